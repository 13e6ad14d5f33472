"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from tapeloom.operators import bootstrap as bs
from tapeloom.operators import inference as inf
from tapeloom.plans import catalog
from tapeloom.plans.statistics import K, SYM, numbered, paired, panel
from tapeloom.session import local_session

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
REPS = 1000

NAMED = [
    "flagship_trend_basket", "d1_resample_ohlcv", "e1_rv_realized", "e2_rv_parkinson", "e3_realized_skew",
    "e4_ofi_tickrule", "e5_microstructure_block", "e14_donchian", "e16_first_fire", "e22_wilder_atr", "e37_back_adjust",
    "c4_asof_join", "c5_news_window_join", "l1_triple_barrier", "l5_bracket_outcomes", "p3_cpcv_split", "q2_sharpe_intervals",
    "q8_l_moments", "q9_ks_benjamini_hochberg", "q23_ruin_projection", "r6_daily_breaker", "r9_rule_report",
    "a5_page_text", "w1_stream_bars", "e19_adx_side", "e20_hac_slope_side", "d20_trend_competition", "q15_cpcv_path_sharpe",
    "q24_log_optimal_fraction", "w6_batch_decay", "w9_batch_ladder", "w7_trigger_counts", "y1_elastic_net", "y3_calibrated_scores",
]


def scaled():
    """The bootstrap family with 1000 replicates."""
    return {
        "q11_bootstrap_1000": lambda s: bs.stationary_bootstrap(numbered(s, SF), K, ["ret"], REPS, 5.0, 42).groupBy(
            "symbol", "rep").avg("ret"),
        "q12_intervals_1000": lambda s: bs.metric_ci(numbered(s, SF), K, ["ret", "pnl"], {
            "pf": inf.profit_factor("pnl")}, REPS, 5.0, 7),
        "q13_sharpe_difference_1000": lambda s: bs.sharpe_difference_ci(paired(s, SF), "a", "b", REPS, 5.0, 13),
        "q14_spa_1000": lambda s: bs.spa_test(panel(s, SF), SYM, REPS, 5.0, 17),
    }


def main() -> None:
    spark = local_session(CPUS, CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    jobs = {n: (lambda s, n=n: catalog.QUERIES[n](s, SF)) for n in NAMED}
    jobs.update(scaled())
    wanted = sys.argv[1:]
    # Start the JVM, the code generator and the Python workers once.
    catalog.QUERIES["d1_resample_ohlcv"](spark, SF).count()
    times = {}
    for name, job in jobs.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.perf_counter()
        job(spark).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": SF.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
