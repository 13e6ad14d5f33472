"""Moments, long-run variance, Sharpe intervals, tests and change points.

Series tables carry one row per (key, session) and a position ``pos``. Whatever
is long is worked on in blocks (``rolling``); what is per key is a grouped sum,
so that any number of strategies runs at once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.numeric import normal_cdf, normal_quantile
from tapeloom.operators.scan import POS, number_rows, prefix, rolling, stored, value_cells

YEAR = 252
EPS = 2.220446049250313e-16


def _seq(lo: Column | int, hi: Column | int) -> Column:
    lo = F.lit(lo) if isinstance(lo, int) else lo
    hi = F.lit(hi) if isinstance(hi, int) else hi
    return F.when(hi >= lo, F.sequence(lo.cast("int"), hi.cast("int"))).otherwise(
        F.array().cast("array<int>"))


def _total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)


# --- moments -------------------------------------------------------------------

def sharpe(df: DataFrame, keys: Sequence[str], r: str, per_year: int = YEAR) -> DataFrame:
    """Annualised mean over deviation; null where it is not defined."""
    sd, n = F.stddev_samp(r), F.count(r)
    return df.groupBy(*keys).agg(
        n.alias("n"), F.when((n >= 2) & (sd > 0), F.avg(r) / sd * math.sqrt(per_year)).alias("sharpe"))


def mppm(df: DataFrame, keys: Sequence[str], r: str, rho: float = 1.0, delta_t: float = 1 / YEAR,
         risk_free: float = 0.0) -> DataFrame:
    """Manipulation-proof performance measure; null where a return loses everything."""
    bad = F.min(F.col(r)) <= -1
    le = F.log1p(r) - math.log1p(risk_free)
    if abs(rho - 1.0) < 1e-12:
        return df.groupBy(*keys).agg(
            F.when(~bad, F.avg(F.when(F.col(r) > -1, le)) / delta_t).alias("mppm"))
    z = (1.0 - rho) * le
    top = df.groupBy(*keys).agg(F.max(z).alias("_top"), (F.min(r) <= -1).alias("_bad"))
    j = df.join(top, list(keys)) if keys else df.crossJoin(F.broadcast(top))
    mean = F.first("_top") + F.log(F.sum(F.exp(z - F.col("_top")))) - F.log(F.count(r))
    return j.groupBy(*keys).agg(
        F.when(~F.first("_bad"), mean / ((1.0 - rho) * delta_t)).alias("mppm"))


def profit_factor(pnl: str) -> Column:
    """Gains over losses; infinite without a loss, 0 without a trade."""
    up = F.coalesce(F.sum(F.when(F.col(pnl) > 0, F.col(pnl))), F.lit(0.0))
    down = F.coalesce(-F.sum(F.when(F.col(pnl) < 0, F.col(pnl))), F.lit(0.0))
    return F.when(down > 0, up / down).when(up > 0, F.lit(float("inf"))).otherwise(0.0)


def gain_loss_ratio(pnl: str) -> Column:
    """Gains over losses; null unless there are both."""
    c = F.col(pnl)
    return F.sum(F.when(c > 0, c)) / -F.sum(F.when(c < 0, c))


def l_moments(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """L-moments 1 to 3 and L-skewness from value cells.

    Equal values share one cell; the sums of (i-1) and (i-1)(i-2) over its ranks have closed
    forms without differences of large numbers.
    """
    k, f, n, v = (F.col(c).cast("double") for c in ("_k", "_from", "_n", "_v"))
    first = k * f + k * (k - 1) / 2
    second = k * f * (f - 1) + f * k * (k - 1) + k * (k - 1) * (k - 2) / 3
    m = value_cells(df, keys, x).groupBy(*keys, F.col("_n").alias("n")).agg(
        (F.sum(v * k) / F.max(n)).alias("b0"), F.try_divide(F.sum(v * first), F.max(n * (n - 1))).alias("b1"),
        F.try_divide(F.sum(v * second), F.max(n * (n - 1) * (n - 2))).alias("b2"))
    l2 = 2 * F.col("b1") - F.col("b0")
    l3 = F.when(F.col("n") >= 3, 6 * F.col("b2") - 6 * F.col("b1") + F.col("b0"))
    return m.select(*keys, "n", F.col("b0").alias("lambda1"), l2.alias("lambda2"), l3.alias("lambda3"),
                    F.try_divide(l3, l2).alias("tau3"))


# --- autocovariance ------------------------------------------------------------

def autocovariances(series: DataFrame, keys: Sequence[str], r: str, lags: int, small: bool = False) -> DataFrame:
    """Per key: n, mean and the array of autocovariances 0..lags with divisor n.

    ``small`` says that a key's rows are bounded (a replicate of a session
    series) and takes one plain window instead of blocks.
    """
    keys = list(keys)
    m = series.groupBy(*keys).agg(F.avg(r).alias("_mean"), F.count(r).alias("_n"))
    c = series.select(*keys, POS, r).join(m, keys) if keys else series.select(POS, r).crossJoin(F.broadcast(m))
    c = c.withColumn("_c", F.col(r) - F.col("_mean"))

    def lagged(d, w):
        return d.withColumns({f"_p{k}": F.col("_c") * F.lag("_c", k).over(w) for k in range(1, lags + 1)})

    d = lagged(c, Window.partitionBy(*keys).orderBy(POS)) if small else rolling(c, keys, lags, lagged)
    n = F.col("_n").cast("double")
    return d.groupBy(*keys, "_n", "_mean").agg(
        F.sum(F.col("_c") * F.col("_c")).alias("_s0"),
        *[F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)).alias(f"_s{k}") for k in range(1, lags + 1)]
    ).select(*keys, F.col("_n").alias("n"), F.col("_mean").alias("mean"),
             F.array(*[F.col(f"_s{k}") / n for k in range(lags + 1)]).alias("g"))


def _g(j) -> Column:
    """Autocovariance at lag j (0 beyond the computed lags)."""
    return F.coalesce(F.get("g", j if isinstance(j, Column) else F.lit(j)), F.lit(0.0))


def nw_first_lags(n) -> int | Column:
    if isinstance(n, Column):
        return F.greatest(F.lit(1), F.floor(4.0 * F.pow(n / 100.0, F.lit(2.0 / 9.0)))).cast("int")
    return max(1, math.floor(4.0 * (n / 100.0) ** (2.0 / 9.0)))


def nw_bandwidth() -> Column:
    """Automatic Newey-West (1994) Bartlett bandwidth from the columns n and g."""
    n = F.col("n").cast("double")
    m = nw_first_lags(n)
    s0 = _g(0) + 2 * _total(F.transform(_seq(1, m), lambda j: _g(j)))
    s1 = 2 * _total(F.transform(_seq(1, m), lambda j: j * _g(j)))
    raw = 1.1447 * F.pow(F.pow(s1 / s0, 2), F.lit(1.0 / 3.0)) * F.pow(n, F.lit(1.0 / 3.0))
    bw = F.when(F.abs(s0) < EPS, 0).otherwise(F.bround(raw, 0).cast("int"))
    return F.greatest(F.lit(0), F.least(bw, (F.col("n") - 1).cast("int")))


def andrews_bandwidth(num: Column, den: Column) -> Column:
    """AR(1) plug-in Bartlett bandwidth; rho = num/den of the lag-one regression."""
    n = F.col("n").cast("double")
    rho = F.greatest(F.lit(-0.999), F.least(F.lit(0.999), F.when(den > 0, num / den).otherwise(0.0)))
    a1 = 4 * rho * rho / (F.pow(1 - rho, 2) * F.pow(1 + rho, 2))
    raw = 1.1447 * F.pow(a1 * n, F.lit(1.0 / 3.0))
    return F.greatest(F.lit(0), F.least(F.bround(raw, 0).cast("int"), (F.col("n") - 1).cast("int")))


def long_run_variance(bw: Column) -> Column:
    """Bartlett-weighted sum of the autocovariances up to ``bw``, not below 0."""
    tail = _total(F.transform(_seq(1, bw), lambda j: (1 - j / (bw + 1.0)) * _g(j)))
    return F.greatest(_g(0) + 2 * tail, F.lit(0.0))


def with_nw_bandwidth(series: DataFrame, keys: Sequence[str], r: str, extra_lags: int = 0) -> DataFrame:
    """Autocovariances with as many lags as the chosen bandwidths need, and ``bw``.

    Two scalars reach the driver: the longest series and the widest bandwidth.
    """
    series = stored(series)
    longest = series.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    lags = max(nw_first_lags(longest), extra_lags)
    a = autocovariances(series, keys, r, min(lags, max(longest - 1, 1))).withColumn("bw", nw_bandwidth())
    widest = a.agg(F.max("bw")).first()[0] or 0
    if widest > lags:
        a = autocovariances(series, keys, r, widest).withColumn("bw", nw_bandwidth())
    return a


def hac_variances(series: DataFrame, keys: Sequence[str], r: str, fixed: int) -> DataFrame:
    """Long-run variance with the automatic, the AR(1) plug-in and a fixed bandwidth."""
    series = stored(series)
    a = with_nw_bandwidth(series, keys, r, fixed)
    # The plug-in regression leaves the last value out of its denominator.
    end = series.groupBy(*keys).agg(F.max_by(r, POS).alias("_end"))
    a = a.join(end, list(keys)).withColumn("bw_ar1", andrews_bandwidth(
        _g(1) * F.col("n"), _g(0) * F.col("n") - F.pow(F.col("_end") - F.col("mean"), 2)))
    widest = a.agg(F.max("bw_ar1"), F.max(F.size("g"))).first()
    if widest[0] is not None and widest[0] >= widest[1]:
        more = autocovariances(series, keys, r, widest[0]).select(*keys, "g")
        a = a.drop("g").join(more, list(keys))
    return a.select(*keys, "n", F.col("bw").alias("bw_auto"), "bw_ar1",
                    long_run_variance(F.col("bw")).alias("lrv_auto"),
                    long_run_variance(F.col("bw_ar1")).alias("lrv_ar1"),
                    long_run_variance(F.lit(fixed)).alias("lrv_fixed"))


def sharpe_intervals(series: DataFrame, keys: Sequence[str], r: str, confidence: float = 0.95) -> DataFrame:
    """Four intervals of the per-period Sharpe ratio: iid, HAC ratio, eta(q) and
    higher moments (with the iid form where its variance is not positive)."""
    series = stored(series)
    a = stored(with_nw_bandwidth(series, keys, r))
    m = series.join(a.select(*keys, F.col("mean").alias("_m")), list(keys)).groupBy(*keys).agg(
        F.stddev_samp(r).alias("_sd"), F.avg(F.pow(F.col(r) - F.col("_m"), 3)).alias("_m3"),
        F.avg(F.pow(F.col(r) - F.col("_m"), 4)).alias("_m4"))
    d = a.join(m, list(keys)).withColumn("lrv", long_run_variance(F.col("bw")))
    n, s = F.col("n").cast("double"), F.try_divide("mean", "_sd")
    var0 = F.nullif(_g(0), F.lit(0.0))
    base = (1 + s * s / 2) / n
    q = F.greatest(F.lit(2), F.col("bw") + 1)
    eta = F.greatest(F.lit(0.0), 1 + 2 * _total(F.transform(
        _seq(1, q - 1), lambda k: (1 - k / q.cast("double")) * _g(k) / var0)))
    s0 = F.col("mean") / F.sqrt(var0)
    skew, kurt = F.col("_m3") / F.pow(var0, 1.5), F.col("_m4") / (var0 * var0) - 3
    raw = (1 + s0 * s0 * (kurt + 2) / 4 - s0 * skew) / n
    moment = F.when(raw > 0, raw * F.col("lrv") / var0).otherwise((1 + s0 * s0 / 2) / n)
    z = normal_quantile(0.5 + confidence / 2)
    forms = [("iid", s, base), ("hac_ratio", s, base * F.col("lrv") / var0), ("eta", s, base * eta),
             ("moments", s0, moment)]
    return d.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(k).alias("method"), p.alias("sharpe"), (p - z * F.sqrt(v)).alias("lower"),
                 (p + z * F.sqrt(v)).alias("upper"), v.alias("variance")) for k, p, v in forms])).alias("_x")
                    ).select(*keys, "_x.*")


def block_length(series: DataFrame, keys: Sequence[str], r: str, circular: bool = False) -> DataFrame:
    """Flat-top automatic block length (Politis and White 2004) per key."""
    series = stored(series)
    longest = series.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    k_n = lambda n: max(5, math.ceil(math.sqrt(math.log10(max(n, 10)))))
    lags = min(max(math.ceil(math.sqrt(longest)) + 2 * k_n(longest), k_n(longest) + 1), max(longest - 1, 1))
    a = autocovariances(series, keys, r, lags)
    n = F.col("n").cast("double")
    ln = F.log10(F.greatest(n, F.lit(10.0)))
    a = a.withColumn("_kn", F.greatest(F.lit(5), F.ceil(F.sqrt(ln)).cast("int")))
    kmax = F.least(F.greatest(F.least(n - 1, F.ceil(F.sqrt(n)) + 2 * F.col("_kn")), F.col("_kn") + 1), n - 1)
    a = a.withColumns({"_km": kmax.cast("int"), "_th": 2 * F.sqrt(ln / n)})
    big = F.transform("g", lambda x: F.abs(x / _g(0)) >= F.col("_th"))
    a = a.withColumn("_big", big)
    quiet = F.filter(_seq(0, F.col("_km") - F.col("_kn") - 1), lambda m: ~F.exists(
        F.slice("_big", m + 2, F.col("_kn")), lambda b: b))
    loud = F.filter(_seq(1, F.col("_km")), lambda k: F.get("_big", k))
    a = a.withColumn("m_hat", F.coalesce(F.get(quiet, F.lit(0)), F.array_max(loud), F.lit(0)))
    a = a.withColumn("M", F.least(F.greatest(2 * F.col("m_hat"), F.lit(2)), F.col("_km")))
    lam = lambda k: F.least(F.lit(1.0), 2 * (1 - k / F.col("M")))
    g0 = _g(0) + 2 * _total(F.transform(_seq(1, F.col("M")), lambda k: lam(k) * _g(k)))
    gg = 2 * _total(F.transform(_seq(1, F.col("M")), lambda k: lam(k) * k * _g(k)))
    a = a.withColumns({"_g0": g0, "_gg": gg})
    dd = (4.0 / 3.0 if circular else 2.0) * F.col("_g0") * F.col("_g0")
    b = F.pow(2 * F.col("_gg") * F.col("_gg") / dd, F.lit(1 / 3.0)) * F.pow(n, F.lit(1 / 3.0))
    flat = (_g(0) <= EPS) | (dd <= EPS) | (F.col("_gg") <= 0)
    return a.select(*keys, "n", "m_hat", "M",
                    F.when(flat, 1.0).otherwise(F.greatest(F.lit(1.0), F.least(b, n))).alias("block_length"))


# --- tests ---------------------------------------------------------------------

def ks_two_sample(df: DataFrame, cols: Sequence[str], second: Column, threshold: float | None = None) -> DataFrame:
    """Kolmogorov-Smirnov test of two row sets per column, with Benjamini-Hochberg.

    Rows are counted by value before any order is made; the two distribution
    functions are running sums over the distinct values.
    """
    long = df.select(second.alias("_b"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])).alias("_s")
    ).select("_b", "_s.*").filter(F.col("v").isNotNull())
    cells = stored(long.groupBy("column", "v").agg(
        F.count_if(~F.col("_b")).alias("a"), F.count_if(F.col("_b")).alias("b")))
    n = cells.groupBy("column").agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    run = prefix(number_rows(cells, ["column"], ["v"]), ["column"], {
        "fa": ("sum", F.col("a")), "fb": ("sum", F.col("b"))})
    d = run.join(F.broadcast(n), "column").groupBy("column", "n1", "n2").agg(
        F.max(F.abs(F.col("fa") / F.col("n1") - F.col("fb") / F.col("n2"))).alias("d"))
    lam = F.col("d") * F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))
    p = 2 * _total(F.transform(_seq(1, 100), lambda k: F.pow(F.lit(-1.0), k - 1) * F.exp(-2 * k * k * lam * lam)))
    p = F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))
    return benjamini_hochberg(d.withColumn("p", p), "p", ["column"], threshold)


def benjamini_hochberg(tests: DataFrame, p: str, tie: Sequence[str], threshold: float | None = None) -> DataFrame:
    """Step-up adjusted p-values (one row per test, so a single window is small)."""
    w = Window.orderBy(p, *tie)
    m = F.count(F.lit(1)).over(Window.partitionBy())
    d = tests.withColumn("_a", F.col(p) * m / F.row_number().over(w))
    up = F.least(F.lit(1.0), F.min("_a").over(w.rowsBetween(0, Window.unboundedFollowing)))
    d = d.withColumn("p_adj", up).drop("_a")
    return d if threshold is None else d.withColumn("alert", F.col("p_adj") < threshold)


def partial_r2(df: DataFrame, base: Sequence[str], extra: Sequence[str], y: str) -> DataFrame:
    """R2 with and without the extra regressors.

    All cross-products come from one aggregate; only p x p numbers are solved here.
    """
    import numpy as np

    cols = [*base, *extra, y]
    agg = [F.count(F.lit(1)).cast("double").alias("n")] + [F.avg(c).alias(f"m_{c}") for c in cols] + [
        F.covar_pop(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    row = df.dropna(subset=cols).agg(*agg).first()
    k = len(cols)
    s = np.array([[row[f"c_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])

    def r2(idx):
        sxx, sxy = s[np.ix_(idx, idx)], s[idx, k - 1]
        return float(sxy @ np.linalg.lstsq(sxx, sxy, rcond=None)[0] / s[k - 1, k - 1])

    a, b = r2(list(range(len(base)))), r2(list(range(k - 1)))
    return df.sparkSession.createDataFrame(
        [(int(row["n"]), a, b, b - a)], "n long, r2_base double, r2_full double, increment double")


def mediation(keys: Sequence[str], df: DataFrame, x: str, m: str, y: str) -> DataFrame:
    """Indirect and direct effect of x on y through m, from grouped covariances."""
    s = df.groupBy(*keys).agg(
        F.var_pop(x).alias("xx"), F.var_pop(m).alias("mm"), F.covar_pop(x, m).alias("xm"),
        F.covar_pop(x, y).alias("xy"), F.covar_pop(m, y).alias("my"), F.count(F.lit(1)).alias("n"))
    xx, mm, xm, xy, my = (F.col(c) for c in ("xx", "mm", "xm", "xy", "my"))
    det = mm * xx - xm * xm
    b, c = F.try_divide(my * xx - xy * xm, det), F.try_divide(xy * mm - my * xm, det)
    return s.select(*keys, "n", (F.try_divide(xm, xx) * b).alias("nie"), c.alias("nde"))


def pc1(df: DataFrame, vec: str, keep: Sequence[str]) -> DataFrame:
    """Scores on the first principal component of the standardised columns, and its share.

    The sign makes the largest loading positive.
    """
    import numpy as np
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.select(*keep, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    scaled = StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True).fit(v).transform(v)
    model = PCA(k=1, inputCol="_z", outputCol="_pc").fit(scaled)
    load = np.asarray(model.pc.toArray())[:, 0]
    sign = 1.0 if load[np.argmax(np.abs(load))] >= 0 else -1.0
    out = model.transform(scaled)
    return out.select(*keep, (vector_to_array("_pc")[0] * sign).alias("score"),
                      F.lit(float(model.explainedVariance[0])).alias("share"))


# --- power ---------------------------------------------------------------------

def sharpe_variance(s: Column, n: Column, skew: Column, kurt: Column, rho: Column) -> Column:
    return (1 - skew * s + (kurt - 1) * s * s / 4) / n * (1 + rho) / (1 - rho)


def power_at(s: Column, n: Column, skew: Column, kurt: Column, rho: Column, alpha: float = 0.05) -> Column:
    z = normal_quantile(1 - alpha)
    se0 = F.sqrt(sharpe_variance(F.lit(0.0), n, skew, kurt, rho))
    se1 = F.sqrt(sharpe_variance(s, n, skew, kurt, rho))
    return 1 - normal_cdf((z * se0 - s) / se1)


def required_n(s: Column, skew: Column, kurt: Column, rho: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Smallest n with the power: both errors shrink with sqrt(n), so n is explicit."""
    one = F.lit(1.0)
    a0 = F.sqrt(sharpe_variance(F.lit(0.0), one, skew, kurt, rho))
    a1 = F.sqrt(sharpe_variance(s, one, skew, kurt, rho))
    root = F.try_divide(normal_quantile(1 - alpha) * a0 + normal_quantile(power) * a1, s)
    return F.when(s > 0, F.greatest(F.lit(3.0), F.ceil(root * root).cast("double")))


def minimum_effect(df: DataFrame, keys: Sequence[str], n: str, skew: str, kurt: str, rho: str, grid: int = 2000,
                   step: float = 0.0005, power: float = 0.8) -> DataFrame:
    """Smallest effect of a grid that reaches the power (rows: keys x grid)."""
    g = df.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(grid)))).withColumn("effect", F.col("_i") * step)
    ok = power_at(F.col("effect"), F.col(n).cast("double"), F.col(skew), F.col(kurt), F.col(rho)) >= power
    return g.groupBy(*keys).agg(F.min(F.when(ok, F.col("effect"))).alias("mde"))


# --- change points, regret, divergence -------------------------------------------

def glr_scan(series: DataFrame, keys: Sequence[str], x: str, alpha: float = 0.05) -> DataFrame:
    """Largest mean-shift statistic over all cuts, against log(3 n^1.5 / alpha)."""
    series = stored(series)
    tot = series.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("_m"), F.var_pop(x).alias("_v"))
    run = prefix(series, keys, {"_s": ("sum", F.col(x))}).join(tot, list(keys))
    k, n = (F.col(POS) + 1).cast("double"), F.col("n").cast("double")
    left = F.col("_s") / k
    right = F.try_divide(F.col("_m") * n - F.col("_s"), n - k)
    g = 0.5 * (k * F.pow(left - F.col("_m"), 2) + (n - k) * F.pow(right - F.col("_m"), 2)) / F.nullif(F.col("_v"), F.lit(0.0))
    ok = (k >= 2) & (k <= n - 2) & (F.col("_v") > 1e-12)
    out = run.groupBy(*keys, "n").agg(
        F.coalesce(F.max(F.when(ok, g)), F.lit(0.0)).alias("glr"),
        F.max_by(k.cast("long"), F.when(ok, F.struct(g, -k))).alias("cut"))
    limit = F.log(3 * F.pow(n, 1.5) / alpha)
    return out.withColumns({"threshold": limit, "change": F.col("glr") > limit})


def regret(rewards: DataFrame, step: str, arm: str, reward: str, chosen: Column) -> DataFrame:
    """Running regret of the logged choices, with the best-arm and equal-weight totals."""
    t = rewards.groupBy(step).agg(
        F.max(reward).alias("best"), F.avg(reward).alias("equal"),
        F.max(F.when(chosen, F.col(reward))).alias("got"))
    d = number_rows(t.filter(F.col("got").isNotNull()), [], [step])
    return prefix(d, [], {"regret": ("sum", F.col("best") - F.col("got")), "equal_total": ("sum", F.col("equal"))}).drop(POS)


def softmax(v: Column) -> Column:
    e = F.transform(v, lambda x: F.exp(x.cast("double")))
    # The total goes in as an array, so that it is summed once per row.
    return F.zip_with(e, F.array_repeat(_total(e), F.size(e)), lambda x, t: x / t)


def hellinger(p: Column, q: Column) -> Column:
    return F.sqrt(0.5 * _total(F.zip_with(p, q, lambda a, b: F.pow(F.sqrt(a) - F.sqrt(b), 2))))


def total_variation(p: Column, q: Column) -> Column:
    return 0.5 * _total(F.zip_with(p, q, lambda a, b: F.abs(a - b)))


def nig_prior(df: DataFrame, keys: Sequence[str], r: str, alpha0: float, kappa0: float, least: int = 50) -> DataFrame:
    """Prior moments from pooled returns; keys with too few rows or no variance drop out."""
    if alpha0 <= 1 or kappa0 <= 0:
        raise ValueError("need alpha0 > 1 and kappa0 > 0")
    return df.groupBy(*keys).agg(
        F.count(r).alias("n"), F.avg(r).alias("mu0"), F.var_samp(r).alias("_v")
    ).filter((F.col("n") >= least) & (F.col("_v") > 0)).select(
        *keys, "n", "mu0", F.lit(float(kappa0)).alias("kappa0"), F.lit(float(alpha0)).alias("alpha0"),
        ((alpha0 - 1) * F.col("_v")).alias("beta0"))


def pareto(df: DataFrame, x: str, y: str) -> DataFrame:
    """Flag rows that no other row beats in one measure without losing in the other.

    One scan from the best x downwards keeps the best y so far; no pairs are formed.
    """
    df = stored(df)
    best = df.groupBy(x).agg(F.max(y).alias("_top"))
    run = prefix(number_rows(best, [], [x]), [], {"_above": ("max", F.col("_top"))}, inclusive=False, reverse=True)
    j = df.join(run.select(x, "_top", "_above"), x)
    beaten = (F.col("_above") >= F.col(y)) | (F.col("_top") > F.col(y))
    return j.withColumn("efficient", ~F.coalesce(beaten, F.lit(False))).drop("_top", "_above")


def cpcv_sharpes(obs: DataFrame, segments: DataFrame, y: str, idx: str = "idx") -> DataFrame:
    """Sharpe of every split: the sign of the training mean, held over the test rows."""
    from tapeloom.operators.splits import members

    m = members(obs, segments, idx)
    side = m.filter("role = 'train'").groupBy("fold_id").agg(F.signum(F.avg(y)).alias("_side"))
    t = m.filter("role = 'test'").join(F.broadcast(side), "fold_id").withColumn("_r", F.col("_side") * F.col(y))
    return sharpe(t, ["fold_id"], "_r")


def path_summary(paths: DataFrame, first: int = 30) -> DataFrame:
    """Deflated median Sharpe over split paths, spread, and how far the first paths
    are from all of them (one row per path: a small table)."""
    s = F.col("sharpe")
    n = F.count(s).cast("double")
    gamma = 0.5772156649015329
    agg = paths.agg(n.alias("n"), F.percentile(s, F.lit(0.5)).alias("median"), F.avg(s).alias("mean"),
                    F.stddev_samp(s).alias("std"), F.percentile(s, F.lit(0.05)).alias("q05"),
                    F.percentile(s, F.lit(0.95)).alias("q95"))
    count = paths.filter(s.isNotNull()).count()
    e_max = 0.0
    if count >= 2:
        e_max = ((1 - gamma) * normal_quantile(1 - 1 / count) + gamma * normal_quantile(1 - 1 / (count * math.e)))
    w = Window.orderBy("sharpe").rangeBetween(Window.unboundedPreceding, 0)
    head = paths.filter(s.isNotNull()).withColumn("_rk", F.row_number().over(Window.orderBy("fold_id")))
    head = head.withColumn("_in", (F.col("_rk") <= first).cast("double"))
    ks = head.withColumn("_d", F.abs(F.sum("_in").over(w) / min(first, max(count, 1))
                                     - F.count(F.lit(1)).over(w) / max(count, 1))).agg(F.max("_d").alias("ks"))
    out = agg.crossJoin(F.broadcast(ks))
    dsr = F.when(F.col("std") > 0, F.col("median") - F.col("std") * e_max).otherwise(F.col("median"))
    return out.select(F.col("n").cast("long").alias("n"), "median", "mean", "std", "q05", "q95", dsr.alias("deflated"),
                      F.when(F.col("n") >= first, F.col("ks")).alias("ks"),
                      F.coalesce((F.col("n") >= first) & (F.col("ks") <= 0.05), F.lit(False)).alias("monotone"))
