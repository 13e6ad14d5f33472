"""Structured Streaming jobs: bars, sliding windows, sessions, joins and stateful rules.

Sources are file streams; a run takes what is there (``availableNow``) and leaves a
table and a checkpoint in the shared folder, so that a lost executor or driver
continues where the last micro-batch ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeloom.operators.joins import band_counts, nearest_within
from tapeloom.operators.scan import stored
from tapeloom.session import load, scratch_path
from tapeloom.streaming.state import (
    PAUSE_COLUMNS, Account, Detector, Limits, Pause, StepUp, decay_path, guard_entries, ladder_step, new_ladder, new_pause, pause_rows,
)


def table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One given table as a stream of files."""
    schema = load(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}*.parquet")


# Rows of a slice that a micro-batch takes; a longer slice is cut at its finer calendar.
SLICE_ROWS = 2_000_000
# Rows of an arrival have a bound, so it is dealt to few files, and the keys of its accounts to few states:
# each is a task of every micro-batch.
ARRIVAL_PARTS = 24


def _arrivals(sizes: list[tuple], rows: int) -> list[tuple]:
    """(slice, first, last) of each arrival: consecutive parts of a slice with up to ``rows`` rows in all, or one part."""
    out: list[list] = []
    held = 0
    for s, part, n in sizes:
        if out and out[-1][0] == s and held + n <= rows:
            out[-1][2], held = part, held + n
        else:
            out.append([s, part, part])
            held = n
    return [tuple(o) for o in out]


def frame_stream(df: DataFrame, name: str, by: list[str] | None = None, slices: Column | None = None,
                 finer: Column | None = None, rows: int | None = None,
                 pack: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A batch frame written out and read again as a stream.

    With ``slices`` (a calendar column) the frame arrives slice after slice, the rows
    of a key in one file per arrival. A slice with more than ``rows`` rows arrives in several
    parts, cut where ``finer`` (a finer calendar column) changes, so its rows don't grow with the
    table. A micro-batch takes as many files as the largest arrival has: a key keeps its order
    and never hands more than about two arrivals to a task. ``pack`` shapes the rows of an
    arrival before they are dealt to its files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = pack(df).schema if pack and slices is not None else df.schema
    reader = spark.readStream.schema(schema)
    if slices is None:
        df.write.parquet(path)
        return reader.parquet(path)
    parts = ["_slice", "_part"]
    whole = df.withColumns({"_slice": slices, "_part": slices if finer is None else finer})
    # Every file is ordered by calendar: an arrival reads its own pages, and all tasks have some of them.
    held = scratch_path(spark, f"{name}-held")
    whole.repartition(*(by or []), *parts).sortWithinPartitions(*parts).write.parquet(held)
    kept = spark.read.schema(whole.schema).parquet(held)
    sizes = [tuple(r) for r in kept.groupBy(*parts).count().orderBy(*parts).collect()]
    files, seen, tasks = 1, 0, min(ARRIVAL_PARTS, int(spark.conf.get(_PARTITIONS)))
    for s, first, last in _arrivals(sizes, rows or SLICE_ROWS):
        here = kept.filter((F.col("_slice") == F.lit(s)) & F.col("_part").between(F.lit(first), F.lit(last)))
        here = here.drop(*parts)
        (pack(here) if pack else here).repartition(tasks, *by).write.mode("append").parquet(path)
        # Keys leave some of the partitions empty, and those have no file.
        now = len(spark.read.schema(schema).parquet(path).inputFiles())
        files, seen = max(files, now - seen), now
    return reader.option("maxFilesPerTrigger", files).parquet(path)


def run_to_table(stream: DataFrame, name: str, place: str | None = None, states: int | None = None) -> DataFrame:
    """Run a stream over all present input and return its output table.

    With the ``place`` of an earlier run it goes on where that one ended. ``states`` bounds the
    partitions of the state where keys are few: a micro-batch commits each of them, used or not.
    """
    spark = stream.sparkSession
    place = place or scratch_path(spark, name)
    # State that is kept in parts (lists, values) needs this store; the caller's settings come back after the start.
    conf = {_PROVIDER: _ROCKS}
    if states is not None:
        conf[_PARTITIONS] = str(min(states, int(spark.conf.get(_PARTITIONS))))
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        q = (stream.writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start(f"{place}/out"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


# --- windows ---------------------------------------------------------------------

def stream_bars(ticks: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Right-closed, right-labelled bars; a tick later than ``delay`` is dropped.

    Moving the clock back by one microsecond turns [start, end) into (start, end].
    """
    t = ticks.withColumn("at", F.col("ts") - F.expr("INTERVAL 0.000001 SECOND")).withWatermark("at", delay)
    order = F.struct("ts", "seq")
    return t.groupBy("symbol", F.window("at", width).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("n")
    ).select("symbol", F.col("w.end").alias("bar_ts"), "open", "high", "low", "close", "volume", "n")


def stream_sliding_variance(r2: DataFrame, length: str, slide: str, delay: str) -> DataFrame:
    """Realised variance in sliding windows over pre-computed squared returns."""
    return r2.withWatermark("bar_ts", delay).groupBy("symbol", F.window("bar_ts", length, slide).alias("w")).agg(
        F.sum("r2").alias("rv"), F.count("r2").alias("n")).select(
        "symbol", F.col("w.end").alias("end_ts"), "rv", "n")


def stream_gap_sessions(events: DataFrame, keys: list[str], gap: str, delay: str) -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n")).select(
        *keys, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


def stream_distinct(events: DataFrame, keys: list[str], delay: str) -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys).select(*keys)


# --- joins -----------------------------------------------------------------------

def nearest_releases(ticks: DataFrame, releases: DataFrame, minutes: int) -> Callable[[DataFrame], DataFrame]:
    """What a micro-batch of ticks (event_id, ts) becomes: each with the nearest release (release_id, release_ts)
    at most ``minutes`` away, the earlier of two equally near, and how many there are in its window.

    Only the last release before and the first one after can be nearest, and a count is a difference
    of running counts, so a tick never meets all releases. Of the releases only those around the
    batch's own time are read.
    """
    us = minutes * 60_000_000
    gap = F.expr(f"INTERVAL {minutes} MINUTES")

    def of_batch(batch: DataFrame) -> DataFrame:
        batch = stored(batch.select(*ticks.columns))
        span = batch.agg((F.min("ts") - gap).alias("_from"), (F.max("ts") + gap).alias("_to"))
        near = releases.crossJoin(F.broadcast(span)).filter(F.col("release_ts").between(F.col("_from"), F.col("_to"))).select(
            F.col("release_ts").alias("ts"), "release_id")
        near = stored(near)
        hit = nearest_within(batch, near, [], "ts", "event_id", ["release_id"], us).filter(F.col("release_id").isNotNull())
        counts = band_counts(batch, near.select("ts"), "ts", us).select("event_id", F.col("n_near").alias("n_releases"))
        return hit.select("event_id", "release_id", "distance_us").join(counts, "event_id")

    return of_batch


def run_each_batch(stream: DataFrame, name: str, of_batch: Callable[[DataFrame], DataFrame], place: str | None = None) -> DataFrame:
    """Run a batch job over every micro-batch of the present input and return all its rows.

    A micro-batch writes its own folder anew, so one that is run again leaves its rows once;
    with the ``place`` of an earlier run it goes on where that one ended.
    """
    spark = stream.sparkSession
    place = place or scratch_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        of_batch(batch).write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{place}/out").drop("batch")


def stream_interval_join(left: DataFrame, right: DataFrame, key: str, minutes: int, delay: str) -> DataFrame:
    """Two streams on a key and within +-minutes; watermarks bound the kept rows."""
    a = left.withWatermark("ts", delay).alias("a")
    b = right.withWatermark("release_ts", delay).alias("b")
    gap = F.expr(f"INTERVAL {minutes} MINUTES")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.ts") >= F.col("b.release_ts") - gap) & (
        F.col("a.ts") <= F.col("b.release_ts") + gap)
    return a.join(b, on).select("a.*", "b.release_id", "b.release_ts")


# --- state -----------------------------------------------------------------------

def _ordered(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """The rows of one key in a micro-batch, in time order."""
    parts = list(batches)
    return _sorted(pd.concat(parts), by) if parts else pd.DataFrame()


def _sorted(pdf: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    keys = [pdf[c].to_numpy() for c in by]
    if any(k.dtype.kind not in "iufM" for k in keys):
        return pdf.sort_values(by, kind="stable")
    # Numbers and instants need no codes of their own.
    return pdf.iloc[np.lexsort(keys[::-1])]


DECAY_OUT = ("symbol string, session date, posterior double, paused boolean, event string, entered date, "
             "entered_posterior double, duration int")
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_PARTITIONS = "spark.sql.shuffle.partitions"


def _decay_frame(symbol: str, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=PAUSE_COLUMNS)
    out.insert(0, "symbol", symbol)
    # Columns without a value in this frame keep their types.
    return out.astype({"duration": "Int32", "entered_posterior": "Float64"})


class _DecayProcessor(StatefulProcessor):
    """The detector of one symbol: run lengths and waiting orders are lists in the state store, the pause one value."""

    def __init__(self, cfg: Detector) -> None:
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getListState("runs", "logp double, mu double, beta double")
        self.orders = handle.getListState("orders", "session date")
        self.head = handle.getValueState(
            "head", "seen int, paused boolean, since int, entered date, entered_posterior double, posterior double, session date")

    def _read(self) -> Pause:
        if not self.head.exists():
            return new_pause(self.cfg)
        run = tuple(np.array(c) for c in zip(*self.runs.get()))
        seen, paused, since, entered, mass, posterior, session = self.head.get()
        waiting = tuple(r[0] for r in self.orders.get()) if self.orders.exists() else ()
        return Pause(run, seen, paused, since, entered, mass, posterior, session, waiting)

    def _write(self, st: Pause) -> None:
        self.runs.put(list(zip(*(part.tolist() for part in st.run))))
        if st.commands:
            self.orders.put([(d,) for d in st.commands])
        elif self.orders.exists():
            self.orders.clear()
        self.head.update((st.seen, st.paused, st.since, st.entered, st.entered_posterior, st.posterior, st.session))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        pdf = _ordered(rows, ["session"])
        if pdf.empty:
            return
        order = pdf["ret"].isna() & pdf["resume"]
        st, out = pause_rows(self._read(), list(zip(pdf["session"][~order], pdf["ret"][~order].astype(float))),
                             list(pdf["session"][order]), self.cfg)
        self._write(st)
        if out:
            yield _decay_frame(key[0], out)

    def close(self) -> None:
        pass


def _with_orders(returns: DataFrame, orders: DataFrame | None) -> DataFrame:
    """Returns and operators' orders (symbol, session) in one frame; a return that is null is no observation."""
    rows = returns.filter(F.col("ret").isNotNull()).select("symbol", "session", F.col("ret").cast("double").alias("ret"), F.lit(False).alias("resume"))
    if orders is None:
        return rows
    return rows.unionByName(orders.select("symbol", "session", F.lit(None).cast("double").alias("ret"), F.lit(True).alias("resume")))


def stream_decay(returns: DataFrame, cfg: Detector, orders: DataFrame | None = None) -> DataFrame:
    """Pause and resume signals from session returns, one detector per symbol.

    ``orders`` is a second stream (symbol, session) of operators' orders to resume. Rows that
    resume (event ``resume`` or ``manual``) are the pause log: entry, exit and duration.
    Sessions of a symbol must arrive in order over the micro-batches, in any order within one.
    """
    return _with_orders(returns, orders).groupBy("symbol").transformWithStateInPandas(
        _DecayProcessor(cfg), DECAY_OUT, "append", "None")


def batch_decay(returns: DataFrame, cfg: Detector, orders: DataFrame | None = None) -> DataFrame:
    """Batch twin over many series; a series has one row per session."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("session", kind="stable")
        o = pdf["resume"]
        rows = pause_rows(new_pause(cfg), list(zip(pdf["session"][~o], pdf["ret"][~o].astype(float))), list(pdf["session"][o]), cfg)[1]
        return _decay_frame(pdf["symbol"].iloc[0], rows)

    return _with_orders(returns, orders).groupBy("symbol").applyInPandas(run, DECAY_OUT)


def pause_log(signals: DataFrame) -> DataFrame:
    """One row per finished pause: its first session and posterior, its last ones, its length and what ended it."""
    return signals.filter(F.col("event").isin("resume", "manual")).select(
        "symbol", "entered", "entered_posterior", F.col("session").alias("exited"), F.col("posterior").alias("exited_posterior"),
        "duration", F.col("event").alias("ended_by"))


def pause_summary(signals: DataFrame) -> DataFrame:
    """Per symbol: finished pauses, paused sessions in all and at most, whether it is paused at the end, refused orders."""
    done = F.col("event").isin("resume", "manual")
    return signals.groupBy("symbol").agg(
        F.count_if(done).alias("pauses"), F.coalesce(F.sum(F.when(done, F.col("duration"))), F.lit(0)).cast("long").alias("paused_sessions"),
        F.coalesce(F.max(F.when(done, F.col("duration"))), F.lit(0)).cast("long").alias("longest"),
        (F.count_if(F.col("event") == "pause") > F.count_if(done)).alias("paused_at_end"),
        F.count_if(F.col("event") == "refused").alias("refused"))


def decay_series(returns: DataFrame, cfg: Detector, by: str = "ret") -> DataFrame:
    """(symbol, session, n, posterior, detected): mass on recent changes over each whole series, 0 in warm-up.

    A series has one row per session, so a calendar bounds it.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("session", kind="stable")
        mass = np.array(decay_path(pdf[by].tolist(), cfg))
        return pd.DataFrame({"symbol": pdf["symbol"].to_numpy(), "session": pdf["session"].to_numpy(), "n": np.arange(1, len(pdf) + 1),
                             "posterior": mass, "detected": mass > cfg.threshold})

    return returns.filter(F.col(by).isNotNull()).select("symbol", "session", by).groupBy("symbol").applyInPandas(
        run, "symbol string, session date, n long, posterior double, detected boolean")


def decay_summary(series: DataFrame) -> DataFrame:
    """Per symbol whether and when the mass first passes the threshold, and its largest value."""
    return series.groupBy("symbol").agg(
        F.bool_or("detected").alias("decayed"), F.min(F.when(F.col("detected"), F.col("session"))).alias("first_session"),
        F.min(F.when(F.col("detected"), F.col("n"))).alias("first_n"), F.max("posterior").alias("max_posterior"))


LADDER_OUT = "symbol string, session date, multiplier double, action string"
LADDER_STATE = ("recent array<double>, n int, path int, logp array<double>, mu array<double>, beta array<double>, "
                "decayed boolean, idx int, checked int")


def _ladder_rows(symbol: str, pdf: pd.DataFrame, st: dict, cfg: StepUp) -> tuple[pd.DataFrame, dict]:
    rows = []
    for day, x in zip(pdf["session"], pdf["ret"]):
        st, action = ladder_step(st, float(x), cfg)
        if action:
            rows.append((symbol, day, cfg.grid[st["idx"]], action))
    return pd.DataFrame(rows, columns=["symbol", "session", "multiplier", "action"]), st


def stream_ladder(returns: DataFrame, cfg: StepUp) -> DataFrame:
    """Sizing steps from session returns, one ladder per symbol."""
    def step(key, batches, state):
        pdf = _ordered(batches, ["session"])
        if state.exists:
            recent, n, path, logp, mu, beta, decayed, idx, checked = state.get
            st = {"recent": list(recent), "n": n, "path": path, "decayed": decayed, "idx": idx, "checked": checked,
                  "run": (np.array(logp), np.array(mu), np.array(beta))}
        else:
            st = new_ladder(cfg)
        out, st = _ladder_rows(key[0], pdf, st, cfg)
        r = st["run"]
        state.update(([float(v) for v in st["recent"]], st["n"], st["path"], r[0].tolist(), r[1].tolist(), r[2].tolist(),
                      bool(st["decayed"]), st["idx"], st["checked"]))
        yield out

    return returns.select("symbol", "session", "ret").groupBy("symbol").applyInPandasWithState(
        step, LADDER_OUT, LADDER_STATE, "append", "NoTimeout")


def batch_ladder(returns: DataFrame, cfg: StepUp) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("session", kind="stable")
        return _ladder_rows(pdf["symbol"].iloc[0], pdf, new_ladder(cfg), cfg)[0]

    return returns.select("symbol", "session", "ret").groupBy("symbol").applyInPandas(run, LADDER_OUT)


def stream_breakers(trades: DataFrame, order: list[str], start: float, daily: float, weekly: float,
                    size_cap: float) -> DataFrame:
    """Reason an entry is blocked: size cap, then daily, then weekly loss limit.

    Per account the state holds equity and the running P&L of the open session and
    week. Trades of a micro-batch are summed by session and week as columns.
    """
    keep = [f for f in trades.schema.fields if f.name in order]
    schema = T.StructType([T.StructField("account", T.StringType()), *keep, T.StructField("reason", T.StringType())])
    # Days as numbers: a date would be an object of its own in the worker.
    trades = trades.withColumn("session", F.unix_date("session"))
    state_schema = "equity double, session long, session_start double, session_pnl double, " \
                   "week long, week_start double, week_pnl double"

    def running(pnl, period, first, before, opening, equity0):
        """P&L of the period before each row and equity at its start."""
        cum = np.concatenate(([0.0], np.cumsum(pnl)))[:-1]
        starts = np.r_[True, period[1:] != period[:-1]]
        block = np.cumsum(starts) - 1
        at = cum[starts][block]
        lost, opened = cum - at, equity0 + at
        if len(period) and period[0] == first:
            same = block == 0
            lost, opened = np.where(same, lost + before, lost), np.where(same, opening, opened)
        return lost, opened

    def step(key, batches, state):
        pdf = _ordered(batches, order)
        if pdf.empty:
            return
        st = state.get if state.exists else (start, None, start, 0.0, -1, start, 0.0)
        equity, ses, ses0, ses_pnl, wk, wk0, wk_pnl = st
        pnl = pdf["pnl"].to_numpy(float)
        day, week = pdf["session"].to_numpy("int64"), pdf["week"].to_numpy("int64")
        lost_d, open_d = running(pnl, day, ses, ses_pnl, ses0, equity)
        lost_w, open_w = running(pnl, week, wk, wk_pnl, wk0, equity)
        reason = np.where(pdf["size"].to_numpy(float) > size_cap, "size_cap",
                          np.where(lost_d < daily * open_d, "daily", np.where(lost_w < weekly * open_w, "weekly", "")))
        state.update((float(equity + pnl.sum()), int(day[-1]), float(open_d[-1]), float(lost_d[-1] + pnl[-1]),
                      int(week[-1]), float(open_w[-1]), float(lost_w[-1] + pnl[-1])))
        out = pdf[order].copy()
        out.insert(0, "account", key[0])
        out["reason"] = reason
        yield out[[f.name for f in schema.fields]]

    return trades.groupBy("account").applyInPandasWithState(step, schema, state_schema, "append", "NoTimeout")


_GUARDED = ["symbol", "size", "pnl", "session", "week", "exit_session", "exit_week"]


def _guard_frame(account, pdf: pd.DataFrame, acc: Account, order: list[str], cfg: Limits) -> tuple[Account, pd.DataFrame]:
    at = [pdf[c].astype("int64").tolist() for c in ("entry_us", "exit_us")]
    acc, reasons = guard_entries(acc, zip(*at, *(pdf[c].tolist() for c in _GUARDED)), cfg)
    out = pdf[[c for c in order if c != "entry_us"]].copy()
    out.insert(0, "account", account)
    out["reason"] = reasons
    return acc, out


class _GuardProcessor(StatefulProcessor):
    """One account: its open positions are a map in the state store, its sums one value."""

    def __init__(self, cfg: Limits, order: list[str]) -> None:
        self.cfg, self.order = cfg, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.positions = handle.getMapState("positions", "number long", "exit_us long, symbol string, pnl double, session date, week long")
        self.sums = handle.getValueState("sums", "equity double, session date, session_equity double, session_pnl double, week long, "
                                                 "week_equity double, week_pnl double, number long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        trades = [pa.ipc.open_stream(b).read_all() for batch in rows for b in batch["trades"]]
        if not trades:
            return
        pdf = _sorted(pa.concat_tables(trades).to_pandas(), self.order)
        before = {}
        acc = Account(self.cfg.start)
        if self.sums.exists():
            before = {k[0]: v for k, v in self.positions.iterator()}
            acc = Account(*self.sums.get(), tuple((v[0], k, *v[1:]) for k, v in before.items()))
        acc, out = _guard_frame(key[0], pdf, acc, self.order, self.cfg)
        after = {p[1]: (p[0], *p[2:]) for p in acc.positions}
        for k in before.keys() - after.keys():
            self.positions.removeKey((k,))
        for k in after.keys() - before.keys():
            self.positions.updateValue((k,), after[k])
        self.sums.update((acc.equity, acc.session, acc.session_equity, acc.session_pnl, acc.week, acc.week_equity, acc.week_pnl, acc.number))
        yield out

    def close(self) -> None:
        pass


def _packed(rows: DataFrame, key: str) -> DataFrame:
    """(key, trades): the rows of a key within an Arrow batch as one Arrow stream.

    Spark hands a stateful processor its rows one by one as Python objects; whole packs
    cost it nothing a row.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(key).dictionary_encode(null_encoding="encode")
            code = keys.indices.to_numpy()
            at = np.argsort(code, kind="stable")
            batch, code = batch.take(pa.array(at)), code[at]
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else code
            packs = []
            for a, b in zip(first, np.r_[first[1:], len(code)]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(a, b - a))
                packs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(code[first])), pa.array(packs, pa.binary())], [key, "trades"])

    return rows.mapInArrow(pack, T.StructType([rows.schema[key], T.StructField("trades", T.BinaryType())]))


def _guard_input(trades: DataFrame, order: list[str]) -> tuple[DataFrame, list[str], T.StructType]:
    keep = [c for c in order if c != "entry_ts"]
    rows = trades.select("account", F.unix_micros("entry_ts").alias("entry_us"), F.unix_micros("exit_ts").alias("exit_us"), *keep,
                         *[F.col(c).cast("double").alias(c) if c in ("size", "pnl") else F.col(c).cast("long").alias(c) if "week" in c else F.col(c) for c in _GUARDED])
    schema = T.StructType([trades.schema["account"], *[rows.schema[c] for c in keep], T.StructField("reason", T.StringType())])
    return rows, ["entry_us", *keep], schema


def guard_packs(trades: DataFrame, order: list[str]) -> DataFrame:
    """What ``stream_guard`` makes of trades before it deals them to accounts."""
    return _packed(_guard_input(trades, order)[0], "account")


def stream_guard(trades: DataFrame, order: list[str], cfg: Limits, packs: DataFrame | None = None) -> DataFrame:
    """Reason each entry of an account is blocked: open position, size cap of the symbol, daily, weekly loss.

    ``trades`` has account, symbol, entry_ts, exit_ts, size, pnl, session, week, exit_session and
    exit_week; ``order`` (entry_ts first) is total. An account's trades arrive in entry order over
    the micro-batches; a micro-batch hands a task no more of an account than it holds itself.
    Where they arrive as ``guard_packs``, ``packs`` is the stream and ``trades`` names the columns.
    """
    _, by, schema = _guard_input(trades, order)
    packs = guard_packs(trades, order) if packs is None else packs
    return packs.groupBy("account").transformWithStateInPandas(_GuardProcessor(cfg, by), schema, "append", "None")


def batch_guard(trades: DataFrame, order: list[str], cfg: Limits) -> DataFrame:
    """Batch twin over the whole ledger of each account.

    Spark sorts the accounts' trades; a worker holds one Arrow batch of them and the open positions.
    """
    rows, by, schema = _guard_input(trades, order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, acc = None, None
        for batch in batches:
            for account, pdf in batch.groupby("account", sort=False, dropna=False):
                # A null account is NaN or None here.
                account = None if pd.isna(account) else account
                if acc is None or account != last:
                    last, acc = account, Account(cfg.start)
                acc, out = _guard_frame(account, pdf, acc, by, cfg)
                yield out

    return rows.repartition("account").sortWithinPartitions("account", *by).mapInPandas(run, schema)


def trigger_counts(guarded: DataFrame, cfg: Limits) -> DataFrame:
    """Per account: entries let in, blocked by each rule, and whether any rule fired."""
    return guarded.groupBy("account").agg(
        F.count_if(F.col("reason") == "").alias("entered"), *[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in cfg.rules],
        F.bool_or(F.col("reason") != "").alias("active"))


# Groups of levels that share a state: a call of the worker takes many levels at once.
LEVEL_BUCKETS = 1024


def stream_levels(touches: DataFrame, r_max: int) -> DataFrame:
    """Rejections, kills and permission per level; the state is a count and a flag of each.

    Levels are dealt to a fixed number of states, and the touches of a state are counted as
    columns, so the calls of the worker don't grow with the levels.
    """
    out_schema = ("level long, fold string, _none boolean, event_id long, rejections long, killed boolean, error boolean, permitted boolean")
    state_schema = "level array<long>, none array<boolean>, fold array<string>, count array<long>, dead array<boolean>"
    rows = touches.select(F.coalesce(F.col("level").cast("long"), F.lit(0)).alias("level"), "fold", F.col("level").isNull().alias("_none"),
                          "event_id", "ts", "kind", F.pmod(F.xxhash64("level", "fold"), F.lit(LEVEL_BUCKETS)).alias("_bucket"))

    def step(key, batches, state):
        pdf = _ordered(batches, ["ts", "event_id"])
        if pdf.empty:
            return
        code = pdf.groupby(["level", "_none", "fold"], sort=False, dropna=False).ngroup().to_numpy()
        at = np.argsort(code, kind="stable")
        pdf, code = pdf.iloc[at], code[at]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        final = np.r_[first[1:], len(code)] - 1
        known = {k[:3]: k[3:] for k in zip(*state.get)} if state.exists else {}
        names = list(zip(*(pdf[c].iloc[first].tolist() for c in ("level", "_none", "fold"))))
        count, dead = (np.array(v) for v in zip(*(known.get(n, (0, False)) for n in names)))

        def running(flags):
            """Flags seen up to each row, in its level."""
            seen = np.cumsum(flags)
            return seen - (seen - flags)[first][code]

        pen = (pdf["kind"] == "penetrate").to_numpy()
        before = dead[code] | (running(pen) - pen > 0)
        error = before & ~pen
        rejections = count[code] + running(~pen & ~error)
        killed = before | pen
        known.update(zip(names, zip(rejections[final].tolist(), killed[final].tolist())))
        state.update(tuple(list(c) for c in zip(*(k + tuple(v) for k, v in known.items()))))
        yield pd.DataFrame({"level": pdf["level"].to_numpy(), "fold": pdf["fold"].to_numpy(), "_none": pdf["_none"].to_numpy(),
                            "event_id": pdf["event_id"].to_numpy(), "rejections": rejections.astype("int64"), "killed": killed,
                            "error": error, "permitted": ~killed & (rejections <= r_max)})

    out = rows.groupBy("_bucket").applyInPandasWithState(step, out_schema, state_schema, "append", "NoTimeout")
    return out.withColumn("level", F.when(~F.col("_none"), F.col("level"))).drop("_none")


def stream_table(spark: SparkSession, sf: str, name: str, build, out: str) -> DataFrame:
    """Build a stream on a given table, run it, return its output."""
    return run_to_table(build(table_stream(spark, sf, name)), out)
