"""Sources and sinks (section A).

Files are written from the given tables into the shared folder and read back, so
that every query works on whole tables.
"""

from pyspark.sql import functions as F

from tapeloom.operators import splits
from tapeloom.operators.quality import bar_rules
from tapeloom.plans.inputs import TRADE_KEY, bars, ledger, returns, ticks
from tapeloom.plans.outcomes import WF_SQL, wf_segments
from tapeloom.plans.registry import cte, query
from tapeloom.session import load, scratch_path
from tapeloom.sources import files, pages

TK = ", ".join(TRADE_KEY)


@query("a1_vendor_bar_csv", cte("bars") + """
SELECT bar_ts AS ts_event, 33 AS rtype, 1 AS publisher_id, n AS instrument_id, open, high, low, close, volume,
  concat(upper(symbol), 'H4') AS contract_symbol, CASE WHEN symbol = 'view' THEN 'VI' ELSE concat(upper(symbol), 'H4') END AS symbol FROM bars""",
       f8="open high low close", i8="rtype publisher_id instrument_id volume")
def a1(spark, sf):
    path = scratch_path(spark, "bars-csv")
    bars(spark, sf).select(
        F.date_format("bar_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts_event"), F.lit(33).alias("rtype"), F.lit(1).alias("publisher_id"),
        F.col("n").alias("instrument_id"), "open", "high", "low", "close", "volume",
        F.concat(F.upper("symbol"), F.lit("H4")).alias("symbol")).write.csv(path, header=True)
    return files.read_bars_csv(spark, path, ["ES", "NQ", "VI"])


@query("a2_wide_survey_csv", """
SELECT make_date(CAST(year(l_shipdate) AS BIGINT), CAST((quarter(l_shipdate) - 1) * 3 + 1 AS BIGINT), 1::BIGINT) AS forecast_date, 'PAYEMS' AS indicator, CAST(l_suppkey AS VARCHAR) AS forecaster_id,
  variable, count(*) AS n, sum(value) AS total FROM (SELECT l_shipdate, l_suppkey, unnest(['P1', 'P2', 'P3']) AS variable,
    unnest([l_discount, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_tax END, l_quantity]) AS value FROM lineitem) WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4""",
       f8="total", dt="forecast_date", digits=4)
def a2(spark, sf):
    path = scratch_path(spark, "survey") + "/Individual_PAYEMS.csv"
    load(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("YEAR"), F.quarter("l_shipdate").alias("QUARTER"), F.col("l_suppkey").alias("ID"),
        F.col("l_discount").alias("P1"), F.when(F.col("l_linenumber") % 3 == 0, "#N/A").otherwise(F.col("l_tax").cast("string")).alias("P2"),
        F.col("l_quantity").alias("P3")).write.csv(path, header=True)
    return files.read_survey(spark, path, ["P1", "P2", "P3"]).groupBy("forecast_date", "indicator", "forecaster_id", "variable").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("a3_vintage_json", """
SELECT 'GDP' AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS vintage,
  round(avg(o_totalprice), 2) AS value FROM orders GROUP BY 2, 3 HAVING month(any_value(o_orderdate)) <> 2""", f8="value", dt="date vintage", digits=2)
def a3(spark, sf):
    path = scratch_path(spark, "vintage") + "/GDP.json"
    m = load(spark, sf, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("d")).agg(F.round(F.avg("o_totalprice"), 2).alias("v"))
    obs = F.struct(F.add_months("d", 1).cast("string").alias("realtime_start"), F.lit("9999-12-31").alias("realtime_end"),
                   F.col("d").cast("string").alias("date"), F.when(F.month("d") == 2, ".").otherwise(F.col("v").cast("string")).alias("value"))
    # One document per year, so no list grows with the table.
    m.groupBy(F.year("d").alias("y")).agg(F.collect_list(obs).alias("observations")).drop("y").write.json(path)
    return files.read_vintages(spark, path, multi_line=False)


@query("a4_daily_index_csv", cte("daily") + """
SELECT session AS date, max(close) AS close FROM daily WHERE day(session) <> 13 GROUP BY 1""", f8="close", dt="date")
def a4(spark, sf):
    from tapeloom.plans.inputs import daily

    path = scratch_path(spark, "index")
    daily(spark, sf).groupBy("session").agg(F.max("close").alias("close")).select(
        F.col("session").alias("observation_date"), F.when(F.dayofmonth("session") == 13, ".").otherwise(F.col("close").cast("string")).alias("VIXCLS")
    ).write.csv(path, header=True)
    return files.read_daily_index(spark, path)


def _strip(expr):
    x = f"regexp_replace({expr}, '^.*?<body[^>]*>', '', 'is')"
    x = f"regexp_replace({x}, '<!--.*?-->', '', 'gs')"
    for tag in pages.SKIP:
        x = f"regexp_replace({x}, '<{tag}[^>]*>.*?</{tag}>', ' ', 'gis')"
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'gs')"
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{ch}')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query("a5_page_text", f"SELECT page_id, nfc_normalize({_strip('html')}) AS text, sha256(html) AS digest FROM pages WHERE {_strip('html')} <> ''")
def a5(spark, sf):
    return pages.extract_text(load(spark, sf, "pages"))


@query("a5_page_text_by_pattern", f"SELECT page_id, {_strip('html')} AS text FROM pages")
def a5_pattern(spark, sf):
    return load(spark, sf, "pages").select("page_id", pages.text_by_pattern(F.col("html")).alias("text"))


LINKED = """SELECT page_id, concat(html, '<a href="/policy/statement', 20200101 + page_id % 40, 'a.htm">x</a><a class="k" href="http://h.org/minutes', 20210601 + page_id % 50, '.htm">y</a>') AS html FROM pages"""


@query("a6_page_links", f"""
WITH l AS ({LINKED}), h AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*?href\\s*=\\s*["'']([^"'']+)["'']', 1, 'is')) AS href, generate_subscripts(regexp_extract_all(html, '<a\\s[^>]*?href\\s*=\\s*["'']([^"'']+)["'']', 1, 'is'), 1) AS i FROM l),
  u AS (SELECT *, CASE WHEN starts_with(href, '/') THEN 'http://b.org' || href ELSE href END AS url FROM h),
  k AS (SELECT *, CASE WHEN regexp_extract(url, 'statement(\\d{{8}})', 1) <> '' THEN 'statement' WHEN regexp_extract(url, 'minutes(\\d{{8}})', 1) <> '' THEN 'minutes' END AS kind,
    coalesce(nullif(regexp_extract(url, 'statement(\\d{{8}})', 1), ''), nullif(regexp_extract(url, 'minutes(\\d{{8}})', 1), '')) AS digits FROM u),
  d AS (SELECT *, try_strptime(digits, '%Y%m%d') AS date FROM k WHERE kind IS NOT NULL)
SELECT date, kind, arg_max(url, (page_id, i)) AS url FROM d WHERE date IS NOT NULL GROUP BY 1, 2""", dt="date")
def a6(spark, sf):
    p = load(spark, sf, "pages")
    p = p.select("page_id", F.concat(
        "html", F.lit('<a href="/policy/statement'), (20200101 + F.col("page_id") % 40).cast("string"),
        F.lit('a.htm">x</a><a class="k" href="http://h.org/minutes'), (20210601 + F.col("page_id") % 50).cast("string"),
        F.lit('.htm">y</a>')).alias("html"))
    return pages.extract_links(p, {"statement": r"statement(\d{8})", "minutes": r"minutes(\d{8})"}, "http://b.org")


def _stored_bars(spark, sf):
    path = scratch_path(spark, "bars")
    b = bars(spark, sf).withColumn("day", F.to_date("bar_ts"))
    files.write_partitioned(b, path, ["symbol", "day"], ["bar_ts"], b.schema, bar_rules())
    return path, b.schema


@query("a7_partitioned_scan", cte("bars") + """
SELECT symbol, bar_ts, close, volume FROM bars WHERE symbol IN ('view', 'click') AND bar_ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-20 18:00:00'""",
       f8="close", i8="volume")
def a7(spark, sf):
    path, schema = _stored_bars(spark, sf)
    return files.load_bars(spark, path, ["view", "click"], "2024-01-05 06:00:00", "2024-01-20 18:00:00", ["close", "volume"], schema=schema)


@query("a8_partitioned_sink", cte("bars") + """
SELECT symbol, CAST(bar_ts AS DATE) AS day, count(*) AS n, sum(volume) AS volume, max(high) AS high FROM bars GROUP BY 1, 2""", f8="high", i8="volume", dt="day")
def a8(spark, sf):
    path, schema = _stored_bars(spark, sf)
    return files.read_published(spark, path, schema).groupBy("symbol", "day").agg(
        F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"), F.max("high").alias("high"))


@query("a9_broker_ledger_csv", cte("ledger") + f"""
SELECT symbol, k3 AS qty, k1 AS buy_id, round(price) AS buy_price, round(price) + 1 AS sell_price, round(pnl) AS pnl, entry_ts AS bought_ts, exit_ts AS sold_ts,
  epoch_us(exit_ts - entry_ts) // 1000000 AS held_s FROM ledger""", f8="buy_price sell_price pnl", i8="held_s")
def a9(spark, sf):
    path = scratch_path(spark, "ledger")
    form = "MM/dd/yyyy HH:mm:ss"
    held = ((F.unix_micros("exit_ts") - F.unix_micros("entry_ts")) / 1_000_000).cast("long")
    p = F.round("pnl").cast("long")
    money = F.format_string("%,d.00", F.abs(p))
    ledger(spark, sf).select(
        "symbol", F.lit("x").alias("_priceFormat"), F.lit("x").alias("_priceFormatType"), F.lit("0.25").alias("_tickSize"),
        F.col("k1").alias("buyFillId"), F.col("k1").alias("sellFillId"), F.col("k3").alias("qty"), F.round("price").alias("buyPrice"),
        (F.round("price") + 1).alias("sellPrice"),
        F.when(p < 0, F.concat(F.lit("$("), money, F.lit(")"))).otherwise(F.concat(F.lit("$"), money)).alias("pnl"),
        F.date_format("entry_ts", form).alias("boughtTimestamp"), F.date_format("exit_ts", form).alias("soldTimestamp"),
        F.concat_ws(" ", F.concat((held / 3600).cast("int"), F.lit("hr")), F.concat(((held % 3600) / 60).cast("int"), F.lit("min")),
                    F.concat((held % 60).cast("int"), F.lit("sec"))).alias("duration")).write.csv(path, header=True)
    return files.read_ledger(spark, path)


@query("a10_run_sidecars", cte("returns") + """
SELECT concat('run-', symbol) AS run_id, symbol, year(session) AS fold_id, min(session) AS test_start, max(session) AS test_end, avg(ret) * 1000 AS mean, count(*) AS n
FROM returns GROUP BY 1, 2, 3 HAVING year(any_value(session)) <> 1999""", f8="mean n", dt="test_start test_end")
def a10(spark, sf):
    path = scratch_path(spark, "runs")
    f = returns(spark, sf).groupBy("symbol", F.year("session").cast("long").alias("fold_id")).agg(
        F.min("session").cast("string").alias("test_start"), F.max("session").cast("string").alias("test_end"),
        F.create_map(F.lit("mean"), F.when(F.year(F.max("session")) != 1999, F.avg("ret") * 1000), F.lit("n"),
                     F.count(F.lit(1)).cast("double")).alias("metrics"))
    # One document per symbol; its list has one entry per year.
    f.groupBy("symbol").agg(F.collect_list(F.struct("symbol", "fold_id", "test_start", "test_end", "metrics")).alias("per_fold")).select(
        F.concat(F.lit("run-"), "symbol").alias("run_id"), F.lit("h").alias("hypothesis"), "per_fold").write.json(path)
    return files.read_sidecars(spark, path, ["mean", "n"], multi_line=False)


@query("a11_fold_ledger", WF_SQL + """
SELECT fold_id, min(lo) FILTER (WHERE role = 'train') AS train_start, max(hi) FILTER (WHERE role = 'train') AS train_end, min(lo) FILTER (WHERE role = 'test') AS test_start,
  max(hi) FILTER (WHERE role = 'test') AS test_end, min(lo) FILTER (WHERE role = 'purge') AS purge_start, max(hi) FILTER (WHERE role = 'purge') AS purge_end,
  CAST(min(lo) FILTER (WHERE role = 'embargo') AS DOUBLE) AS embargo_start, CAST(max(hi) FILTER (WHERE role = 'embargo') AS DOUBLE) AS embargo_end,
  sum(hi - lo) FILTER (WHERE role = 'train') AS n_train, sum(hi - lo) FILTER (WHERE role = 'test') AS n_test, sha256(CAST(fold_id AS VARCHAR)) AS model_hash FROM sg GROUP BY 1""",
       f8="embargo_start embargo_end", i8="fold_id train_start train_end test_start test_end purge_start purge_end n_train n_test")
def a11(spark, sf):
    path = scratch_path(spark, "folds")
    led = splits.fold_ledger(wf_segments(spark, sf)).withColumn("model_hash", F.sha2(F.col("fold_id").cast("string"), 256))
    files.write_fold_ledger(led, path)
    return files.read_fold_ledger(spark, path)


@query("a12_merge_sources", """
WITH c AS (SELECT p_name || '-' || p_size AS filename, max(p_retailprice) AS price, 'canonical' AS origin FROM part WHERE p_partkey % 2 = 0 GROUP BY 1),
  e AS (SELECT p_name || '-' || p_size AS filename, min(p_retailprice) AS price, 'extra' AS origin FROM part WHERE p_partkey % 2 = 1 GROUP BY 1)
SELECT * FROM c UNION ALL SELECT * FROM e WHERE filename NOT IN (SELECT filename FROM c)""", f8="price")
def a12(spark, sf):
    p = load(spark, sf, "part").withColumn("filename", F.concat_ws("-", "p_name", "p_size"))
    c = p.filter("p_partkey % 2 = 0").groupBy("filename").agg(F.max("p_retailprice").alias("price"), F.lit("canonical").alias("origin"))
    e = p.filter("p_partkey % 2 = 1").groupBy("filename").agg(F.min("p_retailprice").alias("price"), F.lit("extra").alias("origin"))
    return files.merge_sources(c, e)


def _provenance(d):
    old = d.filter("doc_id % 3 <> 0").select("filename", F.when(F.col("doc_id") % 5 == 0, "stale").otherwise(F.col("checksum")).alias("checksum"), F.lit(2).alias("recorded_at"))
    return old.unionByName(d.filter("doc_id % 3 <> 0").select("filename", F.lit("older").alias("checksum"), F.lit(1).alias("recorded_at")))


@query("a13_changed_sources", """SELECT CAST(doc_id AS VARCHAR) AS filename, sha256(text) AS checksum FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0""")
def a13(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("filename"), F.sha2("text", 256).alias("checksum"))
    return files.changed_sources(d.select("filename", "checksum"), _provenance(d))


@query("a13_unchanged_sources", """SELECT CAST(doc_id AS VARCHAR) AS filename, sha256(text) AS checksum FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0""")
def a13_same(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("filename"), F.sha2("text", 256).alias("checksum"))
    return files.unchanged_sources(d.select("filename", "checksum"), _provenance(d))


@query("a14_instrument_dimension", cte("ticks") + """
SELECT symbol, count(*) AS n, CASE WHEN symbol <> 'error' THEN sum(size) * 12.5 END AS notional, CASE WHEN symbol <> 'error' THEN 0.25 END AS tick_size,
  symbol <> 'error' AS listed FROM ticks GROUP BY 1""", f8="notional tick_size")
def a14(spark, sf):
    """Ticks and notional of every symbol; one that the dimension lacks keeps its ticks and is marked."""
    path = scratch_path(spark, "instruments")
    spark.createDataFrame([(s, 0.25, 12.5, 50.0, "RTH", "volume", 2.0) for s in ("click", "purchase", "signup", "view")],
                          files.INSTRUMENT).write.json(path)
    dim = files.load_instruments(spark, path)
    return ticks(spark, sf).join(dim, "symbol", "left").groupBy("symbol", "tick_size", "tick_value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("_s")).select(
        "symbol", "n", (F.col("_s") * F.col("tick_value")).alias("notional"), "tick_size", F.col("tick_value").isNotNull().alias("listed"))
