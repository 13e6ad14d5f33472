"""Where every query is registered, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def plain(df: DataFrame, f8: list[str], digits: int) -> DataFrame:
    """Bring a result to types both engines print alike."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in f8:
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(
    name: str, sql: str | None = None, f8: str = "", i8: str = "", dt: str = "", digits: int = 6
):
    """Register ``fn(spark, sf_dir)``; f8/i8/dt name its double, long and date columns."""
    doubles = f8.split()

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(spark, sf_dir), doubles, digits)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            repl = [f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in doubles]
            repl += [f"CAST({c} AS BIGINT) AS {c}" for c in i8.split()]
            repl += [f"CAST(CAST({c} AS DATE) AS VARCHAR) AS {c}" for c in dt.split()]
            star = f"* REPLACE ({', '.join(repl)})" if repl else "*"
            ORACLE[name] = f"SELECT {star} FROM (\n{sql.strip()}\n) AS checked"
        return fn

    return wrap


# Common table expressions of the checking SQL, in dependency order.
CTES = {
    "ticks": """
  SELECT event_type AS symbol, ts, value AS price, event_id AS seq,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS size, user_id FROM events""",
    "bars": """
  SELECT symbol, bar_ts, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, seq) AS close, CAST(sum(size) AS BIGINT) AS volume, count(*) AS n
  FROM (SELECT *, CASE WHEN date_trunc('hour', ts) = ts THEN ts
               ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS bar_ts FROM ticks)
  GROUP BY symbol, bar_ts""",
    "rets": """
  SELECT *, CASE WHEN close > 0 AND lag(close) OVER (PARTITION BY symbol ORDER BY bar_ts) > 0
           THEN ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_ts)) END AS r,
         row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS pos FROM bars""",
    "ledger": """
  SELECT concat(l_returnflag, l_linestatus) AS symbol, CAST(o_orderdate AS DATE) AS session,
         o_orderdate + INTERVAL 1 HOUR * (l_suppkey % 7) AS entry_ts,
         o_orderdate + INTERVAL 1 HOUR * (l_suppkey % 7 + 1 + l_partkey % 5) AS exit_ts,
         CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END AS side,
         l_quantity AS size, l_extendedprice * (l_discount - l_tax) AS pnl,
         (l_discount - l_tax) / 0.05 AS r_multiple, (l_discount - l_tax) / 10 AS ret,
         l_extendedprice / l_quantity AS price,
         l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4,
         l_extendedprice AS k5
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "returns": """
  SELECT symbol, session, avg(ret) AS ret, count(*) AS trades, sum(pnl) AS pnl
  FROM ledger GROUP BY symbol, session""",
    "daily": """
  SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS session,
         arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close
  FROM orders GROUP BY 1, 2""",
}
_NEEDS = {
    "bars": ["ticks"], "rets": ["ticks", "bars"], "returns": ["ledger"],
}


def cte(*names: str, **extra: str) -> str:
    """``WITH RECURSIVE ...`` holding the named fragments and what they need."""
    want: list[str] = []
    for n in names:
        for m in [*_NEEDS.get(n, []), n]:
            if m not in want:
                want.append(m)
    parts = [f"{n} AS ({CTES[n]})" for n in CTES if n in want]
    parts += [f"{k} AS ({v})" for k, v in extra.items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"
