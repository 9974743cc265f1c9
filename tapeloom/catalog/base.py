"""Registration of queries and the SQL pieces that their twins share."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tapeloom.sources.store import through_table
from tapeloom.sources.bars import daily_bars, daily_basics, fundamentals, hourly_bars, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The given tables and the bar tables that follow from them."""

    def __init__(self, spark: SparkSession, sf_dir: str, store: bool = False):
        self.spark, self.sf_dir, self.store = spark, sf_dir, store

    def __getitem__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def bars(self) -> DataFrame:
        bars = daily_bars(self["lineitem"], self["part"])
        return through_table(bars, "bars") if self.store else bars

    @cached_property
    def fundamentals(self) -> DataFrame:
        return fundamentals(self["part"])

    @cached_property
    def bars_and_basics(self) -> DataFrame:
        return daily_bars(self["lineitem"], self["part"], basics=True)

    @cached_property
    def basics(self) -> DataFrame:
        return daily_basics(self["lineitem"], self["part"])

    @cached_property
    def hourly(self) -> DataFrame:
        return hourly_bars(self["events"])


def query(name: str, sql: str | None = None, store: bool = False):
    """Register ``fn(tables) -> DataFrame`` under a name.

    ``store``: the plan reads the bars more than once, so they are built from the trades once and
    written; the trades are the big table, the bars have one row per symbol and day.
    """

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir, store))
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# ---- SQL pieces -----------------------------------------------------------------------------

BARS_SQL = """bars AS (
  SELECT p.p_brand AS symbol, CAST(l.l_shipdate AS DATE) AS date,
         arg_min(l.l_extendedprice / l.l_quantity, ROW(l.l_orderkey, l.l_linenumber, (CAST(round(l.l_extendedprice * 100) AS BIGINT) * 50 + CAST(l.l_quantity AS BIGINT)) % 1048576)) AS open,
         arg_max(l.l_extendedprice / l.l_quantity, ROW(l.l_orderkey, l.l_linenumber, (CAST(round(l.l_extendedprice * 100) AS BIGINT) * 50 + CAST(l.l_quantity AS BIGINT)) % 1048576)) AS close,
         max(l.l_extendedprice / l.l_quantity) AS high, min(l.l_extendedprice / l.l_quantity) AS low,
         sum(l.l_quantity) AS volume, sum(l.l_extendedprice) AS amount
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2)"""

HOURLY_SQL = """hourly AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS hour, arg_min(value, event_id) AS open,
         arg_max(value, event_id) AS close, max(value) AS high, min(value) AS low, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2)"""

FUNDA_SQL = "funda AS (SELECT p_brand AS symbol, arg_max(p_type, p_partkey) AS industry, max(p_retailprice) AS cap FROM part GROUP BY 1)"

BASICS_SQL = """basics AS (
  SELECT p.p_brand AS ts_code, CAST(l.l_shipdate AS DATE) AS trade_date,
         max(l.l_extendedprice / l.l_quantity) / (1 + min(l.l_quantity)) AS pe, min(l.l_extendedprice / l.l_quantity) / (1 + max(l.l_quantity)) AS pb,
         max(l.l_discount) AS roe, max(l.l_tax) AS roa FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2)"""

PART = "PARTITION BY symbol ORDER BY date"
W = f"OVER ({PART})"
SOFAR = f"OVER ({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def with_bars(body: str, *ctes: str) -> str:
    """``WITH bars AS (...), <ctes> <body>``; a CTE is ``name AS (...)``."""
    return "WITH " + ",\n".join((BARS_SQL,) + ctes) + "\n" + body


def R(n: int, part: str = PART) -> str:
    return f"OVER ({part} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def sroll(fn: str, x: str, n: int, m: int | None = None, part: str = PART) -> str:
    """A count-guarded rolling aggregate; fn is a format with {} for the column, or a name."""
    call = fn.format(x) if "{}" in fn else f"{fn}({x})"
    return f"CASE WHEN count({x}) {R(n, part)} >= {n if m is None else m} THEN {call} {R(n, part)} END"


def ema_cte(name: str, src: str, x: str, alpha: str, out: str, keys: str = "symbol", order: str = "date") -> str:
    """An exponential mean by folding the ordered list of one series, as the definition says."""
    k = [s.strip() for s in keys.split(",")]
    return f"""{name}_l AS (
  SELECT {keys}, list({order} ORDER BY {order}) AS ds,
         list_reduce(list_transform(list({x} ORDER BY {order}), lambda v: [CAST(v AS DOUBLE)]),
                     lambda acc, v: list_append(acc, {alpha} * v[1] + (1.0::DOUBLE - {alpha}) * acc[len(acc)])) AS vs
  FROM {src} WHERE {x} IS NOT NULL GROUP BY {keys}),
{name}_u AS (SELECT {keys}, unnest(ds) AS {order}, unnest(vs) AS {out} FROM {name}_l),
{name} AS (SELECT s.*, u.{out} FROM {src} s LEFT JOIN {name}_u u ON {' AND '.join(f's.{c} = u.{c}' for c in k)} AND s.{order} = u.{order})"""


def machine_cte(
    name: str, src: str, long_in: str, short_in: str, long_out: str, short_out: str, valid: str = "TRUE",
    out: str = "signal", keys: str = "symbol", order: str = "date",
) -> str:
    """The position machine as a fold over one series: a code per row, then the transition rules.

    Codes: 8 enter long, -8 enter short, else bit 1 closes a long, bit 2 closes a short; 16 holds the state
    and emits 0.
    """
    k = [s.strip() for s in keys.split(",")]
    code = f"""CASE WHEN NOT coalesce({valid}, FALSE) THEN 16
      WHEN coalesce({long_in}, FALSE) THEN 8 WHEN coalesce({short_in}, FALSE) THEN -8
      ELSE CASE WHEN coalesce({long_out}, FALSE) THEN 1 ELSE 0 END + CASE WHEN coalesce({short_out}, FALSE) THEN 2 ELSE 0 END END"""
    return f"""{name}_c AS (SELECT *, {code} AS code FROM {src}),
{name}_l AS (
  SELECT {keys}, list({order} ORDER BY {order}) AS ds, list(code ORDER BY {order}) AS cs,
         list_reduce(list_prepend([0], list_transform(list(code ORDER BY {order}), lambda v: [v])),
           lambda acc, v: list_append(acc, CASE
             WHEN v[1] = 8 THEN 1 WHEN v[1] = -8 THEN -1
             WHEN acc[len(acc)] = 1 AND v[1] IN (1, 3) THEN 0
             WHEN acc[len(acc)] = -1 AND v[1] IN (2, 3) THEN 0
             ELSE acc[len(acc)] END))[2:] AS vs
  FROM {name}_c GROUP BY {keys}),
{name}_u AS (SELECT {keys}, unnest(ds) AS {order}, unnest(cs) AS c, unnest(vs) AS v FROM {name}_l),
{name} AS (SELECT s.*, CASE WHEN u.c = 16 THEN 0 ELSE u.v END AS {out}
  FROM {src} s JOIN {name}_u u ON {' AND '.join(f's.{c} = u.{c}' for c in k)} AND s.{order} = u.{order})"""
