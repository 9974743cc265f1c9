"""Portfolio queries (inventory rows P01-P09): one portfolio per year, weighted by traded amount."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog.base import W, query, with_bars
from tapeloom.catalog.indicators import r4, s4
from tapeloom.catalog.metrics import RET, ret
from tapeloom.operators import portfolio as pf

# weights of a year, last price of a symbol, and the year before as the current state
WEIGHTS = """amounts AS (SELECT year(date) AS portfolio, symbol, sum(volume) AS amt FROM bars GROUP BY ALL),
weights AS (SELECT portfolio, symbol, amt / sum(amt) OVER (PARTITION BY portfolio) AS weight FROM amounts),
prices AS (SELECT symbol, arg_max(close, date) AS price FROM bars WHERE symbol <> 'Brand#3' GROUP BY 1),
sized AS (SELECT portfolio, symbol, weight, price, CAST(floor(least(greatest(1000000.0::DOUBLE * weight, 1000000.0::DOUBLE * 0.01), 1000000.0::DOUBLE * 0.05) / price) AS BIGINT) AS shares FROM weights JOIN prices USING (symbol)),
held AS (SELECT * FROM sized WHERE shares > 0)"""


def weights(t):
    amounts = t.bars.groupBy(F.year("date").alias("portfolio"), "symbol").agg(F.sum("volume").alias("amt"))
    total = amounts.groupBy("portfolio").agg(F.sum("amt").alias("total"))
    return amounts.join(total, "portfolio").select("portfolio", "symbol", (F.col("amt") / F.col("total")).alias("weight"))


def prices(t):
    # one symbol's closes are blanked: it has no price
    close = F.when(F.col("symbol") != "Brand#3", F.col("close"))
    return t.bars.withColumn("close", close).groupBy("symbol").agg(F.max_by("close", "date").alias("price")).where("price IS NOT NULL")


def held(t):
    return pf.size_positions(weights(t), prices(t)).select("portfolio", "symbol", "shares")


@query("p01_target_shares", store=True, sql=with_bars("SELECT portfolio, symbol, shares FROM sized", WEIGHTS))
def _(t):
    return weights(t).join(prices(t), "symbol").select("portfolio", "symbol", pf.target_shares(F.col("weight"), F.col("price")).alias("shares"))


@query("p02_size_positions", store=True, sql=with_bars("SELECT portfolio, symbol, shares FROM held", WEIGHTS))
def _(t):
    return held(t)


@query("p03_position_values", store=True, sql=with_bars(
    "SELECT portfolio, symbol, shares, round(shares * price, 2) AS value, round(1000000 + sum(shares * price) OVER (PARTITION BY portfolio), 2) AS total_value FROM held", WEIGHTS))
def _(t):
    values = pf.position_values(held(t), prices(t))
    total = pf.total_value(held(t), prices(t), 1_000_000.0)
    return values.join(total, "portfolio").select("portfolio", "symbol", "shares", *r4("value", "total_value", digits=2))


def shifted(df):
    """The year before as the state that the year starts from."""
    return df.withColumn("portfolio", F.col("portfolio") + 1)


@query("p04_rebalance_trades", store=True, sql=with_bars(
    """SELECT portfolio, symbol, CASE WHEN d > 0 THEN 'buy' ELSE 'sell' END AS action, abs(d) AS shares, coalesce(price, 0) AS price, round(abs(d) * coalesce(price, 0), 2) AS value FROM
  (SELECT coalesce(a.portfolio, b.portfolio) AS portfolio, coalesce(a.symbol, b.symbol) AS symbol, coalesce(b.shares, 0) - coalesce(a.shares, 0) AS d
   FROM (SELECT portfolio + 1 AS portfolio, symbol, shares FROM held) a FULL JOIN held b ON a.portfolio = b.portfolio AND a.symbol = b.symbol) LEFT JOIN prices USING (symbol) WHERE d <> 0""", WEIGHTS))
def _(t):
    out = pf.rebalance_trades(shifted(held(t)), held(t), prices(t))
    return out.withColumn("value", F.round("value", 2))


@query("p05_threshold_weights", store=True, sql=with_bars(
    """SELECT portfolio, symbol, round(CASE WHEN abs(t.weight - coalesce(c.weight, 0)) >= 0.002 THEN t.weight ELSE coalesce(c.weight, 0) END, 6) AS weight
  FROM weights t LEFT JOIN (SELECT portfolio + 1 AS portfolio, symbol, weight FROM weights) c USING (portfolio, symbol)""", WEIGHTS))
def _(t):
    return pf.apply_threshold(shifted(weights(t)), weights(t), 0.002).select("portfolio", "symbol", *r4("weight", digits=6))


def greedy_sql(rule):
    return f"""SELECT unnest(list_reduce(list_transform(list(date ORDER BY date), lambda d: [d]),
  lambda acc, d: CASE WHEN {rule} THEN list_append(acc, d[1]) ELSE acc END)) AS date FROM (SELECT DISTINCT date FROM bars)"""


LAST = "acc[len(acc)]"
QUARTERS = f"(year(d[1]) - year({LAST})) * 4 + CAST(floor((month(d[1]) - month({LAST})) / 3) AS BIGINT) >= 1"


@query("p06_rebalance_days", store=True, sql=with_bars(
    f"SELECT 'weekly' AS freq, date FROM ({greedy_sql(f'd[1] - {LAST} >= 7')}) UNION ALL SELECT 'quarterly', date FROM ({greedy_sql(QUARTERS)}) "
    "UNION ALL SELECT 'monthly', date FROM (SELECT date, lag(date) OVER (ORDER BY date) AS p FROM (SELECT DISTINCT date FROM bars)) WHERE p IS NULL OR month(p) <> month(date) "
    "UNION ALL SELECT 'daily', date FROM (SELECT DISTINCT date FROM bars)"))
def _(t):
    days = t.bars.select(F.lit("all").alias("calendar"), "date").distinct()
    parts = [pf.rebalance_days(days, f).select(F.lit(f).alias("freq"), "date") for f in ("weekly", "quarterly", "monthly", "daily")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


COV = """cov AS (SELECT a.symbol AS a, b.symbol AS b, covar_samp(a.r, b.r) AS cov FROM ret a JOIN ret b ON a.date = b.date AND a.symbol <= b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY ALL),
covf AS (SELECT a, b, cov FROM cov UNION ALL SELECT b, a, cov FROM cov WHERE a <> b), mu AS (SELECT symbol, avg(r) AS mean_return FROM ret GROUP BY 1)"""


def cov(t):
    return pf.covariance(ret(t), "r")


@query("p07_mean_variance", store=True, sql=with_bars(
    f"""SELECT portfolio, {s4('expected_return', 'variance')}, round(-expected_return + 2 * variance, 4) AS objective FROM
  (SELECT w.portfolio, sum(w.weight * mean_return) AS expected_return, any_value(v.variance) AS variance FROM weights w JOIN mu USING (symbol) JOIN
    (SELECT x.portfolio, sum(x.weight * cov * y.weight) AS variance FROM weights x JOIN covf ON x.symbol = a JOIN weights y ON y.symbol = b AND x.portfolio = y.portfolio GROUP BY 1) v ON v.portfolio = w.portfolio GROUP BY 1)""",
    *RET, WEIGHTS, COV))
def _(t):
    return pf.mean_variance_objective(weights(t), pf.mean_returns(ret(t)), cov(t), 2.0).select(
        "portfolio", *r4("expected_return", "variance", "objective"))


@query("p08_risk_contributions", store=True, sql=with_bars(
    f"""SELECT portfolio, symbol, {s4('risk_share', digits=6)}, round(power(risk_share - 1.0::DOUBLE / n, 2), 6) AS squared_gap FROM
  (SELECT portfolio, symbol, c / sum(c) OVER (PARTITION BY portfolio) AS risk_share, count(*) OVER (PARTITION BY portfolio) AS n FROM
    (SELECT x.portfolio, x.symbol, sum(x.weight * cov * y.weight) AS c FROM weights x JOIN covf ON x.symbol = a JOIN weights y ON y.symbol = b AND x.portfolio = y.portfolio GROUP BY ALL))""",
    *RET, WEIGHTS, COV))
def _(t):
    return pf.risk_contributions(weights(t), cov(t)).select("portfolio", "symbol", *r4("risk_share", "squared_gap", digits=6))


@query("p09_covariance", store=True, sql=with_bars("SELECT a, b, round(cov, 4) AS cov, round(mean_return, 4) AS mean_return_a FROM cov JOIN mu ON a = symbol", *RET, COV))
def _(t):
    mean = pf.mean_returns(ret(t)).withColumnRenamed("symbol", "a")
    return cov(t).join(mean, "a").select("a", "b", *r4("cov"), F.round("mean_return", 4).alias("mean_return_a"))


@query("p06b_execute_rebalance", store=True, sql=with_bars(
    f"""SELECT date, symbol, CASE WHEN d > 0 THEN 'buy' ELSE 'sell' END AS action, abs(d) AS shares, coalesce(price, 0) AS price, round(abs(d) * coalesce(price, 0), 2) AS value FROM
  (SELECT coalesce(a.date, b.date) AS date, coalesce(a.symbol, b.symbol) AS symbol, coalesce(b.shares, 0) - coalesce(a.shares, 0) AS d FROM
    (SELECT date, symbol, CAST(lag(volume) {W} AS BIGINT) AS shares FROM bars) a FULL JOIN (SELECT date, symbol, CAST(volume AS BIGINT) AS shares FROM bars) b USING (date, symbol))
  LEFT JOIN prices USING (symbol) WHERE d <> 0 AND date IN (SELECT date FROM (SELECT date, lag(date) OVER (ORDER BY date) AS p FROM (SELECT DISTINCT date FROM bars)) WHERE p IS NULL OR month(p) <> month(date))""", WEIGHTS))
def _(t):
    from tapeloom.functions.kernels import lag

    days = pf.rebalance_days(t.bars.select(F.lit("all").alias("calendar"), "date"), "monthly")
    now = t.bars.select("date", "symbol", lag("volume").cast("long").alias("shares"))
    then = t.bars.select("date", "symbol", F.col("volume").cast("long").alias("shares"))
    return pf.execute_rebalance(days, now, then, prices(t)).withColumn("value", F.round("value", 2))
