"""Feature, resampling and relational queries (inventory rows F, H, J, A, V, L, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog.base import BASICS_SQL, FUNDA_SQL, PART, SOFAR, R, W, query, sroll, with_bars
from tapeloom.catalog.indicators import BANDS, KEY, MACD_CTES, r4, rsi_ctes, s4
from tapeloom.catalog.metrics import MARKET, RET, pair
from tapeloom.catalog.portfolio import COV, WEIGHTS, cov, held, shifted
from tapeloom.functions.kernels import BARS, keep_last, lag
from tapeloom.functions.ranks import tie_rank
from tapeloom.operators import features as ft
from tapeloom.operators import frames as fr
from tapeloom.operators import indicators as ind

D = "PARTITION BY date"


@query("f01_normalize", with_bars(
    f"SELECT symbol, date, round((close - avg(close) OVER ({D})) / nullif(stddev_samp(close) OVER ({D}), 0), 4) AS z, "
    f"round((close - min(close) OVER ({D})) / nullif(max(close) OVER ({D}) - min(close) OVER ({D}), 0), 4) AS mm FROM bars"))
def _(t):
    df = t.bars.withColumns({"z": F.col("close"), "mm": F.col("close")})
    df = ft.normalize(ft.normalize(df, ["z"]), ["mm"], "minmax")
    return df.select(*KEY, *r4("z", "mm"))


@query("f02_winsorize", store=True, sql=with_bars(
    "SELECT symbol, date, round(ln(least(greatest(close, lo), hi)), 6) AS log_close FROM bars JOIN (SELECT date, quantile_cont(close, 0.1) AS lo, quantile_cont(close, 0.9) AS hi FROM bars GROUP BY 1) USING (date)"))
def _(t):
    return ft.winsorize(t.bars, "close", 0.1, 0.9).select(*KEY, F.round(F.ln("close"), 6).alias("log_close"))


@query("f03_neutralize", with_bars(
    f"""SELECT symbol, date, round(y / close, 6) AS by_industry, round((y - coalesce(sum(x * y) OVER ({D}) / nullif(sum(x * x) OVER ({D}), 0), 0) * x) / close, 6) AS by_industry_cap FROM
  (SELECT symbol, date, close, close - avg(close) OVER (PARTITION BY date, industry) AS y, cap - avg(cap) OVER (PARTITION BY date, industry) AS x FROM bars JOIN funda USING (symbol))""", FUNDA_SQL))
def _(t):
    df = t.bars.join(t.fundamentals, "symbol")
    df = ft.neutralize(ft.neutralize(df, "close", out="by_industry"), "close", cap="cap", out="by_industry_cap")
    return df.select(*KEY, *[F.round(F.col(c) / F.col("close"), 6).alias(c) for c in ("by_industry", "by_industry_cap")])


# the factor is the 20-row momentum, the target the next day's return
MOM = (f"mom AS (SELECT symbol, date, close - lag(close, 20) {W} AS f, lead(close) {W} / close - 1 AS y, volume FROM bars)",
       "momx AS (SELECT * FROM mom WHERE f IS NOT NULL AND y IS NOT NULL)")


def rank_sql(x, part):
    return f"rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0"


def mom(t):
    df = ind.momentum(t.bars, n=20, out="f")
    return df.withColumn("y", F.lead("close").over(BARS.w) / F.col("close") - 1)


def ic_sql(key):
    return (f"SELECT {key}, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN round(corr(a, b), 4) END AS spearman, "
            f"CASE WHEN stddev_pop(f) > 0 AND stddev_pop(y) > 0 THEN round(corr(f, y), 4) END AS pearson FROM "
            f"(SELECT *, {rank_sql('f', key)} AS a, {rank_sql('y', key)} AS b FROM momx) GROUP BY 1")


def ic(t, key):
    df = mom(t)
    a = ft.information_coefficient(df, "f", "y", "spearman", (key,), out="spearman")
    return a.join(ft.information_coefficient(df, "f", "y", "pearson", (key,), out="pearson"), key).select(key, *r4("spearman", "pearson"))


@query("f04_information_coefficient", store=True, sql=with_bars(ic_sql("symbol"), *MOM))
def _(t):
    return ic(t, "symbol")


@query("f05_ic_by_date", store=True, sql=with_bars(ic_sql("date"), *MOM))
def _(t):
    return ic(t, "date")


@query("f06_lagged_features", with_bars("SELECT symbol, date, " + ", ".join(f"lag({c}, {k}) {W} AS {c}_lag{k}" for k in (1, 5) for c in ("close", "volume")) + " FROM bars"))
def _(t):
    return ft.lagged_features(t.bars, ["close", "volume"], [1, 5]).select(*KEY, *[f"{c}_lag{k}" for k in (1, 5) for c in ("close", "volume")])


ROLLED = [f"{c}_rolling{n}_{f}" for n in (7, 21) for f in ("mean", "std", "max", "min") for c in ("close", "volume")]


@query("f07_rolling_features", with_bars("SELECT symbol, date, " + ", ".join(
    f"round({sroll(dict(mean='avg', std='stddev_samp').get(f, f), c, n)}, {4 if f in ('mean', 'std') else 9}) AS {c}_rolling{n}_{f}" for n in (7, 21) for f in ("mean", "std", "max", "min") for c in ("close", "volume")) + " FROM bars"))
def _(t):
    return ft.rolling_features(t.bars, ["close", "volume"], [7, 21], ("mean", "std", "max", "min", "skew")).select(
        *KEY, *[F.round(c, 4 if c.endswith(("mean", "std")) else 9).alias(c) for c in ROLLED])


@query("f08_select_features", store=True, sql=with_bars(
    f"""SELECT feature, round(ic, 4) AS ic FROM (SELECT feature, corr(a, b) AS ic FROM (SELECT *, {rank_sql('v', 'feature')} AS a, {rank_sql('y', 'feature')} AS b FROM
  (SELECT 'momentum' AS feature, f AS v, y FROM mom UNION ALL SELECT 'volume', volume, y FROM mom UNION ALL SELECT 'reversal', -f / (1 + volume), y FROM mom) WHERE v IS NOT NULL AND y IS NOT NULL) GROUP BY 1) WHERE abs(ic) > 0.01""", *MOM))
def _(t):
    df = mom(t).withColumns({"momentum": F.col("f"), "reversal": -F.col("f") / (1 + F.col("volume"))})
    return ft.select_features(df, ["momentum", "volume", "reversal"], "y", 0.01).select("feature", *r4("ic"))


FACTORS = ["MACD_factor", "RSI_factor", "BOLL_factor", "momentum_factor"]
FACTOR_CTES = (*MACD_CTES, *rsi_ctes(src="macd_t"), f"fac AS (SELECT *, macd AS \"MACD_factor\", rsi AS \"RSI_factor\", "
               f"4 * ({sroll('stddev_samp', 'close', 20)}) / ({sroll('avg', 'close', 20)}) AS \"BOLL_factor\", close - lag(close, 20) {W} AS momentum_factor FROM rsi)")


def s4q(*cols):
    return ", ".join(f'round("{c}", 4) AS "{c}"' for c in cols)


def registry():
    from tapeloom.plans.registry import default_factors

    return default_factors()


@query("f09_factor_columns", with_bars(f"SELECT symbol, date, {s4q('MACD_factor', 'RSI_factor', 'BOLL_factor')} FROM fac", *FACTOR_CTES))
def _(t):
    return registry().calculate(t.bars, ["technical"]).select(*KEY, *r4("MACD_factor", "RSI_factor", "BOLL_factor"))


@query("f10_factors_all_symbols", with_bars(
    f"SELECT symbol, count(*) AS rows, round(avg(\"MACD_factor\"), 4) AS macd, round(avg(\"RSI_factor\"), 4) AS rsi, round(avg(\"BOLL_factor\"), 4) AS boll, round(avg(momentum_factor), 4) AS momentum FROM fac GROUP BY 1", *FACTOR_CTES))
def _(t):
    df = registry().calculate(t.bars, ["technical", "custom"])
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), *[F.round(F.avg(f"{f}_factor"), 4).alias(f.lower()) for f in ("MACD", "RSI", "BOLL", "momentum")])


def zsql(x):
    return f"coalesce((\"{x}\" - avg(\"{x}\") OVER ({D})) / nullif(stddev_samp(\"{x}\") OVER ({D}), 0), 0)"


@query("f11_factor_score", with_bars(
    f"""SELECT symbol, date, round(0.4 / 3 * ({' + '.join(map(zsql, FACTORS[:3]))}) + 0.4 / 4 * ({' + '.join(map(zsql, ['PE_factor', 'PB_factor', 'ROE_factor', 'ROA_factor']))}) + 0.2 * {zsql('momentum_factor')}, 4) AS score FROM
  (SELECT fac.*, pe AS "PE_factor", pb AS "PB_factor", roe AS "ROE_factor", roa AS "ROA_factor" FROM fac JOIN basics ON ts_code = symbol AND trade_date = date)""", BASICS_SQL, *FACTOR_CTES))
def _(t):
    from tapeloom.plans.registry import FACTOR_FAMILIES, FACTOR_WEIGHTS

    df = registry().calculate(t.bars_and_basics)
    return ft.factor_score(df, FACTOR_FAMILIES, FACTOR_WEIGHTS).select(*KEY, *r4("score"))


# ---- resample, fill, align, split


@query("h01_resample_weekly", store=True, sql=with_bars(
    """SELECT c.symbol, c.period, open, high, low, close, coalesce(volume, 0) AS volume FROM
  (SELECT symbol, CAST(unnest(generate_series(min(period), max(period), INTERVAL 7 DAY)) AS DATE) AS period FROM wk GROUP BY 1) c LEFT JOIN
  (SELECT symbol, period, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume FROM wk GROUP BY ALL) USING (symbol, period)""",
    "wk AS (SELECT *, CAST(date_trunc('week', date) + INTERVAL 6 DAY AS DATE) AS period FROM bars)"))
def _(t):
    return fr.resample(t.bars, "W").select("symbol", "period", "open", "high", "low", "close", "volume")


@query("h01b_resample_monthly", store=True, sql=with_bars(
    "SELECT symbol, last_day(date) AS period, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume, count(close) AS bars FROM bars GROUP BY ALL"))
def _(t):
    df = t.bars.withColumn("bars", F.col("close"))
    return fr.resample(df, "M", {**fr.BAR_AGGS, "bars": "count"}).select("symbol", "period", "open", "high", "low", "close", "volume", "bars")


@query("h02_returns", with_bars(f"SELECT symbol, date, round(close / lag(close) {W} - 1, 6) AS simple, round(ln(close / lag(close) {W}), 6) AS log FROM bars"))
def _(t):
    df = fr.simple_returns(fr.simple_returns(t.bars, out="simple"), method="log", out="log")
    return df.select(*KEY, *r4("simple", "log", digits=6))


@query("h03_align", store=True, sql=with_bars(
    """SELECT 'inner' AS how, symbol, date, a.close, b.volume FROM bars a JOIN later b USING (symbol, date)
  UNION ALL SELECT 'outer', symbol, date, a.close, b.volume FROM bars a FULL JOIN later b USING (symbol, date)""", "later AS (SELECT symbol, date + 7 AS date, volume FROM bars)"))
def _(t):
    a, b = t.bars.select(*KEY, "close"), t.bars.select("symbol", F.date_add("date", 7).alias("date"), "volume")
    out = []
    for how in ("inner", "outer"):
        x, y = fr.align([a, b], KEY, how)
        out.append(x.join(y, KEY).select(F.lit(how).alias("how"), *KEY, "close", "volume"))
    return out[0].union(out[1])


HOLES = "holes AS (SELECT symbol, date, CASE WHEN volume > 40 THEN close END AS x FROM bars)"
NEXT = f"OVER ({PART} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("h04_fill_missing", with_bars(
    f"""SELECT symbol, date, coalesce(x, lv) AS ffill, CASE WHEN rn - lr <= 2 THEN lv END AS ffill2, CASE WHEN nr - rn <= 1 THEN nv END AS bfill1,
  round(ln(CASE WHEN nv IS NULL OR nr = lr THEN lv ELSE lv + (nv - lv) * (rn - lr) / (nr - lr) END), 6) AS interpolate,
  round(ln(coalesce(x, avg(x) OVER (PARTITION BY symbol))), 6) AS mean, round(ln(coalesce(x, median(x) OVER (PARTITION BY symbol))), 6) AS median FROM
  (SELECT *, last_value(x IGNORE NULLS) {SOFAR} AS lv, last_value(CASE WHEN x IS NOT NULL THEN rn END IGNORE NULLS) {SOFAR} AS lr,
    first_value(x IGNORE NULLS) {NEXT} AS nv, first_value(CASE WHEN x IS NOT NULL THEN rn END IGNORE NULLS) {NEXT} AS nr FROM (SELECT *, row_number() {W} AS rn FROM holes))""", HOLES))
def _(t):
    x = F.when(F.col("volume") > 40, F.col("close"))
    names = ["ffill", "ffill2", "bfill1", "interpolate", "mean", "median"]
    df = t.bars.select(*KEY, *[x.alias(n) for n in names])
    df = fr.fill_missing(fr.fill_missing(df, ["ffill"]), ["ffill2"], limit=2)
    df = fr.fill_missing(df, ["bfill1"], "bfill", 1)
    for n in names[3:]:
        df = fr.fill_missing(df, [n], n)
    return df.select(*KEY, *names[:3], *[F.round(F.ln(n), 6).alias(n) for n in names[3:]])


@query("h05_split", with_bars(
    f"SELECT symbol, date, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.85::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM (SELECT *, row_number() {W} AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars)"))
def _(t):
    return fr.split(t.bars).select(*KEY, "split")


# ---- joins


@query("j02_condition_columns", with_bars("SELECT symbol, date, close, round(upper, 4) AS upper FROM (SELECT *, middle + 2 * sd AS upper FROM bands) WHERE upper IS NOT NULL", BANDS))
def _(t):
    return ind.bollinger(t.bars).dropna(subset=["close", "upper"]).select(*KEY, "close", *r4("upper"))


@query("j03_full_outer_positions", store=True, sql=with_bars(
    "SELECT coalesce(a.portfolio, b.portfolio) AS portfolio, coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.shares, 0) AS now, coalesce(b.shares, 0) AS then_ "
    "FROM (SELECT portfolio + 1 AS portfolio, symbol, shares FROM held) a FULL JOIN held b ON a.portfolio = b.portfolio AND a.symbol = b.symbol", WEIGHTS))
def _(t):
    a, b = shifted(held(t)).withColumnRenamed("shares", "now"), held(t).withColumnRenamed("shares", "then_")
    return a.join(b, ["portfolio", "symbol"], "full_outer").fillna(0, ["now", "then_"])


@query("j04_universe_semi_join", with_bars("SELECT symbol, date, close FROM bars WHERE symbol IN (SELECT p_brand FROM part WHERE p_size > 49)"))
def _(t):
    universe = t["part"].where("p_size > 49").select(F.col("p_brand").alias("symbol")).distinct()
    return t.bars.join(universe, "symbol", "left_semi").select(*KEY, "close")


@query("j05_quality_anti_join", store=True, sql=with_bars("SELECT symbol, date, close FROM bars WHERE symbol NOT IN (SELECT symbol FROM bars GROUP BY 1 HAVING count(*) < 1530 OR min(low) <= 0)"))
def _(t):
    bad = t.bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("lo")).where("n < 1530 OR lo <= 0")
    return t.bars.join(bad, "symbol", "left_anti").select(*KEY, "close")


@query("j07_as_of_lookup", store=True, sql=with_bars(
    "SELECT b.symbol, d.day, arg_max(b.date, b.date) AS last_date, arg_max(b.close, b.date) AS last_close FROM bars b JOIN (SELECT DISTINCT last_day(date) AS day FROM bars) d ON b.date <= d.day GROUP BY ALL"))
def _(t):
    # the last bar up to each month end: a bar is sent to the ends before the symbol's next bar, however far, an equi-join
    ends = t.bars.select(F.last_day("date").alias("day")).distinct()
    newest = ends.agg(F.max("day")).first()[0]
    until = F.lead("date").over(BARS.w)
    months = F.expr("cast(round(months_between(last_day(coalesce(_next, _newest)), last_day(date))) as int)")
    seen = t.bars.withColumns({"_next": until, "_newest": F.lit(newest)}).withColumn("_months", months)
    seen = seen.withColumn("day", F.explode(F.expr("transform(sequence(0, _months), k -> last_day(add_months(date, k)))")))
    seen = seen.where("_next is null or day < _next").join(ends, "day", "left_semi")
    return seen.select("symbol", "day", F.col("date").alias("last_date"), F.col("close").alias("last_close"))


@query("j08_benchmark_join", store=True, sql=with_bars(f"SELECT symbol, date, {s4('r', 'b')} FROM pair", *MARKET))
def _(t):
    return pair(t).select(*KEY, *r4("r", "b"))


@query("j09_params_by_symbol", with_bars(
    "SELECT symbol, w AS \"window\", k AS num_std, p AS period, count(*) AS rows FROM bars, (VALUES (14), (20)) a(w), (VALUES (1.8::DOUBLE), (2.0::DOUBLE)) b(k), (VALUES ('train'), ('valid')) c(p) "
    "WHERE (p = 'train') = (year(date) < 1999) GROUP BY ALL"))
def _(t):
    from tapeloom.plans.grids import attach_grid

    period = F.when(F.year("date") < 1999, "train").otherwise("valid")
    rows = t.bars.groupBy("symbol", period.alias("period")).agg(F.count(F.lit(1)).alias("rows"))
    return attach_grid(rows, [{"window": w, "num_std": k} for w in (14, 20) for k in (1.8, 2.0)]).select("symbol", "window", "num_std", "period", "rows")


@query("j10_covariance_pairs", store=True, sql=with_bars("SELECT a, b, round(cov, 4) AS cov FROM cov WHERE a <> b", *RET, COV))
def _(t):
    return cov(t).where("a <> b").select("a", "b", *r4("cov"))


# ---- aggregates, frames, ranks, sorts, sets


@query("a01_group_aggregates", with_bars(
    "SELECT symbol, count(*) AS n, count(DISTINCT year(date)) AS years, min(low) AS lo, max(high) AS hi, arg_min(open, date) AS first_open, arg_max(close, date) AS last_close, sum(volume) AS volume, round(avg(close), 4) AS mean_close FROM bars GROUP BY 1"))
def _(t):
    return t.bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.year("date")).alias("years"), F.min("low").alias("lo"), F.max("high").alias("hi"),
        F.min_by("open", "date").alias("first_open"), F.max_by("close", "date").alias("last_close"), F.sum("volume").alias("volume"),
        F.round(F.avg("close"), 4).alias("mean_close"))


@query("a02_quantiles", with_bars(
    "SELECT symbol, round(quantile_cont(close, 0.25), 4) AS p25, round(median(close), 4) AS p50, round(quantile_cont(close, 0.75), 4) AS p75 FROM bars GROUP BY 1"))
def _(t):
    q = F.percentile("close", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return t.bars.groupBy("symbol").agg(q.alias("q")).select("symbol", *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("p25", "p50", "p75"))])


# the years of the calendar of trades
YEARS = list(range(1995, 2002))


@query("a03_pivot", with_bars("SELECT symbol, " + ", ".join(f"round(avg(close) FILTER (year(date) = {y}), 4) AS \"{y}\"" for y in YEARS) + " FROM bars GROUP BY 1"))
def _(t):
    df = t.bars.withColumn("year", F.year("date")).groupBy("symbol").pivot("year", YEARS).agg(F.avg("close"))
    return df.select("symbol", *[F.round(str(y), 4).alias(str(y)) for y in YEARS])


@query("v01_window_frames", with_bars(
    f"""SELECT symbol, date, round(avg(close) {R(7)}, 4) AS trailing, max(high) {SOFAR} AS expanding, lag(close, 2) {W} AS back2, lead(close, 2) {W} AS ahead2,
  min(low) OVER ({PART} ROWS BETWEEN 10 PRECEDING AND 5 PRECEDING) AS block_before FROM bars"""))
def _(t):
    p = BARS
    return t.bars.select(
        *KEY, F.round(F.avg("close").over(p.trailing(7)), 4).alias("trailing"), F.max("high").over(p.so_far).alias("expanding"),
        lag("close", 2).alias("back2"), F.lead("close", 2).over(p.w).alias("ahead2"), F.min("low").over(p.w.rowsBetween(-10, -5)).alias("block_before"))


@query("v02_ranks", with_bars(
    f"SELECT symbol, date, row_number() OVER ({D} ORDER BY volume DESC, symbol) AS place, {rank_sql('volume', 'date')} AS tie_rank FROM bars"))
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("date").orderBy(F.col("volume").desc(), "symbol")
    return t.bars.select(*KEY, F.row_number().over(w).alias("place"), tie_rank(F.col("volume"), ["date"]).alias("tie_rank"))


@query("l01_multi_key_sort", with_bars(
    f"SELECT symbol, date, ret, volume FROM (SELECT *, close - lag(close) {W} AS ret FROM bars) ORDER BY volume DESC, ret DESC NULLS LAST, symbol, date"))
def _(t):
    df = t.bars.withColumn("ret", F.col("close") - lag("close"))
    return df.select(*KEY, "ret", "volume").orderBy(F.desc("volume"), F.desc_nulls_last("ret"), "symbol", "date")


@query("l02_top_and_tail", store=True, sql=with_bars(
    "SELECT 'top' AS part, symbol, date, volume FROM (SELECT * FROM bars ORDER BY volume DESC, symbol, date LIMIT 20) UNION ALL SELECT 'tail', symbol, date, volume FROM "
    "(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS b FROM bars) WHERE b <= 3"))
def _(t):
    top = t.bars.orderBy(F.desc("volume"), "symbol", "date").limit(20).select(F.lit("top").alias("part"), *KEY, "volume")
    return top.union(fr.last_rows(t.bars, 3).select(F.lit("tail").alias("part"), *KEY, "volume"))


@query("u01_union", store=True, sql=with_bars("SELECT symbol, date, close, NULL::DOUBLE AS volume FROM bars WHERE year(date) < 1997 UNION ALL SELECT symbol, date, close, volume FROM bars WHERE year(date) >= 1997"))
def _(t):
    a = t.bars.where(F.year("date") < 1997).select(*KEY, "close")
    return a.unionByName(t.bars.where(F.year("date") >= 1997).select(*KEY, "close", "volume"), allowMissingColumns=True)


@query("u02_distinct_keep_last", with_bars("SELECT symbol, last_day(date) AS month, arg_max(date, date) AS date, arg_max(close, date) AS close FROM bars GROUP BY ALL"))
def _(t):
    df = t.bars.select("symbol", F.last_day("date").alias("month"), "date", "close")
    return keep_last(df, ["symbol", "month"], [F.col("date")])


@query("u02b_trade_dates", "SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem ORDER BY 1")
def _(t):
    return t["lineitem"].select(F.to_date("l_shipdate").alias("date")).distinct().orderBy("date")


@query("u03_index_intersection", store=True, sql=with_bars("SELECT symbol, date FROM bars INTERSECT SELECT symbol, date + 7 FROM bars"))
def _(t):
    return t.bars.select(*KEY).intersect(t.bars.select("symbol", F.date_add("date", 7).alias("date")))


