"""Source, sink and scalar queries (inventory rows S01-S21, X01-X12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tapeloom.catalog.base import BASICS_SQL, W, query, with_bars
from tapeloom.catalog.events import EV, FULL, META, WIN, meta, windows
from tapeloom.catalog.indicators import KEY
from tapeloom.catalog.trades import NAV, PLAIN, nav_of
from tapeloom.functions import scalars as sc
from tapeloom.operators.frames import calendar_days
from tapeloom.session import work_dir
from tapeloom.sources import ingest as ig
from tapeloom.sources import store as st
from tapeloom.sources.store import through_table

CODE = "lpad(regexp_extract(symbol, '[0-9]+'), 6, '0')"


def code():
    return F.lpad(F.regexp_extract("symbol", "[0-9]+", 0), 6, "0")


# ---- scalars

RAW = """raw AS (SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN ' ' || k || ' ' WHEN 1 THEN k || '.sh' WHEN 2 THEN '6' || lpad(k, 5, '0') WHEN 3 THEN k || '.0' WHEN 4 THEN 'NaN' ELSE k END AS code,
  c_acctbal AS x, c_mktsegment AS seg, CASE c_custkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'false' WHEN 2 THEN NULL WHEN 3 THEN ' T ' ELSE 'maybe' END AS yes FROM (SELECT *, CAST(c_custkey AS VARCHAR) AS k FROM customer))"""


def raw(t):
    k = F.col("c_custkey").cast("string")
    n = F.col("c_custkey")
    text = (F.when(n % 6 == 0, F.concat(F.lit(" "), k, F.lit(" "))).when(n % 6 == 1, F.concat(k, F.lit(".sh"))).when(n % 6 == 2, F.concat(F.lit("6"), F.lpad(k, 5, "0")))
            .when(n % 6 == 3, F.concat(k, F.lit(".0"))).when(n % 6 == 4, "NaN").otherwise(k))
    yes = F.when(n % 5 == 0, "Yes").when(n % 5 == 1, "false").when(n % 5 == 3, " T ").when(n % 5 == 4, "maybe")
    return t["customer"].select(n.alias("id"), text.alias("code"), F.col("c_acctbal").alias("x"), F.col("c_mktsegment").alias("seg"), yes.alias("yes"))


def with_raw(body):
    return f"WITH {RAW} {body}"


@query("x01_exchange_code", with_raw("SELECT id, CASE WHEN contains(upper(trim(code)), '.') THEN upper(trim(code)) WHEN left(trim(code), 1) IN ('5', '6', '9') THEN upper(trim(code)) || '.SH' ELSE upper(trim(code)) || '.SZ' END AS code FROM raw"))
def _(t):
    return raw(t).select("id", sc.exchange_code("code").alias("code"))


@query("x02_plain_code", with_raw("SELECT id, split_part(upper(trim(code)), '.', 1) AS code FROM raw"))
def _(t):
    return raw(t).select("id", sc.plain_code("code").alias("code"))


@query("x03_normalize_code", with_raw(
    "SELECT id, CASE WHEN lower(c) IN ('none', 'null', 'nan') OR c = '' THEN '' WHEN regexp_full_match(d, '[0-9]+') AND len(d) < 6 THEN lpad(d, 6, '0') ELSE d END AS code FROM (SELECT id, trim(code) AS c, CASE WHEN ends_with(trim(code), '.0') THEN left(trim(code), len(trim(code)) - 2) ELSE trim(code) END AS d FROM raw)"))
def _(t):
    return raw(t).select("id", sc.normalize_code("code").alias("code"))


@query("x04_normalize_text", with_raw("SELECT id, CASE WHEN lower(trim(code)) IN ('none', 'null', 'nan') THEN '' ELSE trim(code) END AS code, coalesce(trim(yes), '') AS yes FROM raw"))
def _(t):
    return raw(t).select("id", sc.normalize_text("code").alias("code"), sc.normalize_text("yes").alias("yes"))


@query("x05_compact_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day, CASE WHEN o_orderkey % 5 <> 4 THEN strftime(o_orderdate, '%Y%m%d') END AS loose FROM orders")
def _(t):
    n, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = (F.when(n % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(n % 4 == 1, F.date_format(d, "yyyyMMdd")).when(n % 4 == 2, F.date_format(d, "yyyy/M/d"))
            .otherwise(F.concat(F.lit(" "), F.date_format(d, "yyyy.MM.dd"))))
    loose = F.when(n % 5 == 4, "not a day").otherwise(text)
    return t["orders"].select("o_orderkey", sc.compact_date(text).alias("day"), sc.compact_date(loose, strict=False).alias("loose"))


@query("x07_safe_values", with_raw("SELECT id, try_cast(trim(code) AS DOUBLE) AS number, coalesce(x > 0, FALSE) AS positive, coalesce(lower(trim(yes)) NOT IN ('false', '0', 'no', 'n', 'f', 'nan', 'none', 'null', ''), FALSE) AS truth FROM raw WHERE lower(trim(code)) <> 'nan' UNION ALL SELECT id, NULL, coalesce(x > 0, FALSE), coalesce(lower(trim(yes)) NOT IN ('false', '0', 'no', 'n', 'f', 'nan', 'none', 'null', ''), FALSE) FROM raw WHERE lower(trim(code)) = 'nan'"))
def _(t):
    df = raw(t).withColumn("positive", F.col("x") > 0)
    return df.select("id", sc.safe_float("code").alias("number"), sc.safe_bool("positive").alias("positive"), sc.parse_bool("yes").alias("truth"))


@query("x08_format_number", with_raw("SELECT id, printf('%.1f', x / 3) AS plain, printf('%.2f%%', x / 70000 * 100) AS percent, CASE WHEN id % 6 IN (1, 4) THEN '-' ELSE printf('%.2f', trim(code)::DOUBLE) || ' x' END AS dash FROM (SELECT * REPLACE (CASE WHEN id % 6 IN (1, 4) THEN '0' ELSE code END AS code) FROM raw)"))
def _(t):
    x = F.col("x")
    return raw(t).select("id", sc.format_number(x / 3, 1).alias("plain"), sc.format_number(x / 70000, 2, True).alias("percent"), sc.format_or_dash("code", 2, " x").alias("dash"))


@query("x09_run_label", "SELECT event_id, CASE WHEN hour(ts) < 16 THEN '1430_intraday' ELSE '1900_close' END AS run_label FROM events")
def _(t):
    return t["events"].select("event_id", sc.run_label(F.col("ts").cast("timestamp")).alias("run_label"))


@query("x10_digits", "SELECT p_partkey, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits FROM part")
def _(t):
    return t["part"].select("p_partkey", sc.digits_of("p_brand").alias("digits"))


@query("x11_strength_level", "SELECT c_custkey, CASE WHEN b IS NULL THEN '缺失' WHEN b >= 5 THEN '强势' WHEN b >= 0 THEN '偏强' WHEN b > -5 THEN '偏弱' ELSE '弱势' END AS level FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal / 100 - 20 END AS b FROM customer)")
def _(t):
    b = F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal") / 100 - 20)
    return t["customer"].select("c_custkey", sc.strength_level(b).alias("level"))


@query("x12_business_days", with_bars(
    "SELECT symbol, CAST(d AS DATE) AS day FROM (SELECT symbol, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM bars GROUP BY 1) WHERE isodow(d) < 6"))
def _(t):
    return calendar_days(ends(t), "a", "b", "day", business=True).select("symbol", "day")


def ends(t):
    return t.bars.groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))


# every frequency with the rule that says its days
FREQS = {"3D": ("TRUE", 3), "W": ("isodow(d) = 7", 1), "2B": ("isodow(d) < 6", 2), "MS": ("day(d) = 1", 1), "M": ("last_day(d) = d", 1), "2QE": ("last_day(d) = d AND month(d) % 3 = 0", 2),
         "QS": ("day(d) = 1 AND month(d) % 3 = 1", 1), "YE": ("month(d) = 12 AND day(d) = 31", 1), "YS": ("month(d) = 1 AND day(d) = 1", 1)}


@query("x12b_date_ranges", with_bars(" UNION ALL ".join(
    f"SELECT '{f}' AS freq, symbol, day FROM (SELECT symbol, d AS day, row_number() OVER (PARTITION BY symbol ORDER BY d) - 1 AS i FROM days WHERE {rule}) WHERE i % {n} = 0" for f, (rule, n) in FREQS.items()),
    "days AS (SELECT symbol, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS d FROM bars GROUP BY 1)"))
def _(t):
    rows = through_table(ends(t), "ends")
    parts = [calendar_days(rows, "a", "b", "day", freq=f).select(F.lit(f).alias("freq"), "symbol", "day") for f in FREQS]
    return reduce(lambda x, y: x.union(y), parts)


# ---- reading and standardising

CN = {"date": "日期", "symbol": "股票代码", "open": "开盘", "close": "收盘", "high": "最高", "low": "最低", "volume": "成交量", "amount": "成交额"}
BARS_OUT = "SELECT symbol, date, open, close, high, low, volume FROM bars"


@query("s01_csv_encodings", store=True, sql=with_bars(BARS_OUT))
def _(t):
    path = work_dir(t.spark, "bars-csv")
    df = t.bars.select(*[F.col(c).alias(n) for c, n in CN.items()])
    odd = F.crc32(F.col("股票代码")) % 2 == 1
    # the session must allow such a file to be written; reading needs no setting
    t.spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        df.where(odd).write.option("header", "true").option("encoding", "GBK").csv(f"{path}/a")
    finally:
        t.spark.conf.unset("spark.sql.legacy.javaCharsets")
    df.where(~odd).write.option("header", "true").csv(f"{path}/b")
    raw = ig.read_csv_fallback(t.spark, path)
    return ig.standardize_daily(raw).select(F.col("code").alias("symbol"), "date", "open", "close", "high", "low", "volume")


@query("s02_standardize_daily", with_bars(
    f"""SELECT symbol AS code, date, close, high, low, volume, CASE WHEN own = 0 THEN close - pc ELSE NULL END AS change, CASE WHEN own = 0 THEN round((close / pc - 1) * 100, 4) ELSE given END AS pct_change,
  round((high - low) / pc * 100, 4) AS amplitude, NULL::DOUBLE AS turnover FROM (SELECT *, lag(close) {W} AS pc, CAST(regexp_extract(symbol, '[0-9]+') AS INT) % 2 AS own,
   CASE WHEN CAST(regexp_extract(symbol, '[0-9]+') AS INT) % 2 = 1 AND day(date) = 1 THEN 1.5::DOUBLE END AS given FROM (SELECT * REPLACE (CASE WHEN day(date) = 9 THEN NULL ELSE volume END AS volume) FROM bars WHERE day(date) <> 31))"""
    .replace("CASE WHEN own = 0 THEN close - pc ELSE NULL END AS change", "close - pc AS change")))
def _(t):
    own = F.regexp_extract("symbol", "[0-9]+", 0).cast("int") % 2
    day = F.dayofmonth("date")
    raw = t.bars.select(
        F.lower("symbol").alias("ts_code"), F.when(day == 31, "n.a.").otherwise(F.date_format("date", "yyyyMMdd")).alias("trade_date"),
        *[F.col(c).cast("string").alias(c) for c in ("open", "close", "high", "low")],
        F.when(day == 9, "bad").otherwise(F.col("volume").cast("string")).alias("vol"), F.when((own == 1) & (day == 1), "1.5").alias("pct_chg"))
    out = ig.standardize_daily(raw, upper_code=True)
    return out.select(F.concat(F.lit("Brand#"), F.regexp_extract("code", "[0-9]+", 0)).alias("code"), "date", "close", "high", "low", "volume", "change",
                      F.round("pct_change", 4).alias("pct_change"), F.round("amplitude", 4).alias("amplitude"), "turnover")


def corrected(t):
    """Bars with a second version of every fifth day, in ingest order."""
    first = t.bars.select(F.col("symbol").alias("index_code"), F.date_format("date", "yyyy/MM/dd").alias("日期"), F.col("close").cast("string").alias("收盘价"),
                          F.col("high").cast("string").alias("最高价"), F.col("low").cast("string").alias("最低价"), F.lit(1).alias("seq"))
    again = first.where(F.right("日期", F.lit(1)) == "5").withColumns({"收盘价": F.col("最高价"), "seq": F.lit(2)})
    return first.union(again)


CORRECTED = "SELECT symbol AS code, date, CASE WHEN right(CAST(date AS VARCHAR), 1) = '5' THEN high ELSE close END AS close, high, low FROM bars"


@query("s03_standardize_index", store=True, sql=with_bars(CORRECTED))
def _(t):
    return ig.standardize_index(corrected(t), "seq").select("code", "date", "close", "high", "low")


@query("s04_standardize_stock", store=True, sql=with_bars(CORRECTED))
def _(t):
    src = t.bars.select(F.lit(0).alias("c0"), F.date_format("date", "yyyy-MM-dd").alias("c1"), F.col("symbol").alias("c2"), *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(("open", "close", "high", "low", "volume", "amount"), 3)],
                        *[F.lit(None).cast("string").alias(f"c{i}") for i in range(9, 13)], F.lit(1).alias("seq"))
    again = src.where(F.right("c1", F.lit(1)) == "5").withColumns({"c4": F.col("c5"), "seq": F.lit(2)})
    return ig.standardize_stock(src.union(again), "seq").select("code", "date", "close", "high", "low")


@query("s05_universe_file", with_bars(f"SELECT {CODE} || '.SZ' AS symbol FROM (SELECT DISTINCT symbol FROM bars) ORDER BY 1"))
def _(t):
    path = work_dir(t.spark, "universe")
    lines = t.bars.select(code().alias("value")).distinct().orderBy("value")
    lines.select(F.concat(F.lit(" "), "value", F.lit("\n"))).write.text(path)
    return ig.read_universe(t.spark, path, with_exchange=True).select("symbol")


@query("s06_latest_files", with_bars(
    f"SELECT c AS code, arg_max(f, e || (99999999 - s::INT)::VARCHAR) AS file_name FROM (SELECT {CODE} AS c, strftime(min(date), '%Y%m%d') AS s, strftime(last_day(max(date)), '%Y%m%d') AS e, c || '_' || s || '_' || e || '.csv' AS f FROM bars GROUP BY symbol, year(date) // 2) GROUP BY 1"))
def _(t):
    spans = t.bars.groupBy(code().alias("c"), F.floor(F.year("date") / 2)).agg(F.date_format(F.min("date"), "yyyyMMdd").alias("s"), F.date_format(F.last_day(F.max("date")), "yyyyMMdd").alias("e"))
    names = spans.select(F.explode(F.array(F.concat_ws("_", "c", "s", F.concat("e", F.lit(".csv"))), F.concat("c", F.lit("_notes.csv")))).alias("file_name"))
    return ig.file_lookup(names).select("code", "file_name")


@query("s07_index_list", """SELECT lpad(regexp_extract(p_brand, '[0-9]+'), 6, '0') AS index_code, arg_min(p_type, p_partkey) AS industry_name, 'http://' || arg_min(p_name, p_partkey) AS link
  FROM part WHERE p_partkey % 3 <> 0 AND lpad(regexp_extract(p_brand, '[0-9]+'), 6, '0') IN ('000001', '000002', '000003', '000011') GROUP BY 1""")
def _(t):
    raw = t["part"].select(
        F.concat(F.lit(" "), F.regexp_extract("p_brand", "[0-9]+", 0), F.lit(".0")).alias("Code"),
        F.when(F.col("p_partkey") % 3 == 0, "None").otherwise(F.col("p_type")).alias("板块名称"), F.concat(F.lit("http://"), "p_name").alias("url"), F.col("p_partkey").alias("pos"))
    return ig.standardize_index_list(raw, "pos", codes=["1", "2.0", "000003", "11", "none"])


@query("s08_bar_store", store=True, sql=with_bars("SELECT symbol, date, close FROM bars"))
def _(t):
    root = work_dir(t.spark, "store")
    st.save_bars(t.bars, root, "landed", "price", "hfq")
    st.save_bars(t.bars.where("volume > 40"), root, "landed", "price", "raw")
    return st.load_bars(t.spark, root, "landed", "price", "hfq").select(*KEY, "close")


@query("s09_save_load", store=True, sql=with_bars("SELECT 'csv' AS fmt, symbol, date, close FROM bars UNION ALL SELECT 'parquet', symbol, date, close FROM bars"))
def _(t):
    root = work_dir(t.spark, "frames")
    df = t.bars.select(*KEY, "close")
    out = []
    for fmt in st.FORMATS:
        st.save(df, f"{root}/{fmt}", fmt)
        out.append(st.load(t.spark, f"{root}/{fmt}", fmt, "symbol string, date date, close double").select(F.lit(fmt).alias("fmt"), *KEY, "close"))
    return out[0].union(out[1])


@query("s10_price_history", with_bars("SELECT symbol, date, close FROM bars WHERE date BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'"))
def _(t):
    return ig.price_history(t.bars, "1997-03-01", "1998-02-28", ["symbol", "date", "close", "no_such_field"])


@query("s11_fundamentals", f"WITH {BASICS_SQL} SELECT ts_code, trade_date, pe, roe FROM basics WHERE ts_code = 'Brand#5' AND trade_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' ORDER BY trade_date")
def _(t):
    return ig.fundamentals_history(t.basics, "Brand#5", "1996-01-01", "1999-12-31", ["ts_code", "trade_date", "pe", "roe"])




@query("s12_non_positive_prices", with_bars("SELECT symbol, count(*) FILTER (open <= 0) AS open, count(*) FILTER (close <= 0) AS close, count(*) FILTER (high <= 0) AS high, count(*) FILTER (low - 25 <= 0) AS low FROM bars GROUP BY 1 HAVING count(*) FILTER (low - 25 <= 0) > 0"))
def _(t):
    return ig.non_positive_prices(t.bars.withColumn("low", F.col("low") - 25))


@query("s12b_drop_bad_series", store=True, sql=with_bars("SELECT symbol, date, low - 25 AS low FROM (SELECT *, min(low) OVER (PARTITION BY symbol) AS least FROM bars) WHERE least - 25 > 0"))
def _(t):
    return ig.drop_bad_series(t.bars.withColumn("low", F.col("low") - 25)).select(*KEY, "low")


# the symbols of the parts, and those of the kinds of parts, of which there are no bars
NEWCOMERS = "SELECT DISTINCT unnest([p_brand, p_type]) AS symbol FROM part"


def with_newcomers(t):
    return t["part"].select(F.explode(F.array("p_brand", "p_type")).alias("symbol")).distinct()


@query("s13_merge_refresh", store=True, sql=with_bars("SELECT symbol, date, CASE WHEN date >= DATE '2001-06-01' THEN high ELSE close END AS close FROM bars WHERE date < DATE '2001-08-01' OR date >= DATE '2001-06-01'"))
def _(t):
    stored = t.bars.where("date < '2001-08-01'").select(*KEY, "close")
    fresh = t.bars.where("date >= '2001-06-01'").select(*KEY, F.col("high").alias("close"))
    return ig.merge_refresh(stored, fresh)


@query("s14_update_log", store=True, sql=with_bars(
    """SELECT u.symbol, CASE WHEN b.symbol IS NULL THEN 'failed' ELSE 'updated' END AS status, strftime(d, '%Y-%m-%d') AS latest_date,
  strftime(coalesce(least(greatest(DATE '2001-01-01', d - 120), d), DATE '2001-01-01'), '%Y%m%d') AS fetch_start, '20020101' AS fetch_end, CASE WHEN b.symbol IS NULL THEN 'no stored bars' ELSE '' END AS message
  FROM (SELECT DISTINCT p_brand AS symbol FROM part) u LEFT JOIN (SELECT symbol, max(date) AS d FROM bars GROUP BY 1) b USING (symbol)""".replace("FROM (SELECT DISTINCT p_brand AS symbol FROM part) u", f"FROM ({NEWCOMERS}) u")))
def _(t):
    return ig.update_log(with_newcomers(t), t.bars, "2001-01-01", "2002-01-01")


@query("s15_export_shape", with_bars(
    f"SELECT symbol AS industry_name, {CODE} AS index_code, 'link' AS source_link, strftime(date, '%Y-%m-%d') AS \"日期\", open AS \"开盘价\", high AS \"最高价\", low AS \"最低价\", close AS \"收盘价\", volume AS \"成交量\", NULL::DOUBLE AS \"成交额\" FROM bars"))
def _(t):
    return ig.export_shape(t.bars.drop("amount"), F.col("symbol"), code(), F.lit("link"))


@query("s16_report_sink", store=True, sql=with_bars("SELECT symbol, count(*) AS bars, max(date) AS latest FROM bars GROUP BY 1"))
def _(t):
    root = work_dir(t.spark, "reports")
    report = t.bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.max("date").alias("latest"))
    st.export_report(report.limit(0), root, "update", "1430_intraday", "20010910_1430")
    return t.spark.read.parquet(st.export_report(report, root, "update", "1900_close", "20010910_1900"))


WINDOW_SCHEMA = "symbol string, event_date date, trade_date date, relative_day int, open double, high double, low double, close double, volume double, event_close double"


@query("s17_event_window_file", store=True, sql=with_bars(f"SELECT {CODE} AS symbol, event_date, trade_date, relative_day, close, event_close FROM win", *EV, WIN))
def _(t):
    path = work_dir(t.spark, "event_windows")
    names = [c.split()[0] for c in WINDOW_SCHEMA.split(", ")]
    df = windows(t).withColumn("symbol", F.regexp_extract("symbol", "[0-9]+", 0)).select(*names)
    st.save(df, path)
    return ig.read_event_windows(t.spark, path, WINDOW_SCHEMA).select("symbol", "event_date", "trade_date", "relative_day", "close", "event_close")


META_SCHEMA = "symbol string, event_date date, event_close double, bandwidth double, condition_threshold double"


@query("s17b_event_studies", store=True, sql=with_bars(
    f"""SELECT CASE WHEN year(w.event_date) % 2 = 0 THEN 'even' ELSE 'odd' END AS study, {CODE.replace('symbol', 'w.symbol')} AS symbol, w.event_date, w.relative_day, w.close,
  CASE WHEN year(w.event_date) % 2 = 0 THEN round(m.bandwidth, 6) END AS bandwidth FROM win w LEFT JOIN ({META}) m USING (symbol, event_date)""", *EV, FULL, WIN))
def _(t):
    root = work_dir(t.spark, "studies")
    digits = F.regexp_extract("symbol", "[0-9]+", 0).alias("symbol")
    win = through_table(windows(t), "windows")
    facts = through_table(meta(t).select(digits, *[c.split()[0] for c in META_SCHEMA.split(", ")[1:]]), "meta")
    columns = [c.split()[0] for c in WINDOW_SCHEMA.split(", ")][1:]
    for name, which in (("even", F.year("event_date") % 2 == 0), ("odd", F.year("event_date") % 2 == 1)):
        st.save(win.where(which).select(digits, *columns), f"{root}/event_windows_{name}.csv")
    st.save(facts.where(F.year("event_date") % 2 == 0), f"{root}/event_meta_even.csv")  # the other study has none
    out = ig.read_event_studies(t.spark, root, WINDOW_SCHEMA, META_SCHEMA)
    listed = ig.event_window_files(t.spark, root).select("study")
    return out.join(listed, "study", "left_semi").select("study", "symbol", "event_date", "relative_day", "close", F.round("bandwidth", 6).alias("bandwidth"))


@query("s18_result_reader", with_bars("SELECT scenario, date, round(portfolio_value, 0) AS portfolio_value FROM nav WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' ORDER BY date", *PLAIN, NAV))
def _(t):
    path = work_dir(t.spark, "backtest")
    st.save(nav_of(t).select("scenario", "date", "portfolio_value"), path)
    out = ig.read_results(t.spark, path, "scenario string, date date, portfolio_value double", "1997-01-01", "1999-12-31")
    return out.withColumn("portfolio_value", F.round("portfolio_value", 0))


@query("s19_skip_report", with_bars(
    """SELECT symbol, CASE WHEN n IS NULL THEN 'missing_csv' WHEN inside = 0 THEN 'empty_price_data' WHEN inside < 385 THEN 'insufficient_history' WHEN hi = 0 THEN 'missing_required_columns' END AS reason FROM
  (%s) LEFT JOIN (SELECT symbol, count(*) AS n, count(*) FILTER (year(date) >= 2000 AND date <= DATE '2001-12-31') AS inside, count(CASE WHEN symbol <> 'Brand#14' AND year(date) >= 2000 THEN high END) AS hi
    FROM (SELECT * REPLACE (CASE WHEN symbol = 'Brand#8' THEN date - INTERVAL 10 YEAR ELSE date END AS date) FROM bars) GROUP BY 1) USING (symbol)
  WHERE n IS NULL OR inside < 385 OR hi = 0""" % NEWCOMERS))
def _(t):
    early = F.when(F.col("symbol") == "Brand#8", F.add_months("date", -120)).otherwise(F.col("date"))
    have = t.bars.withColumns({"date": early, "high": F.when(F.col("symbol") != "Brand#14", F.col("high"))})
    return ig.skip_report(with_newcomers(t), have, "2000-01-01", "2001-12-31", 385).select("symbol", "reason")


@query("s19b_unreadable_files", store=True, sql=with_bars(
    f"""SELECT symbol, CASE n % 4 WHEN 0 THEN 'UnicodeDecodeError' WHEN 1 THEN 'ValueError' ELSE 'missing_csv' END AS reason FROM
  (SELECT DISTINCT symbol, CAST({CODE} AS INT) AS n FROM bars) WHERE n % 4 < 2 UNION ALL SELECT DISTINCT p_type, 'missing_csv' FROM part"""))
def _(t):
    path = work_dir(t.spark, "price-files")
    n = F.substring_index("symbol", "#", -1)
    files = through_table(t.bars.select(n.alias("n"), "date", "open", "close", "high", "low"), "price-rows")
    kind = F.col("n").cast("int") % 4
    for which, encoding, date in ((kind == 0, "UTF-16", "date"), (kind == 1, "UTF-8", "day"), (kind > 1, "UTF-8", "date")):
        one = files.where(which).withColumnRenamed("date", date).repartition("n")  # a file for each symbol
        one.write.mode("append").partitionBy("n").option("header", "true").option("encoding", encoding).csv(path)
    rows = ig.read_price_files(t.spark, path).withColumn("symbol", F.concat(F.lit("Brand#"), F.regexp_extract("file", r"/n=([^/]*)/", 1)))
    bars = rows.where("error IS NULL").select("symbol", F.to_date("date").alias("date"), *[F.col(c).cast("double").alias(c) for c in ("close", "high", "low")])
    return ig.skip_report(with_newcomers(t), bars, "1990-01-01", "2010-01-01", 1, errors=rows).select("symbol", "reason")


LISTING = """listing AS (SELECT (CASE p_size % 4 WHEN 0 THEN '6' || lpad((p_partkey % 1000)::VARCHAR, 5, '0') || '.SH' WHEN 1 THEN '300' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') || '.SZ'
  WHEN 2 THEN (p_partkey % 2000)::VARCHAR ELSE '900' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') END) AS c, CASE WHEN p_size = 7 THEN 'B board' ELSE 'Main' END AS m, p_size % 3 AS snap FROM part)"""


def listing(t):
    n, size = F.col("p_partkey"), F.col("p_size")
    small = F.lpad((n % 1000).cast("string"), 3, "0")
    c = (F.when(size % 4 == 0, F.concat(F.lit("6"), F.lpad((n % 1000).cast("string"), 5, "0"), F.lit(".SH"))).when(size % 4 == 1, F.concat(F.lit("300"), small, F.lit(".SZ")))
         .when(size % 4 == 2, (n % 2000).cast("string")).otherwise(F.concat(F.lit("900"), small)))
    return t["part"].select(F.col("p_name").alias("title"), c.alias("paper"), F.when(size == 7, "B board").otherwise("Main").alias("market"), (size % 3).alias("trade_date"))


A_SHARE = "regexp_full_match(k, '[0-9]{{6}}') AND regexp_matches(k, '^({})')"
KODE = "CASE WHEN regexp_full_match(split_part(c, '.', 1), '[0-9]+') AND len(split_part(c, '.', 1)) < 6 THEN lpad(split_part(c, '.', 1), 6, '0') ELSE split_part(c, '.', 1) END"


@query("s20_listing_codes", f"WITH {LISTING} SELECT DISTINCT k AS code FROM (SELECT {KODE} AS k FROM listing WHERE NOT contains(m, 'B') AND snap = (SELECT max(snap) FROM listing WHERE NOT contains(m, 'B'))) WHERE {A_SHARE.format('6|000|001|002|003|300|301')} ORDER BY CAST(k AS INT)")
def _(t):
    return ig.listing_codes(listing(t), None, "paper", snapshot="trade_date")


@query("s21_code_column", f"WITH {LISTING} SELECT 'paper' AS code_column, k AS code FROM (SELECT DISTINCT {KODE} AS k FROM listing) WHERE {A_SHARE.format('6')}")
def _(t):
    df = listing(t).select("title", "market", "paper")
    found = ig.code_column(df, ["con_code", "stock_code"])
    return ig.listing_codes(df, "SH", found, board=None).select(F.lit(found).alias("code_column"), "code")


