"""Reading and standardising provider tables."""

from __future__ import annotations

import csv
import io
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.kernels import BARS, Panel, div, keep_last, lag
from tapeloom.functions.scalars import normalize_code, normalize_text, parse_date

# fixed values: the twelve bar columns and the provider names that mean them
BAR_COLUMNS = ["date", "code", "open", "close", "high", "low", "volume", "amount", "amplitude", "pct_change", "change", "turnover"]
BAR_ALIASES = {
    "trade_date": "date", "ts_code": "code", "vol": "volume", "pct_chg": "pct_change",
    "日期": "date", "股票代码": "code", "开盘": "open", "收盘": "close", "最高": "high", "最低": "low",
    "成交量": "volume", "成交额": "amount", "振幅": "amplitude", "涨跌幅": "pct_change", "涨跌额": "change", "换手率": "turnover",
}
INDEX_ALIASES = {
    "日期": "date", "交易日期": "date", "date": "date", "datetime": "date", "开盘价": "open", "开盘": "open", "open": "open",
    "最高价": "high", "最高": "high", "high": "high", "最低价": "low", "最低": "low", "low": "low", "收盘价": "close", "收盘": "close",
    "close": "close", "成交量": "volume", "volume": "volume", "vol": "volume", "成交额": "amount", "amount": "amount",
    "turnover": "amount", "index_code": "code", "code": "code", "symbol": "code", "industry_name": "industry_name",
    "name": "industry_name", "行业名称": "industry_name", "板块名称": "industry_name",
}
STOCK_ALIASES = {
    "date": "date", "datetime": "date", "日期": "date", "open": "open", "开盘": "open", "close": "close", "收盘": "close",
    "high": "high", "最高": "high", "low": "low", "最低": "low", "volume": "volume", "vol": "volume", "成交量": "volume",
    "code": "code", "symbol": "code", "股票代码": "code",
}
EXPORT_COLUMNS = {"open": "开盘价", "high": "最高价", "low": "最低价", "close": "收盘价", "volume": "成交量", "amount": "成交额"}
NUMERIC = BAR_COLUMNS[2:]
ENCODINGS = ("utf-8-sig", "utf-8", "gbk", "gb18030")
PRICES = ("open", "close", "high", "low")


# ---- files --------------------------------------------------------------------------------------


def decoded(raw: bytes) -> str:
    """The bytes as text in the first encoding of the list that fits."""
    for name in ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError as e:
            last = e
    raise last


def read_csv(spark: SparkSession, path: str | Sequence[str], encoding: str = "utf-8", schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV with header, all columns text unless a schema is given, so leading zeros stay."""
    reader = spark.read.option("header", "true").option("encoding", encoding).option("recursiveFileLookup", "true")
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    bom = [c for c in df.columns if c.startswith("﻿")]
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in bom})


#: Rows of a file that leave a worker at a time.
FILE_ROWS = 20_000


def read_price_files(spark: SparkSession, path: str, pattern: str = "*.csv", columns: Sequence[str] = BAR_COLUMNS, aliases: Mapping[str, str] = BAR_ALIASES, need: Sequence[str] = ("date",)) -> DataFrame:
    """All CSV files under a path in one pass: ``columns`` as text, file, line, error, detail.

    Each file is read in the first encoding that fits it and by its own header: names are mapped to standard ones, the
    first of two claimants wins, columns that a file lacks are null, and quoted fields may hold line breaks. ``line`` is the
    record's number in its file, from 1. A file that can't be read so gives one row with the class and text of the error instead of
    its rows; a file of no bytes gives none. Built-in readers take one encoding and one header for all files. A file is one symbol's history and
    is handled whole; what comes out leaves in pieces.
    """
    columns, aliases, need = list(columns), dict(aliases), list(need)

    def places(header: list[str]) -> dict[str, int]:
        found: dict[str, int] = {}
        for i, name in enumerate(header):
            name = name.strip().lstrip("\ufeff")
            found.setdefault(aliases.get(name) or aliases.get(name.lower()) or name, i)
        lacking = [c for c in need if c not in found]
        if lacking:
            raise ValueError(f"Price csv is missing {', '.join(lacking)} column.")
        return found

    def table(file: str, rows: list[tuple], error: str | None = None, detail: str | None = None) -> pa.Table:
        data = {c: pa.array([r[k] for r in rows], pa.string()) for k, c in enumerate(columns)}
        lines = pa.array([r[-1] for r in rows], pa.int64())
        same = lambda v: pa.array([v] * len(rows), pa.string())
        return pa.table({"file": same(file), "line": lines, "error": same(error), "detail": same(detail)} | data)

    def parsed(file: str, content: bytes):
        records = csv.reader(io.StringIO(decoded(content), newline=""), strict=True)
        found = places(next(records, []))
        at = [found.get(c) for c in columns]
        rows = []
        for line, record in enumerate(records, 1):
            if record:
                rows.append((*[record[i] or None if i is not None and i < len(record) else None for i in at], line))
            if len(rows) >= FILE_ROWS:
                yield table(file, rows)
                rows = []
        yield table(file, rows)

    def checked(content: bytes) -> None:
        records = csv.reader(io.StringIO(decoded(content), newline=""), strict=True)
        places(next(records, []))
        for _ in records:
            pass

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                file, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                try:
                    checked(content)  # no row of a file that breaks off later
                except (ValueError, csv.Error) as e:
                    yield from table(file, [(*[None] * len(columns), None)], type(e).__name__, str(e)).to_batches()
                    continue
                for part in parsed(file, content):
                    yield from part.to_batches()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    schema = "file string, line long, error string, detail string, " + ", ".join(f"`{c}` string" for c in columns)
    return files.select("path", "content").mapInArrow(run, schema)


def read_csv_fallback(spark: SparkSession, path: str, pattern: str = "*.csv", columns: Sequence[str] = BAR_COLUMNS, aliases: Mapping[str, str] = BAR_ALIASES) -> DataFrame:
    """The rows of all CSV files under a path, in whatever encoding and layout; a file that can't be read is an error."""
    rows = read_price_files(spark, path, pattern, columns, aliases)
    bad = F.raise_error(F.concat_ws(": ", "file", "error", "detail"))
    return rows.where(F.when(F.col("error").isNotNull(), bad.cast("boolean")).otherwise(F.lit(True))).drop("file", "line", "error", "detail")


def file_lookup(names: DataFrame, name: str = "file_name") -> DataFrame:
    """The newest file per code from names like CODE_START_END.csv: greatest end, then smallest start."""
    pattern = r"^(\d{6})_(\d{8})_(\d{8})\.csv$"
    parts = names.where(F.col(name).rlike(pattern)).select(
        F.regexp_extract(name, pattern, 1).alias("code"), F.regexp_extract(name, pattern, 2).alias("start"),
        F.regexp_extract(name, pattern, 3).alias("end"), F.col(name),
    )
    w = Window.partitionBy("code").orderBy(F.desc("end"), "start", name)
    return parts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


# ---- columns ------------------------------------------------------------------------------------


def rename(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Known names (trimmed, any case) become standard names; the first of two claimants wins."""
    taken: set[str] = set()
    out = []
    for c in df.columns:
        name = c.strip()
        target = aliases.get(name) or aliases.get(name.lower()) or name
        if target in taken:
            target = name
        taken.add(target)
        out.append(F.col(f"`{c}`").alias(target))
    return df.select(*out)


def to_number(c: Column | str) -> Column:
    x = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(x), x)


def add_missing(df: DataFrame, columns: Sequence[str], kind: str = "double") -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(kind) for c in columns if c not in df.columns})


def standardize_daily(raw: DataFrame, symbol: Column | str | None = None, upper_code: bool = False) -> DataFrame:
    """Provider rows as the twelve bar columns, in date order per code.

    Bad numbers become null, rows without a date go. change, pct_change and amplitude are derived
    for a code where the provider gave none at all; they look at the bar before in date order.
    """
    df = rename(raw, BAR_ALIASES)
    df = add_missing(add_missing(df, ["code"], "string"), NUMERIC)
    if symbol is not None:
        df = df.withColumn("code", F.coalesce(F.col("code").cast("string"), F.lit(symbol) if isinstance(symbol, str) else symbol))
    code = F.col("code").cast("string")
    df = df.withColumns({"code": F.upper(code) if upper_code else code, "date": parse_date("date"), **{c: to_number(c) for c in NUMERIC}})
    df = df.where("date IS NOT NULL").select(*BAR_COLUMNS)
    p = Panel(("code",), "date")
    prev = lag("close", panel=p)
    derived = {
        "change": F.col("close") - prev,
        "pct_change": (div("close", prev) - 1) * 100,
        "amplitude": div(F.col("high") - F.col("low"), prev) * 100,
    }
    given = {c: F.count(c).over(p.whole) for c in derived}
    return df.withColumns({c: F.when(given[c] == 0, e).otherwise(F.col(c)) for c, e in derived.items()})


def standardize_index(raw: DataFrame, seq: str, aliases: Mapping[str, str] = INDEX_ALIASES) -> DataFrame:
    """Index bars: standard names, numbers, one row per code and date - the last by ``seq``."""
    df = rename(raw, aliases)
    if "date" not in df.columns:
        raise ValueError("Price csv is missing date column.")
    numbers = [c for c in ("open", "high", "low", "close", "volume", "amount") if c in df.columns]
    df = df.withColumns({"date": parse_date("date"), **{c: to_number(c) for c in numbers}})
    keys = [c for c in ("code",) if c in df.columns] + ["date"]
    return keep_last(df, keys, [F.col(seq)]).drop(seq)


def standardize_stock(raw: DataFrame, seq: str) -> DataFrame:
    """Stock bars from files with 12 or 13 columns (named by position) or with known names.

    ``seq`` names an extra ingest-order column, not counted among the file's columns.
    """
    names = [c for c in raw.columns if c != seq]
    layout = {13: ["index", *BAR_COLUMNS], 12: BAR_COLUMNS}.get(len(names))
    if layout:
        raw = raw.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(names, layout)], seq)
    return standardize_index(raw, seq, STOCK_ALIASES if not layout else {})


def price_history(bars: DataFrame, start=None, end=None, fields: Sequence[str] | None = None, date: str = "date") -> DataFrame:
    """Rows in an inclusive date window; unknown field names are ignored, none known means all.

    Both are plain filter and projection, so they reach the scan.
    """
    if start is not None and end is not None:
        bars = bars.where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    known = [f for f in fields or [] if f in bars.columns]
    return bars.select(*known) if known else bars


def fundamentals_history(basics: DataFrame, code: str | Column, start, end, fields: Sequence[str] | None = None) -> DataFrame:
    """Daily fundamentals of one code, in order of the trade date."""
    return price_history(basics.where(F.col("ts_code") == code), start, end, None, "trade_date").orderBy("trade_date").transform(
        lambda d: price_history(d, fields=fields)
    )


# ---- quality and refresh --------------------------------------------------------------------------


def non_positive_prices(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Count of values at or below zero per price column; only series that have one."""
    cols = [c for c in PRICES if c in bars.columns]
    out = bars.groupBy(*keys).agg(*[F.count_if(F.col(c) <= 0).alias(c) for c in cols])
    return out.where(" OR ".join(f"{c} > 0" for c in cols))


def drop_bad_series(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return bars.join(non_positive_prices(bars, keys), list(keys), "left_anti")


def fetch_start(stored: DataFrame, default_start: str, lookback_days: int = 120, keys: Sequence[str] = ("symbol",), date: str = "date") -> DataFrame:
    """First day to fetch again per series: some days before its last bar, not before the default."""
    last = F.max(date)
    start = F.least(F.greatest(F.lit(default_start).cast("date"), F.date_sub(last, max(lookback_days, 1))), last)
    return stored.groupBy(*keys).agg(last.alias("last_date"), start.alias("fetch_start"))


def merge_refresh(stored: DataFrame, fresh: DataFrame, keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """Stored and fetched bars together; where both have a bar the fetched one counts."""
    both = stored.withColumn("_v", F.lit(0)).unionByName(fresh.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, list(keys), [F.col("_v")]).drop("_v")


def update_log(universe: DataFrame, stored: DataFrame, default_start: str, end: str, lookback_days: int = 120) -> DataFrame:
    """One row per symbol of the universe: status, latest date and the bounds of the next fetch."""
    out = universe.join(fetch_start(stored, default_start, lookback_days), "symbol", "left")
    start = F.coalesce("fetch_start", F.lit(default_start).cast("date"))
    return out.select(
        "symbol",
        F.when(F.col("last_date").isNull(), "failed").otherwise("updated").alias("status"),
        F.date_format("last_date", "yyyy-MM-dd").alias("latest_date"),
        F.date_format(start, "yyyyMMdd").alias("fetch_start"),
        F.date_format(F.lit(end).cast("date"), "yyyyMMdd").alias("fetch_end"),
        F.when(F.col("last_date").isNull(), "no stored bars").otherwise("").alias("message"),
    )


def export_shape(bars: DataFrame, industry: Column, code: Column, link: Column) -> DataFrame:
    """Bars under the provider's column names; columns that are not there are null."""
    bars = add_missing(bars, list(EXPORT_COLUMNS))
    return bars.select(
        industry.alias("industry_name"), code.alias("index_code"), link.alias("source_link"), F.date_format("date", "yyyy-MM-dd").alias("日期"),
        *[F.col(c).alias(n) for c, n in EXPORT_COLUMNS.items()],
    )


def skip_report(universe: DataFrame, bars: DataFrame, start: str, end: str, min_rows: int = 120, panel: Panel = BARS, errors: DataFrame | None = None) -> DataFrame:
    """Why symbols of the universe cannot be studied: reason, the first that applies, and detail.

    ``errors`` (keys, error, detail) names symbols whose files could not be read, as ``read_price_files`` reports them: their
    reason is the class of the error. A symbol with an error and bars of other files counts as failed.
    """
    inside = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    have = bars.groupBy(*panel.keys).agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(inside).alias("_in"),
        *[F.count(F.when(inside, F.col(c))).alias(f"_{c}") for c in ("close", "high", "low")],
    )
    out = universe.join(have, list(panel.keys), "left")
    failed = F.lit(None).cast("string")
    if errors is not None:
        first = errors.where("error IS NOT NULL").groupBy(*panel.keys).agg(F.min(F.struct("error", "detail")).alias("_failed"))
        out, failed = out.join(first, list(panel.keys), "left"), F.col("_failed.error")
    reason = (
        F.when(failed.isNotNull(), failed)
        .when(F.col("_all").isNull(), "missing_csv")
        .when(F.col("_in") == 0, "empty_price_data")
        .when(F.col("_in") < min_rows, "insufficient_history")
        .when((F.col("_close") == 0) | (F.col("_high") == 0) | (F.col("_low") == 0), "missing_required_columns")
    )
    out = out.withColumns({"reason": reason, "detail": F.lit(None).cast("string") if errors is None else F.col("_failed.detail")})
    return out.where("reason IS NOT NULL").drop("_all", "_in", "_close", "_high", "_low", "_failed")


# ---- universes and listings -------------------------------------------------------------------------


def read_universe(spark: SparkSession, path: str, with_exchange: bool = False, first: int | None = None) -> DataFrame:
    """Symbols of a text file in file order: one per line, blank lines skipped, optional first n."""
    from tapeloom.functions.scalars import exchange_code, plain_code

    lines = spark.read.text(path).select(
        F.trim("value").alias("value"), F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id")).alias("line_no")
    ).where("value <> ''")
    out = lines.select((exchange_code if with_exchange else plain_code)("value").alias("symbol"), "line_no")
    return out if first is None else out.orderBy("line_no").limit(first)


# fixed values: names of code, name and link columns in index lists
CODE_NAMES = ["index_code", "code", "industry_code", "板块代码", "行业代码"]
NAME_NAMES = ["industry_name", "name", "board_name", "板块名称", "行业名称"]
LINK_NAMES = ["link", "source_link", "url"]


def pick_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    lower = {c.strip().lower(): c for c in columns}
    for name in candidates:
        if name in columns:
            return name
        if name.lower() in lower:
            return lower[name.lower()]
    return None


def standardize_index_list(raw: DataFrame, order: str, codes: Sequence[str] | None = None, first: int | None = None) -> DataFrame:
    """index_code, industry_name, link: blanks dropped, the first row per code by ``order``."""
    names = [c for c in raw.columns if c != order]
    code, name, link = (pick_column(names, c) for c in (CODE_NAMES, NAME_NAMES, LINK_NAMES))
    if code is None or name is None:
        raise ValueError("the index list must contain index_code and industry_name columns.")
    df = raw.select(
        normalize_code(f"`{code}`").alias("index_code"), normalize_text(f"`{name}`").alias("industry_name"),
        (normalize_text(f"`{link}`") if link else F.lit("")).alias("link"), F.col(order).alias("_order"),
    ).where("index_code <> '' AND industry_name <> ''")
    df = keep_last(df, ["index_code"], [-F.col("_order")])
    if codes is not None:
        wanted = raw.sparkSession.createDataFrame([(c,) for c in codes], "c string").select(normalize_code("c").alias("index_code")).where("index_code <> ''")
        df = df.join(wanted, "index_code", "left_semi")
    if first is not None and first > 0:
        df = df.orderBy("_order").limit(first)
    return df.drop("_order")


def listing_codes(listing: DataFrame, market: str | None = None, code: str = "ts_code", board: str | None = "market", snapshot: str | None = None) -> DataFrame:
    """A-share codes of a listing table in numeric order; the newest constituent snapshot only."""
    from tapeloom.functions.scalars import is_a_share

    if board is not None and board in listing.columns:
        listing = listing.where(~F.coalesce(F.col(board).contains("B"), F.lit(False)))
    if snapshot is not None:
        newest = listing.agg(F.max(snapshot).alias(snapshot))
        listing = listing.join(newest, snapshot, "left_semi")
    text = F.split_part(F.trim(F.col(code).cast("string")), F.lit("."), F.lit(1))
    text = F.when(text.rlike(r"^\d+$") & (F.length(text) < 6), F.lpad(text, 6, "0")).otherwise(text)
    return listing.select(text.alias("code")).where(is_a_share("code", market)).distinct().orderBy(F.col("code").cast("int"))


def code_column(listing: DataFrame, candidates: Sequence[str]) -> str | None:
    """The column that holds codes: by candidate name, by a name with 'code', or by its values.

    By value: the first column of whose values at least 60 % are six digits, with ten different ones; one
    aggregate over all rows.
    """
    hit = pick_column(listing.columns, candidates)
    if hit:
        return hit
    for c in listing.columns:
        if "code" in c.lower():
            return c
    facts = []
    for i, c in enumerate(listing.columns):
        s = F.split_part(F.trim(F.col(f"`{c}`").cast("string")), F.lit("."), F.lit(1))
        s = F.when(s.rlike(r"^\d+$") & (F.length(s) < 6), F.lpad(s, 6, "0")).otherwise(s)
        ok = s.rlike(r"^\d{6}$")
        facts += [F.avg(ok.cast("double")).alias(f"share{i}"), F.count_distinct(F.when(ok, s)).alias(f"kinds{i}")]
    row = listing.agg(*facts).first()
    return next((c for i, c in enumerate(listing.columns) if (row[f"share{i}"] or 0) >= 0.6 and row[f"kinds{i}"] >= 10), None)


# ---- result files -----------------------------------------------------------------------------------


def _with_zeros(df: DataFrame) -> DataFrame:
    """Text codes of six digits at least."""
    return df.withColumns({c: F.when(F.length(c) < 6, F.lpad(c, 6, "0")).otherwise(F.col(c)) for c in ("symbol", "code") if c in df.columns})


def read_event_windows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Event windows with text codes padded to six digits; required columns are checked."""
    from tapeloom.operators.events import check_window_columns

    df = read_csv(spark, path, schema=schema)
    check_window_columns(df)
    return _with_zeros(df)


# fixed values: names of the files of an event study
WINDOW_FILES, META_FILES = "event_windows_", "event_meta_"


def _study(path: Column, prefix: str) -> Column:
    return F.regexp_extract(path, rf"/{prefix}([^/]*)\.csv(?:/[^/]*)?$", 1)


def event_window_files(spark: SparkSession, root: str) -> DataFrame:
    """study, path, meta_path (null where it isn't there) of the event window files in a folder, in name order.

    A file may also be a folder of that name with parts in it, as Spark writes it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    named = lambda prefix: files.where(_study(F.col("path"), prefix) != "").select(
        _study(F.col("path"), prefix).alias("study"), F.regexp_extract("path", rf"^(.*/{prefix}[^/]*\.csv)(?:/[^/]*)?$", 1).alias("path")).distinct()
    return named(WINDOW_FILES).join(named(META_FILES).withColumnRenamed("path", "meta_path"), "study", "left").orderBy("study")


def read_event_studies(spark: SparkSession, root: str, schema: str, meta_schema: str) -> DataFrame:
    """All event windows in a folder beside the metadata of their event, each study with the file of its own name.

    study, the columns of the windows, and those of the metadata but event_close. Windows without metadata have nulls; required
    columns are checked, text codes keep their zeros. All studies are one scan of each kind of file and one join.
    """
    from tapeloom.operators.events import check_window_columns

    def read(prefix: str, columns: str) -> DataFrame:
        reader = spark.read.option("header", "true").schema(columns)
        df = reader.csv(f"{root}/{prefix}*.csv")
        path = F.regexp_replace(F.col("_metadata.file_path"), "%20", " ")
        return _with_zeros(df.withColumn("study", _study(path, prefix)))

    keys = ["study", "symbol", "event_date"]
    windows = read(WINDOW_FILES, schema)
    check_window_columns(windows)
    if event_window_files(spark, root).where("meta_path IS NOT NULL").isEmpty():
        return windows
    meta = read(META_FILES, meta_schema)
    return windows.join(meta.drop("event_close").dropDuplicates(keys), keys, "left")


def read_results(spark: SparkSession, path: str, schema: str, start=None, end=None) -> DataFrame:
    """A stored result or trade log, typed, cut to a date window, in date order."""
    return price_history(read_csv(spark, path, schema=schema), start, end).orderBy("date")
