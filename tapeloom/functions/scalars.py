"""Scalar functions on codes, texts, dates and numbers, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.functions.kernels import col, flag

# fixed values: words that mean nothing is there
NULL_WORDS = ("none", "null", "nan")
TRUE_WORDS = ("true", "1", "yes", "y", "t")
FALSE_WORDS = ("false", "0", "no", "n", "f", "nan", "none", "null", "")
# fixed values: first digits of codes listed in Shanghai
SHANGHAI_FIRST = ("5", "6", "9")


def exchange_code(symbol: Column | str) -> Column:
    """Code with its exchange suffix; a dotted code keeps its own. Empty codes are an error."""
    s = F.upper(F.trim(col(symbol)))
    suffix = F.when(F.substring(s, 1, 1).isin(*SHANGHAI_FIRST), ".SH").otherwise(".SZ")
    out = F.when(s.contains("."), s).otherwise(F.concat(s, suffix))
    return F.when(F.coalesce(s, F.lit("")) == "", F.raise_error(F.lit("symbol cannot be empty"))).otherwise(out)


def plain_code(symbol: Column | str) -> Column:
    """Code without its exchange suffix."""
    return F.split_part(F.upper(F.trim(col(symbol))), F.lit("."), F.lit(1))


def _is_null_word(s: Column) -> Column:
    return F.lower(s).isin(*NULL_WORDS)


def normalize_code(value: Column | str) -> Column:
    """Text code: null words become empty, a trailing .0 goes, digits are padded to six, never cut."""
    s = F.trim(col(value).cast("string"))
    t = F.regexp_replace(s, r"\.0$", "")
    padded = F.when(t.rlike(r"^\d+$") & (F.length(t) < 6), F.lpad(t, 6, "0")).otherwise(t)
    return F.when(s.isNull() | (s == "") | _is_null_word(s), "").otherwise(padded)


def normalize_text(value: Column | str) -> Column:
    s = F.trim(col(value).cast("string"))
    return F.when(s.isNull() | _is_null_word(s), "").otherwise(s)


# fixed values: date layouts, as text patterns; the last one has a time behind it
DIGITS = r"^(?!0000)\d{8}$"
PARTED = r"^(?!0000)\d{4}([-/.])\d{1,2}\1\d{1,2}$"
WITH_TIME = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}$"


def parse_date(value: Column | str) -> Column:
    """A date from one of the known layouts (2024-1-2, 20240102, 2024/1/2, 2024.1.2, 2024-1-2 9:30:00), else null.

    Dates alone are brought to one layout, which a cast reads; only a date with a time goes through a parser.
    """
    s = F.trim(col(value).cast("string"))
    dashed = F.when(s.rlike(PARTED), F.translate(s, "/.", "--")).when(s.rlike(DIGITS), F.concat_ws("-", F.left(s, F.lit(4)), F.substring(s, 5, 2), F.substring(s, 7, 2)))
    timed = F.when(s.rlike(WITH_TIME), F.to_date(F.try_to_timestamp(s, F.lit("yyyy-M-d H:m:s"))))
    return F.coalesce(dashed.try_cast("date"), timed)


def compact_date(value: Column | str, strict: bool = True) -> Column:
    """yyyymmdd; an unreadable date is an error, or null where not strict."""
    text = F.date_format(parse_date(value), "yyyyMMdd")
    if not strict:
        return text
    return F.coalesce(text, F.raise_error(F.concat(F.lit("Unsupported date format: "), F.coalesce(col(value).cast("string"), F.lit("null")))).cast("string"))


def safe_float(value: Column | str) -> Column:
    x = col(value).try_cast("double")
    return F.when(~F.isnan(x), x)


def safe_bool(value: Column | str) -> Column:
    return F.coalesce(col(value).cast("boolean"), F.lit(False))


def parse_bool(value: Column | str) -> Column:
    """Truth of a text: known words by list, any other text is true."""
    s = F.lower(F.trim(col(value).cast("string")))
    return F.when(s.isNull() | s.isin(*FALSE_WORDS), False).otherwise(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def fixed_text(value: Column | str, digits: int) -> Column:
    """A number with up to 15 fixed decimals, rounded by its exact binary value as printf does, ties to even.

    ``format_string`` rounds the shortest decimal of a double instead, so 460.95 (a little less in
    binary) would become 461.0. The fraction of a double is a number of 2**-52 parts, whole from 1 on; below 1, what is
    left of a part has 2**-52 parts of its own. Decimals can scale and round both exactly.
    """
    unit = F.lit(2**52).cast("decimal(20,0)")

    def scaled(n, body):
        """``body`` of 10**digits times a count of parts: whole units, and the rest in parts."""
        product = n.cast("decimal(20,0)") * F.lit(10**digits).cast("decimal(17,0)")
        return _let(product, lambda p: _let(p % unit, lambda rest: body(((p - rest) / unit).cast("long"), rest.cast("long"))))

    def rounded(whole, high, rest, beyond):
        down = high + F.shiftright(rest, 52)
        rest = rest % 2**52
        last = down if digits else whole + down
        up = (rest > 2**51) | ((rest == 2**51) & ((beyond > 0) | (last % 2 == 1)))
        return _let(down + up.cast("long"), lambda steps: text(whole, steps))

    def text(whole, steps):
        if digits == 0:
            return (whole + steps).cast("string")
        carry = (steps >= 10**digits).cast("long")
        return F.concat((whole + carry).cast("string"), F.lit("."), F.lpad((steps - carry * 10**digits).cast("string"), digits, "0"))

    def exact(x):
        whole = F.floor(x)
        return _let((x - whole) * float(2**52), lambda parts: scaled(F.floor(parts), lambda high, rest: scaled(
            F.floor((parts - F.floor(parts)) * float(2**52)), lambda more, beyond: rounded(whole, high, rest + more, beyond))))

    def signed(v):
        x = F.abs(v)
        sign = F.when(v.cast("string").startswith("-"), "-").otherwise("")
        return F.when(F.isnan(v), "nan").otherwise(F.concat(sign, F.when(x == float("inf"), "inf").otherwise(exact(x))))

    return _let(col(value).cast("double"), signed)


def format_number(value: Column | str, digits: int = 2, percentage: bool = False) -> Column:
    return F.concat(fixed_text(col(value) * 100, digits), F.lit("%")) if percentage else fixed_text(value, digits)


def format_or_dash(value: Column | str, digits: int = 2, suffix: str = "") -> Column:
    x = safe_float(value)
    return F.when(x.isNull(), "-").otherwise(F.concat(fixed_text(x, digits), F.lit(suffix)))


def run_label(snapshot: Column | str) -> Column:
    """The label of a monitor run: intraday before 16:00, else close."""
    return F.when(F.hour(col(snapshot)) < 16, "1430_intraday").otherwise("1900_close")


def digits_of(symbol: Column | str) -> Column:
    return F.regexp_replace(col(symbol), "[^0-9]", "")


# fixed values: strength bands from strong to weak, and the word for a missing value
STRENGTH = {"missing": "缺失", "strong": "强势", "firm": "偏强", "soft": "偏弱", "weak": "弱势"}


def strength_level(pct: Column | str, strong: float = 5.0) -> Column:
    x = col(pct)
    return (
        F.when(x.isNull() | F.isnan(x), STRENGTH["missing"])
        .when(x >= strong, STRENGTH["strong"])
        .when(x >= 0, STRENGTH["firm"])
        .when(x > -strong, STRENGTH["soft"])
        .otherwise(STRENGTH["weak"])
    )


def is_a_share(code: Column | str, market: str | None = None) -> Column:
    """Six digits with the first digits of the market (both markets when none is named)."""
    c = col(code)
    rules = {"SH": "^6", "SZ": "^(000|001|002|003|300|301)"}
    if market is not None and market not in rules:
        raise ValueError(f"Unsupported market: {market}")
    hit = c.rlike(rules[market]) if market else c.rlike(rules["SH"]) | c.rlike(rules["SZ"])
    return flag(c.rlike(r"^\d{6}$") & hit)
