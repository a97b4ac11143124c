"""Cell parsing as pure column expressions: missing tokens, numbers, dates, booleans, token lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MISSING = ["", "na", "n/a", "null", "none", "nan", "missing", "unknown", "unk", "?", "-", "--", "tbd"]
TRUE_TOKENS = ["1", "true", "yes", "y", "t", "on"]
FALSE_TOKENS = ["0", "false", "no", "n", "f", "off"]
LAST_EPOCH = 2524608000

_BLANK = " \t\r\n\x0b\x0c"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANK))


def missing_to_null(c: Column) -> Column:
    """Null for missing tokens in any case and padding; the trimmed cell otherwise."""
    t = trimmed(c.cast("string"))
    return F.when(F.lower(t).isin(MISSING), None).otherwise(t)


def separators(s: Column, policy: str = "auto") -> Column:
    """A number with a decimal point and no grouping, under a separator policy (us, eu, auto)."""
    us = F.replace(s, F.lit(","), F.lit(""))
    eu = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    if policy == "us":
        return us
    if policy == "eu":
        return eu
    comma, point = F.contains(s, F.lit(",")), F.contains(s, F.lit("."))
    comma_last = F.instr(F.reverse(s), ",") < F.instr(F.reverse(s), ".")
    one_comma = s.rlike(r"^[^,]*,[0-9]{1,4}$") & ~s.rlike(r"[0-9],[0-9]{3}$")
    return F.when(comma & point, F.when(comma_last, eu).otherwise(us)).when(comma & one_comma, F.replace(s, F.lit(","), F.lit("."))).otherwise(us)


_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_number(c: Column, policy: str = "auto") -> Column:
    """A finite double or null. White space and underscores go, a leading plus and a trailing per
    cent sign too (the value is not divided)."""
    s = F.regexp_replace(trimmed(c.cast("string")), r"[\s_]", "")
    s = F.regexp_replace(F.regexp_replace(separators(s, policy), r"^\+", ""), r"%$", "")
    v = F.when(s.rlike(_NUMBER), s.try_cast("double"))
    return F.when(F.abs(v) < float("inf"), v)


def looks_numeric(c: Column) -> Column:
    """At least 80 % of the characters may stand in a number, one of them a digit."""
    s = trimmed(c.cast("string"))
    good = F.length(F.regexp_replace(s, r"[^0-9.,+\-%$()_]", ""))
    return s.rlike("[0-9]") & (good * 5 >= F.length(s) * 4)


def coerce_number(c: Column, policy: str = "auto") -> Column:
    """Hard coercion of a numeric-looking cell: keeps digits, separators, one sign and exponent;
    parentheses mean a negative value."""
    s = trimmed(c.cast("string"))
    negative = s.rlike(r"^\(.*\)$") | s.rlike(r"^[^0-9]*-")
    kept = F.regexp_extract(F.regexp_replace(s, r"[^0-9.,eE+\-]", ""), r"([0-9.,]*[0-9])(?:[eE][+\-]?[0-9]+)?", 0)
    v = parse_number(kept, policy)
    return F.when(looks_numeric(c), F.coalesce(parse_number(c, policy), F.when(negative, -v).otherwise(v)))


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0))


def parse_datetime(c: Column, hint: str = "auto") -> Column:
    """A timestamp or null: epoch seconds, ISO dates, d/m/y or m/d/y by hint, DD-MM-YYYY, MM-DD-YY
    (70 and later is 19yy), ISO weeks; a time HH:MM:SS may follow after a space, second 60 rolls over."""
    s = trimmed(c.cast("string"))
    date = F.regexp_extract(s, r"^(\S+)(?: ([0-9]{1,2}):([0-9]{2}):([0-9]{2}))?$", 1)
    part = lambda i: F.regexp_extract(s, r"^(\S+)(?: ([0-9]{1,2}):([0-9]{2}):([0-9]{2}))?$", i)
    num = lambda pattern, i: F.regexp_extract(date, pattern, i).try_cast("int")
    iso, slash, dmy, mdy2, week = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$", r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", r"^([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})$", r"^([0-9]{1,2})-([0-9]{1,2})-([0-9]{2})$", r"^([0-9]{4})-W([0-9]{2})-([1-7])$"
    a, b, y = num(slash, 1), num(slash, 2), num(slash, 3)
    day_first = {"dmy": F.lit(True), "mdy": F.lit(False)}.get(hint, (a > 12) & (b <= 12))
    two = num(mdy2, 3)
    monday = F.date_sub(F.make_date(num(week, 1), F.lit(1), F.lit(4)), F.weekday(F.make_date(num(week, 1), F.lit(1), F.lit(4))))
    week_day = F.date_add(monday, (num(week, 2) - 1) * 7 + num(week, 3) - 1).cast("timestamp")
    day = (
        F.when(date.rlike(iso), _ymd(num(iso, 1), num(iso, 2), num(iso, 3)))
        .when(date.rlike(slash), F.when(day_first, _ymd(y, b, a)).otherwise(_ymd(y, a, b)))
        .when(date.rlike(dmy), _ymd(num(dmy, 3), num(dmy, 2), num(dmy, 1)))
        .when(date.rlike(mdy2), _ymd(F.when(two >= 70, 1900 + two).otherwise(2000 + two), num(mdy2, 1), num(mdy2, 2)))
        .when(date.rlike(week) & num(week, 2).between(1, 53), week_day)
    )
    h, m, sec = (F.coalesce(part(i).try_cast("int"), F.lit(0)) for i in (2, 3, 4))
    timed = F.when((h <= 23) & (m <= 59) & (sec <= 60), F.timestamp_seconds(F.unix_timestamp(day) + h * 3600 + m * 60 + sec))
    epoch = F.when(s.rlike(r"^[0-9]{1,10}$"), s.try_cast("long"))
    return F.when(epoch <= LAST_EPOCH, F.timestamp_seconds(epoch)).otherwise(timed)


def parse_boolean(c: Column) -> Column:
    t = F.lower(trimmed(c.cast("string")))
    return F.when(t.isin(TRUE_TOKENS), True).when(t.isin(FALSE_TOKENS), False)


def tokens(c: Column, separator: str) -> Column:
    """Lower-cased, trimmed, non-empty parts of a multi-select cell, each once, in order."""
    parts = F.transform(F.split(c.cast("string"), "[" + separator + "]"), lambda x: F.lower(trimmed(x)))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))


def html_escape(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def fixed(c: Column, digits: int = 4) -> Column:
    """A number as text with fixed decimals; "n/a" where it is not finite, zero without a sign."""
    snapped = F.when(F.abs(c) < 10.0 ** -(digits + 2), 0.0).otherwise(c)
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), "n/a").otherwise(F.format_string(f"%.{digits}f", snapped))


def score_bar(c: Column, width: int = 10) -> Column:
    """A bar of # for a score in 0..1."""
    n = F.round(clamp(c, 0.0, 1.0) * width).cast("int")
    return F.concat(F.repeat(F.lit("#"), n), F.repeat(F.lit("."), width - n))
