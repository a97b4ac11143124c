"""Roles and units read off column names. Pure Python: no job runs."""

from __future__ import annotations

import re

# Word lists and patterns.
ADMIN_PATTERN = r"^id$|^idx$|^index$|_id$|^id_|_index$|_idx$|^row_?id$|^row_?num(ber)?$|^uuid$|_uuid$|^guid$|_guid$|^timestamp$|_timestamp$|^created(_at)?$|_created(_at)?$|^updated(_at)?$|_updated(_at)?$"
ADMIN_PARTS = ["meta", "metadata", "ingest", "ingestion", "audit", "rownum", "serial", "sequence", "record_id"]
METADATA_NAMES = ["id", "idx", "index", "rowid", "row_id", "rownum", "row_num", "rownumber", "uuid", "guid", "timestamp", "created", "created_at", "updated", "updated_at", "date", "time", "lat", "latitude", "lon", "lng", "coords", "coordinate", "coordinates"]
METADATA_ENDS = ["_id", "_idx", "_index", "_uuid", "_guid", "_timestamp", "_created", "_created_at", "_updated", "_updated_at", "_date", "_time", "_lat", "_lon", "_lng", "_coord", "_coords", "_coordinate", "_coordinates"]
METADATA_PARTS = ["metadata", "audit", "ingest"]
TARGET_PARTS = ["score", "class", "target", "label", "outcome", "response"]
LEAK_PARTS = ["future", "post", "outcome", "label", "resolved", "actual"]
DATE_WORDS = ["date", "datetime", "timestamp", "created_at", "updated_at", "event_time", "time"]
DURATION_WORDS = ["runtime", "duration", "latency", "elapsed", "seconds", "minutes", "hours", "days", "ms"]
UNITS: list[tuple[str, list[str]]] = [
    ("currency", ["price", "cost", "revenue", "salary", "income", "expense", "budget", "usd", "eur", "gbp", "jpy", "amount", "payment"]),
    ("percent", ["percent", "percentage", "pct", "%"]),
    ("ratio", ["ratio"]),
    ("rate", ["rate", "per_", "per ", "/"]),
    ("count", ["count", "qty", "quantity", "num", "number", "users", "cases", "population", "clicks", "visits"]),
    ("duration", ["duration", "latency", "time", "seconds", "second", "minutes", "minute", "hours", "hour", "days", "day", "ms"]),
    ("distance", ["distance", "km", "kilometer", "mile", "meter", "meters", "miles"]),
    ("mass", ["weight", "mass", "kg", "kilogram", "lb", "pound", "grams", "gram"]),
    ("volume", ["volume", "litre", "liter", "ml", "gallon"]),
    ("temperature", ["temp", "temperature", "celsius", "fahrenheit", "kelvin"]),
    ("score", ["score", "index", "rating"]),
]
#: Units without a dimension go with any other; these pairs do too.
DIMENSIONLESS = {"percent", "ratio", "score"}
RATIO_PAIRS = {("currency", "count"), ("distance", "duration"), ("count", "duration")}


def words(name: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()) if w]


def is_admin(name: str) -> bool:
    n = name.strip().lower()
    return bool(n) and (re.search(ADMIN_PATTERN, n) is not None or any(p in n for p in ADMIN_PARTS))


def is_metadata(name: str) -> bool:
    n = name.strip().lower()
    return n in METADATA_NAMES or n.startswith("id_") or n.endswith(tuple(METADATA_ENDS)) or any(p in n for p in METADATA_PARTS)


def is_target_candidate(name: str) -> bool:
    return name.lower() in ("y", "y_true") or any(p in name.lower() for p in TARGET_PARTS)


def is_date_like(name: str) -> bool:
    n = name.lower()
    bounded = lambda w: re.search(rf"(?<![a-z0-9]){re.escape(w)}(?![a-z0-9])", n)
    return any(bounded(w) for w in DATE_WORDS) and not any(bounded(w) for w in DURATION_WORDS)


def leak_hint(name: str) -> bool:
    return any(p in name.lower() for p in LEAK_PARTS)


def unit(name: str) -> str:
    """The first unit of which a word occurs in the name, or unknown."""
    n = name.strip().lower()
    return next((u for u, tokens in UNITS if any(t in n for t in tokens)), "unknown")


def ratio_compatible(a: str, b: str) -> bool:
    """Unless both units are known, have dimensions, differ and are no common quotient."""
    x, y = unit(a), unit(b)
    return "unknown" in (x, y) or x == y or bool({x, y} & DIMENSIONLESS) or (x, y) in RATIO_PAIRS or (y, x) in RATIO_PAIRS


def role(name: str, distinct: int, null_ratio: float, rows: int = 0, id_like: bool = False) -> str:
    """ADMIN (all values differ in an id-like column), CONSTANT, LOW_SIGNAL, TARGET_CANDIDATE,
    METADATA or FEATURE, first that applies."""
    if id_like and rows and distinct == rows:
        return "ADMIN"
    if distinct <= 1:
        return "CONSTANT"
    if null_ratio > 0.40:
        return "LOW_SIGNAL"
    if any(p in name.lower() for p in ("score", "target", "label", "total", "class")):
        return "TARGET_CANDIDATE"
    return "METADATA" if is_metadata(name) else "FEATURE"


def task(distinct: int, rows: int) -> str:
    """binary, ordinal or regression from the distinct count of a target."""
    ratio = distinct / rows if rows else 0
    if distinct <= 2:
        return "binary"
    return "ordinal" if distinct <= 8 or distinct <= 12 and ratio <= 0.06 or distinct <= 20 and ratio <= 0.03 else "regression"


def engineered_base(name: str) -> tuple[str, ...]:
    """The columns that an engineered name derives from; empty for an original one."""
    for pattern in (r"^(.*)_pow\d+$", r"^(.*)_log1p_abs$"):
        if m := re.match(pattern, name):
            return (m[1],)
    for mark in ("_x_", "_div_"):
        if mark in name:
            return tuple(name.split(mark, 1))
    return ()


def column_token(token: str) -> str:
    """A token as part of a column name, at most 24 characters."""
    return re.sub(r"[^a-z0-9]+", "_", token.lower()).strip("_")[:24] or "value"


def normalise_header(header: list[str]) -> list[str]:
    """Empty names become column_<i>; repeated names get _2, _3 and so on."""
    out: list[str] = []
    seen: set[str] = set()
    for i, raw in enumerate(header):
        base = (raw or "").replace("﻿", "").strip() or f"column_{i}"
        name, k = base, 1
        while name in seen:
            k += 1
            name = f"{base}_{k}"
        seen.add(name)
        out.append(name)
    return out
