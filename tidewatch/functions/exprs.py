"""Scalar expressions: time, ratios, JSON, hashing, geometry."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.sources.schemas import BOATS

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- fixed values --------------------------------------------------------------

# Other spellings of a zone -> its stored name.
ZONE_ALIASES = {"CBD": "Central Business District (CBD)"}

# Day parts: first hour, hour after the last, text.
DAY_PARTS = [
    (0, 4, "late night hours (12:00 AM - 4:00 AM)"),
    (4, 7, "early morning setup period (4:00 AM - 7:00 AM)"),
    (7, 9, "morning rush hours (7:00 AM - 9:00 AM)"),
    (9, 12, "late morning period (9:00 AM - 12:00 PM)"),
    (12, 14, "lunch service peak (12:00 PM - 2:00 PM)"),
    (14, 17, "afternoon hours (2:00 PM - 5:00 PM)"),
    (17, 20, "evening dinner period (5:00 PM - 8:00 PM)"),
    (20, 23, "nightlife hours (8:00 PM - 11:00 PM)"),
    (23, 24, "late night period (11:00 PM - 12:00 AM)"),
]


# -- zones and numbers -----------------------------------------------------------


def canonical_zone(zone: ColumnOrName) -> Column:
    """Stored name of a zone that may be given by an alias."""
    names = F.create_map(*[F.lit(x) for pair in ZONE_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, _c(zone)), _c(zone))


def to_number(value: ColumnOrName, default: float | None = 0.0) -> Column:
    """Double from any scalar; text that is no number becomes ``default``."""
    number = _c(value).try_cast("double")
    return number if default is None else F.coalesce(number, F.lit(default))


def ratio(actual: ColumnOrName, expected: ColumnOrName, digits: int = 1) -> Column:
    """``actual / expected`` rounded; null when the baseline is zero or null."""
    return F.round(F.try_divide(_c(actual).cast("double"), _c(expected).cast("double")), digits)


def percent_over(actual: ColumnOrName, expected: ColumnOrName, integer_pct: bool = False) -> Column:
    """Rise over the baseline in percent, one digit; null when the baseline is zero.

    ``integer_pct=True`` divides whole numbers first, as SQL does on BIGINTs, so
    the result is a multiple of 100.
    """
    a, e = _c(actual), F.nullif(_c(expected), F.lit(0))
    if integer_pct:
        return F.round(F.call_function("div", a - e, e).cast("double") * 100, 1)
    return F.round(F.try_divide((a - e).cast("double"), e.cast("double")) * 100, 1)


def text_or(value: Column, default: str) -> Column:
    return F.coalesce(value.cast("string"), F.lit(default))


# -- time --------------------------------------------------------------------------


def as_timestamp(value: ColumnOrName, data_type: str) -> Column:
    """Epoch milliseconds or text of them to a timestamp; timestamps pass through."""
    if data_type.startswith("timestamp"):
        return _c(value).cast("timestamp")
    return F.timestamp_millis(_c(value).try_cast("double").cast("long"))


def window_start_ms(ms: ColumnOrName, minutes: int = 1) -> Column:
    """Start of the epoch-aligned window holding an instant in milliseconds."""
    size = F.lit(minutes * 60_000).cast("long")
    return _c(ms) - F.pmod(_c(ms), size)


def window_end_ms(ms: ColumnOrName, minutes: int = 1) -> Column:
    return window_start_ms(ms, minutes) + F.lit(minutes * 60_000).cast("long")


def seconds_to_next_window(ts: ColumnOrName, minutes: int = 1) -> Column:
    size = F.lit(minutes * 60).cast("long")
    return size - F.pmod(F.unix_seconds(_c(ts)), size)


def day_part(ts: ColumnOrName) -> Column:
    hour, out = F.hour(_c(ts)), None
    for first, after, text in DAY_PARTS:
        cond = (hour >= first) & (hour < after)
        out = F.when(cond, F.lit(text)) if out is None else out.when(cond, F.lit(text))
    return out


def clock_12h(ts: ColumnOrName) -> Column:
    return F.date_format(_c(ts), "h:mm a")


def clock_24h(ts: ColumnOrName) -> Column:
    return F.date_format(_c(ts), "HH:mm")


def display_utc(ts: ColumnOrName) -> Column:
    """``2024-01-31 17:05 UTC``, or ``N/A``."""
    return F.coalesce(F.date_format(_c(ts), "yyyy-MM-dd HH:mm' UTC'"), F.lit("N/A"))


def hours_around(ts: ColumnOrName, hours: int) -> tuple[Column, Column]:
    step = F.make_dt_interval(F.lit(0), F.lit(hours))
    return _c(ts) - step, _c(ts) + step


# -- JSON ----------------------------------------------------------------------------


def boats(raw: ColumnOrName) -> Column:
    """Boats of a dispatch; null unless the text is a JSON array.

    A lone object would also parse as a one-item array, so the first character
    is tested.
    """
    text = _c(raw)
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, BOATS))


def is_json(raw: ColumnOrName) -> Column:
    """True for text that is a JSON object or array.

    The variant parser is strict and accepts any value; scalars are excluded by
    the first character.
    """
    text = F.ltrim(_c(raw))
    parsed = F.try_parse_json(_c(raw))
    return F.coalesce(parsed.isNotNull() & (text.startswith("{") | text.startswith("[")), F.lit(False))


def first_embedding(response: str = "data") -> Column:
    """``data[0].embedding`` of a model response; null when the list is empty."""
    return F.try_element_at(F.col(response), F.lit(1)).getField("embedding")


def hit(results: ColumnOrName, rank: int, field: str) -> Column:
    """Field of the hit at a 1-based rank; null past the end."""
    return F.try_element_at(_c(results), F.lit(rank)).getField(field)


# -- ids and hashes --------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def _ascii_fold(text: pd.Series) -> pd.Series:
    return text.map(
        lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")
    )


def slug(*parts: ColumnOrName) -> Column:
    """URL-safe id of the joined parts: lower case, accents folded, runs of
    anything else as one dash."""
    raw = F.lower(F.concat_ws("-", *[F.coalesce(_c(p), F.lit("")) for p in parts]))
    return F.btrim(F.regexp_replace(_ascii_fold(raw), "[^a-z0-9]+", "-"), F.lit("-"))


def djb2(text: ColumnOrName) -> Column:
    """Unsigned 32-bit djb2 over the characters of an ASCII text."""
    chars = F.filter(F.split(_c(text), ""), lambda c: c != "")
    mask = F.lit(0xFFFFFFFF).cast("long")
    return F.aggregate(
        chars, F.lit(5381).cast("long"), lambda h, c: (h * F.lit(33) + F.ascii(c)).bitwiseAND(mask)
    )


def start_offset_ms(vessel_id: ColumnOrName, loop_ms: int = 30_000, duration_ms: int = 8_000) -> Column:
    return F.pmod(djb2(vessel_id), F.lit(max(1, loop_ms - duration_ms)).cast("long"))


# -- geometry ----------------------------------------------------------------------------


def heading_deg(dx: Column, dy: Column) -> Column:
    """Degrees, 0 = east, 90 = north."""
    return F.degrees(F.atan2(dy, dx))


def lerp(a: Column, b: Column, share: Column) -> Column:
    return a + (b - a) * share
