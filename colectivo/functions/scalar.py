"""Text, clock and scoring expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Schedule

def _plain_letters() -> dict[str, str]:
    """Lower-case letters that canonical decomposition turns into a plain letter and marks, with that letter."""
    out = {}
    for letter in map(chr, range(0xC0, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", letter)
        if marks and letter == letter.lower() and base.isalpha() and all(unicodedata.category(m) == "Mn" for m in marks):
            out[letter] = base
    return out


_PLAIN = _plain_letters()

# Fixed value: words that may precede the number of a line.
LINE_PREFIX = r"^(linea|line|l\.?)\s*"

# Days until a detour report is worthless, reports that saturate trust.
DETOUR_HORIZON_DAYS = 14
DETOUR_SATURATION = 20


def strip_accents(text: Column) -> Column:
    bare = F.translate(text, "".join(_PLAIN), "".join(_PLAIN.values()))
    return F.regexp_replace(bare, "[\\u0300-\\u036f]", "")


def line_name_key(name: Column) -> Column:
    """Comparable form of a line name: no case, accents or leading word for line."""
    plain = strip_accents(F.lower(F.trim(name)))
    return F.trim(F.regexp_replace(plain, LINE_PREFIX, ""))


def descriptor_key(text: Column) -> Column:
    """Lower case with single spaces; null when nothing is left."""
    key = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.when(key != "", key)


def label_family(label: Column) -> Column:
    return F.regexp_replace(label, r"\.\d+$", "")


def edge_key(edge_id: Column, forward: Column) -> Column:
    return F.concat_ws(":", edge_id.cast("string"), F.when(forward, "f").otherwise("r"))


def edge_key_id(key: Column) -> Column:
    return F.split(key, ":").getItem(0).cast("bigint")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of either timestamp type."""
    return F.unix_micros(ts.cast("timestamp"))


def local_time(ts: Column, cfg: Schedule = Schedule()) -> Column:
    return ts + F.expr(f"INTERVAL {cfg.utc_offset_hours} HOURS")


def day_bucket(local_ts: Column) -> Column:
    weekday = F.weekday(local_ts)
    return F.when(weekday == 5, "saturday").when(weekday == 6, "sunday").otherwise("weekday")


def seconds_of_day(local_ts: Column) -> Column:
    return F.hour(local_ts) * 3600 + F.minute(local_ts) * 60 + F.second(local_ts)


def clock_text(seconds: Column) -> Column:
    """Seconds of day, rounded half-even, as HH:MM:SS."""
    whole = F.pmod(F.bround(seconds, 0).cast("bigint"), F.lit(86400))
    part = lambda value: F.lpad(F.floor(value).cast("string"), 2, "0")
    return F.concat_ws(":", part(whole / 3600), part((whole % 3600) / 60), part(whole % 60))


def whole_days(later: Column, earlier: Column) -> Column:
    """Elapsed whole days, floored."""
    return F.floor((micros(later) - micros(earlier)) / 86_400_000_000)


def detour_confidence(days: Column, count: Column) -> Column:
    """Percent trust in a detour: fades over two weeks, grows with confirmations."""
    freshness = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - days / DETOUR_HORIZON_DAYS))
    backing = F.log1p(F.greatest(F.lit(0), count - 1).cast("double")) / F.log1p(F.lit(float(DETOUR_SATURATION)))
    trust = F.least(F.lit(1.0), 0.5 + 0.5 * backing)
    percent = F.bround(100 * freshness * trust, 0).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(100), percent))
