"""P1 parse_offset_timestamp, P2 assign_night, P3 interval_minutes.

Health export timestamps look like ``2024-06-18 23:10:00 -0400``. Two values
come out of one text: the *instant* (for durations and range joins) and the
*wall clock* in the record's own offset (for the night key). Spark timestamps
drop the offset, so the wall clock is taken from the first 19 characters.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXPORT_TS_FORMAT = "yyyy-MM-dd HH:mm:ss Z"
WALL_FORMAT = "yyyy-MM-dd HH:mm:ss"
NIGHT_SHIFT_HOURS = 6


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_offset_instant(c) -> Column:
    """Instant (TIMESTAMP) of an offset text; bad text -> null."""
    return F.try_to_timestamp(_col(c), F.lit(EXPORT_TS_FORMAT))


def parse_offset_wallclock(c) -> Column:
    """Wall clock (TIMESTAMP_NTZ) in the text's own offset; bad text -> null."""
    text = _col(c)
    return F.when(parse_offset_instant(text).isNotNull(),
                  F.to_timestamp_ntz(F.substring(text, 1, 19), F.lit(WALL_FORMAT)))


def assign_night(wall_clock) -> Column:
    """Night date = calendar date of (wall clock - 6 hours)."""
    return F.to_date(_col(wall_clock) - F.expr(f"INTERVAL {NIGHT_SHIFT_HOURS} HOURS"))


def interval_minutes(start, end) -> Column:
    """(end - start) in minutes as double (microsecond precision)."""
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end)).cast("double") / F.lit(60_000_000.0)
