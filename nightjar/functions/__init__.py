"""Column-level helpers: every function returns a ``Column`` built from
built-in Spark SQL functions, so it stays inside whole-stage codegen."""
from .clean import finite_or_null, safe_divide, sanitize_numeric, to_numeric_or_null
from .timeparse import assign_night, interval_minutes, parse_offset_instant, parse_offset_wallclock
from .hashrand import hash_uniform
from .calendar import calendar_columns

__all__ = [
    "finite_or_null", "safe_divide", "sanitize_numeric", "to_numeric_or_null",
    "assign_night", "interval_minutes", "parse_offset_instant", "parse_offset_wallclock",
    "hash_uniform", "calendar_columns",
]
