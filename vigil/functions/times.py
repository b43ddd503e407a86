"""Time conversions that never depend on the session time zone.

Log times are wall-clock ``TIMESTAMP_NTZ``.  Watermarks need ``TIMESTAMP``
(an instant); these map a wall-clock time to the instant with the same UTC
wall clock and back, by microsecond arithmetic, so results are the same in
every session zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_NTZ = "1970-01-01 00:00:00"


def _epoch() -> Column:
    return F.lit(EPOCH_NTZ).cast("timestamp_ntz")


def ntz_micros(ts) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock time."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", _epoch(), ts)


def ntz_to_instant(ts) -> Column:
    """Wall-clock time → the instant whose UTC wall clock it is."""
    return F.timestamp_micros(ntz_micros(ts))


def instant_to_ntz(t) -> Column:
    """Instant → its UTC wall-clock time."""
    t = F.col(t) if isinstance(t, str) else t
    return F.timestamp_add("MICROSECOND", F.unix_micros(t), _epoch())
