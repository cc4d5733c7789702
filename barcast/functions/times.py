"""Time expressions. All instants are UTC timestamps; arithmetic is on epoch units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barcast.config import STEP_SECONDS, ZONE

STEP_MICROS = STEP_SECONDS * 1_000_000


def as_instant(df: DataFrame, name: str) -> Column:
    """Column ``name`` as a UTC timestamp: text parsed leniently, absent column → null."""
    found = [f for f in df.schema.fields if f.name == name]
    if not found:
        return F.lit(None).cast("timestamp")
    if isinstance(found[0].dataType, T.StringType):
        return F.try_to_timestamp(F.trim(F.col(name)))
    return F.col(name).cast("timestamp")


def grid_floor(t: Column) -> Column:
    """Epoch second of the last grid point at or before ``t``."""
    micros = F.unix_micros(t)
    return ((micros - F.pmod(micros, F.lit(STEP_MICROS))) / 1_000_000).cast("long")


def grid_ceil(t: Column) -> Column:
    """Epoch second of the first grid point at or after ``t``."""
    micros = F.unix_micros(t)
    return ((micros + F.pmod(-micros, F.lit(STEP_MICROS))) / 1_000_000).cast("long")


def on_grid(t: Column) -> Column:
    return F.unix_micros(t) % STEP_MICROS == 0


def steps_after(t: Column, steps: Column | int) -> Column:
    """Instant ``steps`` grid steps later in elapsed time (never calendar time)."""
    count = F.lit(steps) if isinstance(steps, int) else steps
    return F.timestamp_seconds(F.unix_seconds(t) + count * STEP_SECONDS)


def seconds_before(t: Column, seconds: int) -> Column:
    return F.timestamp_seconds(F.unix_seconds(t) - seconds)


def local_hour(t: Column, zone: str = ZONE) -> Column:
    return F.hour(F.from_utc_timestamp(t, zone))


def local_weekday(t: Column, zone: str = ZONE) -> Column:
    """Monday = 0."""
    return F.weekday(F.from_utc_timestamp(t, zone))
