"""The millisecond time axis, over raw columns so that predicates reach the scan."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = datetime(1970, 1, 1)


def millis(raw: Column, stored: str) -> Column:
    """Epoch milliseconds of a raw time column: "ms" as it is, "ntz" floored from its microseconds (in UTC)."""
    return raw if stored == "ms" else F.unix_millis(raw.cast("timestamp"))


def moment(ms: int, stored: str) -> Column:
    """A literal of the raw column's type: comparing raw with raw is what Parquet statistics understand.

    Flooring is monotone, so for whole milliseconds comparing the raw column is the same as comparing its floor.
    """
    return F.lit(ms).cast("long") if stored == "ms" else F.lit(_EPOCH + timedelta(milliseconds=ms)).cast("timestamp_ntz")


def bucket_start(ms: Column, lo: int, interval: int) -> Column:
    """Label of the bucket that a time in the range falls in; buckets begin at ``lo``."""
    start, since = F.lit(lo).cast("long"), ms - F.lit(lo).cast("long")
    return start + since - since % F.lit(interval).cast("long")
