"""The four queries, for one series, several or all."""

from .aggregate import aggregate
from .batch import aggregate_batch, downsample_batch, range_batch
from .downsample import downsample
from .latest import latest
from .timerange import time_range

__all__ = ["aggregate", "aggregate_batch", "downsample", "downsample_batch", "latest", "range_batch", "time_range"]
