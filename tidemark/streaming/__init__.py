"""Streams of series: ingestion into a table, and tumbling downsamples."""

from .ingest import ingest
from .windows import downsample_stream

__all__ = ["downsample_stream", "ingest"]
