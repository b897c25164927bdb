"""Materialised tables that stand in for scans: rollups and the newest rows."""

from .rollup import aggregate_with_rollup, build_rollup, downsample_with_rollup, fits_blocks
from .snapshot import merge_latest

__all__ = ["aggregate_with_rollup", "build_rollup", "downsample_with_rollup", "fits_blocks", "merge_latest"]
