"""Stacking monthly exports whose columns drift between files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Union all by column name; a column missing in a frame is null there,
    types widen. No data passes through the driver."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
