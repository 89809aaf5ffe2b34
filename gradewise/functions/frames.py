"""Helpers for several frames at once."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_concat(frames: Iterable[DataFrame | None], place: str = "frame_") -> DataFrame | None:
    """The rows of all frames, columns matched by name (null where a frame lacks one), and in ``place`` which frame a row
    is of: rows have no order of their own, so sort by it where order matters. None without frames."""
    numbered = [f.withColumn(place, F.lit(i)) for i, f in enumerate(f for f in frames if f is not None)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered) if numbered else None
