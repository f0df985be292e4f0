"""Accumulators by field: what a voxel or cluster keeps of each field of its points."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Field name -> aggregate. Others are averaged.
BY_FIELD: dict[str, Callable[[str], Column]] = {"label": F.mode, "r": lambda c: F.floor(F.avg(c)), "g": lambda c: F.floor(F.avg(c)), "b": lambda c: F.floor(F.avg(c))}


def accumulate(df: DataFrame, by: Sequence[str], own: Mapping[str, Callable[[str], Column]] | None = None) -> DataFrame:
    """One row a group with every other field accumulated by its rule; `own` adds or replaces rules."""
    rules = BY_FIELD | dict(own or {})
    return df.groupBy(*by).agg(*(rules.get(c, F.avg)(c).alias(c) for c in df.columns if c not in by))
