"""Clouds from and to numpy arrays."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_array(spark: SparkSession, a: np.ndarray | list | int | DataFrame, names: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """A cloud of an (n, k) array, a list of rows, a number of zero points, or another cloud; anything else is a TypeError."""
    if isinstance(a, DataFrame):
        return a.select("idx", *names)
    if isinstance(a, (int, np.integer)) and not isinstance(a, bool):
        a = np.zeros((int(a), len(names)))
    elif isinstance(a, list):
        a = np.array(a, dtype=np.float64).reshape(-1, len(names))
    if not isinstance(a, np.ndarray) or a.ndim != 2 or a.shape[1] != len(names):
        raise TypeError(f"a cloud needs an (n, {len(names)}) array")
    p = pd.DataFrame(a.astype(np.float64), columns=list(names))
    p.insert(0, "idx", np.arange(len(p), dtype=np.int64))
    return spark.createDataFrame(p, ", ".join(["idx long", *(f"{n} double" for n in names)]))


def to_array(df: DataFrame, names: Sequence[str] = ("x", "y", "z")) -> np.ndarray:
    """(n, k) in order of idx; for clouds that fit the driver."""
    return df.orderBy("idx").select(*(F.col(n).cast("double") for n in names)).toPandas().to_numpy()
