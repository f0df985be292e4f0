"""Executors get the package with the first query, so that a driver can run from anywhere."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's source as a zip file to the application, once."""
    sc = spark.sparkContext
    if sc.applicationId in _done:
        return
    _done.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="cloudloom-"), "cloudloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)


def shipped(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, *args, **kwargs) -> DataFrame:
        ship(spark)
        return f(spark, *args, **kwargs)

    return run
