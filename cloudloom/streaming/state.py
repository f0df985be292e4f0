"""Stateful operators: voxel change between snapshots, incremental inserts and per-pixel background models as streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import geometry as G


def new_voxels(points: DataFrame, origin: Sequence[float], size: float, time: str, delay: str) -> DataFrame:
    """The first point of each voxel, as a stream of changes: one key row is kept a voxel. points: a stream with x, y, z and event time."""
    keyed = points.filter(G.finite(*G.AXES)).select("*", *G.keys(origin, size))
    return keyed.withWatermark(time, delay).dropDuplicates(["kx", "ky", "kz"])


def _occupancy(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    before = state.get[0] if state.exists else 0
    added = sum(len(b) for b in batches)
    state.update((before + added,))
    yield pd.DataFrame({"kx": [key[0]], "ky": [key[1]], "kz": [key[2]], "n": [before + added], "is_new": [before == 0]})


def voxel_counts(points: DataFrame, origin: Sequence[float], size: float) -> DataFrame:
    """kx, ky, kz, n (points so far), is_new: an update of every touched voxel in each batch; the state is one count a voxel."""
    keyed = points.filter(G.finite(*G.AXES)).select(*G.keys(origin, size))
    return keyed.groupBy("kx", "ky", "kz").applyInPandasWithState(_occupancy, "kx long, ky long, kz long, n long, is_new boolean", "n long", "update", GroupStateTimeout.NoTimeout)


def background(frames: DataFrame, rate: float | None, history: int = 64, threshold: float = 6.0) -> DataFrame:
    """row, col, mean, var, fg: each pixel's running Gaussian; rate None weighs all frames equally up to `history`, 0 freezes the model. frames: seq, row, col, value."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, var = state.get if state.exists else (0, 0.0, 0.0)
        out = []
        for v in pd.concat(list(batches)).sort_values("seq")["value"].tolist():
            d = v - mean
            out.append((key[0], key[1], v, mean, var, bool(n and d * d > threshold * max(var, 1.0))))
            a = (1 / min(n + 1, history)) if rate is None else (1.0 if n == 0 else rate)
            mean += a * d
            var = (1 - a) * (var + a * d * d)
            n += 1
        state.update((n, mean, var))
        yield pd.DataFrame(out, columns=["row", "col", "value", "mean", "var", "fg"])

    return frames.groupBy("row", "col").applyInPandasWithState(step, "row long, col long, value double, mean double, var double, fg boolean", "n long, mean double, var double", "append", GroupStateTimeout.NoTimeout)


def switch_buffers(current: DataFrame, previous: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next generation: the current keys become the previous ones, and the current buffer is empty."""
    return current.limit(0), current
