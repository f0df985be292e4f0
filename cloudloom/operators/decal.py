"""The decal painter's settings and the spread of a boundary over the unit square."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


@dataclass
class Decal:
    """Inputs of a decal job; missing() names what is not there yet."""

    vertices: DataFrame | None = None
    faces: DataFrame | None = None
    texture: DataFrame | None = None
    decal: DataFrame | None = None
    corners: DataFrame | None = None
    size: tuple[int, int] = (512, 512)
    max_path: int = 10_000
    _needs: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"mesh": ("vertices", "faces"), "texture": ("texture",), "decal": ("decal",), "corners": ("corners",)})

    def missing(self) -> set[str]:
        return {k for k, names in self._needs.items() if any(getattr(self, n) is None for n in names)}

    def check(self) -> None:
        if self.missing():
            raise ValueError(f"missing inputs: {', '.join(sorted(self.missing()))}")
        if min(self.size) <= 0:
            raise ValueError("the mapping size must be positive")


def square_uv(path: DataFrame) -> DataFrame:
    """path (pos, side 0..3, x, y, z), a closed boundary whose sides begin at the corners, with u, v on the square [-1, 1]^2 by arc length within each side."""
    w = Window.orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = [F.coalesce(F.lead(a).over(w), F.first(a).over(whole)) for a in G.AXES]
    p = path.withColumn("step", F.sqrt(G.sq_dist(G.points(), nxt)))
    s = Window.partitionBy("side")
    before = F.coalesce(F.sum("step").over(s.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    p = p.withColumn("t", before / F.sum("step").over(s)).withColumn("a", F.col("t") * 2 - 1)
    side = F.col("side")
    u = F.when(side == 0, F.col("a")).when(side == 1, 1.0).when(side == 2, -F.col("a")).otherwise(-1.0)
    v = F.when(side == 0, -1.0).when(side == 1, F.col("a")).when(side == 2, 1.0).otherwise(-F.col("a"))
    return p.withColumns({"u": u, "v": v}).drop("step", "t", "a")
