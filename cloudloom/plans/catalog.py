"""All queries of the engine and their SQL, by name. Importing the plan modules registers them."""

from . import files, images, index, neighbours, points, shapes  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "A11_voxel_average"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
