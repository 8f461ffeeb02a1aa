"""Named landmarks of meshes in space (mesh, name, x, y, z) and on their textures (mesh, name, u, v): replaced, asked for, moved to other frames.

Defined results: null meshes and names are no landmarks and are left out; of several rows of one landmark the one with the smallest place
counts; a frame that has no matrix gives null places; empty tables are empty sets; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec

KEY = ["mesh", "name"]
MATRIX = [f"m{i}{j}" for i in range(3) for j in range(4)]


def _one(rows: DataFrame, *place: str) -> DataFrame:
    """A row for each landmark."""
    least = rows.dropna(subset=KEY).groupBy(*KEY).agg(F.min(F.struct(*place)).alias("p"))
    return least.select(*KEY, *(F.col("p")[c].alias(c) for c in place))


def upsert(flat: DataFrame, solid: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(landmarks on textures, landmarks in space) after new ones in space: these replace what had their names in either table."""
    new = _one(new, "x", "y", "z")
    names = new.select(*KEY)
    flat = _one(flat, "u", "v").join(names, KEY, "left_anti")
    solid = _one(solid, "x", "y", "z").join(names, KEY, "left_anti")
    return flat, solid.unionByName(new)


def present(asked: DataFrame, flat: DataFrame, solid: DataFrame) -> DataFrame:
    """asked (mesh, name) with kind: 3d where it stands in space, else 2d where it is on a texture, else null."""
    mark = lambda df, kind: df.dropna(subset=KEY).select(*KEY).distinct().withColumn(kind, F.lit(kind))
    j = asked.select(*KEY).distinct().join(mark(solid, "3d"), KEY, "left").join(mark(flat, "2d"), KEY, "left")
    return j.select(*KEY, F.coalesce("`3d`", "`2d`").alias("kind"))


def in_frame(places: DataFrame, frames: DataFrame) -> DataFrame:
    """places (mesh, name, x, y, z, ...) in another frame: through the affine matrix of each mesh (frames: mesh, m00 .. m23)."""
    j = places.join(frames.select("mesh", *MATRIX), "mesh", "left")
    moved = vec.affine([*map(F.col, MATRIX), 0, 0, 0, 1], vec.vec())
    others = [c for c in places.columns if c not in ("mesh", "name", "x", "y", "z")]
    return j.select(*KEY, *(e.alias(c) for c, e in zip("xyz", moved)), *others)
