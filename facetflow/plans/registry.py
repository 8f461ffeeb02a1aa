"""All queries of the library by name, with their SQL where it expresses them."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir)."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


from . import camera_queries, channel_queries, frame_queries, fusion_queries, image_queries, landmark_queries, live_queries, mesh_queries, metadata_queries, part_queries, projection_queries, raster_queries, record_queries, resume_queries, streaming_queries, surface_queries, tensor_queries, texture_queries, uv_queries  # noqa: E402, F401
