"""Frames of recorded streams: what a stream has so far, and which tiles new frames make stale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.operators.intervals import DAY_S, overlap_join


def stream_totals(frames: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """For each stream of frames (keys, stream_id, id, ts_start, ts_end, bbox_*): frame_count, ts_start of the first frame that has one, the latest ts_end, and the box of all."""
    first = F.min_by("ts_start", F.when(F.col("ts_start").isNotNull(), F.col("id")))
    boxes = [F.min(f"bbox_min_{c}").alias(f"bbox_min_{c}") for c in ("lat", "lon")] + [F.max(f"bbox_max_{c}").alias(f"bbox_max_{c}") for c in ("lat", "lon")]
    return frames.groupBy(*(keys or []), "stream_id").agg(F.count("*").alias("frame_count"), first.alias("ts_start"), F.max("ts_end").alias("ts_end"), *boxes)


def stale_tiles(frames: DataFrame, tilesets: DataFrame, keys: list[str] | None = None, size: int = DAY_S) -> DataFrame:
    """(keys, frame_id, tileset_id): each frame with every tileset whose period it overlaps; that they touch isn't enough."""
    keys = keys or []
    a = frames.where("ts_start is not null and ts_end is not null").select(*keys, F.col("id").alias("frame_id"), F.col("ts_start").alias("a_start"), F.col("ts_end").alias("a_end"))
    b = tilesets.where("period_start is not null and period_end is not null").select(*keys, F.col("id").alias("tileset_id"), F.col("period_start").alias("b_start"), F.col("period_end").alias("b_end"))
    return overlap_join(a, b, keys, size).select(*keys, "frame_id", "tileset_id")
