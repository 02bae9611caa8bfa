"""Frames that come as a stream: totals of their streams and stale tiles, kept up to date.

Totals are states that merge in any order, so that late frames count like
others. Totals, invalidations and the number of the batch are published as one
version: a batch that runs again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronofold.operators.frames import stale_tiles
from chronofold.plans.store import Store, Version, bucket_of

BATCH = "batch of frames"
_BOX = [f"bbox_{m}_{c}" for m in ("min", "max") for c in ("lat", "lon")]


def states(frames: DataFrame, keys: list[str]) -> DataFrame:
    """What frames add to the totals of their streams: states that :func:`merged` brings together."""
    seen = F.struct(F.col("id").alias("id"), F.col("ts_start").alias("ts"))
    ends = [getattr(F, b[5:8])(b).alias(b) for b in _BOX]
    return frames.groupBy(*keys, "stream_id").agg(F.count("*").alias("frame_count"), F.min(F.when(F.col("ts_start").isNotNull(), seen)).alias("first"), F.max("ts_end").alias("ts_end"), *ends)


def merged(both: DataFrame, keys: list[str]) -> DataFrame:
    ends = [getattr(F, b[5:8])(b).alias(b) for b in _BOX]
    return both.groupBy(*keys, "stream_id").agg(F.sum("frame_count").alias("frame_count"), F.min("first").alias("first"), F.max("ts_end").alias("ts_end"), *ends)


def fold_frames(store: Store, frames: DataFrame, number: int, tilesets: DataFrame | None = None, keys: list[str] | None = None, buckets: int = 64) -> bool:
    """Count a batch of frames into the totals and note the tiles that it makes stale; False if the store has had that batch."""
    keys = keys or []
    base = store.manifest()
    if base["about"].get(BATCH, -1) >= number:
        return False
    by = [*keys, "stream_id"]
    frames = frames.persist()
    try:
        touched = [r[0] for r in frames.select(bucket_of(by, buckets)).distinct().collect()]
        with Version(store, base=base) as version:
            if touched:
                new, held = states(frames, keys), store.read("totals", manifest=base, buckets=touched)
                version.put_buckets("totals", new if held is None else merged(held.select(*new.columns).unionByName(new), keys), by, buckets, touched)
                if tilesets is not None:
                    version.put("invalidations", stale_tiles(frames, tilesets, keys).withColumn("batch", F.lit(number)), append=True)
            version.about[BATCH] = number
    finally:
        frames.unpersist()
    return True


def totals(store: Store, version: int | None = None) -> DataFrame | None:
    """As :func:`chronofold.operators.frames.stream_totals` of all frames so far."""
    held = store.read("totals", version)
    return held if held is None else held.select(*(c for c in held.columns if c not in ("first", "ts_end", "frame_count", *_BOX)), "frame_count", F.col("first.ts").alias("ts_start"), "ts_end", *_BOX)


def keep_totals(spark: SparkSession, stream: DataFrame, folder: str, checkpoint: str, tilesets: DataFrame | None = None, keys: list[str] | None = None) -> StreamingQuery:
    """Totals and invalidations of a stream of frames, in a store."""
    step = lambda batch, number: fold_frames(Store(spark, folder), batch, number, tilesets, keys)
    return stream.writeStream.foreachBatch(lambda batch, number: step(batch, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
