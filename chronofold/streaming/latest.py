"""Corrected data as a stream: the latest revision of each key, and its deletions.

A micro-batch writes its own winners alone; reading takes the winners of all
batches, so that a stream and a batch over the same files agree. ``compact``
brings the batches so far into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronofold.operators.evidence import latest


def _winners(rows: DataFrame, keys: list[str], order: list[str], deleted: str | None) -> DataFrame:
    """The row of each key that is latest; of equal ones a deletion, and a deletion without a revision is later than all."""
    if deleted is None:
        return latest(rows, keys, order).select(*rows.columns)
    gone = F.coalesce(F.col(deleted), F.lit(False))
    forever: Column = gone & F.col(order[0]).isNull()
    ranked = rows.withColumn("_forever", forever).withColumn("_gone", gone)
    return latest(ranked, keys, ["_forever", *order[:1], "_gone", *order[1:]]).select(*rows.columns)


def merge_revisions(stream: DataFrame, keys: list[str], order: list[str], folder: str, checkpoint: str, deleted: str | None = None) -> StreamingQuery:
    """Keep the winners of a stream's batches in numbered tables below ``folder``; ``current`` reads them.

    ``order`` is what makes a row the later one, its revision first. Rows whose
    column ``deleted`` is true delete their key up to their revision. A batch
    that runs again overwrites what it wrote.
    """

    def step(batch: DataFrame, number: int) -> None:
        _winners(batch, keys, order, deleted).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str, keys: list[str], order: list[str], deleted: str | None = None) -> DataFrame:
    """The latest row of each key that isn't deleted, of all batches."""
    rows = spark.read.parquet(folder).drop("batch")
    won = _winners(rows, keys, order, deleted)
    return won if deleted is None else won.where(~F.coalesce(F.col(deleted), F.lit(False)))


def compact(spark: SparkSession, folder: str, into: str, keys: list[str], order: list[str], deleted: str | None = None) -> None:
    """The winners of all batches, deletions among them, as batch 0 of another folder."""
    _winners(spark.read.parquet(folder).drop("batch"), keys, order, deleted).write.parquet(f"{into}/batch=0")


def session_windows(stream: DataFrame, key: str, ts: str, gap: str = "600 seconds", late: str = "1 hour") -> DataFrame:
    """Runs of observations by the gap rule, over a stream with a watermark; runs of one observation go.

    Where a run ends at a cap depends on where it opened: capped windows are
    cut out of a batch, by :func:`chronofold.operators.windows.observation_windows`.
    """
    timed = stream.withWatermark(ts, late)
    out = timed.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"))
    return out.where("n > 1").select(key, "start_ts", "end_ts", "n")
