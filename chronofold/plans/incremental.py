"""A timeline that follows changes of its events.

A store holds the events, the extents of their islands and the swept timeline,
each in buckets by history. A change can only touch islands that one of its
events, as it was or as it will be, reaches to within a minute, and those beside
them, with which gaps may merge over any distance. The events of these islands
are swept again and their rows replaced; all others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.operators import timeline
from chronofold.plans.store import Store, Version, bucket_of
from chronofold.session import cut

H = "history_id"
#: Stands for the end of what is open: a second some ten thousand years ahead.
OPEN_S = 4e11
BUCKETS = 64


def extents(events: DataFrame) -> DataFrame:
    """(history_id, lo, hi) of the islands of events."""
    return timeline.islands(_usable(events)).groupBy(H, "island").agg(F.min("start_ts").alias("lo"), F.max(F.coalesce("end_ts", F.lit(OPEN_S))).alias("hi")).drop("island")


def _usable(events: DataFrame) -> DataFrame:
    return events.where("start_ts is not null and (end_ts is null or end_ts > start_ts)")


def _told(rows: DataFrame, islands: DataFrame) -> DataFrame:
    """The rows with ``_in``: whether they begin within one of some islands. Both pass one another once, in order of time."""
    w = W.partitionBy(H).orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    held = islands.select(H, F.col("lo").alias("_at"), F.lit(0).alias("_kind"), "hi")
    named = rows.select(H, F.col("start_ts").alias("_at"), F.lit(1).alias("_kind"), F.struct(*rows.columns).alias("_row"))
    met = held.unionByName(named, True).withColumn("_in", F.coalesce(F.col("_at") <= F.max("hi").over(w), F.lit(False)))
    return met.where("_kind = 1").select("_row.*", "_in")


def affected(islands: DataFrame, marks: DataFrame) -> DataFrame:
    """(history_id, lo, hi) of the islands that marks (history_id, start_ts, end_ts) can touch, and of their neighbours."""
    # A mark touches an island if, of those that begin before a minute past its end, the last end lies after a minute before it.
    near = timeline.NEAR_S
    a = islands.select(H, (F.col("hi") + near).alias("_at"), F.lit(0).alias("_kind"), "lo", "hi")
    b = marks.select(H, F.col("start_ts").alias("_at"), F.lit(1).alias("_kind"), F.coalesce("end_ts", F.lit(OPEN_S)).alias("_end"))
    so_far = W.partitionBy(H).orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    hit = F.coalesce(F.max("_end").over(so_far) > F.col("lo") - near, F.lit(False))
    # What lies between two islands touches neither, and yet what merges with it are the islands beside it.
    flagged = a.unionByName(b, True).withColumn("_hit", hit | (F.col("_kind") == 1)).withColumn("lo", F.coalesce("lo", "_at"))
    w = W.partitionBy(H).orderBy("lo")
    beside = flagged.withColumn("_near", F.col("_hit") | F.coalesce(F.lag("_hit").over(w), F.lit(False)) | F.coalesce(F.lead("_hit").over(w), F.lit(False)))
    return beside.where("_near and hi is not null").select(H, "lo", "hi").distinct()


class Timeline:
    """The timeline of the events in a store."""

    def __init__(self, store: Store, buckets: int = BUCKETS) -> None:
        self.store, self.buckets = store, buckets

    def start(self, events: DataFrame) -> None:
        """Sweep all events anew."""
        events = cut(events)
        with Version(self.store) as version:
            for name, rows in (("events", events), ("islands", extents(events)), ("timeline", timeline.sweep(events))):
                version.put_buckets(name, rows, [H], self.buckets, range(self.buckets))

    def read(self, name: str = "timeline", version: int | None = None) -> DataFrame | None:
        return self.store.read(name, version)

    def apply(self, changes: DataFrame) -> int:
        """Take events with ``_change`` insert, update or delete, one for each history_id and id; returns the number of islands that were swept again.

        Deletions of events that aren't there change nothing, insertions of
        those that are replace them.
        """
        base = self.store.manifest()
        changes = cut(changes)
        touched = [r[0] for r in changes.select(bucket_of([H], self.buckets)).distinct().collect()]
        if not touched:
            return 0
        events, islands, rows = (self.store.read(name, manifest=base, buckets=touched) for name in ("events", "islands", "timeline"))
        ids = changes.select(H, "id").distinct()
        later = changes.where("_change <> 'delete'").select(*events.columns)
        before = events.join(ids, [H, "id"], "left_semi")
        marks = _usable(before).select(H, "start_ts", "end_ts").unionByName(_usable(later).select(H, "start_ts", "end_ts"))
        old = cut(affected(islands, marks))
        n = old.count()
        swept_events = cut(_told(_usable(events.join(ids, [H, "id"], "left_anti")), old).where("_in").drop("_in").unionByName(_usable(later).select(*events.columns)))
        gone = lambda df: df.join(old.select(H, "lo"), [H, "lo"], "left_anti")
        outside = _told(rows, old).where("not _in")
        with Version(self.store, base=base) as version:
            version.put_buckets("events", events.join(ids, [H, "id"], "left_anti").select(*events.columns).unionByName(later), [H], self.buckets, touched)
            version.put_buckets("islands", gone(islands).unionByName(extents(swept_events).select(*islands.columns)), [H], self.buckets, touched)
            version.put_buckets("timeline", outside.select(*rows.columns).unionByName(timeline.sweep(swept_events).select(*rows.columns)), [H], self.buckets, touched)
            version.about["islands swept"] = n
        return n
