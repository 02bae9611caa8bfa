"""Stateful streams: capped windows of observations, and revisions as changes.

State is kept by key and checkpointed with the stream, so that a query goes on
where it ended. Rows of a key may come in any order that the watermark allows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from chronofold.operators.windows import CAP_S, DEFAULT_EXTENSION_S, GAP_S
from chronofold.plans.store import Store, Version, bucket_of

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state(spark: SparkSession) -> None:
    """Use the state store that processors with several states need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class CappedWindows(StatefulProcessor):
    """Windows of one key: the open one as numbers, and the rows that the watermark hasn't passed.

    A row at or before the watermark has no row before it that is still to
    come, so rows are folded in order of time up to there. The open window is
    closed by a row behind the gap or the cap, or by a watermark that no such
    row can be before.
    """

    def __init__(self, keys: list[str], gap_s: int, cap_s: int) -> None:
        self.keys, self.gap_s, self.cap_s = keys, gap_s, cap_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "first long, last long, total long, steps long, n long")
        self.waiting = handle.getListState("waiting", "s long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        yield from self._folded(key, [int(r["_s"]) for r in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._folded(key, [], timerValues.getCurrentWatermarkInMs())

    def _folded(self, key, new: list[int], watermark_ms: int) -> Iterator[Row]:
        times = sorted([int(r[0]) for r in self.waiting.get()] + new)
        ready = sum(1 for t in times if t * 1000 <= watermark_ms)
        held = tuple(self.window.get()) if self.window.exists() else None
        for t in times[:ready]:
            if held and (t - held[1] > self.gap_s or t >= held[0] + self.cap_s):
                yield from self._closed(key, held)
                held = None
            if held is None:
                held = (t, t, 0, 0, 1)
            else:
                first, last, total, steps, n = held
                held = (first, t, total + t - last, steps + (t > last), n + 1)
        if held and watermark_ms >= self._until_ms(held):
            yield from self._closed(key, held)
            held = None
        if held:
            self.window.update(held)
        else:
            self.window.clear()
        rest = times[ready:]
        if rest:
            self.waiting.put([(t,) for t in rest])
        else:
            self.waiting.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for at in ([rest[0] * 1000] if rest else []) + ([self._until_ms(held)] if held else []):
            self.handle.registerTimer(at)

    def _until_ms(self, held: tuple) -> int:
        return 1000 * min(held[1] + self.gap_s, held[0] + self.cap_s)

    def _closed(self, key, held: tuple) -> Iterator[Row]:
        first, last, total, steps, n = held
        if n > 1:
            lasts = max(1.0, min(60.0, total / steps)) if steps else float(DEFAULT_EXTENSION_S)
            yield Row(**dict(zip(self.keys, key, strict=True)), start_ts=first, end_ts=last + lasts, n=n)

    def close(self) -> None:
        pass


def capped_windows(stream: DataFrame, keys: list[str], ts: str, late: str = "1 hour", gap_s: int = GAP_S, cap_s: int = CAP_S) -> DataFrame:
    """keys, start_ts, end_ts, n of the windows of a stream, each once it can't change; rows that are later than ``late`` are dropped.

    The same windows as :func:`chronofold.operators.windows.observation_windows`
    makes of the same rows.
    """
    keep_state(stream.sparkSession)
    timed = stream.withWatermark(ts, late).select(*keys, ts, F.unix_seconds(ts).alias("_s"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in timed.select(*keys).schema), "start_ts bigint, end_ts double, n bigint"])
    return timed.groupBy(*keys).transformWithState(CappedWindows(keys, gap_s, cap_s), schema, "Append", "EventTime")


class LatestRevisions(StatefulProcessor):
    """The latest revision of a key, deletions among them; what a batch changes goes out as one row."""

    def __init__(self, schema: str, columns: list[str], order: list[str], deleted: str | None) -> None:
        self.schema, self.columns, self.order, self.deleted = schema, columns, order, deleted

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", self.schema)

    def _rank(self, row: tuple) -> list:
        """Later is larger: a deletion without a revision beats all, of equal ones a deletion; a null is smallest."""
        value = dict(zip(self.columns, row, strict=True))
        gone = bool(self.deleted and value[self.deleted])
        own = [(value[c] is not None, value[c]) for c in self.order]
        nulls = [(x[0], x[1] if x[0] else 0) for x in own]
        return [gone and value[self.order[0]] is None, nulls[0], gone, *nulls[1:], repr(row)]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = tuple(self.row.get()) if self.row.exists() else None
        after = before
        for r in rows:
            row = tuple(r[c] for c in self.columns)
            if after is None or self._rank(row) > self._rank(after):
                after = row
        if after == before:
            return
        self.row.update(after)
        was, shows = (x is not None and not (self.deleted and x[self.columns.index(self.deleted)]) for x in (before, after))
        if was or shows:
            change = "update" if was and shows else "insert" if shows else "delete"
            yield Row(_change=change, **dict(zip(self.columns, after if shows else before, strict=True)))

    def close(self) -> None:
        pass


def revision_changes(stream: DataFrame, keys: list[str], order: list[str], deleted: str | None = None) -> DataFrame:
    """_change (insert, update, delete) and the columns of a stream of revisions: what each batch changes in the latest rows.

    ``order`` is what makes a row the later one, its revision first. Rows whose
    column ``deleted`` is true delete their key up to their revision. A deletion
    goes out with the row that it deletes.
    """
    keep_state(stream.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return stream.groupBy(*keys).transformWithState(LatestRevisions(schema, stream.columns, order, deleted), f"_change string, {schema}", "Update", "None")


def keep_current(stream: DataFrame, keys: list[str], order: list[str], folder: str, checkpoint: str, deleted: str | None = None, buckets: int = 64) -> StreamingQuery:
    """Keep the latest rows of a stream of revisions as table ``current`` of a store.

    A batch replaces the buckets that its changes are in; reading merges
    nothing. A batch that runs again changes nothing.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        apply_changes(Store(spark, folder), batch, keys, number, buckets)

    return revision_changes(stream, keys, order, deleted).writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_changes(store: Store, changes: DataFrame, keys: list[str], number: int, buckets: int = 64, name: str = "current") -> bool:
    """Put the changes of a batch into a table by buckets; False if the store has had that batch."""
    base = store.manifest()
    if base["about"].get(f"batch of {name}", -1) >= number:
        return False
    changes = changes.persist()
    try:
        touched = [r[0] for r in changes.select(bucket_of(keys, buckets)).distinct().collect()]
        with Version(store, base=base) as version:
            if touched:
                held = store.read(name, manifest=base, buckets=touched)
                later = changes.where("_change <> 'delete'").drop("_change")
                rows = later if held is None else held.join(changes.select(*keys), keys, "left_anti").select(*later.columns).unionByName(later)
                version.put_buckets(name, rows, keys, buckets, touched)
            version.about[f"batch of {name}"] = number
    finally:
        changes.unpersist()
    return True
