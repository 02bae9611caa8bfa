"""Step claims of the two dialects, which may be on the same time.

A claim has history_id, claim_id (unique in its history), source, kind (stay
or move), day_key, start (may be null), end, steps, distance, floors_up,
floors_down, tz_offset_s, manual, sequence and mode; times are whole seconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.operators.evidence import components
from chronofold.operators.intervals import CLAIM_SLACK_S, claim_matches
from chronofold.operators.timeline import CUTOFF_TS

# Fixed values.
ITEMS, DAYS = "arc", "moves"
MIN_M_PER_STEP, MAX_M_PER_STEP = 0.3, 2.5

SCHEMA = (
    "history_id string, claim_id bigint, source string, kind string, day_key bigint, start bigint, end bigint, steps bigint, distance double, "
    "floors_up double, floors_down double, tz_offset_s int, manual boolean, sequence bigint, mode string"
)
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def plausible_distance(steps: Column, distance: Column, mode: Column) -> Column:
    """The distance of a walk or run whose steps have a likely length, else null."""
    return F.when((steps > 0) & mode.isin("walk", "run") & (distance / F.when(steps > 0, steps)).between(MIN_M_PER_STEP, MAX_M_PER_STEP), distance)


class Cluster:
    """Claims in a row that may be one claim, told several times."""

    def __init__(self, claim: dict) -> None:
        self.claims, self.end, self.overlaps = [claim], claim["end"], False
        self.floors = {k: claim[k] for k in ("floors_up", "floors_down")}

    def takes(self, claim: dict) -> bool:
        """The same steps and no other floors, within the slack; beyond the cluster's end only what follows in sequence."""
        last, start = self.claims[-1], _start(claim)
        alike = claim["steps"] == last["steps"] and all(v is None or claim[k] is None or claim[k] == v for k, v in self.floors.items())
        next_in_line = None not in (last["sequence"], claim["sequence"]) and claim["sequence"] == last["sequence"] + 1
        return alike and (start <= self.end or next_in_line and start <= self.end + CLAIM_SLACK_S)

    def add(self, claim: dict) -> None:
        self.overlaps |= _start(claim) < self.end
        self.claims.append(claim)
        self.end = max(self.end, claim["end"])
        self.floors = {k: claim[k] if v is None else v for k, v in self.floors.items()}

    def told(self) -> list[dict]:
        """One claim where stays and moves, or moves of several modes, are mixed, where claims overlap or have no duration; else all."""
        if len(self.claims) == 1:
            return self.claims
        moves = [c for c in self.claims if c["kind"] == "move"]
        mixed = 0 < len(moves) < len(self.claims) or len({c["mode"] for c in moves}) > 1
        if not (mixed or self.overlaps or any(c["end"] <= _start(c) for c in self.claims)):
            return self.claims
        best = max(self.claims, key=lambda c: (2 * (c["kind"] == "move") + (c["end"] > _start(c)), c["claim_id"]))
        return [best | self.floors]


def _start(claim: dict) -> int:
    return claim["end"] if claim["start"] is None else claim["start"]


def without_repeats(claims: DataFrame) -> DataFrame:
    """Item claims in order of sequence (without one: of time, after the others), each told once.

    Clusters are folded one after another over sorted rows, so that memory
    holds one cluster.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([(c, {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}[x.split()[1]]) for c, x in zip(COLUMNS, SCHEMA.split(", "), strict=True)])
        now, done = None, []
        for batch in batches:
            for claim in batch.to_pylist():
                if now and now.claims[0]["history_id"] == claim["history_id"] and now.takes(claim):
                    now.add(claim)
                else:
                    done += now.told() if now else []
                    now = Cluster(claim)
            if done:
                yield pa.RecordBatch.from_pylist(done, types)
                done = []
        if now:
            yield pa.RecordBatch.from_pylist(now.told(), types)

    order = ["history_id", F.col("sequence").asc_nulls_last(), F.coalesce("start", "end"), "end", "claim_id"]
    return claims.select(*COLUMNS).repartition("history_id").sortWithinPartitions(*order).mapInArrow(fold, SCHEMA)


def _sides(claims: DataFrame, keys: list[str]) -> list[DataFrame]:
    """Claims of items as a_*, claims of days as b_*."""
    return [claims.where(F.col("source") == source).select(*keys, *(F.col(c).alias(f"{x}_{c}") for c in COLUMNS if c not in keys)) for x, source in (("a", ITEMS), ("b", DAYS))]


def on_days(claims: DataFrame) -> DataFrame:
    """Item claims with the day, and if they have none the offset, of the day claim that they match with most overlap, of equals the smallest id."""
    a, b = _sides(claims, ["history_id"])
    met = claim_matches(a, b.where("b_day_key is not null"), ["history_id"])
    best = met.groupBy("history_id", F.col("a_claim_id").alias("claim_id")).agg(F.max_by(F.struct("b_day_key", "b_tz_offset_s"), F.struct("overlap_s", -F.col("b_claim_id"))).alias("_b"))
    items = claims.where(F.col("source") == ITEMS).join(best, ["history_id", "claim_id"], "left")
    placed = items.withColumn("day_key", F.coalesce("_b.b_day_key", "day_key")).withColumn("tz_offset_s", F.when(F.col("_b").isNotNull(), F.coalesce("tz_offset_s", "_b.b_tz_offset_s")).otherwise(F.col("tz_offset_s")))
    return placed.select(*COLUMNS).unionByName(claims.where(F.col("source") != ITEMS).select(*COLUMNS))


def chosen_side(claims: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """The claims of each day without those that the other source has better.

    Claims of the two sources that match make components. In a mixed one the
    claims of days stay if, before the cut-off, one of them has the steps of an
    item's claim; if the day's steps add up to its total (history_id, day_key,
    total); or if (manual claims, covered seconds, claims with steps, claims
    with distance) is not less than that of the items. Where they stay, the
    floors of the items' claims stay too, without steps and distance.
    """
    keys = ["history_id", "day_key"]
    a, b = _sides(claims, keys)
    met = claim_matches(a, b, keys)
    equal = met.where((F.col("b_end") < CUTOFF_TS) & (F.col("a_steps") == F.col("b_steps"))).select(*keys, F.col("a_claim_id").alias("node")).distinct().withColumn("equal", F.lit(True))
    group = components(met.select(*keys, F.col("a_claim_id").alias("a"), F.col("b_claim_id").alias("b")), keys)
    same = met.sparkSession.createDataFrame([], "history_id string, day_key bigint, total double") if totals is None else totals
    of_days = claims.where(F.col("source") == DAYS).groupBy(*keys).agg(F.sum(F.coalesce("steps", F.lit(0))).alias("_sum")).join(same, keys).where("_sum = total").select(*keys).withColumn("valid", F.lit(True))
    held = claims.join(group.withColumnRenamed("node", "claim_id"), [*keys, "claim_id"], "left").join(equal.withColumnRenamed("node", "claim_id"), [*keys, "claim_id"], "left")
    score = lambda of: F.struct(F.count_if(of & F.col("manual")), F.sum(F.when(of, F.greatest(F.col("end") - F.coalesce("start", "end"), F.lit(0))).otherwise(0)), F.count_if(of & F.col("steps").isNotNull()), F.count_if(of & F.col("distance").isNotNull()))
    mixed = held.where("component is not null").groupBy(*keys, "component").agg(F.max(F.coalesce("equal", F.lit(False))).alias("equal"), score(F.col("source") == DAYS).alias("days"), score(F.col("source") == ITEMS).alias("items"))
    decided = mixed.join(of_days, keys, "left").select(*keys, "component", (F.col("equal") | F.coalesce("valid", F.lit(False)) | (F.col("days") >= F.col("items"))).alias("_days"))
    out = held.join(decided, [*keys, "component"], "left")
    stays = F.coalesce(F.col("_days") == (F.col("source") == DAYS), F.lit(True))
    floors = (F.col("floors_up").isNotNull() | F.col("floors_down").isNotNull()) & (F.col("source") == ITEMS)
    kept = out.where(stays | floors)
    return kept.select(*(F.when(stays, F.col(c)).alias(c) if c in ("steps", "distance") else F.col(c) for c in COLUMNS))


def pedometer_rows(claims: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """raw_pedometer of the claims of both sources: history_id, ts, steps_delta, distance_m, floors_up, floors_down, tz_offset_s, each once."""
    items, others = claims.where(F.col("source") == ITEMS), claims.where(F.col("source") != ITEMS).select(*COLUMNS)
    chosen = chosen_side(on_days(without_repeats(items).unionByName(others)), totals)
    rows = chosen.where("steps is not null or floors_up is not null or floors_down is not null")
    return rows.select("history_id", F.col("end").alias("ts"), F.col("steps").alias("steps_delta"), F.col("distance").alias("distance_m"), "floors_up", "floors_down", "tz_offset_s").distinct()
