"""Evidence: revisions, deletions, twins and merges.

Where several records claim a value, a rank decides: the struct of rank and
tie-breaks that is largest. A field that is null in the winner is filled by the
next in rank that has it, whatever order the records came in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.session import checkpoints


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the largest ``order``; nulls are smallest."""
    rest = [x for x in df.columns if x not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_b.{x}").alias(x) for x in rest))


def first_non_null(column: str, rank: Column) -> Column:
    """An aggregate: the value of highest rank that isn't null."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), rank))


def merged(df: DataFrame, keys: list[str], groups: dict[str, list[str]], rank: dict[str, list[str]]) -> DataFrame:
    """One row for each key; each column of a group is filled in the order of that group's rank."""
    out = [first_non_null(x, F.struct(*rank[name])).alias(x) for name, columns in groups.items() for x in columns]
    return df.groupBy(*keys).agg(*out)


def without_deleted(df: DataFrame, tombstones: DataFrame, keys: list[str], revision: str = "revision") -> DataFrame:
    """Rows that no tombstone of their key deletes; a tombstone without a revision deletes all, a row without one has 0.

    Tombstones of a key count by their latest. A row stays if its revision is
    later than that.
    """
    last = tombstones.groupBy(*keys).agg(F.max(F.coalesce(F.col(revision).cast("double"), F.lit(float("inf")))).alias("_deleted"))
    kept = df.join(last, keys, "left")
    return kept.where(F.col("_deleted").isNull() | (F.coalesce(F.col(revision).cast("double"), F.lit(0.0)) > F.col("_deleted"))).drop("_deleted")


def absorb_twins(df: DataFrame, identity: str, place: list[str], take: list[str], rank: dict[str, list[str]]) -> DataFrame:
    """Identified rows take what their anonymous twins know better; anonymous rows with a twin go.

    Twins are equal in all ``place`` columns, nulls included. For each column
    of ``take`` the twin of highest rank (``rank[column]``) with a value counts,
    and wins if the row has none.
    """
    typed = df
    anonymous = typed.where(F.col(identity).isNull())
    named = typed.where(F.col(identity).isNotNull())
    offers = anonymous.groupBy(*(F.col(x).alias(f"_p_{x}") for x in place)).agg(*(first_non_null(x, F.struct(*rank[x])).alias(f"_t_{x}") for x in take))
    same = [named[x].eqNullSafe(offers[f"_p_{x}"]) for x in place]
    joined = named.join(offers, same, "left").select(*(F.coalesce(named[x], offers[f"_t_{x}"]).alias(x) if x in take else named[x] for x in df.columns))
    spots = named.select(*(F.col(x).alias(f"_p_{x}") for x in place)).distinct()
    alone = anonymous.join(spots, [anonymous[x].eqNullSafe(spots[f"_p_{x}"]) for x in place], "left_anti")
    return joined.unionByName(alone)


def collapsed(df: DataFrame, keys: list[str], groups: dict[str, list[str]], rank: dict[str, list[str]], identity: str) -> DataFrame:
    """Rows with equal, non-null keys become one; rows with a null key pass."""
    there = F.lit(True)
    for x in keys:
        there = there & F.col(x).isNotNull()
    one = merged(df.where(there), keys, groups | {"_identity": [identity]}, rank | {"_identity": [identity]})
    rest = df.where(~there).select(*one.columns)
    return one.unionByName(rest)


def distinct_by(df: DataFrame, keys: list[str], keep_min: str) -> DataFrame:
    """Rows that agree in the keys count once, with the smallest ``keep_min``."""
    return df.groupBy(*keys).agg(F.min(keep_min).alias(keep_min))


def unlinked(observations: DataFrame, known: DataFrame, link: str, prefix: str, keys: list[str] | None = None) -> DataFrame:
    """Observations without a link, or whose link neither begins with the prefix nor is among the known ones (keys, link)."""
    loose = observations.join(known.select(*(keys or []), link).distinct(), [*(keys or []), link], "left_anti")
    return loose.where(F.col(link).isNull() | ~F.col(link).startswith(prefix))


#: The fields of a sample and its location, with the columns of observations that they come from.
_SAMPLE = {"sampleId": "sample_id", "timelineItemId": "link", "secondsFromGMT": "tz_offset_s", "movingState": "moving_state"}
_LOCATION = {"altitude": "altitude_m", "horizontalAccuracy": "h_acc", "verticalAccuracy": "v_acc_m", "speed": "speed_mps", "speedAccuracy": "speed_acc_mps", "course": "course_deg", "courseAccuracy": "course_acc_deg"}
CONFIRMED_RANK, MOTION_RANK = 3, 2


def sample_of(names: dict[str, str], columns: list[str]) -> Column:
    """The sample that an observation (ts, lat, lon, activity, rank, ...) stands for, as a struct.

    An activity of rank 3 or more was confirmed, one of rank 2 is that of core
    motion; of a lower rank the sample has its moving state alone. It has a
    location where there is a latitude and a longitude. ``names`` maps columns
    of the defaults to those of the rows; what is not among ``columns`` is null.
    """
    date = F.date_format(F.timestamp_millis(F.floor(F.col("ts") * 1000)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

    def own(column: str) -> Column:
        name = names.get(column, column)
        return F.col(name) if name in columns else F.lit(None).cast("string" if column in ("sample_id", "link", "moving_state") else "double")

    place = F.struct(date.alias("timestamp"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), *(own(c).alias(field) for field, c in _LOCATION.items()))
    activity = F.nullif("activity", F.lit(""))
    return F.struct(
        date.alias("date"), F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), place).alias("location"), *(own(c).alias(field) for field, c in _SAMPLE.items()),
        F.when(F.col("rank") >= CONFIRMED_RANK, activity).alias("confirmedType"), F.when((F.col("rank") >= MOTION_RANK) & (F.col("rank") < CONFIRMED_RANK), activity).alias("coreMotionActivityType"),
    )


def components(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, node, component) of (keys, a, b) edges, a and b of any orderable type: the smallest node of the same keys that is reachable.

    Labels spread along edges and jump to the label of their label, so the
    rounds grow with the logarithm of a component's width; they end when
    nothing changes. Each round is written to the checkpoint folder.
    """
    keys = keys or []
    checkpoints(edges.sparkSession)
    both = edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(*keys, F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    changed = True
    while changed:
        labels = labels.checkpoint()
        near = both.join(labels.select(*keys, F.col("node").alias("b"), F.col("component").alias("m")), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("m").alias("m"))
        step = labels.join(near, [*keys, "node"]).select(*keys, "node", "component", F.least("component", "m").alias("to"))
        jump = labels.select(*keys, F.col("node").alias("to"), F.col("component").alias("far"))
        after = step.join(jump, [*keys, "to"]).select(*keys, "node", "component", F.least("to", "far").alias("new")).checkpoint()
        changed = after.where("new <> component").limit(1).count() > 0
        labels = after.select(*keys, "node", F.col("new").alias("component"))
    return labels
