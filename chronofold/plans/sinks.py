"""Writing what an import yields, and holding it against itself."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators import spatial, timeline
from chronofold.plans.store import Store, Version

H = "history_id"
#: Tables that may be empty without the import being so.
ABOUT = ("files", "report", "events")
MIGRATIONS = "migrations"
#: Where rows of a table lie, for the layout of its files.
PLACED = {"route_paths": ("(bbox_min_lat + bbox_max_lat) / 2", "(bbox_min_lon + bbox_max_lon) / 2"), "pois": ("lat", "lon"), "stays": ("centroid_lat", "centroid_lon")}

# What each row of a table must be, and which rows another table must have.
CHECKS = {
    "stays": ["start_ts >= 0", "end_ts > start_ts", "centroid_lat between -90 and 90", "centroid_lon between -180 and 180", "radius_m >= 0"],
    "moves": ["start_ts >= 0", "end_ts > start_ts", "coalesce(distance_m, 0) >= 0"],
    "no_data_gaps": ["start_ts >= 0", "end_ts > start_ts"],
    "pois": ["length(name) > 0", "lat between -90 and 90", "lon between -180 and 180", "coalesce(radius_m, 0) >= 0", "visitCount >= 0"],
    "raw_gps": ["ts >= 0", "lat between -90 and 90", "lon between -180 and 180", "coalesce(h_acc_m, 0) >= 0", "coalesce(tz_offset_s, 0) between -50400 and 50400"],
    "samples": ["ts >= 0", "lat between -90 and 90", "lon between -180 and 180"],
    "raw_pedometer": ["ts >= 0", "coalesce(steps_delta, 0) >= 0", "coalesce(distance_m, 0) >= 0"],
    "route_paths": ["sample_count >= 2", "bbox_min_lat <= bbox_max_lat", "bbox_min_lon <= bbox_max_lon"],
}
UNIQUE = {"pois": [H, "poi_id"], "stays": [H, "id", "part"], "moves": [H, "id", "part"], "stay_pois": [H, "id", "part", "poi_id"], "events": [H, "start_ts"]}
REFERENCES = [("stays", ["poi_id"], "pois", ["poi_id"]), ("stay_pois", ["poi_id"], "pois", ["poi_id"]), ("stay_pois", ["id", "part"], "stays", ["id", "part"]), ("route_paths", ["move_id", "part"], "moves", ["id", "part"])]


class Unsound(ValueError):
    """Tables that break what they must hold."""


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(what, n): constraints that rows break, with the number of these rows; none for sound tables."""
    found = []
    for name, conditions in CHECKS.items():
        if name in tables:
            broken = [F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(f"c{k}") for k, c in enumerate(conditions)]
            each = F.explode(F.array(*(F.struct(F.lit(f"{name}: {c}").alias("what"), F.col(f"c{k}").alias("n")) for k, c in enumerate(conditions)))).alias("x")
            found.append(tables[name].agg(*broken).select(each).select("x.*"))
    for name, key in UNIQUE.items():
        if name in tables:
            found.append(tables[name].groupBy(*key).agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("n")).select(F.lit(f"{name}: {', '.join(key)} unique").alias("what"), "n"))
    for name, columns, other, keys in REFERENCES:
        if name in tables and other in tables:
            known = tables[other].select(H, *(F.col(k).alias(c) for k, c in zip(keys, columns, strict=True))).distinct()
            there = tables[name].where(" and ".join(f"{c} is not null" for c in columns))
            found.append(there.join(known, [H, *columns], "left_anti").agg(F.count("*").alias("n")).select(F.lit(f"{name}: {', '.join(columns)} in {other}").alias("what"), "n"))
    if "events" in tables:
        found.append(timeline.integrity(tables["events"], [H]).where(~timeline.is_sound()).agg(F.count("*").alias("n")).select(F.lit("events: a sound timeline").alias("what"), "n"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.where("n > 0")


def refuse_unsound(tables: dict[str, DataFrame]) -> None:
    broken = violations(tables).collect()
    if broken:
        raise Unsound("; ".join(sorted(f"{r.what} ({r.n})" for r in broken)))


def counts(tables: dict[str, DataFrame]) -> dict[str, int]:
    """How many rows each table has, in one job."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return {r.name: r.n for r in every.collect()}


def laid_out(name: str, df: DataFrame) -> DataFrame:
    """Rows of a history together, and of those that lie somewhere the near ones, so that files and row groups of others are skipped."""
    if H not in df.columns:
        return df
    if name not in PLACED:
        return df.repartitionByRange(H).sortWithinPartitions(H)
    lat, lon = map(F.expr, PLACED[name])
    keyed = df.withColumn("_curve", spatial.curve_key(lat, lon))
    return keyed.repartitionByRange(H, "_curve").sortWithinPartitions(H, "_curve").drop("_curve")


def write_tables(tables: dict[str, DataFrame], folder: str, *, mode: str = "errorifexists", on_table: Callable[[str], None] | None = None) -> dict[str, int]:
    """Write the tables as one version below ``folder`` and return their rows.

    All tables are staged, then held against their constraints, then published
    by one manifest; whatever fails before leaves the folder as it was.
    ``mode`` is errorifexists, overwrite (earlier versions stay readable) or
    append. An import that has no row but in the tables about it, and a
    timeline that isn't sound, are errors. ``on_table`` hears of each table
    that is staged.
    """
    spark = next(iter(tables.values())).sparkSession
    store = Store(spark, folder)
    base = store.manifest()
    if mode == "errorifexists" and base["version"]:
        raise FileExistsError(f"{folder} has version {base['version']}")
    append = mode == "append"
    started = base if append else base | {"tables": {k: v for k, v in base["tables"].items() if k == MIGRATIONS}}
    with Version(store, base=started, check=lambda read: refuse_unsound({name: read(name) for name in tables})) as version:
        for name in sorted(tables, key=lambda name: name == "events"):
            version.put(name, laid_out(name, tables[name]), append=append)
            if on_table:
                on_table(name)
        n = counts({name: version.read(name) for name in tables})
        if not any(v for k, v in n.items() if k not in ABOUT):
            raise ValueError("nothing was imported")
        row = spark.createDataFrame([("import", time.time(), sum(n.values()))], "name string, applied_ts double, n_rows long")
        version.put(MIGRATIONS, row.coalesce(1), append=True)
        version.about["rows"] = n
    return n


def read_tables(spark: SparkSession, folder: str, names: Iterable[str] | None = None, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, by default of the latest."""
    store = Store(spark, folder)
    manifest = store.manifest(version)
    return {name: store.read(name, manifest=manifest) for name in (manifest["tables"] if names is None else names)}


def verified(tables: dict[str, DataFrame], written: dict[str, DataFrame]) -> DataFrame:
    """The integrity counters by history of the written events, with an error where they differ from the computed ones, where an invariant is broken, or where the events aren't as many as the rows that they stand for."""
    mine, theirs = (timeline.integrity(x["events"], [H]) for x in (tables, written))
    columns = [c for c in mine.columns if c != H]
    rows = written["stays"].select(H).unionByName(written["moves"].select(H)).unionByName(written["no_data_gaps"].select(H)).groupBy(H).agg(F.count("*").alias("_rows"))
    both = mine.select(H, F.struct(*columns).alias("_a")).join(theirs.select(H, F.struct(*columns).alias("_b")), H, "full").join(rows, H, "full")
    same = F.col("_a").eqNullSafe(F.col("_b")) & F.coalesce(F.col("_rows") == F.col("_b.n_events"), F.lit(False))
    checked = timeline.checked(written["events"], [H])
    return checked.join(both.select(H, F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("what is written differs from what was computed")).cast("boolean")).alias("same")), H)
