"""From archives to a timeline: decode, fuse revisions, materialise, sweep.

Every table has a ``history_id``, which is part of every key, so that many
histories are imported at once. Items, places and days are fused by revision
before they become rows, and time that only samples cover is reconstructed
from them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.functions import codec, json_merge
from chronofold.functions.scalars import course, course_accuracy, haversine_m, mode_of, non_negative, offset_s, positive, timestamp_s, trimmed, valid_point
from chronofold.functions.times import above_0, at_least_0, mode, point, record, records, seconds, string, zone_s
from chronofold.operators import evidence, fusion, intervals, pedometer, reconstruct, routes, timeline, windows
from chronofold.session import cut
from chronofold.sources import archive

H = "history_id"
POINT = "struct<latitude:double,longitude:double,lat:double,lon:double>"
PLACE_FIELDS = f"placeId:string,mapboxPlaceId:string,name:string,center:{POINT},location:{POINT},radius:struct<mean:double>,isHome:boolean,secondsFromGMT:double,lastSaved:string,mapboxCategory:string,streetAddress:string"
PLACE = f"struct<{PLACE_FIELDS}>"
LOCATION = "struct<timestamp:string,latitude:double,longitude:double,lat:double,lon:double,altitude:double,horizontalAccuracy:double,verticalAccuracy:double,speed:double,speedAccuracy:double,course:double,courseAccuracy:double>"
SAMPLE = f"struct<sampleId:string,timelineItemId:string,date:string,secondsFromGMT:double,lastSaved:string,deleted:boolean,confirmedType:string,coreMotionActivityType:string,movingState:string,location:{LOCATION}>"
ITEM = (
    "struct<itemId:string,isVisit:boolean,startDate:string,endDate:string,lastSaved:string,activityType:string,confirmedType:string,manualActivityType:boolean,manualPlace:boolean,"
    f"activityTypeConfidenceScore:double,uncertainActivityType:boolean,unknownActivityType:boolean,center:{POINT},radius:struct<mean:double>,placeId:string,place:{PLACE},secondsFromGMT:double,stepCount:double,hkStepCount:double,floorsAscended:double,floorsDescended:double>"
)

# Fixed values.
#: Fields of an item that a later revision may set to null.
NULLABLE = ["activityType", "activityTypeConfidenceScore", "confirmedType", "manualActivityType", "uncertainActivityType", "unknownActivityType"]
ITEM_PROVIDER, BACKUP_PROVIDER, DAY_PROVIDER, MADE_PROVIDER = "arc_import", "arc_backup", "moves_export", "arc_reconstruction"
GAP_NOTES = {"low": "arc_low_confidence", "off": "moves_tracking_off", "unplaced": "moves_place_without_location", "between": "generated_between_stays"}
ANCHORS = ("home", "work", "school")
DEFAULT_RADIUS_M = 50.0
CODEC = "bqdc-v1"
#: Begins the keys of places that have a name and a point but no id.
NAMED = "named"


def _point(*places: str) -> tuple[Column, Column]:
    """Latitude and longitude of the first of some columns that has a valid point."""
    lat, lon = F.lit(None).cast("double"), F.lit(None).cast("double")
    for p in reversed(places):
        a, b = F.coalesce(f"{p}.latitude", f"{p}.lat"), F.coalesce(f"{p}.longitude", f"{p}.lon")
        lat, lon = F.when(valid_point(a, b), a).otherwise(lat), F.when(valid_point(a, b), b).otherwise(lon)
    return lat, lon


def _revision(field: str = "lastSaved") -> Column:
    return F.coalesce(timestamp_s(field), F.lit(0)).cast("double")


def _of_kind(values: DataFrame, *kinds: str) -> DataFrame:
    return values.where(F.col("error").isNull() & F.col("kind").isin(*kinds))


def _live(rows: DataFrame, key: str) -> DataFrame:
    """Rows (history, key, raw, revision, deleted) that aren't deleted, now or by a later deletion of their key."""
    dead = rows.where("deleted").select(H, key, timestamp_s(F.get_json_object("raw", "$.lastSaved")).cast("double").alias("revision"))
    return evidence.without_deleted(rows.where("not deleted"), dead, [H, key])


def _low(confirmed: str = "confirmedType") -> Column:
    """Whether an item's activity has low confidence."""
    sure = F.coalesce("isVisit", F.lit(False)) | F.coalesce("manualActivityType", F.lit(False)) | F.col(confirmed).isNotNull()
    return ~sure & (F.coalesce("uncertainActivityType", F.lit(False)) | F.coalesce("unknownActivityType", F.lit(False)) | F.coalesce(F.col("activityTypeConfidenceScore") <= 0, F.lit(False)))


def items(values: DataFrame) -> DataFrame:
    """Fused items: history_id, key, the fields of ITEM, revision, n_samples, exported, start_ts, end_ts.

    Revisions of a key are merged field by field from the first to the last; of
    equal ones that which knows more is the later. Deletions are applied.
    """
    own = _of_kind(values, "export-item", "stored-item").select(H, archive.item_key("raw").alias("key"), "kind", "raw").where("key is not null")
    typed = own.select("*", F.from_json("raw", f"{ITEM[:-1]},deleted:boolean,samples:array<{SAMPLE}>>").alias("i"))
    first = F.get("i.samples", F.lit(0))
    rows = typed.select(H, "key", "kind", "raw", "i.*", F.coalesce(F.size("i.samples"), F.lit(0)).alias("n_samples"), first["secondsFromGMT"].alias("first_offset")).withColumn("deleted", F.coalesce("deleted", F.lit(False)) & (F.col("kind") == "stored-item")).withColumn("revision", _revision())
    live = _live(rows, "key")
    start, end = timestamp_s("startDate"), timestamp_s("endDate")
    placed = _point("place.center", "place.location")[0].isNotNull()
    sure = F.coalesce("manualActivityType", F.lit(False)) | F.coalesce("manualPlace", F.lit(False)) | F.col("confirmedType").isNotNull()
    number_ = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    filled = lambda x: F.size(F.filter(F.map_values(F.from_json(x, "map<string,string>")), lambda v: v.isNotNull()))
    sample_fields = F.aggregate(F.coalesce(F.from_json(F.get_json_object("raw", "$.samples"), "array<string>"), F.array()), F.lit(0), lambda n, x: n + F.coalesce(filled(x), F.lit(0)))
    score = F.struct(number_(end > start).alias("a"), number_(sure).alias("b"), number_(~_low()).alias("c"), number_(placed).alias("d"), F.col("n_samples").alias("e"), sample_fields.alias("f"), F.coalesce(filled("raw"), F.lit(0)).alias("g"))
    ranked = live.select(H, "key", "kind", "n_samples", "revision", "first_offset", F.struct("revision", score.alias("score"), "raw").alias("r"))
    fused = ranked.groupBy(H, "key").agg(
        F.transform(F.array_sort(F.collect_list("r")), lambda r: r["raw"]).alias("raws"), F.max("revision").alias("revision"), F.max("n_samples").alias("n_samples"),
        F.max_by("first_offset", F.when(F.col("first_offset").isNotNull(), F.col("r"))).alias("first_offset"), F.max(F.col("kind") == "export-item").alias("exported"),
    )
    one = fused.withColumn("i", F.from_json(json_merge.merged_revisions("raws", NULLABLE), ITEM)).select(H, "key", "i.*", "revision", "n_samples", "first_offset", "exported")
    return one.withColumn("start_ts", start).withColumn("end_ts", end)


def places(values: DataFrame) -> DataFrame:
    """Fused places that have a point: history_id, placeId, name, lat, lon, radius_m, tz_offset_s, category, thoroughfare, revision."""
    own = _of_kind(values, "place").select(H, "raw", F.from_json("raw", f"struct<{PLACE_FIELDS},deleted:boolean>").alias("p"))
    rows = own.select(H, "raw", "p.placeId", F.coalesce("p.deleted", F.lit(False)).alias("deleted"), F.coalesce(timestamp_s("p.lastSaved"), F.lit(0)).cast("double").alias("revision"))
    ranked = _live(rows, "placeId").select(H, "placeId", "revision", F.struct("revision", json_merge.populated_fields("raw").alias("n"), "raw").alias("r"))
    fused = ranked.groupBy(H, "placeId").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["raw"]).alias("raws"), F.max("revision").alias("revision"))
    one = fused.select(H, F.col("placeId").alias("place_id"), "revision", F.from_json(json_merge.merged_revisions("raws"), PLACE).alias("p"))
    lat, lon = _point("p.center", "p.location")
    out = one.select(H, "place_id", F.nullif(trimmed("p.name"), F.lit("")).alias("name"), lat.alias("lat"), lon.alias("lon"), positive("p.radius.mean").alias("radius_m"), offset_s("p.secondsFromGMT").alias("tz_offset_s"), F.col("p.mapboxCategory").alias("category"), F.col("p.streetAddress").alias("thoroughfare"), "revision")
    return out.where("lat is not null")


#: The columns of an observation that come with its location.
FIX = ["lat", "lon", "altitude_m", "h_acc", "v_acc_m", "speed_mps", "speed_acc_mps", "course_deg", "course_acc_deg", "tz_offset_s"]


def observations(values: DataFrame, track_points: DataFrame | None = None) -> DataFrame:
    """What was observed, one row for each identity: history_id, identity, sample_id, ts, FIX, activity, rank, moving_state, link.

    Samples of items and of files of their own, and track points of days.
    Groups of columns that belong together are filled each by its own rank.
    Samples with an id take what anonymous ones at their time and place know
    better, and those go.
    """
    inner = _of_kind(values, "export-item", "stored-item").select(H, archive.item_key("raw").alias("parent"), F.explode(F.from_json(F.get_json_object("raw", "$.samples"), f"array<{SAMPLE}>")).alias("s"))
    alone = _of_kind(values, "sample").select(H, F.lit(None).cast("string").alias("parent"), F.from_json("raw", SAMPLE).alias("s"))
    flat = _of_kind(values, "sample").where(F.get_json_object("raw", "$.location").isNull()).select(H, F.lit(None).cast("string").alias("parent"), F.from_json("raw", SAMPLE).withField("location", F.from_json("raw", LOCATION)).alias("s"))
    s = inner.unionByName(alone.where("s.location is not null")).unionByName(flat).select(H, "parent", "s.*")
    ts = F.coalesce(timestamp_s("location.timestamp"), timestamp_s("date"))
    lat, lon = _point("location")
    told = [F.nullif(F.col(c), F.lit("")) for c in ("confirmedType", "coreMotionActivityType", "movingState")]
    rank = F.when(told[0].isNotNull(), 3).when(told[1].isNotNull(), 2).when(told[2].isNotNull(), 1).otherwise(0)
    there = sum(F.col(f"location.{c}").isNotNull().cast("int") for c in ("altitude", "horizontalAccuracy", "verticalAccuracy", "speed", "speedAccuracy", "course", "courseAccuracy"))
    h_acc = non_negative("location.horizontalAccuracy")
    rows = s.select(
        H, F.nullif("sampleId", F.lit("")).alias("sample_id"), F.coalesce(F.concat(F.lit("id:"), F.nullif("timelineItemId", F.lit(""))), "parent").alias("link"), ts.alias("ts"), lat.alias("lat"), lon.alias("lon"),
        F.col("location.altitude").alias("altitude_m"), h_acc.alias("h_acc"), non_negative("location.verticalAccuracy").alias("v_acc_m"), non_negative("location.speed").alias("speed_mps"), non_negative("location.speedAccuracy").alias("speed_acc_mps"),
        course("location.course").alias("course_deg"), course_accuracy("location.courseAccuracy").alias("course_acc_deg"), offset_s("secondsFromGMT").alias("tz_offset_s"), F.coalesce(*told).alias("activity"), rank.alias("rank"), told[2].alias("moving_state"),
        F.when(lat.isNull(), -1.0).otherwise(F.when(h_acc.isNull(), 0.0).otherwise(1_000_000 - h_acc) + there).alias("quality"), _revision().alias("revision"), F.coalesce("deleted", F.lit(False)).alias("deleted"),
        timestamp_s("lastSaved").cast("double").alias("saved"),
    )
    dead = rows.where("deleted and sample_id is not null").select(H, "sample_id", F.col("saved").alias("revision"))
    live = rows.where("not deleted").drop("deleted", "saved")
    if track_points is not None:
        more = track_points.select(H, "link", "ts", "lat", "lon", "tz_offset_s", F.lit(0.0).alias("quality"), F.lit(0).alias("rank"), F.lit(0.0).alias("revision"))
        live = live.unionByName(more, allowMissingColumns=True)
    live = live.where("ts >= 0 and (lat is not null or activity is not null)")
    spot = F.concat_ws(":", F.lit("observation"), "ts", F.format_string("%.7f", "lat"), F.format_string("%.7f", "lon"))
    identity = F.when(F.col("sample_id").isNotNull(), F.concat(F.lit("id:"), "sample_id")).when(F.col("lat").isNotNull(), spot).otherwise(F.concat_ws(":", F.lit("motion"), "ts", F.coalesce("link", F.lit("")), F.coalesce("activity", F.lit(""))))
    known = evidence.without_deleted(live.withColumn("identity", identity), dead, [H, "sample_id"])
    tie = F.to_json(F.struct(*FIX))
    one = evidence.merged(
        known.withColumn("tie", tie),
        [H, "identity"],
        {"fix": ["ts", *FIX], "activity": ["activity", "rank"], "moving": ["moving_state"], "link": ["link"], "id": ["sample_id"]},
        {"fix": ["quality", "revision", "tie"], "activity": ["rank", "revision", "activity"], "moving": ["revision", "moving_state"], "link": ["revision", "link"], "id": ["sample_id"]},
    )
    return evidence.absorb_twins(one.withColumn("_a", F.col("activity")), "sample_id", [H, "ts", "lat", "lon"], ["activity", "rank", "moving_state", "link"], {"activity": ["rank", "identity"], "rank": ["rank", "identity"], "moving_state": ["identity"], "link": ["identity"]}).drop("_a")


def canonical(seen: DataFrame) -> DataFrame:
    """Observations at one time and place as one; those without a place as they are."""
    groups = {"fix": [c for c in FIX if c not in ("lat", "lon")], "activity": ["activity", "rank"], "moving": ["moving_state"]}
    typed = seen.select(H, "identity", "ts", *FIX, "activity", "rank", "moving_state").withColumn("quality", F.coalesce(1_000_000 - F.col("h_acc"), F.lit(0.0)))
    return evidence.collapsed(typed, [H, "ts", "lat", "lon"], groups, {"fix": ["quality", "identity"], "activity": ["rank", "identity"], "moving": ["identity"]}, "identity")


EVENT = (
    "struct<kind:string,start_ts:bigint,end_ts:bigint,start_offset_s:int,end_offset_s:int,notes:string,manual:boolean,revision:double,lat:double,lon:double,place_ids:array<string>,place_rank:int,poi_name:string,category:string,anchor:boolean,"
    "mode:string,distance_m:double,route:array<struct<ts:bigint,lon:double,lat:double>>,quality:string,if_uncovered:boolean,ref:string>"
)
CLAIM = "struct<kind:string,start:bigint,end:bigint,steps:bigint,distance:double,tz_offset_s:int,manual:boolean,mode:string>"
TRACK_POINT = "struct<link:string,ts:bigint,lat:double,lon:double,tz_offset_s:int>"
DAY = f"struct<events:array<{EVENT}>,claims:array<{CLAIM}>,total:double,points:array<{TRACK_POINT}>>"


def _offsets(start: object, end: object) -> tuple[int | None, int | None]:
    a, b = zone_s(start), zone_s(end)
    return (b if a is None else a), (a if b is None else b)


def _route(points: list[dict], start: float, end: float) -> tuple[list[tuple], str]:
    """Cleaned points (ts, lon, lat) within a window; a track without any times whole, as it is."""
    placed = [(seconds(string(p.get("time")) or string(p.get("timestamp"))), q[1], q[0]) for p in points if (q := point(p))]
    timed = sorted(p for p in placed if p[0] is not None)
    if not timed:
        return placed, "raw"
    inside = [p for p in timed if start <= p[0] <= end]
    kept = routes.clean(inside)
    return kept, "raw" if len(kept) == len(inside) else "filtered"


class DayRows:
    """Events, step claims and track points of one fused day."""

    def __init__(self, day: dict) -> None:
        self.day, self.events, self.claims, self.points = day, [], {}, []
        self.date = string(day.get("date")) or ""
        segments = records(day.get("segments"))
        for s in records(day.get("fragments")):
            self._steps(s)
        for k, s in enumerate(segments):
            self._steps(s)
            self._segment(k, s)
        for k, s in enumerate([*segments, *records(day.get("fragments"))]):
            self._points(f"moves:{self.date}:{k}:{seconds(s.get('startTime'))}", s)
        self.total = float(sum(round(x) for s in records(day.get("summary")) if (x := above_0(s.get("steps")))))
        self._rest()

    def row(self) -> dict:
        return {"events": self.events, "claims": list(self.claims.values()), "total": self.total or None, "points": self.points}

    def _segment(self, k: int, s: dict) -> None:
        start, end = seconds(s.get("startTime")), seconds(s.get("endTime"))
        if start is None or end is None or not 0 < start < end:
            return
        a, b = _offsets(s.get("startTime"), s.get("endTime"))
        base = {"start_ts": start, "end_ts": end, "start_offset_s": a, "end_offset_s": b, "manual": s.get("manual") is True, "revision": fusion.own_revision(s, 0), "ref": f"moves:{self.date}:{k}:{start}"}
        place = record(s.get("place"))
        where = point(place.get("location"))
        if s.get("type") == "off":
            self.events.append(base | {"kind": "gap", "notes": GAP_NOTES["off"]})
        elif s.get("type") == "place" and where:
            _, rank, ids = fusion.place_ids(place)
            kind = (string(place.get("type")) or "").lower()
            other = place.get("foursquareCategoryIds")
            self.events.append(base | {"kind": "stay", "lat": where[0], "lon": where[1], "place_ids": ids, "place_rank": rank, "poi_name": (string(place.get("name")) or "").strip() or None, "anchor": kind in ANCHORS, "category": kind or (string(other[0]) if isinstance(other, list) and other else None)})
        elif s.get("type") == "place":
            self.events.append(base | {"kind": "gap", "notes": GAP_NOTES["unplaced"], "if_uncovered": True})
            for x in self._activities(s, None):
                self._move(s | {"trackPoints": [], "manual": False, fusion.REVISION: None, "lastUpdate": None, "lastSaved": None}, x, seconds(x.get("startTime")), seconds(x.get("endTime")), base["ref"])
        elif s.get("type") == "move":
            found = records(s.get("activities"))
            if not found:
                route, _ = _route(records(s.get("trackPoints")), start, end)
                if string(s.get("activity")) or above_0(s.get("distance")) or len(route) > 1 or base["manual"]:
                    self._move(s, s, start, end, base["ref"])
            for x in self._activities(s, (start, end)):
                self._move(s, x, start, end, base["ref"])

    def _activities(self, s: dict, window: tuple | None) -> list[dict]:
        told = fusion.activities([fusion.Told(x, fusion.own_revision(x, 0)) for x in records(s.get("activities"))])
        timed = [x for x in told if (t := fusion.Told(x, 0)).timed and 0 < t.start < t.end]
        return [x for x in timed if window is None or fusion.Told(x, 0).start < window[1] and fusion.Told(x, 0).end > window[0]]

    def _move(self, s: dict, x: dict, start: int | None, end: int | None, ref: str) -> None:
        """A move of an activity, cut to its segment; of the segment itself where it has none."""
        a, b = seconds(x.get("startTime")), seconds(x.get("endTime"))
        if None in (a, b, start, end):
            return
        lo, hi = max(a, start), min(b, end)
        if not 0 < lo < hi:
            return
        own = fusion.own_revision(s, 0)
        parts = [(records(s.get("trackPoints")), own)] + ([] if x is s else [(records(x.get("trackPoints")), fusion.own_revision(x, own))])
        route, quality = _route(fusion.track(parts) if x is not s else parts[0][0], lo, hi)
        zones = _offsets(x.get("startTime") if a >= start else s.get("startTime"), x.get("endTime") if b <= end else s.get("endTime"))
        metres = above_0(x.get("distance"))
        if metres is None and len(route) > 1:
            metres = routes.length_m(route)
        self.events.append(
            {
                "kind": "move", "start_ts": lo, "end_ts": hi, "start_offset_s": zones[0], "end_offset_s": zones[1], "manual": x.get("manual") is True or s.get("manual") is True, "revision": max(fusion.own_revision(x, 0), own), "mode": mode(x.get("activity")),
                "distance_m": metres and float(metres), "route": [dict(zip(("ts", "lon", "lat"), p, strict=True)) for p in route] if len(route) > 1 else None, "quality": quality, "ref": f"{ref}:{lo}",
            }
        )

    def _claim(self, x: dict, end: int | None, zone: object = None) -> None:
        steps = above_0(x.get("steps"))
        if steps is None or end is None:
            return
        start, steps, metres, name = seconds(x.get("startTime")), int(steps + 0.5), at_least_0(x.get("distance")), string(x.get("activity"))
        likely = metres is not None and mode(name) in ("walk", "run") and pedometer.MIN_M_PER_STEP <= metres / max(1, steps) <= pedometer.MAX_M_PER_STEP
        offset = zone_s(zone) if zone is not None else zone_s(string(x.get("endTime")) or string(x.get("startTime")))
        told = "leaf" if string(x.get("startTime")) and string(x.get("endTime")) else "summary"
        self.claims.setdefault((start, end, steps, metres), {"kind": told, "start": start, "end": end, "steps": steps, "distance": float(metres) if likely else None, "tz_offset_s": offset, "manual": x.get("manual") is True, "mode": name})

    def _steps(self, s: dict) -> None:
        told = fusion.activities([fusion.Told(x, fusion.own_revision(x, 0)) for x in records(s.get("activities"))])
        for x in told or [s]:
            self._claim(x, seconds(x.get("endTime")))

    def _rest(self) -> None:
        """Steps of the summary that no segment has: all of them, or what the segments lack, at the end of the day's last segment."""
        leaf, metres = sum(c["steps"] for c in self.claims.values()), sum(c["distance"] or 0 for c in self.claims.values())
        ends = [(seconds(s.get("endTime")), string(s.get("endTime"))) for s in records(self.day.get("segments"))]
        ends = [e for e in ends if e[0] is not None]
        noon = seconds(f"{self.date}T120000")
        at = max((e[0] for e in ends), default=noon)
        if at is None or at < 0:
            return
        stepped = [s for s in records(self.day.get("summary")) if above_0(s.get("steps"))]
        if not leaf:
            zones = [x for s in records(self.day.get("segments")) for x in (s.get("endTime"), s.get("startTime")) if zone_s(x) is not None]
            for s in stepped:
                self._claim({k: v for k, v in s.items() if k not in ("startTime", "endTime")}, at, zones[0] if zones else "")
        elif self.total > leaf:
            zone = next((text for ts, text in ends if ts == at), "")
            self._claim({"steps": self.total - leaf, "distance": max(0, sum(at_least_0(s.get("distance")) or 0 for s in stepped) - metres)}, at, zone)

    def _points(self, link: str, s: dict) -> None:
        for p in [*records(s.get("trackPoints")), *(p for x in records(s.get("activities")) for p in records(x.get("trackPoints")))]:
            text = string(p.get("time")) or string(p.get("timestamp"))
            ts, q = seconds(text), point(p)
            if ts is not None and q:
                self.points.append({"link": link, "ts": ts, "lat": q[0], "lon": q[1], "tz_offset_s": zone_s(text)})


def _day_rows(fused: Column) -> Column:
    kind = reconstruct.arrow_type(DAY)

    @F.arrow_udf(DAY)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([DayRows(json.loads(t)).row() for t in batch.to_pylist()], kind)

    return run(fused)


def days(values: DataFrame) -> DataFrame:
    """Fused days: history_id, date, and the fields of DAY."""
    own = _of_kind(values, "day").select(H, F.get_json_object("raw", "$.date").alias("date"), "raw")
    accounts = own.groupBy(H, "date").agg(F.array_sort(F.collect_set("raw")).alias("accounts"))
    return accounts.select(H, "date", _day_rows(fusion.fused_days("accounts")).alias("d")).select(H, "date", "d.*")


REFERENCE = {
    "kind": "string", "start_ts": "bigint", "end_ts": "bigint", "start_offset_s": "int", "end_offset_s": "int", "notes": "string", "manual": "boolean", "revision": "double", "source": "string", "provider": "string", "ref": "string", "lat": "double", "lon": "double", "radius_m": "double",
    "place_key": "string", "poi_name": "string", "second_key": "string", "second_m": "double", "anchor": "boolean", "mode": "string", "distance_m": "double", "route": "array<struct<ts:bigint,lon:double,lat:double>>", "path_quality": "string",
}


def _reference(df: DataFrame, **columns: Column) -> DataFrame:
    """Rows with history_id and the columns of REFERENCE, null where neither ``columns`` nor ``df`` has one."""
    have = lambda c: columns[c] if c in columns else F.col(c) if c in df.columns else F.lit(None)
    return df.select(H, *(have(c).cast(t).alias(c) for c, t in REFERENCE.items()))


def from_items(item: DataFrame, seen: DataFrame, place: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References of items, and the windows (history_id, start_ts, end_ts) of fragmented ones, which become none."""
    sample = F.struct(F.col("ts").cast("bigint").alias("ts"), "lon", "lat", "h_acc", "activity", F.col("tz_offset_s").alias("tz"))
    held = seen.where("link is not null").groupBy(H, F.col("link").alias("key")).agg(F.array_sort(F.collect_list(sample)).alias("samples"))
    voted = windows.dominant(seen.where("link is not null and activity is not null and not lower(trim(activity)) in ('stationary', 'unknown', 'uncertain')").withColumn("m", mode_of("activity")), [H, "link"], "m", "rank").select(H, F.col("link").alias("key"), F.col("m").alias("sample_mode"))
    p = place.select(H, F.col("place_id").alias("p_id"), F.col("name").alias("p_name"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), F.col("radius_m").alias("p_radius"), F.col("tz_offset_s").alias("p_offset"))
    some = F.coalesce("samples", F.expr(f"cast(array() as array<{reconstruct.POINT}>)"))
    full = item.join(held, [H, "key"], "left").join(voted, [H, "key"], "left").withColumn("samples", some).withColumn("p_id", F.coalesce(F.nullif("placeId", F.lit("")), "place.placeId")).join(p, [H, "p_id"], "left")

    lasts = F.col("end_ts") - F.col("start_ts")
    sure = F.coalesce("manualActivityType", F.lit(False)) | F.coalesce("manualPlace", F.lit(False)) | F.col("confirmedType").isNotNull()
    anchor = F.coalesce((lasts > 0) & ~_low() & (sure | (lasts >= fusion.TRUSTED_S) | (F.col("n_samples") >= 2)), F.lit(False))
    offset = F.coalesce(offset_s("secondsFromGMT"), offset_s("first_offset"))
    dated = full.where("start_ts is not null and end_ts is not null").withColumn("day", F.floor((F.col("start_ts") + F.coalesce(offset, F.lit(0))) / 86400).cast("bigint")).withColumn("is_anchor", anchor).withColumn("lasts", lasts)
    positive_ = windows.median(dated.withColumn("d", F.when(F.col("lasts") > 0, F.col("lasts"))), [H, "day"], "d")
    broken = dated.groupBy(H, "day").agg(F.count("*").alias("n"), F.count_if(F.col("lasts") <= 0).alias("empty")).join(positive_, [H, "day"])
    broken = broken.where(f"n >= 2 and (empty > 0 and empty / n >= {windows.FRAGMENT_RATIO} or n >= {windows.FRAGMENT_GROUP} and coalesce(d, 0) < {windows.FRAGMENT_MEDIAN_S})").select(H, "day")
    loose = dated.join(broken, [H, "day"], "left_semi")
    anchors = loose.where("is_anchor").select(H, "day", F.col("start_ts").alias("b_start"), F.col("end_ts").alias("b_end"))
    on_anchor = loose.where("not is_anchor").select(H, "day", "key", "start_ts", "end_ts").join(anchors, [H, "day"]).where("start_ts < b_end and end_ts > b_start or start_ts >= b_start and start_ts < b_end").select(H, "key").distinct().withColumn("held", F.lit(True))
    marked = loose.join(on_anchor, [H, "key"], "left").withColumn("stop", F.col("is_anchor") | F.coalesce("held", F.lit(False)))
    spans = windows.fragment_windows(marked, [H, "day"], "start_ts", "end_ts", "stop", "key").select(H, "start_ts", "end_ts")
    fragments = marked.where("not stop").select(H, "key")

    whole = dated.join(fragments, [H, "key"], "left_anti").where("start_ts > 0 and end_ts > start_ts")
    low = _low() & ~reconstruct.borne_out(F.col("isVisit"), F.col("samples"), F.col("lasts"))
    first = F.get(F.filter("samples", lambda s: s["tz"].isNotNull()), F.lit(0))["tz"]
    last = F.element_at(F.filter("samples", lambda s: s["tz"].isNotNull()), -1)
    spare = F.coalesce(offset, offset_s("place.secondsFromGMT"), "p_offset")
    start_offset, end_offset = F.coalesce(first, spare), F.coalesce(F.when(F.size(F.filter("samples", lambda s: s["tz"].isNotNull())) > 0, last["tz"]), spare)
    own_lat, own_lon = _point("center", "place.center", "place.location")
    fix = F.get(F.filter("samples", lambda s: s["lat"].isNotNull()), F.lit(0))
    stored = ~F.col("exported") & F.col("itemId").isNotNull()
    lat, lon = (F.when(stored, F.coalesce(F.col(f"p_{x}"), own, fix[x])).otherwise(F.coalesce(own, F.col(f"p_{x}"), fix[x])) for x, own in (("lat", own_lat), ("lon", own_lon)))
    radius = F.coalesce(F.when(~stored, positive("radius.mean")), F.col("p_radius"), F.lit(DEFAULT_RADIUS_M))
    told = F.when(_low(), F.col("confirmedType")).otherwise(F.coalesce(F.nullif("activityType", F.lit("")), "confirmedType"))
    name = F.coalesce(F.nullif(trimmed("place.name"), F.lit("")), "p_name")
    without_id = F.concat_ws(":", F.lit(NAMED), name, *_point("place.center", "place.location"))
    key = F.when(name.isNotNull(), F.coalesce(F.concat(F.lit("mapbox:"), F.nullif("place.mapboxPlaceId", F.lit(""))), F.concat(F.lit("arc:"), F.col("p_id")), F.when(_point("place.center", "place.location")[0].isNotNull(), without_id)))
    within = F.filter("samples", lambda s: (s["ts"] >= F.col("start_ts")) & (s["ts"] <= F.col("end_ts")) & s["lat"].isNotNull())
    read = whole.withColumn("low", low).withColumn("kind", F.when(F.col("low"), "gap").when(F.col("isVisit") & lat.isNotNull(), "stay").when(~F.col("isVisit"), "move")).where("kind is not null")
    routed = read.withColumn("r", routes.cleaned_route(F.when(F.col("kind") == "move", F.transform(within, lambda s: F.struct(s["ts"].alias("ts"), s["lon"].alias("lon"), s["lat"].alias("lat"))))))
    has_route = F.size("r.points") > 1
    move = F.col("kind") == "move"
    refs = _reference(
        routed, start_offset_s=start_offset, end_offset_s=end_offset, notes=F.when(F.col("low"), GAP_NOTES["low"]), manual=F.when(move, F.coalesce("manualActivityType", F.lit(False)) | F.col("confirmedType").isNotNull()).otherwise(F.coalesce("manualActivityType", F.lit(False)) | F.coalesce("manualPlace", F.lit(False))),
        source=F.lit("arc"), provider=F.when(F.col("exported"), ITEM_PROVIDER).otherwise(BACKUP_PROVIDER), ref=F.col("key"), lat=F.when(~move, lat), lon=F.when(~move, lon), radius_m=radius, place_key=F.when(~move, key), poi_name=F.when(~move, name), anchor=F.coalesce("place.isHome", F.lit(False)),
        mode=F.when(move, F.when(told.isNotNull(), mode_of(told)).otherwise(F.coalesce("sample_mode", F.lit("other")))), distance_m=F.when(has_route, F.col("r.distance_m")), route=F.when(has_route, F.col("r.points")), path_quality=F.col("r.quality"),
    )
    return refs, spans


def _matched_stays(of_days: DataFrame, of_items: DataFrame) -> DataFrame:
    """(history_id, ref, and what the best item's stay at the same time and place has) for stays of days."""
    a = of_days.where("kind = 'stay'").select(H, "ref", F.col("start_ts").alias("a_start"), F.col("end_ts").alias("a_end"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    b = of_items.where("kind = 'stay'").select(H, F.col("ref").alias("b_ref"), F.col("start_ts").alias("b_start"), F.col("end_ts").alias("b_end"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), F.col("radius_m").alias("b_radius"), F.col("place_key").alias("b_key"), F.col("anchor").alias("b_anchor"))
    near = intervals.half_matches(a, b, [H]).withColumn("far", haversine_m("a_lat", "a_lon", "b_lat", "b_lon")).where(F.col("far") <= F.greatest(F.lit(50.0), F.col("b_radius") + intervals.STAY_BUFFER_M))
    return intervals.best_match(near, [H, "ref"], "far", "b_ref").select(H, "ref", "b_radius", "b_key", "b_anchor", "far")


def place_groups(of_days: DataFrame) -> DataFrame:
    """(history_id, alias, place_key): ids that places of days share, directly or by way of others, with the lasting one of them."""
    ids = of_days.where("size(place_ids) > 0").select(H, F.explode("place_ids").alias("alias"), "place_ids", "place_rank")
    edges = ids.select(H, F.get("place_ids", F.lit(0)).alias("a"), F.col("alias").alias("b"))
    group = evidence.components(edges.unionByName(edges.select(H, "a", F.col("a").alias("b"))).distinct(), [H])
    best = of_days.where("size(place_ids) > 0").select(H, F.get("place_ids", F.lit(0)).alias("node"), "place_rank").join(group, [H, "node"]).groupBy(H, "component").agg(F.max_by("node", F.struct("place_rank", "node")).alias("best"))
    return group.join(best, [H, "component"]).select(H, F.col("node").alias("alias"), F.concat(F.lit("moves:"), "best").alias("place_key"))


def item_aliases(item: DataFrame) -> DataFrame:
    """(history_id, arc, mapbox): the two keys of a place that an item with both ids, a name and a point tells."""
    lat = _point("place.center", "place.location")[0]
    named = item.where(F.nullif(trimmed("place.name"), F.lit("")).isNotNull() & lat.isNotNull())
    keys = named.select(H, F.concat(F.lit("arc:"), F.coalesce(F.nullif("placeId", F.lit("")), F.nullif("place.placeId", F.lit("")))).alias("arc"), F.concat(F.lit("mapbox:"), F.nullif("place.mapboxPlaceId", F.lit(""))).alias("mapbox"))
    return keys.where("arc is not null and mapbox is not null").distinct()


def place_aliases(pairs: DataFrame, stored: DataFrame) -> DataFrame:
    """(history_id, alias, place_key): keys that stand for one place, directly or by way of others, with the one that it goes by.

    That is the key of a stored place if there is one, else a mapbox key; of
    several the smallest. ``pairs`` has (history_id, arc, mapbox), ``stored``
    (history_id, place_key).
    """
    group = evidence.components(pairs.select(H, F.col("arc").alias("a"), F.col("mapbox").alias("b")), [H])
    known = stored.select(H, F.col("place_key").alias("node"), F.lit(0).alias("rank")).distinct()
    rank = F.coalesce("rank", F.when(F.startswith("node", F.lit("mapbox:")), 1).otherwise(2))
    best = group.join(known, [H, "node"], "left").groupBy(H, "component").agg(F.min_by("node", F.struct(rank, "node")).alias("place_key"))
    return group.join(best, [H, "component"]).select(H, F.col("node").alias("alias"), "place_key")


def by_alias(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows whose place_key is that which their place goes by."""
    own = aliases.select(F.col(H).alias("_h"), "alias", F.col("place_key").alias("_key"))
    joined = rows.join(own, (rows[H] == own["_h"]) & (rows["place_key"] == own["alias"]), "left")
    return joined.select(*(F.coalesce("_key", rows[c]).alias(c) if c == "place_key" else rows[c] for c in rows.columns))


def from_days(day: DataFrame, item_refs: DataFrame) -> DataFrame:
    """References of fused days.

    A stay is at its own place if any account names that, else at the place of
    the item's stay that it matches best, which is its second place otherwise.
    A place without a point is a gap where nothing else covers any of it.
    """
    rows = day.select(H, F.explode("events").alias("e")).select(H, "e.*")
    groups = place_groups(rows)
    keyed = rows.join(groups.withColumnRenamed("alias", "_first"), [rows[H] == groups[H], F.get("place_ids", F.lit(0)) == F.col("_first")], "left").select(*(rows[c] for c in rows.columns), "place_key")
    met = _matched_stays(rows, item_refs)
    named = keyed.where("poi_name is not null").select(H, "place_key").distinct().withColumn("is_named", F.lit(True))
    full = keyed.join(met, [H, "ref"], "left").join(named, [H, "place_key"], "left")
    own = F.when(F.col("is_named"), F.col("place_key"))
    refs = _reference(
        full.withColumn("if_uncovered", F.coalesce("if_uncovered", F.lit(False))), source=F.lit("moves"), provider=F.lit(DAY_PROVIDER), radius_m=F.coalesce("b_radius", F.lit(DEFAULT_RADIUS_M)), manual=F.coalesce("manual", F.lit(False)), anchor=F.coalesce("anchor", F.lit(False)) | F.coalesce("b_anchor", F.lit(False)),
        place_key=F.coalesce(own, "b_key"), second_key=F.when(own != F.col("b_key"), F.col("b_key")), second_m=F.when(own != F.col("b_key"), F.col("far")), path_quality=F.col("quality"), notes=F.when(F.col("if_uncovered"), F.concat(F.lit("?"), "notes")).otherwise(F.col("notes")),
    )
    maybe, sure = refs.where("notes like '?%'"), refs.where("notes is null or not notes like '?%'")
    others = item_refs.select(H, "start_ts", "end_ts").unionByName(sure.where("kind <> 'move'").select(H, "start_ts", "end_ts"))
    covered = intervals.touching(maybe.select(H, "start_ts", "end_ts", "ref"), others, [H]).select(H, "ref")
    return sure.unionByName(maybe.join(covered, [H, "ref"], "left_anti").withColumn("notes", F.substring("notes", 2, 100)))


def from_samples(refs: DataFrame, spans: DataFrame, seen: DataFrame, known: DataFrame, place: DataFrame) -> DataFrame:
    """References of fragmented windows, and of time that nothing but samples without a known item covers."""
    out = cut(reconstruct.reconstructed(spans, seen, [H]))
    loose = evidence.unlinked(seen, known.select(H, F.col("key").alias("link")), "link", "moves:", [H])
    open_ = windows.observation_windows(loose, [H], "ts", "identity").select(H, F.col("start_ts").alias("window_id"), "start_ts", F.col("end_ts").cast("bigint").alias("end_ts"))
    covered = refs.select(H, "start_ts", "end_ts").unionByName(out.select(H, "start_ts", "end_ts"))
    left = intervals.subtract(open_, covered, [H]).select(H, "start_ts", "end_ts")
    made = cut(out.unionByName(reconstruct.reconstructed(left, loose, [H])))
    named = place.where("name is not null").select(H, "place_id", F.col("lat").alias("place_lat"), F.col("lon").alias("place_lon"), F.coalesce("radius_m", F.lit(DEFAULT_RADIUS_M)).alias("place_radius_m"), F.col("name").alias("n_name"))
    points = made.where("kind = 'stay'").select(H, F.col("start_ts").alias("point_id"), "lat", "lon", "radius_m").distinct()
    near = intervals.nearest_unambiguous(points, named.drop("n_name"), [H]).join(named.select(H, "place_id", "n_name", "place_radius_m"), [H, "place_id"]).select(H, F.col("point_id").alias("start_ts"), "place_id", "n_name", "place_radius_m")
    full = made.join(near, [H, "start_ts"], "left")
    stay = F.col("kind") == "stay"
    return _reference(
        full, source=F.lit("generated"), provider=F.lit(MADE_PROVIDER), manual=F.lit(False), revision=F.lit(0.0), ref=F.concat_ws(":", F.lit("reconstructed"), "kind", "start_ts"), radius_m=F.when(stay, F.greatest("radius_m", F.coalesce("place_radius_m", F.lit(0.0)))), anchor=F.lit(False),
        place_key=F.when(stay & F.col("place_id").isNotNull(), F.concat(F.lit("arc:"), "place_id")), poi_name=F.when(stay, F.col("n_name")), path_quality=F.col("quality"),
    )


def without_duplicate_moves(refs: DataFrame) -> DataFrame:
    """Moves of one window and mode are one.

    That of an item counts before others, but before the cut-off that of a
    day. It is manual if any is, has the latest revision, and what it lacks
    comes from the others.
    """
    moves, rest = refs.where("kind = 'move'"), refs.where("kind <> 'move'")
    keys = [H, "start_ts", "end_ts", "mode"]
    early = (F.col("start_ts") < timeline.CUTOFF_TS) & (F.col("source") == "moves")
    order = F.struct(early.cast("int").alias("a"), (F.col("source") == "arc").cast("int").alias("b"), (F.col("source") == "moves").cast("int").alias("c"), "revision", "ref")
    fields = [c for c in REFERENCE if c not in (*keys, "manual", "revision", "kind")]
    from_route = F.when(F.col("route").isNotNull(), order)
    one = moves.groupBy(*keys).agg(
        *(F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in fields if c not in ("source", "provider", "ref", "path_quality")), *(F.max_by(c, order).alias(c) for c in ("source", "provider", "ref")), F.max_by("path_quality", from_route).alias("path_quality"),
        F.max("manual").alias("manual"), F.max("revision").alias("revision"),
    )
    return one.withColumn("kind", F.lit("move")).select(*refs.columns).unionByName(rest)


def rated(refs: DataFrame) -> DataFrame:
    """References with the quality that counts where they overlap, and an id within their history."""
    stay = 1 + 5 * F.col("poi_name").isNotNull().cast("int") + F.col("place_key").isNotNull().cast("int") + 3 * F.coalesce("anchor", F.lit(False)).cast("int")
    move = 1 + timeline.ROUTE_POINTS * F.col("route").isNotNull().cast("int") + timeline.DISTANCE_POINTS * F.col("distance_m").isNotNull().cast("int") + 2 * F.coalesce(F.col("mode") != "other", F.lit(False)).cast("int")
    gap = F.when(F.col("notes") == GAP_NOTES["off"], 2).otherwise(0)
    quality = F.when(F.col("kind") == "stay", stay).when(F.col("kind") == "move", move).otherwise(gap)
    order = W.partitionBy(H).orderBy("start_ts", "end_ts", "kind", "ref")
    return refs.withColumn("quality", quality.cast("int")).withColumn("id", F.row_number().over(order).cast("bigint"))


class Sources:
    """The fused evidence of some archives: items, places, days, observations.

    Each is read many times over, so its plan ends at a checkpoint.
    """

    def __init__(self, values: DataFrame) -> None:
        self.values = values
        self.items, self.places, self.days = cut(items(values)), cut(places(values)), cut(days(values))
        points = self.days.select(H, F.explode("points").alias("p")).select(H, "p.*")
        self.seen = cut(observations(values, points))
        stored = self.places.where("name is not null").select(H, F.concat(F.lit("arc:"), "place_id").alias("place_key"))
        self.aliases = cut(place_aliases(item_aliases(self.items), stored))

    def references(self) -> DataFrame:
        item_refs, spans = from_items(self.items, self.seen, self.places)
        item_refs, spans = cut(by_alias(item_refs, self.aliases)), cut(spans)
        day_refs = cut(from_days(self.days, item_refs))
        known = self.items.select(H, "key").unionByName(_of_kind(self.values, "stored-item").where(F.get_json_object("raw", "$.deleted") == "true").select(H, archive.item_key("raw").alias("key")))
        made = by_alias(from_samples(item_refs.unionByName(day_refs), spans, self.seen, known, self.places), self.aliases)
        return cut(rated(without_duplicate_moves(item_refs.unionByName(day_refs).unionByName(made))))

    def claims(self) -> DataFrame:
        """Step claims of items, fragments among them, and of days."""
        i = self.items
        order = W.partitionBy(H).orderBy(F.col("start_ts").asc_nulls_last(), "end_ts", "key")
        own = self.seen.where("link is not null and lat is not null").groupBy(H, F.col("link").alias("key")).agg(F.array_sort(F.collect_list(F.struct("ts", "lon", "lat"))).alias("p"))
        first = self.seen.where("link is not null and tz_offset_s is not null").groupBy(H, F.col("link").alias("key")).agg(F.min_by("tz_offset_s", F.struct("ts", "identity")).alias("seen_offset"))
        voted = windows.dominant(self.seen.where("link is not null and activity is not null and not lower(trim(activity)) in ('stationary', 'unknown', 'uncertain')").withColumn("m", mode_of("activity")), [H, "link"], "m", "rank").select(H, F.col("link").alias("key"), F.col("m").alias("sample_mode"))
        steps = positive(F.coalesce("stepCount", "hkStepCount"))
        activity = F.coalesce(F.nullif("activityType", F.lit("")), "confirmedType")
        walked = F.when(~F.col("isVisit"), F.when(activity.isNotNull(), mode_of(activity)).otherwise(F.col("sample_mode")))
        rounded = F.floor(steps + 0.5)
        full = i.withColumn("sequence", F.row_number().over(order).cast("bigint")).join(own, [H, "key"], "left").join(first, [H, "key"], "left").join(voted, [H, "key"], "left")
        metres = routes.cleaned_route("p")["distance_m"]
        offset = F.coalesce("seen_offset", offset_s("secondsFromGMT"))
        from_items_ = full.where("end_ts is not null and (coalesce(stepCount, hkStepCount) > 0 or floorsAscended > 0 or floorsDescended > 0)").withColumn("metres", F.when(F.size("p") > 1, metres)).select(
            H, F.lit(pedometer.ITEMS).alias("source"), F.when(F.col("isVisit"), "stay").otherwise("move").alias("kind"), F.floor((F.col("end_ts") + F.coalesce(offset, F.lit(0))) / 86400).cast("bigint").alias("day_key"), F.col("start_ts").alias("start"), F.col("end_ts").alias("end"), rounded.alias("steps"),
            pedometer.plausible_distance(rounded, F.col("metres"), walked).alias("distance"), positive("floorsAscended").alias("floors_up"), positive("floorsDescended").alias("floors_down"), offset.alias("tz_offset_s"), F.coalesce("manualActivityType", F.lit(False)).alias("manual"), "sequence", activity.alias("mode"),
        )
        c = self.days.select(H, "date", F.explode("claims").alias("c")).select(H, "date", "c.*")
        of_days = c.select(H, F.lit(pedometer.DAYS).alias("source"), "kind", F.floor(timestamp_s(F.concat("date", F.lit("T000000"))) / 86400).cast("bigint").alias("day_key"), "start", "end", "steps", "distance", "tz_offset_s", "manual", "mode")
        both = from_items_.unionByName(of_days, allowMissingColumns=True)
        ids = W.partitionBy(H).orderBy("source", F.col("sequence").asc_nulls_last(), "end", "start", "steps", "distance", "kind", "mode")
        return both.withColumn("claim_id", F.row_number().over(ids).cast("bigint")).select(*(F.col(x.split()[0]).cast(x.split()[1]) for x in pedometer.SCHEMA.split(", ")))

    def totals(self) -> DataFrame:
        return self.days.where("total is not null").select(H, F.floor(timestamp_s(F.concat("date", F.lit("T000000"))) / 86400).cast("bigint").alias("day_key"), "total")


def pois_of(refs: DataFrame, place: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Named places by key: the latest name and point, how often and when they were visited. Stored places go by their ``aliases``."""
    known = place.where("name is not null").select(H, F.concat(F.lit("arc:"), "place_id").alias("place_key"), "name", "lat", "lon", "radius_m", "category", "thoroughfare", "revision", F.lit(None).cast("bigint").alias("seen"))
    visits = refs.where("kind = 'stay' and place_key is not null").select(H, "place_key", F.col("poi_name").alias("name"), "lat", "lon", F.when(F.col("source") == "arc", F.col("radius_m")).alias("radius_m"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("thoroughfare"), "revision", F.col("start_ts").alias("seen"))
    rows = (known if aliases is None else by_alias(known, aliases)).unionByName(visits)
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & F.col("name").isNotNull(), F.struct("revision", F.coalesce("seen", F.lit(0)))))
    out = rows.groupBy(H, "place_key").agg(*(latest(c).alias(c) for c in ("name", "lat", "lon", "radius_m", "category", "thoroughfare")), F.count("seen").alias("visitCount"), F.min("seen").alias("first_seen_ts"), F.max("seen").alias("last_seen_ts"))
    named = out.where("name is not null")
    prefix = F.substring_index("place_key", ":", 1)
    own_id = F.when(prefix != NAMED, F.expr("substring(place_key, locate(':', place_key) + 1)"))
    return named.select(H, F.col("place_key").alias("poi_id"), F.when(prefix == NAMED, "arc").otherwise(prefix).alias("provider"), own_id.alias("provider_poi_id"), "name", "category", "lat", "lon", "radius_m", "visitCount", "first_seen_ts", "last_seen_ts", "thoroughfare")


def along(points: Column) -> Column:
    """Metres along array<struct<ts,lon,lat>>."""
    steps = F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: haversine_m(a["lat"], a["lon"], b["lat"], b["lon"]))
    return F.aggregate(steps, F.lit(0.0), lambda n, x: n + x)


def import_values(values: DataFrame) -> dict[str, DataFrame]:
    """All output tables of decoded archives, each with history_id."""
    source = Sources(values)
    refs = source.references()
    events = refs.select(H, "id", "kind", *(F.col(c).cast("double").alias(c) for c in ("start_ts", "end_ts")), "quality", "manual", "revision", "source", "lat", "lon", "radius_m", "start_offset_s", "end_offset_s", F.col("route").isNotNull().alias("has_route"), F.col("distance_m").isNotNull().alias("has_distance"))
    swept = cut(timeline.sweep(events))
    about = lambda key, *columns: refs.select(H, F.col("id").alias(key), *columns)
    own = swept.join(about("id", "mode", "provider", "notes", F.col("route").alias("own_route"), F.col("distance_m").alias("own_distance"), F.col("path_quality").alias("own_quality")), [H, "id"])
    full = own.join(about("place_from", "place_key", "poi_name", "anchor"), [H, "place_from"], "left").join(about("route_from", "route", "path_quality"), [H, "route_from"], "left").join(about("distance_from", "distance_m"), [H, "distance_from"], "left")
    inside = F.filter("own_route", lambda p: (p["ts"] >= F.col("start_ts")) & (p["ts"] <= F.col("end_ts")))
    moved = full.where("kind = 'move'").withColumn("rebuilt", F.when(~F.col("geometry_valid") & (F.size(inside) > 1), inside))
    moves = moved.select(
        H, "id", "part", "start_ts", "end_ts", "mode", F.coalesce("distance_m", F.when(F.col("rebuilt").isNotNull(), along(F.col("rebuilt")))).alias("distance_m"), F.col("start_offset_s").alias("tz_offset_s"), F.col("end_offset_s").alias("end_tz_offset_s"), "provider",
        F.coalesce("route", "rebuilt").alias("route"), F.coalesce("path_quality", "own_quality").alias("path_quality"),
    )
    paths = moves.where("size(route) > 1")
    least, most = (lambda c: F.array_min(F.transform("route", lambda p: p[c]))), (lambda c: F.array_max(F.transform("route", lambda p: p[c])))
    route_paths = paths.select(
        H, F.col("id").alias("move_id"), "part", F.lit(1).alias("is_primary"), F.lit(CODEC).alias("codec"), F.lit("none").alias("compression"), F.lit(codec.DEFAULT_CM).alias("quantization_cm"), codec.encode_route(F.col("route.lon"), F.col("route.lat")).alias("path_blob"), F.size("route").alias("sample_count"), "path_quality", "provider",
        least("lat").alias("bbox_min_lat"), least("lon").alias("bbox_min_lon"), most("lat").alias("bbox_max_lat"), most("lon").alias("bbox_max_lon"),
    )
    generated = timeline.filled_gaps(swept).select(H, F.lit(None).cast("bigint").alias("id"), F.lit(0).alias("part"), "start_ts", "end_ts", F.lit(GAP_NOTES["between"]).alias("notes"), F.lit(None).cast("int").alias("tz_offset_s"), F.lit(None).cast("int").alias("end_tz_offset_s"))
    gaps = full.where("kind = 'gap'").select(H, "id", "part", "start_ts", "end_ts", "notes", F.col("start_offset_s").alias("tz_offset_s"), F.col("end_offset_s").alias("end_tz_offset_s")).unionByName(generated)
    pois = pois_of(refs, source.places, source.aliases)
    stays = full.where("kind = 'stay'").join(pois.select(H, F.col("poi_id").alias("place_key"), F.lit(True).alias("named")), [H, "place_key"], "left")
    at_place = F.when(F.col("named"), F.col("place_key"))
    at = lambda key, far: refs.where(f"kind = 'stay' and {key} is not null").select(H, F.col("id").alias("from_id"), F.col(key).alias("poi_id"), far.alias("distance_m"))
    links = at("place_key", F.lit(None).cast("double")).unionByName(at("second_key", F.col("second_m")))
    whole = swept.where("kind = 'stay'").select(H, "id", "part", F.explode(F.array_union(F.array("id"), "absorbed")).alias("from_id"))
    primary = stays.select(H, "id", "part", at_place.alias("main"))
    linked = whole.join(links, [H, "from_id"]).join(pois.select(H, "poi_id"), [H, "poi_id"], "left_semi").join(primary, [H, "id", "part"])
    role = F.when(F.col("poi_id") == F.col("main"), "primary").otherwise("secondary")
    stay_pois = linked.groupBy(H, "id", "part", "poi_id").agg(F.min(role).alias("role"), F.min("distance_m").alias("distance_m"))
    seen = canonical(source.seen)
    motion = seen.where("activity is not null").withColumn("k", F.lower(trimmed("activity")))
    flag = lambda *names: F.col("k").isin(*names).cast("int")
    stored = source.items.where("not exported and itemId is not null and isVisit and start_ts > 0 and end_ts > start_ts")
    raw = refs.where(f"kind = 'stay' and provider = '{BACKUP_PROVIDER}'").join(stored.select(H, F.col("key").alias("ref")), [H, "ref"], "left_semi")
    tables = {
        "stays": stays.select(H, "id", "part", "start_ts", "end_ts", F.col("lat").alias("centroid_lat"), F.col("lon").alias("centroid_lon"), "radius_m", F.when(F.col("anchor"), "anchor").otherwise("venue").alias("type"), at_place.alias("poi_id"), F.col("start_offset_s").alias("tz_offset_s"), F.col("end_offset_s").alias("end_tz_offset_s")),
        "moves": moves,
        "no_data_gaps": gaps.withColumn("reason", F.lit("Unknown")),
        "pois": pois,
        "stay_pois": stay_pois,
        "route_paths": route_paths,
        "raw_gps": seen.where("lat is not null").select(H, "ts", "lat", "lon", "altitude_m", F.col("h_acc").alias("h_acc_m"), "v_acc_m", "speed_mps", "speed_acc_mps", "course_deg", "course_acc_deg", "tz_offset_s", F.lit("unknown").alias("provider"), F.lit(0).alias("is_simulated")),
        "samples": seen.where("lat is not null").select(H, "ts", "lat", "lon", "altitude_m", "speed_mps", "speed_acc_mps", "course_deg", "course_acc_deg", F.col("h_acc").alias("h_acc_m"), "v_acc_m", F.lit("raw").alias("estimator"), F.lit("raw").alias("source_kind"), "tz_offset_s"),
        "raw_motion_activity": motion.select(
            H, "ts", F.greatest(F.col("rank") - 1, F.lit(0)).alias("confidence"), flag("stationary").alias("is_stationary"), flag("walking", "walk").alias("is_walking"), flag("running", "run").alias("is_running"), flag("car", "automotive").alias("is_automotive"), flag("cycling", "bicycle").alias("is_cycling"),
            flag("walking", "walk", "running", "run").alias("is_on_foot"), flag("unknown").alias("is_unknown"), "tz_offset_s",
        ),
        "raw_pedometer": pedometer.pedometer_rows(source.claims(), source.totals()),
        "raw_visits": raw.select(H, F.col("start_ts").alias("arrival_ts"), F.col("end_ts").alias("departure_ts"), "lat", "lon", F.col("radius_m").alias("horizontal_acc_m"), F.col("start_offset_s").alias("tz_offset_s")).distinct(),
        "files": archive.scan_summary(values),
    }
    tables["events"] = swept.select(H, "kind", "start_ts", "end_ts").unionByName(generated.select(H, F.lit("gap").alias("kind"), "start_ts", "end_ts"))
    tables["report"] = timeline.integrity(tables["events"], [H])
    return tables


def import_histories(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All output tables of a folder with a folder for each history."""
    return import_values(cut(archive.read_archives(spark, folder)))


def import_history(spark: SparkSession, folder: str, history: str = "history") -> dict[str, DataFrame]:
    """All output tables of a folder of archives of one history."""
    return import_values(cut(archive.read_archives(spark, folder, history)))
