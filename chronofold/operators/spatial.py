"""Where things are: a curve for the layout of files, boxes, and cells of several sizes for joins.

A cell is a band of latitude and a part of it. A band has as many parts as keep
them about as wide as high, and parts are counted around the globe, so that the
date line is no edge. Each place goes to the cells that its reach touches, of a
size that fits the reach and of the larger sizes: some cells for each. Two that are within reach meet in the larger one's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions.scalars import EARTH_M

BASE_DEG = 0.01
MOST_LEVEL = 15
STEP = 5
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread_bits(x: Column) -> Column:
    """The 31 bits of a number at every other place."""
    for shift, mask in _SPREAD:
        x = F.shiftleft(x, shift).bitwiseOR(x).bitwiseAND(F.lit(mask))
    return x


def curve_key(lat: Column | str, lon: Column | str, bits: int = 24) -> Column:
    """The place of a point on a curve that keeps near points near (bits of latitude and longitude in turn); null without a point."""
    scaled = lambda x, low, width: F.least(F.greatest(F.floor((x - low) / width * (1 << bits)).cast("bigint"), F.lit(0)), F.lit((1 << bits) - 1))
    y, x = (F.col(c) if isinstance(c, str) else c for c in (lat, lon))
    key = F.shiftleft(_spread_bits(scaled(y, -90.0, 180.0)), 1).bitwiseOR(_spread_bits(scaled(x, -180.0, 360.0)))
    return F.when(y.isNotNull() & x.isNotNull(), key)


def write_by_place(df: DataFrame, folder: str, lat: str, lon: str, files: int, *, mode: str = "errorifexists") -> None:
    """Parquet files whose rows lie near each other, so that the statistics of files and row groups tell boxes apart."""
    keyed = df.withColumn("_curve", curve_key(lat, lon))
    keyed.repartitionByRange(files, "_curve").sortWithinPartitions("_curve").drop("_curve").write.mode(mode).parquet(folder)


def within_box(df: DataFrame, lat: str, lon: str, south: float, west: float, north: float, east: float) -> DataFrame:
    """Rows in a box; it goes over the date line where ``west`` is greater than ``east``. The comparisons reach the statistics of Parquet files."""
    y, x = F.col(lat), F.col(lon)
    around = x.between(west, east) if west <= east else (x >= west) | (x <= east)
    return df.where(y.between(south, north) & around)


def _least_cos(band: Column, size: Column) -> Column:
    edge = F.least(F.greatest(F.abs(band * size), F.abs((band + 1) * size)), F.lit(90.0))
    return F.greatest(F.cos(F.radians(edge)), F.lit(1e-9))


def own_level(reach_m: Column) -> Column:
    """The smallest size of cells that a reach fits into, as a power of two of the base."""
    deg = F.degrees(reach_m / EARTH_M)
    return F.least(F.greatest(F.ceil(F.log2(F.greatest(deg / BASE_DEG, F.lit(1e-12))) / STEP) * STEP, F.lit(0)), F.lit(MOST_LEVEL)).cast("int")


def in_cells(df: DataFrame, lat: str, lon: str, reach: Column) -> DataFrame:
    """Rows with _own, and for each level from their own on the cells (_level, _band, _part) that their reach touches."""
    leveled = df.withColumn("_reach", reach).withColumn("_own", own_level(F.col("_reach"))).withColumn("_level", F.explode(F.sequence(F.col("_own"), F.lit(MOST_LEVEL), F.lit(STEP))))
    size = F.lit(BASE_DEG) * F.pow(F.lit(2.0), F.col("_level"))
    deg = F.degrees(F.col("_reach") / EARTH_M) * (1 + 1e-9) + 1e-9
    low, high = (F.floor(F.least(F.greatest(F.col(lat) + d, F.lit(-90.0)), F.lit(90.0)) / size).cast("bigint") for d in (-deg, deg))
    banded = leveled.withColumn("_size", size).withColumn("_band", F.explode(F.sequence(low, high)))
    cos = F.least(_least_cos(F.col("_band"), F.col("_size")), F.greatest(F.cos(F.radians(F.col(lat))), F.lit(1e-9)))
    parts = F.greatest(F.floor(360 * _least_cos(F.col("_band"), F.col("_size")) / F.col("_size")), F.lit(1)).cast("bigint")
    # A chord of length d around an axis at distance cos spans at most pi / 2 * d / cos; a bit more for reaches that change it.
    wide = F.least(deg * 2 / cos, F.lit(180.0))
    at = lambda x: F.floor((x + 180) / 360 * F.col("_parts")).cast("bigint")
    sized = banded.withColumn("_parts", parts).withColumn("_from", at(F.col(lon) - wide)).withColumn("_to", F.least(at(F.col(lon) + wide), F.col("_from") + F.col("_parts") - 1))
    spread = sized.withColumn("_part", F.explode(F.sequence("_from", "_to"))).withColumn("_part", F.pmod("_part", "_parts"))
    return spread.drop("_reach", "_size", "_parts", "_from", "_to")
