"""What the operators share: table access and the shared folder.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``. They cut the lineage, so a lost executor costs the
tasks it ran and not the stages before the written table.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: What separates words where a word is letters, digits and all beyond ASCII.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a temporary folder; on a cluster
    there is no safe choice, so it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or _own.get("dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own["dir"] = "file://" + tempfile.mkdtemp(prefix="chronofold-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


_own: dict[str, str] = {}


#: Bytes, as held, of a file that :func:`stored` writes: one task's work.
FILE_BYTES = 32 << 20


def kept(df: DataFrame) -> DataFrame:
    """``df``, computed once and held on the executors' disks; what a lost one held is computed again."""
    out = df.persist(StorageLevel.DISK_ONLY)
    out.count()
    _made[-1].append(out)
    return out


def held_bytes(df: DataFrame) -> int:
    """The size of what :func:`kept` holds."""
    return int(df._jdf.queryExecution().withCachedData().stats().sizeInBytes())


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder and read again, in files of about FILE_BYTES or more."""
    spark = df.sparkSession
    path = shared_dir(spark)
    held = kept(df)
    held.coalesce(max(1, -(-held_bytes(held) // FILE_BYTES))).write.option("compression", "zstd").parquet(path)
    discard(held)
    out = spark.read.schema(df.schema).parquet(path)
    out._chronofold_path = path
    _made[-1].append(out)
    return out


#: What :func:`stored` and :func:`kept` made and nothing has discarded yet, a list for each :func:`lasting` that is under way.
_made: list[list[DataFrame]] = [[]]


def discard(*tables: DataFrame) -> None:
    """Drop what :func:`stored` wrote or :func:`kept` holds, once nothing reads it any more."""
    for df in tables:
        if hasattr(df, "_chronofold_path"):
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df._chronofold_path)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        else:
            df.unpersist()
        for made in _made:
            made[:] = [x for x in made if x is not df]


def lasting(make: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``make``, stored, without the intermediate tables that it went through."""
    _made.append([])
    try:
        out = stored(make())
        _made[-1] = [x for x in _made[-1] if x is not out]
        discard(*_made[-1])
    finally:
        _made.pop()
    _made[-1].append(out)
    return out


#: Rows of three longs or fewer that are broadcast, counted; more are joined by a shuffle.
BROADCAST_ROWS = 400_000


def bounded(rows: DataFrame) -> DataFrame:
    """``rows``, a stored table of few columns, to be broadcast if they are few enough; otherwise joins shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


#: Keys that can each have more than a HOT_KEYS-th of all rows; so there are fewer of them.
HOT_KEYS = 20_000


def with_own(rows: DataFrame, own: DataFrame, key: list[str], count: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``own``, a stored aggregate of theirs: a row for each key, ``count`` of which says how many rows it has.

    A join with an aggregate on its own key has no skew that Spark would split.
    So keys with more than a HOT_KEYS-th of all rows go by a broadcast of their
    aggregates, of which there are fewer than HOT_KEYS, and their rows aren't dealt by key.
    """
    limit = (own.agg(F.sum(count)).first()[0] or 0) // HOT_KEYS
    hot = own.where(F.col(count) > F.lit(max(limit, 1000)))
    if not hot.head(1):
        return rows.join(own, key, how)
    values = [c for c in own.columns if c not in key]
    marked = rows.join(F.broadcast(hot.select(*key, F.struct(*values).alias("_own"))), key, "left")
    split = [marked.where("_own is not null").select(*rows.columns, *(F.col(f"_own.{c}") for c in values))]
    rest = marked.where("_own is null").drop("_own").join(own, key, how)
    return rest.unionByName(split[0].select(*rest.columns))


def ascii_lower(text):
    """Lower-case A-Z alone. Texts of ASCII only take the fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def alnum_words(text):
    """Words of letters, digits and code points beyond ASCII; none for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_ALNUM), lambda w: w != "")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lean(run: Callable) -> Callable:
    """An Arrow function that gives freed memory back to the system when its task ends.

    Spark keeps Python workers for later tasks. What the allocators of idle
    workers hold counts against the executor, while it may run something else.
    """

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped
