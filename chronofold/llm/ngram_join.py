"""Jaccard self-join of shingle sets by prefixes under several global orders.

A set's prefix under an order of all shingles is as much of its beginning as two
similar sets can't both do without: of n shingles n - need + 1, where need is
the least overlap that the threshold asks for. That holds under any order, so
similar sets have a shingle in common in their prefixes under each of them. The
first order gives candidates by inverted lists; those whose prefixes under the
other orders have too little in common are dropped; the rest are verified on
full sets. Before prefixes meet, which are long, parities do, see :func:`parity`. Chance that brings two prefixes together under one order is
independent of chance under the next. The prefixes of the other orders are
EXTENT times as long, and the longer a prefix, the more of it similar sets share.

Each order goes from rare shingles to frequent ones. How frequent a shingle is
comes from a table of counters whose size doesn't depend on the corpus: those of
a bucket that stands out of the others' noise come last, by the logarithm of its
count; a shingle with a few times 1 / BUCKETS of all occurrences does. Shingles
of one class follow the order's own hash. Whatever the counts, an order is the
same for all documents, and so exact; better counts only make better filters.

Documents with the same set are a class, and one of each takes part. Lists of up
to SHORT members yield the pairs of sizes that allow the similarity. Longer ones
are not expanded: members are linked to their list's smallest, and members that
are still in several components are compared on full sets by ranges of what
each place of a prefix allows, see :func:`near_dedup.open_pairs`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import discard, kept, lean, stored, table, with_own
from chronofold.llm.near_dedup import components, open_pairs, sets_of, shingle_hashes, verified

ORDERS = 3
#: How many times as long the prefixes under the orders that filter are.
EXTENT = 2
BUCKET_BITS = 23
#: Lists up to this length yield their pairs, a bounded number for each member.
SHORT = 64
#: Blocks of the table that are added up apart.
BLOCKS = 64
#: Classes of frequency for each doubling of a count.
STEPS = 4
#: Different sets that a task remembers in order to count copies once.
SEEN = 500_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def buckets(values: np.ndarray) -> np.ndarray:
    return values & np.int64((1 << BUCKET_BITS) - 1)


def mixed(values: np.ndarray, order: int) -> np.ndarray:
    """The hash that an order goes by within a class, a bijection of 64 bits."""
    x = values.view(np.uint64) * _MIX[order]
    x ^= x >> np.uint64(31)
    return x * _MIX[order]


def frequency_classes(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """A class of frequency, a byte, for each bucket, from the shingles of all documents: 0 up to the noise of a bucket."""

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int32)
        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, len(batch), 500):
                fresh = []
                for body in batch.column(0).slice(at, 500):
                    values = shingle_hashes(body.as_py(), width)
                    digest = xxhash.xxh3_64_digest(values.tobytes())
                    if digest not in seen:
                        fresh.append(values)
                        if len(seen) < SEEN:
                            seen.add(digest)
                if fresh:
                    np.add.at(counts, buckets(np.concatenate(fresh)), 1)
        pack = zstandard.ZstdCompressor(level=1).compress
        small = np.minimum(counts, 255).astype(np.uint8)  # in one task
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([pack(p.tobytes()) for p in small.reshape(BLOCKS, -1)], pa.binary())], ["block", "counts"])

    def wide(x: bytes | np.ndarray) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).astype(np.int64) if isinstance(x, bytes) else x

    def classed(packed: bytes | np.ndarray) -> tuple[int, bytes]:
        counts = wide(packed)
        return int(counts.sum()), np.minimum(255, np.log2(1.0 + counts) * STEPS).astype(np.uint8).tobytes()

    made = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "block int, counts binary")
    merged = made.rdd.map(lambda r: (r[0], bytes(r[1]))).reduceByKey(lambda a, b: wide(a) + wide(b)).mapValues(classed).collectAsMap()
    if not merged:
        return np.zeros(1 << BUCKET_BITS, np.uint8)
    mean = sum(n for n, _ in merged.values()) / (1 << BUCKET_BITS)
    noise = int(np.log2(1 + mean + 4 * mean**0.5 + 4) * STEPS)
    classes = np.frombuffer(b"".join(merged[k][1] for k in range(BLOCKS)), np.uint8)
    return np.where(classes <= noise, 0, classes).astype(np.uint8)


def prefix(values: np.ndarray, order: int, classes: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a set's prefix under an order; those of orders that filter are EXTENT times as long."""
    n = len(values)
    length = (n - -(-n * percent // 100) + 1) * (EXTENT if order else 1)
    if length >= n:
        return values
    key = classes[buckets(values)].astype(np.uint64) << np.uint64(56) | mixed(values, order) >> np.uint64(8)
    return values[np.argpartition(key, length - 1)[:length]]


def parity(values: np.ndarray) -> np.ndarray:
    """For each of some buckets whether a set has an odd number of shingles there: half a bit a shingle or a bit, 64 at least, in longs.

    Sets differ by as many shingles as their parities do by bits, or more. A set
    of buckets half as large is the exclusive or of the halves.
    """
    bits = 64
    while bits * 2 < len(values):
        bits *= 2
    odd = np.bincount(values >> np.int64(32) & np.int64(bits - 1), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def prefixes(docs: DataFrame, doc_id: str, text: str, width: int, percent: int, classes: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, two halves of the set's digest, p0: the prefix under the first order, p1, p2: 32 bits of each shingle of the others, and the set's parity.

    The prefixes and the parity are null where the task has seen the same set under a smaller id.
    """
    held = docs.sparkSession.sparkContext.broadcast(classes)

    @lean
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, int] = {}
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                digests, sizes = [], []
                out: list[list[np.ndarray | None]] = [[] for _ in range(ORDERS)]
                odd: list[np.ndarray | None] = []
                for doc, body in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    values = shingle_hashes(body.as_py(), width)
                    digest = xxhash.xxh3_128_digest(values.tobytes())
                    digests.append(digest)
                    sizes.append(len(values))
                    again = doc is None or not len(values) or least.get(digest, doc + 1) <= doc
                    if not again and (len(least) < SEEN or digest in least):
                        least[digest] = doc
                    for k in range(ORDERS):
                        own = None if again else prefix(values, k, held.value, percent)
                        out[k].append(own if k == 0 or again else np.unique((own >> np.int64(31)).astype(np.int32)))
                    odd.append(None if again else parity(values))
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), *(_lists(x, np.int32 if k else np.int64) for k, x in enumerate(out)), _lists(odd, np.int64)],
                    ["doc_id", "n_shingles", "d1", "d2", *(f"p{k}" for k in range(ORDERS)), "parity"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(make, "doc_id long, n_shingles long, d1 long, d2 long, p0 array<long>, p1 array<int>, p2 array<int>, parity array<long>")


def _lists(arrays: list[np.ndarray | None], kind) -> pa.ListArray:
    """Arrays as lists, None as null."""
    ends = np.cumsum([0, *(0 if a is None else len(a) for a in arrays)]).astype(np.int32)
    values = np.concatenate([np.zeros(0, kind), *(a for a in arrays if a is not None)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array([a is None for a in arrays]))


def inverted_lists(reps: DataFrame) -> DataFrame:
    """(v, f, doc_id, n): the lists of more than one member under the first order, each row with its list's length."""
    entries = reps.select(F.explode("p0").alias("v"), "doc_id", F.col("n_shingles").cast("int").alias("n"))
    return with_own(entries, stored(entries.groupBy("v").agg(F.count("*").alias("f")).where("f > 1")), ["v"], "f")


def candidates(lists: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) of sizes that allow the similarity: all pairs of short lists, those with the smallest member of long ones."""
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    long = lists.where(f"f > {SHORT}")
    hubs = long.groupBy("v").agg(F.count("*").alias("f"), F.min(F.struct("doc_id", "n")).alias("h"))
    star = with_own(long.drop("f"), stored(hubs.select("v", "f", F.col("h.doc_id").alias("hub"), F.col("h.n").alias("hub_n"))), ["v"], "f")
    star = star.where((F.col("hub") < F.col("doc_id")) & fits(F.col("hub_n"), F.col("n"))).select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))
    short = lists.where(f"f <= {SHORT}").groupBy("v").agg(F.sort_array(F.collect_list(F.struct("doc_id", "n"))).alias("m"))
    one = short.select("m", F.posexplode("m").alias("at", "x"))
    after = F.filter(F.slice("m", F.col("at") + 2, SHORT), lambda y: (y["doc_id"] > F.col("x.doc_id")) & fits(F.col("x.n"), y["n"]))
    both = one.select("x", F.explode(after).alias("y"))
    return star.unionByName(both.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))).distinct()


def open_members(lists: DataFrame, label: DataFrame) -> DataFrame:
    """(doc_id, label) of the members of long lists with several components."""
    long = lists.where(f"f > {SHORT}").join(label, "doc_id", "left").select("v", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    several = stored(long.groupBy("v").agg(F.count("*").alias("f"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("v", "f"))
    return with_own(long, several, ["v"], "f").select("doc_id", "label").distinct()


def least_common(n_a: Column, n_b: Column, percent: int) -> Column:
    """How many shingles prefixes of similar sets under one order share at least, by the sizes of the sets.

    Similar sets have an overlap o, and m = n - o shingles of each aren't in the
    other. A common shingle at rank r of a has at most rank r + m_b in b, so of
    the first shingles of a all but m_a are in the prefix of b, as far as
    m_b from its end.
    """
    length = lambda n: F.least(n, (n - F.ceil(n * percent / 100) + 1) * EXTENT)
    o = F.ceil((n_a + n_b) * percent / (100 + percent))
    m_a, m_b = n_a - o, n_b - o
    return F.greatest(F.lit(1), F.least(length(n_a), length(n_b) - m_b) - m_a, F.least(length(n_b), length(n_a) - m_a) - m_b)


def of_like_parity(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose parities differ by no more bits than similar sets of their sizes do by shingles."""
    side = lambda name: reps.select(F.col("doc_id").alias(name), F.col("n_shingles").alias(f"{name}_n"), F.col("parity").alias(f"{name}_odd"))
    half = lambda x, other: F.when(F.size(x) > F.size(other), F.zip_with(F.slice(x, 1, F.size(other)), F.slice(x, F.size(other) + 1, F.size(other)), lambda u, v: u.bitwiseXOR(v))).otherwise(F.col(x))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    most = F.col("a_n") + F.col("b_n") - 2 * F.ceil((F.col("a_n") + F.col("b_n")) * percent / (100 + percent))
    bits = F.zip_with(half("a_odd", "b_odd"), half("b_odd", "a_odd"), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    alike = F.greatest(F.size("a_odd"), F.size("b_odd")) <= 2 * F.least(F.size("a_odd"), F.size("b_odd"))
    return both.where(~alike | (F.aggregate(bits, F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0))) <= most)).select("a", "b")


def agreeing(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of like parity whose prefixes share enough under each of the other orders."""
    pairs = of_like_parity(pairs, reps, percent)
    others = [f"p{k}" for k in range(1, ORDERS)]
    side = lambda name: reps.select(F.col("doc_id").alias(name), F.col("n_shingles").alias(f"{name}_n"), *(F.col(p).alias(f"{name}_{p}") for p in others))
    both = pairs.join(side("b"), "b").join(side("a"), "a").withColumn("least", least_common(F.col("a_n"), F.col("b_n"), percent))
    full = lambda x: F.least(F.col(f"{x}_n"), (F.col(f"{x}_n") - F.ceil(F.col(f"{x}_n") * percent / 100) + 1) * EXTENT)
    for p in others:
        alike = full("a") - F.size(f"a_{p}") + full("b") - F.size(f"b_{p}")  # shingles of a set that 32 bits don't tell apart
        both = both.where(F.size(F.array_intersect(f"a_{p}", f"b_{p}")) >= F.col("least") - alike)
    return both.select("a", "b")


def dealt_by_id(rows: DataFrame) -> DataFrame:
    """Rows held by their doc_id: joins on it deal the other side alone."""
    return kept(rows.repartition("doc_id"))


def ngram_join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id.

    Documents are linked when their sets of distinct shingles of ``width``
    words have 100 * intersection >= percent * union; fewer words are one
    shingle. Shingles are compared by hashes of 63 bits, places in an order by
    64. ``component_id`` is the smallest doc_id of all that are reachable.

    Null and empty texts, and texts of white space, have no shingles and no
    links. Texts are taken whole, whatever their length. A row with a null
    doc_id takes no part and has a null component. doc_id is meant to be
    unique; rows that repeat it each get the group of their own text, and
    groups with the same smallest id are one. Other columns are ignored,
    whatever their names. An empty table gives no rows.
    """
    made = stored(prefixes(docs, doc_id, text, width, percent, frequency_classes(docs, text, width)))
    classes = made.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_docs"))
    rows = made.select("doc_id", "n_shingles", "d1", "d2")
    named = with_own(rows.where("n_shingles > 0"), stored(classes), ["d1", "d2"], "n_docs", "left").select(*rows.columns, "rep")
    seen = stored(named.unionByName(rows.where("n_shingles = 0").withColumn("rep", F.lit(None).cast("long"))))
    owners = seen.where("doc_id = rep").select("doc_id", "d1", "d2").distinct()
    own = owners.groupBy("doc_id").agg(F.collect_list(F.struct("d1", "d2")).alias("own"))
    whole = made.where("p0 is not null").repartition("doc_id").join(own, "doc_id").where(F.array_contains("own", F.struct("d1", "d2")))
    reps = kept(whole.drop("own").dropDuplicates(["doc_id", "d1", "d2"]))
    lists = stored(inverted_lists(reps))
    digests = lambda ids: stored(owners.join(ids, "doc_id", "left_semi"))
    near = stored(agreeing(candidates(lists, percent), reps, percent))
    full = dealt_by_id(sets_of(docs, doc_id, text, width, digests(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())))
    first = stored(components(verified(near, full, percent)))
    discard(near, full)
    members = stored(open_members(lists, first.select(F.col("node").alias("doc_id"), F.col("component").alias("label"))))
    discard(lists)
    group = first
    if members.head(1):
        full = dealt_by_id(sets_of(docs, doc_id, text, width, digests(members.select("doc_id"))))
        rest = verified(stored(agreeing(open_pairs(members, full, percent), reps, percent)), full, percent)
        group = stored(components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest)))
    discard(made, reps)
    found = seen.join(group.withColumnRenamed("node", "rep"), "rep", "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep", "doc_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def op13_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


#: All pairs of texts that share a shingle; fit for tables of some thousand documents.
OP13_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN w WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) END)) AS s FROM d),
c AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
x AS (SELECT rep, n, unnest(s) AS x FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, a.n AS n, b.n AS m, count(*) AS k FROM x a JOIN x b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * k >= 90 * (n + m - k)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep AS node, rep AS seen FROM c UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen),
g AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(component, s.doc_id) AS component_id FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN g ON g.node = c.rep
"""
