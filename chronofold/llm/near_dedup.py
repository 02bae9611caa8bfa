"""Near-duplicate detection with bottom-k sketches.

The shingles of a text go through one hash function; a text's sketch is the k
smallest values. Texts with the same set of shingles form a class, and only one
representative of each class takes part from there on.

Inverted lists of the retained values generate candidates. Similar texts share
most of their sketches, so a prefix of each sketch, in the order from the
rarest value of the corpus to the most frequent, suffices: two sketches with
the overlap that the threshold asks for have a value in common within their
prefixes. Candidates pass an estimate of the Jaccard similarity from the
sketch of the union; those that pass are verified on the full sets.

A long list isn't expanded into its pairs. First its members are linked to one of
them, the hub, and the links that hold make components; short lists yield all
their pairs. Pairs within a component need no further look. The members of long
lists that still hold several components are then compared by all of their shingles, which are the sketches
of largest k: the prefix and the place of the first common value bound the
overlap of a pair from above, so that few pairs remain to be verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.llm.common import bounded, discard, lean, stored

K = 64
#: Per cent by which an estimate may fall short of the similarity: six standard deviations for k = 64 at 80 per cent.
SLACK = 30
#: Lists up to this length yield all their pairs, a bounded number for each member.
SHORT = 16
#: Logarithm of the ratio of two neighbouring classes of sizes.
SIZE_STEP = math.log(1.02)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes, from 0 below 2**63, of all runs of ``width`` words, ascending; fewer words are one run, none give none.

    A-Z are lower-cased and words end at ASCII white space.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    n = max(1, len(h) - width + 1)
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for k in range(min(width, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
        out = out * np.uint64(0xC4CEB9FE1A85EC53) + np.uint64(k)
    return np.unique((out ^ out >> np.uint64(29)) >> np.uint64(1)).view(np.int64)


def sketches(docs: DataFrame, doc_id: str, text: str, width: int, k: int = K) -> DataFrame:
    """doc_id, n_shingles, two halves of a digest of the set, and the k smallest hashes in ascending order."""

    @lean
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                sets = [shingle_hashes(t.as_py(), width) for t in part.column(1)]
                digests = b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets)
                halves = np.frombuffer(digests, "<i8").reshape(-1, 2)
                kept = [s[:k] for s in sets]
                offsets = np.cumsum([0, *map(len, kept)]).astype(np.int32)
                values = np.concatenate(kept) if kept else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                    ["doc_id", "n_shingles", "d1", "d2", "sketch"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(sketch, "doc_id long, n_shingles long, d1 long, d2 long, sketch array<long>")


def sets_of(docs: DataFrame, doc_id: str, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """doc_id and the full set of shingle hashes of the (doc_id, d1, d2) in ``wanted``, for the rows whose set has that digest."""

    @F.arrow_udf("array<long>")
    @lean
    def full(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, d1, d2 in batches:
            sets = []
            for body, x, y in zip(texts, d1.to_pylist(), d2.to_pylist(), strict=True):
                s = shingle_hashes(body.as_py(), width)
                sets.append(s if np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8").tolist() == [x, y] else s[:0])
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.join(bounded(wanted), "doc_id").select("doc_id", full("text", "d1", "d2").alias("full")).where(F.size("full") > 0)


def similar(shared, n_a, n_b, percent: int):
    """100 * intersection >= percent * union, by the sizes of the intersection and the sets."""
    return (100 + percent) * shared >= percent * (n_a + n_b)


def sketch_lists(reps: DataFrame, k: int, percent: int) -> DataFrame:
    """(v, f, doc_id, n): the inverted lists of the rarest values of each sketch that have f > 1 members.

    Sets of fewer than percent * k / 100 shingles are shared whole with those
    that can be similar, and the overlap that the threshold asks for is exact.
    """
    values = reps.select("doc_id", F.col("n_shingles").cast("int").alias("n"), F.explode("sketch").alias("v"))
    frequency = values.groupBy("v").agg(F.count("*").alias("f")).where("f > 1")
    by_doc = W.partitionBy("doc_id")
    held = F.least(F.col("n"), F.lit(k))
    expected = -(-k * (percent - SLACK) // 100)
    overlap = F.when(F.col("n") * 100 < percent * k, F.ceil(F.col("n") * percent / 100)).otherwise(expected)
    shared = values.join(frequency, "v").withColumn("alone", held - F.count("*").over(by_doc)).withColumn("r", F.row_number().over(by_doc.orderBy("f", "v")))
    prefix = stored(shared.where(F.col("alone") + F.col("r") <= held - overlap + 1).select("v", "doc_id", "n"))
    lists = prefix.groupBy("v").agg(F.count("*").alias("f")).where("f > 1")
    return prefix.join(lists, "v").select("v", "f", "doc_id", "n")


def list_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) of sizes that allow the similarity: all pairs of short lists, those with the smallest id of long ones."""
    a = lists.where(f"f <= {SHORT}").select("v", F.col("doc_id").alias("a"), F.col("n").alias("n_a"))
    long = lists.where(f"f > {SHORT}")
    hubs = long.groupBy("v").agg(F.min("doc_id").alias("doc_id"))
    hub = long.join(hubs, ["v", "doc_id"]).select("v", F.col("doc_id").alias("a"), F.col("n").alias("n_a"))
    b = lists.select("v", F.col("doc_id").alias("b"), F.col("n").alias("n_b"))
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return a.unionByName(hub).join(b, "v").where((F.col("a") < F.col("b")) & sizes).select("a", "b").distinct()


def estimated(pairs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) for which the sketch of the union estimates the similarity, less a margin.

    The upper halves of the values do for an estimate: chance equality, which
    is rare, can only raise it.
    """
    short = reps.select("doc_id", F.transform("sketch", lambda v: F.shiftright(v, 32).cast("int")).alias("s"))
    both = pairs.join(short.select(F.col("doc_id").alias("b"), F.col("s").alias("y")), "b").join(short.select(F.col("doc_id").alias("a"), F.col("s").alias("x")), "a")
    union = F.slice(F.array_sort(F.array_union("x", "y")), 1, k)
    share = F.size(F.array_intersect(union, F.array_intersect("x", "y"))) / F.size(union)
    return both.where(100 * share >= percent - SLACK).select("a", "b")


def verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), a stored table, whose full sets are similar."""
    first = stored(pairs.select(F.col("a").alias("doc_id")).distinct())
    mine = full.join(bounded(first), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("full").alias("x"))
    other = full.select(F.col("doc_id").alias("b"), F.col("full").alias("y"))
    both = pairs.join(other, "b").join(mine, "a")
    return both.where(similar(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"), percent)).select("a", "b").distinct()


def open_members(lists: DataFrame, label: DataFrame) -> DataFrame:
    """(doc_id, label) of the members of long lists with several components."""
    labelled = lists.where(f"f > {SHORT}").join(label, "doc_id", "left").select("v", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    several = labelled.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("v")
    return labelled.join(several, "v", "left_semi").select("doc_id", "label").distinct()


def open_pairs(members: DataFrame, full: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """Pairs (a, b) of (doc_id, label) members with different labels that may be similar.

    All shingles of these documents are ranked from the rarest among them to
    the most frequent. Similar sets have their first common shingle within
    their prefixes, and what follows it bounds their overlap: the set of an
    entry that has ``u`` shingles from its place on can be similar to sets of
    at most ``most`` = (100 + percent) * u / percent - n shingles. Entries that
    no other of their list can go with are left out before anything is paired,
    and the others meet those of their range of sizes alone. For each shingle
    the component with most members isn't paired with itself. With ``every``
    the rows are all pairs that meet, for tests.
    """
    entries = full.join(members, "doc_id").select("doc_id", "label", F.size("full").alias("n"), F.explode("full").alias("h"))
    frequency = entries.groupBy("h").agg(F.count("*").alias("f")).where("f > 1")
    by_doc = W.partitionBy("doc_id")
    shared = entries.join(frequency, "h").withColumn("alone", F.col("n") - F.count("*").over(by_doc)).withColumn("at", F.col("alone") + F.row_number().over(by_doc.orderBy("f", "h")) - 1)
    most = F.floor((100 + percent) * (F.col("n") - F.col("at")) / percent - F.col("n"))
    prefix = stored(shared.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100)).select("h", "doc_id", "label", "n", most.cast("int").alias("most")))
    by_label = prefix.groupBy("h", "label").agg(F.count("*").alias("c"), F.min("n").alias("least_n"), F.max("most").alias("most"))
    lists = by_label.groupBy("h").agg(F.max(F.struct("c", "label")).alias("m"), F.count("*").alias("labels"), F.min("least_n").alias("least_n"), F.max("most").alias("largest_most")).where("labels > 1")
    alive = stored(prefix.join(lists.select("h", F.col("m.label").alias("largest"), "least_n", "largest_most"), "h").where("most >= least_n and n <= largest_most").drop("least_n", "largest_most"))
    discard(prefix)
    size_class = lambda n: F.floor(F.log(n.cast("double")) / F.lit(SIZE_STEP)).cast("int")
    n = F.col("n")
    low, high = F.ceil(n * percent / 100), F.least(F.col("most"), F.floor(n * 100 / percent))
    a = alive.where((F.col("label") != F.col("largest")) & (high >= low)).select("h", "largest", *(F.col(c).alias(f"{c}_a") for c in ("doc_id", "label", "n", "most")), F.explode(F.sequence(size_class(low), size_class(high))).alias("k"))
    b = alive.select("h", *(F.col(c).alias(f"{c}_b") for c in ("doc_id", "label", "n", "most")), size_class(n).alias("k"))
    once = (F.col("label_b") == F.col("largest")) | (F.col("doc_id_a") < F.col("doc_id_b"))
    met = a.join(b, ["h", "k"])
    if every:
        return met
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    met = met.where((F.col("label_a") != F.col("label_b")) & once & (F.col("n_b") <= F.col("most_a")) & (F.col("n_a") <= F.col("most_b")) & sizes)
    return met.select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of (a, b) edges: the smallest node that is reachable.

    Large and small stars in turn, so that the rounds grow with the logarithm
    of a component's width. They end when no edge changes.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            leaves = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
            return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        star = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))
        after = large.join(down, "a").select(F.explode(star).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after = stored(after)
        discard(now)
        now = after


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when their sets of distinct shingles of ``width``
    words have 100 * intersection >= percent * union; shingles are compared by
    hashes of 63 bits. ``component_id`` is the
    smallest doc_id of all that are reachable, ``kept`` says that it is the
    document's own.

    Null and empty texts, and texts of white space, have no shingles and no
    links. A row with a null doc_id takes no part: its component is null and it
    is kept. doc_id is meant to be unique; rows that repeat it each get the
    group of their own text, and groups with the same smallest id are one.
    Other columns are ignored. An empty table gives no rows. Texts of any length
    are taken whole; a task holds the set of one text.
    """
    sketched = stored(sketches(docs, doc_id, text, width, k))
    classes = sketched.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    seen = stored(sketched.drop("sketch").join(classes, ["d1", "d2"], "left").select("doc_id", "n_shingles", "d1", "d2", F.when(F.col("n_shingles") > 0, F.col("rep")).alias("rep")))
    owners = seen.where("doc_id = rep").select("doc_id", "d1", "d2").distinct()
    reps = stored(sketched.join(owners, ["doc_id", "d1", "d2"], "left_semi").dropDuplicates(["doc_id", "d1", "d2"]))
    lists = stored(sketch_lists(reps, k, percent))
    digests = lambda ids: stored(owners.join(ids, "doc_id", "left_semi"))
    near = stored(estimated(list_pairs(lists, percent), reps, k, percent))
    full = stored(sets_of(docs, doc_id, text, width, digests(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())))
    first = stored(components(verified(near, full, percent)))
    discard(sketched, reps, near, full)
    members = stored(open_members(lists, first.select(F.col("node").alias("doc_id"), F.col("component").alias("label"))))
    full = stored(sets_of(docs, doc_id, text, width, digests(members.select("doc_id"))))
    rest = verified(stored(open_pairs(members, full, percent)), full, percent)
    group = stored(components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest)))
    discard(lists, members, full, first)
    found = seen.join(group.withColumnRenamed("node", "rep"), "rep", "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep", "doc_id")).otherwise(F.col("doc_id"))
    out = found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1_near_duplicates(spark, sf_dir: str) -> DataFrame:
    from chronofold.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


#: All pairs of texts that share a shingle; fit for tables of some thousand documents.
OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) END)) AS s FROM d),
c AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
x AS (SELECT rep, n, unnest(s) AS x FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, a.n AS n, b.n AS m, count(*) AS k FROM x a JOIN x b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (n + m - k)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep AS node, rep AS seen FROM c UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen),
g AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(component, s.doc_id) AS component_id, coalesce(component, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN g ON g.node = c.rep
"""
