"""How the sources of a language differ in their terms, from mergeable radix tries.

A task counts the terms of its documents, UNIT_BYTES of text at a time, and
puts them into one radix trie of bytes for each language. A leaf has a counter
for each source and the number of documents; the root's leaf counts the
documents themselves, so that sources without terms are known too. A task's
memory doesn't depend on what it reads.

A trie is traversed in the order of its bytes, which for UTF-8 is that of code
points. The leaves of all tries are dealt by ranges of this order and merged
there: sorted traversals run side by side, and equal terms become one leaf. Terms
in too few documents of their language end here. What is kept is numbered by
stretches of a bounded number of counters.

Each stretch is then traversed with the totals of its language. It adds to the
divergence of each pair of sources, one number for each pair, and keeps the best
candidates of each source: of equal ones the first in the traversal.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.llm.common import bounded, discard, lean, stored, table

SCALE_DIGITS = 3  # of base 1000: shares are in units of 1 / 1,000,000,000
MIN_DOCS = 3
TOP = 200
#: Bytes of texts that a task counts at a time.
UNIT_BYTES = 32 << 20
#: Counters of a stretch.
STRETCH = 200_000
#: Sources whose pairs with all others one task adds up.
BLOCK = 256
#: Cells of a stretch that are held as a matrix at a time.
CELLS = 1 << 20
#: Leaves that a task of the merge gets, more or less.
TASK_LEAVES = 500_000
_SPACED = bytes(32 if c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))

LEAF = "lang string, term binary, sources array<string>, counts array<long>, docs long"
OUT = "lang string, source string, part string, item string, value long"


class Node:
    __slots__ = ("children", "label", "value")

    def __init__(self, label: bytes) -> None:
        self.label = label
        self.children: dict[int, Node] | None = None
        self.value: int | None = None


class Trie:
    """A radix trie of byte strings; a leaf's value is the number of its counters."""

    def __init__(self) -> None:
        self.root = Node(b"")

    def put(self, term: bytes, value: int) -> None:
        node, at, n = self.root, 0, len(term)
        while at < n:
            if node.children is None:
                node.children = {}
            child = node.children.get(term[at])
            if child is None:
                node.children[term[at]] = child = Node(term[at:])
            elif not term.startswith(child.label, at):
                label = child.label
                same = 1
                while same < len(label) and at + same < n and label[same] == term[at + same]:
                    same += 1
                split = Node(label[:same])
                child.label = label[same:]
                split.children = {label[same]: child}
                node.children[term[at]] = child = split
            node, at = child, at + len(child.label)
        node.value = value

    def walk(self) -> Iterator[int]:
        """The values of the leaves in the order of the bytes of their terms."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.value is not None:
                yield node.value
            if node.children:
                stack.extend([node.children[b] for b in sorted(node.children, reverse=True)])

    def terms(self) -> Iterator[tuple[bytes, int]]:
        """The terms in the order of their bytes, with their values."""
        stack = [(b"", self.root)]
        while stack:
            before, node = stack.pop()
            term = before + node.label
            if node.value is not None:
                yield term, node.value
            if node.children:
                stack.extend((term, node.children[b]) for b in sorted(node.children, reverse=True))


def words_of(texts: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
    """The text's number and the word, A-Z lower-cased, of each word of some texts without nulls."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    spaced = np.take(np.frombuffer(_SPACED, np.uint8), body)
    lists = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(spaced)))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return owner[full.to_numpy(zero_copy_only=False)], flat.filter(full)


def unit_leaves(rows: pa.Table, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) rows as the leaves of one trie for each language, in its traversal."""
    lang, source = (rows[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
    of_lang, of_source = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (lang, source))
    n_sources = len(source.dictionary)
    parts = [words_of(chunk) for chunk in rows["text"].chunks]
    starts = np.cumsum([0, *(len(chunk) for chunk in rows["text"].chunks)])
    owner = np.concatenate([o + s for (o, _), s in zip(parts, starts)])
    words = pa.chunked_array([w for _, w in parts], pa.string()).combine_chunks().dictionary_encode()
    words = words if isinstance(words, pa.DictionaryArray) else words.combine_chunks()
    code, m = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(words.dictionary))
    cells, counts = np.unique((of_lang[owner] * m + code) * n_sources + of_source[owner], return_counts=True)
    pairs = np.sort(owner * m + code)
    doc, term = np.divmod(pairs[np.diff(pairs, prepend=-1) != 0], m)
    leaf, docs = np.unique(of_lang[doc] * m + term, return_counts=True)
    ends = np.searchsorted(cells // n_sources, np.arange(len(leaf) + 1) if not len(leaf) else np.append(leaf, leaf[-1] + 1))
    known, seen = np.unique(of_lang * n_sources + of_source, return_counts=True)
    terms = words.dictionary.cast(pa.binary())
    for k, name in enumerate(lang.dictionary.to_pylist()):
        own = known // n_sources == k
        yield _leaf_batch(name, pa.array([b""], pa.binary()), [0, int(own.sum())], source.dictionary.take(pa.array(known[own] % n_sources)), seen[own], [0])
        lo, hi = np.searchsorted(leaf, [k * m, (k + 1) * m])
        trie, held = Trie(), terms.take(pa.array(leaf[lo:hi] - k * m))
        for value, t in enumerate(held.to_pylist()):
            trie.put(t, value)
        order = np.fromiter(trie.walk(), np.int64, hi - lo)
        for at in range(0, hi - lo, size):
            some = order[at : at + size]
            begin, end = ends[lo + some], ends[lo + some + 1]
            length = end - begin
            upto = np.concatenate([[0], np.cumsum(length)])
            cell = np.arange(upto[-1]) + np.repeat(begin - upto[:-1], length)
            yield _leaf_batch(name, held.take(pa.array(some)), upto, source.dictionary.take(pa.array(cells[cell] % n_sources)), counts[cell], docs[lo + some])


def _leaf_batch(lang: str, terms: pa.Array, ends, sources: pa.Array, counts, docs) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (sources, pa.array(counts, pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), terms, *lists, pa.array(docs, pa.int64())], ["lang", "term", "sources", "counts", "docs"])


@lean
def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) as the leaves of tries."""
    gc.disable()  # tries have no cycles
    try:
        held, size = [], 0
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                held.append(part)
                size += pc.sum(pc.binary_length(part.column(2))).as_py()
                if size > UNIT_BYTES:
                    yield from unit_leaves(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield from unit_leaves(pa.Table.from_batches(held))
    finally:
        gc.enable()


def merged_rows(rows: pa.Table) -> pa.Table:
    """Sorted leaves with those of one language and term as one."""
    lang, term = rows["lang"].combine_chunks(), rows["term"].combine_chunks()
    new = np.ones(len(rows), bool)
    new[1:] = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(new)
    lists = rows["counts"].combine_chunks()
    owner = np.repeat(np.cumsum(new) - 1, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    names = rows["sources"].combine_chunks().flatten().dictionary_encode()
    key = owner * len(names.dictionary) + names.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(key, kind="stable")
    key, values = key[order], lists.flatten().to_numpy(zero_copy_only=False)[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    owner, code = np.divmod(key[first], max(1, len(names.dictionary)))
    ends = pa.array(np.searchsorted(owner, np.arange(len(starts) + 1)).astype(np.int32))
    kept = [names.dictionary.take(pa.array(code)), pa.array(np.add.reduceat(values, first) if len(first) else values)]
    docs = np.add.reduceat(rows["docs"].to_numpy(), starts)
    return pa.table([lang.take(pa.array(starts)), term.take(pa.array(starts)), *(pa.ListArray.from_arrays(ends, x) for x in kept), pa.array(docs)], names=["lang", "term", "sources", "counts", "docs"])


def merging(least: int):
    """Merges sorted leaves, drops terms of fewer than ``least`` documents and numbers stretches of what is kept."""

    @lean
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task, number, size = (context.partitionId() if context else 0) << 32, 0, 0
        open_rows = None

        def passed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal number, size
            rows = rows.filter(pc.or_(pc.greater_equal(rows["docs"], least), pc.equal(pc.binary_length(rows["term"]), 0)))
            for at in range(0, len(rows), 1000):
                part = rows.slice(at, 1000).combine_chunks()
                if size > STRETCH:
                    number, size = number + 1, 0
                size += len(part["counts"].combine_chunks().flatten())
                yield part.drop_columns(["docs"]).append_column("stretch", pa.array(np.full(len(part), task + number))).to_batches()[0]

        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch])
            if open_rows is not None:
                rows = pa.concat_tables([open_rows, rows.cast(open_rows.schema)])
            rows = merged_rows(rows)
            open_rows = rows.slice(len(rows) - 1)
            yield from passed(rows.slice(0, len(rows) - 1))
        if open_rows is not None:
            yield from passed(open_rows)

    return merge


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """floor(1000000000 * count / total) by long division, for totals below 9e15."""
    out, rest = np.divmod(count, total)
    for _ in range(SCALE_DIGITS):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def scored(top: int):
    """What a stretch adds to each pair of a block of sources with all others, and its best terms of these sources."""

    def score(leaves: pa.Table, heads: pa.Table) -> pa.Table:
        empty = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())]).empty_table()
        if not len(leaves) or not len(heads):
            return empty
        head = heads.slice(0, 1).to_pylist()[0]
        lang, names, mass, v = head["lang"], head["names"], np.array(head["mass"], np.int64), head["v"]
        lo = head["block"] * BLOCK
        mine = range(lo, min(lo + BLOCK, len(names)))
        leaves = leaves.sort_by("term").combine_chunks()
        lists = leaves["counts"].combine_chunks()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        values = lists.flatten().to_numpy(zero_copy_only=False)
        source = pc.index_in(leaves["sources"].combine_chunks().flatten(), pa.array(names, pa.string())).to_numpy(zero_copy_only=False)
        sums = np.zeros((len(mine), len(names)), np.int64)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in mine]
        step = max(1, CELLS // len(names))
        for at in range(0, len(leaves), step):
            n = min(step, len(leaves) - at)
            cells = slice(ends[at], ends[at + n])
            counts = np.zeros((n, len(names)), np.int64)
            counts[np.repeat(np.arange(n), np.diff(ends[at : at + n + 1])), source[cells]] = values[cells]
            p = 1 + share(counts + 1, mass + v)
            q = 1 + share(counts.sum(axis=1) + 1, mass.sum() + v)
            for k, g in enumerate(mine):
                own = np.ascontiguousarray(p[:, g])
                sums[k] += distance(own[:, None], p).sum(axis=0)
                over = np.flatnonzero((counts[:, g] > 0) & (own > q))
                f, place = np.concatenate([best[k][0], distance(own[over], q[over])]), np.concatenate([best[k][1], over + at])
                first = np.argsort(-f, kind="stable")[:top]  # of equal ones the earlier term stays first
                best[k] = f[first], place[first]
        pairs = [(names[g], names[h], int(sums[k, h])) for k, g in enumerate(mine) for h in range(len(names)) if g != h]
        kept = np.concatenate([b[1] for b in best])
        out = [
            pa.array([x[0] for x in pairs] + [names[g] for k, g in enumerate(mine) for _ in best[k][0]], pa.string()),
            pa.array(["pair"] * len(pairs) + ["term"] * len(kept), pa.string()),
            pa.chunked_array([pa.array([x[1] for x in pairs], pa.string()), leaves["term"].combine_chunks().take(pa.array(kept)).cast(pa.string())]),
            pa.chunked_array([pa.array([x[2] for x in pairs], pa.int64()), pa.array(np.concatenate([b[0] for b in best]), pa.int64())]),
        ]
        return pa.table([pa.array([lang] * len(out[0]), pa.string()), *out], schema=empty.schema)

    return score


def term_leaves(docs: DataFrame, text: str, lang: str, source: str, least: int) -> DataFrame:
    """(lang, term, sources, counts, stretch): the merged leaves of terms in ``least`` documents of their language; the term '' counts documents."""
    read = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]
    leaves = stored(docs.select(*read).mapInArrow(counted, LEAF))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), leaves.count() // TASK_LEAVES)
    ordered = leaves.repartitionByRange(tasks, "lang", "term").sortWithinPartitions("lang", "term")
    out = stored(ordered.mapInArrow(merging(least), "lang string, term binary, sources array<string>, counts array<long>, stretch long"))
    discard(leaves)
    return out


def binned(terms: DataFrame) -> DataFrame:
    """The terms with small stretches that follow each other as one: numbers of (lang, stretch) that have up to twice STRETCH counters."""
    sizes = terms.groupBy("lang", "stretch").agg(F.sum(F.size("counts")).alias("n"))
    upto = F.sum("n").over(W.partitionBy("lang").orderBy("stretch"))
    bins = stored(sizes.select("lang", "stretch", F.floor((upto - F.col("n")) / STRETCH).alias("bin")))
    return terms.join(bounded(bins), ["lang", "stretch"]).select("lang", "term", "sources", "counts", F.col("bin").alias("stretch"))


def totals(leaves: DataFrame) -> DataFrame:
    """(lang, v, names, mass): the number of a language's kept terms, its sources and the sum of each one's counts.

    A row holds the sources of a language; the result has their pairs.
    """
    each = leaves.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    mass = each.groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum(F.when(F.octet_length("term") > 0, F.col("x.counts")).otherwise(0)).alias("n"))
    lists = mass.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("g"))
    v = leaves.groupBy("lang").agg(F.count(F.when(F.octet_length("term") > 0, 1)).alias("v"))
    return lists.join(v, "lang").select("lang", "v", F.col("g.source").alias("names"), F.col("g.n").alias("mass"))


def source_divergence(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others of its language, and its characteristic terms.

    Terms are runs of letters and of code points beyond ASCII, A-Z lower-cased,
    in ``least`` documents of their language. A term's share in a source or a
    language is p = 1 + floor(10**9 * (count + 1) / (sum of counts + number of
    terms)), and f = floor((p - q)**2 / q).

    Part ``pair`` has a row for each other source of the language: the sum of f
    over all terms, with q of that source. Part ``term`` has the ``top`` terms
    that occur in the source and whose share is above the language's, q. Ranks
    go by value, then by item in UTF-8 order.

    Null texts, languages and sources are empty strings. A source without terms
    is in the pairs; a language without kept terms has pairs of value 0. Texts
    are taken whole, whatever their length. Other columns, and ids, are ignored:
    rows that repeat count again. An empty table gives no rows.
    """
    leaves = term_leaves(docs, text, lang, source, least)
    known = stored(totals(leaves))
    terms = binned(leaves.where(F.octet_length("term") > 0))
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))).alias("block")
    heads = terms.select("lang", "stretch").distinct().join(known, "lang").select(*(F.col(c).alias(c) for c in ("lang", "stretch", "v", "names", "mass")), blocks(F.size("names")))
    wide = known.where(F.size("names") > BLOCK).select("lang", F.size("names").alias("n"))
    dealt = terms.join(bounded(wide), "lang", "left").select(*(F.col(c).alias(c) for c in terms.columns), blocks(F.coalesce("n", F.lit(1))))
    key = ["lang", "stretch", "block"]
    made = stored(dealt.groupBy(*key).cogroup(heads.groupBy(*key)).applyInArrow(scored(top), OUT))
    group = ["lang", "source"]
    none = known.where("v = 0").select("lang", F.explode("names").alias("source"), "names").select(*group, F.lit("pair").alias("part"), F.explode("names").alias("item"), F.lit(0).cast("long").alias("value")).where("source <> item")
    pairs = made.where("part = 'pair'").groupBy(*group, "part", "item").agg(F.sum("value").alias("value")).unionByName(none)
    best = W.partitionBy(*group).orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(best))
    return ranked.unionByName(made.where("part = 'term'").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT lang, source, sum(n) AS m FROM x GROUP BY ALL),
p AS (SELECT lang, source, term, n, 1 + CAST(1000000000 AS HUGEINT) * (n + 1) // CAST(m + v AS HUGEINT) AS p FROM x JOIN s USING (lang, source) JOIN v USING (lang)),
l AS (SELECT lang, term, sum(n) AS n FROM x GROUP BY ALL),
t AS (SELECT lang, sum(m) AS m FROM s GROUP BY ALL),
q AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (n + 1) // CAST(m + v AS HUGEINT) AS q FROM l JOIN t USING (lang) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 200
"""
