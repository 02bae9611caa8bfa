"""Repeated passages by sparse suffix arrays.

Texts are sequences of words. Of all suffixes only those are retained that
begin at a minimiser: the smallest run of words in a window, which depends on
the content alone, so that equal passages retain the same suffixes. Of texts
that are equal as a whole one takes part.

The retained suffixes are sorted by their first words over the whole corpus and
neighbours are compared word by word; a suffix that begins like none of another
document can't lie in a repeat. The sort is by range of all columns, so that
the suffixes of a passage that many documents share are dealt to many tasks.

The others are extended: to the left by as many words as a minimiser can be
away from the start of a passage, to the right up to the length of a passage.
A neighbour in the array has the longest common part to the right, but another
suffix further off may have the longer one to the left. So that nothing
is lost every start is compared, by a hash of 128 bits of the words of a
passage's length from there, and matches that touch or overlap join to spans.

With windows of WINDOW runs of RUN words, any MIN_WORDS words in a row hold a
minimiser within their first WINDOW words, so no repeat of that length is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.llm.common import bounded, discard, free_name, kept, lean, stored

MIN_WORDS = 50
RUN = 8
WINDOW = 35
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD = re.compile(rb"[^ \t\n\r\x0b\x0c]+")


class Rolling:
    """Hashes of runs of words of one text, of 128 bits in two halves."""

    def __init__(self, body: bytes) -> None:
        self.words = body.split()
        self.n = len(self.words)
        h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.words)), "<u8").reshape(-1, 2)
        powers = self._powers(_BASE)[:, None]
        self._sums = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(h * powers, axis=0, dtype=np.uint64)])
        self._back = self._powers(_INVERSE)

    def _powers(self, base: np.uint64) -> np.ndarray:
        out = np.full(self.n, base)
        out[:1] = 1
        return np.cumprod(out, dtype=np.uint64)

    def runs(self, length: int, at: np.ndarray | None = None, half: int = 0) -> np.ndarray:
        """Half a hash of the runs of ``length`` words that begin at ``at``, by default everywhere."""
        at = np.arange(max(0, self.n - length + 1)) if at is None else at
        x = (self._sums[at + length, half] - self._sums[at, half]) * self._back[at]
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ x >> np.uint64(29)


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick(x[:-step], x[step:])
        done += step
    return x


def minimisers(text: Rolling, run: int = RUN, window: int = WINDOW) -> np.ndarray:
    """Places of runs that are the smallest of some window; of ties, all."""
    g = text.runs(run)
    if len(g) < window:
        return np.zeros(0, np.int64)
    least = _slide(g, window, np.minimum)
    pad = np.zeros(window - 1, np.uint64)
    reached = _slide(np.concatenate([pad, least, pad]), window, np.maximum)
    return np.flatnonzero(reached == g)


def _bodies(column: pa.Array) -> list[bytes]:
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def _mark(body: bytes) -> int:
    """Tells the texts of rows that share a doc_id from each other."""
    return int(np.uint32(xxhash.xxh3_64_intdigest(body) & 0xFFFFFFFF).view(np.int32))


def long_texts(rows: DataFrame, least: int) -> DataFrame:
    """(doc_id, mark, t1, t2, n): the digest and the number of words of each text with ``least`` words or more."""

    @lean
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc_id, body in zip(batch.column(0).to_pylist(), _bodies(batch.column(1)), strict=True):
                n = len(body.split()) if len(body) >= 2 * least - 1 else 0
                if n >= least:
                    found.append((doc_id, _mark(body), *np.frombuffer(xxhash.xxh3_128_digest(body), "<i8").tolist(), n))
            columns = zip(*found, strict=True) if found else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "mark", "t1", "t2", "n"])

    return rows.mapInArrow(digest, "doc_id long, mark int, t1 long, t2 long, n int")


def suffixes(rows: DataFrame, least: int) -> DataFrame:
    """(start, doc_id, mark, at): the retained suffixes of the texts in (doc_id, text, skip), by their first words; texts whose mark is in ``skip`` are left out."""
    size = least - WINDOW + 1

    @lean
    def retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 200):
                part = batch.slice(first, 200)
                starts, ids, marks, ats = [], [], [], []
                for doc_id, body, skip in zip(part.column(0).to_pylist(), _bodies(part.column(1)), part.column(2).to_pylist(), strict=True):
                    mark = _mark(body)
                    if len(body) < 2 * least - 1 or mark in (skip or ()):
                        continue
                    text = Rolling(body)
                    if text.n < least:
                        continue
                    at = minimisers(text)
                    at = at[at + size <= text.n].tolist()
                    starts += [b" ".join(text.words[a : a + size]) for a in at]
                    ids += [doc_id] * len(at)
                    marks += [mark] * len(at)
                    ats += at
                yield pa.RecordBatch.from_arrays([pa.array(starts, pa.binary()), pa.array(ids, pa.int64()), pa.array(marks, pa.int32()), pa.array(ats, pa.int32())], ["start", "doc_id", "mark", "at"])

    return rows.mapInArrow(retain, "start binary, doc_id long, mark int, at int")


HIT, OPEN, EDGE = 0, 1, 2


def neighbours(suffix: DataFrame) -> DataFrame:
    """(doc_id, mark, at) of the sorted suffixes whose first words a neighbour of another document has.

    A task reads a range of the array. Suffixes that begin alike stand
    together, by doc_id, so that some two neighbours among them are of
    different documents if any two are: HIT. Where they are of one
    document and reach the border of a range they are OPEN; the first and the
    last row of those at a border are repeated as EDGE, for what is open next to it.
    """

    def stated(rows: pa.RecordBatch, state: int) -> pa.RecordBatch:
        start = pa.nulls(len(rows), pa.binary()) if state == HIT else rows.column(0)  # needed at borders alone
        return pa.RecordBatch.from_arrays([start, *rows.columns[1:], pa.array(np.full(len(rows), state, np.int8))], [*rows.schema.names, "state"])

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the run that is not yet at its end: rows, whether they are of several documents, the first and the last row
        held, several, head, tail = [], False, None, None
        outermost = True

        def close() -> Iterator[pa.RecordBatch]:
            if several or outermost:
                yield from (stated(r, HIT if several else OPEN) for r in held)
            if outermost:
                yield from (stated(r, EDGE) for r in (head, tail))

        for batch in batches:
            if not len(batch):
                continue
            start, doc = batch.column(0), batch.column(1)
            same, other = np.zeros(len(batch), bool), np.zeros(len(batch), bool)
            same[1:] = pc.equal(start[1:], start[:-1]).to_numpy(zero_copy_only=False)
            other[1:] = pc.not_equal(doc[1:], doc[:-1]).to_numpy(zero_copy_only=False)
            if tail is not None:
                same[0], other[0] = start[0] == tail.column(0)[0], doc[0] != tail.column(1)[0]
            differs, starts = same & other, np.flatnonzero(~same)
            if tail is None:  # the first run of the range is kept apart
                head, starts = batch.slice(0, 1), starts[1:]
            goes_on = int(starts[0]) if len(starts) else len(batch)
            if goes_on:
                held.append(batch.slice(0, goes_on))
                several = several or bool(differs[:goes_on].any())
                tail = batch.slice(goes_on - 1, 1)
                if several:
                    yield from (stated(r, HIT) for r in held)
                    held = []
            if len(starts):
                yield from close()
                outermost = False
                hit = np.repeat(np.logical_or.reduceat(differs, starts), np.diff([*starts, len(batch)]))
                last = int(starts[-1])
                yield stated(batch.slice(goes_on, last - goes_on).filter(pa.array(hit[: last - goes_on])), HIT)
                held, several, head, tail = [batch.slice(last)], bool(differs[last:].any()), batch.slice(last, 1), batch.slice(len(batch) - 1, 1)
        if tail is not None:
            outermost = True
            yield from close()

    dealt = suffix.repartitionByRange("start", "doc_id", "mark", "at").sortWithinPartitions("start", "doc_id", "mark", "at")
    seen = stored(dealt.mapInArrow(compare, "start binary, doc_id long, mark int, at int, state byte"))
    border = seen.where(F.col("state") != HIT)
    shared = border.groupBy("start").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("start")
    late = border.where(F.col("state") == OPEN).join(shared, "start", "left_semi")
    return seen.where(F.col("state") == HIT).select("doc_id", "mark", "at").unionByName(late.select("doc_id", "mark", "at"))


def extended(rows: DataFrame, shared: DataFrame, least: int) -> DataFrame:
    """(h1, h2, doc_id, mark, at): shared suffixes, extended to ``least`` words from every place at which a passage with them may begin."""
    by_doc = shared.groupBy("doc_id", "mark").agg(F.collect_list("at").alias("ats"))

    @lean
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 200):
                part = batch.slice(first, 200)
                found = []
                for doc_id, body, mark, ats in zip(part.column(0).to_pylist(), _bodies(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if _mark(body) != mark:
                        continue
                    text = Rolling(body)
                    reach = np.zeros(text.n + 1, np.int64)
                    ats = np.array(ats, np.int64)
                    np.add.at(reach, np.maximum(ats - WINDOW + 1, 0), 1)
                    np.add.at(reach, ats + 1, -1)
                    at = np.flatnonzero(np.cumsum(reach)[: max(0, text.n - least + 1)])
                    found.append((text.runs(least, at), text.runs(least, at, 1), np.full(len(at), doc_id), np.full(len(at), mark, np.int32), at.astype(np.int32)))
                if found:
                    h1, h2, ids, marks, at = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids), pa.array(marks), pa.array(at)], ["h1", "h2", "doc_id", "mark", "at"])

    met = rows.select("doc_id", "text").join(by_doc, "doc_id").select("doc_id", "text", "mark", "ats")
    return met.mapInArrow(extend, "h1 long, h2 long, doc_id long, mark int, at int")


def _spans(rows: DataFrame, least: int) -> DataFrame:
    """Spans of (doc_id, text) rows, with the mark of the text they are in; stored."""
    if least < WINDOW + RUN:
        raise ValueError(f"least must be at least {WINDOW + RUN}")
    texts = kept(long_texts(rows, least))
    same = texts.groupBy("t1", "t2").agg(F.min("doc_id").alias("lowest"), F.max("doc_id").alias("highest")).where("lowest < highest")
    copies = kept(texts.join(same, ["t1", "t2"]).select("doc_id", "mark", "n", (F.col("doc_id") == F.col("lowest")).alias("first")).distinct())
    later = kept(copies.where("not first").groupBy("doc_id").agg(F.collect_set("mark").alias("skip")))
    skipping = rows.join(bounded(later), "doc_id", "left").select("doc_id", "text", "skip")
    long = stored(extended(rows, neighbours(suffixes(skipping, least)), least))
    equal = long.groupBy("h1", "h2").agg(F.min("doc_id").alias("lowest"), F.max("doc_id").alias("highest")).where("lowest < highest").select("h1", "h2", "lowest")
    found = long.join(equal, ["h1", "h2"]).select("doc_id", "mark", "at", (F.col("doc_id") == F.col("lowest")).alias("first"))
    order = W.partitionBy("doc_id", "mark", "first").orderBy("at")
    opened = found.withColumn("new", F.coalesce(F.col("at") > F.lag("at").over(order) + least, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    spans = opened.groupBy("doc_id", "mark", "first", "span").agg(F.min("at").alias("start_word"), (F.max("at") + least).alias("end_word"))
    whole = copies.select("doc_id", "mark", F.lit(0).alias("start_word"), F.col("n").alias("end_word"), "first")
    out = spans.select("doc_id", "mark", "start_word", "end_word", "first").unionByName(whole)
    done = stored(out.select("doc_id", "mark", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first"))
    discard(texts, copies, later, long)
    return done


def repeated_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """Spans of ``least`` words or more that stand in several documents too: doc_id, start_word, end_word, n_words, first.

    Words end at ASCII white space and compare byte by byte; ``end_word`` is
    exclusive. ``first`` says that the document has the smallest doc_id of all
    in which the words of the span stand; spans of the two kinds may overlap
    where a document is the first for some words only. Documents with equal
    texts have one span over all, and of these only the first has others
    beside it. What a document repeats within itself alone
    doesn't count, and neither do shorter texts, null texts and rows with null
    doc_id. Rows that share a doc_id are one document, whatever their texts:
    what only they share doesn't count, and the spans of each text come out,
    those of equal rows once. Other columns are ignored; an empty table has no
    spans. Texts of any length are taken whole; a task holds the words of one.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    return _spans(rows, least).drop("mark")


def without_spans(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words of the spans and the white space after them."""
    words = [m.start() for m in _WORD.finditer(body)] + [len(body)]
    out, at = [], 0
    for start, end in sorted(spans):
        end = words[min(end, len(words) - 1)]
        out.append(body[at : max(at, words[min(start, len(words) - 1)])])
        at = max(at, end)
    return b"".join([*out, body[at:]])


def drop_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """``docs`` with each repeated passage left in its first document alone.

    Documents of which no word remains go; all others, null texts and null ids
    among them, stay, and texts without such a passage stay as they are. Of
    rows that share a doc_id each is cut by the spans of its own text, and
    equal ones alike. Columns keep their names, whatever they are; an empty
    table stays empty.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    cut_id, spans = free_name(docs, "cut_id"), free_name(docs, "cuts")
    cuts = _spans(rows, least).where("not first").groupBy(F.col("doc_id").alias(cut_id)).agg(F.collect_list(F.struct("mark", "start_word", "end_word")).alias(spans))

    @F.arrow_udf("string")
    @lean
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for bodies, lists in batches:
            out = []
            for body, every in zip(bodies.cast(pa.binary()).to_pylist(), lists.to_pylist(), strict=True):
                mark = None if body is None or not every else _mark(body)
                own = [(x["start_word"], x["end_word"]) for x in every or [] if x["mark"] == mark]
                out.append(None if body is None or not own else without_spans(body, own).decode("utf-8", "replace"))
            yield pa.array(out, pa.string())

    new = free_name(docs, "new_text")
    joined = docs.join(cuts, docs[doc_id] == cuts[cut_id], "left")
    held = joined.select(*(docs[c] for c in docs.columns), F.when(F.col(spans).isNotNull(), cut(docs[text].cast("string"), F.col(spans))).alias(new))
    kept = held.where(F.col(new).isNull() | F.col(new).rlike(r"\S"))
    return kept.select(*(F.coalesce(F.col(new), F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))


def op5_suffix_repeats(spark, sf_dir: str) -> DataFrame:
    from chronofold.llm.common import table

    return repeated_spans(table(spark, sf_dir, "documents"))


#: Every run of 50 words of every text; fit for tables of some thousand documents. Ids are unique there.
OP5_SQL = r"""
WITH t AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[ \t\n\r\x0b\x0c]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
c AS (SELECT text, any_value(w) AS w, min(doc_id) AS lo, max(doc_id) AS hi FROM t WHERE len(w) >= 50 GROUP BY text),
s AS (SELECT lo AS doc_id, w, unnest(range(len(w) - 49)) AS pos FROM c),
r AS (SELECT doc_id, pos, array_to_string(list_slice(w, pos + 1, pos + 50), ' ') AS run FROM s),
g AS (SELECT run, min(doc_id) AS lo FROM r GROUP BY run HAVING min(doc_id) < max(doc_id)),
f AS (SELECT doc_id, pos, doc_id = lo AS first FROM r JOIN g USING (run)),
o AS (SELECT *, CASE WHEN pos <= lag(pos) OVER x + 50 THEN 0 ELSE 1 END AS new FROM f WINDOW x AS (PARTITION BY doc_id, first ORDER BY pos)),
n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, first ORDER BY pos) AS span FROM o),
z AS (SELECT doc_id, CAST(min(pos) AS INTEGER) AS start_word, CAST(max(pos) + 50 AS INTEGER) AS end_word, first FROM n GROUP BY doc_id, first, span
  UNION ALL SELECT t.doc_id, 0, CAST(len(t.w) AS INTEGER), t.doc_id = c.lo FROM t JOIN c ON t.text = c.text WHERE c.lo < c.hi)
SELECT doc_id, start_word, end_word, end_word - start_word AS n_words, first FROM z
"""
