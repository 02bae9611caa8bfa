"""Benchmark decontamination by a positional inverted index, in SQL functions.

Each window of an item has a rarest word, its pivot. The index stores the
postings (document, position) of the pivots over the whole corpus; a posting,
moved back by the pivot's place in the item, is where the item would stand.
There the neighbouring words are intersected with the item's, outwards from
the pivot. Runs of a window's length are exact phrase matches; the share of
equal words around the pivot gives proximity matches.

The lists of the other words aren't read one by one: the index keeps the words
around a posting beside it, which are the entries of those lists that can meet
it. Lists of their own would have the benchmark's frequent words too, which is
most of the corpus, shuffled by document and position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.llm.common import alnum_words, discard, kept, stored

#: Item windows are broadcast up to this size, measured; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def item_places(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """A row for each word of an item, with up to ``window`` - 1 words on either side."""
    words = items.select(F.col(item_id).alias("item_id"), alnum_words(F.col(text).cast("string")).alias("words")).where(F.size("words") > 0).distinct()
    placed = words.select("item_id", F.xxhash64("words").alias("version"), "words", F.posexplode("words").alias("place", "term"))
    first = F.greatest(F.col("place") - (window - 1), F.lit(0))
    return placed.select(
        "item_id",
        "version",
        "place",
        "term",
        F.size("words").alias("n"),
        F.slice("words", first + 1, F.col("place") - first).alias("before"),
        F.slice("words", F.col("place") + 2, F.lit(window - 1)).alias("after"),
    )


def pivots(places: DataFrame, frequency: DataFrame, window: int) -> DataFrame:
    """The places that hold the rarest word of some window; ties go to the word, then to the first place."""
    span = F.least(F.col("n"), F.lit(window))
    starts = F.sequence(F.greatest(F.col("place") - span + 1, F.lit(0)), F.least(F.col("place"), F.col("n") - span))
    covered = places.join(frequency, "term", "left").select("*", F.explode(starts).alias("start"))
    order = W.partitionBy("item_id", "version", "start").orderBy(F.coalesce("f", F.lit(0)), "term", "place")
    rarest = covered.withColumn("r", F.row_number().over(order)).where("r = 1 and f is not null")
    return rarest.select("item_id", "place", "term", "n", "before", "after").distinct()


def _run(mine: Column, theirs: Column) -> Column:
    """How many leading elements two arrays have in common."""
    n = F.least(F.size(mine), F.size(theirs))
    differs = F.filter(F.sequence(F.lit(0), n), lambda k: (k == n) | (F.get(mine, k) != F.get(theirs, k)))
    return F.get(differs, F.lit(0))


def _equal(mine: Column, theirs: Column) -> Column:
    return F.size(F.filter(F.arrays_zip(mine.alias("a"), theirs.alias("b")), lambda x: x["a"] == x["b"]))


def matches(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, near: float = 0.7) -> DataFrame:
    """Rows (doc_id, n_words, item_id, first, last, exact): where items occur in documents.

    Exact rows: the words first..last of the document stand in the item in a
    row and include a window of ``window`` words, or all of an item of fewer.
    Other rows are proximity matches: around a pivot, at least ``near`` of the
    item's words (up to a window's length on either side) stand at their
    places, but no window does. Each document has one row more, with null
    item_id, first, last and exact, that carries its number of words.

    Null and empty texts have no words. Rows that share a doc_id yield the rows
    of each; a null id is an id like others. Items may repeat, and versions of
    one item_id are searched as they stand. Other columns are ignored; empty
    tables give the rows of the other side, if any, without matches.
    """
    words = docs.select(F.col(doc_id).alias("doc_id"), alnum_words(F.col(text).cast("string")).alias("words"))
    places = kept(item_places(items, item_id, item_text, window))
    size = places.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    small = F.broadcast if size <= BROADCAST_BYTES else (lambda df: df)
    frequency = words.select(F.explode("words").alias("term")).join(small(places.select("term").distinct()), "term").groupBy("term").agg(F.count("*").alias("f"))
    chosen = kept(pivots(places, frequency, window))
    # No word is empty: an empty term before the words keeps a row of each
    # document. The index holds a posting's neighbours and never all words, so
    # that a long text's postings don't carry the text each.
    wanted = chosen.select("term").distinct().unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term")))
    postings = words.select("doc_id", "words", F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("place", "term")).join(small(wanted), "term")
    at = F.col("place") - 1
    start = F.greatest(at - (window - 1), F.lit(0))
    index = stored(
        postings.select(
            "doc_id",
            "term",
            at.alias("at"),
            F.size("words").cast("long").alias("n_words"),
            F.slice("words", start + 1, F.greatest(at, F.lit(0)) - start).alias("their_before"),
            F.slice("words", at + 2, F.when(at < 0, 0).otherwise(window - 1)).alias("their_after"),
        )
    )
    discard(places)
    aligned = index.join(small(chosen), "term").select("doc_id", "item_id", "n", "at", "n_words", F.reverse("before").alias("before"), "after", F.reverse("their_before").alias("their_before"), "their_after")
    met = aligned.select(
        "doc_id",
        "item_id",
        "n",
        "at",
        "n_words",
        (1 + F.size("before") + F.size("after")).alias("around"),
        _run(F.col("before"), F.col("their_before")).alias("l"),
        _run(F.col("after"), F.col("their_after")).alias("r"),
        (1 + _equal(F.col("before"), F.col("their_before")) + _equal(F.col("after"), F.col("their_after"))).alias("equal"),
    )
    exact = F.col("l") + F.col("r") + 1 >= F.least(F.col("n"), F.lit(window))
    matched = met.withColumn("exact", exact).where(F.col("exact") | (F.col("equal") >= near * F.col("around")))
    hits = matched.select("doc_id", "n_words", "item_id", (F.col("at") - F.col("l")).alias("first"), (F.col("at") + F.col("r")).alias("last"), "exact")
    return hits.unionByName(index.where("term = ''").select("doc_id", "n_words"), allowMissingColumns=True)


def contamination(found: DataFrame) -> DataFrame:
    """Sum up :func:`matches` by document.

    Rows: doc_id, n_words, hits (disjoint word spans, ascending), n_hit, items
    (ids as strings, sorted), near_items. Rows that share a doc_id count as one
    document that has the words of the longest and the hits of all.
    """
    hit, item = F.col("exact"), F.col("item_id").cast("string")
    rows = found.select("doc_id", "n_words", F.when(hit, F.col("first")).alias("first"), F.when(hit, F.col("last")).alias("last"), F.when(hit, item).alias("item"), F.when(~hit, item).alias("near_item"))
    order = W.partitionBy("doc_id").orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = F.col("first").isNotNull() & (reached.isNull() | (F.col("first") > reached + 1))
    spans = rows.withColumn("opens", opens.cast("int")).withColumn("span", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    by_span = spans.groupBy("doc_id", "span").agg(F.max("n_words").alias("n_words"), F.min("first").alias("first"), F.max("last").alias("last"), F.collect_set("item").alias("items"), F.collect_set("near_item").alias("near_items"))
    together = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    by_doc = by_span.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_list(F.when(F.col("first").isNotNull(), F.struct("first", "last")))).alias("hits"),
        F.coalesce(F.sum(F.col("last") - F.col("first") + 1), F.lit(0)).cast("long").alias("n_hit"),
        together("items"),
        together("near_items"),
    )
    return by_doc.select("doc_id", "n_words", "items", F.array_except("near_items", "items").alias("near_items"), "hits", "n_hit")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    from chronofold.llm.common import table

    out = contamination(matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
dp AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS p FROM d), ip AS (SELECT item_id, len(w) AS m, unnest(w) AS x, unnest(range(len(w))) AS p FROM i),
dg AS (SELECT doc_id, p, list(x) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS g FROM dp),
ig AS (SELECT item_id, least(m, 10) AS n, list(x) OVER (PARTITION BY item_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS g FROM ip),
iw AS (SELECT DISTINCT item_id, n, array_to_string(g, ' ') AS g FROM ig WHERE len(g) = n),
dw AS (SELECT doc_id, p, n, array_to_string(list_slice(g, 1, n), ' ') AS g FROM dg, (SELECT DISTINCT n FROM iw) WHERE len(g) >= n),
h AS (SELECT doc_id, p, iw.n, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
