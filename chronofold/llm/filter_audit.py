"""Interaction audit of an ordered chain of document filters.

Each document gets a mask of the filters that it fails. Four of them look at the
text alone. The fifth asks whether a smaller id has the same text anywhere in
the table: for that, texts go to partitions by a fingerprint and are sorted
there by fingerprint and id, so that a task holds the collision chain of one
fingerprint at a time: its different texts in full, with the smallest id of
each. Every other id of a text fails.

A group of copies of any size stays small on its way. The task that reads them
keeps one entry for each text, its smallest id, and settles the others at once;
what is routed is one text for each text and reading task, and the documents
that are settled travel without a text, spread by their ids.

What the filters do in any order is a function of how many documents have which
mask. Vectors of these counts are merged by part; from 32 masks come the rows of
all 120 orders.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import stored, table

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
_COPY = 1 << FILTERS.index("E")
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_MARKS = re.compile(rb"[#$%&*|]")
#: Bytes of texts that a reading task holds before it passes on what it has.
HELD_BYTES = 48 << 20
#: Documents that a task of the route gets, more or less: its share of the texts is sorted, on disk where it is large.
TASK_ROWS = 50_000

OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(body: bytes) -> int:
    """The filters A to D that a text fails, as bits."""
    words = body.split()
    n = len(words)
    points = len(body) if body.isascii() else len(body.decode())
    capitals = len(body) - len(body.translate(None, _UPPER))
    return (n < 100) | (100 * len(set(words)) < 80 * n) << 1 | (100 * capitals > 10 * points) << 2 | (_MARKS.search(body) is not None) << 3


def fingerprint(body: bytes) -> int:
    return xxhash.xxh3_64_intdigest(body)


class Chains:
    """Texts by fingerprint, each with its smallest id and how many rows of each part have that id."""

    def __init__(self, digest=fingerprint) -> None:
        self.digest = digest
        self.held: dict[int, list[list]] = {}
        self.bytes = 0
        self.pack = zstandard.ZstdCompressor(level=1, write_checksum=False).compress

    def add(self, doc_id: int, part: str, body: bytes) -> list[tuple[int, str, int, int]]:
        """Take a row; returned is what it settles, as (id, part, mask, rows): ids that aren't the smallest of their text."""
        chain = self.held.setdefault(self.digest(body), [])
        packed = self.pack(body)
        entry = next((e for e in chain if e[0] == packed), None)
        if entry is None:
            chain.append([packed, doc_id, Counter([part]), text_mask(body)])
            self.bytes += len(packed) + 500
            return []
        _, least, parts, mask = entry
        if doc_id > least:
            return [(doc_id, part, mask | _COPY, 1)]
        if doc_id == least:
            parts[part] += 1
            return []
        entry[1:3] = doc_id, Counter([part])
        return [(least, p, mask | _COPY, n) for p, n in parts.items()]

    def drain(self) -> Iterator[tuple]:
        """All entries, as records that still have their text, and none left."""
        for f, chain in self.held.items():
            for packed, least, parts, mask in chain:
                for part, n in parts.items():
                    yield (f, least), (least, packed, part, mask, n)
        self.held, self.bytes = {}, 0


def routed(rows: Iterable[tuple], digest=fingerprint, held_bytes: int = HELD_BYTES) -> Iterator[tuple]:
    """What a reading task sends: ((key, id), (id, packed text or None, part, mask, rows)); what has no text is settled."""
    chains = Chains(digest)
    without_id: Counter = Counter()
    for doc_id, part, text in rows:
        body = bytes(text or b"")
        if doc_id is None:
            without_id[part, text_mask(body)] += 1
            continue
        for done, *rest in chains.add(doc_id, part, body):
            yield (xxhash.xxh3_64_intdigest(str(done)), done), (done, None, *rest)
        if chains.bytes > held_bytes:
            yield from chains.drain()
    yield from chains.drain()
    for (part, mask), n in without_id.items():
        yield (xxhash.xxh3_64_intdigest(part), 0), (None, None, part, mask, n)


def settled(records: Iterable[tuple]) -> Iterator[tuple[int | None, str, int, int]]:
    """(id, part, mask, rows) of records sorted by key and id: the first id of each text in a chain is its smallest."""
    now, chain = None, {}
    for (f, _), (doc_id, packed, part, mask, n) in records:
        if packed is None:
            yield doc_id, part, mask, n
            continue
        if f != now:
            now, chain = f, {}
        yield doc_id, part, mask | (_COPY if doc_id > chain.setdefault(packed, doc_id) else 0), n


def masks(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "lang", digest=fingerprint) -> DataFrame:
    """(doc_id, part, mask, n): which filters documents fail, in bits from A; n is 1 but for rows that share id, part and text.

    A null text is empty, a null part the empty string. A row with a null id has
    no smaller id, and is none. Rows of one id and one text aren't copies of
    each other. Whole texts are compared, of any length. Other columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long"), F.coalesce(F.col(part).cast("string"), F.lit("")), F.col(text).cast("string").cast("binary"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // TASK_ROWS)
    sent = rows.rdd.mapPartitions(lambda x: routed(x, digest)).repartitionAndSortWithinPartitions(tasks, lambda key: key[0])
    return spark.createDataFrame(sent.mapPartitions(settled), "doc_id long, part string, mask int, n long", verifySchema=False)


def _order_rows() -> list[tuple[str, int, int, np.ndarray]]:
    """(order, step, bit of its filter, masks with an earlier filter) for all orders."""
    every = np.arange(MASKS)
    out = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            out.append(("".join(order), step, bit, every & before != 0))
            before |= bit
    return out


def audit_rows(part: str, counts: np.ndarray, orders: list) -> Iterator[tuple]:
    """The rows of a part from its counts of documents, good ones and toxic ones by mask."""
    every = np.arange(MASKS)
    total: Counter = Counter()
    rows = []
    for order, step, bit, early in orders:
        fails = every & bit != 0
        here = fails & ~early
        removed, good, toxic = (int(x) for x in counts[:, here].sum(axis=1))
        total[bit] += removed
        rows.append((order, step, bit, int(counts[0, ~(early | fails)].sum()), removed, int(counts[0, fails & early].sum()), int(counts[0, bit]), good, toxic))
    for order, step, bit, *values in rows:
        yield part, order, step, *values, total[bit]


def filter_audit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """A row for each part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Parts, texts and ids are read as :func:`masks` does. ``labels`` has doc_id,
    quality and toxic; a document is good (toxic) if any label of its id has
    quality (toxic) 1, and neither without a label or an id. An empty table of
    documents has no parts and gives no rows.
    """
    spark = docs.sparkSession
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c) for c in ("quality", "toxic")))
    rows = stored(masks(docs, doc_id=doc_id, text=text, part=part)).join(said, "doc_id", "left").select("part", "mask", "n", F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0)))

    def start(row: tuple) -> np.ndarray:
        return add(np.zeros((3, MASKS), np.int64), row)

    def add(counts: np.ndarray, row: tuple) -> np.ndarray:
        mask, n, good, toxic = row
        counts[:, mask] += (n, n * good, n * toxic)
        return counts

    orders = _order_rows()
    merged = rows.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(start, add, lambda a, b: a + b)
    return spark.createDataFrame(merged.flatMap(lambda kv: audit_rows(*kv, orders)), OUT, verifySchema=False)


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, doc_id > min(doc_id) OVER (PARTITION BY t) AS copy FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, concat(CASE WHEN len(w) < 100 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END, CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN copy THEN 'E' ELSE '' END) AS fails FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS early FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
g AS (SELECT part, filter_order, step, x, n, good, toxic, contains(fails, x) AS hit, fails = x AS only_x, translate(fails, early, '') <> fails AS gone FROM c, s),
r AS (SELECT part, filter_order, step, x, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN only_x THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM g GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r
"""
