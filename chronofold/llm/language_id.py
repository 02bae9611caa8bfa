"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams, the most frequent
first. A text's own list is compared to each profile: an n-gram costs the
difference of its two ranks, or the length of the list where the profile lacks
it. The language with the smallest sum is the prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.llm.common import bounded, free_name, kept, lean

UNKNOWN = "und"


_OTHER = re.compile(r"[\W\d_]+")
_BITS = 21  # of a code point
#: Parts of a language's n-grams that are ranked apart before all of them are.
PARTS = 16


def grams(text: str) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams of a text: lower-cased, letters only, one space between words and at both ends."""
    clean = _OTHER.sub(" ", text.lower()).strip()
    if not clean.replace(" ", "").isalpha():  # numerals that aren't digits
        clean = " ".join("".join(c if c.isalpha() else " " for c in clean).split())
    if not clean:
        return np.zeros(0, np.uint64)
    x = np.frombuffer(f" {clean} ".encode("utf-32-le"), "<u4").astype(np.uint64)
    two = x[:-1] << np.uint64(_BITS) | x[1:]
    three = two[:-1] << np.uint64(_BITS) | x[2:]
    one = x[1:-1]
    return np.concatenate([one[one != 32], two, three])


def ranked(codes: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` codes of largest weight; ties go to the smaller code."""
    if len(codes) > most:
        least = -np.partition(-weights, most - 1)[most - 1]
        keep = weights >= least
        codes, weights = codes[keep], weights[keep]
    return codes[np.lexsort((codes, -weights))][:most]


class Profiles:
    """Profiles of all languages as one sorted table of (n-gram, rank by language)."""

    def __init__(self, by_lang: dict[str, np.ndarray], most: int) -> None:
        self.langs, self.most = sorted(by_lang), most
        self.codes = np.unique(np.concatenate([np.zeros(0, np.uint64), *by_lang.values()]))
        self.ranks = np.full((len(self.codes), len(self.langs)), -1, np.int32)
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, by_lang[lang]), j] = np.arange(len(by_lang[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and 1 - its distance / the largest possible; und and 0 without letters."""
        codes = grams(text or "")
        if not len(codes) or not len(self.codes):
            return UNKNOWN, 0.0
        mine = ranked(*np.unique(codes, return_counts=True), self.most)
        at = np.minimum(np.searchsorted(self.codes, mine), len(self.codes) - 1)
        ranks = self.ranks[at]
        known = (self.codes[at] == mine)[:, None] & (ranks >= 0)
        cost = np.where(known, np.abs(ranks - np.arange(len(mine))[:, None]), self.most).sum(0)
        best = int(cost.argmin())
        return self.langs[best], max(0.0, 1.0 - float(cost[best]) / (self.most * len(mine)))


def sample_of_each(rows: DataFrame, lang: str, key: str, per_lang: int) -> DataFrame:
    """(lang, key): up to ``per_lang`` rows of each language, those of smallest hash of the key.

    A language's rows are first thinned by their hashes to about twice as many
    as are asked for, so that no task ranks all rows of a frequent one.
    """
    h = F.xxhash64(key)
    share = F.col("n").cast("double")
    counts = bounded(kept(rows.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n"))))
    near = rows.select(lang, key, h.alias("h")).join(counts, F.col(lang) == F.col("l")).where((F.col("h") / F.lit(2.0**64) + 0.5) * share <= 2.0 * per_lang)
    return near.withColumn("r", F.row_number().over(W.partitionBy(lang).orderBy("h", key))).where(F.col("r") <= per_lang).select(lang, key)


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", most: int = 400, per_lang: int = 500) -> Profiles:
    """Profiles of all languages in column ``lang``.

    Learns every language there is, from a bounded sample: at most ``per_lang``
    rows with text and label of each, whichever have the smallest hashes of
    ``key``; of rows that share a key those with the smallest hashes of their
    text, also at most ``per_lang``. Each text has the same weight in a
    profile. The driver gets ``most`` n-grams of each language.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(lang).alias("lang"), F.col(key).alias("key"), F.col(text).alias("text"))
    chosen = bounded(kept(sample_of_each(labelled.select("lang", "key"), "lang", "key", per_lang).distinct()))
    order = W.partitionBy("lang").orderBy(F.xxhash64("key"), "key", F.xxhash64("text"))
    texts = labelled.join(chosen, ["lang", "key"], "left_semi").withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_lang).select("lang", "text")

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for name, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = grams(body)
                if len(codes):
                    codes, n = np.unique(codes, return_counts=True)
                    n = n / n.sum()
                    if name in total:
                        codes, back = np.unique(np.concatenate([total[name][0], codes]), return_inverse=True)
                        n = np.bincount(back, np.concatenate([total[name][1], n]))
                    total[name] = codes, n
        for name, (codes, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(n)], ["lang", "code", "weight"])

    summed = texts.mapInArrow(count, "lang string, code long, weight double").groupBy("lang", "code").agg(F.round(F.sum("weight"), 9).alias("weight"))
    best = [F.desc("weight"), "code"]
    part = F.pmod(F.xxhash64("code"), F.lit(PARTS))
    some = summed.withColumn("part", part).withColumn("r", F.row_number().over(W.partitionBy("lang", "part").orderBy(*best))).where(F.col("r") <= most)
    top = some.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(*best))).where(F.col("r") <= most)
    by_lang: dict[str, list[tuple[int, int]]] = {}
    for r in top.collect():
        by_lang.setdefault(r.lang, []).append((r.r, r.code))
    return Profiles({k: np.array([c for _, c in sorted(v)], np.uint64) for k, v in by_lang.items()}, most)


def identify(docs: DataFrame, profiles: Profiles, *, text: str = "text", lang_into: str = "lang_pred", score_into: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score, from 0 (no n-gram is known) to 1 (the profile's own order).

    The whole text counts. Null texts and texts without a letter get ``und``
    and 0, and so does everything if no profile was learned. Rows are neither
    merged nor dropped, ties go to the language that sorts first, and columns
    of the two names, in upper or lower case, are replaced.
    """

    @F.arrow_udf(f"{lang_into} string, {score_into} double")
    @lean
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [profiles.predict(t.as_py()) for t in batch]
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [lang_into, score_into])

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (lang_into.lower(), score_into.lower())]
    guess = free_name(docs, "guess")
    guessed = docs.select(*kept, predict(F.col(text).cast("string")).alias(guess))
    return guessed.select(*kept, f"{guess}.{lang_into}", f"{guess}.{score_into}")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    from chronofold.llm.common import table

    docs = table(spark, sf_dir, "documents")
    profiles = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
