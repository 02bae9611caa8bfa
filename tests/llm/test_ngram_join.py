import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.llm import common
from chronofold.llm import ngram_join as nj

from .brute import near_groups
from .conftest import SCHEMA, prose


def groups(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def edited(text: str, seed: int, share: float) -> str:
    rng = random.Random(seed)
    return " ".join(f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="module")
def copies():
    """Near copies around the threshold, chains of them, exact copies, short texts and passages that many share."""
    rows = []
    passage = prose(99, 40)
    for k in range(24):
        base = prose(k, 60 + 20 * (k % 9)) + (" " + passage if k % 2 else "")
        rows += [base, base, base.upper(), edited(base, k, 0.004), edited(base, k + 500, 0.02), edited(base, k + 900, 0.05)]
        rows.append(edited(rows[-3], k + 70, 0.02))
    rows += [passage, passage + " end", "one", "One", "one two", "one two three", "one two three four", "", " \t", None]
    random.Random(3).shuffle(rows)
    return list(enumerate(rows))


def test_groups_equal_those_of_all_pairs(spark, copies):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in copies], SCHEMA).repartition(5)
    assert groups(nj.ngram_join(docs)) == near_groups(copies, 3, 90)
    assert groups(nj.ngram_join(docs, width=2, percent=70)) == near_groups(copies, 2, 70)


def test_long_lists_are_linked_by_hubs_and_lose_nothing(spark):
    base = prose(7, 300)
    rows = [edited(base, k, 0.006 * (k % 3)) for k in range(120)] + [base + " " + prose(k, 290) for k in range(30)] + [prose(k, 30) + " " + prose(1000, 12) for k in range(60)]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    assert groups(nj.ngram_join(docs)) == near_groups(rows, 3, 90)


def test_odd_rows(spark, odd_docs):
    got = nj.ngram_join(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r.component_id is None for r in got if r.doc_id is None)
    by_id = {r.doc_id: r.component_id for r in got if r.doc_id not in (None, 7)}
    assert by_id == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 8: 8, 9: 9, 10: 10}


def test_no_rows(spark, no_docs):
    assert nj.ngram_join(no_docs).collect() == []


def test_similar_sets_meet_under_each_order_whatever_the_counts(spark, monkeypatch):
    monkeypatch.setattr(nj, "BUCKET_BITS", 12)
    rng = np.random.default_rng(5)
    shares = []
    for seed in range(300):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 1 << 62, n))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.97], rng.integers(0, 1 << 62, int(rng.integers(0, 12)))]))
        classes = np.random.default_rng(seed).integers(0, 256, 1 << 12, np.uint8)
        shared = len(np.intersect1d(x, y))
        if len(y) and 100 * shared >= 90 * (len(x) + len(y) - shared):
            both = [len(np.intersect1d(nj.prefix(x, k, classes, 90), nj.prefix(y, k, classes, 90))) for k in range(nj.ORDERS)]
            assert both[0] >= 1
            shares.append((len(x), len(y), min(both[1:])))
    least = spark.createDataFrame(shares, "a int, b int, n int").withColumn("least", nj.least_common(F.col("a"), F.col("b"), 90))
    assert least.where("n < least").count() == 0 and least.where("least > 10").count() > 20 and len(shares) > 100


def test_orders_drop_what_one_order_lets_pass(spark):
    """Texts with one common passage: fewer pairs meet under all orders than under the first."""
    passage = prose(1, 7)
    docs = spark.createDataFrame([(k, prose(k + 10, 280 + k) + " " + passage, "en", "s", 0) for k in range(30)], SCHEMA)
    classes = np.zeros(1 << nj.BUCKET_BITS, np.uint8)
    reps = nj.prefixes(docs, "doc_id", "text", 3, 90, classes).cache()
    pairs = nj.candidates(nj.inverted_lists(reps), 90)
    assert nj.agreeing(pairs, reps, 90).count() < pairs.count()


def test_parities_drop_pairs_by_chance_before_their_prefixes_meet(spark):
    """Sets around powers of two that are similar all stay, also those whose parities have two lengths; of sets with a few shingles in common hardly any does."""
    rng = np.random.default_rng(8)
    sets, like, chance = [], [], []
    for n in [1, 3, 20, 63, 127, 128, 130, 255, 260, 500, 514, 1030, 4000] * 4:
        x = np.unique(rng.integers(0, 1 << 62, n))
        y = np.unique(np.concatenate([x[int(n * rng.choice([0, 0.02, 0.05])) :], rng.integers(0, 1 << 62, int(n * rng.choice([0, 0.02, 0.05])))]))
        z = np.unique(np.concatenate([x[: 1 + n // 20], rng.integers(0, 1 << 62, n - 1 - n // 20)]))
        shared = len(np.intersect1d(x, y))
        if 100 * shared >= 90 * (len(x) + len(y) - shared):
            like.append((len(sets), len(sets) + 1))
        if n >= 20:
            chance.append((len(sets), len(sets) + 2))
        sets += [x, y, z]
    reps = spark.createDataFrame([(k, len(x), nj.parity(x).tolist()) for k, x in enumerate(sets)], "doc_id long, n_shingles long, parity array<long>").cache()
    kept = {tuple(r) for r in nj.of_like_parity(spark.createDataFrame(like + chance, "a long, b long"), reps, 90).collect()}
    lengths = {(len(nj.parity(sets[a])), len(nj.parity(sets[b]))) for a, b in like}
    assert set(like) <= kept and len(like) > 30 and any(u != v for u, v in lengths)
    assert len(kept & set(chance)) <= 2 and len(chance) > 40


def test_counters_put_frequent_shingles_last(spark):
    line = prose(1, 10)
    docs = spark.createDataFrame([(k, line + " " + prose(k + 10, 30), "en", "s", 0) for k in range(300)], SCHEMA)
    classes = nj.frequency_classes(docs, "text", 3)
    common_ones = nj.shingle_hashes(line, 3)
    own = nj.shingle_hashes(prose(11, 30), 3)
    assert classes[nj.buckets(common_ones)].min() > classes[nj.buckets(own)].max() == 0


def test_hot_keys_are_not_dealt_by_key(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") % 500).alias("k"), F.col("id").alias("x")).cache()
    own = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("x").alias("least")).cache()
    joined = common.with_own(rows, own, ["k"], "n")
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, rows.join(own, "k").collect()))
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
