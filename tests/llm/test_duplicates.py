"""Near-duplicates and repeated passages against brute force."""

import pytest

from chronofold.llm import near_dedup, suffix_dedup
from tests.llm import brute
from tests.llm.conftest import SCHEMA, SF, prose


def texts_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_of_a_table(spark, width):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute.near_groups(texts_of(docs), width)
    got = near_dedup.op1_near_duplicates(spark, SF) if width == 2 else near_dedup.near_duplicates(docs, width=width)
    rows = got.collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_a_large_group_with_members_that_miss_the_hub(spark):
    import random

    rng, base = random.Random(5), prose(9, 90).split()
    rows = []
    for k in range(120):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 8, 10])):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 10**6)}"
        rows.append((k, " ".join(w), "en", "s", 1))
    rows += [(1000 + k, prose(100 + k, 60) + " " + prose(7, 30), "en", "s", 1) for k in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = brute.near_groups([(r[0], r[1]) for r in rows], 2)
    got = near_dedup.near_duplicates(docs, width=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_templates_are_not_compared_pair_by_pair(spark):
    """Pages with a common frame that are too different: what is paired grows with their number and not with its square."""
    import random

    frame = prose(1, 87).split()
    pairs = []
    for n in (300, 600, 1200):
        rng = random.Random(n)
        rows = [(k, " ".join([*(f"own{k}x{j}" if rng.random() < 0.7 else f"pool{rng.randrange(60)}" for j in range(rng.randint(19, 24))), *frame]), "en", "s", 1) for k in range(n)]
        docs = spark.createDataFrame(rows, SCHEMA)
        sketched = near_dedup.sketches(docs, "doc_id", "text", 2).select("doc_id", "d1", "d2", near_dedup.F.col("doc_id").alias("label")).cache()
        full = near_dedup.sets_of(docs, "doc_id", "text", 2, sketched.select("doc_id", "d1", "d2"))
        pairs.append(near_dedup.open_pairs(sketched.select("doc_id", "label"), full, 80, every=True).count())
    assert pairs[2] <= 12 * 1200 and pairs[2] <= 5 * max(pairs[0], 100), pairs
    want = brute.near_groups([(r[0], r[1]) for r in rows[:300]], 2)
    got = near_dedup.near_duplicates(docs.where("doc_id < 300"), width=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    rows = near_dedup.near_duplicates(odd_docs, width=2).collect()
    assert len(rows) == 15
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by_id[1] == [(119, 0, False)] and by_id[0] == [(119, 0, True)] * 2
    assert by_id[2] == [(0, 2, True)] and by_id[4] == [(0, 4, True)]
    assert by_id[6][0][1:] == (5, False) and all(x[1] is None and x[2] for x in by_id[None])
    assert sorted(by_id[7]) == [(1, 7, True), (1, 7, True)]
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95)]
    out = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {k: 0 for k in range(41)} | {90: 90, 95: 90, 100: 90}


def test_repeats_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    every, later = brute.repeats(texts_of(docs))
    rows = suffix_dedup.op5_suffix_repeats(spark, SF).collect()
    assert brute.covered(rows) == every
    assert brute.covered(r for r in rows if not r.first) == later
    assert all(r.n_words == r.end_word - r.start_word >= 50 for r in rows)


def test_planted_passages(spark):
    passage = prose(77, 50)
    rows = [(k, f"{prose(200 + k, k * 7)} {passage} {prose(300 + k, 60 - k * 7)}", "en", "s", 1) for k in range(8)]
    rows += [(50, prose(900, 300), "en", "s", 1), (51, " ".join(passage.split()[:49]), "en", "s", 1), (52, f"{prose(5, 55)} {prose(5, 55)}", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.start_word, r.end_word, r.first) for r in suffix_dedup.repeated_spans(docs).collect()}
    assert got == {(k, k * 7, k * 7 + 50, k == 0) for k in range(8)}
    cut = {r.doc_id: r.text for r in suffix_dedup.drop_repeats(docs).collect()}
    assert cut[0] == rows[0][1] and cut[50] == rows[8][1] and cut[52] == rows[10][1]
    assert cut[3].split() == f"{prose(203, 21)} {prose(303, 39)}".split()


def test_rows_that_share_an_id_are_cut_by_their_own_spans(spark):
    passage = prose(77, 60)
    rows = [(1, f"{passage} {prose(1, 30)}", "en", "s", 1), (2, f"{prose(2, 40)} {passage}", "en", "s", 1), (2, f"{passage} {prose(3, 40)}", "en", "s", 1), (2, prose(4, 150), "en", "s", 1), (3, f"{prose(5, 60)} {prose(6, 20)}", "en", "s", 1), (3, f"{prose(5, 60)} {prose(7, 20)}", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id, r.start_word, r.end_word, r.first) for r in suffix_dedup.repeated_spans(docs).collect())
    assert got == [(1, 0, 60, True), (2, 0, 60, False), (2, 40, 100, False)]
    cut = sorted((r.doc_id, " ".join(r.text.split())) for r in suffix_dedup.drop_repeats(docs).collect())
    assert cut == sorted([(1, rows[0][1]), (2, prose(2, 40)), (2, prose(3, 40)), (2, rows[3][1]), (3, rows[4][1]), (3, rows[5][1])])


@pytest.mark.parametrize(("partitions", "batch"), [(1, 10_000), (1, 3), (7, 10_000), (7, 5), (40, 10_000), (40, 2)])
def test_neighbours_across_the_borders_of_ranges(spark, partitions, batch):
    """Every suffix whose first words another document has, and no other, wherever the array is cut."""
    import random

    rng = random.Random(partitions)
    rows = [(bytes([97 + rng.choice([0, 0, 0, 0, rng.randrange(26)])]), rng.randrange(6), 0, k) for k in range(300)] + [(b"zz", 3, 0, k) for k in range(50)] + [(b"zzz", 4, 0, 1)]
    docs = {}
    for start, doc, _, _ in rows:
        docs.setdefault(start, set()).add(doc)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = suffix_dedup.neighbours(spark.createDataFrame(rows, "start binary, doc_id long, mark int, at int")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(tuple(r) for r in got) == sorted((d, m, a) for start, d, m, a in rows if len(docs[start]) > 1)


def test_a_neighbour_with_the_longer_end_hides_no_repeat(spark):
    """Of three suffixes the middle one of the array shares less to the left than the outer two share with each other."""
    rows = []
    for k in range(12):
        a, right = prose(500 + k, 35), prose(600 + k, 40)
        tails = sorted(prose(700 + 10 * k + j, 30) for j in range(3))
        rows += [(10 * k, f"{a} {right} {tails[0]}", "en", "s", 1), (10 * k + 1, f"{prose(800 + k, 35)} {right} {tails[1]}", "en", "s", 1), (10 * k + 2, f"{a} {right} {tails[2]}", "en", "s", 1)]
    got = brute.covered(suffix_dedup.repeated_spans(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == {i: x for i, x in brute.repeats([(r[0], r[1]) for r in rows])[0].items() if x}


def test_repeats_of_odd_rows(odd_docs, no_docs):
    rows = suffix_dedup.repeated_spans(odd_docs).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.first) for r in rows} == {(0, 0, 120, True), (1, 0, 120, False), (5, 0, 30_000, True), (6, 0, 30_000, False)}
    out = suffix_dedup.drop_repeats(odd_docs)
    assert out.columns == odd_docs.columns
    kept = [(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()]
    assert (6, "end") in kept and 1 not in {d for d, _ in kept} and len(kept) == 14
    assert suffix_dedup.repeated_spans(no_docs).count() == 0 and suffix_dedup.drop_repeats(no_docs).count() == 0


@pytest.mark.parametrize("name", ["op1_near_duplicates", "op5_suffix_repeats"])
def test_rows_of_the_sql(spark, name):
    import duckdb

    from chronofold.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    out = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name]).select(*out.columns).fetchall()
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
