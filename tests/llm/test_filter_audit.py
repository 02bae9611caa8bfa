import itertools
import random
import re

import pytest

from chronofold.llm import filter_audit as fa

from .conftest import SCHEMA, prose


def plain(rows, labels):
    """Every order, step and document in turn."""
    texts = [(i, p or "", t or "") for i, t, p in rows]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, _, t in texts:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    docs = []
    for i, p, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        docs.append((i, p, {k for k, v in bad.items() if v}))
    out = {}
    for part in {p for _, p, _ in docs}:
        mine = [(i, bad) for i, p, bad in docs if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                hit = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(hit)
                failing = sum(f in bad for _, bad in mine)
                out[part, "".join(order), step] = [len(left), len(hit), failing - len(hit), sum(bad == {f} for _, bad in mine), sum(i in good for i, _ in hit), sum(i in toxic for i, _ in hit), f]
        for k in out:
            if k[0] == part:
                out[k][-1] = total[out[k][-1]]
    return {k: tuple(v) for k, v in out.items()}


def found(spark, docs, labels, **how):
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return {(r[0], r[1], r[2]): tuple(r)[3:] for r in fa.filter_audit(docs, said, **how).collect()}


LABELS = [(0, 1, 0), (5, 1, 1), (5, 0, 0), (6, None, 1), (7, 1, None), (None, 1, 1), (99, 1, 1), (10, 0, 1)]


def test_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text, r.lang) for r in odd_docs.collect()]
    got = found(spark, odd_docs, LABELS)
    assert got == plain(rows, LABELS)
    assert len(got) == 600 * len({p or "" for _, _, p in rows})


def test_every_mask_in_large_groups_of_copies(spark):
    rng = random.Random(4)
    texts = [prose(k, n) + end for k, (n, end) in enumerate(itertools.product((20, 150), ("", " #", " AB" * 99, " a" * 400)))] + ["", None]
    rows = [(rng.randrange(5000), texts[0] if rng.random() < 0.4 else rng.choice(texts), rng.choice(["en", "de", "", None]), "s", 1) for _ in range(3000)]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 5000, 3)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert found(spark, docs, labels) == plain([(r[0], r[1], r[2]) for r in rows], labels)


def test_no_rows(spark, no_docs):
    assert fa.filter_audit(no_docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


@pytest.mark.parametrize("held", [0, 2_000, 1 << 30])
def test_chains_tell_texts_of_one_fingerprint_apart(held):
    rng = random.Random(held)
    rows = [(rng.randrange(300), rng.choice(["en", "de"]), f"text {rng.randrange(40)}".encode()) for _ in range(900)]
    sent = [x for k in range(0, 900, 300) for x in fa.routed(rows[k : k + 300], len, held)]
    got = sorted((i, p, n) for i, p, mask, n in fa.settled(sorted(sent, key=lambda kv: kv[0])) if mask & 16)
    least = {}
    for i, _, t in rows:
        least[t] = min(i, least.get(t, i))
    want = sorted((i, p) for i, p, t in rows if i > least[t])
    assert sorted((i, p) for i, p, n in got for _ in range(n)) == want


def test_copies_settle_where_they_are_read():
    sent = list(fa.routed([(k, "en", b"same") for k in range(1000)]))
    assert sum(v[1] is not None for _, v in sent) == 1
    assert len({k[0] for k, _ in sent}) == 1000
