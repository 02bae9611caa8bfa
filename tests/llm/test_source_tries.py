import collections
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from chronofold.llm import source_tries as st

from .conftest import prose

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "text string, lang string, source string"


def plain(rows, top=200, least=3):
    """(lang, source, part, item, value, rank) by whole tables of counts."""
    rows = [((t or "").translate(UPPER), g or "", s or "") for t, g, s in rows]
    out = []
    for lang in {g for _, g, _ in rows}:
        mine = [(TERM.findall(t), s) for t, g, s in rows if g == lang]
        docs = collections.Counter(w for t, _ in mine for w in set(t))
        kept = [w for w, n in docs.items() if n >= least]
        counts = {s: collections.Counter(w for t, x in mine for w in t if x == s) for _, s in mine}
        counts[None] = collections.Counter(w for t, _ in mine for w in t)
        mass = {s: sum(c[w] for w in kept) for s, c in counts.items()}
        p = {s: {w: 1 + 10**9 * (c[w] + 1) // (mass[s] + len(kept)) for w in kept} for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts.keys() - {None}:
            pairs = [(sum(f(p[s][w], p[h][w]) for w in kept), h) for h in counts if h not in (s, None)]
            terms = [(f(p[s][w], p[None][w]), w) for w in kept if counts[s][w] and p[s][w] > p[None][w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)] + ["naïve", "café", "日本語", "日本", "ÉTÉ", "été", "z", "za", "zab", "𝒳", "￮"]
    rows = []
    for _ in range(600):
        source = rng.choice(["s1", "s1", "s1", "s2", "s10", "é", None, ""])
        mine = words[:: rng.choice([1, 2, 3])] if source == "s2" else words
        rows.append((" ".join(rng.choice(mine) for _ in range(rng.randrange(40))) + rng.choice(["", ".5,Z", " X-x "]), rng.choice(["en", "en", "de", None]), source))
    return rows + [(None, "fr", "s1"), ("", "fr", "s2"), ("rare one", "fr", "s3"), ("alone alone", "it", "s1"), ("alone", "it", "s1"), ("alone so", "it", "s1"), ("x" * 90_000, "en", "s1")]


def test_equals_whole_tables_of_counts(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert got(st.source_divergence(docs)) == plain(rows)
    assert got(st.source_divergence(docs, top=7, least=5)) == plain(rows, 7, 5)


def test_small_tries_stretches_and_blocks_give_the_same(spark, rows, monkeypatch):
    """Limits that are met many times: the driver's values go to tasks with the functions' closures, so the functions run here."""
    for name, value in {"UNIT_BYTES": 5_000, "STRETCH": 300, "CELLS": 64, "BLOCK": 2}.items():
        monkeypatch.setattr(st, name, value)
    read = [pa.RecordBatch.from_arrays([pa.array([r[c] or "" for r in rows[k::3]], pa.string()) for c in (1, 2, 0)], ["lang", "source", "text"]) for k in range(3)]
    leaves = pa.Table.from_batches([b for part in read for b in st.counted(iter([part]))]).sort_by([("lang", "ascending"), ("term", "ascending")])
    merged = pa.Table.from_batches(list(st.merging(3)(iter(leaves.to_batches(max_chunksize=37)))))
    assert len(set(merged["stretch"].to_pylist())) > 3
    want = plain(rows)
    sums, best = collections.Counter(), collections.defaultdict(list)
    for lang in ("en", "de", "", "it"):
        own = merged.filter(pc.equal(merged["lang"], lang))
        terms = own.filter(pc.greater(pc.binary_length(own["term"]), 0))
        names = sorted({s for x in own["sources"].to_pylist() for s in x})
        mass = [sum(n for r in terms.to_pylist() for s, n in zip(r["sources"], r["counts"]) if s == name) for name in names]
        for stretch in set(terms["stretch"].to_pylist()):
            part = terms.filter(pc.equal(terms["stretch"], stretch))
            for block in range(-(-len(names) // 2)):
                heads = pa.Table.from_pylist([{"lang": lang, "names": names, "mass": mass, "v": len(terms), "block": block}])
                for r in st.scored(200)(part, heads).to_pylist():
                    if r["part"] == "pair":
                        sums[lang, r["source"], r["item"]] += r["value"]
                    else:
                        best[lang, r["source"]].append((-r["value"], r["item"].encode(), r["item"]))
    assert {k: v for k, v in sums.items()} == {(g, s, i): v for g, s, part, i, v, _ in want if part == "pair" and g != "fr"}
    ranked = [(g, s, "term", x[2], -x[0], k) for (g, s), xs in best.items() for k, x in enumerate(sorted(xs)[:200], 1)]
    assert sorted(ranked) == [r for r in want if r[2] == "term"]


def test_a_trie_holds_its_terms_in_byte_order():
    rng = random.Random(2)
    terms = list({bytes(rng.choice(b"ab\xc3\xa9z") for _ in range(rng.randrange(7))) for _ in range(500)})
    trie = st.Trie()
    for k, term in enumerate(terms):
        trie.put(term, k)
    assert list(trie.terms()) == sorted((t, k) for k, t in enumerate(terms))
    assert [terms[k] for k in trie.walk()] == sorted(terms)


def test_shares_are_exact_for_large_counts():
    rng = random.Random(1)
    total = [rng.randrange(1, 8 * 10**15) for _ in range(300)]
    count = [rng.randint(1, t) for t in total]
    assert st.share(np.array(count), np.array(total)).tolist() == [10**9 * c // t for c, t in zip(count, total)]


def test_a_source_for_each_document(spark):
    rows = [(prose(k, 30), "en", f"s{k}") for k in range(300)]
    assert got(st.source_divergence(spark.createDataFrame(rows, SCHEMA), top=3)) == plain(rows, 3)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.text, r.lang, r.source) for r in odd_docs.collect()]
    assert got(st.source_divergence(odd_docs, least=1)) == plain(rows, least=1)
    assert st.source_divergence(no_docs).collect() == []
