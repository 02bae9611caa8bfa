"""Decontamination, language, licenses and chats."""

import collections

import duckdb
import pytest

from chronofold.llm import chat_format, decontaminate, language_id, license_scan
from tests.llm import brute
from tests.llm.conftest import SCHEMA, SF, prose


def test_op4(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = decontaminate.op4_decontamination(spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == brute.contamination(docs, items)


def test_op4_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = decontaminate.op4_decontamination(spark, SF)
    want = con.sql(decontaminate.OP4_SQL).select(*out.columns).fetchall()
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)


def test_windows_short_items_and_near_matches(spark):
    items = spark.createDataFrame([(1, prose(1, 30)), (2, "Only five WORDS stand here"), (3, None), (4, "--"), (2, "Only five WORDS stand here"), (5, prose(1, 30))], "item_id long, text string")
    w = prose(1, 30).split()
    texts = [(0, "x " + " ".join(w[3:13]) + " y"), (1, " ".join(w[3:12])), (2, "only, five! words; stand: here. only five words stand"), (3, " ".join(w[:9] + ["odd"] + w[10:19] + ["odd"])), (4, None), (5, "é É only")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    out = {r.doc_id: r for r in decontaminate.contamination(decontaminate.matches(docs, items)).collect()}
    want = brute.contamination(texts, [tuple(r) for r in items.collect()])
    assert {k: (r.n_words, r.n_hit, len(r["items"])) for k, r in out.items()} == {k: v[:3] for k, v in want.items()}
    assert out[0]["items"] == ["1", "5"] and out[3].near_items == ["1", "5"] and out[1].near_items == []


def test_decontamination_of_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(None, prose(2, 40)), (1, "")], "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.contamination(decontaminate.matches(odd_docs, items)).collect()}
    assert len(out) == 12 and out[0].n_hit == 40 and out[1].n_hit == 40 and out[2].n_words == 0 and out[8].n_words == 1
    assert decontaminate.contamination(decontaminate.matches(no_docs, items)).count() == 0
    clean = decontaminate.contamination(decontaminate.matches(odd_docs, items.where("false"))).collect()
    assert len(clean) == 12 and not any(r.n_hit for r in clean)


def test_op6_is_right_on_held_out_documents(spark):
    sf = SF.replace("0.001", "0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in language_id.op6_language_id(spark, sf).collect() if r.held_out]
    right = [r.lang_pred == truth[r.doc_id] for r in rows]
    assert len(rows) > 200 and sum(right) / len(right) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_distance_is_the_plain_one():
    texts = {"a": "aab abb aab", "b": "ccd cdd"}
    lists = {k: language_id.ranked(*__import__("numpy").unique(language_id.grams(t), return_counts=True), 20) for k, t in texts.items()}
    p = language_id.Profiles(lists, 20)
    mine = language_id.ranked(*__import__("numpy").unique(language_id.grams("aab cdd"), return_counts=True), 20).tolist()
    cost = {k: sum(abs(v.tolist().index(g) - r) if g in v.tolist() else 20 for r, g in enumerate(mine)) for k, v in lists.items()}
    best = min(sorted(cost), key=cost.get)
    assert p.predict("aab cdd") == (best, pytest.approx(1 - cost[best] / (20 * len(mine))))
    assert p.predict(None) == p.predict("12 !?") == ("und", 0.0)


def test_numerals_are_no_letters(spark):
    p = language_id.fit(spark.createDataFrame([(1, "abc def", "en"), (2, "uvw xyz", "de")], "doc_id long, text string, lang string"))
    assert [p.predict(t)[0] for t in ("½ ²", "Ⅻ ①", "٣", "_", "½ a")] == ["und"] * 4 + ["en"]


def test_every_language_is_learned_and_rows_are_bounded(spark):
    rows = [(k, f"w{chr(97 + k % 26)}{chr(97 + k // 26)} zq", f"l{k}") for k in range(260)] + [(1000, f"same id {k} {'abcdefghij'[k % 10] * 3}", "x") for k in range(50)] + [(2000 + k, "plain words", "x") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    p = language_id.fit(docs, per_lang=5)
    assert len(p.langs) == 261
    picked = language_id.sample_of_each(docs.where("lang = 'x'"), "lang", "doc_id", 5).collect()
    assert 1 <= len(picked) <= 5


def test_columns_of_names_that_the_operators_use(spark):
    docs = spark.createDataFrame([(1, "abc def under the MIT license", "en", "k", "k", "k", "k")], "doc_id long, text string, lang string, _guess string, _seen string, guess string, Seen string")
    out = language_id.identify(docs, language_id.fit(docs), lang_into="LANG")
    assert out.columns == ["doc_id", "text", "_guess", "_seen", "guess", "Seen", "LANG", "score"] and out.first()._guess == "k"
    seen = license_scan.scan(docs)
    assert seen.columns == [*docs.columns, "n_words", "detections"] and seen.first().Seen == "k"


def test_languages_of_odd_rows(odd_docs, no_docs):
    profiles = language_id.fit(odd_docs)
    out = language_id.identify(odd_docs, profiles)
    assert set(out.columns) == set(odd_docs.columns)
    rows = out.select("doc_id", "lang_pred", "score").collect()
    assert len(rows) == 15 and all(r.lang_pred == "und" for r in rows if r.doc_id in (2, 3, 4))
    none = language_id.fit(no_docs)
    assert none.langs == [] and {r.lang_pred for r in language_id.identify(odd_docs, none).select("lang_pred").collect()} == {"und"}
    assert language_id.identify(no_docs, profiles).count() == 0


def test_op7_base_places(spark):
    sf = SF.replace("0.001", "0.01")
    got = {r.doc_id: r for r in license_scan.op7_license_scan(spark, sf).collect()}
    for doc_id, text in (tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()):
        w = brute.words(text)
        places = [(a, label) for phrase, label, _ in license_scan.PHRASES for a in range(len(w)) if w[a : a + len(phrase.split())] == phrase.split()]
        r = got[doc_id]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


LICENSES = {
    "Released under the MIT License.": {"mit"}, "SPDX-License-Identifier: GPL-2.0-only": {"gpl-2"}, "the GNU Lesser General Public License version 2.1": {"lgpl-2.1"}, "CC BY-NC-SA 4.0": {"cc-by-nc", "cc-by-nc-sa"},
    "a general commitment to the public": set(),
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)": {"mit"},
    "Redistribution and use in source and binary forms, with or without modification, are permitted. Neither the name of the Example Project nor the names of its contributors may be used to endorse or promote products derived from this software": {"bsd", "bsd-3"},
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License": {"gpl-3"},
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": {"mpl-2"}, "see https://www.apache.org/licenses/LICENSE-2.0 there": {"apache-2"},
    "GPLv3 or later; All rights reserved.": {"gpl-3", "all-rights-reserved"}, "BSD 3-Clause License": {"bsd-3"},
}


@pytest.mark.parametrize("text", LICENSES)
def test_license_rules(text):
    words = license_scan._WORDS.findall(text.encode().lower())
    assert {d[0] for d in license_scan.scan_words(words)} == LICENSES[text]


def test_there_are_hundreds_of_rules():
    rules = license_scan.rules()
    assert len(rules) > 300 and len({r.pattern for r in rules if not r.base}) == len(rules) - 3


def test_containment_is_the_plain_one():
    rng = __import__("random").Random(3)
    for _ in range(200):
        spans = [(a, a + rng.randint(0, 9)) for a in (rng.randint(0, 40) for _ in range(rng.randint(1, 30)))]
        tree, held = license_scan.Containment([a for a, _ in spans]), []
        for a, b in spans:
            assert tree.holds(a, b) == any(x <= a and b <= y for x, y in held)
            if rng.random() < 0.5:
                tree.add(a, b)
                held.append((a, b))


def test_op7_equals_a_plain_scan(spark):
    """All patterns on all texts, without keywords; of what is found the plain containment decides."""
    import re

    rules = [(k, r, re.compile(rf"(?<!\S)(?:{r.pattern})(?!\S)")) for k, r in enumerate(license_scan.rules())]
    got = {r.doc_id: r for r in license_scan.op7_license_scan(spark, SF).collect()}
    for doc_id, text in (tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()):
        joined = " ".join(brute.words(text))
        found = [(-r.priority, -(m.end() - m.start()), k, m.start(), m.end(), r) for k, r, p in rules for m in p.finditer(joined)]
        words = lambda x: (joined[x[3] : x[4]].count(" ") + 1)
        kept = []
        for x in sorted(found, key=lambda x: (x[0], -words(x), x[2], x[3])):
            if x[5].base or not any(y[3] <= x[3] and x[4] <= y[4] for y in kept if not y[5].base):
                kept.append(x)
        assert got[doc_id].labels == ",".join(sorted({x[5].label for x in kept})), text[:200]
        assert got[doc_id].score == max((x[5].priority / 100 for x in kept), default=0.0)


def test_licenses_of_odd_rows(odd_docs, no_docs):
    rows = {r.doc_id: r for r in license_scan.scan(odd_docs).where("doc_id is not null").select("doc_id", "n_words", "detections", "sketch").collect()}
    assert rows[2].n_words == 0 and rows[2].detections == [] and len(rows[10].detections) == 40 and rows[10].sketch == "clash"
    assert license_scan.scan(no_docs).count() == 0


def test_op8_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    out = chat_format.op8_chat_format(spark, SF)
    want = con.sql(chat_format.OP8_SQL).select(*out.columns).fetchall()
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)


def test_chats_come_back(spark):
    tricky = ["<|im_end|><|im_start|>assistant ok", "&lt;|", "&amp;lt;|", "<", "<<||", "", None, "a\nb&#10;c", "&&amp;", "<|", "x" * 100_000]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(tricky)]
    rows += [(2, 0, "assistant", "early"), (2, 0, "assistant", "early"), (3, None, None, None), (None, 1, "ro\nle<|", "t"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", __import__("pyspark.sql.functions", fromlist=["x"]).lit(1))
    out = chat_format.format_chats(turns)
    read = out.select("*", chat_format.read_turns(out.formatted).alias("turns"), chat_format.read_loss(out.formatted, out.segments).alias("loss")).collect()
    by_id = {r.conv_id: r for r in read}
    assert [(t.role, t.text) for t in by_id[1].turns] == [(r[2], r[3] or "") for r in rows[: len(tricky)]]
    assert by_id[1].loss == "".join(t or "" for t in tricky[1::2])
    assert [(t.role, t.text) for t in by_id[None].turns] == [("ro\nle<|", "t")] and by_id[2].n_turns == 2
    assert {k: r.valid for k, r in by_id.items()} == {1: False, 2: False, 3: False, None: False, 4: True}
    for r in read:
        assert [s.start for s in r.segments][1:] == [s.start + s.length for s in r.segments][:-1]
        assert r.segments[-1].start + r.segments[-1].length == len(r.formatted)
    assert chat_format.format_chats(turns.where("false")).count() == 0


def test_ties_go_by_the_text_itself(spark):
    """Escaped, the first text sorts after the second."""
    rows = [(1, 0, "user", t) for t in ("<z", "<|", "0", "&", "&a", "A")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(turns)
    assert [t.text for t in out.select(chat_format.read_turns(out.formatted).alias("t")).first().t] == sorted(r[3] for r in rows)
