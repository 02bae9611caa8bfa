"""Token counts, packing and record files against the tokenizer itself."""

import collections
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from chronofold.llm import packing, record_files, token_counts, tokens
from tests.llm.conftest import SF

PATH = tokens.default_path()


def ids_of(text):
    return tokens.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


def test_pieces_encode_as_whole_texts():
    rng = random.Random(0)
    parts = [" ", " ", "a", "bc", "\n", "\t", "é", "1", ".", "<|endoftext|>", "　", "'s", "\x85", "\x0b", "Ünï", "*", '"', "日本"]
    texts = [None, "", " ", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500))]
    small = tokens.Encoder(PATH, keep=50)
    for most in (64, 1 << 24):
        for at, ids, begin in small.batches(pa.array(texts, pa.string()), most):
            for k in range(len(begin) - 1):
                assert ids[begin[k] : begin[k + 1]].tolist() == ids_of(texts[at + k]), texts[at + k]
    assert small.lengths(pa.array(texts, pa.string())).tolist() == [len(ids_of(t)) for t in texts]
    assert [small.lengths(pa.array([t], pa.string())).tolist() for t in texts[:200]] == [[len(ids_of(t))] for t in texts[:200]]
    assert list(token_counts.runs(np.array([3, 3, 9, 1, 1, 1]), 6)) == [(0, 2), (2, 3), (3, 6)]


@pytest.mark.parametrize("opening", [True, False])
def test_tables_that_overflow(opening):
    rng = random.Random(1)
    words = ["ab", "Ünï,", "the.\nOn", "\u3000", "\xa0", "\n", "x\n", "\tx", "\u180ex", "x\u180e", "'s", "don't", "<|endoftext|>", "a<|endoftext|>b", "", "q" * 90, "\x00", "\u0120", "日本"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", str(rng.randint(0, 99))]) for _ in range(rng.randint(1, 12))) for _ in range(600)] + [None, "", " ".join(f"{w}{k}" for k in range(300) for w in ("one", "two"))]
    small = tokens.Encoder(PATH, keep=40)
    if not opening:
        small._opening = None
    for most in (50, 1 << 24):
        for at, ids, begin in small.batches(pa.array(texts, pa.string()), most):
            for k in range(len(begin) - 1):
                assert ids[begin[k] : begin[k + 1]].tolist() == ids_of(texts[at + k]), texts[at + k]


class Counted:
    """A tokenizer that notes the texts it is given."""

    def __init__(self, inner, seen):
        self.inner, self.seen = inner, seen

    def __getattr__(self, name):
        got = getattr(self.inner, name)
        if name == "model":
            return Counted(got, self.seen)
        if name not in ("encode_batch_fast", "tokenize"):
            return got
        return lambda texts, **options: self.seen.extend([texts] if isinstance(texts, str) else texts) or got(texts, **options)


def test_new_words_are_encoded_together_and_once(monkeypatch):
    seen, real = [], tokens.tokenizer
    monkeypatch.setattr(tokens, "tokenizer", lambda path: Counted(real(path), seen))
    small, words = tokens.Encoder(PATH, keep=6000), [f"w{k}x," for k in range(8000)]
    for own in (words[:5000], words[3000:]):
        text = " ".join(["first", *own])
        ids, begin = small.batch(pa.array([text, text]))
        assert ids[: begin[1]].tolist() == ids[begin[1] :].tolist() == ids_of(text)
    assert len(seen) < 20
    assert sum(t.count("x,") for t in seen) == 8000  # a table that is full keeps what the batch has again


def test_op2(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: (len((r.text or "").encode()), len(ids_of(r.text))) for r in rows}
    got = token_counts.op2_token_counts(spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_counts_of_odd_rows(odd_docs, no_docs):
    out = token_counts.token_counts(odd_docs).select("doc_id", "text", "n_tokens", "sketch").collect()
    assert len(out) == 15 and all(r.n_tokens == len(ids_of(r.text)) and r.sketch == "clash" for r in out)
    assert token_counts.token_counts(no_docs).count() == 0


def check_packing(rows, texts, size=1024):
    by_sequence, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    for doc_id, text in texts:
        own = ids_of(text) + [2]
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.piece):
            assert r.start == at and (r.piece == 0 or r.length == size)
            assert r.ids_crc32 == zlib.crc32(np.array(own[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(own)
    return len(by_sequence), -(-sum(r.length for r in rows) // size)


def test_op3(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    n, least = check_packing(packing.op3_pattern_packing(spark, SF).collect(), texts)
    assert n <= least * 1.02 + 1


def test_packing_of_odd_rows(odd_docs, no_docs):
    rows = packing.pack(odd_docs).collect()
    assert sum(r.length for r in rows) == sum(len(ids_of(r.text)) + 1 for r in odd_docs.select("text").collect())
    assert sum(r.length == 1 for r in rows if r.doc_id in (2, 3)) == 2
    assert packing.pack(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_each_piece_once(seed):
    rng = np.random.default_rng(seed)
    size = 128
    counts = np.zeros(size + 1, np.int64)
    np.add.at(counts, rng.integers(1, size + 1, [5, 100, 5000, 200_000][seed]), 1)
    planned = packing.plan(counts, size)
    used = np.zeros(size + 1, np.int64)
    for shape, n in planned:
        assert sum(shape) <= size and n > 0
        for length in shape:
            used[length] += n
    assert (used == counts).all() and len(planned) < 20 * size
    assert sum(n for _, n in planned) <= 1.03 * (counts * np.arange(size + 1)).sum() / size + 3


def test_op9(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    start, want = 0, {}
    for doc_id, text in rows:
        own = ids_of(text) + [0]
        want[doc_id] = (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in record_files.op9_token_records(spark, SF).collect()} == want


def test_records_of_odd_rows(spark, odd_docs, no_docs, tmp_path):
    shards = record_files.write_token_records(odd_docs, f"file://{tmp_path}/a")
    rows = record_files.scan_token_records(spark, shards).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in odd_docs.select("doc_id").collect()), key=lambda x: (x is not None, x))
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    empty = record_files.write_token_records(no_docs, f"file://{tmp_path}/b")
    assert empty == [] and record_files.scan_token_records(spark, empty).count() == 0


def test_damage_is_found_and_records_can_be_picked(spark, odd_docs, tmp_path):
    shards = record_files.write_token_records(odd_docs, f"file://{tmp_path}/c")
    _, path, n, _ = max(shards, key=lambda s: s[2])
    whole = [(d, ids.tolist()) for d, ids in record_files.read_shard(path)]
    order = list(range(n))[::-1]
    assert [(d, ids.tolist()) for d, ids in record_files.read_records(path, order)] == [whole[k] for k in order]
    local = path.removeprefix("file://")
    data = bytearray(open(local, "rb").read())
    for at in (2, 9, 20, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 4
        open(local, "wb").write(bad)
        with pytest.raises(ValueError):
            list(record_files.read_shard(path))
    open(local, "wb").write(data[:-3])
    with pytest.raises(ValueError):
        list(record_files.read_shard(path))


def test_frame_layout():
    framed = record_files.frame(b"abc")
    assert struct.unpack_from("<Q", framed)[0] == 3 and framed[12:15] == b"abc" and len(framed) == 19
