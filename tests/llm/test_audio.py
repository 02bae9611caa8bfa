import os

import numpy as np
import pytest

from chronofold.llm import audio_fingerprint as a


def melody(seed, n=64):
    return np.random.default_rng(seed).normal(0, 0.125, n).tolist()


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, audio binary")


def test_damaged_audio_has_no_fingerprint(spark):
    rows = [(1, None), (2, b""), (3, b"RIFF"), (4, a.play([0.0])), (None, a.play(melody(1))), (5, a.play(melody(1))[:50])]
    out = {r.id: len(r.prints) for r in a.fingerprints(table(spark, rows)).collect()}
    assert out == {1: 0, 2: 0, 3: 0, 4: 0, None: 119, 5: 0} or out[None] > 100 and all(v == 0 for k, v in out.items() if k)


def test_shifted_and_noisy_recordings_align(spark):
    base = melody(3)
    noisy = (np.array(base) + np.random.default_rng(4).normal(0, 0.01, 64)).tolist()
    rows = [(0, a.play(base)), (1, a.play(base)), (2, a.play(noisy)), (3, a.play(base[4:])), *((10 + k, a.play(melody(50 + k))) for k in range(20)), (0, a.play(base)), (None, a.play(base)), (99, None)]
    prints = a.fingerprints(table(spark, rows)).cache()
    rows = a.align(prints).collect()
    got = {r.id: r for r in rows}
    assert len(rows) == 27 and {i for i, r in got.items() if r.component_id == 0} == {0, 1, 2, 3}
    assert all(r.component_id == i and r.aligned_to is None for i, r in got.items() if i not in (0, 1, 2, 3))
    assert got[1].offset == 0 and got[1].bit_error_rate == 0 and got[3].offset == -8 and got[3].bit_error_rate < 0.02
    assert a.align(prints.where("false")).count() == 0


def test_recall_of_the_index(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(60):
        base = rng.normal(0, 0.125, 64)
        rows += [(20 * k + j, a.play((base + rng.normal(0, 0.012 * (j > 0), 64)).tolist())) for j in range(3)]
    prints = a.fingerprints(table(spark, rows)).cache()
    all_ = {r.id: np.array(r.prints, np.int32).view(np.uint32) for r in prints.collect()}
    close = {(x, y) for x in all_ for y in all_ if x < y and np.bitwise_count(all_[x] ^ all_[y]).sum() <= 0.2 * 32 * len(all_[x])}
    group = {r.id: r.component_id for r in a.align(prints).collect()}
    found = {(x, y) for x, y in close if group[x] == group[y]}
    assert len(close) >= 120 and len(found) / len(close) >= 0.9
    assert all(x // 20 == group[x] // 20 for x in group)


def test_silence_has_no_keys():
    prints = a.fingerprint(a.chroma([(2000, np.zeros(20_000))]))
    assert not prints.any() and len(a.keys(prints)[0]) == 0


def test_chroma_finds_the_pitch():
    t = np.arange(8000) / 4000
    frames = a.chroma([(4000, np.sin(2 * np.pi * 440 * t))])
    assert frames.shape[1] == 12 and (frames.argmax(1) == 0).all() and frames.sum(1) == pytest.approx(1)


def printed(spark, prints):
    return spark.createDataFrame([(i, x.view(np.int32).tolist()) for i, x in prints.items()], "id long, prints array<int>")


def noise(rng, n, share):
    """Integers of which ``share`` of the bits are set."""
    return np.packbits(rng.random((n, 32)) < share, axis=1).view(np.uint32).ravel()


def groups_by_brute_force(prints, most_errors):
    """id -> smallest id that is reachable by pairs of equal length with few bit errors at offset 0."""
    label = {i: i for i in prints}
    for x in prints:
        for y in prints:
            if x < y and np.bitwise_count(prints[x] ^ prints[y]).sum() <= most_errors * 32 * len(prints[x]):
                lo, hi = sorted((label[x], label[y]))
                label = {i: lo if c == hi else c for i, c in label.items()}
    return label


def test_groups_that_share_a_jingle_with_a_smaller_id(spark):
    """All keys are the jingle's, and the smallest id that has them is in no group; rates between 0.2 and 0.25 count too."""
    rng = np.random.default_rng(11)
    some = lambda n: rng.integers(1, 2**32, n, dtype=np.uint32)
    jingle, prints = some(30), {}
    prints[0] = np.concatenate([jingle, some(90)])
    for k in range(1, 31):
        tail = some(90)
        for j in range(3):
            prints[10 * k + j] = np.concatenate([jingle, tail ^ noise(rng, 90, 0.18)])
    want = groups_by_brute_force(prints, 0.25)
    assert len(set(want.values())) == 31 and len(set(groups_by_brute_force(prints, 0.2).values())) > 31
    rows = a.align(printed(spark, prints)).collect()
    assert {r.id: r.component_id for r in rows} == want
    assert all(r.offset == 0 and want[r.aligned_to] == want[r.id] for r in rows if r.id % 10)


def test_recall_at_a_quarter_of_the_bits(spark):
    """As test_recall_of_the_index, with the larger rate and one group of 60 noisy copies."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(30):
        base = rng.normal(0, 0.125, 64)
        rows += [(100 * k + j, a.play((base + rng.normal(0, 0.012 * (j > 0), 64)).tolist())) for j in range(60 if k == 7 else 3)]
    prints = a.fingerprints(table(spark, rows)).cache()
    all_ = {r.id: np.array(r.prints, np.int32).view(np.uint32) for r in prints.collect()}
    close = {(x, y) for x in all_ for y in all_ if x < y and np.bitwise_count(all_[x] ^ all_[y]).sum() <= 0.25 * 32 * len(all_[x])}
    out = a.align(prints).collect()
    group = {r.id: r.component_id for r in out}
    found = {(x, y) for x, y in close if group[x] == group[y]}
    print(f"recall {len(found)} of {len(close)}, in the large group {len([x for x, _ in found if x // 100 == 7])} of {len([x for x, _ in close if x // 100 == 7])}")
    assert len(found) / len(close) >= 0.95
    for r in out:
        if r.aligned_to is not None:
            x, y = all_[r.aligned_to][max(0, -r.offset) :], all_[r.id][max(0, r.offset) :]
            n = min(len(x), len(y))
            assert r.frames == n >= 60 and np.bitwise_count(x[:n] ^ y[:n]).sum() <= 0.25 * 32 * n


def test_clip_of_a_long_recording_and_of_a_repeat(spark):
    """A key at any place of a long recording counts, and a clip from a later repeat of a passage is found there."""
    rng = np.random.default_rng(12)
    some = lambda n: rng.integers(1, 2**32, n, dtype=np.uint32)
    long, passage, other, rest = some(20_000), some(100), some(150), some(150)
    prints = {0: long, 1: np.concatenate([passage, other, passage, rest])}
    prints |= {10 + j: long[4000 * j + 1500 :][:390].copy() for j in range(5)} | {20: np.concatenate([passage, rest ^ noise(rng, 150, 0.24)])}
    got = {r.id: r for r in a.align(printed(spark, prints)).collect()}
    assert all(got[10 + j].aligned_to == 0 and got[10 + j].offset == -4000 * j - 1500 for j in range(5))
    assert got[20].aligned_to == 1 and got[20].offset == -250 and got[20].frames == 250


def test_votes_of_all_places():
    x = np.array([1, 1, 2], np.int64), np.array([0, 10, 5], np.int32)
    y = np.array([1, 1, 2, 3], np.int64), np.array([4, 14, 9, 1], np.int32)
    offsets, votes = a.voted(x, y)
    assert list(zip(offsets.tolist(), votes.tolist(), strict=True)) == [(4, 3), (-6, 1), (14, 1)]


def test_blocks_make_no_difference(monkeypatch):
    audio = a.play(melody(5, 200))
    whole = a.chroma(a.decode(audio))
    monkeypatch.setattr(a, "SAMPLES", 1001)
    monkeypatch.setattr(a, "FRAMES", 7)
    assert np.array_equal(whole, a.chroma(a.decode(audio))) and len(whole) > 300


def test_a_file_that_ends_within_a_sample():
    audio = a.play(melody(6, 200))
    cut = a.chroma(a.decode(audio[: len(audio) // 2 | 1]))
    assert 100 < len(cut) < 300 and np.allclose(cut, a.chroma(a.decode(audio))[: len(cut)])


def test_recall_on_the_table(spark):
    """Queries are the ids divisible by 20, against all rows at every offset. Smaller tables have no close pairs."""
    sf = "/root/testdata/check_s"
    if not os.path.exists(sf):
        pytest.skip("no such tables")
    prints = {r.id: r.prints for r in a.played_prints(spark, sf).collect()}
    ids = np.array(list(prints))
    words = np.array(list(prints.values()), np.int32)
    n = words.shape[1]
    signs = np.unpackbits(words.view(np.uint8).reshape(len(ids), n, 4), axis=2).reshape(len(ids), -1).astype(np.float32) * 2 - 1
    asked, close = np.flatnonzero(ids % 20 == 0), set()
    for o in range(60 - n, n - 59):
        bits = 32 * (n - abs(o))
        equal = signs[asked, 32 * max(0, -o) :][:, :bits] @ signs[:, 32 * max(0, o) :][:, :bits].T
        close |= {(ids[asked[i]], ids[j]) for i, j in zip(*np.nonzero((bits - equal) / 2 <= a.PLAYED_ERRORS * bits), strict=True) if asked[i] != j}
    group = {r.id: r.component_id for r in a.op10_audio_alignment(spark, sf).collect()}
    assert set(group) == set(ids)
    found = {(x, y) for x, y in close if group[x] == group[y]}
    print(f"recall {len(found)} of {len(close)}")
    assert len(close) > 5 and len(found) / len(close) >= 0.9


def test_rows_that_share_an_id(spark):
    """The smallest fingerprint counts, whichever row comes first, and each row comes out."""
    rng = np.random.default_rng(3)
    x, y = (rng.integers(1, 2**31, 90, dtype=np.uint32) for _ in range(2))
    lo, hi = sorted([x.view(np.int32).tolist(), y.view(np.int32).tolist()])
    rows = [(5, hi), (5, lo), (7, lo), (8, hi), (9, [0] * 80), (10, [0] * 80), (11, lo[:30]), (12, lo[:30])]
    out = a.align(spark.createDataFrame(rows, "id long, prints array<int>")).collect()
    assert sorted((r.id, r.component_id, r.aligned_to) for r in out) == [(5, 5, None), (5, 5, None), (7, 5, 5), (8, 8, None), (9, 9, None), (10, 10, None), (11, 11, None), (12, 12, None)]
