"""Encoding with public tokenizers inside Arrow functions."""

from __future__ import annotations

import functools
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A cut before a space is safe where what precedes it isn't white space: the
#: pre-tokenizer attaches one space to what follows and looks behind nowhere.
_SPACED = re.compile(r"\s ")
_SAFE = re.compile(r"(?<=\S) ")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a file, once for each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def parts(text: str) -> list[str]:
    """Text cut at each safe space, which is dropped."""
    return _SAFE.split(text) if _SPACED.search(text) else text.split(" ")


#: White space in the widest sense.
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{180e}\p{Z}]"
#: White space before a space: there Arrow's split isn't safe.
_SPACED_RE2 = f"{_BLANK} "
#: White space at an end, or nothing at all.
_EDGED_RE2 = rf"\A{_BLANK}|{_BLANK}\z|\A\z"


def opening(whole) -> np.ndarray | None:
    """For each id of a tokenizer whether its token begins with a space; None where pieces that begin with one can't be told apart by that."""
    about = repr(whole.pre_tokenizer)
    added = whole.get_added_tokens_decoder().values()
    if not about.startswith("ByteLevel(") or "use_regex=True" not in about or "add_prefix_space=False" not in about or whole.normalizer is not None or any(t.lstrip or t.rstrip or t.single_word or " " in t.content for t in added):
        return None
    vocab = whole.get_vocab()
    out = np.zeros(max(vocab.values()) + 1, bool)
    out[[i for token, i in vocab.items() if token[0] == "\u0120"]] = True  # this stands for a space
    return out


def strings(texts: pa.Array) -> list[str]:
    """Texts without nulls as a list; ``to_pylist`` goes through a scalar for each."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def gathered(values: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Runs of ``values``, each given by where it begins and how long it is, one after another."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total + len(values) < 1 << 31 else np.int64
    at = np.repeat((begin - (ends - length)).astype(kind), length)
    at += np.arange(total, dtype=kind)
    return values[at]


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    Texts are cut at safe spaces. Arrow finds the distinct pieces of a batch;
    those alone are encoded, and the ids are gathered from their table. Pieces
    are kept for later batches, as Arrow holds them; where they would be more than
    ``keep``, or 32 times as many bytes, those that the batch has not are dropped.
    New pieces are encoded many in one text, in which each begins with a space
    and no other token does; where the tokenizer doesn't warrant that, and for
    pieces with white space at an end, each is a text of its own.
    """

    def __init__(self, path: str, keep: int = 400_000) -> None:
        whole = tokenizer(path)
        self._encode, self._opening, self._keep = whole.encode_batch_fast, opening(whole), keep
        self._pieces = pa.array([], pa.large_string())
        self._ids, self._begin, self._length = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after another, and how many each has."""
        got = [e.ids for e in self._encode(texts, add_special_tokens=False)] if texts else []
        length = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(itertools.chain.from_iterable(got), "<u4", int(length.sum())), length

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`_encoded` of pieces after a space each, none of which has white space at an end."""
        ids = np.array(self._encode([f" {' '.join(pieces)}"], add_special_tokens=False)[0].ids, "<u4")
        first = np.flatnonzero(self._opening[ids])
        return (ids, np.diff(first, append=len(ids))) if len(first) == len(pieces) else self._apart(pieces)

    def _apart(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`_encoded` of pieces after a space each."""
        return self._encoded([f" {w}" for w in pieces])

    def _rows(self, pieces: pa.Array) -> np.ndarray:
        """Where in the table distinct pieces after a space stand; those it lacks are encoded."""
        rows = pc.fill_null(pc.index_in(pieces, value_set=self._pieces), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        held = rows >= 0
        if held.all():
            return rows
        fresh = pieces.filter(pa.array(~held))
        if len(self._pieces) + len(fresh) > self._keep or self._pieces.nbytes + fresh.nbytes > 32 * self._keep:
            at = rows[held]
            self._ids, self._length = gathered(self._ids, self._begin[at], self._length[at]), self._length[at]
            self._pieces, rows[held] = self._pieces.take(pa.array(at)), np.arange(len(at))
        edged = pc.match_substring_regex(fresh, _EDGED_RE2).to_numpy(zero_copy_only=False) | (self._opening is None)
        order = np.argsort(edged, kind="stable")
        plain, other = fresh.filter(pa.array(~edged)), fresh.filter(pa.array(edged))
        new = [encode(strings(own.slice(at, 1000))) for own, encode in ((plain, self._joined), (other, self._apart)) for at in range(0, len(own), 1000)]
        rows[np.flatnonzero(~held)[order]] = len(self._pieces) + np.arange(len(fresh))
        self._pieces = pa.concat_arrays([self._pieces, plain, other])
        self._ids = np.concatenate([self._ids, *(ids for ids, _ in new)])
        self._length = np.concatenate([self._length, *(length for _, length in new)])
        self._begin = np.cumsum(self._length) - self._length
        return rows

    def _split(self, texts: pa.Array) -> tuple[pa.Array, list[str], np.ndarray, np.ndarray]:
        """Texts (null: empty) cut at safe spaces: the distinct pieces after a space, the first pieces, the codes of all pieces and how many each text has.

        The code of a first piece is the number of distinct pieces and the place of its text.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _SPACED_RE2)  # there Arrow's split isn't safe
        by_hand = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        lists = pc.split_pattern(pc.if_else(odd, "", texts) if len(by_hand) else texts, " ")
        words, count = lists.flatten(), np.diff(np.asarray(lists.offsets, np.int64))
        begin = np.cumsum(count) - count
        if len(by_hand):
            cut = [parts(texts[int(i)].as_py()) for i in by_hand]
            count[by_hand] = own = np.fromiter(map(len, cut), np.int64, len(cut))
            begin[by_hand] = len(words) + np.cumsum(own) - own
            words = pa.concat_arrays([words, pa.array(itertools.chain.from_iterable(cut), pa.large_string())])
        firsts = strings(words.take(pa.array(begin)))
        coded = words.dictionary_encode()
        codes = gathered(np.array(coded.indices, np.int64), begin, count) if len(by_hand) else np.array(coded.indices, np.int64)
        leads = np.cumsum(count) - count
        inner = np.ones(len(codes), bool)
        inner[leads] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[codes[inner]] = True
        known = coded.dictionary.filter(pa.array(used))
        codes = (np.cumsum(used) - 1)[codes]
        codes[leads] = len(known) + np.arange(len(texts))
        return known, firsts, codes, count

    def _encode_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the table and of first pieces, where each piece begins among them, its number of ids, and how many pieces each text has."""
        known, firsts, codes, count = self._split(texts)
        rows = self._rows(known)
        ids, length = self._encoded(firsts)
        begin = np.concatenate([self._begin[rows], len(self._ids) + np.cumsum(length) - length])
        length = np.concatenate([self._length[rows], length])
        return np.concatenate([self._ids, ids]), begin[codes], length[codes], count

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text (null: empty) has."""
        if not len(texts):
            return np.zeros(0, np.int64)
        _, _, length, count = self._encode_pieces(texts)
        return np.add.reduceat(length, np.cumsum(count) - count)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) one after another, and where each text begins; the last entry is their number."""
        ids, begin, length, count = self._encode_pieces(texts)
        ends = np.concatenate([[0], np.cumsum(length)])
        return gathered(ids, begin, length), ends[np.concatenate([[0], np.cumsum(count)])]

    def batches(self, texts: pa.Array, most: int = 1 << 24) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """:meth:`batch` for runs of texts of about ``most`` bytes, each with the place of its first text."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
            yield at, *self.batch(texts[at:to])
            at = to


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
