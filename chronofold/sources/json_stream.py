"""JSON texts read piece by piece.

The shape of a text is settled at its first telling root key. From there on a
value is found by its brackets, decoded and passed on, so that memory holds one
value and a piece of the text, whatever the size of the whole. The consumer may
stop at any value; nothing behind it is read then.
"""

from __future__ import annotations

import codecs
import json
import re
import zlib
from collections.abc import Iterable, Iterator

#: Root keys that say that an object is one value, the key of a list of values, and how far it is looked for.
OBJECT_KEYS = ("itemId", "placeId", "sampleId", "segments")
LIST_KEY = "timelineItems"
LOOK_CHARS = 1_000_000
LOOK_TOKENS = 20_000

PIECE = 256 << 10
_SPACE = re.compile(r"[ \t\n\r]*+")
_STRING = re.compile(r'"(?:[^"\\]++|\\.)*+"', re.S)
_SCALAR = re.compile(r'[^\s,:\]}\[{"]*+')
#: Up to the next bracket, or to a string that isn't complete.
_TO_BRACKET = re.compile(r'[^"{}\[\]]*+(?:"(?:[^"\\]++|\\.)*+"[^"{}\[\]]*+)*+', re.S)


class Damaged(ValueError):
    """A file that can't be read whole."""


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


_decode = json.JSONDecoder(parse_constant=_no_constant).decode


def loads(text: str) -> object:
    try:
        return _decode(text)
    except (ValueError, RecursionError) as e:
        raise Damaged(f"JSON: {e}") from None


class Text:
    """A text whose characters from ``at`` on are held; what lies before is forgotten as more is read."""

    def __init__(self, pieces: Iterable[bytes]) -> None:
        self.pieces = iter(pieces)
        self.utf8 = codecs.getincrementaldecoder("utf-8-sig")()
        self.held, self.at, self.ended = "", 0, False

    def more(self) -> bool:
        """Read on: as much as is held, so that a long value isn't looked through again and again."""
        if self.ended:
            return False
        parts, size, want = [self.held[self.at :]], 0, max(1, len(self.held) - self.at)
        while size < want and not self.ended:
            piece = next(self.pieces, None)
            try:
                text = self.utf8.decode(piece or b"", piece is None)
            except UnicodeDecodeError as e:
                raise Damaged(f"JSON: {e}") from None
            self.ended = piece is None
            parts.append(text)
            size += len(text)
        self.held, self.at = "".join(parts), 0
        return size > 0

    def peek(self, ahead: int = 0) -> str:
        """The first character that isn't white space, ``ahead`` of the place; '' at the end. Only white space is passed over."""
        while True:
            place = _SPACE.match(self.held, self.at + ahead).end()
            if place < len(self.held):
                if not ahead:
                    self.at = place
                return self.held[place]
            if not ahead:
                self.at = place
            if not self.more():
                return ""

    def string_end(self, ahead: int = 0) -> int:
        """How far the string that begins ``ahead`` of the place goes."""
        while not (found := _STRING.match(self.held, self.at + ahead)):
            if not self.more():
                raise Damaged("JSON: cut off in a string")
        return found.end() - self.at

    def scalar_end(self, ahead: int = 0) -> int:
        while True:
            end = _SCALAR.match(self.held, self.at + ahead).end()
            if end < len(self.held) or not self.more():
                return end - self.at

    def value(self) -> object:
        """The value at the place, which moves behind it."""
        first = self.peek()
        if first and first in "{[":
            ahead = self.nested_end()
        else:
            ahead = self.string_end() if first == '"' else self.scalar_end()
        text = self.held[self.at : self.at + ahead]
        self.at += ahead
        return loads(text)

    def nested_end(self) -> int:
        ahead, depth = 0, 0
        while True:
            ahead = _TO_BRACKET.match(self.held, self.at + ahead).end() - self.at
            if self.at + ahead >= len(self.held) or self.held[self.at + ahead] == '"':
                if not self.more():
                    raise Damaged("JSON: cut off")
                continue
            depth += 1 if self.held[self.at + ahead] in "{[" else -1
            ahead += 1
            if not depth:
                return ahead

    def expect(self, allowed: str) -> str:
        found = self.peek()
        if not found or found not in allowed:
            raise Damaged(f"JSON: {allowed!r} expected, found {found!r}" if found else "JSON: cut off")
        self.at += 1
        return found

    def elements(self) -> Iterator[object]:
        """The values of the array whose bracket lies right before the place."""
        if self.peek() == "]":
            self.at += 1
            return
        while True:
            yield self.value()
            if self.expect(",]") == "]":
                return

    def end(self) -> None:
        if self.peek():
            raise Damaged("JSON: data after the root value")


def _list_ahead(text: Text) -> int | None:
    """Where the list of values of a root object begins, from the place of the object; None if the object is one value.

    Looks at root keys up to the first that tells, and no further than the limits.
    """
    ahead, depth, tokens, chars, key_next = 1, 1, 1, 0, True
    while tokens <= LOOK_TOKENS and chars <= LOOK_CHARS:
        first = text.peek(ahead)
        if not first:
            return None
        ahead = _SPACE.match(text.held, text.at + ahead).end() - text.at
        tokens += 1
        if first == '"':
            start, ahead = ahead, text.string_end(ahead)
            string = loads(text.held[text.at + start : text.at + ahead])
            chars += len(string.encode("utf-16-le", "surrogatepass")) // 2
            if depth == 1 and key_next:
                key_next = False
                if string in OBJECT_KEYS:
                    return None
                if string == LIST_KEY and text.peek(ahead) == ":":
                    colon = _SPACE.match(text.held, text.at + ahead).end() - text.at
                    if text.peek(colon + 1) == "[":
                        return _SPACE.match(text.held, text.at + colon + 1).end() - text.at
            continue
        if first in "{[":
            depth += 1
        elif first in "}]":
            depth -= 1
            if not depth:
                return None
        elif first == "," and depth == 1:
            key_next = True
        elif first not in ",:":
            end = text.scalar_end(ahead)
            if end == ahead:
                return None
            ahead = end
            continue
        ahead += 1
    return None


def values(pieces: Iterable[bytes]) -> Iterator[tuple[str, object]]:
    """(shape, value) of a JSON text: the elements of a root array or of a root list of items, or else the root object.

    A text that ends early, isn't JSON or holds anything else raises
    :class:`Damaged` where that is met, after the values before it.
    """
    text = Text(pieces)
    first = text.peek()
    if not first:
        raise Damaged("JSON: empty")
    if first == "[":
        text.at += 1
        for value in text.elements():
            yield "root-array", value
    elif first == "{":
        ahead = _list_ahead(text)
        if ahead is None:
            yield "root-object", text.value()
        else:
            loads(text.held[text.at : text.at + ahead] + "0}")  # what lies before the list is sound
            text.at += ahead + 1
            for value in text.elements():
                yield "timeline-items", value
            yield from _rest(text)
    else:
        raise Damaged("JSON: neither an object nor an array")
    text.end()


def _rest(text: Text) -> Iterator[tuple[str, object]]:
    """What follows the list in its object: checked, one member at a time; a list of the same name counts too."""
    while text.expect(",}") == ",":
        if text.peek() != '"':
            raise Damaged("JSON: a key expected")
        key = text.value()
        text.expect(":")
        if key == LIST_KEY and text.peek() == "[":
            text.at += 1
            for value in text.elements():
                yield "timeline-items", value
        else:
            text.value()


def gunzipped(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The content of one gzip member, in pieces of a bounded size, its checksum and size verified; anything after it is an error."""
    reader = zlib.decompressobj(31)
    try:
        for piece in pieces:
            while piece:
                if reader.eof:
                    raise Damaged("gzip: data after the first member")
                out = reader.decompress(piece, PIECE)
                if out:
                    yield out
                piece = reader.unconsumed_tail or (reader.unused_data if reader.eof else b"")
        while not reader.eof and (out := reader.decompress(reader.unconsumed_tail, PIECE)):
            yield out
    except zlib.error as e:
        raise Damaged(f"gzip: {e}") from None
    if not reader.eof:
        raise Damaged("gzip: cut off")


def plain_pieces(path: str, pieces: Iterable[bytes]) -> Iterator[bytes]:
    """A file's content, decompressed if its name or its first bytes say gzip."""
    pieces = iter(pieces)
    head = b""
    while len(head) < 2 and (piece := next(pieces, None)) is not None:
        head += piece

    def whole() -> Iterator[bytes]:
        if head:
            yield head
        yield from pieces

    return gunzipped(whole()) if path.lower().endswith(".gz") or head[:2] == b"\x1f\x8b" else whole()


def inflated(pieces: Iterable[bytes], size: int, crc: int, method: int) -> Iterator[bytes]:
    """The content of a zip entry, stored (0) or deflated (8), checked against the size and checksum that its directory declares."""
    if method not in (0, 8):
        raise Damaged(f"zip: compression method {method}")
    reader = zlib.decompressobj(-15) if method else None
    seen = found = 0

    def outs() -> Iterator[bytes]:
        for piece in pieces:
            while piece:
                if reader is None:
                    yield piece
                    break
                if reader.eof:
                    raise Damaged("zip: data after an entry's end")
                yield reader.decompress(piece, PIECE)
                piece = reader.unconsumed_tail or (reader.unused_data if reader.eof else b"")
        if reader is not None and not reader.eof:
            yield reader.flush()
            if not reader.eof:
                raise Damaged("zip: cut off")

    try:
        for out in outs():
            seen += len(out)
            if seen > size:
                raise Damaged("zip: more than the declared size")
            found = zlib.crc32(out, found)
            if out:
                yield out
    except zlib.error as e:
        raise Damaged(f"zip: {e}") from None
    if seen != size:
        raise Damaged("zip: wrong size")
    if found != crc:
        raise Damaged("zip: wrong checksum")
