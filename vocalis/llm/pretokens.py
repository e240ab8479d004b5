"""Splitting texts into the pieces that a byte-pair encoder treats on their own.

Two layouts of a ``tokenizers`` file are understood: byte-level with its built-in pattern, and
lower-cased words with an end-of-word suffix. A piece is encoded the same wherever it stands, so
encoders keep a bounded table of pieces they have met. The ``tokenizers`` library may know later letters than
Python's Unicode tables; texts with characters that Python doesn't know are normalised and split by the library.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

#: White_Space of Unicode, as a character class.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Texts whose characters all lie below this are split by short character classes, which are faster.
LATIN_END = 0x250
#: Entries of a piece table before it is emptied; bounds a worker's memory.
TABLE = 450_000


@cache
def patterns(end: int) -> tuple[re.Pattern, re.Pattern]:
    """The byte-level and the word pattern for characters below ``end``."""
    ranges = {"L": "", "N": ""}
    kind, start = "", 0
    for c in range(128, end + 1):
        now = unicodedata.category(chr(c))[0] if c < end else ""
        if now != kind:
            if kind in ranges:
                ranges[kind] += f"\\U{start:08x}-\\U{c - 1:08x}"
            kind, start = now, c
    L, N, head = ranges["L"], ranges["N"], "'s|'t|'re|'ve|'m|'ll|'d"
    return (
        re.compile(rf"{head}| ?[A-Za-z{L}]+| ?[0-9{N}]+| ?[^{SPACE}A-Za-z0-9{L}{N}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"),
        re.compile(rf"{head}|[a-z{L}]+|[0-9{N}]|[^{SPACE}a-z0-9{L}{N}]+"),
    )


_WIDE = re.compile(rf"[^\x00-\u{LATIN_END - 1:04x}]")


@cache
def unassigned() -> re.Pattern:
    """Characters that Python's Unicode tables don't know."""
    ranges, start = "", None
    for c in range(LATIN_END, 0x110001):
        new = c < 0x110000 and unicodedata.category(chr(c)) == "Cn"
        if new and start is None:
            start = c
        elif not new and start is not None:
            ranges += f"\\U{start:08x}-\\U{c - 1:08x}"
            start = None
    return re.compile(f"[{ranges}]")


def find(text: str, words: bool) -> list[str]:
    wide = not text.isascii() and _WIDE.search(text)
    return patterns(0x110000 if wide else LATIN_END)[words].findall(text)


class Splitter:
    """Pieces of a text under the rules of a tokenizer file's JSON."""

    def __init__(self, content: str):
        spec = json.loads(content)
        self._content, self._library = content, None
        pre, norm = spec["pre_tokenizer"], spec["normalizer"]
        if pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and norm is None:
            self.words = False
        elif pre["type"] == "Sequence" and [p["type"] for p in pre["pretokenizers"]] == ["Split", "ByteLevel"] and [n["type"] for n in norm["normalizers"]] == ["NFC", "Replace", "Lowercase"]:
            self.words = True
        else:
            raise ValueError("this layout of a tokenizer file isn't supported")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._marks = {x[:2] for x in self.special}

    def pieces(self, text: str) -> list[str]:
        """Pieces in order; an added token's own string is a piece of its own."""
        if self._special is not None and any(m in text for m in self._marks):
            parts = self._special.split(text)
            if len(parts) > 1:
                return [p for i, part in enumerate(parts) for p in ([part] if i % 2 else self._plain(part))]
        return self._plain(text)

    def _by_library(self, text: str) -> list[str]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self._content)
        if self._library.normalizer is not None:
            text = self._library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def _plain(self, text: str) -> list[str]:
        if not text.isascii() and _WIDE.search(text) and unassigned().search(text):
            return self._by_library(text)
        if not self.words:
            return find(text, False)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return find(text, True)


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b] = chr(extra)
            extra += 1
    return letters


#: Bytes, read as Latin-1, to their stand-ins.
STAND_INS = dict(enumerate(byte_letters()))


class LibraryEncoder:
    """Ids by the model of the ``tokenizers`` library, which sees each distinct piece once; pieces are normalised and split already."""

    def __init__(self, content: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.splitter = Splitter(content)
        self.model = Tokenizer.from_str(content).model
        self.ids = _Pieces(self._encode)

    def _encode(self, piece: str) -> bytes:
        if piece in self.splitter.special:
            return self.splitter.special[piece].to_bytes(4, "little")
        letters = piece.encode().decode("latin-1").translate(STAND_INS)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        self.ids.trim()
        return b"".join(map(self.ids.__getitem__, self.splitter.pieces(text)))


class _Pieces(dict):
    """Piece -> result, filled on demand."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece):
        out = self[piece] = self.make(piece)
        return out

    def trim(self) -> None:
        if len(self) > TABLE:
            self.clear()


_made: dict[tuple[str, int], object] = {}


def encoder(kind, content: str):
    """One encoder for each worker process and tokenizer file."""
    key = (kind.__name__, hash(content))
    if key not in _made:
        _made[key] = kind(content)
    return _made[key]


def forget() -> None:
    """Let go of the encoders; the next use makes them anew."""
    _made.clear()


def read_tokenizer(path: str) -> str:
    """The tokenizer file, read on the driver; a few MB whatever the corpus, so it may be broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()
