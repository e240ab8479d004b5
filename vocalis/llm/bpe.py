"""Byte-pair encoding and decoding with forced boundaries (operator 5).

A pair of neighbouring bytes that occurs inside no vocabulary token can never be joined by a
merge, so every such pair is a certain cut. The fragments between cuts are encoded on their own and
the ids are put together again; the result is that of encoding the whole.

Nulls and empty texts give no ids and an empty decoded text; a null id column stays null. Repeated
rows give repeated results; tables without rows give none. Columns besides the two named are not read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.llm.pretokens import STAND_INS, TABLE, Splitter, byte_letters, encoder, read_tokenizer

#: A rank behind those of all merges.
NONE = 1 << 30


class ForcedBoundaryBPE:
    """Encoder and decoder made from the JSON of a tokenizer file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        self.splitter = Splitter(content)
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.ranks = {(a, b): i for i, (a, b) in enumerate(model["merges"])}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.splitter.special.items()}
        self.letters = byte_letters()
        self.bytes = {c: b for b, c in enumerate(self.letters)}
        self.byte_level = (spec["decoder"] or {}).get("type") == "ByteLevel"
        self.inside = {(t[i], t[i + 1]) for t in map(self._bare, self.vocab) for i in range(len(t) - 1)}
        self._pieces: dict[str, tuple[bytes, str]] = {}
        self._fragments: dict[str, tuple[int, ...]] = {}

    def _bare(self, token: str) -> str:
        return token[: -len(self.end)] if self.end and token.endswith(self.end) else token

    def cuts(self, letters: str) -> list[str]:
        """The fragments of a piece between its forced boundaries."""
        inside = self.inside
        at = [i for i, pair in enumerate(zip(letters, letters[1:], strict=False), 1) if pair not in inside]
        return [letters[a:b] for a, b in zip([0, *at], [*at, len(letters)], strict=True)] if at else [letters]

    def _merge(self, symbols: list[str]) -> list[str]:
        """Apply the merges of lowest rank first, the leftmost of equals first."""
        ranks = self.ranks
        if len(symbols) < 24:
            # only the pairs beside a merge get a new rank
            rank = ranks.get
            found = [rank(p, NONE) for p in zip(symbols, symbols[1:], strict=False)]
            while found and (best := min(found)) < NONE:
                at = found.index(best)
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
                del found[at]
                if at:
                    found[at - 1] = rank((symbols[at - 1], symbols[at]), NONE)
                if at < len(found):
                    found[at] = rank((symbols[at], symbols[at + 1]), NONE)
            return symbols
        after = [*range(1, len(symbols)), -1]
        before = [-1, *range(len(symbols) - 1)]
        alive: list[str | None] = list(symbols)
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if alive[i] is None or j < 0 or (alive[i], alive[j]) != pair:
                continue
            alive[i], alive[j] = pair[0] + pair[1], None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (p := (alive[k], alive[after[k]])) in ranks:
                    heapq.heappush(heap, (ranks[p], k, p))
        return [s for s in alive if s is not None]

    def _fragment(self, letters: str, last: bool) -> tuple[int, ...]:
        key = letters + self.end if last else letters
        found = self._fragments.get(key)
        if found is None:
            symbols = list(letters)
            if last:
                symbols[-1] += self.end
            found = self._fragments[key] = tuple(self.vocab[s] for s in self._merge(symbols) if s in self.vocab)
        return found

    def ids(self, piece: str) -> list[int]:
        if piece in self.splitter.special:
            return [self.splitter.special[piece]]
        letters = piece.encode().decode("latin-1").translate(STAND_INS)
        parts = self.cuts(letters)
        return [i for k, part in enumerate(parts) for i in self._fragment(part, k + 1 == len(parts))]

    def _piece(self, piece: str) -> tuple[bytes, str]:
        ids = self.ids(piece)
        return b"".join(i.to_bytes(4, "little") for i in ids), ("" if self.byte_level else " ").join(map(self.tokens.__getitem__, ids))

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the text decoded from them."""
        if len(self._pieces) > TABLE // 2 or len(self._fragments) > TABLE:
            self._pieces.clear()
            self._fragments.clear()
        known, pieces = self._pieces, self.splitter.pieces(text)
        for p in set(pieces).difference(known):
            known[p] = self._piece(p)
        found = [known[p] for p in pieces]
        return b"".join([x[0] for x in found]), self.join([x[1] for x in found if x[1]])

    def join(self, tokens: list[str]) -> str:
        """What decoding gives: tokens with spaces between, or their bytes where the file has a byte-level decoder."""
        if not self.byte_level:
            return " ".join(tokens)
        out = bytearray()
        for t in tokens:
            out += t.encode() if t in self.splitter.special else bytes(map(self.bytes.__getitem__, t))
        return out.decode("utf-8", errors="replace")

    def decode(self, ids) -> str:
        """The text of ids, special tokens included; ids that the file doesn't have are left out."""
        return self.join([self.tokens[i] for i in ids if i in self.tokens])


def bpe_digests(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    Returns ``id_col, n_tokens, ids_sha256, decoded_sha256``, and with ``with_ids`` also ``ids``
    (binary) and ``decoded`` (string). ``tokenizer`` is the path of a tokenizer file.
    """
    content = df.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))
    id_type = df.schema[id_col].dataType.simpleString()
    fields = f"{id_col} {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(ForcedBoundaryBPE, content.value)
        for batch in batches:
            counts, hashes, decoded, raw, texts = [], [], [], [], []
            for text in batch.column(1):
                ids, out = model.encode(text.as_py() or "")
                counts.append(len(ids) // 4)
                hashes.append(sha256(ids).hexdigest())
                decoded.append(sha256(out.encode("utf-8")).hexdigest())
                if with_ids:
                    raw.append(ids)
                    texts.append(out)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                columns += [pa.array(raw, pa.binary()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, fields)
