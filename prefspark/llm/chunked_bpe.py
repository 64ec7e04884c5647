"""BPE encoding with reuse of content-defined chunks.

A rolling hash over the last ``WINDOW`` bytes cuts each text where its low bits are zero, so
that equal passages of different documents give equal chunks wherever they stand. A chunk is
encoded once per Python worker (bounded cache, kept from task to task). Cuts may lie inside
a word; a join is repaired by encoding its surroundings again, wider and wider, until the new
ids agree with the chunks' own ids on both sides.

Nulls count as the empty text: no ids, hash of nothing. One row per input row, any doc_id.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from prefspark.llm.common import prepare, text_or_empty
from prefspark.llm.pieces import ODD, PIECE, WordPieces, tokenizer_path, word_pieces

WINDOW = 32  # bytes under the rolling hash
CHUNK_BITS = 10  # mean chunk length: 2 ** CHUNK_BITS characters
CHUNK_CACHE_BYTES = 100_000_000
SCHEMA = ("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
SCHEMA_FULL = SCHEMA + ", ids binary, decoded string"


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 32, 256, np.uint32)


def cuts(text: str) -> list[int]:
    """Content-defined cut positions of ``text`` (code points; text length last)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = _gear()[codes & 255]
    width = 1
    while width < WINDOW:  # hash of 2 * width characters from two hashes of width characters
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width) if len(h) > width else 0
        h, width = wider, width * 2
    at = np.flatnonzero(h >> np.uint32(32 - CHUNK_BITS) == 0) + 1
    found = at[at < len(text)].tolist()
    return [*found, len(text)]


class _Chunk:
    """A chunk's pieces of text. ``core`` holds the ids of all but the first and last piece;
    those two may be torn."""

    __slots__ = ("head", "tail", "left", "right", "core", "single")

    def __init__(self, text: str, encoder: WordPieces):
        pieces = PIECE.findall(text)
        self.single = len(pieces) < 3
        self.head, self.tail = pieces[0], pieces[-1]
        if self.single:
            self.head, self.tail, self.left, self.right, self.core = text, "", "", "", b""
        else:
            self.left, self.right = pieces[1], pieces[-2]
            self.core = encoder.encode("".join(pieces[1:-1]))


class ChunkedEncoder:
    def __init__(self, encoder: WordPieces):
        self.encoder = encoder
        self.chunks: dict[str, _Chunk] = {}
        self.held = 0
        self.encoded = self.reused = 0

    def chunk(self, text: str) -> _Chunk:
        found = self.chunks.get(text)
        if found is None:
            self.encoded += 1
            found = _Chunk(text, self.encoder)
            size = 3 * len(text) + len(found.core) + 400
            if self.held + size > CHUNK_CACHE_BYTES:
                self.chunks, self.held = {}, 0
            if size <= CHUNK_CACHE_BYTES:
                self.chunks[text] = found
                self.held += size
        else:
            self.reused += 1
        return found

    def whole(self, text: str) -> bytes:
        return self.encoder.encode(text)

    def join(self, left: str, torn: str, right: str) -> bytes | None:
        """Ids of ``torn`` between its neighbours, or None if the ids of a wider stretch do not
        agree with the neighbours' own."""
        ids = self.encoder.encode
        a, b, wide = ids(left), ids(right), ids(left + torn + right)
        if wide.startswith(a) and wide.endswith(b) and len(wide) >= len(a) + len(b):
            return wide[len(a):len(wide) - len(b)]
        return None

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if ODD.search(text):  # other white space: no place to cut is certain
            return self.whole(text)
        out, begin, torn, left = [], 0, "", ""
        for end in cuts(text):
            chunk = self.chunk(text[begin:end])
            begin = end
            torn += chunk.head
            if chunk.single:
                continue  # no certain piece inside: the join grows over this chunk
            ids = self.join(left, torn, chunk.left)
            if ids is None:
                return self.whole(text)  # the widest stretch: all of the text
            out += [ids, chunk.core]
            torn, left = chunk.tail, chunk.right
        ids = self.join(left, torn, "")
        if ids is None:
            return self.whole(text)
        return b"".join([*out, ids])


@lru_cache(maxsize=1)
def chunked(path: str) -> ChunkedEncoder:
    return ChunkedEncoder(word_pieces(path))


def _rows(frames, path: str, full: bool):
    encoder = chunked(path)
    for pdf in frames:
        rows = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            ids = encoder.encode(text_or_empty(text))
            decoded = encoder.encoder.decode(ids)
            row = (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                   hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            rows.append((*row, ids, decoded) if full else row)
        schema = SCHEMA_FULL if full else SCHEMA
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype(
            {"doc_id": "Int64"})


def encode_documents(docs: DataFrame, path: str | None = None, full: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text). ``full`` adds the ids (little-endian unsigned
    32-bit integers) and the decoded text."""
    prepare(docs.sparkSession)
    path = path or tokenizer_path("word_bpe_49k.json")
    return docs.select("doc_id", "text").mapInPandas(lambda it: _rows(it, path, full),
                                                     SCHEMA_FULL if full else SCHEMA)
