"""Exact tokenisation with the merges given as ranks.

The same merges, given to a rank-based encoder, give the tokenizers library's ids several times
faster for plain characters (Latin letters, digits, ASCII signs). Both vocabularies' pre-tokenisers
end a token wherever a visible character is followed by white space, so a text may be cut there
and its ids are those of its pieces in a row: pieces with other characters, or with the string of
a special token, go to the tokenizers library itself. So do whole texts with white space other
than blank, tab, line feed and carriage return.
"""

from __future__ import annotations

import base64
import json
import os
import re
import struct
from functools import cached_property, lru_cache

import numpy as np

# White space beside " \t\n\r", and characters that some libraries count as such.
ODD_SPACE = ("\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060"
             "\u3000\ufeff")
ODD = re.compile(f"[{ODD_SPACE}]")
PIECE = re.compile("[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
# Letters that every library lower-cases, composes and classifies alike.
PLAIN = re.compile("[ -~\t\n\r\xc0-\xd6\xd8-\xf6\xf8-\xff]*")


def _library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class _Pieces:
    """Ids of a text; subclasses encode plain text."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            self.model = json.load(file)
        self.special = [t["content"] for t in self.model["added_tokens"]]

    @cached_property
    def library(self):
        """Loaded only where a text needs it: it takes more memory than all the rest."""
        return _library(self.path)

    def library_ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def plain_ids(self, text: str) -> list[int]:
        raise NotImplementedError

    def plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.plain(text):
            ids = self.plain_ids(text)
        elif ODD.search(text):
            ids = self.library_ids(text)
        else:
            ids = [i for p in PIECE.findall(text)
                   for i in (self.plain_ids(p) if self.plain(p) else self.library_ids(p))]
        return struct.pack(f"<{len(ids)}I", *ids)


class BytePieces(_Pieces):
    """Byte-level vocabulary; the same merges are also given as ranks, which encode faster."""

    def __init__(self, json_path: str, ranks_path: str):
        super().__init__(json_path)
        del self.model
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                       mergeable_ranks=ranks, special_tokens={})


    def plain_ids(self, text):
        return self.ranks.encode_ordinary(text)


class WordPieces(_Pieces):
    """Vocabulary with word ends. A word end is written as one blank after each word, which no
    word holds, so that the merges can be given as ranks as well."""

    def __init__(self, json_path: str):
        super().__init__(json_path)
        import regex
        import tiktoken

        vocabulary = self.model["model"]["vocab"]
        letters = _byte_letters()
        special = set(self.special)
        ranks = {}
        for token, number in vocabulary.items():
            if token not in special:
                end = token.endswith("</w>")
                ranks[bytes(letters[c] for c in (token[:-4] if end else token)) + b" " * end] = number
        self.ranks = tiktoken.Encoding("ends", pat_str="[^ ]+ ", mergeable_ranks=ranks,
                                       special_tokens={})
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.tokens = {number: token for token, number in vocabulary.items()}
        self.tokens |= {t["id"]: t["content"] for t in self.model["added_tokens"]}
        del self.model

    def plain_ids(self, text):
        words = self.words.findall(text.lower())  # plain characters: lower case is per character
        return self.ranks.encode_ordinary(" ".join(words) + " ") if words else []

    def decode(self, ids: bytes) -> str:
        """This vocabulary has no decoder: tokens, joined by blanks."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte: visible Latin-1
    characters stand for themselves, the others for 256 and up in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def byte_pieces(json_path: str, ranks_path: str) -> BytePieces:
    return BytePieces(json_path, ranks_path)


@lru_cache(maxsize=2)
def word_pieces(json_path: str) -> WordPieces:
    return WordPieces(json_path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
