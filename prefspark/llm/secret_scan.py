"""Secret scan by one combined deterministic automaton (see ``automaton.Scanner``).

Nulls: a null text has no spans. Empty texts, repeated rows and empty tables: one result row per
input row, whatever its doc_id (null included). Other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from prefspark.llm.automaton import Scanner
from prefspark.llm.common import prepare, text_or_empty


def _any_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


# The rules' patterns and least lengths. The first three are the base kinds; the
# value of an assignment is looked at after the match, as a too short one still uses up its text.
VALUE = r"[A-Za-z0-9+/_.=-]"
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
RULES = [
    ("assign", "(" + "|".join(map(_any_case, KEYWORDS)) + rf")[\x22']?\x20*[:=]\x20*[\x22']?{VALUE}+"),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]{24,}"),
    ("github", r"gh[oprsu]_[A-Za-z0-9]+"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+"),
    ("google", r"AIza[A-Za-z0-9_-]+"),
    ("stripe", r"[rs]k_live_[A-Za-z0-9]+"),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    ("private_key", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
]
LEAST = {"assign": 6, "access": 20, "hex": 24, "github": 40, "slack": 15, "google": 39,
         "stripe": 24, "jwt": 40, "private_key": 0}
BASE = ("assign", "access", "hex")
KINDS = [name for name, _ in RULES]
SCHEMA = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
          "spans string, n_spans long, redacted string")


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner([pattern for _, pattern in RULES])


_SEPARATORS = frozenset(b"\x22' :=")
_KEYWORD_CHARS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_")


def _value_length(match: bytes) -> int:
    """Length of an assignment's value: what follows keyword, quote, spaces, one ':' or '=',
    spaces and quote."""
    at = 0
    while match[at] in _KEYWORD_CHARS:
        at += 1
    at += match[at] in b"\x22'"
    while match[at] == 0x20:
        at += 1
    at += 1
    while match[at] == 0x20:
        at += 1
    at += match[at] in b"\x22'"
    return len(match) - at


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by kind."""
    data = text.encode("utf-8", "surrogatepass")
    spans = []
    for rule, start, end in scanner().matches(data):
        kind = KINDS[rule]
        size = _value_length(data[start:end]) if kind == "assign" else end - start
        if size >= LEAST[kind]:
            spans.append((start, rule, end))
    spans.sort()
    out, at, chars = [], 0, 0
    for start, rule, end in spans:  # matches are ASCII: their length is the same in code points
        chars += len(data[at:start].decode("utf-8", "surrogatepass"))
        at = start
        out.append((KINDS[rule], chars, chars + end - start))
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans, mask: str = "[SECRET]") -> str:
    """``text`` with every stretch covered by spans replaced by ``mask`` (overlaps once)."""
    parts, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], mask]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _rows(frames, redacted: bool):
    for pdf in frames:
        rows = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            text = text_or_empty(text)
            spans = find(text)
            base = [s for s in spans if s[0] in BASE]
            counts = [sum(s[0] == k for s in base) for k in BASE]
            rows.append((doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(),
                         joined(spans), len(spans), redact(text, spans) if redacted else None))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype(
            {"doc_id": "Int64"})


def scan_secrets(docs: DataFrame, redacted: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts of the base kinds, their digest and all
    spans; ``redacted`` holds the text without its secrets if asked for (else null)."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(lambda it: _rows(it, redacted), SCHEMA)


def redact_column(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with all its columns, secrets in ``column`` replaced; null stays null."""
    prepare(docs.sparkSession)
    at = docs.columns.index(column)

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t if t is None else redact(t, find(t)) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(rows, docs.schema)
