"""Personal data by fixed patterns and a linear-chain conditional random field.

The patterns give the base spans (email, ip, card, phone). The field adds forms that they
miss: phone numbers without a plus, grouped card numbers of other lengths, addresses with
other letters. Its tokens are stretches between white space, its labels begin and inside of each kind
and outside, its features word shapes of a token and its neighbours. It is trained from a small
labelled table (``labelled``) by gradient steps on the exact likelihood.

Every label but "outside" needs a digit or an at sign in its token. A token without either is therefore
outside in every labelling, and the chain falls apart there: each run of other tokens is
decoded on its own, which is exact. Runs of a batch are decoded together by Viterbi in numpy.

What the field finds must pass its kind's check (parts at most 255, Luhn, digits) and must not touch a base
span. Nulls count as the empty text; one result row per input row, whatever its doc_id.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from prefspark.llm.common import prepare, text_or_empty

KINDS = ("email", "ip", "card", "phone")
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
SCHEMA = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
          "spans string, n_spans long, masked string")
FORBIDDEN = -1e4
STEPS, RATE, L2 = 120, 0.1, 1e-3
SENTENCES = 800  # rows of the labelled table
BATCH_CELLS = 400_000

# Fixed values of the contract.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

MARKED = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")


# ---- base patterns ---------------------------------------------------------------------------

def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def small_parts(address: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in address.split("."))


def emails(text: str):
    """Leftmost non-overlapping addresses, found from their at signs: a match holds exactly one, and
    its first part is the longest run of fitting characters before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then by start."""
    spans = [("email", s, e) for s, e in emails(text)]
    spans += [("ip", *m.span()) for m in IP.finditer(text) if small_parts(m[0])]
    for m in CARD.finditer(text):
        number = digits(m[0]) if m.end() - m.start() >= 16 else ""
        if 16 <= len(number) <= 19 and luhn(number):
            spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return spans


# ---- word shapes -----------------------------------------------------------------------------

def shape(token: str) -> list[str]:
    """Runs of digits as d and their length (7 at most), runs of letters as x, other characters
    as they are."""
    out, k = [], 0
    while k < len(token):
        c, end = token[k], k + 1
        if c.isdigit():
            while end < len(token) and token[end].isdigit():
                end += 1
            out.append(f"d{min(end - k, 7)}")
        elif c.isalpha():
            while end < len(token) and token[end].isalpha():
                end += 1
            out.append("x")
        else:
            out.append(c)
        k = end
    return out


def _kind_of(elements: list[str]) -> str:
    """What a neighbour looks like: the sorted set of its shape's elements, without lengths."""
    return "".join(sorted({e[0] for e in elements}))[:8]


def core(token: str) -> tuple[int, int]:
    """Bounds of a token without the brackets, quotes and stops around it; a bracket that
    opens and closes inside stays."""
    start, end = 0, len(token)
    while end > start and (token[end - 1] in ".,;:!?\"'>]}|" or token[end - 1] == ")" and "(" not in token[start:end]):
        end -= 1
    while start < end and (token[start] in "\"'<[{|" or token[start] == "(" and ")" not in token[start:end]):
        start += 1
    return start, end


def features(tokens: list[str]) -> list[tuple[str, ...]]:
    """Feature names of each token of a run."""
    bare = [t[slice(*core(t))] for t in tokens]
    shapes = list(map(shape, bare))
    kinds = ["^", *map(_kind_of, shapes), "$"]
    out = []
    for k, token in enumerate(bare):
        s = shapes[k]
        out.append(("s" + "".join(s), "p" + "".join(s[:2]), "e" + "".join(s[-2:]), "n" + str(min(len(digits(token)), 20)),
                    "k" + kinds[k + 1], "l" + kinds[k], "r" + kinds[k + 2],
                    "a" + ("@." if "." in token.partition("@")[2] else "@" if "@" in token else "")))
    return out


def runs(text: str) -> list[list[tuple[int, int]]]:
    """Token bounds of each run of tokens with a digit or an at sign, within a line."""
    out: list[list[tuple[int, int]]] = []
    for m in MARKED.finditer(text):
        if out:
            gap = text[out[-1][-1][1]:m.start()]
            if gap.isspace() and "\n" not in gap:
                out[-1].append(m.span())
                continue
        out.append([m.span()])
    return out


# ---- labelled table --------------------------------------------------------------------------

# Forms of each kind and of what must be left alone. 9 stands for a digit, a for a
# letter, w for a word of letters; "card" forms get a last digit that passes Luhn.
FORMS = {
    "email": ["w@w.aa", "w.w@w.aaa", "w.99@w9.w.aaa", "w_w99@w.w.aa", "w+w@w.aaa", "wé@w.aa", "wü.w@w.aa", "w@wñw.aa"],
    "ip": ["99.99.99.99", "199.99.9.99", "9.9.9.9", "199.199.19.199", "99.9.199.9"],
    "card": ["9999999999999999", "9999 9999 9999 9999", "9999-9999-9999-9999", "9999 999999 99999",
             "9999-999999-99999", "999999999999999"],
    "phone": ["+9 (999) 999-9999", "+99 99 9999999", "+99 999 999 9999", "+9-999-999-9999", "(999) 999-9999",
              "999-999-9999", "999.999.9999", "(999)999-9999", "999 999 9999", "9-999-999-9999", "(99) 9999 9999",
              "(999) 999 9999"],
    "": ["2099-09-19", "19/09/2099", "19.09.2099", "19:49", "19:49:59", "v9.9.9", "9.9.99", "9,999.99", "$99.99", "99%",
         "9999", "99", "9", "999999", "9999999999", "999-9-99-999999-9", "99-99", "aa-9999-9999", "aaa999", "99999-9999",
         "999-99-9999", "9a9aa99a9a99", "#999", "(9)", "(99)", "[99]", "9999-9999", "w9w", "x=99", "@w", "99 999",
         "9 999 999", "w=9a99aa9a9999", "99999999999999999999", "AKIA99A9A9AAA9A9", "9/99", "999.9", "9th", "w99.w"],
}
STOPS = ["", "", "", "", ".", ",", ";", ")", "!"]


def _filled(form: str, rng: np.random.Generator) -> str:
    def word(low: int, high: int) -> str:
        return "".join(rng.choice(list("abdefghilmnoprstu"), rng.integers(low, high)))

    out = []
    for k, c in enumerate(form):
        if c == "9":
            leading = k == 0 or form[k - 1] != "9"
            out.append(str(rng.integers(int(leading and len(form) > 4), 10)))
        elif c == "a":
            out.append(rng.choice(list("abcdefghiklmnoprstu")))
        else:
            out.append(word(2, 9) if c == "w" else c)
    return "".join(out)


def labelled() -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The labelled table: (text, spans), generated by rule from ``FORMS``."""
    rng = np.random.default_rng(1)
    rows = []
    for k in range(SENTENCES):
        text, spans = "", []
        for _ in range(rng.integers(1, 4)):
            text += " ".join("".join(rng.choice(list("aeionrst"), rng.integers(2, 8)))
                             for _ in range(rng.integers(0, 4))) + " "
            kind = list(FORMS)[rng.integers(0, len(FORMS))] if k % 2 else ""
            value = _filled(str(rng.choice(FORMS[kind])), rng)
            if kind == "ip":
                value = ".".join(str(int(p) % 256) for p in value.split("."))
            if kind == "card":
                value = next(value[:-1] + c for c in "0123456789" if luhn(digits(value[:-1] + c)))
            if kind:
                spans.append((kind, len(text), len(text) + len(value)))
            text += value + str(rng.choice(STOPS)) + " "
            if rng.random() < 0.7:
                text += "".join(rng.choice(list("aeionrst"), rng.integers(2, 8))) + " "
        rows.append((text.rstrip(), spans))
    return rows


# ---- the field -------------------------------------------------------------------------------

def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Penalties of starts and transitions: an inside label follows its own kind only."""
    n = len(LABELS)
    start, move = np.zeros(n), np.zeros((n, n))
    for b, label in enumerate(LABELS):
        if label[0] == "I":
            start[b] = FORBIDDEN
            move[:, b] = FORBIDDEN
            for a, before in enumerate(LABELS):
                if before[2:] == label[2:] and before != "O":
                    move[a, b] = 0.0
    return start, move


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


CACHED_SHAPE = 200  # characters of the longest shape whose emissions are kept for the next token like it


class Field:
    def __init__(self, names: dict[str, int], weights: np.ndarray, start: np.ndarray, move: np.ndarray):
        self.names, self.weights, self.start, self.move = names, weights, start, move
        self.cache: dict[tuple, np.ndarray] = {}

    def emissions(self, tokens: list[str]) -> np.ndarray:
        out = np.zeros((len(tokens), len(LABELS)))
        for k, found in enumerate(features(tokens)):
            row = self.cache.get(found)
            if row is None:
                row = self.weights[[self.names[f] for f in found if f in self.names]].sum(axis=0)
                if len(self.cache) < 100_000 and len(found[0]) < CACHED_SHAPE:
                    self.cache[found] = row
            out[k] = row
        return out

    def decode(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of many sequences of emissions: Viterbi over padded batches of like length."""
        order = sorted(range(len(sequences)), key=lambda k: len(sequences[k]))
        out: list[np.ndarray] = [np.zeros(0, int)] * len(sequences)
        while order:
            longest = len(sequences[order[-1]])
            count = max(1, BATCH_CELLS // (longest * len(LABELS)))
            batch, order = order[-count:], order[:-count]
            for k, best in zip(batch, self._viterbi([sequences[k] for k in batch]), strict=True):
                out[k] = best
        return out

    def _viterbi(self, batch: list[np.ndarray]) -> list[np.ndarray]:
        lengths = np.array([len(s) for s in batch])
        n, steps, labels = len(batch), int(lengths.max()), len(LABELS)
        cells = np.zeros((steps, n, labels))
        for k, s in enumerate(batch):
            cells[:len(s), k] = s
        best = self.start + cells[0]
        back = np.zeros((steps, n, labels), np.int16)
        for t in range(1, steps):
            through = best[:, :, None] + self.move
            back[t] = through.argmax(axis=1)
            best = np.where((t < lengths)[:, None], through.max(axis=1) + cells[t], best)
        label = best.argmax(axis=1)
        path = np.zeros((steps, n), int)
        for t in range(steps - 1, -1, -1):
            path[t] = label
            label = np.where(t < lengths, back[t][np.arange(n), label], label) if t else label
        return [path[:size, k] for k, size in enumerate(lengths)]


def _training_runs(table):
    """(tokens, labels) of each run of the labelled table."""
    for text, spans in table:
        for run in runs(text):
            labels = []
            for s, e in run:
                own = next(((k, a) for k, a, b in spans if a < e and s < b), None)
                first = own and not any(x[1] > own[1] for x in run if x[1] <= s)
                labels.append("O" if own is None else f"{'B' if first else 'I'}-{own[0]}")
            yield [text[s:e] for s, e in run], [LABELS.index(x) for x in labels]


def train(table=None) -> Field:
    """Maximum likelihood with an L2 penalty; exact gradients by forward and backward sums. ``table``:
    (text, [(kind, start, end)]) rows, ``labelled()`` by default."""
    data = list(_training_runs(labelled() if table is None else table))
    n, steps, labels = len(data), max(len(t) for t, _ in data), len(LABELS)
    found = [features(t) for t, _ in data]
    names = {f: k for k, f in enumerate(sorted({f for s in found for t in s for f in t}))}
    per_token = len(found[0][0])
    index = np.zeros((n, steps, per_token), int)
    gold = np.zeros((n, steps), int)
    alive = np.zeros((n, steps), bool)
    for k, (own, (_, y)) in enumerate(zip(found, data, strict=True)):
        index[k, :len(y)] = [[names[f] for f in t] for t in own]
        gold[k, :len(y)], alive[k, :len(y)] = y, True
    no_start, no_move = _allowed()
    weights, move = np.zeros((len(names), labels)), np.zeros((labels, labels))
    last = alive.sum(axis=1) - 1
    observed = np.zeros((n, steps, labels))
    observed[np.nonzero(alive) + (gold[alive],)] = 1.0
    pairs = np.zeros((labels, labels))
    both = alive[:, 1:]
    np.add.at(pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1.0)
    state = [(np.zeros_like(weights), np.zeros_like(weights)), (np.zeros_like(move), np.zeros_like(move))]
    for step in range(1, STEPS + 1):
        cells = weights[index].sum(axis=2)
        path = no_move + move
        forward = np.empty_like(cells)
        forward[:, 0] = no_start + cells[:, 0]
        for t in range(1, steps):
            forward[:, t] = _lse(forward[:, t - 1][:, :, None] + path, 1) + cells[:, t]
        backward = np.zeros_like(cells)
        for t in range(steps - 2, -1, -1):
            further = _lse(path + (cells[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where((t < last)[:, None], further, 0.0)
        total = _lse(forward[np.arange(n), last], 1)
        expected = np.where(alive[:, :, None], np.exp(forward + backward - total[:, None, None]), 0.0)
        moved = np.zeros_like(move)
        for t in range(1, steps):
            joint = forward[:, t - 1][:, :, None] + path + (cells[:, t] + backward[:, t])[:, None, :] - total[:, None, None]
            moved += np.exp(joint[alive[:, t]]).sum(axis=0)
        wrong = expected - observed
        down = np.zeros_like(weights)
        np.add.at(down, index[alive], wrong[alive][:, None, :])
        for values, gradient, (first, second) in ((weights, down / n + L2 * weights, state[0]),
                                                  (move, (moved - pairs) / n + L2 * move, state[1])):
            first += 0.1 * (gradient - first)
            second += 0.001 * (gradient * gradient - second)
            values -= RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return Field(names, weights, no_start, no_move + move)


def _passes(kind: str, value: str) -> bool:
    if kind == "email":
        name, _, domain = value.partition("@")
        return bool(name) and "." in domain.strip(".") and "@" not in domain
    if kind == "ip":
        return value.count(".") == 3 and all(p.isdecimal() for p in value.split(".")) and small_parts(value)
    number = digits(value)
    if kind == "card":
        return 13 <= len(number) <= 19 and luhn(number)
    return 7 <= len(number) <= 15


def field_spans(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    """What the field finds in each text, checked."""
    found = [(k, run) for k, text in enumerate(texts) for run in runs(text)]
    emissions = [field.emissions([texts[k][s:e] for s, e in run]) for k, run in found]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (k, run), labels in zip(found, field.decode(emissions), strict=True):
        at = 0
        while at < len(run):
            label = LABELS[labels[at]]
            end = at + 1
            if label[0] == "B":
                while end < len(run) and LABELS[labels[end]] == "I" + label[1:]:
                    end += 1
                text = texts[k]
                start = run[at][0] + core(text[slice(*run[at])])[0]
                stop = run[end - 1][0] + core(text[slice(*run[end - 1])])[1]
                if stop > start and _passes(label[2:], text[start:stop]):
                    out[k].append((label[2:], start, stop))
            at = end
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(texts: list[str], field: Field):
    """(base spans, all spans) of each text, by kind as listed and then by start."""
    out = []
    for text, extra in zip(texts, field_spans(texts, field), strict=True):
        base = base_spans(text)
        more = [x for x in extra if not any(x[1] < e and s < x[2] for _, s, e in base)]
        out.append((base, sorted(base + more, key=lambda x: (KINDS.index(x[0]), x[1]))))
    return out


def mask(text: str, spans) -> str:
    """``text`` with each span replaced by its kind in brackets (overlaps once)."""
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _rows(frames, field: Field, masked: bool):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for pdf in frames:
        texts = [text_or_empty(t) for t in pdf["text"]]
        rows = []
        for doc_id, text, (base, spans) in zip(pdf["doc_id"], texts, find(texts, field), strict=True):
            counts = [sum(s[0] == k for s in base) for k in KINDS]
            rows.append((doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans),
                         len(spans), mask(text, spans) if masked else None))
        yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})


@lru_cache(maxsize=1)
def trained() -> Field:
    return train()


def scan_pii(docs: DataFrame, masked: bool = False, field: Field | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts and digest of the base spans, all spans;
    ``masked`` holds the text without them if asked for (else null)."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(field or trained())  # some thousand weights
    return docs.select("doc_id", "text").mapInPandas(lambda it: _rows(it, shared.value, masked), SCHEMA)
