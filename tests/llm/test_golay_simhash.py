import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from prefspark.llm import golay_simhash
from llm_fixtures import ODD_ROWS, frame, written


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=100, deadline=None)
@given(st.text("aAbB éÉ \n\t", max_size=60))
def test_fingerprint(text):
    assert golay_simhash.fingerprint(text) == brute_fingerprint(text)


def test_code_is_perfect():
    words = np.random.default_rng(0).integers(0, 1 << 23, 2000)
    index, s, nearby = golay_simhash.decode(words)
    errors = golay_simhash.nearby_errors()[s]
    own = words ^ errors[:, 0]
    assert (golay_simhash.syndrome(own) == 0).all() and (np.bitwise_count(errors[:, 0]) <= 3).all()
    assert ((nearby >= 0).sum(axis=1) <= 6).all() and (own >> 11 == index).all()


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=2))
def test_fingerprints_two_bits_apart_share_a_key(x, bits):
    y = x
    for b in bits:
        y ^= 1 << b
    own = [set(golay_simhash.keys(np.array([v], np.uint64).view(np.int64))[1].tolist()) for v in (x, y)]
    assert own[0] & own[1]


def linked(fps, bits):
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= bits:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def _check_links(spark, values, bits, small):
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    old, golay_simhash.SMALL_KEY = golay_simhash.SMALL_KEY, small
    try:
        edges = golay_simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), bits).collect()
    finally:
        golay_simhash.SMALL_KEY = old
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for r in edges:
        a, b = r["a"] % (1 << 64), r["b"] % (1 << 64)
        parent[find(a)] = find(b)
    expected = linked(values, bits)
    for a in values:
        for b in values:
            assert (find(a) == find(b)) == (expected[a] == expected[b])


def test_components_of_links_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    values = set()
    for _ in range(25):
        v = int(rng.integers(0, 1 << 63)) * 2 + 1
        for _ in range(8):
            values.add(v)
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                v ^= 1 << int(b)
    for bits in (0, 1, 2):
        for small in (64, 2):  # with 2 nearly all keys take the way of crowded keys
            _check_links(spark, sorted(values), bits, small)


def test_near_duplicates_and_keep_first(spark, tmp_path):
    base = " ".join(f"w{k}" for k in range(400))
    rows = [*ODD_ROWS, *[(100 + k, base, "en", "s") for k in range(5)], (200, base + " x", "en", "s"),
            (201, "entirely other words are written here", "en", "s")]
    docs = written(spark, tmp_path, frame(spark, rows, extra=True))
    out = golay_simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    ids = {i: t for i, t, _, _ in rows}
    fps = {golay_simhash.fingerprint(t or "") for t in ids.values()}
    root = linked(sorted(fps), 2)
    for r in out:
        mates = [i for i, t in ids.items() if i is not None
                 and root[golay_simhash.fingerprint(t or "")] == root[golay_simhash.fingerprint(ids[r["doc_id"]] or "")]]
        assert r["component_id"] == (min(mates) if mates else None)
    kept = golay_simhash.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    least = {}
    for i, t in ids.items():
        key = root[golay_simhash.fingerprint(t or "")]
        least[key] = min(least.get(key, (True, 0)), (i is None, i or 0)) if key in least else (i is None, i or 0)
    assert got == sorted(least.values())
    assert golay_simhash.near_duplicates(frame(spark, [])).count() == 0
