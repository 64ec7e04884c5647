import random

import numpy as np
import pytest

from prefspark.llm import line_minhash as lm
from prefspark.llm.graph import components
from llm_fixtures import ODD_ROWS, frame, written


def plain_jaccard(a, b):
    x, y = ({s[k:k + lm.SHINGLE_CHARS] for k in range(len(s) - lm.SHINGLE_CHARS + 1)} for s in (a, b))
    return len(x & y) / len(x | y)


def test_jaccard_and_common_counts():
    rng = random.Random(9)
    for letters in ("ab", "abü", "abü日"):
        lines = ["".join(rng.choices(letters, k=rng.randint(8, 60))) for _ in range(60)]
        sets = lm.shingle_sets(lines)
        common = lm._Common(sets[:40]).counts(sets[40:])
        for i in range(40, 60):
            for j in range(40):
                assert lm.jaccard(sets[i], sets[j]) == plain_jaccard(lines[i], lines[j])
                assert common[i - 40, j] == len(np.intersect1d(sets[i], sets[j]))


def brute(rows, similarity=lm.SIMILARITY):
    """Texts without the lines that go; rows in table order."""
    places = [(k, n, lm.normalised(line)) for k, text in enumerate(rows) if text is not None
              for n, line in enumerate(text.split("\n"))]
    places = [p for p in places if lm.eligible(p[2])]
    lines = sorted({p[2] for p in places})
    parent = {x: x for x in lines}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[i + 1:]:
            if plain_jaccard(a, b) >= similarity:
                parent[find(a)] = find(b)
    seen, gone = set(), {}
    for k, n, line in places:
        if find(line) in seen:
            gone.setdefault(k, set()).add(n)
        seen.add(find(line))
    return [t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(k, ()))
            for k, t in enumerate(rows)]


def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(300)]
    pool = [" ".join(rng.choices(words, k=rng.randint(3, 40))) for _ in range(60)]
    texts = []
    for _ in range(120):
        lines = []
        for _ in range(rng.randint(1, 6)):
            line = rng.choice(pool).split() if rng.random() < 0.5 else rng.choices(words, k=20)
            if rng.random() < 0.4 and len(line) > 12:
                line[rng.randrange(len(line))] = "changed"
            lines.append(rng.choice(["", " "]) + " ".join(line))
        texts.append("\n".join(lines))
    return texts


@pytest.mark.parametrize("small, middle", [(4, 1000), (1, 1000), (1, 1), (2, 4)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, small, middle):
    texts = corpus()
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    docs = written(spark, tmp_path, frame(spark, rows, partitions=1).coalesce(1).orderBy("doc_id"))
    # with 1 and 1 every bucket takes the way of large ones, with few representatives and tiny blocks; with 1 and
    # 1000 every one is compared whole
    monkeypatch.setattr(lm, "SMALL_BUCKET", small)
    monkeypatch.setattr(lm, "MIDDLE_BUCKET", middle)
    if middle < 1000:
        monkeypatch.setattr(lm, "REPRESENTATIVES", 1)
        monkeypatch.setattr(lm, "BLOCK_LINES", 2)
    out = {r["doc_id"]: r["text"] for r in lm.dedup(docs).collect()}
    assert [out[k] for k in range(len(texts))] == brute(texts)


def test_odd_rows(spark, tmp_path):
    rows = [*ODD_ROWS, (9, "one two three four five six\none two three four five six", "en", "s")]
    docs = written(spark, tmp_path, frame(spark, rows, extra=True, partitions=1))
    out = lm.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(rows)
    texts = {r["doc_id"]: r["text"] for r in got}
    assert texts[1] is None and texts[2] == "" and texts[9] == "one two three four five six"
    assert sorted(r["text"] for r in got if r["doc_id"] == 4) == ["", "same text here for you"]
    empty = written(spark, tmp_path, frame(spark, []), "none")
    assert lm.dedup(empty).count() == 0


def test_signatures_do_not_depend_on_the_batch():
    lines = [f"line number {k} of a small set of lines" for k in range(300)]
    together = lm.signatures(lines)
    assert all((lm.signatures([x])[0] == y).all() for x, y in zip(lines[::30], together[::30], strict=True))


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(1001, 1200)]
    edges += [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)] + [(5, 5), (3, 2)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_short_lines_and_scripts_without_blanks(spark, tmp_path):
    rng = random.Random(6)
    signs = [chr(c) for c in range(0x4E00, 0x4E00 + 400)]
    passages = ["".join(rng.choices(signs, k=rng.randint(60, 300))) for _ in range(12)]
    short = ["}", "Read more", "the end", "THE END ", "Home", "一二三", "Terms of service", "a b c d", "exactly8"]
    texts = []
    for _ in range(60):
        lines = ["", "  ", *rng.choices(short, k=3)]
        line = rng.choice(passages)
        if rng.random() < 0.3:
            line = line[:-1] + "終"
        texts.append("\n".join(rng.sample([*lines, line], k=len(lines) + 1)))

    def like(a, b):
        x, y = ({s[k:k + 8] for k in range(max(len(s) - 7, 1))} for s in (a, b))
        return len(x & y) / len(x | y) >= 0.8

    distinct = sorted({line.strip().lower() for text in texts for line in text.split("\n")} - {""})
    group = {x: {x} for x in distinct}
    for a in distinct:
        for b in distinct:
            if group[a] is not group[b] and like(a, b):
                group[a] |= group[b]
                for x in group[a]:
                    group[x] = group[a]
    seen, want = set(), []
    for text in texts:
        stay = []
        for line in text.split("\n"):
            plain = line.strip().lower()
            if plain not in seen:
                stay.append(line)
            if plain:
                seen |= group[plain]
        want.append("\n".join(stay))
    docs = written(spark, tmp_path, frame(spark, [(k, t, "zh", "s") for k, t in enumerate(texts)], partitions=1)
                   .coalesce(1).orderBy("doc_id"))
    out = {r["doc_id"]: r["text"] for r in lm.dedup(docs).collect()}
    assert [out[k] for k in range(len(texts))] == want


def test_splits_may_change_between_passes(spark, tmp_path, monkeypatch):
    from prefspark.llm import golay_simhash

    line = "line %d of document %d which says something of its own"
    rows = [(k, "\n".join([*(line % (j, k % 20 if j == 2 else k) * 2 for j in range(k % 4 + 1)), "shared by all of the documents"]),
             "en", "s") for k in range(60)]
    rows += [(k % 7, "repeated text of some documents, word for word " * 5, "en", "s") for k in range(30)]
    docs = written(spark, tmp_path, frame(spark, rows, partitions=9))
    least = "spark.sql.files.minPartitionNum"

    def results():
        spark.conf.set(least, "1")
        lines = sorted((r["doc_id"], r["text"]) for r in lm.drop_repeated_lines(docs).collect())
        spark.conf.set(least, "1")
        return lines, sorted((r["doc_id"], r["text"]) for r in golay_simhash.keep_first(docs).collect())

    def moved(call):
        def run(*args, **kwargs):
            spark.conf.set(least, "500")
            return call(*args, **kwargs)
        return run

    try:
        want = results()
        monkeypatch.setattr(lm, "classes", moved(lm.classes))
        monkeypatch.setattr(golay_simhash, "components", moved(golay_simhash.components))
        assert results() == want
    finally:
        spark.conf.unset(least)


def test_bucket_is_connected_like_a_graph():
    rng = random.Random(11)
    lines = [("".join(rng.choices("abcdef", k=60)))]
    for _ in range(40):  # chains of changed lines, some in another script
        base = rng.choice(lines)
        at = rng.randrange(len(base))
        lines.append(base[:at] + rng.choice(["x", "é", "語"]) + base[at + 1:])
    lines = list(dict.fromkeys(lines))
    sets = lm.shingle_sets(lines)
    group = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if lm.jaccard(sets[i], sets[j]) >= 0.8 and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    assert lm.connected(lines, 0.8).tolist() == group


def test_sparse_and_dense_counts_agree(monkeypatch):
    rng = random.Random(12)
    sets = lm.shingle_sets(["".join(rng.choices("ab", k=rng.randint(8, 90))) for _ in range(150)])
    dense = lm.common_counts(sets)
    monkeypatch.setattr(lm, "DENSE_CELLS", 0)
    assert (lm.common_counts(sets) == dense).all()
    assert all(dense[i, j] == len(set(sets[i]) & set(sets[j])) for i in range(0, 150, 17) for j in range(0, 150, 13))
