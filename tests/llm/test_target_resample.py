import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from prefspark.llm import target_resample as T
from llm_fixtures import ODD_ROWS, frame

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered)


def brute(docs, target, percent=10, max_run=1):
    """The rules word for word: (doc_id, n_features, weight, score, rank), sorted."""
    def features(text):
        w = words_of(text)
        return [" ".join(w[k:k + n]) for n in range(1, max_run + 1) for k in range(len(w) - n + 1)]

    def counts(texts):
        held = {}
        for text in texts:
            for f in features(text):
                b = zlib.crc32(f.encode()) % 10000
                held[b] = held.get(b, 0) + 1
        return held

    s, t = counts(x for _, x in docs), counts(target)
    all_s, all_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t.get(b, 0) + 1) * (all_s + 10000) / ((s.get(b, 0) + 1) * (all_t + 10000))))

    rows = []
    for doc_id, text in docs:
        f = features(text)
        weight = sum(gain(zlib.crc32(x.encode()) % 10000) for x in f) // len(f) if f else 0
        name = "" if doc_id is None else str(doc_id)
        h = int(hashlib.sha256(f"2024:{name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([len(words_of(text)) >= 20, doc_id, len(f), weight, score])
    able = sorted((r for r in rows if r[0]), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2]))
    drawn = {}
    for rank, row in enumerate(able[:len(able) * percent // 100], 1):
        drawn[id(row)] = rank
    return sorted(((r[1], *r[2:], drawn.get(id(r))) for r in rows), key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=str)


def texts(n):
    return [(k, " ".join(f"w{(k * j) % 97}É tail{j % (k % 13 + 1)}" for j in range(k % 40))) for k in range(n)]


@pytest.mark.parametrize("percent", [0, 1, 10, 50, 100])
def test_equals_the_rules(spark, percent):
    docs = texts(300)
    target = ["w1é tail0 w2É", None, "", "Tail3 tail4 W5"]
    df = frame(spark, [(k, x, "en", "s") for k, x in docs], partitions=5)
    aim = spark.createDataFrame([(x,) for x in target], "text string")
    assert result(T.resample(df, aim, percent)) == brute(docs, target, percent)


def test_longer_runs(spark):
    docs = texts(80)
    df = frame(spark, [(k, x, "en", "s") for k, x in docs])
    aim = spark.createDataFrame([("w1É tail0 w2É",)], "text string")
    assert result(T.resample(df, aim, 30, max_run=3)) == brute(docs, ["w1É tail0 w2É"], 30, 3)


def test_repeated_ids_and_copies_are_drawn_by_number(spark):
    """A third of the rows are copies of one row; the cut falls among them."""
    long = " ".join(f"w{j}" for j in range(30))
    docs = [*texts(120), *[(7, long)] * 60, *[(None, long)] * 5]
    df = frame(spark, [(k, x, "en", "s") for k, x in docs], partitions=7)
    aim = spark.createDataFrame([(long,)], "text string")
    for percent in (5, 20, 33, 70):
        out = result(T.resample(df, aim, percent))
        assert out == brute(docs, [long], percent)
        ranks = sorted(r[4] for r in out if r[4])
        assert ranks == list(range(1, len(ranks) + 1))


def test_tied_scores_go_to_smaller_ids(spark):
    """One id's noise for all: equal weights, equal scores; ids decide, rows without an id come last."""
    rows = [(k if k % 4 else None, 25, 25, 0, 50) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, n_words long, n_features long, weight long, score long").repartition(6)
    out = T.draw(df, 50).where("rank is not null").orderBy("rank").collect()
    ids = sorted(k for k in range(200) if k % 4)
    assert [r["id"] for r in out] == ids[:100]
    out = T.draw(df, 90).where("rank is not null").orderBy("rank").collect()
    assert [r["id"] for r in out] == ids + [None] * 30


def test_odd_rows_and_kept_columns(spark):
    df = frame(spark, ODD_ROWS, extra=True).withColumn("rank", F.lit("mine")).withColumn("score", F.lit(2.5))
    aim = spark.createDataFrame([(None,), ("word word",)], "text string")
    out = T.resample(df, aim, 100, keep=df.columns)
    assert out.columns == [*[c + "_doc" if c in ("rank", "score") else c for c in df.columns], *T.STATS]
    assert out.count() == len(ODD_ROWS) and {r[0] for r in out.select("rank_doc").collect()} == {"mine"}
    assert result(out) == brute([(i, t) for i, t, _, _ in ODD_ROWS], [None, "word word"], 100)


def test_empty_tables(spark):
    none = frame(spark, [])
    aim = spark.createDataFrame([], "text string")
    assert result(T.resample(none, aim)) == []
    docs = texts(60)
    df = frame(spark, [(k, x, "en", "s") for k, x in docs])
    assert result(T.resample(df, aim, 20)) == brute(docs, [], 20)


def test_bisection_finds_the_least(spark):
    held = [0, 0, 3, 3, 4, 9, 9, 9, 20]
    jobs = []

    def counts(tried):
        jobs.append(len(tried))
        return [held[t] for t in tried]

    for k in (1, 3, 4, 5, 9, 10, 20):
        assert T._least(counts, k, -1, 8) == next(j for j, n in enumerate(held) if n >= k)
    assert max(jobs) <= (1 << T.HALVINGS) - 1
