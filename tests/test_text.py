"""Text scalars against plain Python semantics (property-based)."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prefspark.functions import templates as T
from prefspark.functions import text as X

TOKENS = st.sampled_from(list("ab yZ,.\"'\t\n\r") + ["\u00a0", "\u2003", "é", "1", "0", "²", "Response 1:"])
TEXTS = st.lists(st.lists(TOKENS, max_size=30).map("".join), min_size=1, max_size=20)


def _py_parse(s):
    if s is None:
        return None
    d = "".join(ch for ch in s.strip() if ch.isdigit())
    return int(d) if d in ("0", "1") else None


@settings(max_examples=15, deadline=None)
@given(TEXTS)
def test_strip_wordcount_label_like_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.select("i", X.strip_ws("t").alias("s"), X.word_count("t").alias("w"),
                    X.strip_label("t", "Response 1:").alias("l")).orderBy("i").collect()
    for row, t in zip(out, texts):
        assert row["s"] == t.strip()
        assert row["w"] == len(t.split())
        assert row["l"] == t.replace("Response 1:", "").strip()


@settings(max_examples=15, deadline=None)
@given(TEXTS)
def test_parse_preference_like_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.select("i", X.parse_preference("t").alias("p")).orderBy("i").collect()
    for row, t in zip(out, texts):
        assert row["p"] == _py_parse(t)


def test_parse_preference_edges(spark):
    cases = ["0", " 1.", "1", "01", "", None, "Response 1 ... 0", "none", "²0", "The answer is 1"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = [r["p"] for r in df.select("i", X.parse_preference("t").alias("p")).orderBy("i").collect()]
    assert got == [0, 1, 1, None, None, None, None, None, None, 1]


def test_fmt4_keeps_null(spark):
    df = spark.createDataFrame([(0.38234,), (None,), (0.5,)], "x double")
    assert [r[0] for r in df.select(X.fmt4("x")).collect()] == ["0.3823", None, "0.5000"]


def test_ceil_div_and_take_count(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 7, 8, 9)], "n long")
    got = df.select(X.ceil_div("n", F.lit(8)).alias("b"), X.take_count(0.6, F.col("n")).alias("k")).collect()
    assert [r["b"] for r in got] == [0, 1, 1, 1, 2]
    assert [r["k"] for r in got] == [int(0.6 * n) for n in (0, 1, 7, 8, 9)]


def test_templates_render_like_python_format(spark):
    row = ("CONST", "Is it fair?", "Yes.", "No.")
    df = spark.createDataFrame([row], "c string, p string, a string, b string")
    for v, tpl in T.JUDGE_TEMPLATES.items():
        got = df.select(T.judge_prompt("c", "p", "a", "b", v)).first()[0]
        assert got == tpl.format(constitution="CONST", prompt="Is it fair?", response_1="Yes.", response_2="No.")
    gen = df.select(T.generator_prompt("c", F.lit("Health and Well-being"), F.lit(20))).first()[0]
    assert "only in Health and Well-being context. Give me 20 such examples." in gen
    assert not re.search(r" f(Health|20)", gen)


def test_unknown_template_lists_choices():
    try:
        T.judge_prompt("c", "p", "a", "b", "v9")
    except ValueError as ex:
        assert "v1" in str(ex)
    else:
        raise AssertionError("expected ValueError")


ARRAYS = st.lists(st.lists(st.integers(0, 50), max_size=12), min_size=1, max_size=15)


@settings(max_examples=10, deadline=None)
@given(ARRAYS, st.integers(1, 8))
def test_truncate_and_pad_like_python(spark, arrays, n):
    from prefspark.functions import arrays as A
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<int>")
    out = df.select("i", A.truncate_right("a", n).alias("r"), A.truncate_left("a", n).alias("l"),
                    A.pad_left("a", n, 0).alias("p"), A.eos_penalty(F.lit(1.0), "a", 7, 1.0).alias("e"),
                    A.mean_logit(F.array(F.col("a").cast("array<double>"))).alias("m")).orderBy("i").collect()
    for row, a in zip(out, arrays):
        assert row["r"] == a[:n]
        assert row["l"] == a[-n:] if a else row["l"] == []
        assert row["p"] == [0] * max(n - len(a), 0) + a
        assert row["e"] == (1.0 if 7 in a else 0.0)
        assert (row["m"] is None) if not a else abs(row["m"] - sum(a) / len(a)) < 1e-9


def test_tokenize_keeps_null_texts_on_both_paths(spark):
    from prefspark.operators.tokenize import tokenize
    _lengths = lambda: lambda texts: [[len(w) for w in t.split()] for t in texts]
    df = spark.createDataFrame([(1, "a bb"), (2, None), (3, ""), (None, "ccc")], "`odd key` long, text string")
    for extra in (df, df.where("text is null")):
        by_backend = {r[0]: r[1] for r in tokenize(extra, "text", ["odd key"], tokenizer=_lengths).collect()}
        built_in = {r[0]: r[1] for r in tokenize(extra, "text", ["odd key"]).collect()}
        assert by_backend.keys() == built_in.keys() and by_backend[2] is None and built_in[2] is None
    assert by_backend == {2: None}
    assert {r[0]: r[1] for r in tokenize(df, "text", ["odd key"], tokenizer=_lengths).collect()} == {
        1: [1, 2], 2: None, 3: [], None: [3]}
