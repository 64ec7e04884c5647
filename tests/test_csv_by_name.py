"""CSV files are aligned by the names in their headers: batch, tolerant and streaming readers."""

import os

import pytest
from pyspark.sql import functions as F

from plan_utils import plan_text
from prefspark.sources import csv as csv_src
from prefspark.streaming.ingest import ingest_preferences_stream


def write(root, **files):
    os.makedirs(root, exist_ok=True)
    for name, text in files.items():
        with open(os.path.join(root, f"{name}.csv"), "w", newline="") as f:
            f.write(text)
    return str(root)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


MIXED = dict(
    plain='prompt,response_1,response_2\n"p1","a1","b1"\n"p2","a\n2","b,2"\n',
    turned='response_2,prompt,response_1\n"b3","p3","a3"\n',
    lacking='response_1,prompt\n"a4","p4"\n',
    wide='"response_2","score","prompt","response_1","note"\n"b5","0.5","p5","a5",\n',
)
WANT = [("p1", "a1", "b1"), ("p2", "a\n2", "b,2"), ("p3", "a3", "b3"), ("p4", "a4", None), ("p5", "a5", "b5")]


def test_columns_by_name(spark, tmp_path):
    path = write(tmp_path / "drop", **MIXED)
    assert rows(csv_src.read_preferences(spark, path)) == WANT


def test_additional_columns_and_paths(spark, tmp_path):
    path = write(tmp_path / "drop", **MIXED)
    df = csv_src.read_preferences(spark, path, additional=True, path_col="file")
    assert df.columns[:3] == ["prompt", "response_1", "response_2"] and set(df.columns[3:]) == {"file", "score", "note"}
    got = {r["prompt"]: (r["score"], r["note"], os.path.basename(r["file"])) for r in df.collect()}
    assert got["p5"] == ("0.5", None, "wide.csv") and got["p1"] == (None, None, "plain.csv")


def test_typed_columns(spark, tmp_path):
    path = write(tmp_path / "drop", a="score,prompt\n0.5,x\n", b="prompt,n,score\ny,3,1.5\n", c="PROMPT\nz\n")
    df = csv_src.read_preferences(spark, path, schema="prompt string, score double, n long")
    assert rows(df) == [("x", 0.5, None), ("y", 1.5, 3), ("z", None, None)]


def test_tolerant_reader_counts_fields_by_each_files_header(spark, tmp_path):
    path = write(tmp_path / "drop", **MIXED, surplus='response_2,prompt,response_1\n"b","p","a"\n"b","p","a","x"\n',
                 empty_surplus="prompt,response_1\np,a\np,a,\n", short='prompt,response_1,response_2\n"p6"\n')
    good, bad = csv_src.read_preferences_tolerant(spark, path)
    assert rows(good, "prompt", "response_1", "response_2") == sorted([*WANT, ("p6", None, None)], key=str)
    assert sorted(os.path.basename(r["file_path"]) for r in bad.collect()) == ["empty_surplus.csv", "surplus.csv"]
    good, _ = csv_src.read_preferences_tolerant(spark, path, additional=True)
    assert {r["score"] for r in good.collect()} == {None, "0.5"}


def test_headers_that_differ_in_writing_only(spark, tmp_path):
    path = write(tmp_path / "drop", bom="\ufeffprompt,response_1,response_2\np1,a,b\n", crlf="prompt,response_1,response_2\r\np2,a,b\r\n",
                 blank='\n\n"prompt","response_1","response_2"\np3,a,b\n', header_only="prompt,response_1,response_2\n",
                 nothing="", twice="prompt,prompt,response_1\np4,x,a\n")
    df = csv_src.read_preferences(spark, path, additional=True)
    assert rows(df, "prompt", "response_1", "response_2") == [("p1", "a", "b"), ("p2", "a", "b"), ("p3", "a", "b"), ("p4", "a", None)]
    assert {r["prompt.1"] for r in df.select(F.col("`prompt.1`")).collect()} == {None, "x"}


def test_paths_with_odd_characters(spark, tmp_path):
    path = write(tmp_path / "drop dir", **{"a b": "prompt,response_1\np1,a\n", "c%20d": "response_1,prompt\na,p2\n",
                                           "e[1]{x}": "response_2,prompt\nb,p3\n", "é": "response_2,prompt,response_1\nb,p4,a\n"})
    assert rows(csv_src.read_preferences(spark, path)) == [("p1", "a", None), ("p2", "a", None), ("p3", None, "b"), ("p4", "a", "b")]


def test_folders_and_recursive_reads(spark, tmp_path):
    for k, name in enumerate(("plain", "turned")):
        write(tmp_path / "parts" / f"run={k}", **{name: MIXED[name]})
        write(tmp_path / "tree" / str(k + 1), **{f"{k}_7": MIXED[name]})
    df = csv_src.read_preferences(spark, str(tmp_path / "parts"))
    assert rows(df, "prompt", "response_1", "run") == [("p1", "a1", 0), ("p2", "a\n2", 0), ("p3", "a3", 1)]
    deep = csv_src.read_preferences(spark, str(tmp_path / "tree"), recursive=True, path_col="file_path")
    got = rows(csv_src.with_lineage(deep), "prompt", "response_2", "constitution_id", "context_id", "run_id")
    assert got == [("p1", "b1", 1, 0, 7), ("p2", "b,2", 1, 0, 7), ("p3", "b3", 2, 1, 7)]


def test_no_files(spark, tmp_path):
    path = write(tmp_path / "none")
    assert csv_src.read_preferences(spark, path).count() == 0
    good, bad = csv_src.read_preferences_tolerant(spark, path)
    assert good.count() == 0 and bad.count() == 0


def test_broken_header_is_reported(spark, tmp_path):
    path = write(tmp_path / "drop", a='prompt,"response_1\nx,y\n')
    with pytest.raises(ValueError, match="a.csv"):
        csv_src.read_preferences(spark, path)


def test_large_file_split_over_tasks_has_one_header(spark, tmp_path):
    """Lines of the blocks behind a file's first one are no headers."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    path = write(tmp_path / "drop", big="prompt,response_1,response_2\n" + "".join(f"p{i},a,b\n" for i in range(3000)),
                 small="response_1,prompt\na,q\n")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        lines = csv_src.file_lines(spark.read, path)
        assert lines.rdd.getNumPartitions() > 4
        assert sorted(len(names) for names, _ in csv_src.layouts(spark, lines)) == [2, 3]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert csv_src.read_preferences(spark, path).where("response_1 = 'a'").count() == 3001


def test_header_pass_moves_numbers_only(spark, tmp_path):
    plan = plan_text(csv_src.file_headers(csv_src.file_lines(spark.read, write(tmp_path / "drop", **MIXED))))
    assert "SortAggregate" not in plan and plan.count("HashAggregate") >= 2


def test_stream_reads_by_name(spark, tmp_path):
    drop, out, ckpt = (str(tmp_path / x) for x in ("drop", "out", "ckpt"))
    write(drop, plain=MIXED["plain"], turned=MIXED["turned"])
    ingest_preferences_stream(spark, drop, out, ckpt)
    write(drop, lacking=MIXED["lacking"], wide=MIXED["wide"], bad="response_1,prompt\na,p\na,p,x\n")
    ingest_preferences_stream(spark, drop, out, ckpt, max_files_per_trigger=1)
    assert rows(spark.read.parquet(out), "prompt", "chosen", "rejected") == WANT
