import corpus_pipeline
from prefspark.llm import golay_simhash, line_minhash, mcd_quality, secret_scan
from llm_fixtures import ODD_ROWS, frame, written

SF = "/root/testdata/sf0.001"


def test_stages_and_their_decisions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_dedup", "secrets", "packing"]
    kept = written(spark, tmp_path, stages["quality"](spark, docs, SF), "quality")
    verdict = {r["doc_id"]: r["kept"] for r in mcd_quality.judge(docs).collect()}
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, k in verdict.items() if k)
    lines = written(spark, tmp_path, stages["line_dedup"](spark, kept, SF), "lines")
    assert lines.columns == docs.columns and lines.count() == kept.count()
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect() if r["text"] is not None)
    near = written(spark, tmp_path, stages["near_dedup"](spark, lines, SF), "near")
    groups = {r["component_id"] for r in golay_simhash.near_duplicates(lines).collect()}
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(groups)
    clean = written(spark, tmp_path, stages["secrets"](spark, near, SF), "clean")
    assert clean.columns == docs.columns and clean.count() == near.count()
    assert all(not secret_scan.find(r["text"] or "") for r in clean.collect())
    packed = stages["packing"](spark, clean, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in clean.collect()}


def test_odd_rows_pass_through(spark, tmp_path):
    docs = written(spark, tmp_path, frame(spark, ODD_ROWS, extra=True))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = written(spark, tmp_path, stage(spark, docs, SF), name)
        assert out.columns == docs.columns
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    whole = {}
    for r in packed:
        whole.setdefault(r["doc_id"], [0, set()])[0] += r["length"]
        whole[r["doc_id"]][1].add(r["doc_tokens"])
    assert whole.keys() == {r["doc_id"] for r in docs.collect()}
    for doc_id, (length, tokens) in whole.items():  # null and empty texts are one end mark; a repeated id counts by row
        copies = docs.where(docs.doc_id.eqNullSafe(doc_id)).count()
        assert length == next(iter(tokens)) * copies if len(tokens) == 1 else length >= sum(tokens)
    empty = written(spark, tmp_path, frame(spark, []), "empty")
    for name, stage in corpus_pipeline.STAGES:
        assert written(spark, tmp_path, stage(spark, empty, SF), f"empty-{name}").count() == 0


def test_line_dedup_uses_the_operator(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = {r["doc_id"]: r["text"] for r in line_minhash.drop_repeated_lines(docs).collect()}
    b = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, SF).collect()}
    assert a == b
