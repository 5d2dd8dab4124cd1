"""The pipeline on a small folder of tables."""

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        counts.append(docs.count())
        if name != "mixing":
            assert docs.columns == names
    assert counts[0] > counts[1] == counts[2] > counts[3] >= counts[4] == counts[5]
    assert docs.columns[: len(names)] == names and "taken" in docs.columns


def test_stages_on_empty_and_repeated_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name


def test_ngram_join_stage_decides_by_row(spark, sf_dir):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a, 1), (1, a, 1), (2, a, 2), (2, b, 3), (None, c, 4), (None, c, 4), (None, d, 5), (None, a, 6), (3, "", 7), (3, "", 7), (None, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = corpus_pipeline.ngram_join(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "", r.n_chars) for r in got.collect()) == sorted([(1, a, 1), (2, b, 3), (0, c, 4), (0, d, 5), (3, "", 7), (3, "", 7), (0, "", 8)])
