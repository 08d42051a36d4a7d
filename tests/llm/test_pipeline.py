"""The pipeline's stages on the smallest table, each against a plain check of its input."""

import re

import pytest

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(place / name))
        docs = spark.read.parquet(str(place / name))
        out.append(docs)
    return out


def test_columns_and_sizes(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_dedup", "decontamination", "secret_scans", "best_fit_packing"
    ]
    for docs in stages[1:5]:
        assert docs.dtypes == stages[0].dtypes
    counts = [d.count() for d in stages[:5]]
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] > 0


def test_near_dedup_keeps_one_of_equal_texts(stages):
    texts = [r.text for r in stages[1].collect()]
    kept = [r.text for r in stages[2].collect()]
    assert len(kept) == len(set(kept)) and set(kept) <= set(texts)


def test_secrets_are_gone_and_clean_texts_stay(stages):
    before = {r.doc_id: r for r in stages[3].collect()}
    pattern = re.compile(r"AKIA[0-9A-Z]{16}|password=[0-9a-f]{16}")
    for r in stages[4].collect():
        assert pattern.search(r.text) is None and r.n_chars == len(r.text)
        if "[SECRET]" not in r.text:
            assert r.text == before[r.doc_id].text


def test_packing_covers_what_is_left(stages):
    assert {r.doc_id for r in stages[5].collect()} == {r.doc_id for r in stages[4].collect()}


def test_run_gives_the_same_rows(spark, stages):
    key = ("doc_id", "piece", "length", "ids_crc32")
    got = {tuple(r) for r in corpus_pipeline.run(spark, FOLDER).select(*key).collect()}
    assert got == {tuple(r) for r in stages[5].select(*key).collect()}
