"""Every operator on odd rows and on an empty table."""

import pytest
from pyspark.sql import functions as F

from tracelight.llm import (
    context_mixing,
    language_codes,
    lsh_forest,
    packing,
    pii_segments,
    quality_rules,
    secret_forest,
    token_counts,
    url_model,
    winnowing,
)

ITEMS = "item_id long, text string"


def languages(docs, labels):
    model = language_codes.train(docs.select("text", "lang"), F.lit(True))
    return language_codes.predict_language(docs, model)


def pii(docs, labels):
    return pii_segments.find_personal_data(docs, pii_segments.train(docs.select("text")))


def contaminated(docs, labels):
    rows = [(1, "the cat sat on the mat"), (2, None), (3, ""), (None, "one"), (4, "one")]
    return winnowing.decontaminate(docs, docs.sparkSession.createDataFrame(rows, ITEMS))


def scores(docs, labels):
    return context_mixing.score_texts(
        docs.withColumn("train", F.lit(True)), table_bits=12, hot_tokens=2
    )


PER_ROW = {
    "languages": languages,
    "pii": pii,
    "quality": quality_rules.apply_quality_rules,
    "winnowing": contaminated,
    "near": lambda docs, labels: lsh_forest.near_duplicates(docs),
    "redacted": lambda docs, labels: secret_forest.redact_secrets(docs),
}
PER_ID = {
    "tokens": lambda docs, labels: token_counts.token_counts(docs, hot_tokens=2),
    "scores": scores,
}
OTHER = {
    "pieces": lambda docs, labels: packing.pack_documents(docs, capacity=64),
    "secrets": lambda docs, labels: secret_forest.scan_secrets(docs),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_odd_rows_keep_their_number(odd, labels, name):
    assert PER_ROW[name](odd, labels).count() == odd.count()


@pytest.mark.parametrize("name", PER_ID)
def test_odd_rows_by_id(odd, labels, name):
    assert PER_ID[name](odd, labels).count() == odd.select("doc_id").distinct().count()


@pytest.mark.parametrize("name", [*PER_ROW, *PER_ID, *OTHER])
def test_empty_table(odd, labels, name):
    operator = {**PER_ROW, **PER_ID, **OTHER}[name]
    assert operator(odd.limit(0), labels.limit(0)).count() == 0


def test_urls(spark):
    rows = [
        (1, None), (2, ""), (3, "no-scheme.example.net/en/"), (4, "HTTP://Sub.Example.NET/en/x?y#z"),
        (4, "HTTP://Sub.Example.NET/en/x?y#z"), (None, "http://net"), (5, "http://a.net/q"),
        (6, "x://example.com/de/"), (7, "x://badexample.com/de/"), (8, "http://" + "a" * 20_000),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("text", F.lit(1))
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block"}
    out = url_model.filter_urls(pages, rules)
    got = {(r["page_id"], r["host"][:20], r["path"], r["rule"]): r["verdict"] for r in out.collect()}
    assert out.count() == len(rows)
    assert got[4, "sub.example.net", "/en/x", "example.net/en/"] == "allow"
    assert got[5, "a.net", "/q", "net/"] == "block"
    assert got[6, "example.com", "/de/", "example.com/de/"] == "block"
    assert (None, "net", "", None) in got and (7, "badexample.com", "/de/", None) in got
    assert (1, "", "", None) in got and (3, "", "", None) in got
    assert url_model.filter_urls(pages.limit(0), rules).count() == 0


def test_near_edges(odd):
    got = [r.asDict() for r in lsh_forest.near_duplicates(odd, width=2).collect()]
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[7]["component_id"] == 6 and not by_id[7]["kept"]
    assert by_id[None]["kept"] and by_id[None]["component_id"] is None
    assert all(by_id[k]["n_shingles"] == 0 and by_id[k]["kept"] for k in (1, 2, 3))
    assert by_id[5]["n_shingles"] == 1


def test_redaction_keeps_columns(odd):
    out = secret_forest.redact_secrets(odd)
    assert out.columns == odd.columns and out.schema["text"].dataType == odd.schema["text"].dataType


@pytest.mark.parametrize("kind", ["int", "string"])
def test_ids_of_other_types(odd, labels, kind):
    docs = odd.filter("coalesce(doc_id, 0) <> 4").withColumn("doc_id", F.col("doc_id").cast(kind))
    for build in (languages, pii, PER_ID["tokens"], PER_ID["scores"], OTHER["pieces"], OTHER["secrets"]):
        out = build(docs, labels)
        assert dict(out.dtypes)["doc_id"] == kind
        out.write.format("noop").mode("overwrite").save()


def test_pieces_with_clashing_columns(odd):
    names = {"_group": 1, "_group_": 2, "offset": 3, "sequence_id": 4}
    pieces = packing.stored(packing.tokenized_pieces(odd, 64))
    clashing = packing.stored(pieces.withColumns({k: F.lit(v) for k, v in names.items()}))
    out = packing.pack(clashing, 64)
    assert out.count() == pieces.count()
    assert out.agg(F.max("_group"), F.max("_group_")).first()[:] == (1, 2)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 64").isEmpty()
