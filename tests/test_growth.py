"""Steps whose work must grow no faster than their input."""

import numpy as np
from pyspark.sql import functions as F

from tracelight.operators import language, ledger, percept
from tracelight.operators.running import nearest_known
from tracelight.streaming import retention


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_probes_are_never_broadcast(spark, tmp_path):
    spark.range(2000).select(F.xxhash64("id").alias("h")).write.parquet(f"{tmp_path}/h")
    pairs = percept._hash_pairs(spark.read.parquet(f"{tmp_path}/h"), 10, [], 4)
    assert "Broadcast" not in plan(pairs)


def test_slices_find_every_pair():
    assert percept._flips(10, 4) == [2, 2, 2, 1]
    for near in range(13):
        for bands in (1, 2, 3, 4, 5):
            flips = percept._flips(near, bands)
            # differing in one bit more than every slice allows is too far apart
            assert sum(k + 1 for k in flips) > near and len(flips) == bands


def test_words_are_cut_into_grams_once(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(i, "the cat and the dog and the cat again", "en") for i in range(20)]
        + [(90, "", None), (91, None, "en"), (92, "12345 67890 12345 67890", "en")],
        "doc_id long, text string, lang string",
    )
    profiles, cut, original = language.language_profiles(docs), [], language._word_grams
    monkeypatch.setattr(language, "_word_grams", lambda words: cut.append(words) or original(words))
    found = language.detect_language(docs, profiles).collect()
    assert len(found) == 23 and {r["doc_id"] for r in found if r["language"] == "en"} == set(range(20))
    assert [words.count() for words in cut] == [5]


def test_following_rows_are_scanned_once(spark):
    rows = spark.range(50).select("id", (F.col("id") % 2).alias("k"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    out = nearest_known(rows, ["k"], ["id"], F.col("v"), "next", following=True)
    assert "unboundedfollowing" not in plan(out).lower()
    for r in out.collect():
        want = [i for i in range(r["id"] + 1, 50) if i % 7 == 0 and i % 2 == r["k"]]
        assert r["next"] == (want[0] if want else None)


def test_a_bucket_is_swept_at_once():
    held = np.zeros(5, retention.HELD)
    for name in ("retention", "deleted", "kept", "purged"):
        held[name] = retention.NONE
    held["id"], held["call"][:2], held["payload"][:2] = np.arange(5), True, True
    held["created"][1] = retention.NONE  # of unknown age: never due
    held["retention"][2], held["deleted"][3], held["arrived"][4] = 5, 0, 10 * retention.DAY
    policy, day = retention.Policy(1, 4, 2), retention.DAY
    left, taken = retention.sweep_bucket(held, 3 * day, policy)
    assert [(step, ids.tolist()) for step, ids in taken] == [(1, [2]), (2, [0]), (3, []), (4, [3])]
    assert left["id"].tolist() == [0, 1, 2, 4] and held["payload"][0] and not left["payload"][0]
    left, taken = retention.sweep_bucket(left, 5 * day, policy)
    assert [(step, ids.tolist()) for step, ids in taken] == [(1, []), (2, []), (3, [2]), (4, [])]
    assert [ids.tolist() for _, ids in retention.sweep_bucket(left, 10 * day, policy)[1]] == [[], [], [4], [2]]


def test_a_call_of_unknown_time_ends_the_chain(spark):
    calls = spark.createDataFrame(
        [(1, "a", None), (2, "a", 0), (3, "a", 60), (4, "a", 7200)], "call_id long, content_key string, s long"
    ).withColumn("created_at", F.timestamp_seconds("s")).withColumn("cost", F.lit(2).cast("decimal(12,6)"))
    got = {r["call_id"]: r["cached"] for r in ledger.dedupe_requests(calls, 3600).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False}
