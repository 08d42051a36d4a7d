"""Near-duplicates in dense regions: families of copies with stragglers, and shared passages."""

import random

import pytest
from pyspark.sql import functions as F

from tracelight.llm import lsh_forest
from tracelight.llm.common import stored


def changed(rng, words, n, name):
    out = list(words)
    for k, i in enumerate(rng.sample(range(len(out)), n)):
        out[i] = f"{name}x{k}"
    return out


@pytest.mark.parametrize("copies", [100, 400, 1500])
def test_links_to_one_member_of_a_large_family(spark, copies):
    """A straggler is similar enough to the stem (0.802), not to its other copies (0.73), which
    are closer to each other (0.82) than to it."""
    rng = random.Random(copies)
    stem = [f"w{k}" for k in range(400)]
    rows = [(0, stem)]
    rows += [(i, changed(rng, stem, 20, f"c{i}")) for i in range(1, copies + 1)]
    late = range(100_000, 100_020)
    rows += [(i, changed(rng, stem, 44, f"s{i}")) for i in late]
    rows += [(i, changed(rng, stem, 60, f"o{i}")) for i in range(200_000, 200_020)]  # 0.74: strangers
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in lsh_forest.near_duplicates(docs, width=1).collect()}
    assert all(got[i] == 0 for i in late)
    assert all(got[i] == 0 for i in range(copies + 1))
    assert all(got[i] == i for i in range(200_000, 200_020))


def test_a_shared_passage_makes_no_pairs(spark):
    """Texts that share three fifths of their words and no more: many regions, hardly a pair."""
    rng = random.Random(1)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, passage + " " + " ".join(f"d{i}n{k}" for k in range(rng.randint(36, 44)))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    every = stored(docs.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("component")))
    assert lsh_forest.crowded_candidates(docs, every, 1, 80).count() < 200
    assert lsh_forest.near_duplicates(docs, width=1).filter("kept").count() == 2000


def test_rare_shingles_lose_no_link(spark):
    """Random sets over few words: the candidates hold every pair that is similar enough."""
    rng = random.Random(2)
    sets = {i: set(rng.sample(range(24), rng.randint(1, 22))) for i in range(300)}
    docs = spark.createDataFrame(
        [(i, " ".join(f"t{k}" for k in s)) for i, s in sets.items()], "doc_id long, text string"
    )
    every = stored(docs.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("component")))
    got = {tuple(r) for r in lsh_forest.crowded_candidates(docs, every, 1, 80).collect()}
    want = {
        (a, b)
        for a in sets
        for b in sets
        if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    }
    assert want <= got and len(want) > 50
