import hashlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelight.operators import graph, percept, similarity
from tracelight.operators.fingerprints import (
    PRIME,
    minhash_signatures,
    permutations,
    text_fingerprints,
)
from tracelight.operators.text import normalize_corpus

WORDS = [f"w{i}" for i in range(400)]


def texts(rng, n, base, noise):
    out = []
    for _ in range(n):
        words = list(base)
        for at in rng.choice(len(words), noise, replace=False):
            words[at] = rng.choice(WORDS)
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    base, other = list(rng.choice(WORDS, 120)), list(rng.choice(WORDS, 120))
    # two crowded families around shared wording, loners, copies and empty texts
    found = texts(rng, 25, base, 3) + texts(rng, 25, other, 12) + [" ".join(rng.choice(WORDS, 60)) for _ in range(30)]
    found += [found[0], found[0].upper(), found[0] + "  ", "", "!!"]
    # equal shingle sets in different order of repetition: another text, the same signature
    found += [" ".join([*base, *base]), " ".join([*base, *base, *base])]
    df = spark.createDataFrame([(i, x, "a" if i % 2 else "b") for i, x in enumerate(found)], "doc_id long, text string, source string")
    return text_fingerprints(normalize_corpus(df), keep=("doc_id", "source")).cache()


def brute(corpus, threshold):
    """Stars of equal signatures, and links between centres, by comparing everything."""
    texts, centres, pairs = {}, {}, {}
    for r in sorted(corpus.collect(), key=lambda r: r.doc_id):
        if r.sig[0] != 1 << 32:
            texts.setdefault(r.canonical_sha256, r)
    for r in texts.values():
        centre = centres.setdefault(tuple(r.sig), r)
        if centre.doc_id != r.doc_id:
            pairs[centre.doc_id, r.doc_id] = 1.0
    for a, b in combinations(centres.values(), 2):
        same = sum(x == y for x, y in zip(a.sig, b.sig)) / 64
        if same >= threshold:
            pairs[a.doc_id, b.doc_id] = same
    return pairs


@pytest.mark.parametrize("hot", [1, 5, 1000])
@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.9])
def test_exact_search_finds_all_pairs_whatever_counts_as_hot(corpus, hot, threshold):
    got = similarity.near_duplicates(corpus, threshold, hot=hot).collect()
    assert {(r.id_a, r.id_b): r.jaccard for r in got} == brute(corpus, threshold)


def test_signatures_are_exact_beside_a_null_text_and_across_blocks(spark):
    rng = np.random.default_rng(11)
    found = [" ".join(rng.choice(WORDS, n)) for n in (1, 4, 5, 6, 300, 9000, 9000, 40)] + ["", None, "w1 w2"]
    rows = spark.createDataFrame(list(enumerate(found)), "doc_id long, canonical string").coalesce(1)
    got = {r.doc_id: r for r in minhash_signatures(rows).collect()}
    for i, text in enumerate(found):
        if text is None:
            assert got[i].shingle_count == 1
            continue
        words = text.split()
        grams = {" ".join(words[j : j + 5]) for j in range(max(len(words) - 4, 1))} if words else set()
        hashes = [int(hashlib.md5(g.encode()).hexdigest()[:8], 16) for g in grams]
        assert got[i].shingle_count == len(grams)
        assert got[i].sig == [min(((a * h + b) % PRIME for h in hashes), default=1 << 32) for a, b in permutations()]


def test_bands_find_a_subset(corpus):
    banded = {(r.id_a, r.id_b) for r in similarity.near_duplicates(corpus, 0.5, exact=False).collect()}
    assert banded <= set(brute(corpus, 0.5))


def test_relation_ladder_and_expansion(spark, corpus):
    similar = similarity.similar_items(corpus)
    first = similar.filter("doc_id = 0").orderBy("position").collect()
    assert [r.relation for r in first][:3] == ["exact", "normalized", "canonical"] or [
        r.relation for r in first
    ][:2] == ["exact", "canonical"]
    ids = spark.createDataFrame([(0,)], "doc_id long")
    partners = similarity.expand_partners(similar, corpus, ids).collect()
    assert len({r.other for r in partners}) == len(partners)
    assert sum(r.members for r in first) == len(partners)


def test_owners_never_meet(corpus):
    near = similarity.near_duplicates(corpus, 0.5, owner="source")
    owner = {r.doc_id: r.source for r in corpus.select("doc_id", "source").collect()}
    assert all(owner[r.id_a] == owner[r.id_b] == r.source for r in near.collect())


def test_hamming_finds_exactly_the_close_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**62), 2**62, 60)
    hashes = list(base)
    for h in base:
        for flips in (1, 6, 10, 11):
            mask = sum(1 << int(b) for b in rng.choice(63, flips, replace=False))
            hashes.append(int(h) ^ mask)
    rows = [(i, f"s{i}", int(h), int(rng.integers(-(2**62), 2**62)), 0) for i, h in enumerate(hashes)]
    fp = spark.createDataFrame(rows, "item_id long, sha256 string, phash long, dhash long, ahash long")
    rows += [(1000 + i, f"s{i}" if i % 2 else f"t{i}", rows[i][2], 7, 0) for i in range(6)]
    fp = spark.createDataFrame(rows, "item_id long, sha256 string, phash long, dhash long, ahash long")
    partners = percept.expand_neighbors(percept.hamming_neighbors(fp), fp, fp).collect()
    got = {(r.item_id, r.other) for r in partners if r.item_id < r.other}
    assert {(r.other, r.item_id) for r in partners if r.item_id > r.other} == got

    def distance(x, y):
        return bin((x ^ y) & (2**64 - 1)).count("1")

    want = {
        (a[0], b[0])
        for a, b in combinations(rows, 2)
        if a[1] == b[1] or min(distance(a[2], b[2]), distance(a[3], b[3])) <= 10
    }
    assert got == want


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(1, i) for i in range(2, 40)]
    edges = spark.createDataFrame(path + star, "u long, v long")
    found = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 40)}}


def test_dct_hash_matches_a_plain_computation(spark):
    rng = np.random.default_rng(1)
    grid = rng.normal(size=(8, 8))
    df = spark.createDataFrame([(grid.ravel().tolist(),)], "px array<double>")
    got = percept.percept_hashes(df, "px").select(F.lpad(F.bin("phash"), 64, "0")).first()[0]
    n = np.arange(8)
    basis = np.array([[np.cos(np.pi * (2 * i + 1) * k / 16) for i in n] for k in n]) * np.sqrt(0.25)
    basis[0] /= np.sqrt(2)
    low = np.round(basis @ grid @ basis.T, 6)
    assert got == "".join("1" if x else "0" for x in (low > np.median(low)).ravel())


def test_stars_are_the_two_levels_they_need(spark, corpus):
    odd = corpus.limit(3).withColumn("sha256", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 900)
    gone = corpus.limit(2).withColumn("source", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long"))
    null = corpus.limit(2).select(
        "doc_id", "source", *[F.lit(None).cast("string").alias(c) for c in ("sha256", "normalized_sha256", "canonical_sha256")],
        "shingle_count", "sig",
    )
    fp = corpus.unionByName(corpus.limit(9)).unionByName(odd).unionByName(gone).unionByName(null)
    for owner in (None, "source"):
        by = [owner] if owner else []
        full = similarity.copy_groups(fp, owner=owner).select(*by, "sig_rep", "canonical_rep").distinct()
        stars = similarity._canonical_stars(fp, "doc_id", owner).distinct()
        assert stars.exceptAll(full).count() == full.exceptAll(stars).count() == 0 < full.count()
    plan = similarity.near_duplicates(fp)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [sig_key" in plan and "canonical_sha256#" in plan
    assert not any("Aggregate" in x and " sha256#" in x.partition("], [")[0] for x in plan.splitlines())
