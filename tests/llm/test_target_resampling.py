"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tracelight.llm import target_resampling
from tracelight.llm.catalog import QUERIES

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    runs = [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
    return len(words), runs


def plain(docs, target, percent=25, least=20, longest=2, buckets=10_000):
    def place(run):
        return zlib.crc32(run.encode()) % buckets

    s = Counter(place(r) for _, text in docs for r in features(text, longest)[1])
    t = Counter(place(r) for text in target for r in features(text, longest)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))

    rows = []
    for doc_id, text in docs:
        n_words, runs = features(text, longest)
        weight = sum(gain(place(r)) for r in runs) // len(runs) if runs else 0
        name = "" if doc_id is None else doc_id
        h = int(hashlib.sha256(f"7:{name}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(runs), weight, weight + noise, None, n_words])
    pool = [r for r in rows if r[5] >= least]
    pool.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place_, row in enumerate(pool[: len(pool) * percent // 100], 1):
        row[4] = place_
    return sorted((tuple(r[:5]) for r in rows), key=str)


def got(spark, docs, target, **more):
    items = spark.createDataFrame([(t,) for t in target], "text string")
    return sorted(map(tuple, target_resampling.resample(docs, items, **more).collect()), key=str)


@pytest.mark.parametrize("longest, buckets", [(2, 10_000), (1, 50), (4, 300)])
def test_odd_rows(spark, odd, longest, buckets):
    target = ["The cat sat.", None, "", "word1 und1 word2", "Über  Äpfel"]
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    more = {"longest": longest, "buckets": buckets}
    assert got(spark, odd, target, least_words=2, **more) == plain(docs, target, least=2, **more)


def test_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = sorted(map(tuple, QUERIES["op13_target_resampling"](spark, folder).collect()), key=str)
    assert rows == plain(docs, target)


def test_empty_tables_and_int_ids(spark, odd):
    assert got(spark, odd.limit(0), ["a b c"]) == []
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    ints = odd.withColumn("doc_id", odd["doc_id"].cast("int"))
    assert got(spark, ints, []) == plain(docs, [])


def test_runs_stay_inside_documents():
    found = list(target_resampling.grams(pa.array(["a b", None, "", "B", "c c c"]), 3, 1000))
    assert [len(doc) for doc, _, _ in found] == [6, 3, 1]
    assert [doc.tolist() for doc, _, _ in found][1:] == [[0, 4, 4], [4]]
    assert found[1][2][found[1][1][0]] == zlib.crc32(b"a b") % 1000
    assert (np.bincount(found[1][1]) == [1, 2]).all()
