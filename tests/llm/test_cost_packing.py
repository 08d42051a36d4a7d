"""Cost-balanced packing against a plain version, and its invariants on texts."""

import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracelight.llm import cost_packing


def plain(lengths, capacity, linear):
    """Every document, the longest first, to the cheapest sequence with room, all looked at."""
    room = cost_packing.rooms_for(sum(lengths), capacity)
    size, cost = list(room), [0] * len(room)
    todo = [(-n, d, 0) for d, n in enumerate(lengths)]
    out = []
    while todo:
        # of equal lengths whole documents come before what cuts have left
        todo.sort(key=lambda x: (x[0], x[2] > 0, x[1]))
        n, doc, start = todo.pop(0)
        n = -n
        fits = [s for s in range(len(room)) if room[s] >= n]
        s = min(fits or [s for s in range(len(room)) if room[s]], key=lambda s: (cost[s], s))
        part = min(n, room[s])
        out.append((doc, start, part, s, size[s] - room[s]))
        room[s] -= part
        cost[s] += linear * part + part * part
        if part < n:
            todo.append((part - n, doc, start + part))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_like_the_plain_version(seed):
    rng = random.Random(seed)
    top = rng.choice([5, 70, 300])
    lengths = sorted((rng.randint(1, top) for _ in range(rng.randint(1, 250))), reverse=True)
    linear = rng.choice([0, 10, 5000])
    assert cost_packing.balanced(lengths, 64, linear) == plain(lengths, 64, linear)


def check(rows, texts, capacity):
    """Each document is covered once, sequences have no gaps and need no padding."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = defaultdict(int)
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want[doc_id] += len(ids)
    got, sequences = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == capacity or end & (end - 1) == 0 and end < capacity


def test_texts(spark, odd):
    rows = cost_packing.pack_by_cost(odd, capacity=64, group_tokens=4000).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()], 64)
    assert len({r["sequence_id"] >> 32 for r in rows}) > 1
    assert cost_packing.pack_by_cost(odd.limit(0)).count() == 0


def test_pieces_hold_their_ids(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = cost_packing.pack_by_cost(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    check(rows, texts.items(), 4096)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for doc_id, parts in pieces.items():
        ids = [*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2]
        end = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == end and r["doc_tokens"] == len(ids)
            end += r["length"]
            part = b"".join(i.to_bytes(4, "little") for i in ids[r["start"] : end])
            assert r["ids_crc32"] == zlib.crc32(part)
        assert end == len(ids)


def test_int_ids_and_costs(spark):
    rng = random.Random(3)
    rows = [(i, "word " * rng.randint(1, 40), "x", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, deal string, row int")
    packed = cost_packing.pack_by_cost(docs, capacity=128)
    assert dict(packed.dtypes)["doc_id"] == "int"
    costs = [r for r in cost_packing.sequence_costs(packed, 0).collect() if r["tokens"] == 128]
    mean = sum(r["cost"] for r in costs) / len(costs)
    assert max(r["cost"] for r in costs) < 1.25 * mean
