"""Vector codes against a plain version, and on odd rows."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tracelight.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, part int, entry int"


def plain(rows, rounds=4):
    """The contract, one vector at a time."""
    kept = [
        (i, [math.floor(1024 * x) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    each = len(kept[0][1]) // 4
    cut = [[v[p * each : (p + 1) * each] for p in range(4)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:256]] for p in range(4)]

    def closest(part, p):
        far = [sum((x - y) ** 2 for x, y in zip(part, e, strict=True)) for e in books[p]]
        return min(range(len(far)), key=lambda e: (far[e], e)), min(far)

    for _ in range(rounds):
        cells = defaultdict(list)
        for c in cut:
            for p in range(4):
                cells[p, closest(c[p], p)[0]].append(c[p])
        for (p, e), parts in cells.items():
            books[p][e] = [sum(x) // len(parts) for x in zip(*parts, strict=True)]
    digest = hashlib.sha256(
        ",".join(str(x) for book in books for entry in book for x in entry).encode()
    ).hexdigest()
    out, by_label = [], defaultdict(int)
    for (i, _, label), c in zip(kept, cut, strict=True):
        found = [closest(c[p], p) for p in range(4)]
        error = sum(d for _, d in found)
        by_label[label] += error
        out.append((i, bytes(e for e, _ in found).hex(), error, label))
    return sorted(
        ((i, code, error, by_label[label], digest) for i, code, error, label in out), key=str
    )


def table(spark, rows):
    extra = ("code", 3, 4)
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA)


@pytest.mark.parametrize("dim", [4, 12, 20])
def test_like_the_plain_version(spark, dim):
    rng = random.Random(dim)
    rows = [
        (i, [float(np.float32(rng.gauss(0, 0.1))) for _ in range(dim)], rng.choice([0, 1, None]))
        for i in range(330)
    ]
    rows += [(i, rows[i][1], 5) for i in range(5)]  # copies under ids that repeat
    rows += [(400, None, 1), (401, [0.5] * (dim - 1) + [None], 1), (402, [math.nan] * dim, 1)]
    rows += [(403, [math.inf] * dim, None), (None, [0.25] * dim, 0)]
    got = vector_codes.compress_vectors(table(spark, rows).repartition(7))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_few_large_short_and_no_vectors(spark):
    rows = [(1, [30.0, -20.0, 900.0, 0.001] * 2, 1), (2, [0.0] * 8, None), (2, [0.0] * 8, None)]
    got = vector_codes.compress_vectors(table(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)
    ragged = table(spark, [(1, [1.0] * 5, 1), (2, [1.0, 2.0], 1), (3, [], 1)])
    filled = table(spark, [(1, [1.0] * 5 + [0.0] * 3, 1), (2, [1.0, 2.0] + [0.0] * 6, 1), (3, [0.0] * 8, 1)])
    left, right = (sorted(map(tuple, vector_codes.compress_vectors(t).collect())) for t in (ragged, filled))
    assert left == right and len(left) == 3
    only_empty = vector_codes.compress_vectors(table(spark, [(1, [], 1), (2, [], None)])).collect()
    assert {(r["code"], r["error"]) for r in only_empty} == {("00000000", 0)}
    assert vector_codes.compress_vectors(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        vector_codes.compress_vectors(table(spark, [(1, [1e30] * 4, 1)]))


@pytest.mark.parametrize("width", [1, 2, 8, 32])
def test_transform(width):
    rows = np.random.default_rng(1).integers(-50, 50, (9, width))
    out = vector_codes.walsh(rows, width)
    matrix = vector_codes.walsh(np.eye(width, dtype=np.int64), width).T
    assert (out == rows @ matrix.T).all()
    assert [int((np.diff(row) != 0).sum()) for row in matrix] == list(range(width))
    assert ((out**2).sum(axis=1) == width * (rows**2).sum(axis=1)).all()


@pytest.mark.parametrize("kind", [np.int32, np.int64, object])
def test_search_is_exact_with_ties(kind):
    rng = np.random.default_rng(2)
    entries = rng.integers(-3, 3, (200, 12))
    entries[100:] = entries[:100]
    points = np.cumsum(rng.integers(-3, 3, (300, 12)), axis=1)
    far = ((points[:, None] - entries[None]) ** 2).sum(axis=-1)
    walsh = vector_codes.walsh
    index, least = vector_codes.nearest(walsh(points.astype(kind), 16), walsh(entries.astype(kind), 16))
    assert (index == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()
