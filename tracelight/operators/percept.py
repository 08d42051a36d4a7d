"""64-bit perceptual hashes of small grids and Hamming neighbours without a cross join."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.functions.columns import let
from tracelight.session import cut_lineage


def _pack(bits: Column) -> Column:
    """Booleans, most significant first, to one signed long."""
    return F.aggregate(
        bits,
        F.lit(0).cast("long"),
        lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(F.when(b, 1).otherwise(0).cast("long")),
    )


def mean_hash(pixels: Column) -> Column:
    def bits(p: Column) -> Column:
        mean = F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / F.size(p)
        return let(mean, lambda m: F.transform(p, lambda x: x > m))

    return _pack(let(pixels.cast("array<double>"), bits))


def difference_hash(pixels: Column, width: int = 8) -> Column:
    """Bit = a pixel is larger than its right neighbour; the last column compares to the first."""
    last = width - 1
    return _pack(
        let(
            pixels,
            lambda p: F.transform(
                p,
                lambda x, i: x
                > F.get(p, F.when(i % width == last, i - last).otherwise(i + 1).cast("int")),
            ),
        )
    )


def cosine_basis(width: int) -> np.ndarray:
    """Orthonormal cosine transform: wave f sampled at the centres of ``width`` cells of [0, pi]."""
    centres = np.pi * (np.arange(width) + 0.5) / width
    waves = np.cos(np.outer(np.arange(width), centres))
    return waves / np.linalg.norm(waves, axis=1, keepdims=True)


def _dct_bits(width: int):
    basis = cosine_basis(width)
    side = min(8, width)

    @F.pandas_udf("bigint")
    def phash(pixels: pd.Series) -> pd.Series:
        if not len(pixels):
            return pd.Series([], dtype="int64")
        grid = np.stack(pixels.to_numpy()).astype(np.float64).reshape(-1, width, width)
        low = np.round((basis @ grid @ basis.T)[:, :side, :side], 6).reshape(len(grid), -1)
        bits = low > np.median(low, axis=1, keepdims=True)
        packed = np.packbits(bits, axis=1).view(">i8").reshape(-1)
        return pd.Series(packed.astype(np.int64))

    return phash


def percept_hashes(df: DataFrame, arr: str, width: int = 8) -> DataFrame:
    """Adds ``ahash`` (above the mean), ``dhash`` (left > right), ``phash`` (DCT above median).

    The transform has no SQL form: it runs on Arrow batches, one matrix product per batch. Hashes
    are 64 bits, so grids are 8 x 8; other sizes are refused.
    """
    if width != 8:
        raise ValueError("perceptual hashes take grids of 8 x 8 values")
    return (
        df.withColumn("ahash", mean_hash(F.col(arr)))
        .withColumn("dhash", difference_hash(F.col(arr), width))
        .withColumn("phash", _dct_bits(width)(F.col(arr)))
    )


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _probe_masks(bits: int, flips: int) -> list[int]:
    return [
        sum(1 << b for b in chosen)
        for k in range(flips + 1)
        for chosen in combinations(range(bits), k)
    ]


def _flips(near: int, bands: int) -> list[int]:
    """How many bits of each slice are probed: if every slice differed in more, two values would
    differ in more than ``near`` bits."""
    spare = near - bands + 1
    if spare < 0:
        return [0] * bands  # so few bits apart that a slice is equal
    return [spare // bands + (b < spare % bands) for b in range(bands)]


def _hash_pairs(hashes: DataFrame, near: int, by: list[str], bands: int) -> DataFrame:
    """Pairs of distinct values of ``h`` at most ``near`` bits apart.

    Pigeonhole: some slice differs in at most the bits that ``_flips`` allows it, so one side
    probes every slice value that close. Nothing is missed. Probes are many times the rows they
    are made from, which the planner does not know: the join is one of sorted shuffles, as a
    broadcast would bring them all to the driver.
    """
    bits = 64 // bands

    def slice_of(h: Column, band: int) -> Column:
        return F.shiftrightunsigned(h, band * bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))

    stored = hashes.select(
        *by,
        F.col("h").alias("h_b"),
        F.posexplode_outer(
            F.array(*[slice_of(F.col("h"), b) for b in range(bands)])
        ).alias("band", "key"),
    )
    masks = F.array(
        *[F.array(*[F.lit(m).cast("long") for m in _probe_masks(bits, k)]) for k in _flips(near, bands)]
    )
    probes = (
        hashes.select(
            *by,
            F.col("h").alias("h_a"),
            F.posexplode_outer(
                F.array(*[slice_of(F.col("h"), b) for b in range(bands)])
            ).alias("band", "value"),
        )
        .withColumn("mask", F.explode_outer(F.get(masks, F.col("band"))))
        .select(*by, "h_a", "band", F.col("value").bitwiseXOR(F.col("mask")).alias("key"))
    )
    return (
        probes.hint("merge")
        .join(stored, [*by, "band", "key"])
        .filter((F.col("h_a") < F.col("h_b")) & (hamming(F.col("h_a"), F.col("h_b")) <= near))
        .select(*by, "h_a", "h_b")
        .distinct()
    )


def hamming_neighbors(
    fp: DataFrame, near: int = 10, id_col: str = "item_id", owner: str | None = None, bands: int = 4
) -> DataFrame:
    """Links between groups of equal hashes: (hash, id_a, id_b, distance, members_a, members_b).

    A group is named by its smallest item. ``hash`` says which value agrees: 'sha256' (the same
    file), 'phash' or 'dhash' (at most ``near`` bits apart). A group with company links to itself
    at distance 0. Two items are exact copies if they share a sha256 group, and near if a phash or
    dhash link joins their groups, so flat pictures that share one hash by the million are one
    row, not all their pairs. ``expand_neighbors`` lists the partners of chosen items. The groups,
    one row a hash, are stored: every step reads them several times.
    """
    by = [owner] if owner else []
    groups = {
        column: cut_lineage(
            fp.groupBy(*by, F.col(column).alias("h")).agg(
                F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("n")
            )
        )
        for column in ("sha256", "phash", "dhash")
    }

    def own(column: str) -> DataFrame:
        return groups[column].filter(F.col("n") > 1).select(
            *by, F.lit(column).alias("hash"), F.col("rep").alias("id_a"), F.col("rep").alias("id_b"),
            F.lit(0).alias("distance"), F.col("n").alias("members_a"), F.col("n").alias("members_b"),
        )

    def linked(column: str) -> DataFrame:
        values = groups[column]
        a = values.select(*by, F.col("h").alias("h_a"), F.col("rep").alias("rep_a"), F.col("n").alias("n_a"))
        b = values.select(*by, F.col("h").alias("h_b"), F.col("rep").alias("rep_b"), F.col("n").alias("n_b"))
        joined = _hash_pairs(values.select(*by, "h"), near, by, bands).join(a, [*by, "h_a"]).join(b, [*by, "h_b"])
        forward = F.col("rep_a") < F.col("rep_b")
        return joined.select(
            *by,
            F.lit(column).alias("hash"),
            F.least("rep_a", "rep_b").alias("id_a"),
            F.greatest("rep_a", "rep_b").alias("id_b"),
            hamming(F.col("h_a"), F.col("h_b")).alias("distance"),
            F.when(forward, F.col("n_a")).otherwise(F.col("n_b")).alias("members_a"),
            F.when(forward, F.col("n_b")).otherwise(F.col("n_a")).alias("members_b"),
        )

    parts = [own("sha256"), own("phash"), own("dhash"), linked("phash"), linked("dhash")]
    return reduce(DataFrame.unionByName, parts)


def expand_neighbors(
    links: DataFrame, fp: DataFrame, items: DataFrame, id_col: str = "item_id", owner: str | None = None
) -> DataFrame:
    """Partners of the chosen ``items``: (item, other, relation, distances, score), best first by
    score. Exact copies score 0, others the sum of both distances."""
    by = [owner] if owner else []
    hashes = ["phash", "dhash", "ahash"]
    chosen = fp.join(items.select(id_col).distinct(), id_col, "left_semi")
    found = []
    for column in ("sha256", "phash", "dhash"):
        reps = fp.groupBy(*by, column).agg(F.min(id_col).alias("rep"))
        mine = chosen.join(reps, [*by, column]).select(id_col, *by, F.col("rep").alias("from"))
        rows = links.filter(F.col("hash") == column)
        ways = rows.select(F.col("id_a").alias("from"), F.col("id_b").alias("rep")).unionByName(
            rows.select(F.col("id_b").alias("from"), F.col("id_a").alias("rep"))
        ).distinct()
        members = fp.join(reps, [*by, column]).select(F.col(id_col).alias("other"), "rep")
        found.append(mine.join(ways, "from").join(members, "rep").select(id_col, "other"))
    pairs = reduce(DataFrame.unionByName, found).filter(F.col(id_col) != F.col("other")).distinct()
    side = fp.select(F.col(id_col).alias("other"), F.col("sha256").alias("_s"), *[F.col(h).alias(f"_{h}") for h in hashes])
    joined = pairs.join(chosen.select(id_col, "sha256", *hashes), id_col).join(side, "other")
    same = F.col("sha256") == F.col("_s")
    distance = {h: hamming(F.col(h), F.col(f"_{h}")) for h in hashes}
    return joined.select(
        id_col,
        "other",
        F.when(same, "exact").otherwise("near").alias("relation"),
        *[d.alias(f"{h}_distance") for h, d in distance.items()],
        F.when(same, 0).otherwise(distance["phash"] + distance["dhash"]).alias("score"),
    )
