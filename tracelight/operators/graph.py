"""Graph jobs as frontier joins and component labelling; no driver-side traversal."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.filter(F.col("v") > F.col("u"))
        .join(low, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter(F.col("u") != F.col("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): component = smallest node id reachable over undirected ``edges``.

    Alternating large-star / small-star (Kiveris et al., 2014): each step is one minimum per
    node and one equi-join, a node with many edges never collects them, and the number of
    rounds grows with the logarithm of the component size, not with its diameter.
    """
    current = cut_lineage(
        edges.select(F.col(u).alias("u"), F.col(v).alias("v"))
        .filter(F.col("u") != F.col("v"))
        .distinct()
    )
    seen = None
    while True:
        current = cut_lineage(_small_star(_large_star(current)))
        state = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        ).first()
        if state == seen:
            break
        seen = state
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)


def duplicate_clusters(pairs: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """(node, component) over near pairs (id_a, id_b) and, if given, copy links (u, v)."""
    edges = pairs.select(F.col("id_a").alias("u"), F.col("id_b").alias("v"))
    if copies is not None:
        edges = edges.unionByName(copies.select("u", "v"))
    return connected_components(edges)


def _tile_labels():
    """label(tile): the cells of one tile of one grid, each with the smallest cell (lx, ly) that it
    reaches inside. A function of its own travels by value."""

    def label(tile: pa.Table) -> pa.Table:
        cells = sorted(zip(tile["x"].to_pylist(), tile["y"].to_pylist(), strict=True))
        root = {c: c for c in cells}

        def find(c: tuple[int, int]) -> tuple[int, int]:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for x, y in cells:
            for near in ((x - 1, y), (x, y - 1)):
                if near in root:
                    one, two = find((x, y)), find(near)
                    root[max(one, two)] = min(one, two)
        labels = [find(c) for c in cells]
        grid = pa.repeat(tile["grid_id"][0], len(cells))
        columns = [[c[i] for c in part] for part in (cells, labels) for i in (0, 1)]
        arrays = [grid, *(pa.array(c, pa.int64()) for c in columns)]
        return pa.Table.from_arrays(arrays, names=["grid_id", "x", "y", "lx", "ly"])

    return label


def connected_regions(
    cells: DataFrame, min_cells: int = 2, max_regions: int = 8, side: int = 64
) -> DataFrame:
    """4-connected clusters of flagged ``cells`` (grid_id, x, y, value): box, size, mean value.

    Cells are joined within tiles of ``side`` x ``side`` of a grid, each in one task; only links
    across the borders of tiles, between the clusters inside, are an iterative job.
    """
    flagged = cells.filter("flagged").select(
        "grid_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "value"
    )
    node = F.struct("grid_id", "x", "y")
    at = ["grid_id", "x", "y"]
    flagged = cut_lineage(flagged)
    kind = flagged.schema["grid_id"].dataType.simpleString()
    inside = cut_lineage(
        flagged.select(*at)
        .dropna()
        .distinct()
        .groupBy("grid_id", *[F.col(c) - F.pmod(c, F.lit(side)) for c in ("x", "y")])
        .applyInArrow(_tile_labels(), f"grid_id {kind}, x bigint, y bigint, lx bigint, ly bigint")
    ).select(*at, F.struct("grid_id", F.col("lx").alias("x"), F.col("ly").alias("y")).alias("local"))
    # the cells along the borders, and the first ones beyond them
    here = inside.select(*at, F.col("local").alias("u"))
    right = inside.filter(F.pmod("x", F.lit(side)) == 0).select(
        "grid_id", (F.col("x") - 1).alias("x"), "y", F.col("local").alias("v")
    )
    below = inside.filter(F.pmod("y", F.lit(side)) == 0).select(
        "grid_id", "x", (F.col("y") - 1).alias("y"), F.col("local").alias("v")
    )
    last = F.lit(side - 1)
    edges = (
        here.filter(F.pmod("x", F.lit(side)) == last).join(right, at).select("u", "v")
    ).unionByName(here.filter(F.pmod("y", F.lit(side)) == last).join(below, at).select("u", "v"))
    joined = connected_components(edges).withColumnRenamed("node", "local")
    label = inside.join(joined, "local", "left").select(
        *at, F.coalesce("component", "local").alias("component")
    )
    placed = flagged.join(label, at, "left").withColumn(
        "component", F.coalesce("component", node)
    )
    regions = (
        placed.groupBy("grid_id", "component")
        .agg(
            F.min("x").alias("x"),
            F.min("y").alias("y"),
            (F.max("x") - F.min("x") + 1).alias("width"),
            (F.max("y") - F.min("y") + 1).alias("height"),
            F.count(F.lit(1)).alias("cells"),
            F.round(F.avg("value"), 2).alias("value"),
        )
        .filter(F.col("cells") >= min_cells)
    )
    from pyspark.sql import Window

    order = Window.partitionBy("grid_id").orderBy(
        F.desc("cells"), F.col("component.x"), F.col("component.y")
    )
    return (
        regions.withColumn("region", F.row_number().over(order))
        .filter(F.col("region") <= max_regions)
        .drop("component")
    )


def manifest_chain(
    edges: DataFrame, roots: DataFrame, max_depth: int | None = None, cut_every: int = 4
) -> DataFrame:
    """(root, node, parent, depth): breadth-first ancestry, every node once per root.

    ``edges`` (parent, child), ``roots`` (root). Each level joins the frontier to the edges and
    anti-joins what was seen; the loop ends on an empty frontier. A node reached twice on one
    level keeps its smallest parent.
    """
    frontier = roots.select(
        "root", F.col("root").alias("node"), F.lit(None).cast("long").alias("parent")
    ).withColumn("depth", F.lit(0))
    seen = frontier
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        frontier = (
            frontier.select("root", F.col("node").alias("at"))
            .join(edges.select(F.col("parent").alias("at"), F.col("child").alias("node")), "at")
            .join(seen.select("root", "node"), ["root", "node"], "left_anti")
            .groupBy("root", "node")
            .agg(F.min("at").alias("parent"))
            .withColumn("depth", F.lit(depth))
        )
        frontier = cut_lineage(frontier)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % cut_every == 0:
            seen = cut_lineage(seen)
    return seen


def ingredient_tree_failures(
    edges: DataFrame, failed: DataFrame, roots: DataFrame, max_depth: int = 8
) -> DataFrame:
    """(root, nodes, failures): ingredients within ``max_depth`` levels and how many failed."""
    reached = manifest_chain(edges, roots, max_depth).filter(F.col("depth") > 0)
    marked = reached.join(
        failed.select(F.col("node"), F.lit(1).alias("bad")).distinct(), "node", "left"
    )
    return marked.groupBy("root").agg(
        F.count(F.lit(1)).alias("nodes"), F.count("bad").alias("failures")
    )


def order_conflicts(chain: DataFrame, signed: DataFrame, tolerance_s: int = 60) -> DataFrame:
    """Chain links whose ingredient was signed after the manifest that contains it."""
    child = signed.select(F.col("node"), F.col("signed_at").alias("child_at"))
    parent = signed.select(F.col("node").alias("parent"), F.col("signed_at").alias("parent_at"))
    gap = F.unix_timestamp("child_at") - F.unix_timestamp("parent_at")
    return (
        chain.filter(F.col("parent").isNotNull())
        .join(child, "node")
        .join(parent, "parent")
        .withColumn("gap_s", gap)
        .filter(F.col("gap_s") > tolerance_s)
        .select("root", "parent", "node", "gap_s")
    )
