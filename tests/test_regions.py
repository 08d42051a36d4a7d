import random

from tracelight.operators import graph

CELLS = "grid_id long, x long, y long, value double, flagged boolean"


def plain(cells):
    """Clusters of (grid, x, y) by walking: {(grid, smallest cell): cells}."""
    left, found = set(cells), {}
    while left:
        todo, seen = [min(left)], set()
        while todo:
            g, x, y = at = todo.pop()
            if at in left:
                left.remove(at)
                seen.add(at)
                todo += [(g, x - 1, y), (g, x + 1, y), (g, x, y - 1), (g, x, y + 1)]
        found[min(seen)] = seen
    return found


def test_regions_across_tiles(spark, monkeypatch):
    rng = random.Random(5)
    cells = {(g, x, y) for g in (1, 2) for x in range(-9, 9) for y in range(-9, 9) if rng.random() < 0.58}
    rows = [(*c, 1.0, True) for c in sorted(cells)] + [(1, 40, 40, 1.0, False), (2, None, 3, 1.0, True)]
    table = spark.createDataFrame(rows, CELLS)
    want = sorted(
        (c[0], min(x for _, x, _ in m), min(y for _, _, y in m), len(m))
        for c, m in plain(cells).items() if len(m) > 1
    )
    links = []
    real = graph.connected_components
    monkeypatch.setattr(graph, "connected_components", lambda e: (links.append(e.count()), real(e))[1])
    for side in (4, 64):
        got = graph.connected_regions(table, 2, 1000, side).collect()
        assert sorted((r.grid_id, r.x, r.y, r.cells) for r in got) == want
    # links are those across the borders of tiles alone
    border = sum((g, x - 1, y) in cells for g, x, y in cells if x % 64 == 0)
    border += sum((g, x, y - 1) in cells for g, x, y in cells if y % 64 == 0)
    assert links[1] == border and links[0] > links[1]


def test_a_grid_inside_one_tile_needs_no_links(spark, monkeypatch):
    table = spark.createDataFrame([(7, x, y, 2.0, True) for x in range(16) for y in range(16)], CELLS)
    links = []
    real = graph.connected_components
    monkeypatch.setattr(graph, "connected_components", lambda e: (links.append(e.count()), real(e))[1])
    (region,) = graph.connected_regions(table).collect()
    assert (region.cells, region.width, region.height, region.value) == (256, 16, 16, 2.0)
    assert links == [0]
