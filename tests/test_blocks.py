"""Fields and components over blocks: many small blocks give what one pass over the whole grid gives."""

import heapq
import math

import numpy as np
import pytest

from gridstride.operators import blocks
from gridstride.operators import graph as G
from gridstride.operators import stencils as S

INF = math.inf


def table(spark, cost, req=1):
    return spark.createDataFrame([(req, y, x, float(cost[y, x])) for y, x in zip(*map(np.ndarray.tolist, np.nonzero(np.isfinite(cost))), strict=True)], "req long, y long, x long, cost double")


def dijkstra(cost, source, cell_m=1.0):
    best, heap = {source: 0.0}, [(0.0, source)]
    open_ = lambda y, x: 0 <= y < cost.shape[0] and 0 <= x < cost.shape[1] and np.isfinite(cost[y, x])
    while heap:
        d, (y, x) = heapq.heappop(heap)
        if d > best[y, x]:
            continue
        for dy, dx, length in blocks.STEPS:
            to = (y + dy, x + dx)
            if open_(*to) and (not (dy and dx) or (open_(y + dy, x) and open_(y, x + dx))):
                new = d + length * cell_m * ((cost[y, x] + cost[to]) * 0.5)
                if new < best.get(to, INF):
                    best[to] = new
                    heapq.heappush(heap, (new, to))
    return best


def made(seed, shape=(37, 29), closed=0.3):
    random = np.random.default_rng(seed)
    cost = random.integers(1, 9, shape) / 4.0
    cost[random.random(shape) < closed] = INF
    cost[0, 0] = cost[-1, -1] = 1.0
    return cost


@pytest.mark.parametrize("side", [5, 16, 512])
def test_costs_and_ways_equal_dijkstra(spark, side):
    for seed in (1, 2):
        cost = made(seed)
        want = dijkstra(cost, (0, 0), 2.0)
        seeds = spark.createDataFrame([(1, 0, 0, 0.0)], "req long, y long, x long, value double")
        field = blocks.Field(table(spark, cost), blocks.spread(2.0), seeds, side=side)
        got = {(r.y, r.x): r.value for r in field.cells().collect()}
        assert set(got) == set(zip(*map(np.ndarray.tolist, np.nonzero(np.isfinite(cost))), strict=True))
        assert {k: v for k, v in got.items() if v < INF} == want
        targets = spark.createDataFrame([(1, y, x) for y, x in [*list(want)[::40], (0, 0), (36, 28), (500, 3)]], "req long, ty long, tx long")
        ways = {}
        for r in sorted(field.ways(targets, 2.0).collect(), key=lambda r: r.i):
            ways.setdefault((r.ty, r.tx), []).append((r.i, r.y, r.x, r.total))
        assert set(ways) == {k for k in [*list(want)[::40], (0, 0), (36, 28)] if k in want}
        for target, cells in ways.items():
            path = [c[1:3] for c in cells]
            assert [c[0] for c in cells] == list(range(len(cells))) and path[0] == (0, 0) and path[-1] == target
            total = 0.0
            for a, b in zip(path, path[1:], strict=False):
                dy, dx = b[0] - a[0], b[1] - a[1]
                assert max(abs(dy), abs(dx)) == 1 and np.isfinite(cost[a[0], b[1]]) and np.isfinite(cost[b[0], a[1]])
                total += math.hypot(dy, dx) * 2.0 * ((cost[a] + cost[b]) * 0.5)
            assert math.isclose(total, want[target]) and {c[3] for c in cells} == {want[target]}


def test_cheapest_of_many_requests(spark):
    costs = {1: made(3), 2: made(4)}
    cells = table(spark, costs[1]).union(table(spark, costs[2], 2))
    rows = [(10, 1, 0, 0, 36, 28), (11, 2, 0, 0, 36, 28), (12, 2, 36, 28, 0, 0), (13, 1, 0, 0, 0, 0), (14, 1, 0, 0, None, 3), (15, 9, 0, 0, 1, 1), (16, 1, 0, 0, 36, 28), (17, 1, -4, 0, 36, 28)]
    asked = spark.createDataFrame(rows, "id long, req long, sy long, sx long, ty long, tx long")
    got = {}
    for r in sorted(G.cheapest(cells, asked).collect(), key=lambda r: (r.id, r.i)):
        got.setdefault(r.id, []).append((r.cost, r.y, r.x))
    ways = {10: dijkstra(costs[1], (0, 0)).get((36, 28)), 11: dijkstra(costs[2], (0, 0)).get((36, 28)), 12: dijkstra(costs[2], (36, 28)).get((0, 0)), 13: 0.0}
    ways[16] = ways[10]
    assert {k: v[0][0] for k, v in got.items()} == {k: v for k, v in ways.items() if v is not None}
    assert got[13] == [(0.0, 0, 0)] and got.get(16) == got.get(10)
    assert G.cheapest(cells, asked.where("false")).count() == 0 and G.cheapest(cells.where("false"), asked).count() == 0


def snake(height, width):
    """Streets one cell wide that run there and back."""
    mask = np.zeros((height, width), bool)
    mask[::2] = True
    for k, y in enumerate(range(1, height - 1, 2)):
        mask[y, width - 1 if k % 2 == 0 else 0] = True
    return mask


def test_rounds_write_only_blocks_with_news(spark, capsys):
    cost = np.where(snake(8, 160), 1.0, INF)
    seeds = spark.createDataFrame([(1, 0, 0, 0.0)], "req long, y long, x long, value double")
    field = blocks.Field(table(spark, cost), blocks.spread(1.0), seeds, side=16, watch=True)
    assert {(r.y, r.x): r.value for r in field.cells().collect()} == dijkstra(cost, (0, 0))
    with capsys.disabled():
        print(f"\n  blocks written in each of {len(field.rounds)} rounds: {field.rounds}")
    assert field.rounds[0] == 10 and max(field.rounds[1:]) <= 4 and len(field.rounds) > 25
    assert field.state().count() == 10


def plain_components(mask):
    label, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask), strict=True):
        if not label[start]:
            n, todo = n + 1, [start]
            label[start] = n
            while todo:
                y, x = todo.pop()
                for to in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if 0 <= to[0] < mask.shape[0] and 0 <= to[1] < mask.shape[1] and mask[to] and not label[to]:
                        label[to] = n
                        todo.append(to)
    return label


def test_components_equal_a_flood(spark):
    for seed, side in ((1, 4), (2, 7), (3, 512)):
        mask = np.random.default_rng(seed).random((50, 41)) < 0.6
        want = plain_components(mask)
        cells = spark.createDataFrame([(r, y, x) for r in (1, 2) for y, x in zip(*map(np.ndarray.tolist, np.nonzero(mask)), strict=True)], "req long, y long, x long")
        found, parts = blocks.components(cells, 41, side)
        got = {(r.req, r.y, r.x): r["first"] for r in found.join(parts, ["req", "local"]).collect()}
        first = {}
        for (y, x), n in np.ndenumerate(want):
            first.setdefault(n, y * 41 + x)
        assert got == {(r, y, x): first[want[y, x]] for r in (1, 2) for y, x in zip(*map(np.ndarray.tolist, np.nonzero(mask)), strict=True)}


def spiral(height, width):
    """One street that winds inwards, walls one cell wide."""
    mask, y, x, dy, dx = np.zeros((height, width), bool), 0, 0, 0, 1
    mask[0, 0] = True
    turns = 0
    while turns < 2:
        ny, nx, fy, fx = y + dy, x + dx, y + 2 * dy, x + 2 * dx
        if not (0 <= ny < height and 0 <= nx < width) or (0 <= fy < height and 0 <= fx < width and mask[fy, fx]):
            dy, dx, turns = dx, -dy, turns + 1
            continue
        y, x, turns = ny, nx, 0
        mask[y, x] = True
    return mask


def test_a_long_spiral_takes_few_levels(spark, capsys):
    mask = spiral(64, 100_000)
    y, x = np.nonzero(mask)
    import pandas as pd

    cells = spark.createDataFrame(pd.DataFrame({"req": np.ones(len(y), np.int64), "y": y, "x": x}))
    levels = []
    found, parts = blocks.components(cells, 100_000, watch=levels)
    assert parts.select("first").distinct().count() == 1 and found.count() == len(y)
    with capsys.disabled():
        print(f"\n  a spiral of {len(y)} cells: pairs of parts in each of {len(levels)} levels: {levels}")
    assert len(levels) < 15


def test_numbers_of_components_across_bands(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 8)  # bands of 8 rows
    mask = np.random.default_rng(5).random((40, 20)) < 0.4
    cells = spark.createDataFrame([(1, y, x) for y, x in zip(*map(np.ndarray.tolist, np.nonzero(mask)), strict=True)], "req long, y long, x long")
    want = plain_components(mask)
    got = {(r.y, r.x): r.label for r in G.components(cells, 20).collect()}
    assert got == {(y, x): want[y, x] for y, x in got} and len(got) == mask.sum()


@pytest.mark.parametrize("side", [6, 512])
def test_chamfer_over_blocks(spark, side):
    random = np.random.default_rng(6)
    mask = random.random((40, 33)) < 0.01
    mask[30, 20] = True
    ys, xs = np.nonzero(mask)
    rows = [(1, y, x, 1.0, 0.0 if mask[y, x] else INF) for y in range(40) for x in range(33)]
    cells = spark.createDataFrame(rows, "req long, y long, x long, cost double, value double")
    a, b = lambda y: abs(ys - y), lambda x: abs(xs - x)
    want = {(y, x): float((3 * np.maximum(a(y), b(x)) + np.minimum(a(y), b(x))).min()) for y in range(40) for x in range(33)}
    assert {(r.y, r.x): r.value for r in blocks.Field(cells, blocks.chamfer, side=side).cells().collect()} == want
    near = {(r.y, r.x): r.value for r in blocks.Field(cells, blocks.chamfer, most=15.0, side=side).cells().collect()}
    assert all(near[k] == v for k, v in want.items() if v <= 15)


def test_distance_to_a_mask_without_reach(spark):
    cells = spark.createDataFrame([(r, 0, x, int(r == 1 and x == 0)) for r in (1, 2) for x in range(900)], "req long, y long, x long, m int")
    got = {(r.req, r.x): r.dist for r in S.distance_to_mask(cells, "m", 2.0, by=["req"]).collect()}
    assert all(got[1, x] == pytest.approx(2.0 * x) and got[2, x] is None for x in range(900))
    assert S.distance_to_mask(cells.where("false"), "m", 2.0, by=["req"]).count() == 0
