"""Golden fixtures and invariants of grids, borders and paths."""

import ctypes
import random
import re
import tracemalloc
from collections import deque
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from py4j.protocol import Py4JError
from pyspark.sql import functions as F

from gridloom import registry
from gridloom.functions import geometry as G
from gridloom.operators import blocks, borders, cells as C, graph, local, render
from gridloom.plans import checkpoints, paths
from gridloom.plans.checkpoints import written
from gridloom.sources import maps

FIXTURES = {
    # name: (rows, tile, start, goal, flat cost, entrances, nodes with both ends, directed intra edges with both ends, hierarchical cost)
    "scene_test": (["@@@@@", "@...@", "@.@@@", "@...@", "@@@@@"], 3, (3, 1), (3, 3), 6, 3, 6, 4, 6),
    "scene_test_small": (["@" * 20] + ["@" + "." * 18 + "@"] * 18 + ["@" * 20], 10, (1, 1), (18, 18), 34, 4, 10, 16, 34),
    "ragged_open": (["." * 7] * 5, 3, (0, 0), (6, 4), 10, 7, 15, 24, 10),
    "subopt_open": (["." * 12] * 12, 6, (5, 0), (6, 0), 1, 4, 10, 16, 7),
    "exit_required": (["..@....."] * 4 + ["........"] * 4, 4, (0, 0), (3, 0), 11, 5, 12, 18, 11),
    "tile_reentry": (["........", "@@@@.@@@", "........", ".@@@@@@@", "........"], 4, (0, 0), (7, 4), 19, 4, 10, 10, 19),
    "outside_route": (["@@@@@@@@", "@..@...@", "@..@.@.@", "@..@.@.@", "@....@.@", "@@@@@@.@", "@......@", "@@@@@@@@"], 4, (1, 1), (1, 6), 21, 5, 11, 10, 21),
    "tile_wall": (["........", ".@@@@@@.", ".@....@.", "....@.@.", ".@@@@.@.", ".@....@.", ".@@@@@@.", "........"], 4, (2, 2), (5, 2), 3, 7, 16, 26, 3),
    "blocked": (["@@@@@", "@.@.@", "@.@.@", "@.@.@", "@@@@@"], 3, (1, 1), (3, 1), None, 2, 6, 4, None),
}


def query(spark, start, goal, map_id="map"):
    return spark.createDataFrame([(0, map_id, *start, *goal)], "query_id long, map_id string, sx long, sy long, gx long, gy long")


def distances(rows, start, diagonal=False):
    steps = [(dx, dy) for dx, dy, _ in G.STEPS + (G.DIAGONALS if diagonal else ())]
    found, todo = {start: 0}, deque([start])
    while todo:
        x, y = todo.popleft()
        for dx, dy in steps:
            p = (x + dx, y + dy)
            if 0 <= p[1] < len(rows) and 0 <= p[0] < len(rows[0]) and rows[p[1]][p[0]] == "." and p not in found:
                found[p] = found[x, y] + 1
                todo.append(p)
    return found


@pytest.mark.parametrize("name", FIXTURES)
def test_golden(spark, name):
    rows, size, start, goal, flat, n_gates, n_nodes, n_intra, hier = FIXTURES[name]
    cells = maps.cells_from_lines(spark, rows).persist()
    todo = query(spark, start, goal)
    gates = borders.entrances(cells, size)
    assert gates.count() == n_gates
    nodes = borders.abstract_nodes(gates, size)
    ends = spark.createDataFrame([("map", *p, p[0] // size, p[1] // size) for p in (start, goal)], "map_id string, x long, y long, cx long, cy long")
    both = graph.add_nodes(nodes, ends)
    assert both.count() == n_nodes
    assert local.intra_edges(cells, both, size).count() == n_intra
    for mode, cost in (("flat", flat), ("exact", flat), ("hier", hier)):
        found = paths.find_paths(cells, todo, size, mode)
        (r,) = found.collect()
        assert (r["success"], r["cost"]) == (cost is not None, cost), mode
        if cost is not None:
            assert r["path_length"] == cost + 1
            assert [tuple(r["path"][k]) for k in (0, -1)] == [start, goal]
            assert paths.path_violations(cells, found, todo).first()["violations"] == 0
    cells.unpersist()


def random_rows(seed, width, height, share):
    rng = random.Random(seed)
    return ["".join("@" if rng.random() < share else "." for _ in range(width)) for _ in range(height)]


@pytest.mark.parametrize("seed,width,height,size,share", [(0, 13, 9, 4, 0.2), (1, 8, 8, 4, 0.4), (2, 1, 9, 3, 0.1), (3, 11, 1, 3, 0.0), (4, 10, 7, 5, 0.2)])
def test_random_grids(spark, seed, width, height, size, share):
    rows = random_rows(seed, width, height, share)
    cells = maps.cells_from_lines(spark, rows).persist()
    free = [(x, y) for y in range(height) for x in range(width) if rows[y][x] == "."]
    rng = random.Random(seed)
    pairs = [(rng.choice(free), rng.choice(free)) for _ in range(12)]
    todo = spark.createDataFrame([(k, "map", *s, *g) for k, (s, g) in enumerate(pairs)], "query_id long, map_id string, sx long, sy long, gx long, gy long")
    want = {k: distances(rows, s).get(g) for k, (s, g) in enumerate(pairs)}
    for heuristic in ("manhattan", "chebyshev", "euclidean"):
        assert {r["query_id"]: r["cost"] for r in paths.find_paths(cells, todo, size, "flat", heuristic).collect()} == want
    eight = {k: distances(rows, s, True).get(g) for k, (s, g) in enumerate(pairs)}
    assert {r["query_id"]: r["cost"] for r in paths.flat_paths(cells, todo, "chebyshev", diagonal=True).collect()} == eight
    assert {r["query_id"]: r["cost"] for r in paths.find_paths(cells, todo, size, "exact").collect()} == want
    pre = paths.preprocess(cells, size)
    hier = paths.find_paths(cells, todo, size, pre=pre)
    for r in hier.collect():
        assert r["cost"] is None or want[r["query_id"]] is not None and r["cost"] >= want[r["query_id"]]
    assert sum(r["violations"] for r in paths.path_violations(cells, hier, todo).collect()) == 0
    # Block by block: one block for all, blocks of single tiles, and blocks that cut through tiles.
    for block in (128, size, size + 1):
        ways = paths.abstract_paths(pre, todo, broadcast_edges=0, block=block)
        relaxed = {r["query_id"]: r["cost"] for r in ways.collect()}
        assert relaxed == {r["query_id"]: r["cost"] for r in hier.collect() if r["success"]}
        assert {r["query_id"]: len(r["path"]) - 1 for r in paths.refine(pre, ways).collect()} == relaxed
    cells.unpersist()


def test_start_on_a_wall_or_outside(spark):
    cells = maps.cells_from_lines(spark, FIXTURES["scene_test"][0])
    for start in ((0, 0), (40, 40)):
        for mode in ("flat", "hier"):
            assert not paths.find_paths(cells, query(spark, start, (3, 3)), 3, mode).first()["success"]


def test_mazes(spark):
    for seed in range(3):
        lines = maps.maze_lines(20, 15, seed)
        assert lines == maps.maze_lines(20, 15, seed) and (len(lines[0]), len(lines)) == (21, 15)
        assert all(line[0] == line[-1] == "@" for line in lines) and set(lines[0]) == set(lines[-1]) == {"@"}
        found = distances(lines, (1, 1))
        assert found[19, 13] == (21 - 3) + (15 - 3)
        assert len(found) == sum(line.count(".") for line in lines)


def test_map_files(spark, tmp_path):
    (tmp_path / "a").write_text("type octile\nheight 5\nwidth 5\nmap\n@@@@@\n@...@\n@.@@@\n@...@\n@@@@@")  # no line end
    (tmp_path / "b").write_text("type octile\r\nheight 2\r\nwidth 3\r\nmap\r\n.T.\r\n..\r\n")
    texts = maps.read_map_text(spark, str(tmp_path))
    assert {tuple(r) for r in maps.headers(texts).collect()} == {("a", "octile", 5, 5), ("b", "octile", 2, 3)}
    cells = maps.cells_of(texts)
    assert cells.where("map_id = 'a' AND NOT wall").count() == 7
    assert {(r["x"], r["y"]) for r in cells.where("map_id = 'b' AND wall").collect()} == {(1, 0), (2, 1)}
    back = maps.cells_of(maps.cells_to_text(cells))
    assert back.exceptAll(cells).count() == 0 and cells.exceptAll(back).count() == 0
    tile = maps.tile_cells(cells.where("map_id = 'a'"), 3, 1, 1, padded=True)
    assert tile.count() == 9 and tile.where("NOT wall").count() == 1


def test_runs_of_bits(spark):
    cells = maps.cells_from_lines(spark, random_rows(7, 17, 6, 0.5))
    bits = {r["i"]: r["v"] for r in cells.select((F.col("x") + F.col("y") * 17).alias("i"), F.col("wall").cast("int").alias("v")).collect()}
    runs = C.map_runs(cells)
    assert {r["i"]: r["value"] for r in C.decode_runs(runs, ["map_id"]).collect()} == bits
    ordered = runs.orderBy("start").collect()
    assert all(a["start"] + a["count"] == b["start"] and a["value"] != b["value"] for a, b in zip(ordered, ordered[1:]))
    changed = C.run_set_range(runs, ["map_id"], 10, 40, 1)
    assert {r["i"]: r["value"] for r in C.decode_runs(changed, ["map_id"]).collect()} == {i: 1 if 10 <= i <= 40 else v for i, v in bits.items()}
    points = spark.range(0, 120, 7).select(F.lit("map").alias("map_id"), F.col("id").alias("i"))
    assert {r["i"]: r["value"] for r in C.run_get(runs, ["map_id"], points).collect()} == {i: bits.get(i, 1) for i in range(0, 120, 7)}


@pytest.mark.parametrize("bits", [1, 3, 5, 16])
def test_packed_values(spark, bits):
    values = spark.range(50).select(F.lit("m").alias("g"), F.col("id").alias("i"), (F.col("id") * 7 % (1 << bits)).alias("v"))
    words = C.packed(values, ["g"], "i", "v", bits)
    each = 32 // bits
    both = values.withColumn("word", F.expr(f"i div {each}")).join(words, ["g", "word"])
    assert both.where(C.packed_get(F.col("packed"), F.col("i"), bits) != F.col("v")).count() == 0
    changed = both.withColumn("packed", C.packed_set(F.col("packed"), F.col("i"), F.lit(1), bits))
    assert changed.where(C.packed_get(F.col("packed"), F.col("i"), bits) != 1).count() == 0


def test_rendering_round_trip(spark):
    cells = maps.cells_from_lines(spark, random_rows(9, 7, 5, 0.3))
    rows = render.rendered_rows(cells, path=cells.where("x = y AND NOT wall"))
    parsed = render.parse_rendered(rows)
    assert parsed.select("map_id", "x", "y", "wall").exceptAll(cells.select("map_id", "x", "y", "wall")).count() == 0
    assert parsed.where("mark = '*'").count() == cells.where("x = y AND NOT wall").count()
    tile = render.tile_rows(cells, 4, 1, 1).collect()
    assert len(tile) == 1 and len(tile[0]["line"]) == 3


def test_path_cost_counts_the_first_cell(spark):
    rows = spark.createDataFrame([(0, "m", k, x, y) for k, (x, y) in enumerate([(0, 0), (1, 0), (2, 1), (2, 2)])], "query_id long, map_id string, seq long, x long, y long")
    r = paths.path_metrics(rows).first()
    assert (r["n_steps"], r["diagonal_steps"]) == (3, 1) and r["path_cost"] == pytest.approx(3 + 2**0.5)


def test_graph_maintenance(spark):
    edge = "map_id string, src_x long, src_y long, dst_x long, dst_y long, weight long, kind string"
    edges = graph.add_edges(spark.createDataFrame([], edge), spark.createDataFrame([("m", 0, 0, 1, 0, 5, "a"), ("m", 0, 0, 1, 0, 3, "b"), ("m", 0, 0, 0, 0, 0, "a")], edge))
    assert sorted(map(tuple, edges.collect())) == [("m", 0, 0, 1, 0, 3, "b"), ("m", 1, 0, 0, 0, 3, "b")]
    assert graph.node_count(edges).first()["nodes"] == 2
    pairs = spark.createDataFrame([("m", 0, 0, 1, 0), ("m", 5, 5, 1, 0)], "map_id string, src_x long, src_y long, dst_x long, dst_y long")
    assert sorted(r["weight"] or 0 for r in graph.edge_lookup(edges, pairs).collect()) == [0, 3]
    nodes = spark.createDataFrame([("m", 0, 0)], "map_id string, x long, y long")
    points = spark.createDataFrame([("m", 0, 0), ("m", 1, 1)], "map_id string, x long, y long")
    assert {(r["x"], r["found"]) for r in graph.node_lookup(nodes, points).collect()} == {(0, True), (1, False)}


def test_large_maps_go_by_border_cells(spark, monkeypatch):
    """One map above the bound of a flat search and one below it."""
    monkeypatch.setattr(paths, "FLAT_CELLS", 100)
    monkeypatch.setattr(paths, "FLAT_TILE", 7)
    rng = random.Random(5)
    lines = {n: ["".join("@" if rng.random() < 0.2 else "." for _ in range(n)) for _ in range(n)] for n in (9, 23)}
    cells = maps.cells_from_lines(spark, lines[9], "small").unionByName(maps.cells_from_lines(spark, lines[23], "large"))
    points = [(k, m, *(rng.randrange(n) for _ in range(4))) for k, (m, n) in enumerate([("small", 9), ("large", 23)] * 8)]
    todo = spark.createDataFrame(points, "query_id long, map_id string, sx long, sy long, gx long, gy long")
    split = {r["query_id"]: (r["success"], r["cost"]) for r in paths.find_paths(cells, todo, mode="flat").collect()}
    monkeypatch.undo()
    assert split == {r["query_id"]: (r["success"], r["cost"]) for r in paths.find_paths(cells, todo, mode="flat").collect()}
    assert any(ok for ok, _ in split.values()) and len(split) == 16


def test_rounds_of_blocks_do_not_grow(spark):
    """A way over 16 blocks: no edge is made, and no stage has more tasks because of the rounds before it."""
    rows = ["." * 64, "@" * 60 + "....", "." * 64]
    cells = maps.cells_from_lines(spark, rows).persist()
    spark.sparkContext.setJobGroup("blocks", "blocks")
    pre = paths.preprocess_exact(cells, 4)
    found = paths.abstract_paths(pre, query(spark, (0, 0), (0, 2)), broadcast_edges=0, block=4).collect()
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("blocks") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r["cost"] for r in found] == [distances(rows, (0, 0))[0, 2]]
    assert max(s.numTasks for s in stages if s) <= 4 * spark.sparkContext.defaultParallelism
    assert paths.abstract_paths(paths.preprocess(cells, 4), query(spark, (0, 0), (0, 2)), block=4).first()["cost"] >= found[0]["cost"]
    cells.unpersist()


def test_many_edges_are_not_made(spark, monkeypatch):
    monkeypatch.setattr(graph, "BROADCAST_EDGES", 10)
    rows = random_rows(11, 12, 12, 0.2)
    cells = maps.cells_from_lines(spark, rows).persist()
    pre = paths.preprocess_exact(cells, 4)
    assert pre.most_edges > 10 and "edges" not in vars(pre)
    free = [(x, y) for y in range(12) for x in range(12) if rows[y][x] == "."]
    found = paths.find_paths(cells, query(spark, free[0], free[-1]), 4, pre=pre).first()
    assert found["cost"] == distances(rows, free[0]).get(free[-1])
    cells.unpersist()


def test_flat_searches_get_rows_of_bits(spark):
    """A map travels to a flat search with a row for each of its rows, not for each cell."""
    rows = random_rows(3, 21, 6, 0.4)
    found = {r["y"]: r["bits"] for r in paths.open_rows(maps.cells_from_lines(spark, rows)).collect()}
    assert len(found) == 6
    for y, line in enumerate(rows):
        bits = "".join(f"{b:08b}" for b in found[y])
        assert bits.rstrip("0") == line.replace(".", "1").replace("@", "0").rstrip("0")


def test_rounds_of_few_blocks_take_no_jobs(spark):
    """Few bytes of blocks: a way over 16 blocks takes no more jobs than one over 2, but for a few that follow sizes."""
    cells = maps.cells_from_lines(spark, ["." * 64, "@" * 60 + "....", "." * 64]).persist()
    pre, jobs = paths.preprocess_exact(cells, 4), {}
    for gx in (7, 63):
        spark.sparkContext.setJobGroup(f"to {gx}", "blocks")
        assert paths.abstract_paths(pre, query(spark, (0, 0), (gx, 0)), broadcast_edges=0, block=4).first()["cost"] == gx
        jobs[gx] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"to {gx}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    cells.unpersist()
    assert jobs[63] <= jobs[7] + 3


@pytest.mark.parametrize("seed,width,height,size", [(0, 13, 9, 4), (1, 17, 23, 3)])
def test_rounds_in_tasks_and_over_tables(spark, monkeypatch, seed, width, height, size):
    """Two maps, walled and outer ends too; each way is one over the map."""
    lines = {m: random_rows(f"{seed}{m}", width, height, 0.3) for m in "ab"}
    cells = maps.cells_from_lines(spark, lines["a"], "a").unionByName(maps.cells_from_lines(spark, lines["b"], "b")).persist()
    rng = random.Random(seed)
    points = [(k, "ab"[k % 2], *(rng.randrange(n + (k == 0)) for n in (width, height, width, height))) for k in range(24)]
    todo = spark.createDataFrame([*points, (24, "a", 0, 0, width + 90, 0), (25, "b", -1, 0, 1, 1), (26, "c", 0, 0, 1, 1)], "query_id long, map_id string, sx long, sy long, gx long, gy long")
    for gates in (borders.border_pairs(cells, size), borders.entrances(cells, size)):
        pre = paths.preprocess(cells, size, gates)
        want = {r["query_id"]: r["cost"] for r in paths.abstract_paths(pre, todo).collect()}
        for bound in (0, blocks.SMALL_BYTES):
            monkeypatch.setattr(blocks, "SMALL_BYTES", bound)
            ways = written(paths.abstract_paths(pre, todo, broadcast_edges=0, block=2 * size))
            assert {r["query_id"]: r["cost"] for r in ways.collect()} == want
            assert {r["query_id"]: len(r["path"]) - 1 for r in paths.refine(pre, ways).collect()} == want
        monkeypatch.undo()
    cells.unpersist()


def test_rounds_over_tables_do_not_grow(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SMALL_BYTES", 0)
    test_rounds_of_blocks_do_not_grow(spark)


def test_path_queries_sort_no_map(spark):
    """Ends are the n-th open cells in row order; no window ranks all cells or pairs of a map."""
    rows = random_rows(2, 19, 14, 0.4)
    made = registry.path_queries(maps.cells_from_lines(spark, rows), 5)
    free = [(x, y) for y, line in enumerate(rows) for x, c in enumerate(line) if c == "."]
    found = {r["query_id"]: (r["sx"], r["sy"], r["gx"], r["gy"]) for r in made.collect()}
    assert {k: v for k, v in found.items() if k < 20} == {k: (*free[(1 + k * 397) % len(free)], *free[(53 + k * 911) % len(free)]) for k in range(20)}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"row_number\(\) windowspecdefinition\(map_id#\d+, y#", plan) and "WindowGroupLimit" in plan


def test_edges_go_to_the_driver_without_objects():
    """The driver splits edges by map in a few times their bytes."""
    n = 200_000
    columns = {"map_id": ["a map with a name", "b"] * (n // 2), **{c: list(range(n)) for c in ("src_x", "src_y", "dst_x", "dst_y", "weight")}}
    table = pa.concat_tables([pa.table({c: v[at : at + n // 2] for c, v in columns.items()}) for at in (0, n // 2)])
    tracemalloc.start()
    raw = graph._by_map(table)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2.5 * 40 * n
    assert list(raw) == ["a map with a name", "b"]
    for k, (source, target, weight) in enumerate(raw.values()):
        assert (source[:, 0] == np.arange(k, n, 2)).all() and (target[:, 1] == source[:, 1]).all() and (weight == source[:, 0]).all()
    assert graph._by_map(table.slice(0, 0)) == {}


def test_costs_need_no_refined_paths(spark, monkeypatch):
    """exact_path_cost over a small grid: no abstract way is refined to cells, and costs are those of paths."""
    rows = random_rows(4, 23, 17, 0.3)
    cells = maps.cells_from_lines(spark, rows).persist()
    todo = written(registry.path_queries(cells, 5))
    want = {(r["query_id"], r["success"], r["cost"]) for r in paths.find_paths(cells, todo, 5, "exact").collect()}
    monkeypatch.setattr(registry, "_grid", lambda spark, d: cells)
    monkeypatch.setattr(registry, "SIZE", 5)
    monkeypatch.setattr(paths, "refine", lambda *a: pytest.fail("refined"))
    for mode in ("exact", "flat"):
        found = paths.find_paths(cells, todo, 5, mode, with_path=False)
        assert found.columns == ["query_id", "map_id", "success", "cost"]
        assert {(r["query_id"], r["success"], r["cost"]) for r in found.collect()} == want
    assert registry.exact_path_cost(spark, "").count() == len(want) == 24
    cells.unpersist()


def test_path_lengths_write_what_is_read_again(spark, monkeypatch):
    """Paths are read once, so path_lengths writes only the cells itself; the bound of edges takes one action."""
    cells = maps.cells_from_lines(spark, random_rows(6, 17, 13, 0.2)).persist()
    gates, tables = written(borders.entrances(cells, 5)), []
    in_tiles = borders.abstract_nodes(gates, 5).groupBy("cx", "cy").count().collect()
    want = sum(r["count"] * (r["count"] - 1) for r in in_tiles) + 2 * len(gates.collect())
    with monkeypatch.context() as m:
        m.setattr(type(cells), "count", lambda df: pytest.fail("counted alone"))
        assert paths.preprocess(cells, 5, gates).most_edges == want > 0
    monkeypatch.setattr(registry, "_grid", lambda spark, d: cells)
    monkeypatch.setattr(registry, "written", lambda df: tables.append(df) or written(df))
    todo = registry.path_queries(cells)
    costs = {r["query_id"]: r["cost"] for r in paths.find_paths(cells, todo, registry.SIZE).collect() if r["success"]}
    assert {r["query_id"]: r["n_steps"] for r in registry.path_lengths(spark, "").collect()} == costs
    assert len(tables) == 1
    cells.unpersist()


def test_edges_come_to_the_driver_compressed(spark, monkeypatch):
    """Small buffers of Arrow come through whole, and the session's setting stays."""
    name, seen, plain = "spark.sql.execution.arrow.compression.codec", [], type(spark.range(0)).toArrow
    before = spark.conf.get(name)
    monkeypatch.setattr(type(spark.range(0)), "toArrow", lambda df: seen.append(df.sparkSession.conf.get(name)) or plain(df))
    rows = random_rows(8, 14, 9, 0.2)
    free = [(x, y) for y in range(9) for x in range(14) if rows[y][x] == "."]
    found = paths.find_paths(maps.cells_from_lines(spark, rows), query(spark, free[0], free[-1]), 4, "exact", with_path=False).first()
    assert found["cost"] == distances(rows, free[0]).get(free[-1])
    assert seen == ["zstd"] and spark.conf.get(name) == before


def test_freed_memory_goes_back(spark):
    """Python's memory that lies under a block in use, and whatever the JVM finds; a JVM without the command says nothing."""
    libc = ctypes.CDLL(None)
    libc.malloc.restype, libc.malloc.argtypes, libc.free.argtypes, libc.memset.argtypes = ctypes.c_void_p, [ctypes.c_size_t], [ctypes.c_void_p], [ctypes.c_void_p, ctypes.c_int, ctypes.c_size_t]
    held = lambda: int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) >> 10
    taken = [libc.malloc(1 << 16) for _ in range(2000)]
    for at in taken:
        libc.memset(at, 1, 1 << 16)
    for at in taken[:-1]:
        libc.free(at)
    before, said = held(), checkpoints.released(spark)
    assert held() < before - 100
    libc.free(taken[-1])
    assert said.startswith("Trim native heap")
    assert checkpoints.released(SimpleNamespace(sparkContext=SimpleNamespace(_jvm=spark._jvm, _gateway=SimpleNamespace(new_array=raised)))) is None


def raised(*_):
    raise Py4JError("no such command")


def test_path_lengths_give_back_memory_after_each_table(spark, monkeypatch):
    """Also after edges or blocks, which the driver holds for a while; results stay."""
    cells, log = maps.cells_from_lines(spark, random_rows(9, 17, 13, 0.2)).persist(), []
    kind, lengths = type(cells), lambda: {tuple(r) for r in registry.path_lengths(spark, "").collect()}
    monkeypatch.setattr(registry, "_grid", lambda spark, d: cells)
    want = lengths()
    for name in ("checkpoint", "toArrow"):
        monkeypatch.setattr(kind, name, lambda df, *a, f=getattr(kind, name), name=name, **b: log.append(name) or f(df, *a, **b))
    for module in (checkpoints, graph, blocks):
        monkeypatch.setattr(module, "released", lambda spark: log.append("released"))
    assert lengths() == want != set()
    abstract = paths.abstract_paths
    monkeypatch.setattr(paths, "abstract_paths", lambda pre, todo: abstract(pre, todo, broadcast_edges=0))
    assert lengths() == want
    assert log[1::2] == ["released"] * (len(log) // 2) and log[::2].count("toArrow") == 2 and "released" not in log[::2]
    cells.unpersist()
