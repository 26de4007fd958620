"""Path queries: flat, inside a tile, and hierarchical over preprocessing that many queries share."""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.geometry import DIAGONALS, STEPS
from gridloom.operators import blocks, borders, cells as C, graph, local
from gridloom.plans.checkpoints import bounded_batches, written

POINTS = local.POINTS
#: A whole map goes to a task for a flat search up to so many cells; larger ones go by all border cells, in tiles of so many
#: cells a side.
FLAT_CELLS, FLAT_TILE = 16_000_000, 64
#: A map's flat searches are dealt to so many tasks at most, each with the map.
FLAT_TASKS = 8


@dataclass(frozen=True)
class Preprocessed:
    """What doesn't depend on queries: kept once, used by many."""

    cells: DataFrame
    size: int
    entrances: DataFrame
    nodes: DataFrame
    masks: DataFrame
    most_edges: int

    @cached_property
    def edges(self) -> DataFrame:
        """Made when first used; searches block by block do without."""
        intra = local.intra_edges(self.cells, self.nodes, self.size, masks=self.masks).select(*borders.EDGE)
        return written(borders.upsert(borders.inter_edges(self.entrances).unionByName(intra)))


def preprocess(cells: DataFrame, size: int, gates: DataFrame | None = None) -> Preprocessed:
    gates = written(borders.entrances(cells, size) if gates is None else gates)
    nodes = written(borders.abstract_nodes(gates, size))
    masks = written(local.tile_masks(cells, size, nodes))
    # As many as if all nodes of a tile reached each other, and two for each entrance.
    inside = nodes.groupBy("map_id", "cx", "cy").count().select(F.expr("count * (count - 1)").alias("n"))
    most = inside.unionByName(gates.select(F.lit(2).cast("long").alias("n"))).agg(F.sum("n")).first()[0] or 0
    pre = Preprocessed(cells, size, gates, nodes, masks, most)
    if pre.most_edges <= graph.BROADCAST_EDGES:
        pre.edges  # noqa: B018
    return pre


def preprocess_exact(cells: DataFrame, size: int) -> Preprocessed:
    """Every passable border pair is an entrance: hierarchical costs over it are the shortest."""
    return preprocess(cells, size, borders.border_pairs(cells, size))


def abstract_paths(pre: Preprocessed, queries: DataFrame, broadcast_edges: int = graph.BROADCAST_EDGES, block: int = blocks.BLOCK) -> DataFrame:
    """query_id, map_id, cost, nodes (start, abstract nodes, goal; repeats left out) of queries (query_id, map_id, sx,
    sy, gx, gy). A way inside the tile that start and goal share is one candidate, not the only one."""
    size = pre.size
    if pre.most_edges > broadcast_edges:
        over = blocks.solve(pre.masks, pre.entrances, queries, size, block)
    else:
        point = lambda end, x, y: F.struct(F.lit(end).alias("end"), F.col(x).alias("x"), F.col(y).alias("y"))
        points = queries.select("query_id", "map_id", F.inline(F.array(point("s", "sx", "sy"), point("g", "gx", "gy"))))
        ends = local.point_distances(pre.cells, pre.nodes, points, size, masks=pre.masks).select("query_id", "map_id", "end", "node_x", "node_y", "weight")
        over = graph.solve(pre.edges, written(ends))
    over = over.withColumn("direct", F.lit(1))
    shared = queries.where(F.expr(f"sx div {size} = gx div {size} AND sy div {size} = gy div {size}"))
    tasks = shared.select("map_id", F.col("query_id").alias("task_id"), F.expr(f"sx div {size}").alias("cx"), F.expr(f"sy div {size}").alias("cy"), "sx", "sy", "gx", "gy")
    inside = local.tile_tasks(pre.cells, tasks, size, with_path=False, masks=pre.masks).where("cost IS NOT NULL")
    inside = inside.select(F.col("task_id").alias("query_id"), "map_id", "cost", F.lit(None).cast(POINTS).alias("nodes"), F.lit(0).alias("direct"))
    best = over.unionByName(inside).groupBy("query_id", "map_id").agg(F.min(F.struct("cost", "direct", "nodes")).alias("best"))
    point = lambda x, y: F.array(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    whole = F.concat(point("sx", "sy"), F.coalesce("best.nodes", F.array().cast(POINTS)), point("gx", "gy"))
    fresh = F.filter(whole, lambda p, i: (i == 0) | (p != F.get(whole, i - 1)))
    return best.join(queries, ["query_id", "map_id"]).select("query_id", "map_id", F.col("best.cost").alias("cost"), fresh.alias("nodes"))


def hops(waypoints: DataFrame) -> DataFrame:
    """query_id, map_id, seq, sx, sy, gx, gy: from each node of `nodes` to the next."""
    at = waypoints.select("query_id", "map_id", "nodes", F.explode(F.sequence(F.lit(0), F.size("nodes") - 1)).alias("seq")).where(F.col("seq") + 1 < F.size("nodes"))
    a, b = F.get("nodes", F.col("seq")), F.get("nodes", F.col("seq") + 1)
    return at.select("query_id", "map_id", "seq", a["x"].alias("sx"), a["y"].alias("sy"), b["x"].alias("gx"), b["y"].alias("gy"))


def refine(pre: Preprocessed, waypoints: DataFrame) -> DataFrame:
    """query_id, map_id, path: cells from start to goal, each once where pieces meet."""
    size = pre.size
    steps = hops(waypoints).withColumns({"cx": F.expr(f"sx div {size}"), "cy": F.expr(f"sy div {size}"), "to_cx": F.expr(f"gx div {size}"), "to_cy": F.expr(f"gy div {size}")})
    crossing = (F.col("cx") != F.col("to_cx")) | (F.col("cy") != F.col("to_cy"))
    over = steps.where(crossing).select("query_id", "map_id", "seq", F.array(F.struct(F.col("sx").alias("x"), F.col("sy").alias("y")), F.struct(F.col("gx").alias("x"), F.col("gy").alias("y"))).alias("path"))
    inside = local.tile_tasks(pre.cells, steps.where(~crossing).select("query_id", "map_id", "seq", "cx", "cy", "sx", "sy", "gx", "gy"), size, masks=pre.masks)
    pieces = over.unionByName(inside.select("query_id", "map_id", "seq", "path"))
    joined = gather(pieces)
    alone = waypoints.where(F.size("nodes") == 1).select("query_id", "map_id", F.col("nodes").alias("path"))
    return joined.unionByName(alone)


def gather(pieces: DataFrame) -> DataFrame:
    """query_id, map_id, path of pieces (seq, path) in order; of a later piece the first cell goes."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "path")))
    parts = F.transform(ordered, lambda s: F.when(s["seq"] == 0, s["path"]).otherwise(F.slice(s["path"], F.lit(2), F.greatest(F.size(s["path"]) - 1, F.lit(0)))))
    return pieces.groupBy("query_id", "map_id").agg(F.flatten(parts).alias("path"))


def open_rows(cells: DataFrame) -> DataFrame:
    """map_id, y, bits: the open cells of each row that has some, a bit a cell from x = 0."""

    def run(batches):
        for batch in batches:
            bits = []
            for k in range(batch.num_rows):
                xs = batch["xs"].slice(k, 1).flatten().to_numpy()
                row = np.zeros(int(xs.max()) + 1, bool)
                row[xs] = True
                bits.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch["map_id"], batch["y"], pa.array(bits, pa.binary())], ["map_id", "y", "bits"])

    rows = cells.where(~F.col("wall")).groupBy("map_id", "y").agg(F.collect_list("x").alias("xs"))
    bounded_batches(cells.sparkSession)
    return rows.select("map_id", "y", "xs").mapInArrow(run, "map_id string, y bigint, bits binary")


def flat_paths(cells: DataFrame, queries: DataFrame, heuristic: str = "manhattan", diagonal: bool = False) -> DataFrame:
    """query_id, map_id, cost, path, visited: best-first search over the whole map. Maps of over FLAT_CELLS cells, which are
    counted first, go through preprocess_exact, whose costs are equal; visited is null for them, and diagonal steps
    aren't offered."""
    queries = queries.select(*[F.col(c).alias(c) for c in ("query_id", "map_id", "sx", "sy", "gx", "gy")])
    large = written(cells.groupBy("map_id").count().where(F.col("count") > FLAT_CELLS).select("map_id"))
    if not large.isEmpty():
        if diagonal:
            raise ValueError(f"diagonal steps over a map of more than {FLAT_CELLS} cells")
        of = lambda df, how: written(df.join(large, "map_id", how))
        found = find_paths(of(cells, "left_semi"), of(queries, "left_semi"), FLAT_TILE, "exact").select("query_id", "map_id", "cost", "path", F.lit(None).cast("long").alias("visited"))
        return flat_paths(of(cells, "left_anti"), of(queries, "left_anti"), heuristic).unionByName(found)
    steps = [(dx, dy) for dx, dy, _ in STEPS + (DIAGONALS if diagonal else ())]
    schema = f"query_id bigint, map_id string, cost bigint, path {POINTS}, visited bigint"

    def estimate(x, y, gx, gy):
        dx, dy = abs(x - gx), abs(y - gy)
        if heuristic == "manhattan" and not diagonal:
            return dx + dy
        return int((dx * dx + dy * dy) ** 0.5) if heuristic == "euclidean" and not diagonal else max(dx, dy)

    def search(free, start, goal):
        height, width = free.shape
        inside = lambda x, y: 0 <= x < width and 0 <= y < height and free[y, x]
        if not (inside(*start) and inside(*goal)):
            return None, None, 0
        cost, came, closed = {start: 0}, {}, set()
        heap = [(estimate(*start, *goal), 0, 0, start)]
        pushed = 0
        while heap:
            _, _, _, at = heapq.heappop(heap)
            if at in closed:
                continue
            closed.add(at)
            if at == goal:
                path = [at]
                while path[-1] in came:
                    path.append(came[path[-1]])
                return cost[goal], path[::-1], len(closed)
            for dx, dy in steps:
                to = (at[0] + dx, at[1] + dy)
                if inside(*to) and to not in closed and cost[at] + 1 < cost.get(to, 1 << 60):
                    cost[to], came[to] = cost[at] + 1, at
                    pushed += 1
                    heapq.heappush(heap, (cost[to] + estimate(*to, *goal), -cost[to], pushed, to))
        return None, None, len(closed)

    def run(key, todo, own):
        out = []
        bits = [np.unpackbits(np.frombuffer(b, np.uint8)) for b in own["bits"]]
        free = np.zeros((int(own["y"].max()) + 1 if len(own) else 0, max(map(len, bits), default=0)), bool)
        for y, row in zip(own["y"], bits, strict=True):
            free[y, : len(row)] = row
        for q in todo.itertuples():
            cost, path, visited = search(free, (q.sx, q.sy), (q.gx, q.gy))
            out.append((q.query_id, key[0], cost, None if path is None else [{"x": int(x), "y": int(y)} for x, y in path], visited))
        made = pd.DataFrame(out, columns=["query_id", "map_id", "cost", "path", "visited"])
        return made.astype({"cost": "Int64"})

    part = F.pmod(F.xxhash64("query_id"), F.lit(FLAT_TASKS)).alias("part")
    queries = queries.select("*", part)
    # A map goes to as many tasks as it has parts of queries.
    parts = queries.select(F.col("map_id").alias("_map_id"), F.col("part").alias("_part")).distinct()
    free = open_rows(cells).join(parts, F.col("map_id") == F.col("_map_id")).select("map_id", F.col("_part").alias("part"), "y", "bits")
    return queries.groupBy("map_id", "part").cogroup(free.groupBy("map_id", "part")).applyInPandas(run, schema)


def find_paths(cells: DataFrame, queries: DataFrame, size: int = 50, mode: str = "hier", heuristic: str = "manhattan", pre: Preprocessed | None = None, with_path: bool = True) -> DataFrame:
    """query_id, map_id, success, cost, path_length (cells), path. mode: hier, exact or flat.

    Costs are steps. hier crosses tile borders at entrances only and may be longer than flat; exact crosses anywhere.
    Without with_path the last two columns are left out, and abstract ways aren't refined to cells.
    """
    queries = queries.select("query_id", "map_id", "sx", "sy", "gx", "gy")
    if mode == "flat":
        found = flat_paths(cells, queries, heuristic).select("query_id", "map_id", "cost", "path").where("cost IS NOT NULL")
    else:
        queries = written(queries)
        pre = pre or (preprocess_exact if mode == "exact" else preprocess)(cells, size)
        found = abstract_paths(pre, queries)
        if with_path:
            ways = written(found)
            found = refine(pre, ways).join(ways.select("query_id", "map_id", "cost"), ["query_id", "map_id"])
    out = queries.join(found, ["query_id", "map_id"], "left")
    path = [F.size("path").cast("long").alias("path_length"), "path"] if with_path else []
    return out.select("query_id", "map_id", F.col("cost").isNotNull().alias("success"), "cost", *path)


def path_rows(paths: DataFrame) -> DataFrame:
    """query_id, map_id, seq, x, y."""
    return paths.select("query_id", "map_id", F.posexplode("path").alias("seq", "p")).select("query_id", "map_id", F.col("seq").cast("long").alias("seq"), "p.x", "p.y")


def path_metrics(rows: DataFrame) -> DataFrame:
    """n_steps, straight and diagonal steps, and path_cost: the first cell costs 1, a step 1 or, on both axes, root 2."""
    own = Window.partitionBy("query_id", "map_id").orderBy("seq")
    dx, dy = F.abs(F.col("x") - F.lag("x").over(own)), F.abs(F.col("y") - F.lag("y").over(own))
    both = F.coalesce((dx > 0) & (dy > 0), F.lit(False))
    marked = rows.withColumns({"_both": both, "_jump": F.coalesce(F.greatest(dx, dy) != 1, F.lit(False))})
    return marked.groupBy("query_id", "map_id").agg((F.count(F.lit(1)) - 1).alias("n_steps"), F.sum(F.col("_both").cast("long")).alias("diagonal_steps"), F.sum(F.col("_jump").cast("long")).alias("jumps"), F.sum(F.when(F.col("_both"), F.sqrt(F.lit(2.0))).otherwise(1.0)).alias("path_cost"))


def path_violations(cells: DataFrame, paths: DataFrame, queries: DataFrame) -> DataFrame:
    """For each found path: cells on walls or outside, steps that aren't one cell along one axis, repeated cells, wrong ends."""
    rows = path_rows(paths.where("success"))
    walls = C.lookup(cells, rows).groupBy("query_id", "map_id").agg(F.sum(F.col("wall").cast("long")).alias("walls"), (F.count(F.lit(1)) - F.count_distinct("x", "y")).alias("repeats"))
    shape = path_metrics(rows).select("query_id", "map_id", (F.col("jumps") + F.col("diagonal_steps")).alias("jumps"), "n_steps")
    ends = paths.where("success").join(queries, ["query_id", "map_id"])
    first, last = F.element_at("path", 1), F.element_at("path", -1)
    wrong = ((first["x"] != F.col("sx")) | (first["y"] != F.col("sy")) | (last["x"] != F.col("gx")) | (last["y"] != F.col("gy"))).cast("long")
    ends = ends.select("query_id", "map_id", "cost", wrong.alias("wrong_ends"))
    out = ends.join(walls, ["query_id", "map_id"]).join(shape, ["query_id", "map_id"])
    return out.select("query_id", "map_id", "cost", (F.col("walls") + F.col("repeats") + F.col("jumps") + F.col("wrong_ends") + F.abs(F.col("cost") - F.col("n_steps"))).alias("violations"))


def compare(hier: DataFrame, flat: DataFrame) -> DataFrame:
    """query_id, map_id, flat_cost, hier_cost, pct: how much longer the hierarchical way is."""
    both = flat.select("query_id", "map_id", F.col("cost").alias("flat_cost")).join(hier.select("query_id", "map_id", F.col("cost").alias("hier_cost")), ["query_id", "map_id"])
    longer = (F.col("hier_cost") - F.col("flat_cost")) * 100.0 / F.col("flat_cost")
    return both.withColumn("pct", F.when(F.col("flat_cost") != 0, longer))
