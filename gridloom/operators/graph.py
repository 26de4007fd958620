"""The abstract graph: construction, lookups and shortest ways for many queries."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.borders import EDGE, both_ways, upsert
from gridloom.plans.checkpoints import collected, released

__all__ = ["add_edges", "add_nodes", "both_ways", "degree", "edge_lookup", "expand", "node_count", "node_lookup", "solve", "upsert"]

#: Edges are sent to every executor up to this number; beyond, ways are found block by block (operators/blocks.py).
BROADCAST_EDGES = 1_000_000
POINTS = "array<struct<x:bigint,y:bigint>>"


def add_nodes(nodes: DataFrame, more: DataFrame) -> DataFrame:
    return nodes.unionByName(more.select(*nodes.columns)).distinct()


def add_edges(edges: DataFrame, more: DataFrame, directed: bool = False) -> DataFrame:
    more = more.select(*EDGE)
    return upsert(edges.select(*EDGE).unionByName(more if directed else both_ways(more)))


def node_count(edges: DataFrame) -> DataFrame:
    ends = edges.select("map_id", F.inline(F.array(F.struct(F.col("src_x").alias("x"), F.col("src_y").alias("y")), F.struct(F.col("dst_x").alias("x"), F.col("dst_y").alias("y")))))
    return ends.distinct().groupBy("map_id").agg(F.count(F.lit(1)).alias("nodes"))


def degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("map_id", F.col("src_x").alias("x"), F.col("src_y").alias("y")).agg(F.count(F.lit(1)).alias("degree"), F.min("weight").alias("nearest"))


def node_lookup(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """points with found: whether the place is a node."""
    return points.join(nodes.select("map_id", "x", "y", F.lit(True).alias("found")), ["map_id", "x", "y"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def edge_lookup(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (map_id, src_x, src_y, dst_x, dst_y) with the edge's weight and kind, or nulls."""
    return pairs.join(edges.select(*EDGE), list(EDGE[:5]), "left")


def expand(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """frontier (query_id, map_id, x, y, d) a step on: query_id, map_id, x, y, d, from_x, from_y."""
    onward = edges.select("map_id", F.col("src_x").alias("x"), F.col("src_y").alias("y"), "dst_x", "dst_y", "weight")
    return frontier.join(onward, ["map_id", "x", "y"]).select("query_id", "map_id", F.col("dst_x").alias("x"), F.col("dst_y").alias("y"), (F.col("d") + F.col("weight")).alias("d"), F.col("x").alias("from_x"), F.col("y").alias("from_y"))


class _Graph:
    """Edges of one map in rows by source: nodes as sorted pairs packed in one number, with the place of the first edge of
    each; of each edge the target's number and the weight."""

    def __init__(self, source: np.ndarray, target: np.ndarray, weight: np.ndarray):
        self.corner = np.minimum(source.min(axis=0), target.min(axis=0))
        self.wide = int(np.maximum(source.max(axis=0), target.max(axis=0))[1] - self.corner[1]) + 1
        both = np.concatenate([self._packed(source), self._packed(target)])
        self.nodes, at = np.unique(both, return_inverse=True)
        order = np.lexsort((at[len(source) :], at[: len(source)]))
        self.first = np.searchsorted(at[: len(source)][order], np.arange(len(self.nodes) + 1)).tolist()
        self.target, self.weight = at[len(source) :][order].tolist(), weight[order].tolist()

    def _packed(self, places: np.ndarray) -> np.ndarray:
        return (places[:, 0] - self.corner[0]) * self.wide + places[:, 1] - self.corner[1]

    def places(self, k):
        return self.nodes[k] // self.wide + self.corner[0], self.nodes[k] % self.wide + self.corner[1]

    def place(self, k: int) -> dict:
        return dict(zip("xy", map(int, self.places(k)), strict=True))

    def numbers(self, places: np.ndarray) -> np.ndarray:
        """Of each place its node's number; nodes without an edge come after all others."""
        y = places[:, 1] - self.corner[1]
        packed = self._packed(places)
        at = np.minimum(np.searchsorted(self.nodes, packed), len(self.nodes) - 1)
        return np.where((self.nodes[at] == packed) & (y >= 0) & (y < self.wide), at, -1)

    def search(self, start: dict[int, int], goal: dict[int, int]) -> tuple[int | None, list[int]]:
        """The cost and the nodes on the way. Ties go to the node that comes first by place."""
        heap = [(w, k, -1) for k, w in start.items()]
        heapq.heapify(heap)
        came, best, last = {}, None, -1
        while heap:
            d, k, before = heapq.heappop(heap)
            if best is not None and d >= best:
                break
            if k in came:
                continue
            came[k] = before
            if k in goal and (best is None or d + goal[k] < best):
                best, last = d + goal[k], k
            for e in range(self.first[k], self.first[k + 1]):
                if self.target[e] not in came:
                    heapq.heappush(heap, (d + self.weight[e], self.target[e], k))
        way = []
        while last != -1:
            way.append(last)
            last = came[last]
        return best, way[::-1]


def _by_map(table: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sources, targets and weights of each map's edges. Names of maps stay codes: no object is made for an edge."""
    coded = table["map_id"].combine_chunks().dictionary_encode()
    of, column = coded.indices.to_numpy(), lambda c: table[c].to_numpy()
    raw = {}
    for k, map_id in enumerate(coded.dictionary.to_pylist()):
        own = np.flatnonzero(of == k)
        raw[map_id] = (np.stack([column("src_x")[own], column("src_y")[own]], axis=1), np.stack([column("dst_x")[own], column("dst_y")[own]], axis=1), column("weight")[own])
    return raw


def solve(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """query_id, map_id, cost, nodes: the cheapest way for each query, or no row.

    ends (query_id, map_id, end, node_x, node_y, weight) say what it costs to get from the start ('s') to nodes and
    from nodes to the goal ('g'). Each query is a priority-queue search against a broadcast graph; the caller sees to it
    that there are at most BROADCAST_EDGES edges.
    """
    raw = _by_map(collected(edges.select("map_id", "src_x", "src_y", "dst_x", "dst_y", "weight")))
    # At most BROADCAST_EDGES edges of 40 bytes.
    shared = edges.sparkSession.sparkContext.broadcast(raw)
    del raw
    released(edges.sparkSession)
    point = pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())]))

    def run(batches):
        graphs = {}
        for batch in batches:
            out = []
            for query_id, map_id, own in zip(batch["query_id"].to_pylist(), batch["map_id"].to_pylist(), batch["ends"].to_pylist(), strict=True):
                if map_id not in graphs:
                    graphs[map_id] = _Graph(*shared.value[map_id]) if map_id in shared.value else None
                g = graphs[map_id]
                if g is None:
                    continue
                sides = {"s": {}, "g": {}}
                for e, k in zip(own, g.numbers(np.array([(e["node_x"], e["node_y"]) for e in own], np.int64)).tolist(), strict=True):
                    if k >= 0:
                        sides[e["end"]][k] = e["weight"]
                cost, way = g.search(sides["s"], sides["g"])
                if cost is not None:
                    out.append((query_id, map_id, cost, [g.place(k) for k in way]))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), point), strict=True)], ["query_id", "map_id", "cost", "nodes"])

    # A query's ends are the nodes of two tiles: bounded by their borders.
    of_query = ends.groupBy("query_id", "map_id").agg(F.collect_list(F.struct("end", "node_x", "node_y", "weight")).alias("ends"))
    return of_query.mapInArrow(run, f"query_id bigint, map_id string, cost bigint, nodes {POINTS}")
