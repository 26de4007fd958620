"""Searches inside tiles, many at a time: numpy floods from all starts of a batch of rows at once.

A tile travels as a mask of its open cells (and nodes), a bit a cell; points and tasks are joined to the masks of their
tiles, so a tile with many of them spreads over tasks and no group is collected.

Steps cost 1, so breadth-first distances are those of any search with a consistent heuristic. Ties between equally
short paths go to the first step of the list: west, north, east, south, then the diagonals if they are allowed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.geometry import DIAGONALS, STEPS
from gridloom.operators.cells import opened

POINTS = "array<struct<x:bigint,y:bigint>>"
KEYS = ["map_id", "cx", "cy"]
#: Cells that are flooded in one go.
CELLS = 1 << 22


def floods(rooms: np.ndarray, which: np.ndarray, x: np.ndarray, y: np.ndarray, steps) -> np.ndarray:
    """Distances (start, row, column) from starts (x, y) in rooms[which], below 0 where there is no way. Starts outside
    or on a wall reach nothing. Only the cells on the edge of a flood are looked at in each round."""
    height, width = rooms.shape[1:]
    room = np.full((len(rooms), height + 2, width + 2), -2, np.int32)
    room[:, 1:-1, 1:-1] = np.where(rooms, -1, -2)
    found = room[which].reshape(len(which), -1)
    flat, wide = found.reshape(-1), width + 2
    inside = (x >= 0) & (x < width) & (y >= 0) & (y < height)
    edge = (np.arange(len(which)) * found.shape[1] + (y + 1) * wide + x + 1)[inside]
    edge, level = edge[flat[edge] == -1], 0
    while len(edge):
        flat[edge] = level
        level += 1
        reached = []
        for dx, dy in steps:
            to = edge + dy * wide + dx
            to = to[flat[to] == -1]
            flat[to] = level
            reached.append(to)
        edge = np.concatenate(reached)
    return found.reshape(len(which), height + 2, wide)[:, 1:-1, 1:-1]


def walk(distance: np.ndarray, goal: tuple[int, int], steps) -> list[tuple[int, int]]:
    """The cells from the source to the goal; none if it wasn't reached."""
    x, y = goal
    if distance[y, x] < 0:
        return []
    path = [(x, y)]
    while distance[y, x]:
        for dx, dy in steps:
            u, v = x - dx, y - dy
            if 0 <= v < distance.shape[0] and 0 <= u < distance.shape[1] and distance[v, u] == distance[y, x] - 1:
                x, y = u, v
                break
        path.append((x, y))
    return path[::-1]


def _steps(diagonal: bool):
    return [(dx, dy) for dx, dy, _ in STEPS + (DIAGONALS if diagonal else ())]


def tile_masks(cells: DataFrame, size: int, nodes: DataFrame | None = None) -> DataFrame:
    """map_id, cx, cy, mask: of each tile with an open cell its open cells and, if nodes (map_id, x, y) are given, its
    nodes, as bits in row order."""
    place = ((F.col("y") - F.col("cy") * size) * size + F.col("x") - F.col("cx") * size).cast("int")
    # A tile's cells are bounded by its size.
    tiles = opened(cells, size).groupBy(*KEYS).agg(F.collect_list(place).alias("free"))
    if nodes is None:
        tiles = tiles.withColumn("marks", F.array().cast("array<int>"))
    else:
        at = nodes.select("map_id", "x", "y", F.expr(f"x div {size}").alias("cx"), F.expr(f"y div {size}").alias("cy"))
        tiles = tiles.join(at.groupBy(*KEYS).agg(F.collect_list(place).alias("marks")), KEYS, "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<int>")))

    def run(batches):
        for batch in batches:
            bits = []
            for c in ("free", "marks"):
                own = np.zeros((batch.num_rows, size * size), bool)
                lists = batch[c]
                own[np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = True
                bits.append(np.packbits(own, axis=1))
            masks = [x.tobytes() for x in np.concatenate(bits, axis=1)]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in KEYS], pa.array(masks, pa.binary())], [*KEYS, "mask"])

    return tiles.select(*KEYS, "free", "marks").mapInArrow(run, "map_id string, cx bigint, cy bigint, mask binary")


def _opened_masks(column, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which mask each row has, and the masks' open cells and nodes (mask, row, column)."""
    coded = column.dictionary_encode()
    data = np.frombuffer(b"".join(coded.dictionary.to_pylist()), np.uint8).reshape(len(coded.dictionary), 2, -1)
    bits = np.unpackbits(data, axis=2)[:, :, : size * size].astype(bool).reshape(-1, 2, size, size)
    return coded.indices.to_numpy(), bits[:, 0], bits[:, 1]


def _in_parts(batch, size: int):
    step = max(1, CELLS // (size + 2) ** 2)
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def tile_tasks(cells: DataFrame, tasks: DataFrame, size: int, with_path: bool = True, diagonal: bool = False, masks: DataFrame | None = None) -> DataFrame:
    """tasks (map_id, cx, cy, sx, sy, gx, gy and any other columns) with cost and path (start to goal) inside the tile;
    null if there is none. Points outside the tile or on a wall have none."""
    steps, own = _steps(diagonal), tasks.columns
    masks = tile_masks(cells, size) if masks is None else masks
    point = pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())]))

    def run(batches):
        for batch in (part for b in batches for part in _in_parts(b, size)):
            column = lambda c: batch[c].to_numpy(zero_copy_only=False)
            left, top = column("cx") * size, column("cy") * size
            cost, path = [None] * batch.num_rows, [None] * batch.num_rows
            there = np.flatnonzero(~batch["_mask"].is_null().to_numpy(zero_copy_only=False))
            if len(there):
                which, free, _ = _opened_masks(batch["_mask"].take(pa.array(there)), size)
                sx, sy, gx, gy = (column(c)[there] - corner[there] for c, corner in (("sx", left), ("sy", top), ("gx", left), ("gy", top)))
                spread = floods(free, which, sx, sy, steps)
                inside = np.flatnonzero((gx >= 0) & (gx < size) & (gy >= 0) & (gy < size))
                found = spread[inside, gy[inside], gx[inside]]
                for k, d in zip(inside[found >= 0].tolist(), found[found >= 0].tolist(), strict=True):
                    row = there[k]
                    cost[row] = d
                    if with_path:
                        path[row] = [{"x": int(x + left[row]), "y": int(y + top[row])} for x, y in walk(spread[k], (gx[k], gy[k]), steps)]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in own], pa.array(cost, pa.int64()), pa.array(path, point)], [*own, "cost", "path"])

    # New names for the columns: tasks and masks may come from one table.
    todo = tasks.select(*[F.col(c).alias(c) for c in own]).join(masks.select(*[F.col(c).alias(f"_{c}") for c in (*KEYS, "mask")]), _same_tile(), "left")
    schema = T.StructType([*tasks.schema.fields, T.StructField("cost", T.LongType()), T.StructField("path", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in "xy"])))])
    return todo.select(*own, "_mask").mapInArrow(run, schema)


def _same_tile():
    same = [F.col(c) == F.col(f"_{c}") for c in KEYS]
    return same[0] & same[1] & same[2]


def point_distances(cells: DataFrame, nodes: DataFrame, points: DataFrame, size: int, diagonal: bool = False, masks: DataFrame | None = None) -> DataFrame:
    """points (map_id, x, y and any other columns) with node_x, node_y, weight: a row for each of its tile's nodes that a
    point reaches inside the tile, both ends included."""
    steps, own = _steps(diagonal), points.columns
    masks = tile_masks(cells, size, nodes) if masks is None else masks

    def run(batches):
        for batch in (part for b in batches for part in _in_parts(b, size)):
            x, y = (batch[c].to_numpy() for c in "xy")
            left, top = x // size * size, y // size * size
            which, free, marks = _opened_masks(batch["_mask"], size)
            spread = floods(free, which, x - left, y - top, steps)
            row, ny, nx = np.nonzero((spread >= 0) & marks[which])
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([*[batch[c].take(at) for c in own], pa.array(nx + left[row]), pa.array(ny + top[row]), pa.array(spread[row, ny, nx].astype(np.int64))], [*own, "node_x", "node_y", "weight"])

    dealt = points.select(*[F.col(c).alias(c) for c in own]).withColumns({"cx": F.expr(f"x div {size}"), "cy": F.expr(f"y div {size}")})
    dealt = dealt.join(masks.select(*[F.col(c).alias(f"_{c}") for c in (*KEYS, "mask")]), _same_tile())
    schema = T.StructType([*points.schema.fields, *[T.StructField(c, T.LongType()) for c in ("node_x", "node_y", "weight")]])
    return dealt.select(*own, "_mask").mapInArrow(run, schema)


def intra_edges(cells: DataFrame, nodes: DataFrame, size: int, diagonal: bool = False, masks: DataFrame | None = None) -> DataFrame:
    """Edges between all nodes of a tile that reach each other inside it, both ways."""
    found = point_distances(cells, nodes, nodes.select("map_id", "x", "y"), size, diagonal, masks)
    named = found.select("map_id", F.col("x").alias("src_x"), F.col("y").alias("src_y"), F.col("node_x").alias("dst_x"), F.col("node_y").alias("dst_y"), "weight", F.lit("intra").alias("kind"))
    return named.where((F.col("src_x") != F.col("dst_x")) | (F.col("src_y") != F.col("dst_y")))
