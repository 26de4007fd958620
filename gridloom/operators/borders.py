"""Tile borders: passable pairs, sections, entrances, and the nodes and edges they give. No Python on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.cells import opened

EDGE = ("map_id", "src_x", "src_y", "dst_x", "dst_y", "weight", "kind")


def border_pairs(cells: DataFrame, size: int) -> DataFrame:
    """map_id, side, cx, cy, a_x, a_y, b_x, b_y: open cells that face each other over a border, each found by an
    equi-join. Side H leads to the tile at the right, V to the one below."""
    free = opened(cells, size)
    far = free.select("map_id", F.col("x").alias("b_x"), F.col("y").alias("b_y"))
    near = free.withColumnsRenamed({"x": "a_x", "y": "a_y"})
    right = near.where(F.col("a_x") % size == size - 1).withColumns({"b_x": F.col("a_x") + 1, "b_y": F.col("a_y"), "side": F.lit("H")})
    below = near.where(F.col("a_y") % size == size - 1).withColumns({"b_x": F.col("a_x"), "b_y": F.col("a_y") + 1, "side": F.lit("V")})
    return right.unionByName(below).join(far, ["map_id", "b_x", "b_y"]).select("map_id", "side", "cx", "cy", "a_x", "a_y", "b_x", "b_y")


def tile_adjacency(tiles: DataFrame) -> DataFrame:
    """map_id, side, cx, cy, to_cx, to_cy: tiles next to each other, to the right and below."""
    ways = F.array(F.struct(F.lit("H").alias("side"), (F.col("cx") + 1).alias("to_cx"), F.col("cy").alias("to_cy")), F.struct(F.lit("V").alias("side"), F.col("cx").alias("to_cx"), (F.col("cy") + 1).alias("to_cy")))
    there = tiles.select("map_id", F.col("cx").alias("to_cx"), F.col("cy").alias("to_cy"))
    return tiles.select("map_id", "cx", "cy", F.inline(ways)).join(there, ["map_id", "to_cx", "to_cy"]).select("map_id", "side", "cx", "cy", "to_cx", "to_cy")


def sections(cells: DataFrame, size: int) -> DataFrame:
    """border_pairs with pos (along the border), section (its first pos), rank in the section from 0, and size."""
    pairs = border_pairs(cells, size).withColumn("pos", F.when(F.col("side") == "H", F.col("a_y")).otherwise(F.col("a_x")))
    border = ["map_id", "side", "cx", "cy"]
    pairs = pairs.withColumn("_island", F.col("pos") - F.row_number().over(Window.partitionBy(*border).orderBy("pos")))
    own = Window.partitionBy(*border, "_island")
    return pairs.withColumns({"section": F.min("pos").over(own), "rank": F.row_number().over(own.orderBy("pos")) - 1, "size": F.count(F.lit(1)).over(own)}).drop("_island")


def border_sections(cells: DataFrame, size: int) -> DataFrame:
    return sections(cells, size).where("rank = 0").select("map_id", "side", "cx", "cy", "section", "size")


def entrances(cells: DataFrame, size: int) -> DataFrame:
    """One pair for each section: the one in its middle, of an even number the later. All sections count."""
    return sections(cells, size).where("rank = size div 2").select("map_id", "side", "cx", "cy", "a_x", "a_y", "b_x", "b_y")


def abstract_nodes(gates: DataFrame, size: int) -> DataFrame:
    """Distinct ends of entrances with their tiles; a cell can be an end of several."""
    ends = F.array(F.struct(F.col("a_x").alias("x"), F.col("a_y").alias("y")), F.struct(F.col("b_x").alias("x"), F.col("b_y").alias("y")))
    points = gates.select("map_id", F.inline(ends)).distinct()
    return points.withColumns({"cx": F.expr(f"x div {size}"), "cy": F.expr(f"y div {size}")})


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse; the lightest of several between two nodes."""
    back = edges.select("map_id", F.col("dst_x").alias("src_x"), F.col("dst_y").alias("src_y"), F.col("src_x").alias("dst_x"), F.col("src_y").alias("dst_y"), "weight", "kind")
    return upsert(edges.select(*EDGE).unionByName(back))


def upsert(edges: DataFrame) -> DataFrame:
    """One edge for each source and target: the lightest, of its kind first by name. No edge from a node to itself."""
    kept = edges.where((F.col("src_x") != F.col("dst_x")) | (F.col("src_y") != F.col("dst_y")))
    best = kept.groupBy("map_id", "src_x", "src_y", "dst_x", "dst_y").agg(F.min(F.struct("weight", "kind")).alias("best"))
    return best.select("map_id", "src_x", "src_y", "dst_x", "dst_y", "best.weight", "best.kind")


def inter_edges(gates: DataFrame) -> DataFrame:
    named = gates.select("map_id", F.col("a_x").alias("src_x"), F.col("a_y").alias("src_y"), F.col("b_x").alias("dst_x"), F.col("b_y").alias("dst_y"), F.lit(1).cast("long").alias("weight"), F.lit("inter").alias("kind"))
    return both_ways(named)
