"""Cells: lookups, neighbours, tiles, run lengths and packed bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import geometry as G


def dimensions(cells: DataFrame, size: int) -> DataFrame:
    found = cells.groupBy("map_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.sum(F.when(F.col("wall"), 0).otherwise(1)).alias("open_cells"), F.sum(F.when(F.col("wall"), 1).otherwise(0)).alias("wall_cells"))
    tiles_w, tiles_h = G.tile_count("w", size), G.tile_count("h", size)
    return found.withColumns({"tiles_w": tiles_w, "tiles_h": tiles_h, "tiles": tiles_w * tiles_h, "wall_pct": F.col("wall_cells") * 100.0 / (F.col("open_cells") + F.col("wall_cells"))})


def visited_percentage(cells: DataFrame, visited: DataFrame) -> DataFrame:
    """map_id, visited, visited_pct: how many open cells are among the places visited (map_id, x, y), and their share of all
    cells. A place that is visited again counts once."""
    seen = visited.select("map_id", "x", "y").distinct().withColumn("_seen", F.lit(1))
    open_seen = F.count_if(F.col("_seen").isNotNull() & ~F.col("wall"))
    return cells.join(seen, ["map_id", "x", "y"], "left").groupBy("map_id").agg(open_seen.alias("visited"), (open_seen * 100.0 / F.count(F.lit(1))).alias("visited_pct"))


def tiles(cells: DataFrame, size: int) -> DataFrame:
    wall = F.when(F.col("wall"), 1).otherwise(0)
    return cells.groupBy("map_id", G.tile_of("x", size).alias("cx"), G.tile_of("y", size).alias("cy")).agg(F.sum(1 - wall).alias("open_cells"), F.sum(wall).alias("wall_cells"))


def opened(cells: DataFrame, size: int) -> DataFrame:
    """Open cells with their tiles. Cells outside the map don't exist and can't be entered."""
    return cells.where(~F.col("wall")).select("map_id", "x", "y", G.tile_of("x", size).alias("cx"), G.tile_of("y", size).alias("cy"))


def lookup(cells: DataFrame, points: DataFrame) -> DataFrame:
    """points with wall; a point outside the map counts as wall."""
    return points.join(cells, ["map_id", "x", "y"], "left").withColumn("wall", F.coalesce("wall", F.lit(True)))


def neighbours(cells: DataFrame, diagonal: bool = False) -> DataFrame:
    """map_id, x, y, dir, nx, ny: steps between open cells; an equi-join on the neighbour's place."""
    steps = G.STEPS + (G.DIAGONALS if diagonal else ())
    free = cells.where(~F.col("wall")).select("map_id", "x", "y")
    ways = F.array(*[F.struct(F.lit(d).alias("dir"), (F.col("x") + dx).alias("nx"), (F.col("y") + dy).alias("ny")) for dx, dy, d in steps])
    moved = free.select("map_id", "x", "y", F.inline(ways))
    return moved.join(free.select("map_id", F.col("x").alias("nx"), F.col("y").alias("ny")), ["map_id", "nx", "ny"]).select("map_id", "x", "y", "dir", "nx", "ny")


# -- run lengths ------------------------------------------------------------------------------------------------------


def run_lengths(values: DataFrame, group: list[str], index: str, value: str) -> DataFrame:
    """group, start, value, count: maximal runs of equal values over consecutive indexes (gaps and islands)."""
    own = Window.partitionBy(*group).orderBy(index)
    same = Window.partitionBy(*group, value).orderBy(index)
    marked = values.withColumn("_island", F.row_number().over(own) - F.row_number().over(same))
    return marked.groupBy(*group, value, "_island").agg(F.min(index).alias("start"), F.count(F.lit(1)).alias("count")).select(*group, "start", F.col(value).alias("value"), "count")


def row_runs(cells: DataFrame) -> DataFrame:
    """map_id, y, start, value, count: runs within rows, so that no window holds a whole map."""
    return run_lengths(cells.select("map_id", "y", "x", F.col("wall").cast("int").alias("wall")), ["map_id", "y"], "x", "wall")


def map_runs(cells: DataFrame) -> DataFrame:
    """map_id, start, value, count: runs over the whole map in row order. Runs of rows are merged where one ends a row
    and the next begins one with the same value; only row runs meet in the map's window."""
    width = cells.groupBy("map_id").agg((F.max("x") + 1).alias("w"))
    runs = row_runs(cells).join(F.broadcast(width), "map_id").select("map_id", (F.col("start") + F.col("y") * F.col("w")).alias("start"), "value", "count")
    return _merged(runs, ["map_id"])


def _merged(runs: DataFrame, group: list[str]) -> DataFrame:
    """group, start, value, count: neighbours of one value as one run."""
    own = Window.partitionBy(*group).orderBy("start")
    new = F.coalesce((F.lag("value").over(own) != F.col("value")).cast("int"), F.lit(1))
    merged = runs.withColumn("_new", new).withColumn("_island", F.sum("_new").over(own))
    return merged.groupBy(*group, "_island").agg(F.min("start").alias("start"), F.first("value").alias("value"), F.sum("count").alias("count")).drop("_island")


def decode_runs(runs: DataFrame, group: list[str]) -> DataFrame:
    return runs.select(*group, F.explode(F.sequence("start", F.col("start") + F.col("count") - 1)).alias("i"), "value")


def run_get(runs: DataFrame, group: list[str], points: DataFrame) -> DataFrame:
    """points (group, i) with value; past the last run it is 1. The run is found by its start, in one ordered pass."""
    own = Window.partitionBy(*group).orderBy("i", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = runs.select(*group, F.col("start").alias("i"), F.lit(0).alias("_kind"), F.struct("start", "count", "value").alias("_run")).unionByName(points.select(*group, "i", F.lit(1).alias("_kind"), F.lit(None).cast("struct<start:bigint,count:bigint,value:int>").alias("_run")))
    found = both.withColumn("_at", F.last("_run", ignorenulls=True).over(own)).where("_kind = 1")
    return found.select(*group, "i", F.when(F.col("i") < F.col("_at.start") + F.col("_at.count"), F.col("_at.value")).otherwise(1).alias("value"))


def run_set_range(runs: DataFrame, group: list[str], first: int, last: int, value: int) -> DataFrame:
    """Indexes first to last get the value; runs are maximal again. Runs are cut at the range and merged with equal
    neighbours, without being decoded: only runs meet in a group's window."""
    end = F.col("start") + F.col("count") - 1
    before = runs.where(F.col("start") < first).select(*group, "start", "value", (F.least(end, F.lit(first - 1)) - F.col("start") + 1).alias("count"))
    after = runs.where(end > last).select(*group, F.greatest("start", F.lit(last + 1)).alias("start"), "value", (end - F.greatest("start", F.lit(last + 1)) + 1).alias("count"))
    inside = runs.where((F.col("start") <= last) & (end >= first)).groupBy(*group).agg(F.greatest(F.min("start"), F.lit(first)).alias("start"), F.least(F.max(end), F.lit(last)).alias("_end"))
    inside = inside.select(*group, "start", F.lit(value).alias("value"), (F.col("_end") - F.col("start") + 1).alias("count"))
    return _merged(before.unionByName(inside).unionByName(after), group)


# -- packed bits ------------------------------------------------------------------------------------------------------


def packed(values: DataFrame, group: list[str], index: str, value: str, bits: int = 1) -> DataFrame:
    """group, word, packed: values of `bits` bits in 32-bit words, first value in the highest bits; left-over bits are 0."""
    each = 32 // bits
    place = 32 - bits * (F.pmod(F.col(index), F.lit(each)) + 1)
    return values.groupBy(*group, F.expr(f"{index} div {each}").alias("word")).agg(F.sum(F.col(value).cast("long") * F.pow(F.lit(2.0), place).cast("long")).alias("packed"))


def packed_get(word: Column, index: Column, bits: int = 1) -> Column:
    """The value at an index, from the word that holds it."""
    each = 32 // bits
    shift = (32 - bits * (F.pmod(index, F.lit(each)) + 1)).cast("int")
    return F.call_function("shiftright", word, shift).bitwiseAND((1 << bits) - 1)


def packed_set(word: Column, index: Column, value: Column, bits: int = 1) -> Column:
    each = 32 // bits
    shift = (32 - bits * (F.pmod(index, F.lit(each)) + 1)).cast("int")
    mask = F.call_function("shiftleft", F.lit((1 << bits) - 1).cast("long"), shift)
    return word.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(F.call_function("shiftleft", value.cast("long"), shift))
