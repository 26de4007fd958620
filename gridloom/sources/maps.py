"""Maps: text files, tables and generated mazes, as cells (map_id, x, y, wall) and headers (map_id, type, h, w)."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geometry as G


def read_map_text(spark: SparkSession, path: str) -> DataFrame:
    """map_id (the file's name) and value (the whole text)."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("map_id"), F.regexp_replace("value", "\r", "").alias("value"))


def headers(texts: DataFrame) -> DataFrame:
    """Only the four header lines are parsed."""
    field = lambda name, kind: F.regexp_extract("value", rf"(?m)^{name}\s+(\S+)", 1).cast(kind)
    return texts.select("map_id", field("type", "string").alias("type"), field("height", "int").alias("h"), field("width", "int").alias("w"))


def cells_of(texts: DataFrame) -> DataFrame:
    """Every row is parsed, the last also without a line end; cells that a short row lacks are walls."""
    header = texts.join(headers(texts), "map_id")
    body = header.select("map_id", "w", "h", F.slice(F.split("value", "\n"), 5, 1 << 30).alias("rows"))
    rows = body.select("map_id", "w", "h", F.posexplode("rows").alias("y", "line")).where(F.col("y") < F.col("h"))
    xs = rows.select("map_id", "y", "line", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
    return xs.select("map_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), G.is_wall(F.substr("line", F.col("x") + 1, F.lit(1))).alias("wall"))


def tile_cells(cells: DataFrame, size: int, cx: int, cy: int, padded: bool = False) -> DataFrame:
    """The cells of one tile; padded: all size x size of them, those outside the map as walls. Written with
    partitionBy("cx", "cy"), only that tile's files are read."""
    own = cells.where((G.tile_of("x", size) == cx) & (G.tile_of("y", size) == cy)) if "cx" not in cells.columns else cells.where((F.col("cx") == cx) & (F.col("cy") == cy))
    if not padded:
        return own
    ids = own.select("map_id").distinct()
    full = ids.select("map_id", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("id")).select("map_id", (F.col("id") % size + cx * size).cast("long").alias("x"), (F.expr(f"id div {size}") + cy * size).cast("long").alias("y"))
    return full.join(own, ["map_id", "x", "y"], "left").select("map_id", "x", "y", F.coalesce("wall", F.lit(True)).alias("wall"))


def grid_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square grid over the events, in the order of their ids; errors are walls."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    width = int(events.count() ** 0.5)
    x, y = G.index_cell("event_id", width)
    return events.where(F.col("event_id") < width * width).select(F.lit("events").alias("map_id"), x.alias("x"), y.alias("y"), (F.col("event_type") == "error").alias("wall"))


def grid_from_parts(spark: SparkSession, sf_dir: str, width: int = 50) -> DataFrame:
    """A grid of the given width over the parts; small sizes are walls."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    x, y = G.index_cell("p_partkey", width)
    return parts.select(F.lit("parts").alias("map_id"), x.alias("x"), y.alias("y"), (F.col("p_size") <= 10).alias("wall"))


def maze_lines(width: int, height: int, seed: int) -> list[str]:
    """A maze with one way between any two cells of the odd lattice, and a monotone way carved from the first to the
    last; even sizes are made odd. Equal seeds give equal mazes."""
    width, height, rng = width | 1, height | 1, random.Random(seed)
    rows = [["@"] * width for _ in range(height)]
    rows[1][1], stack = ".", [(1, 1)]
    while stack:
        x, y = stack[-1]
        ways = [(dx, dy) for dx, dy, _ in G.STEPS if 0 < x + 2 * dx < width - 1 and 0 < y + 2 * dy < height - 1 and rows[y + 2 * dy][x + 2 * dx] == "@"]
        if not ways:
            stack.pop()
            continue
        dx, dy = rng.choice(ways)
        rows[y + dy][x + dx] = rows[y + 2 * dy][x + 2 * dx] = "."
        stack.append((x + 2 * dx, y + 2 * dy))
    x = y = 1
    while (x, y) != (width - 2, height - 2):
        if y == height - 2 or x < width - 2 and rng.random() < 0.5:
            x += 1
        else:
            y += 1
        rows[y][x] = "."
    return ["".join(r) for r in rows]


def map_text(lines: list[str], kind: str = "octile") -> str:
    return "\n".join([f"type {kind}", f"height {len(lines)}", f"width {len(lines[0])}", "map", *lines]) + "\n"


def cells_from_lines(spark: SparkSession, lines: list[str], map_id: str = "map") -> DataFrame:
    """Small maps, as in tests and examples."""
    texts = spark.createDataFrame([(map_id, map_text(lines))], "map_id string, value string")
    return cells_of(texts)


def cells_to_text(cells: DataFrame, kind: str = "octile") -> DataFrame:
    """map_id, value: the text that cells_of reads; for spark's text sink."""
    rows = cells.groupBy("map_id", "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", F.when(F.col("wall"), "@").otherwise(".").alias("ch")))), lambda s: s["ch"]), "").alias("line"))
    maps = rows.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("y", "line"))).alias("rows"))
    lines = F.transform("rows", lambda r: r["line"])
    head = F.concat(F.lit(f"type {kind}\nheight "), F.size("rows"), F.lit("\nwidth "), F.length(F.element_at("rows", 1)["line"]), F.lit("\nmap\n"))
    return maps.select("map_id", F.concat(head, F.array_join(lines, "\n"), F.lit("\n")).alias("value"))
