"""Maps and paths as text: @ wall, space open, o visited, ~ node, * path; what comes later in this list covers the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rendered_rows(cells: DataFrame, path: DataFrame | None = None, nodes: DataFrame | None = None, visited: DataFrame | None = None) -> DataFrame:
    """map_id, y, line. Layers are tables of map_id, x, y; each is joined at most once for each cell."""
    layers = cells
    chars = []
    for name, ch, points in (("path", "*", path), ("node", "~", nodes), ("seen", "o", visited)):
        if points is not None:
            layers = layers.join(points.select("map_id", "x", "y").distinct().withColumn(name, F.lit(ch)), ["map_id", "x", "y"], "left")
            chars.append(F.col(name))
    ch = F.coalesce(*chars, F.when(F.col("wall"), "@").otherwise(" "))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("x"), ch.alias("ch"))))
    return layers.groupBy("map_id", "y").agg(F.array_join(F.transform(ordered, lambda s: s["ch"]), "").alias("line"))


def tile_rows(cells: DataFrame, size: int, cx: int, cy: int, path: DataFrame | None = None) -> DataFrame:
    own = cells.where((F.expr(f"x div {size}") == cx) & (F.expr(f"y div {size}") == cy))
    return rendered_rows(own, path)


def parse_rendered(rows: DataFrame) -> DataFrame:
    """map_id, x, y, wall, mark of rendered rows."""
    at = rows.select("map_id", "y", F.posexplode(F.split("line", "")).alias("x", "ch")).where("ch <> ''")
    return at.select("map_id", F.col("x").cast("long").alias("x"), "y", (F.col("ch") == "@").alias("wall"), F.when(F.col("ch").isin("o", "~", "*"), F.col("ch")).alias("mark"))


def result_text(metrics: DataFrame, rows: DataFrame) -> DataFrame:
    """map_id, value: 'Key: value' lines of metrics (map_id, path_length, max_memory, path_cost, visited_pct, nodes,
    cpu_time, workers), an empty line and the picture."""
    lines = [("Path Length", "path_length"), ("Max Memory", "max_memory"), ("Path Cost", "path_cost"), ("Visited", "visited_pct"), ("L1 Nodes", "nodes"), ("CPU Time", "cpu_time"), ("Workers", "workers")]
    head = F.concat_ws("\n", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{k}: "), F.col(c).cast("string"))) for k, c in lines])
    art = rows.groupBy("map_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "line"))), lambda r: r["line"]), "\n").alias("art"))
    return metrics.join(art, "map_id").select("map_id", F.concat(head, F.lit("\n\n"), "art").alias("value"))
