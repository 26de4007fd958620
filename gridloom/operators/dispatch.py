"""Distribution of tiles and tasks over workers, as tables."""

from __future__ import annotations

import resource
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import geometry as G
from gridloom.operators import local

#: Status of a response: fixed values.
OK, NO_PATH, NOT_ASSIGNED = 0, 1, 2


def assignment(tiles: DataFrame, tiles_w: int, workers: int) -> DataFrame:
    """cluster_idx (row order), cx, cy, worker_id: dealt out in turn."""
    index = F.col("cx") + F.col("cy") * tiles_w
    return tiles.select(index.alias("cluster_idx"), "cx", "cy", F.pmod(index, F.lit(workers)).alias("worker_id"))


def located(assigned: DataFrame, workers: int) -> DataFrame:
    """Each worker's tiles in the partition of its number."""
    return assigned.repartitionById(workers, F.col("worker_id").cast("int"))


def clusters_per_worker(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("worker_id").agg(F.count(F.lit(1)).alias("clusters"))


def cluster_lists(assigned: DataFrame) -> DataFrame:
    """worker_id, clusters: 'cx:cy' of each tile in row order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("cluster_idx", "cx", "cy"))), lambda s: F.concat_ws(":", s["cx"], s["cy"]))
    return assigned.groupBy("worker_id").agg(F.array_join(listed, ",").alias("clusters"))


def segments(waypoints: DataFrame, size: int) -> DataFrame:
    """One row for each stay in a tile: query_id, seg_idx, cx, cy, sx, sy, gx, gy of rows (query_id, seq, x, y)."""
    own = Window.partitionBy("query_id").orderBy("seq")
    tiled = waypoints.withColumns({"cx": G.tile_of("x", size), "cy": G.tile_of("y", size)})
    moved = F.coalesce(((F.lag("cx").over(own) != F.col("cx")) | (F.lag("cy").over(own) != F.col("cy"))).cast("long"), F.lit(0))
    tiled = tiled.withColumn("_moved", moved).withColumn("seg_idx", F.sum("_moved").over(own))
    return _first_last(tiled, "seg_idx")


def merged_segments(waypoints: DataFrame, size: int) -> DataFrame:
    """One row for each tile, however often it is entered, in the order of first entry: first and last waypoint."""
    tiled = waypoints.withColumns({"cx": G.tile_of("x", size), "cy": G.tile_of("y", size)})
    found = tiled.groupBy("query_id", "cx", "cy").agg(F.min("seq").alias("_at"), F.min_by(F.struct("x", "y"), "seq").alias("s"), F.max_by(F.struct("x", "y"), "seq").alias("g"))
    order = Window.partitionBy("query_id").orderBy("_at")
    return found.select("query_id", (F.row_number().over(order) - 1).cast("long").alias("seg_idx"), "cx", "cy", F.col("s.x").alias("sx"), F.col("s.y").alias("sy"), F.col("g.x").alias("gx"), F.col("g.y").alias("gy"))


def _first_last(tiled: DataFrame, seg: str) -> DataFrame:
    found = tiled.groupBy("query_id", seg, "cx", "cy").agg(F.min_by(F.struct("x", "y"), "seq").alias("s"), F.max_by(F.struct("x", "y"), "seq").alias("g"))
    return found.select("query_id", seg, "cx", "cy", F.col("s.x").alias("sx"), F.col("s.y").alias("sy"), F.col("g.x").alias("gx"), F.col("g.y").alias("gy"))


def tasks(segs: DataFrame) -> DataFrame:
    """task_id from 0 in each query, in path order."""
    order = Window.partitionBy("query_id").orderBy("seg_idx")
    return segs.withColumn("task_id", (F.row_number().over(order) - 1).cast("long")).select("query_id", "task_id", "cx", "cy", "sx", "sy", "gx", "gy")


def responses(cells: DataFrame, todo: DataFrame, assigned: DataFrame, size: int) -> DataFrame:
    """query_id, task_id, worker_id, status_code, cost, path: a task of a tile that no worker has gets status 2 and no
    worker; one without a path status 1."""
    owned = todo.join(assigned.select("cx", "cy", "worker_id"), ["cx", "cy"], "left")
    run = local.tile_tasks(cells, owned.where("worker_id IS NOT NULL").select(F.lit("events").alias("map_id"), "query_id", "task_id", "cx", "cy", "sx", "sy", "gx", "gy"), size)
    run = run.select("query_id", "task_id", "cost", "path")
    out = owned.join(run, ["query_id", "task_id"], "left")
    status = F.when(F.col("worker_id").isNull(), NOT_ASSIGNED).when(F.col("cost").isNull(), NO_PATH).otherwise(OK)
    return out.select("query_id", "task_id", "worker_id", status.alias("status_code"), "cost", "path")


def gathered(answers: DataFrame) -> DataFrame:
    """query_id, success, path: the pieces in task order; success only if all tasks were answered."""
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("task_id", "path"))), lambda s: s["path"])
    whole = answers.groupBy("query_id").agg(F.max("status_code").alias("worst"), F.flatten(pieces).alias("path"))
    return whole.select("query_id", (F.col("worst") == OK).alias("success"), F.when(F.col("worst") == OK, F.col("path")).alias("path"))


def worker_metrics(answers: DataFrame) -> DataFrame:
    """worker_id, tasks, cpu_time (sum), max_memory."""
    return answers.groupBy("worker_id").agg(F.count(F.lit(1)).alias("tasks"), F.sum("cpu_time").alias("cpu_time"), F.max("max_memory").alias("max_memory"))


def probed(df: DataFrame) -> DataFrame:
    """df with cpu_time (seconds that this process took for the batch) and max_memory (bytes, its peak so far)."""

    def run(batches):
        began = time.process_time()
        for frame in batches:
            now = time.process_time()
            yield frame.assign(cpu_time=now - began, max_memory=resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024)
            began = now

    from pyspark.sql import types as T

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("cpu_time", T.DoubleType()), T.StructField("max_memory", T.LongType())]))


