"""A stream of tasks against static tiles. Event time, watermarks and windows go beyond what a task queue needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.plans.checkpoints import shared_folder


def task_stream(spark: SparkSession, path: str, schema, width: int, size: int, files_a_trigger: int = 8) -> DataFrame:
    """Tasks (task_id, ts, x, y, cx, cy) of an events table that grows by files."""
    # A pattern, since a plain path has to be a folder.
    path = f"{path[:-1]}[{path[-1]}]"
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)
    return tasks_of(events, width, size)


def tasks_of(events: DataFrame, width: int, size: int) -> DataFrame:
    x, y = G.index_cell("event_id", width)
    placed = events.where(F.col("event_id") < width * width).select(F.col("event_id").alias("task_id"), F.col("ts").cast("timestamp").alias("ts"), x.alias("x"), y.alias("y"))
    return placed.withColumns({"cx": G.tile_of("x", size), "cy": G.tile_of("y", size)})


def dispatched(tasks: DataFrame, assigned: DataFrame) -> DataFrame:
    """task_id, worker_id, status_code: a stream-static join; a tile without a worker has status 2."""
    owned = tasks.join(assigned.select("cx", "cy", "worker_id"), ["cx", "cy"], "left")
    return owned.select("task_id", "ts", "worker_id", F.when(F.col("worker_id").isNull(), 2).otherwise(0).alias("status_code"))


def once_each(tasks: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Tasks that are sent again within the delay go."""
    return tasks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["task_id"])


def worker_load(answers: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """window_start, worker_id, tasks."""
    grouped = answers.withWatermark("ts", delay).groupBy(F.window("ts", window), "worker_id").agg(F.count(F.lit(1)).alias("tasks"))
    return grouped.select(F.col("window.start").alias("window_start"), "worker_id", "tasks")


def gathered_until_idle(answers: DataFrame, expected: int, idle: str = "5 seconds", delay: str = "1 day") -> DataFrame:
    """query_id, started, received, complete: what came for a query (query_id, task_id, ts) until nothing more came for the
    idle time; then the result stands, whole or in part. What comes after that starts another."""
    came = answers.withWatermark("ts", delay).groupBy(F.session_window("ts", idle).alias("session"), "query_id").agg(F.count(F.lit(1)).alias("received"))
    return came.select("query_id", F.col("session.start").alias("started"), "received", (F.col("received") >= expected).alias("complete"))


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there and gives the rows that it wrote, exactly once, as a table."""
    spark = stream.sparkSession
    folder = shared_folder(spark, "stream")
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    else:

        def write(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out")

        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
