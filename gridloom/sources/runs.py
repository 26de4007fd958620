"""Run records: benchmark JSON, result files and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TIMINGS = ("inter_edges", "preprocessed", "finish_abstract_graph", "found_graph_path", "found_overall_path", "max_memory", "path_length")
SCHEMA = (
    "metadata struct<timestamp:string, cluster_sizes:array<int>, workers_sizes:array<int>, runs_per_size:int, algorithms:array<string>>, "
    "data array<struct<cluster_size:int, workers_size:int, algorithm:string, run:int, timings:struct<"
    + ", ".join(f"{c}:double" for c in TIMINGS)
    + ", worker_analysis:map<string,double>>>>"
)

#: What logs and result files say, as patterns: fixed values.
LOG_PATTERNS = {
    "inter_edges": r"Find inter edges - ([\d.]+)s",
    "preprocessed": r"Find intra cluster paths - ([\d.]+)s",
    "finish_abstract_graph": r"Finish abstract graph for search - ([\d.]+)s",
    "found_graph_path": r"Found graph path - ([\d.]+)s",
    "found_overall_path": r"Found overall path - ([\d.]+)s",
    "max_memory": r"Max memory: ([\d.]+) MB",
    "path_length": r"Path length: ([\d.]+)",
}
WORKER_CPU = r"Worker\s+(\d+)\s+CPU\s+time:\s+([\d.]+)s"
WORKER_MEMORY = r"Worker\s+(\d+)\s+Max\s+memory:\s+([\d.]+) \s*MB"
RESULT_KEYS = {"path_length": "Path Length", "max_memory": "Max Memory", "path_cost": "Path Cost", "nodes": "L1 Nodes", "cpu_time": "CPU Time", "workers": "Workers", "worker_max_memory": "Worker Max Memory"}
#: A document of benchmark JSON holds so many runs at most when it is written.
DOCUMENT_RUNS = 10_000


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """One row for each run: file, timestamp, cluster_size, workers_size (1 if missing), algorithm, run, timings, worker_analysis."""
    raw = spark.read.schema(SCHEMA).json(path, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    name = F.input_file_name()
    file = F.coalesce(F.nullif(F.url_decode(F.regexp_extract(name, "/file=([^/]*)/", 1)), F.lit("")), F.element_at(F.split(name, "/"), -1))
    rows = raw.select(file.alias("file"), F.col("metadata.timestamp").alias("timestamp"), F.explode("data").alias("d"))
    return rows.select("file", "timestamp", "d.cluster_size", F.coalesce("d.workers_size", F.lit(1)).alias("workers_size"), "d.algorithm", "d.run", *[F.col(f"d.timings.{c}").alias(c) for c in TIMINGS], F.col("d.timings.worker_analysis").alias("worker_analysis"))


def write_benchmark(runs: DataFrame, path: str) -> None:
    """What read_benchmark() gives, as the documents that it reads: a folder for each file's name, and in it a document for
    every DOCUMENT_RUNS runs, each with metadata on its own runs. Metrics that are null are left out."""
    runs = runs.withColumn("document", F.expr(f"(row_number() OVER (PARTITION BY file, timestamp ORDER BY cluster_size, workers_size, algorithm, run) - 1) div {DOCUMENT_RUNS}"))
    timings = F.struct(*TIMINGS, "worker_analysis")
    point = F.struct("cluster_size", "workers_size", "algorithm", "run", timings.alias("timings"))
    several = lambda c: F.array_sort(F.collect_set(c)).alias(f"{c}s")
    metadata = [F.array_sort(F.collect_set("cluster_size")).alias("cluster_sizes"), several("workers_size").alias("workers_sizes"), F.max("run").alias("runs_per_size"), several("algorithm")]
    made = runs.groupBy("file", "timestamp", "document").agg(*metadata, F.collect_list(point).alias("data"))
    made = made.select("file", "document", F.struct("timestamp", "cluster_sizes", "workers_sizes", "runs_per_size", "algorithms").alias("metadata"), "data")
    # A document is a file: rows that share a folder are told apart by their place.
    made = made.withColumn("at", F.row_number().over(Window.partitionBy("file").orderBy("document", "metadata.timestamp")))
    made.drop("document").write.mode("overwrite").partitionBy("file", "at").json(path)


def worker_rows(runs: DataFrame) -> DataFrame:
    """file, algorithm, cluster_size, workers_size, run, worker, metric, value of worker_analysis."""
    flat = runs.select("file", "algorithm", "cluster_size", "workers_size", "run", F.explode("worker_analysis").alias("key", "value"))
    return flat.select("file", "algorithm", "cluster_size", "workers_size", "run", F.regexp_extract("key", r"worker_(\d+)_", 1).cast("int").alias("worker"), F.regexp_extract("key", r"worker_\d+_(.*)", 1).alias("metric"), "value")


def _number(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found.cast("double"))


def log_metrics(logs: DataFrame, text: str = "value") -> DataFrame:
    """logs with a column for each pattern: its first match, or null."""
    return logs.withColumns({k: _number(F.col(text), p) for k, p in LOG_PATTERNS.items()})


def log_workers(logs: DataFrame, key: list[str], text: str = "value") -> DataFrame:
    """key, worker, cpu_time, max_memory_mb: all matches, paired in order."""
    take = lambda p, g: F.regexp_extract_all(F.col(text), F.lit(p), F.lit(g))
    cpu = logs.select(*key, F.inline(F.arrays_zip(take(WORKER_CPU, 1).alias("worker"), take(WORKER_CPU, 2).alias("cpu_time"))))
    mem = logs.select(*key, F.inline(F.arrays_zip(take(WORKER_MEMORY, 1).alias("worker"), take(WORKER_MEMORY, 2).alias("max_memory_mb"))))
    both = cpu.join(mem, [*key, "worker"], "full")
    return both.select(*key, F.col("worker").cast("int").alias("worker"), F.col("cpu_time").cast("double").alias("cpu_time"), F.col("max_memory_mb").cast("double").alias("max_memory_mb"))


def result_metrics(texts: DataFrame, complete: bool = True, lines: int | None = 7) -> DataFrame:
    """file and the metrics of result files (file, value): 'Key: value' among the first lines. complete: only files with
    all keys. lines=None: among all lines, and the largest memory of numbered workers counts too."""
    head = F.col("value") if lines is None else F.substring_index("value", "\n", lines)
    out = texts.select("file", head.alias("value"))
    worker = r"Worker(?: \d+)? Max Memory" if lines is None else RESULT_KEYS["worker_max_memory"]
    plain = [_number(F.col("value"), rf"(?m)^\s*{k}:\s*([\d.]+)").alias(c) for c, k in RESULT_KEYS.items() if c != "worker_max_memory"]
    largest = F.array_max(F.transform(F.regexp_extract_all("value", F.lit(rf"(?m)^\s*{worker}:\s*([\d.]+)"), F.lit(1)), lambda x: x.cast("double")))
    out = out.select("file", *plain, largest.alias("worker_max_memory"))
    return out.dropna() if complete else out


def read_results(spark: SparkSession, path: str, complete: bool = True, lines: int | None = 7) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    return result_metrics(raw, complete, lines)
