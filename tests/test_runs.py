"""Run records, dispatch and streams on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from gridloom.operators import dispatch, runs as R
from gridloom.sources import maps, runs as S
from gridloom.streaming import tasks as stream
from tests.test_grids import FIXTURES


def test_benchmark_json(spark, tmp_path):
    data = {
        "metadata": {"timestamp": "t", "cluster_sizes": [50], "workers_sizes": [2], "runs_per_size": 2, "algorithms": ["a", "tiled"]},
        "data": [
            {"cluster_size": 50, "workers_size": 2, "algorithm": "a", "run": 1, "timings": {"found_overall_path": 0.5, "path_length": 10.0}},
            {"cluster_size": 50, "algorithm": "tiled", "run": 1, "timings": {"inter_edges": 1.0, "preprocessed": 2.0, "finish_abstract_graph": 0.1, "found_graph_path": 0.2, "found_overall_path": 0.3, "worker_analysis": {"worker_1_cpu_time": 0.5, "worker_2_cpu_time": 0.0, "worker_1_max_memory_mb": 2.5}}},
        ],
    }
    (tmp_path / "x_manhattan.json").write_text(json.dumps(data, indent=1))
    rows = S.read_benchmark(spark, str(tmp_path))
    assert {(r["algorithm"], r["workers_size"]) for r in rows.collect()} == {("a", 2), ("tiled", 1)}
    times = {r["algorithm"]: (round(r["s"], 6), r["p"], r["h"]) for r in rows.select("algorithm", R.search_time().alias("s"), R.preprocess_time().alias("p"), R.heuristic_of_file().alias("h")).collect()}
    assert times == {"a": (0.5, 0.0, "manhattan"), "tiled": (0.6, 3.0, "manhattan")}
    assert {(r["worker"], r["metric"], r["value"]) for r in S.worker_rows(rows).collect()} == {(1, "cpu_time", 0.5), (2, "cpu_time", 0.0), (1, "max_memory_mb", 2.5)}
    stats = R.map_stats(rows.where("algorithm = 'tiled'"), ["algorithm"], "worker_analysis", "cpu_time").first()
    assert (stats["mean"], stats["max"]) == (0.5, 0.5)
    S.write_benchmark(rows, str(tmp_path / "out"))
    back = S.read_benchmark(spark, str(tmp_path / "out"))
    assert back.columns == rows.columns and sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    written = [json.loads(p.read_text()) for p in (tmp_path / "out").rglob("part-*.json")]
    assert written[0]["metadata"] == data["metadata"] | {"workers_sizes": [1, 2], "runs_per_size": 1} and len(written[0]["data"]) == 2


def test_benchmark_documents_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "DOCUMENT_RUNS", 3)
    rows = spark.range(10).select(F.lit("a b.json").alias("file"), F.lit("t").alias("timestamp"), F.lit(50).alias("cluster_size"), F.lit(2).alias("workers_size"), F.lit("a").alias("algorithm"), F.col("id").cast("int").alias("run"), *[F.col("id").cast("double").alias(c) for c in S.TIMINGS], F.lit(None).cast("map<string,double>").alias("worker_analysis"))
    S.write_benchmark(rows, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").rglob("part-*.json"))) == 4
    assert sorted(map(str, S.read_benchmark(spark, str(tmp_path / "out")).collect())) == sorted(map(str, rows.collect()))


def test_logs(spark):
    log = (
        "Find inter edges - 0.5s\nFind intra cluster paths - 4.25s\nFinish abstract graph for search - 0.005s\nFound graph path - 0.001s\nFound overall path - 0.002s\n"
        "Max memory: 3.5 MB\nPath length: 2037\nWorker 1 CPU time: 0.0005s\nWorker  2 CPU time: 0.1s\nWorker 1 Max memory: 2.35 MB\n"
    )
    logs = spark.createDataFrame([(1, log), (2, "nothing")], "id long, value string")
    found = {r["id"]: r for r in S.log_metrics(logs).collect()}
    assert [found[1][c] for c in S.TIMINGS] == [0.5, 4.25, 0.005, 0.001, 0.002, 3.5, 2037.0]
    assert [found[2][c] for c in S.TIMINGS] == [None] * 7
    workers = {(r["worker"], r["cpu_time"], r["max_memory_mb"]) for r in S.log_workers(logs, ["id"]).collect()}
    assert workers == {(1, 0.0005, 2.35), (2, 0.1, None)}


def test_result_files(spark, tmp_path):
    head = "Path Length: 10\nMax Memory: 5\nPath Cost: 10.0\nL1 Nodes: 4\nCPU Time: 0.5\nWorkers: 2\n"
    (tmp_path / "a").write_text(head + "Worker 1 Max Memory: 3\nWorker 2 Max Memory: 4\n\n@@\n")
    (tmp_path / "b").write_text(head + "Worker Max Memory: 9.5 MB\n")
    (tmp_path / "c").write_text("Path Length: 10\n")
    (tmp_path / "d").write_text(head + "@@\nWorker Max Memory: 9\n")
    get = lambda **options: {r["file"]: r["worker_max_memory"] for r in S.read_results(spark, str(tmp_path), **options).collect()}
    assert get() == {"b": 9.5} and get(lines=None) == {"a": 4.0, "b": 9.5, "d": 9.0} and len(get(complete=False)) == 4


def test_idle_streams_give_partial_results(spark, tmp_path):
    rows = [(1, 0, 0), (1, 1, 4), (1, 2, 30), (2, 0, 1), (2, 1, 3), (2, 2, 5)]
    table = spark.createDataFrame(rows, "query_id long, task_id long, s int").select("query_id", "task_id", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("s"))).alias("ts"))
    table.repartition(1).write.parquet(str(tmp_path / "answers"))
    flow = spark.readStream.schema(table.schema).parquet(str(tmp_path / "answers"))
    found = stream.run_available(stream.gathered_until_idle(flow, 3), "complete").collect()
    assert sorted((r["query_id"], r["received"], r["complete"]) for r in found) == [(1, 1, False), (1, 2, False), (2, 3, True)]


def test_small_helpers(spark):
    table = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 4.0), ("b", 2, 0.0), ("b", 2, None)], "algorithm string, workers_size int, metric double")
    assert {r["algorithm"]: r["std"] for r in R.mean_std(table, ["algorithm"], "metric").collect()} == {"a": pytest.approx(2**0.5), "b": 0.0}
    assert R.without_zero(table, "metric").count() == 2
    assert [r["algorithm"] for r in R.nonzero_groups(table, ["algorithm"], "metric").collect()] == ["a"]
    assert R.columns_with(R.renamed(table, {"metric": "cpu_time"}), "cpu") == ["cpu_time"]
    assert R.tagged({"x": table, "y": table}, "map").groupBy("map").count().count() == 2
    assert [r[0] for r in R.sorted_unique(table, "workers_size").collect()] == [1, 2]
    assert [r["metric"] for r in R.head(table.dropna(), ["metric"], 2).collect()] == [0.0, 2.0]
    assert R.sweep(spark, [25, 50], [1, 2], 3).count() == 12


def test_a_tile_that_is_entered_twice(spark):
    rows, size, start, goal = FIXTURES["tile_reentry"][:4]
    from gridloom.plans import paths
    from tests.test_grids import query

    cells = maps.cells_from_lines(spark, rows, "events")
    points = paths.path_rows(paths.find_paths(cells, query(spark, start, goal, "events"), size, "exact")).drop("map_id")
    segments = dispatch.segments(points, size)
    assert [(r["cx"], r["cy"]) for r in segments.orderBy("seg_idx").collect()] == [(0, 0), (1, 0), (0, 0), (0, 1), (1, 1)]
    assert dispatch.merged_segments(points, size).count() == 4
    tiles = spark.createDataFrame([(0, 0), (1, 0), (0, 1), (1, 1)], "cx long, cy long")
    assigned = dispatch.assignment(tiles, 2, 2)
    assert {r["p"] for r in dispatch.located(assigned, 2).withColumn("at", F.spark_partition_id()).groupBy("worker_id").agg(F.count_distinct("at").alias("p")).collect()} == {1}
    answers = dispatch.responses(cells, dispatch.tasks(segments), assigned, size)
    assert {r["status_code"] for r in answers.collect()} == {dispatch.OK}
    whole = dispatch.gathered(answers).first()
    assert whole["success"] and tuple(whole["path"][0]) == start and tuple(whole["path"][-1]) == goal
    fewer = dispatch.responses(cells, dispatch.tasks(segments), assigned.where("worker_id = 0"), size)
    assert {r["status_code"] for r in fewer.collect()} == {dispatch.OK, dispatch.NOT_ASSIGNED}
    assert not dispatch.gathered(fewer).first()["success"]
    probed = dispatch.probed(answers.select("task_id", "worker_id")).collect()
    assert all(r["cpu_time"] >= 0 and r["max_memory"] > 0 for r in probed)


def test_streams_equal_batches(spark, tmp_path):
    events = spark.range(300).select(F.col("id").alias("event_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=(F.col("id") % 50).cast("int"))).alias("ts"))
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    read = spark.read.parquet(str(tmp_path / "events.parquet"))
    flow = stream.task_stream(spark, str(tmp_path / "events.parquet"), read.schema, 17, 5, files_a_trigger=1)
    assigned = dispatch.assignment(spark.range(16).select((F.col("id") % 4).alias("cx"), F.expr("id div 4").alias("cy")), 4, 3).where("worker_id < 2")
    batch = stream.dispatched(stream.tasks_of(read, 17, 5), assigned)
    got = stream.run_available(stream.dispatched(flow, assigned))
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0 and got.count() == 289
    load = stream.run_available(stream.worker_load(stream.dispatched(flow, assigned)), "complete")
    assert load.agg(F.sum("tasks")).first()[0] == 289
