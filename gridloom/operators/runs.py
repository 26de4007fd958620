"""Analytics over runs. A run has keys (such as algorithm, workers_size) and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search_time() -> Column:
    """What a query takes once maps are preprocessed."""
    parts = [F.coalesce(c, F.lit(0.0)) for c in ("finish_abstract_graph", "found_graph_path", "found_overall_path")]
    return F.when(F.col("algorithm") == "a", F.coalesce("found_overall_path", F.lit(0.0))).otherwise(parts[0] + parts[1] + parts[2])


def preprocess_time() -> Column:
    return F.coalesce("preprocessed", F.lit(0.0)) + F.coalesce("inter_edges", F.lit(0.0))


def tagged(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    """Union of tables, each with its name in the column `tag`."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(name)) for name, df in frames.items()])


def heuristic_of_file(name: str = "file") -> Column:
    return F.regexp_extract(name, r"_(manhattan|chebyshev|euclidean)", 1)


def means(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return runs.groupBy(*keys).agg(*[F.avg(m).alias(f"{m}_mean") for m in metrics], F.count(F.lit(1)).alias("runs"))


def means_with_total(runs: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """The means by key and, with a null key, of all."""
    return runs.rollup(key).agg(*[F.avg(m).alias(f"{m}_mean") for m in metrics])


def mean_std(runs: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Sample standard deviation; 0 for a single run."""
    return runs.groupBy(*keys).agg(F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"))


def bands(runs: DataFrame, keys: list[str], metric: str, kind: str = "sd") -> DataFrame:
    """mean, low, high: one standard deviation, or the normal 95% interval of the mean ('ci')."""
    made = runs.groupBy(*keys).agg(F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"), F.count(metric).alias("n"))
    wide = F.col("std") if kind == "sd" else F.col("std") * 1.96 / F.sqrt("n")
    return made.select(*keys, "mean", (F.col("mean") - wide).alias("low"), (F.col("mean") + wide).alias("high"))


def pivoted(runs: DataFrame, index: str, columns: str, metric: str, values: list[str]) -> DataFrame:
    return runs.groupBy(index).pivot(columns, values).agg(F.avg(metric))


def percent_difference(runs: DataFrame, index: str, columns: str, metric: str, base: str, other: str) -> DataFrame:
    """index, base, other, pct = (other - base) / base * 100."""
    wide = pivoted(runs, index, columns, metric, [base, other])
    return wide.select(index, F.col(base).alias("base"), F.col(other).alias("other"), F.when(F.col(base) != 0, (F.col(other) - F.col(base)) / F.col(base) * 100).alias("pct"))


def melted(runs: DataFrame, ids: list[str], metrics: list[str], names: dict[str, str] | None = None) -> DataFrame:
    """ids, metric, value; names gives labels for metrics."""
    long = runs.unpivot(ids, metrics, "metric", "value")
    if names:
        table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        long = long.withColumn("metric", F.coalesce(F.try_element_at(table, F.col("metric")), "metric"))
    return long


def without_zero(runs: DataFrame, metric: str) -> DataFrame:
    return runs.where(F.col(metric) != 0).dropna(subset=[metric])


def nonzero_groups(runs: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Groups whose metric isn't 0 throughout, with the sum and a lower bound of 1e-6 for logarithmic axes."""
    return runs.groupBy(*keys).agg(F.sum(metric).alias("total"), F.avg(metric).alias("mean")).where("total <> 0").withColumn("clipped", F.greatest("mean", F.lit(1e-6)))


def map_stats(runs: DataFrame, keys: list[str], column: str, suffix: str) -> DataFrame:
    """Mean and maximum of a map's values whose keys end in `suffix`, zeros left out."""
    kept = F.map_values(F.map_filter(column, lambda k, v: k.endswith(suffix) & (v != 0)))
    total = F.aggregate(kept, F.lit(0.0), lambda a, v: a + v)
    return runs.select(*keys, F.when(F.size(kept) > 0, total / F.size(kept)).alias("mean"), F.array_max(kept).alias("max"))


def labelled(runs: DataFrame, columns: list[str], out: str = "label", sep: str = "-") -> DataFrame:
    return runs.withColumn(out, F.concat_ws(sep, *[F.col(c).cast("string") for c in columns]))


def only(runs: DataFrame, column: str, values: list) -> DataFrame:
    return runs.where(F.col(column).isin(values))


def renamed(runs: DataFrame, names: dict[str, str]) -> DataFrame:
    return runs.withColumnsRenamed(names)


def columns_with(runs: DataFrame, part: str) -> list[str]:
    return [c for c in runs.columns if part in c]


def sorted_unique(runs: DataFrame, column: str) -> DataFrame:
    """The column's distinct values, in order."""
    return runs.select(column).distinct().orderBy(column)


def head(runs: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first rows in an order: a top-n, for which no task holds more than n rows."""
    return runs.orderBy(*order).limit(n)


def sweep(spark, cluster_sizes: list[int], workers: list[int], runs_per_size: int) -> DataFrame:
    """All configurations of a benchmark, as nested sequences: cluster_size, workers_size, run from 1."""
    one = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in cluster_sizes])).alias("cluster_size"))
    two = one.select("cluster_size", F.explode(F.array(*[F.lit(w) for w in workers])).alias("workers_size"))
    return two.select("cluster_size", "workers_size", F.explode(F.sequence(F.lit(1), F.lit(runs_per_size))).alias("run"))
