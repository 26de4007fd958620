"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space, as a Java and DuckDB character class.
WS = r"[\x20\x09-\x0D]+"
#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: monotonically_increasing_id() keeps the row index of a partition in its low 33 bits.
_ROW_BITS = 33


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def whole_text(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def utf8(text: Column) -> Column:
    return text.cast("binary")


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4; a null id counts as the empty text."""
    return F.crc32(utf8(F.coalesce(F.col(id_col).cast("string"), F.lit("")))) % 4 == 2


def use_shared_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder named in spark.checkpoint.dir. Only a local session (tests) does without: it gets a
    temporary folder."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridloom-checkpoint-"))


def materialize(df: DataFrame) -> DataFrame:
    """Written once to the shared checkpoint folder, so that lost executors and reuse don't compute it again."""
    use_shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like materialize(), as Parquet, which takes less room for large tables. Goes with the checkpoint folder."""
    use_shared_checkpoints(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_global_order(df: DataFrame, order: Sequence[Column], sums: Sequence[str] = ()) -> DataFrame:
    """Adds `_pos` (0-based place in the order) and, for each column in sums, `_before_<col>` and `_all_<col>`.

    Range partitions are sorted, each partition's totals are summed up, and only those totals (a row for each
    partition) meet in one place. A running number breaks ties, so any hot value spreads over several partitions.
    The range partitions are written once: sampling them anew could cut elsewhere.
    """
    keys = [*order, F.col("_tie")]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    dealt = materialize(dealt.drop("_tie").withColumn("_part", F.shiftright(at, _ROW_BITS)).withColumn("_row", at.bitwiseAND((1 << _ROW_BITS) - 1)))
    parts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_sum_{c}") for c in sums])
    above = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    parts = parts.select(
        "_part",
        F.coalesce(F.sum("_n").over(above), zero).alias("_base"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(above), zero).alias(f"_base_{c}") for c in sums],
        *[F.sum(f"_sum_{c}").over(whole).alias(f"_all_{c}") for c in sums],
    )
    out = dealt
    if sums:
        own = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumns({f"_own_{c}": F.coalesce(F.sum(c).over(own), zero) for c in sums})
    # One row for each shuffle partition: bounded by the session's partition number, not by the data.
    out = out.join(F.broadcast(parts), "_part")
    return out.select(
        *[c for c in dealt.columns if c not in ("_part", "_row")],
        (F.col("_base") + F.col("_row")).alias("_pos"),
        *[(F.col(f"_base_{c}") + F.col(f"_own_{c}")).alias(f"_before_{c}") for c in sums],
        *[f"_all_{c}" for c in sums],
    )

#: Rows go to Python in batches of so many bytes at most, besides Spark's bound on their number.
BATCH_BYTES = 32 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Long texts would make batches of 10,000 rows too large; a smaller bound that is already set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not str(now).isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
