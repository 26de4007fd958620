"""Contiguous shards of nearly equal bytes, by global prefix sums. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import documents, in_global_order, utf8, whole_text

SHARDS = 40
ROW_BYTES = 16


def shard_by_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """One row for each row of docs: id, size, text_crc32, shard, slot.

    Rows are taken in the order of their ids (null ids last; repeated ids by size, checksum and then arrival). A row's
    size is its text's UTF-8 bytes (null: none) plus row_bytes. The total is cut at equal targets: a row goes to the
    shard in which the middle of its bytes lies, so that a shard is off its target by one row's size at most. Slots
    count from 0 in each shard. Fewer rows than shards leave some shards empty; an empty table gives no rows.
    """
    body = utf8(whole_text(text_col))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(body) + row_bytes).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    placed = in_global_order(rows, [F.col("id").asc_nulls_last(), F.col("size"), F.col("text_crc32")], ["size"])
    # The middle of the row's bytes, doubled to stay an integer.
    shard = F.expr(f"(2 * _before_size + size) * {shards} div greatest(2 * _all_size, 1)")
    placed = placed.withColumn("shard", F.least(shard, F.lit(shards - 1)).cast("int"))
    first = placed.groupBy("shard").agg(F.min("_pos").alias("_first"))
    # `first` has a row for each shard.
    return placed.join(F.broadcast(first), "shard").select("id", "size", "text_crc32", "shard", (F.col("_pos") - F.col("_first")).alias("slot"))


def op3_prefix_shards(spark, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(documents(spark, sf_dir))
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
