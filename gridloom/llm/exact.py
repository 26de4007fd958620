"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of a fixed number of bytes. Distinct blocks are sorted into integer names, then
adjacent names are paired and the pairs sorted into integer names again, until each document has one name. Two
documents have the same (number of blocks, name) if and only if their normalised texts are equal.

Block texts are shuffled once, to be named. Names travel back to the documents by the block's 64-bit hash; blocks
that share a hash with another block are found and go by their whole content, so the hash decides nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import WS, documents, materialize, utf8, whole_text

BLOCK_BYTES = 2048


def normalised(text_col: str = "text") -> Column:
    """UTF-8 bytes of the text with each run of ASCII white space as one space; null counts as empty."""
    return utf8(F.regexp_replace(whole_text(text_col), WS, " "))


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """A row for each block: uid, id, sha, n (blocks of the text), pos, block, h."""
    # The number of a row is made below the generator: above it, each block would have its own.
    body = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), normalised(text_col).alias("body"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / block_bytes)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("body"), i * block_bytes + 1, F.lit(block_bytes)))
    rows = body.withColumn("n", n).select("uid", "id", F.unhex(F.sha2("body", 256)).alias("sha"), "n", F.posexplode(cut).alias("pos", "block"))
    return rows.withColumn("h", F.xxhash64("block"))


def _named_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """uid, id, sha, n, pos, name."""
    blocks = _blocks(docs, id_col, text_col, block_bytes)
    places = materialize(blocks.select("uid", "id", "sha", "n", "pos", "h"))
    # The distinct blocks of a partition are sorted; a name is the partition's number and the place in it.
    names = blocks.select("h", "block").distinct().sortWithinPartitions("h", "block").select("h", F.monotonically_increasing_id().alias("name"))
    names = materialize(names)
    shared = materialize(names.groupBy("h").count().where("count > 1").select("h"))
    if shared.isEmpty():
        return places.join(names, "h").drop("h")
    # Different blocks with one hash (about one pair in 2^64): named by content, below zero.
    contents = blocks.select("h", "block").join(shared, "h", "left_semi").distinct()
    contents = contents.select("h", "block", (-F.row_number().over(Window.orderBy("h", "block"))).cast("long").alias("name"))
    by_content = blocks.join(contents, ["h", "block"]).select("uid", "id", "sha", "n", "pos", "name")
    alone = places.join(shared, "h", "left_anti").join(names, "h").drop("h")
    return alone.unionByName(by_content)


def name_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: uid, id, sha (of the normalised text), n, name; (n, name) identifies the text."""
    current = materialize(_named_blocks(docs, id_col, text_col, block_bytes))
    done = [current.where("n = 1").drop("pos")]
    longest = current.agg(F.max("n")).first()[0] or 1
    current, width = current.where("n > 1"), 1
    while width < longest:
        width *= 2
        left, right = F.when(F.col("pos") % 2 == 0, F.col("name")), F.when(F.col("pos") % 2 == 1, F.col("name"))
        pairs = current.groupBy("uid", "id", "sha", "n", F.shiftright("pos", 1).alias("pos")).agg(F.max(left).alias("a"), F.max(right).alias("b"))
        pairs = materialize(pairs.withColumns({"alone": F.col("b").isNull(), "b": F.coalesce("b", F.lit(0))}))
        names = materialize(pairs.select("a", "b", "alone").distinct().sortWithinPartitions("a", "b", "alone").withColumn("name", F.monotonically_increasing_id()))
        current = materialize(pairs.join(names, ["a", "b", "alone"]).select("uid", "id", "sha", "n", "pos", "name"))
        done.append(current.where(F.col("n") <= width).drop("pos"))
        current = current.where(F.col("n") > width)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, sha (binary).

    Of equal texts the row with the smallest id stays; null ids come last, and of repeated ids one row stays. Null
    texts count as empty. An empty table gives an empty result. Other columns of docs aren't read.
    """
    named = materialize(name_documents(docs, id_col, text_col, block_bytes))
    best = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("uid"))).alias("best")
    # Written, so that adaptive execution can split a large group's rows in the join.
    groups = materialize(named.groupBy("n", "name").agg(best, F.count(F.lit(1)).alias("group_size")))
    return named.join(groups, ["n", "name"]).select("id", F.col("best.id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), "sha")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that stay, with all their columns; see exact_groups."""
    stays = exact_groups(docs, id_col, text_col, block_bytes).where("kept").select(F.col("id").alias("__gl_id"), F.col("sha").alias("__gl_sha"))
    rows = docs.withColumn("__gl_sha_of", F.unhex(F.sha2(normalised(text_col), 256)))
    rows = rows.join(stays, F.col(id_col).eqNullSafe(F.col("__gl_id")) & (F.col("__gl_sha_of") == F.col("__gl_sha")), "left_semi")
    # Rows that repeat both id and text: the first by raw text stays.
    once = Window.partitionBy(F.col(id_col), F.col("__gl_sha_of")).orderBy(F.col(text_col))
    return rows.withColumn("__gl_row", F.row_number().over(once)).where("__gl_row = 1").drop("__gl_row", "__gl_sha_of")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256
FROM d
"""
