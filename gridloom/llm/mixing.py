"""Mixing sources to target weights with packed blocks. DataFrame functions only.

The words of each source, document after document, are packed into blocks of a fixed length. A source's target gives its
number of slots. All slots of all sources are numbered, and a pseudorandom permutation of the numbers deals them to
places in output shards: how many slots of each source a shard has is a multinomial draw, given the sources' totals. A
source's slots run through a pseudorandom permutation of its block numbers, again and again, and slots and blocks are
joined by number.

Permutations are swap-or-not shuffles: in each round a number x and its mate k - x (modulo the size) change places or
don't, by a hash of the larger. They work for any size, need no table and no sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import WS, documents, in_global_order, materialize, whole_text

BLOCK_WORDS = 64
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SLOTS_A_SHARD = 4096
SEED = 42
#: Rounds of a permutation: a number has 2^16 places that it can come to, by bits of its own.
ROUNDS = 16
#: Tables with a row for each source are broadcast up to this many rows; beyond, a sort-merge join takes them.
SMALL_ROWS = 20_000
_CHUNK = 65_536


@dataclass(frozen=True)
class Mix:
    """rows: _pos, id, th, size, sidx, offset. sources: sidx, source, source_size, weight, target, n_blocks, quota.
    slots: shard, place, sidx, q, block (a place in an output shard, the source's slot there and the block that fills it)."""

    rows: DataFrame
    sources: DataFrame
    slots: DataFrame
    block_words: int


def word_count(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(text, WS, " "))
    spaces = F.octet_length(flat) - F.octet_length(F.replace(flat, F.lit(" "), F.lit("")))
    return F.when(flat == "", 0).otherwise(spaces + 1).cast("long")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def _expand(df: DataFrame, count: str, name: str) -> DataFrame:
    """A row for each number below `count`, in chunks, so that a large count spreads over tasks."""
    chunks = df.where(F.col(count) > 0).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({count} - 1) div {_CHUNK}"))))
    chunks = chunks.repartition(*[F.col(c) for c in chunks.columns])
    last = F.least(F.col(count), (F.col("_chunk") + 1) * _CHUNK) - 1
    return chunks.withColumn(name, F.explode(F.sequence(F.col("_chunk") * _CHUNK, last))).drop("_chunk")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """From source, source_size: adds sidx, weight and target.

    Sources in code point order, null last, get the weights in turn. Targets share `share` times all sizes by weight;
    those above `cap` times their source's size stop there and the excess is shared again. In the order of cap by
    weight, a source is capped if it is below the level that remains once all before it are capped.
    """
    ranked = in_global_order(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()]).withColumnRenamed("_pos", "sidx")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sidx") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    ranked = in_global_order(ranked, [F.col("most") / F.col("weight"), F.col("sidx")], ["most", "weight", "source_size"])
    level = (F.col("_all_source_size") * float(share) - F.col("_before_most")) / (F.col("_all_weight") - F.col("_before_weight"))
    ranked = ranked.withColumn("level", level).withColumn("capped", F.col("most") <= F.col("level") * F.col("weight"))
    free = ranked.agg(F.max(F.when(~F.col("capped"), F.col("level")))).first()[0]
    target = F.when(F.col("capped"), F.col("most")).otherwise(F.lit(free).cast("double") * F.col("weight"))
    return ranked.withColumn("target", target).select("sidx", "source", "source_size", "weight", "target")


def permuted(df: DataFrame, value: Column, size: Column, key: Column, out: str, seed: int = SEED, rounds: int = ROUNDS) -> DataFrame:
    """df with `out`: the place of `value` (0 to size - 1) in a pseudorandom permutation; each key (long) has its own."""
    of = lambda *parts: F.xxhash64(*[p if isinstance(p, Column) else F.lit(p).cast("long") for p in parts])
    df = df.withColumns({out: value, "_size": size, "_key": key})
    for r in range(rounds):
        df = df.withColumn("_mate", F.pmod(F.pmod(of(seed, 0, r, F.col("_key")), F.col("_size")) - F.col(out), F.col("_size")))
        swaps = of(seed, 1, r, F.col("_key"), F.greatest(F.col(out), F.col("_mate"))).bitwiseAND(1) == 1
        df = df.withColumn(out, F.when(swaps, F.col("_mate")).otherwise(F.col(out)))
    return df.drop("_mate", "_size", "_key")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, slots_a_shard: int = SLOTS_A_SHARD, seed: int = SEED) -> Mix:
    """Null and empty texts have no words; a null source is a source of its own, the last. Rows that repeat count
    each. An empty table gives empty tables."""
    text = whole_text(text_col)
    rows = materialize(docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), word_count(text).alias("size")))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    n_blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    # Slots are counted in blocks of the source's mean length: at most `cap` times its blocks.
    quota = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n_blocks") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("n_blocks", n_blocks).withColumn("quota", quota)
    summed = ("source_size", "n_blocks", "quota")
    sources = in_global_order(targets, [F.col("sidx")], summed).drop("_pos", *[f"_all_{c}" for c in summed])
    sources = materialize(sources.withColumnsRenamed({f"_before_{c}": f"{c}_before" for c in summed}))
    small = _small(sources)

    numbered = rows.join(small.select(F.col("source").alias("_source"), "sidx"), F.col("source").eqNullSafe(F.col("_source"))).select("sidx", "id", "th", "size")
    placed = in_global_order(numbered, [F.col("sidx"), F.col("id").asc_nulls_last(), F.col("th")], ["size"])
    placed = placed.join(small.select("sidx", "source_size_before"), "sidx")
    placed = placed.select("_pos", "id", "th", "size", "sidx", (F.col("_before_size") - F.col("source_size_before")).alias("offset"))
    return Mix(placed, sources, _slots(sources, slots_a_shard, seed), block_words)


def _slots(sources: DataFrame, slots_a_shard: int, seed: int) -> DataFrame:
    total = sources.agg(F.sum("quota")).first()[0] or 0
    slots = _expand(sources.select("sidx", "n_blocks", "quota_before", "quota"), "quota", "q")
    slots = permuted(slots, F.col("quota_before") + F.col("q"), F.lit(max(1, total)).cast("long"), F.lit(-1).cast("long"), "_at", seed)
    slots = slots.withColumns({"shard": F.expr(f"_at div {slots_a_shard}"), "place": F.col("_at") % slots_a_shard})
    slots = permuted(slots, F.col("q") % F.col("n_blocks"), F.col("n_blocks"), F.col("sidx"), "block", seed)
    return materialize(slots.select("shard", "place", "sidx", "q", "block"))


def shard_counts(mix: Mix) -> DataFrame:
    """shard, sidx, slots: what each output shard drew of each source."""
    return mix.slots.groupBy("shard", "sidx").agg(F.count(F.lit(1)).alias("slots"))


def segments(mix: Mix) -> DataFrame:
    """The part that each document has in each block, and how often the mix takes the block: a document without
    words has one row with nulls. _pos, id, th, size, sidx, block, start, length, uses."""
    length = mix.block_words
    first, last = F.expr(f"offset div {length}"), F.expr(f"(offset + size - 1) div {length}")
    parts = mix.rows.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    start = F.greatest(F.col("offset"), F.col("block") * length)
    end = F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * length)
    parts = parts.select("_pos", "id", "th", "size", "sidx", "block", (start - F.col("offset")).alias("start"), (end - start).alias("length"))
    uses = mix.slots.groupBy("sidx", "block").agg(F.count(F.lit(1)).alias("uses"))
    # Documents without words are on the kept side of the join with a block that matches none, each with its own.
    return parts.withColumn("block", F.coalesce("block", -1 - F.col("_pos"))).join(uses, ["sidx", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0).cast("long")))


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: id, size, source_size, target, taken; see plan_mix."""
    mix = plan_mix(docs, **options)
    taken = segments(mix).groupBy("_pos", "id", "size", "sidx").agg(F.coalesce(F.sum(F.col("length") * F.col("uses")), F.lit(0)).cast("long").alias("taken"))
    return taken.join(_small(mix.sources.select("sidx", "source_size", "target")), "sidx").select("id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix as documents: for each time round, a row for each run of a document's taken words, all columns kept.

    A document that is taken whole keeps its text as it is; of others, the words taken keep the white space after
    them. n_chars, if there, is the new text's length. Documents without words aren't taken.
    """
    mix = plan_mix(docs, id_col, text_col, **options)
    used = segments(mix).where("uses > 0").withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("uses"))))
    own = Window.partitionBy("_pos", "time").orderBy("block")
    runs = used.withColumn("island", F.col("block") - F.row_number().over(own)).groupBy("_pos", "id", "th", "size", "time", "island").agg(F.min("start").alias("start"), F.sum("length").alias("length"))
    lists = runs.groupBy("_pos", "id", "th", "size").agg(F.array_sort(F.collect_list(F.struct("time", "start", "length"))).alias("runs"))
    # Rows that repeat both id and text take the lists in turn.
    lists = lists.groupBy("id", "th").agg(F.min("size").alias("__gl_size"), F.array_sort(F.collect_list(F.struct("_pos", "runs"))).alias("__gl_lists")).withColumnsRenamed({"id": "__gl_id", "th": "__gl_th"})
    rows = docs.withColumn("__gl_of", F.xxhash64(whole_text(text_col))).join(lists, F.col(id_col).eqNullSafe(F.col("__gl_id")) & (F.col("__gl_of") == F.col("__gl_th")))
    turn = F.row_number().over(Window.partitionBy("__gl_id", "__gl_th").orderBy("__gl_id"))
    rows = rows.withColumn("__gl_turn", turn).where(F.col("__gl_turn") <= F.size("__gl_lists"))
    # A text is cut into words once: the generator keeps its array from being put into the function for each run.
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    rows = rows.withColumn("__gl_runs", F.element_at("__gl_lists", F.col("__gl_turn"))["runs"]).drop("__gl_lists")
    rows = rows.withColumn("__gl_words", F.explode(F.array(words)))
    part = lambda run: F.array_join(F.slice("__gl_words", (run["start"] + 1).cast("int"), run["length"].cast("int")), "")
    parts = F.transform("__gl_runs", lambda run: F.when(run["length"] == F.col("__gl_size"), F.col(text_col)).otherwise(part(run)))
    rows = rows.withColumn("__gl_part", F.explode(parts)).withColumn(text_col, F.col("__gl_part"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
