"""Near-duplicates by SimHash, linked through a Gray-order hierarchical index.

Distinct fingerprints are dealt into buckets by equal blocks of bits: of any two within the bound, one more block than
bits that may differ is equal in one. Each bucket is indexed: sorted by Gray rank, runs of neighbours share a node that
holds the bits they have in common and that the node above doesn't hold; a search adds up differences from the top
and leaves a whole node once they exceed the bound. Hot buckets are dealt again by the remaining bits, and what is
still hot is searched in pairs of chunks, so no task holds more than two chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.llm.common import bounded_batches, documents, materialize, whole_text
from gridloom.llm.graph import components, joined
from gridloom.llm.words import mixed

WORDS = 4
SEED = 42
BITS = 64
MAX_DIFFERENT = 4
#: A bucket above so many fingerprints is dealt again.
BUCKET_ROWS = 4096
#: Children of a node of the index.
FAN = 8
#: Pairs of a query and a node that are looked at in one go.
PAIRS = 1 << 21


def fingerprint(text: str | None, words: int = WORDS, prints: int = 1, distinct: bool = False) -> list[int]:
    """Of the text with A-Z in lower case: a bit is 1 if over half of the shingles' hashes have it. No word: zero.

    Of several prints, the first takes the hashes as they are and the others mix them again. distinct: a shingle that
    repeats counts once."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return [0] * prints
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - words + 1)
    first, last = starts[:n].tolist(), ends[min(words, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros((prints, BITS), np.int64)
    every = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, n)
    every = np.unique(every) if distinct else every
    n = len(every)
    for at in range(0, n, 1 << 16):
        hashes = every[at : at + (1 << 16)]
        for k in range(prints):
            hashes = mixed(hashes + np.uint64(k)) if k else hashes
            ones[k] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8").reshape(-1).tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, prints: int = 1, distinct: bool = False) -> DataFrame:
    """One row for each row of docs: id, th (a hash of the text, to find the row again), fp0 and on (64 bits as longs)."""
    names = [f"fp{k}" for k in range(prints)]

    def run(batches):
        for batch in batches:
            made = np.array([fingerprint(x.as_py(), words, prints, distinct) for x in batch["text"]], np.uint64).reshape(-1, prints).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["th"], *[pa.array(np.ascontiguousarray(made[:, k])) for k in range(prints)]], ["id", "th", *names])

    fed = docs.select(F.col(id_col).alias("id"), F.xxhash64(whole_text(text_col)).alias("th"), F.col(text_col).cast("string").alias("text"))
    bounded_batches(docs.sparkSession)
    return fed.mapInArrow(run, T.StructType([fed.schema["id"], *[T.StructField(c, T.LongType()) for c in ("th", *names)]]))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence."""
    rank = codes.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


class GrayIndex:
    """levels, from the top: (pattern, mask) of each node, the mask without the bits of the nodes above; a node's
    children are FAN neighbours of the next level. The last level holds the codes, in Gray order; order has the place that
    each had. A code is a 64-bit word, or a row of several."""

    def __init__(self, codes: np.ndarray):
        codes = codes.reshape(len(codes), -1)
        self.order = np.lexsort(gray_rank(codes).T[::-1])
        self.codes = codes[self.order]
        shared = [(self.codes, ~self.codes)]  # bits that are 1 in all below, and 0 in all below
        while len(shared[-1][0]) > FAN:
            cut = np.arange(0, len(shared[-1][0]), FAN)
            shared.append(tuple(np.bitwise_and.reduceat(x, cut, axis=0) for x in shared[-1]))
        self.levels, above = [], None
        for ones, zeros in reversed(shared):
            held = np.zeros_like(ones) if above is None else above[np.arange(len(ones)) // FAN]
            self.levels.append((ones, (ones | zeros) & ~held))
            above = ones | zeros

    def pairs(self, bound: int):
        """Yields (i, j) arrays, i < j: places of codes that differ in 1 to `bound` bits."""
        size = len(self.codes)
        step = max(1, PAIRS // max(1, size))
        for at in range(0, size, step):
            top = len(self.levels[0][0])
            query = np.repeat(np.arange(at, min(size, at + step)), top)
            node = np.tile(np.arange(top), min(size, at + step) - at)
            differ = np.zeros(len(query), np.uint16)
            for depth, (pattern, mask) in enumerate(self.levels):
                if depth:
                    query, node, differ = np.repeat(query, FAN), (node[:, None] * FAN + np.arange(FAN)).reshape(-1), np.repeat(differ, FAN)
                    there = node < len(pattern)
                    query, node, differ = query[there], node[there], differ[there]
                # Nodes whose codes all come before the query were or will be met the other way round.
                later = (node + 1) * FAN ** (len(self.levels) - 1 - depth) > query
                query, node, differ = query[later], node[later], differ[later]
                for w in range(self.codes.shape[1]):
                    differ = differ + np.bitwise_count((self.codes[query, w] ^ pattern[node, w]) & mask[node, w])
                near = differ <= bound
                query, node, differ = query[near], node[near], differ[near]
            own = node > query
            yield query[own], node[own]


def spanning_links(codes: np.ndarray, bound: int, prints: np.ndarray | None = None, total: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places of the codes that are linked to others of the bucket, each with that of its component's first code.
    With prints (rows of several fingerprints), linked codes differ in `total` bits of them at most."""
    index = GrayIndex(codes)
    labels = np.arange(len(codes))
    for a, b in index.pairs(bound):
        if prints is not None and len(a):
            one, two = prints[index.order[a]], prints[index.order[b]]
            near = np.bitwise_count(one ^ two).sum(axis=1) <= total
            a, b = a[near], b[near]
        labels = joined(labels, a, b)
    moved = np.flatnonzero(labels != np.arange(len(codes)))
    return index.order[moved], index.order[labels[moved]]


def _widths(bits: int, blocks: int) -> list[int]:
    return [bits // blocks + (k < bits % blocks) for k in range(blocks)]


def _block(value: Column, offset: int, width: int) -> Column:
    return F.shiftrightunsigned(value, offset).bitwiseAND((1 << width) - 1)


def _without(value: Column, offset: int, width: int) -> Column:
    """The value with the block cut out."""
    low = value.bitwiseAND((1 << offset) - 1) if offset else F.lit(0).cast("long")
    high = F.shiftleft(F.shiftrightunsigned(value, offset + width), offset) if offset + width < BITS else F.lit(0).cast("long")
    return low.bitwiseOR(high)


def _bucketed(codes: DataFrame, bound: int, bucket_rows: int) -> DataFrame:
    """codes with key, inner, pair: rows that share them are a bucket of at most about two chunks of bucket_rows."""
    own_columns = codes.columns
    fp, plain, again, at = F.col("fp"), [], {}, 0
    widths = _widths(BITS, bound + 1)
    for i, width in enumerate(widths):
        plain.append(F.shiftleft(F.lit(i).cast("long"), max(widths)).bitwiseOR(_block(fp, at, width)))
        rest, subs, low = _without(fp, at, width), [], 0
        inner = _widths(BITS - width, bound + 1)
        for j, w in enumerate(inner):
            subs.append(F.struct(F.lit(j).cast("long").alias("sub"), _block(rest, low, w).alias("part")))
            low += w
        again[i] = F.array(*subs)
        at += width
    rows = codes.select(*own_columns, F.posexplode(F.array(*plain)).alias("i", "key"))
    # A key for each value of each block: 5 times 2^13 for a bound of 4, fewer for a larger one.
    hot = materialize(rows.groupBy("key").count().where(F.col("count") > bucket_rows).select("key", F.lit(True).alias("hot")))
    alone = F.array(F.struct(F.lit(-1).cast("long").alias("sub"), F.lit(0).cast("long").alias("part")))
    deal = F.coalesce(*[F.when(F.col("hot") & (F.col("i") == i), sub) for i, sub in again.items()], alone)
    rows = rows.join(F.broadcast(hot), "key", "left").select(*own_columns, "key", F.inline(deal))
    rows = rows.select(*own_columns, "key", (F.col("sub") * (1 << 32) + F.col("part")).alias("inner"))
    if hot.isEmpty():
        return rows.select(*own_columns, "key", "inner", F.lit(0).cast("long").alias("pair"))
    rows = materialize(rows)
    still = materialize(rows.where("inner >= 0").groupBy("key", "inner").count().where(F.col("count") > bucket_rows).select("key", "inner", F.ceil(F.col("count") / bucket_rows).cast("long").alias("chunks")))
    rows = rows.join(still, ["key", "inner"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))
    own = F.pmod(F.xxhash64(F.lit(SEED), "code"), F.col("chunks"))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    # Two chunks or more: pairs of different chunks cover each chunk itself too.
    rows = rows.where((F.col("chunks") == 1) | (F.col("own") != F.col("other")))
    return rows.select(*own_columns, "key", "inner", (F.least("own", "other") * (1 << 31) + F.greatest("own", "other")).alias("pair"))


def _search(rows: DataFrame, bound: int, total: int | None) -> DataFrame:
    """a, b: links between codes that connect each bucket's components."""
    keys = ["key", "inner", "pair"]
    prints = [c for c in rows.columns if c not in (*keys, "fp", "code")]
    columns = [*keys, "fp", "code", *prints]

    def run(batches):
        held = np.zeros((0, len(columns)), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([batch[c].to_numpy(zero_copy_only=False) for c in columns], axis=1)])
            cut = np.flatnonzero((held[1:, :3] != held[:-1, :3]).any(axis=1)) + 1
            if len(cut):
                yield from found(held[: cut[-1]])
                held = held[cut[-1] :]
        yield from found(held)

    def found(part):
        if not len(part):
            return
        cut = [0, *(np.flatnonzero((part[1:, :3] != part[:-1, :3]).any(axis=1)) + 1), len(part)]
        a, b = [], []
        for low, high in zip(cut[:-1], cut[1:], strict=True):
            if high - low > 1:
                own = part[low:high]
                wide = np.ascontiguousarray(own[:, 5:]).view(np.uint64) if prints else None
                one, two = spanning_links(np.ascontiguousarray(own[:, 3]).view(np.uint64), bound, wide, total or 0)
                a.append(own[one, 4])
                b.append(own[two, 4])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return rows.select(*columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def near_links(codes: DataFrame, bound: int = MAX_DIFFERENT, bucket_rows: int = BUCKET_ROWS, total: int | None = None) -> DataFrame:
    """Of distinct rows code, fp0 and on: links a, b between codes that connect whatever the bounds connect: at most
    `bound` bits differ in one print, and at most `total` in all prints."""
    prints = [c for c in codes.columns if c != "code"]
    links = None
    for c in prints:
        rows = codes.select(F.col(c).alias("fp"), "code", *(prints if total is not None else []))
        found = _search(_bucketed(rows, bound, bucket_rows), bound, total)
        links = found if links is None else links.unionByName(found)
    return links


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bound: int = MAX_DIFFERENT, bucket_rows: int = BUCKET_ROWS, prints: int = 1, total: int | None = None) -> DataFrame:
    """One row for each row of docs: id, th, fp0 and on, component_id (the smallest id that links reach, itself
    included) and label (which names the component). See near_links for the bounds.

    Null and empty texts have fingerprint zero and link like any other. Equal fingerprints are linked. Null ids count
    as larger than any; a component of null ids only has a null component_id. Other columns of docs aren't read.
    """
    names = [f"fp{k}" for k in range(prints)]
    rows = fingerprints(docs, id_col, text_col, words, prints)
    rows = materialize(rows.withColumn("code", F.col("fp0") if prints == 1 else F.xxhash64(*names)))
    codes = materialize(rows.groupBy("code", *names).agg(F.min("id").alias("least")))
    named = components(near_links(codes.select("code", *names), bound, bucket_rows, total))
    named = materialize(codes.join(named.withColumnRenamed("node", "code"), "code", "left").select("code", "least", F.coalesce("label", "code").alias("label")))
    least = materialize(named.groupBy("label").agg(F.min("least").alias("component_id")))
    named = materialize(named.join(least, "label").select("code", "label", "component_id"))
    return rows.join(named, "code").select("id", "th", *names, "component_id", "label")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group with all its columns: that with the smallest id; of repeated ids one row."""
    return keep_first(docs, near_groups(docs, id_col, text_col, **options), id_col, text_col)


def keep_first(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of found (id, th, label: a row for each row of docs), the rows of docs that come first in their label."""
    found = materialize(found)
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("th"))).alias("first")
    stays = found.groupBy("label").agg(first).select(F.col("first.id").alias("__gl_id"), F.col("first.th").alias("__gl_th"))
    rows = docs.withColumn("__gl_of", F.xxhash64(whole_text(text_col)))
    rows = rows.join(stays, F.col(id_col).eqNullSafe(F.col("__gl_id")) & (F.col("__gl_of") == F.col("__gl_th")), "left_semi")
    once = Window.partitionBy(F.col(id_col), F.col("__gl_of")).orderBy(F.col("__gl_of"))
    return rows.withColumn("__gl_row", F.row_number().over(once)).where("__gl_row = 1").select(*docs.columns)


def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")
