"""Near duplicates by the Jaccard similarity of word shingles: SimHash finds candidates, whole texts decide.

A document has a fingerprint of several 64-bit prints over its distinct shingles. Bands of its bits deal documents into
buckets; each bucket gets a Gray-order index over the first prints, whose search gives pairs that differ in few bits.
How wide bands are follows from the number of documents, so that buckets stay small, and how many there are from the
share of pairs at the least similarity that may be missed. Candidates are verified on their texts, word for word, and
only verified pairs link.

A bucket gives the spanning forest of its candidate pairs that are least apart: first in a few bands, and once those are verified and contracted
in all others, between components only. Where a bucket had more candidates than its forest, the documents that candidates
connect are then compared with each other, chunk by chunk, unless all lie in one component by now. So nothing is left out,
and a large group of copies isn't compared with itself.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import bounded_batches, materialize, whole_text
from gridloom.llm.graph import components, joined
from gridloom.llm.simhash import BITS, GrayIndex, fingerprints, keep_first
from gridloom.llm.words import mixed

WORDS = 5
#: Least similarity, as a fraction.
OVER, UNDER = 4, 5
#: Share of pairs at the least similarity that no band brings together; standard deviations of the index's bound.
MISSED, DEVIATIONS = 0.004, 3.2
#: Documents that share a band by chance, about; and the least width of a band.
BUCKET_MEAN, LEAST_WIDTH = 256, 12
#: Prints that the index holds.
INDEX_PRINTS = 2
#: A bucket above so many documents is searched in pairs of chunks of so many.
CHUNK = 4096
#: Bands whose pairs are verified before the other bands are searched.
FIRST_BANDS = 2
#: Candidates' numbers (24 bytes each) are broadcast up to so many; beyond, their texts are found by a shuffled join.
SMALL_ROWS = 100_000
#: A chunk of documents that are compared with each other has about so many rows and bytes.
COMPARED_ROWS, COMPARED_BYTES = 256, 8 << 20
PAIR, DENSE, LARGE = 0, 1, 2


def agreement(similarity: float = OVER / UNDER) -> float:
    """Share of bits that agree for two sets of one size: 1 - angle / pi, the cosine being 2s / (1 + s)."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def plan(there: int) -> tuple[int, int, int, int]:
    """Width and number of bands, prints, and the bound of the index, for so many documents."""
    width = max(LEAST_WIDTH, math.ceil(math.log2(max(1, there) / BUCKET_MEAN)))
    bands = math.ceil(math.log(MISSED) / math.log1p(-(agreement() ** width)))
    bits, miss = INDEX_PRINTS * BITS, 1 - agreement()
    bound = math.ceil(bits * miss + DEVIATIONS * math.sqrt(bits * miss * (1 - miss)))
    return width, bands, max(INDEX_PRINTS, -(-width * bands // BITS)), bound


def tokens_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, words: int = WORDS) -> set[tuple[bytes, ...]]:
    """Runs of so many words; a shorter text is one shingle."""
    t = tokens_of(text)
    return set(zip(*[t[k:] for k in range(words)])) if len(t) >= words else {tuple(t)}


def similar(one: set, two: set) -> bool:
    both = len(one & two)
    return UNDER * both >= OVER * (len(one) + len(two) - both)


_INDEXED = [f"fp{k}" for k in range(INDEX_PRINTS)]
_ROWS = ["key", "part", "code", "label", *_INDEXED]
_FOUND = ["kind", "key", "part", "a", "b", *_INDEXED]


def _banded(codes: DataFrame, width: int, low: int, high: int) -> DataFrame:
    """key, part, code, label and the index's prints: a row for each of the bands low to high - 1 of each code."""
    prints = [c for c in codes.columns if c.startswith("fp")]
    weight, bands = (1 << np.arange(width, dtype=np.int64))[::-1], high - low

    def run(batches):
        for batch in batches:
            code, label = batch["code"].to_numpy(), batch["label"].to_numpy()
            fp = np.stack([batch[c].to_numpy() for c in prints], axis=1)
            step = max(1, (1 << 18) // bands)
            for at in range(0, len(code), step):
                own = np.ascontiguousarray(fp[at : at + step])
                bits = np.unpackbits(own.view(np.uint8), axis=1)[:, width * low : width * high].reshape(-1, bands, width)
                key = (bits @ weight) + (np.arange(low, high) << width)
                spread = [np.repeat(x, bands) for x in (code[at : at + step], label[at : at + step], *own[:, :INDEX_PRINTS].T)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.reshape(-1), np.full(len(own) * bands, -1), *spread)], _ROWS)

    return codes.mapInArrow(run, ", ".join(f"{c} long" for c in _ROWS))


def _forest(size: int, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Which of the pairs a, b of numbers below `size` make a spanning forest of those that are least apart: in each round
    every component takes its nearest pair; ties by place."""
    labels, kept, at = np.arange(size), [np.zeros(0, np.int64)], np.argsort(apart, kind="stable")
    while len(at):
        one, two = labels[a[at]], labels[b[at]]
        open_ = one != two
        at, ends = at[open_], np.stack([one[open_], two[open_]], axis=1).reshape(-1)
        _, first = np.unique(ends, return_index=True)
        chosen = at[np.unique(first // 2)]
        kept.append(chosen)
        labels = joined(labels, labels[a[chosen]], labels[b[chosen]])
    return np.concatenate(kept)


def _search(rows: DataFrame, bound: int, most: int | None) -> DataFrame:
    """Of key, part, code, label, prints: PAIR rows (a, b), of each bucket a forest of candidates of different labels; DENSE
    rows, the ends of all candidates of a bucket that has more; and LARGE rows, those of buckets above `most`. a has their
    code, b their label."""
    print_columns = slice(_ROWS.index(_INDEXED[0]), len(_ROWS))

    def rows_of(kind, own):
        columns = (np.full(len(own), kind), *own[:, :4].T, *own[:, print_columns].T)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], _FOUND)

    def pairs_of(a, b):
        none = np.zeros(len(a), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (none, none, none, np.minimum(a, b), np.maximum(a, b), *[none] * INDEX_PRINTS)], _FOUND)

    def searched(own):
        index = GrayIndex(np.ascontiguousarray(own[:, print_columns]).view(np.uint64))
        own = own[index.order]
        code, label = own[:, 2], np.unique(own[:, 3], return_inverse=True)[1]
        count, forest, ends = 0, [], np.zeros(len(own), bool)

        def nearest(i, j):
            apart = np.bitwise_count(index.codes[i] ^ index.codes[j]).sum(axis=1, dtype=np.int64)
            kept = _forest(len(own), label[i], label[j], apart)
            return i[kept], j[kept]

        for i, j in index.pairs(bound):
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            if len(i):
                # What isn't in the forest of a part isn't in that of the whole.
                ends[i] = ends[j] = True
                count += len(i)
                forest.append(nearest(i, j))
        if forest:
            i, j = nearest(*map(np.concatenate, zip(*forest))) if len(forest) > 1 else forest[0]
            yield pairs_of(code[i], code[j])
            if count > len(i):
                yield rows_of(DENSE, own[ends])

    def found(part):
        cut = [0, *(np.flatnonzero((part[1:, :2] != part[:-1, :2]).any(axis=1)) + 1), len(part)]
        for low, high in zip(cut[:-1], cut[1:], strict=True):
            if most is not None and high - low > most:
                yield rows_of(LARGE, part[low:high])
            elif high - low > 1 and (part[low + 1 : high, 3] != part[low, 3]).any():
                yield from searched(part[low:high])

    def run(batches):
        held, large = np.zeros((0, len(_ROWS)), np.int64), None
        for batch in batches:
            held = np.concatenate([held, np.stack([batch[c].to_numpy(zero_copy_only=False) for c in _ROWS], axis=1)])
            if large is not None:  # the rest of a bucket whose first rows went on already
                n = int((held[:, :2] == large).all(axis=1).sum())
                if n:
                    yield rows_of(LARGE, held[:n])
                held = held[n:]
                large = large if not len(held) else None
            cut = np.flatnonzero((held[1:, :2] != held[:-1, :2]).any(axis=1)) + 1
            if len(cut):
                yield from together(found(held[: cut[-1]]))
                held = held[cut[-1] :]
            if most is not None and len(held) > most:
                large = held[0, :2].copy()
                yield rows_of(LARGE, held)
                held = held[:0]
        if len(held):
            yield from together(found(held))

    def together(parts):
        """Many small results as few batches."""
        own, n = [], 0
        for x in parts:
            own.append(x)
            n += x.num_rows
            if n > 10_000:
                yield from pa.Table.from_batches(own).combine_chunks().to_batches()
                own, n = [], 0
        if own:
            yield from pa.Table.from_batches(own).combine_chunks().to_batches()

    return rows.select(*_ROWS).repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(run, ", ".join(f"{c} long" for c in _FOUND))


def _dealt(rows: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """rows, each in the pairs of chunks (`part`) that have its own chunk. sizes: key, chunks; one chunk is a pair alone."""
    rows = rows.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("code"), F.col("chunks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).where("own <> other OR chunks = 1")
    return rows.withColumn("part", F.least("own", "other") * (1 << 31) + F.greatest("own", "other")).drop("own", "other", "chunks")


def _chunked(large: DataFrame, chunk: int) -> DataFrame:
    """Rows of large buckets, dealt into pairs of chunks."""
    return _dealt(large.drop("part"), materialize(large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("long").alias("chunks"))), "key")


def _compared(rows: DataFrame, words: int) -> DataFrame:
    """a, b: all similar pairs with different labels of rows key, part, code, label, text that share key and part. Shingles
    are counted by 64-bit hashes, and what they call similar is verified on the texts."""

    def hashed(text):
        t = tokens_of(text)
        one = np.fromiter(map(xxhash.xxh64_intdigest, t), np.uint64, len(t))
        total = np.zeros(max(1, len(t) - words + 1), np.uint64)
        for k in range(min(words, len(t))):
            total = mixed(total * np.uint64(3) + one[k : k + len(total)])
        return np.unique(total)

    def found(held):
        code, label, texts = (np.array([r[k] for r in held], t) for k, t in ((2, np.int64), (3, np.int64), (4, object)))
        sets = [hashed(t) for t in texts]
        size = np.array([len(x) for x in sets])
        start = np.cumsum(size) - size
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        mark, a, b = np.zeros(flat.max() + 1, bool), [], []
        for i in range(len(held) - 1):
            own = flat[start[i] : start[i] + size[i]]
            mark[own] = True
            both = np.add.reduceat(mark[flat[start[i + 1] :]], start[i + 1 :] - start[i + 1], dtype=np.int64)
            mark[own] = False
            near = (UNDER * both >= OVER * (size[i] + size[i + 1 :] - both)) & (label[i + 1 :] != label[i])
            for j in (np.flatnonzero(near) + i + 1).tolist():
                if similar(shingles(texts[i], words), shingles(texts[j], words)):
                    a.append(min(code[i], code[j]))
                    b.append(max(code[i], code[j]))
        return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in (a, b)], ["a", "b"])

    def run(batches):
        held = []
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("key", "part", "code", "label", "text")), strict=True):
                if held and row[:2] != held[0][:2]:
                    yield found(held)
                    held = []
                held.append(row)
        if held:
            yield found(held)

    return rows.select("key", "part", "code", "label", "text").repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs a, b (codes) whose texts are similar. texts: code, text."""
    one, two = (texts.select(F.col("code").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")

    def run(batches):
        last, own = None, None
        for batch in batches:
            a, b, good = batch["a"].to_pylist(), batch["b"].to_pylist(), []
            for k, (x, y) in enumerate(zip(batch["text_a"], batch["text_b"], strict=True)):
                if b[k] != last:
                    last, own = b[k], shingles(y.as_py(), words)
                good.append(similar(own, shingles(x.as_py(), words)))
            good = np.array(good, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)[good]) for x in (a, b)], ["a", "b"])

    both = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return materialize(both.mapInArrow(run, "a long, b long"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, chunk: int = CHUNK) -> DataFrame:
    """One row for each row of docs: id, th (a hash of the text) and label, which documents share that pairs with a
    similarity of OVER / UNDER or more connect: all that SimHash brings together (see MISSED) and none besides.

    Null texts count as empty; texts without a word are alike. Rows that repeat both id and text share a label. Other
    columns of docs aren't read; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    width, bands, prints, bound = plan(docs.count())
    rows = docs.select(F.col(id_col).alias("__gl_id"), whole_text(text_col).alias("text")).withColumn("__gl_th", F.xxhash64("text"))
    # Numbers of documents are given once, in a written table.
    codes = fingerprints(docs, id_col, text_col, words, prints, True).dropDuplicates(["id", "th"])
    codes = materialize(codes.withColumn("code", F.monotonically_increasing_id()))
    same = F.col("__gl_id").eqNullSafe(F.col("id")) & (F.col("__gl_th") == F.col("th"))

    def texts(pairs):
        wanted = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("code")), F.struct(F.col("b").alias("code"))))).distinct()
        named = materialize(codes.select("id", "th", "code").join(wanted, "code", "left_semi"))
        side = F.broadcast(named) if named.count() <= SMALL_ROWS else named
        return materialize(rows.join(side, same).select("code", "text").dropDuplicates(["code"]))

    def relabelled(table):
        if links is None:
            return table.withColumn("label", F.col("code"))
        return table.join(components(links).withColumnRenamed("node", "code"), "code", "left").withColumn("label", F.coalesce("label", "code"))

    def verified(pairs):
        pairs = materialize(pairs.distinct() if tested is None else pairs.distinct().join(tested, ["a", "b"], "left_anti"))
        new = _verified(pairs, texts(pairs), words)
        return (pairs, new) if links is None else (tested.unionByName(pairs), links.unionByName(new))

    links = tested = None
    of = lambda kind: F.col("kind") == kind
    as_rows = ["key", "part", F.col("a").alias("code"), F.col("b").alias("label"), *_INDEXED]
    dense = []
    for low, high in ((0, FIRST_BANDS), (FIRST_BANDS, bands)):
        found = materialize(_search(_banded(relabelled(codes.drop("id", "th")), width, low, high), bound, 2 * chunk))
        large = found.where(of(LARGE)).select(*as_rows)
        if not large.isEmpty():
            found = found.unionByName(materialize(_search(_chunked(large, chunk), bound, None)))
        dense.append(found.where(of(DENSE)).select(*as_rows))
        tested, links = verified(found.where(of(PAIR)).select("a", "b"))
    rest = dense[0].unionByName(dense[1]).select("code").distinct()
    if not rest.isEmpty():
        # Candidates that weren't compared are connected by pairs that were.
        near = components(tested).select(F.col("node").alias("code"), F.col("label").alias("key"))
        rest = relabelled(rest).join(near, "code", "left").withColumn("key", F.coalesce("key", "code"))
        rest = materialize(rest.select("code", "label", "key"))
        several = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
        rest = materialize(rest.join(several, "key", "left_semi"))
        own = rest.join(texts(rest.select(F.col("code").alias("a"), F.col("code").alias("b"))), "code")
        parts = F.greatest(F.ceil(F.count(F.lit(1)) / COMPARED_ROWS), F.ceil(F.sum(F.octet_length("text")) / COMPARED_BYTES)).cast("long")
        sizes = materialize(own.groupBy("key").agg(F.when(parts > 1, parts + 1).otherwise(1).alias("chunks")))
        links = links.unionByName(materialize(_compared(_dealt(own, sizes, "key"), words).distinct()))
    named = components(links)
    labels = codes.join(named.withColumnRenamed("node", "code"), "code", "left").select("id", "th", F.coalesce("label", "code").alias("label"))
    return rows.select("__gl_id", "__gl_th").join(labels, same).select("id", "th", "label")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One document of each group with all its columns: that with the smallest id; of repeated ids one row. Null ids
    come last; a group of null ids only keeps one of them."""
    return keep_first(docs, similar_groups(docs, id_col, text_col, words), id_col, text_col)
