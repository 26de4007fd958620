"""Packing documents into token sequences of a fixed length by bin completion.

Items are told apart by length only, so the search runs on counts by length, a table bounded by the sequence length
whatever the corpus. It fills bins around the largest length left, trying undominated fillings, prunes by waste and
starts from a best-fit packing. The search is complete unless its budget of steps ends it, and says which: the bound was
met, the packing is proved best, or the search was cut. The patterns found are then dealt to the documents by rank within
their length.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import bounded_batches, documents, in_global_order, materialize

CAPACITY = 2048
END = 0
#: The search ends after so many steps (lengths that were tried, and fillings that were held against each other), with the
#: best packing so far.
STEPS = 1_000_000
#: So many steps at each node go ahead, to try fillings with little waste first.
AHEAD = 400
BOUND_MET, PROVED, CUT = "bound met", "proved", "cut"

Pattern = tuple[tuple[int, int], ...]  # (length, copies), longest first


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing, on counts: bins with equal gaps are kept together."""
    bins: dict[int, list[tuple[Pattern, int]]] = {}
    gaps: list[int] = []

    def put(gap: int, pattern: Pattern, n: int):
        if n:
            if gap not in bins:
                bins[gap] = []
                insort(gaps, gap)
            bins[gap].append((pattern, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        at = bisect_right(gaps, length - 1)
        while left and at < len(gaps):
            gap = gaps[at]
            each, old, kept = gap // length, bins.pop(gap), []
            gaps.pop(at)
            for pattern, n in old:
                full = min(n, left // each)
                put(gap - each * length, (*pattern, (length, each)), full)
                left, n = left - full * each, n - full
                if n and 0 < left < each:
                    put(gap - left * length, (*pattern, (length, left)), 1)
                    left, n = 0, n - 1
                if n:
                    kept.append((pattern, n))
            for pattern, n in kept:
                put(gap, pattern, n)
            at = bisect_right(gaps, length - 1)
        each = capacity // length
        if left // each:
            put(capacity - each * length, ((length, each),), left // each)
        if left % each:
            put(capacity - (left % each) * length, ((length, left % each),), 1)
    return [x for group in bins.values() for x in group]


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """The larger of the volume bound and, for each k, bins of lengths above capacity - k plus what then can't share."""
    best = -(-sum(k * n for k, n in counts.items()) // capacity)
    for k in {0, *[x for x in counts if 2 * x <= capacity]}:
        large = sum(n for x, n in counts.items() if x > capacity - k)
        middle = [(x, n) for x, n in counts.items() if capacity - k >= x > capacity / 2]
        small = sum(x * n for x, n in counts.items() if capacity / 2 >= x >= max(k, 1))
        space = sum((capacity - x) * n for x, n in middle)
        best = max(best, large + sum(n for _, n in middle) + max(0, -(-(small - space) // capacity)))
    return best


def _dominates(one: list[int], other: list[int]) -> bool:
    """Whether other's lengths fit, each whole, into those of one (found by first fit, which can miss some)."""
    room = sorted(one, reverse=True)
    for x in sorted(other, reverse=True):
        for k, r in enumerate(room):
            if r >= x:
                room[k] -= x
                break
        else:
            return False
    return True


class _Budget:
    def __init__(self, steps: int):
        self.left = steps


def _maximal(counts: dict[int, int], lengths: list[int], largest: int, room: int, budget: _Budget) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(waste, lengths, longest first) of all maximal ways to fill the room beside `largest`. Stops when the budget ends."""
    used = {largest: 1}

    def search(room: int, most: int, chosen: tuple[int, ...]):
        at = bisect_right(lengths, min(room, most)) - 1
        maximal = True
        while at >= 0 and budget.left > 0:
            x = lengths[at]
            at -= 1
            if counts[x] <= used.get(x, 0):
                continue
            budget.left -= 1
            maximal = False
            used[x] = used.get(x, 0) + 1
            yield from search(room - x, x, (*chosen, x))
            used[x] -= 1
            if room == x:
                return  # a length that fills the room alone dominates all others here
        if maximal:
            yield room, chosen

    yield from search(room, room, ())


def fillings(counts: dict[int, int], lengths: list[int], largest: int, room: int, budget: _Budget) -> Iterator[tuple[int, ...]]:
    """Undominated ways to fill the room beside `largest`: all of them while the budget lasts; of those that a look
    ahead of AHEAD steps finds, the ones with the least waste come first."""
    every, ahead, end = _maximal(counts, lengths, largest, room, budget), [], budget.left - AHEAD
    for found in every:
        ahead.append(found)
        if budget.left <= end or found[0] == 0 and sum(w == 0 for w, _ in ahead) >= 4:
            break
    kept: list[tuple[int, ...]] = []
    ahead.sort(key=lambda f: (f[0], len(f[1]), [-x for x in f[1]]))
    for found in (ahead, every):
        for _, chosen in found:
            budget.left -= len(kept)
            if not any(_dominates(one, chosen) for one in kept):
                kept.append(chosen)
                yield chosen


@dataclass(frozen=True)
class Packed:
    """patterns and how many bins each has; bins in all; least, a bound below; outcome: whether bins equals the bound,
    is proved best by the search, or the search was cut."""

    patterns: list[tuple[Pattern, int]]
    bins: int
    least: int
    outcome: str


def complete(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> Packed:
    """The fewest bins that the search finds, never more than best fit.

    A node takes a filling as often as it can, for each filling; then, for each that it could take several times, less
    often with others beside it. So nothing is left out but what the bounds or the budget end.
    """
    counts = {k: n for k, n in counts.items() if n}
    best = best_fit(counts, capacity)
    fewest, least, budget = sum(n for _, n in best), least_bins(counts, capacity), _Budget(steps)
    left, lengths, volume = dict(counts), sorted(counts), sum(k * n for k, n in counts.items())
    path: list[tuple[Pattern, int]] = []
    used = 0

    def move(pattern: Pattern, n: int, sign: int):
        nonlocal volume, used
        for x, copies in pattern:
            if sign > 0 and left[x] == copies * n:
                lengths.remove(x)
            elif sign < 0 and left[x] == 0:
                insort(lengths, x)
            left[x] -= sign * copies * n
            volume -= sign * x * copies * n
        used += sign * n

    def moves(without: frozenset):
        """(pattern, bins, patterns that must not follow while the largest length is the same)."""
        largest, several = lengths[-1], []
        for chosen in fillings(left, lengths, largest, capacity - largest, budget):
            copies: dict[int, int] = {}
            for x in (largest, *chosen):
                copies[x] = copies.get(x, 0) + 1
            pattern = tuple(copies.items())
            if pattern in without:
                continue
            n = min(left[x] // c for x, c in pattern)
            yield pattern, n, without
            if n > 1:
                several.append((pattern, n))
        for pattern, n in several:
            for fewer in range(n - 1, 0, -1):
                yield pattern, fewer, without | {pattern}

    stack = [(lengths[-1], moves(frozenset()))] if lengths and fewest > least else []
    while stack and fewest > least and budget.left > 0:
        largest, options = stack[-1]
        step = next(options, None)
        if step is None:
            stack.pop()
            if path:
                move(*path.pop(), -1)
            continue
        budget.left -= 1
        pattern, n, without = step
        move(pattern, n, 1)
        path.append((pattern, n))
        if not lengths and used < fewest:
            best, fewest = list(path), used
        # Waste bound: what is left needs its volume in bins at least.
        if lengths and used + -(-volume // capacity) < fewest:
            stack.append((lengths[-1], moves(without if lengths[-1] == largest else frozenset())))
        else:
            move(*path.pop(), -1)
    return Packed(best, fewest, least, BOUND_MET if fewest <= least else CUT if budget.left <= 0 else PROVED)


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids): each text's byte-level BPE ids with END after them, cut into
    pieces of `capacity` if longer, of which the first may be shorter. Null texts count as empty, which give END alone.

    `ranks` is the vocabulary as a file of base64 tokens and ranks that executors can read; by default the public one
    with 50,257 ids. As with the JSON form, special tokens are cut out of a text before all else, each one id.
    """

    def run(batches):
        import public_tokenizers
        import regex
        import tiktoken

        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

        with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as form:
            special = {t["content"]: t["id"] for t in json.load(form)["added_tokens"]}
        between = re.compile(f"({'|'.join(map(re.escape, special))})")

        def ids_of(text):
            if not any(t in text for t in special):
                return plain_ids(text)
            return [i for part in between.split(text) if part for i in ([special[part]] if part in special else plain_ids(part))]

        def plain_ids(text):
            try:
                return coder.encode_ordinary(text)
            except BaseException as e:  # the splitter gives up on very long runs, with a panic of its own
                if type(e).__name__ != "PanicException":
                    raise
                pieces = regex.findall(public_tokenizers.PATTERN, text)
                return [i for p in pieces for i in coder._encode_single_piece(p.encode())]

        for batch in batches:
            row, piece, start, length, crc, held = [], [], [], [], [], []
            for at, text in enumerate(batch["text"]):
                ids = np.array([*ids_of(text.as_py() or ""), END], "<u4")
                cut = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    row.append(at)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    held.append(ids[a:b].tolist() if with_ids else None)
            own = [batch["id"].take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            own += [pa.array(held, pa.list_(pa.int64()))] * with_ids
            yield pa.RecordBatch.from_arrays(own, names)

    fed = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([fed.schema["id"], T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]])
    if with_ids:
        schema.add("ids", T.ArrayType(T.LongType()))
    names = schema.names
    bounded_batches(docs.sparkSession)
    return fed.mapInArrow(run, schema)


def length_counts(pieces: DataFrame) -> dict[int, int]:
    """How many pieces each length has: at most as many rows as a sequence has tokens."""
    return {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}


def pack(pieces: DataFrame, capacity: int = CAPACITY, steps: int = STEPS) -> DataFrame:
    """pieces with sequence_id and offset: places in sequences of at most `capacity` tokens, without gaps from 0.

    Reads id, piece, start, length, ids_crc32; lengths are 1 to capacity. An empty table gives an empty result.
    """
    pieces = materialize(pieces)
    counts = length_counts(pieces)
    base = np.zeros(capacity + 2, np.int64)
    for k, n in counts.items():
        base[k + 1] = n
    base = np.cumsum(base)  # pieces that are shorter
    # A row for each pattern and length in it: from which rank of the length it takes pieces, and where it puts them.
    key, columns, next_rank, first_bin = [], [], dict.fromkeys(counts, 0), 0
    for pattern, n in complete(counts, capacity, steps).patterns:
        offset = 0
        for length, copies in pattern:
            key.append((length << 44) + next_rank[length])
            columns.append((next_rank[length], n, first_bin, offset))
            next_rank[length] += copies * n
            offset += copies * length
        first_bin += n
    order = np.argsort(np.array(key, np.int64), kind="stable")
    table = (base, np.array(key, np.int64)[order], np.array(columns, np.int64).reshape(-1, 4)[order])
    # A few rows for each pattern. Best fit makes at most two patterns for a length and a gap: bounded by capacity squared,
    # not by the data.
    shared = pieces.sparkSession.sparkContext.broadcast(table)
    placed = in_global_order(pieces, [F.col("length"), F.col("id").asc_nulls_last(), F.col("piece"), F.col("ids_crc32")])
    names = [*pieces.columns, "sequence_id", "offset"]

    def place(batches):
        base, key, columns = shared.value
        for batch in batches:
            length, pos = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "_pos"))
            rank = pos - base[length]
            row = columns[np.searchsorted(key, (length << 44) + rank, side="right") - 1]
            since, bins = rank - row[:, 0], row[:, 1]
            sequence, offset = row[:, 2] + since % bins, row[:, 3] + since // bins * length
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names[:-2]], pa.array(sequence), pa.array(offset)], names)

    return placed.mapInArrow(place, T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: see token_pieces and pack. A null or empty text is
    one piece of one token; rows that repeat are packed each; a null id comes after all others of its length."""
    return pack(token_pieces(docs, id_col, text_col, ranks)).withColumnRenamed("id", "doc_id")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
