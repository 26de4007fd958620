"""Hashed character n-grams of whole texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Odd multipliers of the rolling and the final hash: fixed values.
_ROLL = np.uint64(0x9E3779B97F4A7C15)
_FINAL = np.uint64(0xC2B2AE3D27D4EB4F)
#: Texts are taken together, or a long one in parts, up to so many characters.
SLAB = 1 << 19


def _slabs(texts: Sequence[str | None], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, document of each part, start of each part, characters after it that belong to the next part).

    Each text is lower-cased with a space before and after. A long text is cut into parts that overlap by longest - 1.
    """
    parts: list[str] = []
    who: list[int] = []
    over: list[int] = []
    held = 0

    def flush():
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum([0, *map(len, parts)], dtype=np.int64)
        return points, np.array(who, np.int64), starts, np.array(over, np.int64)

    for i, text in enumerate(texts):
        text = f" {(text or '').lower()} "
        for at in range(0, len(text), SLAB):
            part = text[at : at + SLAB + longest - 1]
            parts.append(part)
            who.append(i)
            over.append(max(0, len(part) - SLAB))
            held += len(part)
            if held >= SLAB:
                yield flush()
                parts, who, over, held = [], [], [], 0
    if parts:
        yield flush()


def _rolled(points: np.ndarray, orders: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each order, a 64-bit hash at each start. Orders go up."""
    base = points.astype(np.uint64) + np.uint64(1)
    rolled, have = base, 1
    for n in orders:
        while have < n:
            rolled = rolled[: max(0, len(points) - have)] * _ROLL + base[have:]
            have += 1
        yield n, rolled


def buckets(texts: Sequence[str | None], orders: Sequence[int], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Yields (document, start, bucket) arrays: `start` has each document's first index in `bucket`, which holds the
    buckets of all its n-grams of one order, in one slab. A document can come in several yields."""
    orders = sorted(orders)
    for points, who, starts, over in _slabs(texts, orders[-1]):
        for n, rolled in _rolled(points, orders):
            # An n-gram belongs to the part in which it starts, and must end there.
            ends = starts[1:] - np.maximum(n - 1, over)
            ends = np.maximum(np.minimum(ends, len(rolled)), starts[:-1])
            bucket = ((rolled + np.uint64(n)) * _FINAL) >> np.uint64(64 - bits)
            yield who, np.stack([np.minimum(starts[:-1], len(rolled)), ends]), bucket.astype(np.int64)


def sums(texts: Sequence[str | None], orders: Sequence[int], bits: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its n-grams' rows of `table` (buckets x columns), and the number of n-grams."""
    out, count = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), np.int64)
    for who, span, bucket in buckets(texts, orders, bits):
        rows = table[bucket]
        # reduceat sums from one index to the next; every second sum is a gap between documents.
        edges = span.T.reshape(-1)
        rows = np.concatenate([rows, np.zeros((1, table.shape[1]), table.dtype)])
        part = np.add.reduceat(rows, np.minimum(edges, len(bucket)), axis=0, dtype=np.float64)[::2]
        size = span[1] - span[0]
        part[size == 0] = 0
        np.add.at(out, who, part)
        np.add.at(count, who, size)
    return out, count


def counts(texts: Sequence[str | None], orders: Sequence[int], bits: int) -> np.ndarray:
    """How often each bucket occurs in all texts together."""
    out = np.zeros(1 << bits, np.int64)
    for _, span, bucket in buckets(texts, orders, bits):
        keep = np.zeros(len(bucket) + 1, np.int64)
        np.add.at(keep, span[0], 1)
        np.add.at(keep, span[1], -1)
        out += np.bincount(bucket[np.cumsum(keep[:-1]) > 0], minlength=1 << bits)
    return out


def presence_sums(texts: Sequence[str | None], orders: Sequence[int], bits: int, weights: np.ndarray) -> np.ndarray:
    """For each text the sum of `weights` over the distinct buckets that it has. Few weights differ from 0."""
    found = [np.zeros(0, np.int64)]
    for who, bucket in _weighted(texts, orders, bits, weights != 0):
        found.append((who << bits) | bucket)
    pairs = np.unique(np.concatenate(found))
    return np.bincount(pairs >> bits, weights=weights[pairs & ((1 << bits) - 1)], minlength=len(texts))


def present(texts: Sequence[str | None], orders: Sequence[int], bits: int, wanted: np.ndarray) -> list[np.ndarray]:
    """For each text the distinct buckets that it has among those wanted (a boolean for each bucket)."""
    found = [np.zeros(0, np.int64)]
    for who, bucket in _weighted(texts, orders, bits, wanted):
        found.append((who << bits) | bucket)
    pairs = np.unique(np.concatenate(found))
    return np.split(pairs & ((1 << bits) - 1), np.searchsorted(pairs >> bits, np.arange(1, len(texts)))) if len(texts) else []


def _weighted(texts, orders, bits, wanted) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of the n-grams whose bucket is wanted."""
    for who, span, bucket in buckets(texts, orders, bits):
        at = np.flatnonzero(wanted[bucket])
        part = np.searchsorted(span[0], at, side="right") - 1
        own = at < span[1][part]
        yield who[part[own]], bucket[at[own]]
