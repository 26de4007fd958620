"""Words and lines of whole batches of texts, hashed in numpy straight from Arrow's buffers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Odd multipliers of the final mix: fixed values.
_MIX_A, _MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Bytes of a word that have random numbers of their own; longer words repeat them, times an odd number for each round.
_OWN = 64
#: Texts are taken together up to so many bytes.
SLAB = 1 << 20

#: For each byte, whether it separates words: ASCII white space, or all ASCII but letters and digits.
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX_A
    x = (x ^ (x >> np.uint64(33))) * _MIX_B
    return x ^ (x >> np.uint64(33))


#: A random number for each place of a byte in a word and each byte (tabulation hashing): made by mixed().
_TABLE = mixed(np.arange(1, _OWN * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _at(places: np.ndarray, salt: int) -> np.ndarray:
    """A random number for each place."""
    return mixed((places.astype(np.uint64) + np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Lines:
    """Lines of texts `first_doc` and on. By line: doc, number (in its text), start and end (bytes of data), word
    (index of the first word; one more at the end). By word: hash."""

    data: np.ndarray
    doc: np.ndarray
    number: np.ndarray
    start: np.ndarray
    end: np.ndarray
    word: np.ndarray
    hash: np.ndarray


class Reader:
    def __init__(self, separators: np.ndarray, lower: bool):
        self.separators, self.lower = separators, lower

    def slabs(self, texts: pa.Array) -> Iterator[Lines]:
        """Null texts count as empty. A text ends its last line; an empty text is one empty line."""
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        whole = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLAB, side="right")) - 1)
            yield self._lines(whole[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
            at = to

    def _lines(self, data: np.ndarray, offsets: np.ndarray, first_doc: int) -> Lines:
        size = len(data)
        breaks = np.flatnonzero(data == 10)
        # A line starts at each text's start and after each line feed; starts of empty texts can coincide.
        doc_of_break = np.searchsorted(offsets, breaks, side="right") - 1
        doc = np.concatenate([np.arange(len(offsets) - 1), doc_of_break])
        start = np.concatenate([offsets[:-1], breaks + 1])
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        first = np.searchsorted(doc, np.arange(len(offsets) - 1))
        number = np.arange(len(doc)) - first[doc]
        last = np.r_[doc[1:] != doc[:-1], True]
        end = np.where(last, offsets[doc + 1], np.r_[start[1:], 0] - 1)
        apart = self.separators[data]
        edge = np.zeros(size + 1, bool)
        edge[offsets] = True
        begins = np.flatnonzero(~apart & (np.r_[True, apart[:-1]] | edge[:-1]))
        ends = np.flatnonzero(~apart & (np.r_[apart[1:], True] | edge[1:])) + 1
        length = ends - begins
        inside = ~apart
        # Sizes of slabs fit 32 bits but for a single longer text.
        small = np.int32 if size < 1 << 31 else np.int64
        place = np.flatnonzero(inside).astype(small) - np.repeat(begins.astype(small), length)
        own = data[inside]
        drawn = _TABLE[((place & (_OWN - 1)).astype(np.uint16) << np.uint16(8)) | (_LOWER[own] if self.lower else own)]
        if len(length) and length.max() > _OWN:
            later = np.flatnonzero(place >= _OWN)
            drawn[later] *= _at(place[later] // _OWN, 1 << 40) | np.uint64(1)
        value = np.add.reduceat(drawn, np.cumsum(length) - length) if len(length) else np.zeros(0, np.uint64)
        value = mixed(value + length.astype(np.uint64) * _MIX_A)
        # A word belongs to the last line that starts at or before it.
        word = np.searchsorted(begins, start)
        return Lines(data, doc + first_doc, number, start, end, np.r_[word, len(begins)], value)


class LineHasher:
    """Hashes of whole lines and of lines without one word, from word hashes: sums of random numbers that a word and its
    place in the line give together."""

    def sums(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running sums over the words, each at its own place and one place earlier. first: of each word, the first of
        its line."""
        place = np.arange(len(hashes)) - first
        out = []
        for k in (1, 0):
            sums = np.zeros(len(hashes) + 1, np.uint64)
            np.cumsum(mixed(hashes + _at(place + k, 1 << 41)), out=sums[1:])
            out.append(sums)
        return out[0], out[1]

    def whole(self, sums, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed(sums[0][b] - sums[0][a] + (b - a).astype(np.uint64) * _MIX_B)

    def without(self, sums, a: np.ndarray, b: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Of words a to b (not included), all but word i: what whole() gives for that sequence."""
        value = (sums[0][i] - sums[0][a]) + (sums[1][b] - sums[1][i + 1])
        return mixed(value + (b - a - 1).astype(np.uint64) * _MIX_B)


def line_sums(hasher: LineHasher, slab: Lines) -> tuple[np.ndarray, np.ndarray]:
    return hasher.sums(slab.hash, np.repeat(slab.word[:-1], np.diff(slab.word)))
