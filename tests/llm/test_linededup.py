import random
import re
from collections import Counter

import pytest

from gridloom.llm import linededup
from gridloom.llm.words import WHITE, LineHasher, Reader, line_sums
from tests.llm.helpers import WORDS, clashing, empty, frame, odd_rows


def near(a, b, min_words=linededup.MIN_WORDS):
    """Levenshtein distance of word lists at most 1, by the full table."""
    table = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, table[0] = table[0], i
        for j, y in enumerate(b, 1):
            old, table[j] = table[j], min(table[j] + 1, table[j - 1] + 1, old + (x != y))
    return table[-1] <= 1 and max(len(a), len(b)) >= min_words


def brute(rows, min_words=linededup.MIN_WORDS):
    lines = []
    for nth, (i, text, *_) in enumerate(rows):
        for k, line in enumerate((text or "").split("\n")):
            lines.append(((i is None, i or 0, nth, k), i, tuple(re.findall(r"[^\x20\x09-\x0D]+", line))))
    first = {}
    for at, _, words in sorted(lines):
        if words:
            first.setdefault(words, at)
    gone = {w for w, at in first.items() if any(first[v] < at and near(w, v, min_words) for v in first if abs(len(v) - len(w)) < 2)}
    return [(i, at[3], "keep" if not w else "exact" if first[w] != at else "near" if w in gone else "keep") for at, i, w in lines]


def rows_of(seed):
    rng = random.Random(seed)
    out = []
    for i in range(80):
        lines = []
        for _ in range(rng.randint(0, 6)):
            words = [rng.choice(WORDS[:6]) for _ in range(rng.randint(0, 8))]
            lines.append(" ".join(words))
        out.append((i, "\n".join(lines), "en", "a"))
    return out + [(90, None, None, None), (91, "", None, None)]


@pytest.mark.parametrize("seed", [0, 1])
def test_decisions_match_brute_force(spark, seed):
    rows = rows_of(seed)
    found = linededup.line_decisions(clashing(frame(spark, rows)).repartition(5)).collect()
    assert Counter((r["id"], r["number"], r["decision"]) for r in found) == Counter(brute(rows))


@pytest.mark.parametrize("min_words", [1, 2, 7])
def test_the_least_number_of_words_is_a_parameter(spark, min_words):
    rows = rows_of(4)
    found = linededup.line_decisions(frame(spark, rows), min_words=min_words).collect()
    assert Counter((r["id"], r["number"], r["decision"]) for r in found) == Counter(brute(rows, min_words))


@pytest.mark.parametrize("bits", [8, 12])
def test_keys_that_collide_lose_no_link(spark, monkeypatch, bits):
    """With keys of few bits, foreign variants meet all over; links and decisions stay the same."""
    monkeypatch.setattr(linededup, "KEY_BITS", bits)
    rng = random.Random(9)
    rows = []
    for i in range(300):
        line = [f"w{rng.randrange(500)}" for _ in range(8)]
        rows.append((i, " ".join(line), "en", "a"))
        line[rng.randrange(8)] = "other"
        rows.append((1000 - i, " ".join(line), "en", "a"))
    found = linededup.line_decisions(frame(spark, rows)).collect()
    assert Counter((r["id"], r["number"], r["decision"]) for r in found) == Counter(brute(rows))
    assert sum(r["decision"] == "near" for r in found) >= 300


def test_a_hot_variant_is_sent_once_a_batch(spark, monkeypatch):
    """Lines that differ in one word only, in many batches: all but the earliest go."""
    monkeypatch.setattr(linededup, "HELD", 500)
    rows = [(i, f"a template line with the number n{i} in it", "en", "a") for i in range(2000)]
    found = linededup.line_decisions(frame(spark, rows)).collect()
    assert Counter(r["decision"] for r in found) == {"keep": 1, "near": 1999} and [r["id"] for r in found if r["decision"] == "keep"] == [0]


def test_texts_built_to_collide_are_kept_apart(spark):
    """Sequences that hashes by powers modulo 2^64 can't tell apart, as words of letters and as lines of words."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = ("".join("ab"[b ^ k] for b in bits) for k in (0, 1))
    rows = [(1, one, None, None), (2, two, None, None), (3, " ".join(one), None, None), (4, " ".join(two), None, None), (5, one, None, None)]
    got = {r["id"]: r["decision"] for r in linededup.line_decisions(frame(spark, rows), min_words=2).collect()}
    assert got == {1: "keep", 2: "keep", 3: "keep", 4: "keep", 5: "exact"}


def test_kept_lines_make_the_text(spark):
    rows = rows_of(2)
    docs = frame(spark, rows)
    kept = {}
    for i, k, decision in brute(rows):
        if decision == "keep":
            kept.setdefault(i, []).append(k)
    got = {r["doc_id"]: r["text"] for r in linededup.drop_lines(docs).collect()}
    for i, text, *_ in rows:
        assert got[i] == (None if text is None else "\n".join(text.split("\n")[k] for k in kept.get(i, [])))


def test_odd_documents(spark):
    rows = odd_rows(n=30)
    found = linededup.line_decisions(frame(spark, rows)).collect()
    assert len(found) == sum(len((t or "").split("\n")) for _, t, *_ in rows)
    assert linededup.drop_lines(frame(spark, rows)).count() == len(rows)
    assert linededup.line_decisions(empty(spark)).count() == 0


def test_hashes_of_variants_equal_those_of_lines():
    import numpy as np
    import pyarrow as pa

    texts = ["a b c d e", "a b d e", "x\n\ny z", None, "", "\n"]
    (slab,) = Reader(WHITE, False).slabs(pa.array(texts))
    assert slab.doc.tolist() == [0, 1, 2, 2, 2, 3, 4, 5, 5] and slab.number.tolist() == [0, 0, 0, 1, 2, 0, 0, 0, 1]
    assert np.diff(slab.word).tolist() == [5, 4, 1, 0, 2, 0, 0, 0, 0]
    hasher = LineHasher()
    sums = line_sums(hasher, slab)
    whole = hasher.whole(sums, slab.word[:-1], slab.word[1:])
    assert hasher.without(sums, np.array([0]), np.array([5]), np.array([2]))[0] == whole[1]


def test_within_one():
    rng = random.Random(0)
    for _ in range(3000):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 6))] for _ in range(2))
        table = near([*a, *"vwxyz"], [*b, *"vwxyz"])
        assert linededup.within_one([*a, *"vwxyz"], [*b, *"vwxyz"]) == table
