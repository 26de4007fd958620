import re
import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import mixing
from tests.llm.helpers import clashing, empty, frame, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: float(weights[k % len(weights)]) for k, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        above = {s for s in free if level * w[s] >= cap * sizes[s]}
        for s in above or free:
            out[s] = cap * sizes[s] if above else level * w[s]
        left -= sum(out[s] for s in above)
        free = free - above if above else set()
    return out


@pytest.mark.parametrize("block", [4, 128])
def test_taken_words(spark, block):
    rows = odd_rows() + [(1000 + i, "w " * (i % 50), "en", "hot") for i in range(400)]
    docs = clashing(frame(spark, rows))
    found = mixing.taken_words(docs, block_words=block, slots_a_shard=16).collect()
    assert Counter((r["id"], r["size"]) for r in found) == Counter((i, len(WORD.findall(t or ""))) for i, t, *_ in rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    by = defaultdict(list)
    for s, size in sizes.items():
        by[(size, round(want[s], 6))].append(s)
    taken = defaultdict(int)
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert (r["source_size"], round(r["target"], 6)) in by
        taken[(r["source_size"], round(r["target"], 6))] += r["taken"]
    for key, got in taken.items():
        assert abs(got - key[1]) <= 3 * block, (key, got)
    again = mixing.taken_words(docs, block_words=block, slots_a_shard=16).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))


def test_targets_match_a_loop(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 70}, {"x": 1}, {"a": 0, "b": 9}, {f"s{k}": (k * 37) % 91 for k in range(40)}):
        table = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(table).collect()}
        want = brute_targets(sizes)
        assert got == pytest.approx(want)
        assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mixed_documents_hold_the_taken_words(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    taken = defaultdict(int)
    for r in mixing.taken_words(docs, block_words=16).collect():
        taken[r["id"]] += r["taken"]
    out = mixing.mixed_documents(docs, block_words=16)
    assert out.columns == docs.columns
    got, texts = defaultdict(int), defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(" ".join(WORD.findall(t or "")))
    for r in out.collect():
        words = WORD.findall(r["text"])
        got[r["doc_id"]] += len(words)
        assert r["n_chars"] == len(r["text"]) and any(" ".join(words) in t for t in texts[r["doc_id"]])
    assert {k: v for k, v in taken.items() if v} == dict(got)


def test_slots_fill_shards_and_blocks_repeat_evenly(spark):
    mix = mixing.plan_mix(frame(spark, odd_rows()), block_words=8, slots_a_shard=32)
    slots, sources = mix.slots.collect(), {r["sidx"]: r for r in mix.sources.collect()}
    for k, s in sources.items():
        own = [r for r in slots if r["sidx"] == k]
        assert sorted(r["q"] for r in own) == list(range(s["quota"]))
        uses = Counter(r["block"] for r in own)
        assert set(uses) <= set(range(s["n_blocks"])) and (not uses or max(uses.values()) <= 2)


def brute_place(x, size, key, seed=mixing.SEED):
    def of(*parts):
        h = 42
        for p in parts:
            h = xxhash.xxh64_intdigest(struct.pack("<q", p), h)
        return h - 2**64 if h >= 2**63 else h

    for r in range(mixing.ROUNDS):
        mate = (of(seed, 0, r, key) % size - x) % size
        x = mate if of(seed, 1, r, key, max(x, mate)) & 1 else x
    return x


def test_mix_matches_brute_force(spark):
    """Slots, shards, blocks and taken words of a plain loop over words."""
    rows = [(k, "w " * (k % 23), "en", "abc"[k % 3]) for k in range(120)] + [(900, "w " * 3000, "en", "c")]
    block, shard = 16, 8
    docs = frame(spark, rows)
    by = {s: [(i, len(t.split())) for i, t, _, source in rows if source == s] for s in "abc"}
    size = {s: sum(n for _, n in own) for s, own in by.items()}
    target, blocks = brute_targets(size), {s: -(-n // block) for s, n in size.items()}
    quota = {s: round(target[s] * blocks[s] / size[s]) for s in size}
    total, slots, taken, before = sum(quota.values()), [], Counter(), 0
    for k, s in enumerate("abc"):
        words = [i for i, n in by[s] for _ in range(n)]
        for q in range(quota[s]):
            at, own = brute_place(before + q, total, -1), brute_place(q % blocks[s], blocks[s], k)
            slots.append((at // shard, at % shard, k, q, own))
            taken.update(words[own * block : (own + 1) * block])
        before += quota[s]
    assert len({x[:2] for x in slots}) == total  # every place of a shard is filled once
    mix = mixing.plan_mix(docs, block_words=block, slots_a_shard=shard)
    assert sorted((r["shard"], r["place"], r["sidx"], r["q"], r["block"]) for r in mix.slots.collect()) == sorted(slots)
    assert {(r["shard"], r["sidx"]): r["slots"] for r in mixing.shard_counts(mix).collect()} == Counter((x[0], x[2]) for x in slots)
    found = mixing.taken_words(docs, block_words=block, slots_a_shard=shard).collect()
    assert {r["id"]: r["taken"] for r in found if r["taken"]} == dict(taken)


def test_permutations_are_whole_and_spread(spark):
    for size in (1, 2, 7, 1000):
        got = mixing.permuted(spark.range(size), F.col("id"), F.lit(size).cast("long"), F.lit(5).cast("long"), "at").orderBy("id").collect()
        assert sorted(r["at"] for r in got) == list(range(size))
    # Shard counts of two halves spread as a draw without replacement does: variance 10 * 1/4 * 990/999 of 10 places.
    halves = Counter(r["at"] // 10 for r in got[:500])
    spread = sum((halves[k] - 5) ** 2 for k in range(100)) / 100
    assert 1.5 < spread < 3.6


def test_no_python_on_the_main_path(spark):
    docs = frame(spark, odd_rows())
    for made in (mixing.taken_words(docs), mixing.mixed_documents(docs), mixing.plan_mix(docs).slots):
        plan = made._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_a_long_text_in_many_runs(spark):
    """Linear in the text: a document of 400,000 words in thousands of runs."""
    rows = [(1, "word " * 400_000, "en", "a"), (2, "x " * 100, "en", "b")]
    out = mixing.mixed_documents(frame(spark, rows)).select("doc_id", F.length("text").alias("n")).collect()
    assert len(out) > 1000 and abs(sum(r["n"] for r in out) - 1.5 * 5 * 400_000) < 20_000


def test_empty_and_wordless_tables(spark):
    assert mixing.taken_words(empty(spark)).count() == 0
    assert mixing.mixed_documents(empty(spark)).count() == 0
    assert [r["taken"] for r in mixing.taken_words(frame(spark, [(1, None, None, None), (2, "", None, "a")])).collect()] == [0, 0]
