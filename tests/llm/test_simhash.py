import random

import numpy as np
import pytest
import xxhash

from gridloom.llm import graph, simhash
from gridloom.llm.graph import components
from tests.llm.helpers import clashing, empty, frame, odd_rows


def brute_fingerprint(text, words=4):
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    tokens = data.split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_groups(codes, bound):
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if bound(codes[i], codes[j]) if callable(bound) else bin(codes[i] ^ codes[j]).count("1") <= bound:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(codes))]


def near_codes(rng, centres, each):
    out = []
    for _ in range(centres):
        base = rng.getrandbits(64)
        for _ in range(each):
            code = base
            for _ in range(rng.randint(0, 5)):
                code ^= 1 << rng.randrange(64)
            out.append(code)
    return list(dict.fromkeys(out))


def test_fingerprints(spark):
    rows = odd_rows() + [(500, "Aa BB cc Dd EE ff", None, None)]
    got = simhash.fingerprints(clashing(frame(spark, rows))).collect()
    assert sorted(str((r["id"], r["fp0"] % 2**64)) for r in got) == sorted(str((i, brute_fingerprint(t))) for i, t, *_ in rows)


def test_gray_rank():
    codes = np.arange(1 << 10, dtype=np.uint64)
    assert (simhash.gray_rank(codes ^ (codes >> np.uint64(1))) == codes).all()


def test_index_finds_all_pairs():
    rng = random.Random(3)
    codes = np.array(near_codes(rng, 12, 30) + [0, 2**64 - 1], np.uint64)
    index = simhash.GrayIndex(codes)
    got = {(int(a), int(b)) for x, y in index.pairs(4) for a, b in zip(x, y)}
    want = {(i, j) for j in range(len(codes)) for i in range(j) if bin(int(index.codes[i, 0]) ^ int(index.codes[j, 0])).count("1") <= 4}
    assert got == want


@pytest.mark.parametrize("bucket_rows", [4096, 40, 7])
def test_links_connect_what_brute_force_connects(spark, bucket_rows):
    rng = random.Random(5)
    codes = near_codes(rng, 20, 25)
    signed = [int(np.uint64(c).view(np.int64)) for c in codes]
    links = simhash.near_links(spark.createDataFrame([(c, c) for c in signed], "code long, fp0 long"), 4, bucket_rows)
    label = {r["node"]: r["label"] for r in components(links).collect()}
    want = brute_groups(codes, 4)
    by_label, by_want = {}, {}
    for c, w in zip(signed, want):
        by_label.setdefault(label.get(c, c), set()).add(c)
        by_want.setdefault(w, set()).add(c)
    assert sorted(map(sorted, by_label.values())) == sorted(map(sorted, by_want.values()))


@pytest.mark.parametrize("bucket_rows", [4096, 20])
def test_several_prints(spark, bucket_rows):
    rng = random.Random(6)
    pairs = list(dict.fromkeys(zip(near_codes(rng, 15, 20), near_codes(rng, 15, 20))))
    signed = [tuple(int(np.uint64(c).view(np.int64)) for c in p) for p in pairs]
    links = simhash.near_links(spark.createDataFrame([(k, *p) for k, p in enumerate(signed)], "code long, fp0 long, fp1 long"), 6, bucket_rows, 9)
    label = {r["node"]: r["label"] for r in components(links).collect()}
    root = list(range(len(pairs)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, p in enumerate(pairs):
        for j, q in enumerate(pairs[:i]):
            d = [bin(x ^ y).count("1") for x, y in zip(p, q)]
            if min(d) <= 6 and sum(d) <= 9:
                root[max(find(i), find(j))] = min(find(i), find(j))
    same = {(label.get(i, i), find(i)) for i in range(len(pairs))}
    assert len(same) == len({a for a, _ in same}) == len({b for _, b in same})


@pytest.mark.parametrize("one_task", [0, 10, 1 << 20])
def test_components_of_odd_shapes(spark, monkeypatch, one_task):
    """By rounds of joins only, by rounds until few links are left, and in one task."""
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200), (300, 301), (301, 300)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = lambda n: got.get(n, n)
    assert len({label(n) for n in range(41)}) == 1 and len({label(n) for n in range(100, 140)}) == 1
    assert label(300) == label(301) and len({label(0), label(100), label(300), label(200)}) == 4
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_match_brute_force(spark):
    rows = odd_rows() + [(700 + k, odd_rows()[64][1] if k == 0 else " ".join(f"w{j}" for j in range(200)) + f" end{k}", None, None) for k in range(6)]
    codes = [brute_fingerprint(t) for _, t, *_ in rows]
    want, ids = brute_groups(codes, 4), [r[0] for r in rows]
    least = {}
    for g, i in zip(want, ids):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    found = simhash.near_groups(frame(spark, rows)).collect()
    assert sorted(str((r["id"], r["component_id"])) for r in found) == sorted(str((i, least.get(g))) for g, i in zip(want, ids))
    kept = simhash.drop_near(clashing(frame(spark, rows)))
    assert kept.count() == len(set(want)) and "__gl_of" not in kept.columns


def test_empty_table(spark):
    assert simhash.near_groups(empty(spark)).count() == 0 and simhash.drop_near(empty(spark)).count() == 0
