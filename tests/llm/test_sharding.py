import zlib

from gridloom.llm import sharding
from tests.llm.helpers import clashing, empty, frame, odd_rows


def brute(rows, shards):
    sized = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows]
    sized.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    total, before, slots, out = sum(s for _, s, _ in sized), 0, {}, []
    for i, size, crc in sized:
        shard = min(shards - 1, (2 * before + size) * shards // (2 * total))
        out.append((i, size, crc, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        before += size
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rows = odd_rows()
    for shards in (1, 7, 40):
        found = sharding.shard_by_bytes(clashing(frame(spark, rows)), shards=shards)
        assert sorted([tuple(r) for r in found.select("id", "size", "text_crc32", "shard", "slot").collect()], key=str) == brute(rows, shards)


def test_sizes_are_near_equal(spark):
    rows = [(i, "x" * (i % 97), "en", "a") for i in range(3000)]
    sizes = {}
    for r in sharding.shard_by_bytes(frame(spark, rows)).collect():
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 2 * (97 + 16)


def test_one_hot_id(spark):
    rows = [(7, "same", "en", "a")] * 500 + [(8, "b", "en", "a")]
    assert sorted([tuple(r) for r in sharding.shard_by_bytes(frame(spark, rows), shards=5).select("id", "size", "text_crc32", "shard", "slot").collect()], key=str) == brute(rows, 5)


def test_empty_table(spark):
    assert sharding.shard_by_bytes(empty(spark)).count() == 0


def test_no_python_in_plan(spark):
    plan = sharding.shard_by_bytes(frame(spark, odd_rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
