import hashlib
import re
from collections import defaultdict

import pytest

from gridloom.llm import exact
from tests.llm.helpers import clashing, empty, frame, odd_rows


def brute(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = []
    for text, ids in groups.items():
        real = [i for i in ids if i is not None]
        keep = min(real) if real else None
        first = True
        for i in sorted(ids, key=lambda x: (x is None, x or 0)):
            out.append((i, keep, len(ids), first, hashlib.sha256(text.encode()).hexdigest()))
            first = False
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [3, 64, 2048])
def test_groups_match_brute_force(spark, block):
    rows = odd_rows()
    if block == 3:
        rows = [r for r in rows if len(r[1] or "") < 400]
    found = exact.exact_groups(frame(spark, rows), block_bytes=block).collect()
    assert sorted([(r["id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["sha"]).hex()) for r in found], key=str) == brute(rows)


def test_drop_keeps_one_row_of_each_text(spark):
    rows = odd_rows()
    docs = clashing(frame(spark, rows))
    kept = exact.drop_exact(docs)
    assert kept.columns == docs.columns
    want = [(i, s) for i, _, _, k, s in brute(rows) if k]
    got = [(r["doc_id"], hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "").encode()).hexdigest()) for r in kept.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert exact.exact_groups(empty(spark)).count() == 0
    assert exact.drop_exact(empty(spark)).count() == 0


def test_blocks_that_share_a_hash_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = odd_rows(n=30)
    plain = exact._blocks
    monkeypatch.setattr(exact, "_blocks", lambda *a: plain(*a).withColumn("h", F.octet_length("block").cast("long") % 3))
    found = exact.exact_groups(frame(spark, rows), block_bytes=64).collect()
    assert sorted([(r["id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["sha"]).hex()) for r in found], key=str) == brute(rows)
