"""The pipeline against a brute-force version of each stage's decisions, and each stage on odd input."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from gridloom.llm import mixing, neardup, packing
from gridloom.llm.common import documents
from tests.llm.helpers import empty, frame, odd_rows
from tests.llm.test_packing import check
from tests.llm.test_simhash import brute_groups

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_match_brute_force(spark):
    docs = documents(spark, SF)
    rows = {r["doc_id"]: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    one = stages["language_id"](spark, docs, SF)
    want = [i for i, r in rows.items() if any(c.isalpha() for c in r["text"])]
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(want) and one.columns == docs.columns

    two = stages["exact_dedup"](spark, one, SF)
    least = {}
    for i in sorted(want, reverse=True):
        least[re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]["text"])] = i
    want = sorted(least.values())
    assert sorted(r["doc_id"] for r in two.collect()) == want

    three = stages["near_dedup"](spark, two, SF)
    sets = [neardup.shingles(rows[i]["text"]) for i in want]
    groups = brute_groups(sets, lambda a, b: len(a & b) / len(a | b) >= 0.8)
    want = sorted({g: want[k] for k, g in reversed(list(enumerate(groups)))}.values())
    assert sorted(r["doc_id"] for r in three.collect()) == want

    four = stages["mix_sources"](spark, three, SF)
    taken = {r["id"]: r["taken"] for r in mixing.taken_words(three, block_words=corpus_pipeline.MIX_BLOCK_WORDS).collect()}
    got = defaultdict(int)
    pieces = four.collect()
    for r in pieces:
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["text"] in rows[r["doc_id"]]["text"]
    assert dict(got) == {i: n for i, n in taken.items() if n} and set(taken) == set(want)

    found = stages["best_fit_packing"](spark, four, SF).collect()
    check([(r["doc_id"], r["text"]) for r in pieces], found)
    whole = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(key, whole)) == Counter(map(key, found))


def test_odd_and_empty_input(spark):
    docs = frame(spark, odd_rows())
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, SF).count() > 0 and stage(spark, empty(spark), SF).count() == 0
    assert corpus_pipeline.STAGES[0][1](spark, empty(spark), SF).count() == 0
    assert packing.CAPACITY == 2048
