import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import langid, licenses, toxicity
from gridloom.llm.common import documents, held_out, labels
from tests.llm.helpers import clashing, empty, frame, odd_rows

SF = "/root/testdata/sf0.01"


def test_held_out_rule(spark):
    rows = [(i, "x", None, None) for i in range(50)]
    got = {r["doc_id"]: r["h"] for r in frame(spark, rows).select("doc_id", held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)}


def test_language_accuracy_on_held_out_rows(spark):
    docs = documents(spark, SF)
    found = langid.op9_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 150 and sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.97


def test_toxicity_on_held_out_rows(spark):
    found = toxicity.op5_toxicity(spark, SF).join(labels(spark, SF), "doc_id").where("held_out").collect()
    hits = sum(r["predicted"] == r["toxic"] for r in found)
    assert len(found) > 60 and hits / len(found) > 0.9  # few rows to learn from here
    assert all(0 <= r["score"] <= 1 and (r["score"] >= 0.3) == bool(r["predicted"]) for r in found)


def test_language_of_odd_texts(spark):
    docs = documents(spark, SF)
    model = langid.train(docs)
    odd = clashing(frame(spark, odd_rows())).withColumn("Lang_Pred", F.lit("x"))
    found = langid.identify(odd, model)
    assert found.columns == [c for c in odd.columns if c not in ("score", "Lang_Pred")] + ["lang_pred", "score"]
    found = found.collect()
    assert len(found) == len(odd_rows())
    for r in found:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
        assert letters or r["score"] == 0
    long = frame(spark, [(1, "der die und " * 200_000, None, None), (2, "der die und " * 20, None, None)])
    assert {r["lang_pred"] for r in langid.identify(long, model).collect()} == {"de"}


def test_scores_depend_on_the_text_alone(spark):
    docs, label_rows = documents(spark, SF), labels(spark, SF)
    model, lang = toxicity.train(docs, label_rows), langid.train(docs)
    sample = docs.limit(40)
    twice = sample.unionByName(sample.withColumns({"doc_id": F.lit(7).cast("long"), "lang": F.lit(None).cast("string"), "source": F.lit("zz")}))
    for out in (toxicity.score(twice, model), langid.identify(twice, lang)):
        assert out.groupBy("text").agg(F.count_distinct("score").alias("n")).where("n > 1").count() == 0


def brute_buckets(text, orders, bits):
    """The bucket of each n-gram, in whole numbers, one after the other."""
    points, roll, final, top = [ord(c) + 1 for c in f" {(text or '').lower()} "], 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 2**64
    out = Counter()
    for n in orders:
        for at in range(len(points) - n + 1):
            h = 0
            for c in points[at : at + n]:
                h = (h * roll + c) % top
            out[((h + n) * final % top) >> (64 - bits)] += 1
    return out


def test_language_scores_match_a_plain_loop(spark):
    """Counts, smoothing, priors and posteriors from dictionaries, on a small table."""
    rows = [(i, t, lang, s) for i, t, lang, s in odd_rows(n=25) if len(t or "") < 5000]
    docs = frame(spark, rows)
    learn = [(t, lang) for i, t, lang, _ in rows if lang and zlib.crc32(("" if i is None else str(i)).encode()) % 4 != 2]
    languages, size = sorted({lang for _, lang in learn}), 1 << langid.BITS
    counts = {x: sum((brute_buckets(t, langid.ORDERS, langid.BITS) for t, lang in learn if lang == x), Counter()) for x in languages}
    logs = {x: math.log(sum(c.values()) + langid.SMOOTHING * size) for x, c in counts.items()}
    found = langid.identify(docs, langid.train(docs)).collect()
    for r in found:
        if any(c.isalpha() for c in r["text"] or ""):
            own = brute_buckets(r["text"], langid.ORDERS, langid.BITS)
            total = {x: math.log(sum(lang == x for _, lang in learn) / len(learn)) + sum(n * (math.log(counts[x][b] + langid.SMOOTHING) - logs[x]) for b, n in own.items()) for x in languages}
            best = max(languages, key=total.get)
            score = 1 / sum(math.exp(v - total[best]) for v in total.values())
            assert r["score"] == pytest.approx(score, abs=2e-3) and (r["lang_pred"] == best or score < 0.51)


def test_toxicity_scores_match_a_plain_loop(spark):
    docs = documents(spark, SF)
    model = toxicity.train(docs, labels(spark, SF))
    assert 100 < np.count_nonzero(model.weights) < 1 << toxicity.BITS
    rows = [tuple(r) for r in docs.select("doc_id", "text").limit(30).collect()] + [(-1, None), (-2, ""), (-3, "long words " * 3000)]
    found = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string").withColumn("SCORE", F.lit("x")), model)
    assert found.columns == ["doc_id", "text", "score"]
    for r in found.collect():
        total = sum(float(model.weights[b]) for b in brute_buckets(r["text"], toxicity.ORDERS, toxicity.BITS)) + model.bias
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-5)


def test_toxic_documents_are_found(spark):
    """A larger table: held-out recall and precision. Some labels of the table contradict their texts."""
    large = "/root/testdata/sf0.1"
    found = toxicity.op5_toxicity(spark, large).join(labels(spark, large), "doc_id").where("held_out").collect()
    both = sum(r["predicted"] and r["toxic"] for r in found)
    assert both >= 0.9 * sum(r["toxic"] for r in found) and both >= 0.85 * sum(r["predicted"] for r in found)


def test_labels_of_one_class(spark):
    docs = frame(spark, odd_rows())
    for y in (0, 1):
        table = docs.select("doc_id", F.lit(y).alias("toxic")).distinct()
        scores = {r["score"] for r in toxicity.score(docs, toxicity.train(docs, table)).collect()}
        assert len(scores) == 1 and abs(scores.pop() - y) < 0.01


def test_nothing_to_learn_from(spark):
    none = langid.train(empty(spark))
    assert {r["lang_pred"] for r in langid.identify(frame(spark, odd_rows()), none).collect()} == {"und"}
    blank = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    model = toxicity.train(empty(spark), blank)
    scored = toxicity.score(frame(spark, odd_rows()), model).collect()
    assert len(scored) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.score(empty(spark), model).count() == 0 and langid.identify(empty(spark), none).count() == 0


LICENSE_LINES = {
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "All rights reserved.": "Proprietary",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "BSD",
    "# SPDX-License-Identifier: Apache-2.0 License": "Apache-2.0",
}


def test_license_families(spark):
    docs = documents(spark, SF)
    model = licenses.train(docs)
    filler = docs.first()["text"]
    rows = [(k, f"{filler}\n{line}\n{filler}", "en", "a") for k, line in enumerate(LICENSE_LINES)]
    rows += [(100 + k, text, "en", "a") for k, text in enumerate(licenses.SOUNDS_ALIKE[:4])] + odd_rows(n=30)
    found = licenses.scan(clashing(frame(spark, rows)), model).collect()
    want = dict(enumerate(LICENSE_LINES.values()))
    first = {}
    for r in found:
        if r["found"]:
            first.setdefault(r["id"], []).append([x["family"] for x in r["found"]])
    assert all([want[k]] in first.get(k, []) for k in want), first
    assert not set(first) & set(range(100, 110))
    assert licenses.scan(empty(spark), model).count() == 0


#: Wordings, licences, denials and prose that training doesn't see.
NEW_NOTICES = ("You may use, copy and change these files under the {}.", "Source and data: {}, see the file in the root folder.", "All of our code has been published under the {} since last year", "(c) 2021 The authors, {}", "By contributing you agree that your work is covered by the {}")
NEW_OTHERS = ("Intel Open Source License", "Sleepycat License", "Sun Public License", "OpenSSL License", "Ruby License", "Vim License", "IBM Public License Version 1.0", "NASA Open Source Agreement 1.3", "Historical Permission Notice and Disclaimer", "Creative Archive Licence", "GNU Free Documentation License 1.3", "Q Public License 1.0", "Nokia Open Source License")
NEW_DENIALS = ("Nothing here is licensed under the {}.", "The {} doesn't apply here.", "This is not covered by the {}.", "It was never available under the {}.")
PROSE = (
    "The licence fee for a television set rose again, and the public was not pleased with the version that the paper printed.",
    "He redistributed the notices to all copies of the software of the office, with or without the permission of the lawyer.",
    "A driving licence may be obtained free of charge by any person who passes the test under the terms of the act.",
    "The general public had the right to modify the terms of the agreement, provided that the following conditions were met by the bank.",
    "The apache helicopter, version two, is distributed to bases on an as needed basis.",
    "distributed under the terms of the",
)


def test_unseen_license_notices(spark):
    """Names in wordings that training doesn't have, against other licences, denials and prose: precision and recall."""
    model = licenses.train(documents(spark, SF))
    want = [(n.format(x), family) for family, (names, _) in licenses.FAMILIES.items() for x in names if family != "Proprietary" for n in NEW_NOTICES]
    want += [(n.format(x), None) for x in NEW_OTHERS for n in (*NEW_NOTICES, *licenses.NOTICES)] + [(d.format(x), None) for family in ("MIT", "Apache-2.0", "GPL", "BSD", "CC-BY") for x in licenses.FAMILIES[family][0] for d in NEW_DENIALS] + [(t, None) for t in PROSE]
    rows = [(k, t, "en", "a") for k, (t, _) in enumerate(want)]
    got = {r["id"]: {x["family"] for x in r["found"]} for r in licenses.scan(frame(spark, rows), model).collect()}
    right = sum(family in got[k] for k, (_, family) in enumerate(want) if family)
    said = sum(len(v) for v in got.values())
    missed = [want[k] for k, (_, family) in enumerate(want) if family and family not in got[k]]
    false = [(want[k], got[k]) for k in got if got[k] - {want[k][1]}]
    print(len(want), right, said, missed[:20], false[:20])
    assert right >= 0.9 * sum(family is not None for _, family in want) and right >= 0.9 * said


def test_license_scores_match_a_plain_loop(spark):
    """The model's sums over words and word pairs, window by window, one after the other."""
    from gridloom.llm.words import NOT_ALNUM, Reader

    texts = ["Released under the MIT License.", "word " * 130 + "Licensed under CC BY-NC 4.0.", "x", "a b\n\nc d e"]
    model = licenses.fit(*[f(x) for f, x in zip((list, np.array), licenses.examples(["some plain words of a corpus"] * 50))])
    import pyarrow as pa

    (slab,) = Reader(NOT_ALNUM, True).slabs(pa.array(texts))
    windows = licenses._windows(slab.word)
    one, two = licenses.buckets_of(slab.hash)
    for (_, start, end), got in zip(zip(*windows), model.logits(slab, windows)):
        total = model.bias + sum(model.weights[one[k]].astype(float) for k in range(start, end)) + sum(model.weights[two[k]].astype(float) for k in range(start, end - 1))
        assert got == pytest.approx(total, abs=1e-6) and end - start <= licenses.WINDOW
    assert [int(x) for x in np.bincount(windows[0])] == [1, 3, 1, 1, 0, 1]


def test_license_scan_of_odd_texts(spark):
    """Nulls, empties, null ids and a very long line, row by row."""
    model = licenses.train(empty(spark))
    long = "word " * 300_000 + "Released under the MIT License. " + "word " * 1000
    rows = [(1, None, None, None), (2, "", None, None), (None, "Released under the MIT License.", None, None), (3, "\n\nReleased under the MIT License.\nReleased under the MIT License.", None, None), (4, long, None, None)]
    got = {r["id"]: (r["paragraphs"], [(x["paragraph"], x["family"]) for x in r["found"]]) for r in licenses.scan(clashing(frame(spark, rows)), model).collect()}
    assert got == {1: (1, []), 2: (1, []), None: (1, [(0, "MIT")]), 3: (4, [(2, "MIT"), (3, "MIT")]), 4: (1, [(0, "MIT")])}


def test_license_lines_of_the_corpus_are_found(spark):
    docs = documents(spark, SF)
    found = {r["doc_id"]: r["license_paragraphs"] for r in licenses.op7_license_scan(spark, SF).collect()}
    want = {r["doc_id"] for r in docs.collect() if any(line in LICENSE_LINES for line in r["text"].split("\n"))}
    got = {k for k, n in found.items() if n}
    assert len(want) >= 5 and want <= got and len(got - want) <= 1
