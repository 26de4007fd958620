"""Paragraphs that name several licences."""

from gridloom.llm import licenses
from gridloom.llm.common import documents
from tests.llm.helpers import frame


def test_all_licences_of_a_paragraph_are_found(spark):
    plain = "the river ran past the old mill and children played near the water in summer " * 12
    mit, apache = licenses.FAMILIES["MIT"][1][0], licenses.FAMILIES["Apache-2.0"][1][0]
    texts = {
        1: (f"{plain} {mit} {plain} {apache} {plain}", {"MIT", "Apache-2.0"}),
        2: ("Licensed under the MIT License or the Apache License, Version 2.0.", {"MIT", "Apache-2.0"}),
        3: (f"{plain} {licenses.FAMILIES['LGPL'][1][0]} {plain}", {"LGPL"}),
        4: ("This work is licensed under the CC BY-SA 4.0.", {"CC-BY-SA"}),
        5: (plain, set()),
    }
    model = licenses.train(documents(spark, "/root/testdata/sf0.01"))
    found = licenses.scan(frame(spark, [(i, t, None, None) for i, (t, _) in texts.items()]), model).collect()
    assert {r["id"]: {x["family"] for x in r["found"]} for r in found} == {i: want for i, (_, want) in texts.items()}
