"""Ids of texts with special tokens, as the JSON tokenizer gives them without any switch."""

import public_tokenizers
from tokenizers import Tokenizer

from gridloom.llm import packing
from tests.llm.helpers import frame


def test_special_tokens_are_single_ids(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y ", "<|endoftext|", "<|ENDOFTEXT|> z", " \n<|endoftext|>\n\n t", "<|<|endoftext|>|>"]
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r["id"]: r["ids"] for r in packing.token_pieces(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]), with_ids=True).collect()}
    for i, text in enumerate(texts):
        assert found[i] == [*coder.encode(text, add_special_tokens=False).ids, packing.END]
    assert found[0].count(50256) == 1
