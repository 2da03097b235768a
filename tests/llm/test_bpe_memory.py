"""What a tokenizer process keeps is bounded."""

import random

import public_tokenizers

from lakeloom.llm import bpe


def test_dictionary_stays_small():
    """200 000 distinct words leave fewer than 130 000 in memory, and one that has gone is encoded as before."""
    c = bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(3)
    first = c.encode(["zqxj vkwq"])
    for _ in range(20):
        c.encode([" ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(10_000))])
    assert len(c.ids) + len(c.older[0]) < 130_000
    assert " vkwq" not in c.ids and c.encode(["zqxj vkwq"]) == first
    c.rest()
