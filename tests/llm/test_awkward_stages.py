"""Each stage of the pipeline over odd rows and an empty table."""

import pytest

import corpus_pipeline
from larkspur.llm import packing
from larkspur.llm.queries import tokenizer_file

from .test_dedup_mix_pack import AWKWARD, docs


@pytest.mark.parametrize("rows", [AWKWARD, [], [(None, None, None)] * 3, [(1, "", ""), (1, "", "")]])
def test_stages(spark, sf, rows):
    df = docs(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, sf)
        got = out.collect()
        if name != "packing":
            assert out.columns == df.columns
        if name in ("quality", "exact", "near"):
            assert len(got) <= len(rows)
        if name == "packing":
            assert len(got) >= len(rows)


def test_plain_split_is_the_tokenizers(spark):
    """Pieces split here against the tokenizer, over characters on both sides of the plain range."""
    import random

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    t.encode_special_tokens = False
    rng, ids = random.Random(1), packing.WordIds(tokenizer_file(), most=3000)
    alphabet = "abcxyzABCIS's't're'll'  \n\t\r.,!?-_09½²ªºßÀÉéñçœİıſΣςσ漢字́  \u0085\x1c­<|endoftext|>"
    for _ in range(40):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(40)]
        for text, buf in zip(texts, ids.encode(texts), strict=True):
            want = t.encode(text, add_special_tokens=False).ids
            assert list(memoryview(buf).cast("I")) == want, text
