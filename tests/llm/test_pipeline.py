import numpy as np
import pytest

import corpus_pipeline
from larkspur.llm import mixing, quality
from larkspur.llm.queries import tokenizer_file

from .test_dedup_mix_pack import brute_components, brute_fp


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The rows after each stage."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        f(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:5])


def test_each_filter_against_brute_force(spark, sf, stages):
    docs, good, exact, near = map(rows, stages[:4])
    predicted = {r["doc_id"] for r in quality.classified(stages[0], spark.read.parquet(f"{sf}/labels.parquet")).filter("predicted = 1").collect()}
    assert set(good) == predicted and 0.5 * len(docs) < len(good) < len(docs)
    groups = {}
    for i, t in good.items():
        groups.setdefault(b"".join(t.encode().split()), []).append((-len(t), i))
    assert set(exact) == {min(g)[1] for g in groups.values()}
    ids = sorted(exact)
    roots = brute_components([brute_fp(exact[i]) for i in ids])
    assert set(near) == {ids[r] for r in roots}
    assert all(docs[i] == t for i, t in near.items())


def test_mixture_and_windows(stages):
    from tokenizers import Tokenizer

    plan = {r["doc_id"]: r for r in mixing.mixed(stages[3]).collect()}
    texts, near = {}, rows(stages[3])
    for r in stages[4].collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    for i, p in plan.items():
        got = texts.get(i, [])
        assert got.count(near[i]) == p["whole"] + (p["part"] == p["size"] > 0)
        for t in got:
            assert near[i].startswith(t)
        assert sum(len(t.encode().split()) for t in got) == p["taken"]
    t = Tokenizer.from_file(tokenizer_file())
    t.encode_special_tokens = False
    want = sorted((i, len(t.encode(x, add_special_tokens=False).ids) + 1) for i, xs in texts.items() for x in xs)
    pieces = stages[5].collect()
    assert sorted((r["doc_id"], r["doc_tokens"]) for r in pieces if r["start"] == 0) == want
    assert sum(r["length"] for r in pieces) == sum(n for _, n in want)
    fill = np.bincount([r["sequence_id"] for r in pieces], [r["length"] for r in pieces])
    assert fill.max() <= 4096 and fill.mean() > 0.9 * 4096


def test_run(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() == stages[5].count()
