import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import exact_dedup, mixing, packing, simhash
from larkspur.llm.components import components
from larkspur.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, fp string, row int, owner string, size string"


def docs(spark, rows):
    """rows of (doc_id, text, source), with null and clashing columns besides."""
    return spark.createDataFrame([(i, t, None, s, None, "x", "y", 1, "z", "w") for i, t, s in rows], SCHEMA)


AWKWARD = [
    (0, "a b", "s"), (1, None, None), (2, "", "s"), (3, " \t\n", "t"), (4, "ab", "s"), (4, "ab", "s"), (None, "a  b ", None),
    (5, "word " * 30_000, "u"), (6, "word " * 30_000, "u"), (7, "naïve café 漢字 \U0001f600", "t"), (8, "x", "s"), (9, "a b", "s"),
]


def test_trie_against_dict():
    rng = random.Random(3)
    trie, plain = exact_dedup.Patricia(), {}
    for _ in range(3000):
        key = bytes(rng.choice(b"ab") for _ in range(rng.randrange(12)))
        node = trie.find(key)
        node.value = (node.value or 0) + 1
        plain[key] = plain.get(key, 0) + 1
    assert dict(trie.items()) == plain
    spilled = dict(trie.spill(0.5))
    assert spilled and not set(spilled) & set(dict(trie.items()))
    assert {**spilled, **dict(trie.items())} == plain
    assert trie.size == sum(exact_dedup.weight(x) for x in trie.root.children.values())
    before = dict(trie.items())
    gone = dict(trie.keep(lambda value: value % 2))
    assert gone == {k: v for k, v in before.items() if v % 2 == 0} and dict(trie.items()) == {k: v for k, v in before.items() if v % 2}
    for _ in range(20):
        gone |= dict(trie.spill(0.5))
    assert gone | dict(trie.items()) == before and not trie.root.children


def test_texts_share_the_nodes_of_their_beginnings():
    """200 texts with 1,700 bytes in common take a little more than their own endings, and one way to them."""
    head, trie = bytes(random.Random(5).randrange(33, 127) for _ in range(1700)), exact_dedup.Patricia()
    keys = [head + f"{i:04d}".encode() for i in range(200)]
    for k in keys:
        trie.find(k).value = 1
    assert trie.size < 1700 + 250 * 220 < sum(map(len, keys)) / 4
    assert {k for k, _ in trie.spill(0.9)} | {k for k, _ in trie.items()} == set(keys)
    assert trie.size < 1700 + 180 * 220


@pytest.mark.parametrize("budget", [300, 3000, 1 << 20])
def test_reducers_release_finished_keys(budget):
    """Partial groups in key order, of texts with long common beginnings: the same owners whatever the trie may hold."""
    rng = random.Random(8)
    texts = [b"x" * 300 + bytes(rng.choice(b"abc") for _ in range(rng.randrange(4))) for _ in range(200)]
    rows = sorted((*exact_dedup.place(t)[::-1], t, i, rng.randrange(1, 4), rng.randrange(5), rng.randrange(50), i) for i, t in enumerate(texts))
    cols = list(zip(*[(h, n, *r) for n, h, *r in rows], strict=True))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h", "len", "body", "grp", "n", "chars", "owner", "owner_row"])
    got = {r[0]: r[1:] for out in exact_dedup.merged_groups(budget)(iter([batch.slice(0, 90), batch.slice(90)])) for r in zip(*out.values(), strict=True)}
    for _, _, t, grp, *_ in rows:
        same = [r for r in rows if r[2] == t]
        chars, owner, row = min((-r[5], r[6], r[7]) for r in same)
        assert got[grp] == (sum(r[4] for r in same), owner, row)
    assert len(got) == len(texts)


@given(st.binary(max_size=40), st.binary(max_size=40))
def test_common_prefix(a, b):
    n = exact_dedup.common_prefix(a, b)
    assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


@pytest.mark.parametrize("budget", [64 << 20, 500])
def test_exact_groups(spark, budget):
    got = exact_dedup.exact_groups(docs(spark, AWKWARD), budget).collect()
    groups = {}
    for i, t, _ in AWKWARD:
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r"), []).append((-len(t or ""), 2**63 if i is None else i))
    assert len(got) == len(AWKWARD)
    for r in got:
        body = next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r["text_sha256"])
        best = min(groups[body])[1]
        assert r["group_size"] == len(groups[body]) and r["keep_id"] == (None if best == 2**63 else best)
    assert sum(r["kept"] for r in got) == len(groups)
    kept = exact_dedup.drop_copies(docs(spark, AWKWARD), budget)
    assert kept.count() == len(groups) and kept.columns == docs(spark, AWKWARD).columns
    assert exact_dedup.exact_groups(docs(spark, []), budget).count() == 0


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("most", [20_000, 3])
def test_links_against_brute_force(spark, most):
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(450):
        x = rng.choice(fps)
        for _ in range(rng.randrange(1, 7)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps = sorted(set(fps), key=lambda x: np.array(x, np.uint64).view(np.int64).item())
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r["node"]: r["root"] for r in components(simhash.links(nodes, most=most)).collect()}
    want = brute_components(fps)
    assert [got.get(x, x) for x in signed] == [signed[w] for w in want]


def test_near_groups(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in simhash.near_groups(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    fps = [brute_fp(t) for _, t in sorted(rows)]
    roots = brute_components(fps)
    ids = [i for i, _ in sorted(rows)]
    assert [(got[i]["fingerprint"], got[i]["component_id"]) for i in ids] == [(f"{f:016x}", ids[r]) for f, r in zip(fps, roots, strict=True)]
    odd = simhash.near_groups(docs(spark, AWKWARD)).collect()
    assert len(odd) == len(AWKWARD) and simhash.near_groups(docs(spark, [])).count() == 0
    assert simhash.drop_near(docs(spark, AWKWARD)).columns == docs(spark, []).columns


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(200)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(1, 200)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_mixing(spark, sf):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), docs(spark, AWKWARD)):
        rows = mixing.mixed(df).collect()
        assert len(rows) == df.count()
        by = {}
        for r in rows:
            by.setdefault(r["source"], []).append(r)
            assert 0 <= r["taken"] <= 2 * r["size"]
        names = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in by)
        weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
        size = {s: sum(r["size"] for r in by[s]) for s in names}
        left, target, free = 1.5 * sum(size.values()), {}, set(names)
        while free:
            level = left / sum(weights[s] for s in free)
            over = {s for s in free if level * weights[s] > 2 * size[s]}
            for s in over or free:
                target[s] = 2 * size[s] if over else level * weights[s]
            if not over:
                break
            left -= sum(target[s] for s in over)
            free -= over
        for s in names:
            assert abs(by[s][0]["target"] - target[s]) < 1e-6 * max(1, target[s])
            assert sum(r["taken"] for r in by[s]) == round(target[s])
    assert mixing.mixed(docs(spark, [])).count() == 0


def test_mixture_takes_the_words(spark):
    df = docs(spark, AWKWARD)
    want = sum(r["taken"] for r in mixing.mixed(df).collect())
    out = mixing.mixture(df)
    assert out.columns == df.columns
    assert sum(len((r["text"] or "").encode().split()) for r in out.collect()) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_best_fit_against_one_by_one(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.best_fit_decreasing(counts, 64)
    rooms, placed = [], []
    for n in sorted(lengths, reverse=True):
        fit = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fit:
            r, i = min(fit)
        else:
            i, r = len(rooms), 64
            rooms.append(64)
        rooms[i] -= n
    used = {}
    for n in counts:
        runs = sorted(x for x in plan if x[0] == n)
        for k in range(counts[n]):
            _, rank, first, at = [x for x in runs if x[1] <= k][-1]
            used.setdefault(first + k - rank, []).append((at, n))
    for parts in used.values():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at <= 64
    assert sorted(64 - sum(n for _, n in p) for p in used.values()) == sorted(rooms)


def test_packing(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    t.encode_special_tokens = False
    extra = [(-1, "", "s"), (-2, None, None), (-3, "ΑΣ ΣΑΣ. ǅabc İx i̇ ... don't 're THE'LL <|endoftext|> éé a\x1cb c", "s"), (-4, "z" * 20_000 + "!?" * 9000, "s"), (-4, "q.Q! 12ab ½ Ωß ẞ.", None), (None, "hi", None)]
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), docs(spark, extra)):
        got = packing.packed(df, tokenizer_file()).collect()
        ids = {}
        for r in df.collect():
            ids.setdefault(r["doc_id"], []).append(np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4"))
        windows, seen = {}, {}
        for r in got:
            assert any(len(a) == r["doc_tokens"] and zlib.crc32(a[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for a in ids[r["doc_id"]])
            windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
        assert seen == {k: sum(map(len, v)) for k, v in ids.items()}
        for parts in windows.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 4096
    assert packing.packed(docs(spark, []), tokenizer_file()).count() == 0


CLASHES = ("h", "len", "__row", "row", "grp", "__keep", "_near_id", "_near_mark", "_mix_size", "_mix_place", "_mix_cut", "__words", "__turn", "__id", "skey", "bucket", "place", "size", "part", "whole", "file")


@pytest.mark.parametrize("stage", [exact_dedup.drop_copies, simhash.drop_near, mixing.mixture])
def test_clashing_names(spark, stage):
    df = spark.createDataFrame([(i, t, s, *[j + 7 for j in range(len(CLASHES))]) for i, t, s in AWKWARD], "doc_id long, text string, source string, " + ", ".join(f"`{c}` long" for c in CLASHES))
    out = stage(df)
    assert out.columns == df.columns
    got = out.collect()
    assert got and all([r[c] for c in CLASHES] == [j + 7 for j in range(len(CLASHES))] for r in got)
    assert sorted(map(str, stage(df.drop(*CLASHES)).collect())) == sorted(map(str, out.drop(*CLASHES).collect()))


def test_one_row_of_each_component(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(3, text, "s"), (3, text, "s"), (3, "quite another text of five words", "s"), (None, text, "s"), (1, "quite another text of five words", None), (None, "", "s"), (None, None, "s")]
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in simhash.drop_near(docs(spark, rows)).collect())
    assert got == sorted([("3", text), ("1", "quite another text of five words"), ("None", "")])


def test_mixture_of_null_ids_and_odd_characters(spark):
    odd = "a1 b c d e f  g h"
    rows = [(None, " ".join([f"{s}{i}"] * n), s) for s, n in (("p", 20), ("q", 200), ("r", 20)) for i in range(20)] + [(9, odd, "z")]
    plan = {r["source"]: r["target"] for r in mixing.mixed(docs(spark, rows)).collect()}
    out = mixing.mixture(docs(spark, rows)).collect()
    words = {}
    for r in out:
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].encode().split())
    assert {s: words.get(s, 0) for s in plan} == {s: int(t + 0.5) for s, t in plan.items()}
    assert all(odd.startswith(r["text"]) for r in out if r["doc_id"] == 9)


@pytest.mark.parametrize("n", [0, 1, 3, 7, 8])
def test_a_text_is_cut_after_its_nth_word(spark, n):
    """The fractional repetition of one source is a prefix that ends with the word."""
    text = " \t a1  b\nc d e f\x0bg h  "
    got = [r["text"] for r in mixing.mixture(docs(spark, [(1, text, "s")]), share=n / 7).collect()]
    ends = [i for i in range(1, len(text) + 1) if text[i - 1] not in " \t\n\x0b" and (i == len(text) or text[i] in " \t\n\x0b")]
    whole, part = divmod(n, len(ends))
    assert got == [text] * whole + ([text[: ends[part - 1]]] if part else [])


def test_readings_split_otherwise(spark, sf, tmp_path):
    """Exact and suffix dedup give equal rows when the default parallelism falls between two readings."""
    from larkspur.llm import suffix_dedup

    df = spark.read.parquet(f"{sf}/documents.parquet").repartition(4)
    df.write.parquet(str(tmp_path / "d"))
    read = lambda: spark.read.parquet(str(tmp_path / "d"))
    want = sorted(map(str, suffix_dedup.without_repeats(read()).drop("kept").collect()))
    owners = sorted(map(str, exact_dedup.exact_groups(read()).drop("row", "keep_row").collect()))
    key, whole = "spark.sql.leafNodeDefaultParallelism", suffix_dedup.stored

    def between(x):
        out = whole(x)
        if {"ranges", "body"} & set(x.columns):
            spark.conf.set(key, "1")
        return out

    try:
        spark.conf.set(key, "64")
        suffix_dedup.stored = exact_dedup.stored = between
        assert sorted(map(str, suffix_dedup.without_repeats(read()).drop("kept").collect())) == want
        spark.conf.set(key, "64")
        assert sorted(map(str, exact_dedup.exact_groups(read()).drop("row", "keep_row").collect())) == owners
    finally:
        suffix_dedup.stored = exact_dedup.stored = whole
        spark.conf.unset(key)


def test_padding(spark, sf):
    got = packing.packed(spark.read.parquet(f"{sf}/documents.parquet"), tokenizer_file()).collect()
    fill, padded = {}, {}
    for r in got:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
        padded.setdefault(r["sequence_id"], set()).add(r["padded"])
    assert all(padded[s] == {n if n & (n - 1) == 0 else 4096} for s, n in fill.items())
    assert sorted(fill) == list(range(len(fill)))
    assert sum(next(iter(p)) - fill[s] for s, p in padded.items()) < 0.1 * sum(fill.values())


def test_special_tokens_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    t, text = Tokenizer.from_file(tokenizer_file()), "One<|endoftext|>two <|startoftext|> Don't <|endoftext| > é"
    (got,) = packing.packed(docs(spark, [(1, text, "s")]), tokenizer_file()).collect()
    want = [*t.encode(text, add_special_tokens=False).ids, 2]
    assert 49407 in want and (got["length"], got["ids_crc32"]) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()))


def test_very_long_texts(spark):
    """One text of 3 MB among short ones, twice: equal groups, one component, its words and all its tokens."""
    long = " ".join(f"w{i % 7919}" for i in range(450_000))
    rows = [(1, long, "s"), (2, long + " ", "t"), (3, "short one", "s"), (4, None, None)]
    groups = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs(spark, rows)).collect()}
    assert groups[1]["keep_id"] == groups[2]["keep_id"] == 2 and groups[1]["group_size"] == 2 and [r["doc_id"] for r in exact_dedup.drop_copies(docs(spark, rows)).orderBy("doc_id").collect()] == [2, 3, 4]
    near = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs(spark, rows)).collect()}
    assert near[1] == near[2] == 1 and near[3] == 3
    assert {r["doc_id"]: r["size"] for r in mixing.mixed(docs(spark, rows)).collect()} == {1: 450_000, 2: 450_000, 3: 2, 4: 0}
    pieces = packing.packed(docs(spark, rows), tokenizer_file()).collect()
    for i in (1, 2):
        mine = sorted((r["start"], r["length"], r["doc_tokens"]) for r in pieces if r["doc_id"] == i)
        assert sum(n for _, n, _ in mine) == mine[0][2] > 450_000 and all(n == 4096 for _, n, _ in mine[:-1])


def test_near_groups_broadcast_nothing(spark, sf, monkeypatch):
    import importlib

    plans = []

    def kept(df):
        out = common_cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    common_cut = simhash.cut
    monkeypatch.setattr(importlib.import_module("larkspur.llm.components"), "cut", kept)
    monkeypatch.setattr(simhash, "cut", kept)
    texts = spark.read.parquet(f"{sf}/documents.parquet")
    for out in (simhash.near_groups(texts), simhash.drop_near(texts)):
        out.collect()
        plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 8 and not [p for p in plans if "Broadcast" in p]
