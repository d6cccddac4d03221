import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import prefix_trie, running, topk, whitening
from larkspur.llm.queries import QUERIES, SQL, op11_whitening

TURNS = "conv_id long, turn long, role string, text string, depth int, words string, rank int, part string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "w", 2, "p") for r in rows], TURNS)


def brute_trie(rows, rebuild=True):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own.setdefault(c, []).append((t is not None, t or 0, r, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest(), x))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        full[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]
    nodes = {}
    for c, v in full.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    kids, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    for k, m in nodes.items():
        own_saved = (len(m) - 1) * len(k[-1][1].encode().split()) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own_saved
            leaves[k[:d]] += not kids[k]
    ends = {k: ",".join(map(str, sorted(c for c in m if len(full[c]) == len(k)))) for k, m in nodes.items()}
    return sorted(
        (min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in nodes.items()
    )


def trie_rows(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def rebuilt(df):
    conv = F.col("conv")
    return prefix_trie.conversation_trie(df, F.crc32(conv.cast("string").cast("binary")) % 4, conv - conv % 20)


def shared(n=120, seed=1):
    """Conversations that share beginnings, some whole, with ties, nulls and repeated rows."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-60, 400), n):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, rng.choice([t, t, t, None, 0]), rng.choice(["user", "user", None]), rng.choice(["a b", "a b", "c", None, "", "d  e\tf"])))
    return rows + rows[:5] + [(None, 1, "user", "x"), (None, None, None, None)]


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_trie_against_brute_force(spark, coalesce):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, coalesce)
    try:
        rows = shared()
        assert trie_rows(rebuilt(turns(spark, rows))) == brute_trie(rows)
    finally:
        spark.conf.unset(key)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)], [(7, None, None, None)] * 3, [(5, 0, "user", "own turn only")], [(0, 0, "u", "word " * 40_000), (20, 0, "u", "word " * 40_000)]])
def test_trie_of_few_rows(spark, rows):
    assert trie_rows(rebuilt(turns(spark, rows))) == brute_trie(rows)


@pytest.mark.parametrize("turn_ids", ["up", "down", "mixed"])
def test_chains_of_conversations(spark, turn_ids):
    """Each conversation goes one turn on from the one before it: a chain of paths as long as the longest one, besides combs and copies."""
    n = 40
    ids = list(range(1, n + 1))
    if turn_ids == "down":
        ids.reverse()
    if turn_ids == "mixed":
        random.Random(2).shuffle(ids)
    rows = [(c, t, "u", f"t{t} w") for k, c in enumerate(ids) for t in range(k + 1)]
    rows += [(100 + c, t, "u", f"t{t} w" if t < c else f"side {c}") for c in range(0, n, 3) for t in range(c + 1)]
    rows += [(200 + c, t, "u", f"t{t} w") for c in range(20) for t in range(n)]
    got = trie_rows(prefix_trie.conversation_trie(turns(spark, rows)))
    assert got == brute_trie(rows, rebuild=False)


def test_peeling_halves_chains(spark):
    """A chain of 300 paths ends in a few rounds, not in 300."""
    n = 300
    rng = random.Random(5)
    names = rng.sample(range(10_000), n)
    paths = [(names[i], names[i - 1] if i else None, int(i == n - 1), i) for i in range(n)] + [(20_000 + i, names[i], 1, 1) for i in range(0, n, 7)]
    got = {r["id"]: (r["leaves"], r["saved"]) for r in prefix_trie.peeled(spark.createDataFrame(paths, "id long, parent long, leaves long, saved long"), rounds=14).collect()}
    want, kids = {}, {}
    for i, p, _, _ in paths:
        kids.setdefault(p, []).append(i)
    own = {i: (a, b) for i, _, a, b in paths}
    for i in [x for x in own if x >= 20_000] + names[::-1]:
        want[i] = tuple(own[i][j] + sum(want[k][j] for k in kids.get(i, [])) for j in (0, 1))
    assert got == want


def test_running_values_over_partitions(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        rng = random.Random(3)
        rows = [(rng.choice([1, 1, 1, 1, 2, 3]), i, rng.randrange(100), rng.randrange(2**31 - 600)) for i in range(400)]
        got = running.running(spark.createDataFrame(rows, "g long, at long, v long, s long"), "g", [F.col("at")], sums=("v",), series=("s",)).collect()
    finally:
        spark.conf.unset(key)
    state, want = {}, {}
    for g, at, v, s in rows:
        n, a, b = state.get(g, (0, 0, 0))
        after = (b + s * pow(running.BASES[0], n + 1, running.PRIMES[0])) % running.PRIMES[0]
        state[g] = (n + 1, a + v, after)
        want[at] = (g, *state[g], b)
    assert {r["at"]: (r["g"], r["rank"], r["v"], r["s"], r["s_before"]) for r in got} == want


VECTORS = "vec_id long, embedding array<float>, label int, whitened string, deviation string, v int, away int, id long, _vector int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "w", "d", 1, 2, 3, 4) for i, v in rows], VECTORS)


def points(n, d=12, seed=1):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.normal(size=(n, d)) * np.linspace(2, 0.5, d))]


ODD = [(900, None), (1000, [1.0, None] + [0.0] * 10), (1001, [float("nan")] * 12), (1100, [float("inf")] + [0.0] * 11), (None, [0.5] * 12), (1200, [0.25] * 12), (1200, [0.25] * 12), (1201, [0.25] * 5), (1300, [])]


def fixed(rows, width, offset=0):
    out = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.append((i, [math.floor(1024 * x) + offset for x in v] + [offset] * (width - len(v))))
    return out


@pytest.mark.parametrize("space", [8, 1])
def test_whitening_against_dense_eigenvectors(spark, space):
    rows = points(300) + ODD
    df = vectors(spark, rows)
    want = fixed(rows, 12, 100_000)
    x = np.array([v for _, v in want], float)
    n, s = len(x), [sum(v[j] for _, v in want) for j in range(12)]
    centred = x - x.mean(axis=0)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    model = whitening.fit(df, k=5, extra=3, space=space)
    assert model.n == n and list(model.sums) == s and np.allclose(model.variances, e[:5], rtol=1e-12) and np.allclose(model.explained, e[:5] / e.sum(), rtol=1e-10)
    assert np.abs(np.abs((model.directions * u[:, :5]).sum(axis=0)) - 1).max() < 1e-12 and model.residuals.max() < 1e-10 * e[0] and model.identity_error < 1e-9
    got = model.transform(df)
    assert got.columns == [*df.columns, "whitened_", "deviation_"]
    signs = np.sign((model.directions * u[:, :5]).sum(axis=0))
    left = {}
    for r in got.collect():
        left.setdefault(r["vec_id"], []).append((r["deviation_"], r["whitened_"]))
    for (i, v), row in zip(want, centred, strict=True):
        deviation, white = left[i].pop(0)
        assert deviation == sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True))
        assert np.allclose(white, row @ u[:, :5] * signs / np.sqrt(e[:5]), atol=1e-9)
    assert not any(left.values())


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 4, [(1, []), (2, [])]])
def test_nothing_to_whiten(spark, rows):
    got = whitening.whitened(vectors(spark, rows)).collect()
    assert len(got) == sum(v is not None for _, v in rows) and all(r["whitened_"] == [] and r["deviation_"] == 0 for r in got)


def test_fewer_components_than_asked(spark):
    """Three directions in eight dimensions, and a vector whose deviation is beyond a long."""
    rng = np.random.default_rng(4)
    x = rng.integers(-50, 50, size=(200, 3)) @ rng.integers(-3, 4, size=(3, 8))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    model = whitening.fit(vectors(spark, rows), k=6)
    assert model.directions.shape == (8, 3) and model.identity_error < 1e-10
    wide = whitening.whitened(vectors(spark, [(0, [1e30]), (1, [0.0]), (2, [5.0])])).collect()
    assert all(r["deviation_"] is None and len(r["whitened_"]) == 1 for r in wide)


def test_whitening_query(spark, sf):
    got = op11_whitening(spark, sf).toPandas()
    z = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(z.T @ z / len(z) - np.eye(8)).max() < 1e-9 and got["identity_error"].max() < 1e-9 and list(got.sort_values("component")["component"].unique()) == list(range(1, 9))


def brute_top(rows, every, k):
    v = fixed(rows, 12)
    out = []
    for a, (q, x) in enumerate(v):
        if q is not None and q % every == 0:
            scores = sorted((-sum(p * r for p, r in zip(x, y, strict=True)), c is None, c or 0, c) for b, (c, y) in enumerate(v) if a != b)
            out += [(q, r + 1, s[3], -s[0]) for r, s in enumerate(scores[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [16_384, 4])
def test_top_k_against_all_pairs(spark, block):
    rows = points(400) + ODD + [(2000 + i, [0.5, 0.5, 0.5] + [0.0] * 9) for i in range(60)]
    got = topk.top_k(vectors(spark, rows), F.col("id") % 20 == 0, k=7, block=block, seeds=4).collect()
    assert sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got), key=str) == brute_top(rows, 20, 7)


@pytest.mark.parametrize("rows", [[], [(0, None)], [(0, [1.0])], [(0, [1.0]), (100, [1.0]), (0, [1.0])], [(1, [1.0]), (2, [2.0])], [(0, []), (1, [])]])
def test_top_k_of_few_rows(spark, rows):
    got = topk.top_k(vectors(spark, rows), F.col("id") % 100 == 0).collect()
    assert sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got), key=str) == brute_top(rows, 100, 10)


def test_pivots_pass_over_rows():
    """Close groups: most scores are never computed, and the answer is that of all scores."""
    rng = np.random.default_rng(7)
    centres = rng.integers(-400, 400, size=(20, 16))
    x = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(size=(4000, 16)) * 8)
    x *= (np.linalg.norm(centres[0]) / np.linalg.norm(x, axis=1))[:, None]
    x = np.floor(x)
    q = x[::100]
    pivots = x[::200]
    best, made = topk.Best(len(q), 5), 0
    away, q_away, x2 = topk.distances(x, pivots), topk.distances(q, pivots), (x * x).sum(axis=1)
    for at in range(0, len(x), 1024):
        c = slice(at, at + 1024)
        for i in range(len(q)):
            made += topk.search_run(best, q, (q * q).sum(axis=1), q_away, np.array([i]), x[c], x2[c], away[c], np.arange(len(x))[c], np.zeros(len(x), bool)[c])
    want = np.array([[j for _, j in sorted((-s, j) for j, s in enumerate(x @ r))[:5]] for r in q])
    assert (best.id == want).all() and made < 0.6 * len(q) * len(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, name):
    """The registered SQL gives the same rows."""
    import duckdb

    con = duckdb.connect()
    for t in ("conversations", "embeddings", "documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    rel = con.execute(SQL[name])
    names = [c[0] for c in rel.description]
    got = QUERIES[name](spark, sf)
    assert sorted(names) == sorted(got.columns)
    plain = lambda rows: sorted(str(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)
    assert plain(rel.fetchall()) == plain(tuple(r[c] for c in names) for r in got.collect())
