import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import html_extract, quality, sharding

from .test_dedup_mix_pack import AWKWARD, docs

# quality


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=5), st.integers(0, 10**6))
def test_marginals_against_enumeration(counts, seed):
    rng = np.random.default_rng(seed)
    unary, steps = rng.normal(size=sum(counts)) * 2, rng.normal(size=(2, 2)) * 2
    odds, _, _ = quality.Chains(np.array(counts)).marginals(unary, steps)
    at = 0
    for n in counts:
        total = np.zeros((n, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(unary[at + i] * y[i] for i in range(n)) + sum(steps[a][b] for a, b in itertools.pairwise(y)))
            for i in range(n):
                total[i][y[i]] += w
        assert np.allclose(odds[at : at + n], np.log(total[:, 1] / total[:, 0]))
        at += n


def test_gradient_raises_likelihood():
    rng = np.random.default_rng(1)
    counts = np.array([3, 1, 5, 4])
    x, y = rng.normal(size=(13, 4)), rng.integers(0, 2, 13).astype(float)
    chains = quality.Chains(counts)

    def likelihood(f):
        total = at = 0
        for n in counts:
            u = x[at : at + n] @ f.weights
            score = lambda z: sum(u * z) + sum(f.steps[a][b] for a, b in itertools.pairwise(z))  # noqa: E731, B023
            total += score(y[at : at + n].astype(int)) - math.log(sum(math.exp(score(np.array(z))) for z in itertools.product((0, 1), repeat=n)))
            at += n
        return total - 0.5 * (f.weights @ f.weights + (f.steps**2).sum())

    got = quality.fit_field(x, y, chains, rounds=400)
    best = likelihood(got)
    for _ in range(40):
        near = quality.Field(got.weights + rng.normal(size=4) * 0.05, got.steps + rng.normal(size=(2, 2)) * 0.05)
        assert likelihood(near) <= best + 1e-3


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.classified(d, labels).collect()}
    assert len(got) == d.count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [r for r in labels.collect() if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    assert np.mean([got[r["doc_id"]]["predicted"] == r["quality"] for r in held]) >= 0.95
    again = {r["doc_id"]: r["score"] for r in quality.classified(d.repartition(5), labels).collect()}
    assert all(abs(again[i] - r["score"]) < 1e-9 for i, r in got.items())
    assert quality.good_documents(d, labels).count() == sum(r["predicted"] for r in got.values())


def test_quality_of_awkward_rows(spark):
    labels = spark.createDataFrame([(0, 1, 0), (5, 0, None), (5, 1, 0), (4, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classified(docs(spark, AWKWARD), labels).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got)
    none = quality.classified(docs(spark, AWKWARD), labels.limit(0)).collect()
    assert all(r["score"] == 1 and r["predicted"] == 1 for r in none)
    assert quality.classified(docs(spark, []), labels).count() == 0
    assert quality.good_documents(docs(spark, AWKWARD), labels.limit(0)).columns == docs(spark, []).columns


def plain_score(field, text):
    """The same field, line by line: products of weights over all labellings of a chain, added from the left and from the right."""
    lines = quality.document_lines(text)
    x, sizes = quality.line_features(lines)
    zero = [0.0] * x.shape[1]
    unary = []
    for i in range(len(lines)):
        near = [*x[i], *(x[i - 1] if i else zero), *(x[i + 1] if i + 1 < len(lines) else zero)]
        unary.append(sum(float(a) * float(b) for a, b in zip(near, field.weights, strict=True)))
    n, s = len(lines), field.steps
    left, right = [[0.0, 0.0] for _ in range(n)], [[0.0, 0.0] for _ in range(n)]
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    for i in range(n):
        for y in (0, 1):
            left[i][y] = y * unary[i] + (add(left[i - 1][0] + s[0][y], left[i - 1][1] + s[1][y]) if i else 0.0)
    for i in range(n - 2, -1, -1):
        for y in (0, 1):
            right[i][y] = add(s[y][0] + right[i + 1][0], s[y][1] + unary[i + 1] + right[i + 1][1])
    good = bad = 0.0
    for i in range(n):
        p = 1 / (1 + math.exp(min(700.0, max(-700.0, left[i][0] + right[i][0] - left[i][1] - right[i][1]))))
        good, bad = good + (sizes[i] + 1) * p, bad + (sizes[i] + 1) * (1 - p)
    z = field.curve[0] * (math.log(good + 1e-3) - math.log(bad + 1e-3)) + field.curve[1]
    return 1 / (1 + math.exp(-z))


def test_scores_against_a_plain_scorer(spark, sf):
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    field = quality.learn(d, labels)
    got = {r["doc_id"]: r["score"] for r in quality.classified(d, labels).collect()}
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    texts |= {-1: "", -2: "one line only", -3: "x\n" * 3000}
    extra = {i: float(quality.scores(field, [texts[i]])[0]) for i in (-1, -2, -3)}
    for i, t in texts.items():
        assert abs(plain_score(field, t) - (extra | got)[i]) < 1e-6, i


def test_learning_sample_is_bounded(spark):
    """Repeated doc_ids give one row each, texts are whole, and those that don't fit in the lines left are passed over."""
    rows = [(i, "\n".join([f"good line {i}."] * (n + i)), "s") for i in range(30) for n in ((3, 5) if i % 3 else (4000,))]
    whole_texts = {n + i for i in range(30) for n in ((3, 5) if i % 3 else ())}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    seen = []
    whole = quality.train
    quality.train = lambda f, s, q: seen.append(([len(x) for x in f], len(q))) or whole(f, s, q)
    try:
        for lines in (50, 1 << 20, 0):
            quality.learn(docs(spark, rows), labels, most=10, most_lines=lines)
    finally:
        quality.train = whole
    assert 1 <= seen[0][1] < 10 and sum(seen[0][0]) <= 50 and set(seen[0][0]) <= whole_texts
    assert seen[1][1] == 10 and max(seen[1][0]) > 4000
    assert seen[2] == ([], 0)


def test_good_documents_with_clashing_names(spark, sf):
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    names = ("id", "mark", "quality", "lines", "sizes", "n", "held_out", "score", "predicted", "r")
    out = quality.good_documents(d.selectExpr("*", *[f"'{n}' AS `{n}`" for n in names]), labels)
    assert out.columns == [*d.columns, *names]
    got = out.collect()
    assert got and all([r[n] for n in names] == list(names) for r in got)
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in quality.classified(d, labels).filter("predicted = 1").collect())


# html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>x";</script></head><body>
<header>Site name</header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article class="post"><header><h1>Head &amp; line</h1></header><p>One<b>two</b> thr<i>ee</i> <!-- no > comment -->x<br>y
<p class="ad">advert<p>after<ul><li>a<li>b</ul><table><tr><td>1<td>2</table>
<div id="comments"><p>first!</p></div><form><input><p>f</p></form><aside>s</aside><p title="a>b">&eacute;&nbsp;x &lt;&#33;</p></article>
<footer>&copy; me</footer></body></html>"""


def test_blocks():
    assert html_extract.blocks(PAGE) == (["Head & line", "Onetwo three x y", "after", "a", "b", "1", "2", "é x <!"], True)
    assert html_extract.blocks("<p>cut off <b>here</p><p>and <a hre") == (["cut off here", "and"], False)
    assert html_extract.blocks("a < b > c & d") == (["a < b > c & d"], False)
    assert html_extract.blocks("<main><p>x</main><p>y") == (["x"], True)
    assert html_extract.blocks(None) == html_extract.blocks("") == ([], False)
    assert html_extract.blocks("<form id=f><div class=menu>m</div><article>x<form>n</form></article>y</form>") == (["x"], True)
    assert html_extract.blocks("<article><p>x<article class='comment reply'>no</article></article><article class='post has-sidebar'>y</article>") == (["x", "y"], True)
    assert html_extract.blocks("<h1>Site</h1><div id='page' class='with-sidebar'><div id='main-content'><p>long text here</p></div><div class='sidebar'>s</div></div>") == (["long text here"], True)
    assert html_extract.blocks("<div class='content'>a</div><p>much more text than in there</p>")[1] is False
    assert html_extract.blocks("<div>" * 5000 + "deep")[0] == ["deep"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>/!-\"'= apbdiv&;é\n", max_size=120))
def test_blocks_take_anything(text):
    html_extract.blocks(text)


def brute_repeated(tokens, page, least, spread):
    n, seen = len(tokens), {}
    starts = [i for i in range(n - least + 1) if page[i] == page[i + least - 1]]
    for i in starts:
        seen.setdefault(tuple(tokens[i : i + least]), set()).add(page[i])
    out = np.zeros(n, bool)
    for i in starts:
        if len(seen[tuple(tokens[i : i + least])]) >= spread:
            out[i : i + least] = True
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=15), max_size=6), st.integers(1, 9), st.integers(2, 3))
def test_repeated_against_brute_force(pages, least, spread):
    tokens = np.array([t for p in pages for t in p], np.int64)
    page = np.array([i for i, p in enumerate(pages) for _ in p], np.int64)
    assert np.array_equal(html_extract.repeated(tokens, page, least, spread), brute_repeated(tokens, page, least, spread))


def test_pages(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r for r in html_extract.main_text(df).collect()}
    for r in df.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        import html

        want = " ".join(html.unescape(re.sub(r"<[^>]*>?", "", re.sub(r"</?(p|h1|br)>", " ", article))).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


@pytest.mark.parametrize("lot", [2000, 4])
def test_host_boilerplate(spark, lot):
    rng = random.Random(1)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    menu, end = "Home About us Contact Help Terms Jobs Press", "All rights reserved by the makers of this fine site"
    rows, want = [], {}
    for i in range(24):
        text = words(30)
        rows.append((i, f"https://h{i % 2}.example.org/{i}", f"<div>{menu}</div><div>{text}</div><div>{end}</div>", "extra"))
        want[i] = text
    rows += [(100, "https://h0.example.org/c", rows[0][2], "extra"), (101, None, f"<div>{menu}</div>", None), (102, None, f"<div>{menu}</div>", None), (103, "x", None, None), (None, "x", "", None)]
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), lot=lot).collect()}
    if lot == 2000:
        assert {i: got[i] for i in want if i} == {i: want[i] for i in want if i}
        assert got[0] == got[100]  # copies keep all
    assert all(want[i] in got[i] for i in want)
    assert got[101] == menu and got[103] == "" and got[None] == ""
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def of_host(spark, sources, **options):
    """The text of each page of one host."""
    rows = [(i, f"http://h.example/{i}", x) for i, x in enumerate(sources)]
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), **options).collect()}
    assert len(got) == len(rows)
    return [got[i] for i in range(len(rows))]


def own(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n))


@pytest.mark.parametrize("lot", [1, 3, 2000])
def test_repeats_do_not_depend_on_lots(spark, lot):
    shared = [own(1000 + i, 12) for i in range(10)]  # each on two pages alone, on a host most of whose pages are marked
    texts = [own(i, 40) for i in range(20)]
    sources = [f"<div>{texts[i]}</div><div>{shared[i // 2]}</div>" for i in range(20)] + [f"<article>{own(100 + i, 20)}</article>" for i in range(40)]
    assert of_host(spark, sources, lot=lot) == texts + [own(100 + i, 20) for i in range(40)]


@pytest.mark.parametrize("lot", [1, 2000])
def test_short_pages_and_copies(spark, lot):
    menu, end = own(3000, 100), own(3001, 100)
    page = lambda text: f"<div>{menu}</div><div>{text}</div><div>{end}</div>"
    short = [own(400 + i, 20) for i in range(6)]
    article = own(500, 300).split(" ")
    near = [" ".join([*article[:k], "edited", *article[k + 1 :]]) for k in (40, 150, 260)] + [f"{own(501, 10)} {' '.join(article)}"]
    long = own(502, 60)
    texts = [*short, long, long, *near, *near[:1]]
    assert of_host(spark, [page(t) for t in texts], lot=lot) == texts
    assert of_host(spark, [page(t) for t in short[:2]], lot=lot) == short[:2]


@pytest.mark.parametrize("lot", [1, 4, 2000])
def test_boilerplate_in_marked_pages(spark, lot):
    notice, quote = own(2000, 12), own(2001, 12)
    texts = [own(200 + i, 25) for i in range(12)]
    texts[1:4] = [f"{t} {quote}" for t in texts[1:4]]  # a quarter of the pages quote it
    wrap = [("<main>", "</main>"), ("<div id='content'>", "</div>"), ("<article>", "</article>")]
    sources = [f"{wrap[i % 3][0]}<p>{texts[i]}</p><div class='more'>{notice}</div>{wrap[i % 3][1]}" for i in range(12)]
    sources += [sources[5]] * 2  # copies
    assert of_host(spark, sources, lot=lot) == [*texts, texts[5], texts[5]]
    copies = [f"<article>{texts[0]} {own(300 + i, 3)}</article>" for i in range(5)]
    assert of_host(spark, copies, lot=lot) == [f"{texts[0]} {own(300 + i, 3)}" for i in range(5)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text("ab", min_size=1, max_size=2), min_size=1, max_size=15), min_size=1, max_size=6), st.integers(1, 9))
def test_windows_against_suffix_array(pages, least):
    streams = [html_extract.Stream("h", " ".join(p), least, {}) for p in pages]
    number = {w: i for i, w in enumerate({w for s in streams for w in s.words})}
    tokens = np.array([number[w] for s in streams for w in s.words], np.int64)
    page = np.array([i for i, s in enumerate(streams) for _ in s.words], np.int64)
    kinds, counts = np.unique(np.concatenate([np.unique(s.windows) for s in streams]), return_counts=True)
    covered = np.concatenate([s.covered(kinds[counts >= 2]) for s in streams])
    assert np.array_equal(covered, html_extract.repeated(tokens, page, least, 2))


def brute_host(texts, least):
    """The method on whole pages without marks: what a window of ``least`` tokens (block ends count) shares with another page of the host goes."""
    streams = [[w for block in t for w in (*block.split(" "), None)] for t in texts]
    pages = {}
    for i, s in enumerate(streams):
        for k in range(len(s) - least + 1):
            pages.setdefault(tuple(s[k : k + least]), set()).add(i)
    out = []
    for s in streams:
        gone = set()
        for k in range(len(s) - least + 1):
            if len(pages[tuple(s[k : k + least])]) > 1:
                gone |= set(range(k, k + least))
        out.append(" ".join(w for k, w in enumerate(s) if k not in gone and w is not None))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_host_repeats_against_brute_force(spark, seed):
    """Whole pages, all elements a reader sees, over three hosts; each page has words of its own, so none is a copy."""
    rng = random.Random(seed)
    shared = [own(7000 + seed * 100 + i, rng.randrange(5, 20)) for i in range(8)]
    hosts = []
    for h in range(3):
        pages = []
        for i in range(14):
            blocks = [own(seed * 10_000 + h * 1000 + i * 10 + k, 30) for k in range(2)] + rng.sample(shared, rng.randrange(4))
            rng.shuffle(blocks)
            pages.append(blocks)
        hosts.append(pages)
    tags = ["div", "p", "nav", "footer", "article", "li"]
    rows, want = [], {}
    for h, pages in enumerate(hosts):
        for i, (blocks, text) in enumerate(zip(pages, brute_host(pages, 8), strict=True)):
            html = "".join(f"<{t}>{b}</{t}>" for b in blocks for t in [rng.choice(tags)])
            rows.append((100 * h + i, f"https://host{h}.example/{i}", f"<script>x</script>{html}"))
            want[100 * h + i] = text
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extract.main_text(df, markup=False, lot=rng.choice([1, 5, 2000])).collect()} == want


def test_very_long_page(spark):
    body = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, "http://h.example/1", f"<article><p>{body}</p></article>"), (2, "http://h.example/2", f"<div>{body}</div>"), (3, "http://h.example/3", None)]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: (body, len(body)), 2: (body, len(body)), 3: ("", 0)}


# shards


def test_plan_merges_like_sizes():
    shards = [sharding.Shard(f"s{i}", 1, b, i, (i,), ()) for i, b in enumerate([5, 5, 100, 6, 7, 90, 5])]
    merges = sharding.plan(shards, 4)
    assert [[s.name for s in g] for g in merges] == [["s0", "s1", "s3", "s4"]]
    assert [sharding.tier(x) for x in (0, 1, 3, 4, 15, 16)] == [0, 1, 1, 2, 2, 3]


def simulated(arrivals, fan, target):
    """arrivals: {key: (rows, bytes)}; the shards after all rounds as sets of arrivals."""
    live, version = [(1, f"a000001-{k:06d}", r, b, (k,)) for k, (r, b) in arrivals.items()], 1
    while True:
        by, merges = {}, []
        for s in sorted(live):
            if s[3] >= target:
                continue
            t = 0
            while 4**t <= s[3]:
                t += 1
            by.setdefault(t, []).append(s)
            if len(by[t]) == fan:
                merges.append(by.pop(t))
        if not merges:
            return version, live
        version += 1
        for i, g in enumerate(merges):
            live = [s for s in live if s not in g]
            live.append((version, f"m{version:06d}-{i:06d}", sum(s[2] for s in g), sum(s[3] for s in g), tuple(sorted(a for s in g for a in s[4]))))


def test_sharded(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    out = sharding.sharded(df, target=20_000).cache()
    rows, arrivals = {r["doc_id"]: r for r in df.collect()}, {}
    for i, r in rows.items():
        m = zlib.crc32(str(i).encode()) % 64
        a = m if m < 24 else 24 + (m - 24) // 8
        n, b = arrivals.get(a, (0, 0))
        arrivals[a] = n + 1, b + len((r["text"] or "").encode())
    version, live = simulated(arrivals, 4, 20_000)
    of = {a: s for s in live for a in s[4]}
    got = out.collect()
    assert sorted(r["doc_id"] for r in got) == sorted(rows)
    for r in got:
        m = zlib.crc32(str(r["doc_id"]).encode()) % 64
        s = of[m if m < 24 else 24 + (m - 24) // 8]
        tier = next(t for t in range(40) if 4**t > s[3])
        assert tuple(r["shard"]) == (s[1], tier, s[2], s[3], len(s[4]), version)
        assert r["text"] == rows[r["doc_id"]]["text"]


def test_store_versions_and_conflicts(spark, tmp_path):
    from pyspark.sql import functions as F

    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    assert store.version() == 0 and store.shards() == []
    df = docs(spark, AWKWARD)
    store.append(df, F.lit(1), F.lit(10))
    old = store.shards()
    store.append(df, F.lit(1), F.lit(10))
    assert store.version() == 2 and len(store.shards(1)) == 1 and len(store.shards()) == 2
    with pytest.raises(sharding.Conflict):
        store.commit(1, old)
    assert len(store.shards()) == 2 and store.read(df.schema).drop("x").count() == 2 * len(AWKWARD)
    assert store.read(df.schema, small=0).select("shard.*").distinct().count() == 2
    empty = sharding.sharded(docs(spark, []))
    assert empty.count() == 0


def test_append_beside_a_compaction(spark, tmp_path):
    """A writer that has its files but no manifest yet keeps them, and readers keep the versions they opened."""
    from pyspark.sql import functions as F

    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    df = docs(spark, AWKWARD)
    for i in range(4):
        store.append(df, F.lit(i), F.lit(10))
    old = store.read(df.schema, 4)
    late = store.version() + 1  # compaction commits this one; the late writer commits the next
    folder = "data/late"
    df.write.parquet(f"file://{tmp_path}/store/{folder}")
    assert store.compact(df.schema) == late and len(store.shards()) == 1
    store.vacuum()
    store.vacuum(versions=2, age=3600)
    store.commit(late, [*store.shards(), sharding.Shard("late", len(AWKWARD), 10, late + 1, (9,), (folder,))])
    assert store.read(df.schema).count() == 5 * len(AWKWARD) and old.count() == 4 * len(AWKWARD)
    store.vacuum(1, 0)
    assert store.read(df.schema).count() == 5 * len(AWKWARD)


def test_files_near_the_target(spark, tmp_path):
    import os

    from pyspark.sql import functions as F

    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x" * 100).alias("text"))
    store.append(df, F.col("doc_id") % 4, F.lit(100))
    store.compact(df.schema, target=101_000)
    (one,) = store.shards()
    files = [f for f in os.listdir(tmp_path / "store" / one.folders[0]) if f.endswith(".parquet")]
    assert len(files) == 4 and {spark.read.parquet(str(tmp_path / "store" / one.folders[0] / f)).count() for f in files} <= set(range(900, 1101))
    assert sharding.plan([one] * 4, target=101_000) == []


def test_no_python_in_the_plan(spark, sf):
    out = sharding.sharded(spark.read.parquet(f"{sf}/documents.parquet"), target=20_000)
    assert "Python" not in out._jdf.queryExecution().toRdd().toDebugString()
    assert "Python" not in sharding.sharded(docs(spark, []).limit(0))._jdf.queryExecution().optimizedPlan().toString()


def test_sharded_with_clashing_names(spark):
    df = docs(spark, AWKWARD).selectExpr("*", "7 as _bytes", "8 as _arrival", "9 as shard", "10 as folder")
    got = sharding.sharded(df)
    assert got.columns == [*df.columns, "_bytes_", "shard_"]
    assert {(r["_bytes"], r["_arrival"], r["shard"], r["folder"]) for r in got.collect()} == {(7, 8, 9, 10)} and got.count() == len(AWKWARD)


def test_sharded_awkward(spark):
    got = sharding.sharded(docs(spark, AWKWARD)).select("doc_id", "text", "extra", "row").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted([(r["doc_id"], r["text"]) for r in got], key=key) == sorted([(i, t) for i, t, _ in AWKWARD], key=key)
