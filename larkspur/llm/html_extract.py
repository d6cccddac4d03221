"""HTML extraction: markup first, then a suffix array over the pages of a host.

A page is cut into blocks by its block elements; menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, hidden parts and
reader comments are left out by element, role, class and id.  Where a page marks its article (``article``, ``main``, role or itemprop; else a class or id such as
"post" or "content" around half of its text or more), the blocks inside are its text.  Articles are quoted and copied within a host, so what repeats there may be text: a window of
``least`` tokens in there is boilerplate if more than half of the host's marked pages hold it, in ``voices`` distinct texts or more (share lines, lists of other articles, notices, a page-wide
``main``).  A marked page that holds no run of ``least`` words besides is a copy and keeps all.

Pages without such a mark are compared with their host.  A page's token stream holds the words of its blocks, block ends being tokens too.  A window of ``least`` tokens that
occurs on ``spread`` distinct streams of the host or more is boilerplate with all its tokens, which is what a suffix array over the host's streams finds (:func:`repeated`), but windows are
dealt by the hash of host and window, so that no task holds a host and the result is the same however large it is.  Equal and near-equal pages count as one stream, so copies do
not take each other's text, but lose what other pages hold too.  Two pages are near-equal if neither has a run of ``least`` words or more, or of the part ``near`` of its words without those that more than
half of the host's streams hold if that is longer, in no window of the other; chains of near-equal pages are one group.

Cases: null and empty html give empty text; a page without markup is one block; broken and cut-off markup is read as far as it goes; a null url is a host of its own, where
nothing is compared; repeated rows give a row each; a null page_id stays null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, encoded, map_arrow, stored, text_blocks
from .components import components

#: Elements by their role.
DROPPED = frozenset("nav footer aside script style noscript template iframe svg math canvas object select textarea button input dialog menu head title audio video map datalist".split())
UNSEEN = DROPPED - {"nav", "footer", "aside", "dialog", "menu", "button"}
RAW_TEXT = frozenset("script style textarea title iframe noscript noembed noframes xmp template svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: An element that the start of one of the others ends, unless an element of the third set lies between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
}
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog status".split())
#: Words of class and id that mark what is no article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense adbox adslot adunit banner banners sponsor sponsored sponsors promo promos promotion nav navbar navigation navi menu menus topbar "
    "breadcrumb breadcrumbs pagination pager sidebar sidebars aside footer foot masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments disqus respond reply replies discussion toolbar skip".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6 html body main".split())
#: Those of the words above that an ``article`` element must have to be left out, and words that mark an article for want of a better mark.
NO_ARTICLE = frozenset("ad ads advert advert adverts promo sponsored related recommended comment comments reply replies".split())
WEAK = frozenset("article post entry story content".split())
NEGATED = re.compile("(?:has|with|no|without|hide|show|is|wp|js)[-_]", re.I)
PIECE = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def attributes(source: str) -> dict[str, str]:
    if not source.strip(" /\n\t"):
        return {}
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in reversed(ATTRIBUTE.findall(source))}


def said(a: dict[str, str]) -> set[str]:
    """The words of class and id."""
    names = " ".join((a.get("class", ""), a.get("id", ""))).split()
    return {w.lower() for n in names if not NEGATED.match(n) for w in WORD.findall(n)}


def left_out(name: str, source: str, inside: bool) -> bool:
    """Whether an element is no part of an article."""
    if name in DROPPED or (name == "header" and not inside):
        return True
    if not source.strip(" /\n\t") or name in HEADING:
        return False
    a = attributes(source)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return True
    if ROLES & set(a.get("role", "").lower().split()):
        return True
    words = said(a)
    if name == "article":
        return bool(NO_ARTICLE & words)
    return bool(MARKS & words) or ("header" in words and not inside)


def marks_article(name: str, source: str) -> bool:
    if name in ("article", "main"):
        return True
    if "role" not in source and "itemprop" not in source:
        return False
    a = attributes(source)
    return a.get("role", "").lower() in ("article", "main") or a.get("itemprop", "") == "articleBody"


#: What an element and those inside it are: out of the text for good, or unless an article begins in there (a form around a page).
GONE, FORM, TEXT = 2, 1, 0


def blocks(source: str | None, markup: bool = True) -> tuple[list[str], bool]:
    """A page's blocks in order, and whether they come from a marked article.  Without ``markup`` all that a reader would see, and no marks."""
    if markup:
        out_of_text, marks = left_out, marks_article
    else:
        out_of_text, marks = (lambda name, _source, _inside: name in UNSEEN), (lambda _name, _source: False)
    every: list[str] = []
    inner: list[str] = []
    weak: list[str] = []
    parts: list[str] = []
    stack: list[tuple[str, int, int]] = []  # name, out from here on, article from here on (2; 1 for a weak mark)
    out = inside = 0
    marked = False

    def flush():
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                every.append(text)
                if inside:
                    weak.append(text)
                if inside == 2:
                    inner.append(text)
            parts.clear()

    def state():
        nonlocal out, inside
        flush()
        out, inside = stack[-1][1:] if stack else (0, 0)

    def close(i: int):
        del stack[i:]
        if (stack[-1][1:] if stack else (0, 0)) != (out, inside):
            state()

    source, at = source or "", 0
    while m := PIECE.match(source, at):
        at = m.end()
        token = m[0]
        name = m[2] or m[5]
        if name is None:
            if token[0] != "<" or len(token) == 1:
                if not out:
                    parts.append(token)
            continue
        name, rest = name.lower(), m[3] if m[2] else m[6]
        if m[1] or m[4]:
            if name in BLOCK:
                flush()
            elif name == "br":
                parts.append(" ")
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        if name in BLOCK:
            flush()
            if name in CLOSES:
                ends, fence = CLOSES[name]
                low = None
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in fence:
                        break
                    if stack[i][0] in ends:
                        low = i
                if low is not None:
                    close(low)
            else:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        close(i)
                        break
                    if stack[i][0] in BLOCK:
                        break
        elif name == "br":
            parts.append(" ")
        if name in VOID:
            continue
        if name in RAW_TEXT:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        strong = out < GONE and marks(name, rest) and not out_of_text(name, rest, True)
        if strong:
            new = TEXT, 2
        elif out:
            new = GONE if out == GONE or out_of_text(name, rest, inside == 2) else FORM, inside
        else:
            gone = out_of_text(name, rest, inside == 2)
            new = GONE if gone else FORM if markup and name == "form" else TEXT, inside or int(markup and not gone and bool(rest.strip(" /")) and bool(WEAK & said(attributes(rest))))
        stack.append((name, *new))
        marked |= strong
        if new != (out, inside):
            state()
    flush()
    if not marked and weak and 2 * sum(map(len, weak)) >= sum(map(len, every)):
        return weak, True
    return (inner, True) if marked else (every, False)


#: The host in a url.
HOST = "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def repeated(tokens: np.ndarray, page: np.ndarray, least: int, spread: int) -> np.ndarray:
    """Which tokens lie in a substring of ``least`` tokens that occurs on ``spread`` pages or more and does not cross pages.

    A suffix array by prefix doubling that stops at the depth ``least``: equal ranks there are equal substrings.
    """
    n = len(tokens)
    covered = np.zeros(n, bool)
    if n < least:
        return covered
    rank, depth = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while depth < least:
        step = min(depth, least - depth)
        if step < depth:  # the last step overlaps, so the depth is exact
            second = np.concatenate((rank[least - depth :], np.full(least - depth, -1)))
        else:
            second = np.concatenate((rank[step:], np.full(step, -1)))
        depth += step
        rank = np.unique((rank + 1) * (n + 2) + second + 1, return_inverse=True)[1]
    starts = np.flatnonzero(page[: n - least + 1] == page[least - 1 :])
    pairs = np.unique(rank[starts] * np.int64(page.max() + 1) + page[starts])
    kinds, pages = np.unique(pairs // np.int64(page.max() + 1), return_counts=True)
    hit = starts[np.isin(rank[starts], kinds[pages >= spread])]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + least, -1)
    return np.cumsum(step)[:n] > 0


#: Odd numbers for the hashes of windows.
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def hash64(text: str) -> int:
    """64 bits with a sign, the same in all workers."""
    return int.from_bytes(hashlib.blake2b(encoded(text), digest_size=8).digest(), "little", signed=True)


class Stream:
    """A page's tokens, block ends among them, and the hash of the window of ``least`` tokens that begins at each."""

    def __init__(self, host: str, text: str, least: int, seen: dict[str, int]):
        self.words: list[str | None] = []
        for block in text.split("\n"):
            if block:
                self.words += block.split(" ")
                self.words.append(None)
        self.least = least
        for w in self.words:
            if w not in seen:
                seen[w] = 1 if w is None else hash64(w)
        ids = np.fromiter(map(seen.__getitem__, self.words), np.int64, len(self.words)).view(np.uint64)
        n = max(0, len(ids) - least + 1)
        h = np.full(n, np.array(hash64(host)).view(np.uint64))
        for j in range(least):
            h = h * FACTOR + ids[j : j + n]
        for shift in (30, 27):
            h = (h ^ (h >> np.uint64(shift))) * MIX
        self.windows = (h ^ (h >> np.uint64(31))).view(np.int64)

    def covered(self, hits: np.ndarray) -> np.ndarray:
        """Which tokens lie in one of the windows."""
        at = np.flatnonzero(np.isin(self.windows, hits))
        step = np.zeros(len(self.words) + 1, np.int64)
        step[at] += 1
        step[at + self.least] -= 1
        return np.cumsum(step)[:-1] > 0

    def without(self, covered: np.ndarray) -> str:
        return " ".join(w for w, c in zip(self.words, covered.tolist(), strict=True) if w is not None and not c)


def own_run(s: Stream, covered: np.ndarray) -> int:
    """The words in the longest run that is not covered; block ends do not end a run."""
    free = np.array([not c for w, c in zip(s.words, covered.tolist(), strict=True) if w is not None], bool)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], free, [0]))))
    return int(np.max(edges[1::2] - edges[::2], initial=0))


def article_text(host: str, text: str, hits: bytes | None, least: int, seen: dict[str, int]) -> str:
    """A marked page's text without the windows that ``hits`` packs."""
    if hits:
        s = Stream(host, text, least, seen)
        covered = s.covered(np.frombuffer(hits, np.int64))
        if covered.any() and own_run(s, covered) >= least:
            return s.without(covered)
    return text.replace("\n", " ")


def site_windows(pages: DataFrame, least: int, voices: int, lot: int) -> DataFrame | None:
    """(h, hits): for a host's key the windows, packed, that more than half of its marked pages hold, in ``voices`` distinct texts or more; None if there are none.

    ``pages``: h, host, text of marked pages; no null hosts.  A block of pages sends on the windows that more than a third of its pages of a host hold.  One sent by no block is on a third of the
    pages at most, so what the blocks sent bounds the count from above; those that may be on half are then counted over all pages.
    """

    def articles(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple]]:
        for b in text_blocks(batches, limit=8 << 20):
            for i in range(0, b.num_rows, size):
                part, seen, out = b.slice(i, size), {}, []
                asked = part.column("asked").to_pylist() if "asked" in part.schema.names else [None] * part.num_rows
                for h, host, text, a in zip(*(part.column(c).to_pylist() for c in ("h", "host", "text")), asked, strict=True):
                    out.append((h, hash64(text), np.unique(Stream(host, text, least, seen).windows), a))
                yield out

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for block in articles(batches, lot):
            by: dict[int, list] = {}
            for h, _, w, _ in block:
                by.setdefault(h, []).append(w)
            for h, held in by.items():
                kinds, counts = np.unique(np.concatenate(held), return_counts=True)
                sent = 3 * counts > len(held)
                n = int(np.sum(sent))
                # the row without a window counts the host's pages
                yield {"h": [h] * (n + 1), "w": [None, *kinds[sent].tolist()], "c": [0, *counts[sent].tolist()], "r": [len(held)] * (n + 1)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for block in articles(batches, lot):
            for _, text, w, asked in block:
                w = w[np.isin(w, np.frombuffer(asked, np.int64))]
                yield {"w": w, "text": np.full(len(w), text, np.int64)}

    sent = cut(map_arrow(pages, likely, "h long,w long,c long,r long").groupBy("h", "w").agg(F.sum("c").alias("c"), F.sum("r").alias("r")))
    total = sent.filter("w is null").select("h", F.col("r").alias("m"))
    asked = cut(sent.filter("w is not null").join(total, "h").filter(f"6 * c - 2 * r > m and m >= {voices}").select("h", "w", "m"))
    if asked.isEmpty():
        return None
    per_text = with_hits(pages, packed_windows(asked, "asked"), "inner").transform(lambda d: map_arrow(d, count, "w long,text long")).groupBy("w", "text").agg(F.count("*").alias("n"))
    counted = per_text.groupBy("w").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    found = cut(asked.join(counted, "w").filter(f"2 * n > m and texts >= {voices}").select("h", "w"))
    return None if found.isEmpty() else packed_windows(found, "hits")


def packed_windows(windows: DataFrame, name: str) -> DataFrame:
    """(h, name): a host's windows as one string of bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield {"h": b.column("h"), name: [np.array(x, np.int64).tobytes() for x in b.column("w").to_pylist()]}

    return cut(map_arrow(windows.groupBy("h").agg(F.collect_list("w").alias("w")), pack, f"h long,{name} binary"))


def with_hits(pages: DataFrame, hits: DataFrame, how: str, small: int = 16 << 20) -> DataFrame:
    """Pages with their host's windows.  Few windows are sent to the pages, more are joined; the result is the same."""
    size = hits.agg(F.sum(F.octet_length(hits.columns[1]) + 64)).first()[0] or 0
    return pages.join(F.broadcast(hits) if size <= small else hits, "h", how)


def near_groups(streams: DataFrame, held: DataFrame, least: int, near: float) -> DataFrame:
    """(stream, root) for streams that have near-equal ones: stars around the least stream of each window, each link verified on both texts, then components."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Streams of which others hold nearly all: only these can have near-equal ones."""
        for b in text_blocks(batches):
            seen: dict = {}
            out = []
            for row in zip(*(b.column(c).to_pylist() for c in ("stream", "host", "text", "shared", "wide")), strict=True):
                s = Stream(row[1], row[2], least, seen)
                words = np.array([w is not None for w in s.words], bool)
                most = max(least, int(near * np.sum(words & ~s.covered(np.array(row[4], np.int64)))))
                if own_run(s, s.covered(np.array(row[3], np.int64))) < most:
                    out.append((*row[:3], most))
            yield {n: [x[i] for x in out] for i, n in enumerate(("stream", "host", "text", "most"))}

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in text_blocks(batches, limit=4 << 20):
            seen: dict = {}
            out = []
            for u, v, host, text, most, text_v, most_v in zip(*(b.column(c).to_pylist() for c in ("u", "v", "host", "text", "most", "text_v", "most_v")), strict=True):
                x, y = Stream(host, text, least, seen), Stream(host, text_v, least, seen)
                if own_run(x, x.covered(y.windows)) < most and own_run(y, y.covered(x.windows)) < most_v:
                    out.append((u, v))
            yield {"u": [x for x, _ in out], "v": [x for _, x in out]}

    total = streams.groupBy("h").agg(F.count("*").alias("m"))
    shared = held.groupBy("w").agg(F.count("*").alias("n"), F.min("h").alias("h")).filter("n > 1").join(total, "h").select("w", F.expr("2 * n > m").alias("wide"))
    of = held.select("stream", "w").join(shared, "w").groupBy("stream").agg(F.collect_list("w").alias("shared"), F.collect_list(F.when(F.col("wide"), F.col("w"))).alias("wide"))
    few = cut(map_arrow(streams.join(of, "stream").select("stream", "host", "text", "shared", "wide"), alike, "stream long,host string,text string,most long"))
    theirs = held.join(few.select("stream"), "stream").select("stream", "w")
    stars = theirs.join(theirs.groupBy("w").agg(F.min("stream").alias("v")), "w").filter("stream <> v").select(F.col("stream").alias("u"), "v").distinct()
    pairs = stars.join(few.withColumnRenamed("stream", "u"), "u").join(few.select(F.col("stream").alias("v"), F.col("text").alias("text_v"), F.col("most").alias("most_v")), "v")
    return components(map_arrow(pairs, verified, "u long,v long")).select(F.col("node").alias("stream"), "root")


PAGE = "page_id long,url string,host string,h long,text string,marked boolean,stream long"


def main_text(pages: DataFrame, least: int = 8, spread: int = 2, near: float = 0.05, lot: int = 2000, voices: int = 3, markup: bool = True) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of ``pages``.

    Pages are parsed once and their blocks written, joined by a line feed, which no block holds.  At most ``lot`` pages are worked on at once; the result does not depend on it.
    markup: whether elements, roles and classes are looked at; without it the repeats of a host decide alone.
    """

    def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, limit=1 << 20):
            for i in range(0, b.num_rows, lot):
                yield b.slice(i, lot)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in text_blocks(batches, "html", limit=8 << 20):
            got = [blocks(x, markup) for x in b.column("html").to_pylist()]
            text, marked = ["\n".join(parts) for parts, _ in got], [m for _, m in got]
            stream = [None if m or host is None else hash64(f"{host}\n{t}") for m, host, t in zip(marked, b.column("host").to_pylist(), text, strict=True)]
            yield {"page_id": b.column("page_id"), "url": b.column("url"), "host": b.column("host"), "h": b.column("h"), "text": text, "marked": marked, "stream": stream}

    def articles(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in text_blocks(batches, limit=8 << 20):
            seen: dict = {}
            text = [article_text(host, t, hits, least, seen) for host, t, hits in zip(*(b.column(c).to_pylist() for c in ("host", "text", "hits")), strict=True)]
            yield {"page_id": b.column("page_id"), "url": b.column("url"), "text": text}

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in lots(batches):
            seen: dict = {}
            got = [np.unique(Stream(host, text, least, seen).windows) for host, text in zip(b.column("host").to_pylist(), b.column("text").to_pylist(), strict=True)]
            counts = [len(w) for w in got]
            yield {"stream": np.repeat(b.column("stream").to_numpy(), counts), "h": np.repeat(b.column("h").to_numpy(), counts), "w": np.concatenate(got)}

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in lots(batches):
            seen: dict = {}
            out = []
            for host, text, hits in zip(*(b.column(c).to_pylist() for c in ("host", "text", "hits")), strict=True):
                s = Stream(host, text, least, seen)
                out.append(s.without(s.covered(np.array(hits or [], np.int64))))
            yield {"stream": b.column("stream"), "text": out}

    host = F.when(F.col("url").rlike(HOST), F.lower(F.regexp_extract("url", HOST, 1)))
    key = F.when(host.isNull(), F.xxhash64("page_id", "html")).otherwise(F.xxhash64(host)).alias("h")
    parsed = stored(map_arrow(pages.select(F.col("page_id").cast("long"), "url", host.alias("host"), "html", key), parse, PAGE))
    alone = parsed.filter("stream is null")
    site = site_windows(alone.filter("host is not null").select("h", "host", "text"), least, voices, lot)
    if site is None:
        sure = alone.select("page_id", "url", F.translate("text", "\n", " ").alias("text"))
    else:
        sure = map_arrow(with_hits(alone.select("page_id", "url", "host", "h", "text"), site, "left"), articles, "page_id long,url string,text string")
    # each distinct stream once
    others = parsed.filter("stream is not null")
    streams = cut(others.groupBy("stream").agg(F.first("h").alias("h"), F.first("host").alias("host"), F.first("text").alias("text")))
    if streams.isEmpty():
        return sure.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
    every = map_arrow(streams, windows, "stream long,h long,w long")
    # windows of one stream decide nothing and go no further
    again = cut(every.groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= min(spread, 2)).select("w"))
    held = cut(every.join(F.broadcast(again) if again.count() <= 1 << 20 else again, "w").select("stream", "h", "w"))
    voice = held.select("stream", "w")
    if not held.isEmpty():
        voice = voice.join(near_groups(streams, held, least, near), "stream", "left").select(F.coalesce("root", "stream").alias("stream"), "w").distinct()
    common = voice.groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= spread).select("w")
    hits = held.join(common, "w").groupBy("stream").agg(F.collect_list("w").alias("hits"))
    clean = map_arrow(streams.join(hits, "stream", "left").select("stream", "host", "text", "hits"), strip, "stream long,text string")
    rest = others.select("page_id", "url", "stream").join(clean, "stream").select("page_id", "url", "text")
    return sure.unionByName(rest).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
