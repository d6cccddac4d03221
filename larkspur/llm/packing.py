"""Packing token pieces into windows: best-fit decreasing with a segment tree over remaining capacities.

A document's ids, with an end id, are first cut into full windows and one rest.  Pieces of one length are
interchangeable, so the whole corpus is planned at once from the counts of its lengths (at most ``window`` rows): from
the longest length down, a segment tree indexed by remaining capacity finds the tightest open windows, and a block of equal
pieces goes into a block of equal windows in one step.  The plan says which ranks of a length go to which run of windows;
ranks are given by a running count in buckets, so no task orders all pieces of one length.  Full windows need no place and no rank.

A sequence is padded to ``window`` unless its length is a power of two; ``padded`` is that length.

Cases: null text counts as empty and yields its end id alone; repeated rows are packed each; null doc_ids come last in
the order; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow, text_blocks

WINDOW, END = 4096, 2
#: The letters and numbers among plain characters in lower case, and the tokenizer's split for those.
LETTER, NUMBER = "a-zªµºß-öø-įA-ZÀ-ÖØ-Þ", "0-9²³¹¼½¾"
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\\s{LETTER}{NUMBER}]+").findall
PLAIN = re.compile("[ \\n\\t\\r!-~¡-į]*").fullmatch
RAW = "\0"
REST = 1 << 39
PIECES = "doc_id long,start long,length long,ids_crc32 long,doc_tokens long,nth long"


class WordIds:
    """Little-endian ids of texts by a tokenizer that lower-cases and splits by ``SPLIT``, through a table of pieces.

    Texts of plain characters (ASCII, and Latin below U+0130: no composition, no case that depends on its neighbours) are split
    here; new pieces of letters are tokenized many at a time and taken apart at the ends of words that the ids tell.  In other texts
    this is done word by word, and a word with other characters is given to the tokenizer as it is; none of its pieces crosses a blank.
    """

    def __init__(self, path: str, most: int = 450_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.most = most

    def split(self, text: str) -> list[str]:
        if "<" in text and self.special.search(text):
            return [RAW + text]  # the tokenizer takes its own tokens out of a text before it splits
        if PLAIN(text):
            return SPLIT(text.lower())
        out = []
        for word in text.replace("\n", " ").split(" "):
            if PLAIN(word):
                out += SPLIT(word.lower())
            else:
                out.append(RAW + word)
        return out

    def one_by_one(self, pieces: list[str]) -> None:
        for p, e in zip(pieces, self.tokenizer.encode_batch_fast([p.removeprefix(RAW) for p in pieces], add_special_tokens=False), strict=True):
            self.known[p] = np.array(e.ids, "<u4").tobytes()

    def learn(self, new: set[str]) -> None:
        letters = [p for p in new if p[0] != RAW and p.isalpha()]
        self.one_by_one(list(new.difference(letters)))
        groups = [letters[i : i + 64] for i in range(0, len(letters), 64)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(group):
                self.one_by_one(group)
                continue
            buf, at = ids.tobytes(), 0
            for p, to in zip(group, (4 * stops).tolist(), strict=True):
                self.known[p] = buf[at:to]
                at = to

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        pieces = [self.split(t) for t in texts]
        known = self.known
        new = {p for ps in pieces for p in ps if p not in known}
        if len(known) + len(new) > self.most:
            self.known = {}
            new = set().union(*pieces)
        self.learn(new)
        for ps in pieces:
            yield b"".join(map(self.known.__getitem__, ps))
        for p in [p for p in new if len(p) > 1000]:
            del self.known[p]  # whole texts are not kept


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    """One table for all tasks of a worker.  A worker has one core, so the tokenizer need not start threads, which hold memory of their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, nth: a number of its own, the scan partition above 40 bits; full windows are counted from 0, others from ``REST``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from .common import row_numbers

        ids, last, full, rest = word_ids(tokenizer), np.array([end], "<u4").tobytes(), row_numbers(), row_numbers(REST)
        for block in text_blocks(batches, limit=256 << 10):  # small, so that the pieces of a block take little beside the table
            out = []
            for doc, buf in zip(block.column("doc_id").to_pylist(), ids.encode([x or "" for x in block.column("text").to_pylist()]), strict=True):
                buf += last
                n = len(buf) // 4
                for at in range(0, n, window):
                    size = min(window, n - at)
                    out.append((doc, at, size, zlib.crc32(buf[4 * at : 4 * (at + size)]), n, next(full if size == window else rest)))
            yield dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth"), zip(*out, strict=True), strict=True))

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, PIECES)


class Tightest:
    """A segment tree of flags over capacities 0..size: the smallest flagged capacity not below a bound."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = bytearray(2 * self.leaves)

    def put(self, at: int, flag: bool) -> None:
        i = at + self.leaves
        self.tree[i] = flag
        while i > 1:
            i //= 2
            self.tree[i] = self.tree[2 * i] or self.tree[2 * i + 1]

    def at_least(self, bound: int) -> int | None:
        i = bound + self.leaves
        if self.tree[i]:
            return bound
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first window, offset) runs: from that rank on, pieces go to windows one by one, all at that offset."""
    open_runs: dict[int, list[tuple[int, int]]] = {}  # by remaining capacity: (first window, number of windows)
    tree, plan, windows = Tightest(window), [], 0

    def reopen(room: int, first: int, n: int) -> None:
        if n and room:
            open_runs.setdefault(room, []).append((first, n))
            tree.put(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.at_least(length)
            if room is None:  # new windows
                room, first, n = window, windows, -(-left // (window // length))
                windows += n
            else:
                first, n = open_runs[room].pop()
                if not open_runs[room]:
                    tree.put(room, False)
            each = room // length  # a window just used is the tightest again until the length no longer fits
            full, rest = min(n, left // each), 0
            for k in range(each if full else 0):
                plan.append((length, rank, first, window - room + k * length))
                rank += full
            left -= full * each
            if full < n and left:
                rest, left = left, 0
                for k in range(rest):
                    plan.append((length, rank + k, first + full, window - room + k * length))
                reopen(room - rest * length, first + full, 1)
            reopen(room - each * length, first, full)
            used = full + bool(rest)
            reopen(room, first + used, n - used)
    return plan


def sequence_lengths(plan: list[tuple[int, int, int, int]], counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of windows with one filling begin (ascending), and that filling; from the plan alone."""
    ends: list[tuple[int, int, int]] = []  # window, +1 or -1, length
    by: dict[int, list[tuple[int, int]]] = {}
    for length, rank, first, _ in plan:
        by.setdefault(length, []).append((rank, first))
    for length, runs in by.items():
        runs.sort()
        for (rank, first), (until, _) in zip(runs, [*runs[1:], (counts[length], 0)], strict=True):
            ends += [(first, 1, length), (first + until - rank, -1, length)]
    steps: dict[int, int] = {}
    for at, sign, length in ends:
        steps[at] = steps.get(at, 0) + sign * length
    at = sorted(steps)
    return np.array(at, np.int64), np.cumsum(np.array([steps[x] for x in at], np.int64))


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, in_bucket: int = 1 << 20) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded: one row for each piece.

    in_bucket: pieces that one task ranks, about; full windows are sequences of their own, numbered after all others.
    """
    cutup = cut(pieces(docs, tokenizer, window, end))
    full, parts = cutup.filter(F.col("length") == window), cutup.filter(F.col("length") < window)
    buckets = max(256, parts.count() // in_bucket)
    keyed = parts.withColumn("bucket", F.pmod(F.xxhash64(F.coalesce("doc_id", "nth"), "start"), F.lit(buckets)))
    counts = cut(keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``window`` rows
    plan = sorted(best_fit_decreasing(totals, window))
    runs = np.array([(a << 44) | b for a, b, _, _ in plan], np.int64)
    firsts = np.array([c for _, _, c, _ in plan], np.int64)
    offsets = np.array([d for _, _, _, d in plan], np.int64)
    places, fill = sequence_lengths(plan, totals)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("length", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "start", "nth")
    ranked = keyed.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (b.column(x).to_numpy() for x in ("length", "rank"))
            run = np.searchsorted(runs, (length << 44) | rank, "right") - 1
            sequence = firsts[run] + rank - (runs[run] & ((1 << 44) - 1))
            held = fill[np.searchsorted(places, sequence, "right") - 1]
            yield {x: b.column(x) for x in columns} | {"sequence_id": sequence, "offset": offsets[run], "padded": np.where(held & (held - 1), window, held)}

    placed = map_arrow(ranked.select(*columns, F.col("rank").cast("long")), place, "doc_id long,start long,length long,ids_crc32 long,doc_tokens long,sequence_id long,offset long,padded long")
    used = int(places[-1]) if len(places) else 0
    # one row for each scan partition
    of = cut(full.groupBy(F.shiftright("nth", 40).alias("scan")).agg(F.count("*").alias("n")))
    of = of.select("scan", (F.coalesce(F.sum("n").over(Window.orderBy("scan").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + used).alias("from"))
    whole = full.withColumn("scan", F.shiftright("nth", 40)).join(of, "scan").select(
        *columns, (F.col("from") + F.col("nth").bitwiseAND(F.lit(REST - 1))).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(window).cast("long").alias("padded")
    )
    return placed.unionByName(whole)
