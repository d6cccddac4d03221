"""Suffix-array dedup: byte windows that repeat across documents, by a radix sort limited in depth.

Each byte that lies in a window of ``width`` bytes which also starts in a document with a smaller doc_id is removed; windows
are judged on the input.

The method is a radix sort of all windows by their bytes, most significant digit first and through ``width`` bytes only (:func:`radix_groups`): eight bytes a digit, and a
group that has no two documents any more leaves the sort.  The groups left at the end are exactly the repeated windows, and each has its smallest doc_id.

Two things only say where windows are sorted and which of them need not be; the result is the same without them (``contexts`` and ``collapsed`` switch them off, as the tests do):

* Place.  Shipping every window would send each byte ``width`` times.  Instead the windows of a text are dealt out by their minimiser, the smallest hash of their ``seed`` -byte
  strings: windows in a row with the same minimiser go together as one string, about 3.2 bytes for each byte of text, packed by zstd.  Equal windows have equal minimisers at the
  same place, so they meet in one bucket.  Seeds that a sample finds very often rank behind all others, so that a frequent phrase does not fill a bucket.
* Omission.  A string takes part if the ``width``-limited context to one side of its minimiser (half of what the window has beyond it) also occurs in another document; two
  windows cannot be equal otherwise.  Equal strings are put together, byte by byte compared, before anything is sent and again in a bucket: all but those of the smallest document are
  repeats, and a passage with any number of copies costs one string for each block.

The removed ranges come back by row and meet the texts in one join.

Cases: a null text counts as empty; texts shorter than ``width`` keep all; rows with the same doc_id do not remove each
other's bytes; a null doc_id is larger than all others; an empty table gives an empty result; other columns are ignored.

The texts are read twice.  Rows go by their file and their place in it, so both readings name them alike however the scans are split;
an input that is no plain scan of Parquet files is written first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, map_arrow, merged_blocks, named_rows, shuffle_parts, stored, text_blocks

WIDTH, SEED_BYTES = 50, 8
NO_ID = 2**63 - 1
K1, K2, K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def words(data: np.ndarray) -> np.ndarray:
    """The little-endian 8 bytes at each place of a buffer that has 8 spare bytes at its end."""
    return np.ndarray((len(data) - 7,), "<u8", data.data, 0, (1,))


def mix(h: np.ndarray) -> np.ndarray:
    h = h * K1
    h ^= h >> np.uint64(32)
    h *= K2
    h ^= h >> np.uint64(29)
    return h


def span_hash(at8: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """A hash of ``size`` (8 or more) bytes from each start."""
    h = np.zeros(len(start), np.uint64)
    for o in [*range(0, size - 8, 8), size - 8]:
        h = mix(h * K3 ^ at8[start + o])
    return h


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of many spans, one after the other."""
    ends = np.cumsum(size)
    if not len(ends):
        return data[:0]
    where = np.repeat((start - (ends - size)).astype(np.int64), size)
    where += np.arange(ends[-1])
    return data[where]


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, block: int = 1 << 22) -> np.ndarray:
    """Whether spans from a and b of the given sizes hold the same bytes."""
    out = np.empty(len(a), bool)
    cuts = np.searchsorted(np.cumsum(size), np.arange(block, int(size.sum()) + block, block))
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(a)], strict=True):
        if hi > lo:
            n = size[lo:hi]
            differ = gather(data, a[lo:hi], n) != gather(data, b[lo:hi], n)
            out[lo:hi] = np.add.reduceat(differ, np.cumsum(n) - n) == 0 if len(n) else out[lo:hi]
    return out


def collapse(data: np.ndarray, at8: np.ndarray, start: np.ndarray, size: np.ndarray, rel: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each string the index of an equal string of the smallest document, itself if none is known."""
    key = mix(span_hash(at8, start, 8) ^ mix(at8[start + size - 8] ^ mix(at8[start + rel] ^ (size.astype(np.uint64) << np.uint64(32)) ^ rel.astype(np.uint64))))
    order = np.lexsort((doc, key))
    ks = key[order]
    new = np.concatenate(([True], ks[1:] != ks[:-1])) if len(ks) else np.empty(0, bool)
    lead = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(ks) else order
    other = np.flatnonzero(lead != order)
    mine, theirs = order[other], lead[other]
    same = size[mine] == size[theirs]
    mine, theirs = mine[same], theirs[same]
    good = equal_spans(data, start[mine], start[theirs], size[mine])
    leader = np.arange(len(start))
    leader[mine[good]] = theirs[good]
    return leader


class Strings:
    """Windows in a row with one minimiser: start, number of windows, place of the minimiser, its hash, document."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, width: int, seed: int, hot: np.ndarray | None = None):
        """data: texts one after the other and 64 spare bytes; bounds: where each text starts, and the end; hot: hashes that rank behind all others."""
        n, w = int(bounds[-1]), width - seed + 1
        at8 = words(data)
        h = mix(at8[:n] ^ mix(at8[seed - 8 : n + seed - 8]))
        h >>= np.uint64(25)
        if hot is not None and len(hot):
            marked = np.zeros(1 << 16, bool)
            marked[(hot >> np.uint64(23)).astype(np.int64)] = True
            maybe = np.flatnonzero(marked[(h >> np.uint64(23)).astype(np.int64)])
            h[maybe[np.isin(h[maybe], hot)]] |= np.uint64(1 << 39)
        h <<= np.uint64(24)
        h |= np.arange(n, dtype=np.uint64)  # equal hashes: the first place
        low, have = h, 1
        while have * 2 <= w:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < w:
            low = np.minimum(low[: len(low) - (w - have)], low[w - have :])
        valid = np.zeros(len(low) + 1, bool)
        size = np.diff(bounds)
        long = np.flatnonzero(size >= width)
        step = np.zeros(n + 2, np.int8)
        np.add.at(step, bounds[:-1][long], 1)
        np.add.at(step, bounds[1:][long] - width + 1, -1)
        inside = np.cumsum(step, dtype=np.int8)[: len(low)]
        valid[: len(low)] = inside > 0
        begins = valid[:-1].copy()
        begins[1:] &= (low[1:] != low[:-1]) | ~valid[:-2]
        self.start = np.flatnonzero(begins)
        # a run ends where the next begins or where windows are not valid
        ends_valid = np.flatnonzero(valid[:-1] & ~valid[1:]) + 1
        nxt = np.concatenate((self.start[1:], [len(low) + 1]))
        stop = ends_valid[np.minimum(np.searchsorted(ends_valid, self.start, "right"), len(ends_valid) - 1)] if len(ends_valid) else nxt
        self.windows = np.minimum(nxt, stop) - self.start
        least = low[self.start]
        self.rel = (least & np.uint64(0xFFFFFF)).astype(np.int64) - self.start
        self.hash = least >> np.uint64(24)
        self.doc = np.searchsorted(bounds, self.start, "right") - 1


def pack(docs: np.ndarray, start: np.ndarray, windows: np.ndarray, rel: np.ndarray, body: np.ndarray) -> bytes:
    """docs: files, rows, doc_ids, places in the block and in the text of the texts concerned; start: ascending places in the block."""
    parts = [np.array([docs.shape[1], len(start)]), docs, np.diff(start, prepend=0).astype(np.uint32), windows.astype(np.uint16), rel.astype(np.uint16), body]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(x).tobytes() for x in parts))


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    """(file, row) and doc_ids of texts; index of the text, start in it, windows and place of the minimiser of strings; their bytes."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    nd, ns = np.frombuffer(raw, np.int64, 2).tolist()
    files, rows, ids, place, base = np.frombuffer(raw, np.int64, 5 * nd, 16).reshape(5, nd)
    at, out = 16 + 40 * nd, []
    for kind in (np.uint32, np.uint16, np.uint16):
        out.append(np.frombuffer(raw, kind, ns, at).astype(np.int64))
        at += ns * np.dtype(kind).itemsize
    start = np.cumsum(out[0])
    text = np.searchsorted(place, start, "right") - 1
    return np.stack((files, rows), axis=1), ids, text, start - place[text] + base[text], out[1], out[2], np.frombuffer(raw, np.uint8, offset=at)


RANGES = "file long,row long,start long,stop long"


def segments(batches: Iterator[pa.RecordBatch], width: int, block: int) -> Iterator[tuple]:
    """Names (file, row), doc_ids, places in their texts and bytes of blocks of texts; a longer text goes in pieces, each with its own windows."""
    for table in merged_blocks(batches, limit=block):
        held, total = [], 0
        for file, row, doc, text in zip(*(table.column(c).to_pylist() for c in ("file", "row", "doc_id", "text")), strict=True):
            data = encoded(text)
            for at in range(0, max(1, len(data) - width + 1), block):
                part = data[at : at + block + width - 1]
                if held and total + len(part) > block + width:
                    yield tuple(np.array(x, np.int64) for x in list(zip(*held, strict=True))[:4]) + ([h[4] for h in held],)
                    held, total = [], 0
                held.append((file, row, NO_ID if doc is None else doc, at, part))
                total += len(part)
        yield tuple(np.array(x, np.int64) for x in list(zip(*held, strict=True))[:4]) + ([h[4] for h in held],)


def deal(width: int, seed: int, buckets: int, block: int, hot: np.ndarray, collapsed: bool):
    """Texts to packed strings by bucket (bucket >= 0), and ranges already known as repeats (bucket -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for files, rows, ids, base, texts in segments(batches, width, block):
            bounds = np.cumsum([0, *map(len, texts)])
            if bounds[-1] < width:
                continue
            data = np.frombuffer(b"".join(texts) + bytes(64), np.uint8)
            s = Strings(data, bounds, width, seed, hot)
            if not len(s.start):
                continue
            at8, size, doc = words(data), s.windows + width - 1, s.doc
            leader = collapse(data, at8, s.start, size, s.rel, ids[doc]) if collapsed else np.arange(len(s.start))
            known = ids[doc] > ids[doc[leader]]
            where = np.where(known, -1, (s.hash % np.uint64(buckets)).astype(np.int64))
            order = np.argsort(where, kind="stable")
            cuts = np.flatnonzero(np.diff(where[order], prepend=-2, append=buckets))
            out = {"bucket": [], "blob": []}
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                x = order[lo:hi]
                bucket = int(where[x[0]])
                used = np.unique(doc[x])
                docs = np.stack((files[used], rows[used], ids[used], bounds[used], base[used]))
                out["bucket"].append(bucket)
                out["blob"].append(pack(docs, s.start[x], s.windows[x], s.rel[x], data[:0] if bucket < 0 else gather(data, s.start[x], size[x])))
            yield out

    return run


def several(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries have a key that occurs in two or more documents."""
    if not len(key):
        return np.empty(0, bool)
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
    d = doc[order]
    more = np.minimum.reduceat(d, new) != np.maximum.reduceat(d, new)
    out = np.empty(len(key), bool)
    out[order] = np.repeat(more, np.diff([*new, len(key)]))
    return out


def radix_groups(at8: np.ndarray, start: np.ndarray, group: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """The smallest document among equal windows of ``width`` bytes with the same group number; its own where it is alone."""
    least, alive = doc.copy(), np.arange(len(start))
    depths = [*range(0, width - 8, 8), width - 8]
    for i, depth in enumerate(depths):
        if not len(alive):
            break
        digit = at8[start[alive] + depth].byteswap()
        order = np.lexsort((digit, group[alive]))
        a, g, w = alive[order], group[alive][order], digit[order]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (w[1:] != w[:-1])))
        heads = np.flatnonzero(new)
        d = doc[a]
        low, high = np.minimum.reduceat(d, heads), np.maximum.reduceat(d, heads)
        which = np.cumsum(new) - 1
        if i == len(depths) - 1:
            least[a] = low[which]
            break
        group = group.copy()
        group[a] = which
        alive = a[(low != high)[which]]
    return least


def bucket_ranges(blobs: list[bytes], width: int, seed: int, contexts: bool = True, collapsed: bool = True) -> dict[str, np.ndarray] | None:
    parts = [unpack(b) for b in blobs]
    base = np.cumsum([0, *(len(p[0]) for p in parts)])
    rows, ids = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    short = np.concatenate([p[2] + b for p, b in zip(parts, base, strict=False)])
    begin, windows, rel = (np.concatenate([p[i] for p in parts]) for i in (3, 4, 5))
    data = np.concatenate([*(p[6] for p in parts), np.zeros(64, np.uint8)])
    del parts
    size = windows + width - 1
    start = np.cumsum(size) - size
    at8, doc = words(data), ids[short]
    # 1. contexts: a window has width - seed bytes beside its minimiser, so half of them at one side
    half = (width - seed + 1) // 2
    right, left = size - rel >= seed + half, rel >= half
    live = np.full(len(start), not contexts)
    for ok, first in ((right, rel), (left, rel - half)):
        x = np.flatnonzero(ok)
        live[x[several(span_hash(at8, start[x] + first[x], seed + half), doc[x])]] = True
    x = np.flatnonzero(live)
    if not len(x):
        return None
    start, size, rel, windows, doc, short, begin = (v[x] for v in (start, size, rel, windows, doc, short, begin))
    # 2. equal strings
    leader = collapse(data, at8, start, size, rel, doc) if collapsed else np.arange(len(start))
    whole = np.flatnonzero(doc > doc[leader])
    found = [(rows[short[whole]], begin[whole], begin[whole] + size[whole])]
    # 3. windows of one of each; equal strings of the smallest document share its result
    own = np.flatnonzero(leader == np.arange(len(leader)))
    twin = np.flatnonzero((leader != np.arange(len(leader))) & (doc == doc[leader]))
    total = windows[own]
    index = np.repeat(np.arange(len(own)), total)
    step = np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total)
    at = start[own][index] + step
    key = span_hash(at8, start[own] + rel[own], seed)
    group = np.unique(key, return_inverse=True)[1][index] * 64 + (rel[own][index] - step) if len(own) else index
    least = radix_groups(at8, at, group, doc[own][index], width)
    hit = least < doc[own][index]
    edge = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1] & (index[1:] == index[:-1])))) if len(hit) else np.empty(0, np.int64)
    close = np.flatnonzero(hit & ~np.concatenate((hit[1:] & (index[1:] == index[:-1]), [False]))) if len(hit) else edge
    s = own[index[edge]]
    found.append((rows[short[s]], begin[s] + step[edge], begin[s] + step[close] + width))
    if len(twin) and len(edge):  # copies within the document of a string that has removed windows
        order = np.argsort(s, kind="stable")
        lo, hi = np.searchsorted(s[order], leader[twin], "left"), np.searchsorted(s[order], leader[twin], "right")
        n = hi - lo
        t = np.repeat(twin, n)
        e = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        found.append((rows[short[t]], begin[t] + step[edge[e]], begin[t] + step[close[e]] + width))
    name, a, b = (np.concatenate([f[i] for f in found]) for i in range(3))
    return {"file": name[:, 0], "row": name[:, 1], "start": a, "stop": b} if len(a) else None


def judge(width: int, seed: int, contexts: bool = True, collapsed: bool = True):
    """Packed strings in order of their bucket to ranges of repeated bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        key, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if bucket < 0:
                    rows, _, short, begin, windows, _, _ = unpack(blob)
                    yield {"file": rows[short, 0], "row": rows[short, 1], "start": begin, "stop": begin + windows + (width - 1)}
                    continue
                if bucket != key and blobs:
                    if out := bucket_ranges(blobs, width, seed, contexts, collapsed):
                        yield out
                    blobs = []
                key = bucket
                blobs.append(blob)
        if blobs and (out := bucket_ranges(blobs, width, seed, contexts, collapsed)):
            yield out

    return run


def buckets_for(docs: DataFrame, target: int = 48 << 20) -> int:
    """So many buckets that a bucket's strings, about 3.2 bytes for each byte of text, take about ``target``; by the size Spark states for the scan, thrice for its packing."""
    stated = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(4 * shuffle_parts(docs.sparkSession), min(1 << 20, 10 * stated // target))


def hot_seeds(rows: DataFrame, width: int, seed: int, buckets: int, block: int, part: int = 64, most: int = 4096) -> np.ndarray:
    """Hashes of the minimisers that, by one row in ``part``, stand for over half a bucket's share of all strings; ``most`` of them at the most.

    They only change which bucket a window goes to, never the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for _, _, _, _, texts in segments(batches, width, block):
            bounds = np.cumsum([0, *map(len, texts)])
            if bounds[-1] >= width:
                h, n = np.unique(Strings(np.frombuffer(b"".join(texts) + bytes(64), np.uint8), bounds, width, seed).hash, return_counts=True)
                yield {"h": h.astype(np.int64), "n": n}

    counts = stored(map_arrow(rows.filter(F.pmod(F.xxhash64("file", "row"), F.lit(part)) == 0), run, "h long,n long").groupBy("h").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.filter(F.col("n") >= max(8, total // (2 * buckets))).orderBy(F.desc("n"), "h").limit(most).collect()
    return np.array(sorted(r["h"] for r in found), np.uint64)


def repeats(rows: DataFrame, width: int = WIDTH, seed: int = SEED_BYTES, block: int = 5_000_000, contexts: bool = True, collapsed: bool = True) -> DataFrame:
    """From rows (file, row, doc_id, text) to file, row, start and stop of ranges of repeated bytes; ranges may overlap and touch."""
    buckets = buckets_for(rows)
    hot = hot_seeds(rows, width, seed, buckets, block)
    dealt = map_arrow(rows, deal(width, seed, buckets, block, hot, collapsed), "bucket int,blob binary")
    # known ranges stay where they are spread: each goes by its own hash
    place = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(-1 - F.pmod(F.xxhash64("blob"), F.lit(1 << 20))).cast("int")
    met = dealt.withColumn("place", place).repartition(max(shuffle_parts(rows.sparkSession), buckets // 4), "place").sortWithinPartitions("place").select("bucket", "blob")
    return map_arrow(met, judge(width, seed, contexts, collapsed), RANGES)


def merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Ranges put together where they touch or overlap."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], np.maximum.accumulate(stops[order])
    new = np.concatenate(([True], a[1:] > b[:-1]))
    heads = np.flatnonzero(new)
    return list(zip(a[heads].tolist(), b[[*(heads[1:] - 1), len(b) - 1]].tolist(), strict=True))


def without_repeats(docs: DataFrame, width: int = WIDTH, seed: int = SEED_BYTES, contexts: bool = True, collapsed: bool = True) -> DataFrame:
    """doc_id, kept (the bytes left), n_bytes, n_removed, n_spans, kept_sha256: one row for each row of ``docs``."""
    rows = named_rows(docs.select(F.col("doc_id").cast("long"), "text"))
    # written, so that the packed strings are off the disks when the texts move
    by_row = stored(repeats(rows, width, seed, contexts=contexts, collapsed=collapsed).groupBy("file", "row").agg(F.collect_list(F.shiftleft("start", 31).bitwiseOR(F.col("stop"))).alias("ranges")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in text_blocks(batches, limit=8 << 20):
            out = {k: [] for k in ("kept", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
            for text, packed in zip(b.column("text").to_pylist(), b.column("ranges"), strict=True):
                data = encoded(text)
                spans = []
                if packed.is_valid:
                    v = packed.values.to_numpy()
                    spans = merged(v >> 31, v & (2**31 - 1))
                at, kept = 0, []
                for lo, hi in spans:
                    kept.append(data[at:lo])
                    at = hi
                kept = b"".join([*kept, data[at:]])
                for k, v in zip(out, (kept, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()), strict=True):
                    out[k].append(v)
            yield {"doc_id": b.column("doc_id"), **out}

    both = rows.join(by_row, ["file", "row"], "left").select("doc_id", "text", "ranges")
    return map_arrow(both, run, "doc_id long,kept binary,n_bytes long,n_removed long,n_spans long,kept_sha256 string")
