"""SimHash near-duplicates: candidates by chains of segments on a ring, components by star contraction.

Fingerprint: texts are lower-cased (A-Z only) and split into words ``[^\\x20\\x09-\\x0D]+``; every ``shingle`` words in a row,
joined by a space, are hashed with XXH64 (seed 42); a bit is 1 if it is set in over half the hashes.  Fewer words give one
shingle, none the fingerprint zero.

Candidates: the 64 bits form a ring of ``limit + 1`` segments.  If two fingerprints differ in ``limit`` bits or fewer,
there is a segment from which every chain of l segments differs in at most floor(l * limit / segments) bits.  So the first segment of the
chain is equal, and the first two differ in one bit at most: each fingerprint is filed under its first two segments
and under every one-bit change of the second, and links are sought among what is filed together.  There, pairs must keep
within the budgets of all longer chains before the full distance is taken.

Inside one pigeonhole, links are found by flooding: what a node reaches leaves the pool, so a dense group costs about
its size and yields a spanning forest, not its pairs.  A pigeonhole of over ``most`` fingerprints is dealt out in pairs of tiles; each pair of
fingerprints meets in some pair of tiles, so nothing is lost and no task holds more than two tiles.

Cases: a null text counts as empty; equal fingerprints are one node, so repeated rows and copies cost nothing; a null
doc_id takes part, a group of nothing else has a null component_id; an empty table gives an empty result; other columns are ignored and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, encoded, fresh, map_arrow, shuffle_parts, text_blocks
from .components import components

LIMIT, SHINGLE, SEED = 4, 4, 42


def fingerprint(data: bytes, shingle: int = SHINGLE, block: int = 1 << 16) -> int:
    """The unsigned fingerprint of one text's bytes."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    lasts = ends[min(shingle, len(words)) - 1 :]
    hashed, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, block):
        h = [hashed(joined[a:b], SEED) for a, b in zip(starts[at : min(n, at + block)].tolist(), lasts[at : at + block].tolist(), strict=True)]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def text_mark():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, mark (a hash of the text), fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in text_blocks(batches):
            fps = np.array([fingerprint(encoded(t), shingle) for t in b.column("text").to_pylist()], np.uint64)
            yield {"doc_id": b.column("doc_id"), "mark": b.column("mark"), "fp": fps.view(np.int64)}

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_mark().alias("mark"), "text"), run, "doc_id long,mark long,fp long")


class Ring:
    """The segments of 64 bits on a ring."""

    def __init__(self, limit: int = LIMIT):
        self.limit, m = limit, limit + 1
        cuts = [64 * i // m for i in range(m + 1)]
        self.width = [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
        self.shift = cuts[:-1]
        self.m = m

    def part(self, x: np.ndarray, i: int) -> np.ndarray:
        i %= self.m
        return (x >> np.uint64(self.shift[i])) & np.uint64((1 << self.width[i]) - 1)

    def holes(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """hole, fingerprint and whether it is filed there unchanged."""
        keys, homes = [], []
        for i in range(self.m):
            second, w = self.part(fps, i + 1), self.width[(i + 1) % self.m]
            base = (np.uint64(i) << np.uint64(56)) | (self.part(fps, i) << np.uint64(28))
            for bit in range(w + 1 if self.limit * 2 >= self.m else 1):
                keys.append(base | (second ^ np.uint64((1 << bit) >> 1)))
                homes.append(np.full(len(fps), bit == 0))
        return np.concatenate(keys).view(np.int64), np.tile(fps, len(keys)).view(np.int64), np.concatenate(homes)

    def linked(self, x: np.ndarray, start: int) -> np.ndarray:
        """Which differences ``x`` keep within the budget of every chain from ``start`` on, and in full."""
        ok, total = np.ones(len(x), bool), np.zeros(len(x), np.int64)
        for length in range(1, self.m):
            total += np.bitwise_count(self.part(x, start + length - 1))
            ok &= total <= length * self.limit // self.m
        left = np.flatnonzero(ok)
        ok[left] = np.bitwise_count(x[left]) <= self.limit
        return ok

    def forest(self, f: np.ndarray, start: int) -> list[tuple[int, int]]:
        """Links (position, position) that join what is linked in ``f``, by flooding."""
        links, pool = [], np.arange(len(f))
        while len(pool) > 1:
            front, pool = [pool[0]], pool[1:]
            while front and len(pool):
                at = front.pop()
                near = self.linked(f[pool] ^ f[at], start)
                if near.any():
                    links += [(at, x) for x in pool[near]]
                    front += list(pool[near])
                    pool = pool[~near]
        return links


def flood(ring: Ring):
    """Batches of (hole, a, b, fp) in order of (hole, a, b) to links; a group may go over many batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1) if batch.num_rows else np.empty((0, 4), np.int64)
            if not len(rows):
                continue
            # the last group may go on
            same = (rows[:, :3] == rows[-1, :3]).all(axis=1)
            whole = rows[~same] if same.any() else rows
            if held and (rows[0, :3] == held[-1][-1, :3]).all() and same.all():
                held.append(rows)
                continue
            yield from groups(np.concatenate([*held, whole]))
            held = [rows[same]]
        if held:
            yield from groups(np.concatenate(held))

    def groups(rows: np.ndarray) -> Iterator[dict]:
        if len(rows) < 2:
            return
        edge = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
        starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(rows)]))
        fps = rows[:, 3].astype(np.int64).view(np.uint64)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        two = np.flatnonzero(ends - starts == 2)
        for i in range(ring.m):
            at = starts[two[(rows[starts[two], 0] >> 56) == i]]
            at = at[ring.linked(fps[at] ^ fps[at + 1], i)]
            out.append((fps[at], fps[at + 1]))
        for k in np.flatnonzero(ends - starts > 2):
            f = fps[starts[k] : ends[k]]
            if links := ring.forest(f, int(rows[starts[k], 0] >> 56)):
                a, b = np.array(links).T
                out.append((f[a], f[b]))
        u, v = (np.concatenate([x[i] for x in out]).view(np.int64) for i in (0, 1))
        if len(u):
            yield {"u": u, "v": v}

    return run


def links(nodes: DataFrame, limit: int = LIMIT, most: int = 20_000) -> DataFrame:
    """From distinct fingerprints (fp) to links (u, v) whose components are those of all pairs within ``limit``."""
    ring, spark = Ring(limit), nodes.sparkSession

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            if b.num_rows:
                hole, fp, home = ring.holes(b.column("fp").to_numpy().view(np.uint64))
                for at in range(0, len(hole), 100_000):
                    yield {"hole": hole[at : at + 100_000], "fp": fp[at : at + 100_000], "home": home[at : at + 100_000]}

    # dealt out first, by a hash of its own so that Spark does not leave this out: fingerprints are few bytes, but each is filed many times
    filed = map_arrow(nodes.select("fp").repartition(shuffle_parts(spark), F.xxhash64("fp")), file, "hole long,fp long,home boolean")
    # counted apart, so that the entries of a hole with very many need not be in one task before they are dealt out
    holes = filed.groupBy("hole").agg(F.count("*").alias("n"), F.max("home").alias("any")).filter("n > 1 and any")
    # merged, as are all joins here: what a broadcast builds on the driver grows with the table
    met = filed.join(holes.select("hole", "n").hint("merge"), "hole")
    tiles = F.ceil(F.col("n") / F.lit(most)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    dealt = (
        met.withColumn("tiles", tiles)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
        .select("hole", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
        .repartition(shuffle_parts(spark), "hole", "a", "b")
        .sortWithinPartitions("hole", "a", "b")
    )
    return map_arrow(dealt, flood(ring), "u long,v long")


NO_ID = 2**63 - 1


def rooted_groups(docs: DataFrame, limit: int, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, mark, fp); fingerprints with their component's root; and each root's best row (id, fp, mark) and size.

    mark: a hash of the text, which tells rows with the same doc_id apart.
    """
    prints = cut(fingerprints(docs, shingle))
    best = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "fp", "mark")
    nodes = prints.groupBy("fp").agg(F.min(best).alias("least"), F.count("*").alias("n"))
    roots = components(links(nodes.select("fp"), limit)).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # written first: Spark can then split the rows of a large component in the join below
    groups = cut(rooted.groupBy("root").agg(F.min("least").alias("least"), F.sum("n").alias("component_size")))
    return prints, rooted.select("fp", "root"), groups


def near_groups(docs: DataFrame, limit: int = LIMIT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, component_id, component_size: one row for each row of ``docs``."""
    prints, rooted, groups = rooted_groups(docs, limit, shingle)
    named = rooted.join(groups.hint("merge"), "root").select("fp", F.when(F.col("least.id") != NO_ID, F.col("least.id")).alias("component_id"), "component_size")
    return prints.join(named.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def drop_near(docs: DataFrame, limit: int = LIMIT, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component with all its columns: the one with the smallest doc_id (nulls last, then the smallest fingerprint and hash of the text).

    Rows that agree in doc_id and text are one row here; which of them stays is open where their other columns differ.
    """
    _, _, groups = rooted_groups(docs, limit, shingle)
    names = docs.columns
    i, m = fresh(names, "_near_id"), fresh(names, "_near_mark")
    keep = groups.select(F.col("least.id").alias(i), F.col("least.mark").alias(m))
    found = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), m: text_mark()}).join(keep.hint("merge"), [i, m], "left_semi")
    return found.dropDuplicates([i, m]).select(*[F.col(f"`{x}`") for x in names])
