"""The trie of shared beginnings of conversations, and sums over its subtrees by leaf-peeling message passing.

1. Each turn becomes a fingerprint of role and text and a word count; texts are read once and go no further.
2. A prefix is named by its length and four sums of (fingerprint * base**place) modulo primes (124 bits), which run over a conversation of any length (``running``).
   The sums of a conversation that takes its first turns from another one follow from the sums of both.
3. Rows that name one prefix are a node; its id is its smallest member and its depth.  The nodes with one smallest member are a path, so the trie is a tree of paths,
   each hanging below a node of another one.  A long conversation is one path, not a message for each turn.
4. Peeling: a path counts the paths that hang below it and are not finished.  Those with none left send their subtree's totals to their parents, added up
   on the way, and are done; the rest count down.  A path with one child left waits for that child by name, and chains of these are halved in each round, so the rounds grow
   with the logarithm of the tree's height and size.  The names of children left are kept as their xor, which is the name once one is left.
5. A node's totals are its path's sums from the bottom up to it, with what the paths below have sent (``running`` again).

Hot beginnings are combined before each shuffle; a hot conversation is spread over partitions; members that end at a node are joined into text in order
and hashed as a stream of pieces of 8 KB.

Cases: rows are ordered by turn (null first), then role, then the fingerprint of role and text; null roles and texts are empty; repeated rows are turns of their own; rows without a conv_id belong to no
conversation and are left out; remainders and base conversations of negative ids are those of SQL (towards zero); an empty table has no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, stored
from .mixing import word_count
from .running import BASES, PRIMES, running

K = [f"k{i}" for i in range(len(PRIMES))]
KEY = ["depth", "ka", "kb"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def fingerprints(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, sha, rid, words): what the trie needs of each turn; written."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    sha = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.unhex(sha).alias("sha"), word_count(text).alias("words"))
    return stored(rows.filter("conv is not null").withColumn("rid", F.monotonically_increasing_id()))


def _packed(k: list[Column], prefix: str = "k") -> list[Column]:
    """Four remainders as two longs."""
    return [(k[0] * 2**31 + k[1]).alias(f"{prefix}a"), (k[2] * 2**31 + k[3]).alias(f"{prefix}b")]


def prefixes(turns: DataFrame, heads: Column, base: Column, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Two tables over the rebuilt conversations: each prefix of each, and where each ends.

    A rebuilt conversation is the first ``heads`` (at most ``most``) turns of conversation ``base``, then its own turns after as many; both are over ``conv``.
    Prefixes: conv, depth, ka, kb (the name), pa, pb (the name without the last turn), words of the last turn, length.  Ends: conv, depth, ka, kb.
    """
    piece = lambda i: F.conv(F.hex(F.substring("sha", 4 * i + 1, 4)), 16, 10).cast("long") % PRIMES[i]
    rows = fingerprints(turns).select("conv", "turn", "role", "sha", "rid", "words", *[piece(i).alias(c) for i, c in enumerate(K)])
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "sha", "rid")]
    run = running(rows, "conv", order, series=tuple(K)).select("conv", "rank", "words", *K, *[f"{c}_before" for c in K])
    head = [F.max(F.when(F.col("rank") == r, F.struct(*K, "words"))).alias(f"at{r}") for r in range(1, most + 1)]
    own = run.groupBy("conv").agg(F.max("rank").alias("n"), F.max_by(F.struct(*K), "rank").alias("whole"), *head)
    own = stored(own.withColumns({"h": heads.cast("int"), "base": base.cast("long")}))
    lent = own.select(F.col("conv").alias("base"), F.col("n").alias("base_n"), *[F.col(f"at{r}").alias(f"lent{r}") for r in range(1, most + 1)])
    convs = own.join(lent, "base", "left").withColumn("m", F.least(F.coalesce("base_n", F.lit(0)), "h").cast("int"))

    def at(name: str, rank: Column, c: str) -> Column:
        """Sum ``c`` of the first ``rank`` turns."""
        out = F.lit(0).cast("long")
        for r in range(1, most + 1):
            out = F.when(rank == r, F.col(f"{name}{r}.{c}")).otherwise(out)
        return out

    def shifted(i: int, k: Column) -> Column:
        """Name of an own prefix in the rebuilt conversation: the sum without the dropped turns, moved by m - h places, after the sum of the borrowed ones."""
        moves = F.array(*[F.lit(pow(BASES[i], -s, PRIMES[i])) for s in range(most + 1)])
        return (((k - F.col(f"drop{i}")) % PRIMES[i] + PRIMES[i]) % PRIMES[i] * moves[F.col("h") - F.col("m")] % PRIMES[i] + F.col(f"lead{i}")) % PRIMES[i]

    facts = convs.withColumns({
        "length": F.col("m") + F.greatest(F.lit(0), F.col("n") - F.col("h")),
        **{f"drop{i}": F.coalesce(at("at", F.least("n", "h"), c), F.lit(0)) for i, c in enumerate(K)},
        **{f"lead{i}": F.coalesce(at("lent", F.col("m"), c), F.lit(0)) for i, c in enumerate(K)},
    })
    lead = [f"{x}{i}" for x in ("drop", "lead") for i in range(len(K))]
    whole = [F.when(F.col("n") > F.col("h"), shifted(i, F.col(f"whole.{c}"))).otherwise(F.col(f"lead{i}")) for i, c in enumerate(K)]
    facts = stored(facts.select("conv", "h", "m", "length", *lead, *[F.col(f"lent{r}") for r in range(1, most + 1)], *_packed(whole)))
    ends = facts.select("conv", F.col("length").cast("int").alias("depth"), "ka", "kb")
    none = F.lit(0).cast("long")
    roots = facts.select("conv", F.lit(0).alias("depth"), none.alias("ka"), none.alias("kb"), none.alias("pa"), none.alias("pb"), none.alias("words"), "length")
    place = F.col("depth")
    borrowed = facts.filter("m > 0").withColumn("depth", F.explode(F.sequence(F.lit(1), F.col("m")))).select(
        "conv", "depth", *_packed([at("lent", place, c) for c in K]), *_packed([at("lent", place - 1, c) for c in K], "p"), at("lent", place, "words").alias("words"), "length",
    )
    after = run.join(facts.select("conv", "h", "m", "length", *lead), "conv").filter(F.col("rank") > F.col("h")).select(
        "conv", (F.col("m") + F.col("rank") - F.col("h")).cast("int").alias("depth"), *_packed([shifted(i, F.col(c)) for i, c in enumerate(K)]),
        *_packed([shifted(i, F.col(f"{c}_before")) for i, c in enumerate(K)], "p"), "words", "length",
    )
    return roots.unionByName(borrowed).unionByName(after), ends


def ends_hashes(ends: DataFrame, piece: int = 8192) -> DataFrame:
    """(depth, ka, kb, ends_sha256): hash of the members that end at a node, in numerical order, comma-joined.

    The ids of a node are joined where they lie in the order, into pieces of at most about ``piece`` characters; these meet by node and are hashed one after the other.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, last, size = [], None, 0
            for *key, conv in zip(*[b.column(c).to_pylist() for c in (*KEY, "conv")], strict=True):
                if key != last or size >= piece:
                    out.append((*key, conv, []))
                    last, size = key, 0
                out[-1][4].append(str(conv))
                size += len(out[-1][4][-1]) + 1
            if out:
                d, ka, kb, first, ids = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(ka), pa.array(kb), pa.array(first), pa.array([",".join(x) for x in ids])], names=[*KEY, "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha, out = None, None, []
        for b in batches:
            for *key, ids in zip(*[b.column(c).to_pylist() for c in (*KEY, "ids")], strict=True):
                if key == last:
                    sha.update(b",")
                else:
                    if last is not None:
                        out.append((*last, sha.hexdigest()))
                    last, sha = key, hashlib.sha256()
                sha.update(ids.encode())
            if out:
                yield of(out)
                out = []
        if last is not None:
            yield of([(*last, sha.hexdigest())])

    def of(out: list[tuple]) -> pa.RecordBatch:
        d, ka, kb, sha = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(ka), pa.array(kb), pa.array(sha)], names=[*KEY, "ends_sha256"])

    pieces = ends.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv").mapInArrow(joined, "depth int, ka long, kb long, first long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hashed, "depth int, ka long, kb long, ends_sha256 string")


def peeled(paths: DataFrame, rounds: int = 100) -> DataFrame:
    """Totals of subtrees, from (id, parent, leaves, saved): parent is null for the root, leaves and saved are a path's own.  The result has the same columns.

    State: left, children that aren't finished; child, the xor of their ids.  A path with one child left takes that child's totals when it finishes (it pulls); the others are sent theirs.
    """
    below = paths.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("left"), F.bit_xor("id").alias("child"))
    live = cut(paths.join(below, "id", "left").withColumns({"left": F.coalesce("left", F.lit(0)).cast("long"), "child": F.coalesce("child", F.lit(0)).cast("long")}))
    done: list[DataFrame] = []
    for _ in range(rounds):
        counts = {r["left"]: r["n"] for r in live.groupBy(F.least("left", F.lit(2)).alias("left")).agg(F.count("*").alias("n")).collect()}
        if not counts:
            break
        if not counts.get(0):
            raise RuntimeError("a cycle among paths")
        finished = live.filter("left = 0")
        done.append(finished.select("id", "parent", "leaves", "saved"))
        if counts[0] == sum(counts.values()):
            break
        sent = finished.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("_n"), F.bit_xor("id").alias("_x"), F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        told = live.filter("left > 1").join(sent, "id", "left").select(
            "id", "parent", (F.col("leaves") + zero("_l")).alias("leaves"), (F.col("saved") + zero("_s")).alias("saved"), (F.col("left") - zero("_n")).alias("left"),
            F.col("child").bitwiseXOR(zero("_x")).alias("child"),
        )
        if not counts.get(1):
            live = cut(told)
            continue
        # a path that waits for one child takes the child's totals if it is finished; if the child goes on waiting for one as well, it takes what that has and waits for whom that waits for
        taken = [(F.col("leaves") + zero("_l")).alias("leaves"), (F.col("saved") + zero("_s")).alias("saved")]
        there = [F.col("id").alias("child"), F.col("leaves").alias("_l"), F.col("saved").alias("_s")]
        waits = live.filter("left = 1").join(finished.select(*there), "child", "left").select("id", "parent", *taken, F.when(F.col("_l").isNull(), 1).otherwise(0).cast("long").alias("left"), "child")
        seen = waits.filter("left = 1").select(*there, F.col("child").alias("_child"))
        pulled = waits.join(seen, (waits["child"] == seen["child"]) & (waits["left"] == 1), "left").select("id", "parent", *taken, "left", F.coalesce("_child", waits["child"]).alias("child"))
        live = cut(told.unionByName(pulled))
    else:
        raise RuntimeError(f"peeling did not end in {rounds} rounds")
    out = paths.select("id", "parent", "leaves", "saved").limit(0)
    for d in done:
        out = out.unionByName(d)
    return out


def trie(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """One row for each node from :func:`prefixes`: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    first = F.min(F.struct("conv", "length"))
    nodes = rows.groupBy(*KEY).agg(first.alias("first"), F.count("*").alias("n_convs"), *[F.max(c).alias(c) for c in ("words", "pa", "pb")])
    nodes = stored(nodes.select(F.col("first.conv").alias("id"), *KEY, "pa", "pb", "n_convs", F.col("first.length").alias("length"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")))
    # a path: the nodes of one smallest member, from its top down; the node above the top is of another path
    top = F.min_by(F.struct("pa", "pb"), "depth")
    paths = nodes.groupBy("id").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum("saved").alias("saved"), top.alias("up"))
    above = nodes.select(F.col("id").alias("parent"), (F.col("depth") + 1).alias("top"), F.col("ka").alias("ua"), F.col("kb").alias("ub"))
    paths = paths.select("id", "top", "bottom", "saved", F.when(F.col("top") > 0, F.col("up.pa")).alias("ua"), F.col("up.pb").alias("ub"))
    paths = stored(paths.join(above, ["top", "ua", "ub"], "left").select("id", "parent", "top", "bottom", "saved"))
    hung = paths.filter("parent is not null").select(F.col("parent").alias("id"), (F.col("top") - 1).alias("bottom")).distinct().withColumn("hung", F.lit(1))
    own = paths.join(hung, ["id", "bottom"], "left").select("id", "parent", F.when(F.col("hung").isNull(), 1).otherwise(0).cast("long").alias("leaves"), "saved")
    totals = peeled(cut(own))
    sent = totals.filter("parent is not null").join(paths.select("id", "top"), "id").groupBy(F.col("parent").alias("id"), (F.col("top") - 1).alias("depth"))
    sent = sent.agg(F.count("*").alias("hung"), F.sum("leaves").alias("got_leaves"), F.sum("saved").alias("got_saved"))
    tops = paths.select("id", F.col("top").alias("depth"), "parent", F.lit(True).alias("is_top"))
    joined = nodes.join(ends_hashes(ends), KEY, "left").join(sent, ["id", "depth"], "left").join(tops, ["id", "depth"], "left")
    goes_on = F.when(F.col("depth") < F.col("length"), 1).otherwise(0)
    children = (F.coalesce("hung", F.lit(0)) + goes_on).cast("long")
    joined = joined.select(
        "id", "depth", F.when(F.col("is_top").isNull(), F.col("id")).otherwise(F.col("parent")).alias("up"), "n_convs", children.alias("n_children"),
        (F.coalesce("got_leaves", F.lit(0)) + F.when(children == 0, 1).otherwise(0)).cast("long").alias("leaves"), (F.col("saved") + F.coalesce("got_saved", F.lit(0))).alias("saved"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends"),
    )
    summed = running(joined, "id", [F.col("depth").desc()], sums=("leaves", "saved"))
    return summed.select(
        F.col("id").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("up").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    )


def conversation_trie(turns: DataFrame, heads: Column | None = None, base: Column | None = None, most: int = 3) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, turn, role, text), as they are or rebuilt as :func:`prefixes` says."""
    rows, ends = prefixes(turns, F.lit(0) if heads is None else heads, F.col("conv") if base is None else base, most)
    return trie(rows, ends)
