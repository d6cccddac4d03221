"""Exact deduplication: Patricia-trie owners.

Two texts are equal when they are identical after deleting the bytes of ``[\\x20\\x09-\\x0D]``.  The owner of a group is
the row with the most code points in its original text, then the smallest doc_id (nulls last), then the first row.

Each map task inserts the full byte strings of its rows into a compressed radix trie, where texts share the nodes of their common
beginnings; a terminal node keeps the best owner and the number of rows.  When the trie holds more than ``budget`` bytes, its
subtrees are spilled, the largest first: their terminals go out as partial groups and the memory is released.  Partial groups
are dealt to partitions by (length, hash), so a text with any number of copies sends one row for each map task or spill, and a reducer's
trie merges the full byte strings of its partition.  It reads in the order of (length, hash), so what it holds when it passes ``budget`` is finished
but for the key at hand, goes out and is released.

The input is read once.  That reading writes partial groups and, beside them, each row with the name of its partial group; owners come
back to the rows by an equi-join on that name, which no more than a task's rows share.  :func:`drop_copies` needs no join: a terminal
node there holds the best row itself.

Cases: a null text counts as empty and empty texts are equal; repeated rows count as copies, one row stays; a null
doc_id loses ties and yields a null keep_id when nobody better is there; an empty table gives an empty result; other columns are ignored
and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, encoded, fresh, map_arrow, row_numbers, stored, text_blocks

NO_ID = 2**63 - 1


class Node:
    """held: bytes of the value that count for the trie's size."""

    __slots__ = ("label", "children", "value", "held")

    def __init__(self, label: bytes, value=None):
        self.label, self.children, self.value, self.held = label, {}, value, 0


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Patricia:
    """A compressed radix trie from byte strings to values."""

    def __init__(self):
        self.root, self.size = Node(b""), 0

    def find(self, key: bytes) -> Node:
        """The node where ``key`` ends; it is made if need be."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.size += len(child.label) + 200
                return child
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            n = common_prefix(label, key[at : at + len(label)])
            upper = Node(label[:n])
            child.label = label[n:]
            upper.children[child.label[0]] = child
            node.children[key[at]] = upper
            self.size += 200
            node, at = upper, at + n
        return node

    def terminals(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, Node]]:
        todo = [(node or self.root, prefix)]
        while todo:
            node, prefix = todo.pop()
            key = prefix + node.label
            if node.value is not None:
                yield key, node
            todo += [(x, key) for x in node.children.values()]

    def items(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, object]]:
        return ((key, x.value) for key, x in self.terminals(node, prefix))

    def spill(self, share: float = 0.5) -> Iterator[tuple[bytes, object]]:
        """Release the largest subtrees of the first fork until at most ``share`` of the bytes is left; yields what they held."""
        fork, prefix = self.root, b""
        while len(fork.children) == 1 and fork.value is None:
            (fork,) = fork.children.values()
            prefix += fork.label
        weights = {first: weight(top) for first, top in fork.children.items()}
        goal = self.size * share
        for first in sorted(weights, key=weights.get, reverse=True):
            if self.size <= goal:
                break
            self.size -= weights[first]
            yield from self.items(fork.children.pop(first), prefix)
        if self.size > goal and fork.value is not None:
            yield prefix, fork.value
            self.size -= fork.held
            fork.value, fork.held = None, 0
        if not fork.children and fork.value is None:  # nothing is left but the way to the fork
            self.root, self.size = Node(b""), 0

    def keep(self, last) -> Iterator[tuple[bytes, object]]:
        """Release all terminals but those whose value ``last`` holds of; yields what was released."""
        nodes = list(self.terminals())
        self.root, self.size = Node(b""), 0
        for key, old in nodes:
            if last(old.value):
                new = self.find(key)
                new.value, new.held = old.value, old.held
                self.size += old.held
            else:
                yield key, old.value


def weight(top: Node) -> int:
    """The bytes of a subtree: labels, values and 200 for each node."""
    total, todo = 0, [top]
    while todo:
        node = todo.pop()
        total += len(node.label) + 200 + node.held
        todo += node.children.values()
    return total


def normalised(text: str | None) -> bytes:
    return encoded(text).translate(None, WHITE)


def place(body: bytes) -> tuple[int, int]:
    """Hash and length, by which texts are dealt to partitions."""
    return int.from_bytes(xxhash.xxh64_digest(body), "big", signed=True), len(body)


PARTIAL = "h long,len long,body binary,grp long,n long,chars long,owner long,owner_row long"
OWNED = "grp long,n long,owner long,owner_row long"
#: Rows of the reading: partial groups (body is set), and members (row is set) with the name of their partial group.
READ = f"{PARTIAL},doc_id long,row long,text_sha256 string"


def columns_of(rows: list[tuple], ddl: str) -> dict[str, tuple]:
    return dict(zip([x.split()[0] for x in ddl.split(",")], zip(*rows, strict=True), strict=True))


def read_groups(budget: int):
    """Rows to partial groups and members.  A partial group's name is its first row's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        trie, numbers = Patricia(), row_numbers()

        def partial(items) -> Iterator[dict]:
            held, total = [], 0
            for body, (grp, n, (chars, owner, row)) in items:
                held.append((*place(body), body, grp, n, -chars, owner, row, None, None, None))
                total += len(body)
                if total > 4 << 20 or len(held) == 2000:
                    yield columns_of(held, READ)
                    held, total = [], 0
            if held:
                yield columns_of(held, READ)

        for batch in text_blocks(batches):
            members = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n, body = next(numbers), normalised(text)
                node = trie.find(body)
                mine = (-len(text or ""), NO_ID if doc is None else doc, n)
                if node.value is None:
                    node.value = [n, 1, mine]
                else:
                    node.value[1] += 1
                    node.value[2] = min(node.value[2], mine)
                members.append((None, None, None, node.value[0], None, None, None, None, doc, n, hashlib.sha256(body).hexdigest()))
                if trie.size > budget:
                    yield from partial(trie.spill())
            yield columns_of(members, READ)
        yield from partial(trie.items())

    return run


def merged_groups(budget: int):
    """Partial groups that arrive in the order of (len, h) to (grp, n, owner, owner_row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        trie = Patricia()

        def out(items) -> Iterator[dict]:
            rows = [(g, n, owner, row) for _, (groups, n, (_, owner, row), _) in items for g in groups]
            if rows:
                yield columns_of(rows, OWNED)

        for batch in text_blocks(batches, "body"):
            for h, size, body, grp, n, chars, owner, row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                node = trie.find(body)
                if node.value is None:
                    node.value = [[grp], n, (-chars, owner, row), (size, h)]
                else:
                    node.value[0].append(grp)
                    node.value[1] += n
                    node.value[2] = min(node.value[2], (-chars, owner, row))
                if trie.size > budget:
                    yield from out(trie.keep(lambda value, key=(size, h): value[3] == key))
        yield from out(trie.items())

    return run


def exact_groups(docs: DataFrame, budget: int = 32 << 20) -> DataFrame:
    """doc_id, row, keep_id, keep_row, group_size, kept, text_sha256: one row for each row of ``docs``.

    budget: bytes of trie that a task holds before it releases subtrees or finished keys.
    """
    read = stored(map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), read_groups(budget), READ))
    partial = read.filter("body is not null").select(*[x.split()[0] for x in PARTIAL.split(",")])
    owned = map_arrow(partial.repartition("h", "len").sortWithinPartitions("len", "h"), merged_groups(budget), OWNED)
    members = read.filter("row is not null").select("grp", "doc_id", "row", "text_sha256")
    return members.join(owned, "grp").select(
        "doc_id",
        "row",
        F.when(F.col("owner") != NO_ID, F.col("owner")).alias("keep_id"),
        F.col("owner_row").alias("keep_row"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("owner_row")).alias("kept"),
        "text_sha256",
    )


def best_rows(schema: pa.Schema, text_at: int, id_at: int, budget: int, extra: list[str]):
    """Rows to the best row of each text so far; with ``extra`` names the hash and length of its text are added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Patricia()
        names = [*schema.names, *extra]
        kinds = [*schema.types, *([pa.int64(), pa.int64()] if extra else [])]
        done: list[tuple] = []

        def finish(items) -> None:
            for body, (_, row, _) in items:
                done.append((*row, *place(body)) if extra else row)

        def out(least: int = 1) -> Iterator[pa.RecordBatch]:
            if len(done) >= least:
                for i in range(0, len(done), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done[i : i + 500], strict=True), kinds, strict=True)], names=names)
                done.clear()

        for batch in text_blocks(batches, schema.names[text_at], limit=4 << 20):
            keys = None if extra else list(zip(batch.columns[-2].to_pylist(), batch.columns[-1].to_pylist(), strict=True))
            for i, row in enumerate(zip(*(c.to_pylist() for c in batch.columns[: len(schema)]), strict=True)):
                text, doc, key = row[text_at], row[id_at], keys and keys[i]
                node = trie.find(normalised(text))
                rank = (-len(text or ""), NO_ID if doc is None else doc)
                if node.value is None or rank < node.value[0] or (rank == node.value[0] and repr(row) < repr(node.value[1])):
                    node.value = (rank, row, key)
                    trie.size += len(text or "") - node.held
                    node.held = len(text or "")
                if trie.size > budget:
                    # in the order of keys: what has another key is finished
                    finish(trie.spill() if extra else trie.keep(lambda value, key=key: value[2] == key))
                    yield from out()
            yield from out()
        finish(trie.items())
        yield from out()

    return run


def drop_copies(docs: DataFrame, budget: int = 32 << 20) -> DataFrame:
    """The rows of ``docs`` that own their group, with all their columns; of repeated owners the one that sorts first.

    Read once, shuffled once: the best row of each text in a map task travels whole.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    h, size = fresh(docs.columns, "h"), fresh(docs.columns, "len")
    lower = [c.lower() for c in docs.columns]
    where = lower.index("text"), lower.index("doc_id")
    schema = to_arrow_schema(docs.schema)
    keyed = T.StructType([*docs.schema.fields, T.StructField(h, T.LongType()), T.StructField(size, T.LongType())])
    best = docs.mapInArrow(best_rows(schema, *where, budget, [h, size]), keyed)
    return best.repartition(h, size).sortWithinPartitions(size, h).mapInArrow(best_rows(schema, *where, budget, []), docs.schema)
