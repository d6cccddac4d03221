"""Running values inside groups of any size: no group has to be in one task.

Rows are dealt out by ranges of the whole order and written with values that run inside a partition; what a group brings along from the partitions before is one row for each
partition, which the driver adds up and a broadcast join (no more rows than partitions) gives back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import stored

#: Primes below 2**31, so that a product of two remainders is a long, with a base for each.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1315423911, 1640531527, 1103515245, 1540483477)


def powers(n: int, base: int, prime: int) -> np.ndarray:
    """base**0 .. base**n mod prime."""
    out = np.ones(1, np.int64)
    while len(out) <= n:
        out = np.concatenate([out, out * pow(base, len(out), prime) % prime])
    return out[: n + 1]


def running(df: DataFrame, group: str, order: list[Column], sums: tuple[str, ...] = (), series: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``rank`` (from 1) in each group (a long, not null), in its order, and, up to and with the row: sums of the columns ``sums`` (in place of their values); for the columns ``series``
    (at most four, whole numbers from 0 to below 2**31) the sum of value * base**rank modulo their prime, and under the name with ``_before`` that sum without the row.
    """
    names = [*sums, *series]
    kept = [f for f in df.schema.fields if f.name not in names]
    out = StructType(kept).add("part", "integer").add("rank", "long").add("last", "boolean")
    for c in [*names, *[f"{c}_before" for c in series]]:
        out = out.add(c, "long")
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, ready = TaskContext.get().partitionId(), None, None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            g, at = b.column(group).to_numpy(), np.arange(n)
            start = np.maximum.accumulate(np.where(np.r_[True, g[1:] != g[:-1]], at, 0))
            goes_on = (start == 0) & (held is not None and g[0] == held[0])
            before = held[1] if held is not None else {}
            rank = at - start + 1 + goes_on * before.get("rank", 0)
            cols = {"part": np.full(n, part, np.int32), "rank": rank, "last": np.zeros(n, bool)}
            for c in sums:
                v = b.column(c).to_numpy()
                total = np.cumsum(v)
                cols[c] = total - (total[start] - v[start]) + goes_on * before.get(c, 0)
            for c, prime, base in zip(series, PRIMES, BASES, strict=False):
                term = b.column(c).to_numpy() % prime * powers(n, base, prime)[at - start + 1] % prime
                if goes_on.any():
                    term = np.where(goes_on, term * pow(base, before["rank"], prime) % prime, term)
                total = np.cumsum(term)
                cols[c] = (total - (total[start] - term[start]) + goes_on * before.get(c, 0)) % prime
                cols[f"{c}_before"] = (cols[c] - term) % prime
            if ready is not None:
                yield ready()
            held = (g[-1], {c: int(cols[c][-1]) for c in ("rank", *names)})
            ready = lambda b=b, cols=cols: pa.RecordBatch.from_arrays([b.column(f.name) if f.name not in cols else pa.array(cols[f.name], f.type) for f in schema], schema=schema)
            last = cols["last"]
        if ready is not None:
            last[-1] = True
            yield ready()

    local = stored(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).mapInArrow(run, out))
    carried = _carried(local, group, names, series)
    if not carried:
        return local.drop("part", "last")
    ddl = ", ".join(["part int", f"{group} long", "_rank long", *[f"_{c} long" for c in names], *[f"_by_{c} long" for c in series]])
    brought = F.broadcast(local.sparkSession.createDataFrame(carried, ddl))
    or_ = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    new = {"rank": F.col("rank") + or_("_rank", 0), **{c: F.col(c) + or_(f"_{c}", 0) for c in sums}}
    for c, prime in zip(series, PRIMES, strict=False):
        for name in (c, f"{c}_before"):
            new[name] = (F.col(name) * or_(f"_by_{c}", 1) % prime + or_(f"_{c}", 0)) % prime
    return local.join(brought, ["part", group], "left").withColumns(new).select(*[c for c in local.columns if c not in ("part", "last")])


def _carried(local: DataFrame, group: str, names: list[str], series: tuple[str, ...]) -> list[tuple]:
    """For each partition, what the group that the partitions before it ended with has come to: one row for each partition."""
    now, out = None, []
    for r in local.filter("last").select("part", group, "rank", *names).orderBy("part").collect():
        part, g, rank, *values = r
        if now is not None:
            by = [pow(base, now[1], prime) for _, prime, base in zip(series, PRIMES, BASES, strict=False)]
            out.append((part, *now[:2], *now[2], *by))
        if now is not None and now[0] == g:
            plain = len(names) - len(series)
            added = [a + v for a, v in zip(now[2][:plain], values[:plain], strict=True)]
            turned = [(a + v * w) % p for a, v, w, p in zip(now[2][plain:], values[plain:], by, PRIMES, strict=False)]
            now = (g, now[1] + rank, [*added, *turned])
        else:
            now = (g, rank, values)
    return out
