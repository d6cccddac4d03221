"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Size of a document: its number of words ``[^\\x20\\x09-\\x0D]+`` (null text: 0).  Sources in order of code points, null
last, take the weights in turn and share ``share`` times all sizes; no target is above ``epochs`` times its source's
size, and what a cap cuts off goes to the other sources by weight.  The water level has a closed form: sort the sources by
cap / weight; the first whose share of what is left fits under its cap fixes the level for it and all later ones.

A source's target is filled by whole repetitions of all its documents and one fractional repetition: documents in
seeded order (md5 of seed and doc_id) until the words are used up, the last of them in part.  So the words taken of a source are
its target, rounded.  The running sum over a source goes through ``16**digits`` buckets of the order,
so no task sorts a whole source.  The water level itself is found in one task over one row for each source.

Cases: null and empty texts have size 0 and take 0; repeated rows count each and share their place in
the order by turn; rows without a doc_id are ordered by their text in its place; a null source is a source; an empty table gives an empty result; other columns are ignored
and may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, source_key

WEIGHTS = (3, 1, 2)
SEED = "larkspur-mix"
NOT_SPACE = "[^\\x20\\x09-\\x0D]+"


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def water_levels(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """From (skey, source_size) to (skey, source_size, target).  The table has one row for each source."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.substring("skey", 1, 1).desc(), "skey"))).withColumn("weight", w)
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    levels = (
        ranked.withColumn("left", F.sum("source_size").over(every) * F.lit(share) - F.lit(float(epochs)) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(after))
        .withColumn("cap", F.lit(float(epochs)) * F.col("source_size"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    level = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = F.min(F.when(F.col("fits"), F.col("source_size") / F.col("weight"))).over(every)
    return levels.withColumn("first", first).select(
        "skey", "source_size", F.when(F.col("source_size") / F.col("weight") >= F.col("first"), F.least(F.col("cap"), level * F.col("weight"))).otherwise(F.col("cap")).alias("target")
    )


def order_key(seed: str):
    """Where a row stands in its source's order; null ids go by their text, so that they are not all in one place."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))))


def shares(rows: DataFrame, names: dict[str, str], weights, share: float, epochs: int, digits: int) -> DataFrame:
    """``rows`` with source_size, target, whole and part under ``names``; they have skey, bucket, place, id and size under ``names``.

    Totals of buckets are written once; the rows then meet them where the windows over buckets have put them, without another shuffle.
    """
    n = names
    buckets = cut(rows.groupBy(F.col(n["skey"]).alias("skey"), F.col(n["bucket"]).alias("bucket")).agg(F.sum(n["size"]).alias("bucket_size")))
    targets = water_levels(buckets.groupBy("skey").agg(F.sum("bucket_size").alias("source_size")), weights, share, epochs)
    # running sums in two levels: over the leading digits of a source's buckets, and over the buckets below them
    below = Window.unboundedPreceding, -1
    tops = buckets.groupBy("skey", F.substring("bucket", 1, digits // 2).alias("top")).agg(F.sum("bucket_size").alias("top_size"))
    tops = tops.select("skey", "top", F.coalesce(F.sum("top_size").over(Window.partitionBy("skey").orderBy("top").rowsBetween(*below)), F.lit(0)).alias("before_top"))
    inner = F.coalesce(F.sum("bucket_size").over(Window.partitionBy("skey", "top").orderBy("bucket").rowsBetween(*below)), F.lit(0))
    offsets = buckets.withColumn("top", F.substring("bucket", 1, digits // 2)).withColumn("inner", inner).join(tops, ["skey", "top"]).join(targets, "skey").select(
        F.col("skey").alias(n["skey"]), F.col("bucket").alias(n["bucket"]), F.col("source_size").alias(n["source_size"]), F.col("target").alias(n["target"]),
        (F.col("before_top") + F.col("inner")).alias(n["before"]),
    )
    inside = Window.partitionBy(n["skey"], n["bucket"]).orderBy(n["place"], n["id"], n["size"]).rowsBetween(Window.unboundedPreceding, -1)
    size, source_size, target = (F.col(n[x]) for x in ("size", "source_size", "target"))
    rest = F.round(target).cast("long") - F.col(n["whole"]) * source_size
    return (
        rows.withColumn(n["at"], F.coalesce(F.sum(n["size"]).over(inside), F.lit(0)))
        .join(offsets, [n["skey"], n["bucket"]])
        .withColumn(n["whole"], F.when(source_size > 0, F.floor(F.round(target) / source_size)).otherwise(0).cast("long"))
        .withColumn(n["part"], F.greatest(F.lit(0), F.least(size, rest - F.col(n["before"]) - F.col(n["at"]))).cast("long"))
    )


NAMES = ("skey", "bucket", "place", "id", "size", "source_size", "target", "before", "at", "whole", "part")


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, epochs: int = 2, seed: str = SEED, digits: int = 4) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, whole, part: one row for each row of ``docs``.  Texts are read once; sizes and places are written."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), source_key().alias("skey"), word_count(F.col("text")).alias("size"), order_key(seed).alias("place"))
    rows = cut(rows.withColumn("bucket", F.substring("place", 1, digits)))
    return shares(rows, {x: x for x in NAMES}, weights, share, epochs, digits).select(
        F.col("id").alias("doc_id"), F.when(F.col("skey") != "0", F.expr("substring(skey, 2)")).alias("source"), "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"), "whole", "part",
    )


def mixture(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, epochs: int = 2, seed: str = SEED, digits: int = 4) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, a partial one cut after its last word taken.

    All columns of ``docs`` are kept; only ``text`` of a partial repetition differs.  Each row goes through the plan itself, whole, so
    repeated and null doc_ids need no matching; it moves once.
    """
    names = docs.columns
    n = {x: fresh(names, f"_mix_{x}") for x in NAMES}
    text = F.col("text")
    rows = docs.withColumns({n["id"]: F.col("doc_id").cast("long"), n["skey"]: source_key(), n["size"]: word_count(text), n["place"]: order_key(seed)})
    planned = shares(rows.withColumn(n["bucket"], F.substring(n["place"], 1, digits)), n, weights, share, epochs, digits)
    part, cutoff = F.col(n["part"]), fresh(names, "_mix_cut")
    cases = F.concat(
        F.array_repeat(F.lit(False), F.col(n["whole"]).cast("int")),
        F.when(part > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")),
    )
    # words with the white space before them: the first ones, put together, are the text as far as the last of them
    words = F.regexp_extract_all(text, F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(words, 1, part.cast("int")), "")
    out = planned.withColumn(cutoff, F.explode(cases))
    new = F.when(F.col(cutoff) & (part < F.col(n["size"])), head).otherwise(text)
    return out.select(*[new.alias(x) if x.lower() == "text" else F.col(f"`{x}`") for x in names])
