"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes str.split()/bytes.split() treat as ASCII white space, i.e. [\x20\x09-\x0D].
WHITE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoints(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one of our own only where that is unset and everything runs in one process, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="larkspur-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it: for wide rows of which later steps need some columns.

    The shuffles of the job that wrote it are removed when it ends (Spark's own setting), since nothing needs them again.
    """
    spark = df.sparkSession
    path, key = f"{shared_checkpoints(spark)}/table-{uuid.uuid4().hex}", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
    return spark.read.schema(df.schema).parquet(path)


def fresh(names: Iterable[str], wanted: str) -> str:
    """``wanted``, or that with underscores after it until no column is called so (names do not depend on case)."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


#: Plans that give the rows of one file scan, each once.
ROW_WISE = ("Project", "Filter", "SubqueryAlias")


def is_scan(df: DataFrame) -> bool:
    """Whether ``df`` gives rows of Parquet files, each at most once and the same ones at every reading."""
    node = df._jdf.queryExecution().analyzed()
    while node.deterministic() and node.getClass().getSimpleName() in ROW_WISE:
        node = node.children().head()
    return node.getClass().getSimpleName() == "LogicalRelation" and "parquet" in node.relation().toString().lower()


def named_rows(df: DataFrame) -> DataFrame:
    """``df`` with the columns ``file`` and ``row``, which name a row alike in every reading, however the scan is split.

    They are the hash of the file's path and the row's place in it.  What is no plain scan is written first.
    """
    if not is_scan(df):
        df = stored(df)
    meta = df.metadataColumn("_metadata")
    return df.select(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("row"), *[F.col(f"`{c}`") for c in df.columns])


def encoded(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null counts as empty, a lone surrogate becomes '?'."""
    return b"" if text is None else text.encode("utf-8", "replace")


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that no block holds much more than ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total + n > limit and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def merged_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 8 << 20) -> Iterator[pa.Table]:
    """Like :func:`text_blocks`, but small batches are put together up to ``limit`` as well."""
    held: list[pa.RecordBatch] = []
    total = 0
    for block in text_blocks(batches, column, limit):
        n = pc.sum(pc.binary_length(block.column(column))).as_py() or 0
        if held and total + n > limit:
            yield pa.Table.from_batches(held)
            held, total = [], 0
        held.append(block)
        total += n
    if held:
        yield pa.Table.from_batches(held)


def row_numbers(first: int = 0) -> Iterator[int]:
    """Numbers unique over all rows of one reading: the partition in the high bits.  Another reading may be split otherwise, so write them before they are used twice."""
    base = (TaskContext.get().partitionId() << 40) + first
    while True:
        yield base
        base += 1


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema for a DDL of plain types."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(","))])


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], ddl: str) -> DataFrame:
    """mapInArrow for a function that yields dicts of columns (lists or arrays)."""
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in f(batches):
            yield pa.RecordBatch.from_arrays([x if isinstance(x := out[n.name], pa.Array) else pa.array(x, n.type) for n in schema], schema=schema)

    return df.mapInArrow(run, ddl)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def source_key(name: str = "source"):
    """A non-null key for a nullable string column; null is a value of its own."""
    return F.when(F.col(name).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(name)))
