"""XYZ text: molecules as one row of a file, atoms as rows, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import canonical_symbol, nuclear_charge

TOKENS = r"\s+"


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """(name, body): one row for each file."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("name"), F.col("value").alias("body"))


def lines(body: Column) -> Column:
    return F.split(F.regexp_replace(body, "\r", ""), "\n")


def comment_value(body: Column, name: str) -> Column:
    """name=value in the second line."""
    return F.regexp_extract(F.coalesce(F.get(lines(body), F.lit(1)), F.lit("")), rf"(?:^|\s){name}=(\S+)", 1)


def molecules(files: DataFrame) -> DataFrame:
    """name, natoms, charge, and the lines; a missing charge is 0."""
    n = F.expr("try_cast(trim(element_at(_lines, 1)) as int)")
    return (
        files.withColumn("_lines", lines(F.col("body")))
        .withColumn("natoms", n)
        .withColumn("charge", F.coalesce(comment_value(F.col("body"), "charge").try_cast("int"), F.lit(0)))
        .withColumnRenamed("_lines", "lines")
    )


def atoms(files: DataFrame) -> DataFrame:
    """(name, atom, symbol, z, x, y, c): columns after the fourth are left out; *^ in numbers is an exponent."""
    m = molecules(files).select("name", F.posexplode(F.slice("lines", F.lit(3), F.col("natoms"))).alias("atom", "line"))
    t = m.withColumn("t", F.split(F.trim("line"), TOKENS))
    number = lambda i: F.replace(F.get(F.col("t"), F.lit(i)), F.lit("*^"), F.lit("e")).try_cast("double")
    symbol = canonical_symbol(F.get("t", F.lit(0)))
    return t.select("name", "atom", symbol.alias("symbol"), nuclear_charge(symbol).alias("z"), number(1).alias("x"), number(2).alias("y"), number(3).alias("c"))


def stoichiometry(a: DataFrame) -> DataFrame:
    """(name, counts): element -> number of atoms."""
    n = a.groupBy("name", "symbol").agg(F.count("*").alias("n"))
    return n.groupBy("name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("symbol", "n")))).alias("counts"))


def xyz_text(a: DataFrame, comment: str = "") -> DataFrame:
    """(name, body) from atoms."""
    line = F.concat_ws(" ", "symbol", F.col("x").cast("string"), F.col("y").cast("string"), F.col("c").cast("string"))
    g = a.groupBy("name").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("atom", line.alias("line")))).alias("ls"))
    return g.select("name", F.concat_ws("\n", F.col("n").cast("string"), F.lit(comment), F.array_join(F.transform("ls", lambda s: s["line"]), "\n")).alias("body"))


def write_xyz(a: DataFrame, path: str, comment: str = "") -> None:
    """One folder for each molecule with its text in it."""
    xyz_text(a, comment).select("name", F.col("body").alias("value")).write.partitionBy("name").text(path)
