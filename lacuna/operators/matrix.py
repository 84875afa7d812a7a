"""Sparse symmetric matrices: merging, mirroring and value transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_pairs(df: DataFrame, *more_keys: str) -> DataFrame:
    """Sum of n by (x, y) and ``more_keys``."""
    return df.groupBy(*more_keys, "x", "y").agg(F.sum("n").alias("n"))


def merge_counts(df: DataFrame, *more_keys: str) -> DataFrame:
    """Sum of n by x and ``more_keys``."""
    return df.groupBy(*more_keys, "x").agg(F.sum("n").alias("n"))


def merge_scalars(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def ids_of(pairs: DataFrame) -> DataFrame:
    """Distinct ids of either end."""
    return pairs.select(F.explode(F.array("x", "y")).alias("x")).distinct()


def canonical(df: DataFrame) -> DataFrame:
    """Ends ordered so that x <= y."""
    return df.withColumns({"x": F.least("x", "y"), "y": F.greatest("x", "y")})


def mirror(df: DataFrame) -> DataFrame:
    """Both orientations of every pair, from one scan."""
    rest = [c for c in df.columns if c not in ("x", "y")]
    ways = F.explode(F.array(F.struct(F.col("x").alias("x"), F.col("y").alias("y")), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))
    return df.select(ways.alias("_w"), *rest).select("_w.x", "_w.y", *rest)


def fill_diagonal(df: DataFrame, dimension: int) -> DataFrame:
    """Drops the diagonal there is and adds (i, i, 1) for 0 <= i < dimension."""
    ones = df.sparkSession.range(dimension).select(F.col("id").alias("x"), F.col("id").alias("y"), F.lit(1).cast("long").alias("n"))
    return df.where("x <> y").select("x", "y", "n").unionByName(ones)


def binarize(df: DataFrame) -> DataFrame:
    return df.withColumn("n", F.lit(1).cast("long"))


def log1p(df: DataFrame) -> DataFrame:
    return df.withColumn("n", F.ln(F.col("n") + 1))


def mutual_information(df: DataFrame, decimals: int = 6) -> DataFrame:
    """1e6 n / (c(x) + c(y) - n), c being the sums by first column."""
    sums = df.groupBy("x").agg(F.sum("n").alias("c"))
    both = df.join(sums.withColumnRenamed("c", "cx"), "x").join(sums.select(F.col("x").alias("y"), F.col("c").alias("cy")), "y")
    return both.select("x", "y", F.round(1e6 * F.col("n") / (F.col("cx") + F.col("cy") - F.col("n")), decimals).alias("n"))


def transform(df: DataFrame, mirrored: bool = False, diagonal: int | None = None, values: str = "as_is") -> DataFrame:
    """The transforms before a decomposition, in order; ``values``: as_is, binary, log or information."""
    df = mirror(df) if mirrored else df
    df = fill_diagonal(df, diagonal) if diagonal is not None else df
    return {"as_is": lambda x: x, "binary": binarize, "log": log1p, "information": mutual_information}[values](df)
