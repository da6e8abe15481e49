"""Vectors and matrices as tables: partitions, reductions, products.

A vector is a table (i, x, ...) with unique i; vectors over one index are columns
of one table, so axpy and the like join nothing. ``ordered_sum`` is the only
reduction whose bits do not depend on the cluster; the others are ordinary sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNKS = 512


def block_start(n: Column, parts: Column, k: Column) -> Column:
    """First index of block k of ``parts`` balanced blocks of 0..n-1; 0 for bad arguments."""
    good = (n >= 0) & (parts > 0) & (k >= 0) & (k < parts)
    base = F.floor(F.try_divide(n, parts)).cast("long")
    extra = n - base * parts
    return F.when(good, k * base + F.least(k, extra)).otherwise(F.lit(0)).cast("long")


def block_end(n: Column, parts: Column, k: Column) -> Column:
    base = F.floor(F.try_divide(n, parts)).cast("long")
    good = (n >= 0) & (parts > 0) & (k >= 0) & (k < parts)
    return F.when(good, block_start(n, parts, k) + base + (k < n - base * parts).cast("long")).otherwise(F.lit(0)).cast("long")


def block_of(i: Column, n: Column, parts: Column) -> Column:
    """The block that holds index i."""
    base = F.floor(n / parts).cast("long")
    extra = n - base * parts
    return F.when(i < extra * (base + 1), F.floor(i / (base + 1))).otherwise(extra + F.floor((i - extra * (base + 1)) / F.greatest(base, F.lit(1)))).cast("long")


def fold(values: Column) -> Column:
    """Left-to-right sum of an array of doubles."""
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def ordered_sum(vector: DataFrame, value: Column, index: str = "i") -> DataFrame:
    """One row (n, total): at most 512 chunks by index, each and their partials from left to right.

    The position comes from counts by index range, not from one sorted partition;
    a chunk is a task's row, and 512 partials meet at the end.
    """
    n = F.lit(vector.count())
    ranked = vector.select(F.col(index).alias("i"), value.alias("v"))
    bands = ranked.withColumn("band", F.floor(F.col("i") / F.lit(4096)))
    before = bands.groupBy("band").count().withColumn("before", F.coalesce(F.sum("count").over(W.orderBy("band").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = bands.join(before.select("band", "before"), "band").withColumn("at", F.col("before") + F.row_number().over(W.partitionBy("band").orderBy("i")) - 1)
    chunks = placed.withColumn("chunk", block_of(F.col("at"), n, F.least(n, F.lit(CHUNKS))))
    in_turn = F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"])
    partial = chunks.groupBy("chunk").agg(fold(in_turn).alias("partial"))
    last = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "partial"))), lambda s: s["partial"])
    return partial.agg(n.alias("n"), fold(last).alias("total"))


def dot(vector: DataFrame, x: str, y: str) -> DataFrame:
    return vector.agg(F.sum(F.col(x) * F.col(y)).alias("dot"))


def norm(vector: DataFrame, x: str) -> DataFrame:
    return vector.agg(F.sqrt(F.sum(F.col(x) * F.col(x))).alias("norm"))


def axpy(vector: DataFrame, alpha: float, x: str, y: str) -> DataFrame:
    """y + alpha x in place of y."""
    return vector.withColumn(y, F.col(y) + F.lit(alpha) * F.col(x))


def xpby(vector: DataFrame, x: str, beta: float, y: str) -> DataFrame:
    """x + beta y in place of y."""
    return vector.withColumn(y, F.col(x) + F.lit(beta) * F.col(y))


def dominant(entries: DataFrame) -> DataFrame:
    """(i, j, a) with each diagonal entry replaced by its row's absolute sum plus 1."""
    off = entries.filter("i <> j")
    return off.unionByName(off.groupBy("i").agg((F.sum(F.abs("a")) + 1.0).alias("a")).select("i", F.col("i").alias("j"), "a"))


def gershgorin(entries: DataFrame) -> DataFrame:
    """Upper bound of the spectrum: largest row sum of diagonal and absolute off-diagonal entries."""
    rows = entries.groupBy("i").agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("a")).otherwise(F.abs("a"))).alias("bound"))
    return rows.agg(F.max("bound").alias("bound"))


def spmv(entries: DataFrame, vector: DataFrame) -> DataFrame:
    """(i, y) of a sparse matrix (i, j, a) times (i, x)."""
    x = vector.select(F.col("i").alias("j"), "x")
    return entries.join(x, "j").groupBy("i").agg(F.sum(F.col("a") * F.col("x")).alias("y"))


def matvec(rows: DataFrame, x: Column) -> DataFrame:
    """(i, y) of dense rows (i, row array) times an array, each from left to right."""
    return rows.select("i", fold(F.zip_with("row", x, lambda a, b: a * b)).alias("y"))


def owner(place: Column, n: Column, parts: Column) -> Column:
    """Which of the balanced blocks holds a place of 0 to n - 1: the inverse of block_start."""
    base, extra = F.floor(n / parts), n % parts
    small = F.when(base > 0, extra + F.floor((place - extra * (base + 1)) / base))
    return F.when(place < extra * (base + 1), F.floor(place / (base + 1))).otherwise(small)


def local_rows(rows: DataFrame, place: str, n: int | Column, parts: int) -> DataFrame:
    """Rows with the block that owns them, the rows of a block in one partition and blocks in order."""
    own = owner(F.col(place), (n if isinstance(n, Column) else F.lit(n)).cast("long"), F.lit(parts).cast("long"))
    return rows.withColumn("owner", own).repartitionByRange(parts, "owner")
