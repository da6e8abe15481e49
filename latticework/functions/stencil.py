"""The five-point grid as a cell table (i, j, b, x): sweeps by window functions.

Neighbours come from lag and lead along rows and columns, with the zero ring as
their default; the update is one left-to-right expression, so its bits are those of
the array kernels. Two shuffles a sweep, whatever the size.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import require


def neighbours(cells: DataFrame, x: str = "x") -> DataFrame:
    """Adds left, right, up and down."""
    row, column = W.partitionBy("i").orderBy("j"), W.partitionBy("j").orderBy("i")
    near = {"left": F.lag(x, 1, 0.0).over(row), "right": F.lead(x, 1, 0.0).over(row), "up": F.lag(x, 1, 0.0).over(column), "down": F.lead(x, 1, 0.0).over(column)}
    return cells.withColumns(near)


def _around() -> Column:
    return F.col("b") + F.col("left") + F.col("right") + F.col("up") + F.col("down")


def _applied(x: str) -> Column:
    return F.lit(4.0) * F.col(x) - F.col("left") - F.col("right") - F.col("up") - F.col("down")


def apply(cells: DataFrame, x: str = "x") -> DataFrame:
    """(i, j, y): the operator's image of x."""
    return neighbours(cells, x).select("i", "j", _applied(x).alias("y"))


def residual(cells: DataFrame) -> DataFrame:
    """(i, j, r): right-hand side minus image."""
    return neighbours(cells).select("i", "j", (F.col("b") - _applied("x")).alias("r"))


def jacobi(cells: DataFrame) -> DataFrame:
    return neighbours(cells).select("i", "j", "b", (F.lit(0.25) * _around()).alias("x"))


def coloured(cells: DataFrame, omega: float, colour: int) -> DataFrame:
    """Relaxes the cells of one colour (0: i + j even)."""
    new = F.lit(1.0 - omega) * F.col("x") + F.lit(0.25 * omega) * _around()
    return neighbours(cells).select("i", "j", "b", F.when((F.col("i") + F.col("j")) % 2 == colour, new).otherwise(F.col("x")).alias("x"))


def richardson(cells: DataFrame, omega: float) -> DataFrame:
    return neighbours(cells).select("i", "j", "b", (F.col("x") + F.lit(omega) * (F.col("b") - _applied("x"))).alias("x"))


def red_black(cells: DataFrame, omega: float = 1.0) -> DataFrame:
    return coloured(coloured(cells, omega, 0), omega, 1)


def iterate(cells: DataFrame, sweep: Callable[[DataFrame], DataFrame], sweeps: int, every: int = 5) -> DataFrame:
    """``sweeps`` sweeps; lineage is cut by a checkpoint in the shared folder every few."""
    context = cells.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        require(bool(shared) or context.master.startswith("local"), "on a cluster, spark.checkpoint.dir must name a shared folder")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    for k in range(sweeps):
        cells = sweep(cells)
        if (k + 1) % every == 0 and k + 1 < sweeps:
            cells = cells.checkpoint()
    return cells
