"""Execution layouts by name: how a grid's cells are laid out while they are swept.

Every layout takes the cells (i, j, b) of an n x n grid and returns (i, j, x) after a
fixed number of sweeps from zero; the bits are the same in each.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import errors
from ..functions import stencil
from . import solvers
from .kernels import optimal_omega

Layout = Callable[[DataFrame, int, str, int], DataFrame]


def arrow(cells: DataFrame, n: int, solver: str, sweeps: int) -> DataFrame:
    """The grid as arrays in one row, swept by numpy; any solver, and a grid that fits a task."""
    ordered = F.array_sort(F.collect_list(F.struct("i", "j", "b")))
    system = cells.agg(F.transform(ordered, lambda c: c["b"]).alias("b")).select(F.lit("grid").alias("system"), F.lit(n).alias("n"), "b")
    options = solvers.Options(mode="fixed", max_iterations=sweeps, check_interval=max(1, sweeps))
    at = F.col("p").cast("long")
    out = solvers.solve(system, [solver], options).select(F.posexplode("x").alias("p", "x"))
    return out.select((F.floor(at / n) + 1).alias("i"), (at % n + 1).alias("j"), "x")


def relational(cells: DataFrame, n: int, solver: str, sweeps: int) -> DataFrame:
    """The grid as a cell table, swept by window functions; a grid of any size, solvers without an order within a sweep."""
    known = {
        "jacobi": stencil.jacobi,
        "richardson": lambda c: stencil.richardson(c, 0.125),
        "gauss_seidel_rb": stencil.red_black,
        "sor_rb": lambda c: stencil.red_black(c, optimal_omega(n)),
    }
    if solver not in known:
        raise errors.ConfigurationError(f"the relational layout has no {solver!r}; known: {', '.join(known)}")
    return stencil.iterate(cells.withColumn("x", F.lit(0.0)), known[solver], sweeps).select("i", "j", "x")


LAYOUTS: dict[str, Layout] = {"arrow": arrow, "relational": relational}


def register(name: str, layout: Layout) -> None:
    if not name or name in LAYOUTS:
        raise errors.InvalidArgument(f"layout name {name!r} is empty or taken")
    LAYOUTS[name] = layout


def find(name: str) -> Layout:
    if name not in LAYOUTS:
        raise errors.ConfigurationError(f"unknown layout {name!r}; known: {', '.join(LAYOUTS)}")
    return LAYOUTS[name]


@contextmanager
def relayed() -> Iterator[None]:
    """Failures of tasks as this library's own errors, others as BackendFailure; the session stays usable.

    Spark attempts every task of a stage that it has started, and reports the first that failed for good.
    """
    try:
        yield
    except (PySparkException, Py4JJavaError) as failure:
        named = re.findall(r"latticework\.errors\.(\w+): ([^\n]*)", str(failure))
        kind = getattr(errors, named[-1][0], None) if named else None
        if kind:
            raise kind(named[-1][1]) from failure
        raise errors.BackendFailure(str(failure).split("\n", 1)[0]) from failure
