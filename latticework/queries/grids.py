"""Grid queries: parts fall into the cells of an n x n grid, whose mean price is the right-hand side.

The aggregation runs over the whole table; what is solved is the grid, in arrays of
one row (any number of rows solve in parallel) or as a cell table. The SQL carries
the iterate as a list through a recursive query, operand by operand in the same
order, so results agree to the bit.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stencil
from ..operators import solvers
from ..operators.kernels import Grid
from ..session import table
from ..sources.generators import grid_rhs

N, SWEEPS = 15, 10
H2 = 1.0 / (N + 1) ** 2


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, b, x) of every cell; cells without parts hold 0."""
    part = table(spark, sf_dir, "part")
    key = part.select(
        (F.col("p_partkey") % N + 1).cast("int").alias("i"),
        (F.floor(F.col("p_partkey") / N) % N + 1).cast("int").alias("j"),
        F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"),
        "p_size",
    )
    mean = key.groupBy("i", "j").agg(F.sum("cents").cast("double").alias("s"), F.count("*").alias("n"), F.sum("p_size").cast("double").alias("z"))
    own = mean.select("i", "j", ((F.col("s") / 100.0 / F.col("n") - 1000.0) / 1000.0 * H2).alias("b"), (F.col("z") / F.col("n") / 50.0).alias("x"))
    every = spark.range(N * N).select((F.floor(F.col("id") / N) + 1).cast("int").alias("i"), (F.col("id") % N + 1).cast("int").alias("j"))
    return every.join(F.broadcast(own), ["i", "j"], "left").select("i", "j", F.coalesce("b", F.lit(0.0)).alias("b"), F.coalesce("x", F.lit(0.0)).alias("x"))


_CELLS = f"""cells AS (SELECT g.i, g.j, coalesce(b, 0.0::DOUBLE) AS b, coalesce(x, 0.0::DOUBLE) AS x
  FROM (SELECT (a.range + 1)::INTEGER AS i, (c.range + 1)::INTEGER AS j FROM range({N}) a, range({N}) c) g
  LEFT JOIN (SELECT (p_partkey % {N} + 1)::INTEGER AS i, ((p_partkey // {N}) % {N} + 1)::INTEGER AS j,
      (sum(round(p_retailprice * 100)::BIGINT)::DOUBLE / 100.0::DOUBLE / count(*) - 1000.0::DOUBLE) / 1000.0::DOUBLE * {H2!r}::DOUBLE AS b,
      sum(p_size)::DOUBLE / count(*) / 50.0::DOUBLE AS x
    FROM part GROUP BY 1, 2) q ON g.i = q.i AND g.j = q.j)"""
_LISTS = f"{_CELLS},\nst AS (SELECT list(b ORDER BY i, j) AS b FROM cells)"


def _d(value: float) -> str:
    return f"'{float(value)!r}'::DOUBLE"


def _near(x: str, n: int = N) -> dict[str, str]:
    zero = "0.0::DOUBLE"
    return {
        "l": f"(CASE WHEN (p - 1) % {n} = 0 THEN {zero} ELSE {x}[p - 1] END)",
        "r": f"(CASE WHEN p % {n} = 0 THEN {zero} ELSE {x}[p + 1] END)",
        "u": f"(CASE WHEN p <= {n} THEN {zero} ELSE {x}[p - {n}] END)",
        "d": f"(CASE WHEN p > {n * (n - 1)} THEN {zero} ELSE {x}[p + {n}] END)",
    }


def _around(x: str) -> str:
    return "(v + {l} + {r} + {u} + {d})".format(**_near(x))


def _image(x: str, at: str = "p") -> str:
    return f"({_d(4.0)} * {x}[{at}]" + " - {l} - {r} - {u} - {d})".format(**_near(x))


def _listed(state: str) -> str:
    return f"SELECT ((p - 1) // {N} + 1)::INTEGER AS i, ((p - 1) % {N} + 1)::INTEGER AS j, x FROM (SELECT unnest(range(1, {N * N + 1})) AS p, unnest(x) AS x FROM {state})"


def _iterated(steps: int, mask: str, new: str) -> str:
    """Steps over the cells under ``mask``, which may use t and p."""
    return f"""WITH RECURSIVE {_LISTS},
s(t, x) AS (SELECT 0, list_transform(b, lambda v: 0.0::DOUBLE) FROM st
  UNION ALL SELECT t + 1, list_transform(st.b, lambda v, p: CASE WHEN {mask} THEN {new} ELSE s.x[p] END) FROM s, st WHERE t < {steps})
{_listed(f"s WHERE t = {steps}")}"""


def _relaxed(omega: float) -> str:
    return f"{_d(1.0 - omega)} * s.x[p] + {_d(0.25 * omega)} * {_around('s.x')}"


_OMEGA = Grid(N, grid_rhs(N)).omega
_SPAN = 2 * N - 1
_DIAGONAL = f"((p - 1) // {N} + (p - 1) % {N})"
_FORWARD, _BACKWARD = f"{_DIAGONAL} = t % {_SPAN}", f"{_DIAGONAL} = {_SPAN - 1} - t % {_SPAN}"
_BOTH = f"{_DIAGONAL} = CASE WHEN (t // {_SPAN}) % 2 = 0 THEN t % {_SPAN} ELSE {_SPAN - 1} - t % {_SPAN} END"
_COLOUR = f"{_DIAGONAL} % 2 = t % 2"


def _blocks(sweeps: int, lagged: bool) -> str:
    """Tridiagonal line solves a column at a time: down, back up, and the lines put in place."""
    turn = 2 * N + 1
    grid = Grid(N, grid_rhs(N))
    pivot, ratio = ("[" + ", ".join(_d(float(v)) for v in values) + "]" for values in (grid.pivot, grid.ratio))
    near = _near("s.x")
    own = "true" if lagged else f"(p - 1) // {N} = (s.t // {turn}) % {N}"
    u = f"(s.t % {turn})"
    column = f"((p - 1) % {N})"
    given = f"(v + {near['u']} + {near['d']})"
    down = f"CASE WHEN {u} = 0 THEN {given} ELSE {given} + s.y[p - 1] END / ({pivot})[{u} + 1]"
    up = f"s.y[p] - ({ratio})[{column} + 1] * s.y[p + 1]"
    steps = turn * sweeps * (1 if lagged else N)
    return f"""WITH RECURSIVE {_LISTS},
s(t, x, y) AS (SELECT 0, list_transform(b, lambda v: 0.0::DOUBLE), list_transform(b, lambda v: 0.0::DOUBLE) FROM st
  UNION ALL SELECT s.t + 1,
    CASE WHEN {u} = {2 * N} THEN list_transform(s.x, lambda v, p: CASE WHEN {own} THEN s.y[p] ELSE v END) ELSE s.x END,
    CASE WHEN {u} = {2 * N} THEN s.y ELSE list_transform(st.b, lambda v, p: CASE WHEN NOT ({own}) THEN s.y[p]
      WHEN {u} < {N} AND {column} = {u} THEN {down}
      WHEN {u} > {N} AND {column} = {2 * N - 1} - {u} THEN {up} ELSE s.y[p] END) END
  FROM s, st WHERE s.t < {steps})
{_listed(f"s WHERE t = {steps}")}"""


def _dot(a: str, b: str) -> str:
    row = f"list_reduce(list_transform(range({N}), lambda c: {a}[k * {N} + c + 1] * {b}[k * {N} + c + 1]), lambda e, f: e + f)"
    return f"list_reduce(list_transform(range({N}), lambda k: {row}), lambda g, h: g + h)"


def _conjugate(steps: int) -> str:
    return f"""WITH RECURSIVE {_LISTS},
s(t, x, r, w, rr) AS (SELECT 0, list_transform(b, lambda v: 0.0::DOUBLE), b, b, {_dot("b", "b")} FROM st
  UNION ALL SELECT t + 1, x, r2, list_transform(r2, lambda v, p: v + (rr2 / rr) * w[p]), rr2 FROM (
    SELECT *, {_dot("r2", "r2")} AS rr2 FROM (
      SELECT t, w, rr, list_transform(x, lambda v, p: v + a * w[p]) AS x, list_transform(r, lambda v, p: v + (-a) * q[p]) AS r2 FROM (
        SELECT *, rr / {_dot("w", "q")} AS a FROM (
          SELECT *, list_transform(w, lambda v, p: {_image("w")}) AS q FROM s WHERE t < {steps})))))
{_listed(f"s WHERE t = {steps}")}"""


_HISTORY = f"""{_iterated(SWEEPS, "true", f"{_d(0.25)} * {_around('s.x')}").rpartition("SELECT (")[0]},
e AS (SELECT s.t, list_transform(st.b, lambda v, p: v - {_image("s.x")}) AS r, st.b AS b FROM s, st),
h AS (SELECT t AS iteration, sqrt({_dot("r", "r")}) / sqrt({_dot("b", "b")}) AS relative_residual FROM e)"""


def _system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row (system, n, b): the cells in row-major order."""
    b = F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "b"))), lambda s: s["b"])
    return cells(spark, sf_dir).agg(F.lit("parts").alias("system"), F.lit(N).alias("n"), b.alias("b"))


def _solution(name: str, sweeps: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        options = solvers.Options(mode="fixed", max_iterations=sweeps, check_interval=10**6)
        out = solvers.solve(_system(spark, sf_dir), [name], options).select(F.posexplode("x").alias("p", "x"))
        return out.select((F.floor(F.col("p") / N) + 1).cast("int").alias("i"), (F.col("p") % N + 1).cast("int").alias("j"), "x")

    return query


def _swept(sweep, sweeps: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        start = cells(spark, sf_dir).withColumn("x", F.lit(0.0))
        return stencil.iterate(start, sweep, sweeps).select("i", "j", "x")

    return query


def stencil_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.apply(cells(spark, sf_dir))


def stencil_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.residual(cells(spark, sf_dir))


_AROUND = "coalesce(lag(x) OVER r, 0.0::DOUBLE) - coalesce(lead(x) OVER r, 0.0::DOUBLE) - coalesce(lag(x) OVER c, 0.0::DOUBLE) - coalesce(lead(x) OVER c, 0.0::DOUBLE)"
_WINDOWS = "WINDOW r AS (PARTITION BY i ORDER BY j), c AS (PARTITION BY j ORDER BY i)"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = solvers.Options(mode="fixed", max_iterations=SWEEPS, history=True)
    return solvers.solve(_system(spark, sf_dir), ["jacobi"], options)


def solve_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative residual after each iteration."""
    return _history(spark, sf_dir).select(F.posexplode("history").alias("iteration", "r")).select("iteration", F.round("r", 10).alias("relative_residual"))


def convergence_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).select("solver", F.round("factor", 10).alias("factor"))


def work_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics of all solvers after a fixed number of iterations."""
    out = solvers.solve(_system(spark, sf_dir), list(solvers.SOLVERS), solvers.Options(mode="fixed", max_iterations=SWEEPS))
    return out.select("solver", "iterations", "evaluations", "converged", "reason", "sweeps", "passes")


def solver_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All solvers, to tolerance: converged, and how far the solution is from the mean over solvers."""
    out = solvers.solve(_system(spark, sf_dir), list(solvers.SOLVERS), solvers.Options(tolerance=1e-10))
    x = out.select("solver", "converged", F.posexplode("x").alias("p", "x"))
    mean = x.groupBy("p").agg(F.avg("x").alias("mean"))
    return x.join(mean, "p").groupBy("solver", "converged").agg((F.max(F.abs(F.col("x") - F.col("mean"))) < 1e-9).alias("agrees"))


def poisson_theory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectral radii and best relaxation of the grid with one side point per size of part."""
    sides = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("n")).agg(F.count("*").alias("parts"))
    angle = F.lit(math.pi) / (F.col("n") + 1)
    rho, omega = F.cos(angle), 2.0 / (1.0 + F.sin(angle))
    return sides.select("n", "parts", F.round(rho, 10).alias("rho_jacobi"), F.round(rho * rho, 10).alias("rho_gauss_seidel"), F.round(omega, 10).alias("omega"), F.round(omega - 1.0, 10).alias("rho_sor"))


def grid_sine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sine right-hand side of the grid."""
    flat = spark.range(N * N).select((F.floor(F.col("id") / N) + 1).cast("int").alias("i"), (F.col("id") % N + 1).cast("int").alias("j"))
    wave = F.lit(2.0 * math.pi * math.pi * H2) * F.sin(F.lit(math.pi / (N + 1)) * F.col("i")) * F.sin(F.lit(math.pi / (N + 1)) * F.col("j"))
    return flat.select("i", "j", F.round(wave, 12).alias("b"))


_UNITS = {"richardson": (1, 2, 11), "gauss_seidel_s": (2, 2, 31), "ssor": (2, 2, 31), "gauss_seidel_rb": (1, 2, 21), "sor_rb": (1, 2, 21), "block_jacobi": (1, 2, 21), "cg": (1, 6, 11)}

QUERIES = {
    "jacobi": _solution("jacobi", SWEEPS),
    **{name: _solution(name, SWEEPS) for name in ("richardson", "gauss_seidel_f", "gauss_seidel_b", "gauss_seidel_s", "gauss_seidel_rb", "sor", "ssor", "sor_rb", "block_jacobi")},
    "block_gauss_seidel": _solution("block_gauss_seidel", 2),
    "cg": _solution("cg", 5),
    "jacobi_cells": _swept(stencil.jacobi, 3),
    "red_black_cells": _swept(lambda c: stencil.red_black(c, _OMEGA), 2),
    **{f.__name__: f for f in (stencil_apply, stencil_residual, solve_history, convergence_factor, work_units, solver_agreement, poisson_theory, grid_sine)},
}

ORACLES = {
    "jacobi": _iterated(SWEEPS, "true", f"{_d(0.25)} * {_around('s.x')}"),
    "richardson": _iterated(SWEEPS, "true", f"s.x[p] + {_d(1 / 8.0)} * (v - {_image('s.x')})"),
    "gauss_seidel_f": _iterated(SWEEPS * _SPAN, _FORWARD, _relaxed(1.0)),
    "gauss_seidel_b": _iterated(SWEEPS * _SPAN, _BACKWARD, _relaxed(1.0)),
    "gauss_seidel_s": _iterated(2 * SWEEPS * _SPAN, _BOTH, _relaxed(1.0)),
    "gauss_seidel_rb": _iterated(2 * SWEEPS, _COLOUR, _relaxed(1.0)),
    "sor": _iterated(SWEEPS * _SPAN, _FORWARD, _relaxed(_OMEGA)),
    "ssor": _iterated(2 * SWEEPS * _SPAN, _BOTH, _relaxed(1.0)),
    "sor_rb": _iterated(2 * SWEEPS, _COLOUR, _relaxed(_OMEGA)),
    "block_jacobi": _blocks(SWEEPS, True),
    "block_gauss_seidel": _blocks(2, False),
    "cg": _conjugate(5),
    "jacobi_cells": _iterated(3, "true", f"{_d(0.25)} * {_around('s.x')}"),
    "red_black_cells": _iterated(4, _COLOUR, _relaxed(_OMEGA)),
    "stencil_apply": f"WITH {_CELLS} SELECT i, j, 4.0::DOUBLE * x - {_AROUND} AS y FROM cells {_WINDOWS}",
    "stencil_residual": f"WITH {_CELLS} SELECT i, j, b - (4.0::DOUBLE * x - {_AROUND}) AS r FROM cells {_WINDOWS}",
    "solve_history": f"{_HISTORY} SELECT iteration, round(relative_residual, 10) AS relative_residual FROM h",
    "convergence_factor": f"{_HISTORY} SELECT 'jacobi' AS solver, round(pow(max(relative_residual) FILTER (iteration = {SWEEPS}) / max(relative_residual) FILTER (iteration = 0), {_d(1 / SWEEPS)}), 10) AS factor FROM h",
    "work_units": "SELECT solver, 10::BIGINT AS iterations, evaluations::BIGINT AS evaluations, false AS converged, 'iteration_cap' AS reason, sweeps, passes FROM (VALUES "
    + ", ".join(f"('{s}', {e}, {w}, {p})" for s in solvers.SOLVERS for w, p, e in [_UNITS.get(s, (1, 1, 21))])
    + ") t(solver, evaluations, sweeps, passes)",
    "solver_agreement": "SELECT solver, true AS converged, true AS agrees FROM (VALUES " + ", ".join(f"('{s}')" for s in solvers.SOLVERS) + ") t(solver)",
    "poisson_theory": "SELECT n, parts, round(c, 10) AS rho_jacobi, round(c * c, 10) AS rho_gauss_seidel, round(w, 10) AS omega, round(w - 1.0, 10) AS rho_sor FROM (SELECT p_size AS n, count(*) AS parts, cos(pi() / (p_size + 1)) AS c, 2.0 / (1.0 + sin(pi() / (p_size + 1))) AS w FROM part GROUP BY p_size)",
    "grid_sine": f"SELECT i::INTEGER AS i, j::INTEGER AS j, round({_d(2.0 * math.pi * math.pi * H2)} * sin({_d(math.pi / (N + 1))} * i) * sin({_d(math.pi / (N + 1))} * j), 12) AS b FROM range(1, {N + 1}) a(i), range(1, {N + 1}) c(j)",
}
