"""Column-valued routines against those of numerics, iterate by iterate."""

import math

from pyspark.sql import functions as F

from latticework.operators import expressions as E
from latticework.operators import numerics as N


def test_bisection_and_newton_have_the_same_iterates(spark):
    rows = spark.createDataFrame([(2.0,), (10.0,), (0.5,), (4.0,)], "c double")
    c = F.col("c")
    got = rows.select("c", E.bisection(lambda x: x * x - c, F.lit(0.0), c + 1.0).alias("b"), E.newton(lambda x: x * x - c, lambda x: 2 * x, c + 1.0).alias("n")).collect()
    for r in got:
        for told, (root, d) in ((r.b, N.bisection(lambda x: x * x - r.c, 0.0, r.c + 1.0)), (r.n, N.newton(lambda x: x * x - r.c, lambda x: 2 * x, r.c + 1.0))):
            assert (told.root, told.error_estimate, told.iterations, told.converged) == (root, d.error_estimate, d.iterations, d.converged)


def test_rows_that_cannot_be_solved_have_a_reason(spark):
    x = F.col("x")
    rows = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    got = rows.select(E.bisection(lambda v: v * v + x, F.lit(-1.0), F.lit(1.0)).alias("b"), E.newton(lambda v: v + x, lambda v: 0 * v, F.lit(1.0)).alias("n"), E.bisection(lambda v: v - 3.0, F.lit(0.0), F.lit(8.0), cap=2).alias("s")).collect()
    assert [r.b.reason for r in got] == ["no_bracket"] * 3 and all(r.b.root is None and not r.b.converged for r in got)
    assert {r.n.reason for r in got} == {"breakdown"} and {r.s.reason for r in got} == {"iteration_cap"}
    ends = spark.range(1).select(E.bisection(lambda v: v, F.lit(0.0), F.lit(1.0)).alias("a"), E.bisection(lambda v: v - 1.0, F.lit(0.0), F.lit(1.0)).alias("b")).first()
    assert (ends.a.root, ends.b.root, ends.a.iterations) == (0.0, 1.0, 0)


def test_steps_stop_at_the_cap_within_a_round(spark):
    caps = (1, E.ROUND - 1, E.ROUND, E.ROUND + 1, 2 * E.ROUND + 3, 200)
    told = spark.range(1).select(*[E.bisection(lambda x: x - 0.3, F.lit(0.0), F.lit(1.0), tolerance=1e-12, cap=n).alias(f"c{n}") for n in caps]).first()
    for n in caps:
        if n < 40:
            assert (told[f"c{n}"].iterations, told[f"c{n}"].reason) == (n, "iteration_cap")
    root, d = N.bisection(lambda x: x - 0.3, 0.0, 1.0)
    assert (told.c200.root, told.c200.iterations, told.c200.converged) == (root, d.iterations, True)


def test_quadrature_and_trajectories(spark):
    told = spark.range(1).select(E.gauss_legendre(F.cos, F.lit(0.0), F.lit(1.0)).alias("g"), E.rk4(lambda t, y: y - t, F.lit(0.0), F.lit(2.0), F.lit(1.0), 10).alias("p")).first()
    value, d = N.gauss_legendre(math.cos, 0.0, 1.0)
    assert math.isclose(told.g.value, value, rel_tol=1e-15) and told.g.error_estimate < 1e-12
    path, _ = N.rk4(lambda t, y: y - t, 0.0, [2.0], 1.0, 10)
    assert [(s.t, s.y) for s in told.p] == [(t, y[0]) for t, y in path]
