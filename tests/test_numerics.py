"""Direct solves, roots, quadrature, ODEs; readers and writers; analytics on small tables."""

import math
import random

import numpy as np
import pytest

from latticework.errors import InvalidArgument, NumericalFailure
from latticework.operators import numerics as N
from latticework.operators.kernels import determinant, factorise
from latticework.plans import analytics as A
from latticework.session import check_contract
from latticework.sources import results


def test_bisection():
    x, d = N.bisection(lambda x: x * x - 2, 0, 2)
    assert abs(x - math.sqrt(2)) <= max(1e-11, d.error_estimate) and d.converged
    with pytest.raises(InvalidArgument):
        N.bisection(lambda x: 1e-200, 0, 1)
    assert N.bisection(lambda x: 1e200 if x > 0.3 else -1e200, 0, 1)[1].converged
    with pytest.raises(InvalidArgument):
        N.bisection(lambda x: math.nan, 0, 1)
    assert N.bisection(lambda x: x, 0, 1)[0] == 0


def test_newton():
    x, d = N.newton(lambda x: x * x - 2, lambda x: 2 * x, 1.0)
    assert d.iterations <= 8 and d.evaluations == 2 * d.iterations and abs(x - math.sqrt(2)) < 1e-12
    with pytest.raises(NumericalFailure):
        N.newton(lambda x: x * x + 1, lambda x: 2 * x, 0.0)


def test_brent_needs_fewer_calls_than_bisection():
    def f(x):
        return math.cos(x) - x

    a, b = N.brent(f, 0, 2), N.bisection(f, 0, 2)
    assert abs(a[0] - b[0]) < 1e-10 and a[1].evaluations < b[1].evaluations


def test_quadrature():
    assert abs(N.adaptive_simpson(math.sin, 0, math.pi)[0] - 2) < 1e-10
    assert abs(N.adaptive_simpson(lambda x: x**3, 0, 2)[0] - 4) < 1e-12
    assert abs(N.gauss_legendre(lambda x: x**9 + x**8, -1, 1, 6)[0] - 2 / 9) < 1e-12
    for n in (2, 5, 12, 33):
        assert abs(sum(w for _, w in N.gauss_rule(n)) - 2) < 1e-13
    assert abs(N.romberg(lambda x: math.exp(-x * x), 0, 1)[0] - math.sqrt(math.pi) / 2 * math.erf(1)) < 1e-11


def test_lu_and_qr():
    a, b = np.array([[0.0, 2, 1], [1, 1, 1], [2, 1, 3]]), np.array([3.0, 3, 6])
    x, d = N.lu_solve(a, b)
    assert np.allclose(a @ x, b) and d.converged and determinant(factorise(a)) == pytest.approx(np.linalg.det(a))
    assert np.allclose(N.qr_solve(a, b)[0], x)
    with pytest.raises(NumericalFailure):
        factorise(np.ones((2, 2)))
    with pytest.raises(NumericalFailure):
        N.qr_solve(np.ones((3, 2)), np.ones(3))


def test_thomas():
    draw = np.random.default_rng(1)
    for n in (0, 1, 2, 9):
        low, up = draw.uniform(-1, 1, n), draw.uniform(-1, 1, n)
        x = draw.uniform(-1, 1, n)
        full = np.diag(np.full(n, 3.0)) + np.diag(low[1:], -1) + np.diag(up[:-1], 1) if n else np.zeros((0, 0))
        assert np.allclose(N.thomas(low, np.full(n, 3.0), up, full @ x), x)
    with pytest.raises(InvalidArgument):
        N.thomas([0, 1], [1, 0.5], [1, 0], [1, 1])


def test_odes():
    errors = [abs(N.rk4(lambda t, y: [-2 * y[0]], 0, [1.0], 1, n)[0][-1][1][0] - math.exp(-2)) for n in (10, 20, 40, 80)]
    orders = [math.log2(a / b) for a, b in zip(errors, errors[1:], strict=False)]
    assert all(abs(o - 4) < 0.15 for o in orders)
    path, d = N.dormand_prince(lambda t, y: [-y[0]], 0, [1.0], 1, tolerance=1e-9)
    assert abs(path[-1][1][0] - math.exp(-1)) < 1e-7 and d.converged
    back, _ = N.dormand_prince(lambda t, y: [-y[0]], 1, [math.exp(-1)], 0, tolerance=1e-9)
    assert abs(back[-1][1][0] - 1) < 1e-7
    loose = N.dormand_prince(lambda t, y: [-y[0]], 0, [1.0], 1, tolerance=1e-4)[1]
    assert loose.iterations < d.iterations
    stiff = N.dormand_prince(lambda t, y: [1 / (1e-9 + abs(t - 0.5)) ** 2 * 1e6], 0, [0.0], 1, tolerance=1e-14, floor=1e-3)[1]
    assert stiff.reason == "step_floor" and not stiff.converged


def test_contract(spark):
    check_contract(spark)


def run_row(**given):
    row = {c: None for c, _ in results.COLUMNS}
    return row | {"commit": "c", "solver": "jacobi", "unknowns": 9, "iterations": 10, "sweeps": 1, "bytes_per_unknown": 24.0} | given


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c, _ in results.COLUMNS) for r in rows], results.RUN.replace("measured_at timestamp", "measured_at timestamp"))


def test_runs_round_trip(spark, tmp_path):
    rows = frame(spark, [run_row(seconds_median=2.0, workers=1, seconds_reps="1;x;3"), run_row(workers=2)])
    results.write_runs(rows, str(tmp_path / "runs"))
    back = results.read_runs(spark, str(tmp_path / "runs"))
    assert back.columns == [c for c, _ in results.COLUMNS] and back.exceptAll(rows).isEmpty()
    rated = {r.workers: r for r in results.with_rates(back).withColumn("reps_s", results.repetition_seconds("seconds_reps")).collect()}
    assert rated[1].updates_per_second == 45.0 and rated[2].gib_per_second is None and rated[1].reps_s == [1.0, None, 3.0]
    with pytest.raises(InvalidArgument):
        results.write_runs(rows.drop("seed"), str(tmp_path / "no"))


def test_hex_round_trip(spark, tmp_path):
    draw = random.Random(1)
    values = [(i, draw.uniform(-1, 1) * 10.0 ** draw.randrange(-300, 300)) for i in range(50)] + [(50, 0.0)]
    results.write_hex(spark.createDataFrame(values, "pos long, value double"), str(tmp_path / "h"), "head")
    assert sorted(map(tuple, results.read_hex(spark, str(tmp_path / "h")).collect())) == values


def test_manifests(spark, tmp_path):
    for stamp, x in (("20260101T000000Z", 1.0), ("20260102T000000Z", 2.0)):
        (tmp_path / f"manifest-abc-{stamp}.json").write_text('{"commit": "abc", "bandwidth": {"repetitions": {"plain": {"2": [%s, 3]}}},\n "failures": []}' % x)
    found = results.newest_manifest(results.read_manifests(spark, str(tmp_path)), "abc")
    assert [tuple(r) for r in results.probes(found).collect()] == [("plain", 2, [2.0, 3.0])]
    assert results.newest_manifest(results.read_manifests(spark, str(tmp_path)), "none").isEmpty()


def test_missing_measurements_stay_missing(spark):
    rows = frame(spark, [run_row(seconds_median=0.0, seconds_min=0.0, seconds_max=1.0), run_row()])
    assert {r[0] for r in rows.select(A.spread()).collect()} == {None}
    assert {r[0] for r in rows.select(A.counted_bandwidth()).collect()} == {None}


def test_generations(spark):
    rows = frame(spark, [run_row(), run_row(commit="d.dirty")])
    with pytest.raises(InvalidArgument):
        A.generation(rows)
    assert A.generation(A.clean(rows)).count() == 1
