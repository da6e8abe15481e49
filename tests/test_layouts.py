"""Layouts, relayed failures, the command line, manifests and the knee without repetitions."""

import csv
import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework import __main__ as cli
from latticework import errors
from latticework.functions import vectors as V
from latticework.operators import kernels, layouts
from latticework.plans import analytics as A
from latticework.sources import generators, probe, results


@pytest.mark.parametrize("solver", ["jacobi", "richardson", "gauss_seidel_rb", "sor_rb"])
def test_layouts_agree_bit_for_bit(spark, solver):
    n, rhs = 6, generators.grid_rhs(6, "rich")
    cells = spark.createDataFrame([(p // n + 1, p % n + 1, float(v)) for p, v in enumerate(rhs)], "i long, j long, b double")
    both = [sorted(map(tuple, layouts.find(name)(cells, n, solver, 6).collect())) for name in ("arrow", "relational")]
    assert len(both[0]) == n * n and both[0] == both[1]


def test_layout_registry():
    with pytest.raises(errors.ConfigurationError, match="known: arrow, relational"):
        layouts.find("nope")
    for name in ("", "arrow"):
        with pytest.raises(errors.InvalidArgument):
            layouts.register(name, layouts.arrow)
    with pytest.raises(errors.ConfigurationError):
        layouts.relational(None, 3, "cg", 1)


def test_failures_of_tasks_are_relayed(spark):
    def fail(kind):
        def task(frames):
            for _ in frames:
                raise kind("pivot 3 is zero")
            yield

        return spark.range(4).mapInPandas(task, "id long")

    for kind, raised in ((errors.NumericalFailure, errors.NumericalFailure), (RuntimeError, errors.BackendFailure)):
        with pytest.raises(raised), layouts.relayed():
            fail(kind).collect()
    assert spark.range(3).count() == 3


def test_jacobi_by_bands_has_the_bits_of_one_expression(monkeypatch):
    monkeypatch.setattr(kernels, "BAND", 30)
    grid = kernels.Grid(9, generators.grid_rhs(9, "rich"))
    x = grid.jacobi(grid.jacobi(grid.start()))
    wanted = 0.25 * (grid.b[1:-1, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] + x[:-2, 1:-1] + x[2:, 1:-1])
    assert np.array_equal(grid.jacobi(x)[1:-1, 1:-1], wanted)


@pytest.mark.parametrize("n", [0, 1, 3, 7, 20])
def test_owner_is_the_inverse_of_blocks(spark, n):
    rows = spark.range(n).withColumn("k", V.owner(F.col("id"), F.lit(n).cast("long"), F.lit(4).cast("long"))).collect()
    wanted = [k for k, (a, b) in enumerate(kernels.split(n, 4)) for _ in range(a, b)]
    assert [r.k for r in rows] == wanted


@pytest.mark.parametrize(
    "line",
    ["--size abc", "--size 12abc", "--size +3", "--size", "--tolerance 1e", "--tolerance 0x1", "--nope", "--reps 0", "--workers 99999999999", "--seed -1", "--size ٣"],
)
def test_command_lines_that_cannot_be_read(line, capsys):
    assert cli.main(line.split()) == 2
    assert "try --help" in capsys.readouterr().err


@pytest.mark.parametrize(
    ("line", "code"),
    [("--help", 0), ("--version", 0), ("--list", 0), ("--header", 0), ("--backend nope", 1), ("--solver nope", 1), ("--problem nope", 1), ("--solver sor_rb --problem dense_spd", 3), ("--solver cg --problem dense_dd", 3), ("--backend cuda", 4), ("--topology", 4)],
)
def test_exit_codes(line, code, capsys):
    assert cli.main(line.split()) == code


@pytest.mark.parametrize("line", ["--solver richardson --size 7", "--solver cg --problem dense_spd --size 8 --rhs sine", "--backend relational --mode fixed --iterations 2 --size 4"])
def test_rows_of_runs(spark, capsys, line):
    assert cli.main([*line.split(), "--reps", "2", "--label", "a b"]) == 0
    values = next(csv.reader(io.StringIO(capsys.readouterr().out.splitlines()[-1])))
    row = dict(zip([c for c, _ in results.COLUMNS], values, strict=True))
    assert row["label"] == "a b" and row["reps"] == "2" and len(row["seconds_reps"].split(";")) == 2
    assert row["stop_reason"] == ("iteration_cap" if "fixed" in line else "converged")


def test_triad_probe(spark):
    told = probe.stream_triad(spark, 1000, 2)
    assert told["seconds"] > 0 and told["gib_per_second"] > 0
    with pytest.raises(errors.InvalidArgument):
        probe.stream_triad(spark, 0)


def test_manifest_is_refreshed_and_read_again(spark, tmp_path):
    empty = spark.createDataFrame([], f"{results.MANIFEST}, stamp string")

    def bandwidth(value):
        reps = F.create_map(F.lit("plain"), F.create_map(F.lit("1"), F.array(F.lit(value))))
        return F.struct(reps.alias("repetitions"))

    model = F.create_map(F.lit("outcome"), F.lit("store miss"))
    first = results.refresh_bandwidth(empty, "abc", bandwidth(1.0), model, "first", "20260101T000000Z")
    results.write_manifest(first, str(tmp_path), "abc", "20260101T000000Z")
    read = results.read_manifests(spark, str(tmp_path))
    second = results.refresh_bandwidth(read, "abc", bandwidth(2.0), model, "second", "20260202T000000Z").first()
    assert second.stamp == "20260101T000000Z" and second.bandwidth_refreshed == "20260202T000000Z"
    assert second.bandwidth.repetitions == {"plain": {"1": [2.0]}} and second.bandwidth_previous.repetitions == {"plain": {"1": [1.0]}}
    with pytest.raises(errors.InvalidArgument):
        results.write_manifest(read, str(tmp_path), "abc", "yesterday")


def test_knee_without_repetitions(spark):
    rows = [(1, x, [float(8 - x)] if x % 2 else None, 7.0 - x, 8.0 - x, 9.0 - x, 3) for x in range(1, 7)]
    rows += [(2, x, None, None, None, None, None) for x in range(1, 7)]
    points = spark.createDataFrame(rows, "k int, x int, reps array<double>, seconds_min double, seconds_median double, seconds_max double, n int")
    got = A.bootstrap_knee(points, ["k"], resamples=20).collect()
    assert [r.k for r in got] == [1] and all(math.isfinite(v) for v in got[0][1:])
