"""Queries against DuckDB on the smallest tables, and the same bits however they are partitioned."""

import math
import os

import pytest

from latticework.functions import stencil
from latticework.functions import vectors as V
from latticework.queries import ORACLES, QUERIES, grids, vectors


@pytest.fixture(scope="module")
def base(smoke):
    import duckdb

    found = duckdb.connect()
    for file in os.listdir(smoke):
        found.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{smoke}/{file}'")
    return found


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) or (math.isnan(a) and math.isnan(b))
    return a == b


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(name, spark, smoke, base):
    df = QUERIES[name](spark, smoke)
    columns = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    done = base.execute(ORACLES[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == columns
    wanted = sorted((tuple(r[names.index(c)] for c in columns) for r in done.fetchall()), key=repr)
    assert len(rows) == len(wanted)
    assert all(same(x, y) for a, b in zip(rows, wanted, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql(name, spark, smoke):
    assert QUERIES[name](spark, smoke).count() > 0


def test_dense_solvers_agree(spark, smoke):
    rows = QUERIES["dense_solvers"](spark, smoke).collect()
    by = {}
    for r in rows:
        if r.converged:
            by.setdefault(r.i, []).append(r.x)
    assert len(by) == vectors.DIMENSIONS and all(max(v) - min(v) <= 1e-3 * max(1.0, max(map(abs, v))) for v in by.values())


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_ordered_sum_has_the_same_bits(parts, spark, smoke):
    vector = vectors.vector(spark, smoke)
    one = V.ordered_sum(vector, vector["x"] * vector["y"]).first()
    again = vector.repartition(parts)
    assert V.ordered_sum(again, again["x"] * again["y"]).first() == one


def test_cell_table_has_the_bits_of_the_arrays(spark, smoke):
    cells = grids.cells(spark, smoke).withColumn("x", grids.F.lit(0.0)).repartition(5)
    swept = stencil.iterate(cells, stencil.jacobi, 2)
    arrays = grids._solution("jacobi", 2)(spark, smoke)
    assert swept.select("i", "j", "x").exceptAll(arrays).isEmpty()


@pytest.mark.parametrize("name", ["bisection", "newton", "brent", "bisection_native", "newton_native"])
def test_roots_of_one_file_are_many_tasks(name, spark, smoke):
    df = QUERIES[name](spark, smoke)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = df.groupBy(grids.F.spark_partition_id()).count().collect()
    assert len(sizes) == tasks and max(r["count"] for r in sizes) <= 2 * min(r["count"] for r in sizes)
