"""Numerics queries: direct solves, roots, quadrature and ODEs, a case per group or row of a table.

Sums that make up a case are exact integers, so a case is the same on any cluster.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import expressions as E
from ..operators import numerics as N
from ..operators.kernels import determinant, factorise
from ..session import spread, table

EXACT = "decimal(20,0)"


def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal equations of price over (1, quantity, discount in percent) by return flag: columns m and r."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast(EXACT).alias("q"), F.round(F.col("l_discount") * 100).cast(EXACT).alias("d"), F.round(F.col("l_extendedprice") * 100).cast(EXACT).alias("p")
    )
    one, terms = F.lit(1).cast(EXACT), ("q", "d")
    columns = [one, *map(F.col, terms)]

    def total(a, b):
        return (F.sum((a * b).cast("decimal(30,0)")).cast("double"))

    m = [total(columns[min(i, j)], columns[max(i, j)]) for i in range(3) for j in range(3)]
    return lines.groupBy("flag").agg(F.array(*m).alias("m"), F.array(*[total(c, F.col("p")) for c in columns]).alias("r"))


_MOMENTS = """s AS (SELECT l_returnflag AS flag, count(*)::DOUBLE AS n, sum(q)::DOUBLE AS sq, sum(d)::DOUBLE AS sd, sum(q * q)::DOUBLE AS qq, sum(q * d)::DOUBLE AS qd, sum(d * d)::DOUBLE AS dd, sum(p)::DOUBLE AS sp, sum(q * p)::DOUBLE AS qp, sum(d * p)::DOUBLE AS dp
  FROM (SELECT l_returnflag, l_quantity::BIGINT AS q, round(l_discount * 100)::BIGINT AS d, round(l_extendedprice * 100)::BIGINT AS p FROM lineitem) GROUP BY 1)"""


def _det(a: str, b: str, c: str) -> str:
    x, y, z = (v.split() for v in (a, b, c))
    return " + ".join(f"{x[i]} * ({y[j]} * {z[k]} - {y[k]} * {z[j]})" for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)))


_DET = _det("n sq sd", "sq qq qd", "sd qd dd")
_CRAMER = [_det("sp sq sd", "qp qq qd", "dp qd dd"), _det("n sp sd", "sq qp qd", "sd dp dd"), _det("n sq sp", "sq qq qp", "sd qd dp")]


def lu_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    def case(flag, m, r):
        x, d = N.lu_solve(np.array(list(m)).reshape(3, 3), np.array(list(r)))
        return {"flag": flag, "c0": x[0], "c1": x[1], "c2": x[2], "converged": d.converged}

    out = N.per_row(_moments(spark, sf_dir), case, "flag string, c0 double, c1 double, c2 double, converged boolean")
    return out.select("flag", "converged", *[F.round(F.col(c) / 1e6, 7).alias(c) for c in ("c0", "c1", "c2")])


def lu_det(spark: SparkSession, sf_dir: str) -> DataFrame:
    def case(flag, m, r):
        return {"flag": flag, "det": determinant(factorise(np.array(list(m)).reshape(3, 3))) / m[0] ** 3}

    return N.per_row(_moments(spark, sf_dir), case, "flag string, det double").select("flag", F.round("det", 5).alias("det"))


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(flag, q, y): mean price, in units of 10,000, by return flag and quantity; as many rows as quantities."""
    lines = table(spark, sf_dir, "lineitem")
    sums = lines.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("int").alias("q")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast(EXACT)).cast("double").alias("s"), F.count("*").alias("n"))
    return sums.select("flag", "q", (F.col("s") / F.col("n") / 1e6).alias("y"))


_BINS = "bins AS (SELECT l_returnflag AS flag, l_quantity::INTEGER AS q, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / count(*) / 1e6 AS y FROM lineitem GROUP BY 1, 2)"


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("q", "y")))
    return _bins(spark, sf_dir).groupBy("flag").agg(ordered.alias("s")).select("flag", F.transform("s", lambda v: v["q"]).alias("q"), F.transform("s", lambda v: v["y"]).alias("y"))


def qr_lstsq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line of mean price over quantity, and the residual norm."""

    def case(flag, q, y):
        x, d = N.qr_solve(np.stack([np.ones(len(q)), np.asarray(q, float)], axis=1), np.asarray(y, float))
        return {"flag": flag, "intercept": x[0], "slope": x[1], "residual": d.error_estimate}

    out = N.per_row(_series(spark, sf_dir), case, "flag string, intercept double, slope double, residual double")
    return out.select("flag", *[F.round(c, 8).alias(c) for c in ("intercept", "slope", "residual")])


def thomas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean prices smoothed by the tridiagonal system (-1, 4, -1)."""

    def case(flag, q, y):
        n = len(q)
        return {"flag": flag, "q": list(q), "x": N.thomas(np.full(n, -1.0), np.full(n, 4.0), np.full(n, -1.0), np.asarray(y, float)).tolist()}

    out = N.per_row(_series(spark, sf_dir), case, "flag string, q array<int>, x array<double>")
    return out.select("flag", F.explode(F.arrays_zip("q", "x")).alias("e")).select("flag", "e.q", F.round("e.x", 12).alias("x"))


def _balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, a): one more than each balance's size, dealt over all tasks."""
    return spread(table(spark, sf_dir, "customer").select("c_custkey", (F.abs("c_acctbal") + 1.0).alias("a")))


def _root(method: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Square root of each customer's balance plus one, as the root of a parabola."""

        def case(c_custkey, a):
            def f(x):
                return x * x - a

            if method == "newton":
                x, d = N.newton(f, lambda x: 2 * x, a, tolerance=1e-11)
            else:
                x, d = getattr(N, method)(f, 0.0, a + 1.0, tolerance=1e-11)
            return {"c_custkey": c_custkey, "root": x, "converged": d.converged}

        return N.per_row(_balances(spark, sf_dir), case, "c_custkey long, root double, converged boolean").withColumn("root", F.round("root", 7))

    return query


def _integral(method: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Integral of cos(s x) over [0, 1] for each size s / 10 of parts."""

        def case(p_size, parts):
            value, d = getattr(N, method)(lambda x: math.cos(p_size / 10.0 * x), 0.0, 1.0)
            return {"p_size": p_size, "parts": parts, "integral": value, "converged": d.converged}

        rows = table(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("parts"))
        return N.per_row(rows, case, "p_size int, parts long, integral double, converged boolean").withColumn("integral", F.round("integral", 8))

    return query


def rk4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decay y' = -k y over one unit of time in 20 steps, k from the size of parts."""

    def case(p_size, parts):
        path, d = N.rk4(lambda t, y: [-p_size / 10.0 * y[0]], 0.0, [1.0], 1.0, 20)
        return {"p_size": p_size, "parts": parts, "y": path[-1][1][0], "evaluations": d.evaluations}

    rows = table(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("parts"))
    return N.per_row(rows, case, "p_size int, parts long, y double, evaluations int").withColumn("y", F.round("y", 10))


def dormand_prince(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same decay by adaptive steps, to the solution's own accuracy."""

    def case(p_size, parts):
        path, d = N.dormand_prince(lambda t, y: [-p_size / 10.0 * y[0]], 0.0, [1.0], 1.0, tolerance=1e-11)
        return {"p_size": p_size, "parts": parts, "y": path[-1][1][0], "converged": d.converged}

    rows = table(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("parts"))
    return N.per_row(rows, case, "p_size int, parts long, y double, converged boolean").withColumn("y", F.round("y", 7))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("parts"))


def bisection_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The square root of each balance's size as a root, as an expression."""
    a = F.col("a")
    rows = _balances(spark, sf_dir).select("c_custkey", E.bisection(lambda x: x * x - a, F.lit(0.0), a + 1.0).alias("r"))
    return rows.select("c_custkey", F.round("r.root", 7).alias("root"), "r.converged")


def newton_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("a")
    rows = _balances(spark, sf_dir).select("c_custkey", E.newton(lambda x: x * x - a, lambda x: 2 * x, a, tolerance=1e-9).alias("r"))
    return rows.select("c_custkey", F.round("r.root", 7).alias("root"), "r.converged")


def gauss_legendre_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = E.gauss_legendre(lambda x: F.cos(F.col("p_size") / 10.0 * x), F.lit(0.0), F.lit(1.0))
    return _sizes(spark, sf_dir).select("p_size", "parts", F.round(told["value"], 8).alias("integral"), (told["error_estimate"] < 1e-8).alias("converged"))


def rk4_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decay of ``rk4`` with a row for each of its 20 steps."""
    path = E.rk4(lambda t, y: -F.col("p_size") / 10.0 * y, F.lit(0.0), F.lit(1.0), F.lit(1.0), 20)
    rows = _sizes(spark, sf_dir).select("p_size", "parts", F.posexplode(path).alias("k", "s"))
    return rows.select("p_size", "parts", "k", F.round("s.y", 8).alias("y"))


def gauss_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integral of a polynomial of degree 9 by a five-point rule: a small table joined to all sizes."""
    rule = F.broadcast(spark.createDataFrame(N.gauss_rule(5), "node double, weight double"))  # five rows
    sizes = table(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("parts"))
    s = F.col("p_size") / 10.0
    x = s / 2.0 + s / 2.0 * F.col("node")
    return sizes.join(rule).groupBy("p_size", "parts").agg(F.round(F.sum(s / 2.0 * F.col("weight") * F.pow(x, F.lit(9.0))) / F.lit(1e5), 6).alias("integral"))


QUERIES = {
    **{f.__name__: f for f in (lu_solve, lu_det, qr_lstsq, thomas)},
    **{m: _root(m) for m in ("bisection", "newton", "brent")},
    **{m: _integral(m) for m in ("adaptive_simpson", "gauss_legendre", "romberg")},
    **{f.__name__: f for f in (gauss_nodes, rk4, dormand_prince, bisection_native, newton_native, gauss_legendre_native, rk4_path)},
}

_ROOT = "SELECT c_custkey, round(sqrt(abs(c_acctbal) + 1.0::DOUBLE), 7) AS root, true AS converged FROM customer"
_INTEGRAL = "SELECT p_size, count(*) AS parts, round(sin(p_size / 10.0::DOUBLE) / (p_size / 10.0::DOUBLE), 8) AS integral, true AS converged FROM part GROUP BY p_size"
ORACLES = {
    "lu_solve": f"WITH {_MOMENTS} SELECT flag, true AS converged, " + ", ".join(f"round(({c}) / ({_DET}) / 1e6, 7) AS c{k}" for k, c in enumerate(_CRAMER)) + " FROM s",
    "lu_det": f"WITH {_MOMENTS} SELECT flag, round(({_DET}) / pow(n, 3), 5) AS det FROM s",
    "qr_lstsq": f"WITH {_BINS} SELECT flag, round(regr_intercept(y, q), 8) AS intercept, round(regr_slope(y, q), 8) AS slope, round(sqrt(regr_syy(y, q) - pow(regr_sxy(y, q), 2) / regr_sxx(y, q)), 8) AS residual FROM bins GROUP BY flag",
    "thomas": f"""WITH RECURSIVE {_BINS}, b AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY q) AS k, count(*) OVER (PARTITION BY flag) AS m FROM bins),
f(flag, k, q, m, ratio, y) AS (SELECT flag, k, q, m, -1.0::DOUBLE / 4.0::DOUBLE, y / 4.0::DOUBLE FROM b WHERE k = 1
  UNION ALL SELECT b.flag, b.k, b.q, b.m, -1.0::DOUBLE / (4.0::DOUBLE + f.ratio), (b.y + f.y) / (4.0::DOUBLE + f.ratio) FROM f JOIN b ON b.flag = f.flag AND b.k = f.k + 1),
z(flag, k, q, x) AS (SELECT flag, k, q, y FROM f WHERE k = m
  UNION ALL SELECT f.flag, f.k, f.q, f.y - f.ratio * z.x FROM z JOIN f ON f.flag = z.flag AND f.k = z.k - 1)
SELECT flag, q, round(x, 12) AS x FROM z""",
    **dict.fromkeys(("bisection", "newton", "brent", "bisection_native", "newton_native"), _ROOT),
    **dict.fromkeys(("adaptive_simpson", "gauss_legendre", "romberg", "gauss_legendre_native"), _INTEGRAL),
    "rk4_path": "SELECT p_size, parts, k::INTEGER AS k, round(pow(1 - z + z * z / 2 + -z * z * z / 6 + z * z * z * z / 24, k), 8) AS y FROM (SELECT p_size, p_size / 200.0::DOUBLE AS z, count(*) AS parts FROM part GROUP BY 1, 2), range(21) r(k)",
    "gauss_nodes": "SELECT p_size, count(*) AS parts, round(pow(p_size / 10.0::DOUBLE, 10) / 10 / 1e5, 6) AS integral FROM part GROUP BY p_size",
    "rk4": "SELECT p_size, count(*) AS parts, round(pow(1 - z + z * z / 2 + -z * z * z / 6 + z * z * z * z / 24, 20), 10) AS y, 80::INTEGER AS evaluations FROM (SELECT p_size, p_size / 200.0::DOUBLE AS z FROM part) GROUP BY p_size, z",
    "dormand_prince": "SELECT p_size, count(*) AS parts, round(exp(-p_size / 10.0::DOUBLE), 7) AS y, true AS converged FROM part GROUP BY p_size",
}
