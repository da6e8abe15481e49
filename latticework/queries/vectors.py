"""Vector and matrix queries.

The vector has an entry for each (order, line); the sparse matrix adds up quantities
by supplier and part; the dense one is the Gram matrix of all embeddings, in exact
integers. All come from whole tables by aggregations that combine before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import solvers
from ..session import table
from ..sources.probe import triad

M, DIMENSIONS = 64, 64


def vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, x, y): largest price in thousands and largest discount."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("i")).agg((F.max("l_extendedprice") / 1000.0).alias("x"), F.max("l_discount").alias("y"))


_VECTOR = "vec AS (SELECT l_orderkey * 8 + l_linenumber AS i, max(l_extendedprice) / 1000.0::DOUBLE AS x, max(l_discount) AS y FROM lineitem GROUP BY 1)"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, a) of the sparse matrix."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy((F.col("l_suppkey") % M).alias("i"), (F.col("l_partkey") % M).alias("j")).agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("a"))


_ENTRIES = f"m AS (SELECT l_suppkey % {M} AS i, l_partkey % {M} AS j, sum(l_quantity::BIGINT)::DOUBLE AS a FROM lineitem GROUP BY 1, 2)"
_ROW_SUMS = "t AS (SELECT i, sum(abs(a)) + 1.0 AS d FROM m WHERE i <> j GROUP BY i)"


def gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, row): Gram matrix of the embeddings in units of 1/256, diagonal raised by 1; i from 0."""
    whole = F.transform("embedding", lambda v: F.floor(v.cast("double") * 256).cast("long"))
    rows = table(spark, sf_dir, "embeddings").select(F.posexplode(whole).alias("i", "u"), whole.alias("e"))
    sums = [F.sum(F.col("u") * F.col("e")[k]) for k in range(DIMENSIONS)]
    row = F.array(*[(s + F.when(F.col("i") == k, 1).otherwise(0)).cast("double") for k, s in enumerate(sums)])
    return rows.groupBy("i").agg(row.alias("row"))


_GRAM = f"""e AS (SELECT list_transform(embedding, lambda v: floor(v::DOUBLE * 256)::BIGINT) AS e FROM embeddings),
g AS (SELECT i, j, (sum(e[i + 1] * e[j + 1]) + (i = j)::INTEGER)::DOUBLE AS a FROM e, range({DIMENSIONS}) r(i), range({DIMENSIONS}) c(j) GROUP BY i, j)"""


def vec_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.dot(vector(spark, sf_dir), "x", "y").select(F.round(F.col("dot") / 1e4, 8).alias("dot"))


def vec_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.norm(vector(spark, sf_dir), "x").select(F.round(F.col("norm") / 1e3, 8).alias("norm"))


def vec_axpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.axpy(vector(spark, sf_dir), 0.5, "x", "y").select("i", "y")


def vec_xpby(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.xpby(vector(spark, sf_dir), "x", 0.25, "y").select("i", "y")


def det_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of x y in the fixed order of 512 chunks: the same bits on any cluster."""
    return V.ordered_sum(vector(spark, sf_dir), F.col("x") * F.col("y"))


def native_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector(spark, sf_dir).agg(F.round(F.sum("x") / 1e4, 8).alias("total"), F.count("*").alias("n"))


def block_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven balanced blocks of each supplier's number of lines."""
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    each = sizes.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))))
    parts = F.lit(7).cast("long")
    return each.select("l_suppkey", "k", V.block_start(F.col("n"), parts, F.col("k")).alias("start"), V.block_end(F.col("n"), parts, F.col("k")).alias("end"))


def local_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and places of part that each of seven owners holds."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("place"))
    n = part.agg(F.max("place") + 1).scalar()
    return V.local_rows(part, "place", n, 7).groupBy("owner").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.max("place").alias("last"))


def stream_triad(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", triad(F.col("l_quantity"), F.col("l_discount")).alias("a"))


def dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.dominant(entries(spark, sf_dir))


def gershgorin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.gershgorin(V.dominant(entries(spark, sf_dir)))


def coo_spmv(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.range(M).select(F.col("id").alias("i"), ((F.col("id") + 1) / 64.0).alias("x"))
    return V.spmv(V.dominant(entries(spark, sf_dir)), x)


def dense_matvec(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.array(*[F.lit((k + 1) / 64.0) for k in range(DIMENSIONS)])
    return V.matvec(gram(spark, sf_dir).select(F.col("i").cast("long").alias("i"), "row"), x)


def dense_solvers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each solver for dense systems on the Gram matrix of the embeddings, its rows raised to dominance."""
    row = F.transform("row", lambda v, j: F.when(j == F.col("i"), F.aggregate("row", F.lit(1.0), lambda s, w: s + F.abs(w)) - F.abs(v)).otherwise(v))
    rows = gram(spark, sf_dir).select("i", row.alias("row"), (F.col("i") + 1.0).alias("b"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "row", "b")))
    system = rows.agg(ordered.alias("r")).select(
        F.lit("gram").alias("system"), F.lit(DIMENSIONS).alias("n"), F.transform("r", lambda s: s["b"]).alias("b"), F.flatten(F.transform("r", lambda s: s["row"])).alias("a"), F.lit(8).alias("blocks"), F.lit(True).alias("spd")
    )
    names = [n for n, s in solvers.SOLVERS.items() if not s.coloured]
    out = solvers.solve(system, names, solvers.Options(tolerance=1e-12, max_iterations=20_000))
    return out.select("solver", "converged", F.posexplode("x").alias("i", "x")).select("solver", "converged", F.col("i").cast("long").alias("i"), F.round(F.col("x") * F.lit(1e6), 5).alias("x"))


_SUM = "list_reduce(list(v ORDER BY place), lambda s, w: s + w)"

QUERIES = {f.__name__: f for f in (vec_dot, vec_norm, vec_axpy, vec_xpby, det_reduce, native_reduce, block_partition, local_rows, stream_triad, dominant, gershgorin, coo_spmv, dense_matvec, dense_solvers)}

ORACLES = {
    "vec_dot": f"WITH {_VECTOR} SELECT round(sum(x * y) / 1e4, 8) AS dot FROM vec",
    "vec_norm": f"WITH {_VECTOR} SELECT round(sqrt(sum(x * x)) / 1e3, 8) AS norm FROM vec",
    "vec_axpy": f"WITH {_VECTOR} SELECT i, y + 0.5::DOUBLE * x AS y FROM vec",
    "vec_xpby": f"WITH {_VECTOR} SELECT i, x + 0.25::DOUBLE * y AS y FROM vec",
    "det_reduce": f"""WITH {_VECTOR}, a AS (SELECT row_number() OVER (ORDER BY i) - 1 AS place, x * y AS v, count(*) OVER () AS n FROM vec),
b AS (SELECT *, n // least(n, 512) AS base, n % least(n, 512) AS extra FROM a),
c AS (SELECT *, CASE WHEN place < extra * (base + 1) THEN place // (base + 1) ELSE extra + (place - extra * (base + 1)) // base END AS chunk FROM b),
d AS (SELECT chunk AS place, n, {_SUM} AS v FROM c GROUP BY chunk, n)
SELECT n, {_SUM} AS total FROM d GROUP BY n""",
    "native_reduce": f"WITH {_VECTOR} SELECT round(sum(x) / 1e4, 8) AS total, count(*) AS n FROM vec",
    "block_partition": "SELECT l_suppkey, k, k * (n // 7) + least(k, n % 7) AS start, (k + 1) * (n // 7) + least(k + 1, n % 7) AS end FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), range(7) r(k)",
    "local_rows": """WITH m AS (SELECT p_partkey AS place, (SELECT max(p_partkey) + 1 FROM part) AS n FROM part), b AS (SELECT k, k * (n // 7) + least(k, n % 7) AS lo, (k + 1) * (n // 7) + least(k + 1, n % 7) AS hi FROM (SELECT max(n) AS n FROM m), range(7) r(k))
SELECT k AS owner, count(*) AS n, min(place) AS first, max(place) AS last FROM m JOIN b ON place >= lo AND place < hi GROUP BY 1""",
    "stream_triad": "SELECT l_orderkey, l_linenumber, l_quantity + 3.0::DOUBLE * l_discount AS a FROM lineitem",
    "dominant": f"WITH {_ENTRIES}, {_ROW_SUMS} SELECT i, j, a FROM m WHERE i <> j UNION ALL SELECT i, i, d FROM t",
    "gershgorin": f"WITH {_ENTRIES}, {_ROW_SUMS} SELECT max(d + d - 1.0) AS bound FROM t",
    "coo_spmv": f"WITH {_ENTRIES}, {_ROW_SUMS}, f AS (SELECT i, j, a FROM m WHERE i <> j UNION ALL SELECT i, i, d FROM t) SELECT i, sum(a * ((j + 1) / 64.0::DOUBLE)) AS y FROM f GROUP BY i",
    "dense_matvec": f"WITH {_GRAM} SELECT i, sum(a * ((j + 1) / 64.0::DOUBLE)) AS y FROM g GROUP BY i",
}
