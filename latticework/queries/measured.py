"""Queries over measured runs: orders stand for runs, lines for probes.

A run is a solver (priority), backend (status), workers and side (from the keys);
prices are its seconds, with the mean for the middle one, so that it adds up exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import analytics as A
from ..session import table
from ..sources import results

SIDES, WORKERS = (15, 31, 63, 127), (1, 2, 4, 8)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    side = F.element_at(F.array(*map(F.lit, SIDES)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    keyed = orders.select(F.col("o_orderpriority").alias("solver"), F.col("o_orderstatus").alias("backend"), F.element_at(F.array(*map(F.lit, WORKERS)), (F.col("o_custkey") % 4 + 1).cast("int")).alias("workers"), (side * side).cast("long").alias("unknowns"), "o_totalprice")
    n = F.count("*")
    out = keyed.groupBy("solver", "backend", "workers", "unknowns").agg(
        n.alias("iterations"),
        (n % 3 != 0).cast("int").alias("converged"),
        n.cast("int").alias("reps"),
        F.min("o_totalprice").alias("seconds_min"),
        (F.sum(F.round(F.col("o_totalprice") * 100).cast("decimal(20,0)")).cast("double") / n / 100.0).alias("seconds_median"),
        F.max("o_totalprice").alias("seconds_max"),
        F.lit(24.0).alias("bytes_per_unknown"),
        F.when(n % 5 != 0, 32.0).alias("dram_bytes_per_unknown_per_sweep"),
        (n % 2 + 1).cast("int").alias("sweeps"),
        ((n % 2 + 1) * 2).cast("int").alias("passes"),
    )
    return results.with_rates(out.withColumn("label", F.concat_ws(" ", "solver", "backend")))


_RUNS = f"""r0 AS (SELECT o_orderpriority AS solver, o_orderstatus AS backend, (1 << (o_custkey % 4)::INTEGER)::INTEGER AS workers, [{", ".join(str(s * s) for s in SIDES)}][o_orderkey % 4 + 1]::BIGINT AS unknowns, o_totalprice AS t FROM orders),
r1 AS (SELECT solver, backend, workers, unknowns, count(*) AS iterations, (count(*) % 3 <> 0)::INTEGER AS converged, count(*)::INTEGER AS reps, min(t) AS seconds_min,
  sum(round(t * 100)::BIGINT)::DOUBLE / count(*) / 100.0::DOUBLE AS seconds_median, max(t) AS seconds_max, 24.0::DOUBLE AS bytes_per_unknown,
  CASE WHEN count(*) % 5 <> 0 THEN 32.0::DOUBLE END AS dram, (count(*) % 2 + 1)::INTEGER AS sweeps, ((count(*) % 2 + 1) * 2)::INTEGER AS passes FROM r0 GROUP BY ALL),
r AS (SELECT *, solver || ' ' || backend AS label, (seconds_max - seconds_min) / seconds_median AS spread, unknowns * iterations * sweeps * bytes_per_unknown / seconds_median / 1073741824.0::DOUBLE AS gib FROM r1)"""


def _rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select("solver", "backend", "workers", "unknowns", F.round(A.spread(), 9).alias("spread"))


def speedup_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["solver", "backend", "unknowns"]
    return _rounded(A.speedup(runs(spark, sf_dir), keys).select(*keys, "workers", "speedup", "low", "high"), "speedup", "low", "high")


def separable_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["solver", "workers", "unknowns"]
    return _rounded(A.separable(runs(spark, sf_dir), keys, F.col("backend") == "F").select(*keys, "backend", "effect", "verdict"), "effect")


def backend_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.backend_cost(runs(spark, sf_dir), "F").select("solver", "workers", "backend", "effect", "verdict"), "effect")


def backend_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ranking(runs(spark, sf_dir), "1-URGENT").select("backend", "workers", F.col("place").cast("long").alias("place"))


def convergence_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.convergence_pivot(runs(spark, sf_dir).filter("workers = 1 and backend = 'F'"), list(SIDES))


def dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.dispersion(runs(spark, sf_dir)), "median_spread", "max_spread")


def counted_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select("solver", "backend", "workers", "unknowns", F.round(A.counted_bandwidth() * 1e6, 6).alias("counted"))


def cache_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = runs(spark, sf_dir).select("solver", A.cache_regime(F.col("unknowns") * F.col("bytes_per_unknown"), 40_000.0).alias("regime"))
    return own.groupBy("solver", "regime").agg(F.count("*").alias("n"))


def growth_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.growth_pairs(runs(spark, sf_dir).withColumn("unknowns", F.pow(4, F.round(F.log2(F.sqrt("unknowns"))).cast("int")).cast("long"))), "growth")


def red_black_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.penalty(runs(spark, sf_dir), "2-HIGH", "1-URGENT"), "penalty")


def device_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = runs(spark, sf_dir)
    peaks = own.groupBy("backend").agg(F.max("gib_per_second").alias("peak"))
    out = A.device_comparison(own, "O", peaks)
    return _rounded(out.select("solver", "backend", "workers", "unknowns", "efficiency", "counted", "measured", "predicted"), "efficiency", "counted", "measured", "predicted", digits=8)


def _means(spark: SparkSession, sf_dir: str, *keys) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(*keys).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("decimal(20,0)")).cast("double") / F.count("*") / 1e6).alias("y"))


def _mean_sql(keys: str) -> str:
    return f"SELECT {keys}, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / count(*) / 1e6 AS y FROM lineitem GROUP BY ALL"


def knee(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _means(spark, sf_dir, F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("int").alias("x"))
    return _rounded(A.knee(points, ["flag"]), "cost", digits=7)


def bootstrap_knee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the knee over discounts, resampled from the means of line numbers."""
    means = _means(spark, sf_dir, F.col("l_returnflag").alias("flag"), F.round(F.col("l_discount") * 100).cast("int").alias("x"), "l_linenumber")
    points = means.groupBy("flag", "x").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "y"))), lambda s: s["y"]).alias("reps"))
    return A.bootstrap_knee(points, ["flag"])


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(probe, workers, reps): line status as the store, line number as workers, discounts as repetitions."""
    probe = F.when(F.col("l_linestatus") == "F", "plain").otherwise("streaming").alias("probe")
    means = _means(spark, sf_dir, probe, F.col("l_linenumber").alias("workers"), F.round(F.col("l_discount") * 100).cast("int").alias("k"))
    return means.groupBy("probe", "workers").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "y"))), lambda s: s["y"]).alias("reps"))


_PROBES = "m AS (" + _mean_sql("CASE WHEN l_linestatus = 'F' THEN 'plain' ELSE 'streaming' END AS probe, l_linenumber AS workers, round(l_discount * 100)::INTEGER AS k") + "), p AS (SELECT probe, workers, list(y ORDER BY k) AS reps FROM m GROUP BY 1, 2)"


def traffic_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.traffic_model(_probes(spark, sf_dir))


def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probes(spark, sf_dir).select("probe", "workers", F.round(A.nearest_rank(F.col("reps"), 0.025), 9).alias("low"), F.round(results.upper_median(F.col("reps")), 9).alias("middle"), F.round(A.nearest_rank(F.col("reps"), 0.975), 9).alias("high"))


def bandwidth_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    gib = _means(spark, sf_dir, F.col("l_returnflag").alias("probe"), F.col("l_quantity").cast("int").alias("workers")).withColumnRenamed("y", "gib")
    return _rounded(A.bandwidth_table(gib), "best", "worst")


def recounted_triad(spark: SparkSession, sf_dir: str) -> DataFrame:
    gib = _means(spark, sf_dir, F.col("l_returnflag").alias("probe"), F.col("l_linenumber").alias("workers"))
    return gib.groupBy("probe").agg(F.round(A.recounted_triad(F.max("y")), 9).alias("recounted"))


def row_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's newest order."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("measured_at"), F.col("o_totalprice").alias("seconds_median"))
    return A.latest(orders, ["o_custkey"]).select("o_custkey", "o_orderkey", "seconds_median")


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with every status, as configurations."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return customers.withColumn("o_orderstatus", F.explode(F.array(*map(F.lit, ("F", "O", "X")))))


def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and statuses without orders, as configurations without runs."""
    return A.pending(_wanted(spark, sf_dir), table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"])


def dry_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same configurations counted by status; orders of a status that nobody wants are unpredicted."""
    wanted = _wanted(spark, sf_dir).withColumn("commit", F.lit("1-URGENT"))
    done = table(spark, sf_dir, "orders").withColumn("commit", F.col("o_orderpriority"))
    return A.status_counts(wanted, done, ["o_custkey", "o_orderstatus", "commit"], "o_orderstatus")


def axis_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers as the policy whose cost is asked; some runs are missing."""
    keys, some = ["solver", "backend", "unknowns"], runs(spark, sf_dir).filter("iterations % 7 > 0")
    asked = some.withColumn("policy", F.col("workers").cast("string"))
    return _rounded(A.axis_cost(asked, "policy", ["1", "2", "4", "8"], "1", keys).select(*keys, "policy", "seconds_median", "spread", "effect", "verdict").withColumn("seconds_median", F.round("seconds_median", 4)), "spread", "effect")


def reduction_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line status as the reduction, line number as the backend."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("backend"), F.col("l_linestatus").alias("reduction"))
    price = F.col("l_extendedprice")
    mean = F.sum(F.round(price * 100).cast("decimal(20,0)")).cast("double") / F.count("*") / 100.0
    own = lines.agg(F.min(price).alias("seconds_min"), mean.alias("seconds_median"), F.max(price).alias("seconds_max"))
    return _rounded(A.axis_cost(own, "reduction", ["F", "O"], "F", ["backend"]).select("backend", "reduction", "effect", "verdict"), "effect")


def efficiency_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = runs(spark, sf_dir)
    peaks = own.groupBy("backend").agg(F.max("gib_per_second").alias("peak"))
    out = A.efficiency_by_method(own, "F", "O", peaks, F.col("unknowns") * F.col("bytes_per_unknown"), 5_000.0)
    return _rounded(out, *[c for c in out.columns if c not in ("solver", "unknowns")], digits=6)


def manifest_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as manifests of their customers: one customer's newest gets a new bandwidth."""
    stamp = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    found = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("commit"), F.col("o_totalprice").alias("bandwidth"), F.col("o_orderstatus").alias("traffic_model"), stamp.alias("stamp"), "o_custkey")
    return results.refresh_bandwidth(found, "2-HIGH", F.lit(55.0), F.lit("resolved"), "probed again", "20260906T203409Z")


def identity_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit("P").alias("commit"))
    done = table(spark, sf_dir, "orders").withColumn("commit", F.col("o_orderstatus"))
    return A.status(wanted, done, ["o_custkey", "commit"])


def matrix_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations of axes, with the size of the table that each stands for."""
    axes = A.expand(spark, {"solver": ["1-URGENT", "2-HIGH"], "backend": ["F", "O", "P"], "workers": [1, 2, 4, 8]})
    have = runs(spark, sf_dir).groupBy("solver", "backend", "workers").agg(F.sum("iterations").alias("runs"))
    return axes.join(have, ["solver", "backend", "workers"], "left")


def migrate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    defaults = {"kernels": "host", "sweeps": 1, "n_name": "none"}
    return A.migrate(A.migrate(table(spark, sf_dir, "nation"), defaults), defaults)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = A.outcome((F.col("o_orderkey") % 5).cast("int"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_orderstatus")).otherwise(F.lit(" ")))
    return table(spark, sf_dir, "orders").groupBy(said.alias("outcome")).agg(F.count("*").alias("n"))


def repetition_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds by worker count out of text made from customers; what is no number is null."""
    text = F.concat(F.lit("2:"), F.col("c_acctbal").cast("string"), F.lit("|x 4:"), F.col("c_nationkey").cast("string"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(A.repetitions(text)).alias("workers", "seconds"))
    return rows.select("c_custkey", "workers", F.posexplode("seconds").alias("k", "seconds"))


def dirty_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs, those of one status as uncommitted code."""
    orders = table(spark, sf_dir, "orders").withColumn("commit", F.concat(F.col("o_orderpriority"), F.when(F.col("o_orderstatus") == "P", ".dirty").otherwise("")))
    return A.clean(orders).groupBy("commit").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        spread, speedup_bounds, separable_effect, backend_cost, backend_ranking, convergence_pivot, dispersion, counted_bandwidth, cache_regime, growth_pairs, red_black_penalty, device_comparison, knee,
        bootstrap_knee, traffic_model, nearest_rank, bandwidth_table, recounted_triad, row_upsert, resume_antijoin, dry_run_counts, identity_status, matrix_expand, migrate_rows, outcomes, repetition_parser, dirty_filter, axis_cost, reduction_cost, efficiency_by_method, manifest_refresh,
    )
}

_COMPARED = "CASE WHEN abs(effect) > greatest(a.spread, b.spread) THEN CASE WHEN effect > 0 THEN 'slower' ELSE 'faster' END ELSE 'not separable at this precision' END AS verdict"
_EFFECT = "(a.seconds_median - b.seconds_median) / b.seconds_median"
_COUNTED = "gib * (dram / bytes_per_unknown) * (passes::DOUBLE / sweeps)"
_LINE = "regr_syy(y, x) FILTER ({0}) - coalesce(pow(regr_sxy(y, x) FILTER ({0}), 2) / nullif(regr_sxx(y, x) FILTER ({0}), 0), 0)"
_WANTED = "WITH w AS (SELECT c_custkey AS o_custkey, s AS o_orderstatus FROM customer, (VALUES ('F'), ('O'), ('X')) v(s))"
ORACLES = {
    "spread": f"WITH {_RUNS} SELECT solver, backend, workers, unknowns, round(spread, 9) AS spread FROM r",
    "speedup_bounds": f"WITH {_RUNS} SELECT a.solver, a.backend, a.unknowns, a.workers, round(b.seconds_median / a.seconds_median, 9) AS speedup, round(b.seconds_min / a.seconds_max, 9) AS low, round(b.seconds_max / a.seconds_min, 9) AS high FROM r a JOIN r b ON b.workers = 1 AND a.solver = b.solver AND a.backend = b.backend AND a.unknowns = b.unknowns",
    "separable_effect": f"WITH {_RUNS} SELECT a.solver, a.workers, a.unknowns, a.backend, round({_EFFECT}, 9) AS effect, {_COMPARED.replace('effect', _EFFECT)} FROM r a JOIN r b ON b.backend = 'F' AND a.backend <> 'F' AND a.solver = b.solver AND a.workers = b.workers AND a.unknowns = b.unknowns",
    "backend_cost": f"WITH {_RUNS} SELECT a.solver, a.workers, a.backend, round({_EFFECT}, 9) AS effect, {_COMPARED.replace('effect', _EFFECT)} FROM r a JOIN r b ON b.backend = 'F' AND a.backend <> 'F' AND a.solver = b.solver AND a.workers = b.workers AND a.unknowns = b.unknowns WHERE a.unknowns = (SELECT max(unknowns) FROM r c WHERE c.solver = a.solver)",
    "backend_ranking": f"WITH {_RUNS} SELECT backend, workers, row_number() OVER (ORDER BY seconds_median, backend, workers) AS place FROM r WHERE solver = '1-URGENT' AND unknowns = (SELECT max(unknowns) FROM r WHERE solver = '1-URGENT')",
    "convergence_pivot": f"WITH {_RUNS} SELECT solver, " + ", ".join(f"coalesce(max(CASE WHEN converged = 1 THEN iterations::VARCHAR ELSE 'cap' END) FILTER (unknowns = {s * s}), 'pending') AS side_{s}" for s in SIDES) + " FROM r WHERE workers = 1 AND backend = 'F' GROUP BY solver",
    "dispersion": f"WITH {_RUNS} SELECT split_part(label, ' ', 1) AS block, count(*) AS n, round(median(spread), 9) AS median_spread, round(max(spread), 9) AS max_spread FROM r WHERE reps > 1 GROUP BY 1",
    "counted_bandwidth": f"WITH {_RUNS} SELECT solver, backend, workers, unknowns, round({_COUNTED} * 1e6, 6) AS counted FROM r",
    "cache_regime": f"WITH {_RUNS} SELECT solver, CASE WHEN unknowns * bytes_per_unknown < 40000 THEN 'cache' WHEN unknowns * bytes_per_unknown < 160000 THEN 'partial' ELSE 'streaming' END AS regime, count(*) AS n FROM r GROUP BY 1, 2",
    "growth_pairs": f"WITH {_RUNS}, s AS (SELECT solver, backend, pow(4, round(log2(sqrt(unknowns))))::BIGINT AS unknowns, max(iterations) AS iterations FROM r GROUP BY 1, 2, 3), q AS (SELECT a.solver, a.backend, b.unknowns AS small, a.unknowns, round(a.iterations / b.iterations, 9) AS growth, row_number() OVER (PARTITION BY a.solver, a.backend ORDER BY a.unknowns DESC) AS k FROM s a JOIN s b ON a.solver = b.solver AND a.backend = b.backend AND abs(a.unknowns / b.unknowns - 4) < 0.05) SELECT solver, backend, small, unknowns, growth FROM q WHERE k = 1",
    "red_black_penalty": f"WITH {_RUNS}, s AS (SELECT unknowns, max(iterations) FILTER (solver = '2-HIGH') AS c, max(iterations) FILTER (solver = '1-URGENT') AS n FROM r GROUP BY 1) SELECT unknowns, round(c / n - 1, 9) AS penalty FROM s WHERE c IS NOT NULL AND n IS NOT NULL ORDER BY unknowns DESC LIMIT 1",
    "device_comparison": f"WITH {_RUNS}, k AS (SELECT backend, max(gib) AS peak FROM r GROUP BY 1), e AS (SELECT r.*, peak, gib / peak AS efficiency, {_COUNTED} / (peak * 32.0 / 24.0) AS counted FROM r JOIN k USING (backend)) SELECT a.solver, a.backend, a.workers, a.unknowns, round(a.efficiency, 8) AS efficiency, round(a.counted, 8) AS counted, round(a.seconds_median / b.seconds_median, 8) AS measured, round(b.efficiency / a.efficiency * (b.peak / a.peak), 8) AS predicted FROM e a JOIN e b ON b.backend = 'O' AND a.backend <> 'O' AND a.solver = b.solver AND a.workers = b.workers AND a.unknowns = b.unknowns",
    "knee": f"""WITH m AS ({_mean_sql("l_returnflag AS flag, l_quantity::INTEGER AS x")}), p AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY flag) AS n FROM m),
c AS (SELECT c.flag, c.k AS cut, c.x AS knee, {_LINE.format("p.k <= c.k").replace("y, x", "p.y, p.x")} + {_LINE.format("p.k >= c.k").replace("y, x", "p.y, p.x")} AS cost FROM p c JOIN p ON p.flag = c.flag WHERE c.n >= 5 AND c.k BETWEEN 2 AND c.n - 3 GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY round(cost, 9), cut) AS place FROM c) SELECT flag, knee, round(cost, 7) AS cost FROM o WHERE place = 1""",
    "traffic_model": f"""WITH {_PROBES}, w AS (SELECT a.workers, list_sort(a.reps)[len(a.reps) // 2 + 1] AS m, list_sort(b.reps)[len(b.reps) // 2 + 1] AS sm, list_transform(list_zip(b.reps, a.reps), lambda z: round(z[1] / z[2], 4)) AS q FROM p a JOIN p b ON a.workers = b.workers AND a.probe = 'plain' AND b.probe = 'streaming'),
o AS (SELECT workers, round(sm / m, 4) AS ratio, list_min(q) AS low, list_max(q) AS high FROM w ORDER BY m DESC, workers LIMIT 1)
SELECT *, CASE WHEN low < 1.10 AND high > 1.10 OR low < 1.20 AND high > 1.20 THEN 'unresolved' WHEN ratio < 1.10 THEN 'no store miss' WHEN ratio > 1.20 THEN 'store miss' ELSE 'unresolved' END AS verdict FROM o""",
    "nearest_rank": f"WITH {_PROBES} SELECT probe, workers, " + ", ".join(f"round(list_sort(reps)[{at}], 9) AS {c}" for c, at in (("low", "round_even((len(reps) - 1) * 0.025, 0)::INTEGER + 1"), ("middle", "len(reps) // 2 + 1"), ("high", "round_even((len(reps) - 1) * 0.975, 0)::INTEGER + 1"))) + " FROM p",
    "bandwidth_table": f"""WITH m AS ({_mean_sql("l_returnflag AS probe, l_quantity::INTEGER AS workers")}) SELECT probe, round(max(y), 9) AS best, arg_max(workers, y) AS best_workers, round(min(y), 9) AS worst, arg_min(workers, y) AS worst_workers FROM m GROUP BY probe""",
    "recounted_triad": f"""WITH m AS ({_mean_sql("l_returnflag AS probe, l_linenumber AS workers")}) SELECT probe, round(max(y) * 32.0 / 24.0, 9) AS recounted FROM m GROUP BY probe""",
    "row_upsert": "SELECT o_custkey, o_orderkey, o_totalprice AS seconds_median FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice, o_orderkey) AS k FROM orders) WHERE k = 1",
    "resume_antijoin": f"{_WANTED} SELECT o_custkey, o_orderstatus FROM w ANTI JOIN orders USING (o_custkey, o_orderstatus)",
    "dry_run_counts": f"""{_WANTED}, s AS (SELECT o_orderstatus, CASE WHEN EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = w.o_custkey AND o.o_orderstatus = w.o_orderstatus AND o_orderpriority = '1-URGENT') THEN 'have'
  WHEN EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = w.o_custkey AND o.o_orderstatus = w.o_orderstatus) THEN 'have-earlier' ELSE 'run' END AS status FROM w
UNION ALL SELECT o_orderstatus, 'unpredicted' FROM (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders) o WHERE o_orderpriority <> '1-URGENT' OR NOT EXISTS (SELECT 1 FROM w WHERE w.o_custkey = o.o_custkey AND w.o_orderstatus = o.o_orderstatus))
SELECT o_orderstatus, status, count(*) AS n FROM s GROUP BY ALL""",
    "axis_cost": f"""WITH {_RUNS}, q AS (SELECT *, workers::VARCHAR AS policy FROM r WHERE iterations % 7 > 0), k AS (SELECT DISTINCT solver, backend, unknowns, p AS policy FROM q, (VALUES ('1'), ('2'), ('4'), ('8')) v(p))
SELECT k.solver, k.backend, k.unknowns, k.policy, round(a.seconds_median, 4) AS seconds_median, round(a.spread, 9) AS spread, CASE WHEN k.policy <> '1' THEN round({_EFFECT}, 9) END AS effect,
  CASE WHEN a.seconds_median IS NULL THEN 'pending' WHEN k.policy = '1' THEN 'baseline' WHEN b.seconds_median IS NULL THEN 'pending' ELSE {_COMPARED.removesuffix(' AS verdict').replace('effect', _EFFECT)} END AS verdict
FROM k LEFT JOIN q a USING (solver, backend, unknowns, policy) LEFT JOIN q b ON b.policy = '1' AND b.solver = k.solver AND b.backend = k.backend AND b.unknowns = k.unknowns""",
    "reduction_cost": f"""WITH m AS (SELECT l_linenumber AS backend, l_linestatus AS reduction, min(l_extendedprice) AS lo, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / count(*) / 100.0::DOUBLE AS seconds_median, max(l_extendedprice) AS hi FROM lineitem GROUP BY ALL),
q AS (SELECT *, (hi - lo) / seconds_median AS spread FROM m), k AS (SELECT DISTINCT backend, p AS reduction FROM m, (VALUES ('F'), ('O')) v(p))
SELECT k.backend, k.reduction, CASE WHEN k.reduction <> 'F' THEN round({_EFFECT}, 9) END AS effect, CASE WHEN a.lo IS NULL THEN 'pending' WHEN k.reduction = 'F' THEN 'baseline' WHEN b.lo IS NULL THEN 'pending' ELSE {_COMPARED.removesuffix(' AS verdict').replace('effect', _EFFECT)} END AS verdict
FROM k LEFT JOIN q a USING (backend, reduction) LEFT JOIN q b ON b.backend = k.backend AND b.reduction = 'F'""",
    "efficiency_by_method": f"""WITH {_RUNS}, peaks AS (SELECT backend, max(gib) AS peak FROM r GROUP BY 1), top AS (SELECT max(unknowns) AS unknowns FROM r WHERE backend IN ('F', 'O') AND unknowns * bytes_per_unknown >= 4 * 5000),
f AS (SELECT r.*, peak, row_number() OVER (PARTITION BY solver, r.backend ORDER BY seconds_median, workers) AS place FROM r JOIN top USING (unknowns) JOIN peaks ON peaks.backend = r.backend WHERE r.backend IN ('F', 'O')),
e AS (SELECT *, gib * 100 / peak AS share, {_COUNTED} * 100 / (peak * 32.0 / 24.0) AS counted FROM f WHERE place = 1)
SELECT a.solver, a.unknowns, {", ".join(f"round({t}.share, 6) AS {n}_efficiency, round({t}.share * {t}.seconds_median / {t}.seconds_max, 6) AS {n}_low, round({t}.share * {t}.seconds_median / {t}.seconds_min, 6) AS {n}_high, round({t}.counted, 6) AS {n}_counted" for t, n in (("a", "host"), ("b", "device")))}
FROM e a JOIN e b ON a.solver = b.solver AND a.backend = 'F' AND b.backend = 'O'""",
    "manifest_refresh": """SELECT '2-HIGH' AS commit, 55.0::DOUBLE AS bandwidth, 'resolved' AS traffic_model, strftime(o_orderdate, '%Y%m%d') || '-' || lpad(o_orderkey::VARCHAR, 12, '0') AS stamp, o_custkey, o_totalprice AS bandwidth_previous, 'probed again' AS bandwidth_note, '20260906T203409Z' AS bandwidth_refreshed
FROM orders WHERE o_orderpriority = '2-HIGH' ORDER BY stamp DESC LIMIT 1""",
    "identity_status": "SELECT c_custkey AS o_custkey, 'P' AS commit, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN 'have' WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'have-earlier' ELSE 'run' END AS status FROM customer",
    "matrix_expand": f"WITH {_RUNS}, h AS (SELECT solver, backend, workers, sum(iterations)::BIGINT AS runs FROM r GROUP BY ALL) SELECT a.solver, b.backend, c.workers, h.runs FROM (VALUES ('1-URGENT'), ('2-HIGH')) a(solver), (VALUES ('F'), ('O'), ('P')) b(backend), (VALUES (1), (2), (4), (8)) c(workers) LEFT JOIN h ON h.solver = a.solver AND h.backend = b.backend AND h.workers = c.workers",
    "migrate_rows": "SELECT *, 'host' AS kernels, 1 AS sweeps FROM nation",
    "outcomes": "SELECT CASE WHEN o_orderkey % 5 = 0 AND o_custkey % 3 > 0 THEN 'ok' WHEN o_orderkey % 5 = 3 THEN 'inapplicable' WHEN o_orderkey % 5 = 0 THEN 'no output' ELSE 'failed' END AS outcome, count(*) AS n FROM orders GROUP BY 1",
    "repetition_parser": "SELECT c_custkey, 2 AS workers, 0 AS k, c_acctbal AS seconds FROM customer UNION ALL SELECT c_custkey, 2, 1, NULL FROM customer UNION ALL SELECT c_custkey, 4, 0, c_nationkey::DOUBLE FROM customer",
    "dirty_filter": "SELECT o_orderpriority AS commit, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1",
}
