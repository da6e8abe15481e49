"""Plans over a table of measured runs: what can be told apart, and what it costs.

A run has a solver, backend, workers, unknowns, iterations and repeated seconds
(min, median, max). Missing measurements are null and stay null. Comparisons are
equi-joins of the table with its own baseline rows, which are few.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import require

IDENTITY = ("problem", "unknowns", "solver", "backend", "workers", "ranks", "threads_per_rank", "pinning", "reduction", "schedule", "mode", "label", "commit")


def spread() -> Column:
    """(max - min) / median; null where it cannot be told."""
    return F.when(F.col("seconds_median") > 0, (F.col("seconds_max") - F.col("seconds_min")) / F.col("seconds_median"))


def block_label() -> Column:
    return F.split_part("label", F.lit(" "), F.lit(1))


def nearest_rank(values: Column, share: float) -> Column:
    """Nearest-rank percentile of an array, its index rounded half to even."""
    return F.element_at(F.array_sort(values), (F.bround((F.size(values) - 1) * F.lit(share)) + 1).cast("int"))


def clean(runs: DataFrame) -> DataFrame:
    """Runs of committed code only."""
    return runs.filter(~F.col("commit").endswith(".dirty"))


def generation(runs: DataFrame) -> DataFrame:
    """The runs in order of time, if they are of one commit."""
    require(runs.select("commit").distinct().limit(2).count() <= 1, "runs of several commits are no generation")
    return runs.orderBy("measured_at")


def latest(runs: DataFrame, identity: list[str]) -> DataFrame:
    """One run for each identity, the newest (upsert); ties by seconds, then by the other columns in their order."""
    rest = [c for c, kind in runs.dtypes if c not in {*identity, "measured_at", "seconds_median"} and not kind.startswith("map")]
    new = W.partitionBy(*identity).orderBy(F.col("measured_at").desc(), "seconds_median", *rest)
    return runs.withColumn("_turn", F.row_number().over(new)).filter("_turn = 1").drop("_turn")


def pending(wanted: DataFrame, runs: DataFrame, identity: list[str]) -> DataFrame:
    """Configurations without a run yet."""
    return wanted.join(runs.select(*identity).distinct(), identity, "left_anti")


def status(wanted: DataFrame, runs: DataFrame, identity: list[str]) -> DataFrame:
    """For each configuration: have, have-earlier (another commit only), or run."""
    earlier = [c for c in identity if c != "commit"]
    own = runs.select(*identity).distinct().withColumn("_own", F.lit(True))
    some = runs.select(*earlier).distinct().withColumn("_some", F.lit(True))
    out = wanted.join(own, identity, "left").join(some, earlier, "left")
    return out.select(*wanted.columns, F.when(F.col("_own"), "have").when(F.col("_some"), "have-earlier").otherwise("run").alias("status"))


def status_counts(wanted: DataFrame, runs: DataFrame, identity: list[str], by: str) -> DataFrame:
    """Configurations by status, with the identities of runs that nobody wants as "unpredicted"."""
    odd = runs.select(*identity).distinct().join(wanted.select(*identity), identity, "left_anti")
    said = status(wanted, runs, identity).select(by, "status").unionByName(odd.select(by, F.lit("unpredicted").alias("status")))
    return said.groupBy(by, "status").agg(F.count("*").alias("n"))


def expand(spark, axes: dict[str, list]) -> DataFrame:
    """A row for each combination of the axes' values."""
    out = spark.range(1)
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out.drop("id")


def migrate(runs: DataFrame, defaults: dict) -> DataFrame:
    """Adds missing columns with their defaults; what is there stays, so twice is once."""
    return runs.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in runs.columns})


def against(runs: DataFrame, keys: list[str], base: Column) -> DataFrame:
    """Runs joined to the baseline run of their keys, its columns as base_*."""
    kept = ["seconds_median", "seconds_min", "seconds_max"]
    first = runs.filter(base).select(*keys, *[F.col(c).alias(f"base_{c}") for c in kept], spread().alias("base_spread"))
    return runs.join(first, keys)


def speedup(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Speedup over one worker, with bounds from the extremes of both."""
    out = against(runs, keys, F.col("workers") == 1)
    ratio = {"speedup": ("base_seconds_median", "seconds_median"), "low": ("base_seconds_min", "seconds_max"), "high": ("base_seconds_max", "seconds_min")}
    return out.withColumns({k: F.try_divide(F.col(a), F.col(b)) for k, (a, b) in ratio.items()})


def separable(runs: DataFrame, keys: list[str], base: Column) -> DataFrame:
    """Relative effect on medians, and whether it exceeds both spreads."""
    out = against(runs, keys, base).filter(~base)
    effect = F.try_divide(F.col("seconds_median") - F.col("base_seconds_median"), F.col("base_seconds_median"))
    told = F.abs(effect) > F.greatest(spread(), F.col("base_spread"))
    return out.withColumns({"effect": effect, "verdict": F.when(told, F.when(effect > 0, "slower").otherwise("faster")).otherwise("not separable at this precision")})


def axis_cost(runs: DataFrame, axis: str, values: list[str], base: str, keys: list[str]) -> DataFrame:
    """What each value of one axis (reduction, schedule, pinning) costs against ``base``, the keys being equal.

    A row for each value and each keys that any run has; the verdict of the base itself
    is "baseline", and "pending" where the run or its baseline is missing.
    """
    wanted = runs.select(*keys).distinct().withColumn(axis, F.explode(F.array(*map(F.lit, values))))
    have = runs.select(*keys, axis, "seconds_median", spread().alias("spread"))
    told = separable(runs, keys, F.col(axis) == base).select(*keys, axis, "effect", "verdict")
    verdict = F.when(F.col("seconds_median").isNull(), "pending").when(F.col(axis) == base, "baseline").otherwise(F.coalesce("verdict", F.lit("pending")))
    return wanted.join(have, [*keys, axis], "left").join(told, [*keys, axis], "left").withColumn("verdict", verdict)


def convergence_pivot(runs: DataFrame, sides: list[int]) -> DataFrame:
    """Iterations by solver and grid side: a number, cap or pending."""
    cell = F.when(F.col("converged") == 1, F.col("iterations").cast("string")).otherwise("cap")
    out = runs.withColumn("side", F.round(F.sqrt("unknowns")).cast("int")).groupBy("solver").pivot("side", sides).agg(F.max(cell))
    return out.select("solver", *[F.coalesce(F.col(str(s)), F.lit("pending")).alias(f"side_{s}") for s in sides])


def backend_cost(runs: DataFrame, serial: str) -> DataFrame:
    """Each backend against the serial one at the solver's largest size."""
    top = F.max("unknowns").over(W.partitionBy("solver"))
    return separable(runs.withColumn("_top", top).filter("unknowns = _top").drop("_top"), ["solver", "unknowns", "workers"], F.col("backend") == serial)


def ranking(runs: DataFrame, solver: str) -> DataFrame:
    """A solver's runs of the largest size by median."""
    own = runs.filter(F.col("solver") == solver)
    top = F.max("unknowns").over(W.partitionBy("solver"))
    return own.withColumn("_top", top).filter("unknowns = _top").drop("_top").withColumn("place", F.row_number().over(W.partitionBy("solver").orderBy("seconds_median", "backend", "workers")))


def dispersion(runs: DataFrame) -> DataFrame:
    """By block label: runs of two repetitions at least, median and largest spread."""
    ranked = runs.filter("reps > 1").withColumns({"block": block_label(), "spread": spread()})
    return ranked.groupBy("block").agg(F.count("*").alias("n"), F.median("spread").alias("median_spread"), F.max("spread").alias("max_spread"))


def counted_bandwidth() -> Column:
    """Declared GiB/s rescaled to counted bytes and passes; null if anything is missing."""
    return F.col("gib_per_second") * F.try_divide(F.col("dram_bytes_per_unknown_per_sweep"), F.col("bytes_per_unknown")) * F.try_divide(F.col("passes"), F.col("sweeps"))


def recounted_triad(peak: Column) -> Column:
    return peak * 32.0 / 24.0


def cache_regime(resident: Column, cache: float) -> Column:
    return F.when(resident < cache, "cache").when(resident < 4 * cache, "partial").otherwise("streaming")


def growth_pairs(runs: DataFrame) -> DataFrame:
    """Last pair of a solver's sizes that are four times apart, and the growth of iterations."""
    sizes = runs.groupBy("solver", "backend", "unknowns").agg(F.max("iterations").alias("iterations"))
    small = sizes.select("solver", "backend", F.col("unknowns").alias("small"), F.col("iterations").alias("before"))
    pairs = sizes.join(small, ["solver", "backend"]).filter(F.abs(F.col("unknowns") / F.col("small") - 4) < 0.05)
    return pairs.groupBy("solver", "backend").agg(F.max_by(F.struct("small", "unknowns", (F.col("iterations") / F.col("before")).alias("growth")), "unknowns").alias("p")).select("solver", "backend", "p.*")


def penalty(runs: DataFrame, coloured: str, natural: str) -> DataFrame:
    """Extra iterations of one solver over another at the largest size both have."""
    sizes = runs.filter(F.col("solver").isin(coloured, natural)).groupBy("unknowns").agg(*[F.max(F.when(F.col("solver") == s, F.col("iterations"))).alias(c) for s, c in ((coloured, "c"), (natural, "n"))])
    return sizes.filter("c is not null and n is not null").agg(F.max_by(F.struct("unknowns", (F.col("c") / F.col("n") - 1).alias("penalty")), "unknowns").alias("p")).select("p.*")


def knee(points: DataFrame, keys: list[str]) -> DataFrame:
    """Best two-segment fit of y over x for each key: the shared point of the cut with least squares.

    Cuts run from the third point to the third last; the first minimum wins; five points at least.
    """
    ordered = W.partitionBy(*keys).orderBy("x")
    at = points.withColumn("k", F.row_number().over(ordered) - 1).withColumn("n", F.count("*").over(W.partitionBy(*keys))).filter("n >= 5")
    cuts = at.filter("k >= 2 and k <= n - 3").select(*keys, F.col("k").alias("cut"), F.col("x").alias("knee"))
    both = cuts.join(at, keys)

    def rest(inside: Column) -> Column:
        x, y = (F.when(inside, F.col(c).cast("double")) for c in ("x", "y"))
        return F.regr_syy(y, x) - F.coalesce(F.try_divide(F.pow(F.regr_sxy(y, x), F.lit(2.0)), F.regr_sxx(y, x)), F.lit(0.0))

    cost = both.groupBy(*keys, "cut", "knee").agg((rest(F.col("k") <= F.col("cut")) + rest(F.col("k") >= F.col("cut"))).alias("cost"))
    return cost.groupBy(*keys).agg(F.min_by("knee", F.struct(F.round("cost", 9), "cut")).alias("knee"), F.min("cost").alias("cost"))


def _two_lines(y: list[float], x: list[float]) -> float:
    def rest(u, v):
        mu, mv = sum(u) / len(u), sum(v) / len(v)
        sxx = sum((a - mu) ** 2 for a in u)
        sxy = sum((a - mu) * (b - mv) for a, b in zip(u, v, strict=True))
        return sum((b - mv) ** 2 for b in v) - (sxy * sxy / sxx if sxx else 0.0)

    return min(range(2, len(x) - 2), key=lambda c: rest(x[: c + 1], y[: c + 1]) + rest(x[c:], y[c:]))


def bootstrap_knee(points: DataFrame, keys: list[str], resamples: int = 2000, seed: int = 20260906) -> DataFrame:
    """2.5 and 97.5 % nearest-rank bounds of the knee, over resampled repetitions (x, reps array).

    Where reps are null or empty and the columns seconds_min, seconds_median, seconds_max and n
    are there, n draws from the triangle of these three stand for them; keys with neither have no row.
    """
    types = dict(points.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "low double", "high double"])
    triangle = ["seconds_min", "seconds_median", "seconds_max", "n"]

    def task(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("x")
        if len(frame) < 5:
            return pd.DataFrame(columns=[*keys, "low", "high"])
        draw, x = random.Random(seed), frame["x"].astype(float).tolist()
        reps = [sorted(r) if r is not None else [] for r in frame["reps"]]
        corners = frame[triangle].to_numpy().tolist() if set(triangle) <= set(frame.columns) else [[float("nan")] * 4] * len(x)
        if any(not r and not sum(c) == sum(c) for r, c in zip(reps, corners, strict=True)):
            return pd.DataFrame(columns=[*keys, "low", "high"])

        def median(r: list[float], low: float, middle: float, high: float, n: float) -> float:
            drawn = [draw.choice(r) for _ in r] or [draw.triangular(low, high, middle) for _ in range(int(n))]
            return sorted(drawn)[len(drawn) // 2]

        found = []
        for _ in range(resamples):
            medians = [median(r, *c) for r, c in zip(reps, corners, strict=True)]
            found.append(x[_two_lines([medians[0] / m for m in medians], x)])
        found.sort()
        low, high = (found[round((len(found) - 1) * q)] for q in (0.025, 0.975))
        return pd.DataFrame([[*frame.iloc[0][keys], low, high]], columns=[*keys, "low", "high"])

    return points.groupBy(*keys).applyInPandas(task, schema)


def traffic_model(probes: DataFrame) -> DataFrame:
    """From (probe, workers, reps array) of plain and streaming stores: ratio at the plain peak, with verdict.

    The peak is the plain probe's best median (least workers on ties). An interval of
    the per-repetition ratios that straddles 1.10 or 1.20 leaves the model unresolved.
    """
    middle = F.element_at(F.array_sort("reps"), F.floor(F.size("reps") / 2).cast("int") + 1)
    wide = probes.withColumn("m", middle).groupBy("workers").agg(*[F.max(F.when(F.col("probe") == p, F.col(c))).alias(f"{p}_{c}") for p in ("plain", "streaming") for c in ("m", "reps")])
    best = wide.filter("plain_m is not null and streaming_m is not null").agg(F.max_by(F.struct("workers", "plain_m", "plain_reps", "streaming_m", "streaming_reps"), F.struct("plain_m", -F.col("workers"))).alias("b")).select("b.*")
    ratios = F.zip_with("streaming_reps", "plain_reps", lambda s, p: F.round(F.try_divide(s, p), 4))
    out = best.select("workers", F.round(F.try_divide("streaming_m", "plain_m"), 4).alias("ratio"), F.array_min(ratios).alias("low"), F.array_max(ratios).alias("high"))
    straddles = [(F.col("low") < edge) & (F.col("high") > edge) for edge in (1.10, 1.20)]
    return out.withColumn("verdict", F.when(straddles[0] | straddles[1], "unresolved").when(F.col("ratio") < 1.10, "no store miss").when(F.col("ratio") > 1.20, "store miss").otherwise("unresolved"))


def repetitions(text: Column) -> Column:
    """Map of workers to seconds from ``2:41.2|42.6 4:...``; what is no number is null."""
    pairs = F.filter(F.split(F.trim(text), " +"), lambda p: p.contains(":"))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.split_part(p, F.lit(":"), F.lit(1)).try_cast("int").alias("workers"), F.transform(F.split(F.split_part(p, F.lit(":"), F.lit(2)), r"\|"), lambda v: v.try_cast("double")).alias("seconds"))))


def outcome(exit_code: Column, output: Column) -> Column:
    return F.when((exit_code == 0) & (F.length(F.trim(output)) > 0), "ok").when(exit_code == 3, "inapplicable").when(exit_code == 0, "no output").otherwise("failed")


def device_comparison(runs: DataFrame, device: str, peaks: DataFrame) -> DataFrame:
    """Declared and counted efficiency of each side against its own triad (backend, peak), and the time ratio."""
    own = runs.join(peaks, "backend").withColumns({"efficiency": F.try_divide(F.col("gib_per_second"), F.col("peak")), "counted": F.try_divide(counted_bandwidth(), recounted_triad(F.col("peak")))})
    keys = ["solver", "unknowns", "workers"]
    far = own.filter(F.col("backend") == device).select(*keys, *[F.col(c).alias(f"device_{c}") for c in ("seconds_median", "efficiency", "counted", "peak")])
    out = own.filter(F.col("backend") != device).join(far, keys)
    return out.withColumns({"measured": F.try_divide("seconds_median", "device_seconds_median"), "predicted": F.try_divide("device_efficiency", "efficiency") * F.try_divide("device_peak", "peak")})


def efficiency_by_method(runs: DataFrame, host: str, device: str, peaks: DataFrame, resident: Column, cache: float) -> DataFrame:
    """Percent of their own triad (backend, peak) that both sides reach with each solver, at the largest size that streams.

    Of several runs of a solver on a side the fastest counts, ties by fewer workers. The
    bounds move inversely with the seconds; they and the counted efficiency are null where
    something is missing. Solvers that one side lacks are left out; without a streaming size
    there are no rows.
    """
    both = runs.filter(F.col("backend").isin(host, device))
    top = both.filter(cache_regime(resident, cache) == "streaming").agg(F.max("unknowns").alias("unknowns"))
    given = ["unknowns", "workers", "seconds_median", "seconds_min", "seconds_max", "gib_per_second", "bytes_per_unknown", "dram_bytes_per_unknown_per_sweep", "passes", "sweeps"]
    best = F.min_by(F.struct(*given), F.struct("seconds_median", "workers")).alias("r")
    at = both.join(F.broadcast(top), "unknowns").groupBy("solver", "backend").agg(best).select("solver", "backend", "r.*").join(peaks, "backend")
    share = F.try_divide(F.col("gib_per_second") * 100.0, F.col("peak"))
    told = {
        "efficiency": share,
        "low": share * F.try_divide(F.col("seconds_median"), F.col("seconds_max")),
        "high": share * F.try_divide(F.col("seconds_median"), F.col("seconds_min")),
        "counted": F.try_divide(counted_bandwidth() * 100.0, recounted_triad(F.col("peak"))),
    }
    sides = [F.max(F.when(F.col("backend") == b, F.col(c))).alias(f"{side}_{c}") for side, b in (("host", host), ("device", device)) for c in told]
    return at.withColumns(told).groupBy("solver", "unknowns").agg(F.count("*").alias("_sides"), *sides).filter("_sides = 2").drop("_sides")


def bandwidth_table(probes: DataFrame) -> DataFrame:
    """Best and worst worker count of each probe, with GiB/s, from (probe, workers, gib)."""
    return probes.groupBy("probe").agg(F.max("gib").alias("best"), F.max_by("workers", F.struct("gib", -F.col("workers"))).alias("best_workers"), F.min("gib").alias("worst"), F.min_by("workers", F.struct("gib", "workers")).alias("worst_workers"))
