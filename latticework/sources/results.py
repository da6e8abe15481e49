"""Readers and writers of measured runs, session manifests and recorded iterates.

A run is a row of 36 columns in a fixed order. An empty field was not measured and
stays null; what is no number where one is due becomes null too, never 0.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import require

# The names of the 36 columns, in order, with their types.
RUN = (
    "problem string, unknowns bigint, solver string, backend string, workers int, ranks int, threads_per_rank int, pinning string, "
    "reduction string, schedule string, mode string, iterations bigint, converged int, stop_reason string, relative_residual double, "
    "omega double, blocks bigint, check_interval bigint, seconds_median double, seconds_min double, seconds_max double, reps int, "
    "updates_per_second double, gib_per_second double, bytes_per_unknown double, seed bigint, commit string, label string, sweeps int, "
    "passes int, dram_bytes_per_unknown_per_sweep double, pinning_status string, measured_at timestamp, seconds_reps string, "
    "kernels string, kernel_variant string"
)
COLUMNS = [c.split(" ") for c in RUN.split(", ")]

BANDWIDTH = "struct<repetitions: map<string, map<string, array<double>>>>"
MANIFEST = (
    f"commit string, bandwidth {BANDWIDTH}, failures array<string>, traffic_model map<string, string>, "
    f"bandwidth_note string, bandwidth_previous {BANDWIDTH}, bandwidth_refreshed string"
)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs from CSV with a header; columns are found by name, and missing ones are null."""
    raw = spark.read.option("header", True).csv(path)
    have = set(raw.columns)
    return raw.select(*[(F.col(c).try_cast(kind) if c in have else F.lit(None).cast(kind)).alias(c) for c, kind in COLUMNS])


def write_runs(runs: DataFrame, path: str) -> None:
    """All 36 columns as CSV; the committer makes the folder appear as a whole."""
    missing = [c for c, _ in COLUMNS if c not in runs.columns]
    require(not missing, f"a run needs the columns {', '.join(missing)}")
    runs.select(*[F.col(c).cast(kind) for c, kind in COLUMNS]).write.mode("overwrite").option("header", True).csv(path)


def with_rates(runs: DataFrame) -> DataFrame:
    """Adds what follows from seconds: updates and GiB per second; null without them."""
    updates = F.col("unknowns") * F.col("iterations") * F.coalesce("sweeps", F.lit(1))
    return runs.withColumns(
        {
            "updates_per_second": F.try_divide(updates, F.col("seconds_median")),
            "gib_per_second": F.try_divide(updates * F.col("bytes_per_unknown"), F.col("seconds_median")) / 2.0**30,
        }
    )


def repetition_seconds(text: str | Column) -> Column:
    """Array of the seconds in ``1.5;1.7;...``."""
    return F.transform(F.split(text, ";"), lambda v: v.try_cast("double"))


def upper_median(values: Column) -> Column:
    """The element at size / 2 of the sorted array: of an even number, the upper middle."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Session manifests, one JSON document per file or folder, with the time stamp of their names."""
    found = spark.read.schema(MANIFEST).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return found.withColumn("stamp", F.regexp_extract(F.col("_metadata.file_path"), r"-(\d{8}T\d{6}Z)\.json(?:/|$)", 1))


def write_manifest(manifest: DataFrame, folder: str, commit: str, stamp: str) -> str:
    """Writes the one manifest of a session under the name that ``read_manifests`` takes its stamp from."""
    require(re.fullmatch(r"\d{8}T\d{6}Z", stamp, re.ASCII) is not None, f"{stamp!r} is no stamp like 20260906T203409Z")
    path = f"{folder}/manifest-{commit}-{stamp}.json"
    manifest.drop("stamp").coalesce(1).write.mode("overwrite").json(path)
    return path


def refresh_bandwidth(manifests: DataFrame, commit: str, bandwidth: Column, traffic_model: Column, note: str, at: str) -> DataFrame:
    """The newest manifest of a commit with new bandwidth and traffic model, all else as it was.

    What the bandwidth was stays as bandwidth_previous. A commit without a manifest gets
    one of nulls but for these columns and its stamp, ``at``.
    """
    own = manifests.filter(F.col("commit") == commit)
    old = own.agg(F.max_by(F.struct(*manifests.columns), "stamp").alias("m")).select("m.*")
    new = {"commit": F.lit(commit), "stamp": F.coalesce("stamp", F.lit(at)), "bandwidth_previous": F.col("bandwidth"), "bandwidth": bandwidth}
    return old.withColumns(new | {"traffic_model": traffic_model, "bandwidth_note": F.lit(note), "bandwidth_refreshed": F.lit(at)})


def newest_manifest(manifests: DataFrame, commit: str) -> DataFrame:
    """The manifest of a commit with the greatest stamp, whole."""
    own = manifests.filter(F.col("commit") == commit)
    return own.agg(F.max_by(F.struct(*manifests.columns), "stamp").alias("m")).filter("m is not null").select("m.*")


def probes(manifests: DataFrame) -> DataFrame:
    """(probe, workers, reps array) of the manifests' bandwidth repetitions."""
    by_probe = manifests.select(F.explode("bandwidth.repetitions").alias("probe", "by"))
    return by_probe.select("probe", F.explode("by").alias("workers", "reps")).withColumn("workers", F.col("workers").cast("int"))


def read_hex(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value) of a file with one hexadecimal double a line under a # header."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\n"), lambda v: (v != "") & ~v.startswith("#"))))
    return lines.select(F.col("pos").cast("long").alias("pos"), F.trim("col").try_cast("double").alias("value"))


def write_hex(values: DataFrame, path: str, header: str) -> None:
    """Writes (pos, value) in order, as ``read_hex`` reads it; for iterates that fit one file."""
    spelled = F.udf(lambda v: None if v is None else float(v).hex(), "string")
    rows = values.withColumn("spelled", spelled("value"))
    last = F.concat_ws("\n", F.lit(f"# {header}"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "spelled"))), lambda s: s["spelled"]))
    rows.agg(last.alias("value")).coalesce(1).write.mode("overwrite").text(path)
