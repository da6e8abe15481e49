"""A triad a = b + 3c over a generated table: what the session streams, not what its memory could."""

from __future__ import annotations

import time

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import require


def triad(b: Column, c: Column) -> Column:
    return b + F.lit(3.0) * c


def stream_triad(spark: SparkSession, rows: int = 1 << 24, repeats: int = 5) -> dict[str, float]:
    """Seconds of the best of ``repeats`` passes, and GiB/s at 24 bytes a row."""
    require(rows >= 1 and repeats >= 1, "a probe needs rows and repeats")
    x = F.col("id").cast("double")
    plan = spark.range(rows).select(triad(x, x * 0.5).alias("a"))
    seconds = []
    for _ in range(repeats):
        began = time.perf_counter()
        plan.agg(F.max("a")).collect()
        seconds.append(time.perf_counter() - began)
    return {"seconds": min(seconds), "gib_per_second": rows * 24 / min(seconds) / 2.0**30}
