"""Session factory and the arithmetic contract that results rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ConfigurationError


def session(name: str = "latticework", **options: str) -> SparkSession:
    """A session with UTC time, ANSI arithmetic and adaptive execution, whose arithmetic has been checked."""
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}
    spark = SparkSession.builder.appName(name).config(map=fixed | options).getOrCreate()
    check_contract(spark)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt over all shuffle partitions: where a row costs far more than its bytes, a small file must not be one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def check_contract(spark: SparkSession) -> None:
    """Products must be rounded before they are added: no fused multiply-add."""
    a = F.col("a")
    got = spark.range(1).select((F.lit(1.0) + F.pow(F.lit(2.0), F.lit(-27))).alias("a")).select((a * a - 1.0).alias("d")).first().d
    if got != 2.0**-26:
        raise ConfigurationError("multiply-add is contracted on this JVM; results would not be reproducible")
