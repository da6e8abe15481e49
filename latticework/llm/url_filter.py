"""URL filters: host and path rules by hashed expressions, with precedence.

Each URL expands into host-suffix and path-prefix expressions, one for each
shape (number of labels, length of path) that some rule has. The expressions
equi-join the rules on a short prefix of their SHA-256; full digests confirm a
hit. The longest rule decides (then the longer host, then allow). Everything is
a DataFrame expression.

Host: between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with
A-Z in lower case; path: from there to the next ``?``, ``#`` or the end.

Defined results: a null URL, or one without ``://``, has an empty host and path,
fits no rule and gets ``default``; repeated rows are judged each, of any length; further
columns are ignored; without rules all get ``default``; rules with a null count as none;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Hex digits of the short hash, and the most rules that are broadcast (some 20 MB); more are joined by a shuffle, with the same result.
PREFIX, BROADCAST_RULES = 8, 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """(verdict, rule) rows; a rule is ``host/path...``."""
    return spark.createDataFrame(list(rules), "verdict string, rule string")


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path, both empty without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return pages.withColumns({"host": F.translate(host, UPPER, LOWER), "path": path})


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of (page_id, url)."""
    host = F.substring_index("rule", "/", 1)
    path = F.substring(F.col("rule"), F.length(host) + 1, F.length("rule"))
    rules = rules.filter("rule is not null and verdict is not null").dropDuplicates(["rule", "verdict"])
    # the longest rule, then the longer host, then the lesser verdict
    rank = F.struct(F.length("rule").alias("size"), F.length(host).alias("host"), (F.col("verdict") == "allow").alias("allow"), F.col("rule").alias("rule"), F.col("verdict").alias("verdict"))
    digest = F.sha2("rule", 256)
    keyed = rules.select(F.substring(digest, 1, PREFIX).alias("short"), digest.alias("digest"), rank.alias("rank"))
    # as many as labels and path lengths differ, not as there are rules
    shapes = rules.select(F.size(F.split(host, r"\.")).alias("n"), F.length(path).alias("k")).distinct().collect()
    small = F.broadcast if rules.limit(broadcast_rules + 1).count() <= broadcast_rules else (lambda x: x)

    rows = with_parts(pages.select("page_id", "url").withColumn("row", F.monotonically_increasing_id()))
    names = F.split("host", r"\.")
    known = F.array(*[F.struct(F.lit(x.n).alias("n"), F.lit(x.k).alias("k")) for x in shapes]) if shapes else F.array().cast("array<struct<n:int,k:int>>")
    fits = F.filter(known, lambda x: (F.size(names) >= x["n"]) & (F.length("path") >= x["k"]))
    spelled = F.transform(fits, lambda x: F.concat(F.array_join(F.slice(names, F.size(names) - x["n"] + 1, x["n"]), "."), F.substring(F.col("path"), F.lit(1), x["k"])))
    asked = rows.select("row", "page_id", "host", "path", F.explode_outer(F.when(F.col("host") != "", spelled)).alias("expression"))
    asked = asked.withColumn("full", F.sha2("expression", 256)).withColumn("short", F.substring("full", 1, PREFIX))
    hits = asked.join(small(keyed), "short", "left")
    # folded before the shuffle: a page's expressions are in one task
    best = hits.groupBy("row", "page_id", "host", "path").agg(F.max(F.when(F.col("full") == F.col("digest"), F.col("rank"))).alias("rank"))
    return best.select("page_id", "host", "path", F.col("rank.rule").alias("rule"), F.coalesce("rank.verdict", F.lit(default)).alias("verdict"))


_HOST = "CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(url[instr(url, '://') + 3:], '^[^/?#]*'), '" + UPPER + "', '" + LOWER + "') ELSE '' END"
_PATH = "CASE WHEN instr(url, '://') > 0 THEN regexp_extract(url[instr(url, '://') + 3:], '^[^/?#]*([^?#]*)', 1) ELSE '' END"
_RULES = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)
ORACLE = f"""
WITH p AS (SELECT row_number() OVER () AS n, page_id, coalesce({_HOST}, '') AS host, coalesce({_PATH}, '') AS path FROM pages),
r(verdict, rule, h, q) AS (VALUES {_RULES}),
m AS (SELECT p.n, r.rule, r.verdict, row_number() OVER (PARTITION BY p.n ORDER BY length(r.rule) DESC) AS k FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.q))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (n)
"""
