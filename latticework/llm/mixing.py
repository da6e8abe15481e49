"""Mixing sources to target weights by weighted fair queueing.

Each source sends its documents in a seeded shuffle, once and then a second time.
A document's virtual finish time is the source's words up to its end, divided by
the source's target; all sources reach time 1 when their targets are spent. All
documents of all sources are ordered by finish time, and the order is truncated where the next
document would pass the total budget. What finishes by time 1 always fits, so a
source misses its target by a document or so.

Targets: sources by code point, null last, weigh ``weights`` in turn and share
``share`` times all words; none gets over ``most`` times its own words, and what
it can't use is shared by the others by weight (water-filling, in closed form).

Running sums never meet in one task: the shuffle key's leading digits cut every
source into slots, whose sums give each slot its offset. Likewise time is cut into ``BINS`` to a unit;
sums by bin tell in which bin the order is truncated, and only that bin is summed
row by row. Windows without a partition see a row for each source or bin.

Defined results: a null text has size 0; documents of size 0 take 0; a null
source is a source of its own; rows with equal ids are shuffled by id and text; null
ids are one id; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Slots of a source; a slot of a source of 10**9 documents holds some 250,000.
SLOT_DIGITS = 3
#: Bins of a unit of time, and units that are binned; what finishes later shares a bin.
BINS, UNITS = 4096, 2


def words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size); a row per source, no more."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.array(*map(F.lit, weights))[((rank - 1) % len(weights)).cast("int")]
    every = W.partitionBy(F.lit(0))
    in_turn = W.partitionBy(F.lit(0)).orderBy("ratio", "turn")
    out = sizes.select("source", "source_size", rank.alias("turn"), weight.cast("double").alias("weight"), (F.lit(most) * F.col("source_size")).alias("cap"))
    out = out.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("budget", F.lit(share) * F.sum("source_size").over(every))
    before = F.coalesce(F.sum("cap").over(in_turn.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(in_turn.rowsBetween(0, W.unboundedFollowing))
    out = out.withColumn("level", (F.col("budget") - before) / rest)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "turn", "level"))).over(every)
    return out.select("source", "source_size", F.least(F.col("cap"), F.coalesce(first["level"] * F.col("weight"), F.col("cap"))).alias("target"))


def _order(lap: int) -> Column:
    """Place in the global order of a document's turn."""
    finish = (F.col("start") + lap * F.col("source_size") + F.col("size")) / F.when(F.col("target") > 0, F.col("target"))
    return F.struct(finish.alias("finish"), F.col("key"), F.col("doc_id"), F.col("size"), F.lit(lap).alias("lap"))


def _bin(order: Column) -> Column:
    return F.least(F.floor(order["finish"] * BINS), F.lit(BINS * UNITS)).cast("int")


def queued(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, *carried: str) -> DataFrame:
    """Adds size, source_size, target, start (words of the source before) and taken."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    sized = docs.select("doc_id", "source", words("text").alias("size"), key.alias("key"), *carried).withColumn("slot", F.substring("key", 1, SLOT_DIGITS))
    slots = sized.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    aims = targets(slots.groupBy("source").agg(F.sum("slot_size").alias("source_size")), weights, share, most)
    offset = F.coalesce(F.sum("slot_size").over(W.partitionBy("source").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    small = slots.select(F.col("source").alias("s"), F.col("slot").alias("t"), offset.alias("offset"))
    small = small.join(aims, small["s"].eqNullSafe(aims["source"])).drop("source")
    both = sized.join(small, sized["source"].eqNullSafe(small["s"]) & (sized["slot"] == small["t"])).drop("s", "t")
    inside = W.partitionBy("source", "slot").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("start", F.col("offset") + F.sum("size").over(inside) - F.col("size"))
    cut, last = _cut(both.select("start", "source_size", "target", "size", "key", "doc_id"), aims.agg(F.sum("target")).scalar())
    laps = [F.coalesce((_bin(_order(k)) < cut) | (_order(k) <= last), F.lit(False)).cast("long") for k in range(2)]
    return both.withColumn("taken", F.col("size") * (laps[0] + laps[1])).drop("key", "slot", "offset")


def _cut(rows: DataFrame, budget: Column) -> tuple[Column, Column]:
    """The bin in which the order is truncated, and the last turn in it that fits, if any."""
    turns = rows.select(F.explode(F.array(_order(0), _order(1))).alias("o")).filter("o.finish is not null").select("o", _bin(F.col("o")).alias("bin"))
    in_turn = W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    bins = turns.groupBy("bin").agg(F.sum("o.size").alias("n")).withColumn("upto", F.sum("n").over(in_turn))
    at = bins.filter(F.col("upto") > budget).agg(F.min(F.struct("bin", (F.col("upto") - F.col("n")).alias("before"))).alias("at"))  # bins are as many at any size
    cut = at.select(F.coalesce("at.bin", F.lit(BINS * UNITS + 1))).scalar()
    upto = at.select("at.before").scalar() + F.sum("o.size").over(W.partitionBy("bin").orderBy("o").rowsBetween(W.unboundedPreceding, 0))
    border = turns.filter(F.col("bin") == cut).select("o", upto.alias("upto"))
    return cut, border.filter(F.col("upto") <= budget).agg(F.max("o")).scalar()


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row of ``docs`` per time it is taken, with finish time and lap, in global order."""
    others = [c for c in docs.columns if c not in ("doc_id", "source")]
    out = queued(docs.withColumnsRenamed({c: f"doc_{c}" for c in others}).withColumn("text", F.col("doc_text")), options.pop("seed", "mix"), *[options.pop(k, v) for k, v in (("weights", (5, 2, 1)), ("share", 1.5), ("most", 2.0))], *[f"doc_{c}" for c in others])
    laps = F.sequence(F.lit(0), F.when(F.col("taken") > F.col("size"), 1).otherwise(0))
    out = out.filter("taken > 0").withColumn("lap", F.explode(laps))
    out = out.withColumn("finish", (F.col("start") + F.col("lap") * F.col("source_size") + F.col("size")) / F.col("target"))
    return out.select(*[F.col(c if c in ("doc_id", "source") else f"doc_{c}").alias(c) for c in docs.columns], *[c for c in ("lap", "finish") if c not in docs.columns]).orderBy("finish", "doc_id")


ORACLE = f"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS key FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS cap, [5.0, 2.0, 1.0][(turn - 1) % 3 + 1]::DOUBLE AS weight, 1.5::DOUBLE * (sum(source_size) OVER ()) AS budget FROM (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS turn FROM src)),
l AS (SELECT *, cap / weight AS ratio FROM w),
v AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(weight) OVER (ORDER BY ratio, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l),
f AS (SELECT level AS lam FROM v WHERE level <= ratio ORDER BY ratio, turn LIMIT 1),
aims AS (SELECT source, source_size, least(cap, lam * weight) AS target FROM v, f),
q AS (SELECT doc_id, size, source_size, target, sum(size) OVER (PARTITION BY sized.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start, key FROM sized JOIN aims ON sized.source IS NOT DISTINCT FROM aims.source),
t AS (SELECT *, (start + lap * source_size + size) / target AS finish FROM q, (VALUES (0), (1)) AS laps(lap) WHERE target > 0),
c AS (SELECT doc_id, key, size, lap, source_size, start, sum(size) OVER (ORDER BY finish, key, doc_id, size, lap ROWS UNBOUNDED PRECEDING) <= (SELECT sum(target) FROM aims) AS fits FROM t)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(n, 0))::BIGINT AS taken
FROM q LEFT JOIN (SELECT doc_id, key, source_size, start, count_if(fits) AS n FROM c WHERE size > 0 GROUP BY ALL) k
ON q.doc_id IS NOT DISTINCT FROM k.doc_id AND q.key = k.key AND q.source_size = k.source_size AND q.start = k.start
"""
