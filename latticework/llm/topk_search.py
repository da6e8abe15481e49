"""Exact top-k inner-product search: cover trees over queries and data, searched together.

Vectors become integers, floor(256 x). All of them are dealt to *cells* around a
bounded sample of centres, cells to blocks; a cell knows its radius, so the top of
either tree is shared by all tasks. The queries of a cell are first searched in the
data cells of the best centres; this gives each its worst k-th score. Then they meet only those
other cells whose best possible score, c_q c_r + |c_q| r_r + |c_r| r_q + r_q r_r, isn't
under the worst of the cell's queries. For each pair of blocks a task builds a cover
tree over either side (children cover their parent's points within its radius
divided by ``BASE``) and walks the pairs of nodes, pruned by the same bound; leaves
are scored exactly. Blocks' k best rows merge in a window over the query row. Memory is a
block of each side.

Defined results: vectors that are null or hold null or non-finite components, and
rows without an id, take no part; shorter vectors count as padded with zeros; ties
go to the smaller id; a query's own row is no candidate, other rows of its id are;
each query row has its own ranks, also where ids repeat; with fewer candidates
than k all are returned; scores beyond a long are held at its ends; further columns
are ignored; an empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ._shared import kept

BASE, LEAF, DATA_ROWS, QUERY_ROWS = 1.3, 48, 8192, 4096
#: Most cells; their centres are what tasks and driver hold.
CELLS = 1024
LEAST, MOST = -(2**63) + 1, 2**63 - 1
FOUND = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Node:
    __slots__ = ("center", "children", "hi", "lo", "norm", "radius")

    def __init__(self, lo: int, hi: int, center: np.ndarray, radius: float):
        self.lo, self.hi, self.center, self.radius = lo, hi, center, radius
        self.norm, self.children = float(np.sqrt(center @ center)), []


def cover_tree(points: np.ndarray) -> tuple[Node, np.ndarray]:
    """The root, and an order of the points in which each node is a range."""
    order = np.arange(len(points))

    def reach(at: np.ndarray, center: np.ndarray) -> np.ndarray:
        gap = points[at] - center
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def node(lo: int, hi: int, center: np.ndarray) -> Node:
        return Node(lo, hi, center, float(reach(order[lo:hi], center).max()))

    root = node(0, len(points), points.mean(axis=0))
    stack = [root]
    while stack:
        top = stack.pop()
        if top.hi - top.lo <= LEAF or top.radius == 0:
            continue
        rest, groups, centers = order[top.lo : top.hi].copy(), [], []
        while len(rest):
            if len(groups) > max(8, (top.hi - top.lo) // LEAF):  # nothing to gain from a finer cover here
                parts = np.array_split(rest, ceil(len(rest) / LEAF))
                groups += parts
                centers += [points[p].mean(axis=0) for p in parts]
                break
            center = points[rest[int(np.argmax(reach(rest, top.center)))]] if groups else points[rest[0]]
            near = reach(rest, center) <= top.radius / BASE
            groups.append(rest[near])
            centers.append(center)
            rest = rest[~near]
        order[top.lo : top.hi] = np.concatenate(groups)
        lo = top.lo
        for group, center in zip(groups, centers, strict=True):
            if len(group):
                child = node(lo, lo + len(group), center)
                top.children.append(child)
                lo += len(group)
                if child.radius < top.radius:
                    stack.append(child)
    return root, order


def _scores(a: np.ndarray, b: np.ndarray, wide: bool) -> np.ndarray:
    """Inner products as longs; ``wide``: a long may not hold them."""
    if wide:
        exact = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
        return np.array([[min(max(x, LEAST), MOST) for x in r] for r in exact.tolist()], np.int64).reshape(len(a), len(b))
    if a.dtype == np.int64:
        return a @ b.T
    return (a @ b.T).astype(np.int64)


def search(queries: np.ndarray, rows: np.ndarray, floor: np.ndarray, data: np.ndarray, data_rows: np.ndarray, ids: np.ndarray, k: int, most: float) -> tuple[np.ndarray, np.ndarray]:
    """For each query its k best ids and scores in the data, if not under ``floor`` (score LEAST where there are fewer).

    ``most``: a bound of all scores, by which their arithmetic is chosen.
    """
    q_root, q_order = cover_tree(queries)
    r_root, r_order = cover_tree(data)
    exact = queries.dtype if most < 2**53 or most >= 2**63 else np.int64
    q, q_rows, worst = queries[q_order].astype(exact), rows[q_order], floor[q_order]
    r, r_rows, r_ids = data[r_order].astype(exact), data_rows[r_order], ids[r_order]
    best = np.full((len(q), k), LEAST)
    names = np.full((len(q), k), MOST)

    def bound(a: Node, b: Node) -> float:
        top = float(a.center @ b.center) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
        return top + 1e-9 * abs(top) + 1e-12 * (a.norm + a.radius) * (b.norm + b.radius) + 1e-6

    def walk(a: Node, b: Node) -> None:
        if bound(a, b) < worst[a.lo : a.hi].min():
            return
        if b.children and (not a.children or b.radius >= a.radius):
            for _, child in sorted(((bound(a, x), x) for x in b.children), key=lambda x: -x[0]):
                walk(a, child)
        elif a.children:
            for child in a.children:
                walk(child, b)
        else:
            scores = _scores(q[a.lo : a.hi], r[b.lo : b.hi], most >= 2**63)
            own = q_rows[a.lo : a.hi, None] == r_rows[None, b.lo : b.hi]
            good = (scores >= worst[a.lo : a.hi, None]) & ~own
            at = np.flatnonzero(good.any(axis=1))
            if len(at):
                every = np.concatenate([best[a.lo + at], np.where(good[at], scores[at], LEAST)], axis=1)
                who = np.concatenate([names[a.lo + at], np.where(good[at], r_ids[None, b.lo : b.hi], MOST)], axis=1)
                pick = np.lexsort((who, -every), axis=1)[:, :k]
                best[a.lo + at], names[a.lo + at] = np.take_along_axis(every, pick, 1), np.take_along_axis(who, pick, 1)
                worst[a.lo + at] = np.maximum(worst[a.lo + at], best[a.lo + at, -1])

    walk(q_root, r_root)
    back = np.argsort(q_order)
    return names[back], best[back]


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of vectors, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(column.value_lengths())
    out = np.zeros((len(size), width))
    out[np.arange(width)[None, :] < size[:, None]] = np.asarray(column.flatten())
    return out


def _gaps(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances, for the choice of a center only."""
    return (points**2).sum(axis=1)[:, None] - 2 * points @ centers.T + (centers**2).sum(axis=1)


def in_cells(rows: DataFrame, centers: np.ndarray, width: int) -> DataFrame:
    """``rows`` (row, vec_id, v, ask) with the nearest center's number and distance."""
    shared = rows.sparkSession.sparkContext.broadcast(centers)

    def step(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                points, own = _matrix(part.column("v"), width), shared.value
                cell = _gaps(points, own).argmin(axis=1)
                gap = np.sqrt(((points - own[cell]) ** 2).sum(axis=1))
                yield part.append_column("cell", pa.array(cell.astype(np.int32))).append_column("gap", pa.array(gap))

    return rows.mapInArrow(step, f"{', '.join(f'{n} {t}' for n, t in rows.dtypes)}, cell int, gap double")


def _searched(placed: DataFrame, pairs: np.ndarray, tiles: tuple[np.ndarray, np.ndarray], floors: DataFrame | None, width: int, k: int, most: float) -> DataFrame:
    """The k best of each query row in the data cells that ``pairs`` (query cell, data cell) gives it."""
    spark = placed.sparkSession
    schema = "cell int, others array<struct<cell:int,tile:int>>"

    def dealt(mask: np.ndarray, sizes: np.ndarray) -> DataFrame:
        """For each cell the blocks on the other side."""
        found = [(int(c), [(int(o), t) for o in np.flatnonzero(mask[c]) for t in range(int(sizes[o]))]) for c in np.flatnonzero(mask.any(axis=1))]
        return F.broadcast(spark.createDataFrame(found, schema))  # pairs of cells, bounded by CELLS

    def tile(sizes: np.ndarray):
        return F.pmod(F.xxhash64("row"), F.element_at(F.lit([int(max(x, 1)) for x in sizes]), F.col("cell") + 1)).cast("int")

    queries = placed.filter("ask")
    queries = queries.join(floors, "row", "left") if floors is not None else queries.withColumn("floor", F.lit(None).cast("long"))
    left = queries.withColumn("tile", tile(tiles[0])).join(dealt(pairs, tiles[1]), "cell").select("row", "vec_id", "v", "floor", F.col("cell").alias("a"), F.col("tile").alias("b"), F.explode("others").alias("o"))
    left = left.select("row", "vec_id", "v", "floor", "a", "b", F.col("o.cell").alias("c"), F.col("o.tile").alias("d"))
    right = placed.withColumn("tile", tile(tiles[1])).join(dealt(pairs.T, tiles[0]), "cell").select("row", "vec_id", "v", F.col("cell").alias("c"), F.col("tile").alias("d"), F.explode("others").alias("o"))
    right = right.select(F.col("o.cell").alias("a"), F.col("o.tile").alias("b"), "c", "d", "row", "vec_id", "v").toDF("a2", "b2", "c2", "d2", "other", "id", "w")

    def find(one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return FOUND.empty_table()
        rows, asked, others, ids = (np.asarray(t.column(c).combine_chunks()) for t, c in ((one, "row"), (one, "vec_id"), (two, "other"), (two, "id")))
        floor = np.asarray(one.column("floor").combine_chunks().fill_null(LEAST)).copy()
        names, scores = search(_matrix(one.column("v"), width), rows, floor, _matrix(two.column("w"), width), others, ids, k, most)
        has = scores > LEAST
        many = has.sum(axis=1)
        return pa.Table.from_arrays([pa.array(np.repeat(rows, many)), pa.array(np.repeat(asked, many)), pa.array(names[has]), pa.array(scores[has])], schema=FOUND)

    return left.groupBy("a", "b", "c", "d").cogroup(right.groupBy("a2", "b2", "c2", "d2")).applyInArrow(find, from_arrow_schema(FOUND))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query, k: int = 5, data_rows: int = DATA_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of (vec_id, embedding) where ``is_query``."""
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.abs(x) < 2.0**44, F.floor(x * 256.0).cast("double")).otherwise(x * 256.0))  # beyond, all are whole
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("ask"))
    size, asks, width, most = rows.agg(F.count("*"), F.count_if("ask"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not asks or not width:
        centers = np.zeros((1, width))
    else:
        cells = min(CELLS, max(1, ceil(size / data_rows)))
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(cells).toArrow()
        centers = np.unique(_matrix(sample.column("v"), width), axis=0)
    most = width * (most or 0.0) ** 2
    placed = kept(in_cells(rows, centers, width))  # rows have their numbers as written
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("r"), F.count_if("ask").alias("asks"), F.coalesce(F.max(F.when(F.col("ask"), F.col("gap"))), F.lit(0.0)).alias("q")).collect()  # one for each cell
    n, asks, radius, reach = (np.zeros(len(centers)) for _ in range(4))
    for s in stats:
        n[s.cell], asks[s.cell], radius[s.cell], reach[s.cell] = s.n, s.asks, s.r, s.q
    tiles = np.ceil(asks / query_rows).astype(int), np.ceil(n / data_rows).astype(int)
    norm = np.sqrt((centers**2).sum(axis=1))
    bound = centers @ centers.T + np.outer(norm, radius) + np.outer(reach, norm) + np.outer(reach, radius)
    bound += 1e-9 * np.abs(bound) + 1e-12 * np.outer(norm + reach, norm + radius) + 1e-6
    there = np.outer(asks > 0, n > 0)
    first = np.zeros(there.shape, bool)
    for c in np.flatnonzero(asks):  # the best centres, until they have k rows besides the query
        best = np.argsort(-np.where(n > 0, centers @ centers[c], -np.inf), kind="stable")
        first[c, best[: int(np.searchsorted(np.cumsum(n[best]), min(k + 1, n.sum()))) + 1]] = True
    first &= there
    found = _searched(placed, first, tiles, None, width, k, most)
    if (there & ~first).any():
        found = kept(_ranked(found, k).drop("rank"))
        floors = found.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        worst = np.full(len(centers), -np.inf)
        least = placed.filter("ask").join(floors, "row", "left").groupBy("cell").agg(F.when(F.count("*") == F.count("floor"), F.min("floor")).alias("floor"))
        for s in least.collect():
            worst[s.cell] = -np.inf if s.floor is None else s.floor
        rest = there & ~first & (bound >= worst[:, None])
        if rest.any():
            found = found.unionByName(_searched(placed, rest, tiles, floors, width, k, most))
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON c.n <> q.n WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
