"""MinHash near-dedup: signature coordinates as an inverted index, links confirmed on full sets.

A document's set holds its distinct ``shingle``-word shingles; equal sets are one
class. A class posts itself under its (coordinate, value) pairs, two neighbouring coordinates at
a time, as texts of one language share many single values. Two classes
with ``matches`` of 64 equal coordinates (36) have at least 4 of 32 such posts in common, so one among the
29 that are rarest (prefix), and a post that no other
class has is left out (skip), so a text without relatives posts nothing.
The posts' frequencies come from the packed exchange in ``_blocks``.

Groups under one value are never turned into all of their pairs; a large one is
posted again within itself, under the values that are rarest there. Signatures alone
first give families, closed under pairs with ``matches`` equal coordinates: each
member meets one leader of its group, then tiles of bounded size compare what is
still apart and return spanning links. Within a family, tiles do the same with
links confirmed on the full sets; families of several tiles share some leaders, and
what remains outside the largest component meets all other members. Pairs inside a
component can't change the outcome, and all others are compared, so no link
between candidates is lost; a pair at the threshold misses ``matches`` of its
coordinates with a probability of some 5e-6 (64 coordinates, 36 matches, 0.8).

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. Defined results: with fewer
words than a shingle the whole sequence is one; a null text, or one without words,
has an empty set and is linked with nothing; repeated rows are copies; a null id
is in its component but never its smallest id, unless there is no other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from . import _blocks as B
from . import _text as T
from ._shared import bounded, kept

COORDINATES, MATCHES, TILE, LEADS = 64, 36, 1024, 8
#: Coordinates are posted two at a time; a mismatch spoils one pair, so so many pairs are equal at least, and a prefix that leaves out one less meets.
POSTS = COORDINATES // 2
PREFIX = POSTS - (POSTS - (COORDINATES - MATCHES)) + 1
TOKENS = 0
#: Most bits of the filter in front of the join with texts (32 MB), and what stands for a null id in it.
FILTER_BITS, NO_ID = 1 << 28, np.iinfo(np.int64).min
_FACTORS = np.random.default_rng(0xC0FFEE).integers(0, 1 << 64, COORDINATES, dtype=np.uint64) | T.U64(1)
SIGNED = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("digest", pa.binary()), ("n_shingles", pa.int64()), ("sig", pa.binary())])


def _shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all documents in turn, and where each document's begin and end."""
    words = T.Words(data, offsets, T.SPACE_SPLIT, lower=True)
    sums, counts = T.prefix(words.hash), words.counts
    many = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    first = np.append(0, np.cumsum(many))
    start = np.arange(first[-1]) + np.repeat(words.first[:-1] - first[:-1], many)
    end = np.minimum(start + size, words.first[1:][T.lengths_to_owner(many)])
    return T.spans(sums, start, end) + (end - start).astype(T.U64), first


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, h, digest, n_shingles, sig) for each row; h of the text, digest of its set, null if empty."""

    def sign(batches):
        for batch, data, offsets in T.chunks(batches):
            hashes, first = _shingles(data, offsets, shingle)
            full = np.flatnonzero(np.diff(first))
            sig = np.empty((len(full), COORDINATES), np.uint32)
            if len(full):
                at = first[full]
                for k, factor in enumerate(_FACTORS):
                    sig[:, k] = np.minimum.reduceat((hashes * factor) >> T.U64(32), at)
            ends = first.tolist()
            sets = [np.unique(hashes[ends[i] : ends[i + 1]]) for i in full.tolist()]
            digest, size, sigs = [None] * batch.num_rows, [0] * batch.num_rows, [None] * batch.num_rows
            for j, i in enumerate(full.tolist()):
                digest[i], size[i], sigs[i] = T.digest(sets[j].tobytes()), len(sets[j]), sig[j].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("h"), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(sigs, pa.binary())], schema=SIGNED)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(sign, from_arrow_schema(SIGNED))


def _tokens(sigs: list[bytes]) -> np.ndarray:
    """A name for each pair of coordinates and their values, of each signature."""
    values = np.frombuffer(b"".join(sigs), T.U64).reshape(-1, POSTS)
    return T.mix(T.mix(values.copy()) + np.arange(1, POSTS + 1, dtype=T.U64)[None, :])


def postings(classes: DataFrame, blocks: int, buckets: int) -> DataFrame:
    """(token, cls): the values in the prefixes that more than one class has."""
    parts = classes.select(F.pmod(F.xxhash64("cls"), F.lit(blocks)).cast("int").alias("blk"), "cls", "sig")
    schema = pa.schema([("token", pa.int64()), ("cls", pa.int64())])

    def counted(names):
        return B.distinct(names.ravel(), np.ones(names.size, np.int64), np.add)

    def post(table: pa.Table) -> pa.Table:
        return B.ask(table.column("blk")[0].as_py(), TOKENS, *counted(_tokens(table.column("sig").to_pylist())), buckets)

    def select(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        names = _tokens(table.column("sig").to_pylist())
        known = np.unique(names)
        often = B.answered(told, TOKENS)[np.searchsorted(known, names)]
        rarest = np.lexsort((names, often), axis=1)[:, :PREFIX]
        names, often = np.take_along_axis(names, rarest, 1), np.take_along_axis(often, rarest, 1)
        row, column = np.nonzero(often > 1)
        cls = np.asarray(table.column("cls").combine_chunks())
        return pa.Table.from_arrays([pa.array(names[row, column].view(np.int64)), pa.array(cls[row])], schema=schema)

    told = B.answers(parts.groupBy("blk").applyInArrow(post, B.ASK), np.add, B.numbers)
    return parts.groupBy("blk").cogroup(told.groupBy("blk")).applyInArrow(select, from_arrow_schema(schema))


def _bits(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each id in a filter of ``size`` bits."""
    h = T.mix(ids.view(T.U64) + T.U64(1))
    return ((h >> T.U64(32)) % T.U64(size)).astype(np.int64), ((h & T.U64(0xFFFFFFFF)) % T.U64(size)).astype(np.int64)


def _skipping(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """(doc_id, text) of the rows that can be heads, and of some others.

    A Bloom filter of at most FILTER_BITS keeps the text of rows that can't be
    joined out of the shuffle; the join decides. A fuller filter lets more through.
    """
    size = int(min(FILTER_BITS, max(1 << 16, 16 * heads.count())))

    def places(batches):
        for batch in batches:
            at = np.concatenate(_bits(np.asarray(batch.column("head").fill_null(NO_ID)), size))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.left_shift(1, at & 31))], names=["word", "bits"])

    rows = heads.select("head").mapInArrow(places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # FILTER_BITS / 32 at most
    filled = np.zeros(size // 32 + 1, np.uint32)
    filled[np.asarray(rows.column("word"))] = np.asarray(rows.column("bits"))
    shared = docs.sparkSession.sparkContext.broadcast(filled)

    def may(batches):
        for batch in batches:
            one, two = (((shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1).astype(bool) for at in _bits(np.asarray(batch.column("doc_id").cast(pa.int64()).fill_null(NO_ID)), size))
            yield batch.filter(pa.array(one & two))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(may, rows.schema)


def shingle_sets(docs: DataFrame, heads: DataFrame, shingle: int) -> DataFrame:
    """``heads`` (head, digest, ...) without these two and with shingles, from the text of the heads."""
    schema = from_arrow_schema(pa.schema([("shingles", pa.binary())]))
    carried = [f for f in heads.schema.fields if f.name not in ("head", "digest")]

    def build(batches):
        for batch, data, offsets in T.chunks(batches):
            hashes, first = _shingles(data, offsets, shingle)
            ends, sets = first.tolist(), []
            for i, want in enumerate(batch.column("digest").to_pylist()):
                own = np.unique(hashes[ends[i] : ends[i + 1]])
                sets.append(B.rising(own) if len(own) and T.digest(own.tobytes()) == want else None)
            out = batch.drop_columns(["text", "digest"]).append_column("shingles", pa.array(sets, pa.binary()))
            yield out.filter(out.column("shingles").is_valid())

    joined = _skipping(docs, heads).join(heads, F.col("doc_id").eqNullSafe(F.col("head"))).select("text", "digest", *[f.name for f in carried])
    return joined.mapInArrow(build, StructType([*carried, *schema.fields]))


def _alike(a: list[bytes], b: list[bytes]) -> np.ndarray:
    one, two = (np.frombuffer(b"".join(x), np.uint32).reshape(-1, COORDINATES) for x in (a, b))
    return (one == two).sum(axis=1) >= MATCHES


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The (a, b) whose signatures have ``matches`` equal coordinates."""

    def alike(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_alike(batch.column("sig_a").to_pylist(), batch.column("sig_b").to_pylist()))).select(["a", "b"])

    for side in "ab":
        pairs = pairs.join(classes.select(F.col("cls").alias(side), F.col("sig").alias(f"sig_{side}")), side)
    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(alike, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(v, comp): least vertex in reach, for all vertices of edges (a, b) but the least ones.

    Large and small stars in turn: larger neighbours move to the least neighbour of
    their vertex, then smaller ones do. Edges never grow in number, and at the end
    each component is a star around its least vertex.
    """
    lower = kept(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    calm, large = 0, False
    while calm < 2:
        large = not large
        low = lower.groupBy("b").agg(F.min("a").alias("m"))
        if large:
            step = lower.join(low.withColumnRenamed("b", "a"), "a", "left")
            moved, new = F.col("m").isNotNull(), F.struct(F.coalesce("m", "a").alias("a"), "b")
        else:
            step = lower.join(low, "b")
            moved = F.col("a") != F.col("m")
            new = F.struct(F.col("m").alias("a"), F.when(moved, F.col("a")).otherwise(F.col("b")).alias("b"))
        step = step.select(new.alias("e"), moved.alias("moved")).groupBy("e.a", "e.b").agg(F.max("moved").alias("moved"))
        step = kept(step)
        calm = calm + 1 if step.filter("moved").isEmpty() else 0
        lower = step.select("a", "b")
    return lower.select(F.col("b").alias("v"), F.col("a").alias("comp"))


def _joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(cls, comp) of the classes by their links (a, b)."""
    return kept(classes.select("cls").join(components(links).toDF("cls", "to"), "cls", "left").select("cls", F.coalesce("to", "cls").alias("comp")))


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (cls, comp), joined further by links (a, b) of classes; between components, not members: few are left."""
    for side in "ab":
        links = links.join(comps.toDF(side, f"{side}_comp"), side)
    further = components(links.select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))).toDF("comp", "to")
    return kept(comps.join(further, "comp", "left").select("cls", F.coalesce("to", "comp").alias("comp")))


def _leads(posted: DataFrame, comps: DataFrame, salt: str) -> DataFrame:
    """Pairs of each member with its group's leader, where their components differ."""
    members = posted.join(comps, "cls")
    leader = F.min(F.struct(F.expr(salt).alias("order"), F.col("cls").alias("leader"), F.col("comp").alias("at"))).alias("lead")
    groups = members.groupBy("token").agg(leader, F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token", "lead.leader", "lead.at")
    return members.join(groups, "token").filter("comp <> at").select(F.col("cls").alias("a"), F.col("leader").alias("b")).distinct()


def _starred(led: DataFrame) -> DataFrame:
    """Links (a, b) that join what the pairs (member, leader) do: a member to its least leader, and that one to the others."""
    own = led.groupBy("member").agg(F.array_sort(F.collect_set("leader")).alias("l"))  # a member has a prefix of leaders at most
    links = F.transform("l", lambda x, i: F.struct(F.when(i == 0, F.col("member")).otherwise(F.col("l")[0]).alias("a"), x.alias("b")))
    return own.select(F.explode(links).alias("e")).select("e.a", "e.b").distinct()


def _meeting(members: DataFrame, group: str) -> DataFrame:
    """``members`` (group, cls, comp, ...) dealt to tiles (group, chunk, tile, side) in which all pairs of different components meet.

    Members of a group's largest component (side 2) don't meet each other, only the others
    (side 1, in chunks); these meet each other as side 2 too. A group that one
    component has for the most part takes few tiles; in a small group all meet (side 0).
    """
    counts = members.groupBy(group, "comp").count()
    tops = counts.groupBy(group).agg(F.max_by("comp", F.struct("count", "comp")).alias("top"), F.sum("count").alias("n"), F.max("count").alias("most")).filter("n > most")
    sizes = tops.select(group, "top", F.ceil(F.col("n") / F.lit(TILE)).cast("int").alias("tiles"), F.ceil((F.col("n") - F.col("most")) / F.lit(TILE)).cast("int").alias("chunks"))
    rows = members.join(sizes, group)
    tile, chunk = (F.pmod(F.xxhash64("cls"), F.col(c)).cast("int") for c in ("tiles", "chunks"))
    few = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(chunk.alias("chunk"), t.alias("tile"), F.lit(1).alias("side")))
    many = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(c.alias("chunk"), tile.alias("tile"), F.lit(2).alias("side")))
    alone = F.array(F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("tile"), F.lit(0).alias("side")))
    places = F.when(F.col("tiles") == 1, alone).when(F.col("comp") == F.col("top"), many).otherwise(F.concat(few, many))
    return rows.withColumn("place", F.explode(places)).select(*members.columns, "place.chunk", "place.tile", "place.side")


def _refined(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members (token, cls, comp) of large groups in smaller ones.

    Posted again within their group, under the values that are rarest there: two
    members with enough equal coordinates share one of these as well.
    """

    def values(batches):
        for batch in batches:
            names = _tokens(batch.column("sig").to_pylist())
            wide = [np.repeat(np.asarray(batch.column(c)), POSTS) for c in ("token", "cls", "comp")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (wide[0], names.ravel().view(np.int64), wide[1], wide[2])], names=["token", "value", "cls", "comp"])

    every = members.join(classes.select("cls", "sig"), "cls").select("token", "cls", "comp", "sig").mapInArrow(values, "token long, value long, cls long, comp long")
    often = every.groupBy("token", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("token", "cls").orderBy("n", "value"))
    rarest = every.join(often, ["token", "value"]).withColumn("rank", rank).filter((F.col("rank") <= PREFIX) & (F.col("n") > 1))
    return rarest.select(F.xxhash64("token", "value").alias("token"), "cls", "comp")


def _across(posted: DataFrame, comps: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of one group in different components with enough equal coordinates, found in tiles."""
    members = posted.join(comps, "cls")
    sizes = members.groupBy("token", "comp").count().groupBy("token").agg((F.sum("count") - F.max("count")).alias("few")).filter("few > 0")
    members = members.join(sizes, "token")
    large = F.col("few") > TILE
    dealt = members.filter(~large).drop("few").unionByName(_refined(members.filter(large).drop("few"), classes))
    dealt = _meeting(dealt, "token").join(classes.select("cls", "sig"), "cls")

    def compare(table: pa.Table) -> pa.Table:
        cls, comp, side = (np.asarray(table.column(c).combine_chunks()) for c in ("cls", "comp", "side"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
        return _spanning(cls, comp, sig, None if (side == 0).all() else side, None)

    return dealt.groupBy("token", "chunk", "tile").applyInArrow(compare, "a long, b long").distinct()


def _spanning(cls: np.ndarray, comp: np.ndarray, sig: np.ndarray, side: np.ndarray | None, sure) -> pa.Table:
    """Links of a tile that join components: between any rows, or across the two sides.

    Every pair of different components with enough equal coordinates (and, if
    given, ``sure``) is joined by the links returned or by others of them; there
    are fewer links than rows.
    """
    label = np.unique(comp, return_inverse=True)[1]
    sizes = np.bincount(label)
    a, b = [], []
    for x in np.argsort(sizes[label], kind="stable").tolist():  # rows of the largest component last: the others have met them
        failed = np.zeros(len(cls), bool)
        while True:
            mates = (label != label[x]) & ~failed
            if side is not None:
                mates &= side != side[x]
            at = np.flatnonzero(mates)
            if not len(at):
                break
            same = (sig[at] == sig[x]).sum(axis=1)
            order = np.argsort(-same, kind="stable")
            at = at[order[: int((same >= MATCHES).sum())]]
            hit = None
            for y in at.tolist():
                if sure is None or sure(x, y):
                    hit = y
                    break
                failed[y] = True
            if hit is None:
                break
            a.append(min(cls[x], cls[hit]))
            b.append(max(cls[x], cls[hit]))
            label[label == label[hit]] = label[x]
        if (label == label[0]).all():
            break
    return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _links(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Confirmed links that join components within the tiles of (cls, comp, side, sig, shingles)."""

    def link(table: pa.Table) -> pa.Table:
        cls, comp = (np.asarray(table.column(c).combine_chunks()) for c in ("cls", "comp"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
        packed = table.column("shingles").to_pylist()
        side = table.column("side").to_numpy()
        sets: dict[int, np.ndarray] = {}

        def own(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = B.risen(packed[i])
            return sets[i]

        def sure(x: int, y: int) -> bool:
            p, q = own(x), own(y)
            same = int(T.found(p, q).sum()) if len(p) < len(q) else int(T.found(q, p).sum())
            return 100 * same >= percent * (len(p) + len(q) - same)

        return _spanning(cls, comp, sig, None if (side == 0).all() else side, sure)

    return rows.groupBy(*keys).applyInArrow(link, "a long, b long").distinct()


def _family_links(docs: DataFrame, family: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(cls, comp) by confirmed links within families (cls, fam), tile by tile."""
    sizes = family.groupBy("fam").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int")
    leads = family.join(sizes.filter("tiles > 1"), "fam").withColumn("k", F.row_number().over(W.partitionBy("fam").orderBy(F.xxhash64("cls")))).filter(F.col("k") <= LEADS)
    dealt = family.join(sizes, "fam").join(leads.select("cls", "k"), "cls", "left")
    dealt = dealt.select("cls", "fam", F.when(F.col("k").isNull(), F.array(tile)).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tiles"))
    # the sets carry all that is needed, so that they are shuffled once
    full = kept(shingle_sets(docs, kept(classes.join(dealt, "cls")), shingle))
    rows = full.select("fam", F.explode("tiles").alias("tile"), "cls", F.col("cls").alias("comp"), F.lit(0).alias("side"), "sig", "shingles")
    alone = family.select("cls")
    links = kept(_links(rows, ["fam", "tile"], percent))
    comps = _joined(alone, links)
    # families of several tiles: what is outside the largest component meets all others
    wide = family.join(sizes.filter("tiles > 1"), "fam").join(comps, "cls").select("cls", "fam", "comp")
    if wide.isEmpty():
        return comps
    rows = _meeting(wide, "fam").join(full.select("cls", "sig", "shingles"), "cls")
    more = _links(rows, ["fam", "chunk", "tile"], percent)
    return _merged(comps, more)


def _grouped(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, h, n_shingles, comp, component_id) for each row; h is the text's xxhash64, comp null where the set is empty."""
    signed = kept(signatures(bounded(docs), shingle))
    classes = signed.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("head"), F.first("sig").alias("sig"))
    classes = kept(classes.withColumn("cls", F.monotonically_increasing_id()))  # as written, so each class has one number
    buckets = B.buckets(classes, classes.count() * POSTS)
    posted = postings(classes, buckets, buckets)
    posted = kept(posted)
    # families: closed under likely pairs, found by signature alone
    apart = kept(posted.select("cls").distinct().withColumn("comp", F.col("cls")))
    likely_classes = kept(classes.join(apart.select("cls"), "cls"))
    led = kept(likely(_leads(posted, apart, "xxhash64(cls)"), likely_classes))
    known = _joined(apart, _starred(led.toDF("member", "leader")))
    families = _merged(known, kept(_across(posted, known, likely_classes)))
    several = families.groupBy("comp").count().filter("count > 1").select("comp")
    family = kept(families.join(several, "comp").select("cls", F.col("comp").alias("fam")))
    comps = _family_links(docs, family, likely_classes, shingle, percent)
    placed = classes.select("cls", "digest", "head").join(comps, "cls", "left").select("digest", "head", F.coalesce("comp", "cls").alias("comp"))
    ids = placed.groupBy("comp").agg(F.min("head").alias("component_id"))
    found = placed.join(ids, "comp").select("digest", "comp", "component_id")
    out = signed.select("doc_id", "h", "digest", "n_shingles").join(found, "digest", "left")
    out = out.withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "h", "n_shingles", "comp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, h, n_shingles, component_id, kept) for each row; h is the text's xxhash64."""
    kept_one = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return _grouped(docs, shingle, percent).select("doc_id", "h", "n_shingles", "component_id", kept_one)


def deduplicate(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: of the smallest id, nulls last, then of the least text hash; repeated rows go too."""
    alone = F.col("comp").isNull()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("first")
    groups = _grouped(docs, shingle, percent).groupBy("comp", F.when(alone, F.col("doc_id")).alias("own_id"), F.when(alone, F.col("h")).alias("own_h"))
    keep = groups.agg(first).select(F.col("first.doc_id").alias("_id"), F.col("first.h").alias("_k"))
    marked = docs.withColumn("_h", F.xxhash64("text"))
    found = marked.join(keep, marked["doc_id"].eqNullSafe(keep["_id"]) & (marked["_h"] == keep["_k"]), "left_semi")
    return found.dropDuplicates(["doc_id", "_h"]).select(*docs.columns)
