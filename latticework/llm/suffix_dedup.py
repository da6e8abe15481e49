"""Suffix-array dedup: bytes under strings of ``length`` that start more than once.

Suffixes are sorted to a depth of ``length``, bucket by bucket, with ties resolved by
ranks of a cover sample. The sample is content-defined in place of modulo v: each
window of ``length`` bytes holds the sample position that has the least hash of
half-length strings in it, so equal windows hold it at the same offset, which makes
ranks usable as sort keys. A sample string that occurs once rules out all windows
around it; these are never sent. For the others, a *context* (sample string, and
what its windows reach to either side) goes to a bucket of the sample strings.
There the contexts are sorted by what follows the sample's start and by what
precedes it, read backwards; common prefixes of neighbours turn the two orders into
ranks to any depth. The windows that start d bytes before their sample are one suffix bucket after
the other (d = 0, 1, ...): equal ones have an equal left rank to depth d and right
rank to depth ``length`` - d, both compared on the bytes themselves, so no hash
decides. Where one sample string occurs more than ``heavy`` times (a sentence that is everywhere), its windows
are grouped by 128-bit digests instead, each on its own, so that no bucket grows with the
input. Memory is bounded by a block of text and a bucket.

Equal texts form a class of which one member stands for all, with weight two.

Defined results: a null text is empty; texts shorter than ``length`` keep all;
repeated rows count as elsewhere; ids, null or equal, play no part; long texts are
taken in overlapping pieces; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from . import _blocks as B
from . import _text as T
from ._shared import bounded

#: Occurrences of a sample string from which its windows go alone, and bytes of text that a bucket is laid out for.
HEAVY, BUCKET_TEXT = 8192, 16 << 20
#: Bits of a position in a piece of text; the others are the hash by which a sample is least.
PLACE = 22
#: What comes back to a block: by kind, a copied text (h, g) and whether it stands for all; a sample string's name and count; a context's number and its repeated windows; a digest of a repeated window.
TOLD = "blk int, kind int, one long, two long, bits binary"
COPIES, SAMPLES, CONTEXTS, WINDOWS = range(4)


def _copies(text: GroupedData) -> DataFrame:
    """For each block the texts that occur more than once, and where one stands for them.

    Blocks tell what they hold: a second reading of the rows may number them otherwise, and would deal them to other blocks.
    """

    def held(table: pa.Table) -> pa.Table:
        own = table.select(["blk", "sha"]).group_by(["blk", "sha"]).aggregate([([], "count_all")])
        return pa.Table.from_arrays([own.column("blk"), own.column("sha").cast(pa.binary()), own.column("count_all")], ["blk", "sha", "n"])

    same = W.partitionBy("sha")
    here = text.applyInArrow(held, "blk int, sha binary, n long")
    found = here.select("blk", "sha", F.sum("n").over(same).alias("n"), F.min("blk").over(same).alias("at")).filter("n > 1")
    return found.select("blk", F.lit(COPIES).alias("kind"), (F.col("blk") == F.col("at")).cast("long").alias("one"), F.lit(0).cast("long").alias("two"), F.col("sha").alias("bits"))


class _Told:
    """What a block was told."""

    def __init__(self, told: pa.Table):
        kind = np.asarray(told.column("kind"))
        one, two, bits = (told.column(c).to_numpy(zero_copy_only=False) for c in ("one", "two", "bits"))
        self.copies = dict(zip(bits[kind == COPIES].tolist(), one[kind == COPIES].tolist(), strict=True))
        at = np.flatnonzero(kind == SAMPLES)
        at = at[np.argsort(one[at].view(T.U64))]
        self.samples, self.counts = one[at].view(T.U64), two[at]
        self.contexts = dict(zip(one[kind == CONTEXTS].tolist(), bits[kind == CONTEXTS].tolist(), strict=True))
        self.windows = set(bits[kind == WINDOWS].tolist())

    def count(self, names: np.ndarray) -> np.ndarray:
        """How often each sample string occurs, or 0 if once."""
        if not len(self.samples):
            return np.zeros(len(names), np.int64)
        at = np.minimum(np.searchsorted(self.samples, names), len(self.samples) - 1)
        return np.where(self.samples[at] == names, self.counts[at], 0)


def _roles(table: pa.Table, copies: dict[bytes, int]) -> np.ndarray:
    """For each row: 0 a text of its own, 1 stands for its copies, 2 one of those."""
    out, stands = np.zeros(table.num_rows, np.int8), dict(copies)
    for i, sha in enumerate(table.column("sha").to_pylist() if copies else ()):
        if sha in stands:
            out[i] = 1 if stands[sha] else 2
            stands[sha] = 0
    return out


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Where each piece begins, its bytes, and its offsets; a long text is cut so that each window is in one piece."""
    step = T.CHUNK
    if len(data) <= step:
        yield 0, data, offsets
        return
    for lo, hi in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        for at in range(lo, max(lo + 1, hi - length + 1), step):
            piece = data[at : min(hi, at + step + length - 1)]
            yield at, piece, np.array([0, len(piece)])


def _runs(data: np.ndarray, offsets: np.ndarray, skip: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one sample: first and last window, the sample's place, its name, its text; ``skip``: texts to leave out."""
    short = (length + 1) // 2
    names = T.rolling(T.byte_sums(data), short)
    if len(data) < length:
        return (np.empty(0, np.int64),) * 3 + (names[:0], np.empty(0, np.int64))
    keys = (names >> T.U64(PLACE) << T.U64(PLACE)) | np.arange(len(names), dtype=T.U64)  # the leftmost of equal ones
    sample = (T.sliding(keys, length - short + 1, np.minimum) & T.U64((1 << PLACE) - 1)).astype(np.int64)
    owner = T.lengths_to_owner(np.diff(offsets))[: len(sample)]
    at = np.flatnonzero((np.arange(len(sample)) + length <= offsets[1:][owner]) & ~skip[owner])
    if not len(at):
        return at, at, at, names[:0], at
    new = np.append(True, (sample[at[1:]] != sample[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]]))
    begin = np.flatnonzero(new)
    first = at[begin]
    last = at[np.append(begin[1:], len(at)) - 1]
    return first, last, sample[first], names[sample[first]], owner[first]


def _steps(table: pa.Table, copies: dict[bytes, int], length: int):
    """For each chunk: rows, bytes, offsets, roles, and an iterator over pieces with their runs and the weight of each.

    Rows of a block come in the order in which a shuffle fetched them, another one in each stage; here they are in the
    order of their digests, so that contexts have the same numbers whenever they are counted.
    """
    table = table.combine_chunks().sort_by("sha")
    roles, row = _roles(table, copies), 0

    def over(data, offsets, role):
        for base, piece, ends in _pieces(data, offsets, length):
            own = role if len(ends) == len(offsets) else role[np.searchsorted(offsets, base, "right") - 1][None]
            first, last, at, names, doc = _runs(piece, ends, own > 1, length)
            yield base, piece, first, last, at, names, 1 + own[doc].astype(np.int64)

    for batch, data, offsets in T.chunks(table.to_batches()):
        role = roles[row : row + batch.num_rows]
        row += batch.num_rows
        yield batch, data, offsets, role, over(data, offsets, role)


def _contexts(steps, told: _Told, length: int, heavy: int):
    """Each run that may repeat: its chunk's bytes, base, first and last window, whether its windows go alone, weight, context and lead."""
    for _, _, _, _, pieces in steps:
        yield from _hot(pieces, told, length, heavy)


def _hot(pieces, told: _Told, length: int, heavy: int):
    for base, piece, first, last, at, names, weight in pieces:
        count = told.count(names)
        hot = np.flatnonzero(count)
        raw = piece.tobytes() if len(hot) else b""
        for a, z, s, h, w, n in zip(first[hot].tolist(), last[hot].tolist(), at[hot].tolist(), names[hot].view(np.int64).tolist(), weight[hot].tolist(), count[hot].tolist(), strict=True):
            yield base + a, base + z, n > heavy, h, w, raw[a : z + length], s - a


def ranked(table: pa.Table, length: int) -> list[bytes]:
    """For each context the bits of its windows that repeat among the contexts."""
    short = (length + 1) // 2
    reach = length - short
    n, raw = table.num_rows, table.column("context").to_pylist()
    lead, weight = (np.asarray(table.column(c)).astype(np.int64) for c in ("lead", "weight"))
    size = np.array([len(x) for x in raw])
    last = size - length  # the last window, from the context's start
    grid = np.zeros((n, reach + length), np.uint8)
    for i, (x, k) in enumerate(zip(raw, lead.tolist(), strict=True)):
        grid[i, reach - k : reach - k + len(x)] = np.frombuffer(x, np.uint8)

    def order(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the rows, and the bytes each has in common with the one before it."""
        side = np.ascontiguousarray(side)
        by = np.argsort(side.view(f"S{side.shape[1]}").ravel(), kind="stable")
        common = np.zeros(n, np.int64)
        for lo in range(1, n, 1 << 14):
            unlike = side[by[lo : lo + (1 << 14)]] != side[by[lo - 1 : lo - 1 + min(1 << 14, n - lo)]]
            common[lo : lo + (1 << 14)] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), side.shape[1])
        return by, common

    right, right_common = order(grid[:, reach:])
    left, left_common = order(grid[:, reach - 1 :: -1] if reach else np.zeros((n, 1), np.uint8))
    twice = np.zeros((n, reach + 1), bool)
    rank = np.empty((2, n), np.int64)
    for d in range(reach + 1):  # windows that start d bytes before their sample
        own = np.flatnonzero((lead >= d) & (lead - last <= d))
        if not len(own):
            continue
        rank[0, left] = np.cumsum(left_common < d)
        rank[1, right] = np.cumsum(right_common < length - d)
        key = rank[0, own] * (n + 1) + rank[1, own]
        by = np.argsort(key)
        begin = np.flatnonzero(np.append(True, key[by[1:]] != key[by[:-1]]))
        total = np.add.reduceat(weight[own[by]], begin)
        twice[own[by], d] = np.repeat(total > 1, np.diff(np.append(begin, len(by))))
    return [np.packbits(twice[i, k - z : k + 1][::-1]).tobytes() if twice[i].any() else b"" for i, (k, z) in enumerate(zip(lead.tolist(), last.tolist(), strict=True))]


def removal(docs: DataFrame, length: int, schema: pa.Schema, emit: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray], pa.Table], heavy: int) -> DataFrame:
    """Applies ``emit`` to rows, their bytes, offsets and the mask of bytes to remove."""
    blocks, total = B.layout(bounded(docs))
    buckets = max(ceil(total / BUCKET_TEXT), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = B.in_blocks(docs, blocks, F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("sha"))
    sent = pa.schema([("blk", pa.int32()), ("h", pa.int64()), ("number", pa.int64()), ("lead", pa.int32()), ("weight", pa.int64()), ("context", pa.binary())])

    def sample(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return B.COUNTS.empty_table()
        names = [np.repeat(names, weight) for *_, pieces in _steps(table, _Told(told).copies, length) for *_, names, weight in pieces]
        return B.counts(table.column("blk")[0].as_py(), np.concatenate([np.empty(0, T.U64), *names]))

    def contexts(table: pa.Table, told: pa.Table) -> pa.Table:
        """The block's distinct contexts, numbered, and the digests of windows that go alone."""
        if not table.num_rows:
            return sent.empty_table()
        known, named, alone = _Told(told), {}, {}
        for _, _, single, h, weight, context, lead in _contexts(_steps(table, known.copies, length), known, length, heavy):
            if single:
                for k in range(len(context) - length + 1):
                    x = T.digest(context[k : k + length])
                    alone[x] = min(2, alone.get(x, 0) + weight)
            else:
                had = named.setdefault((context, lead), [h, 0])
                had[1] = min(2, had[1] + weight)
        n, m = len(named), len(alone)
        columns = [
            [table.column("blk")[0].as_py()] * (n + m), [x[0] for x in named.values()] + [None] * m, [*range(n)] + [None] * m,
            [k[1] for k in named] + [None] * m, [x[1] for x in named.values()] + [*alone.values()], [k[0] for k in named] + [*alone],
        ]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, sent, strict=True)], schema=sent)

    def bucket(table: pa.Table) -> pa.Table:
        """What repeats: bits of a context's windows, or the digest of a window that goes alone."""
        alone = table.filter(table.column("h").is_null())
        table = table.filter(table.column("h").is_valid())
        bits = ranked(table, length) if table.num_rows else []
        digest = alone.column("context").to_pylist()
        total = {}
        for x, n in zip(digest, alone.column("weight").to_pylist(), strict=True):
            total[x] = total.get(x, 0) + n
        twice = [x if total[x] > 1 else b"" for x in digest]
        kind = pa.array([CONTEXTS] * len(bits) + [WINDOWS] * len(twice), pa.int32())
        number = pa.chunked_array([*table.column("number").chunks, *alone.column("number").fill_null(0).chunks], pa.int64())
        blk = pa.chunked_array([*table.column("blk").chunks, *alone.column("blk").chunks], pa.int32())
        out = pa.table({"blk": blk, "kind": kind, "one": number, "two": pa.array([0] * len(kind), pa.int64()), "bits": pa.array(bits + twice, pa.binary())})
        return out.filter(pa.array([bool(x) for x in bits + twice]))

    def result(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        known, numbers, out = _Told(told), {}, []
        for batch, data, offsets, role, pieces in _steps(table, known.copies, length):
            marks = []
            for first, last, single, _, _, context, lead in _hot(pieces, known, length, heavy):
                if single:
                    marks += [first + k for k in range(len(context) - length + 1) if T.digest(context[k : k + length]) in known.windows]
                elif bits := known.contexts.get(numbers.setdefault((context, lead), len(numbers))):
                    marks += (first + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=last - first + 1))).tolist()
            gone = T.cover(len(data), np.array(marks, np.int64), length)
            for i in np.flatnonzero((role > 0) & (np.diff(offsets) >= length)).tolist():
                gone[offsets[i] : offsets[i + 1]] = True
            out.append(emit(batch, data, offsets, gone))
        return pa.concat_tables(out)

    text = parts.groupBy("blk")
    copies = _copies(text)
    asked = text.cogroup(copies.groupBy("blk")).applyInArrow(sample, B.ASKED)
    samples = B.repeated(asked).select("blk", F.lit(SAMPLES).alias("kind"), F.col("name").alias("one"), F.col("total").alias("two"), F.lit(None).cast("binary").alias("bits"))
    told = copies.unionByName(samples)
    found = text.cogroup(told.groupBy("blk")).applyInArrow(contexts, from_arrow_schema(sent))
    place = F.when(F.col("h").isNull(), F.xxhash64("context")).otherwise(F.xxhash64("h"))
    repeats = found.withColumn("bucket", F.pmod(place, F.lit(buckets))).groupBy("bucket").applyInArrow(bucket, TOLD)
    return text.cogroup(told.unionByName(repeats).groupBy("blk")).applyInArrow(result, from_arrow_schema(schema))


def _counts(offsets: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, removed bytes and maximal removed runs of each row."""
    removed, spans = [], []
    for lo, hi in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        own = gone[lo:hi]
        removed.append(int(np.count_nonzero(own)))
        spans.append(int(np.count_nonzero(own[1:] & ~own[:-1])) + int(own[0]) if removed[-1] else 0)
    return np.diff(offsets), np.array(removed, np.int64), np.array(spans, np.int64)


def _kept(data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> Iterator[bytes]:
    """What is left of each row."""
    for lo, hi in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        yield data[lo:hi][~gone[lo:hi]].tobytes()


def dedup_bytes(docs: DataFrame, length: int = 200, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, kept binary, spans array of removed byte ranges) for each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def emit(batch, data, offsets, gone):
        spans = [[{"start": int(a), "end": int(b)} for a, b in zip(*T.runs(gone[lo:hi]), strict=True)] for lo, hi in zip(offsets, offsets[1:], strict=False)]
        return pa.Table.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(_kept(data, offsets, gone), pa.binary()), pa.array(spans, schema.field("spans").type)], schema=schema)

    return removal(docs, length, schema, emit, heavy)


def digests(docs: DataFrame, length: int = 200, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of what ``dedup_bytes`` leaves."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def emit(batch, data, offsets, gone):
        sizes, removed, spans = _counts(offsets, gone)
        return pa.Table.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.array(removed), pa.array(spans), pa.array([T.sha256(x) for x in _kept(data, offsets, gone)], pa.string())], schema=schema)

    return removal(docs, length, schema, emit, heavy)
