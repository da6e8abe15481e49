"""Benchmark decontamination: documents scanned for n-word windows of benchmark items.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z in lower case. The windows of
all items are named by 128-bit digests of their words. Sorted rolling hashes of them form a set that each
task holds; document windows that fall into it are verified by digest. An item of fewer words
than the window is one window. Documents are never shuffled and are read once. The set is
broadcast in parts of some ``part_windows`` distinct windows (40 bytes each), of which a task holds one at
a time and the driver builds one at a time.

Defined results: a null text has no words and no hits; items that are null or
without words, or without an id, have no windows; rows of the same id are one
item; repeated rows are judged each, texts of any length whole; without items nothing is hit;
other columns, of any name, pass through; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from . import _text as T
from ._shared import bounded, kept

PART_WINDOWS = 1 << 20
#: Bits of a hash that a first look-up uses; the table takes 4 MB.
LOOK = 22
WINDOW = pa.schema([("size", pa.int32()), ("hash", pa.int64()), ("digest", pa.binary()), ("item", pa.int64())])


class Known:
    """Some windows of items: by size the sorted hashes, and for each window its digest and item."""

    def __init__(self, table: pa.Table):
        size, name = np.asarray(table.column("size")), np.asarray(table.column("hash")).view(T.U64)
        order = np.lexsort((name, size))
        self.hash, self.item = name[order], np.asarray(table.column("item"))[order]
        self.digest = np.frombuffer(b"".join(table.column("digest").to_pylist()), "V16")[order]
        ends = np.searchsorted(size[order], np.arange(size.max() + 2 if len(size) else 1)).tolist()
        self.sizes = {n: (lo, hi) for n, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)) if lo < hi}


def windows(items: DataFrame, n: int) -> DataFrame:
    """(size, hash, digest, item): the distinct windows of each item of (item_id, text)."""

    def step(batches):
        for batch, data, offsets in T.chunks(batches):
            words, plain = T.Words(data, offsets, T.ALNUM, lower=True), _Plain(data)
            size = np.minimum(n, words.counts)
            many = np.where(size > 0, words.counts - size + 1, 0)
            owner = T.lengths_to_owner(many)
            start = np.arange(len(owner)) + np.repeat(words.first[:-1] - np.append(0, np.cumsum(many))[:-1], many)
            end = start + size[owner]
            digest = [plain.digest(words, a, b) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            columns = [size[owner], T.spans(T.prefix(words.hash), start, end).view(np.int64), digest, np.asarray(batch.column("item_id"))[owner]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, WINDOW, strict=True)], schema=WINDOW)

    return items.mapInArrow(step, from_arrow_schema(WINDOW)).distinct()


class _Plain:
    """Lower-cased bytes of a chunk, made when first needed."""

    def __init__(self, data: np.ndarray):
        self.data, self.raw = data, None

    def digest(self, words: T.Words, a: int, b: int) -> bytes:
        """Of the words a to b."""
        if self.raw is None:
            self.raw = T.lowered(self.data)
        return T.digest(b" ".join(self.raw[x:y] for x, y in zip(words.start[a:b].tolist(), words.end[a:b].tolist(), strict=True)))


def hits(known: Known, words: T.Words, plain: _Plain, mask: np.ndarray, items: dict[int, set[int]]) -> None:
    """Adds verified windows to the mask of words, and their items to those found by document."""
    sums, owner, ends = T.prefix(words.hash), T.lengths_to_owner(words.counts), words.first[1:]
    look = np.zeros(1 << LOOK, bool)
    look[(known.hash >> T.U64(64 - LOOK)).astype(np.int64)] = True
    for size, (lo, hi) in known.sizes.items():
        hashes, listed = T.rolling(sums, size), known.hash[lo:hi]
        at = np.flatnonzero(look[(hashes >> T.U64(64 - LOOK)).astype(np.int64)])
        at = at[at + size <= ends[owner[at]]]
        at = at[T.found(hashes[at], listed)]
        begin, end = (lo + np.searchsorted(listed, hashes[at], side) for side in ("left", "right"))
        good = []
        for i, a, b in zip(at.tolist(), begin.tolist(), end.tolist(), strict=True):
            same = known.digest[a:b] == np.frombuffer(plain.digest(words, i, i + size), "V16")[0]
            if same.any():
                good.append(i)
                items.setdefault(int(owner[i]), set()).update(known.item[a:b][same].tolist())
        mask |= T.cover(len(owner), np.array(good, np.int64), size)


def _parts(benchmark: DataFrame, n: int, part_windows: int) -> list[Broadcast]:
    """The windows in parts of about ``part_windows``."""
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    every = kept(windows(items, n))
    parts = max(1, ceil(every.count() / part_windows))
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast(Known(every.filter(F.pmod("hash", F.lit(parts)) == k).toArrow())) for k in range(parts)]


def scan(docs: DataFrame, benchmark: DataFrame, n: int, schema: pa.Schema, emit: Callable[[pa.RecordBatch, T.Words, np.ndarray, dict[int, set[int]]], pa.RecordBatch], part_windows: int = PART_WINDOWS) -> DataFrame:
    """Applies ``emit`` to rows, their words, the mask of words hit, and the items by row."""
    parts = _parts(benchmark, n, part_windows)

    def step(batches):
        for batch, data, offsets in T.chunks(batches):
            words, plain = T.Words(data, offsets, T.ALNUM, lower=True), _Plain(data)
            mask, items = np.zeros(len(words.start), bool), {}
            for part in parts:
                hits(part.value, words, plain, mask, items)
                if len(parts) > 1:  # one at a time in memory; read again from the executor's copy
                    vars(part).pop("_value", None)
            yield emit(batch, words, mask, items)

    return bounded(docs).mapInArrow(step, from_arrow_schema(schema))


def digests(docs: DataFrame, benchmark: DataFrame, n: int = 13, part_windows: int = PART_WINDOWS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])

    def emit(batch, words, mask, items):
        hit = np.diff(np.append(0, np.cumsum(mask))[words.first])
        own = [sorted(map(str, items.get(i, ()))) for i in range(batch.num_rows)]
        columns = [batch.column("doc_id").cast(pa.int64()), words.counts, hit, [len(x) for x in own], [T.sha256(",".join(x).encode()) for x in own], (hit > 0) & (20 * hit >= words.counts)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return scan(docs.select("doc_id", "text"), benchmark, n, schema, emit, part_windows)


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 13, part_windows: int = PART_WINDOWS) -> DataFrame:
    """``docs`` without contaminated rows, and without the hit spans in the others.

    A span goes from the start of a run's first word to the end of its last one;
    ``n_chars``, if there, follows the text. Rows without hits stay as they are.
    """
    schema = to_arrow_schema(docs.schema)

    def emit(batch, words, mask, items):
        if not mask.any():
            return batch.cast(schema)
        hit = np.diff(np.append(0, np.cumsum(mask))[words.first])
        keep = ~((hit > 0) & (20 * hit >= words.counts))
        texts = batch.column("text").to_pylist()
        for i in np.flatnonzero(keep & (hit > 0)).tolist():
            lo, hi = words.first[i], words.first[i + 1]
            raw, base, out, done = texts[i].encode(), int(words.offsets[i]), [], 0
            for a, b in zip(*T.runs(mask[lo:hi]), strict=True):
                out.append(raw[done : int(words.start[lo + a]) - base])
                done = int(words.end[lo + b - 1]) - base
            texts[i] = b"".join([*out, raw[done:]]).decode()
        batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
        if "n_chars" in batch.schema.names:
            sizes = [None if t is None else len(t) if h else c for t, h, c in zip(texts, hit.tolist(), batch.column("n_chars").to_pylist(), strict=True)]
            batch = batch.set_column(batch.schema.get_field_index("n_chars"), "n_chars", pa.array(sizes, schema.field("n_chars").type))
        return batch.filter(pa.array(keep)).cast(schema)

    return scan(docs, benchmark, n, schema, emit, part_windows)
