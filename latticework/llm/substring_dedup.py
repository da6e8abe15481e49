"""Substring dedup: repeated fixed-length token windows, removed after their first document.

Rabin-Karp hashes roll over the words of each document. Any two equal windows of
``window`` words hold an equal *anchor* at the same place (the least hash of the
half-length windows inside), so Spark first counts anchors, some 7 % of the
positions; a window whose anchor is in one document only can't repeat. The other
windows are named by a 128-bit digest of their words, never by a rolling hash, and
grouped by name in Spark for the least id; a document gets back the places of its
windows that start in an earlier one, and these merge into maximal intervals.

Of copies of a text only those of the least id are read so: what the others lose
follows from it, they all do. A name that is everywhere is folded before the shuffle, and the
join that brings its least id back can be split, as its other side has it once.

Defined results: a null or empty text has no words; documents of fewer words
than the window keep all; null ids neither precede others nor lose words; equal
ids do not precede each other, repeated rows lose the same; texts of any length are
taken whole; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from . import _text as T
from ._shared import bounded, kept

ANCHORS, WINDOWS = "doc_id long, tag long, sha binary, hs array<long>", "w1 long, w2 long, doc_id long, tag long, pos int"


def _chunk(data: np.ndarray, offsets: np.ndarray, window: int):
    """Words, owner of each window start, anchor hashes and each window's least anchor."""
    words = T.Words(data, offsets, T.SPACE_SPLIT)
    short = (window + 1) // 2
    anchors = T.rolling(T.prefix(words.hash), short)
    owner = T.lengths_to_owner(words.counts)
    ends = words.first[1:][owner]
    inside = np.arange(len(owner)) + window <= ends  # window starts that stay in their document
    least = T.sliding(anchors, window - short + 1, np.minimum)
    return words, owner, inside[: len(least)], least


def _starts(least: np.ndarray, owner: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows, and which of them begin a run of one document with one anchor."""
    at = np.flatnonzero(inside)
    if not len(at):
        return at, at
    new = (least[at[1:]] != least[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
    return at, np.flatnonzero(np.append(True, new))


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(batch.column("head"))


def _number(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(name))


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, tag, sha, hs): the distinct anchors of each row with an id."""

    def step(batches):
        for batch, data, offsets in T.chunks(batches):
            _, owner, inside, least = _chunk(data, offsets, window)
            at, begin = _starts(least, owner, inside)
            doc, h = owner[at[begin]], least[at[begin]]
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else order
            ends = np.searchsorted(doc[new], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "tag", "sha")), pa.ListArray.from_arrays(pa.array(ends), pa.array(h[new].view(np.int64)))], names=["doc_id", "tag", "sha", "hs"])

    return docs.mapInArrow(step, ANCHORS)


def windows(rows: DataFrame, window: int) -> DataFrame:
    """(w1, w2, doc_id, tag, pos): digests of the windows whose anchor is among ``hs``."""

    def step(batches):
        for batch, data, offsets in T.chunks(b.filter(b.column("hs").is_valid()) for b in _heads(batches)):
            words, owner, inside, least = _chunk(data, offsets, window)
            hot = np.unique(np.asarray(batch.column("hs").flatten())).view(T.U64)
            hot.sort()
            at, begin = _starts(least, owner, inside)
            at = at[np.repeat(T.found(least[at[begin]], hot), np.diff(np.append(begin, len(at))))]
            doc = owner[at]
            raw, named = data.tobytes(), []
            bounds = np.append(np.flatnonzero(np.append(len(doc) > 0, doc[1:] != doc[:-1])), len(doc)).tolist() if len(doc) else []
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                i = int(doc[lo])
                own = raw[int(offsets[i]) : int(offsets[i + 1])].split()
                ends = (np.cumsum([len(w) + 1 for w in own]) - 1).tolist()
                plain, begins = b" ".join(own), [0, *(x + 1 for x in ends)]
                named += [T.digest(plain[begins[k] : ends[k + window - 1]]) for k in (at[lo:hi] - words.first[i]).tolist()]
            two = np.frombuffer(b"".join(named), np.int64).reshape(-1, 2)
            columns = [np.ascontiguousarray(two[:, 0]), np.ascontiguousarray(two[:, 1]), _number(batch, "doc_id")[doc], _number(batch, "tag")[doc], (at - words.first[doc]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["w1", "w2", "doc_id", "tag", "pos"])

    return rows.mapInArrow(step, WINDOWS)


def removal(docs: DataFrame, window: int, schema: pa.Schema, emit: Callable[[pa.RecordBatch, list[list[bytes]], list[np.ndarray]], pa.RecordBatch]) -> DataFrame:
    """Applies ``emit`` to the rows, their words and the masks of words to remove."""
    if window < 1:
        raise ValueError("a window has one word at least")
    key = ["doc_id", "tag"]
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).withColumn("tag", F.xxhash64("sha"))
    # packed and written, so that no text is read twice for what is counted and then asked
    every = kept(anchors(rows.filter("doc_id is not null"), window))
    first = every.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.first("tag").alias("tag")).select(*key).distinct()
    every = every.join(first, key).select(F.explode("hs").alias("h"), *key)
    shared = every.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("h")
    told = every.join(shared, "h").groupBy(*key).agg(F.collect_list("h").alias("hs"))
    # left joins, so that the texts are shuffled once for all uses
    rows = rows.drop("sha").join(first.withColumn("head", F.lit(True)), key, "left").withColumn("head", F.coalesce("head", F.lit(False)))
    named = windows(rows.join(told, key, "left"), window)
    least = named.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("w1", "w2", "first")
    gone = named.join(least, ["w1", "w2"]).filter("doc_id > first").groupBy(*key).agg(F.collect_list("pos").alias("gone"))

    def result(batches):
        for batch, data, offsets in T.chunks(batches):
            raw, ends = data.tobytes(), offsets.tolist()
            texts = [raw[a:b].split() for a, b in zip(ends, ends[1:], strict=False)]
            masks = []
            for words, head, at, no_id in zip(texts, batch.column("head").to_pylist(), batch.column("gone"), batch.column("doc_id").is_null().to_pylist(), strict=True):
                copy = not head and not no_id and len(words) >= window
                masks.append(np.ones(len(words), bool) if copy else T.cover(len(words), np.asarray(at.values) if at.is_valid else np.empty(0, np.int64), window))
            yield emit(batch, texts, masks)

    return rows.join(gone, key, "left").mapInArrow(result, from_arrow_schema(schema))


def _left(texts: list[list[bytes]], masks: list[np.ndarray]) -> list[bytes]:
    return [b" ".join([w for w, m in zip(t, k.tolist(), strict=True) if not m] if k.any() else t) for t, k in zip(texts, masks, strict=True)]


def _columns(batch: pa.RecordBatch, texts: list[list[bytes]], masks: list[np.ndarray]) -> list[pa.Array]:
    return [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([int(k.sum()) for k in masks], pa.int64())]


_COUNTS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64())]


def dedup_substrings(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, text): what is left of each text, joined by spaces."""
    schema = pa.schema([*_COUNTS, ("text", pa.string())])
    return removal(docs, window, schema, lambda batch, texts, masks: pa.RecordBatch.from_arrays([*_columns(batch, texts, masks), pa.array([x.decode() for x in _left(texts, masks)], pa.string())], schema=schema))


def digests(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), the digest of what ``dedup_substrings`` leaves."""
    schema = pa.schema([*_COUNTS, ("kept_sha256", pa.string())])
    return removal(docs, window, schema, lambda batch, texts, masks: pa.RecordBatch.from_arrays([*_columns(batch, texts, masks), pa.array([T.sha256(x) for x in _left(texts, masks)], pa.string())], schema=schema))
