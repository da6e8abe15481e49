"""Blocks of text and what they ask about: bounded two-way exchange of fingerprints.

Documents are dealt into *blocks* of about ``BLOCK_BYTES`` of text by a hash of the row,
its number included, so a hot source, copies and repeated rows spread evenly. A block asks about its
distinct 64-bit *names* (fingerprints), each with one value. A name that is
everywhere costs one entry per block, not one per occurrence, so no key is hot.

Few names travel as rows, counted by a window of Spark. Where names are as many as
words, rows of names would outgrow the text, so they travel in packed, sorted arrays to
*buckets* of the hash range; a bucket folds the values of equal names over all blocks
and answers each block in the order it asked. Buckets grow in number with the
names and not in size; there are never more packed rows than names.

All steps are deterministic functions of their input, and the answers match names,
not rows: a lost executor's tasks can simply run again.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._text import U64

#: Bytes of text in a block, and names that a bucket is laid out for.
BLOCK_BYTES = 8 << 20
BUCKET_NAMES = 1 << 21

ASK = "blk int, bucket int, kind int, names binary, vals binary"
ANSWER = pa.schema([("blk", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("names", pa.binary()), ("vals", pa.binary())])


def pack(values: np.ndarray) -> bytes:
    """Little-endian byte planes, without the leading ones that are all zero."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)
    top = int(values.max()) if len(values) else 0
    k = max(1, ceil(top.bit_length() / 8))
    return bytes([k]) + planes[:, :k].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    k = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(k, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :k] = planes.T
    return out.view(U64).ravel()


def layout(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[int, int]:
    """Blocks and bytes for the text of ``docs``."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(ceil(total / block_bytes), _least(docs)), total


def _least(table: DataFrame) -> int:
    return int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def buckets(table: DataFrame, names: float) -> int:
    """Buckets for so many names."""
    return max(_least(table), ceil(names / BUCKET_NAMES))


def in_blocks(docs: DataFrame, blocks: int, *more) -> DataFrame:
    """(blk, doc_id, text, ...)."""
    block = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    return docs.select(block.alias("blk"), "doc_id", "text", *more)


#: Names and counts of a block, as rows.
ASKED = "blk int, name long, n long"
COUNTS = pa.schema([("blk", pa.int32()), ("name", pa.int64()), ("n", pa.int64())])


def counts(blk: int, names: np.ndarray) -> pa.Table:
    """The block's distinct names, with how often it has them."""
    names, n = np.unique(names, return_counts=True)
    return pa.Table.from_arrays([pa.array(np.full(len(names), blk, np.int32)), pa.array(names.view(np.int64)), pa.array(n)], schema=COUNTS)


def repeated(asked: DataFrame) -> DataFrame:
    """(blk, name, total) of the names that occur twice at least; one shuffle."""
    return asked.select("blk", "name", F.sum("n").over(W.partitionBy("name")).alias("total")).filter("total > 1")


def distinct(names: np.ndarray, vals: np.ndarray, op: np.ufunc) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct names, and their values folded."""
    if not len(names):
        return names, vals
    order = np.argsort(names)
    names = names[order]
    at = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    return names[at], op.reduceat(vals[order], at)


def ask(blk: int, kind: int, names: np.ndarray, vals: np.ndarray, buckets: int) -> pa.Table:
    """A block's questions about sorted distinct names, a row per bucket that has some."""
    bucket = (((names >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)
    at = np.append(np.flatnonzero(np.append(len(names) > 0, bucket[1:] != bucket[:-1])), len(names)).tolist() if len(names) else [0]
    full, n = bucket[at[:-1]].tolist(), len(at) - 1
    packed = [rising(names[a:b]) for a, b in zip(at, at[1:], strict=False)]
    return pa.Table.from_arrays(
        [pa.array([blk] * n, pa.int32()), pa.array(full, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array(packed, pa.binary()), pa.array([pack(vals[a:b].view(U64)) for a, b in zip(at, at[1:], strict=False)], pa.binary())],
        schema=ANSWER,
    )


def rising(names: np.ndarray) -> bytes:
    """Packed sorted names."""
    return pack(np.concatenate([names[:1], np.diff(names)]))


def risen(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=U64)


def answers(asked: DataFrame, op: np.ufunc, finish: Callable[[np.ndarray, np.ndarray], tuple[bytes | None, bytes | None]]) -> DataFrame:
    """Folds equal names over all blocks; ``finish`` packs a block's answers."""

    def bucket(table: pa.Table) -> pa.Table:
        own = [risen(x.as_py()) for x in table.column("names")]
        sizes = np.cumsum([len(x) for x in own])[:-1]
        names = np.concatenate(own)
        vals = np.concatenate([unpack(x.as_py()) for x in table.column("vals")]).view(np.int64)
        order = np.argsort(names, kind="stable")
        names = names[order]
        first = np.concatenate([[True], names[1:] != names[:-1]])
        del names
        total = op.reduceat(vals[order], np.flatnonzero(first))
        vals[order] = total[np.cumsum(first) - 1]
        told = [finish(n, x) for n, x in zip(own, np.split(vals, sizes), strict=True)]
        return pa.Table.from_arrays([table.column("blk"), table.column("bucket"), table.column("kind"), *(pa.array([x[k] for x in told], pa.binary()) for k in (0, 1))], schema=ANSWER)

    return asked.groupBy("bucket", "kind").applyInArrow(bucket, ASK)


def repeated_bits(names: np.ndarray, total: np.ndarray) -> tuple[None, bytes]:
    """For each name, whether its folded count is two or more."""
    return None, len(total).to_bytes(4, "little") + np.packbits(total >= 2).tobytes()


def numbers(names: np.ndarray, total: np.ndarray) -> tuple[None, bytes]:
    """For each name, the folded value."""
    return None, pack(total.view(U64))


def answered(table: pa.Table, kind: int, bits: bool = False) -> np.ndarray:
    """A block's answers of a kind, in the order of its sorted names."""
    rows = sorted((b.as_py(), v.as_py()) for b, k, v in zip(table.column("bucket"), table.column("kind"), table.column("vals"), strict=True) if k.as_py() == kind)
    if bits:
        parts = [np.unpackbits(np.frombuffer(v, np.uint8, offset=4), count=int.from_bytes(v[:4], "little")).astype(bool) for _, v in rows]
        return np.concatenate(parts) if parts else np.empty(0, bool)
    return np.concatenate([unpack(v).view(np.int64) for _, v in rows]) if rows else np.empty(0, np.int64)
