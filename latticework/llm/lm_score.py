"""LM scoring: stupid-backoff scores from n-gram counts of the whole corpus.

Relational form: count tables of all orders, partitioned by n-gram hash, are
joined to the exploded n-grams of each document and summed per document. The
relations travel packed: each block of documents posts its distinct n-grams once,
with their counts, to the hash partition that holds their part of the tables, and
gets the corpus counts back; so a frequent n-gram costs an entry per block, and
nothing is a row per token. The tables grow with the corpus and are never
collected or broadcast. Words and pairs are asked about first; a longer n-gram
only if both shorter ones inside it occur twice in the corpus, without which it
can't occur in another document.

A document is scored against all *other* documents: its own counts are taken off
(else no n-gram would be unseen). For w_i with up to ``order - 1`` words before
it, S = c(w_{i-k}..w_i) / c(w_{i-k}..w_{i-1}) for the longest k seen, times
``alpha`` for each order given up; the empty context has all other tokens, and a
word unseen elsewhere scores 1 / (that number + 1) at the lowest order.

Words are ``[^\\x20\\x09-\\x0D]+`` in lower case (A-Z). Defined results: a null or
empty text has no tokens, log_score 0 and null mean; repeated rows count as
other documents; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_schema

from . import _blocks as B
from . import _text as T
from ._shared import bounded

RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_backoff", pa.int64()), ("log_score", pa.float64()), ("mean_log_score", pa.float64())])


#: The name under which blocks post how many tokens they have; the last of all.
TOTAL = T.U64((1 << 64) - 1)


def _grams(words: T.Words, order: int) -> list[np.ndarray]:
    """For each order n, the fingerprint of the n words up to each position; 0 across a document's start."""
    place = np.arange(len(words.hash)) - words.first[:-1][T.lengths_to_owner(words.counts)]
    out, so_far = [], words.hash
    for n in range(1, order + 1):
        if n > 1:
            so_far = np.concatenate([np.zeros(1, T.U64), so_far[:-1]])[: len(words.hash)]
            so_far = T.mix(so_far * T.U64(0x9E3779B97F4A7C15) + words.hash + T.U64(n))
        out.append(np.where(place >= n - 1, np.clip(so_far, T.U64(1), TOTAL - T.U64(1)), T.U64(0)))
    return out


class _Block:
    """The n-grams of a block's documents, and what the corpus has of them."""

    def __init__(self, table: pa.Table, order: int):
        grams, ids, counts = [], [], []
        for batch, data, offsets in T.chunks(table.combine_chunks().to_batches()):
            words = T.Words(data, offsets, T.SPACE_SPLIT, lower=True)
            grams.append(_grams(words, order))
            ids.append(batch.column("doc_id").cast(pa.int64()))
            counts.append(words.counts)
        self.names = [np.concatenate([x[n] for x in grams]) for n in range(order)]
        self.ids, self.counts = pa.concat_arrays(ids), np.concatenate(counts)
        self.twice: list[np.ndarray] = []  # by order and position: in the corpus twice at least

    def possible(self, n: int) -> np.ndarray:
        """Positions of the n-grams that are asked about."""
        if n < 2:
            return np.flatnonzero(self.names[n])
        often = self.twice[n - 1]
        return np.flatnonzero((self.names[n] > 0) & often & np.append(False, often[:-1])[: len(often)])

    def ranked(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions sorted by n-gram, then position; and where each n-gram begins among them."""
        at = self.possible(n)
        name = self.names[n][at]
        order = np.argsort(name, kind="stable")
        name = name[order]
        return at[order], np.flatnonzero(np.append(len(name) > 0, name[1:] != name[:-1])) if len(name) else np.empty(0, np.int64)

    def spread(self, n: int, values: np.ndarray) -> np.ndarray:
        """Values of the distinct n-grams, by position; 0 elsewhere."""
        at, first = self.ranked(n)
        out = np.zeros(len(self.names[n]), values.dtype)
        out[at] = np.repeat(values, np.diff(np.append(first, len(at))))
        return out

    def ask(self, blk: int, n: int, buckets: int) -> pa.Table:
        names, counts = _counted(self.names[n][self.possible(n)])
        if n == 0:
            names, counts = np.append(names, TOTAL), np.append(counts, self.counts.sum())
        return B.ask(blk, n, names, counts, buckets)


def scores(docs: DataFrame, order: int = 3, alpha: float = 0.4) -> DataFrame:
    """(doc_id, n_tokens, n_backoff, log_score, mean_log_score) for each row."""
    blocks, total = B.layout(bounded(docs))
    buckets = B.buckets(docs, 0.1 * order * total)
    text = B.in_blocks(docs, blocks).groupBy("blk")

    def first(table: pa.Table) -> pa.Table:
        block, blk = _Block(table, min(order, 2)), table.column("blk")[0].as_py()
        return pa.concat_tables([block.ask(blk, n, buckets) for n in range(min(order, 2))])

    def further(n: int):
        def ask(table: pa.Table, told: pa.Table) -> pa.Table:
            if not table.num_rows:
                return B.ANSWER.empty_table()
            block = _Block(table, n + 1)
            block.twice.append(np.empty(0, bool))
            for k in range(1, n):
                block.twice.append(block.spread(k, B.answered(told, k, bits=True)))
            return block.ask(table.column("blk")[0].as_py(), n, buckets)

        return ask

    def score(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return RESULT.empty_table()
        block = _Block(table, order)
        counts, owner = block.counts, T.lengths_to_owner(block.counts)
        other, tokens = [], 0  # counts in all other documents, of the n-gram that ends at each position
        for n in range(order):
            corpus = B.answered(told, n)
            if n == 0:
                corpus, tokens = corpus[:-1], int(corpus[-1])
            at, begin = block.ranked(n)
            every = np.repeat(corpus, np.diff(np.append(begin, len(at))))
            # the positions of an n-gram are in order, so those in one document are neighbours
            new = np.append(len(at) > 0, owner[at[1:]] != owner[at[:-1]]) if len(at) else np.empty(0, bool)
            new[begin] = True
            size = np.diff(np.append(np.flatnonzero(new), len(at)))
            left, often = np.zeros(len(owner)), np.zeros(len(owner), bool)
            left[at] = every - np.repeat(size, size)
            often[at] = every >= 2
            other.append(left)
            block.twice.append(often)
        rest = tokens - counts[owner].astype(float)
        value = np.where(other[0] > 0, other[0] / np.maximum(rest, 1), 1 / (rest + 1))
        depth = np.zeros(len(owner), np.int64)  # orders seen, beyond the first
        for n in range(1, order):
            here = np.flatnonzero(other[n] > 0)
            value[here] = other[n][here] / other[n - 1][here - 1]
            depth[here] = n
        place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        lost = np.minimum(place, order - 1) - depth
        logs = np.log(value) + np.log(alpha) * lost
        ends = np.append(0, np.cumsum(counts))
        sums = np.array([float(np.sum(logs[a:b])) for a, b in zip(ends, ends[1:], strict=False)])
        back = np.diff(np.append(0, np.cumsum(lost > 0))[ends])
        mean = pa.array(sums / np.maximum(counts, 1), mask=counts == 0)
        return pa.Table.from_arrays([block.ids, pa.array(counts.astype(np.int64)), pa.array(back.astype(np.int64)), pa.array(sums), mean], schema=RESULT)

    asked = [text.applyInArrow(first, B.ASK)]
    told, bits = B.answers(asked[0], np.add, B.numbers), B.answers(asked[0], np.add, B.repeated_bits)
    for n in range(2, order):
        asked.append(text.cogroup(bits.groupBy("blk")).applyInArrow(further(n), B.ASK))
        told = told.unionByName(B.answers(asked[-1], np.add, B.numbers))
        bits = bits.unionByName(B.answers(asked[-1], np.add, B.repeated_bits))
    return text.cogroup(told.groupBy("blk")).applyInArrow(score, from_arrow_schema(RESULT))


def _counted(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names = np.sort(names)
    if not len(names):
        return names, np.empty(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    return names[at], np.diff(np.append(at, len(names)))
