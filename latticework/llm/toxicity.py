"""Toxicity: a bag of subword embeddings, averaged into a linear softmax.

A text is the mean of the embeddings of its distinct character n-grams (bytes of lower-cased
words with their borders), hashed into buckets; a softmax over two classes sits on
top. Embeddings and softmax are trained jointly by gradient descent in numpy. An unseen
misspelling or a new ending shares n-grams with what was seen. As the model is
linear after the mean, scoring needs one weight for each bucket: the broadcast
model is 2**BITS floats, whatever the corpus.

The model is fitted on a bounded sample of labelled rows, the first by a hash of
their id: at most ``per_class`` toxic and twice as many others, of texts of at most ``most_bytes``
(whole, never cut). N-grams in fewer than ``least_texts`` texts of the sample say nothing about others and keep weight 0. Rows are scored on their whole text, a long one in pieces
between words; ids, languages and sources are no inputs.

Defined results: null and empty texts have no n-grams and get the score of the
intercept; without both classes among the labels every row gets their (smoothed)
rate; a labelled row without a document is no example;
repeated rows are scored each; rows with a null label, id or text are no examples, and among
labels of one id the toxic one counts; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from . import _text as T
from ._shared import bounded

SIZES, BITS, WIDTH = (3, 4, 5), 19, 8
PER_CLASS, MOST_BYTES, LEAST_TEXTS = 2000, 1 << 16, 3
#: Passes over the sample, and the steps that a small one gets at least.
EPOCHS, STEPS, BATCH, RATE, SCALE = 10, 150, 128, 2.0, 100.0
#: A mean counts so many neutral n-grams besides.
PRIOR = 100


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from training: one of five by crc32 of the id."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _places(plain: np.ndarray):
    """For each size, where n-grams without an inner gap begin in lower-cased bytes, and their buckets."""
    inside = T.ALNUM[plain]
    plain[~inside] = 32
    gaps = np.zeros(len(plain) + 1, np.int32)
    np.cumsum(~inside, dtype=np.int32, out=gaps[1:])
    sums, inverse = T.byte_sums(plain), T.powers(len(plain) + 1)[1]
    for size in SIZES:
        n = max(0, len(plain) - size + 1)
        at = np.flatnonzero(gaps[size - 1 : size - 1 + n] == gaps[1 : 1 + n])
        yield at, (((sums[size:] - sums[:n]) * inverse[:n])[at] >> T.U64(64 - BITS)).astype(np.int32)


def _ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each document, as buckets and the documents they are of."""
    bounds = offsets + np.arange(len(offsets))
    last, buckets, owners = np.empty(1 << BITS, np.int32), [], []
    for at, names in _places(np.insert(T._LOWER[data], offsets, 32)):
        place, ends = np.arange(len(names), dtype=np.int32), np.searchsorted(at, bounds).tolist()
        fresh = np.empty(len(names), bool)
        for lo, hi in zip(ends, ends[1:], strict=False):  # the last of equal n-grams stays
            own = names[lo:hi]
            last[own] = place[lo:hi]
            fresh[lo:hi] = last[own] == place[lo:hi]
        fresh[ends[-1] :] = False
        keep = np.flatnonzero(fresh)
        buckets.append(names[keep])
        owners.append(np.searchsorted(ends, keep, "right") - 1)
    return np.concatenate(buckets), np.concatenate(owners)


def _bags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each size, with memory of a piece where one text is long."""
    if len(data) <= 2 * T.CHUNK or len(offsets) > 2:
        return _ngrams(data, offsets)
    seen = np.zeros((len(SIZES), 1 << BITS), bool)
    for lo in range(0, len(data), T.CHUNK):
        plain = T._LOWER[data[lo : lo + T.CHUNK + max(SIZES)]]
        plain = np.concatenate([np.full(int(lo == 0), 32, np.uint8), plain, np.full(int(lo + T.CHUNK + max(SIZES) >= len(data)), 32, np.uint8)])
        for mark, (_, names) in zip(seen, _places(plain), strict=True):
            mark[names] = True
    found = np.concatenate([np.flatnonzero(mark) for mark in seen]).astype(np.int32)
    return found, np.zeros(len(found), np.int64)


def _sample(docs: DataFrame, labels: DataFrame, per_class: int, most_bytes: int) -> DataFrame:
    """(order, doc_id, toxic, text) of the rows to learn from, bounded by per_class and most_bytes."""
    usable = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = docs.select("doc_id", F.octet_length("text").alias("bytes")).filter(F.col("bytes") <= most_bytes).select("doc_id").distinct()
    usable = usable.join(short, "doc_id").select("doc_id", F.col("toxic").cast("long").alias("toxic"), F.xxhash64("doc_id").alias("order"))
    picked = [tuple(r) for c, n in ((0, 2 * per_class), (1, per_class)) for r in usable.filter(F.col("toxic") == c).orderBy("order", "doc_id").limit(n).collect()]
    wanted = docs.sparkSession.createDataFrame(picked, "doc_id long, toxic long, order long")
    rows = docs.select("doc_id", "text").filter(F.octet_length("text") <= most_bytes).join(F.broadcast(wanted), "doc_id")
    return rows.groupBy("order", "doc_id", "toxic").agg(F.min("text").alias("text"))


def model(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES, least_texts: int = LEAST_TEXTS) -> tuple[np.ndarray, float]:
    """The model, fitted by one task on the bounded sample."""
    schema = pa.schema([("weights", pa.binary()), ("bias", pa.float64())])

    def task(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("order", "ascending"), ("doc_id", "ascending")])
        weights, bias = fit(np.asarray(rows.column("toxic").combine_chunks()), rows.column("text").to_pylist(), least_texts)
        return pa.Table.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], schema=schema)

    found = _sample(docs, labels, per_class, most_bytes).groupBy().applyInArrow(task, from_arrow_schema(schema)).collect()
    if not found:
        return np.zeros(1 << BITS, np.float32), 0.0
    return np.frombuffer(found[0].weights, np.float32), found[0].bias


def fit(y: np.ndarray, texts: list[str], least_texts: int = LEAST_TEXTS) -> tuple[np.ndarray, float]:
    """Weight of each bucket and intercept, for the log odds of class 1."""
    if len(set(y.tolist())) < 2:
        ones = int(y.sum())
        return np.zeros(1 << BITS, np.float32), float(np.log((ones + 1) / (len(y) - ones + 1)))
    bags = []
    for text in texts:
        data, offsets = T.text_buffer(pa.array([text], pa.large_string()))
        bags.append(_ngrams(data, offsets)[0])
    shares = np.array([SCALE / (PRIOR + len(b)) for b in bags], np.float32)
    random = np.random.default_rng(7)
    often = np.zeros(1 << BITS, np.int32)
    for b in bags:
        np.add.at(often, b, 1)
    often = often >= least_texts
    used = np.flatnonzero(often)  # what is too rare to generalise keeps weight 0
    number = np.cumsum(often, dtype=np.int32) - 1
    bags = [number[b[often[b]]] for b in bags]
    starts = np.append(0, np.cumsum([len(b) for b in bags]))
    place = np.concatenate(bags)
    del bags
    embedding = (random.standard_normal((len(used), WIDTH)) * 0.01).astype(np.float32)
    softmax = (random.standard_normal((WIDTH, 2)) * 0.3).astype(np.float32)
    bias = np.zeros(2, np.float32)
    speed = [np.zeros_like(p) for p in (embedding, softmax, bias)]
    epochs = max(EPOCHS, -(-STEPS // -(-len(y) // BATCH)))
    steps, step = epochs * -(-len(y) // BATCH), 0
    for _ in range(epochs):
        order = random.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            rows = np.sort(order[lo : lo + BATCH])
            size = starts[rows + 1] - starts[rows]
            first = np.append(0, np.cumsum(size))
            at = np.arange(first[-1]) + np.repeat(starts[rows] - first[:-1], size)
            ids, share = place[at], np.repeat(shares[rows], size)
            full = np.flatnonzero(size)
            mean = np.zeros((len(rows), WIDTH), np.float32)
            if len(full):
                mean[full] = np.add.reduceat(embedding[ids] * share[:, None], first[full], axis=0)
            logits = mean @ softmax + bias
            logits -= logits.max(axis=1, keepdims=True)
            odds = np.exp(logits)
            odds /= odds.sum(axis=1, keepdims=True)
            odds[np.arange(len(rows)), y[rows]] -= 1
            odds /= len(rows)
            back = np.repeat(odds @ softmax.T, size, axis=0) * share[:, None]
            grads = [np.stack([np.bincount(ids, back[:, k], len(used)) for k in range(WIDTH)], 1).astype(np.float32), mean.T @ odds, odds.sum(axis=0)]
            rate = RATE * (1 - step / steps)
            step += 1
            for p, g, v, r in zip((embedding, softmax, bias), grads, speed, (rate, rate / 100, rate / 100), strict=True):
                v *= 0.9
                v -= g
                p += r * v
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = SCALE * (embedding @ (softmax[:, 1] - softmax[:, 0]))
    return weights, float(bias[1] - bias[0])


def score(docs: DataFrame, fitted: tuple[np.ndarray, float], schema: pa.Schema, emit) -> DataFrame:
    """Applies ``emit`` to rows and the scores of their texts."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def step(batches):
        weights, bias = shared.value
        for batch, data, offsets in T.chunks(batches):
            buckets, owner = _bags(data, offsets)
            total = np.bincount(owner, weights[buckets], batch.num_rows)
            mean = total / (PRIOR + np.bincount(owner, minlength=batch.num_rows))
            yield emit(batch, 1 / (1 + np.exp(-np.clip(mean + bias, -500, 500))))

    return bounded(docs).mapInArrow(step, from_arrow_schema(schema))


def scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def emit(batch, odds):
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(odds), pa.array((odds >= 0.5).astype(np.int32))], schema=schema)

    return score(docs.select("doc_id", "text", held_out().alias("held_out")), model(docs, labels, per_class, most_bytes, least_texts), schema, emit)


def clean(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """``docs`` without the rows predicted toxic."""
    schema = to_arrow_schema(docs.schema)
    return score(docs, model(docs, labels, per_class, most_bytes, least_texts), schema, lambda batch, odds: batch.filter(pa.array(odds < 0.5)).cast(schema))
