"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word has a sparse random index vector. A word's vector is the sum, over all its places in all
documents, of the index vectors of the words around it, turned by where they stand. Words share
``BUCKETS`` buckets by a hash, so that the table of vectors has a fixed size and every word of every
document counts, at any size of the corpus. Sums are of whole numbers: they don't depend on order.

A document is the mean of its words' vectors. A network of two layers, fitted in numpy on a bounded
sample of labelled documents, scores it; a temperature, fitted on a part of the sample that the
weights have not seen, calibrates the probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precolens.llm.common import free_name, kept, raw, ready, slices
from precolens.session import durable

# Rows of the table, its width, and the places of an index vector that are not zero.
BUCKETS, WIDTH, FILLED = 1 << 14, 64, 4
# How far around a word others count for its vector.
REACH = 2
SAMPLE_ROWS = 20_000
# The network: units of the inner layer, passes over the sample, its share for the temperature.
HIDDEN, PASSES, BATCH, RATE, DECAY, CALIBRATION = 32, 60, 128, 3e-3, 1e-4, 0.2
_WORD = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^\sA-Za-z0-9\x80-\xff]+|\n")
_CACHED, _STEP = 400_000, 1 << 16
# The bucket of the mark after a word that is equal to one of the two before it.
_AGAIN = 0


class _Buckets(dict):
    """The buckets of words asked for before; emptied when there are ``_CACHED``."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED:
            self.clear()
        found = self[word] = 1 + xxhash.xxh64_intdigest(word) % (BUCKETS - 1)
        return found


class Words:
    """The words of a text by their buckets."""

    def __init__(self):
        self.bucket = _Buckets().__getitem__

    def numbers(self, text: bytes | None) -> np.ndarray:
        """Runs of letters and digits, runs of other signs and line ends; marks where words repeat."""
        x = np.fromiter(map(self.bucket, _WORD.findall(text or b"")), np.int64)
        again = np.zeros(len(x), bool)
        for back in (1, 2):
            again[back:] |= x[back:] == x[:-back]
        return np.insert(x, np.flatnonzero(again) + 1, _AGAIN)


def index_vectors(seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the places of its index vector that are not zero, and their signs."""
    rng = np.random.default_rng(seed)
    place = np.argsort(rng.random((BUCKETS, WIDTH)), axis=1)[:, :FILLED]
    return place.astype(np.uint8), rng.choice(np.array([-1, 1], np.int8), (BUCKETS, FILLED))


def contexts(texts: list[np.ndarray], place: np.ndarray, sign: np.ndarray, into: np.ndarray) -> None:
    """Add the index vectors around every word to its bucket's row of ``into``; the last column counts places."""
    words = np.concatenate(texts)
    for at in range(0, len(words), _STEP):
        into[:, WIDTH] += np.bincount(words[at : at + _STEP], minlength=BUCKETS)
    for away in range(1, REACH + 1):
        some = [t for t in texts if len(t) > away]
        if not some:
            continue
        left, right = np.concatenate([t[:-away] for t in some]), np.concatenate([t[away:] for t in some])
        for word, other, turn in ((left, right, away), (right, left, WIDTH - away)):
            for at in range(0, len(word), _STEP):
                w, o = word[at : at + _STEP], other[at : at + _STEP]
                cell = w[:, None] * WIDTH + (place[o].astype(np.int64) + turn) % WIDTH
                sums = np.bincount(cell.ravel(), sign[o].ravel(), BUCKETS * WIDTH)
                into[:, :WIDTH] += sums.reshape(BUCKETS, WIDTH).astype(np.int64)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The table of vectors over all documents, a row of length 1 for each bucket with words.

    What all words have in common, their mean by count, is taken away. Null texts have no words.
    """
    index = docs.sparkSession.sparkContext.broadcast(index_vectors())
    names = [*(f"d{i}" for i in range(WIDTH)), "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums = kept("words", Words), np.zeros((BUCKETS, WIDTH + 1), np.int64)
        for batch in slices(batches, 0):
            texts = [words.numbers(t) for t in raw(batch.column(0)).to_pylist()]
            if texts:
                contexts(texts, *index.value, sums)
        used = np.flatnonzero(sums[:, WIDTH])
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(c) for c in sums[used].T)], ["bucket", *names])

    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = ready(texts).mapInArrow(run, ", ".join(f"{n} long" for n in ["bucket", *names]))
    table = np.zeros((BUCKETS, WIDTH + 1))
    for r in rows.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).collect():  # BUCKETS rows at most
        table[r[0]] = r[1:]
    places = table[:, WIDTH:]
    vectors = _unit(table[:, :WIDTH])
    vectors -= (places * vectors).sum(axis=0) / max(places.sum(), 1)
    return (_unit(vectors) * (places > 0)).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def pooled(words: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The mean vector of a text's words; zeros without any."""
    total = np.zeros(WIDTH)
    for at in range(0, len(words), _STEP):
        total += vectors[words[at : at + _STEP]].sum(axis=0, dtype=np.float64)
    return total / max(len(words), 1)


class Network(NamedTuple):
    """Centre and scale of the inputs, the weights of both layers, and the temperature."""

    centre: np.ndarray
    scale: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: np.ndarray
    temperature: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.centre) / self.scale @ self.inner + self.inner_bias, 0)
        return hidden @ self.outer + self.outer_bias[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x) / self.temperature, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 1) -> Network:
    """A network for the probability of y = 1. Without rows of both kinds it gives everything the smoothed share of y."""
    share = (y.sum() + 1) / (len(y) + 2)
    rng, n = np.random.default_rng(seed), x.shape[1]
    centre, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(n), np.ones(n))
    if len(np.unique(y)) < 2:
        base = np.array([np.log(share / (1 - share))])
        return Network(centre, scale, np.zeros((n, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), base, 1.0)
    mixed = rng.permutation(len(y))
    apart, used = np.split(mixed, [int(CALIBRATION * len(y))])
    if len(np.unique(y[used])) < 2:
        apart, used = mixed, mixed
    weights = [rng.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    mean, square, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    inputs = (x - centre) / scale
    for _ in range(PASSES):
        order = rng.permutation(used)
        for at in range(0, len(order), BATCH):
            rows, step = order[at : at + BATCH], step + 1
            hidden = np.maximum(inputs[rows] @ weights[0] + weights[1], 0)
            slope = (1 / (1 + np.exp(-(hidden @ weights[2] + weights[3][0]))) - y[rows]) / len(rows)
            back = np.outer(slope, weights[2]) * (hidden > 0)
            slopes = [inputs[rows].T @ back + DECAY * weights[0], back.sum(axis=0), hidden.T @ slope + DECAY * weights[2], slope.sum(keepdims=True)]
            for w, m, s, g in zip(weights, mean, square, slopes, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    network = Network(centre, scale, *weights, 1.0)
    return network._replace(temperature=_temperature(network.margin(x[apart]), y[apart]))


def _temperature(margin: np.ndarray, y: np.ndarray) -> float:
    """Of temperatures from a quarter to eight, the one that makes the labels likeliest."""
    found = np.geomspace(0.25, 8, 161)
    loss = [np.logaddexp(0, np.where(y == 1, -1, 1) * margin / t).mean() for t in found] if len(y) else [0]
    return float(found[int(np.argmin(loss))]) if len(y) else 1.0


def _pooled_rows(rows: DataFrame, columns: list[str], vectors) -> DataFrame:
    """``columns`` of ``rows``, whose last column is a text, and array<double> pooled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table = kept("words", Words), vectors.value
        for batch in slices(batches, len(columns)):
            means = [pooled(words.numbers(t), table).tolist() for t in raw(batch.column(len(columns))).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(means, pa.list_(pa.float64()))], [*columns, "pooled"])

    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes[:-1])
    return ready(rows).mapInArrow(run, f"{fields}, pooled array<double>")


def train(
    docs: DataFrame, labels: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", sample_rows: int = SAMPLE_ROWS,
) -> Network:
    """A network fitted on at most ``sample_rows`` labelled documents, those with the smallest hashes of (id, label, text).

    Labels without an id, a value or a document are not used. A document labelled twice counts twice; rows
    that repeat an id count each. Without labels, or with one kind, see :func:`fit`.
    """
    key = ["_hash", "_id", "_label", "_print"]
    named = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label"))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_body"))
    # Copies of a label and of a document are counted before they meet.
    named = named.where("_id is not null and _label is not null").groupBy("_id", "_label").agg(F.count("*").alias("_n"))
    hashes = texts.groupBy("_id", F.xxhash64("_body").alias("_print")).agg(F.count("*").alias("_m"))
    counted = named.join(hashes, "_id").select("_id", "_label", "_print", (F.col("_n") * F.col("_m")).alias("_times"))
    order = counted.withColumn("_hash", F.xxhash64("_id", "_label", "_print")).orderBy(*key).limit(sample_rows)
    picked = durable(order)  # sample_rows rows of numbers at most
    bodies = texts.withColumn("_print", F.xxhash64("_body")).join(F.broadcast(picked), ["_id", "_print"])
    bodies = bodies.select("_hash", "_id", "_label", "_times", "_print", "_body").dropDuplicates(key)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)
    rows = sorted(_pooled_rows(bodies, ["_hash", "_id", "_label", "_times", "_print"], sent).collect())
    rows = [r for r in rows for _ in range(min(r._times, sample_rows))][:sample_rows]
    x = np.array([r.pooled for r in rows], float).reshape(len(rows), WIDTH)
    return fit(x, np.array([r._label == 1 for r in rows], float))


def score(docs: DataFrame, network: Network, vectors: np.ndarray, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` and a double ``out``: the probability that a text's label is 1, for every row.

    Null and empty texts have no words and are scored by their zero vector. The column's name is
    lengthened if ``docs`` has it; rows and other columns stay as they are. No rows give no rows.
    """
    name, text = free_name(docs, out), docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast((network, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (network, table) = kept("words", Words), sent.value
        for batch in slices(batches, text):
            means = [pooled(words.numbers(t), table) for t in raw(batch.column(text)).to_pylist()]
            found = network.probability(np.array(means).reshape(len(means), WIDTH))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, name])

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return ready(docs).mapInArrow(run, f"{fields}, `{name}` double")
