"""Quality rules: gradient-boosted trees over document statistics, scored as numpy node arrays.

Statistics come from whole texts, one document at a time. The trees are fitted on a bounded sample of
labelled documents; some features are held monotonic, so that more symbols, more equal lines or more
repeated words can never raise a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precolens.llm.common import free_name, raw, ready, slices
from precolens.session import durable

# Labelled rows that the trees are fitted on, at most; those with the smallest hash of the id.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST_WEIGHT, SMOOTHING = 60, 4, 64, 0.2, 1.0, 1.0
# A document goes when its estimated probability of good quality is below this.
LEAST_QUALITY = 0.5
# Fixed values of the base rules.
SYMBOLS, LEAST_WORDS, MOST_REPEATED = b"#*$%&|<>", 50, 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Feature -> direction in which the score may move as it grows (0: either).
FEATURES = {
    "words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "lines": 0,
    "distinct_share": 0, "top_word_share": -1, "upper_share": 0, "digit_share": 0, "punctuation_share": 0,
    "bar_share": 0, "bang_share": 0, "non_ascii_share": 0, "longest_word": 0, "words_per_line": 0,
}

_SPACE = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)
_SYMBOL = np.frombuffer(SYMBOLS, np.uint8)
_PUNCTUATION = np.frombuffer(b"!\"'(),-./:;?@[\\]^_`{}~+=", np.uint8)


def _repeated(ids: np.ndarray, distinct: int) -> int:
    """Words inside 3-word windows that occur at least twice."""
    if len(ids) < 4:
        return 0
    pairs = ids[:-1] * distinct + ids[1:]
    if distinct > 1_000_000:  # keeps the codes of triples within 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, place, counts = np.unique(pairs[:-1] * distinct + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[place] > 1
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum())


def statistics(text: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The counts of ``COUNTS`` and the features of ``FEATURES`` of a whole text."""
    words = text.split()
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    n = len(words)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(seen.sum() - seen[0x80:0xC0].sum() - seen[_SPACE].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeated = _repeated(ids, len(known))
    symbols = int(seen[_SYMBOL].sum())
    per_char, per_word = 1 / max(chars, 1), 1 / max(n, 1)
    features = (
        n, chars * per_word, symbols * per_char, dup_lines / max(len(lines), 1), repeated * per_word, len(lines),
        len(known) * per_word, (int(np.bincount(ids).max()) if n else 0) * per_word, seen[65:91].sum() * per_char,
        seen[48:58].sum() * per_char, seen[_PUNCTUATION].sum() * per_char, seen[124] * per_char, seen[33] * per_char,
        seen[0xC0:].sum() * per_char, max(map(len, known), default=0), n / max(len(lines), 1),
    )
    return (n, chars, symbols, dup_lines, repeated), tuple(map(float, features))


class Trees(NamedTuple):
    """All trees in shared node arrays; a leaf has feature -1 and itself as both children."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        """The estimated probability of good quality for each row of features."""
        out = np.full(len(x), self.base)
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            row = np.arange(len(part))[:, None]
            node = np.repeat(self.roots[None, :], len(part), axis=0)
            for _ in range(DEPTH):
                low = part[row, self.feature[node]] <= self.threshold[node]
                node = np.where(low, self.left[node], self.right[node])
            out[at : at + 4096] += self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, monotonic: tuple[int, ...] = tuple(FEATURES.values())) -> Trees:
    """Boosted trees for the log-odds of y = 1, by histogram splits that keep the given directions.

    Without rows of both kinds there are no trees: every document gets the smoothed share of y.
    """
    share = (y.sum() + 1) / (len(y) + 1) if len(y) else 1 - 1e-9
    base = float(np.log(share / max(1 - share, 1e-9)))
    empty = np.zeros(0, np.int64)
    if len(np.unique(y)) < 2:
        return Trees(empty, empty, np.zeros(0), empty, empty, np.zeros(0), base)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = [np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)]
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots, margin = [], np.full(len(y), base)

    def grow(rows, gradient, weight, depth, low, high) -> int:
        g, w = gradient[rows].sum(), weight[rows].sum()
        leaf = float(np.clip(g / (w + SMOOTHING), low, high))
        at = len(nodes)
        nodes.append([-1, np.inf, at, at, RATE * leaf])
        best = None
        for f, e in enumerate(edges) if depth else ():
            if not len(e):
                continue
            gs = np.cumsum(np.bincount(binned[f][rows], gradient[rows], len(e) + 1))[:-1]
            ws = np.cumsum(np.bincount(binned[f][rows], weight[rows], len(e) + 1))[:-1]
            left = np.clip(gs / (ws + SMOOTHING), low, high)
            right = np.clip((g - gs) / (w - ws + SMOOTHING), low, high)
            gain = (
                2 * left * gs - left**2 * (ws + SMOOTHING)
                + 2 * right * (g - gs) - right**2 * (w - ws + SMOOTHING)
                - 2 * leaf * g + leaf**2 * (w + SMOOTHING)
            )
            allowed = (ws >= LEAST_WEIGHT) & (w - ws >= LEAST_WEIGHT) & ((right - left) * monotonic[f] >= 0)
            gain = np.where(allowed, gain, 0)
            cut = int(gain.argmax())
            if gain[cut] > (best[0] if best else 1e-6):
                best = (gain[cut], f, cut, left[cut], right[cut])
        if best:
            _, f, cut, left, right = best
            goes = binned[f][rows] <= cut
            middle = (left + right) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}
            (a, b), (c, d) = bounds[monotonic[f]]
            nodes[at][:2] = f, float(edges[f][cut])
            nodes[at][2] = grow(rows[goes], gradient, weight, depth - 1, a, b)
            nodes[at][3] = grow(rows[~goes], gradient, weight, depth - 1, c, d)
        else:
            margin[rows] += RATE * leaf
        return at

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), y - p, np.maximum(p * (1 - p), 1e-6), DEPTH, -np.inf, np.inf))
    feature, threshold, left, right, value = zip(*nodes, strict=True)
    return Trees(
        np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), base
    )


def _features(docs: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    """``columns`` of ``docs`` and array<double> features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(columns)):
            rows = [statistics(t or b"")[1] for t in raw(batch.column(len(columns))).to_pylist()]
            kept = [batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, pa.list_(pa.float64()))], [*columns, "features"])

    rows = docs.select(*columns, F.col(text_col).cast("string").alias("_text"))
    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes[:-1])
    return ready(rows).mapInArrow(run, f"{fields}, features array<double>")


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> Trees:
    """Trees fitted on at most ``sample_rows`` labelled documents.

    Labels without an id, a value or a document are not used and take no place in the sample. A document
    labelled twice counts twice, an id that several rows share once for each. The sample takes the labels
    whose ids have the smallest hashes, and of their documents as many again, so it doesn't depend on row order.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_body"))
    texts = texts.withColumn("_hash", F.xxhash64("_body"))
    order = [F.xxhash64("_id"), "_id", "_label"]
    sample = (
        labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label"))
        .where("_id is not null and _label is not null")
        .join(texts.select("_id"), "_id", "left_semi")
        .orderBy(*order)
        .limit(sample_rows)
    )
    # At most sample_rows rows of two or three numbers; equal documents are computed once.
    picked = texts.select("_id", "_hash").join(F.broadcast(sample), "_id").orderBy(*order, "_hash").limit(sample_rows)
    picked = durable(picked.groupBy("_id", "_label", "_hash").agg(F.count("*").alias("_times")))
    labelled = texts.join(F.broadcast(picked), ["_id", "_hash"]).dropDuplicates(["_id", "_hash", "_label"])
    rows = sorted(_features(labelled, ["_id", "_label", "_times"], "_body").collect(), key=lambda r: (r._id, r._label, r.features))
    rows = [r for r in rows for _ in range(r._times)]
    x = np.array([r.features for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r._label for r in rows], float))


def judge(docs: DataFrame, trees: Trees, text_col: str = "text", out: str = "quality_rules") -> DataFrame:
    """``docs`` and a struct ``out``: the counts, base_failed, probability and kept of every row.

    The struct's name is lengthened if ``docs`` has it. A null or empty text has no words and fails
    the base rules. All columns, repeated rows and null ids stay as they are.
    """
    name = free_name(docs, out)
    arrow = pa.struct(
        [*((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()), ("probability", pa.float64()), ("kept", pa.bool_())]
    )
    kind = ", ".join([*(f"{c}: bigint" for c in COUNTS), "base_failed: boolean", "probability: double", "kept: boolean"])
    text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = [statistics(t or b"") for t in raw(batch.column(text)).to_pylist()]
            counts = np.array([c for c, _ in found], np.int64).reshape(len(found), len(COUNTS))
            p = trees.probability(np.array([f for _, f in found]).reshape(len(found), len(FEATURES)))
            failed = (counts[:, 0] < LEAST_WORDS) | (counts[:, 4] > MOST_REPEATED * counts[:, 0])
            kept = ~failed & (p >= LEAST_QUALITY)
            columns = [*counts.T, failed, p, kept]
            verdict = pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(arrow))
            yield pa.RecordBatch.from_arrays([*batch.columns, verdict], [*batch.schema.names, name])

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return ready(docs).mapInArrow(run, f"{fields}, {name} struct<{kind}>")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged."""
    found = judge(docs, train(docs, labels, id_col, text_col), text_col)
    verdict = found.columns[-1]
    return found.where(F.col(f"{verdict}.kept")).drop(verdict)
