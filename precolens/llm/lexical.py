"""Ranked lexical search with bags of documents deduplicated.

A document's score for an item depends only on how often it has each of the items' terms and on its
length class ``m``. So documents are restricted to the items' vocabulary, those with the same counts
and the same ``m`` are brought together (by a hash, then compared whole), every such class is scored
once, and the best classes are opened to their documents by ascending id.

Of a class an item needs no more documents than it ranks, and the best ``k`` classes by (score,
smallest id) hold its best ``k`` documents: each class before the one of such a document has a better
document itself. Both cuts are exact.

Items are the stated queries. They are taken in blocks of ``BLOCK_BYTES`` of text (one item at least),
so that the vocabulary that goes to the workers is bounded; every block meets all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precolens.llm.common import raw, ready, slices, stored
from precolens.session import durable

TOP = 10
BLOCK_BYTES = 4 << 20
# Scores of a matrix of classes and items; postings that a step expands.
_CELLS, _EXPANDED = 2 << 20, 4 << 20
# Bytes that belong to no term become spaces, A-Z become a-z.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)
_NO_ID = np.iinfo(np.int64).max
_EXACT = 1 << 53


def terms(text: bytes | None) -> list[bytes]:
    """The maximal runs of ASCII letters, digits and all other characters beyond ASCII; A-Z in lower case."""
    return (text or b"").translate(_FOLD).split()


def _width(largest: int) -> int:
    return 1 if largest < 1 << 8 else 2 if largest < 1 << 16 else 4 if largest < 1 << 32 else 8


def _bag(counts: Counter) -> bytes:
    """The terms' numbers in order and their counts; one bag has one form. A byte tells both widths."""
    ids, times = zip(*sorted(counts.items()), strict=True)
    a, b = _width(ids[-1]), _width(max(times))
    return bytes([a << 4 | b]) + np.array(ids, f"<u{a}").tobytes() + np.array(times, f"<u{b}").tobytes()


def _unbagged(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    a, b = bag[0] >> 4, bag[0] & 15
    n = (len(bag) - 1) // (a + b)
    return np.frombuffer(bag, f"<u{a}", n, 1).astype(np.int64), np.frombuffer(bag, f"<u{b}", n, 1 + a * n).astype(np.int64)


class Block:
    """Items by number with their vocabulary: which items have a term, and how often."""

    def __init__(self, texts: list[str]):
        counts = [Counter(terms(t.encode())) for t in texts]
        self.items = len(texts)
        self.vocabulary = sorted(set(chain.from_iterable(counts)))
        number = {t: i for i, t in enumerate(self.vocabulary)}
        rows = sorted((number[t], i, n) for i, c in enumerate(counts) for t, n in c.items())
        term, self.item, self.times = np.array(rows, np.int64).reshape(-1, 3).T
        self.start = np.searchsorted(term, np.arange(len(self.vocabulary) + 1))

    def weighed(self, weights: np.ndarray) -> None:
        """Take the terms' weights; scores beyond what doubles hold exactly are added as integers."""
        self.weights = weights
        most = np.zeros(self.items, np.float64)
        np.add.at(most, self.item, np.repeat(weights, np.diff(self.start)) * self.times * 1e6)
        self.exact = not len(most) or most.max() < _EXACT

    def scores(self, bags: list[bytes], m: np.ndarray) -> np.ndarray:
        """The matrix of scores, a row for each bag."""
        found = [_unbagged(b) for b in bags]
        sizes = np.array([len(ids) for ids, _ in found], np.int64)
        ids, tf = (np.concatenate(x) for x in zip(*found, strict=True))
        owner = np.repeat(np.arange(len(bags)), sizes)
        parts = self.weights[ids] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
        out = np.zeros(len(bags) * self.items, np.float64 if self.exact else np.int64)
        fan = self.start[ids + 1] - self.start[ids]
        ends = np.cumsum(fan)
        at = 0
        while at < len(ids):  # as many postings as a step may expand
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _EXPANDED, "right")))
            n = fan[at:upto]
            place = np.arange(int(n.sum())) + np.repeat(self.start[ids[at:upto]] - np.cumsum(n) + n, n)
            cell = np.repeat(owner[at:upto], n) * self.items + self.item[place]
            value = np.repeat(parts[at:upto], n) * self.times[place]
            if self.exact:
                out += np.bincount(cell, value, len(out))
            else:
                np.add.at(out, cell, value)
            at = upto
        return out.astype(np.int64).reshape(len(bags), self.items)


def _best(rows: np.ndarray, k: int) -> np.ndarray:
    """Of columns (item, score, smallest id, class) each item's ``k`` best, in order."""
    rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
    first = np.searchsorted(rows[0], rows[0])
    return rows[:, np.arange(rows.shape[1]) - first < k]


def _restricted(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, bag) of the rows of ``docs`` (doc_id, text); without a term of the items no bag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(vocabulary.value)}.get
        for batch in slices(batches, 1):
            sizes, bags = [], []
            for text in raw(batch.column(1)).to_pylist():
                words = terms(text)
                counts = Counter(map(number, words))
                counts.pop(None, None)
                sizes.append(len(words))
                bags.append(_bag(counts) if counts else None)
            columns = [pa.array(sizes, pa.int64()), pa.array(bags, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n", "bag"])

    return ready(docs).mapInArrow(run, "doc_id long, n long, bag binary")


def _document_counts(bags: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term; a task counts all its documents before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            found = [_unbagged(b)[0] for b in batch.column(0).to_pylist()]
            if found:
                counts += np.bincount(np.concatenate(found), minlength=size)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["term", "df"])

    rows = bags.select("bag").where("bag is not null").mapInArrow(run, "term long, df long")
    out = np.zeros(size, np.int64)
    for r in rows.groupBy("term").agg(F.sum("df").alias("df")).collect():  # the block's vocabulary at most
        out[r.term] = r.df
    return out


def _classes(bags: DataFrame, documents: int, length: int, k: int) -> DataFrame:
    """(class, m, bag, ids): documents with equal bags and ``m``, their ``k`` smallest ids in order.

    Tasks cut a class to ``k`` before the shuffle, so that a class of very many documents stays small.
    """
    m = F.lit(25) + F.expr(f"(cast(75 as decimal(20)) * cast(n as decimal(20)) * {documents}) div {length}")
    rows = bags.where("bag is not null").select("doc_id", "bag", m.cast("long").alias("m"))
    key = [F.xxhash64("bag", "m"), "m", "bag"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.asc_nulls_last("doc_id")))
    cut = rows.withColumn("nth", nth).where(F.col("nth") <= k)
    grouped = cut.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("nth", "doc_id"))).alias("ids"))
    return stored(grouped.select(F.monotonically_increasing_id().alias("class"), "m", "bag", "ids.doc_id"), "classes")


def _ranked(docs: DataFrame, texts: list[str], k: int) -> DataFrame:
    """(item, rank, doc_id, score) for items by their numbers in ``texts``."""
    spark, block = docs.sparkSession, Block(texts)
    size = len(block.vocabulary)
    bags = stored(_restricted(docs, spark.sparkContext.broadcast(block.vocabulary)), "bags", compression="zstd")
    documents, length = bags.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = _document_counts(bags, size)
    block.weighed(np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64))
    classes = _classes(bags, documents, max(length, 1), k)
    sent = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = sent.value, np.zeros((4, 0), np.int64)
        for batch in slices(batches, 2):
            step = max(1, _CELLS // block.items)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                name, m = (part.column(c).to_numpy() for c in (0, 1))
                first = part.column(3).fill_null(int(_NO_ID)).to_numpy()
                scores = block.scores(part.column(2).to_pylist(), m)
                full = np.zeros(block.items, np.int64)  # the score of an item's last rank, when it has so many
                last = np.flatnonzero(np.bincount(best[0], minlength=block.items) >= k)
                full[last] = best[1][np.searchsorted(best[0], last, "right") - 1]
                row, item = np.nonzero((scores > 0) & (scores >= full))
                best = _best(np.hstack([best, np.stack([item, scores[row, item], first[row], name[row]])]), k)
        columns = [pa.array(best[0]), pa.array(best[1]), pa.array(best[2], mask=best[2] == _NO_ID), pa.array(best[3])]
        yield pa.RecordBatch.from_arrays(columns, ["item", "score", "first", "class"])

    rows = classes.select("class", "m", "bag", F.col("doc_id")[0].alias("first"))
    found = rows.mapInArrow(run, "item long, score long, first long, class long")
    by_class = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("first"), "class")
    best = found.withColumn("nth", F.row_number().over(by_class)).where(F.col("nth") <= k)
    best = durable(best.select("item", "score", "class"))  # k rows for each item of the block
    members = best.join(classes.select("class", F.col("doc_id").alias("ids")), "class")
    members = members.select("item", "score", F.explode("ids").alias("doc_id"))
    by_doc = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return members.withColumn("rank", F.row_number().over(by_doc)).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[DataFrame]:
    """The distinct texts in blocks of about so many bytes; a longer text is a block of its own."""
    texts = durable(items.select("text").where("text is not null").distinct())
    size = F.octet_length("text").cast("long")
    total = texts.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    blocks = -(-total // block_bytes)
    while True:
        texts_in = texts.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(max(blocks, 1))))
        sizes = texts_in.groupBy("block").agg(F.sum(size).alias("bytes"), F.count("*").alias("n"))
        if sizes.where((F.col("bytes") > 2 * block_bytes) & (F.col("n") > 1)).isEmpty():
            break
        blocks *= 2
    for b in range(blocks):
        yield texts_in.where(F.col("block") == b).select("text")


def rank(
    docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): for every row of ``items`` the ``k`` rows of ``docs`` with the highest scores above 0.

    Equal scores rank by ascending doc_id, null ids last; rows that repeat an id rank each. Null and
    empty texts have no terms: such documents match nothing and such items have no rows. Items of
    equal texts get equal rows. Without documents or items there are no rows. Whole texts count, however
    long; other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    spark, found = docs.sparkSession, []
    for block in _blocks(items, block_bytes):
        # A block's texts: twice block_bytes at most, or one text.
        texts = [r.text for r in block.collect()]
        if not texts or not any(terms(t.encode()) for t in texts):
            continue
        numbers = spark.createDataFrame(list(enumerate(texts)), "item long, text string")
        found.append(_ranked(docs, texts, k).join(numbers, "item").drop("item"))
    if not found:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return items.join(reduce(DataFrame.unionAll, found), "text").select("item_id", "rank", "doc_id", "score")
