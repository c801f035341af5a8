"""SimHash near-duplicates, found by meeting in the middle of Hamming balls.

Two fingerprints that differ in at most ``radius`` bits share a variant within ``radius / 2`` bits of
either. Every distinct fingerprint emits the variants in its half ball, equal variants meet in one
shuffle, and each group is linked as a star. A group holds at most as many fingerprints as a half
ball has points (65 for radius 2), however many documents there are: copies collapse before.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precolens.llm.common import free_name, raw, ready, slices
from precolens.session import durable

SEED = 42
SHINGLE = 3
RADIUS = 2
_STEP = 1 << 16


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of every shingle of ``size`` words, repeats included; fewer words make one shingle, none make none."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return [xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :], strict=False)]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The bits set in over half of the shingles' hashes; zero without words."""
    hashes = np.array(shingle_hashes(text, size), "<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _STEP):
        bits = np.unpackbits(hashes[i : i + _STEP].view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; fp holds the fingerprint's 64 bits as a signed long.

    A null text has no words. Rows keep null ids. Words are cut at ASCII white space and A-Z lowered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = [fingerprint(t or b"", size) for t in raw(batch.column(1)).to_pylist()]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return ready(rows).mapInArrow(run, "doc_id long, fp long")


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def half_ball(fp: Column, radius: int = RADIUS) -> Column:
    """All variants of ``fp`` within half the radius, as an array."""
    masks = [sum(1 << i for i in c) for n in range(radius // 2 + 1) for c in combinations(range(64), n)]
    return F.transform(F.array(*(F.lit(_signed(m)).cast("long") for m in masks)), lambda m: m.bitwiseXOR(fp))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b: verified links of the distinct fingerprints in column fp.

    Every pair within the radius is joined by a chain of the links. Of the fingerprints that share a
    variant each is linked to the smallest; any two of them are within the radius.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    variants = distinct.select("fp", F.explode(half_ball(F.col("fp"), radius)).alias("variant"))
    lowest = F.min("fp").over(Window.partitionBy("variant"))
    return (
        variants.select(lowest.alias("a"), F.col("fp").alias("b"))
        .where("a < b")
        .distinct()
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b): root is the component's smallest node.

    Large-star and small-star steps alternate until nothing changes; each round is written to the
    shared folder. Stars meet in aggregations and joins, which the adaptive skew join can split.
    """
    edges = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = durable(least.select("u", F.col("m").alias("v")).union(small).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def _named(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, first, root, component_id) of the distinct fingerprints in ``rows``; ``root`` tells components apart."""
    distinct = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = components(links(distinct, radius)).withColumnRenamed("node", "fp").join(distinct, "fp")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    reached = linked.join(smallest, "root").select("fp", "root", "component_id")
    whole = F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component_id"))
    return distinct.join(reached, "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"), whole.alias("component_id")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links reach.

    One row per row of ``docs``, also for repeated rows and ids. Equal fingerprints are linked, so all
    texts without words form one component. Null ids stay null and are never a component's id unless
    it has no other. An empty table gives no rows. Other columns are not read.
    """
    rows = durable(fingerprints(docs, id_col, text_col, size))
    names = _named(rows, radius).select("fp", "component_id")
    # Written, so that both sides of the join are plain shuffles, of which a hot key's can be split.
    return rows.join(durable(names), "fp").select("doc_id", "fp", "component_id")


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """One row of each component of ``docs``: that with the smallest id, null ids last.

    Of rows with that id, which repeat it, one with the smallest fingerprint stays. An empty table
    gives no rows; all columns stay as they are.
    """
    rows = durable(fingerprints(docs, id_col, text_col, size))
    winner = F.min(F.struct(F.col("first").isNull(), "first", "fp"))
    first = _named(rows, radius).groupBy("root").agg(winner.alias("w")).select("w.first", "w.fp")
    first = durable(first.select(F.col("first").alias("_first"), F.col("fp").alias("_print")))
    id_, fp = free_name(docs, "_id"), free_name(docs, "_fp")
    found = _printed(docs, id_col, text_col, size, id_, fp)
    kept = found.join(first, (F.col(fp) == F.col("_print")) & F.col(id_).eqNullSafe(F.col("_first")), "left_semi")
    if not rows.groupBy("doc_id", "fp").count().where("count > 1").isEmpty():
        nth = free_name(docs, "_nth")
        order = Window.partitionBy(fp, id_).orderBy(F.xxhash64(*docs.columns))
        kept = kept.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1)
    return kept.select(*docs.columns)


def _printed(docs: DataFrame, id_col: str, text_col: str, size: int, id_: str, fp: str) -> DataFrame:
    """``docs`` with the id as a long and the fingerprint."""
    text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = [fingerprint(t or b"", size) for t in raw(batch.column(text)).to_pylist()]
            column = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, fp])

    rows = docs.withColumn(id_, F.col(id_col).cast("long"))
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return ready(rows).mapInArrow(run, f"{fields}, `{fp}` long")
