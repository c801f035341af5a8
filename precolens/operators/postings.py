"""Blocked postings: the word index with one row per word and block of products instead of one per posting.

Products are numbered; a block holds those whose numbers agree but for the last ``BLOCK_BITS`` bits. A word's row
lists its products' places in the block in ascending order, which Parquet stores as differences, and the first and last of them.
A frequent word has many rows of bounded size. A search reads the blocks of its rarest word, and of the
other words only these blocks; places are intersected rarest word first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import search_terms
from ..session import measured, written
from .bitmaps import NUMBER, number_products
from .selection import ID
from .textindex import INDEXED, TOKEN_BUCKETS, build_index

# Products of a block: 2^BLOCK_BITS.
BLOCK_BITS = 12

# As many block numbers may go to the scan as a list of values.
LISTED = 1000

# Differences of neighbouring places instead of a dictionary of them.
_DELTAS = {"parquet.writer.version": "v2", "parquet.enable.dictionary#lugares.list.element": "false"}

_BLOCKS = "coluna string, token string, bloco long, n int, primeiro int, ultimo int, lugares array<int>, vezes array<long>, balde int"
_WORDS = "coluna string, token string, n long, balde int"
_NUMBERS = f"{ID} string, {NUMBER} long, bloco long"


def _bucket():
    return F.pmod(F.xxhash64("token"), F.lit(TOKEN_BUCKETS)).cast("int")


def _block():
    return F.shiftright(NUMBER, BLOCK_BITS).alias("bloco")


def blocks(index: DataFrame, numbers: DataFrame) -> DataFrame:
    """Rows (coluna, token, bloco, n, primeiro, ultimo, lugares, vezes) of an index with one row per posting.

    A group is a word in one block, so no group has more than 2^BLOCK_BITS postings, however frequent the word.
    """
    placed = index.join(numbers.select(ID, NUMBER), ID)
    place = F.col(NUMBER).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
    pair = F.struct(place.alias("lugar"), F.col("ocorrencias").alias("vezes"))
    lists = placed.groupBy("coluna", "token", _block()).agg(F.sort_array(F.collect_list(pair)).alias("_p"))
    return lists.select(
        "coluna", "token", "bloco", F.size("_p").alias("n"), F.col("_p")[0]["lugar"].alias("primeiro"),
        F.element_at("_p", -1)["lugar"].alias("ultimo"), F.col("_p.lugar").alias("lugares"), F.col("_p.vezes").alias("vezes"),
    )


def _store(rows: DataFrame, path: str, order: list[str], mode: str, **options: str) -> None:
    """By bucket of the word; the adaptive plan splits one that a frequent word makes large."""
    (
        rows.withColumn("balde", _bucket())
        .hint("rebalance", F.col("balde"))
        .sortWithinPartitions("balde", *order)
        .write.mode(mode)
        .options(**options)
        .partitionBy("balde")
        .parquet(path)
    )


def _add(fact: DataFrame, numbers: DataFrame, path: str, mode: str) -> None:
    made = written(blocks(build_index(fact), numbers), "blocos")
    _store(made, f"{path}/blocos", ["token", "coluna", "bloco"], mode, **_DELTAS)
    words = made.groupBy("coluna", "token").agg(F.sum("n").cast("long").alias("n"))
    _store(words, f"{path}/palavras", ["token", "coluna"], mode)


def _keep_numbers(numbers: DataFrame, path: str, mode: str) -> None:
    ordered = numbers.select(ID, NUMBER, _block()).repartitionByRange("bloco").sortWithinPartitions(NUMBER)
    ordered.write.mode(mode).parquet(f"{path}/numeros")


def _numbers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_NUMBERS).parquet(f"{path}/numeros")


def write_postings(fact: DataFrame, path: str) -> None:
    """Index the fact anew: numbers of products, blocks of postings, and how many postings a word has."""
    _keep_numbers(number_products(fact), path, "overwrite")
    _add(fact, _numbers(fact.sparkSession, path), path, "overwrite")


def extend_postings(rows: DataFrame, path: str) -> None:
    """Add appended rows: new products get the next numbers, their postings become further rows of words and blocks."""
    known = _numbers(rows.sparkSession, path)
    fresh = measured(number_products(rows, known.select(ID, NUMBER)).join(known, ID, "left_anti")).rows
    _keep_numbers(fresh, path, "append")
    _add(rows, _numbers(rows.sparkSession, path), path, "append")


def _of_words(spark: SparkSession, path: str, table: str, schema: str, words: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A stored table's rows for some words: only their buckets are read."""
    named = spark.createDataFrame([(w,) for w in words], "token string")
    buckets = [r.balde for r in named.select(_bucket().alias("balde")).distinct().collect()]
    held = F.col("balde").isin(buckets) & F.col("token").isin(list(words)) & F.col("coluna").isin(list(columns))
    return spark.read.schema(schema).parquet(f"{path}/{table}").where(held)


def matching_blocks(spark: SparkSession, path: str, words: Sequence[str], columns: Sequence[str] = INDEXED) -> tuple[list[str], DataFrame]:
    """The words, rarest first, and their rows in the blocks that the rarest word has; no words if one is nowhere."""
    sizes = _of_words(spark, path, "palavras", _WORDS, words, columns).groupBy("token").agg(F.sum("n").alias("n"))
    known = {r.token: r.n for r in sizes.collect()}  # a row per word of the phrase
    rows = _of_words(spark, path, "blocos", _BLOCKS, words, columns).select("token", "bloco", "lugares")
    if len(known) < len(words):
        return [], rows.limit(0)
    order = sorted(words, key=lambda w: (known[w], w))
    if len(order) == 1:
        return order, rows
    first = _of_words(spark, path, "blocos", _BLOCKS, order[:1], columns).select("bloco").distinct()
    held = measured(first)
    if held.count <= LISTED:
        return order, rows.where(F.col("bloco").isin([r.bloco for r in held.rows.collect()]))
    return order, rows.join(held.side, "bloco", "left_semi")


def search(spark: SparkSession, path: str, phrase: str, columns: Sequence[str] = INDEXED) -> DataFrame:
    """Ids of the products in which every word of the phrase occurs, from the stored blocks."""
    words = search_terms(spark, phrase)
    if not words:
        raise ValueError("the search phrase has no words")
    order, rows = matching_blocks(spark, path, words, columns)
    numbers = _numbers(spark, path)
    if not order:
        return numbers.select(ID).limit(0)
    # A word may have several rows in a block: one per column and append.
    lists = rows.groupBy("bloco").agg(*[F.flatten(F.collect_list(F.when(F.col("token") == w, F.col("lugares")))).alias(f"_p{i}") for i, w in enumerate(order)])
    both = reduce(F.array_intersect, [F.col(f"_p{i}") for i in range(1, len(order))], F.array_distinct("_p0"))
    found = lists.select("bloco", F.explode(both).alias("lugar"))
    number = F.shiftleft("bloco", BLOCK_BITS) + F.col("lugar")
    return found.select("bloco", number.alias(NUMBER)).join(numbers, ["bloco", NUMBER]).select(ID)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """The whole index as rows (coluna, token, id_produto, ocorrencias), appended rows added up."""
    rows = spark.read.schema(_BLOCKS).parquet(f"{path}/blocos")
    single = rows.select("coluna", "token", "bloco", F.inline(F.arrays_zip("lugares", "vezes")))
    number = (F.shiftleft("bloco", BLOCK_BITS) + F.col("lugares")).alias(NUMBER)
    named = single.select("coluna", "token", "bloco", number, "vezes").join(_numbers(spark, path), ["bloco", NUMBER])
    return named.groupBy("coluna", "token", ID).agg(F.sum("vezes").alias("ocorrencias"))
