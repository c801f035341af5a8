"""Index for the substring search: three-letter grams of the distinct descriptions, then the pattern itself.

A description is stored once, however many prices it has, and so is each of its grams. A search takes the
grams of its literal runs (``%`` and ``_`` stay wildcards), keeps the descriptions that have them all, and tests
the pattern on those alone. The fact is then met by whole descriptions, not by a pattern on each of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import contains_ignoring_case
from ..session import measured

TEXT = "descricao"
GRAM = 3

# Folders of the stored index: a gram, and a description, lies in one of them.
GRAM_BUCKETS = TEXT_BUCKETS = 64

# As many descriptions may go to the scan as a list of values; Spark pushes so many down one by one.
LISTED = 10

_TEXTS = f"texto long, {TEXT} string, balde int"
_GRAMS = "grama string, texto long, balde int"


def _grams(text: Column) -> Column:
    """The distinct grams of a text; none if it is shorter than one."""
    starts = F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, GRAM)))


def distinct_texts(fact: DataFrame) -> DataFrame:
    """Rows (texto, descricao): each description once under a hash; texts of one hash share a number, not a row."""
    texts = fact.select(TEXT).where(F.col(TEXT).isNotNull()).distinct()
    return texts.select(F.xxhash64(TEXT).alias("texto"), TEXT)


def postings(texts: DataFrame) -> DataFrame:
    """Rows (grama, texto): every gram of every description, folded to lower case, once."""
    return texts.select(F.explode(_grams(F.lower(TEXT))).alias("grama"), "texto").distinct()


def _bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int").alias("balde")


def _write(rows: DataFrame, path: str, order: list[str], mode: str) -> None:
    """By bucket; the adaptive plan splits one that a frequent gram makes large."""
    (
        rows.hint("rebalance", F.col("balde"))
        .sortWithinPartitions("balde", *order)
        .write.mode(mode)
        .partitionBy("balde")
        .parquet(path)
    )


def write_gram_index(fact: DataFrame, path: str) -> None:
    """Index the descriptions of ``fact`` anew."""
    texts = distinct_texts(fact)
    _write(texts.select("*", _bucket("texto", TEXT_BUCKETS)), f"{path}/textos", ["texto"], "overwrite")
    stored = fact.sparkSession.read.schema(_TEXTS).parquet(f"{path}/textos")
    grams = postings(stored.select("texto", TEXT))
    _write(grams.select("*", _bucket("grama", GRAM_BUCKETS)), f"{path}/gramas", ["grama", "texto"], "overwrite")


def extend_gram_index(rows: DataFrame, path: str) -> None:
    """Add the descriptions of appended rows that the index does not have yet."""
    known = rows.sparkSession.read.schema(_TEXTS).parquet(f"{path}/textos")
    fresh = measured(distinct_texts(rows).join(known, ["texto", TEXT], "left_anti").select("texto", TEXT)).rows
    _write(fresh.select("*", _bucket("texto", TEXT_BUCKETS)), f"{path}/textos", ["texto"], "append")
    grams = postings(fresh).select("*", _bucket("grama", GRAM_BUCKETS))
    _write(grams, f"{path}/gramas", ["grama", "texto"], "append")


def search_grams(spark: SparkSession, term: str) -> list[str]:
    """The distinct grams of a term's literal runs, folded as the texts are."""
    row = spark.createDataFrame([(term,)], "termo string")
    runs = F.split(F.lower("termo"), "[%_]")
    found = F.array_distinct(F.flatten(F.transform(runs, _grams)))
    return row.select(F.array_sort(found)).first()[0]


def candidates(spark: SparkSession, path: str, term: str) -> DataFrame:
    """Rows (texto, descricao) that have every gram of the term; all of them if it has none."""
    texts = spark.read.schema(_TEXTS).parquet(f"{path}/textos")
    grams = search_grams(spark, term)
    if not grams:
        return texts.drop("balde")
    named = spark.createDataFrame([(g,) for g in grams], "grama string")
    buckets = [r.balde for r in named.select(_bucket("grama", GRAM_BUCKETS)).distinct().collect()]
    lists = spark.read.schema(_GRAMS).parquet(f"{path}/gramas").where(F.col("balde").isin(buckets) & F.col("grama").isin(grams))
    # Texts of one hash, or a text appended twice, may have a gram more than once.
    found = lists.groupBy("texto").agg(F.count_distinct("grama").alias("n")).where(F.col("n") == len(grams))
    return texts.join(found, "texto", "left_semi").drop("balde")


def matching_texts(spark: SparkSession, path: str, term: str) -> DataFrame:
    """The descriptions that contain the term, wildcards and all."""
    term = term.strip()
    return candidates(spark, path, term).where(contains_ignoring_case(F.col(TEXT), term)).select(TEXT).distinct()


def search(fact: DataFrame, path: str, term: str) -> DataFrame:
    """Fact rows whose description contains the term, as the filter by text finds them; a blank term finds all.

    The index must have all descriptions of ``fact``. Few descriptions go to the scan as values, many are
    joined, by a broadcast if they are small.
    """
    if not term.strip():
        return fact
    found = measured(matching_texts(fact.sparkSession, path, term))
    if found.count <= LISTED and found.small:
        return fact.where(F.col(TEXT).isin([r[TEXT] for r in found.rows.collect()]))
    return fact.join(found.side, TEXT, "left_semi").select(*fact.columns)
