"""Inverted index over descriptions and brands, for searches by several whole words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import search_terms, tokens

INDEXED = ("descricao", "marca")

# Folders of the stored index: a word lies in one of them.
TOKEN_BUCKETS = 64

# Words of a phrase that share one number.
_WORD_BITS = 62


def build_index(fact: DataFrame) -> DataFrame:
    """Rows (coluna, token, id_produto, ocorrencias).

    Equal texts of a product, collected on many dates, are counted together before any text is
    split, so that words are made once per distinct text and not once per row.
    """
    texts = fact.groupBy("id_produto", *INDEXED).agg(F.count("*").alias("_linhas"))
    columns = F.array(
        *[F.struct(F.lit(c).alias("coluna"), tokens(F.col(c)).alias("_tokens")) for c in INDEXED]
    )
    return (
        texts.select("id_produto", "_linhas", F.inline(columns))
        .select("id_produto", "_linhas", "coluna", F.explode("_tokens").alias("token"))
        .groupBy("coluna", "token", "id_produto")
        .agg(F.sum("_linhas").alias("ocorrencias"))
    )


def _bucket():
    return F.pmod(F.xxhash64("token"), F.lit(TOKEN_BUCKETS)).cast("int")


def write_index(index: DataFrame, path: str) -> None:
    """Index partitioned by token bucket; the adaptive plan splits a bucket that a frequent word makes large."""
    (
        index.withColumn("balde", _bucket())
        .hint("rebalance", F.col("balde"))
        .sortWithinPartitions("balde", "token", "coluna", "id_produto")
        .write.mode("overwrite")
        .partitionBy("balde")
        .parquet(path)
    )


def read_index(spark: SparkSession, path: str, phrase: str) -> DataFrame:
    """Postings of a phrase's words from a stored index: only their buckets are read."""
    words = spark.createDataFrame([(t,) for t in search_terms(spark, phrase)], "token string")
    buckets = [r.balde for r in words.select(_bucket().alias("balde")).distinct().collect()]
    return spark.read.parquet(path).where(F.col("balde").isin(buckets)).drop("balde")


def search(index: DataFrame, phrase: str, columns: Sequence[str] = INDEXED) -> DataFrame:
    """Ids of the products in which every word of the phrase occurs. One bit per word, one shuffle."""
    words = search_terms(index.sparkSession, phrase)
    if not words:
        raise ValueError("the search phrase has no words")
    groups = [words[i : i + _WORD_BITS] for i in range(0, len(words), _WORD_BITS)]
    bits = {}
    for g, group in enumerate(groups):
        bit = F.create_map(*[F.lit(v) for i, w in enumerate(group) for v in (w, 1 << i)])
        bits[f"_g{g}"] = F.coalesce(F.try_element_at(bit, F.col("token")).cast("long"), F.lit(0).cast("long"))
    rows = index.where(F.col("token").isin(words) & F.col("coluna").isin(list(columns))).select(
        "id_produto", *[b.alias(n) for n, b in bits.items()]
    )
    found = rows.groupBy("id_produto").agg(*[F.bit_or(n).alias(n) for n in bits])
    for n, group in zip(bits, groups, strict=True):
        found = found.where(F.col(n) == (1 << len(group)) - 1)
    return found.select("id_produto")
