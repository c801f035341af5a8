"""The price tables derived from the order-warehouse Parquet files (``lineitem``, ``part``, ...)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import derive
from ..functions.text import zero_padded


@lru_cache(maxsize=256)
def _schema(spark: SparkSession, path: str) -> T.StructType:
    return spark.read.parquet(path).schema


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; its schema is read from the file footer once per session."""
    path = f"{folder}/{name}.parquet"
    return spark.read.schema(_schema(spark, path)).parquet(path)


def _products(spark: SparkSession, folder: str) -> DataFrame:
    """Fields that follow from the product, made once per product and not once per price."""
    key = F.col("p_partkey")
    digits = key.cast("string")
    return table(spark, folder, "part").select(
        "p_partkey",
        zero_padded(key, 13).alias("ean"),
        F.concat(F.lit("SKU-"), digits, F.lit("-")).alias("_sku"),
        F.concat(F.lit("https://www.example.com/produto/sku/"), digits, F.lit("/")).alias("_url"),
        derive.description(F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("descricao"),
        F.col("p_brand").alias("marca"),
        F.when(key % 3 == 0, "BRL").when(key % 3 == 1, "USD").otherwise("EUR").alias("moeda"),
        derive.product_id(key).alias("id_produto"),
    )


def _suppliers(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        "s_suppkey",
        "s_nationkey",
        F.when(key % 17 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(key.cast("string"), F.lit("ALT")))
        .alias("cod_informante"),
        F.col("s_name").alias("nome_informante"),
    )


def collection(spark: SparkSession, folder: str, *, price_type: bool = True) -> DataFrame:
    """Fact table, one row per line item.

    ``price_type`` comes from ``orders`` by its primary key (tested for each folder of test data), so
    that join neither drops nor repeats a row; without it the column is left out, too. Each table is
    joined by itself, so that Spark sees its file size when it picks the join.
    """
    items = table(spark, folder, "lineitem")
    if price_type:
        orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
        items = items.join(orders, items.l_orderkey == orders.o_orderkey, "left")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    line, order = F.col("l_linenumber").cast("string"), F.col("l_orderkey").cast("string")
    return (
        items.join(_products(spark, folder), F.col("l_partkey") == F.col("p_partkey"))
        .join(_suppliers(spark, folder), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("l_shipdate").cast("date").cast("string").alias("data_coleta"),
            F.col("l_returnflag").alias("plataforma"),
            "cod_informante",
            "nome_informante",
            F.col("l_linestatus").alias("periodicidade"),
            *[F.col("o_orderpriority").alias("tipo_preco")] * price_type,
            "ean",
            F.concat("_sku", line).alias("sku"),
            F.concat("_url", line).alias("url"),
            "descricao",
            "marca",
            F.col("n_name").alias("uf"),
            "moeda",
            F.col("l_extendedprice").alias("preco"),
            F.when(
                F.col("l_discount") > 0.07, F.col("l_extendedprice") * (1 - F.col("l_discount"))
            ).alias("preco_promocional"),
            "id_produto",
            derive.collection_id(order).alias("id_coleta"),
            derive.image_id(F.concat(order, F.lit("_"), line)).alias("id_imagem"),
        )
    )


def flat_collection(spark: SparkSession, folder: str) -> DataFrame:
    """Flat variant of the fact table: the supplier code is one scalar."""
    return collection(spark, folder).withColumn("cod_informante", F.get("cod_informante", F.lit(0)))


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """Registry, one row per (supplier, product): both codes, one code, an empty row, or no row."""
    mark = (F.col("l_partkey") + F.col("l_suppkey")) % 10
    return (
        table(spark, folder, "lineitem")
        .select("l_suppkey", "l_partkey")
        .where(mark < 9)
        .distinct()
        .select(
            F.col("l_suppkey").alias("cod_informante"),
            derive.product_id(F.col("l_partkey")).alias("id_produto_site"),
            F.when(mark < 7, F.concat(F.lit("INS"), F.col("l_partkey").cast("string"))).alias("cod_insumo"),
            F.when(mark < 4, F.lit(100000) + F.col("l_partkey")).alias("insumo_informado"),
        )
    )


def roster(spark: SparkSession, folder: str) -> DataFrame:
    """Keyed dimension table in the roster shape, one row per customer."""
    key = F.col("c_custkey")
    segment = F.col("c_mktsegment")
    return table(spark, folder, "customer").select(
        key.alias("id"),
        F.col("c_name").alias("nome"),
        F.when(key % 5 == 0, "")
        .otherwise(F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com")))
        .alias("email"),
        F.when(segment == "BUILDING", "master")
        .when(segment == "MACHINERY", "administrador")
        .when(segment == "FURNITURE", "tecnico")
        .otherwise(F.lower(segment))
        .alias("tipo"),
        F.when(key % 4 != 0, F.concat(F.lit("AREA-"), F.col("c_nationkey").cast("string"))).alias("area"),
        F.when(key % 11 == 0, 0).otherwise(1).alias("ativo"),
    )


def insert_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Insert change set from keys 0 modulo 7: names and ids already present or repeated, blank names."""
    key = F.col("id")
    return (
        roster(spark, folder)
        .where(key % 7 == 0)
        .select(
            key.alias("seq"),
            F.when(key % 13 == 0, key).when(key % 17 == 0, 10_000_000).otherwise(key + 10_000_000).alias("id"),
            F.when(key % 35 == 0, "  ")
            .when(key % 14 == 0, F.concat(F.lit(" "), "nome"))
            .otherwise(F.concat(F.lit("Novo-"), F.floor(key / 28).cast("string")))
            .alias("nome"),
            "email",
            "tipo",
            "area",
        )
    )


def update_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Update change set from keys 1 modulo 7; some keys come twice and some are unknown."""
    key = F.col("id")
    rows = roster(spark, folder).where(key % 7 == 1)
    target = F.when(key % 3 == 0, key + 20_000_000).otherwise(key)
    first = rows.select(
        (key * 2).alias("seq"), target.alias("id"), F.concat("email", F.lit(".br")).alias("email"),
        F.lit("primeira").alias("area"),
    )
    second = rows.where(key % 2 == 0).select(
        (key * 2 + 1).alias("seq"), target.alias("id"), F.lit(None).cast("string").alias("email"),
        F.lit("segunda").alias("area"),
    )
    return first.unionByName(second)


def delete_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Delete change set from keys 2 modulo 7; some are unknown."""
    key = F.col("id")
    return (
        roster(spark, folder)
        .where(key % 7 == 2)
        .select(F.when(key % 3 == 0, key + 30_000_000).otherwise(key).alias("id"))
    )
