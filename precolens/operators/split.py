"""Exact proportional split of the registry keys, and the references derived from products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Shares at which the shuffled keys are cut.
BOTH_CODES_SHARE = 0.40
ANY_CODE_SHARE = 0.70

_BUCKET_DIGITS = 4  # 65,536 hash buckets


def split_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys in hash order, cut by position into ``ambos``, ``so_insumo`` and ``nenhum``.

    A position is the number of keys in earlier hash buckets plus the place within the bucket.
    Buckets are even, since each key occurs once, and there are at most 65,536 sizes to sum.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    hashed = rows.select(*keys).distinct().withColumn("_h", F.md5(text))
    hashed = hashed.withColumn("_b", F.substring("_h", 1, _BUCKET_DIGITS))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = (
        hashed.groupBy("_b")
        .agg(F.count("*").alias("_n"))
        .select(
            "_b",
            (F.sum("_n").over(before) - F.col("_n")).alias("_before"),
            F.sum("_n").over(everything).alias("_all"),
        )
    )
    within = Window.partitionBy("_b").orderBy("_h", *keys)
    position = F.col("_before") + F.row_number().over(within)

    def cut(share: float) -> Column:
        return F.floor(F.col("_all").cast("double") * F.lit(share))

    return (
        hashed.join(F.broadcast(sizes), "_b")
        .withColumn("posicao", position)
        .select(
            *keys,
            "posicao",
            F.when(F.col("posicao") <= cut(BOTH_CODES_SHARE), "ambos")
            .when(F.col("posicao") <= cut(ANY_CODE_SHARE), "so_insumo")
            .otherwise("nenhum")
            .alias("classe"),
        )
    )


def _hash_number(text: Column, digits: int) -> Column:
    """Number made of the first hex digits of the text's hash."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def product_references(products: DataFrame) -> DataFrame:
    """One to three price-bank codes per product row; number and codes follow from the id."""
    copies = (_hash_number(F.col("id_produto"), 4) % 3 + 1).cast("int")
    rows = products.withColumn("ordem", F.explode(F.sequence(F.lit(1), copies)))
    code = _hash_number(F.concat_ws("-", "id_produto", F.col("ordem").cast("string")), 8)
    return rows.select(
        "id_produto",
        "ordem",
        F.concat(F.lit("BP"), (code % 900000 + 100000).cast("string")).alias("cod_bp"),
        "descricao",
        "marca",
    )
