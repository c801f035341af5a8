"""The enriched view: fact rows with their registry codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packed import packed, unpacked
from ..functions.text import supplier_code
from ..schemas import VISIBLE_COLUMNS
from ..session import measured

KEY = ["cod_informante", "id_produto"]

# The registry's columns in the view; among rows alike in the fact's they decide the order.
REGISTRY_TIES = ["cod_insumo", "insumo_informado"]


def registry_by_text_key(registry: DataFrame) -> DataFrame:
    """Registry under the fact's key names; the supplier code compares as exact text."""
    return registry.withColumns({"cod_informante": F.col("cod_informante").cast("string")}).withColumnRenamed(
        "id_produto_site", "id_produto"
    )


def with_code(fact: DataFrame) -> DataFrame:
    """Fact rows with the first supplier code in place of the array."""
    return fact.withColumn("cod_informante", supplier_code(fact))


def _joined(coded: DataFrame, codes: DataFrame) -> DataFrame:
    codes = codes.select(*KEY, *REGISTRY_TIES)
    return coded.join(codes, KEY, "left").select(*VISIBLE_COLUMNS)


def enrich(fact: DataFrame, registry: DataFrame, whole: bool = False) -> DataFrame:
    """Fact rows left-joined to the registry on (supplier code as text, product id).

    ``whole``: all columns are wanted, so that rows go through the join with their texts as one.

    A key with several registry rows repeats the fact row. The join has no hint: a registry
    below Spark's broadcast threshold is broadcast, beyond it a hot key on the fact side is
    split by the adaptive skew join.
    """
    coded, codes = with_code(fact), registry_by_text_key(registry)
    if not whole:
        return _joined(coded, codes)
    joined = packed(coded, KEY).join(codes.select(*KEY, *REGISTRY_TIES), KEY, "left")
    return unpacked(joined, VISIBLE_COLUMNS)


def registry_for(fact: DataFrame, registry: DataFrame) -> DataFrame:
    """The registry rows that a view of ``fact`` needs, and perhaps others; for few fact rows, written out before.

    Hashes of the fact's keys are measured and, if small, broadcast to the registry's scan, so that the rest of it is
    not shuffled. Beyond that size the registry stays whole.
    """
    key = F.xxhash64(*KEY).alias("_chave")
    wanted = measured(with_code(fact).select(key).distinct())
    if not wanted.small:
        return registry
    named = F.xxhash64(F.col("cod_informante").cast("string"), F.col("id_produto_site"))
    return registry.join(F.broadcast(wanted.rows), named == F.col("_chave"), "left_semi")


def enrich_first(first: DataFrame, registry: DataFrame, n: int, backward: bool = False) -> DataFrame:
    """Enriched rows that hold the first ``n`` of the view, from its first ``n`` fact rows; the last, if ``backward``.

    The left join drops no fact row, so no others are needed; nor are more than the first ``n``
    registry rows of a key. The fact rows, found once, are written out and measured. Their keys pick the
    registry rows, by a broadcast to its scan if they are small, so that then neither table is shuffled.
    """
    coded = measured(with_code(first))
    keys = coded.rows.select(*KEY).distinct()
    if coded.small:
        keys = F.broadcast(keys)
    ties = [F.desc_nulls_first(c) if backward else F.asc_nulls_last(c) for c in REGISTRY_TIES]
    order = Window.partitionBy(*KEY).orderBy(*ties)
    codes = (
        registry_by_text_key(registry)
        .join(keys, KEY, "left_semi")
        .withColumn("_rn", F.row_number().over(order))
        .where(F.col("_rn") <= n)
    )
    return _joined(coded.rows, codes)


def repeated_keys(registry: DataFrame) -> DataFrame:
    """Report of the registry keys with more than one row, and how many rows each has."""
    return (
        registry_by_text_key(registry)
        .groupBy(*KEY)
        .agg(F.count("*").alias("linhas"))
        .where("linhas > 1 and cod_informante is not null and id_produto is not null")
    )


class FanOut:
    """The repeated registry keys, found once and written out.

    The left join keeps every fact row, so its size is the fact's own count plus the extra
    rows of these keys. Without any, the registry need not be read again to count.
    """

    def __init__(self, registry: DataFrame, keys: DataFrame | None = None):
        """``keys``: the repeated keys, if they are stored with the registry."""
        self.registry = registry
        self.keys = measured(repeated_keys(registry) if keys is None else keys)

    @classmethod
    def of(cls, registry: DataFrame, given: FanOut | None) -> FanOut:
        """The report given, which must be of this registry, or a new one."""
        if given is not None and given.registry is not registry:
            raise ValueError("the fan-out report is of another registry")
        return given or cls(registry)

    def extra(self, fact: DataFrame, *columns: str) -> DataFrame | None:
        """Per fact row on a repeated key: ``columns`` and the rows the join adds; None when there are none."""
        if not self.keys.count:
            return None
        rows = with_code(fact).join(self.keys.side, KEY)
        return rows.select(*columns, (F.col("linhas") - 1).alias("linhas"))


def count_rows(fact: DataFrame, fan_out: FanOut) -> DataFrame:
    """One row ``cnt``: the number of enriched rows."""
    parts = fact.agg(F.count("*").alias("cnt"))
    extra = fan_out.extra(fact)
    if extra is not None:
        parts = parts.unionByName(extra.agg(F.sum("linhas").alias("cnt")))
    return parts.agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("cnt"))


def page_count(total: DataFrame, size: int = 30) -> DataFrame:
    """Number of pages for a ``cnt`` row: at least one."""
    return total.select(
        "cnt", F.greatest(F.lit(1), F.ceil(F.col("cnt") / F.lit(size))).cast("long").alias("paginas")
    )


def filtered_ids(fact: DataFrame, fan_out: FanOut) -> DataFrame:
    """Product id of every enriched row, repeats kept. Left-only rows need no join while no key repeats."""
    if not fan_out.keys.count:
        return fact.select("id_produto")
    codes = registry_by_text_key(fan_out.registry).select(*KEY)
    return with_code(fact).select(*KEY).join(codes, KEY, "left").select("id_produto")


def distinct_products(fact: DataFrame) -> DataFrame:
    return fact.select("id_produto", "descricao", "marca").distinct()
