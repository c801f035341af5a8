"""Selections of products as bitmaps: one row for 64 products, and all set operations on whole words.

Every product gets a number once; the stored fact table carries it. A selection is then rows (palavra, bits):
the number without its last six bits, and a word with one bit for each of the 64 products. Words come from
a hash aggregation with ``bit_or``, so a task hands on each word once and product ids are never shuffled. Union,
difference and comparison are bit operations where words of several selections meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, measured
from .enrich import enrich
from .selection import ID

NUMBER = "numero_produto"

# Parts in which products are numbered side by side; a part's numbers follow those of the parts before it.
NUMBERED_PARTS = 1024

_BITS = 6


def number_products(ids: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows (id_produto, numero_produto): the distinct ids numbered without gaps; those ``known`` keep their numbers.

    Parts by a hash of the id are numbered each by itself; only their sizes pass through one task.
    """
    fresh, start = ids.select(ID).where(F.col(ID).isNotNull()).distinct(), 0
    if known is not None:
        fresh = fresh.join(known, ID, "left_anti")
        start = known.agg(F.coalesce(F.max(NUMBER) + 1, F.lit(0))).first()[0]
    fresh = durable(fresh.withColumn("parte", F.pmod(F.xxhash64(ID), F.lit(NUMBERED_PARTS))))
    sizes = fresh.groupBy("parte").agg(F.count("*").alias("n"))
    before = Window.orderBy("parte").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("parte", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("antes"))
    place = F.row_number().over(Window.partitionBy("parte").orderBy(ID))
    numbered = fresh.withColumn("lugar", place).join(F.broadcast(offsets), "parte")  # NUMBERED_PARTS rows at most
    numbered = numbered.select(ID, (F.col("antes") + F.col("lugar") - 1 + start).alias(NUMBER))
    return numbered if known is None else known.select(ID, NUMBER).unionByName(numbered)


def with_numbers(fact: DataFrame, numbers: DataFrame) -> DataFrame:
    """Fact rows with their product's number, NULL for a product without one; for publishing."""
    return fact.join(numbers.select(ID, NUMBER), ID, "left")


def _bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(F.lit(63)).cast("int"))


def bitmap(rows: DataFrame) -> DataFrame:
    """Rows (palavra, bits) of the product numbers in ``rows``, repeats and NULLs included."""
    number = F.col(NUMBER)
    words = rows.where(number.isNotNull()).select(F.shiftright(number, _BITS).alias("palavra"), _bit(number).alias("bits"))
    return words.groupBy("palavra").agg(F.bit_or("bits").alias("bits"))


def _together(**sets: DataFrame) -> DataFrame:
    """One row per word with each selection's bits: all meet in a single aggregation on the word."""
    nothing = F.lit(0).cast("long")
    rows = [s.select("palavra", *[(F.col("bits") if n == m else nothing).alias(m) for m in sets]) for n, s in sets.items()]
    return reduce(DataFrame.unionAll, rows).groupBy("palavra").agg(*[F.bit_or(n).alias(n) for n in sets])


def _words(rows: DataFrame, bits: Column) -> DataFrame:
    return rows.select("palavra", bits.alias("bits")).where("bits != 0")


def _without(a: str, b: str) -> Column:
    return F.col(a).bitwiseAND(F.bitwise_not(b))


def select_all(selected: DataFrame, filtered: DataFrame) -> DataFrame:
    """The union of two bitmaps."""
    return selected.unionByName(filtered).groupBy("palavra").agg(F.bit_or("bits").alias("bits"))


def reconcile(selected: DataFrame, page: DataFrame, chosen: DataFrame) -> DataFrame:
    """The selection after the page was edited: products of the page follow its marks, the rest stay."""
    both = _together(antes=selected, pagina=page, marcado=chosen)
    return _words(both, _without("antes", "pagina").bitwiseOR(F.col("marcado")))


def deselected(page: DataFrame, chosen: DataFrame) -> DataFrame:
    """Products of the page that carry no mark."""
    return _words(_together(pagina=page, marcado=chosen), _without("pagina", "marcado"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row ``mudou``: whether two selections differ."""
    return _together(antes=before, depois=after).agg((F.count_if(F.col("antes") != F.col("depois")) > 0).alias("mudou"))


def count_selected(selected: DataFrame) -> DataFrame:
    """One row: the number of selected products."""
    return selected.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("selecionados"))


def all_selected(selected: DataFrame, filtered: DataFrame, total: DataFrame) -> DataFrame:
    """Whether everything is selected, by counts as the page shows it (``total``, a ``cnt`` row) and exactly."""
    both = _together(selecionado=selected, filtrado=filtered).agg(
        F.coalesce(F.sum(F.bit_count("selecionado")), F.lit(0)).cast("long").alias("selecionados"),
        F.coalesce(F.sum(F.bit_count(_without("filtrado", "selecionado"))), F.lit(0)).alias("faltam"),
    )
    some = F.col("cnt") > 0
    return both.crossJoin(total).select(  # one row and one row
        F.col("cnt").alias("total"),
        "selecionados",
        (some & (F.col("selecionados") >= F.col("cnt"))).alias("todos"),
        (some & (F.col("faltam") == 0)).alias("todos_exato"),
    )


def ids(selected: DataFrame, numbers: DataFrame) -> DataFrame:
    """The product ids of a bitmap, by the numbering it was made with."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1)
    found = selected.select("palavra", F.explode(places).alias("lugar"))
    return found.select((F.shiftleft("palavra", _BITS) + F.col("lugar")).alias(NUMBER)).join(numbers, NUMBER).select(ID)


def picked(fact: DataFrame, registry: DataFrame, selected: DataFrame) -> DataFrame:
    """All enriched rows of the selected products, in no order; the fact carries product numbers.

    The words are the join's side: broadcast if they were measured small, 64 products to a row.
    """
    side = measured(selected).side
    words = fact.withColumn("palavra", F.shiftright(NUMBER, _BITS)).join(side, "palavra")
    held = F.getbit("bits", F.col(NUMBER).bitwiseAND(F.lit(63)).cast("int")) == 1
    return enrich(words.where(held).drop("palavra", "bits", NUMBER), registry)
