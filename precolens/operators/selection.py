"""Selections of product ids as one-column DataFrames, with the set algebra of the page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Measured, measured
from .enrich import enrich
from .paging import all_newest_first

ID = "id_produto"


def _memberships(**sets: DataFrame) -> DataFrame:
    """One row per id with a boolean per set: all sets meet in a single aggregation on the id."""
    names = list(sets)
    tagged = [s.select(ID, F.lit(1 << i).alias("_em")) for i, s in enumerate(sets.values())]
    merged = reduce(DataFrame.unionAll, tagged).groupBy(ID).agg(F.bit_or("_em").alias("_em"))
    return merged.select(
        ID, *[(F.col("_em").bitwiseAND(1 << i) != 0).alias(name) for i, name in enumerate(names)]
    )


def select_all(selected: DataFrame, fact: DataFrame) -> DataFrame:
    """The selection with every filtered id. The join drops no fact row, so the ids need no registry."""
    return selected.select(ID).unionAll(fact.select(ID)).distinct()


def reconcile(selected: DataFrame, page_ids: DataFrame, chosen: DataFrame) -> DataFrame:
    """The selection after the page was edited: ids of the page follow its marks, the rest stay."""
    ids = _memberships(antes=selected, pagina=page_ids, marcado=chosen)
    return ids.where("marcado or (antes and not pagina)").select(ID)


def deselected(page_ids: DataFrame, chosen: DataFrame) -> DataFrame:
    """Ids of the page that carry no mark."""
    return _memberships(pagina=page_ids, marcado=chosen).where("pagina and not marcado").select(ID)


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row ``mudou``: whether two selections differ."""
    differing = _memberships(antes=before, depois=after).where("antes != depois")
    return differing.agg((F.count("*") > 0).alias("mudou"))


def count_selected(selected: DataFrame) -> DataFrame:
    """One row: the number of distinct ids."""
    return selected.agg(F.count_distinct(ID).alias("selecionados"))


def all_selected(selected: DataFrame, fact: DataFrame, total: DataFrame) -> DataFrame:
    """Whether everything is selected, by counts as the page shows it and exactly.

    ``todos`` compares the number of selected ids with the number of enriched rows (``total``, a
    ``cnt`` row); ``todos_exato`` asks that no filtered id is missing from the selection.
    """
    ids = _memberships(selecionado=selected, filtrado=fact).agg(
        F.lit(0).cast("long").alias("total"),
        F.count_if("selecionado").alias("selecionados"),
        F.count_if(F.col("filtrado") & ~F.col("selecionado")).alias("faltam"),
    )
    rows = total.select(F.col("cnt").alias("total"), F.lit(0).cast("long").alias("selecionados"),
                        F.lit(0).cast("long").alias("faltam"))
    both = ids.unionByName(rows).agg(*[F.sum(c).alias(c) for c in ("total", "selecionados", "faltam")])
    some = F.col("total") > 0
    return both.select(
        "total",
        "selecionados",
        (some & (F.col("selecionados") >= F.col("total"))).alias("todos"),
        (some & (F.col("faltam") == 0)).alias("todos_exato"),
    )


def _distinct_ids(selected: DataFrame) -> Measured:
    """The selection written out and measured, so a small one is broadcast and a large one shuffled."""
    return measured(selected.select(ID).where(F.col(ID).isNotNull()).distinct())


def mark_selected(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """Rows with the flag ``selecionado``."""
    marks = _distinct_ids(selected)
    flagged = marks.rows.withColumn("selecionado", F.lit(True))
    return rows.join(F.broadcast(flagged) if marks.small else flagged, ID, "left").withColumn(
        "selecionado", F.coalesce("selecionado", F.lit(False))
    )


def cleared(selected: DataFrame) -> DataFrame:
    """The empty selection."""
    return selected.select(ID).where(F.lit(False))


def toggle_all(selected: DataFrame, fact: DataFrame, total: DataFrame, ticked: bool) -> DataFrame:
    """The selection after the box for all rows was ticked or unticked.

    Unticked while everything is selected, it clears the selection; unticked otherwise, it leaves it.
    """
    if ticked:
        return select_all(selected, fact)
    return cleared(selected) if all_selected(selected, fact, total).first().todos else selected.select(ID)


def picked(fact: DataFrame, registry: DataFrame, selected: DataFrame) -> DataFrame:
    """All enriched rows of the selected products, in no order, whatever the current filters."""
    ids = _distinct_ids(selected)
    if ids.small:
        # The same broadcast thins the registry before the two tables meet.
        registry = registry.join(
            F.broadcast(ids.rows.withColumnRenamed(ID, "id_produto_site")), "id_produto_site", "left_semi"
        )
    return enrich(fact.join(ids.side, ID, "left_semi"), registry)


def rows_by_ids(fact: DataFrame, registry: DataFrame, selected: DataFrame) -> DataFrame:
    """All enriched rows of the selected products, newest first."""
    return all_newest_first(picked(fact, registry, selected))
