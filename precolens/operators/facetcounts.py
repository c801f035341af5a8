"""Filter options kept by changes: how often each facet value occurs, by month, added to and taken from.

A load writes the counts of its own rows only. Months that are published anew replace their counts, appended rows
add theirs and removed rows take theirs away; a value is offered while its counts add up to more than none. So
the options after any number of loads come from this table alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import supplier_code
from ..schemas import MONTH
from ..session import written
from .facets import FACETS, with_bounds

_SCHEMA = f"faceta string, valor string, n long, {MONTH} string"


def facet_counts(fact: DataFrame, sign: int = 1) -> DataFrame:
    """Rows (mes_coleta, faceta, valor, n), ``sign`` times the number of fact rows; the dates are a facet, too.

    Rows alike on all facets are counted before they are taken apart.
    """
    month = F.nullif(F.substring("data_coleta", 1, len("yyyy-MM")), F.lit("")).alias(MONTH)
    code, listed = supplier_code(fact).alias("_cod"), F.col("cod_informante").isNotNull().alias("_com_cod")
    alike = fact.select(month, "data_coleta", *FACETS, code, listed)
    alike = alike.groupBy(*alike.columns).agg(F.count("*").alias("n"))

    def pair(name: str, column: str, given: str) -> Column:
        return F.struct(F.lit(name).alias("faceta"), F.col(column).alias("valor"), F.expr(given).alias("_dado"))

    pairs = [pair(c, c, f"{c} is not null") for c in FACETS]
    pairs += [pair("cod_informante", "_cod", "_com_cod"), pair("data", "data_coleta", "data_coleta is not null")]
    each = alike.select(MONTH, "n", F.inline(F.array(*pairs))).where("_dado")
    return each.groupBy(MONTH, "faceta", "valor").agg((F.sum("n") * sign).alias("n"))


def _write(rows: DataFrame, path: str, mode: str) -> None:
    (
        rows.hint("rebalance", F.col(MONTH))
        .sortWithinPartitions(MONTH, "faceta", "valor")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(MONTH)
        .parquet(path)
    )


def replace_months(fact: DataFrame, path: str) -> None:
    """The counts of the months in ``fact``, which must have all their rows, in place of earlier ones."""
    _write(facet_counts(fact), path, "overwrite")


def add_rows(rows: DataFrame, path: str, sign: int = 1) -> None:
    """Add the counts of appended rows; with ``sign`` -1 take away those of removed rows."""
    _write(facet_counts(rows, sign), path, "append")


def compact(spark: SparkSession, path: str) -> None:
    """One row for each month and value; values that add up to none go. A month without any keeps a row of zero."""
    stored = spark.read.schema(_SCHEMA).parquet(path)
    summed = stored.groupBy(MONTH, "faceta", "valor").agg(F.sum("n").alias("n"))
    nothing = stored.select(MONTH).distinct().select(MONTH, F.lit(None).cast("string").alias("faceta"), F.lit(None).cast("string").alias("valor"), F.lit(0).cast("long").alias("n"))
    # Written first, since it is read from where it goes.
    _write(written(summed.where("n != 0").unionByName(nothing), "contagens"), path, "overwrite")


def stored_options(spark: SparkSession, path: str) -> DataFrame:
    """The filter options as :func:`facets.filter_options` gives them, from the counts alone."""
    summed = spark.read.schema(_SCHEMA).parquet(path).groupBy("faceta", "valor").agg(F.sum("n").alias("n"))
    return with_bounds(summed.where("n > 0 and faceta is not null").select("faceta", "valor"))
