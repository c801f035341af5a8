"""Clustered layout: rows along a space-filling curve over the filter columns, so that every equality filter skips row groups.

A column's values are cut into bins of about equal numbers of rows, in the values' own order, so that a row group's
smallest and largest values say something about each column. The bins' bits are interleaved, first bits first; rows
are sorted by month and by that number.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packed import packed, unpacked
from ..operators.enrich import with_code
from ..schemas import MONTH
from ..session import CODEC
from .publish import by_month

# The equality filters' columns, and the day within the month.
DIMENSIONS = ("cod_informante", "marca", "uf", "nome_informante", "data_coleta")

# A column has 2^BITS bins at most.
BITS = 4


def bin_starts(rows: DataFrame, columns: Sequence[str] = DIMENSIONS, bits: int = BITS) -> dict[str, list]:
    """For each column the values at which its bins start, the first bin's left out.

    Distinct values are counted, never rows sorted; fewer than 2^bits starts of each column come back.
    """
    value = [F.struct(F.lit(c).alias("coluna"), F.col(c).cast("string").alias("valor")) for c in columns]
    counts = rows.select(F.inline(F.array(*value))).where("valor is not null").groupBy("coluna", "valor").agg(F.count("*").alias("n"))
    order = Window.partitionBy("coluna").orderBy("valor")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    total = F.sum("n").over(Window.partitionBy("coluna"))
    placed = counts.select("coluna", "valor", F.floor(before * (1 << bits) / total).alias("faixa"))
    starts = placed.groupBy("coluna", "faixa").agg(F.min("valor").alias("valor")).collect()
    found: dict[str, list] = {c: [] for c in columns}
    for r in sorted(starts, key=lambda r: r.faixa):
        if r.faixa > 0:
            found[r.coluna].append(r.valor)
    return found


def curve(starts: Mapping[str, Sequence], bits: int = BITS) -> Column:
    """A row's place on the curve; NULLs share the last bin of their column."""
    parts, width = [], len(starts)
    for at, (column, values) in enumerate(starts.items()):
        value = F.col(column).cast("string")
        passed = reduce(add, ((value >= F.lit(v)).cast("int") for v in values), F.lit(0))
        place = F.coalesce(passed, F.lit((1 << bits) - 1))
        for bit in range(bits):
            parts.append(F.shiftleft(F.shiftright(place, bit).bitwiseAND(F.lit(1)).cast("long"), bit * width + at))
    return reduce(add, parts, F.lit(0).cast("long"))


def publish_clustered(rows: DataFrame, path: str, starts: Mapping[str, Sequence] | None = None, **options: object) -> None:
    """Write rows by month along the curve, replacing just the months present; the supplier code becomes a scalar.

    ``starts`` may give the bins of an earlier load, so that months stay comparable; else they are found anew.
    """
    coded = by_month(with_code(rows))
    starts = bin_starts(coded) if starts is None else starts
    placed = packed(coded.withColumn("_curva", curve(starts)), [MONTH])
    # By ranges, so that a large month is split along the curve and not across it.
    ordered = placed.repartitionByRange(MONTH, "_curva").sortWithinPartitions(MONTH, "_curva")
    (
        unpacked(ordered, coded.columns)
        .write.mode("overwrite")
        .options(**{"compression": CODEC} | options)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(MONTH)
        .parquet(path)
    )
