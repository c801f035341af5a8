"""Labelled, formatted export of enriched rows, and its column widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lenient_date, price_text
from ..schemas import COLUMN_LABELS, PRICE_COLUMNS

# Room added to the longest value of a column, and the widest a column may be.
WIDTH_MARGIN = 4
WIDTH_LIMIT = 60


def _shown(column: str) -> Column:
    if column in PRICE_COLUMNS:
        return price_text(F.col(column))
    if column == "data_coleta":
        return F.date_format(lenient_date(F.col(column)), "dd/MM/yyyy")
    return F.col(column)


def formatted(rows: DataFrame) -> DataFrame:
    """Rows under their export labels, prices and dates as text; a column without label keeps its name."""
    return rows.select(*[_shown(c).alias(COLUMN_LABELS.get(c, c)) for c in rows.columns])


def filled_columns(rows: DataFrame) -> DataFrame:
    """Rows (coluna, rotulo, preenchidas): each column, its export label and how many cells are not blank."""
    counted = formatted(rows).agg(*[F.count(f"`{COLUMN_LABELS.get(c, c)}`").alias(c) for c in rows.columns])
    cells = [
        F.struct(F.lit(c).alias("coluna"), F.lit(COLUMN_LABELS.get(c, c)).alias("rotulo"), F.col(c).alias("preenchidas"))
        for c in rows.columns
    ]
    return counted.select(F.inline(F.array(*cells)))


def write_export(rows: DataFrame, path: str) -> None:
    """Formatted rows as CSV files with a header; the files' order is the rows' order, NULL is blank."""
    (
        formatted(rows)
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .csv(path)
    )


def _plain_number(number: Column) -> Column:
    """Text of a number in digits, without an exponent, as a sheet cell would give it."""
    text = number.cast("string")
    digits = F.rtrim(text.try_cast("decimal(38,10)").cast("string"), F.lit("0"))
    positional = F.when(F.endswith(digits, F.lit(".")), F.concat(digits, F.lit("0"))).otherwise(digits)
    return F.when(F.contains(text, F.lit("E")), F.coalesce(positional, text)).otherwise(text)


def _cell_length(column: str) -> Column:
    value = F.col(column)
    if column in PRICE_COLUMNS:
        value = F.when(~F.isnan(value.try_cast("double")), _plain_number(value))
    elif column == "data_coleta":
        value = lenient_date(value)
    return F.length(value.cast("string"))


def column_widths(rows: DataFrame) -> DataFrame:
    """Rows (coluna, largura): longest value or header of each column plus a margin, in one pass."""
    longest = rows.agg(*[F.max(_cell_length(c)).alias(c) for c in rows.columns])
    widths = [
        F.struct(
            F.lit(label).alias("coluna"),
            F.least(
                F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(len(label))) + WIDTH_MARGIN,
                F.lit(WIDTH_LIMIT),
            ).alias("largura"),
        )
        for c, label in ((c, COLUMN_LABELS.get(c, c)) for c in rows.columns)
    ]
    return longest.select(F.inline(F.array(*widths)))
