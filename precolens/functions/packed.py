"""Whole rows made smaller for a shuffle or a sort: their texts as one text.

A row of many texts holds eight bytes for each one's place and length. They differ from row to row, so a shuffle's
compression gains little from them: rows of the price tables take a third less with their texts as one, and fewer bytes in memory.
Only for rows that are wanted whole, as columns that are not needed are not left out any more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Between texts, and in place of a NULL. Texts with one of them are not put together.
_BETWEEN, _NULL = "\x1f", "\x1e"

_TEXT, _PARTS, _WHOLE = "_texto", "_partes", "_inteiros"


def packed(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Rows with one text for all text columns but those of ``keep``; :func:`unpacked` undoes it.

    A row whose texts hold a separator, or bytes that are no UTF-8, takes them along as they are.
    """
    names = [f.name for f in rows.schema if f.dataType == T.StringType() and f.name not in keep]
    texts = [F.col(f"`{n}`") for n in names]
    other = [F.col(f"`{c}`") for c in rows.columns if c not in names]
    if not names:
        return rows
    joined, plain = F.concat_ws(_BETWEEN, *[F.coalesce(t, F.lit(_NULL)) for t in texts]), F.concat_ws("", *texts)
    odd = F.contains(plain, F.lit(_BETWEEN)) | F.contains(plain, F.lit(_NULL)) | ~F.is_valid_utf8(joined)
    return rows.select(*other, F.when(~odd, joined).alias(_TEXT), F.when(odd, F.struct(*texts)).alias(_WHOLE))


def unpacked(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` of packed rows, to which others may have been added since."""
    if _WHOLE not in rows.columns:
        return rows.select(*[f"`{c}`" for c in columns])
    at = {n: i for i, n in enumerate(rows.schema[_WHOLE].dataType.fieldNames())}

    def value(name: str) -> Column:
        if name not in at:
            return F.col(f"`{name}`")
        part = F.nullif(F.get(_PARTS, F.lit(at[name])), F.lit(_NULL))
        return F.coalesce(F.col(_WHOLE).getField(name), part).alias(name)

    return rows.withColumn(_PARTS, F.split(_TEXT, _BETWEEN)).select(*map(value, columns))
