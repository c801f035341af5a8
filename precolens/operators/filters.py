"""Optional AND-ed filters on the fact table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_ignoring_case, supplier_code
from ..schemas import MONTH


@dataclass(frozen=True)
class FilterSpec:
    """One value per filter; ``None`` or empty means no filter, for the two searches also blank."""

    cod_informante: str | None = None
    nome_informante: str | None = None
    marca: str | None = None
    tipo_preco: str | None = None
    uf: str | None = None
    data_apos: date | str | None = None
    ean_sku: str | None = None
    busca_texto: str | None = None

    @classmethod
    def of(cls, values: Mapping[str, object]) -> FilterSpec:
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown filters: {', '.join(sorted(unknown))}")
        return cls(**values)

    def _given(self, name: str) -> str | None:
        value = getattr(self, name)
        text = "" if value is None else value.isoformat() if isinstance(value, date) else str(value)
        if name in ("ean_sku", "busca_texto"):
            text = text.strip()
        return text or None

    def predicates(self, rows: DataFrame) -> list[Column]:
        """The conditions present, on the fact table's or the enriched view's columns."""
        found = []
        if (code := self._given("cod_informante")) is not None:
            found.append(supplier_code(rows) == F.lit(code))
        for name in ("nome_informante", "marca", "tipo_preco", "uf"):
            if (value := self._given(name)) is not None:
                found.append(F.col(name) == F.lit(value))
        if (since := self._given("data_apos")) is not None:
            # Inclusive and on the text itself, as the column is stored.
            found.append(F.col("data_coleta") >= F.lit(since))
            if MONTH in rows.columns:
                # A text not below the date has a prefix not below the date's: prunes whole months.
                found.append(F.col(MONTH) >= F.lit(since[:7]))
        if (code := self._given("ean_sku")) is not None:
            found.append((F.col("ean") == F.lit(code)) | (F.col("sku") == F.lit(code)))
        if (term := self._given("busca_texto")) is not None:
            found.append(contains_ignoring_case(F.col("descricao"), term))
        return found

    def apply(self, rows: DataFrame) -> DataFrame:
        """Rows that meet every condition; all rows when there is none."""
        return rows.where(reduce(and_, self.predicates(rows), F.lit(True)))
