"""Table schemas, the visible column list and the export labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _L = T.StringType(), T.DoubleType(), T.LongType()

COLETA = T.StructType(
    [
        T.StructField("data_coleta", _S),
        T.StructField("plataforma", _S),
        T.StructField("cod_informante", T.ArrayType(_S)),
        T.StructField("nome_informante", _S),
        T.StructField("periodicidade", _S),
        T.StructField("tipo_preco", _S),
        T.StructField("ean", _S),
        T.StructField("sku", _S),
        T.StructField("url", _S),
        T.StructField("descricao", _S),
        T.StructField("marca", _S),
        T.StructField("uf", _S),
        T.StructField("moeda", _S),
        T.StructField("preco", _D),
        T.StructField("preco_promocional", _D),
        T.StructField("id_produto", _S),
        T.StructField("id_coleta", _S),
        T.StructField("id_imagem", _S),
    ]
)

CADASTRO = T.StructType(
    [
        T.StructField("cod_informante", _L),
        T.StructField("id_produto_site", _S),
        T.StructField("cod_insumo", _S),
        T.StructField("insumo_informado", _L),
    ]
)

ROSTER = T.StructType(
    [
        T.StructField("id", _L, False),
        T.StructField("nome", _S, False),
        T.StructField("email", _S),
        T.StructField("tipo", _S, False),
        T.StructField("area", _S),
        T.StructField("ativo", T.IntegerType(), False),
    ]
)

# The visible columns in display order, each with its export label.
COLUMN_LABELS = {
    "data_coleta": "Data Coleta",
    "plataforma": "Plataforma",
    "cod_informante": "Cód. Informante",
    "nome_informante": "Nome Informante",
    "periodicidade": "Periodicidade",
    "tipo_preco": "Tipo Preço",
    "cod_insumo": "Cód. Insumo",
    "ean": "EAN",
    "sku": "SKU",
    "insumo_informado": "Insumo Informado",
    "url": "URL",
    "descricao": "Descrição",
    "marca": "Marca",
    "uf": "UF",
    "moeda": "Moeda",
    "preco": "Preço (R$)",
    "preco_promocional": "Preço Promo (R$)",
    "id_produto": "ID Produto",
    "id_coleta": "ID Coleta",
    "id_imagem": "ID Imagem",
}

VISIBLE_COLUMNS = list(COLUMN_LABELS)

# Partition column of tables stored by month.
MONTH = "mes_coleta"

PRICE_COLUMNS = ("preco", "preco_promocional")

_REGISTRY_COLUMNS = {"cod_insumo": _S, "insumo_informado": _L}

ENRICHED = T.StructType(
    [
        T.StructField(c, _REGISTRY_COLUMNS[c] if c in _REGISTRY_COLUMNS else COLETA[c].dataType)
        if c != "cod_informante"
        else T.StructField(c, _S)
        for c in VISIBLE_COLUMNS
    ]
)


def empty(spark: SparkSession, schema: T.StructType = ENRICHED) -> DataFrame:
    """The empty relation of a known schema."""
    return spark.createDataFrame([], schema)


def add_missing_columns(
    df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None
) -> DataFrame:
    """Additive migration: columns of ``schema`` absent from ``df`` arrive typed, NULL or with a constant."""
    defaults = defaults or {}
    new = {
        f.name: F.lit(defaults.get(f.name)).cast(f.dataType)
        for f in schema
        if f.name not in df.columns
    }
    return df.withColumns(new) if new else df


def _conformed(df: DataFrame, field: T.StructField) -> Column:
    found = df.schema[field.name].dataType
    if found == field.dataType:
        return F.col(field.name)
    if isinstance(field.dataType, T.ArrayType) and not isinstance(found, T.ArrayType):
        # The flat variant of the fact table carries one scalar code. It stays a plain column,
        # so that filters and joins on it reach the scan.
        return F.col(field.name).cast(field.dataType.elementType).alias(field.name)
    return F.col(field.name).cast(field.dataType).alias(field.name)


def conform(df: DataFrame, schema: T.StructType, required: Sequence[str] = ()) -> DataFrame:
    """``df`` brought to ``schema``: missing columns added, types aligned, extra columns left out."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    df = add_missing_columns(df, schema)
    return df.select(*[_conformed(df, f) for f in schema])
