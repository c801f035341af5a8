"""Hand-made edge rows: arrays, keys, dates, patterns, accents, quotes, fan-out, empty tables."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from precolens.functions.text import capitalised, folded, lenient_date, price_text, search_terms, tokens, zero_padded
from precolens.operators import facets, paging
from precolens.operators.enrich import FanOut, count_rows, enrich, filtered_ids, page_count, repeated_keys
from precolens.operators.filters import FilterSpec
from precolens.schemas import (
    CADASTRO, COLETA, ENRICHED, ROSTER, VISIBLE_COLUMNS, add_missing_columns, conform, empty,
)
from precolens.sources.tables import register_views, run_query


def values(df, column):
    return sorted((r[column] for r in df.collect()), key=lambda v: (v is None, v))


def one_column(spark, column, *cells, kind="string"):
    return spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, {column} {kind}").orderBy("i")


def test_first_element_of_short_and_null_arrays(fact, registry):
    rows = fact(
        {"id_coleta": "a", "cod_informante": []},
        {"id_coleta": "b", "cod_informante": None},
        {"id_coleta": "c", "cod_informante": [None]},
        {"id_coleta": "d", "cod_informante": ["1", "2"]},
    )
    codes = {r.id_coleta: r.cod_informante for r in enrich(rows, registry()).collect()}
    assert codes == {"a": None, "b": None, "c": None, "d": "1"}
    # The facet drops the NULL array but keeps the NULL that an empty array yields, last.
    assert [r.cod_informante for r in facets.supplier_codes(rows).collect()] == ["1", None]


def test_key_is_compared_as_exact_text(fact, registry):
    rows = fact(
        {"cod_informante": ["12"], "id_produto": "P"},
        {"cod_informante": ["012"], "id_produto": "P"},
        {"cod_informante": ["INF001"], "id_produto": "P"},
    )
    joined = enrich(rows, registry((12, "P", "INS", 7)))
    assert {r.cod_informante: r.cod_insumo for r in joined.collect()} == {"12": "INS", "012": None, "INF001": None}


def test_enriched_columns_in_order(fact, registry):
    joined = enrich(fact(), registry())
    assert joined.columns == VISIBLE_COLUMNS
    assert [f.dataType for f in joined.schema] == [f.dataType for f in ENRICHED]


def test_fan_out_is_kept_and_counted(fact, registry):
    rows = fact(*[{"cod_informante": ["1"], "id_produto": p} for p in "PPQR"])
    codes = registry((1, "P", "a", 1), (1, "P", "b", 2), (1, "P", "b", 2), (1, "Q", "c", 3), (None, "R", "x", 1), (None, "R", "y", 1))
    joined = enrich(rows, codes)
    fan_out = FanOut(codes)
    assert joined.count() == 8
    assert count_rows(rows, fan_out).first().cnt == 8
    assert values(filtered_ids(rows, fan_out), "id_produto") == list("PPPPPPQR")
    assert [tuple(r) for r in repeated_keys(codes).collect()] == [("1", "P", 3)]


def test_empty_table(fact, registry):
    none = fact()
    assert facets.date_bounds(none).first().asDict() == {"data_min": None, "data_max": None}
    assert facets.facet_values(none).isEmpty()
    total = count_rows(none, FanOut(registry()))
    assert page_count(total).first().asDict() == {"cnt": 0, "paginas": 1}


def test_filter_options_as_a_stored_table(fact, spark, tmp_path):
    rows = fact(
        {"marca": "B", "data_coleta": "2024-01-02", "cod_informante": ["7"]},
        {"marca": "B", "data_coleta": "2024-01-01", "cod_informante": []},
        {"cod_informante": None},
    )
    path = str(tmp_path / "opcoes")
    facets.write_options(rows, path)
    assert [tuple(r) for r in facets.read_options(spark, path).collect()] == [
        ("cod_informante", "7"), ("cod_informante", None), ("data_max", "2024-01-02"), ("data_min", "2024-01-01"), ("marca", "B"),
    ]


def test_facets_skip_null_and_keep_other_filters_out(fact):
    rows = fact({"marca": "B", "uf": "SP"}, {"marca": "A"}, {"marca": "B"})
    assert [tuple(r) for r in facets.facet_values(rows).collect()] == [("marca", "A"), ("marca", "B"), ("uf", "SP")]


@pytest.mark.parametrize(
    "term, found",
    [
        ("a\\b", ["a\\b c"]),
        ("a_b", ["a%b c", "a\\b c", "axb c"]),
        ("a%b", ["a%b c", "a\\b c", "axb c"]),
        ("  AXB  ", ["axb c"]),
        ("   ", ["a%b c", "a\\b c", "axb c", None]),
        ("\\", ["a\\b c"]),
    ],
)
def test_pattern_wildcards_and_backslash(fact, term, found):
    rows = fact(*[{"descricao": d} for d in ("a\\b c", "a%b c", "axb c", None)])
    assert values(FilterSpec(busca_texto=term).apply(rows), "descricao") == found


def test_substring_respects_accents(fact):
    rows = fact({"descricao": "Sabão em Pó Nestlé 500g"})
    assert FilterSpec(busca_texto="SABÃO").apply(rows).count() == 1
    assert FilterSpec(busca_texto="sabao").apply(rows).count() == 0
    assert FilterSpec(busca_texto="sabão pó nestlé").apply(rows).count() == 0


def test_a_blank_facet_value_is_a_value(fact):
    rows = fact({"marca": " "}, {"marca": "x"}, {"marca": None})
    assert values(FilterSpec(marca=" ").apply(rows), "marca") == [" "]
    for blank in ({"marca": ""}, {"busca_texto": " "}, {"ean_sku": "\t"}, {"marca": None}):
        assert FilterSpec(**blank).apply(rows).count() == 3


def test_quotes_in_values(fact, spark, registry):
    rows = fact({"marca": "L'Oréal"}, {"marca": "x"})
    assert FilterSpec(marca="L'Oréal").apply(rows).count() == 1
    register_views(rows, registry())
    assert run_query(spark, "select marca from enriquecida where marca = :m", m="L'Oréal").count() == 1
    assert run_query(spark, "select count(*) as n from coleta").first().n == 2


def test_filters_combine_and_blank_means_absent(fact):
    rows = fact(
        {"marca": "A", "uf": "SP", "ean": "1", "sku": "s", "data_coleta": "2024-05-01", "cod_informante": ["9"]},
        {"marca": "A", "uf": "RJ", "ean": "2", "sku": "1", "data_coleta": "2024-05-02", "cod_informante": ["8", "9"]},
        {"marca": "B", "uf": "SP", "ean": "3", "sku": "t", "data_coleta": None},
    )
    count = lambda **f: FilterSpec.of(f).apply(rows).count()
    assert count() == 3
    assert count(marca="", uf="", busca_texto="  ", data_apos=None) == 3
    assert count(marca="A", uf="SP") == 1
    assert count(ean_sku=" 1 ") == 2
    assert count(cod_informante="9") == 1
    assert count(data_apos=date(2024, 5, 2)) == 1
    assert count(data_apos="2024-05-01") == 2
    with pytest.raises(ValueError, match="cor"):
        FilterSpec.of({"cor": "azul"})


def test_date_filter_compares_text(fact):
    rows = fact(*[{"data_coleta": d} for d in ("2024-05-01", "xx", "", None, "2024-05-01 10:20:30")])
    kept = values(FilterSpec(data_apos="2024-05-01").apply(rows), "data_coleta")
    assert kept == ["2024-05-01", "2024-05-01 10:20:30", "xx"]


def test_lenient_dates(spark):
    rows = one_column(spark, "t", "2024-05-01", "xx", "", None, "2024-05-01 10:20:30")
    got = [r.d for r in rows.select(lenient_date(F.col("t")).alias("d")).collect()]
    assert got == [date(2024, 5, 1), None, None, None, date(2024, 5, 1)]


def test_price_text(spark):
    rows = one_column(spark, "p", None, 1234.5, 0.0, 2.675, -3.0, float("nan"), kind="double")
    got = [r.t for r in rows.select(price_text(F.col("p")).alias("t")).collect()]
    assert got == [None, "R$ 1,234.50", "R$ 0.00", "R$ 2.68", "-R$ 3.00", None]
    rows = one_column(spark, "p", "12", "sob consulta", None)
    got = [r.t for r in rows.select(price_text(F.col("p")).alias("t")).collect()]
    assert got == ["R$ 12.00", "sob consulta", None]


def test_numbers_longer_than_the_padding_keep_their_digits(spark):
    rows = one_column(spark, "n", 7, 123456, 12345678, kind="bigint")
    got = [r.t for r in rows.select(zero_padded(F.col("n"), 6).alias("t")).collect()]
    assert got == ["000007", "123456", "12345678"]


def test_words(spark):
    rows = one_column(spark, "t", "Sabão em Pó Nestlé 500g", "L'Oréal—ÇA/ça", "Café", None, " ")
    got = [r.t for r in rows.select(tokens(F.col("t")).alias("t")).collect()]
    assert got == [["sabao", "em", "po", "nestle", "500g"], ["l", "oreal", "ca", "ca"], ["cafe"], None, []]
    assert search_terms(spark, "Sabão  PÓ, nestlé cafe\u0301 po") == ["cafe", "nestle", "po", "sabao"]
    assert search_terms(spark, "  -- ") == []
    assert [r.t for r in rows.select(folded(F.col("t")).alias("t")).collect()][1] == "l'oreal—ca/ca"


def test_capitalised_lowers_the_rest(spark):
    rows = one_column(spark, "t", "fiscal DE campo", "x", "", None)
    got = [r.t for r in rows.select(capitalised(F.col("t")).alias("t")).collect()]
    assert got == ["Fiscal de campo", "X", "", None]


def test_conform_accepts_flat_and_decimal_shapes(spark, registry):
    flat = spark.sql(
        "select '2024-05-01' as data_coleta, 'P' as id_produto, c as cod_informante, cast(1.5 as decimal(18,2)) as preco, 1 as a_mais "
        "from values ('12'), (null) as t(c)"
    )
    rows = conform(flat, COLETA, required=["id_produto"])
    assert rows.schema.fieldNames() == COLETA.fieldNames()
    assert {f.name for f in rows.schema if f.dataType != COLETA[f.name].dataType} == {"cod_informante"}
    assert values(rows, "cod_informante") == ["12", None]
    assert values(facets.supplier_codes(rows), "cod_informante") == ["12"]
    assert FilterSpec(cod_informante="12").apply(rows).count() == 1
    assert enrich(rows, registry((12, "P", "INS", 1))).where("cod_insumo = 'INS'").count() == 1
    assert paging.page_topk(rows, registry((12, "P", "INS", 1)), 1).count() == 2
    with pytest.raises(ValueError, match="id_produto_site"):
        conform(flat, CADASTRO, required=["id_produto_site"])


def test_empty_relation_and_added_columns(spark):
    none = empty(spark)
    assert none.isEmpty() and none.columns == VISIBLE_COLUMNS
    older = spark.createDataFrame([(1, "Ana", "tecnico")], "id long, nome string, tipo string")
    rows = add_missing_columns(older, ROSTER, {"ativo": 1})
    assert rows.first().asDict() == {"id": 1, "nome": "Ana", "tipo": "tecnico", "email": None, "area": None, "ativo": 1}
    assert add_missing_columns(rows, ROSTER).columns == rows.columns
