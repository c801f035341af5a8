"""Substring search by the gram index: against the filter by text, and what it reads."""

import pytest
from pyspark.sql import functions as F

from precolens.operators import gramindex
from precolens.operators.filters import FilterSpec

TEXTS = [
    "Sabão em Pó Nestlé 500g", "small RING brand", "ring", "ri", "", None, "a_b", "a\\b ring", "100% ring", "Ring ring ring", "strings",
    "ra ing", "r%ng", "İstanbul ring", "漢字の環", "big green ringlet",
]
TERMS = ["ring", " RING ", "ri", "r%ng", "r_ng", "sab%nest", "ão em", "a\\b", "_", "%", "ring%ring", "zzz", "環", "字の環", "ringlet%x", "İst", "small_ring"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("gramas"))
    rows = spark.createDataFrame([(t,) for t in TEXTS], "descricao string")
    gramindex.write_gram_index(rows.where("descricao not like '%ring%'"), path)
    gramindex.extend_gram_index(rows, path)
    gramindex.extend_gram_index(rows, path)
    return path


@pytest.mark.parametrize("term", TERMS)
def test_search_equals_the_filter(spark, fact, index, term):
    rows = fact(*[{"descricao": t, "id_produto": str(i)} for i, t in enumerate(TEXTS + TEXTS[:3])])
    want = sorted(r.id_produto for r in FilterSpec(busca_texto=term).apply(rows).collect())
    assert sorted(r.id_produto for r in gramindex.search(rows, index, term).collect()) == want


def test_many_descriptions_are_joined(spark, fact, index, monkeypatch):
    monkeypatch.setattr(gramindex, "LISTED", 1)
    rows = fact(*[{"descricao": t, "id_produto": str(i)} for i, t in enumerate(TEXTS)])
    found = gramindex.search(rows, index, "ring")
    assert found.columns == rows.columns
    assert sorted(r.id_produto for r in found.collect()) == sorted(r.id_produto for r in FilterSpec(busca_texto="ring").apply(rows).collect())


def test_each_description_is_indexed_once(spark, index):
    texts = spark.read.parquet(f"{index}/textos")
    assert texts.count() == len({t for t in TEXTS if t is not None})
    grams = spark.read.parquet(f"{index}/gramas")
    assert grams.count() == grams.select("grama", "texto").distinct().count()


def test_only_the_terms_buckets_and_candidates_are_read(spark, fact, index, tmp_path):
    found = gramindex.candidates(spark, index, "ring")
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "In(grama" in text and "PartitionFilters: [balde" in text
    assert {r.descricao for r in found.collect()} == {t for t in TEXTS if t and "rin" in t.lower() and "ing" in t.lower()}
    fact(*[{"descricao": t} for t in TEXTS]).select("descricao", "preco").write.parquet(str(tmp_path / "f"))
    read = gramindex.search(spark.read.parquet(str(tmp_path / "f")), index, "sab%nest")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(descricao,Sabão em Pó Nestlé 500g)" in plan and "LIKE" not in plan
    assert read.where(F.col("descricao").isNotNull()).count() == 1
