"""Blocked postings: searches and whole index as from single rows, stored as differences, blocks that can't match unread."""

from pathlib import Path

import pyarrow.parquet as pq
import pytest

from precolens.operators import postings, textindex
from precolens.operators.bitmaps import NUMBER

PHRASES = ["ring", "small ring", "ring small Nestle", "rare ring", "rare", "nowhere ring", "sabao em po", "BRAND 7", "ring ring"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(3000).selectExpr(
        "concat('P', id % 2500) as id_produto",
        "concat('ring ', if(id % 3 = 0, 'small ', ''), if(id in (7, 2107), 'rare ', ''), if(id % 50 = 1, 'Sabão em Pó Nestlé', '')) as descricao",
        "if(id % 10 = 0, null, concat('brand ', id % 9)) as marca",
    )


@pytest.fixture(scope="module")
def small_blocks():
    patch = pytest.MonkeyPatch()
    patch.setattr(postings, "BLOCK_BITS", 5)
    yield
    patch.undo()


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory, small_blocks):
    """Written from a part of the rows and extended twice, once by products it has."""
    path = str(tmp_path_factory.mktemp("blocos"))
    number = rows.id_produto.substr(2, 9).cast("int")
    postings.write_postings(rows.where(number < 1000), path)
    postings.extend_postings(rows.where(number >= 1000), path)
    postings.extend_postings(rows.where(number < 100), path)
    return path


@pytest.mark.parametrize("phrase", PHRASES)
def test_search_equals_the_plain_index(spark, rows, index, phrase):
    plain = textindex.build_index(rows)
    for columns in (textindex.INDEXED, ["marca"]):
        want = sorted(r[0] for r in textindex.search(plain, phrase, columns).collect())
        assert sorted(r[0] for r in postings.search(spark, index, phrase, columns).collect()) == want


def test_many_blocks_are_joined(spark, rows, index, monkeypatch):
    monkeypatch.setattr(postings, "LISTED", 1)
    want = sorted(r[0] for r in textindex.search(textindex.build_index(rows), "small nestle").collect())
    assert want and sorted(r[0] for r in postings.search(spark, index, "small nestle").collect()) == want


def test_whole_index_with_counts(spark, rows, index):
    number = rows.id_produto.substr(2, 9).cast("int")
    want = textindex.build_index(rows.unionByName(rows.where(number < 100)))
    assert sorted(map(tuple, postings.read_postings(spark, index).select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_only_blocks_of_the_rarest_word_are_read(spark, index):
    order, read = postings.matching_blocks(spark, index, ["rare", "ring"])
    assert order == ["rare", "ring"]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [balde" in plan and "In(bloco" in plan.replace("EqualTo(bloco", "In(bloco") and "vezes" not in plan
    everywhere = spark.read.parquet(f"{index}/blocos").where("token = 'ring'").select("bloco").distinct().count()
    assert read.where("token = 'ring'").select("bloco").distinct().count() <= 2 < everywhere


def test_blocks_are_bounded_and_stored_as_differences(spark, index):
    blocks = spark.read.parquet(f"{index}/blocos")
    assert blocks.where("n > 32 or n <> size(lugares) or primeiro <> array_min(lugares) or ultimo <> array_max(lugares) or lugares <> array_sort(lugares)").isEmpty()
    file = next(f for f in Path(index, "blocos").rglob("*.parquet"))
    group = pq.ParquetFile(file).metadata.row_group(0)
    chunks = {group.column(c).path_in_schema: group.column(c) for c in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in chunks["lugares.list.element"].encodings


def test_numbers_have_no_gaps_and_stay(spark, index):
    numbers = spark.read.parquet(f"{index}/numeros")
    found = sorted(r[0] for r in numbers.select(NUMBER).collect())
    assert found == list(range(2500)) and numbers.select("id_produto").distinct().count() == 2500


def test_no_rows_and_no_words(spark, rows, tmp_path):
    path = str(tmp_path / "empty")
    postings.write_postings(rows.limit(0), path)
    assert postings.search(spark, path, "ring").count() == 0
    postings.extend_postings(rows.limit(5), path)
    assert postings.search(spark, path, "ring").count() == 5
    with pytest.raises(ValueError):
        postings.search(spark, path, " - ")
