"""Co-located storage: the view as joined otherwise, no exchange in its plan, large keys in slices."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from precolens.functions.packed import unpacked
from precolens.operators.enrich import enrich
from precolens.session import written
from precolens.sinks import colocated
from precolens.sinks.colocated import ColocatedStore


@pytest.fixture
def store(spark, tmp_path, request, monkeypatch):
    monkeypatch.setattr(colocated, "ROWS_PER_SLICE", 50)
    made = ColocatedStore(spark, f"juntas_{abs(hash(request.node.name))}", str(tmp_path / "juntas"))
    yield made
    made.drop()


@pytest.fixture
def rows(fact):
    """Some 900 rows: a third on one key and alike in every column, NULL and missing keys."""
    code = lambda i: None if i % 11 == 0 else [] if i % 13 == 0 else [str(i % 7), "ALT"]
    plain = [{"data_coleta": f"2024-01-{i % 28 + 1:02d}", "cod_informante": code(i), "id_produto": f"P{i % 40}" if i % 9 else None, "id_coleta": str(i)} for i in range(600)]
    hot = [{"data_coleta": "2024-02-01", "cod_informante": ["3"], "id_produto": "P3", "id_coleta": "x"}] * 300
    return fact(*plain, *hot)


@pytest.fixture
def codes(registry):
    pairs = [(s, f"P{p}", f"INS{p}", 100 * s + p) for s in range(6) for p in range(0, 40, 3)]
    return registry(*pairs, (3, "P3", "INSX", 7), (3, None, "N", 1), (None, "P3", "N", 2))


def same(found, wanted):
    assert found.columns == wanted.columns
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, wanted.collect()))


def no_exchange(spark, rows):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rows()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return "SortMergeJoin" in plan and "Exchange" not in plan


def test_view_is_joined_without_exchange(spark, store, rows, codes):
    store.create(rows, codes)
    same(store.enriched(), enrich(rows, codes))
    assert no_exchange(spark, store.enriched)


def test_large_key_is_split_over_buckets(spark, store, rows, codes):
    store.create(rows, codes, buckets=16)
    stored = spark.table(store.fact_table)
    hot = stored.where("id_coleta = 'x'").groupBy(colocated.SLICE).count().collect()
    assert len(hot) >= 6 and max(r["count"] for r in hot) <= 60
    per_file = stored.groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in per_file) < 300


def test_keys_are_counted_once_and_in_large_groups_only(spark, store, rows, codes, monkeypatch):
    """A batch is counted once; keys without a large group are not counted, and neighbours in one are not large."""
    calls, counted = [], colocated._large_keys
    monkeypatch.setattr(colocated, "_large_keys", lambda coded: calls.append(counted(coded)) or calls[-1])
    monkeypatch.setattr(colocated, "ROWS_PER_BUCKET", 64)
    small = rows.where("id_coleta <> 'x'").limit(40)
    store.create(small, codes)
    store.append(rows)
    assert [c[0] for c in calls] == [40, 900] and calls[0][1] is None
    assert {(r._codigo, r._produto) for r in calls[1][1].rows.collect()} == {
        (r.cod_informante, r.id_produto) for r in colocated.with_code(rows).groupBy(*colocated.KEY).count().where("count > 50").collect()
    }
    same(store.enriched(), enrich(small.unionByName(rows), codes))
    monkeypatch.setattr(colocated, "KEY_GROUPS", 1)
    assert counted(colocated.with_code(rows))[1].rows.count() == calls[1][1].count
    monkeypatch.setattr(colocated, "MOST_BUCKETS", 9)
    store.create(rows, codes)
    assert store.buckets == 9


def test_append_gives_the_registry_what_it_lacks(spark, store, rows, codes):
    hot, rest = rows.where("id_coleta = 'x'"), rows.where("id_coleta <> 'x'")
    store.create(rest, codes)
    for _ in range(2):
        store.append(hot)
    store.append(rest.limit(0))
    same(store.enriched(), enrich(rows.unionByName(hot), codes))
    assert no_exchange(spark, store.enriched)
    slices = [r[0] for r in spark.table(store.registry_table).where("id_produto = 'P3' and cod_informante = '3'").select(colocated.SLICE).collect()]
    assert Counter(slices) == {i: 2 for i in range(6)}  # both registry rows of the key once in each


def test_another_registry_follows_the_facts_slices(spark, store, rows, codes, registry):
    store.create(rows, codes)
    other = registry((3, "P3", "NOVO", 1), (5, "P6", None, None))
    store.replace_registry(other)
    same(store.enriched(), enrich(rows, other))


def test_empty_tables_and_views_made_before_a_drop(spark, store, rows, codes):
    store.create(rows.limit(0), codes)
    assert store.enriched().count() == 0
    store.append(rows)
    view = store.enriched()
    store.drop()
    same(view, enrich(rows, codes))


def test_tables_are_stored_small_and_a_batch_is_made_once(spark, store, fact, registry, tmp_path, monkeypatch):
    """Buckets are dealt with texts as one and compressed by zstd; what makes an appended batch runs once."""
    stored, dealt = [], []
    monkeypatch.setattr(colocated, "written", lambda df, name: stored.append(name) or written(df, name))
    monkeypatch.setattr(colocated, "unpacked", lambda df, columns: dealt.append(df.columns) or unpacked(df, columns))
    made, runs = fact(*[{"id_produto": f"P{i}", "cod_informante": ["1"], "url": f"u{i}"} for i in range(40)]), spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    store.create(made, registry((1, "P1", "x", 1)), buckets=2)
    store.append(made.where("id_produto < 'P2'").mapInArrow(count, made.schema))
    assert runs.value == 11 + 1 and "lote" in stored
    assert all("_texto" in d and "url" not in d for d in dealt[::2])
    names = [p.name for p in (tmp_path / "juntas").rglob("*.parquet")]
    assert names and all(".zstd." in n for n in names)
    assert store.enriched().where("cod_insumo = 'x'").count() == 2
