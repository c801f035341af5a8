from collections import Counter

import pytest
from precolens.llm import sharding
from precolens.llm.oracles import _owners

NAMES = [f"s{i}" for i in range(10)]


def test_table_equals_one_from_written_out_preferences():
    for slots in (11, 101, 1009):
        assert [NAMES[s] for s in sharding.lookup_table(NAMES, slots)] == _owners(NAMES, slots)


def test_shares_are_equal_and_order_of_names_is_no_matter():
    table = sharding.lookup_table(NAMES)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    other = sharding.lookup_table(NAMES[::-1])
    assert [NAMES[s] for s in table] == [NAMES[::-1][s] for s in other]


def test_few_slots_move_when_a_shard_goes():
    table = [NAMES[s] for s in sharding.lookup_table(NAMES)]
    fewer = [NAMES[s] for s in sharding.lookup_table(NAMES[:-1])]
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != NAMES[-1])
    assert moved < 0.1 * len(table)


@pytest.mark.parametrize("bad", [([], 11), (["a", "a"], 11), (["a"], 12), (NAMES, 7)])
def test_refused(bad):
    with pytest.raises(ValueError):
        sharding.lookup_table(*bad)


def test_rows_stay_with_clashing_names_nulls_and_hot_keys(spark):
    rows = spark.createDataFrame([("a", 1)] * 50 + [(None, 2), ("", 3), ("é", 4)], "key string, slot int")
    got = sharding.place(rows, "key", NAMES)
    assert got.columns == ["key", "slot", "slot_", "shard"] and got.count() == 53
    assert len({r.shard for r in got.where("key = 'a'").collect()}) == 1
    assert len({r.shard for r in got.where("key is null or key = ''").collect()}) == 1
    assert sharding.place(rows.limit(0), "key", NAMES).count() == 0
    assert sharding.place(rows, "key", ["only"], 2).where("shard = 'only'").count() == 53


def test_plan_is_native_and_unshuffled(spark, folder):
    plan = sharding.place(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", NAMES)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Python" not in plan and "Arrow" not in plan


def test_written_shards(spark, tmp_path):
    rows = sharding.place(spark.range(500), "id", NAMES)
    sharding.write_shards(rows, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 500 and {r.shard for r in back.select("shard").distinct().collect()} == set(NAMES)
