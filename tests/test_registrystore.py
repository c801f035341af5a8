"""The stored roster: changes rewrite touched files only, versions take effect as a whole."""

import pytest

from precolens.operators import maintenance
from precolens.operators.registrystore import RegistryStore
from precolens.schemas import ROSTER


@pytest.fixture
def roster(spark):
    types = ["master", "tecnico", "administrador"]
    rows = [(i, f"N{i}", f"n{i}@x", types[i % 3], None, int(i % 5 > 0)) for i in range(400)]
    return spark.createDataFrame(rows, ROSTER)


@pytest.fixture
def store(spark, roster, tmp_path):
    found = RegistryStore(spark, str(tmp_path / "r"))
    assert found.version() == 0 and found.read().isEmpty()
    assert found.create(roster) == 1
    return found


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_update_keeps_untouched_files(spark, store, roster):
    changes = spark.createDataFrame([(1, 7, "a@b", None), (2, 7, None, "A"), (3, 9_000, "x", "x"), (4, 9, "c@d", None)], "seq long, id long, email string, area string")
    before = store.files()
    assert store.update(changes, ["email", "area"]) == 2
    after = store.files()
    assert len(set(before) & set(after)) == len(before) - 1 and len(before) > 4
    assert rows(store.read()) == rows(maintenance.update_keyed(roster, changes, ["email", "area"]))
    assert rows(store.read(1)) == rows(roster)


def test_delete_and_insert(spark, store, roster):
    keys = spark.createDataFrame([(i,) for i in (1, 3, 4, 9_000)], "id long")
    assert store.delete(keys) == 2
    gone = maintenance.delete_keys(roster, keys)
    assert rows(store.read()) == rows(gone)
    batch = spark.createDataFrame(
        [(1, 5_000, " New ", "e@x", "tecnico", ""), (2, 5_001, "N8", "e@x", "tecnico", None), (3, 1, "Again", None, "master", None), (4, 8, "Other", None, "master", None)],
        "seq long, id long, nome string, email string, tipo string, area string",
    )
    before = store.files()
    assert store.insert(batch) == 3
    assert set(before) < set(store.files())
    assert rows(store.read()) == rows(maintenance.insert_new(gone, batch))


def test_nothing_touched_makes_no_version(spark, store):
    assert store.delete(spark.createDataFrame([(77_777,)], "id long")) == 1
    assert store.delete(spark.createDataFrame([], "id long")) == 1


def test_a_version_is_made_once_and_unfinished_ones_do_not_count(spark, store, roster, tmp_path):
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        store._publish(store.files(), 0)
    (tmp_path / "r" / "versoes" / "0000000002").mkdir()
    assert store.version() == 1 and rows(store.read()) == rows(roster)


def test_only_keys_are_read_to_find_touched_files(spark, store):
    keys = spark.createDataFrame([(5,)], "id long")
    assert len(store.touched(keys, store.files())) == 1


def test_delete_outcomes_are_one_per_id(spark, roster):
    both = roster.unionByName(spark.createDataFrame([(0, "Z", None, "tecnico", None, 1), (4, "Y", None, "tecnico", None, 1)], ROSTER))
    keys = spark.createDataFrame([(0,), (3,), (4,), (4,), (900,)], "id long")
    got = {r.id: r.resultado for r in maintenance.delete_outcomes(both, keys).collect()}
    assert got == {0: "removido", 3: "protegido", 4: "removido", 900: "nao_encontrado"}
    assert maintenance.delete_outcomes(both, keys).count() == 4
