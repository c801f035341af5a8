"""Selection algebra against Python sets, and rows of a selection."""

import random

import pytest

from precolens import session
from precolens.operators import selection
from precolens.operators.enrich import FanOut, count_rows


@pytest.fixture
def ids(spark):
    return lambda values: spark.createDataFrame([(v,) for v in values], "id_produto string")


def found(df):
    values = [r.id_produto for r in df.collect()]
    assert len(values) == len(set(values))
    return set(values)


@pytest.mark.parametrize("seed", range(4))
def test_algebra_is_that_of_sets(ids, fact, seed):
    rnd = random.Random(seed)
    some = lambda: [rnd.choice("abcdefghij") for _ in range(rnd.randrange(0, 12))]
    before, page, rows = some(), some(), some()
    chosen = [p for p in page if rnd.random() < 0.5]
    expected = (set(before) - (set(page) - set(chosen))) | set(chosen)
    after = selection.reconcile(ids(before), ids(page), ids(chosen))
    assert found(after) == expected
    assert found(selection.reconcile(after, ids(page), ids(chosen))) == expected
    assert found(selection.deselected(ids(page), ids(chosen))) == set(page) - set(chosen)
    assert selection.changed(ids(before), after).first().mudou == (set(before) != expected)
    assert found(selection.select_all(ids(before), fact(*[{"id_produto": i} for i in rows]))) == set(before) | set(rows)
    assert selection.count_selected(ids(before)).first().selecionados == len(set(before))


def flags(selected, rows, codes):
    row = selection.all_selected(selected, rows, count_rows(rows, FanOut(codes))).first()
    return row.total, row.selecionados, row.todos, row.todos_exato


def test_all_selected_by_count_and_exactly(ids, fact, registry):
    rows = fact(*[{"id_produto": p, "cod_informante": ["1"]} for p in ("a", "a", "b")])
    assert flags(ids("ab"), rows, registry()) == (3, 2, False, True)
    # Ids from other filters count towards the number.
    assert flags(ids("axy"), rows, registry()) == (3, 3, True, False)
    assert flags(ids(""), fact(), registry()) == (0, 0, False, False)
    assert flags(ids("ab"), rows, registry((1, "b", "x", 1), (1, "b", "y", 1))) == (4, 2, False, True)


@pytest.mark.parametrize("limit", [0, session.BROADCAST_BYTES])
def test_rows_of_a_selection_ignore_filters(ids, fact, registry, monkeypatch, limit):
    monkeypatch.setattr(session, "BROADCAST_BYTES", limit)
    rows = fact(
        *[{"id_produto": "a", "cod_informante": ["1"], "data_coleta": d} for d in ("2024-01-01", "2024-03-01", None, "2024-02-01")],
        {"id_produto": "b", "data_coleta": "2024-01-01"},
        {"id_produto": None, "data_coleta": "2024-01-01"},
    )
    picked = selection.rows_by_ids(rows, registry((1, "a", "INS", 3), (1, "b", "x", 1)), ids(["a", "a", "zz", None]))
    got = [(r.data_coleta, r.cod_insumo) for r in picked.collect()]
    assert got == [("2024-03-01", "INS"), ("2024-02-01", "INS"), ("2024-01-01", "INS"), (None, "INS")]
    marked = selection.mark_selected(rows.select("id_produto", "data_coleta"), ids(["a", "a"]))
    assert sorted(r.selecionado for r in marked.collect()) == [False, False, True, True, True, True]


def test_copies_stay_in_an_ordered_selection(ids, fact, registry):
    rows = fact(
        *[{"id_produto": "a", "cod_informante": ["1"], "data_coleta": "2024-01-02"}] * 8,
        *[{"id_produto": "a", "cod_informante": ["1"], "data_coleta": "2024-01-03"}] * 3,
        {"id_produto": "a", "data_coleta": "2024-01-01"},
    )
    picked = selection.rows_by_ids(rows, registry((1, "a", "x", 1), (1, "a", "x", 1), (1, "a", "y", 1)), ids("a"))
    got = [(r.data_coleta, r.cod_insumo) for r in picked.collect()]
    assert got == (
        [("2024-01-03", "x")] * 6 + [("2024-01-03", "y")] * 3 + [("2024-01-02", "x")] * 16
        + [("2024-01-02", "y")] * 8 + [("2024-01-01", None)]
    )


def test_box_for_all_rows(ids, fact, registry):
    rows, codes = fact(*[{"id_produto": p, "cod_informante": ["1"]} for p in "abc"]), registry()
    total = count_rows(rows, FanOut(codes))
    after = lambda chosen, ticked: found(selection.toggle_all(ids(chosen), rows, total, ticked))
    assert after("a", True) == {"a", "b", "c"}
    assert after("abc", False) == set() == found(selection.cleared(ids("ab")))
    assert after("ab", False) == {"a", "b"}


def test_empty_selection(ids, fact, registry):
    rows = fact({"id_produto": "a"})
    assert selection.rows_by_ids(rows, registry(), ids([])).isEmpty()
