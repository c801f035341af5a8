"""Selections as bitmaps: against sets, numbering without gaps, and what is shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from precolens.operators import bitmaps
from precolens.operators.bitmaps import ID, NUMBER


@pytest.fixture(scope="module")
def numbers(spark):
    found = spark.range(300).select(F.concat(F.lit("P"), F.col("id")).alias(ID))
    return bitmaps.number_products(found.unionAll(found))


def as_bitmap(spark, numbers, ids):
    rows = spark.createDataFrame([(i,) for i in ids], f"{ID} string")
    return bitmaps.bitmap(bitmaps.with_numbers(rows, numbers))


def as_set(selected, numbers):
    found = [r[0] for r in bitmaps.ids(selected, numbers).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_numbers_have_no_gaps_and_stay(spark, numbers):
    known = {r[ID]: r[NUMBER] for r in numbers.collect()}
    assert sorted(known.values()) == list(range(300))
    more = bitmaps.number_products(spark.createDataFrame([("P1",), ("Q1",), ("Q2",), ("Q1",), (None,)], f"{ID} string"), numbers)
    later = {r[ID]: r[NUMBER] for r in more.collect()}
    assert sorted(later.values()) == list(range(302)) and {k: later[k] for k in known} == known
    assert bitmaps.number_products(spark.createDataFrame([], f"{ID} string")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_algebra_against_sets(spark, numbers, seed):
    rng = random.Random(seed)
    some = lambda n: {f"P{rng.randrange(300)}" for _ in range(n)}
    selected, page = some(120), some(30) | {"P0", "P63", "P64", "P299"}
    chosen = {p for p in page if rng.random() < 0.5}
    a, b, c = (as_bitmap(spark, numbers, [*s, *s, None, "unknown"]) for s in (selected, page, chosen))
    assert as_set(bitmaps.select_all(a, b), numbers) == selected | page
    after = bitmaps.reconcile(a, b, c)
    want = (selected - page) | chosen
    assert as_set(after, numbers) == want
    assert as_set(bitmaps.deselected(b, c), numbers) == page - chosen
    assert bitmaps.count_selected(after).first()[0] == len(want)
    assert bitmaps.changed(a, after).first()[0] == (want != selected) and not bitmaps.changed(after, after).first()[0]
    total = spark.createDataFrame([(len(selected | page),)], "cnt long")
    every = bitmaps.all_selected(bitmaps.select_all(a, b), b, total).first()
    assert tuple(every) == (len(selected | page), len(selected | page), True, True)
    assert bitmaps.all_selected(a, b, total).first().todos_exato == (page <= selected)


def test_empty_selections(spark, numbers):
    none, some = as_bitmap(spark, numbers, []), as_bitmap(spark, numbers, ["P5"])
    assert as_set(bitmaps.select_all(none, none), numbers) == set() and bitmaps.count_selected(none).first()[0] == 0
    assert as_set(bitmaps.reconcile(some, some, none), numbers) == set()
    assert bitmaps.changed(none, none).first()[0] is False and bitmaps.changed(none, some).first()[0] is True


def test_ids_are_never_shuffled(spark, numbers, tmp_path):
    fact = spark.range(50_000).select(F.concat(F.lit("P"), F.col("id") % 300).alias(ID), (F.col("id") % 5).alias("marca"))
    bitmaps.with_numbers(fact, numbers).write.parquet(str(tmp_path / "f"))
    stored = spark.read.parquet(str(tmp_path / "f"))
    selected = bitmaps.bitmap(stored.where("marca = 1"))
    text = bitmaps.select_all(selected, bitmaps.bitmap(stored.where("marca = 2")))._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in text and ID not in text
    assert text.count("Exchange hashpartitioning(palavra") == text.count("Exchange")
    assert selected.count() <= 5  # 300 products in words of 64
