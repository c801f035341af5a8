"""Filter options kept by changes, against a full recount."""

from precolens.operators import facetcounts, facets


def rows(fact, *values):
    names = ("data_coleta", "marca", "uf", "cod_informante")
    return fact(*[dict(zip(names, v, strict=True)) for v in values])


def listed(options):
    return [tuple(r) for r in options.collect()]


def test_options_follow_every_change(spark, fact, tmp_path):
    path = str(tmp_path / "c")
    march = rows(fact, ("2024-03-01", "a", "X", ["1"]), ("2024-03-09", "b", None, None), ("2024-03-09", "b", None, []))
    odd = rows(fact, (None, "n", "N", ["9"]), ("", "e", "E", [None]), ("xx", "g", "G", ["9"]))
    facetcounts.replace_months(march.unionByName(odd), path)
    assert listed(facetcounts.stored_options(spark, path)) == listed(facets.filter_options(march.unionByName(odd)))
    april = rows(fact, ("2024-04-02", "a", "Y", ["2", "3"]), ("2024-04-02", "c", "Y", ["2"]))
    facetcounts.add_rows(april, path)
    every = march.unionByName(odd).unionByName(april)
    assert listed(facetcounts.stored_options(spark, path)) == listed(facets.filter_options(every))
    # A month replaced: what only it had is gone; a row removed: its values stay while others have them.
    march = rows(fact, ("2024-03-05", "d", "X", ["1"]))
    facetcounts.replace_months(march, path)
    facetcounts.add_rows(april.where("marca = 'c'"), path, sign=-1)
    now = march.unionByName(odd).unionByName(april.where("marca = 'a'"))
    assert listed(facetcounts.stored_options(spark, path)) == listed(facets.filter_options(now))
    facetcounts.compact(spark, path)
    assert listed(facetcounts.stored_options(spark, path)) == listed(facets.filter_options(now))
    assert spark.read.parquet(path).where("n < 0").isEmpty()
    text = facetcounts.stored_options(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "nome_informante" not in text


def test_no_rows(spark, fact, tmp_path):
    path = str(tmp_path / "c")
    some = rows(fact, ("2024-03-01", "a", "X", ["1"]))
    facetcounts.replace_months(some, path)
    facetcounts.add_rows(some, path, sign=-1)
    facetcounts.compact(spark, path)
    assert listed(facetcounts.stored_options(spark, path)) == listed(facets.filter_options(some.limit(0)))
