"""Rows with their texts as one come back as they were, and are shuffled so."""

import pytest
from pyspark.sql import functions as F

from precolens.functions.packed import packed, unpacked
from precolens.operators.enrich import enrich
from precolens.schemas import MONTH
from precolens.sinks import clustered, publish
from precolens.sources.tables import read_collection

ODD = [None, "", " ", "\x1e", "\x1f", "a\x1fb", "\x1e\x1f", "é漢🙂", "\x00", "a,b\n"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def odd(spark):
    rows = [(i, a, b, [a], float(i), "k") for i, (a, b) in enumerate((a, b) for a in ODD for b in ODD)]
    made = spark.createDataFrame(rows, "n long, a string, `b.c` string, l array<string>, d double, k string")
    cut = made.where("n < 2").withColumn("a", F.expr("cast(X'C3' as string)")).withColumn("b.c", F.expr("cast(X'A9' as string)"))
    return made.unionByName(cut).withColumn("z", F.col("a"))


@pytest.mark.parametrize("keep", [[], ["k"], ["a", "k"], ["a", "b.c", "k", "z"]])
def test_rows_come_back(odd, keep):
    small = packed(odd, keep)
    assert set(keep) <= set(small.columns)
    back = unpacked(small, odd.columns)
    assert back.columns == odd.columns and back.count() == odd.count()
    seen = lambda df: df.select(*[F.hex(F.col(f"`{c}`").cast("binary")).alias(f"c{i}") if c in ("a", "b.c", "z") else f"`{c}`" for i, c in enumerate(df.columns)])
    assert sorted(map(str, seen(back).collect())) == sorted(map(str, seen(odd).collect()))


def test_few_rows_go_as_they_are(odd):
    small = packed(odd.where("n = 70"), ["k"])  # plain texts
    assert small.where("_inteiros is not null").count() == 0
    assert unpacked(small.withColumn("mais", F.lit(1)), ["mais", "a"]).columns == ["mais", "a"]


def test_the_whole_view_is_the_view(spark, fact, registry):
    rows = fact(*[{"id_produto": f"P{i % 3}", "cod_informante": [str(i % 2)] if i % 5 else [], "url": ODD[i % len(ODD)], "marca": ODD[i // 10], "preco": i / 7} for i in range(100)])
    codes = registry((1, "P1", "x", 1), (1, "P1", "y", 2), (0, "P2", None, None))
    slim, whole = enrich(rows, codes), enrich(rows, codes, whole=True)
    assert whole.schema.names == slim.schema.names and [f.dataType for f in whole.schema] == [f.dataType for f in slim.schema]
    assert sorted(map(str, whole.collect())) == sorted(map(str, slim.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = plan(enrich(rows, codes, whole=True))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffled = joined[joined.index("Exchange hashpartitioning(cod_informante") :].split("\n")[1]
    assert "_texto" in shuffled and "nome_informante" not in shuffled.split("concat_ws")[0]


@pytest.mark.parametrize("write", [publish.publish, clustered.publish_clustered])
def test_stored_tables_shuffle_one_text_and_keep_rows(spark, fact, tmp_path, monkeypatch, write):
    rows = fact(*[{"data_coleta": f"2024-0{i % 4 + 1}-1{i % 9}", "cod_informante": [str(i % 4)], "id_produto": f"P{i}", "url": ODD[i % len(ODD)], "marca": ODD[i // 10]} for i in range(100)])
    seen = []
    for module in (publish, clustered):
        monkeypatch.setattr(module, "unpacked", lambda df, columns: seen.append(df) or unpacked(df, columns))
    write(rows, str(tmp_path / "t"))
    assert {"_texto", "_inteiros"} <= set(seen[0].columns) and "url" not in seen[0].columns
    back = read_collection(spark, str(tmp_path / "t")).drop(MONTH)
    code = F.get("cod_informante", F.lit(0)) if write is publish.publish else F.col("cod_informante")
    assert sorted(map(str, back.withColumn("cod_informante", code).collect())) == sorted(map(str, rows.withColumn("cod_informante", F.get("cod_informante", F.lit(0))).select(*back.columns).collect()))
