"""The clustered layout: rows as before, and how many row groups an equality filter has to read."""

from pathlib import Path

import pyarrow.parquet as pq
import pytest

from precolens.operators.filters import FilterSpec
from precolens.sinks import clustered, publish
from precolens.sources.tables import read_collection

OPTIONS = {"parquet.block.size": "32768", "parquet.page.size": "4096", "parquet.page.size.row.check.min": "50", "parquet.block.size.row.check.min": "50"}


def row_groups(path, column, value):
    """(those whose bounds admit a value, all of them)."""
    admitted = total = 0
    for file in Path(path).rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            chunks = (meta.row_group(g).column(c) for c in range(meta.num_columns))
            stats = next(c.statistics for c in chunks if c.path_in_schema == column)
            total += 1
            admitted += stats is None or not stats.has_min_max or stats.min <= value <= stats.max
    return admitted, total


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(40_000).selectExpr(
        "concat('2024-0', cast(id % 2 + 1 as int), '-', lpad(cast(hash(id) % 14 + 14 as string), 2, '0')) as data_coleta",
        "array(concat('s', pmod(hash(id, 1), 60))) as cod_informante", "concat('Supplier ', pmod(hash(id, 1), 60)) as nome_informante",
        "case when pmod(hash(id, 2), 3) = 0 then 'hot' else concat('brand', pmod(hash(id, 2), 30)) end as marca",
        "if(id % 50 = 0, null, concat('U', pmod(hash(id, 3), 27))) as uf", "concat('P', id) as id_produto", "cast(id as string) as id_coleta",
        "md5(cast(id as string)) as url",
    )


def test_equality_filters_read_fewer_row_groups(spark, rows, tmp_path):
    plain, curved = str(tmp_path / "plain"), str(tmp_path / "curved")
    saved = {k: spark._jsc.hadoopConfiguration().get(k) for k in OPTIONS}
    for k, v in OPTIONS.items():
        spark._jsc.hadoopConfiguration().set(k, v)
    try:
        publish.publish(rows.withColumn("cod_informante", rows.cod_informante[0]), plain)
    finally:
        for k, v in saved.items():
            spark._jsc.hadoopConfiguration().unset(k) if v is None else spark._jsc.hadoopConfiguration().set(k, v)
    clustered.publish_clustered(rows, curved, **OPTIONS)
    wanted = {"marca": "brand7", "uf": "U5", "nome_informante": "Supplier 31", "cod_informante": "s31"}
    for column, value in wanted.items():
        before, after = (a / n for a, n in (row_groups(p, column, value) for p in (plain, curved)))
        assert after < 0.65 * before, column
        spec = FilterSpec(**{column: value})
        found = [sorted(r.id_coleta for r in spec.apply(read_collection(spark, p)).collect()) for p in (plain, curved)]
        assert found[0] == found[1] and found[0]
    assert read_collection(spark, curved).count() == 40_000


def test_bins_hold_equal_shares_in_order(spark, rows):
    starts = clustered.bin_starts(rows.withColumn("cod_informante", rows.cod_informante[0]), ["marca", "uf"], 3)
    assert all(v == sorted(v) and 3 <= len(v) < 8 for v in starts.values())
    assert clustered.bin_starts(rows.limit(0), ["marca"], 3) == {"marca": []}


def test_months_are_replaced_and_empty_tables_written(spark, fact, tmp_path):
    path = str(tmp_path / "c")
    row = lambda month, i: {"data_coleta": f"2024-0{month}-01", "id_produto": f"P{i}", "marca": None}
    clustered.publish_clustered(fact(*[row(m, i) for m in (1, 2) for i in range(5)]), path)
    clustered.publish_clustered(fact(row(2, 9)), path)
    assert sorted(r.id_produto for r in read_collection(spark, path).collect()) == ["P0", "P1", "P2", "P3", "P4", "P9"]
    clustered.publish_clustered(fact().limit(0), path)
    assert read_collection(spark, path).count() == 6
