"""Stored tables are compressed by more than Parquet's default."""

from precolens.session import written
from precolens.sinks import clustered, publish


def test_tables_of_texts_are_stored_small(spark, tmp_path, fact):
    rows = fact(*[{"data_coleta": f"2024-0{i % 3 + 1}-11", "id_produto": f"P{i}", "url": f"https://example.com/{i}"} for i in range(50)])
    publish.publish(rows, str(tmp_path / "meses"))
    clustered.publish_clustered(rows, str(tmp_path / "curva"))
    kept = written(rows, "teste")
    names = [str(p) for d in ("meses", "curva") for p in (tmp_path / d).rglob("*.parquet")] + list(kept.inputFiles())
    assert names and all(".zstd." in n for n in names)
    assert kept.exceptAll(rows).isEmpty() and rows.exceptAll(kept).isEmpty()


def test_a_given_codec_stands(spark, tmp_path, fact):
    clustered.publish_clustered(fact({"data_coleta": "2024-01-02", "id_produto": "P"}), str(tmp_path / "curva"), compression="gzip")
    names = [str(p) for p in (tmp_path / "curva").rglob("*.parquet")]
    assert names and all(".gz." in n for n in names)
