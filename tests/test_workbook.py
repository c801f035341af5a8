"""The workbook: read back equal, valid archive, header and widths, sheets and files at their limits."""

import io
import zipfile
import zlib
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from precolens.operators.paging import all_newest_first
from precolens.schemas import COLUMN_LABELS, ENRICHED
from precolens.session import written
from precolens.sinks import export, workbook

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
TYPES = {f.name: f.dataType.simpleString() for f in ENRICHED}
TEXTS = ["a & b <c> \"d\"", "", " x ", "é漢🙂", "tab\tline\nend\r", "bell\x07 _x0041_", "_x0041_ _x", "=1+1", "R$ 1.5"]


@pytest.fixture
def rows(spark):
    """Some 100 rows in order, newest first."""
    made = [
        {"data_coleta": f"2024-01-{i % 28 + 1:02d}" if i % 10 else None, "descricao": TEXTS[i % len(TEXTS)] if i % 7 else None, "preco": i / 3 if i % 5 else None,
         "preco_promocional": -1.5e-7 * i, "insumo_informado": 10**i if i < 18 else None, "id_produto": f"P{i:03d}", "id_coleta": str(i)}
        for i in range(100)
    ]
    return all_newest_first(spark.createDataFrame([tuple(r.get(f.name) for f in ENRICHED) for r in made], ENRICHED))


def back(spark, paths):
    read = workbook.read_rows(spark, paths, TYPES).orderBy("posicao").collect()
    assert [r.posicao for r in read] == list(range(1, len(read) + 1))
    return [tuple(r)[:-1] for r in read]


def test_rows_come_back_in_order(spark, rows, tmp_path):
    paths = workbook.write_workbook(rows, str(tmp_path), block_rows=7)
    assert paths == [f"{tmp_path}/produtos.xlsx"] and [p.name for p in tmp_path.iterdir()] == ["produtos.xlsx"]
    assert back(spark, paths) == list(map(tuple, rows.collect()))


def test_sheets_and_files_end_at_their_limits(spark, rows, tmp_path):
    paths = workbook.write_workbook(rows, str(tmp_path), sheet_rows=21, sheets=2, block_rows=8)
    assert [p.rsplit("/", 1)[1] for p in paths] == ["produtos.xlsx", "produtos-2.xlsx", "produtos-3.xlsx"]
    names = [[s.get("name") for s in ElementTree.fromstring(zipfile.ZipFile(p).read("xl/workbook.xml")).iterfind("m:sheets/m:sheet", NS)] for p in paths]
    assert names == [["produtos", "produtos 2"]] * 2 + [["produtos"]]
    assert back(spark, paths) == list(map(tuple, rows.collect()))


def test_archive_header_and_widths(spark, rows, tmp_path):
    book = zipfile.ZipFile(workbook.write_workbook(rows, str(tmp_path), block_rows=9)[0])
    assert book.testzip() is None  # checksums of all files
    for name in book.namelist():
        ElementTree.fromstring(book.read(name))
    sheet = ElementTree.fromstring(book.read("xl/worksheets/sheet1.xml"))
    header = sheet.find("m:sheetData/m:row", NS)
    assert [t.text for t in header.iterfind("m:c/m:is/m:t", NS)] == list(COLUMN_LABELS.values())  # dots and all
    assert sheet.find("m:sheetViews/m:sheetView/m:pane", NS).get("state") == "frozen"
    widths = {r.coluna: r.largura for r in export.column_widths(rows).collect()}
    assert [int(c.get("width")) for c in sheet.iterfind("m:cols/m:col", NS)] == [widths[c] for c in COLUMN_LABELS.values()]
    cells = {c.get("s") for c in sheet.iterfind("m:sheetData/m:row/m:c", NS)}
    assert {"1", "2", "3"} <= cells


def test_odd_prices_and_dates(spark, tmp_path):
    odd = spark.sql("select '2024-13-01' as data_coleta, double('nan') as preco, double('inf') as preco_promocional union all select '2024-02-29x', 1e20D, null")
    paths = workbook.write_workbook(odd.orderBy("data_coleta"), str(tmp_path))
    cells = workbook.read_workbook(spark, paths).where("linha > 1").orderBy("linha").collect()
    assert [r.celulas for r in cells] == [[None, "1.0E20", None], [None, None, "Infinity"]]


def test_no_rows(spark, rows, tmp_path):
    paths = workbook.write_workbook(rows.limit(0), str(tmp_path))
    assert workbook.read_workbook(spark, paths).select("linha", F.get("celulas", F.lit(0)).alias("c")).collect() == [(1, "Data Coleta")]
    assert back(spark, paths) == []


def test_a_sheet_is_parsed_in_pieces_by_several_tasks(spark, rows, tmp_path, monkeypatch):
    paths = workbook.write_workbook(rows, str(tmp_path), block_rows=9)
    monkeypatch.setattr(workbook, "PIECE_BYTES", 5000)
    parts = workbook.read_workbook(spark, paths).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 2 and sum(r["count"] for r in parts) == 101
    assert back(spark, paths) == list(map(tuple, rows.collect()))


def test_no_table_holds_blocks_or_pieces(spark, rows, tmp_path, monkeypatch):
    """A batch of rows has thousands of them: blocks and pieces of some MB in rows would be held all at once."""
    stored = []
    monkeypatch.setattr(workbook, "written", lambda df, name: stored.append((name, kept := written(df, name))) or kept)
    monkeypatch.setattr(workbook, "PIECE_BYTES", 5000)
    paths = workbook.write_workbook(rows, str(tmp_path), block_rows=9)
    read = workbook.read_rows(spark, paths, TYPES)
    tables = dict(stored)
    assert tables["blocos"].count() == 12 and tables["trechos"].count() > 4
    for name in ("blocos", "trechos"):
        assert "binary" not in dict(tables[name].dtypes).values()
        assert all(len(r.caminho) < 400 for r in tables[name].collect())
    assert read.count() == 100


@pytest.mark.parametrize("size", [1, 40, 10**6])
@pytest.mark.parametrize(("p", "odd"), [("", ""), ("x:", ""), ("", "<!-- </row> <row> -->"), ("", "<row r='3'/>")])
def test_sheets_of_other_writers_are_cut_between_rows(size, p, odd):
    row = lambda *texts: f"<{p}row>" + "".join(f"<{p}c><{p}f>1</{p}f><{p}v>{t}</{p}v></{p}c>" for t in texts) + f"</{p}row>"
    space = f"xmlns{':x' if p else ''}='{NS['m']}'"
    text = f"<?xml version='1.0'?><{p}worksheet {space}><{p}cols/><{p}sheetData>{row(1, 2)}{odd}{row(3)}{row(4)}</{p}sheetData><{p}tail/></{p}worksheet>"
    pieces = list(workbook._cut(io.BytesIO(text.encode()), size))
    cells = [workbook._sheet_rows(t) for _, _, t in pieces]
    assert sum(cells, []) == [["1", "2"], *([[]] if "r=" in odd else []), ["3"], ["4"]]
    assert [n for _, n, _ in pieces] == list(map(len, cells)) and [f for f, _, _ in pieces] == [1 + sum(map(len, cells[:i])) for i in range(len(cells))]
    assert len(pieces) > 1 or size > 1


def test_checksums_are_combined():
    parts = [b"", b"a", bytes(range(256)) * 5, b"x" * 100_000]
    whole, crc = b"", 0
    for p in parts:
        whole, crc = whole + p, workbook.joined_crc(crc, zlib.crc32(p), len(p))
    assert crc == zlib.crc32(whole)


def test_sizes_beyond_32_bits_are_written_wide():
    entry = workbook._Entry("a.xml", 7, 5 << 30, 9 << 30, 6 << 30)
    assert zipfile.ZipInfo and entry.local().endswith(b"a.xml" + b"\x01\x00\x10\x00" + (9 << 30).to_bytes(8, "little") + (5 << 30).to_bytes(8, "little"))
    assert entry.central().endswith((6 << 30).to_bytes(8, "little"))
    assert b"PK\x06\x06" in workbook._directory_end([entry], 5 << 30, 60)
