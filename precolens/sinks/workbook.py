"""Spreadsheet export: the rows of a selection as one ordered workbook file.

Cells are written as XML by column expressions. The sorted rows are stored once with their places; blocks of
``BLOCK_ROWS`` rows are deflated side by side, each ending on a whole byte, and one task joins a file's blocks to sheets as
it reads them in order. Blocks are files in the shared folder, and so are the pieces of sheets that are read: Spark's rows carry
their paths, so that no batch of rows holds more than one of them. Checksums of blocks are combined, not computed anew. A sheet ends at
the format's row limit, a file after ``sheets`` sheets: a larger selection gives several files, each written by its own task.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import lenient_date
from ..schemas import COLUMN_LABELS, PRICE_COLUMNS
from ..session import durable, importable, measured, scratch_path, written
from .export import column_widths

# Rows of a sheet with its header, the sheets' name, the header's colours and height.
SHEET_ROWS = 1_048_576
SHEET_NAME = "produtos"
HEADER_FILL, HEADER_FONT, HEADER_HEIGHT = "FF1B4F72", "FFFFFFFF", 20
PRICE_FORMAT, DATE_FORMAT = '"R$" #,##0.00', "dd/mm/yyyy"

# Sheets of a file, and rows that are deflated together.
SHEETS, BLOCK_ROWS = 16, 8192

# When reading: bytes of a sheet that are parsed together, and such pieces for a task.
PIECE_BYTES, PIECES_PER_TASK = 1 << 22, 4

# Styles by their places in the style sheet; days are counted from the day before the first.
_PLAIN, _HEADER, _PRICE, _DATE = range(4)
_DAY_ZERO = "1899-12-30"
# Numbers with more digits are text: a cell's number has 15.
_DIGITS = 10**15

_NAMESPACE = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_DECLARATION = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_LAST_BLOCK = zlib.compressobj(wbits=-15).flush()
_SHEET_BEGIN = re.compile(rb"(?P<sheet><(?P<a>(?:[\w.-]+:)?)worksheet\b[^>]*>).*?(?P<data><(?P<b>(?:[\w.-]+:)?)sheetData(?:\s[^>/]*)?>)", re.DOTALL)


# --- cells ----------------------------------------------------------------------------------


def _escaped(text: Column) -> Column:
    """Text for XML; characters that it cannot hold are written by their number, as the format does."""
    bad, written_out = "[\\x00-\\x08\\x0B-\\x1F\\uFFFE\\uFFFF]", "_(?=x[0-9A-Fa-f]{4}_)"
    marked = F.when(text.rlike(written_out), F.regexp_replace(text, written_out, "_x005F_")).otherwise(text)
    numbered = F.transform(
        F.split(marked, ""),
        lambda c: F.when(c.rlike(bad), F.concat(F.lit("_x"), F.lpad(F.hex(F.ascii(c)), 4, "0"), F.lit("_"))).otherwise(c),
    )
    marked = F.when(text.rlike(bad), F.array_join(numbered, "")).otherwise(marked)
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        marked = F.replace(marked, F.lit(char), F.lit(name))
    return marked


def _text_cell(text: Column) -> Column:
    return F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), _escaped(text), F.lit("</t></is></c>"))


def _number_cell(number: Column, style: int) -> Column:
    return F.concat(F.lit(f'<c s="{style}"><v>'), number.cast("string"), F.lit("</v></c>"))


def _cell(field: T.StructField) -> Column:
    """A cell; blank for NULL, a price that is not a number and a date that is none."""
    value = F.col(f"`{field.name}`")
    if field.name in PRICE_COLUMNS:
        number = value.try_cast("double")
        odd = number.isNull() | (F.abs(number) == float("inf"))
        cell = F.when(odd, _text_cell(value.cast("string"))).when(~F.isnan(number), _number_cell(number, _PRICE))
    elif field.name == "data_coleta":
        cell = _number_cell(F.date_diff(lenient_date(value.cast("string")), F.lit(_DAY_ZERO).cast("date")), _DATE)
    elif isinstance(field.dataType, T.IntegralType):
        cell = F.when(F.abs(value) < _DIGITS, _number_cell(value, _PLAIN)).otherwise(_text_cell(value.cast("string")))
    else:
        cell = _text_cell(value.cast("string"))
    return F.coalesce(cell, F.lit("<c/>"))


def _row(rows: DataFrame) -> Column:
    return F.concat(F.lit("<row>"), *[_cell(f) for f in rows.schema if f.name != "_lugar"], F.lit("</row>")).alias("xml")


# --- checksums and archive records ------------------------------------------------------------


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of the checksum, lowest power in the highest bit."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """The checksum of two texts in a row from those of each; the second is ``length`` bytes long."""
    power, square, bits = 0x80000000, 0x40000000, 8 * length
    while bits:
        if bits & 1:
            power = _times(square, power)
        square, bits = _times(square, square), bits >> 1
    return _times(power, first) ^ second


class _Entry:
    """A file of the archive: its sizes and checksum are known before its bytes are written."""

    def __init__(self, name: str, crc: int, packed: int, plain: int, at: int):
        self.name, self.crc, self.packed, self.plain, self.at = name.encode(), crc, packed, plain, at

    def _head(self, signature: bytes, made_by: bytes, tail: bytes, at: tuple[int, ...]) -> bytes:
        limit, wide = 0xFFFFFFFF, b""
        sizes = [self.plain, self.packed, *at]
        if max(sizes) >= limit:
            wide = struct.pack(f"<HH{len(sizes)}Q", 1, 8 * len(sizes), *sizes)
            sizes = [limit] * len(sizes)
        fixed = struct.pack("<HHHHHIIIHH", 45, 1 << 11, 8, 0, 0x21, self.crc, sizes[1], sizes[0], len(self.name), len(wide))
        return signature + made_by + fixed + tail + struct.pack(f"<{len(at)}I", *sizes[2:]) + self.name + wide

    def local(self) -> bytes:
        return self._head(b"PK\x03\x04", b"", b"", ())

    def central(self) -> bytes:
        return self._head(b"PK\x01\x02", struct.pack("<H", 45), struct.pack("<HHHI", 0, 0, 0, 0), (self.at,))


def _directory_end(entries: list[_Entry], start: int, size: int) -> bytes:
    n, limit, wide = len(entries), 0xFFFFFFFF, b""
    if max(start, size) >= limit or n >= 0xFFFF:
        wide = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start)
        wide += b"PK\x06\x07" + struct.pack("<IQI", 0, start + size, 1)
    short = min(n, 0xFFFF)
    return wide + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, short, short, min(size, limit), min(start, limit), 0)


def _deflated(data: bytes) -> bytes:
    """Compressed so that another part may follow: up to a whole byte, without an end."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    return packer.compress(data) + packer.flush(zlib.Z_FULL_FLUSH)


# --- blocks and pieces as files -----------------------------------------------------------------


def _kept(folder: str, data: bytes) -> str:
    """The path of a new file below ``folder`` with these bytes; a task that is run again writes another."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    name = uuid.uuid4().hex
    with store.open_output_stream(f"{root.rstrip('/')}/{name}", compression=None) as out:
        out.write(data)
    return f"{folder.rstrip('/')}/{name}"


def _bytes_of(place: str) -> bytes:
    store, path = fs.FileSystem.from_uri(place)
    with store.open_input_stream(path, compression=None) as file:
        return file.read()


# --- the fixed parts ----------------------------------------------------------------------------


def _sheet_names(n: int) -> list[str]:
    return [SHEET_NAME if i == 1 else f"{SHEET_NAME} {i}" for i in range(1, n + 1)]


def _parts(sheets: int) -> dict[str, str]:
    """The files of a workbook beside its sheets."""
    numbers = range(1, sheets + 1)
    override = '<Override PartName="/xl/{}" ContentType="' + _TYPE + '.{}+xml"/>'
    types = [override.format("workbook.xml", "sheet.main"), override.format("styles.xml", "styles")]
    types += [override.format(f"worksheets/sheet{i}.xml", "worksheet") for i in numbers]
    link = f'<Relationship Id="{{}}" Type="{_RELATIONS}/{{}}" Target="{{}}"/>'
    links = [link.format("styles", "styles", "styles.xml")] + [link.format(f"s{i}", "worksheet", f"worksheets/sheet{i}.xml") for i in numbers]
    listed = [f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="s{i}"/>' for i, name in enumerate(_sheet_names(sheets), 1)]
    middle = '<alignment vertical="center"/></xf>'
    cell = '<xf numFmtId="{}" fontId="{}" fillId="{}" borderId="0" xfId="0" applyNumberFormat="1" applyFont="1" applyFill="1" applyAlignment="1">'
    styles = [
        f'<styleSheet xmlns="{_NAMESPACE}"><numFmts count="2"><numFmt numFmtId="164" formatCode={quoteattr(PRICE_FORMAT)}/>',
        f'<numFmt numFmtId="165" formatCode="{DATE_FORMAT}"/></numFmts><fonts count="2"><font><sz val="11"/><name val="Calibri"/></font>',
        f'<font><b/><sz val="11"/><color rgb="{HEADER_FONT}"/><name val="Calibri"/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill>',
        f'<fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="{HEADER_FILL}"/></patternFill></fill></fills>',
        '<borders count="1"><border><left/><right/><top/><bottom/><diagonal/></border></borders>',
        '<cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs><cellXfs count="4">',
        cell.format(0, 0, 0) + middle + cell.format(0, 1, 2) + '<alignment horizontal="center" vertical="center"/></xf>',
        cell.format(164, 0, 0) + middle + cell.format(165, 0, 0) + middle + "</cellXfs></styleSheet>",
    ]
    return {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Default Extension="xml" ContentType="application/xml"/>{"".join(types)}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">{link.format("r1", "officeDocument", "xl/workbook.xml")}</Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_NAMESPACE}" xmlns:r="{_RELATIONS}"><sheets>{"".join(listed)}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">{"".join(links)}</Relationships>',
        "xl/styles.xml": "".join(styles),
    }


def _sheet_ends(labels: list[str], widths: list[int]) -> tuple[bytes, bytes]:
    """What stands before and after a sheet's rows: frozen header, widths, the header itself."""
    columns = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
    header = "".join(f'<c s="{_HEADER}" t="inlineStr"><is><t>{escape(label)}</t></is></c>' for label in labels)
    start = (
        f'{_DECLARATION}<worksheet xmlns="{_NAMESPACE}"><sheetViews><sheetView workbookViewId="0">'
        '<pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
        f'<cols>{columns}</cols><sheetData><row ht="{HEADER_HEIGHT}" customHeight="1">{header}</row>'
    )
    return start.encode(), b"</sheetData></worksheet>"


# --- writing ------------------------------------------------------------------------------------


def _blocks(kept: DataFrame, sheet_rows: int, block_rows: int) -> DataFrame:
    """Rows (folha, bloco, caminho, crc, bruto, compacto): the file of every block's rows in order, compressed.

    The stored place has the sorted part in its upper bits and the row within it in the lower 33.
    """
    part = F.shiftright("_lugar", 33)
    sizes = kept.groupBy(part.alias("parte")).agg(F.count("*").alias("n"))
    before = Window.orderBy("parte").rowsBetween(Window.unboundedPreceding, -1)  # one row per sorted part
    offsets = sizes.select("parte", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("antes"))
    placed = kept.select(part.alias("parte"), F.col("_lugar").bitwiseAND(F.lit((1 << 33) - 1)).alias("indice"), _row(kept))
    place = F.col("antes") + F.col("indice")
    rows = placed.join(measured(offsets).side, "parte").select(
        F.floor(place / sheet_rows).alias("folha"), F.floor(F.pmod(place, F.lit(sheet_rows)) / block_rows).alias("bloco"), place.alias("lugar"), "xml"
    )

    folder = scratch_path(kept.sparkSession, "compactos")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        data = "".join(rows.sort_by("lugar").column("xml").to_pylist()).encode()
        packed = _deflated(data)
        place = _kept(f"{folder}/{key[0].as_py()}", packed)
        columns = [*([k.as_py()] for k in key), [place], [zlib.crc32(data)], [len(data)], [len(packed)]]
        return pa.table(dict(zip(["folha", "bloco", "caminho", "crc", "bruto", "compacto"], columns, strict=True)))

    schema = "folha long, bloco long, caminho string, crc long, bruto long, compacto long"
    return written(importable(rows).groupBy("folha", "bloco").applyInArrow(run, schema), "blocos")


def _plan(blocks: DataFrame, rows: int, sheet_rows: int, sheets: int) -> DataFrame:
    """Rows (arquivo, folha, bloco, caminho, lista): before a sheet's blocks a row without a file that lists them."""
    n = max(1, -(-rows // sheet_rows))
    listed = blocks.groupBy("folha").agg(F.sort_array(F.collect_list(F.struct("bloco", "crc", "bruto", "compacto"))).alias("lista"))
    heads = blocks.sparkSession.range(n).withColumnRenamed("id", "folha").join(listed, "folha", "left")
    heads = heads.select("folha", F.lit(-1).cast("long").alias("bloco"), F.lit(None).cast("string").alias("caminho"), "lista")
    both = heads.unionByName(blocks.select("folha", "bloco", "caminho", F.lit(None).cast(heads.schema["lista"].dataType).alias("lista")))
    file = F.floor(F.col("folha") / sheets).alias("arquivo")
    return both.select(file, "folha", "bloco", "caminho", "lista").repartition(-(-n // sheets), "arquivo").sortWithinPartitions("arquivo", "folha", "bloco")


def file_name(number: int) -> str:
    return f"{SHEET_NAME}.xlsx" if number == 0 else f"{SHEET_NAME}-{number + 1}.xlsx"


def write_workbook(rows: DataFrame, folder: str, sheet_rows: int = SHEET_ROWS, sheets: int = SHEETS, block_rows: int = BLOCK_ROWS) -> list[str]:
    """Write sorted rows as workbook files below ``folder``, any URI that ``pyarrow.fs`` opens; their paths, in order.

    Prices are numbers, dates are days, both with the formats of the export; other columns are text or whole numbers.
    Without rows there is one sheet with its header. A file appears under its name when it is complete.
    """
    per_sheet = sheet_rows - 1
    kept = written(rows.withColumn("_lugar", F.monotonically_increasing_id()), "ordenada")
    plain = kept.drop("_lugar")
    count = kept.count()
    width = {r.coluna: r.largura for r in column_widths(plain).collect()}
    labels = [COLUMN_LABELS.get(c, c) for c in plain.columns]
    start, end = _sheet_ends(labels, [width[c] for c in labels])
    n_sheets = max(1, -(-count // per_sheet))
    plan = _plan(_blocks(kept, per_sheet, block_rows), count, per_sheet, sheets)
    # The ends are short; blocks in between are the sheet's rows.
    ends = [(_deflated(start), zlib.crc32(start), len(start)), (_deflated(end) + _LAST_BLOCK, zlib.crc32(end), len(end))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, book = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if book is None or book.number != row["arquivo"]:
                    done += [book.close()] if book else []
                    book = _Book(folder, row["arquivo"], min(sheets, n_sheets - row["arquivo"] * sheets), ends)
                if row["bloco"] < 0:
                    book.begin([(b["crc"], b["bruto"], b["compacto"]) for b in row["lista"] or []])
                else:
                    book.add(_bytes_of(row["caminho"]))
        done += [book.close()] if book else []
        yield pa.RecordBatch.from_pydict({"arquivo": pa.array([d[0] for d in done], pa.int64()), "caminho": pa.array([d[1] for d in done], pa.string())})

    found = durable(importable(plan).mapInArrow(run, "arquivo long, caminho string"))
    return [r.caminho for r in found.orderBy("arquivo").collect()]  # a path per file


class _Book:
    """A workbook as it is written, under a name of its own until it is complete."""

    def __init__(self, folder: str, number: int, sheets: int, ends: list[tuple[bytes, int, int]]):
        self.number, self.ends, self.entries, self.at, self.sheet = number, ends, [], 0, 0
        self.path = f"{folder.rstrip('/')}/{file_name(number)}"
        self.store, root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(root, recursive=True)
        self.place = f"{root.rstrip('/')}/{file_name(number)}"
        self.hidden = f"{root.rstrip('/')}/_{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.hidden, compression=None)
        for name, text in _parts(sheets).items():
            data = (_DECLARATION + text).encode()
            packed = _deflated(data) + _LAST_BLOCK
            self._open(name, zlib.crc32(data), len(packed), len(data))
            self.add(packed)

    def _open(self, name: str, crc: int, packed: int, plain: int) -> None:
        entry = _Entry(name, crc, packed, plain, self.at)
        self.entries.append(entry)
        self.add(entry.local())

    def add(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, blocks: list[tuple[int, int, int]]) -> None:
        """Start the next sheet, whose blocks have these checksums and sizes."""
        self._end_sheet()
        (start, crc, plain), (end, end_crc, end_plain) = self.ends
        packed = len(start) + len(end)
        for block_crc, size, compressed in [*blocks, (end_crc, end_plain, 0)]:
            crc, plain, packed = joined_crc(crc, block_crc, size), plain + size, packed + compressed
        self.sheet += 1
        self._open(f"xl/worksheets/sheet{self.sheet}.xml", crc, packed, plain)
        self.add(start)

    def _end_sheet(self) -> None:
        if self.sheet:
            self.add(self.ends[1][0])

    def close(self) -> tuple[int, str]:
        self._end_sheet()
        start, directory = self.at, b"".join(e.central() for e in self.entries)
        self.add(directory + _directory_end(self.entries, start, len(directory)))
        self.out.close()
        self.store.move(self.hidden, self.place)
        return self.number, self.path


# --- reading ------------------------------------------------------------------------------------


def read_workbook(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows (arquivo, folha, linha, celulas): the cells of every row as text, NULL for blank ones; the header is row 1.

    Days and prices come as the numbers in the file.
    """
    return _cells(_pieces(spark, paths))


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows (arquivo, folha, primeira, linhas, caminho), stored: the file with whole rows of a sheet as a document, and the first one's number.

    Sheets are inflated side by side, each as a stream that is only cut; its pieces are parsed by any number of tasks.
    """
    import zipfile

    def sheets(place: str) -> int:
        store, path = fs.FileSystem.from_uri(place)
        with store.open_input_file(path) as file, zipfile.ZipFile(file) as book:
            return sum(name.startswith("xl/worksheets/") for name in book.namelist())

    listed = [(a, p, s) for a, p in enumerate(paths) for s in range(1, sheets(p) + 1)]
    places = spark.createDataFrame(listed, "arquivo long, caminho string, folha long")
    places = places.repartition(max(1, len(listed)), "arquivo", "folha")
    size, folder = PIECE_BYTES, scratch_path(spark, "recortes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for arquivo, place, folha in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, path = fs.FileSystem.from_uri(place)
                with store.open_input_file(path) as file, zipfile.ZipFile(file) as book, book.open(f"xl/worksheets/sheet{folha}.xml") as sheet:
                    for first, n, text in _cut(sheet, size):
                        kept = _kept(f"{folder}/{arquivo}-{folha}", zlib.compress(text, 1))
                        yield pa.RecordBatch.from_pydict({"arquivo": [arquivo], "folha": [folha], "primeira": [first], "linhas": [n], "caminho": [kept]})

    return written(importable(places).mapInArrow(run, "arquivo long, folha long, primeira long, linhas long, caminho string"), "trechos")


def _cells(pieces: DataFrame) -> DataFrame:
    names = ["arquivo", "folha", "linha", "celulas"]
    schema = pa.schema([("arquivo", pa.int64()), ("folha", pa.int64()), ("linha", pa.int64()), ("celulas", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one text at a time
                arquivo, folha, first, _, place = (c[i].as_py() for c in batch.columns)
                cells = _sheet_rows(zlib.decompress(_bytes_of(place)))
                columns = [arquivo] * len(cells), [folha] * len(cells), range(first, first + len(cells)), cells
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], names)

    spread = pieces.repartition(pieces.count() // PIECES_PER_TASK + 1, "arquivo", "folha", "primeira")
    return importable(spread).mapInArrow(run, "arquivo long, folha long, linha long, celulas array<string>")


def _cut(sheet, size: int) -> Iterator[tuple[int, int, bytes]]:
    """(first row's number, rows, document) for pieces of a sheet that end with a row.

    Where a comment or a marked section may hold what looks like a row's end, nothing more is cut, and neither is a
    sheet whose beginning is not found, such as one in another encoding.
    """
    kept, head, tail, first = b"", None, b"", 1
    while data := sheet.read(size):
        kept += data
        if head is None and (begin := _SHEET_BEGIN.search(kept)):
            head, kept = begin["sheet"] + begin["data"], kept[begin.end() :]
            tail, row_end = b"</" + begin["b"] + b"sheetData></" + begin["a"] + b"worksheet>", b"</" + begin["b"] + b"row>"
            row = re.compile(b"<" + begin["b"] + rb"row[\s/>]")
        if head is None or b"<!" in kept or (end := kept.rfind(row_end)) < 0:
            continue
        end += len(row_end)
        part, kept = kept[:end], kept[end:]
        n = len(row.findall(part))
        yield first, n, head + part + tail
        first += n
    if head is not None:
        kept = head + kept[: kept.rfind(tail[: tail.index(b">")])] + tail
    if n := len(_sheet_rows(kept)):
        yield first, n, kept


def _sheet_rows(text: bytes) -> list[list[str | None]]:
    """The cells of the rows of a sheet's document."""
    from xml.etree.ElementTree import fromstring

    value, inline, shown = (f"{{{_NAMESPACE}}}{n}" for n in ("v", "is", "t"))
    numbered = re.compile("_x([0-9A-Fa-f]{4})_")
    found = []
    for row in fromstring(text).iterfind(f"{{{_NAMESPACE}}}sheetData/{{{_NAMESPACE}}}row"):
        cells = []
        for cell in row:
            inner = plain = None
            for part in cell:
                if part.tag == value and plain is None:
                    plain = part
                elif part.tag == inline and inner is None:
                    inner = part.find(shown)
            if inner is None:
                cells.append(None if plain is None else plain.text)
            else:
                text = inner.text or ""
                cells.append(numbered.sub(lambda m: chr(int(m[1], 16)), text) if "_x" in text else text)
        found.append(cells)
    return found


def read_rows(spark: SparkSession, paths: list[str], columns: dict[str, str]) -> DataFrame:
    """The rows below the headers, under names with types, and their place ``posicao`` in the whole export, from 1.

    Days become date text again.
    """
    pieces = _pieces(spark, paths)
    cells = _cells(pieces).where("linha > 1")
    order = Window.orderBy("arquivo", "folha")  # one row per sheet
    sizes = pieces.groupBy("arquivo", "folha").agg((F.sum("linhas") - 1).alias("n"))
    before = sizes.select("arquivo", "folha", (F.sum("n").over(order) - F.col("n")).alias("antes"))

    def value(at: int, name: str, kind: str) -> Column:
        text = F.get("celulas", F.lit(at))
        if name == "data_coleta":
            return F.date_add(F.lit(_DAY_ZERO).cast("date"), text.cast("int")).cast("string").alias(name)
        return text.cast(kind).alias(name)

    found = [value(i, n, t) for i, (n, t) in enumerate(columns.items())]
    place = (F.col("antes") + F.col("linha") - 1).cast("long").alias("posicao")
    return cells.join(measured(before).side, ["arquivo", "folha"]).select(*found, place)
