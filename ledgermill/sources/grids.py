"""Files and texts as long grids: one row per non-empty cell (doc_id, sheet, row, col, raw, cell_type).

CSV, HTML, XLSX, ODS and DOCX come as binary rows and are opened in Python, a file at a time and with guards on its size;
plain text stays in the JVM.  Only the standard library is needed: the office formats are zipped XML.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import date, timedelta
from html.parser import HTMLParser
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.schemas import GRID

MAX_FILE, MAX_UNPACKED, MAX_ENTRIES = 20 << 20, 300 << 20, 5_000
#: Cells of one file, merged and repeated ones spelled out; a file of more is refused as a whole, never cut.
MAX_CELLS = 4_000_000
#: Cells that a reader gives on at once.
BATCH = 50_000
FORMATS = {"xlsx": "xlsx", "csv": "csv", "txt": "text", "html": "html", "htm": "html", "ods": "ods", "docx": "docx"}
#: Fixed value of HTML: a cell spans at most so many columns; rows it spans end with the table.
MAX_ACROSS = 1_000
Row = tuple[str, int, int, str, str]
#: Cell type of the row that stands for a file that could not be read.
ERROR = "error"


def text_grid(texts: DataFrame, gap: str = r"\s{2,}", least_columns: int = 2, least_rows: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines cut into cells at wide gaps; lines of one cell and texts of fewer than three such lines are no grid.

    Everything happens inside the text's own row: no shuffle.
    """
    cells: Column = F.transform(F.split(text_col, "\n"), lambda line: F.split(F.trim(line), gap))
    rows = F.filter(F.transform(cells, lambda c, i: F.struct(i.alias("row"), c.alias("cells"))), lambda r: F.size(r["cells"]) >= least_columns)
    kept = texts.select(F.col(id_col).alias("doc_id"), rows.alias("rows")).where(F.size("rows") >= least_rows)
    long = kept.select("doc_id", F.explode("rows").alias("r")).select("doc_id", F.col("r.row").alias("row"), F.posexplode("r.cells").alias("col", "raw"))
    return long.select("doc_id", F.lit("text").alias("sheet"), "row", "col", "raw", F.lit("text").alias("cell_type"))


def decoded(data: bytes) -> str:
    for encoding in ("utf-8-sig", "cp1251"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def csv_cells(data: bytes) -> Iterator[Row]:
    text = decoded(data)
    try:
        dialect = csv.Sniffer().sniff(text[:8192], delimiters=",;\t|")
    except csv.Error:
        dialect = csv.excel
    for r, row in enumerate(csv.reader(io.StringIO(text, newline=""), dialect)):
        for c, raw in enumerate(row):
            if raw.strip():
                yield "csv", r, c, raw.strip(), "text"


class _Tables(HTMLParser):
    """Cells of all tables; a nested table belongs to none of its parent's cells."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []
        self.done: list[list[list[tuple[str, int, int]]]] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([[], None])
        elif self.open and tag == "tr":
            self.open[-1][0].append([])
            self.open[-1][1] = None
        elif self.open and tag in ("td", "th"):
            a = dict(attrs)
            span = [int(x) if (x := a.get(k) or "1").isdigit() else 1 for k in ("colspan", "rowspan")]
            if not self.open[-1][0]:
                self.open[-1][0].append([])
            self.open[-1][1] = [[], *span]
            self.open[-1][0][-1].append(self.open[-1][1])

    def handle_endtag(self, tag):
        if not self.open:
            return
        if tag == "table":
            self.done.append([[(" ".join("".join(c[0]).split()), c[1], c[2]) for c in row] for row in self.open.pop()[0]])
        elif tag in ("td", "th"):
            self.open[-1][1] = None

    def handle_data(self, data):
        if self.open and self.open[-1][1] is not None:
            self.open[-1][1][0].append(data)


def html_cells(data: bytes) -> Iterator[Row]:
    parser = _Tables()
    parser.feed(decoded(data))
    parser.close()
    while parser.open:
        parser.handle_endtag("table")
    for k, rows in enumerate(parser.done, 1):
        taken: set[tuple[int, int]] = set()
        for r, row in enumerate(rows):
            c = 0
            for text, across, down in row:
                while (r, c) in taken:
                    c += 1
                across, down = min(across, MAX_ACROSS), min(down, len(rows) - r)
                within_bound(len(taken) + across * down)
                for rr in range(r, r + down):
                    for cc in range(c, c + across):
                        taken.add((rr, cc))
                        if text:
                            yield f"таблица {k}", rr, cc, text, "text"
                c += across


def opened(data: bytes) -> zipfile.ZipFile:
    """The archive, unless it would unpack to too much."""
    z = zipfile.ZipFile(io.BytesIO(data))
    infos = z.infolist()
    if len(infos) > MAX_ENTRIES or sum(i.file_size for i in infos) > MAX_UNPACKED:
        raise ValueError("the archive unpacks to too much")
    return z


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _all(node: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in node.iter() if _local(x.tag) == name)


def a1(ref: str) -> tuple[int, int]:
    """Row and column, from 0, of a cell reference."""
    m = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref)
    col = 0
    for ch in m[1]:
        col = col * 26 + ord(ch) - 64
    return int(m[2]) - 1, col - 1


def cell_name(row: int, col: int) -> str:
    name, col = "", col + 1
    while col:
        col, rest = divmod(col - 1, 26)
        name = chr(65 + rest) + name
    return f"{name}{row + 1}"


def within_bound(cells: int) -> int:
    if cells > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    return cells


def xlsx_cells(data: bytes) -> Iterator[Row]:
    z = opened(data)
    names = set(z.namelist())
    strings = ["".join(t.text or "" for t in _all(si, "t")) for si in _all(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in names else []
    dates = set()
    if "xl/styles.xml" in names:
        styles = ElementTree.fromstring(z.read("xl/styles.xml"))
        custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in _all(styles, "numFmt")}
        formats = next(_all(styles, "cellXfs"), [])
        for k, xf in enumerate(formats):
            n = int(xf.get("numFmtId", 0))
            if 14 <= n <= 17 or n == 22 or re.search(r"[yд]|m.*d|d.*m", re.sub(r'"[^"]*"|\[[^\]]*\]', "", custom.get(n, "")).lower()):
                dates.add(k)
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for sheet in _all(book, "sheet"):
        target = next((rels[v] for k, v in sheet.attrib.items() if _local(k) == "id"), "").lstrip("/")
        root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
        found: dict[tuple[int, int], tuple[str, str]] = {}
        for cell in _all(root, "c"):
            at = a1(cell.get("r"))
            value = next((v.text for v in cell if _local(v.tag) == "v"), None)
            kind, raw, as_ = cell.get("t", "n"), None, "text"
            if kind == "s" and value is not None:
                raw = strings[int(value)]
            elif kind == "inlineStr":
                raw = "".join(t.text or "" for t in _all(cell, "t"))
            elif value is not None and kind == "n":
                as_, raw = "number", value
                if int(cell.get("s", 0)) in dates:
                    as_, raw = "date", str(date(1899, 12, 30) + timedelta(days=int(float(value))))
            elif value is not None and kind != "e":
                raw = value
            if raw is not None and raw.strip():
                found[at] = (raw.strip(), as_)
        for merge in _all(root, "mergeCell"):
            lo, _, hi = merge.get("ref").partition(":")
            (r0, c0), (r1, c1) = a1(lo), a1(hi or lo)
            if (anchor := found.get((r0, c0))) is not None:
                within_bound(len(found) + (r1 - r0 + 1) * (c1 - c0 + 1))
                found.update(((r, c), anchor) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1))
        for (r, c), (raw, as_) in sorted(found.items()):
            yield sheet.get("name"), r, c, raw, as_


def ods_cells(data: bytes) -> Iterator[Row]:
    root = ElementTree.fromstring(opened(data).read("content.xml"))
    attr = lambda node, name: next((v for k, v in node.attrib.items() if _local(k) == name), None)
    for table in _all(root, "table"):
        r = 0
        for row in _all(table, "table-row"):
            again = int(attr(row, "number-rows-repeated") or 1)
            cells, c = [], 0
            for cell in row:
                if _local(cell.tag) not in ("table-cell", "covered-table-cell"):
                    continue
                times = int(attr(cell, "number-columns-repeated") or 1)
                kind = attr(cell, "value-type")
                raw = {"float": attr(cell, "value"), "currency": attr(cell, "value"), "percentage": attr(cell, "value"), "date": (attr(cell, "date-value") or "")[:10]}.get(kind) or "\n".join("".join(p.itertext()) for p in _all(cell, "p"))
                if raw and raw.strip():
                    as_ = "date" if kind == "date" else "number" if kind in ("float", "currency", "percentage") else "text"
                    cells += [(c + k, raw.strip(), as_) for k in range(within_bound(times))]
                c += times
            for k in range(again if cells else 0):
                for col, raw, as_ in cells:
                    yield attr(table, "name") or "", r + k, col, raw, as_
            r += again


def docx_cells(data: bytes) -> Iterator[Row]:
    """Tables as grids; paragraphs outside of them as sheet «текст», one a row."""
    root = ElementTree.fromstring(opened(data).read("word/document.xml"))
    body = next(_all(root, "body"))
    tables = lines = 0
    for node in body:
        if _local(node.tag) == "p":
            text = "".join(t.text or "" for t in _all(node, "t")).strip()
            if text:
                yield "текст", lines, 0, text, "text"
                lines += 1
        elif _local(node.tag) == "tbl":
            tables += 1
            for r, row in enumerate(x for x in node if _local(x.tag) == "tr"):
                for c, cell in enumerate(x for x in row if _local(x.tag) == "tc"):
                    text = " ".join("".join(t.text or "" for t in _all(p, "t")) for p in _all(cell, "p")).strip()
                    if text:
                        yield f"таблица {tables}", r, c, text, "text"


def line_cells(data: bytes) -> Iterator[Row]:
    rows = [(r, re.split(r"\s{2,}", line.strip())) for r, line in enumerate(decoded(data).splitlines())]
    rows = [(r, cells) for r, cells in rows if len(cells) >= 2]
    if len(rows) >= 3:
        for r, cells in rows:
            for c, raw in enumerate(cells):
                yield "текст", r, c, raw, "text"


READERS = {"xlsx": xlsx_cells, "csv": csv_cells, "html": html_cells, "ods": ods_cells, "docx": docx_cells, "text": line_cells}


def cells_of(path: str, content: bytes) -> list[Row]:
    ext = path.rpartition(".")[2].lower()
    if ext not in FORMATS:
        raise ValueError(f"no reader for .{ext}")
    if len(content) > MAX_FILE:
        raise ValueError(f"{path} is larger than {MAX_FILE} bytes")
    rows = list(islice(READERS[FORMATS[ext]](content), MAX_CELLS + 1))
    within_bound(len(rows))
    return rows


def reader(strict: bool):
    names = [c.split()[0] for c in GRID.split(", ")]

    def read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc_id, path, content, first in zip(pdf["doc_id"], pdf["path"], pdf["content"], pdf["first_row"], strict=True):
                try:
                    rows = cells_of(path, content)
                except (ValueError, KeyError, IndexError, TypeError, AttributeError, zipfile.BadZipFile, ElementTree.ParseError, csv.Error) as e:
                    if strict:
                        raise
                    rows, first = [("", -1, -1, f"{type(e).__name__}: {e}", ERROR)], 0
                for k in range(0, len(rows), BATCH):
                    yield pd.DataFrame([(doc_id, sheet, r + first, *cell) for sheet, r, *cell in rows[k : k + BATCH]], columns=names)

    return read_files


def grids(files: DataFrame, strict: bool = True) -> DataFrame:
    """Long grid of files (doc_id, path, content); the path's ending names the format.

    A file that can't be read (another ending, too large, damaged, of more than MAX_CELLS cells) fails the job, or without ``strict`` gives one row of
    cell type ERROR that says why; ``usable`` and ``problems`` part the two.  A long table may take several files of one doc_id, each
    with the table's row that it begins with (``first_row``, 0 where there is no such column).
    """
    first = F.col("first_row").cast("int") if "first_row" in files.columns else F.lit(0)
    return files.select(F.col("doc_id").cast("string").alias("doc_id"), "path", "content", first.alias("first_row")).mapInPandas(reader(strict), GRID)


def usable(grid: DataFrame) -> DataFrame:
    return grid.where(F.col("cell_type") != ERROR)


def problems(grid: DataFrame) -> DataFrame:
    """(doc_id, reason) of the files that could not be read."""
    return grid.where(F.col("cell_type") == ERROR).select("doc_id", F.col("raw").alias("reason"))


def folder(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder, once per content: (doc_id, path, content), doc_id the content's SHA-256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*FORMATS))
    return files.withColumn("doc_id", F.sha2("content", 256)).groupBy("doc_id").agg(F.min("path").alias("path"), F.first("content").alias("content"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A journal of JSON lines; lines that don't parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
