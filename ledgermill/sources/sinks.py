"""Reports out: spreadsheets of bounded reports, journals as JSON lines, tables of fixed width."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Sequence
from datetime import date
from decimal import Decimal
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from ledgermill.sources.grids import cell_name

#: A spreadsheet is for people: reports of more rows are an error, not cut.
MAX_REPORT_ROWS = 100_000


def _cell(row: int, col: int, value) -> str:
    at = cell_name(row, col)
    if value is None:
        return ""
    if isinstance(value, bool) or not isinstance(value, int | float | Decimal):
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'
    return f'<c r="{at}"><v>{value}</v></c>'


def xlsx(sheets: dict[str, Sequence[Sequence]]) -> bytes:
    """A workbook of named sheets of rows; numbers stay numbers, anything else is text."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + types + "</Types>")
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="r{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r + 1}">{"".join(_cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate(rows))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def rows_of(df: DataFrame, titles: Sequence[str] | None = None) -> list[list]:
    """A bounded report as rows under its titles."""
    got = df.limit(MAX_REPORT_ROWS + 1).collect()
    if len(got) > MAX_REPORT_ROWS:
        raise ValueError(f"a report of more than {MAX_REPORT_ROWS} rows belongs in a table")
    plain = lambda v: v.isoformat() if isinstance(v, date) else v
    return [list(titles or df.columns), *([plain(v) for v in r] for r in got)]


def series_workbook(series: DataFrame) -> bytes:
    """Points of series with their unit and source, in order."""
    cols = ["metric", "period_label", "value", "unit", "currency", "document_id"]
    return xlsx({"Показатели": rows_of(series.orderBy("metric", "period_end").select(*cols), ["Показатель", "Период", "Значение", "Единица", "Валюта", "Документ"])})


def text_table(rows: Iterable[Sequence], widths: Sequence[int]) -> str:
    """Rows as lines of fixed-width columns; the first column is left-aligned, the others right."""
    line = lambda r: "  ".join(str(v)[:w].ljust(w) if k == 0 else str(v)[:w].rjust(w) for k, (v, w) in enumerate(zip(r, widths, strict=True))).rstrip()
    return "\n".join(map(line, rows))


def split_message(text: str, most: int = 4000) -> list[str]:
    """A long text in pieces: at paragraphs, else at lines, else wherever the limit falls."""
    out = []
    while len(text) > most:
        cut = max(text.rfind("\n\n", 0, most), 0) or max(text.rfind("\n", 0, most), 0) or most
        out.append(text[:cut])
        text = text[cut:].lstrip("\n")
    return [*out, text] if text or not out else out
