"""Queries of the scanner: the relational tables written as report files of each format, read, laid out, and asked for as facts.

The reports are made of whole tables (orders, customers, nations), one file a nation or a nation and year; the SQL works the
facts out from the tables and knows nothing of files, cells or layouts.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import date
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.operators import grid
from ledgermill.plans.testdata import table
from ledgermill.shared import written
from ledgermill.sources import grids, page_words, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TODAY = date(2026, 2, 10)
#: The tables' years end in 2001; reports speak of years that the period forms know.
SHIFT = 24
FILES = "doc_id string, path string, content binary"
#: Cyrillic letters as code page 1251 has them, and the Latin-1 characters of the same bytes.
CYRILLIC = "".join(map(chr, range(0x410, 0x450))) + "Ёё№—"
SAME_BYTES = "".join(map(chr, range(0xC0, 0x100))) + "\xa8\xb8\xb9\x97"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- writing files out of long cells (doc_id, row, col, text, number) ----------------------------------------------------


#: Lines of a csv file: longer tables go on in another one.
LINES = 100_000


def lines_of(cells: DataFrame, width: int, most: int | None = None) -> DataFrame:
    """(doc_id, first_row, rows): each row an array of ``width`` texts, blank where there is no cell; rows from 0, without gaps, ``most`` together."""
    at = F.map_from_entries(F.collect_list(F.struct("col", "text")))
    row = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.coalesce(F.try_element_at("at", c), F.lit("")))
    rows = cells.groupBy("doc_id", "row").agg(at.alias("at")).select("doc_id", "row", row.alias("cells"))
    first = F.floor(F.col("row") / most).cast("int") * most if most else F.lit(0)
    return rows.groupBy("doc_id", first.alias("first_row")).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda x: x["cells"]).alias("rows"))


def as_csv(cells: DataFrame, width: int) -> DataFrame:
    """Semicolons between cells; files of even names in UTF-8, the others in code page 1251. A table of more than LINES rows takes several files."""
    text = F.array_join(F.transform("rows", lambda r: F.array_join(r, ";")), "\n")
    old = F.encode(F.translate(text, CYRILLIC, SAME_BYTES), "ISO-8859-1")
    even = F.regexp_extract("doc_id", r"(\d+)$", 1).cast("int") % 2 == 0
    return lines_of(cells, width, LINES).select("doc_id", "first_row", F.concat("doc_id", F.lit(".csv")).alias("path"), F.when(even, F.encode(text, "UTF-8")).otherwise(old).alias("content"))


def as_html(cells: DataFrame, width: int) -> DataFrame:
    """A table whose title spans all columns."""
    row = lambda r, i: F.when(i == 0, F.concat(F.lit(f'<tr><th colspan="{width}">'), F.get(r, F.lit(0)), F.lit("</th></tr>"))).otherwise(F.concat(F.lit("<tr><td>"), F.array_join(r, "</td><td>"), F.lit("</td></tr>")))
    text = F.concat(F.lit("<html><body><p>Отчёт</p><table>"), F.array_join(F.transform("rows", row), "\n"), F.lit("</table></body></html>"))
    return lines_of(cells, width).select("doc_id", F.concat("doc_id", F.lit(".html")).alias("path"), F.encode(text, "UTF-8").alias("content"))


def as_text(cells: DataFrame, width: int) -> DataFrame:
    """Columns parted by four blanks."""
    text = F.array_join(F.transform("rows", lambda r: F.array_join(r, "    ")), "\n")
    return lines_of(cells, width).select("doc_id", F.concat("doc_id", F.lit(".txt")).alias("path"), F.encode(text, "UTF-8").alias("content"))


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def ods(rows: list[list[str]]) -> bytes:
    cell = lambda v: f'<t:table-cell o:value-type="string"><x:p>{escape(v)}</x:p></t:table-cell>' if v else "<t:table-cell/>"
    body = "".join(f"<t:table-row>{''.join(map(cell, r))}</t:table-row>" for r in rows)
    return zipped({"content.xml": f'<d xmlns:t="t" xmlns:o="o" xmlns:x="x"><t:table t:name="Лист">{body}</t:table></d>'})


def docx(rows: list[list[str]]) -> bytes:
    cell = lambda v: f"<w:tc><w:p><w:r><w:t>{escape(v)}</w:t></w:r></w:p></w:tc>"
    body = "".join(f"<w:tr>{''.join(map(cell, r))}</w:tr>" for r in rows)
    return zipped({"word/document.xml": f'<w:d xmlns:w="w"><w:body><w:p><w:r><w:t>Записка</w:t></w:r></w:p><w:tbl>{body}</w:tbl></w:body></w:d>'})


def xlsx(rows: list[list[str]]) -> bytes:
    number = lambda v: int(v.replace(" ", "")) if v.replace(" ", "").isdigit() else v or None
    return sinks.xlsx({"Лист": [[number(v) for v in r] for r in rows]})


def as_office(cells: DataFrame, width: int, ending: str) -> DataFrame:
    make = {"xlsx": xlsx, "ods": ods, "docx": docx}[ending]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "path": pdf["doc_id"] + f".{ending}", "content": [make([list(r) for r in rows]) for rows in pdf["rows"]]})

    return lines_of(cells, width).mapInPandas(run, FILES)


def scanned(files: DataFrame) -> DataFrame:
    rows = grid.scan(grids.grids(files), TODAY)
    return rows.select("doc_id", "sheet", "metric", "period_type", "period_label", "period_start", "period_end", F.col("value").cast("double").alias("value"), "unit", "currency", "variant", "section", "parent_hint", "is_total", "cell_ref", "layout")


# -- wide reports ----------------------------------------------------------------------------------------------------------


def sales(spark, sf) -> DataFrame:
    """Orders with their nation, segment, priority in words, day and amount."""
    t = lambda name: table(spark, sf, name)
    o = t("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), F.split_part("o_orderpriority", F.lit("-"), F.lit(2)).alias("prio"), "o_orderstatus", F.floor("o_totalprice").cast("long").alias("v"))
    n = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("doc_id"), F.col("c_mktsegment").alias("seg"))
    return o.join(n, F.col("o_custkey") == F.col("c_custkey")).withColumn("y", F.year("day") + SHIFT)


SALES = f"sales AS (SELECT o_orderkey, n_name AS doc_id, c_mktsegment AS seg, split_part(o_orderpriority, '-', 2) AS prio, CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) + {SHIFT} AS INTEGER) AS y, o_orderstatus, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
#: Years of the tables, so that every report has the same columns.
YEARS = tuple(range(1995 + SHIFT, 2002 + SHIFT))


def grouped(v: Column) -> Column:
    """12345 as «12 345»."""
    return F.translate(F.format_number(v, 0), ",", " ")


def const(docs: DataFrame, row: int, col: int, text: Column | str) -> DataFrame:
    return docs.select("doc_id", F.lit(row).alias("row"), F.lit(col).alias("col"), (F.lit(text) if isinstance(text, str) else text).alias("text"))


def wide_cells(spark, sf) -> DataFrame:
    """A report a nation: title with the unit, header, a numbering row, and per segment a section, its priorities, the total
    and, as a part of it, the number of orders; lines are numbered in a column before the names."""
    s = sales(spark, sf)
    signed = F.when(F.col("prio") == "LOW", -F.col("v")).otherwise(F.col("v"))
    part = s.groupBy("doc_id", "seg", F.lit(1).alias("ord"), "prio", "y").agg(F.sum(signed).alias("v"))
    total = s.groupBy("doc_id", "seg", F.lit(2).alias("ord"), F.lit("").alias("prio"), "y").agg(F.sum(signed).alias("v"))
    count = s.groupBy("doc_id", "seg", F.lit(3).alias("ord"), F.lit("").alias("prio"), "y").agg(F.count(F.lit(1)).alias("v"))
    values = part.unionByName(total).unionByName(count)
    heads = s.select("doc_id", "seg", F.lit(0).alias("ord"), F.lit("").alias("prio")).distinct()
    lines = values.select("doc_id", "seg", "ord", "prio").distinct().unionByName(heads).withColumn("row", 2 + F.row_number().over(Window.partitionBy("doc_id").orderBy("seg", "ord", "prio")))
    name = F.when(F.col("ord") == 0, F.col("seg")).when(F.col("ord") == 1, F.initcap("prio")).when(F.col("ord") == 2, "Итого").otherwise("в т.ч. заказов, шт")
    names = lines.select("doc_id", "row", F.lit(1).alias("col"), name.alias("text"))
    codes = lines.where("ord > 0").select("doc_id", "row", F.lit(0).alias("col"), (F.col("row") * 10).cast("string").alias("text"))
    years = F.sequence(F.lit(0), F.lit(len(YEARS) - 1))
    # A year without orders has a dash, a negative amount brackets.
    cells = lines.where("ord > 0").select("*", F.explode(years).alias("k")).withColumn("y", F.col("k") + YEARS[0]).join(values, ["doc_id", "seg", "ord", "prio", "y"], "left")
    shown = F.when(F.col("v").isNull(), "—").when(F.col("v") < 0, F.concat(F.lit("("), grouped(-F.col("v")), F.lit(")"))).otherwise(grouped(F.col("v")))
    body = cells.select("doc_id", "row", (F.col("k") + 2).alias("col"), shown.alias("text"))
    docs = s.select("doc_id").distinct()
    top = const(docs, 0, 0, F.concat(F.lit("Отчёт "), "doc_id", F.lit(", тыс. руб."))).union(const(docs, 1, 0, "№")).union(const(docs, 1, 1, "Показатель")).union(const(docs, 2, 1, "код строки"))
    for k, y in enumerate(YEARS):
        top = top.union(const(docs, 1, k + 2, f"{y} г.")).union(const(docs, 2, k + 2, str(k + 3)))
    return top.unionByName(names).unionByName(codes).unionByName(body)


def wide_sql(sheet: str) -> str:
    signed = "CASE WHEN prio = 'LOW' THEN -v ELSE v END"
    return f"""WITH {SALES},
vals AS (SELECT doc_id, seg, 1 AS ord, prio, y, sum({signed}) AS v FROM sales GROUP BY ALL UNION ALL SELECT doc_id, seg, 2, '', y, sum({signed}) FROM sales GROUP BY ALL UNION ALL SELECT doc_id, seg, 3, '', y, count(*) FROM sales GROUP BY ALL),
lines AS (SELECT *, 2 + row_number() OVER (PARTITION BY doc_id ORDER BY seg, ord, prio) AS row FROM (SELECT DISTINCT doc_id, seg, ord, prio FROM vals UNION SELECT DISTINCT doc_id, seg, 0, '' FROM sales)),
named AS (SELECT doc_id, prio, count(DISTINCT seg) AS segs FROM sales GROUP BY ALL)
SELECT doc_id, '{sheet}' AS sheet, CASE ord WHEN 1 THEN lower(prio) || CASE WHEN segs > 1 THEN ' (' || lower(seg) || ')' ELSE '' END WHEN 2 THEN lower(seg) || ' итого' ELSE lower(seg) || ' итого — заказов' END AS metric,
 'year' AS period_type, CAST(y AS VARCHAR) AS period_label, make_date(y, 1, 1) AS period_start, make_date(y, 12, 31) AS period_end, CAST(v AS DOUBLE) * CASE WHEN ord = 3 THEN 1 ELSE 1000 END AS value,
 CASE WHEN ord = 3 THEN 'шт' ELSE 'руб' END AS unit, 'RUB' AS currency, 'fact' AS variant, lower(seg) AS section, CASE WHEN ord = 3 THEN lower(seg) || ' итого' END AS parent_hint, ord = 2 AS is_total,
 chr(CAST(67 + y - {YEARS[0]} AS INTEGER)) || (row + 1) AS cell_ref, 'wide' AS layout
FROM vals JOIN lines USING (doc_id, seg, ord, prio) LEFT JOIN named USING (doc_id, prio)"""


WIDTH = 2 + len(YEARS)


@query(wide_sql("csv"))
def scan_wide_csv(spark, sf) -> DataFrame:
    return scanned(as_csv(wide_cells(spark, sf), WIDTH))


@query(wide_sql("таблица 1"))
def scan_wide_html(spark, sf) -> DataFrame:
    return scanned(as_html(wide_cells(spark, sf), WIDTH))


@query(wide_sql("Лист"))
def scan_wide_xlsx(spark, sf) -> DataFrame:
    return scanned(as_office(wide_cells(spark, sf), WIDTH, "xlsx"))


@query(wide_sql("Лист"))
def scan_wide_ods(spark, sf) -> DataFrame:
    return scanned(as_office(wide_cells(spark, sf), WIDTH, "ods"))


@query(wide_sql("таблица 1"))
def scan_wide_docx(spark, sf) -> DataFrame:
    return scanned(as_office(wide_cells(spark, sf), WIDTH, "docx"))


#: Lines of a page in the reports by pages.
PAGE_LINES = 9


def words_of(cells: DataFrame) -> DataFrame:
    """The report's cells as words on pages: names begin where their column does, amounts end there, lines waver by a unit.

    Every second document repeats the header and the numbering row at the head of each page; all have a page number at the
    foot, and a first page that states nothing but who the report is for.
    """
    page = F.floor(F.greatest(F.col("row") - 3, F.lit(0)) / PAGE_LINES).cast("int")
    again = F.pmod(F.length("doc_id"), F.lit(2)) == 0
    last = cells.groupBy("doc_id").agg(F.max(page).alias("last"))
    own = cells.select("doc_id", page.alias("page"), F.when(page == 0, F.col("row")).otherwise(F.col("row") - page * PAGE_LINES - 3 + F.when(again, 2).otherwise(0)).alias("line"), "col", "text")
    repeated = cells.where(F.col("row").isin(1, 2)).join(last.where(again), "doc_id").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("page"), (F.col("row") - 1).alias("line"), "col", "text").where("page > 0")
    foot = last.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("page")).select("doc_id", "page", F.lit(40).alias("line"), F.lit(4).alias("col"), F.concat(F.lit("стр. "), (F.col("page") + 2).cast("string")).alias("text"))
    cover = last.select("doc_id", F.lit(-1).alias("page"), F.lit(20).alias("line"), F.lit(1).alias("col"), F.lit("Отчёт составлен для совета директоров").alias("text"))
    rows = own.unionByName(repeated).unionByName(foot).unionByName(cover).where("text <> ''")
    left = F.when(F.col("col") == 0, 40.0).when(F.col("col") == 1, 90.0).otherwise(200.0 + 100 * F.col("col") - 5 * F.length("text"))
    spread = rows.select("doc_id", (F.col("page") + 2).alias("page"), "line", left.alias("left"), F.posexplode(F.split("text", " ")).alias("at", "word"), "text")
    before = F.length(F.array_join(F.slice(F.split("text", " "), F.lit(1), F.col("at")), " ")) + F.when(F.col("at") > 0, 1).otherwise(0)
    x0 = F.col("left") + 5.0 * before
    return spread.select("doc_id", "page", x0.alias("x0"), (x0 + 5.0 * F.length("word")).alias("x1"), (60.0 + 14 * F.col("line") + F.pmod(F.hash("word"), F.lit(3)) - 1).alias("y"), F.col("word").alias("text"))


@query(wide_sql("стр. 2, таблица 1"))
def scan_wide_pages(spark, sf) -> DataFrame:
    """The wide reports as words on pages: the tables go on over page breaks, with the header again or without it."""
    words = written(words_of(written(wide_cells(spark, sf), "report-cells")), "page-words")
    rows = grid.scan(page_words.page_grid(words), TODAY)
    return rows.select("doc_id", "sheet", "metric", "period_type", "period_label", "period_start", "period_end", F.col("value").cast("double").alias("value"), "unit", "currency", "variant", "section", "parent_hint", "is_total", "cell_ref", "layout")


@query(f"""WITH {SALES}, p AS (SELECT doc_id, seg, y, CASE o_orderstatus WHEN 'O' THEN 'plan' WHEN 'F' THEN 'fact' END AS variant, sum(v) AS v, CAST(split_part(doc_id, '_', 2) AS INTEGER) % 2 AS odd FROM sales WHERE o_orderstatus IN ('O', 'F') GROUP BY ALL)
SELECT doc_id, lower(seg) AS metric, CAST(y AS VARCHAR) AS period_label, variant, CAST(v AS DOUBLE) * 1000000 AS value FROM p""")
def scan_plan_and_fact(spark, sf) -> DataFrame:
    """Two columns a year, plan and fact: said in a row under the years, or (odd files) behind the year in brackets."""
    s = sales(spark, sf).where(F.col("o_orderstatus").isin("O", "F")).withColumn("odd", F.split_part("doc_id", F.lit("_"), F.lit(2)).cast("int") % 2 == 1)
    sums = s.groupBy("doc_id", "odd", "seg", "y", (F.col("o_orderstatus") == "F").cast("int").alias("second")).agg(F.sum("v").alias("v"))
    rows = s.select("doc_id", "odd", "seg").distinct().withColumn("row", F.row_number().over(Window.partitionBy("doc_id").orderBy("seg")) + F.when(F.col("odd"), 1).otherwise(2))
    body = sums.join(rows, ["doc_id", "odd", "seg"]).select("doc_id", "row", (1 + 2 * (F.col("y") - YEARS[0]) + F.col("second")).cast("int").alias("col"), grouped(F.col("v")).alias("text"))
    names = rows.select("doc_id", "row", F.lit(0).alias("col"), F.col("seg").alias("text"))
    docs = s.select("doc_id", "odd").distinct()
    top = const(docs, 0, 0, "Показатели, млн руб.").union(const(docs, 1, 0, "Показатель"))
    for k, y in enumerate(YEARS):
        for i, variant in enumerate(("план", "факт")):
            top = top.union(const(docs, 1, 1 + 2 * k + i, F.when(F.col("odd"), f"{y} ({variant})").otherwise(str(y)))).union(const(docs.where("not odd"), 2, 1 + 2 * k + i, variant))
    found = scanned(as_csv(top.unionByName(names).unionByName(body), 1 + 2 * len(YEARS)))
    return found.select("doc_id", "metric", "period_label", "variant", "value")


# -- other layouts -----------------------------------------------------------------------------------------------------------

MONTHS = ("январь", "февраль", "март", "апрель", "май", "июнь", "июль", "август", "сентябрь", "октябрь", "ноябрь", "декабрь")


def months_sql(months: tuple[str, ...] = MONTHS) -> str:
    return "[" + ", ".join(f"'{m}'" for m in months) + "]"


def month_sums(spark, sf) -> DataFrame:
    return sales(spark, sf).groupBy("doc_id", "y", F.month("day").alias("m")).agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SALES}, m AS (SELECT doc_id || '-' || y AS doc_id, y, CAST(month(day) AS INTEGER) AS m, sum(v) AS v, count(*) AS n FROM sales GROUP BY ALL), k AS (SELECT doc_id FROM m GROUP BY doc_id HAVING count(*) >= 3)
SELECT doc_id, 'текст' AS sheet, metric, 'month' AS period_type, lpad(CAST(m AS VARCHAR), 2, '0') || '.' || y AS period_label, make_date(y, m, 1) AS period_start, last_day(make_date(y, m, 1)) AS period_end, value, unit, currency, 'vertical' AS layout
FROM (SELECT *, 'выручка' AS metric, CAST(v AS DOUBLE) * 1000 AS value, 'руб' AS unit, 'RUB' AS currency FROM m UNION ALL SELECT *, 'заказы', CAST(n AS DOUBLE), 'шт', 'RUB' FROM m) JOIN k USING (doc_id)""")
def scan_vertical_text(spark, sf) -> DataFrame:
    """Plain text, months down: columns parted by blanks, the thousands of a number by one."""
    m = month_sums(spark, sf).withColumn("doc_id", F.concat_ws("-", "doc_id", "y"))
    row = F.row_number().over(Window.partitionBy("doc_id").orderBy("m"))
    rows = m.withColumn("row", row).withColumn("month", F.element_at(F.array(*map(F.lit, MONTHS)), F.col("m")))
    cell = lambda c, text: rows.select("doc_id", "row", F.lit(c).alias("col"), text.alias("text"))
    docs = m.select("doc_id").distinct()
    top = const(docs, 0, 0, "Месяц").union(const(docs, 0, 1, "Выручка, тыс. руб.")).union(const(docs, 0, 2, "Заказы"))
    cells = top.unionByName(cell(0, F.concat_ws(" ", "month", "y"))).unionByName(cell(1, grouped(F.col("v")))).unionByName(cell(2, F.concat(F.col("n").cast("string"), F.lit(" шт"))))
    return scanned(as_text(cells, 3)).select("doc_id", "sheet", "metric", "period_type", "period_label", "period_start", "period_end", "value", "unit", "currency", "layout")


@query(f"""WITH {SALES}, s AS (SELECT doc_id || '-' || y || '-' || month(day) AS doc_id, y, CAST(month(day) AS INTEGER) AS m, lower(seg) AS seg, sum(v) AS v FROM sales GROUP BY ALL), k AS (SELECT doc_id FROM s GROUP BY doc_id HAVING count(*) >= 3),
r AS (SELECT * FROM s JOIN k USING (doc_id)), b AS (SELECT doc_id, y, m, seg AS metric, CAST(v AS DOUBLE) AS value, 'сделки' AS section, 'сделки' AS parent_hint, false AS is_total FROM r
 UNION ALL SELECT doc_id, y, m, 'сделки', CAST(sum(v) AS DOUBLE), NULL, NULL, true FROM r GROUP BY ALL)
SELECT doc_id, metric, CASE m % 3 WHEN 0 THEN 'month' WHEN 1 THEN 'year' ELSE 'quarter' END AS period_type,
 CASE m % 3 WHEN 0 THEN make_date(y, m, 1) WHEN 1 THEN make_date(y, 1, 1) ELSE make_date(y, (m - 1) // 3 * 3 + 1, 1) END AS period_start,
 CASE m % 3 WHEN 0 THEN last_day(make_date(y, m, 1)) WHEN 1 THEN make_date(y, 12, 31) ELSE last_day(make_date(y, (m - 1) // 3 * 3 + 3, 1)) END AS period_end,
 value * 1000 AS value, section, parent_hint, is_total, 'categorical' AS layout FROM b""")
def scan_categorical_csv(spark, sf) -> DataFrame:
    """Names and values under a heading that names a month, a year or a quarter; the total is worked out."""
    s = sales(spark, sf).withColumn("m", F.month("day")).groupBy(F.concat_ws("-", "doc_id", "y", "m").alias("doc_id"), "y", "m", "seg").agg(F.sum("v").alias("v"))
    rows = s.withColumn("row", F.row_number().over(Window.partitionBy("doc_id").orderBy("seg")))
    year = F.col("y").cast("string")
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.col("m"))
    said = F.when(F.col("m") % 3 == 0, F.concat_ws(" ", F.lit("за"), month, year, F.lit("сделки, тыс. руб."))).when(F.col("m") % 3 == 1, F.concat_ws(" ", F.lit("за"), year, F.lit("год сделки, тыс. руб."))).otherwise(F.concat(F.lit("за "), F.ceil(F.col("m") / 3).cast("string"), F.lit(" кв. "), year, F.lit(" сделки, тыс. руб.")))
    top = s.select("doc_id", "m", "y").distinct().select("doc_id", F.lit(0).alias("row"), F.lit(0).alias("col"), said.alias("text"))
    cells = top.unionByName(rows.select("doc_id", "row", F.lit(0).alias("col"), F.col("seg").alias("text"))).unionByName(rows.select("doc_id", "row", F.lit(1).alias("col"), grouped(F.col("v")).alias("text")))
    return scanned(as_csv(cells, 2)).select("doc_id", "metric", "period_type", "period_start", "period_end", "value", "section", "parent_hint", "is_total", "layout")


#: What orders are said to be, by their key, with the category that each has.
PURPOSES = (("Аренда офиса", "Аренда"), ("Зарплата за месяц", "Зарплата"), ("Комиссия банка", "Банк"), ("Поставщик труб", "Поставщики и подрядчики"), ("Такси до склада", "Транспорт"), ("Нечто иное", "Прочее"))


def statements(spark, sf) -> DataFrame:
    """Statements of a nation and year: one line an order, with its day, purpose and amount."""
    purpose = F.element_at(F.array(*(F.lit(p) for p, _ in PURPOSES)), (F.pmod("o_orderkey", F.lit(len(PURPOSES))) + 1).cast("int"))
    s = sales(spark, sf).select(F.concat_ws("-", "doc_id", "y").alias("doc_id"), F.add_months("day", 12 * SHIFT).alias("day"), "o_orderkey", "v", purpose.alias("purpose"))
    rows = s.withColumn("row", F.row_number().over(Window.partitionBy("doc_id").orderBy("day", "o_orderkey")))
    line = F.array(F.date_format("day", "dd.MM.yyyy"), F.concat_ws(" ", "purpose", F.lit("по заказу"), F.concat(F.lit("№"), F.col("o_orderkey").cast("string"))), grouped(F.col("v")))
    head = F.array(F.lit("Дата"), F.lit("Назначение"), F.lit("Сумма"))
    both = rows.select("doc_id", "row", line.alias("line")).withColumn("lines", F.when(F.col("row") == 1, F.array(F.struct(F.lit(0).alias("row"), head.alias("line")), F.struct("row", "line"))).otherwise(F.array(F.struct("row", "line"))))
    return both.select("doc_id", F.explode("lines").alias("x")).select("doc_id", "x.row", F.posexplode("x.line").alias("col", "text"))


_PURPOSE = "list_extract([" + ", ".join(f"'{p}'" for p, _ in PURPOSES) + f"], CAST(o_orderkey % {len(PURPOSES)} + 1 AS INTEGER))"
_CATEGORY = "list_extract([" + ", ".join(f"'{c}'" for _, c in PURPOSES) + f"], CAST(o_orderkey % {len(PURPOSES)} + 1 AS INTEGER))"
STATEMENTS = f"""st AS (SELECT doc_id || '-' || y AS doc_id, CAST(day + INTERVAL {SHIFT} YEAR AS DATE) AS day, o_orderkey, v, {_PURPOSE} || ' по заказу №' || o_orderkey AS description, {_CATEGORY} AS category FROM sales),
lg AS (SELECT * FROM st WHERE doc_id IN (SELECT doc_id FROM st GROUP BY doc_id HAVING count(*) >= 3))"""


@query(f"""WITH {SALES}, {STATEMENTS} SELECT doc_id, 'csv' AS sheet, day AS "when", CAST(v AS DOUBLE) AS value, description, category, 'сумма' AS header, 'C' || (1 + row_number() OVER (PARTITION BY doc_id ORDER BY day, o_orderkey)) AS cell_ref FROM lg""")
def scan_ledger_csv(spark, sf) -> DataFrame:
    """Dated operations of statements, categorised by what they are for."""
    found = grid.operations(grids.grids(as_csv(statements(spark, sf), 3)), TODAY)
    return found.select("doc_id", "sheet", "when", F.col("value").cast("double").alias("value"), "description", "category", "header", "cell_ref")


@query(f"""WITH {SALES}, v AS (SELECT doc_id, seg, y, sum(v) AS v FROM sales GROUP BY ALL), l AS (SELECT doc_id, 2 AS row, 'Показатель | ' || string_agg(DISTINCT CAST(y AS VARCHAR), ' | ' ORDER BY CAST(y AS VARCHAR)) AS line FROM (SELECT DISTINCT doc_id, unnest(range({YEARS[0]}, {YEARS[-1] + 1})) AS y FROM v) GROUP BY doc_id
 UNION ALL SELECT doc_id, 2 + row_number() OVER (PARTITION BY doc_id ORDER BY seg), seg || ' | ' || string_agg(CAST(v AS VARCHAR), ' | ' ORDER BY y) FROM v GROUP BY doc_id, seg)
SELECT doc_id, 'csv' AS sheet, left('Отчёт' || chr(10) || string_agg(line, chr(10) ORDER BY row), 4000) AS body FROM l GROUP BY doc_id""")
def scan_sheet_texts(spark, sf) -> DataFrame:
    """Sheets as text for search: cells joined by bars."""
    return grid.sheet_texts(grids.grids(as_csv(segment_cells(spark, sf), 1 + len(YEARS)))).select("doc_id", "sheet", "body")


def segment_cells(spark, sf) -> DataFrame:
    """Segments by year, without units, sections or totals."""
    v = sales(spark, sf).groupBy("doc_id", "seg", "y").agg(F.sum("v").alias("v"))
    rows = v.select("doc_id", "seg").distinct().withColumn("row", 1 + F.row_number().over(Window.partitionBy("doc_id").orderBy("seg")))
    body = v.join(rows, ["doc_id", "seg"]).select("doc_id", "row", (F.col("y") - YEARS[0] + 1).cast("int").alias("col"), F.col("v").cast("string").alias("text"))
    docs = v.select("doc_id").distinct()
    top = const(docs, 0, 0, "Отчёт").union(const(docs, 1, 0, "Показатель"))
    for k, y in enumerate(YEARS):
        top = top.union(const(docs, 1, k + 1, str(y)))
    return top.unionByName(rows.select("doc_id", "row", F.lit(0).alias("col"), F.col("seg").alias("text"))).unionByName(body)


@query(f"""WITH {SALES}, v AS (SELECT doc_id, seg, y, sum(v) AS v FROM sales GROUP BY ALL), l AS (SELECT doc_id, 'Показатель «' || lower(seg) || '»: ' || string_agg(y || ' — ' || v || '.000000', ', ' ORDER BY y) || ';' AS line, row_number() OVER (PARTITION BY doc_id ORDER BY lower(seg)) AS r FROM v GROUP BY doc_id, seg)
SELECT doc_id, 'csv' AS sheet, left(string_agg(line, chr(10) ORDER BY line), 1500) AS body FROM l WHERE r <= 60 GROUP BY doc_id""")
def scan_fact_texts(spark, sf) -> DataFrame:
    """Sentences of a sheet's facts."""
    facts = grid.scan(grids.grids(as_csv(segment_cells(spark, sf), 1 + len(YEARS))), TODAY)
    return grid.fact_texts(facts).select("doc_id", "sheet", "body")


@query(f"""WITH {SALES}, t AS (SELECT doc_id, lower(seg) AS section, y, CAST(sum(CASE WHEN prio = 'LOW' THEN -v ELSE v END) AS DOUBLE) * 1000 AS parts, o.n FROM sales JOIN (SELECT doc_id, seg, y, count(*) AS n FROM sales GROUP BY ALL) o USING (doc_id, seg, y) GROUP BY ALL),
w AS (SELECT *, parts + CASE WHEN n % 2 = 0 THEN parts * 0.5 ELSE 0 END AS value FROM t) SELECT doc_id, section, make_date(y, 12, 31) AS period_end, value, parts FROM w WHERE n % 2 = 0 AND parts <> 0""")
def scan_totals_that_miss(spark, sf) -> DataFrame:
    """Totals of sections held against their parts: those of an even number of orders are half too large."""
    s = sales(spark, sf)
    facts = grid.scan(grids.grids(as_csv(wide_cells(spark, sf), WIDTH)), TODAY)
    even = s.groupBy("doc_id", F.lower("seg").alias("section"), F.make_date("y", F.lit(12), F.lit(31)).alias("period_end")).agg((F.count(F.lit(1)) % 2 == 0).alias("even"))
    wrong = facts.join(even, ["doc_id", "section", "period_end"], "left").withColumn("value", F.when(F.col("is_total") & F.col("even"), F.col("value") * F.lit("1.5").cast("decimal(2,1)")).otherwise(F.col("value")).cast("decimal(28,6)")).drop("even")
    return grid.check_totals(wrong).select("doc_id", "section", "period_end", F.col("value").cast("double").alias("value"), F.col("parts").cast("double").alias("parts"))


@query("""SELECT n_name AS doc_id, CASE n_nationkey % 4 WHEN 0 THEN 1000 WHEN 1 THEN 1000000 WHEN 2 THEN 1000000000 END::BIGINT AS multiplier, CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE 'RUB' END AS currency FROM nation WHERE n_nationkey % 4 <> 3""")
def document_units(spark, sf) -> DataFrame:
    """The unit that a document states in its text."""
    said = F.element_at(F.array(F.lit("Единица измерения: тыс. руб.\nОтчёт"), F.lit("суммы (в млн рублей), округлены"), F.lit("Единицы измерения - млрд руб"), F.lit("без единиц")), (F.col("n_nationkey") % 4 + 1).cast("int"))
    texts = table(spark, sf, "nation").select(F.col("n_name").alias("doc_id"), said.alias("text"))
    return grid.document_units(texts).select("doc_id", "unit.multiplier", "unit.currency")


@query(f"""WITH {SALES}, v AS (SELECT doc_id, seg, y, sum(v) AS v, CAST(split_part(doc_id, '_', 2) AS INTEGER) % 2 AS odd FROM sales GROUP BY ALL)
SELECT doc_id, lower(seg) AS metric, CAST(y AS VARCHAR) AS period_label, CAST(v AS DOUBLE) * CASE odd WHEN 1 THEN 1000 ELSE 1 END AS value, CASE odd WHEN 1 THEN 'RUB' END AS currency FROM v""")
def scan_document_unit(spark, sf) -> DataFrame:
    """Sheets without a unit beside a document's text that states one (odd files)."""
    said = F.when(F.split_part("doc_id", F.lit("_"), F.lit(2)).cast("int") % 2 == 1, "Единица измерения: тыс. руб.").otherwise("Отчёт")
    cells = segment_cells(spark, sf)
    units = grid.document_units(cells.select("doc_id").distinct().withColumn("text", said))
    found = grid.scan(grids.grids(as_csv(cells, 1 + len(YEARS))), TODAY, units)
    return found.select("doc_id", "metric", "period_label", F.col("value").cast("double").alias("value"), "currency")


@query("SELECT n_name AS doc_id, n_nationkey % 4 = 0 AS read, CASE n_nationkey % 4 WHEN 1 THEN 'BadZipFile' WHEN 2 THEN 'ValueError' WHEN 3 THEN 'ParseError' END AS reason FROM nation")
def scan_problem_files(spark, sf) -> DataFrame:
    """Damaged archives, unknown endings and broken XML give a reason each and leave the other files alone."""
    n = table(spark, sf, "nation").withColumn("k", F.col("n_nationkey") % 4)

    def broken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = {0: ("csv", b"a;1\nb;2\n"), 1: ("xlsx", b"no archive"), 2: ("exe", b""), 3: ("ods", zipped({"content.xml": "<open"}))}
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["n_name"], "path": [f"x.{make[k][0]}" for k in pdf["k"]], "content": [make[k][1] for k in pdf["k"]]})

    cells = grids.grids(n.select("n_name", "k").mapInPandas(broken, FILES), strict=False)
    kind = F.split_part("reason", F.lit(":"), F.lit(1))
    bad = grids.problems(cells).select("doc_id", F.lit(False).alias("read"), kind.alias("reason"))
    return bad.unionByName(grids.usable(cells).select("doc_id", F.lit(True).alias("read"), F.lit(None).cast("string").alias("reason")).distinct())
