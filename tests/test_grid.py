from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgermill.functions.numbers import parse_number, parse_number_with_unit
from ledgermill.functions.periods import parse
from ledgermill.operators import grid
from ledgermill.plans import catalog_scan
from ledgermill.schemas import GRID
from ledgermill.sources import grids

TODAY = date(2026, 2, 10)


def facts(spark, rows, doc="doc", sheet="лист"):
    cells = [(doc, sheet, r, c, str(v), "text") for r, row in enumerate(rows) for c, v in enumerate(row) if v not in ("", None)]
    return [r.asDict() for r in grid.scan(spark.createDataFrame(cells, GRID), TODAY).collect()]


def values(found, **where):
    return {(f["metric"], f["period_label"], f["variant"]): float(f["value"]) for f in found if all(f[k] == v for k, v in where.items())}


def test_wide_with_unit_brackets_and_gaps(spark):
    got = facts(spark, [["Отчёт, тыс. руб."], ["Показатель", "2024", "2025"], ["Выручка", "41 200", "45 800"], ["Прочие расходы", "(500)", "—"]])
    assert values(got) == {("выручка", "2024", "fact"): 41_200_000, ("выручка", "2025", "fact"): 45_800_000, ("прочие расходы", "2024", "fact"): -500_000}
    assert {(f["unit"], f["currency"], f["layout"]) for f in got} == {("руб", "RUB", "wide")}


def test_two_tier_header_keeps_plan_and_fact(spark):
    got = facts(spark, [["тыс. руб.", "2024", "2024", "2025"], ["", "план", "факт", "факт"], ["Выручка", "41 200", "41 950", "45 000"]])
    assert values(got) == {("выручка", "2024", "plan"): 41_200_000, ("выручка", "2024", "fact"): 41_950_000, ("выручка", "2025", "fact"): 45_000_000}


def test_sections_totals_and_parts(spark):
    got = facts(spark, [["Показатель", "2024", "2025"], ["Расходы"], ["Зарплаты", "10", "12"], ["Аренда", "5", "6"], ["Итого", "15", "18"], ["в т.ч. коммунальные", "1", "2"], ["Прочее, млн руб.", "1,2", ""]])
    v = values(got)
    assert v["расходы итого", "2025", "fact"] == 18 and v["расходы итого — коммунальные", "2024", "fact"] == 1
    assert v["прочее", "2024", "fact"] == 1_200_000
    assert {f["section"] for f in got if f["metric"] == "зарплаты"} == {"расходы"}
    assert {f["is_total"] for f in got if f["metric"] == "расходы итого"} == {True}


def test_vertical_with_title_and_dashes(spark):
    got = facts(spark, [["Помесячно, тыс. руб."], ["№", "Месяц", "Выручка", "Расходы"], ["1", "январь 2024", "1 200", "-"], ["2", "февраль 2024", "1 300", "800"], ["3", "март 2024", "1 400", "900"]])
    v = values(got)
    assert v["выручка", "01.2024", "fact"] == 1_200_000 and ("расходы", "01.2024", "fact") not in v


def test_categorical_with_and_without_year(spark):
    rows = [["за 2025 год сделки заключенные"], ["сайт", "436350"], ["2 гис", "2116040"], ["авито", "276000"]]
    got = facts(spark, rows)
    assert values(got, is_total=True) == {("сделки заключенные", "2025", "fact"): 2_828_390}
    assert len(got) == 4 and all(f["warning"] is None for f in got)
    none = facts(spark, [["сделки"], *rows[1:]])
    assert {f["period_label"] for f in none} == {"2026"} and all(f["warning"] for f in none)
    assert {f["period_label"] for f in facts(spark, [["сделки"], *rows[1:]], doc="сделки 2024.csv")} == {"2024"}


def test_statement_is_a_ledger(spark):
    rows = [["Дата", "Назначение", "Сумма"], ["12.01.2026", "Аренда офиса", "120 000"], ["25.01.2026", "Зарплата", "500000"], ["03.02.2026", "Комиссия банка", "1 500"], ["10.02.2026", "Поставщик труб", "390000"]]
    cells = [("d", "s", r, c, v, "text") for r, row in enumerate(rows) for c, v in enumerate(row)]
    df = spark.createDataFrame(cells, GRID)
    got = {(str(r["when"]), float(r["value"]), r["category"], r["header"]) for r in grid.operations(df, TODAY).collect()}
    assert got == {("2026-01-12", 120000.0, "Аренда", "сумма"), ("2026-01-25", 500000.0, "Зарплата", "сумма"), ("2026-02-03", 1500.0, "Банк", "сумма"), ("2026-02-10", 390000.0, "Поставщики и подрядчики", "сумма")}
    assert grid.scan(df, TODAY).count() == 0


def test_same_name_in_two_sections(spark):
    got = facts(spark, [["Показатель", "2024", "2025"], ["I. Внеоборотные активы"], ["Прочие активы", "1", "2"], ["II. Оборотные активы"], ["Прочие активы", "3", "4"]])
    assert {f["metric"] for f in got} == {"прочие активы (внеоборотные активы)", "прочие активы (оборотные активы)"}


def test_totals_check(spark):
    def gaps(total):
        rows = [["Показатель", "2024", "2025"], ["Расходы"], ["Зарплаты", "10", "12"], ["Аренда", "5", "6"], ["Итого", total, "18"]]
        cells = [("d", "s", r, c, v, "text") for r, row in enumerate(rows) for c, v in enumerate(row)]
        return grid.check_totals(grid.scan(spark.createDataFrame(cells, GRID), TODAY)).count()

    assert gaps("15") == 0 and gaps("20") == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Показатель;2023;2024\nВыручка;10000;12000\nРасходы;8000;9000\n".encode("cp1251"))
    (tmp_path / "b.html").write_text("<table><tr><th>Показатель<th>2023<th>2024</tr><tr><td>Выручка<td>1<td>2</tr><tr><td colspan=3>x</table>", encoding="utf-8")
    (tmp_path / "c.txt").write_text("Показатель    2023    2024\nВыручка    5    6\nРасходы    7    8\n", encoding="utf-8")
    (tmp_path / "copy.csv").write_bytes((tmp_path / "a.csv").read_bytes())
    files = grids.folder(spark, f"file://{tmp_path}")
    assert files.count() == 3
    got = grid.scan(grids.grids(files), TODAY).collect()
    assert {float(r["value"]) for r in got if r["metric"] == "выручка"} == {10000.0, 12000.0, 1.0, 2.0, 5.0, 6.0}


def office(path, parts):
    import zipfile

    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def test_office_files(spark, tmp_path):
    office(tmp_path / "a.xlsx", {
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="Отчёт" r:id="x1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="x1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>Показатель</t></si><si><t>Выручка</t></si></sst>",
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>2023</v></c><c r="D1"><v>2024</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>10.5</v></c><c r="C2"><v>11</v></c><c r="D2"><v>12</v></c></row></sheetData><mergeCells><mergeCell ref="B1:C1"/></mergeCells></worksheet>',
    })
    office(tmp_path / "b.ods", {"content.xml": '<d xmlns:t="t" xmlns:o="o" xmlns:x="x"><t:table t:name="Лист"><t:table-row><t:table-cell o:value-type="string"><x:p>Показатель</x:p></t:table-cell><t:table-cell o:value-type="float" o:value="2023"/><t:table-cell o:value-type="float" o:value="2024"/></t:table-row><t:table-row><t:table-cell o:value-type="string"><x:p>Выручка</x:p></t:table-cell><t:table-cell o:value-type="float" o:value="7" t:number-columns-repeated="2"/></t:table-row></t:table></d>'})
    office(tmp_path / "c.docx", {"word/document.xml": '<w:d xmlns:w="w"><w:body><w:p><w:r><w:t>Записка</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:t>Показатель</w:t></w:p></w:tc><w:tc><w:p><w:t>2023</w:t></w:p></w:tc><w:tc><w:p><w:t>2024</w:t></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:t>Выручка</w:t></w:p></w:tc><w:tc><w:p><w:t>3</w:t></w:p></w:tc><w:tc><w:p><w:t>4</w:t></w:p></w:tc></w:tr></w:tbl></w:body></w:d>'})
    cells = grids.grids(grids.folder(spark, f"file://{tmp_path}"))
    assert {r["sheet"] for r in cells.collect()} == {"Отчёт", "Лист", "таблица 1", "текст"}
    got = sorted(float(r["value"]) for r in grid.scan(cells, TODAY).where("metric = 'выручка'").collect())
    assert got == [3.0, 4.0, 7.0, 7.0, 10.5, 11.0, 12.0]


def test_guards(spark):
    with pytest.raises(ValueError, match="unpacks"):
        grids.opened(_bomb())
    bad = spark.createDataFrame([("d", "x.exe", bytearray(b""))], "doc_id string, path string, content binary")
    with pytest.raises(Exception, match="no reader"):
        grids.grids(bad).collect()


def _bomb():
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k in range(grids.MAX_ENTRIES + 1):
            z.writestr(str(k), b"")
    return out.getvalue()


def test_text_grid(spark):
    df = spark.createDataFrame([("a", "x  1\ny  2\nz  3"), ("b", "x  1\ny  2"), ("c", None)], "doc_id string, text string")
    assert {(r["doc_id"], r["row"], r["col"], r["raw"]) for r in grids.text_grid(df).collect()} == {("a", r, c, v) for r, row in enumerate(("x1", "y2", "z3")) for c, v in enumerate(row)}


def test_period_inside_titles():
    said = {
        "Сделки_1 кв. 2026.xlsx": ("quarter", date(2026, 1, 1), date(2026, 3, 31)),
        "за январь 2026 сделки": ("month", date(2026, 1, 1), date(2026, 1, 31)),
        "сделки 2026-02.csv": ("month", date(2026, 2, 1), date(2026, 2, 28)),
        "итоги, 2 полугодие 2025": ("halfyear", date(2025, 7, 1), date(2025, 12, 31)),
        "за 2025 год сделки": ("year", date(2025, 1, 1), date(2025, 12, 31)),
        "отчёт(2024)": ("year", date(2024, 1, 1), date(2024, 12, 31)),
    }
    for text, want in said.items():
        p, found = grid.period_inside(text)
        assert (p.ptype, p.start, p.end) == want and found, text
    assert grid.period_inside("без периода 12345") == (None, "")


def test_ods_repeats(tmp_path):
    office(tmp_path / "r.ods", {"content.xml": '<d xmlns:t="t" xmlns:o="o" xmlns:x="x"><t:table t:name="Л"><t:table-row t:number-rows-repeated="300"><t:table-cell o:value-type="float" o:value="7"/></t:table-row><t:table-row t:number-rows-repeated="40"><t:table-cell/></t:table-row><t:table-row><t:table-cell o:value-type="string"><x:p>end</x:p></t:table-cell></t:table-row></t:table></d>'})
    cells = list(grids.ods_cells((tmp_path / "r.ods").read_bytes()))
    assert [c[1] for c in cells] == [*range(300), 340] and cells[-1][3] == "end"


def test_problem_files_leave_the_others_alone(spark):
    files = spark.createDataFrame([("a", "a.csv", bytearray(b"x;1\ny;2\n")), ("b", "b.xlsx", bytearray(b"none")), ("c", "c.pdf", bytearray(b""))], "doc_id string, path string, content binary")
    cells = grids.grids(files, strict=False)
    assert {r["doc_id"] for r in grids.problems(cells).collect()} == {"b", "c"}
    assert {r["raw"] for r in grids.usable(cells).collect()} == {"x", "1", "y", "2"}


def test_operations_are_those_of_the_sheets_walk(spark):
    """Ties of days and lengths, several amounts, units in cells, a header's scale, gaps, short sheets, too few days, a period across."""
    days = [f"{d:02d}.03.2020" for d in range(1, 10)]
    docs = {
        "plain": [["Дата", "Назначение", "Сумма, тыс. руб."], *([d, f"такси {k}", f"{k} 500"] for k, d in enumerate(days, 1))],
        "two": [["Дата", "Приход", "", "Расход"], *([d, str(k), "ab", "5 руб.", "cd"] for k, d in enumerate(days))],
        "gaps": [["", ""], *([d if k % 2 else "нет", "" if k == 4 else f"{k},5", "за два года"] for k, d in enumerate(days, 1))],
        "short": [["Дата", "Сумма"], [days[0], "1"], [days[1], "2"]],
        "few": [["Дата", "Сумма"], *([days[0] if k < 3 else "x", "7"] for k in range(20))],
        "wide": [["Показатель", "2024", "2025"], *([d, "1", "2"] for d in days)],
        "headed": [["Показатель", "2024"], *([d, "1"] for d in days)],
        "far": [["" for _ in range(30)], *([d, *("" for _ in range(28)), "(3)"] for d in days)],
    }
    cells = [(doc, "млн", r, c, v, "text") for doc, rows in docs.items() for r, row in enumerate(rows) for c, v in enumerate(row) if v]
    cells += [(None, "т", r, c, v, kind) for r, d in enumerate(["2020-03-01", "2020-03-02", "2020-03-03", "2020-03-04"]) for c, (v, kind) in enumerate([(d, "date"), ("7.5", "number"), ("x" * 300, "text")])]
    df = spark.createDataFrame(cells, GRID)
    want = set()
    for doc in [*docs, None]:
        sheet = grid.sheet_of(grid.annotated(df.where(df.doc_id.eqNullSafe(doc))).toPandas())
        want |= {(doc, header, day, float(v), text, ref) for header, day, v, text, ref in (sheet.ledger() or () if sheet.wide() is None else ())}
    found = grid.operations(df, TODAY)
    assert {(r["doc_id"], r["header"], r["when"], float(r["value"]), r["description"], r["cell_ref"]) for r in found.collect()} == want
    assert {w[0] for w in want} == {"plain", "two", "gaps", "far", None}
    assert "InPandas" not in found._jdf.queryExecution().toString()


def test_a_long_table_takes_several_files(spark, monkeypatch):
    monkeypatch.setattr(catalog_scan, "LINES", 4)
    cells = spark.createDataFrame([("d-2020", r, c, f"{r}.{c}") for r in range(10) for c in range(2)], "doc_id string, row int, col int, text string")
    files = catalog_scan.as_csv(cells, 2)
    assert sorted(r["first_row"] for r in files.collect()) == [0, 4, 8]
    assert {(r["row"], r["col"], r["raw"]) for r in grids.grids(files).collect()} == {(r, c, f"{r}.{c}") for r in range(10) for c in range(2)}


def test_guards_let_all_numbers_and_periods_pass(spark):
    numbers_ = ["(1 234,5)", "−5", "１２％", "1’000", " 7\t", "1.234.567", "5-", "+3"]
    united = ["5 ТЫС. руб.", "1,2 млрд ₽", "7 штук", "3 Thousand usd", "12 %", "$ 5"]
    said = ["на 01.01.2021", "за январь-март 2020", " За  2020 год", "\u00a02020", "IV квартал 2020", "Q3 2020", "H1 2020", "кв. 2 20", "FY2021", "мая 2020", "31/12/2020", "2020-5"]
    rows = [r.asDict() for r in spark.createDataFrame([(x,) for x in (*numbers_, *united, *said, "№ 5", "такси 5")], "t string").select("t", parse_number(F.col("t")).alias("n"), parse_number_with_unit(F.col("t"))["value"].alias("u"), parse(F.col("t"))["ptype"].alias("p")).collect()]
    by = {r["t"]: r for r in rows}
    assert all(by[x]["n"] is not None for x in numbers_) and all(by[x]["u"] is not None for x in united) and all(by[x]["p"] for x in said)
    assert all(by[x][k] is None for x in ("№ 5", "такси 5") for k in "nup")
