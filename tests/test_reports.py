import io
import zipfile
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgermill.operators import analytics as an
from ledgermill.operators import grid, grounding, ledger, resolve
from ledgermill.operators import retrieval as rt
from ledgermill.schemas import FACTS, GRID
from ledgermill.sources import grids, sinks

ROW = dict(org_id=1, metric="m", parent=None, document_id=1, period_type="month", period_label="01.2024", period_start=date(2024, 1, 1), period_end=date(2024, 1, 31), value=Decimal(10), unit="руб", currency="RUB", variant="fact", needs_review=False, is_private=False, superseded=False, uploaded_by=1)


def facts(spark, *rows):
    return spark.createDataFrame([tuple((ROW | r)[n] for n in FACTS.fieldNames()) for r in rows], FACTS)


def test_workbook_round_trip(spark):
    data = sinks.series_workbook(facts(spark, {}, {"period_label": "02.2024", "period_end": date(2024, 2, 29), "value": Decimal("20.5")}))
    cells = {(r, c): raw for _, r, c, raw, _ in grids.xlsx_cells(data)}
    assert cells[0, 0] == "Показатель" and cells[1, 1] == "01.2024" and float(cells[2, 2]) == 20.5
    names = [s for s, *_ in grids.xlsx_cells(sinks.xlsx({'A & "B"': [["x <y>", None, 1]], "Second": [[True]]}))]
    assert names == ['A & "B"', 'A & "B"', "Second"]


def test_no_cell_is_dropped_in_silence(spark, monkeypatch):
    far = grids.xlsx_cells(sinks.xlsx({"S": [["a"], *[[] for _ in range(60_000)], [*[None] * 600, "b"]]}))
    assert [(r, c, raw) for _, r, c, raw, _ in far] == [(0, 0, "a"), (60_001, 600, "b")]
    row = '<table:table-row table:number-rows-repeated="{}"><table:table-cell office:value-type="string"><text:p>{}</text:p></table:table-cell></table:table-row>'
    content = '<d xmlns:table="t" xmlns:office="o" xmlns:text="x"><table:table table:name="S">' + row.format(60_000, "a") + row.format(1, "b") + "</table:table></d>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", content)
    cells = grids.cells_of("x.ods", out.getvalue())
    assert len(cells) == 60_001 and cells[-1][1:4] == (60_000, 0, "b")
    page = b"<table><tr><td rowspan=70000>a<td>b</tr><tr><td colspan=9000>c</tr></table>"
    assert sorted((r, c, raw) for _, r, c, raw, _ in grids.cells_of("x.html", page)) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "a"), *((1, 1 + c, "c") for c in range(1000))]
    monkeypatch.setattr(grids, "MAX_CELLS", 60_000)
    for name, data in (("x.ods", out.getvalue()), ("x.csv", b"a;b\n" * 30_001)):
        with pytest.raises(ValueError, match="more than 60000 cells"):
            grids.cells_of(name, data)


def test_reports_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(sinks, "MAX_REPORT_ROWS", 2)
    with pytest.raises(ValueError, match="more than 2 rows"):
        sinks.rows_of(spark.range(3))
    assert sinks.rows_of(spark.range(2)) == [["id"], [0], [1]]


def test_messages_and_tables():
    text = "a" * 30 + "\n\n" + "b" * 30 + "\n" + "c" * 50
    parts = sinks.split_message(text, 40)
    assert all(len(p) <= 40 for p in parts) and "".join(parts).replace("\n", "") == text.replace("\n", "")
    assert sinks.text_table([["ab", 1], ["c", 22]], [4, 3]) == "ab      1\nc      22"


def test_history_takes_the_newest_unit(spark):
    rows = an.history(facts(spark, {"unit": "шт"}, {"period_label": "02.2024", "period_end": date(2024, 2, 29), "document_id": 7}), last=None).collect()
    assert {r["unit"] for r in rows} == {"руб"} and {r["source"] for r in rows} == {"документ 1 · 01.2024", "документ 7 · 02.2024"}


def test_digest(spark):
    months = [{"metric": m, "period_start": date(y, k, 1), "period_end": date(y, k, 28), "value": Decimal(v * (y - 2000))} for m, v in (("выручка", 1), ("инн", 5)) for y in (2023, 2024) for k in range(1, 13)]
    kinds = spark.createDataFrame([("выручка", "revenue"), ("инн", "identifier")], "metric string, kind string")
    got = [(r["part"], r["metric"]) for r in an.daily_digest(facts(spark, *months), kinds).collect()]
    assert got.count(("last", "выручка")) == 1 and ("last", "инн") not in got and any(p == "growth" for p, _ in got)


def test_new_entries_refresh_their_months(spark):
    schema = "op_id long, header string, when date, value decimal(28,6), sheet string"
    old = spark.createDataFrame([(1, "h", date(2024, 1, 5), Decimal(10), "s"), (2, "h", date(2024, 2, 5), Decimal(3), "s")], schema)
    new = spark.createDataFrame([(3, "H", date(2024, 1, 9), Decimal(5), "s")], schema)
    _, got = ledger.add_entries(old, new, ledger.month_facts(old))
    assert {str(r["period_start"]): float(r["value"]) for r in got.collect()} == {"2024-01-01": 15.0, "2024-02-01": 3.0}


def test_one_journal_an_organisation(spark):
    docs = spark.createDataFrame([(1, "x", "d", 5)], "org_id int, file_hash string, original_name string, uploaded_by long")
    orgs = spark.createDataFrame([(1,), (2,)], "org_id int")
    once = ledger.ensure_journal(docs, orgs, "Журнал")
    assert once.count() == 3 and ledger.ensure_journal(once, orgs, "Журнал").count() == 3


def test_codes_and_kinds(spark):
    got = resolve.unique_codes(spark.createDataFrame([(1, "Выручка"), (2, "выручка!"), (3, "Аренда")], "metric_id long, name string")).orderBy("metric_id").collect()
    assert [r["code"] for r in got] == ["vyruchka", "vyruchka_2", "arenda"]
    kinds = resolve.backfill_kinds(spark.createDataFrame([("Выручка", None), ("Нечто", "asset")], "name string, kind string")).collect()
    assert [r["kind"] for r in kinds] == ["revenue", "asset"]


def test_allowed_numbers_and_template(spark):
    rows = spark.createDataFrame([(1, 5.0, 50.0), (1, 7.0, None)], "answer_id int, value double, share double")
    (r,) = grounding.allowed_of(rows, {"value": "₽"}, ("share",)).collect()
    assert sorted((a["value"], a["unit"]) for a in r["allowed"]) == [(5.0, "₽"), (7.0, "₽"), (50.0, "%")]
    tries = spark.createDataFrame([(1, 1, False, "bad", "t"), (1, 2, True, "good", "t"), (2, 1, False, "bad", "t2")], "answer_id int, try int, ok boolean, answer string, template string")
    assert {r["answer_id"]: (r["answer"], r["from_model"]) for r in grounding.answer_or_template(tries).collect()} == {1: ("good", True), 2: ("t2", False)}


def test_document_unit_and_fact_texts(spark):
    texts = spark.createDataFrame([("a", "Отчёт\nЕдиница измерения: тыс. руб.\n"), ("b", "без единицы")], "doc_id string, text string")
    (r,) = grid.document_units(texts).collect()
    assert (r["doc_id"], r["unit"]["multiplier"], r["unit"]["currency"]) == ("a", 1000, "RUB")
    cells = [("d", "s", r, c, v, "text") for r, row in enumerate([["Показатель", "2023", "2024"], ["Выручка", "1", "2"], ["ИНН", "5", "5"]]) for c, v in enumerate(row)]
    df = spark.createDataFrame(cells, GRID)
    (t,) = grid.fact_texts(grid.scan(df, date(2026, 1, 1))).collect()
    assert t["body"] == "Показатель «выручка»: 2023 — 1.000000, 2024 — 2.000000;"
    (s,) = grid.sheet_texts(df).collect()
    assert s["body"] == "Показатель | 2023 | 2024\nВыручка | 1 | 2\nИНН | 5 | 5"


def test_explain_finds_the_sentence(spark):
    chunks = spark.createDataFrame([(1, None, "Договор аренды офиса подписан директором Ивановым в марте. " + "x" * 60), (2, None, "Выручка компании выросла на десять процентов за год. " + "y" * 60)], "chunk_id long, section string, body string")
    vec = rt.hash_embedding(chunks.select("chunk_id", "body"), 64)
    q = spark.createDataFrame([(1, 0, "кто подписал договор аренды")], "query_id long, variant int, text string")
    qv = rt.hash_embedding(q.select(F.col("query_id").alias("chunk_id"), F.col("text").alias("body")), 64).withColumnRenamed("chunk_id", "query_id")
    got = rt.explain(chunks, vec, q.join(qv, "query_id")).collect()
    assert [r["chunk_id"] for r in got] == [1] and got[0]["text"].startswith("Договор")


def test_context_for_embedding(spark):
    df = spark.createDataFrame([("Отчёт", "Раздел", "текст"), ("Отчёт", None, "текст")], "document_name string, section string, body string")
    assert [r["to_embed"] for r in rt.in_context(df).collect()] == ["Документ: Отчёт, фрагмент: Раздел. текст", "Документ: Отчёт. текст"]
    assert rt.index_fingerprint("hash", "md5", 64) == "hash:md5:64"
