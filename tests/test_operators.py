import math
import uuid
from datetime import date
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermill.operators import analytics as an
from ledgermill.operators import forecast as fc
from ledgermill.operators import grounding, ledger, resolve, store
from ledgermill.operators import retrieval as rt
from ledgermill.plans import dispatch, sqlguard
from ledgermill.schemas import FACTS
from ledgermill.streaming import ledger as st
from tests.plans import most_rows


def yearly(spark, **series):
    rows = [(m, date(2000 + i, 1, 1), date(2000 + i, 12, 31), Decimal(str(v))) for m, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "metric string, period_start date, period_end date, value decimal(28,6)")


def monthly(spark, values, year=2022, metric="m"):
    rows = []
    for i, v in enumerate(values):
        y, m = year + i // 12, i % 12 + 1
        end = (date(y + (m == 12), m % 12 + 1, 1)).toordinal() - 1
        rows.append((metric, date(y, m, 1), date.fromordinal(end), Decimal(str(v))))
    return spark.createDataFrame(rows, "metric string, period_start date, period_end date, value decimal(28,6)")


def test_forecast_worked_values(spark):
    rows = {r["metric"]: r for r in fc.forecast(yearly(spark, a=[10, 12, 14], b=[9800, 11400, 12700], c=[8700, 9800, 11400, 12700])).collect()}
    want = {"a": (15.9161, 15.3227, 16.5096, 2.913), "b": (13968.8327, 13119.1707, 14818.4947, 4.752), "c": (13944.0334, 13165.9274, 14722.1395, 4.3595)}
    for m, v in want.items():
        assert [rows[m][k] for k in ("base", "low", "high", "backtest_error_pct")] == pytest.approx(v, rel=1e-4)
    assert rows["b"]["methods"]["mean_growth"] == pytest.approx(14457.4781) and rows["b"]["weights"]["linear_trend"] == pytest.approx(0.4415, abs=1e-4)
    half = {r["metric"]: r["base"] for r in fc.forecast(yearly(spark, a=[10, 12, 14], b=[9800, 11400, 12700]), growth_multiplier=0.5).collect()}
    assert half["a"] == pytest.approx(14.958, abs=1e-3) and half["b"] == pytest.approx(13334.416, abs=1e-2)


def test_forecast_of_months(spark):
    (r,) = fc.forecast(monthly(spark, range(100, 124)), "month", target_year=2024).collect()
    assert r["steps"] == 12 and r["reference"] == sum(range(112, 124)) and 1400 < r["base"] < 2400 and "seasonal_naive" in r["methods"]
    (r,) = fc.forecast(monthly(spark, [100] * 9), "month", target_year=2022).collect()
    assert r["steps"] == 3 and r["fact_to_date"] == 900 and r["base"] == pytest.approx(900 + r["rest_forecast"]) and r["rest_forecast"] == pytest.approx(300)
    one, two = (fc.forecast(yearly(spark, a=[400, 470, 536]), target_year=y).collect()[0]["base"] for y in (2003, 2004))
    assert 536 < one < two < 800
    assert fc.forecast(yearly(spark, a=[1])).count() == 0
    (r,) = fc.forecast(yearly(spark, a=[10, -5, 3])).collect()
    assert "mean_growth" not in r["methods"] and math.isfinite(r["base"])


FACT = (1, "m", None, 1, "month", "01.2024", date(2024, 1, 1), date(2024, 1, 31), Decimal(10), "руб", "RUB", "fact", False, False, False, 1)


def fact(**over):
    names = FACTS.fieldNames()
    row = dict(zip(names, FACT, strict=True)) | over
    return tuple(row[n] for n in names)


def test_visibility_and_latest(spark):
    rows = [fact(value=Decimal(100)), fact(document_id=2, value=Decimal(999), is_private=True, uploaded_by=3), fact(document_id=3, value=Decimal(5), superseded=True), fact(document_id=4, value=Decimal(7), variant=None, is_private=None, org_id=2)]
    df = spark.createDataFrame(rows, FACTS)
    val = lambda uid: {float(r["value"]) for r in store.series(df, uid=uid).collect()}
    assert val(None) == {100.0, 7.0} and val(3) == {999.0, 7.0} and val(2) == {100.0, 7.0}
    assert {float(r["value"]) for r in store.series(df, org=1).collect()} == {100.0}


def test_yearly_labels(spark):
    rows = [fact(period_start=date(2024, m, 1), period_end=date(2024, m, 28), period_label=f"{m:02d}.2024") for m in range(1, 13)] + [fact(period_start=date(2025, 1, 1), period_end=date(2025, 1, 31))]
    rows += [fact(metric="y", period_type="year", period_label="2024", period_start=date(2024, 1, 1), period_end=date(2024, 12, 31))]
    got = {(r["metric"], r["period_label"]): float(r["value"]) for r in an.yearly(spark.createDataFrame(rows, FACTS)).collect()}
    assert got == {("m", "2024"): 120.0, ("m", "2025 (1 мес.)"): 10.0, ("y", "2024"): 10.0}


def test_empty_and_zero(spark):
    none = spark.createDataFrame([], FACTS)
    for f in (an.yearly, an.total, an.month_rank, an.growth_stats, an.dominant_type, an.last_values, an.breakdown, an.plan_fact, an.trailing):
        assert f(none).count() == 0
    zero = spark.createDataFrame([fact(value=Decimal(0)), fact(period_start=date(2024, 2, 1), period_end=date(2024, 2, 29))], FACTS)
    assert [r["change_pct"] for r in an.compare_previous(zero.withColumn("months", F.lit(12))).collect()] == [None]


def test_maintenance(spark):
    docs = spark.createDataFrame([(1, 1, None, False, 5), (2, 1, 1, False, 5), (3, 2, None, True, 6), (4, 1, None, False, 0)], "document_id long, org_id int, superseded_by_id long, is_private boolean, uploaded_by long")
    assert {r["document_id"]: r["superseded_by_id"] for r in store.supersede(docs, 1, 2).collect()} == {1: 2, 2: 1, 3: None, 4: None}
    assert all(r["superseded_by_id"] != 3 for r in store.supersede(docs, 1, 3).collect())
    assert {r["document_id"]: r["is_private"] for r in store.set_private(docs, 3, 5, False).collect()}[3] is True
    facts = spark.createDataFrame([(1,), (2,)], "document_id long")
    left, kids = store.delete_document(docs, {"facts": facts}, 1, 5)
    assert {r["document_id"]: r["superseded_by_id"] for r in left.collect()} == {2: None, 3: None, 4: None} and [r[0] for r in kids["facts"].collect()] == [2]
    assert store.delete_document(docs, {}, 4, 0)[0].count() == 4


def test_save_replaces_only_its_documents(spark, tmp_path):
    path = f"file://{tmp_path}/facts"
    store.save(spark.createDataFrame([(1, "a"), (2, "b")], "document_id long, metric string"), path)
    store.save(spark.createDataFrame([(2, "c"), (2, "d")], "document_id long, metric string"), path)
    assert sorted((r["document_id"], r["metric"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (2, "d")]


def test_orphans_of_a_deep_chain(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(19)]
    metrics = spark.createDataFrame([*chain, ("x", "y"), ("y", "x"), ("used", None)], "name string, parent string")
    facts = spark.createDataFrame([("used",)], "metric string")
    assert {r["name"] for r in store.orphans(metrics, facts).collect()} == {n for n, _ in chain}


def test_orphans_to_the_fixed_point(spark):
    metrics = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", None)], "name string, parent string")
    facts = spark.createDataFrame([("d",)], "metric string")
    assert {r["name"] for r in store.orphans(metrics, facts).collect()} == {"a", "b", "c"}


def test_bm25_by_hand(spark):
    chunks = spark.createDataFrame([(1, 1, None, "налог налог прибыль"), (2, 1, "s", "прибыль растет"), (3, 1, "s", "дубль раздела"), (4, 2, None, "")], "chunk_id long, document_id long, section string, body string")
    kept = rt.corpus(chunks)
    assert {r["chunk_id"] for r in kept.collect()} == {1, 2, 4}
    got = {r["chunk_id"]: r["score"] for r in rt.bm25(kept, spark.createDataFrame([(1, "налоги и прибыль")], "query_id long, text string")).collect()}
    n, avg = 3, (3 + 2 + 1) / 3
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got == {1: pytest.approx(idf(1) * part(2, 3) + idf(2) * part(1, 3)), 2: pytest.approx(idf(2) * part(1, 2))} or got[2] == pytest.approx(idf(2) * part(1, 2))


def test_fusion_and_rerank(spark):
    lists = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (1, 20, 1), (1, 30, 2)], "query_id long, chunk_id long, rank int")
    assert [(r["chunk_id"], r["score"]) for r in rt.fuse(lists).orderBy("rank").collect()][0] == (20, pytest.approx(1 / 61 + 1 / 62))
    cand = spark.createDataFrame([(1, "аренда офиса", 1, "Договор аренды офиса " + "x" * 100, None, 0.0), (1, "аренда офиса", 2, "аренда", None, 0.0), (1, "аренда офиса", 3, "аренда офиса " + "y" * 100, "карточка: аренда", 0.4)], "query_id long, query string, chunk_id long, body string, section string, semantic_score double")
    got = {r["chunk_id"]: r["score"] for r in rt.rerank(cand).collect()}
    assert got == {1: pytest.approx(0.5), 2: pytest.approx(0.5 * 0.5 * 0.7), 3: pytest.approx(0.5 + 0.2 * 0.8 + 0.2 + 0.15)}


def test_hash_embedding(spark):
    import hashlib

    (r,) = rt.hash_embedding(spark.createDataFrame([(1, "аренда аренды офиса")], "chunk_id long, body string"), 64).collect()
    want = np.zeros(64)
    for tok, tf in (("аренд", 2), ("офиса", 1)):
        h = hashlib.md5(tok.encode()).digest()
        want[int.from_bytes(h[:4], "little") % 64] += (1 if h[4] % 2 == 0 else -1) * (1 + math.log(tf))
    assert np.allclose(r["vec"], want / np.linalg.norm(want), atol=1e-6)


def test_snippet(spark):
    body = "\n".join(["шапка", "ничего", "аренда офиса", "рядом", "далеко", "ещё дальше", "аренда склада"])
    (r,) = spark.createDataFrame([(body, "аренда")], "b string, q string").select(rt.snippet(F.col("b"), F.col("q")).alias("s")).collect()
    assert r["s"].replace("…\n", "…").split("\n") == ["…ничего", "аренда офиса", "рядом", "…ещё дальше", "аренда склада"]


def test_lexical_resolution(spark):
    metrics = spark.createDataFrame([("аренда спецтехники", 1, "expense"), ("аренда", 2, "expense"), ("2 гис", 3, "other"), ("инн", 4, "identifier"), ("выручка", 5, "revenue")], "name string, metric_id long, kind string")
    synonyms = spark.createDataFrame([(5, "доходы от продаж")], "metric_id long, text string")
    asked = spark.createDataFrame([(1, "прогноз по аренде спецтехники"), (2, "аренда офиса"), (3, "что принёс 2гис"), (4, "инн"), (5, "доходы от продаж за год"), (6, "погода")], "query_id long, metric_query string")
    d = resolve.entries(metrics, synonyms)
    assert {r["query_id"]: r["metric_id"] for r in resolve.lexical(asked, d).collect()} == {1: 1, 2: 2, 3: 3, 5: 5}
    assert resolve.exact(asked, d).count() == 0


def test_exact_resolution_of_a_name_with_many_entries(spark):
    asked = spark.range(400).selectExpr("id as query_id", "if(id % 2 = 0, ' Blue RING', 'none') as metric_query")
    entries = spark.range(400).selectExpr("'blue ring' as name", "1000 - id as metric_id", "cast(id % 2 as int) as from_synonym")
    found = resolve.exact(asked, entries)
    assert {tuple(r) for r in found.collect()} == {(i, 602) for i in range(0, 400, 2)}
    assert most_rows(found) <= 400


def test_lexical_resolution_of_many_questions_of_the_same_words(spark):
    asked = spark.range(300).selectExpr("id as query_id", "concat('how much ', if(id % 3 = 0, 'blue ring', 'old plate'), ' large') as metric_query")
    entries = spark.range(300).selectExpr("if(id % 2 = 0, 'blue ring', 'bluering') as name", "id as metric_id", "0 as from_synonym").union(spark.createDataFrame([("old", 7, 1), ("plate old", 9, 1), ("new plate", 8, 0)], "name string, metric_id long, from_synonym int"))
    found = resolve.lexical(asked, entries, ())
    assert {tuple(r) for r in found.collect()} == {(i, 0, "blue ring") if i % 3 == 0 else (i, 9, "plate old") for i in range(300)}
    assert most_rows(found) < 1500


def test_lexical_resolution_meets_on_the_rarest_word(spark):
    asked = spark.range(200).selectExpr("id as query_id", "concat('total x', lpad(id, 3, '0')) as metric_query")
    entries = spark.range(200).selectExpr("concat('x', lpad(id, 3, '0'), ' total') as name", "id as metric_id", "0 as from_synonym")
    found = resolve.lexical(asked, entries, ())
    assert {(r["query_id"], r["metric_id"]) for r in found.collect()} == {(i, i) for i in range(200)}
    assert most_rows(found) < 10_000


def test_semantic_decision(spark):
    rows = [(1, "сделки", 1, "сделки заключенные", False, 0.6), (1, "сделки", 2, "сделки отмененные", False, 0.58), (2, "аренда", 3, "аренда офиса", False, 0.7), (2, "аренда", 4, "выручка", False, 0.9), (3, "всего сделок", 5, "сделки сайта", False, 0.6), (3, "всего сделок", 6, "сделки", True, 0.5)]
    got = {r["query_id"]: (r["metric_id"], r["clarify"]) for r in resolve.semantic(spark.createDataFrame(rows, "query_id long, metric_query string, metric_id long, name string, is_aggregate boolean, score double")).collect()}
    assert got == {1: (None, ["сделки заключенные", "сделки отмененные"]), 2: (3, None), 3: (6, None)}


def test_merging_names():
    v = lambda *x: np.array(x) / np.linalg.norm(x)
    known = [resolve.Known("аренда смм", v(1, 0.2), "expense"), resolve.Known("выручка", v(0, 1), "revenue")]
    got, renamed, review = resolve.merge_names([("аренда спецтехники", "expense", v(1, 0.3)), ("выручка москва", "revenue", v(0.1, 1)), ("выручка", "revenue", v(0, 1))], known)
    assert renamed == [("аренда спецтехники", "аренда смм")] and not review
    assert next(k.parent for k in known if k.name == "выручка москва") == "выручка"


def test_grounding(spark):
    hist = [("2023", 412e6), ("2024", 468.5e6)]
    cases = {"Выручка за 2024 — 468,5 млн ₽, рост 13,7%": True, "Выручка 2024 года: 700 млн ₽": False, "За 2024 — 412 млн": False, "5 точек за 2023 и 2024": True, "Разница 56,5 млн ₽": True}
    rows = [(i, a, "", [(v, "₽") for _, v in hist], hist) for i, a in enumerate(cases)]
    df = spark.createDataFrame(rows, "answer_id int, answer string, template string, allowed array<struct<value:double,unit:string>>, history array<struct<year:string,value:double>>")
    assert [r["ok"] for r in grounding.review(df).orderBy("answer_id").collect()] == list(cases.values())


def test_sql_guard(spark):
    good = "SELECT m.name, SUM(f.value) FROM facts_visible f JOIN metrics m ON m.name = f.metric WHERE EXTRACT(YEAR FROM f.period_end) = 2025 GROUP BY m.name"
    assert sqlguard.is_safe(spark, good)
    bad = [
        "SELECT telegram_id FROM users WHERE 'facts_visible' = 'facts_visible'", "SELECT * FROM facts_visible f JOIN documents d ON d.id = f.document_id", "SELECT * FROM facts_visible WHERE metric IN (SELECT user_id FROM audit_log)",
        "SELECT * FROM facts_visible, users", "SELECT * FROM `facts_visible`, `secret.t`", "SELECT java_method('java.lang.System', 'exit', 0) FROM facts_visible", "SELECT reflect('a', 'b') FROM facts_visible",
        "SELECT * FROM facts_visible; DROP TABLE facts", "SELECT * FROM facts", "UPDATE facts SET value = 0", "SELECT * FROM parquet.`/etc`", "SELECT 1", "SELECT * FROM facts_visible WHERE EXISTS (SELECT 1 FROM users)", "WITH t AS (SELECT 1) SELECT * FROM facts_visible",
        "SELECT (SELECT max(x) FROM users) FROM facts_visible", "SELECT explode(array(1)) FROM facts_visible", "SELECT * FROM facts_visible LATERAL VIEW explode(array(1)) t",
    ]
    for sql in bad:
        assert not sqlguard.is_safe(spark, sql), sql
    df = spark.createDataFrame([fact()], FACTS)
    assert sqlguard.run(spark, "SELECT metric, value FROM facts_visible", df, df.select("metric")).collect()[0]["metric"] == "m"


def test_graph():
    g = dispatch.Graph({"a": lambda s: {"n": s["n"] + 1}, "b": lambda s: {"done": True}}, {"b": dispatch.END}, {"a": (lambda s: "more" if s["n"] < 3 else "stop", {"more": "a", "__default__": "b"})}, "a")
    assert g.run({"n": 0})["trace"] == ["a", "a", "a", "b"]
    g.branches["a"] = (lambda s: "more", {"more": "a", "__default__": "b"})
    with pytest.raises(RuntimeError, match="16 steps"):
        g.run({"n": 0})


def test_answers_by_intent(spark):
    rows = [fact(metric=m, parent="все", period_start=date(y, k, 1), period_end=date(y, k, 28), value=Decimal(v * (y - 2022) + k)) for m, v in (("a", 10), ("b", 30)) for y in (2023, 2024) for k in range(1, 13)]
    df = spark.createDataFrame(rows, FACTS)
    ask = lambda intent, **k: dispatch.answer(df, intent, 1, None, **k).collect()
    assert {r["metric"]: float(r["total"]) for r in ask("factual", years=(2024,))} == {"a": 20 * 12 + 78, "b": 60 * 12 + 78}
    assert ask("compare", metric="a", years=(2023, 2024))[0]["abs_change"] == 120
    assert [r["metric"] for r in ask("breakdown", metric="все")] == ["b", "a"]
    assert [r["metric"] for r in ask("rank")] == ["b", "a"]
    assert ask("forecast", metric="a")[0]["n"] == 2 and len(ask("overview")) == 2


def test_streams_give_the_batch(spark, tmp_path):
    rows = [(i, f"расход: {100 + i} кофе", f"2024-0{1 + i % 3}-0{1 + i % 9} 10:00:00") for i in range(20)]
    msgs = spark.createDataFrame(rows, "id long, text string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    msgs.write.parquet(f"file://{tmp_path}/m")
    stream = spark.readStream.schema(msgs.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/m")
    total = lambda m: st.month_totals(st.entries(m).withColumn("header", F.lit("журнал")))
    name = f"t_{uuid.uuid4().hex}"
    assert sorted(map(tuple, st.run_once(total(stream), name).collect())) == sorted(map(tuple, total(msgs).collect()))


def test_duplicate_uploads_once(spark, tmp_path):
    files = spark.createDataFrame([(1, "h", "2024-01-01 00:00:00"), (1, "h", "2024-01-01 01:00:00"), (1, "g", "2024-01-01 02:00:00")], "org_id int, file_hash string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    files.coalesce(1).write.parquet(f"file://{tmp_path}/f")
    stream = spark.readStream.schema(files.schema).parquet(f"file://{tmp_path}/f")
    assert st.run_once(st.fresh_files(stream), f"t_{uuid.uuid4().hex}", "append").count() == 2


def test_ledger_reports(spark):
    ops = spark.createDataFrame([(1, "H", date(2024, 1, 5), Decimal(10), "a", "s1", "expense"), (2, "h", date(2024, 1, 9), Decimal(5), "b", "s2", "income"), (3, "h", date(2024, 2, 1), Decimal(2), "a", "s1", "expense")], "op_id long, header string, when date, value decimal(28,6), category string, sheet string, kind string")
    got = {str(r["period_start"]): (float(r["value"]), r["n"], r["sheets"]) for r in ledger.month_facts(ops).collect()}
    assert got == {"2024-01-01": (15.0, 2, "s1, s2"), "2024-02-01": (2.0, 1, "s1")}
    rep = {str(r["month"]): float(r["balance_expense_minus_income"]) for r in ledger.month_report(ops.withColumn("month", F.trunc("when", "MM"))).collect()}
    assert rep == {"2024-01-01": 5.0, "2024-02-01": 2.0, "None": 7.0}
    assert {r["op_id"] for r in ledger.undo_last(ops.withColumn("header", F.lower("header"))).collect()} == {1, 2}


def test_short_known_names_are_found(spark):
    new = spark.createDataFrame([("общая НД",), ("ab",), ("x",), ("",)], "name string")
    known = spark.createDataFrame([("НД",), ("a",), ("x",), ("",)], "name string")
    assert {(r["name"], r["parent"]) for r in store.containment_parent(new, known).collect()} == {("общая НД", "НД"), ("ab", "a")}


def test_a_period_end_has_one_point(spark):
    from datetime import date

    rows = [(1, "m", "fact", 1, "month", date(2024, 12, 1), date(2024, 12, 31), 5.0), (1, "m", "fact", 1, "year", date(2024, 1, 1), date(2024, 12, 31), 60.0), (1, "m", "fact", 2, "month", date(2024, 11, 1), date(2024, 11, 30), 4.0)]
    facts = spark.createDataFrame(rows, "org_id int, metric string, variant string, document_id long, period_type string, period_start date, period_end date, value double")
    assert {(r["period_type"], r["value"]) for r in store.latest_wins(facts).collect()} == {("year", 60.0), ("month", 4.0)}
    later = facts.unionByName(facts.where("period_type = 'month'").withColumn("document_id", F.lit(9).cast("long")).withColumn("value", F.lit(7.0)))
    assert {r["value"] for r in store.latest_wins(later).collect()} == {7.0}


def test_deletion_leaves_no_orphans(spark):
    metrics = spark.createDataFrame([(str(k), str(k - 1) if k else None) for k in range(20)] + [("used", None), ("child", "used")], "name string, parent string")
    facts = spark.createDataFrame([("child",)], "metric string")
    assert {r["name"] for r in store.without_orphans(metrics, facts).collect()} == {"used", "child"}


def test_confirmed_facts_are_certain(spark):
    facts = spark.createDataFrame([(1, True, 0.5), (2, True, 0.5)], "document_id long, needs_review boolean, confidence double")
    assert {tuple(r) for r in store.confirm(facts, 1).collect()} == {(1, False, 1.0), (2, True, 0.5)}


def test_vectors_of_another_index_fail(spark):
    v = spark.createDataFrame([(1, "hash:md5:64"), (2, "hash:md5:32")], "chunk_id long, fingerprint string")
    want = rt.index_fingerprint("hash", "md5", 64)
    assert rt.same_index(v.where("chunk_id = 1"), want).count() == 1
    with pytest.raises(Exception, match="not of index"):
        rt.same_index(v, want).collect()


def test_share_needs_the_same_unit(spark):
    rows = [("a", "p", "RUB", 10.0), ("b", "p", None, 5.0), ("p", None, "RUB", 40.0)]
    s = spark.createDataFrame([(m, p, "шт" if c is None else "руб", c, "year", "2024-12-31", v) for m, p, c, v in rows], "metric string, parent string, unit string, currency string, period_type string, period_end string, value double")
    assert {r["metric"]: r["share_pct"] for r in an.share_in_parent(s).collect()} == {"a": 25.0, "b": None, "p": None}

def test_nearest_equals_the_expression_on_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(rng.integers(-2, 3, 6))]) for i in range(300)]
    rows += [(300, None), (301, []), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, [1.0] * 5), (304, [math.nan] * 6), (305, [math.inf] * 6), (306, [0.0] * 6), (None, [1.0] * 6), (307, [1.0] * 5), (307, [1.0] * 5)]
    vectors = spark.createDataFrame(rows, "chunk_id long, vec array<float>").repartition(3)
    queries = spark.createDataFrame([(str(i), v) for i, v in rows if i is not None and (i % 10 == 0 or i > 299)], "query_id string, vec array<float>")
    monkeypatch.setattr(rt.blocks, "QUERIES", 8)
    pairs = vectors.crossJoin(queries.withColumnRenamed("vec", "q"))
    want = rt.top(pairs.select("query_id", "chunk_id", F.round(rt.cosine(F.col("vec"), F.col("q")), 9).alias("score")), 7)
    got = lambda df: sorted(map(str, df.select("query_id", "rank", "chunk_id", "score").collect()))
    found = rt.nearest(vectors, queries, 7)
    assert got(found) == got(want)
    assert most_rows(found) < vectors.count() * queries.count() / 4
    assert rt.nearest(vectors, queries.limit(0), 7).count() == 0 == rt.nearest(vectors.limit(0), queries, 7).count()
