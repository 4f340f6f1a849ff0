from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgermill.functions import entries, names, numbers, periods
from ledgermill.operators import ledger


def run(spark, f, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_numbers(spark):
    cases = {
        "1 234,56": "1234.56", "(500)": "-500", "—": None, "н/д": None, "1.234,56": "1234.56", "1.234": "1234", "1,234.56": "1234.56", "1,500": "1.5", "-5": "-5", "5-": "-5", "12,5%": "12.5",
        "−7": "-7", "(0)": "0", "abc": None, "1 000 000": "1000000", "12 700,5": "12700.5", "1,234,567": "1234567", "１２３": "123", "": None, None: None, "0.1": "0.1", "+7": "7", "9" * 40: None, "1 2 x": None,
    }
    assert run(spark, numbers.parse_number, list(cases)) == [None if v is None else Decimal(v) for v in cases.values()]
    assert run(spark, lambda c: numbers.parse_number(c, 1000), ["12,7", "(0,5)"]) == [Decimal(12700), Decimal(-500)]


def test_numbers_with_units(spark):
    cases = {"12,7 млн": (12_700_000, None), "9 800 тыс. руб.": (9_800_000, "RUB"), "12,7 евро": ("12.7", "EUR"), "45%": (45, None), "100 шт": (100, None), "5 млрд ₽": (5_000_000_000, "RUB"), "текст": (None, None)}
    got = run(spark, numbers.parse_number_with_unit, list(cases))
    assert [(g["value"], g["unit"]["currency"]) for g in got] == [(None if v is None else Decimal(v), c) for v, c in cases.values()]
    units = run(spark, numbers.detect_unit, ["Проценты к получению", "в процентах", "Количество, шт", "тыс. руб.", None])
    assert [u["unit"] for u in units] == [None, "%", "шт", "руб", None] and units[3]["multiplier"] == 1000


def test_money_in_millions_at_most(spark):
    million = lambda c: numbers.fmt_money(c.cast("decimal(28,6)"), F.lit("RUB"), largest=1_000_000)
    assert run(spark, million, ["1234567.891", "2e9", "-2e9", "-45000"]) == ["1,23 млн ₽", "2 000,00 млн ₽", "-2 000,00 млн ₽", "-45,00 тыс. ₽"]


def test_formats(spark):
    dec = lambda c: c.cast("decimal(28,6)")
    assert run(spark, lambda c: numbers.fmt_money(dec(c), F.lit("RUB")), ["1234567.891", "999", "-45000", None, "2e9"]) == ["1,23 млн ₽", "999,00 ₽", "-45,00 тыс. ₽", "—", "2,00 млрд ₽"]
    assert run(spark, lambda c: numbers.fmt_pct(dec(c)), ["12.34", "-1", None]) == ["+12,3%", "-1,0%", "—"]
    got = run(spark, numbers.extract_numbers, ["13,97 млн ₽ и 5% к 2024, 1 234,5"])[0]
    assert [(x["value"], x["unit"]) for x in got] == [(13_970_000.0, "₽"), (5.0, "%"), (2024.0, ""), (1234.5, "")]


def test_periods(spark):
    cases = {
        "2024": ("year", "2024", "2024-01-01", "2024-12-31"), "2024 г.2": ("year", "2024", "2024-01-01", "2024-12-31"), "FY2024": ("year", "2024", "2024-01-01", "2024-12-31"),
        "1 кв. 2024 г.": ("quarter", "1 кв. 2024", "2024-01-01", "2024-03-31"), "Q1'24": ("quarter", "1 кв. 2024", "2024-01-01", "2024-03-31"), "I квартал 2025 года": ("quarter", "1 кв. 2025", "2025-01-01", "2025-03-31"),
        "2024 Q3": ("quarter", "3 кв. 2024", "2024-07-01", "2024-09-30"), "9М 2024": ("ytd", "9 мес. 2024", "2024-01-01", "2024-09-30"), "12 мес. 2024": ("year", "2024", "2024-01-01", "2024-12-31"),
        "янв. 24": ("month", "01.2024", "2024-01-01", "2024-01-31"), "01.2024": ("month", "01.2024", "2024-01-01", "2024-01-31"), "2024-02": ("month", "02.2024", "2024-02-01", "2024-02-29"),
        "01.01.2023-31.12.2023": ("year", "2023", "2023-01-01", "2023-12-31"), "На 31 декабря 2025 г.": ("year", "2025", "2025-01-01", "2025-12-31"), "За январь–март 2025 г.": ("ytd", "01–03.2025", "2025-01-01", "2025-03-31"),
        "1 полугодие 2025": ("halfyear", "1 полугодие 2025", "2025-01-01", "2025-06-30"), "2 полугодие 2025": ("halfyear", "2 полугодие 2025", "2025-07-01", "2025-12-31"),
        "15.03.2024": ("day", "15.03.2024", "2024-03-15", "2024-03-15"), "31.03.2024": ("quarter", "1 кв. 2024", "2024-01-01", "2024-03-31"), "30.04.2024": ("month", "04.2024", "2024-04-01", "2024-04-30"),
        "31.02.2024": None, "Маркетинг 2024": None, "выручка": None, "": None, None: None, "1999": None, "слишком длинный заголовок, в котором есть 2024 год": None,
    }
    got = run(spark, periods.parse, list(cases))
    assert [g and (g["ptype"], g["label"], str(g["start"]), str(g["end"])) for g in got] == list(cases.values())
    assert run(spark, periods.months_in, ["в августе и марте, мае", ""]) == [[8, 3, 5], []]
    assert run(spark, periods.years_in, ["с 2023 по 2025", "1998"]) == [[2023, 2025], []]


def test_entries(spark):
    today = F.lit("2026-02-10").cast("date")
    cases = {
        "расход: 1500 кофе": ("expense", "1500", "кофе", None), "расход: кофе 1500": ("expense", "1500", "кофе", None), "потратил 3000 на подарок": ("expense", "3000", "подарок", None), "1500 кофе": ("expense", "1500", "кофе", None),
        "грузоперевозка 60к": ("expense", "60000", "грузоперевозка", None), "доход 50000 зарплата": ("income", "50000", "зарплата", None), "расходы - 2 500,50 руб — такси": ("expense", "2500.5", "такси", None),
        "получил 1,5 млн премия": ("income", "1500000", "премия", None), "такси 700 01.03": ("expense", "700", "такси", date(2026, 3, 1)), "обед 350,50 руб (03.01.2026)": ("expense", "350.5", "обед", date(2026, 1, 3)),
        "2 гис 2025": None, "сколько стоит 100": None, "2025 год прогноз": None, "привет": None, "": None, None: None,
    }
    got = run(spark, lambda c: entries.parse_entry(c, today), list(cases))
    assert [g and (g["kind"], g["amount"], g["description"], g["when"]) for g in got] == [v and (v[0], Decimal(v[1]), v[2], v[3] or date(2026, 2, 10)) for v in cases.values()]


def test_names(spark):
    assert run(spark, names.categorize, ["кофе в кафе", "налог на прибыль", "нечто", None, "аренда офиса", "на транспорт"]) == ["Кафе и рестораны", "Налоги и взносы", "Прочее", "Прочее", "Аренда", "Транспорт"]
    assert run(spark, names.kind_of, ["Отложенные налоговые активы", "Себестоимость продаж", "Выручка", "ИНН", "Нечто"]) == ["asset", "expense", "revenue", "identifier", "other"]
    assert run(spark, names.detect_variant, ["2026 (план)", "Факт", "2025"]) == ["plan", "fact", None]
    assert run(spark, names.clean_name, ["Уставный капитал5 :", "Платежи – всего", None]) == ["Уставный капитал", "Платежи - всего", ""]
    assert run(spark, names.strip_unit, ["Выручка, тыс. руб.", "Прочее (млн руб.)", "%"]) == ["Выручка", "Прочее", "%"]
    assert run(spark, names.slug, ["Выручка, млн", "Щёлочь юга"]) == ["vyruchka_mln", "schelochyuga".replace("yuga", "_yuga")]
    assert run(spark, names.expand_query, ["ндс за год", "привет"]) == [["ндс за год", "ндс за год налог на добавленную стоимость"], ["привет"]]


def test_questions(spark):
    cases = {"Прогноз выручки на 2027": "forecast", "почему упала прибыль": "explain", "из чего состоят расходы": "breakdown", "какие позиции сильнее всего выросли": "rank", "сравни 2024 и 2025": "compare", "сколько выручка в 2024": "factual", "привет": "smalltalk", "что лучше: авито или 2гис": "compare"}
    assert run(spark, names.intent, list(cases)) == list(cases.values())
    assert run(spark, names.scenario, ["если рост упадёт вдвое", "если вырастет на 20%", "снизится в 4 раза", "ничего", "продажи увеличатся"]) == [0.5, 1.2, 0.25, None, 1.5]


def test_chunks_masks_and_json(spark):
    assert run(spark, lambda c: names.split_chunks(c, 5, 2), ["a b c\n\nd e f\n\ng h i j k l m", "", "one"]) == [["a b c", "b c\n\nd e f", "e f\n\ng h i j k l m"], [], ["one"]]
    masked = run(spark, lambda c: names.anonymize(c, ("Ромашка",)), ["ИНН 7712345678 паспорт 4509 123456 тел +7 (999) 123-45-67 a@b.ru ромашка 135400273000.0"])[0]
    assert masked == "ИНН [ИНН] паспорт [ПАСПОРТ] тел [ТЕЛЕФОН] [EMAIL] [ORG0] 135400273000.0"
    assert run(spark, names.json_block, ['```json\n{"a": 1}\n```', 'so {"b": 2} it is', "none", "{bad"]) == ['{"a": 1}', '{"b": 2}', None, None]
    usage = run(spark, names.token_usage, ['{"prompt_tokens": 5, "prompt_cache_hit_tokens": 2}', '{"prompt_tokens": 5, "prompt_tokens_details": {"cached_tokens": 3}}'])
    assert [u["cached_tokens"] for u in usage] == [2, 3]


def test_prices():
    assert ledger.parse_prices("a=1/2, b=0.5, bad, c=x") == {"a": (1.0, 2.0), "b": (0.5, 0.5)}


@pytest.mark.parametrize(("row", "col", "name"), [(0, 0, "A1"), (9, 25, "Z10"), (0, 26, "AA1"), (4, 701, "ZZ5"), (0, 702, "AAA1")])
def test_cell_names(row, col, name):
    from ledgermill.sources.grids import a1, cell_name

    assert cell_name(row, col) == name and a1(name) == (row, col)
