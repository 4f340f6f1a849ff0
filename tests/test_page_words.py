"""Pages of positioned words: lines, cells, columns, and tables over page breaks."""

from datetime import date

from ledgermill.operators import grid
from ledgermill.sources import page_words

SCHEMA = "doc_id string, page int, x0 double, x1 double, y double, text string"


def page(doc, number, lines, top=50.0, jitter=1.5):
    """Words of lines [(x, text), ...]; a line given as a number is a gap of so many units."""
    out, y = [], top
    for line in lines:
        if isinstance(line, (int, float)):
            y += line
            continue
        for x, text in ((float(x), text) for x, text in line):
            for i, word in enumerate(text.split(" ")):
                out.append((doc, number, x, x + 5.0 * len(word), y + jitter * (i % 2), word))
                x += 5.0 * len(word) + 5
        y += 14
    return out


def cells_of(spark, words):
    rows = page_words.page_grid(spark.createDataFrame(words, SCHEMA)).collect()
    return sorted((r["doc_id"], r["sheet"], r["row"], r["col"], r["raw"]) for r in rows)


HEADER = [(20, "Показатель, тыс. руб."), (200, "2023 г."), (260, "2024 г.")]


def body(name, a, b):
    return [(20, name), (200, a), (260, b)]


def test_lines_cells_columns(spark):
    words = page("d", 1, [[(40, "Отчёт за два года")], HEADER, body("выручка от продаж", "1 000", "1 200"), [(20, "прибыль"), (260, "90")], 60, [(150, "стр. 1")]])
    got = cells_of(spark, words[::-1])
    sheet = ("d", "стр. 1, таблица 1")
    assert got == [
        (*sheet, 0, 0, "Отчёт за два года"), (*sheet, 1, 0, "Показатель, тыс. руб."), (*sheet, 1, 1, "2023 г."), (*sheet, 1, 2, "2024 г."),
        (*sheet, 2, 0, "выручка от продаж"), (*sheet, 2, 1, "1 000"), (*sheet, 2, 2, "1 200"), (*sheet, 3, 0, "прибыль"), (*sheet, 3, 2, "90"),
    ]


def test_header_and_section_go_on(spark):
    rows = [page("d", 1, [HEADER, [(20, "Доходы")], body("услуги", "10", "20"), body("товары", "30", "40")]), page("d", 2, [body("товары прочие", "5", "6"), body("итого", "45", "66")]), page("d", 3, [HEADER, body("прочее", "7", "8")])]
    words = spark.createDataFrame(sum(rows, []), SCHEMA)
    got = {(r["metric"], r["period_label"]): (int(r["value"]), r["section"], r["sheet"]) for r in grid.scan(page_words.page_grid(words), date(2026, 1, 1)).collect()}
    assert got[("товары прочие", "2024")] == (6000, "доходы", "стр. 1, таблица 1")
    assert got[("доходы итого", "2023")][0] == 45000
    assert got[("прочее", "2023")] == (7000, "доходы", "стр. 1, таблица 1")
    assert len(got) == 10


def test_what_is_no_continuation(spark):
    other = [(20, "Статья"), (200, "Иванов"), (260, "Петров")]
    words = page("d", 1, [HEADER, body("а", "1", "2"), 40, other, body("б", "3", "4")])  # two tables on a page
    words += page("d", 2, [other[:1] + [(200, "Сидоров"), (260, "Петров")], body("в", "5", "6")])  # another header
    words += page("d", 4, [body("г", "7", "8"), body("д", "9", "10")])  # a page between
    words += page("e", 1, [[(20, "Только текст без таблиц")], [(20, "и вторая строка")]])
    words += page("e", 2, [body("ж", "1", "2"), body("з", "1", "2")])  # nothing to continue
    assert sorted({r[:2] for r in cells_of(spark, words)}) == [("d", "стр. 1, таблица 1"), ("d", "стр. 1, таблица 2"), ("d", "стр. 2, таблица 1"), ("d", "стр. 4, таблица 1"), ("e", "стр. 2, таблица 1")]


def test_units_texts_problems(spark):
    words = page("d", 1, [[(20, "Бухгалтерский баланс")], [(20, "Единица измерения: тыс. руб.")]]) + page("d", 2, [HEADER, body("а", "1", "2")])
    words += [("d", 3, None, 1.0, 1.0, "потеряно"), ("e", 1, 1.0, 2.0, 3.0, "  "), (None, None, None, None, None, None)]
    df = spark.createDataFrame(words, SCHEMA)
    assert [(r["doc_id"], r["unit"]["multiplier"], r["unit"]["currency"]) for r in page_words.document_units(df).collect()] == [("d", 1000, "RUB")]
    texts = {(r["doc_id"], r["page"]): r["text"] for r in page_words.page_texts(df).collect()}
    assert texts[("d", 1)] == "Бухгалтерский баланс\nЕдиница измерения: тыс. руб." and set(texts) == {("d", 1), ("d", 2)}
    assert sorted((r["doc_id"] or "", r["page"] or 0, r["reason"]) for r in page_words.problems(df).collect()) == [("", 0, "no text layer"), ("d", 3, "1 words without a place"), ("e", 1, "no text layer")]


def test_no_words(spark):
    assert page_words.page_grid(spark.createDataFrame([], SCHEMA)).count() == 0
