"""Reporting periods as Column expressions: struct(ptype, label, start, end)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermill.functions.numbers import let

TYPE = "struct<ptype:string,label:string,start:date,end:date>"
#: Month names by their first letters; short forms stand alone.
MONTHS = {"янв": 1, "фев": 2, "мар": 3, "апр": 4, "май": 5, "мая": 5, "июн": 6, "июл": 7, "авг": 8, "сен": 9, "окт": 10, "ноя": 11, "дек": 12}
MONTH = (
    r"(?:январ[а-я]*|янв\.?|феврал[а-я]*|фев\.?|март[а-я]*|мар\.?|апрел[а-я]*|апр\.?|ма[йя]|июн[а-я]*|июл[а-я]*|"
    r"август[а-я]*|авг\.?|сентябр[а-я]*|сент?\.?|октябр[а-я]*|окт\.?|ноябр[а-я]*|ноя\.?|декабр[а-я]*|дек\.?)"
)
YEAR = r"20[0-4]\d"
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4}
# The forms in which reports write periods, in the order in which they are tried.
DATE_RANGE = r"(\d{2}[./]\d{2}[./]\d{4})\s*[-т]+\s*(\d{2}[./]\d{2}[./]\d{4})"
DAY_IN_WORDS = rf"(\d{{1,2}})\s*({MONTH})\s*({YEAR})"
MONTH_RANGE = rf"(?:за\s*)?({MONTH})\s*-\s*({MONTH})\s*({YEAR})"
MONTHS_SO_FAR = rf"(?:за\s*)?(\d{{1,2}})\s*(?:мес[а-я]*\.?|м|m)\s*({YEAR})"
HALF = rf"(?:за\s*)?([12])\s*(?:полугоди[а-я]*|п/г|h)\s*({YEAR})"
HALF_ENGLISH = rf"h([12])\s*'?\s*({YEAR})"
WHOLE_YEAR = rf"(?:fy|за)?\s*({YEAR})"
QUARTER = rf"([1-4])\s*[-.\s]*(?:кв|квартал|q)[а-я]*\.?[-.\s]*({YEAR})"
QUARTER_LAST = rf"({YEAR})\s*[-.\s]*(?:кв|квартал|q)[а-я]*\.?[-.\s]*([1-4])"
QUARTER_WORD_FIRST = rf"(?:кв|q)[а-я]*\.?\s*([1-4])\s*[-.\s']*({YEAR}|\d\d)"
QUARTER_ROMAN = rf"(i{{1,3}}|iv)\s*[-.\s]*(?:кв|квартал)[а-я]*\.?[-.\s]*({YEAR})"
QUARTER_YEAR_FIRST = rf"({YEAR})\s*[-.\s]*([1-4])\s*кв"
MONTH_IN_WORDS = rf"({MONTH})\s*({YEAR}|\d\d)"
MONTH_NUMBER = rf"(0?[1-9]|1[0-2])\s*[./]\s*({YEAR})"
MONTH_ISO = rf"({YEAR})-(0?[1-9]|1[0-2])"
YEAR_TAIL = r"(?<=[\d\s.])\s*(?:г\.?|год[а-я]*|year)\s*\d?\s*$"
LONGEST = 40
#: Fixed value: days in digits.
DAY = r"^(?:\d{1,2}[./]\d{1,2}[./]\d{4}|\d{4}-\d{1,2}-\d{1,2})$"
#: How all forms, days among them, begin, and a digit in them: looked at first, as most cells hold no period.
OPENING = r"(?iu)^(?=[^0-9]*[0-9])[\s  ]*(?:на[\s  ]+)?(?:за[\s  ]*)?(?:[0-9]|fy|h|q|кв|i|янв|фев|мар|апр|ма[йя]|июн|июл|авг|сен|окт|ноя|дек)"


def _struct(ptype, label: Column, start: Column, end: Column) -> Column:
    return F.struct((F.lit(ptype) if isinstance(ptype, str) else ptype).alias("ptype"), label.alias("label"), start.alias("start"), end.alias("end"))


def _date(y: Column, m, d) -> Column:
    """A date, or null where there is no such day."""
    pad = lambda c, n: F.lpad(c.cast("string") if isinstance(c, Column) else F.lit(str(c)), n, "0")
    return F.try_to_timestamp(F.concat_ws("-", pad(y, 4), pad(m, 2), pad(d, 2)), F.lit("yyyy-MM-dd")).cast("date")


def year(y: Column) -> Column:
    return _struct("year", y.cast("string"), _date(y, 1, 1), _date(y, 12, 31))


def quarter(y: Column, q: Column) -> Column:
    return _struct("quarter", F.format_string("%d кв. %d", q, y), _date(y, 3 * q - 2, 1), F.last_day(_date(y, 3 * q, 1)))


def month(y: Column, m: Column) -> Column:
    return _struct("month", F.format_string("%02d.%d", m, y), _date(y, m, 1), F.last_day(_date(y, m, 1)))


def first_months(y: Column, n: Column) -> Column:
    """The year's first n months: the whole year, its first half, or a type of their own, so nothing sums them as months."""
    half = _struct("halfyear", F.format_string("1 полугодие %d", y), _date(y, 1, 1), _date(y, 6, 30))
    return F.when(n == 12, year(y)).when(n == 6, half).when(n.between(1, 11), _struct("ytd", F.format_string("%d мес. %d", n, y), _date(y, 1, 1), F.last_day(_date(y, n, 1))))


def from_date(d: Column) -> Column:
    """Balance dates: 31 December is the year, the end of March, June, September a quarter, of another month the month."""
    return let(d, _from_date)


def _from_date(d: Column) -> Column:
    y, m = F.year(d), F.month(d)
    day = _struct("day", F.date_format(d, "dd.MM.yyyy"), d, d)
    return F.when(d.isNotNull(), F.when(d != F.last_day(d), day).when(m == 12, year(y)).when(m.isin(3, 6, 9), quarter(y, (m / 3).cast("int"))).otherwise(month(y, m)))


def parse_date(s: Column) -> Column:
    """dd.mm.yyyy, dd/mm/yyyy or yyyy-mm-dd."""
    return F.when(s.rlike(DAY), let(s, _parse_date))


def _parse_date(s: Column) -> Column:
    dmy = F.regexp_replace(s, "/", ".")
    day = lambda i: F.regexp_extract(dmy, r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", i)
    return F.when(dmy.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), _date(day(3), day(2), day(1))).when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), _date(*(F.split_part(s, F.lit("-"), F.lit(k)) for k in (1, 2, 3))))


def _month_number(stem: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in MONTHS.items() for x in kv)), F.left(stem, F.lit(3)))


def parse(text: Column) -> Column:
    """The period that a header cell names, or null."""
    s = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.translate(text, "’–—", "'--"), r"[\u00a0\u202f]", " "), r"\s+", " ")))
    fits = (F.length(s) > 0) & (F.length(s) <= LONGEST)
    s = F.trim(F.regexp_replace(s, YEAR_TAIL, ""))
    s = F.regexp_replace(s, r"^на\s+", "")
    return F.when(text.rlike(OPENING) & fits, let(s, _parse))


def _parse(s: Column) -> Column:
    """The period that a prepared text is, by the first form that it has."""

    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(s, f"^(?:{pattern})$", i)

    def num(pattern: str, i: int) -> Column:
        return part(pattern, i).try_cast("int")

    cases: list[tuple[Column, Column]] = []

    def case(pattern: str, value) -> None:
        cases.append((s.rlike(f"^(?:{pattern})$"), value(pattern)))

    def date_range(p: str) -> Column:
        return let(F.struct(parse_date(part(p, 1)).alias("a"), parse_date(part(p, 2)).alias("b")), lambda x: of_dates(x["a"], x["b"]))

    def of_dates(a: Column, b: Column) -> Column:
        whole = (F.date_format(a, "ddMM") == "0101") & (F.date_format(b, "ddMM") == "3112")
        same = F.month(a) == F.month(b)
        return F.when(a.isNotNull() & b.isNotNull(), F.when(whole, _struct("year", F.year(a).cast("string"), a, b)).when(same, _struct("month", F.date_format(a, "MM.yyyy"), a, b)).otherwise(_struct("quarter", F.year(a).cast("string"), a, b)))

    def month_range(p: str) -> Column:
        a, b, y = _month_number(part(p, 1)), _month_number(part(p, 2)), num(p, 3)
        return F.when(a <= b, _struct("ytd", F.format_string("%02d–%02d.%d", a, b, y), _date(y, a, 1), F.last_day(_date(y, b, 1))))

    def half(p: str) -> Column:
        h, y = num(p, 1), num(p, 2)
        second = _struct("halfyear", F.format_string("2 полугодие %d", y), _date(y, 7, 1), _date(y, 12, 31))
        return F.when(h == 1, first_months(y, F.lit(6))).otherwise(second)

    def short(y: Column) -> Column:
        return F.when(y < 100, y + 2000).otherwise(y)

    roman = F.create_map(*(F.lit(x) for kv in ROMAN.items() for x in kv))
    case(DATE_RANGE, date_range)
    case(DAY_IN_WORDS, lambda p: from_date(_date(num(p, 3), _month_number(part(p, 2)), num(p, 1))))
    case(MONTH_RANGE, month_range)
    case(MONTHS_SO_FAR, lambda p: first_months(num(p, 2), num(p, 1)))
    case(HALF, half)
    case(HALF_ENGLISH, half)
    case(WHOLE_YEAR, lambda p: year(num(p, 1)))
    case(QUARTER, lambda p: quarter(num(p, 2), num(p, 1)))
    case(QUARTER_LAST, lambda p: quarter(num(p, 1), num(p, 2)))
    case(QUARTER_WORD_FIRST, lambda p: quarter(short(num(p, 2)), num(p, 1)))
    case(QUARTER_ROMAN, lambda p: quarter(num(p, 2), F.try_element_at(roman, part(p, 1))))
    case(QUARTER_YEAR_FIRST, lambda p: quarter(num(p, 1), num(p, 2)))
    case(MONTH_IN_WORDS, lambda p: month(short(num(p, 2)), _month_number(part(p, 1))))
    case(MONTH_NUMBER, lambda p: month(num(p, 2), num(p, 1)))
    case(MONTH_ISO, lambda p: month(num(p, 1), num(p, 2)))
    out = from_date(parse_date(s))
    for test, value in reversed(cases):
        out = F.when(test, value).otherwise(out)
    return out


def months_in(text: Column) -> Column:
    """Numbers of the months a question names, in order of appearance."""
    stems = F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}_])(январ|феврал|март|апрел|ма[йея]|июн|июл|август|сентябр|октябр|ноябр|декабр)"), F.lit(1))
    number = lambda x: F.when(x.rlike("^ма[йея]$"), 5).otherwise(_month_number(x))
    return F.array_distinct(F.transform(stems, number))


def years_in(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"20\d\d"), F.lit(0)), lambda y: y.cast("int")), lambda y: (y > 1990) & (y < 2100))
