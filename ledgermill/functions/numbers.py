"""Numbers, units and money as Column expressions (no Python in the plan)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(28,6)"
#: Scale words, currencies and unit words, in the order in which they are looked for.
SCALES = (("млрд", 1_000_000_000), ("млн", 1_000_000), ("(?<![\\p{L}\\p{N}_])тыс|thousand", 1_000))
CURRENCIES = (("₽|руб", "RUB", "руб"), ("\\$|usd|долл", "USD", "usd"), ("€|eur|евро", "EUR", "eur"))
UNIT_WORDS = ("млрд", "млн", "тыс", "thousand", "рублей", "рубля", "руб", "rub", "usd", "долларов", "долл", "eur", "евро", "штуки", "штука", "штук", "шт")
SIGNS = {"RUB": "₽", "USD": "$", "EUR": "€"}
FULL_WIDTH = "０１２３４５６７８９（）％，．－＋"
_EDGE = r"(?<![\p{L}\p{N}_])"
_END = r"(?![\p{L}\p{N}_])"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def plain(text: Column) -> Column:
    """Compatibility forms that occur in reports replaced by their plain characters; no full NFKC exists in Spark."""
    t = F.translate(text, FULL_WIDTH, "0123456789()%,.-+")
    return F.trim(F.regexp_replace(t, r"[\u00a0\u2000-\u200a\u202f\u205f\u3000\t\r\n]", " "))


def detect_unit(text: Column) -> Column:
    """struct(multiplier, unit, currency) said by a text."""
    return let(F.lower(F.coalesce(text, F.lit(""))), _unit_of)


def _unit_of(low: Column) -> Column:
    pct = low.rlike(r"%|в процентах|[,(]\s*процент[\p{L}]*\s*\)?\s*$")
    mult, cur, unit = F.lit(1), F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, factor in reversed(SCALES):
        mult = F.when(low.rlike(pattern), factor).otherwise(mult)
    for pattern, code, name in reversed(CURRENCIES):
        cur, unit = F.when(low.rlike(pattern), code).otherwise(cur), F.when(low.rlike(pattern), name).otherwise(unit)
    unit = F.when(pct, "%").otherwise(unit)
    pieces = low.rlike(rf"{_EDGE}шт{_END}|количество|кол-во")
    return F.struct(F.when(pct, 1).otherwise(mult).cast("long").alias("multiplier"), F.coalesce(unit, F.when(pieces, "шт")).alias("unit"), cur.alias("currency"))


#: Thousands parted by dots, and by commas.
DOTTED, COMMAED = r"^\d{1,3}(\.\d{3})+(,\d+)?$", r"^(\d{1,3}(,\d{3})+\.\d+|\d{1,3}(,\d{3}){2,})$"


#: Fixed value: all that a number's text may hold, a digit among it; days (dd.mm.yyyy) and cells that say «no value» are none. Looked at first, as most cells are no numbers.
_CHARS = r"0-9０-９（）％，．－＋()%,.+\-−'’\s\u00a0\u2000-\u200a\u202f\u205f\u3000"
NUMERIC = rf"^(?!\d{{1,2}}\.\d{{1,2}}\.\d{{4}}$)(?=[^0-9０-９]*[0-9０-９])[{_CHARS}]+$"
#: The same of a number beside unit words.
WITH_UNIT = rf"(?iu)^(?=[^0-9０-９]*[0-9０-９])[{_CHARS}₽$€{''.join(sorted(set(''.join(UNIT_WORDS))))}]+$"


def parse_number(text: Column, multiplier: Column | int = 1) -> Column:
    """Decimal of a cell: brackets and a leading or trailing minus negate; blanks and apostrophes part thousands.

    «1.234,56» and «1.234» have thousands dots, «1,234.56» and «1,234,567» thousands commas; any other comma is decimal.
    """
    mult = F.lit(multiplier) if isinstance(multiplier, int) else multiplier

    def signed(s: Column) -> Column:
        bracket = s.rlike(r"^\(.*\)$")
        bare = let(F.when(bracket, F.regexp_replace(s, r"^\(|\)$", "")).otherwise(s), unsigned)
        return F.when(bracket, -F.abs(bare)).otherwise(bare)

    def unsigned(s: Column) -> Column:
        minus = s.rlike("^-|-$")
        digits = F.trim(F.when(minus, F.replace(s, F.lit("-"), F.lit(""))).otherwise(s))
        value = let(F.regexp_replace(F.regexp_replace(digits, r"%$", ""), r"[\s'’]", ""), amount)
        return F.when(minus, -value).otherwise(value)

    def amount(s: Column) -> Column:
        dotted = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        return let(F.when(s.rlike(DOTTED), dotted).when(s.rlike(COMMAED), F.replace(s, F.lit(","), F.lit(""))).otherwise(F.replace(s, F.lit(","), F.lit("."))), scaled)

    def scaled(s: Column) -> Column:
        value = F.when(s.rlike(r"^[+-]?\d{1,20}(\.\d+)?$"), s.try_cast("decimal(38,12)"))
        return F.round(value * mult.cast("decimal(10,0)"), 6).cast(MONEY)

    return F.when(text.rlike(NUMERIC), let(F.replace(plain(text), F.lit("−"), F.lit("-")), signed))


def parse_number_with_unit(text: Column) -> Column:
    """struct(value, unit): a number with its scale, currency or unit in the same cell."""
    words = "|".join(UNIT_WORDS)
    bare = F.regexp_replace(plain(text), rf"(?iu){_EDGE}(?:{words}){_END}\.?|[%₽$€]", " ")
    bare = F.trim(F.regexp_replace(bare, r"(?<=\d)[\s'’](?=\d)", ""))
    return let(detect_unit(text), lambda info: F.struct(F.when(text.rlike(WITH_UNIT), parse_number(bare, info["multiplier"])).alias("value"), info.alias("unit")))


def fmt_number(value: Column, digits: int = 2) -> Column:
    """Blanks between thousands, decimal comma; null is «—»."""
    shown = F.translate(F.format_number(value.cast("decimal(28,6)"), digits), ",.", " ,")
    return F.coalesce(shown, F.lit("—"))


def fmt_money(value: Column, currency: Column, largest: int = 1_000_000_000) -> Column:
    """Amount in its natural scale, at most ``largest``, with the currency's sign."""
    size = F.abs(value)
    sign = F.lit("")
    for code, mark in SIGNS.items():
        sign = F.when(currency == code, f" {mark}").otherwise(sign)
    scaled = lambda by, word: F.concat(fmt_number(value / F.lit(by)), F.lit(f" {word}"))
    shown = fmt_number(value)
    for by, word in ((1_000, "тыс."), (1_000_000, "млн"), (1_000_000_000, "млрд")):
        shown = F.when(size >= by, scaled(by, word)).otherwise(shown) if by <= largest else shown
    return F.when(value.isNull(), "—").otherwise(F.concat(shown, sign))


def fmt_pct(value: Column, signed: bool = True) -> Column:
    body = F.concat(F.translate(F.format_number(value.cast("decimal(28,6)"), 1), ",.", " ,"), F.lit("%"))
    return F.when(value.isNull(), "—").otherwise(F.concat(F.when(value > 0, "+").otherwise(""), body) if signed else body)


def common_scale(value: Column, largest: Column) -> Column:
    """Value in the scale that suits the largest of its vector."""
    return value / F.when(largest >= 1_000_000_000, 1_000_000_000).when(largest >= 1_000_000, 1_000_000).when(largest >= 1_000, 1_000).otherwise(1)


def extract_numbers(text: Column) -> Column:
    """array<struct<value, unit>>: the numbers of a text in base units, in order.

    Only blanks and apostrophes part thousands here.  Scale words and one unit may follow a number in a chain.
    """
    number = r"\d{1,3}(?:[   '’]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?"
    unit = r"(?:\s*(?:млрд|млн|тыс|thousand|рублей|рубля|руб|₽|р\.|rub|usd|долл[\p{L}]*|\$|eur|евро|€|%))*"
    found = F.regexp_extract_all(text, F.lit(rf"(?iu)(?:{number}){unit}"), F.lit(0))

    def one(x: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(x, rf"^(?:{number})", 0), r"[   '’]", "")
        return let(F.lower(F.regexp_replace(x, rf"^(?:{number})", "")), lambda tail: of_tail(digits, tail))

    def of_tail(digits: Column, tail: Column) -> Column:
        factor = F.when(tail.rlike("млрд"), 1e9).otherwise(1.0) * F.when(tail.rlike("млн"), 1e6).otherwise(1.0) * F.when(tail.rlike("тыс|thousand"), 1e3).otherwise(1.0)
        kind = F.when(tail.rlike("%"), "%").when(tail.rlike(r"руб|₽|р\.|rub"), "₽").when(tail.rlike(r"usd|долл|\$"), "$").when(tail.rlike("eur|евро|€"), "€").otherwise("")
        return F.struct((F.replace(digits, F.lit(","), F.lit(".")).cast("double") * factor).alias("value"), kind.alias("unit"))

    return F.transform(found, one)
