"""Free-text ledger entries («1500 кофе», «расход: такси 700 01.03») as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermill.functions.numbers import let

# Words before the one that opens an entry, words that open it, those of an income among them, and words that make
# a message a question.
OPENERS = r"я|мы|сегодня|вчера|только что|опять|снова"
VERBS = r"расходы|расход|доходы|доход|потратил[аи]?|купил[аи]?|заплатил[аи]?|оплатил[аи]?|взял[аи]?|снял[аи]?|перев[её]л[аи]?|отдал[аи]?|ушло|получил[аи]?|пришло|заработал[аи]?"
INCOME = r"^(?:доход|получил|пришло|заработал)"
QUESTION = r"сколько|какой|какая|какие|каков|что|почему|прогноз|сравни|покажи|динамик|состав|доля"
NUMBER = r"(?:\d{1,3}(?:[ \u00a0\u202f]\d{3})+(?:[.,]\d+)?|\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+(?:[.,]\d+)?)"
SCALE = r"(?:\s*(к|k|тыс\.?[\p{L}]*|млн[\p{L}]*))?(?![\p{L}])"
CURRENCY = r"\s*(?:руб[\p{L}]*\.?|rub|₽|р\.?(?![\p{L}]))?"
LARGEST = 10**15


def _amount(text: Column, pattern: str) -> Column:
    digits = F.regexp_replace(F.regexp_extract(text, pattern, 1), r"[ \u00a0\u202f]", "")
    digits = F.when(digits.rlike(r"^\d{1,3}(\.\d{3})+(,\d+)?$"), F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(digits, F.lit(","), F.lit(".")))
    scale = F.lower(F.regexp_extract(text, pattern, 2))
    factor = F.when(scale.startswith("млн"), 1_000_000).when(scale != "", 1_000).otherwise(1)
    return (digits.try_cast("decimal(28,6)") * factor.cast("decimal(10,0)")).cast("decimal(28,6)")


def parse_entry(text: Column, today: Column) -> Column:
    """struct(kind, amount, description, when), or null if the message is no entry.

    The amount stands at the beginning, or else at the end; a date may close the message.  A message without an opening
    verb must be an amount and a few words without digits.
    """
    return let(F.trim(F.coalesce(text, F.lit(""))), lambda t: let(_opened(t), lambda o: let(_dated(o, today), lambda x: _entry(x, today))))


def _opened(t: Column) -> Column:
    """The message with its opening verb, and what comes after it."""
    opening = rf"(?isu)^\s*(?:(?:{OPENERS})\s+)*({VERBS})(?![\p{{L}}])\s*[:\-–—]?\s*(.*)$"
    verb = F.lower(F.regexp_extract(t, opening, 1))
    return F.struct(t.alias("all"), verb.alias("verb"), F.when(verb != "", F.regexp_extract(t, opening, 2)).otherwise(t).alias("body"))


def _dated(o: Column, today: Column) -> Column:
    """The same with the date that closes it, taken off; a date needs words or an amount before it: «кофе 12.50» alone is an amount."""
    body = o["body"]
    day = r"[(\[]?(?<![\d.,])(\d{1,2})\.(\d{1,2})(?:\.(\d{4}|\d{2}))?[)\]]?\s*$"
    y = F.regexp_extract(body, day, 3)
    y = F.when(y == "", F.year(today).cast("string")).when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    pad = lambda i: F.lpad(F.regexp_extract(body, day, i), 2, "0")
    named = F.try_to_timestamp(F.concat_ws("-", y, pad(2), pad(1)), F.lit("yyyy-MM-dd")).cast("date")
    before = F.regexp_replace(body, day, "")
    found = F.when(before.rlike(r"\d"), named)
    rest = F.trim(F.when(found.isNotNull(), F.regexp_replace(before, r"[ ,;\-–—()\[\]]+$", "")).otherwise(body))
    return F.struct(o["all"].alias("all"), o["verb"].alias("verb"), found.alias("day"), rest.alias("body"))


def _entry(x: Column, today: Column) -> Column:
    body, verb = x["body"], x["verb"]
    bare = body.rlike(rf"(?iu)^{NUMBER}{SCALE}{CURRENCY}\s+[^?\d]{{1,60}}$") | body.rlike(rf"(?iu)^[^?\d]{{1,60}}?\s+{NUMBER}{SCALE}{CURRENCY}\s*$")
    plain = (verb == "") & bare & ~x["all"].rlike(r"^20[0-4]\d(?:\s|$)") & ~F.lower(x["all"]).rlike(QUESTION)
    head, tail = rf"(?iu)^({NUMBER}){SCALE}{CURRENCY}(?=[(\[,;\s]|$)", rf"(?iu)(?:^|[\s(—-])({NUMBER}){SCALE}{CURRENCY}[\s)\]]*$"
    at_head = body.rlike(head)
    amount = F.when(at_head, _amount(body, head)).when(body.rlike(tail), _amount(body, tail))
    left = F.when(at_head, F.regexp_replace(body, head, "")).otherwise(F.regexp_replace(body, tail, ""))
    left = F.regexp_replace(F.regexp_replace(left, r"^[\s,;:\-–—()\[\]]+|[\s,;:\-–—()\[\]]+$", ""), r"(?iu)^(?:на|за)\s+", "")
    kind = F.when(verb.rlike(INCOME), "income").otherwise("expense")
    entry = F.struct(kind.alias("kind"), amount.alias("amount"), left.alias("description"), F.coalesce(x["day"], today).alias("when"))
    return let(entry, lambda e: F.when(((verb != "") | plain) & (e["amount"] > 0) & (e["amount"] < LARGEST), e))
