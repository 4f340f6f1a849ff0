"""Grounding: are the numbers of an answer those of its data?

An answer's numbers and what it may say are arrays of one row, so the tolerance match is an expression inside the row; no
answer is compared with another one's data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.functions.numbers import extract_numbers, let

RELATIVE, ABSOLUTE = 0.005, 0.011
SCALES = (1.0, 1e3, 1e6, 1e9)
COUNTER = 31
PERCENT_SLACK = 2.0


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.abs(b) * RELATIVE, F.lit(ABSOLUTE))


def same_amount(a: Column, b: Column) -> Column:
    """Equal within tolerance, in any of the scales in which amounts are written."""
    out = close(a, b)
    for s in SCALES[1:]:
        out = out | close(a * s, b)
    return out


def same_unit(a: Column, b: Column) -> Column:
    """Percent only with percent; otherwise a missing unit fits any."""
    return ((a == "%") == (b == "%")) & ((a == "") | (b == "") | (a == b))


def foreign_numbers(numbers: Column, allowed: Column) -> Column:
    """The numbers that the data doesn't explain; bare years and small counts need no explanation."""
    shares = F.transform(F.filter(allowed, lambda a: a["unit"] == "%"), lambda a: a["value"])

    def unexplained(lows: Column) -> Column:
        def explained(n: Column) -> Column:
            bare = (n["unit"] == "") & (n["value"] == F.floor(n["value"]))
            year = bare & n["value"].between(1900, 2100)
            count = bare & (n["value"] > 0) & (n["value"] <= COUNTER)
            spread = (n["unit"] == "%") & lows["least"].isNotNull() & n["value"].between(lows["least"] - PERCENT_SLACK, lows["most"] + PERCENT_SLACK)
            return year | count | spread | said(n, lows["all"])

        return F.filter(numbers, lambda n: ~explained(n))

    return let(F.struct(F.array_min(shares).alias("least"), F.array_max(shares).alias("most"), allowed.alias("all")), unexplained)


def said(n: Column, allowed: Column) -> Column:
    """Is the number one of the allowed ones, in any scale?"""
    return F.exists(allowed, lambda a: same_unit(n["unit"], a["unit"]) & same_amount(n["value"], a["value"]))


def derived(amounts: Column) -> Column:
    """Sums, differences, growth and shares of all pairs of amounts."""
    pairs = F.flatten(F.transform(amounts, lambda a: F.transform(amounts, lambda b: F.struct(a["value"].alias("a"), b["value"].alias("b"), a["unit"].alias("unit")))))
    of = lambda p: F.array(
        F.struct((p["a"] + p["b"]).alias("value"), p["unit"].alias("unit")),
        F.struct((p["a"] - p["b"]).alias("value"), p["unit"].alias("unit")),
        F.struct(F.coalesce((p["a"] / F.nullif(p["b"], F.lit(0.0)) - 1) * 100, F.lit(0.0)).alias("value"), F.lit("%").alias("unit")),
        F.struct(F.coalesce(p["a"] / F.nullif(p["b"], F.lit(0.0)) * 100, F.lit(0.0)).alias("value"), F.lit("%").alias("unit")),
    )
    return F.flatten(F.transform(pairs, of))


def claims(answer: Column) -> Column:
    """array<struct<year, value>>: amounts that follow a year at a short distance."""
    unit = r"(?:\s*(?:млрд|млн|тыс|руб[\p{L}]*|₽|%))?"
    pattern = rf"(?iu)(?:19|20)\d{{2}}(?!\d)[^\d\n]{{1,24}}?\d[\d   ']*(?:[.,]\d+)?{unit}"
    return F.transform(F.regexp_extract_all(answer, F.lit(pattern), F.lit(0)), lambda c: F.struct(F.left(c, F.lit(4)).alias("year"), F.element_at(extract_numbers(F.substring(c, F.lit(5), F.length(c))), 1)["value"].alias("value")))


def misattributed(answer: Column, history: Column) -> Column:
    """Claims whose value is another year's and not the named one's; ``history`` is array<struct<year, value>>."""
    return F.filter(
        claims(answer),
        lambda c: F.exists(history, lambda h: h["year"] == c["year"]) & F.exists(history, lambda h: close(c["value"], h["value"])) & ~F.exists(history, lambda h: (h["year"] == c["year"]) & close(c["value"], h["value"])),
    )


def review(answers: DataFrame, with_derived: bool = True) -> DataFrame:
    """answers (answer_id, answer, template, allowed, history) with ok, foreign and misattributed.

    With ``with_derived``, sums, differences and growth of the allowed amounts are allowed as well; they are made only where
    numbers remain that nothing else explains, and for those alone.
    """
    direct = F.concat(F.col("allowed"), extract_numbers(F.coalesce("template", F.lit(""))))

    def rest(left: Column) -> Column:
        if not with_derived:
            return left
        made = lambda: derived(F.filter(F.col("allowed"), lambda a: a["unit"] != "%"))
        return F.when(F.size(left) == 0, left).otherwise(let(made(), lambda m: unspread(left, m)))

    def unspread(left: Column, made: Column) -> Column:
        return foreign_numbers(left, F.concat(direct, made))

    foreign = let(foreign_numbers(extract_numbers(F.col("answer")), direct), rest)
    both = F.struct(F.transform(foreign, lambda n: n["value"]).alias("foreign"), misattributed(F.col("answer"), F.col("history")).alias("misattributed"))
    checked = let(both, lambda x: F.struct(((F.size(x["foreign"]) == 0) & (F.size(x["misattributed"]) == 0)).alias("ok"), x["foreign"].alias("foreign"), x["misattributed"].alias("misattributed")))
    return answers.select("answer_id", F.inline(F.array(checked)))


def allowed_of(rows: DataFrame, amounts: dict[str, str], shares: tuple[str, ...] = ()) -> DataFrame:
    """What answers may say, from result rows (answer_id, …): amount columns with their unit, and percent columns.

    One array per answer; a result row set is a report, so it is short.
    """
    cells = [F.struct(F.col(c).cast("double").alias("value"), F.lit(unit).alias("unit")) for c, unit in amounts.items()] + [F.struct(F.col(c).cast("double").alias("value"), F.lit("%").alias("unit")) for c in shares]
    long = rows.select("answer_id", F.explode(F.array(*cells)).alias("x")).where("x.value is not null")
    return long.groupBy("answer_id").agg(F.collect_list("x").alias("allowed"))


def answer_or_template(tries: DataFrame) -> DataFrame:
    """First try of each answer that passed review (answer_id, try, ok, answer, template), else the template."""
    return tries.groupBy("answer_id").agg(F.min_by("answer", F.when(F.col("ok"), F.col("try"))).alias("passed"), F.first("template").alias("template")).select("answer_id", F.coalesce("passed", "template").alias("answer"), F.col("passed").isNotNull().alias("from_model"))
