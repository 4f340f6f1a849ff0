"""Pages of positioned words as grids: lines, cells and columns by gaps, and tables that go on over page breaks.

Input are words (doc_id, page, x0, x1, y, text) as a tool for page formats gives them.  Words of a page form lines where gaps in y
part them, and blocks where wide gaps do; words of a line form cells; the cells of a table's lines form columns where
nothing reaches over from one to the next.  A block at the head of a page continues the table at the foot of the page before
if it repeats that table's header, or has none and lies within its width: its repeated header lines go, and its rows follow
on, so that the header, and the section that was open, hold for them as well.

Everything is windows by page and by document.  Words are shuffled once; their cells and lines are written tables, which the
steps by document read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.functions.numbers import detect_unit
from ledgermill.shared import written


@dataclass(frozen=True)
class Gaps:
    """Distances, in the pages' own unit: what parts lines, blocks of lines, cells and columns; how far a continued table may reach beyond the first page's."""

    line: float = 4.0
    block: float = 30.0
    cell: float = 8.0
    column: float = 1.0
    width: float = 20.0


#: Lines at a table's head that a later page may repeat.
HEADER_LINES = 5
#: A page with fewer characters has no text layer.
LEAST_TEXT = 20
PAGE, BLOCK, LINE = ["doc_id", "page"], ["doc_id", "page", "block"], ["doc_id", "page", "block", "line"]
NUMBER, YEAR = r"^[(\-−–—]?\s*\d[\d\s.,]*[)%]?$", r"^(?:19|20)\d\d$"


def placed(words: DataFrame) -> DataFrame:
    """The words that have a page, a place and text."""
    whole = F.col("page").isNotNull() & F.col("x0").isNotNull() & F.col("x1").isNotNull() & F.col("y").isNotNull() & (F.trim("text") != "")
    return words.where(whole).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page").cast("int").alias("page"), *[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "y")], F.trim("text").alias("text"))


def _group(break_: Column, w) -> Column:
    """Number of the group that a row is in, where ``break_`` says that a new one begins."""
    return F.sum(F.coalesce(break_.cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))


def cells(words: DataFrame, gaps: Gaps = Gaps()) -> DataFrame:
    """(doc_id, page, block, line, cell, x0, x1, text, width): the cells of every line, ``width`` the line's number of cells."""
    by_y = Window.partitionBy(*PAGE).orderBy("y", "x0")
    step = F.col("y") - F.lag("y").over(by_y)
    lined = placed(words).withColumn("step", step).withColumn("line", _group(F.col("step") > gaps.line, by_y)).withColumn("block", _group(F.col("step") > gaps.block, by_y))
    by_x = Window.partitionBy(*LINE).orderBy("x0", "x1", "text")
    reach = F.max("x1").over(by_x.rowsBetween(Window.unboundedPreceding, -1))
    parted = lined.withColumn("gap", F.col("x0") - reach).withColumn("cell", _group(F.col("gap") > gaps.cell, by_x))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))), lambda w: w["text"]), " ")
    found = parted.groupBy(*LINE, "cell").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), text.alias("text"))
    return found.withColumn("width", F.count(F.lit(1)).over(Window.partitionBy(*LINE)))


def _lines(found: DataFrame) -> DataFrame:
    """A row per line: its cells' texts, their extent, and whether one of them is a number (a year is none)."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("cell", "text"))), lambda c: c["text"])
    number = F.max(F.col("text").rlike(NUMBER) & ~F.col("text").rlike(YEAR))
    return found.groupBy(*LINE).agg(texts.alias("texts"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), number.alias("number"), F.count(F.lit(1)).alias("width"))


def _tables(lines: DataFrame, gaps: Gaps) -> tuple[DataFrame, DataFrame]:
    """Blocks with the table they belong to, and the texts of the first lines of each table.

    A block is a table if two of its lines have several cells, or if it continues one.
    """
    first = F.min_by(F.struct("texts", "number"), F.col("line"))
    wide = lines.where(F.col("width") > 1)
    blocks = wide.groupBy(*BLOCK).agg(first.alias("first"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count(F.lit(1)).alias("rows"), F.min("line").alias("top"))
    header = F.when(~F.col("first.number"), F.struct(F.transform("first.texts", lambda t: F.lower(t)).alias("texts"), "x0", "x1"))
    in_order = Window.partitionBy("doc_id").orderBy("page", "block")
    of_page = Window.partitionBy(*PAGE)
    seen = blocks.withColumn("header", header).withColumn("open", F.last("header", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
    follows = (F.col("block") == F.min("block").over(of_page)) & (F.lag("page").over(in_order) == F.col("page") - 1)
    fits = F.col("header").isNull() & (F.col("x0") >= F.col("open.x0") - gaps.width) & (F.col("x1") <= F.col("open.x1") + gaps.width)
    goes_on = F.coalesce(follows & (fits | (F.col("header.texts") == F.col("open.texts"))), F.lit(False))
    joined = seen.withColumn("goes_on", goes_on).where(F.col("goes_on") | (F.col("rows") > 1)).withColumn("table", _group(~F.col("goes_on"), in_order))
    begun = Window.partitionBy("doc_id", "table")
    joined = joined.withColumn("begins", F.min(F.struct("page", "block")).over(begun))
    on_page = Window.partitionBy("doc_id", "begins.page").orderBy("begins.block")
    named = joined.withColumn("sheet", F.format_string("стр. %d, таблица %d", F.col("begins.page"), F.dense_rank().over(on_page)))
    blocks = named.select(*BLOCK, "sheet", "goes_on")
    heads = lines.join(blocks.where("not goes_on"), BLOCK).withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "sheet").orderBy("line"))).where(F.col("_r") <= HEADER_LINES)
    return blocks, heads.groupBy("doc_id", "sheet").agg(F.collect_set("texts").alias("head"))


def page_grid(words: DataFrame, gaps: Gaps = Gaps()) -> DataFrame:
    """Long grid (doc_id, sheet, row, col, raw, cell_type) of the tables; ``sheet`` names the page on which a table begins."""
    found = written(cells(words, gaps), "page-cells")
    lines = written(_lines(found), "page-lines")
    blocks, heads = _tables(lines, gaps)
    down = Window.partitionBy(*BLOCK).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    told = lines.select(*LINE, "texts").join(blocks, BLOCK).join(heads, ["doc_id", "sheet"])
    told = told.withColumn("again", F.min(F.col("goes_on") & F.array_contains("head", F.col("texts"))).over(down)).where("not again")
    rows = told.select(*LINE, "sheet", (F.row_number().over(Window.partitionBy("doc_id", "sheet").orderBy("page", "line")) - 1).alias("row"))
    body = found.join(rows, LINE)
    across = Window.partitionBy("doc_id", "sheet").orderBy("x0", "x1")
    reach = F.max("x1").over(across.rowsBetween(Window.unboundedPreceding, -1))
    starts = body.where(F.col("width") > 1).withColumn("reach", reach).where(F.col("reach").isNull() | (F.col("x0") > F.col("reach") + gaps.column))
    starts = starts.groupBy("doc_id", "sheet").agg(F.array_sort(F.collect_set("x0")).alias("starts"))
    at = F.greatest(F.size(F.filter("starts", lambda s: s <= F.col("x0") + gaps.column)) - 1, F.lit(0))
    # Of two cells that begin in one column, as a line out of the columns may have, the texts follow one another.
    put = body.join(starts, ["doc_id", "sheet"]).withColumn("col", at).groupBy("doc_id", "sheet", "row", "col")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda c: c["text"]), " ")
    return put.agg(text.alias("raw")).select("doc_id", "sheet", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "raw", F.lit("text").alias("cell_type"))


def page_texts(words: DataFrame, gaps: Gaps = Gaps()) -> DataFrame:
    """(doc_id, page, text): every page as text, cells parted by four blanks, lines by newlines."""
    lines = _lines(cells(words, gaps)).withColumn("said", F.array_join("texts", "    "))
    return lines.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "said"))), lambda x: x["said"]), "\n").alias("text"))


def document_units(words: DataFrame, gaps: Gaps = Gaps()) -> DataFrame:
    """(doc_id, unit): the unit that the first page to state one («Единица измерения: тыс. руб.») gives to the document's tables."""
    said = F.regexp_extract("text", r"(?iu)(?:единиц[аы]\s+измерения|ед\.\s*изм\.?|в\s+(?=тыс|млн|млрд))[:\s]*([^\n]{0,40})", 1)
    units = page_texts(words, gaps).withColumn("unit", detect_unit(said)).where((said != "") & ((F.col("unit.multiplier") > 1) | (F.col("unit.currency") != "")))
    return units.groupBy("doc_id").agg(F.min_by("unit", "page").alias("unit"))


def problems(words: DataFrame) -> DataFrame:
    """(doc_id, page, reason) of pages that can't be read: too little text, or words without a place."""
    whole = F.col("x0").isNotNull() & F.col("x1").isNotNull() & F.col("y").isNotNull()
    by_page = words.groupBy(F.col("doc_id").cast("string").alias("doc_id"), F.col("page").cast("int").alias("page")).agg(
        F.sum(F.when(whole, F.length(F.trim(F.coalesce("text", F.lit(""))))).otherwise(0)).alias("chars"), F.sum((~whole & (F.trim(F.coalesce("text", F.lit(""))) != "")).cast("int")).alias("lost")
    )
    reason = F.when(F.col("lost") > 0, F.format_string("%d words without a place", F.col("lost"))).when(F.col("chars") < LEAST_TEXT, F.lit("no text layer"))
    return by_page.withColumn("reason", reason).where("reason is not null").select("doc_id", "page", "reason")
