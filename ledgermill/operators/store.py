"""Fact store: row-level visibility, versions, series, hierarchy, maintenance.

Facts carry their document's flags (a broadcast-sized or co-partitioned join made once, in ``with_documents``); every read
goes through ``visible``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermill.shared import written

def with_documents(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Facts with is_private, superseded, uploaded_by of their documents."""
    return facts.join(documents.select("document_id", "is_private", F.col("superseded_by_id").isNotNull().alias("superseded"), "uploaded_by"), "document_id")


def visible_to(uid: int | None) -> Column:
    """Shared (null counts as shared) or the reader's own; without a reader, shared only."""
    shared = ~F.coalesce(F.col("is_private"), F.lit(False))
    return shared if uid is None else shared | (F.col("uploaded_by") == uid)


def visible(facts: DataFrame, org: int | None = None, uid: int | None = None, current: bool = True) -> DataFrame:
    keep = visible_to(uid)
    if org is not None:
        keep = keep & (F.col("org_id") == org)
    if current:
        keep = keep & ~F.coalesce(F.col("superseded"), F.lit(False))
    return facts.where(keep)


def reviewed(facts: DataFrame) -> DataFrame:
    return facts.where(~F.coalesce(F.col("needs_review"), F.lit(False)))


def of_variant(facts: DataFrame, variant: str) -> DataFrame:
    return facts.where(F.coalesce(F.col("variant"), F.lit("fact")) == variant)


def in_years(rows: DataFrame, years: Iterable[int]) -> DataFrame:
    """Rows whose period touches one of the years."""
    wanted = F.array(*(F.lit(int(y)) for y in years))
    return rows.where(F.exists(wanted, lambda y: y.between(F.year("period_start"), F.year("period_end"))))


def in_months(rows: DataFrame, months: Iterable[int]) -> DataFrame:
    return rows.where((F.col("period_type") == "month") & F.month("period_start").isin(*months))


def latest_wins(facts: DataFrame, keys: tuple[str, ...] = ("org_id", "metric", "variant", "period_end")) -> DataFrame:
    """One row per series point: the one of the newest document; of one document, that of the longest period.

    A point is where a period ends, so a year and its December are one point and a series is never both.
    """
    newest = Window.partitionBy(*keys).orderBy(F.col("document_id").desc(), "period_start", F.col("value").desc())
    return facts.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def series(facts: DataFrame, org: int | None = None, uid: int | None = None, variant: str = "fact", review: bool = True) -> DataFrame:
    rows = of_variant(visible(facts, org, uid), variant)
    return latest_wins(reviewed(rows) if review else rows)


def first_non_empty(series_rows: DataFrame, metric: str) -> DataFrame:
    """The metric's own series; if it has none, that of «<metric> итого»."""
    total = f"{metric} итого"
    both = series_rows.where(F.col("metric").isin(metric, total))
    best = both.agg(F.max((F.col("metric") == metric).cast("int")).alias("own"))
    return both.crossJoin(F.broadcast(best)).where((F.col("metric") == metric) == (F.col("own") == 1)).drop("own")


def tree(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """(name, parent) → every node with its root, depth and path, by a recursive query."""
    nodes.createOrReplaceTempView("_ledgermill_nodes")
    return spark.sql("""
        WITH RECURSIVE t(name, root, depth, path) AS (
          SELECT name, name, 0, name FROM _ledgermill_nodes WHERE parent IS NULL
          UNION ALL
          SELECT n.name, t.root, t.depth + 1, concat(t.path, ' > ', n.name) FROM _ledgermill_nodes n JOIN t ON n.parent = t.name)
        SELECT name, root, depth, path FROM t""")


def containment_parent(new: DataFrame, known: DataFrame) -> DataFrame:
    """For each new name the first known name (alphabetically) that it contains and is longer than.

    A known name is posted under its first three characters (all of it, if it is shorter), a new one under each run of one to
    three of its own, so the two meet by a hash join and not in a cross product.
    """
    grams = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    left = new.select("name", F.explode(F.array_distinct(F.concat(*(grams(F.col("name"), n) for n in (1, 2, 3))))).alias("gram"))
    right = known.where("name <> ''").select(F.col("name").alias("inner"), F.left("name", F.lit(3)).alias("gram"))
    met = left.join(right, "gram").where(F.contains("name", "inner") & (F.length("name") > F.length("inner")))
    return met.groupBy("name").agg(F.min("inner").alias("parent"))


def orphans(metrics: DataFrame, facts: DataFrame) -> DataFrame:
    """Metrics (name, parent) with neither facts nor children, and then those that this leaves bare, to the fixed point.

    Anti joins over the metric dictionary; it ends when a round finds none.  Metrics on a cycle have children and stay.  Each
    round reads the one before it several times, so rounds are written to the shared folder.
    """
    used = facts.select(F.col("metric").alias("name")).distinct()
    left, gone = metrics, metrics.limit(0)
    while True:
        parents = left.where("parent is not null").select(F.col("parent").alias("name")).distinct()
        bare = written(left.join(used, "name", "left_anti").join(parents, "name", "left_anti"), "orphans")
        if bare.isEmpty():
            return gone
        gone = gone.unionByName(bare)
        left = written(left.join(bare.select("name"), "name", "left_anti"), "metrics-left")


def supersede_candidates(documents: DataFrame, returned: int = 3) -> DataFrame:
    """For each document the newest earlier ones of its organisation that share a period label.

    ``documents``: document_id, org_id, uploaded_at, periods array<string>; earlier is by (uploaded_at, document_id).
    The newest that share any label are among the newest that share one, so each (org, label) run gives only as many
    predecessors as are returned, and never its pairs.
    """
    labels = documents.select("org_id", "document_id", "uploaded_at", F.explode("periods").alias("label"))
    run = Window.partitionBy("org_id", "label").orderBy("uploaded_at", "document_id").rowsBetween(-returned, -1)
    near = labels.withColumn("others", F.collect_list(F.struct("uploaded_at", "document_id")).over(run)).select("org_id", "document_id", F.explode("others").alias("other")).distinct()
    newest = Window.partitionBy("document_id").orderBy(F.col("other").desc())
    return near.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= returned).select("org_id", "document_id", F.col("other.document_id").alias("other_id"), "rank")


def duplicates(files: DataFrame, content: str = "content") -> DataFrame:
    """Each file with its SHA-256 and the first file of the same organisation with equal content."""
    same = Window.partitionBy("org_id", "file_hash").orderBy("file_id")
    return files.withColumn("file_hash", F.sha2(F.col(content).cast("binary"), 256)).withColumn("original_id", F.first("file_id").over(same))


# Maintenance: each returns the table after the change; writing it back is ``save``.


def confirm(facts: DataFrame, document_id: int, uid: int | None = None) -> DataFrame:
    """The document's facts as reviewed, and certain where the table has a confidence."""
    mine = (F.col("document_id") == document_id) & (visible_to(uid) if uid is not None else F.lit(True))
    out = facts.withColumn("needs_review", F.col("needs_review") & ~mine)
    return out.withColumn("confidence", F.when(mine, F.lit(1.0)).otherwise(F.col("confidence"))) if "confidence" in facts.columns else out


def supersede(documents: DataFrame, old_id: int, new_id: int) -> DataFrame:
    """Mark the old version, if both are different documents of one organisation."""
    orgs = documents.where(F.col("document_id").isin(old_id, new_id)).agg(F.count_distinct("org_id").alias("orgs"), F.count_distinct("document_id").alias("docs"))
    ok = documents.crossJoin(F.broadcast(orgs))
    return ok.withColumn("superseded_by_id", F.when((F.col("document_id") == old_id) & (F.col("orgs") == 1) & (F.col("docs") == 2), F.lit(new_id).cast("long")).otherwise(F.col("superseded_by_id"))).drop("orgs", "docs")


def set_private(documents: DataFrame, document_id: int, uid: int, private: bool) -> DataFrame:
    own = (F.col("document_id") == document_id) & (F.col("uploaded_by") == uid)
    return documents.withColumn("is_private", F.when(own, F.lit(private)).otherwise(F.col("is_private")))


def delete_document(documents: DataFrame, children: dict[str, DataFrame], document_id: int, uid: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Without the document (the system journal, uploaded by 0, stays), its back references and its rows elsewhere."""
    target = documents.where((F.col("document_id") == document_id) & (F.col("uploaded_by") == uid) & (F.col("uploaded_by") != 0)).select("document_id")
    left = documents.join(F.broadcast(target), "document_id", "left_anti")
    back = F.broadcast(target.select(F.col("document_id").alias("_gone")))
    left = left.join(back, left["superseded_by_id"] == F.col("_gone"), "left").withColumn("superseded_by_id", F.when(F.col("_gone").isNull(), F.col("superseded_by_id"))).drop("_gone")
    return left, {name: rows.join(F.broadcast(target), "document_id", "left_anti") for name, rows in children.items()}


def without_orphans(metrics: DataFrame, facts: DataFrame) -> DataFrame:
    """The dictionary after a deletion: without the metrics that it leaves with neither facts nor children."""
    return metrics.join(orphans(metrics, facts).select("name"), "name", "left_anti")


def newest_documents(documents: DataFrame, org: int, uid: int | None = None, most: int = 50) -> DataFrame:
    """The documents of an organisation that the reader may see, newest first."""
    mine = documents.where((F.col("org_id") == org) & visible_to(uid))
    return mine.orderBy(F.col("uploaded_at").desc(), F.col("document_id").desc()).limit(most)


def delete_user(documents: DataFrame, children: dict[str, DataFrame], uid: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Without everything that a user uploaded: documents, back references to them, and their rows elsewhere."""
    target = documents.where((F.col("uploaded_by") == uid) & (F.col("uploaded_by") != 0)).select("document_id")
    left = documents.join(target, "document_id", "left_anti")
    gone = target.select(F.col("document_id").alias("_gone"))
    left = left.join(gone, left["superseded_by_id"] == F.col("_gone"), "left").withColumn("superseded_by_id", F.when(F.col("_gone").isNull(), F.col("superseded_by_id"))).drop("_gone")
    return left, {name: rows.join(target, "document_id", "left_anti") for name, rows in children.items()}


def unreferenced(files: DataFrame, documents: DataFrame) -> DataFrame:
    return files.join(documents.select("stored_path"), "stored_path", "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def save(rows: DataFrame, path: str, by: str = "document_id") -> None:
    """Replace the rows of the documents at hand and no others."""
    rows.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
