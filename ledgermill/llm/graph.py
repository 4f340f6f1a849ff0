"""Connected components of an edge table, with alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.common import discard, new_path


#: The edges of a node are dealt to this many tasks, so that a hub is none's alone; its smallest neighbour goes to each.
SALTS = 8


def salted(edges: DataFrame) -> DataFrame:
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))


def spread(marks: DataFrame) -> DataFrame:
    # Spark's estimate would not see the copies, so it is told not to broadcast them.
    return marks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges`` (u long, v long); root is the component's smallest node.

    Each round is two joins on a node with its smallest neighbour, written to the shared folder; the number of rounds is
    logarithmic in the longest chain.  Only a count and a checksum reach the driver.
    """
    spark = edges.sparkSession
    now, at, before = None, None, None

    def keep(some: DataFrame) -> None:
        nonlocal now, at
        path = new_path(spark, name)
        some.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().write.parquet(path)
        if at:
            discard(spark, at)  # the round before this one
        now, at = spark.read.schema("u long, v long").parquet(path), path

    keep(edges.where("u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")))
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before or mark[0] == 0:
            break
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = spread(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = salted(both).join(least, ["u", "salt"]).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = salted(large).join(spread(low), ["u", "salt"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        keep(hooked.union(low.select("u", F.col("m").alias("v"))))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
