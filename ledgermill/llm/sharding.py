"""Sharding over fixed virtual slots.

Records are hashed into a fixed number of virtual slots by their content, so equal texts share a slot.  Bytes are
aggregated per slot, and a versioned slot-to-shard map is kept as a table: version 0 deals slots round-robin, each
rebalance reads the latest version, moves only what does not fit and appends the next version.  A slot heavier than
``HOT_SHARE`` of a shard is split into sub-slots by content, so equal texts still go together; only a single text that is
itself heavier than that is dealt by record id, so a group of copies that holds a third of all rows is spread as well.

Everything here is DataFrame expressions; documents are read once for their keys.  What is broadcast is the map (a row a
slot, and ``2 * SUBS`` for each split one) and the split slots and heavy texts, of which there are at most
``shards / HOT_SHARE`` each, whatever the input.  Positions are numbered inside parts of a few average slots' records, so a
heavy slot or text is many parts.

Defined cases: a null text has size 1 and checksum 0; null ids hash like an empty id; rows repeated in full each get
their own position; an empty table gives an empty result; columns other than the id and the text are ignored, so
clashing names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermill.llm.common import new_path, stash

SHARDS = 8
SLOTS = 4096
SUBS = 64
#: A slot that holds more than this share of an even shard is split into its sub-slots.
HOT_SHARE = 0.5
#: How far above an even share a shard may be filled by the slots that stay where they are.
SLACK = 0.0005
#: Records numbered in one task: as many as PART_SLOTS average slots hold, and no more than PART_ROWS.
PART_SLOTS, PART_ROWS = 4, 1 << 20
#: The sub-slot of a slot that is whole.
WHOLE = -1


def _keys(record_id: Column, text: Column) -> tuple[Column, ...]:
    """The virtual slot, and numbers for the content and the id: of their MD5 (so that SQL can follow)."""
    digits = lambda c, start, n: F.conv(F.substring(F.md5(F.coalesce(c, F.lit("")).cast("binary")), start, n), 16, 10).cast("long")
    return F.pmod(digits(text, 1, 8), F.lit(SLOTS)).cast("int").alias("vslot"), digits(text, 9, 12).alias("text_key"), digits(record_id.cast("string"), 9, 8).alias("id_key")


def _split(keyed: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """The slots that are too heavy to be whole, and the texts in them that are too heavy to stay together."""
    most = keyed.groupBy().agg((F.sum("size") * HOT_SHARE / shards).alias("most"))
    heavier = lambda some, by: some.groupBy(*by).agg(F.sum("size").alias("bytes")).crossJoin(F.broadcast(most)).where("bytes > most").select(*by)
    hot = stash(heavier(keyed, ["vslot"]), "hot-slots")
    return hot, stash(heavier(keyed.join(F.broadcast(hot), "vslot"), ["vslot", "text_key"]), "heavy-texts")


def _with_sub(keyed: DataFrame, hot: DataFrame, heavy: DataFrame) -> DataFrame:
    """``keyed`` with its sub-slot: WHOLE, one of SUBS by content, or, of a heavy text, one of SUBS more by id."""
    by = F.when(F.col("_heavy"), SUBS + F.pmod("id_key", F.lit(SUBS))).when(F.col("_hot"), F.pmod("text_key", F.lit(SUBS))).otherwise(WHOLE)
    return (
        keyed.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "vslot", "left")
        .join(F.broadcast(heavy.withColumn("_heavy", F.lit(True))), ["vslot", "text_key"], "left")
        .withColumn("sub", by.cast("int"))
        .drop("_hot", "_heavy")
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return stash(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            *_keys(F.col(id_col), text),
        ),
        "shard-keys",
    )


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per record: id, size, checksum, virtual slot and sub-slot; the text itself goes no further."""
    keyed = _keyed(docs, id_col, text_col)
    return _with_sub(keyed, *_split(keyed, shards)).select("doc_id", "size", "text_crc32", "vslot", "sub", "id_key")


def slot_bytes(recs: DataFrame) -> DataFrame:
    """Bytes and rows per unit of placement: a slot, or a sub-slot of a split one."""
    return recs.groupBy("vslot", "sub").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


class SlotMap:
    """Versioned slot-to-shard map in a Parquet table partitioned by version; old versions stay readable.

    A row says where a unit goes: (vslot, null) is a whole slot, (vslot, sub) one sub-slot of a split slot.  A version is
    written once; of two rebalances of the same version the second fails.
    """

    SCHEMA = "vslot int, sub int, shard int, version int"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "slot-map")

    def create(self, shards: int, slots: int = SLOTS) -> SlotMap:
        self._append(self.spark.range(slots).select(F.col("id").cast("int").alias("vslot"), F.lit(None).cast("int").alias("sub"), F.pmod("id", F.lit(shards)).cast("int").alias("shard")), 0)
        return self

    def _append(self, rows: DataFrame, version: int) -> None:
        rows.select("vslot", "sub", "shard").coalesce(1).write.mode("error").parquet(f"{self.path}/version={version}")

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema("vslot int, sub int, shard int").parquet(f"{self.path}/version={version}")

    def latest(self) -> int:
        """The newest version that is there in full: one whose write was broken off has no files yet."""
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).agg(F.max("version")).first()[0]

    def rebalance(self, sizes: DataFrame, shards: int, version: int | None = None) -> DataFrame:
        """Edit version ``version`` (the latest) for the measured bytes, append the result as the next version and return it.

        Units go from the largest to the smallest: each stays at home while that shard has room, otherwise it moves to
        the lightest shard.  The fold runs over one array, whose length the number of slots and of split slots bounds.
        """
        version = self.latest() if version is None else version
        units = sizes.groupBy("vslot", F.when(F.col("sub") >= 0, F.col("sub")).alias("sub")).agg(F.sum("bytes").alias("bytes"))
        home = self.read(version)
        # A slot that was split before and is whole again goes home with its first sub-slot.
        whole = home.groupBy("vslot").agg(F.min_by("shard", F.coalesce("sub", F.lit(-1))).alias("whole_home"))
        split = home.where(F.col("sub").isNotNull()).select("vslot", "sub", F.col("shard").alias("split_home"))
        units = (
            whole.join(units, "vslot", "left")
            .join(split, ["vslot", "sub"], "left")
            .select("vslot", "sub", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.pmod(F.coalesce("split_home", F.col("whole_home") + F.coalesce("sub", F.lit(0))), F.lit(shards)).cast("int").alias("home"))
        )
        one = units.groupBy().agg(
            F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), "vslot", F.coalesce("sub", F.lit(-1)).alias("sub"), "home"))).alias("units"),
            (F.sum("bytes") * (1 + SLACK) / shards).alias("room"),
        )

        def place(state, unit):
            loads = state["loads"]
            at = F.when(F.get(loads, unit["home"]) - unit["neg"] <= F.col("room"), unit["home"]).otherwise((F.array_position(loads, F.array_min(loads)) - 1).cast("int"))
            return F.struct(
                F.transform(loads, lambda load, i: F.when(i == at, load - unit["neg"]).otherwise(load)).alias("loads"),
                F.array_append(state["shards"], at).alias("shards"),
            )

        start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.expr("cast(array() as array<int>)").alias("shards"))
        placed = one.select(F.explode(F.arrays_zip(F.col("units"), F.aggregate("units", start, place, lambda s: s["shards"]).alias("shards"))).alias("x"))
        rows = placed.select(F.col("x.units.vslot").alias("vslot"), F.when(F.col("x.units.sub") >= 0, F.col("x.units.sub")).alias("sub"), F.col("x.shards").alias("shard"))
        self._append(rows, version + 1)
        return self.read(version + 1)


def shard_of(sizes: DataFrame, slot_map: DataFrame) -> DataFrame:
    """(vslot, sub) with its shard."""
    return sizes.join(F.broadcast(slot_map.select("vslot", F.coalesce("sub", F.lit(WHOLE)).alias("sub"), "shard")), ["vslot", "sub"])


def place(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", slot_map: SlotMap | None = None) -> DataFrame:
    """The documents with ``shard`` and ``virtual_slot`` added (columns of these names are replaced, all others stay): no document is shuffled.

    With a kept ``slot_map`` its latest version is edited, so that few slots move.
    """
    keyed = _keyed(docs, id_col, text_col)
    split = _split(keyed, shards)
    sizes = stash(slot_bytes(_with_sub(keyed, *split)), "slot-bytes")
    slot_map = slot_map or SlotMap(docs.sparkSession).create(shards)
    placed = shard_of(sizes, slot_map.rebalance(sizes, shards)).select("vslot", "sub", "shard")
    rows = docs.select(F.struct("*").alias("_row"), *(F.col(c).alias(a) for c, a in ((id_col, "doc_id"), (text_col, "text"))))
    subs = _with_sub(rows.select("_row", *_keys(F.col("doc_id"), F.col("text"))), *split)
    old = [F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in ("shard", "virtual_slot")]
    return subs.join(F.broadcast(placed), ["vslot", "sub"]).select(*old, "shard", F.col("vslot").alias("virtual_slot"))


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", slot_map: SlotMap | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """Documents with their shard, their gapless position in it, and the virtual slot; sizes of shards are near equal."""
    recs = records(docs, id_col, text_col, shards)
    slot_map = slot_map or SlotMap(docs.sparkSession).create(shards)
    sizes = stash(slot_bytes(recs), "slot-bytes")
    few = sizes.groupBy().agg(F.least(F.lit(part_rows), F.greatest(F.lit(1), F.ceil(F.sum("rows") * PART_SLOTS / SLOTS))).alias("few"))
    placed = shard_of(sizes, slot_map.rebalance(sizes, shards)).crossJoin(F.broadcast(few))
    placed = stash(placed.withColumn("parts", F.ceil(F.col("rows") / F.col("few"))), "placed-slots")
    parted = recs.join(F.broadcast(placed.select("vslot", "sub", "shard", "parts")), ["vslot", "sub"]).withColumn("part", F.pmod("id_key", "parts"))
    before = Window.partitionBy("shard").orderBy("vslot", "sub", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parted.groupBy("vslot", "sub", "part", "shard").agg(F.count(F.lit(1)).alias("rows")).withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)).cast("long"))
    inside = Window.partitionBy("vslot", "sub", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        parted.withColumn("inside", F.row_number().over(inside))
        .join(starts.select("vslot", "sub", "part", "start"), ["vslot", "sub", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("inside") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"))
    )


#: The same in DuckDB: its own CRC-32 from the polynomial, the fold over units as a recursive query.
ORACLE = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
x AS (SELECT doc_id, coalesce(text, '') AS text, string_split(hex(encode(coalesce(text, ''))), '') AS h FROM documents),
y AS (SELECT doc_id, text, list_transform(range(1, strlen(text) + 1), lambda i: (strpos('0123456789ABCDEF', h[2 * i - 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i]) - 1) AS b FROM x),
d AS (SELECT doc_id, strlen(text)::BIGINT + 1 AS size, xor(list_reduce(list_prepend(4294967295, b), lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8)), 4294967295)::BIGINT AS text_crc32,
  CAST(CAST('0x' || md5(text)[1:8] AS BIGINT) % {SLOTS} AS INTEGER) AS vslot, CAST('0x' || md5(text)[9:20] AS BIGINT) AS text_key, CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), ''))[9:16] AS BIGINT) AS id_key FROM y, crc),
tot AS (SELECT coalesce(sum(size), 0)::BIGINT AS total FROM d),
hot AS (SELECT vslot FROM d, tot GROUP BY vslot, total HAVING sum(size) > {HOT_SHARE}::DOUBLE * total / {SHARDS}),
heavy AS (SELECT vslot, text_key FROM d, tot WHERE vslot IN (SELECT vslot FROM hot) GROUP BY vslot, text_key, total HAVING sum(size) > {HOT_SHARE}::DOUBLE * total / {SHARDS}),
e AS (SELECT *, CAST(CASE WHEN (vslot, text_key) IN (SELECT (vslot, text_key) FROM heavy) THEN {SUBS} + id_key % {SUBS} WHEN vslot IN (SELECT vslot FROM hot) THEN text_key % {SUBS} ELSE {WHOLE} END AS INTEGER) AS sub FROM d),
sizes AS (SELECT vslot, sub, sum(size)::BIGINT AS bytes, CAST(ceil(count(*) / (SELECT least({PART_ROWS}, greatest(1, ceil(count(*) * {PART_SLOTS} / {SLOTS}))) FROM d)) AS BIGINT) AS parts FROM e GROUP BY ALL),
units AS (SELECT vslot, CASE WHEN sub >= 0 THEN sub END AS sub, bytes FROM sizes),
numbered AS (SELECT s.vslot, u.sub, coalesce(bytes, 0) AS bytes, (s.vslot % {SHARDS} + coalesce(u.sub, 0)) % {SHARDS} AS home, row_number() OVER (ORDER BY coalesce(bytes, 0) DESC, s.vslot, coalesce(u.sub, -1)) AS k
  FROM (SELECT CAST(range AS INTEGER) AS vslot FROM range({SLOTS})) s LEFT JOIN units u USING (vslot)),
room AS (SELECT CAST(total AS DOUBLE) * {1 + SLACK}::DOUBLE / {SHARDS} AS room FROM tot),
fold(k, loads, shard) AS (
 SELECT 0::BIGINT, list_transform(range({SHARDS}), lambda i: 0::BIGINT), -1
 UNION ALL SELECT k, list_transform(loads, lambda v, i: CASE WHEN i - 1 = goes THEN v + bytes ELSE v END), goes FROM (
  SELECT n.k, loads, bytes, CAST(CASE WHEN loads[home + 1] + bytes <= room THEN home ELSE list_position(loads, list_min(loads)) - 1 END AS INTEGER) AS goes FROM fold f JOIN numbered n ON n.k = f.k + 1, room)),
placed AS (SELECT vslot, sub, shard FROM fold JOIN numbered USING (k)),
parted AS (SELECT e.*, shard, id_key % parts AS part FROM e JOIN sizes USING (vslot, sub) JOIN placed p ON p.vslot = e.vslot AND coalesce(p.sub, {WHOLE}) = e.sub),
starts AS (SELECT vslot, sub, part, coalesce(sum(count(*)) OVER (PARTITION BY shard ORDER BY vslot, sub, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM parted GROUP BY vslot, sub, part, shard)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(start + row_number() OVER (PARTITION BY vslot, sub, part ORDER BY doc_id, text_crc32, size) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, vslot AS virtual_slot
FROM parted JOIN starts USING (vslot, sub, part)"""
