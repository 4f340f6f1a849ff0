import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from ledgermill.llm import mixing, sharding


def test_shards_are_even_gapless_and_keep_copies_together(documents):
    rows = sharding.shard(documents).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    by = defaultdict(list)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        by[r["shard"]].append(r)
    assert sorted(by) == list(range(8))
    for some in by.values():
        assert sorted(r["slot"] for r in some) == list(range(len(some)))
    sizes = [sum(r["size"] for r in some) for some in by.values()]
    assert max(sizes) - min(sizes) < 0.05 * sum(sizes) / 8
    homes = defaultdict(set)
    for r in rows:
        homes[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in homes.values())


def test_hot_copies_are_split(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same " * 50)).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"), F.repeat(F.lit("z"), 240))).alias("text"))
    sizes = [r["b"] for r in sharding.shard(docs).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.1 * min(sizes)


def test_heavy_slots_keep_other_copies_together(spark):
    """Texts that share the heavy text's slot, and one more slot that is heavy by many texts, each in several copies."""
    slot = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % sharding.SLOTS
    hot = "same " * 50
    beside = [t for t in (f"text {i}" for i in range(40_000)) if slot(t) == slot(hot)]
    many = [t + " " * 400 for t in (f"other {i}" for i in range(60_000)) if slot(t + " " * 400) == 7]
    rows = [hot] * 3000 + beside * 5 + many * 40 + [f"filler {i} " * 20 for i in range(3000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in sharding.shard(docs, part_rows=100).collect()}
    homes = defaultdict(set)
    for i, t in enumerate(rows):
        homes[t].add(got[i]["shard"])
    assert len(beside) > 5 and len(many) > 5 and len(homes[hot]) == 8
    assert all(len(h) == 1 for t, h in homes.items() if t != hot)
    assert len({s for t in many for s in homes[t]}) > 1
    by = defaultdict(list)
    for r in got.values():
        by[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_map_is_versioned_and_rebalancing_moves_little(spark, documents):
    sizes = sharding.slot_bytes(sharding.records(documents))
    m = sharding.SlotMap(spark).create(8)
    first = {(r["vslot"], r["sub"]): r["shard"] for r in m.rebalance(sizes, 8, 0).collect()}
    second = {(r["vslot"], r["sub"]): r["shard"] for r in m.rebalance(sizes, 8, 1).collect()}
    assert {r["shard"] for r in m.read(0).collect()} == set(range(8))
    assert first.keys() == second.keys()
    assert sum(first[k] != second[k] for k in first) < 0.1 * len(first)


def test_a_kept_map_is_edited_from_its_latest_version(spark):
    documents = spark.range(20_000).select(F.col("id").alias("doc_id"), F.expr("concat('text ', id, repeat(' more', cast(id % 41 as int)))").alias("text"))
    m = sharding.SlotMap(spark).create(8)
    homes = []
    for part in (0.5, 0.75, 1.0):
        rows = sharding.place(documents.where(F.crc32(F.col("doc_id").cast("string")) < part * 2**32), slot_map=m).select("virtual_slot", "shard").distinct().collect()
        homes.append({r["virtual_slot"]: r["shard"] for r in rows})
        assert m.latest() == len(homes)
    rows = sharding.shard(documents, slot_map=m).select("doc_id", "shard").collect()
    assert len(rows) == documents.count() and m.latest() == 4
    for a, b in zip(homes, homes[1:]):
        both = a.keys() & b.keys()
        assert len(both) > 1000 and sum(a[k] != b[k] for k in both) < 0.1 * len(both)


def test_clashing_columns_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "mine", 5), (2, "d e", "y", "mine", 6)], "doc_id long, text string, source string, mix_shard string, Virtual_Slot int")
    mixed = mixing.in_order(mixing.mix(docs))
    assert sorted(mixed.columns) == sorted(["doc_id", "text", "source", "Virtual_Slot", "mix_pass", "mix_words", "mix_shard", "mix_order"])
    assert "mine" not in {r["mix_shard"] for r in mixed.collect()}
    placed = sharding.place(docs)
    assert placed.columns == ["doc_id", "text", "source", "mix_shard", "shard", "virtual_slot"] and placed.count() == 2


def test_place_keeps_columns(odd_docs, no_docs):
    out = sharding.place(odd_docs)
    assert out.columns == [c for c in odd_docs.columns if c != "shard"] + ["shard", "virtual_slot"]
    assert out.count() == odd_docs.count()
    assert sharding.place(no_docs).count() == 0


def test_odd_rows(odd_docs, no_docs):
    rows = sharding.shard(odd_docs).collect()
    assert len(rows) == 10
    assert all(r["size"] == 1 and r["text_crc32"] == 0 for r in rows if r["doc_id"] in (2, 3))
    assert sharding.shard(no_docs).count() == 0


def brute_targets(sizes, weights):
    targets, left, open_ = {}, 1.5 * sum(sizes), set(range(len(sizes)))
    while True:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w > 2 * sizes[i]}
        if not over:
            return [targets.get(i, left * weights[i] / w if i in open_ else 0) for i in range(len(sizes))]
        for i in over:
            targets[i] = 2.0 * sizes[i]
            left -= targets[i]
        open_ -= over


def test_mix_meets_targets(documents):
    rows = mixing.taken(documents).collect()
    text = {r["doc_id"]: (r["text"], r["source"]) for r in documents.collect()}
    words = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, (t, _) in text.items()}
    size = Counter()
    for d, (_, s) in text.items():
        size[s] += words[d]
    order = sorted(size)
    want = dict(zip(order, brute_targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True))
    got = Counter()
    for r in rows:
        s = text[r["doc_id"]][1]
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == size[s]
        assert abs(r["target"] - want[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        got[s] += r["taken"]
    assert all(abs(got[s] - want[s]) <= 1 for s in order)
    assert sorted(map(tuple, ((r["doc_id"], r["taken"]) for r in rows))) == sorted((r["doc_id"], r["taken"]) for r in mixing.taken(documents).collect())


def test_tree_splits_exactly():
    quotas = [100, 7, 0, 33]
    tree = mixing.split_tree(quotas, 16, 1)
    assert tree.sum(axis=1).tolist() == quotas
    assert np.ptp(tree.sum(axis=0)) <= 4
    assert mixing.split_tree([], 4, 1).shape == (0, 4)


def test_mix_copies_match_plan(documents):
    drawn = {r["doc_id"]: r["taken"] for r in mixing.taken(documents).collect()}
    cut = mixing.mix(documents, whole_documents=False).collect()
    got = Counter()
    for r in cut:
        assert len(r["text"].split()) == r["mix_words"] and 0 <= r["mix_shard"] < 16
        got[r["doc_id"]] += r["mix_words"]
    assert {d: n for d, n in drawn.items() if n} == dict(got)


def test_mix_odd_rows(odd_docs, no_docs):
    rows = mixing.taken(odd_docs).collect()
    assert len(rows) == 10 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    mixed = mixing.mix(odd_docs)
    assert set(odd_docs.columns) <= set(mixed.columns)
    assert all(r["size"] == 9 for r in mixed.collect())
    assert mixing.taken(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def test_draws_follow_the_hypergeometric_law():
    from math import comb

    for good, bad, sample in ((7, 5, 6), (3, 40, 10), (40, 3, 41)):
        law = [comb(good, k) * comb(bad, sample - k) / comb(good + bad, sample) for k in range(min(good, sample) + 1)]
        for u in np.linspace(0, 0.999, 50):
            want = next(k for k in range(len(law)) if sum(law[: k + 1]) > u + 1e-12 or k == len(law) - 1)
            assert mixing.hypergeometric(good, bad, sample, u) == want


def test_shards_by_brute_force(spark, sf, documents, tmp_path):
    plan = {r["source"]: r for r in mixing.plan(mixing.measured(documents.select("doc_id", "text", "source")).drop("text"), block_words=mixing.BLOCK_WORDS).collect()}
    docs = {r["doc_id"]: r for r in documents.collect()}
    tree = mixing.split_tree([plan[s]["quota"] for s in sorted(plan)], mixing.OUT_SHARDS, mixing.SEED)
    for k, s in enumerate(sorted(plan)):
        p = plan[s]
        # every block of the quota is drawn once, and each shard draws as many as its leaf says
        drawn = [sum(e <= b * p["step"] % p["quota"] for e in p["leaves"]) for b in range(p["quota"])]
        assert Counter(drawn) == Counter({i: int(n) for i, n in enumerate(tree[k]) if n})
    rows = mixing.taken(documents).collect()
    assert len(rows) == len(docs)
    copies = Counter()
    for r in rows:
        doc = docs[r["doc_id"]]
        p = plan[doc["source"]]
        key = f"{mixing.SEED}:{r['doc_id']}:{hashlib.md5(doc['text'].encode()).hexdigest()}"
        block = int(hashlib.md5(key.encode()).hexdigest()[:10], 16) % p["blocks"]
        full = [sum(e <= (c * p["blocks"] + block) * p["step"] % p["quota"] for e in p["leaves"]) for c in range(p["passes"] + 1)]
        parts = [tuple(map(int, x.split(":"))) for x in r["shards"].split(",") if x]
        assert [s for s, _ in parts] == full[: len(parts)] and sum(n for _, n in parts) == r["taken"]
        copies.update((r["doc_id"], s, o) for (s, _), o in zip(parts, r["mix_orders"], strict=True))
    # the local shuffle: each shard's files hold its copies in their order
    mixing.write_mix(mixing.mix(documents, whole_documents=False), f"file://{tmp_path}/mix")
    got = Counter()
    for folder in (tmp_path / "mix").glob("mix_shard=*"):
        (file,) = folder.glob("*.parquet")
        there = [(r["doc_id"], int(folder.name.split("=")[1]), r["mix_order"]) for r in pq.ParquetFile(file).read(["doc_id", "mix_order"]).to_pylist()]
        assert [o for *_, o in there] == sorted(o for *_, o in there)
        got.update(there)
    assert got == copies


def taken_by_source(rows):
    got, want = Counter(), {}
    for r in rows:
        got[r["source_size"]] += r["taken"]
        want[r["source_size"]] = r["target"]
        assert r["taken"] == sum(int(x.split(":")[1]) for x in r["shards"].split(",") if x) and r["taken"] <= 2 * r["size"]
    return got, want


def test_ties_at_the_cut_meet_the_target(spark):
    def make(key, value):
        ties = [(key, value, "a", i % 3) for i in range(1000)] + [(None, value + " more", "a", 1) for _ in range(1000)]
        return [*ties, *((k, " ".join(["w"] * (k % 9)), "b", 2) for k in range(4000, 4200)), *((None, f"own text {k}", None, 0) for k in range(300))]

    for key in (7, None):
        docs = spark.createDataFrame(make(key, "ten words of the same text that all rows share"), "doc_id long, text string, source string, other int")
        got, want = taken_by_source(mixing.taken(docs).collect())
        assert all(abs(got[s] - want[s]) <= 1 for s in want)
        again, _ = taken_by_source(mixing.taken(docs).collect())
        assert again == got
        whole = Counter()
        for r in mixing.mix(docs).collect():
            whole[r["source"]] += len(r["text"].split())
        sizes = {"a": 21_000, "b": sum(k % 9 for k in range(4000, 4200)), None: 900}
        assert all(abs(whole[s] - want[n]) <= 12 for s, n in sizes.items())
        parts = Counter()
        for r in mixing.mix(docs, whole_documents=False).collect():
            parts[r["source"]] += len(r["text"].split())
        assert all(abs(parts[s] - want[n]) <= 1 for s, n in sizes.items())


def test_many_sources_are_joined_by_a_shuffle(documents, monkeypatch):
    rows = sorted(map(tuple, mixing.taken(documents).drop("mix_orders").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.taken(documents).drop("mix_orders").collect())) == rows
