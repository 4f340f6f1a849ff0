"""Operator 12 against a trie in plain Python, with conversations that fill many partitions."""

import binascii
import hashlib
import random

import pytest

from ledgermill.llm import scans, trie

SCHEMA = "conv_id long, turn long, role string, text string, a long, n int, lent string"


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()[:30]


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = binascii.crc32(str(c).encode()) % 6
        base = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])
        built[c] = tuple(base[:h] + ts[h:])
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(ts[:d], []).append(c)
    children, leaves, saved = {}, {}, {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)
    for path in sorted(nodes, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[p] for p in below) if below else 1
        saved[path] = sum(saved[p] for p in below) + (len(nodes[path]) - 1) * (len(path[-1][1]) if path else 0)
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children.get(path, [])), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(spark, rows):
    df = trie.build(spark.createDataFrame([(*r, 7, 7, "x") for r in rows], SCHEMA))
    got = df.collect()
    # preorder: a node's subtree is the interval from its number to its end
    by_number = {r["preorder"]: r for r in got}
    assert sorted(by_number) == list(range(len(got)))
    for r in got:
        inside = [by_number[i] for i in range(r["preorder"], r["subtree_end"] + 1)]
        assert all(x["depth"] > r["depth"] for x in inside[1:])
        assert r["n_leaves"] == sum(x["n_children"] == 0 for x in inside)
    return sorted((tuple(r)[:8] for r in got), key=str)


@pytest.fixture
def many_parts(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def odd_rows():
    rnd = random.Random(3)
    rows = []
    for c in [*range(-5, 30), *range(98, 130), 400, 401, 402, 555]:
        rows += [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(["hi", "yes", "nöö", "", "ok then"])) for t in range(rnd.randint(1, 5))]
    rows += [(5, None, None, None), (5, 1, "user", "hi"), (5, 1, "user", "hi"), (None, 0, "user", "lost"), (6, None, "a", "b"), (6, None, "ab", "")]
    rows += [(900, t, "user", f"turn {t % 7}") for t in range(400)]  # longer than several partitions
    rows += [(c, t, "user", f"turn {t % 7}") for c in (901, 902, 903) for t in range(300)]
    rows += [(700 + c, t, "system", "same") for c in range(60) for t in range(6)]
    return rows


def test_against_plain_python(spark, many_parts, monkeypatch):
    rows = odd_rows()
    want = brute(rows)
    assert built(spark, rows) == want
    monkeypatch.setattr(scans, "HOT_ROWS", 3)
    monkeypatch.setattr(trie, "CHUNK", 2)
    assert built(spark, rows[::-1]) == want


def test_few_rows(spark):
    assert built(spark, []) == []
    assert built(spark, [(None, 1, "a", "b")]) == []
    for rows in ([(1, 0, "user", "x")], [(0, 0, "u", "x"), (0, 1, "u", "y")], [(7, 3, None, None), (8, 3, None, None)], [(50, 0, "u", "only one turn"), (51, 0, "u", "z")]):
        assert built(spark, rows) == brute(rows)


def test_running_sums_go_on(spark, many_parts):
    df = spark.range(1000).selectExpr("id % 97 * 1000 + id as k", "id as v")
    ordered = scans.in_order(df, ["k"], ["k", "v"])
    got = sorted(map(tuple, scans.running(ordered, ["v"]).collect()))
    total = 0
    for _, v, before in got:
        assert before == total
        total += v
