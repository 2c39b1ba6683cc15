"""The prefix trie against a dictionary of prefixes in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lurescope.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = {(): set(rebuilt)}
    for c, turns in rebuilt.items():
        for d in range(1, len(turns) + 1):
            members.setdefault(turns[:d], set()).add(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    totals = {}
    for p in sorted(members, key=len, reverse=True):
        kids = children.get(p, [])
        saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        totals[p] = (sum(totals[k][0] for k in kids) if kids else 1, saved + sum(totals[k][1] for k in kids))
    out = []
    for p, own_members in members.items():
        ends = ",".join(map(str, sorted(c for c in own_members if rebuilt[c] == p)))
        out.append((
            min(own_members, default=None), len(p), min(members[p[:-1]]) if p else None, len(own_members),
            len(children.get(p, [])), *totals[p], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(450), n):
        if c % 100 == 0 and rng.random() < 0.3:
            continue
        for turn in range(rng.choice([1, 2, 5, 8, 12])):
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "bot", None]), rng.choice(["a", "b", "hello there", "", None])))
    rows += [(c, t, "user", "same") for c in range(500, 560) for t in range(7)]
    rows += [(900, t, "user", "long") for t in range(2500)] + [(901, t // 3, "user", "long") for t in range(2500)]
    rows += [(None, 1, "user", "x"), (700, 0, "user", "once"), (700, 0, "user", "once")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,n,few,queue", [(1, 300, None, 100), (2, 200, 2, 3), (3, 250, 20, 10)])
def test_equals_brute_force(spark, seed, n, few, queue):
    rows = conversations(seed, n)
    turns = spark.createDataFrame(rows, TURNS).repartition(5).withColumn("depth", F.lit("mine")).withColumn("a", F.lit(1))
    found = prefix_trie.trie(turns, few=few, queue=queue)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_packed_ids_of_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN_IDS", 7)
    ends = spark.range(1000).select(F.lit(3).cast("long").alias("a"), (F.col("id") % 2).alias("b"), F.col("id").alias("conv_id"))
    got = {r["b"]: r["ends_sha256"] for r in prefix_trie.end_digests(ends).collect()}
    assert got == {b: hashlib.sha256(",".join(map(str, range(b, 1000, 2))).encode()).hexdigest() for b in (0, 1)}


def test_empty_table_has_the_root_alone(spark):
    rows = prefix_trie.trie(spark.createDataFrame([], TURNS)).collect()
    assert [tuple(r)[:7] for r in rows] == [(None, 0, None, 0, 0, 1, 0)]


def test_queue_spills_in_order():
    rng, queue, sums = random.Random(4), prefix_trie.SpillingQueue(5), {}
    for _ in range(300):
        key = (rng.randrange(40),)
        queue.push(key, (1, key[0], 2))
        sums[key] = sums.get(key, 0) + 1
    assert queue.runs
    for k in range(41):
        n = sums.get((k,), 0)
        assert queue.taken((k,)) == (n, n * k, 2 * n)
    assert not queue.runs and not queue.heap
