"""The conversation trie against a plain trie, built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lintlake.llm import trie

TURNS = "conv_id long, turn long, role string, text string"


def plain(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0, sha), role, text))
    own = {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}
    children, members, ends = defaultdict(set), defaultdict(list), defaultdict(list)
    last = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        first = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        turns = own.get(first, [])[:h] + own[c][h:]
        key = b""
        members[key, 0].append(c)
        last[key, 0] = ""
        for d, (role, text) in enumerate(turns, 1):
            above, key = key, hashlib.sha256(key + repr((role, text)).encode()).digest()
            children[above, d - 1].add((key, d))
            members[key, d].append(c)
            last[key, d] = text
        ends[key, len(turns)].append(c)
    leaves, saved, parent = {}, {}, {}
    for node in sorted(members, key=lambda n: -n[1]):
        kids = children.get(node, ())
        leaves[node] = sum(leaves[k] for k in kids) if kids else 1
        saved[node] = (len(members[node]) - 1) * len(last[node]) + sum(saved[k] for k in kids)
        for k in kids:
            parent[k] = min(members[node])
    return sorted(
        (min(m), n[1], -1 if n not in parent else parent[n], len(m), len(children.get(n, ())), leaves[n], saved[n],
         hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
        for n, m in members.items()
    )


def got(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in trie.conversation_trie(df).collect())


def test_trie(spark):
    r = random.Random(3)
    rows = []
    for c in [0, 100, 200, 300, 400, -100, *r.sample(range(-150, 430), 90)]:
        for t in range(r.choice([1, 2, 3, 6, 9])):
            role, text = r.choice(["user", "assistant", None]), r.choice(["hi", "é", "yes", None, "", "a" * 50])
            rows.append((c, r.choice([t, t, t, 3, None]), role, text))
    rows += rows[:40] + [(None, 1, "user", "x"), (7, None, None, None), (7, None, None, None)]
    df = spark.createDataFrame(rows, TURNS).withColumns({"pos": F.lit(1), "depth": F.lit("x"), "block": F.lit(None)})
    assert got(df.repartition(3)) == plain(rows)


def test_trie_of_long_and_branching_conversations(spark):
    """Chains over several blocks, copies that end at many depths, and a comb that is raked and spliced in turn."""
    rows = [(100 * k, t, "u", f"{t}" if t < 2100 - k * 50 else f"{k} {t}") for k in range(3) for t in range(2200)]
    rows += [(1000 + 100 * k, t, "u", f"same {t}") for k in range(30) for t in range(k + 1)]
    rows += [(9000 + 100 * k, t, "u", f"comb {t}" if t < k else f"tooth {k}") for k in range(40) for t in range(k + 1)]
    rows += [(20_000 + 100 * k, None, "u", f"only {k}") for k in range(300)]
    assert got(spark.createDataFrame(rows, TURNS)) == plain(rows)


def test_trie_empty(spark):
    assert trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert got(spark.createDataFrame([(5, 0, "u", "x")], TURNS)) == plain([(5, 0, "u", "x")])


def test_equal_rows_are_taken_apart_in_parts(spark, monkeypatch):
    monkeypatch.setattr(trie, "COPIES", 3)
    df = spark.createDataFrame([(1, 10), (4, 3), (5, 5)], "low long, high long")
    assert sorted(x.pos for x in trie._with_places(df, F.col("low"), F.col("high")).collect()) == sorted([*range(1, 11), 5])


@pytest.mark.parametrize("count", [1, 70_000])
def test_ends_over_several_parts(spark, count):
    ids = [*range(-5, count)]
    df = spark.range(-5, count).select(F.lit(1).cast("long").alias("k1"), F.lit(2).cast("long").alias("k2"), F.col("id").alias("conv_id"))
    assert [r.ends_sha256 for r in trie.hashed_ends(df).collect()] == [hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]
