"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

A conversation's turns become digests, and its prefixes chains of digests, made in blocks of turns so that one long
conversation is many rows of work. Equal prefixes meet in one aggregation; a node is named by its depth and its smallest
member. Subtree totals come from rounds of joins over the shrinking tree: leaves are raked into their parents, then
nodes with a single child are spliced out, no two of them neighbours. The rounds are undone in reverse order, which
gives every node that was spliced out the total of its child and what it held itself.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintlake.plans.lineage import bounded_batches, written

#: Conversations of one hundred share the first turns of the first of them, up to five.
FAMILY, SHARED = 100, 6
#: Turns of a block, by bits; conversation ids of one part of a node's list of ends, by bits.
BLOCK_BITS, END_BITS = 10, 16
#: Copies of one row that are counted in one array when they are taken apart again.
COPIES = 1 << 16
#: A parent with over one part in so many of all nodes as children is looked up in a broadcast table (as many rows at most).
WIDE = 1000
_NONE = hashlib.sha256(b"").hexdigest()


def _places(low: Column, high: Column) -> Column:
    """The whole numbers low .. high (none if high < low) as arrays of at most COPIES, to be exploded twice."""
    return F.when(
        high >= low,
        F.transform(F.sequence(low, high, F.lit(COPIES).cast("long")), lambda x: F.struct(x.alias("a"), F.least(x + COPIES - 1, high).alias("b"))),
    )


def _with_places(df: DataFrame, low: Column, high: Column) -> DataFrame:
    spans = df.withColumn("span", F.explode(_places(low, high)))
    return spans.withColumn("pos", F.explode(F.sequence("span.a", "span.b"))).drop("span")


def rebuilt_turns(conversations: DataFrame, family: int = FAMILY, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """Turns ``conv_id, depth, size, digest, chars`` of the rebuilt conversations, and ``conv_id, size`` of each.

    Conversation c begins with the first h turns of conversation c - c % family (all, if it has fewer), h = crc32(c) %
    shared; its own turns follow, but for its first h. Turns are ordered by ``turn``, null first; rows with equal
    ``turn`` by the SHA-256 of role and text. Null role or text is empty. Rows with a null conv_id belong to no
    conversation and are left out. Repeated rows are that many turns. Turns are numbered within blocks of turn numbers
    (null ones within blocks of digests) and equal rows are counted before they are dealt out.
    """
    base = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).where("conv_id is not null")
    sha = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    null_block = F.lit(-(1 << 62)) + F.conv(F.substring("sha", 1, 3), 16, 10).cast("long")
    rows = base.select("conv_id", "turn", sha.alias("sha"), F.length("text").cast("long").alias("chars")).select(
        "conv_id", F.when(F.col("turn").isNull(), null_block).otherwise(F.shiftright("turn", BLOCK_BITS)).alias("block"), "turn",
        F.unhex(F.substring("sha", 1, 32)).alias("digest"), "chars",
    )
    counted = written(rows.groupBy("conv_id", "block", "turn", "digest", "chars").agg(F.count("*").alias("m")), "trie-turns")

    in_conv = Window.partitionBy("conv_id")
    upto = in_conv.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = counted.groupBy("conv_id", "block").agg(F.sum("m").alias("n")).select(
        "conv_id", "block", (F.sum("n").over(upto) - F.col("n")).alias("before"), F.sum("n").over(in_conv).alias("turns")
    )
    each = blocks.groupBy("conv_id").agg(F.max("turns").alias("turns"))
    first = each.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("first_id"), F.col("turns").alias("first_turns"))
    convs = (
        each.withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % shared, "first_id": F.col("conv_id") - F.col("conv_id") % family})
        .join(first, "first_id", "left")
        .withColumn("head", F.least("h", F.coalesce("first_turns", F.lit(0).cast("long"))))
        .select("conv_id", "first_id", "h", "head", (F.col("head") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("size"))
    )
    convs = written(convs, "trie-conversations")

    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        counted.withColumn("stop", F.sum("m").over(inside))
        .join(blocks.drop("turns"), ["conv_id", "block"])
        .select("conv_id", "block", "digest", "chars", (F.col("before") + F.col("stop") - F.col("m") + 1).alias("low"), (F.col("before") + F.col("stop")).alias("high"))
    )
    # what a conversation's rows need to know of it travels by (conv_id, block), so that a long one is many keys
    known = blocks.select("conv_id", "block").join(convs, "conv_id").select("conv_id", "block", "h", "head", "size")
    own = placed.join(known, ["conv_id", "block"])
    own = _with_places(own, F.greatest(F.col("low"), F.col("h") + 1), F.col("high")).select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("depth"), "size", "digest", "chars"
    )
    heads = placed.where((F.col("conv_id") % family == 0) & (F.col("low") < shared))
    heads = _with_places(heads, F.col("low"), F.least("high", F.lit(shared - 1).cast("long"))).select(F.col("conv_id").alias("first_id"), "pos", "digest", "chars")
    heads = convs.join(heads, "first_id").where("pos <= head").select("conv_id", F.col("pos").alias("depth"), "size", "digest", "chars")
    return own.unionByName(heads), convs.select("conv_id", "size")


def _chained(left: bytes, right: bytes) -> bytes:
    return hashlib.blake2b(left + right, digest_size=16).digest()


ROOT = bytes(16)
_CHAIN = "conv_id long, depth long, size long, chars long, k1 long, k2 long, p1 long, p2 long"


def _names(keys: list[bytes]) -> list[pa.Array]:
    halves = [struct.unpack("<qq", k) for k in keys]
    return [pa.array([x[i] for x in halves], pa.int64()) for i in (0, 1)]


def _chain_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within each (conversation, block), in order: what a prefix is called from the block's start, and its parent."""
    at, key = None, ROOT
    for batch in batches:
        keys, before = [], []
        conv, depth, _, digest, _ = (c.to_pylist() for c in batch.columns)
        for c, d, x in zip(conv, depth, digest):
            if at != (c, (d - 1) >> BLOCK_BITS):
                at, key = (c, (d - 1) >> BLOCK_BITS), ROOT
            before.append(key)
            key = _chained(key, x)
            keys.append(key)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in (0, 1, 2, 4)), *_names(keys), *_names(before)],
            ["conv_id", "depth", "size", "chars", "k1", "k2", "p1", "p2"],
        )


def _chain_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the last prefix of each full block, in order: the name of all up to the block that follows."""
    at, key = None, ROOT
    for batch in batches:
        conv, block, k1, k2 = (c.to_pylist() for c in batch.columns)
        names = []
        for c, a, b in zip(conv, k1, k2):
            one = struct.pack("<qq", a, b)
            key = _chained(key, one) if at == c else one
            at = c
            names.append(key)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b + 1 for b in block], pa.int64()), *_names(names)], ["conv_id", "block", "s1", "s2"])


def _continued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes of later blocks, named after all that goes before their block."""
    for batch in batches:
        rows = batch.to_pylist()
        keys, before = [], []
        for r in rows:
            start = struct.pack("<qq", r["s1"], r["s2"])
            parent = struct.pack("<qq", r["p1"], r["p2"])
            keys.append(_chained(start, struct.pack("<qq", r["k1"], r["k2"])))
            before.append(start if parent == ROOT else _chained(start, parent))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), *_names(keys), *_names(before)], ["conv_id", "depth", "size", "chars", "k1", "k2", "p1", "p2"])


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, size, chars, k1, k2, p1, p2``: 128-bit names of each prefix of at least one turn and of its parent."""
    bounded_batches(turns.sparkSession)
    block = F.shiftright(F.col("depth") - 1, BLOCK_BITS)
    rows = turns.select("conv_id", "depth", "size", "digest", "chars")
    rows = rows.repartition("conv_id", block).sortWithinPartitions("conv_id", "depth").mapInArrow(_chain_blocks, _CHAIN)
    rows = written(rows, "trie-chains").withColumn("block", block)
    full = rows.where(F.col("depth") % (1 << BLOCK_BITS) == 0).select("conv_id", "block", "k1", "k2")
    starts = full.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_chain_starts, "conv_id long, block long, s1 long, s2 long")
    later = rows.where("block > 0").join(starts, ["conv_id", "block"])
    later = later.select("conv_id", "depth", "size", "chars", "k1", "k2", "p1", "p2", "s1", "s2").mapInArrow(_continued, _CHAIN)
    return rows.where("block = 0").drop("block").unionByName(later)


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each node's parts, which come in order; only the hash's state is held."""
    at, state, out = None, None, []

    def told(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(3)], ["k1", "k2", "ends_sha256"])

    for batch in batches:
        for a, b, part in zip(*(c.to_pylist() for c in batch.columns)):
            if at != (a, b):
                if at is not None:
                    out.append((*at, state.hexdigest()))
                at, state = (a, b), hashlib.sha256(part.encode())
            else:
                state.update(b"," + part.encode())
        yield told(out)
        out = []
    if at is not None:
        yield told([(*at, state.hexdigest())])


def hashed_ends(ends: DataFrame) -> DataFrame:
    """``k1, k2, ends_sha256`` of rows ``k1, k2, conv_id``: the hash of each node's ids, ascending, joined by commas.

    Parts of up to 2^16 neighbouring ids are joined to text where they meet. Then one task goes through the parts of a
    node, as the hash is sequential by its nature; it holds one part at a time.
    """
    parts = ends.groupBy("k1", "k2", F.shiftright("conv_id", END_BITS).alias("part")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    )
    dealt = parts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "part").select("k1", "k2", "ids")
    return dealt.mapInArrow(_hash_ends, "k1 long, k2 long, ends_sha256 string")


def prefix_tree(members: DataFrame) -> DataFrame:
    """Nodes from rows ``conv_id, depth, chars, k1, k2, p1, p2`` of each conversation and prefix, the root's included.

    Gives ``conv_id, depth, parent_conv_id, n_convs, n_children, chars, k1, k2``. A parent with very many children is
    looked up in a broadcast table of at most ``WIDE`` rows, the others by a join.
    """
    nodes = members.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"),
    )
    nodes = written(nodes, "trie-nodes")
    kids = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(kids, ["k1", "k2"], "left").fillna(0, ["n_children"]), "trie-counted")
    parents = nodes.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    many = F.lit(nodes.count() // WIDE)
    wide = nodes.where("depth > 0").join(F.broadcast(parents.where(F.col("n_children") > many).drop("n_children")), ["p1", "p2"], "left")
    found = wide.where("parent_conv_id is not null")
    rest = wide.where("parent_conv_id is null").drop("parent_conv_id").join(parents.where(F.col("n_children") <= many).drop("n_children"), ["p1", "p2"])
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "chars", "k1", "k2"]
    root = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return written(reduce(DataFrame.unionByName, (x.select(columns) for x in (found, rest, root))), "trie-tree")


def _coin(conv: str, depth: str, k: int) -> Column:
    """Heads or tails of a node in round k: in a chain of all depths every second node that is left shows heads."""
    d, bits = F.col(depth), min(k, 40)
    odd = d.bitwiseAND((1 << bits) - 1)
    return (odd == 1 << bits - 1) | ((odd != 0) & (F.xxhash64(conv, depth, F.lit(k)) % 2 == 0))


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """``conv_id, depth`` and, of each of ``values``, the sum over the node and all below it.

    ``tree`` has ``conv_id, depth, parent_conv_id`` (null for roots; a parent is one less deep), ``n_children`` and the
    values as whole numbers. A round rakes all leaves, then splices out nodes with one child whose coin shows heads while
    their child's shows tails. The rounds are about the logarithm of the number of nodes; each is written down, and
    only the number of nodes that are left comes to the driver.
    """
    held, link = [f"held_{v}" for v in values], [f"link_{v}" for v in values]
    zero = F.lit(0).cast("long")
    left = tree.select(
        "conv_id", "depth", F.col("parent_conv_id").alias("up_conv"), F.when(F.col("parent_conv_id").isNotNull(), F.col("depth") - 1).alias("up_depth"),
        F.col("n_children").alias("kids"), *(F.col(v).cast("long").alias(h) for v, h in zip(values, held)), *(zero.alias(x) for x in link),
    )
    rounds: list[DataFrame] = []
    while left.limit(1).count():
        k = len(rounds) + 1
        leaf = F.col("kids") == 0
        # rake: leaves into their parents; the one child that may be left is the least of those with children
        below = left.where("up_conv is not null").groupBy(F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth")).agg(
            F.count_if(leaf).alias("raked"), F.min(F.when(~leaf, F.col("conv_id"))).alias("kid_conv"), F.min(F.when(~leaf, F.col("depth"))).alias("kid_depth"),
            *(F.sum(F.when(leaf, F.col(h) + F.col(x)).otherwise(zero)).alias(f"add_{v}") for v, h, x in zip(values, held, link)),
        )
        inner = left.where(~leaf).join(below, ["conv_id", "depth"]).withColumns(
            {"kids": F.col("kids") - F.col("raked")} | {h: F.col(h) + F.col(f"add_{v}") for v, h in zip(values, held)}
        )
        # compress: a spliced node's child takes its parent, and the link to it carries what the spliced node held
        spliced = (F.col("kids") == 1) & F.col("up_conv").isNotNull() & _coin("conv_id", "depth", k) & ~_coin("kid_conv", "kid_depth", k)
        spliced = F.coalesce(spliced, F.lit(False))
        gone = inner.where(spliced).select(
            F.col("kid_conv").alias("conv_id"), F.col("kid_depth").alias("depth"), F.col("conv_id").alias("gone_conv"), F.col("depth").alias("gone_depth"),
            F.col("up_conv").alias("new_conv"), F.col("up_depth").alias("new_depth"),
            *(F.col(h).alias(f"own_{v}") for v, h in zip(values, held)), *(F.col(x).alias(f"on_{v}") for v, x in zip(values, link)),
        )
        taken = F.col("gone_conv").isNotNull()
        stay = inner.where(~spliced).join(gone, ["conv_id", "depth"], "left").select(
            F.lit(True).alias("stays"), "conv_id", "depth", F.when(taken, F.col("new_conv")).otherwise(F.col("up_conv")).alias("up_conv"),
            F.when(taken, F.col("new_depth")).otherwise(F.col("up_depth")).alias("up_depth"), "kids", *held,
            *(F.when(taken, F.col(x) + F.col(f"own_{v}") + F.col(f"on_{v}")).otherwise(F.col(x)).alias(x) for v, x in zip(values, link)),
            "gone_conv", "gone_depth", *((F.col(x) + F.col(f"own_{v}")).alias(f"more_{v}") for v, x in zip(values, link)),
        )
        done = left.where(leaf).select(F.lit(False).alias("stays"), "conv_id", "depth", *held)
        rounds.append(written(stay.unionByName(done, allowMissingColumns=True), f"trie-round{k}"))
        left = rounds[-1].where("stays").select(left.columns)
    columns = ["conv_id", "depth", *values]
    known = tree.select("conv_id", "depth", *(zero.alias(v) for v in values)).where("false")
    for k in range(len(rounds), 0, -1):
        one = rounds[k - 1]
        again = one.where("gone_conv is not null").join(known, ["conv_id", "depth"]).select(
            F.col("gone_conv").alias("conv_id"), F.col("gone_depth").alias("depth"), *((F.col(v) + F.col(f"more_{v}")).alias(v) for v in values)
        )
        done = one.where("not stays").select("conv_id", "depth", *(F.col(h).alias(v) for v, h in zip(values, held)))
        known = known.unionByName(written(again.unionByName(done).select(columns), f"trie-known{k}"))
    return known


def conversation_trie(conversations: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """One row a node of the prefix trie of the rebuilt conversations (see ``rebuilt_turns`` for nulls, ties and repeats).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256`` as the contract has them. Prefixes are told apart by 128-bit chained digests. An
    empty table has no conversation, so not even a root; a conversation without a turn left is a member and an end of
    the root. Texts of any length are hashed whole; other columns are not looked at.
    """
    turns, convs = rebuilt_turns(conversations, family, shared)
    r1, r2 = struct.unpack("<qq", ROOT)
    none = F.lit(None).cast("long")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), "size", F.lit(0).cast("long").alias("chars"),
                        F.lit(r1).cast("long").alias("k1"), F.lit(r2).cast("long").alias("k2"), none.alias("p1"), none.alias("p2"))
    members = written(prefixes(turns).unionByName(root), "trie-members")
    tree = prefix_tree(members)
    ends = hashed_ends(members.where("depth = size").select("k1", "k2", "conv_id"))
    valued = tree.select("conv_id", "depth", "parent_conv_id", "n_children", F.when(F.col("n_children") == 0, 1).otherwise(0).alias("n_leaves"),
                         ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    totals = subtree_totals(valued, ["n_leaves", "saved_tokens"])
    return (
        tree.join(totals, ["conv_id", "depth"])
        .join(ends, ["k1", "k2"], "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"))
    )


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, one row a node."""
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


ORACLE_OP12 = """
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS t
), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS sha, turn
  FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha) AS pos FROM turns
), sizes AS (
  SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id
), convs AS (
  SELECT s.conv_id, s.n, s.conv_id - s.conv_id % 100 AS first_id,
         xor(list_reduce(list_transform(range(length(s.conv_id::varchar)), lambda i: ascii(substring(s.conv_id::varchar, (i + 1)::bigint, 1))::bigint),
             lambda c, b: xor(c // 256, t[1 + xor(c, b) % 256]), 4294967295::bigint), 4294967295::bigint) % 6 AS h
  FROM sizes s, crc
), heads AS (
  SELECT c.*, least(h, coalesce(f.n, 0)) AS head FROM convs c LEFT JOIN sizes f ON f.conv_id = c.first_id
), rebuilt AS (
  SELECT h.conv_id, p.pos AS depth, p.sha, p.text FROM heads h JOIN placed p ON p.conv_id = h.first_id AND p.pos <= h.head
  UNION ALL
  SELECT h.conv_id, p.pos - h.h + h.head, p.sha, p.text FROM heads h JOIN placed p ON p.conv_id = h.conv_id AND p.pos > h.h
), members AS (
  SELECT conv_id, depth, string_agg(sha, '') OVER (PARTITION BY conv_id ORDER BY depth) AS name, length(text) AS chars FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, '', 0 FROM convs
), nodes AS (
  SELECT name, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM members GROUP BY name, depth
), tree AS (
  SELECT n.*, p.conv_id AS parent_conv_id, p.name AS parent
  FROM nodes n LEFT JOIN members m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1 LEFT JOIN nodes p ON p.name = m.name AND p.depth = m.depth
), kids AS (
  SELECT parent, count(*) AS n_children FROM tree WHERE parent IS NOT NULL GROUP BY parent
), valued AS (
  SELECT t.*, coalesce(k.n_children, 0) AS n_children FROM tree t LEFT JOIN kids k ON k.parent = t.name
), totals AS (
  SELECT m.name, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.chars) AS saved_tokens
  FROM valued v JOIN members m ON m.conv_id = v.conv_id AND m.depth <= v.depth GROUP BY m.name
), ends AS (
  SELECT m.name, sha256(string_agg(m.conv_id::varchar, ',' ORDER BY m.conv_id)) AS ends_sha256
  FROM members m JOIN (SELECT conv_id, max(depth) AS depth FROM members GROUP BY conv_id) l ON l.conv_id = m.conv_id AND l.depth = m.depth GROUP BY m.name
)
SELECT v.conv_id, v.depth::bigint AS depth, v.parent_conv_id, v.n_convs, v.n_children, t.n_leaves::bigint AS n_leaves, t.saved_tokens::bigint AS saved_tokens,
       coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM valued v JOIN totals t ON t.name = v.name LEFT JOIN ends e ON e.name = v.name
"""
