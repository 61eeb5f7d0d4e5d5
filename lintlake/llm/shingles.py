"""Near-duplicate texts: chosen-path candidates, exact Jaccard verification by tiles.

Texts are sets of hashed five-word shingles (words are runs of non-space bytes, A-Z folded). Each set is
embedded as a min-hash signature, whose coordinates are its sampled tokens. A chosen-path tree splits the sets
on coordinates picked by a hash of the path: two sets with similarity s stay together with probability s at
every split. Small buckets are compared at once, large ones are split again; the number of repeated runs
follows from the survival probability at the threshold and the target recall.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.textnp import label_pairs, mix, sequence_hashes, span_hashes, text_batches, tidied, token_spans
from lintlake.plans.graph import connected_components
from lintlake.plans.lineage import bounded_batches, cut, written

WIDTH = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.999
#: Coordinates of a signature; children a set has at each split, on average; splits at most; bucket brute-forced.
COORDINATES = 64
BRANCHES = 2.0
DEPTH = 3
BUCKET = 64
#: Texts and shingles on a side of a verification tile; shingle columns multiplied at once.
TILE = 2048
TILE_SHINGLES = 2_000_000
COLUMNS = 2048


def runs_needed(threshold: float, target: float, branches: float = BRANCHES, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold was together in some deepest bucket with the target probability.

    A pair's shared path is a branching process with Poisson(branches * threshold) children.
    """
    alive = 1.0
    for _ in range(depth):
        alive = 1.0 - math.exp(-branches * threshold * alive)
    return max(1, math.ceil(math.log(1.0 - target) / math.log(1.0 - alive)))


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row and the bounds of the rows."""
    starts, ends, first = token_spans(buf, offsets)
    h, bounds = sequence_hashes(span_hashes(buf, starts, ends), first, width)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(offsets)))


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Min-hash signatures (rows without shingles: zeros)."""
    n = len(bounds) - 1
    out = np.zeros((n, COORDINATES), np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return out
    at = bounds[full]
    for k in range(COORDINATES):
        a = mix(np.array([2 * k + 1], np.uint64))[0] | np.uint64(1)
        v = ((h ^ mix(np.array([1000 + k], np.uint64))[0]) * a) >> np.uint64(32)
        out[full, k] = np.minimum.reduceat(v, at)
    return out


def _children(keys: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows at path ``keys``: the row indexes and keys of their children."""
    bar = np.uint64(int(BRANCHES / COORDINATES * float(1 << 63)) * 2)
    coordinate = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64))
    row, k = np.nonzero(mix(keys[:, None] ^ coordinate[None, :]) < bar)
    return row, mix(mix(keys[row] + coordinate[k]) ^ sig[row, k].astype(np.uint64))


def _signature_array(column: pa.Array) -> np.ndarray:
    buf = b"".join(column.to_pylist())
    return np.frombuffer(buf, "<u4").reshape(-1, COORDINATES)


def sketch(docs: DataFrame) -> DataFrame:
    """``doc_id, n, f1, f2, sig`` per row: number of shingles, a 128-bit fingerprint of the set, the signature."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offsets in text_batches(batches, "text"):
            h, bounds = shingle_sets(buf, offsets)
            prints = []
            for salt in (17, 91):
                total = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(mix(h ^ mix(np.array([salt], np.uint64))[0]), out=total[1:])
                prints.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
            sig = signatures(h, bounds).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(bounds)), pa.array(prints[0]), pa.array(prints[1]),
                 pa.array([s.tobytes() for s in sig], pa.binary())],
                ["doc_id", "n", "f1", "f2", "sig"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long, sig binary")


def _first_level(reps: DataFrame, runs: int) -> DataFrame:
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mix(np.arange(7_000, 7_000 + runs, dtype=np.uint64))
        for batch in batches:
            ids, sig = batch.column(0).to_numpy(), _signature_array(batch.column(1))
            for root in roots:
                row, key = _children(np.full(len(ids), root), sig)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[row])], ["key", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "key long, rep long")


def _next_level(rows: DataFrame) -> DataFrame:
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            row, key = _children(keys, _signature_array(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(batch.column(1).to_numpy()[row])], ["key", "rep"]
            )

    return rows.select("key", "rep", "sig").mapInArrow(run, "key long, rep long")


def bucket_edges(key: np.ndarray, rep: np.ndarray, sig: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges (rep, least rep reached) inside each run of equal keys, by estimated similarity at least ``floor``."""
    left, right = [], []
    for d in range(1, BUCKET):
        i = np.flatnonzero(key[:-d] == key[d:]) if len(key) > d else np.zeros(0, np.int64)
        if not len(i):
            break
        like = np.concatenate(
            [(sig[i[k : k + 65536]] == sig[i[k : k + 65536] + d]).mean(axis=1) >= floor for k in range(0, len(i), 65536)]
        )
        left.append(i[like])
        right.append(i[like] + d)
    if not left:
        return rep[:0], rep[:0]
    root = label_pairs(len(key), np.concatenate(left), np.concatenate(right))
    at = np.flatnonzero(root != np.arange(len(key)))
    return rep[at], rep[root[at]]


def _compare_buckets(rows: DataFrame, floor: float) -> DataFrame:
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> pa.RecordBatch:
            key, rep = table.column("key").to_numpy(), table.column("rep").to_numpy()
            a, b = bucket_edges(key, rep, _signature_array(table.column("sig").combine_chunks()), floor)
            pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["src", "dst"])

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            if len(key) < 20_000:
                continue
            whole = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
            yield flush(table.slice(0, whole))
            held = table.slice(whole).combine_chunks().to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    dealt = rows.repartition("key").sortWithinPartitions("key", "rep").select("key", "rep", "sig")
    return dealt.mapInArrow(run, "src long, dst long")


def candidate_edges(reps: DataFrame, threshold: float, target: float) -> DataFrame:
    """Edges whose components hold, with the target probability, every pair at the threshold.

    ``reps(rep, sig)``. A bucket of up to BUCKET sets is compared pair by pair on signatures (kept if the
    estimate is no more than three deviations below the threshold); a larger one is split again; one still
    large at the last depth becomes a star, since exact verification follows.
    """
    floor = threshold - 3 * math.sqrt(threshold * (1 - threshold) / COORDINATES)
    level = _first_level(reps, runs_needed(threshold, target))
    edges = None
    for depth in range(1, DEPTH + 1):
        level = cut(level)
        sizes = level.groupBy(F.col("key").alias("at")).agg(F.count("*").alias("size"), F.min("rep").alias("low")).where("size > 1")
        sized = level.join(sizes, F.col("key") == F.col("at")).drop("at")
        small = _compare_buckets(sized.where(F.col("size") <= BUCKET).join(reps, "rep").select("key", "rep", "sig"), floor)
        edges = small if edges is None else edges.union(small)
        large = sized.where(F.col("size") > BUCKET)
        if depth == DEPTH:
            edges = edges.union(large.where("rep <> low").select(F.col("rep").alias("src"), F.col("low").alias("dst")))
        else:
            level = _next_level(large.join(reps, "rep").select("key", "rep", "sig"))
    return edges.distinct()


def shared_counts(h: np.ndarray, bounds: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``rows`` with the sets ``cols``."""
    _, column, times = np.unique(h, return_inverse=True, return_counts=True)
    shared = times > 1
    new = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    keep = shared[column]
    owner, column = owner[keep], new[column[keep]]
    out = np.zeros((len(rows), len(cols)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        m = np.zeros((len(bounds) - 1, int(column[b - 1]) - lo + 1), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        out += m[rows] @ m[cols].T
    return out


def verify(members: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Exact links within candidate components: ``rep, n, root`` per tile and text, ``n`` counting copies.

    ``members(rep, component, weight, n)``. A component of more than TILE texts, or TILE_SHINGLES shingles, is
    dealt over chunks and compared chunk by chunk, so no task holds more than two chunks whatever the component's
    size; pairs never leave a tile.
    """
    sizes = members.groupBy("component").agg(
        F.count("*").alias("size"), F.greatest(F.count("*") / TILE, F.sum("n") / TILE_SHINGLES).alias("fill")
    ).where("size > 1")
    placed = members.join(sizes, "component").withColumn("chunks", F.ceil("fill").cast("int"))
    placed = placed.withColumn("c", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(placed, "rep")

    @tidied
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offsets in text_batches(batches, "text"):
            h, bounds = shingle_sets(buf, offsets)
            packed = [h[bounds[i] : bounds[i + 1]].astype("<u8").tobytes() for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [part.column(i) for i in range(5)] + [pa.array(packed, pa.large_binary()).cast(pa.binary())],
                ["rep", "component", "weight", "chunks", "c", "set"],
            )

    rows = texts.select("rep", "component", "weight", "chunks", "c", "text").mapInArrow(
        sets, "rep long, component long, weight long, chunks int, c int, set binary"
    )
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "component", F.least("c", "other").alias("ta"), F.greatest("c", "other").alias("tb"), "c", "rep", "weight", "set"
    )

    def compare(table: pa.Table) -> pa.Table:
        ta, tb = table.column("ta")[0].as_py(), table.column("tb")[0].as_py()
        table = table.sort_by("rep")
        rep, weight, c = (table.column(x).to_numpy() for x in ("rep", "weight", "c"))
        packed = table.column("set").to_pylist()
        size = np.array([len(x) // 8 for x in packed], np.int64)
        bounds = np.concatenate([[0], np.cumsum(size)])
        h = np.frombuffer(b"".join(packed), "<u8")
        rows, cols = np.flatnonzero(c == ta), np.flatnonzero(c == tb)
        both = shared_counts(h, bounds, rows, cols).astype(np.float64)
        ok = both >= threshold * (size[rows][:, None] + size[cols][None, :] - both) - 1e-9
        ok &= both > 0
        if ta == tb:
            ok = np.triu(ok, 1)
        i, j = np.nonzero(ok)
        i, j = rows[i], cols[j]
        n = np.bincount(i, weight[j], len(rep)) + np.bincount(j, weight[i], len(rep))
        root = label_pairs(len(rep), i, j)
        at = np.flatnonzero(n > 0)
        return pa.table({"rep": rep[at], "n": n[at].astype(np.int64), "root": rep[root[at]]})

    return dealt.groupBy("component", "ta", "tb").applyInArrow(compare, "rep long, n long, root long")


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL) -> DataFrame:
    """``doc_id, class_id, n_links, kept`` for every distinct doc_id of ``docs(doc_id, text)``.

    Links join texts whose shingle sets have a Jaccard similarity of at least ``threshold``; equal sets are
    linked; texts without words link with nothing. class_id is the least doc_id of the linked component and kept
    marks that row. Texts of one to four words have one shingle, all their words. Of rows that repeat an id
    one is used; a row with a null id stays, links with nothing and is kept.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounded_batches(docs.sparkSession)
    known = base.where("doc_id is not null")
    drawn = written(sketch(known), "sketch")
    # one text for each set; the least id stands for its copies
    reps = drawn.where("n > 0").groupBy("n", "f1", "f2").agg(
        F.min("doc_id").alias("rep"), F.countDistinct("doc_id").alias("weight"), F.min_by("sig", "doc_id").alias("sig")
    )
    reps = written(reps, "reps")
    sigs = reps.select("rep", "sig")
    groups = connected_components(candidate_edges(sigs, threshold, target_recall)).withColumnRenamed("node", "rep")
    members = cut(groups.join(reps.select("rep", "weight", "n"), "rep").select("rep", "component", "weight", "n"))
    found = cut(verify(members, known.dropDuplicates(["doc_id"]), threshold))
    links = found.groupBy("rep").agg(F.sum("n").alias("n_far"))
    classes = connected_components(found.where("rep <> root"), "rep", "root").withColumnRenamed("node", "rep")
    per_rep = (
        reps.select("n", "f1", "f2", "rep", "weight").join(links, "rep", "left").join(classes, "rep", "left")
        .select("n", "f1", "f2", F.coalesce("component", "rep").alias("class_id"),
                (F.coalesce("n_far", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    )
    per_doc = drawn.select("doc_id", "n", "f1", "f2").dropDuplicates(["doc_id"]).join(per_rep, ["n", "f1", "f2"], "left")
    out = per_doc.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    nameless = base.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(nameless).withColumn("kept", F.col("class_id").eqNullSafe(F.col("doc_id")))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def brute_force_classes(docs: list[tuple[int, str | None]], threshold: float = THRESHOLD, width: int = WIDTH) -> dict[int, tuple[int, int]]:
    """doc_id -> (class_id, n_links) by comparing all pairs of word sets; for the tests."""
    sets = {}
    for doc, text in docs:
        raw = (text or "").encode()
        words = [w for w in raw.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()]
        sets[doc] = {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    ids = sorted(sets)
    parent, links = {d: d for d in ids}, dict.fromkeys(ids, 0)

    def root(d: int) -> int:
        while parent[d] != d:
            d = parent[d]
        return d

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and shared >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {d: (root(d), links[d]) for d in ids}
