"""Near-duplicate embeddings by int8 tile products with rigorous error bounds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.textnp import label_pairs
from lintlake.plans.graph import connected_components
from lintlake.plans.lineage import cut

#: Vectors on a side of a tile.
TILE = 2048


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale, length of the quantised vector and of the error, for each unit vector.

    With x = s q + e the product of two vectors differs from the quantised one by
    (s q).e' + e.x', so by no more than |s q| |e'| + |e| |x'|; both lengths are computed, not estimated.
    """
    top = np.abs(unit).max(axis=1)
    scale = np.where(top > 0, top / 127.0, 1.0)
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    return codes, scale, np.linalg.norm(near, axis=1), np.linalg.norm(unit - near, axis=1)


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows. Float32 holds whole numbers up to 2**24, so 1,040 components at a time."""
    out = None
    for k in range(0, a.shape[1], 1024):
        part = a[:, k : k + 1024].astype(np.float32) @ b[:, k : k + 1024].astype(np.float32).T
        out = part if out is None else out.astype(np.float64) + part
    return out


#: Rounding of a double-precision product of unit vectors and of the bound itself; far above what can occur.
SLACK = 1e-6


def tile_links(
    x: np.ndarray, y: np.ndarray, threshold: float, same: bool
) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (i, j) of rows whose cosine is at least ``threshold``, in full precision; and how many were recomputed.

    ``same``: both sides are one tile, pairs i < j only.
    """
    qx, sx, nx, ex = quantise(x)
    qy, sy, ny, ey = (qx, sx, nx, ex) if same else quantise(y)
    upper = int8_products(qx, qy)
    upper *= sx[:, None].astype(np.float32)
    upper *= sy[None, :].astype(np.float32)
    # the bound |s q| |e'| + |e| |x'| with |x'| = 1
    upper += np.outer(nx, ey).astype(np.float32)
    upper += ex[:, None].astype(np.float32)
    possible = upper >= threshold - 1e-5 - SLACK
    if same:
        possible = np.triu(possible, 1)
    i, j = np.nonzero(possible)
    if not len(i):
        return i, j, 0
    rows, cols = np.unique(i), np.unique(j)
    if len(i) * 8 > len(rows) * len(cols):
        full = np.zeros(possible.shape, bool)
        full[np.ix_(rows, cols)] = (x[rows] @ y[cols].T) >= threshold
        ok = full[i, j]
    else:
        ok = np.concatenate(
            [np.einsum("ij,ij->i", x[i[k : k + 65536]], y[j[k : k + 65536]]) >= threshold for k in range(0, len(i), 65536)]
        )
    return i[ok], j[ok], len(i)


def embedding_links(vectors: DataFrame, threshold: float = 0.9, tile: int = TILE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links between different vectors of ``(vec_id, embedding)``.

    Returns ``members(vec_id, rep)``, where equal vectors share a representative (their least id; null for a
    vector that links with nothing), ``weights(rep, weight)``, and ``found(rep, n, root)``: for each tile and
    representative the number of linked vectors (copies counted) and the least representative that it reaches
    within the tile. No pair leaves a tile, so a group in which all are linked costs rows in proportion to its size.
    """
    ok = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    usable = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), ok.alias("ok"))
        .where("vec_id is not null and v is not null and ok and exists(v, c -> c <> 0)")
        .select("vec_id", "v")
    )
    # -0.0 equals 0.0
    usable = usable.withColumn("v", F.transform("v", lambda c: c + F.lit(0.0)))
    reps = cut(usable.groupBy("v").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("weight")))
    members = base.join(
        usable.join(reps.select("v", "rep"), "v").groupBy("vec_id").agg(F.min("rep").alias("rep")), "vec_id", "left"
    ).select("vec_id", "rep")
    count = reps.count()
    blocks = max(1, math.ceil(count / tile))
    part = F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")
    dealt = (
        reps.withColumn("b", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .select(F.least("b", "other").alias("ta"), F.greatest("b", "other").alias("tb"), "b", "rep", "weight", "v", F.size("v").alias("dim"))
    )

    def within(table: pa.Table) -> pa.Table:
        ta, tb = table.column("ta")[0].as_py(), table.column("tb")[0].as_py()
        dim = table.column("dim")[0].as_py()
        table = table.sort_by("rep")
        rep, weight, b = (table.column(c).to_numpy() for c in ("rep", "weight", "b"))
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        # scaled first, so that no square over- or underflows
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        first, second = np.flatnonzero(b == ta), np.flatnonzero(b == tb)
        i, j, _ = tile_links(x[first], x[second], threshold, ta == tb)
        i, j = first[i], second[j]
        n = np.bincount(i, weight[j], len(rep)) + np.bincount(j, weight[i], len(rep))
        root = label_pairs(len(rep), i, j)
        at = np.flatnonzero(n > 0)
        return pa.table({"rep": rep[at], "n": n[at].astype(np.int64), "root": rep[root[at]]})

    found = dealt.groupBy("ta", "tb", "dim").applyInArrow(within, "rep long, n long, root long")
    return members, reps.select("rep", "weight"), found


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every distinct vec_id (a null id once).

    Null, zero and non-finite vectors link with nothing, vectors of different lengths are never linked, equal
    vectors are linked with each other. Rows that repeat an id and a vector are one vector.
    """
    members, weights, found = embedding_links(vectors, threshold, tile)
    found = cut(found)
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    groups = connected_components(found.where("rep <> root"), "rep", "root").withColumnRenamed("node", "rep")
    per_rep = weights.join(links, "rep", "left").join(groups, "rep", "left").select(
        "rep",
        (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    # the representative is the least of its copies, so a component's least representative is its least vector
    return members.distinct().join(per_rep, "rep", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


ORACLE_OP3 = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, e, len(e) AS dim, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
      WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.dim = b.dim
          WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach(n, m) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.n, l.b FROM reach r JOIN links l ON r.m = l.a),
c AS (SELECT n, min(m) AS component_id FROM reach GROUP BY n),
k AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.n = v.vec_id LEFT JOIN k ON k.a = v.vec_id
"""
