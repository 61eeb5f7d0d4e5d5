"""Language identification by fusing text, declared language, address suffix and host.

The text's likelihood under each language comes from hashed byte trigrams counted over the labelled documents.
Soft counts of the text-only posteriors, summed by host, by domain and over all rows, give each row a prior: its
host's counts (without the row's own share) smoothed towards its domain's, those towards all rows'. Declared
language and address suffix enter as likelihoods estimated from the same soft counts. Evidence that a row lacks
adds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.textnp import LOWER, text_batches, tidied
from lintlake.plans.lineage import bounded_batches, written

BUCKET_BITS = 14
#: A text counts as so many independent trigrams at most.
EVIDENCE = 60.0
#: Weights, in rows, of the coarser level in the prior, and of the flat part of the likelihoods.
HOST_WEIGHT, DOMAIN_WEIGHT, FLAT = 4.0, 20.0, 1.0
#: Of crc32(doc_id as text) modulo FOLDS, the remainder whose labels are not learned from.
FOLDS, HELD_OUT = 5, 0
#: Not content; fixed pattern.
MARKUP = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|&#?\w{1,8};"


@dataclass
class TextModel:
    languages: list[str]
    log_p: np.ndarray  # (languages, buckets)


def _trigrams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte trigram that lies in one row, and the bounds of the rows."""
    n = np.maximum(np.diff(offsets) - 2, 0)
    bounds = np.concatenate([[0], np.cumsum(n)])
    if len(buf) < 3:
        return np.zeros(0, np.int64), bounds
    b = LOWER[buf].astype(np.uint32)
    h = b[:-2] * np.uint32(2654435761) + b[1:-1] * np.uint32(2246822519) + b[2:] * np.uint32(3266489917)
    h ^= h >> np.uint32(15)
    h *= np.uint32(668265263)
    inside = np.zeros(len(buf) + 1, np.int64)
    long = n > 0
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - 2, -1)
    ok = np.cumsum(inside)[: len(h)] > 0
    return (h >> np.uint32(32 - BUCKET_BITS))[ok].astype(np.int64), bounds


def train(docs: DataFrame) -> TextModel:
    """Count trigrams of all rows of ``docs(doc_id, text, lang)`` that have a language and are not held out."""
    bounded_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT, F.lit(True)))
    size = 1 << BUCKET_BITS

    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part, buf, offsets in text_batches(batches, "text"):
            index, bounds = _trigrams(buf, offsets)
            langs, code = np.unique(part.column(0).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            both = np.bincount(np.repeat(code, np.diff(bounds)) * size + index, minlength=size * len(langs))
            for k, lang in enumerate(langs):
                sums[lang] = sums.get(lang, 0) + both[k * size : (k + 1) * size]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())],
            ["lang", "counts"],
        )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<i8") for x in table.column("counts").to_pylist())
        return pa.table({"lang": table.column("lang").slice(0, 1), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    # one row of fixed size for each language
    found = rows.select("lang", "text").mapInArrow(count, "lang string, counts binary").groupBy("lang").applyInArrow(add, "lang string, counts binary").collect()
    found = sorted((r.lang, np.frombuffer(r.counts, "<i8")) for r in found)
    if not found:
        return TextModel(["und"], np.zeros((1, size)))
    counts = np.array([c for _, c in found]) + 0.5
    return TextModel([lang for lang, _ in found], np.log(counts / counts.sum(axis=1, keepdims=True)))


def text_evidence(rows: DataFrame, model: TextModel) -> DataFrame:
    """Replace ``text`` by ``ll``, the text's log likelihood in each language (all 0 for a text without trigrams)."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    others = [c for c in rows.columns if c != "text"]
    ordered = rows.select(*others, "text")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        k = len(model.languages)
        for part, buf, offsets in text_batches(batches, "text"):
            index, bounds = _trigrams(buf, offsets)
            n = np.diff(bounds)
            out = np.zeros((part.num_rows, k))
            full = np.flatnonzero(n)
            for j in range(k if len(full) else 0):
                out[full, j] = np.add.reduceat(model.log_p[j][index], bounds[full])
            out *= (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
            ll = pa.ListArray.from_arrays(pa.array(np.arange(0, k * part.num_rows + 1, k, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], ll], [*others, "ll"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields if f.name != "text")
    return ordered.mapInArrow(run, f"{fields}, ll array<double>")


def _softmax(values: Column) -> Column:
    top = F.array_max(values)
    grown = F.transform(values, lambda v: F.exp(v - top))
    return F.transform(grown, lambda v: v / F.aggregate(grown, F.lit(0.0), lambda a, x: a + x))


def _sums(rows: DataFrame, key: str, k: int, name: str) -> DataFrame:
    """Soft counts of each value of ``key``."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.array(*[F.sum(F.col("post")[j]) for j in range(k)]).alias(name)
    )


def fuse(rows: DataFrame, model: TextModel) -> DataFrame:
    """Add ``lang, p, text_lang`` to rows with ``ll, host, domain, suffix, declared`` (any of the four may be null)."""
    k = len(model.languages)
    held = written(rows.withColumn("post", _softmax(F.col("ll"))), "evidence")
    every = held.agg(F.array(*[F.coalesce(F.sum(F.col("post")[j]), F.lit(0.0)) for j in range(k)])).first()[0]
    total = sum(every) + k
    overall = [(c + 1.0) / total for c in every]
    own = lambda j: F.col("post")[j]

    def smoothed(counts: str, weight: float, base: list[Column]) -> list[Column]:
        """Counts without the row's own share, smoothed towards ``base``."""
        left = [F.greatest(F.coalesce(F.col(counts)[j] - own(j), F.lit(0.0)), F.lit(0.0)) for j in range(k)]
        n = reduce(lambda a, b: a + b, left)
        return [(c + b * weight) / (n + weight) for c, b in zip(left, base)]

    out = held
    for key, name in (("host", "n_host"), ("domain", "n_domain"), ("suffix", "n_suffix"), ("declared", "n_declared")):
        sums = _sums(held, key, k, name).withColumnRenamed(key, f"__{key}")
        out = out.join(sums, F.col(key) == F.col(f"__{key}"), "left").drop(f"__{key}")
    out = out.withColumn("by_domain", F.array(*smoothed("n_domain", DOMAIN_WEIGHT, [F.lit(x) for x in overall])))
    out = out.withColumn("prior", F.array(*smoothed("n_host", HOST_WEIGHT, [F.col("by_domain")[j] for j in range(k)])))

    def likelihood(counts: str, j: int) -> Column:
        """log P(value | language), up to what all languages share."""
        seen = F.greatest(F.col(counts)[j] - own(j), F.lit(0.0)) + FLAT
        return F.when(F.col(counts).isNotNull(), F.log(seen / (every[j] + FLAT))).otherwise(0.0)

    fused = F.array(
        *[F.col("ll")[j] + F.log(F.col("prior")[j]) + likelihood("n_declared", j) + likelihood("n_suffix", j) for j in range(k)]
    )
    names = F.array(*[F.lit(x) for x in model.languages])
    best = lambda c: F.element_at(names, F.array_position(F.col(c), F.array_max(F.col(c))).cast("int"))
    out = out.withColumn("fused", fused).withColumn("after", _softmax(F.col("fused")))
    return out.select(
        *[c for c in rows.columns if c != "ll"], best("fused").alias("lang"), F.array_max("after").alias("p"), best("ll").alias("text_lang")
    )


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as rows of evidence: text without markup, host, domain (last two labels), suffix, declared language."""
    html = F.coalesce(F.col("html"), F.lit(""))
    declared = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    host = host_of(F.col("url"))
    return pages.select(
        F.lit("page").alias("kind"),
        F.lit(None).cast("long").alias("doc_id"),
        F.col("page_id").cast("long").alias("page_id"),
        host.alias("host"),
        F.concat(F.lit("web:"), F.substring_index(host, ".", -2)).alias("domain"),
        F.when(host.contains("."), F.substring_index(host, ".", -1)).alias("suffix"),
        F.when(declared != "", declared).alias("declared"),
        F.regexp_replace(html, MARKUP, " ").alias("text"),
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as rows of evidence: their source stands for the host; no markup, no address."""
    return docs.select(
        F.lit("document").alias("kind"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.lit(None).cast("long").alias("page_id"),
        F.concat(F.lit("source:"), F.col("source")).alias("host"),
        F.when(F.col("source").isNotNull(), F.lit("source")).alias("domain"),
        F.lit(None).cast("string").alias("suffix"),
        F.lit(None).cast("string").alias("declared"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def op4_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page and every document with its language; trained on the documents' own labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    model = train(docs)
    rows = text_evidence(document_rows(docs).unionByName(page_rows(pages)), model)
    return fuse(rows, model).withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))
    )
