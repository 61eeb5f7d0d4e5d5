"""Interpolated modified Kneser-Ney language model: counted by Spark, kept as sorted arrays, mapped by workers.

Words get their number from the sorted array of word hashes. A pair (context, word) is one 64-bit key of two
numbers; pairs are dealt out by the low bits of both numbers, so neither a frequent context nor a frequent word
fills one task. The model of order two has, for a pair seen c times after a context seen C times,

    p(w | u) = max(c - D(c), 0) / C + (D1 N1(u) + D2 N2(u) + D3 N3+(u)) / C * p1(w)

with p1 of the same form over continuation counts (in how many contexts w was seen), interpolated with the
uniform distribution over the V known words and the unknown one. Contexts do not cross texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.hashfiles import HashFiles, bits_for, build, pack, read_array, unpack, write_array
from lintlake.llm.textnp import mix, span_hashes, text_batches, tidied, token_spans
from lintlake.plans.lineage import bounded_batches, scratch_path, written

#: Of crc32(doc_id as text) modulo FOLDS, the remainder that is held out.
FOLDS, HELD_OUT = 7, 2
END, BEGIN = (int(x) for x in mix(np.array([101, 102], np.uint64)))


def _doc_tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of each row with END after its words, and the bounds of the rows."""
    starts, ends, first = token_spans(buf, offsets)
    words = span_hashes(buf, starts, ends)
    n = np.diff(first)
    bounds = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.empty(bounds[-1], np.uint64)
    last = np.zeros(bounds[-1], bool)
    last[bounds[1:] - 1] = True
    out[last] = END
    out[~last] = words
    return out, bounds


def held_out(ids: list) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in ids], bool)


def discounts(times: np.ndarray) -> np.ndarray:
    """D0 .. D3 from the numbers of entries seen once, twice, three and four times."""
    n1, n2, n3, n4 = (float(x) for x in times)
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(x, 0.0), k) for k, x in enumerate(d[1:], 1))])


@dataclass
class Model:
    words: HashFiles  # count of each word as a token, and its place in its shard
    base: dict[int, int]  # number of the first word of each shard of words
    pairs_uri: str
    pairs: dict[int, int]  # shard -> pairs
    pair_count: str  # kind of number that holds a pair's count
    half_bits: int
    stats_uri: str
    stats: frozenset[int]
    stat_shift: int
    tokens: int
    vocabulary: int
    texts: int
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    pair_kinds: int
    floor: float  # the weight of the uniform part of p1

    def number(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1: unknown) and count as a token of each word hash."""
        there, count, place = self.words.find(hashes, "count", "place")
        shard = (hashes >> np.uint64(64 - self.words.bits)).astype(np.int64)
        lookup = np.zeros(1 << self.words.bits, np.int64)
        for p, b in self.base.items():
            lookup[p] = b
        return np.where(there, place.astype(np.int64) + lookup[shard], -1), count.astype(np.int64)

    def about(self, numbers: np.ndarray) -> np.ndarray:
        """For each number (-1: zeros) how many words followed once, twice, more often; in how many contexts it was."""
        asked, back = np.unique(numbers, return_inverse=True)
        out = np.zeros((len(asked), 4), np.int64)
        shard = asked >> self.stat_shift
        for p in np.unique(shard[asked >= 0]):
            if int(p) in self.stats:
                a, b = np.searchsorted(shard, [p, p + 1])
                rows = read_array(f"{self.stats_uri}/stats-{p}", "<u4").reshape(-1, 4)
                out[a:b] = rows[asked[a:b] - (int(p) << self.stat_shift)]
        return out[back]

    def pair_counts(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        known = (context >= 0) & (word >= 0)
        keys, back = np.unique(_pair_key(context[known], word[known]), return_inverse=True)
        got = np.zeros(len(keys), np.int64)
        shard = _pair_shard(keys, self.half_bits)
        order = np.argsort(shard, kind="stable")
        full, first = np.unique(shard[order], return_index=True)
        for p, at in zip(full, np.split(order, first[1:])):
            if self.pairs.get(int(p)):
                have = read_array(f"{self.pairs_uri}/keys-{p}", "<u8")
                place = np.minimum(np.searchsorted(have, keys[at]), len(have) - 1)
                ok = have[place] == keys[at]
                got[at[ok]] = read_array(f"{self.pairs_uri}/count-{p}", self.pair_count)[place[ok]]
        out = np.zeros(len(context), np.int64)
        out[known] = got[back]
        return out

    def word_probability(self, contexts: np.ndarray) -> np.ndarray:
        """p1 of words seen in the given numbers of contexts."""
        uniform = 1.0 / (self.vocabulary + 1)
        if not self.pair_kinds:
            return np.full(len(contexts), uniform)
        d = self.word_discounts[np.minimum(contexts, 3)]
        return np.maximum(contexts - d, 0) / self.pair_kinds + self.floor * uniform

    def log10(self, context: np.ndarray, context_count: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 p(word | context) for numbers; ``context_count`` is how often the context was seen."""
        unique, back = np.unique(word, return_inverse=True)
        p = self.word_probability(self.about(unique)[:, 3])[back]
        followers = self.about(context)
        seen = context_count > 0
        total = np.maximum(context_count, 1)
        c = self.pair_counts(context, word)
        d = self.pair_discounts
        back_off = (d[1] * followers[:, 0] + d[2] * followers[:, 1] + d[3] * followers[:, 2]) / total
        p = np.where(seen, np.maximum(c - d[np.minimum(c, 3)], 0) / total + back_off * p, p)
        return np.log10(p)


def _pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (context.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64)


def _pair_shard(keys: np.ndarray, half: int) -> np.ndarray:
    low = np.uint64((1 << half) - 1)
    return (((keys >> np.uint64(32)) & low) << np.uint64(half) | (keys & low)).astype(np.int64)


def _pack_by(shard: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows ``(p, blobs)`` with the columns of each shard in the order given."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    full, first = np.unique(shard[order], return_index=True)
    bounds = np.append(first, len(order))
    cut = [[c[order[bounds[k] : bounds[k + 1]]].tobytes() for k in range(len(full))] for c in columns]
    yield pa.RecordBatch.from_arrays(
        [pa.array(full.astype(np.int32)), *(pa.array(x, pa.binary()) for x in cut)],
        ["p", *(f"b{k}" for k in range(len(columns)))],
    )


def count_words(docs: DataFrame, bits: int) -> HashFiles:
    """Counts of the training tokens as sorted hash arrays; ``total`` is the number of tokens."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            yield from pack(keys, bits, times.astype(np.uint64))

        for part, buf, offsets in text_batches(batches, "text"):
            train = ~held_out(part.column(0).to_pylist())
            tokens, bounds = _doc_tokens(buf, offsets)
            held.append(tokens[np.repeat(train, np.diff(bounds))])
            size += len(held[-1])
            if size > 4_000_000:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def make(table: pa.Table) -> tuple[np.ndarray, dict, int]:
        keys, times = unpack(table, "<u8", "<u8")
        found, at = np.unique(keys, return_inverse=True)
        total = np.zeros(len(found), np.uint64)
        np.add.at(total, at, times)
        return found, {"count": total, "place": np.arange(len(found))}, int(times.sum())

    return build(docs.mapInArrow(run, "p int, b0 binary, b1 binary"), bits, make, "words", {"count": "<u8", "place": "<u4"})


def train(docs: DataFrame) -> Model:
    """Learn from the rows of ``docs(doc_id, text)`` that are not held out."""
    spark = docs.sparkSession
    bounded_batches(spark)
    bits = bits_for(docs)
    half = max(1, bits // 2)
    words = count_words(docs, bits)
    base, vocabulary = {}, 0
    for p in sorted(words.sizes):
        base[p] = vocabulary
        vocabulary += words.sizes[p]
    if vocabulary >= (1 << 32) - 1:
        raise ValueError("more than 2**32 different words")
    tokens = words.total
    texts = int(words.find(np.array([END], np.uint64), "count")[1][0])
    wide = "<u4" if tokens < 1 << 32 else "<u8"
    # a shard of statistics is a range of numbers; the number after the last word is the context before a text
    stat_shift = max(8, int(vocabulary).bit_length() - bits)
    pairs_uri, stats_uri = scratch_path(spark, "pairs"), scratch_path(spark, "stats")
    blank = Model(words, base, pairs_uri, {}, wide, half, stats_uri, frozenset(), stat_shift, tokens, vocabulary, texts,
                  np.zeros(4), np.zeros(4), 0, 1.0)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            yield from _pack_by(_pair_shard(keys, half), keys, times.astype("<u4"))

        for part, buf, offsets in text_batches(batches, "text"):
            train = ~held_out(part.column(0).to_pylist())
            hashes, bounds = _doc_tokens(buf, offsets)
            keep = np.repeat(train, np.diff(bounds))
            context, word, _ = _numbered(blank, hashes, bounds)
            held.append(_pair_key(context[keep], word[keep]))
            size += len(held[-1])
            if size > 3_000_000:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def reduce(table: pa.Table) -> pa.Table:
        p = table.column("p")[0].as_py()
        keys, times = unpack(table, "<u8", "<u4")
        found, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, times, len(found)).astype(np.int64)
        write_array(f"{pairs_uri}/keys-{p}", found)
        write_array(f"{pairs_uri}/count-{p}", total.astype(wide))
        # what the pairs say about their contexts and their words, summed within the shard
        context, word = (found >> np.uint64(32)).astype(np.int64), (found & np.uint64(0xFFFFFFFF)).astype(np.int64)
        kind = np.minimum(total, 3)
        about, back = np.unique(context, return_inverse=True)
        follow = [np.bincount(back[kind == k], minlength=len(about)) for k in (1, 2, 3)]
        seen, contexts = np.unique(word, return_counts=True)
        who = np.concatenate([about, seen])
        columns = [np.concatenate([x, np.zeros(len(seen), np.int64)]) for x in follow]
        columns.append(np.concatenate([np.zeros(len(about), np.int64), contexts]))
        rows = [pa.Table.from_batches(_pack_by(who >> stat_shift, who.astype("<u4"), *(c.astype("<u4") for c in columns)))]
        head = np.array([p, len(found), *(int((total == k).sum()) for k in (1, 2, 3, 4))], "<i8").tobytes()
        rows.append(pa.table({"p": pa.array([-1], pa.int32()), **{f"b{k}": pa.array([b"" if k else head], pa.binary()) for k in range(5)}}))
        return pa.concat_tables(rows)

    blobs = "p int, " + ", ".join(f"b{k} binary" for k in range(5))
    about = written(docs.mapInArrow(run, "p int, b0 binary, b1 binary").groupBy("p").applyInArrow(reduce, blobs), "about")
    heads = np.array([np.frombuffer(r.b0, "<i8") for r in about.where("p = -1").select("b0").collect()]).reshape(-1, 6)

    def merge(table: pa.Table) -> pa.Table:
        p = table.column("p")[0].as_py()
        who, *columns = unpack(table, "<u4", "<u4", "<u4", "<u4", "<u4")
        low = p << stat_shift
        size = min(1 << stat_shift, vocabulary + 1 - low)
        full = np.stack([np.bincount(who.astype(np.int64) - low, c, size) for c in columns], 1).astype("<u4")
        write_array(f"{stats_uri}/stats-{p}", full.ravel())
        times = [int((full[:, 3] == k).sum()) for k in (1, 2, 3, 4)] + [int((full[:, 3] > 2).sum())]
        return pa.table({"p": pa.array([p], pa.int32()), "n": pa.array([times], pa.list_(pa.int64()))})

    rows = about.where("p >= 0").groupBy("p").applyInArrow(merge, "p int, n array<long>").collect()
    times = np.array([r.n for r in rows]).reshape(-1, 5).sum(axis=0)
    kinds = int(heads[:, 1].sum())
    by_word = discounts(times[:4])
    floor = float(by_word[1] * times[0] + by_word[2] * times[1] + by_word[3] * times[4]) / kinds if kinds else 1.0
    return Model(words, base, pairs_uri, {int(h[0]): int(h[1]) for h in heads}, wide, half, stats_uri,
                 frozenset(r.p for r in rows), stat_shift, tokens, vocabulary, texts, discounts(heads[:, 2:].sum(axis=0)), by_word, kinds, floor)


def _numbered(model: Model, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of each token's context and of the token (-1: unknown), and the token's count."""
    word, count = model.number(hashes)
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[bounds[:-1]] = model.vocabulary
    return context, word, count


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Each row's counts, base score (unigrams with one added) and model score, in log10.

    A null or empty text has one token, its end. Rows with a null id are not held out. Repeated ids are scored
    (and learned from) row by row.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for part, buf, offsets in text_batches(batches, "text"):
            hashes, bounds = _doc_tokens(buf, offsets)
            context, word, count = _numbered(model, hashes, bounds)
            before = np.zeros_like(count)
            before[1:] = count[:-1]
            before[bounds[:-1]] = model.texts
            p = model.log10(context, before, word)
            q = np.log10((count + 1) / (model.tokens + model.vocabulary + 1))
            add = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  each row has its end at least
            n = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(held_out(part.column(0).to_pylist())), pa.array(np.diff(bounds)),
                 pa.array(add((count > 0).astype(np.int64))), pa.array(np.full(n, model.tokens)), pa.array(add(q)), pa.array(add(p))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return docs.mapInArrow(run, schema)


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity of the model and of the base over the held-out and the training rows."""
    ten = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(ten("score").alias("perplexity"), ten("base_score").alias("base_perplexity"))


def op8_kneser_ney_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(docs, train(docs))
