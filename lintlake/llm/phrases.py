"""Collocations of two to four words by best-first branch and bound over counted prefixes.

Words seen often enough get numbers; texts are written once as runs of numbers, and every later pass reads those. All
pairs of numbered words are counted. From then on only the frontier is expanded: no phrase that begins with P scores
more than 2 f(P) / (f(first word) + f(P)), and none that ends with P more than 2 f(P) / (f(P) + f(last word)), as a
phrase is not seen more often than its parts. A round takes a score for each language, counts the longer phrases whose
bounds reach it and all one-word extensions of those that do themselves, and so knows every phrase of that score or
more and whether a longer one replaces it. A language is settled once enough of them stand; the others go on with a
lower score, down to nought, where everything has been counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintlake.llm.hashfiles import HashFiles, bits_for, build, pack, unpack
from lintlake.llm.textnp import LOWER, mix, text_batches, tidied
from lintlake.plans.lineage import bounded_batches, written

#: Occurrences that a phrase needs, phrases reported of a language, part of a phrase's occurrences that replaces it.
MIN_COUNT, TOP, COVERED = 30, 2000, (80, 100)
#: Rank, among a language's pairs by score, of the first round's score, and the factor by which it grows.
FIRST_RANK, RANK_STEP = 6000, 4
#: Bytes of text that get their words together; n-grams that are counted together before they leave a task, rows of a batch.
TEXT_BYTES, HELD, BATCH_ROWS = 4 << 20, 2_000_000, 100_000
#: Flags of a counted phrase: it may begin, or end, a phrase of the score looked for; it has that score itself.
BEGINS, ENDS, REACHES, COUNTED = 1, 2, 4, 8

_CLASS = np.zeros(256, np.uint8)
_CLASS[[32, 9]] = 1
_CLASS[[*b".,;:!?", 10, 11, 12, 13]] = 2


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Of the lower-cased words of some rows: codes, the different words, rows, and whether a piece begins with each."""
    kind = _CLASS[buf]
    solid = kind == 0
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    if not len(starts):
        return np.zeros(0, np.int64), [], np.zeros(0, np.int64), np.zeros(0, bool)
    rows = np.searchsorted(offsets, starts, "right") - 1
    breaks = np.cumsum(kind == 2, dtype=np.int32)[starts]
    first = np.ones(len(starts), bool)
    first[1:] = (np.diff(breaks) > 0) | (np.diff(rows) > 0)
    bounds = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=bounds[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(LOWER[buf[solid]])]).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist(), rows, first


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str], list[bytes], np.ndarray, np.ndarray]]:
    """Of slices of ``lang, text``: place of each token's (language, word) among the different ones, these, and piece begins."""
    for part, buf, offsets in text_batches(batches, "text", TEXT_BYTES):
        codes, words, rows, first = _words(buf, offsets)
        if not len(codes):
            continue
        languages = part.column(0).dictionary_encode()
        spoken = languages.indices.to_numpy().astype(np.int64)[rows]
        different, back = np.unique(spoken * len(words) + codes, return_inverse=True)
        names = languages.dictionary.to_pylist()
        which, word = np.divmod(different, len(words))
        yield back, [names[k] for k in which], [words[k] for k in word], np.bincount(back), first


def count_words(docs: DataFrame) -> DataFrame:
    """``lang, word, n`` over all rows of ``lang, text``; words are told apart by their bytes."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, names, words, times, _ in _by_language(batches):
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], ["lang", "word", "n"])

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _digests(names: list[str], words: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each (language, word), as two numbers."""
    said = {n: b"%d:%d:" % (seed, len(n.encode())) + n.encode() for n in set(names)}
    raw = b"".join(hashlib.blake2b(said[n] + w, digest_size=16).digest() for n, w in zip(names, words))
    both = np.frombuffer(raw, "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


class Numbering:
    """Numbers of the words that are seen often enough, from sorted arrays of 64-bit keys verified by 64 bits more."""

    def __init__(self, files: HashFiles, seed: int):
        self.files, self.seed = files, seed
        self.base = np.zeros(1 << files.bits, np.int64)
        before = 0
        for p in sorted(files.sizes):
            self.base[p] = before
            before += files.sizes[p]
        self.size = before

    def __call__(self, names: list[str], words: list[bytes]) -> np.ndarray:
        keys, checks = _digests(names, words, self.seed)
        there, check, place = self.files.find(keys, "check", "place")
        number = place.astype(np.int64) + self.base[(keys >> np.uint64(64 - self.files.bits)).astype(np.int64)]
        return np.where(there & (check == checks), number, -1)


def number_words(frequent: DataFrame, bits: int) -> Numbering:
    """Numbers for the different rows ``lang, word``; should two share a 64-bit key, another seed is taken."""
    wanted = frequent.count()
    for seed in range(64):

        @tidied
        def run(batches: Iterator[pa.RecordBatch], seed=seed) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    keys, checks = _digests(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), seed)
                    yield from pack(keys, bits, checks)

        def make(table: pa.Table) -> tuple[np.ndarray, dict]:
            keys, checks = unpack(table, "<u8", "<u8")
            found, at = np.unique(keys, return_index=True)
            return found, {"check": checks[at], "place": np.arange(len(found))}

        files = build(frequent.select("lang", "word").mapInArrow(run, "p int, b0 binary, b1 binary"), bits, make, "phrase-words", {"check": "<u8", "place": "<u4"})
        if files.count() == wanted:
            return Numbering(files, seed)
    raise RuntimeError("no seed keeps the words apart")


def vocabulary(frequent: DataFrame, numbering: Numbering) -> DataFrame:
    """``id, lang, word, f``."""
    held = frequent.sparkSession.sparkContext.broadcast(numbering)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = held.value(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *batch.columns], ["id", "lang", "word", "f"])

    return written(frequent.select("lang", "word", "n").mapInArrow(run, "id long, lang string, word string, f long"), "phrase-vocabulary")


def encode(docs: DataFrame, numbering: Numbering) -> DataFrame:
    """Rows ``ids``: numbers of consecutive words, -1 where a piece ends or a word has no number; runs of one are left out."""
    held = docs.sparkSession.sparkContext.broadcast(numbering)
    kind = _kind(numbering.size)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for back, names, words, _, first in _by_language(batches):
            ids = held.value(names, words)[back]
            out = np.full(len(ids) + int(first.sum()), -1, np.int64)
            out[np.arange(len(ids)) + np.cumsum(first)] = ids
            known = np.concatenate([[False], out >= 0, [False]])
            out = out[known[1:-1] & (known[:-2] | known[2:]) | ~known[1:-1] & known[:-2]]  # one mark is enough after a run
            yield pa.RecordBatch.from_arrays([pa.array([out.astype(kind).tobytes()], pa.binary())], ["ids"])

    return written(docs.mapInArrow(run, "ids binary"), "phrase-texts")


def _kind(size: int) -> str:
    return "<i4" if size < 1 << 31 else "<i8"


def tuple_hashes(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for x in columns:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x.astype(np.uint64))
    return h


def _distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of some columns of whole numbers, and how often each is there."""
    key, span = columns[0], int(columns[0].max()) + 1
    for x in columns[1:]:
        wide = int(x.max()) + 1
        if span * wide >= 1 << 62:  # number what is there so far anew
            key = np.unique(key, return_inverse=True)[1]
            span = int(key.max()) + 1
            if span * wide >= 1 << 62:
                values, x = np.unique(x, return_inverse=True)
                wide = len(values)
        key, span = key * wide + x, span * wide
    _, at, times = np.unique(key, return_index=True, return_counts=True)
    return [x[at] for x in columns], times


def count_ngrams(texts: DataFrame, kind: str, width: int, flags: HashFiles | None = None, min_count: int = MIN_COUNT) -> DataFrame:
    """``w1 .. w<width>, a`` of the n-grams seen at least ``min_count`` times that the flags of their parts let through.

    Of three words, both pairs must be counted pairs, and the first may begin or the second may end a phrase that
    reaches the score. Of four, that must hold of the first and of the second triple, or one of them reaches it itself.
    """
    held = texts.sparkSession.sparkContext.broadcast(flags)
    names = [f"w{k}" for k in range(1, width + 1)]

    def allowed(columns: list[np.ndarray]) -> np.ndarray:
        one, two = (held.value.find(tuple_hashes(c), "flags")[1] for c in (columns[:-1], columns[1:]))
        if width == 3:
            return (one & two & COUNTED > 0) & ((one & BEGINS > 0) | (two & ENDS > 0))
        return (one & BEGINS > 0) & (two & ENDS > 0) | ((one | two) & REACHES > 0)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            whole = [np.concatenate(c) for c in zip(*kept)]
            kept.clear()
            columns, times = _distinct(whole)
            for lo in range(0, len(times), BATCH_ROWS):
                part = [c[lo : lo + BATCH_ROWS].astype(np.int64) for c in [*columns, times]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in part], [*names, "n"])

        for batch in batches:
            for row in batch.column(0):
                ids = np.frombuffer(row.as_py(), kind).astype(np.int64)
                for lo in range(0, len(ids), HELD // 2):
                    part = ids[lo : lo + HELD // 2 + width - 1]
                    if len(part) < width:
                        continue
                    columns = [part[k : len(part) - width + 1 + k] for k in range(width)]
                    whole = np.logical_and.reduce([c >= 0 for c in columns])
                    columns = [c[whole] for c in columns]
                    if width > 2 and len(columns[0]):
                        through = allowed(columns)
                        columns = [c[through] for c in columns]
                    if len(columns[0]):
                        kept.append(columns)
                    if sum(len(c[0]) for c in kept) > HELD:
                        yield from flush()
        if kept:
            yield from flush()

    rows = texts.mapInArrow(run, ", ".join(f"{x} long" for x in [*names, "n"]))
    return rows.groupBy(*names).agg(F.sum("n").alias("a")).where(F.col("a") >= min_count)


def flag_files(phrases: DataFrame, width: int, bits: int) -> HashFiles:
    """Flags of phrases ``w1 .. , flags`` as sorted arrays by hash. Equal hashes share their flags, which only adds counts."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_numpy() for k in range(width + 1)]
            if len(columns[0]):
                yield from pack(tuple_hashes(columns[:-1]), bits, columns[-1].astype("u1"))

    def make(table: pa.Table) -> tuple[np.ndarray, dict]:
        keys, flags = unpack(table, "<u8", "u1")
        found, at = np.unique(keys, return_inverse=True)
        all_flags = np.zeros(len(found), np.uint8)
        np.bitwise_or.at(all_flags, at, flags)
        return found, {"flags": all_flags}

    named = phrases.select(*(f"w{k}" for k in range(1, width + 1)), F.col("flags").cast("int"))
    return build(named.mapInArrow(run, "p int, b0 binary, b1 binary"), bits, make, "phrase-flags", {"flags": "u1"})


def _score(a: str | Column, l: str | Column, r: str | Column) -> Column:  # noqa: E741  the contract's names
    """floor(2000000 a / (l + r)) exactly: products are decimals of up to 38 digits."""
    a, l, r = (F.col(x) if isinstance(x, str) else x for x in (a, l, r))  # noqa: E741
    wide = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * wide(a), wide(l) + wide(r))


def _lowest(cuts: list[tuple[Column, Column, Column]]) -> Column:
    """Struct ``score, k, l, r`` of the lowest-scoring cut, the first one in a tie."""
    return F.least(*(F.struct(s.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")) for k, (s, l, r) in enumerate(cuts, 1)))  # noqa: E741


def _flags(reach: Column | None = None) -> Column:
    flag = lambda c, v: F.when(c, v).otherwise(0)
    all_ = F.lit(COUNTED) + flag(F.col("begin") >= F.col("tau"), BEGINS) + flag(F.col("end") >= F.col("tau"), ENDS)
    return all_ if reach is None else all_ + flag(reach, REACHES)


def _replaced(phrases: DataFrame, longer: DataFrame, width: int) -> DataFrame:
    """``phrases`` without those of which a phrase of one word more holds the part COVERED of the occurrences."""
    names = [f"w{k}" for k in range(1, width + 1)]
    sides = [longer.select(*(F.col(f"w{k + s}").alias(f"w{k}") for k in range(1, width + 1)), F.col("a").alias("most")) for s in (0, 1)]
    most = sides[0].unionByName(sides[1]).groupBy(*names).agg(F.max("most").alias("most"))
    part, whole = COVERED
    return phrases.join(most, names, "left").where(F.col("most").isNull() | (F.col("most") * whole < F.col("a") * part)).drop("most")


def _with_pairs(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Triples with the counts of their parts: ``f1, f12, f23, f3`` and their language's ``lang, tau``."""
    first = pairs.select("w1", "w2", F.col("a").alias("f12"), "f1", "lang", "tau")
    second = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"), F.col("f2").alias("f3"))
    return triples.join(first, ["w1", "w2"]).join(second, ["w2", "w3"])


def settle(texts: DataFrame, kind: str, pairs: DataFrame, bits: int, min_count: int) -> DataFrame:
    """All phrases that reach their language's ``tau`` and are not replaced: ``lang, tau, w1 .. w4, a, l, r, score``.

    ``pairs`` has the counted pairs of the languages of this round: ``w1, w2, a, lang, f1, f2, score, begin, end, tau``.
    """
    reaches = F.col("score") >= F.col("tau")
    files = flag_files(pairs.withColumn("flags", _flags()), 2, bits)
    triples = _with_pairs(count_ngrams(texts, kind, 3, files, min_count), pairs)
    lowest = _lowest([(_score("a", "f1", "f23"), F.col("f1"), F.col("f23")), (_score("a", "f12", "f3"), F.col("f12"), F.col("f3"))])
    triples = triples.withColumn("cut", lowest).withColumns({x: F.col(f"cut.{x}") for x in ("score", "l", "r")}).drop("cut")
    triples = written(triples.withColumns({"begin": _score("a", "f1", "a"), "end": _score("a", "a", "f3")}), "phrase-triples")

    fours = written(count_ngrams(texts, kind, 4, flag_files(triples.withColumn("flags", _flags(reaches)), 3, bits), min_count), "phrase-fours")
    first = triples.select("w1", "w2", "w3", "lang", "tau", "f1", "f12", F.col("a").alias("f123"))
    second = triples.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("w3").alias("w4"), F.col("f23").alias("f34"), F.col("f3").alias("f4"), F.col("a").alias("f234"))
    whole = fours.join(first, ["w1", "w2", "w3"]).join(second, ["w2", "w3", "w4"])
    parts = [("f1", "f234"), ("f12", "f34"), ("f123", "f4")]
    whole = whole.withColumn("cut", _lowest([(_score("a", l, r), F.col(l), F.col(r)) for l, r in parts]))  # noqa: E741
    whole = whole.withColumns({x: F.col(f"cut.{x}") for x in ("score", "l", "r")})

    none = F.lit(None).cast("long")
    names = ["lang", "tau", "w1", "w2", "w3", "w4", "a", "l", "r", "score"]
    two = _replaced(pairs.where(reaches), triples, 2).withColumns({"w3": none, "w4": none, "l": F.col("f1"), "r": F.col("f2")})
    three = _replaced(triples.where(reaches), fours, 3).withColumn("w4", none)
    return written(two.select(names).unionByName(three.select(names)).unionByName(whole.where(reaches).select(names)), "phrase-settled")


def mine_phrases(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, first_rank: int = FIRST_RANK) -> DataFrame:
    """The best ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score`` as the contract has them.

    ``docs`` has ``lang`` (null: und) and ``text`` (null: empty); other columns are not looked at. Every row counts,
    repeated ones as often as they are there. Ties of score are settled by count, then by the phrase's bytes. A language
    without a phrase seen ``min_count`` times has no rows, nor has an empty table. Texts are read whole, by slices of
    ``TEXT_BYTES`` or one text. Hot languages and words are only keys of sums with partial sums in each task. Languages
    and scores stay in tables; the driver gets the numbers of words and of languages that are left.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    bits = bits_for(docs)
    words = written(count_words(docs), "phrase-counts")
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    numbering = number_words(words.where(F.col("n") >= min_count), bits)
    kind = _kind(numbering.size)
    known = vocabulary(words.where(F.col("n") >= min_count), numbering)
    texts = encode(docs, numbering)
    left, right = known.select(F.col("id").alias("w1"), "lang", F.col("f").alias("f1")), known.select(F.col("id").alias("w2"), F.col("f").alias("f2"))
    pairs = count_ngrams(texts, kind, 2, None, min_count).join(left, "w1").join(right, "w2")
    pairs = written(pairs.withColumns({"score": _score("a", "f1", "f2"), "begin": _score("a", "f1", "a"), "end": _score("a", "a", "f2")}), "phrase-pairs")

    done, waiting, rank = [], totals.select("lang"), first_rank
    while True:
        best = Window.partitionBy("lang").orderBy(F.col("score").desc())
        tau = pairs.select("lang", "score").withColumn("k", F.row_number().over(best)).where(F.col("k") <= rank).groupBy("lang").agg(
            F.when(F.count("*") < rank, 0).otherwise(F.min("score")).alias("tau")
        )
        tau = written(tau.join(waiting, "lang"), "phrase-tau")
        if not tau.count():
            break
        found = settle(texts, kind, pairs.join(tau, "lang"), bits, min_count)
        standing = found.groupBy("lang").agg(F.count("*").alias("standing"))
        settled = tau.join(standing, "lang", "left").where((F.col("tau") == 0) | (F.col("standing") >= top)).select("lang")
        done.append(found.join(settled, "lang"))
        waiting, rank = written(tau.select("lang").join(settled, "lang", "left_anti"), "phrase-waiting"), rank * RANK_STEP
    schema = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
    if not done:
        return docs.sparkSession.createDataFrame([], schema)
    found = done[0]
    for one in done[1:]:
        found = found.unionByName(one)
    # ranks without the phrase first, ties kept, so that only rows that can be among the best get their words
    by_count = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    found = found.withColumn("about", F.rank().over(by_count)).where(F.col("about") <= top)
    for k in range(1, 5):
        found = found.join(known.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"word{k}")), f"w{k}", "left")
    found = found.withColumn("phrase", F.concat_ws(" ", *(f"word{k}" for k in range(1, 5)))).join(totals, "lang")
    last = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    found = found.withColumn("rank", F.row_number().over(last).cast("long")).where(F.col("rank") <= top)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language of all documents."""
    return mine_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


ORACLE_OP11 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p
  FROM documents
), pieces AS (
  SELECT rid, lang, unnest(p) AS piece, generate_subscripts(p, 1) AS pid FROM docs
), lists AS (
  SELECT rid, lang, pid, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces
), words AS (
  SELECT rid, lang, pid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM lists
), grams AS (
  SELECT lang, w AS g1, w || ' ' || lead(w, 1) OVER o AS g2, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS g3,
         w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS g4
  FROM words WINDOW o AS (PARTITION BY rid, pid ORDER BY i)
), counts AS (
  SELECT lang, g1 AS phrase, 1 AS len, count(*) AS f FROM grams GROUP BY 1, 2
  UNION ALL SELECT lang, g2, 2, count(*) FROM grams WHERE g2 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 30
  UNION ALL SELECT lang, g3, 3, count(*) FROM grams WHERE g3 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 30
  UNION ALL SELECT lang, g4, 4, count(*) FROM grams WHERE g4 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 30
), totals AS (
  SELECT lang, sum(f) AS n FROM counts WHERE len = 1 GROUP BY lang
), candidates AS (
  SELECT lang, phrase, len, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE len > 1
), cuts AS (
  SELECT c.*, k.k, array_to_string(ws[1:k.k], ' ') AS left_part, array_to_string(ws[k.k + 1:], ' ') AS right_part
  FROM candidates c JOIN (SELECT unnest(range(1, 4)) AS k) k ON k.k < c.len
), scored AS (
  SELECT c.lang, c.phrase, c.len, c.a, c.k, l.f AS l, r.f AS r, (2000000::hugeint * c.a) // (l.f + r.f) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.left_part JOIN counts r ON r.lang = c.lang AND r.phrase = c.right_part
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT c.lang, array_to_string(ws[s.s:s.s + n.n - 1], ' ') AS phrase, max(c.a) AS longer
  FROM candidates c JOIN (SELECT unnest(range(1, 4)) AS s) s ON true JOIN (SELECT unnest(range(2, 4)) AS n) n ON n.n < c.len AND s.s + n.n - 1 <= c.len
  GROUP BY 1, 2
), ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank
  FROM lowest w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 80 * w.a
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n::bigint AS n, r.score::bigint AS score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
