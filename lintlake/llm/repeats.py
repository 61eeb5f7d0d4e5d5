"""Removal of repeated byte strings, by suffix arrays of the places where texts can repeat.

Every window of ``length`` bytes chooses the least hash of the short strings in it (the leftmost of equals), a
choice that depends on the window alone: equal windows choose equal strings at equal places. Windows in a row
with one choice make a segment. Only segments whose chosen string occurs elsewhere can repeat anything:

1. the chosen strings' hashes are counted, and those that occur twice kept as sorted arrays in the shared folder;
2. of segments with such a string, equal ones are brought together; all but the first are repeats throughout;
3. different segments with one string are dealt to shards by it. A shard's text gets a suffix array by induced
   sorting and permuted common prefixes; suffixes in a row that share ``length`` bytes are occurrences of one
   string, and all but the first of them repeats. A string with very many different segments is taken apart
   into its single windows, which are grouped by their own hash instead;
4. repeats are gathered by document and the covered bytes cut out.

Hashes have 64 bits (two of them where rows are merged by hash).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.hashfiles import HashFiles, bits_for, build, pack, unpack
from lintlake.llm.suffix import permuted_lcp, suffix_array
from lintlake.llm.textnp import _INVERSE, mix, powers, tidied, utf8, window_hashes
from lintlake.plans.lineage import bounded_batches, remove, written

LENGTH = 100
#: Bytes of the strings among which a window chooses.
SEED = 24
#: Different segments of one string up to which they go through a suffix array; bytes of a suffix array's text.
SPLIT = 400
SHARD_BYTES = 1 << 20
#: Bytes looked at at once (positions have 20 bits).
BLOCK = (1 << 20) - 4096


def segments(buf: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Of one text: first and last window start, and two hashes: of the chosen string, of the whole segment."""
    lows, highs, hs, fs = [], [], [], []
    for lo in range(0, max(0, len(buf) - length + 1), BLOCK - length + 1):
        part = buf[lo : lo + BLOCK]
        a, b, h, f = _segments(part, np.array([0, len(part)]), length, seed)
        lows.append(a + lo)
        highs.append(b + lo)
        hs.append(h)
        fs.append(f)
    if not lows:
        zero = np.zeros(0, np.int64)
        return zero, zero, zero.astype(np.uint64), zero.astype(np.uint64)
    return tuple(np.concatenate(x) for x in (lows, highs, hs, fs))


def _segments(buf: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """The same for several texts in one buffer of at most BLOCK bytes."""
    n = len(buf)
    zero = np.zeros(0, np.int64)
    if n < length:
        return zero, zero, zero.astype(np.uint64), zero.astype(np.uint64)
    value = buf.astype(np.uint64)
    value += np.uint64(1)
    value *= powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    inverse = powers(n + 1, _INVERSE)
    h = total[seed:] - total[:-seed]
    h *= inverse[: len(h)]
    # the order of the polynomial's leading bits will do; only chosen strings are mixed
    least = h & np.uint64(0xFFFFFFFFFFF00000)
    least |= np.arange(len(h), dtype=np.uint64)
    width, have = length - seed + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    chosen = (least & np.uint64(0xFFFFF)).astype(np.int64)
    start = np.arange(len(chosen))
    fits = np.zeros(n + 1, np.int64)  # windows that lie inside one text
    long = np.diff(offsets) >= length
    np.add.at(fits, offsets[:-1][long], 1)
    np.add.at(fits, offsets[1:][long] - length + 1, -1)
    inside = np.cumsum(fits)[: len(chosen)] > 0
    start, chosen = start[inside], chosen[inside]
    if not len(start):
        return zero, zero, zero.astype(np.uint64), zero.astype(np.uint64)
    new = np.ones(len(start), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    low = start[at]
    high = start[np.append(at[1:], len(start)) - 1]
    c = chosen[at]
    stop = high + length
    whole = (total[stop] - total[low]) * inverse[low]
    f = mix(whole + mix((stop - low).astype(np.uint64) * np.uint64(1 << 20) + (c - low).astype(np.uint64)))
    return low, high, mix(h[c]), f


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, tuple]]:
    """doc ids, bytes, offsets and segments (with their row and starts in the row) of blocks of rows."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        buf, offsets = utf8(batch.column(1))
        i = 0
        while i < len(ids):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
            j = min(j, len(ids))
            part, off = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if len(part) > BLOCK:
                low, high, h, f = segments(part)
            else:
                low, high, h, f = _segments(part, off, LENGTH, SEED)
            row = np.searchsorted(off, low, "right") - 1
            yield ids[i:j], part, off, (row, low, high, h, f)
            i = j


def repeated_strings(docs: DataFrame, bits: int) -> HashFiles:
    """Hashes of the chosen strings that occur at least twice, as sorted arrays."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            yield from pack(keys, bits, (times > 1).astype(np.uint8))

        for _, _, _, (_, _, _, h, _) in _each(batches):
            held.append(h)
            size += len(h)
            if size > 4_000_000:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def make(table: pa.Table) -> tuple[np.ndarray, dict]:
        keys, often = unpack(table, "<u8", "u1")
        found, at, times = np.unique(keys, return_inverse=True, return_counts=True)
        twice = (times > 1) | (np.bincount(at, often, len(found)) > 0)
        return found[twice], {}

    return build(docs.mapInArrow(run, "p int, b0 binary, b1 binary"), bits, make, "repeated")


def occurrences(docs: DataFrame, repeated: HashFiles) -> DataFrame:
    """``h, f, doc_id, low, high``: the segments of every text whose chosen string occurs elsewhere."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, off, (row, low, high, h, f) in _each(batches):
            there = repeated.find(h)[0]
            row, low, high, h, f = (x[there] for x in (row, low, high, h, f))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(f.view(np.int64)), pa.array(ids[row]), pa.array(low - off[row]), pa.array(high - off[row])],
                ["h", "f", "doc_id", "low", "high"],
            )

    return docs.mapInArrow(run, "h long, f long, doc_id long, low long, high long")


def _place(doc: np.ndarray, low: np.ndarray) -> np.ndarray:
    return mix(mix(doc.view(np.uint64)) + low.view(np.uint64))


def open_segments(docs: DataFrame, wanted: HashFiles) -> DataFrame:
    """The text of the wanted segments: ``kind 0: h, doc_id, low, text``; a split one gives its single windows,
    ``kind 1: h, f`` two hashes of the window, ``doc_id, low``."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, buf, off, (row, low, high, h, _) in _each(batches):
            there, split = wanted.find(_place(ids[row], low - off[row]), "split")
            raw = buf.tobytes()
            at = np.flatnonzero(there & (split == 0))
            texts = [raw[low[k] : high[k] + LENGTH] for k in at]
            doc, begin, key, other, kind = ids[row[at]], (low - off[row])[at], h[at], np.zeros(len(at), np.uint64), np.zeros(len(at), np.int32)
            at = np.flatnonzero(there & (split == 1))
            if len(at):
                n = high[at] - low[at] + 1
                which = np.repeat(at, n)
                start = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                one, two = _window_hashes(buf, start)
                doc = np.concatenate([doc, ids[row[which]]])
                begin = np.concatenate([begin, start - off[row[which]]])
                key, other = np.concatenate([key, one]), np.concatenate([other, two])
                kind = np.concatenate([kind, np.ones(len(which), np.int32)])
                texts += [None] * len(which)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind), pa.array(key.view(np.int64)), pa.array(other.view(np.int64)), pa.array(doc), pa.array(begin), pa.array(texts, pa.binary())],
                ["kind", "h", "f", "doc_id", "low", "text"],
            )

    return docs.mapInArrow(run, "kind int, h long, f long, doc_id long, low long, text binary")


def _window_hashes(buf: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the windows at the given starts, from one pass with two bases."""
    out = []
    for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        value = (buf.astype(np.uint64) + np.uint64(1)) * powers(len(buf), base)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        inverse = powers(len(buf) + 1, pow(base, -1, 1 << 64))
        out.append(mix((total[start + LENGTH] - total[start]) * inverse[start]))
    return out[0], out[1]


def shard_repeats(text: list[bytes], doc: np.ndarray, low: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window start in it) of every window that also occurs at an earlier place in the shard.

    Segments none of whose windows has a hash that occurs twice in the shard can share nothing and are left out
    of the suffix array, which decides about all others.
    """
    raw = np.frombuffer(b"".join(text), np.uint8)
    size = np.array([len(x) for x in text])
    if len(raw) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.concatenate([[0], np.cumsum(size)])
    h = window_hashes(raw, length)
    owner = np.repeat(np.arange(len(text)), size)[: len(h)]
    inside = np.arange(len(h)) + length <= edge[owner + 1]
    h, owner = h[inside], owner[inside]
    order = np.argsort(h)
    twice = np.zeros(len(h), bool)
    equal = h[order[1:]] == h[order[:-1]]
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    kept = np.unique(owner[twice])
    if not len(kept):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text, doc, low, size = [text[k] for k in kept], doc[kept], low[kept], size[kept]
    bounds = np.concatenate([[0], np.cumsum(size + 1)])
    letters = np.frombuffer(b"\0".join(text) + b"\0", np.uint8).astype(np.int64) + len(text) + 1
    letters[bounds[1:] - 1] = np.arange(1, len(text) + 1)  # every segment ends in a letter of its own
    sa = suffix_array(letters)
    _, plcp = permuted_lcp(letters, sa)
    # suffixes in a row that share `length` letters; the own letters at the ends keep them inside segments
    same = plcp[sa] >= length
    same[0] = False
    group = np.cumsum(~same)
    shared = same.copy()
    shared[:-1] |= same[1:]
    at, group = sa[shared], group[shared]
    which = np.searchsorted(bounds, at, "right") - 1
    place = low[which] + at - bounds[which]
    order = np.lexsort((place, doc[which], group))
    later = np.zeros(len(order), bool)
    later[1:] = group[order][1:] == group[order][:-1]
    # one place can stand in two segments of different shards only, so places of a group differ
    found = order[later]
    return kept[which[found]], (at - bounds[which])[found]


def _runs(doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered byte ranges of windows, those of a document that touch merged."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    if not len(doc):
        return doc, start, start
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length)
    at = np.flatnonzero(new)
    return doc[at], start[at], start[np.append(at[1:], len(doc)) - 1] + length


def sorted_repeats(rows: DataFrame) -> DataFrame:
    """``doc_id, start, stop``: ranges of ``h, doc_id, low, text`` that repeat an earlier place."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(table: pa.Table) -> pa.RecordBatch:
            doc, low = table.column("doc_id").to_numpy(), table.column("low").to_numpy()
            which, at = shard_repeats(table.column("text").to_pylist(), doc, low)
            ranges = _runs(doc[which], low[which] + at, LENGTH)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in ranges], ["doc_id", "start", "stop"])

        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                held.append(part)
                size += part.nbytes
                if size < SHARD_BYTES:
                    continue
                table = pa.Table.from_batches(held).combine_chunks()
                key = table.column("h").to_numpy()
                other = np.flatnonzero(key != key[-1])
                whole = int(other[-1]) + 1 if len(other) else 0  # the last string may go on
                if whole:
                    yield flush(table.slice(0, whole))
                    held = table.slice(whole).combine_chunks().to_batches()
                    size = sum(b.nbytes for b in held)
        if held:
            yield flush(pa.Table.from_batches(held).combine_chunks())

    dealt = rows.select("h", "doc_id", "low", "text").repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, "doc_id long, start long, stop long")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """``doc_id, start, stop``: byte ranges (they may overlap) covered by a string that starts earlier too.

    ``docs(doc_id, text)`` with distinct ids, none null.
    """
    spark = docs.sparkSession
    bits = bits_for(docs)
    repeated = repeated_strings(docs, bits)
    seen = written(occurrences(docs, repeated), "seen")
    remove(spark, repeated.uri)
    first = seen.groupBy("h", "f").agg(F.min(F.struct("doc_id", "low")).alias("first"), F.count("*").alias("times"))
    first = written(first.select("h", "f", "first.*", "times"), "first")
    later = (
        seen.join(
            first.where("times > 1").select("h", "f", F.col("doc_id").alias("d0"), F.col("low").alias("l0")), ["h", "f"]
        )
        .where("doc_id <> d0 or low <> l0")
        .select("doc_id", F.col("low").alias("start"), (F.col("high") + LENGTH).alias("stop"))
    )
    kinds = first.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    several = first.join(kinds, "h").select("doc_id", "low", (F.col("kinds") > SPLIT).cast("int").alias("split"))

    @tidied
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, low, split = (batch.column(k).to_numpy() for k in range(3))
            yield from pack(_place(doc, low), bits, split.astype(np.uint8))

    def make(table: pa.Table) -> tuple[np.ndarray, dict]:
        keys, split = unpack(table, "<u8", "u1")
        found, at = np.unique(keys, return_index=True)
        return found, {"split": split[at]}

    wanted = build(several.mapInArrow(places, "p int, b0 binary, b1 binary"), bits, make, "wanted", {"split": "u1"})
    opened = written(open_segments(docs, wanted), "opened")
    remove(spark, wanted.uri)
    inner = sorted_repeats(opened.where("kind = 0"))
    single = opened.where("kind = 1").select("h", "f", "doc_id", "low")
    heads = single.groupBy("h", "f").agg(F.min(F.struct("doc_id", "low")).alias("first"), F.count("*").alias("times")).where("times > 1")
    return later.unionByName(inner).unionByName(window_repeats(single, heads.select("h", "f", "first.*"), bits))


def window_repeats(single: DataFrame, heads: DataFrame, bits: int) -> DataFrame:
    """``doc_id, start, stop``: ranges of the windows (two hashes, place) that are not at the first place of their like."""
    both = lambda h, f: mix(mix(h.view(np.uint64)) + f.view(np.uint64))

    @tidied
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, f, doc, low = (batch.column(k).to_numpy() for k in range(4))
            yield from pack(both(h, f), bits, _place(doc, low))

    def make(table: pa.Table) -> tuple[np.ndarray, dict]:
        keys, place = unpack(table, "<u8", "<u8")
        found, at = np.unique(keys, return_index=True)
        return found, {"place": place[at]}

    first = build(heads.mapInArrow(packed, "p int, b0 binary, b1 binary"), bits, make, "heads", {"place": "<u8"})

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, f, doc, low = (batch.column(k).to_numpy() for k in range(4))
            there, place = first.find(both(h, f), "place")
            again = there & (place != _place(doc, low))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _runs(doc[again], low[again], LENGTH)], ["doc_id", "start", "stop"])

    return single.mapInArrow(run, "doc_id long, start long, stop long")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text binary (what is left), n_bytes, spans array<struct<start, stop>>`` for every distinct id.

    spans are the maximal removed byte runs. A null text is empty. Of rows that repeat an id one is used; a row
    with a null id keeps its text and is no source of repeats.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounded_batches(docs.sparkSession)
    known = base.where("doc_id is not null")
    if not known.groupBy("doc_id").count().where("count > 1").isEmpty():
        known = known.dropDuplicates(["doc_id"])
    ranges = repeated_ranges(known).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("ranges"))
    joined = known.join(ranges, "doc_id", "left").unionByName(base.where("doc_id is null").withColumn("ranges", F.lit(None).cast(ranges.schema["ranges"].dataType)))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                left, sizes, spans = [], [], []
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    raw = text.encode()
                    merged: list[list[int]] = []
                    for r in found or []:
                        if merged and r["start"] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], r["stop"])
                        else:
                            merged.append([r["start"], r["stop"]])
                    at, keep = 0, []
                    for a, b in merged:
                        keep.append(raw[at:a])
                        at = b
                    keep.append(raw[at:])
                    left.append(b"".join(keep))
                    sizes.append(len(raw))
                    spans.append([{"start": a, "stop": b} for a, b in merged])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(left, pa.binary()), pa.array(sizes, pa.int64()), pa.array(spans, kind)],
                    ["doc_id", "text", "n_bytes", "spans"],
                )

    return joined.select("doc_id", "text", "ranges").mapInArrow(
        run, "doc_id long, text binary, n_bytes long, spans array<struct<start:long,stop:long>>"
    )


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def brute_force(docs: dict[int, str | None], length: int = LENGTH) -> dict[int, tuple]:
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256), window by window; for the tests."""
    seen: set[bytes] = set()
    out = {}
    for doc in sorted(docs):
        raw = (docs[doc] or "").encode()
        covered = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                covered[i : i + length] = True
            seen.add(w)
        edges = np.flatnonzero(covered[:-1] & ~np.append(False, covered[:-2])) if len(raw) else []
        left = bytes(np.frombuffer(raw, np.uint8)[~covered[:-1]])
        out[doc] = (len(raw), int(covered.sum()), len(edges), hashlib.sha256(left).hexdigest())
    return out
