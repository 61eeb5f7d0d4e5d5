"""Line deduplication: equal lines, and lines within a small edit distance by segment partition.

A line of n characters is cut into tau + 1 even segments. A line within distance tau has one of them, shifted by
a bounded amount, so each line probes the segments of lines of its own length and up to tau shorter, at the
places that can still match. Lines that meet in a segment are compared by banded bit-parallel edit distance.
Distances count code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintlake.llm.hashfiles import HashFiles, bits_for, distinct_files, pack, unpack
from lintlake.llm.textnp import _INVERSE, label_pairs, mix, powers, text_batches, tidied
from lintlake.plans.graph import connected_components
from lintlake.plans.lineage import bounded_batches, cut, remove, written

TAU = 2
#: Shorter lines are duplicates only of equal lines; empty ones are none at all.
MIN_EDIT_CHARS = 24
MIN_CHARS = 1
#: Lines compared at once in a segment's bucket; larger buckets are dealt out in chunks.
BUCKET = 512
#: lid = (doc_id << LINE_BITS) + line number.
LINE_BITS = 24


def line_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, row and number of the lines (cut at \\n) of each row; a row has at least one, maybe empty."""
    nl = np.flatnonzero(buf == 10)
    row_of_nl = np.searchsorted(offsets, nl, "right") - 1
    starts = np.concatenate([offsets[:-1], nl + 1])
    row = np.concatenate([np.arange(len(offsets) - 1), row_of_nl])
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    first = np.searchsorted(row, np.arange(len(offsets) - 1))
    number = np.arange(len(row)) - first[row]
    ends = np.empty(len(row), np.int64)
    ends[:-1] = starts[1:] - 1
    last = np.ones(len(row), bool)
    last[:-1] = row[1:] != row[:-1]
    ends[last] = offsets[1:][row[last]]
    return starts, ends, row, number


def code_points(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buffer as code points, and the spans in them."""
    lead = (buf & 0xC0) != 0x80
    at = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(lead, out=at[1:])
    points = np.frombuffer(buf.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
    return points, at[starts], at[ends]


class Hasher:
    """Hashes of any spans of a code point array; longer arrays than a batch are taken block by block by callers."""

    def __init__(self, points: np.ndarray):
        value = points.astype(np.uint64) + np.uint64(1)
        value *= powers(len(points))
        self.total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(value, out=self.total[1:])
        self.inverse = powers(len(points) + 1, _INVERSE)

    def __call__(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return (self.total[e] - self.total[s]) * self.inverse[s]


def line_table(docs: DataFrame) -> DataFrame:
    """``lid, h, chars`` of every line: its place, a 64-bit hash of its text, its length."""
    shift = LINE_BITS

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offsets in text_batches(batches, "text"):
            starts, ends, row, number = line_spans(buf, offsets)
            points, s, e = code_points(buf, starts, ends)
            h = mix(Hasher(points)(s, e) ^ (e - s).astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array((part.column(0).to_numpy()[row] << shift) + number), pa.array(h.view(np.int64)), pa.array((e - s).astype(np.int32))],
                ["lid", "h", "chars"],
            )

    return docs.mapInArrow(run, "lid long, h long, chars int")


def segment_keys(hasher: Hasher, s: np.ndarray, n: np.ndarray, h: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, line hashes and roles (1: a segment of the line, 0: a probe only) for lines s .. s + n."""
    keys, lines, roles = [], [], []
    k = tau + 1
    for delta in range(tau + 1):
        length = n - delta
        for i in range(k):
            begin, end = (i * length) // k, ((i + 1) * length) // k
            for shift in range(max(-i, delta - (tau - i)), min(i, delta + (tau - i)) + 1):
                a, b = begin + shift, end + shift
                ok = (a >= 0) & (b <= n)
                if delta == 0 and shift == 0:
                    role = 1
                else:
                    role = 0
                value = hasher(s[ok] + a[ok], s[ok] + b[ok])
                salt = mix(length[ok].astype(np.uint64) * np.uint64(64) + np.uint64(i + 1))
                keys.append(mix(value ^ salt))
                lines.append(h[ok])
                roles.append(np.full(len(value), role, np.uint8))
    return np.concatenate(keys), np.concatenate(lines), np.concatenate(roles)


def meeting_lines(docs: DataFrame, tau: int, bits: int) -> DataFrame:
    """``key, h, role`` for the segments in which two different lines meet, one of them with a segment of its own."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, lines, roles = (np.concatenate(x) for x in zip(*held))
            yield from pack(keys, bits, lines, roles)

        for _, buf, offsets in text_batches(batches, "text"):
            starts, ends, _, _ = line_spans(buf, offsets)
            points, s, e = code_points(buf, starts, ends)
            n = e - s
            fit = n >= MIN_EDIT_CHARS
            hasher = Hasher(points)
            h = mix(hasher(s, e) ^ n.astype(np.uint64))
            _, once = np.unique(h[fit], return_index=True)
            s, n, h = s[fit][once], n[fit][once], h[fit][once]
            if len(s):
                held.append(segment_keys(hasher, s, n, h, tau))
                size += len(held[-1][0])
            if size > 500_000:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        key, h, role = unpack(table, "<u8", "<u8", "u1")
        order = np.lexsort((1 - role.astype(np.int8), h, key))
        key, h, role = key[order], h[order], role[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])  # a line once for each key, in its stronger role
        key, h, role = key[new], h[new], role[new]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        counts = np.diff(np.append(starts, len(key)))
        own = np.add.reduceat(role, starts, dtype=np.int64)
        good = np.repeat((counts > 1) & (own > 0), counts)
        return pa.table({"key": key[good].view(np.int64), "h": h[good].view(np.int64), "role": role[good].astype(np.int32)})

    packed = docs.mapInArrow(run, "p int, b0 binary, b1 binary, b2 binary")
    return packed.groupBy("p").applyInArrow(meet, "key long, h long, role int")


def lines_in(docs: DataFrame, wanted: HashFiles) -> DataFrame:
    """``h, line`` for the lines whose hash is wanted, one row for each distinct line."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, buf, offsets in text_batches(batches, "text"):
            starts, ends, _, _ = line_spans(buf, offsets)
            points, s, e = code_points(buf, starts, ends)
            h = mix(Hasher(points)(s, e) ^ (e - s).astype(np.uint64))
            h, once = np.unique(h, return_index=True)
            there = wanted.find(h)[0]
            raw = buf.tobytes()
            at = once[there]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[there].view(np.int64)), pa.array([raw[a:b] for a, b in zip(starts[at], ends[at])], pa.binary())],
                ["h", "line"],
            )

    return docs.mapInArrow(run, "h long, line binary").groupBy("h").agg(F.first("line").alias("line"))


def within_distance(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, tau: int) -> np.ndarray:
    """Whether the edit distance of code point rows a[i][:la[i]] and b[i][:lb[i]] is at most tau.

    Banded and bit-parallel: column j of the dynamic program is kept as vertical differences of the 2 tau + 1
    cells around the diagonal in one word for each pair (rows before the first and after the last character
    match nothing), and the score follows the band's lowest diagonal.
    """
    width = 2 * tau + 1
    full = np.uint64((1 << width) - 1)
    one = np.uint64(1)
    top = np.uint64(1 << (width - 1))
    n = len(la)
    longest = int(lb.max()) if n else 0
    # row 0 is the band's upper edge: pad the pattern by tau on the left, and enough on the right
    pad = np.full((n, int(la.max() if n else 0) + longest + 2 * width), 0xFFFFFFFF, np.uint32)
    pad[:, tau : tau + a.shape[1]] = np.where(np.arange(a.shape[1])[None] < la[:, None], a, 0xFFFFFFFF)
    # vertical positive/negative differences inside the band, before the first column
    vp = np.full(n, (((1 << (tau + 1)) - 1) << tau) & int(full), np.uint64)
    vn = np.zeros(n, np.uint64)
    score = np.full(n, tau, np.int64)  # D[tau, 0]: the band's last cell of column 0
    for j in range(longest):
        live = j < lb
        eq = np.zeros(n, np.uint64)
        for d in range(width):
            eq |= (pad[:, j + d] == b[:, j]).astype(np.uint64) << np.uint64(d)
        # Hyyro's diagonal step: d0 says where the diagonal difference is zero
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        nvp = (hn | ~((d0 >> one) | hp)) & full
        nvn = ((d0 >> one) & hp) & full
        step = np.where(d0 & top, 0, 1)
        score = np.where(live, score + step, score)
        vp, vn = np.where(live, nvp, vp), np.where(live, nvn, vn)
    # walk up from the band's last cell (row lb + tau) to row la
    up = lb + tau - la
    out = score.copy()
    for k in range(width - 1):
        bit = np.uint64(1 << (width - 2 - k))  # the words already stand for the next column's band
        go = k < up
        out -= np.where(go & ((vp & bit) != 0), 1, 0)
        out += np.where(go & ((vn & bit) != 0), 1, 0)
    return (out <= tau) & (np.abs(la - lb) <= tau)


def _points(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    each = [np.frombuffer(x.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4") for x in lines]
    length = np.array([len(x) for x in each], np.int64)
    out = np.full((len(each), int(length.max()) if len(each) else 0), 0xFFFFFFFE, np.uint32)
    for i, x in enumerate(each):
        out[i, : len(x)] = x
    return out, length


def bucket_pairs(lines: list[bytes], i: np.ndarray, j: np.ndarray, tau: int) -> np.ndarray:
    """Which of the pairs (i, j) of lines are within distance ``tau``, pairs of like length together."""
    if not len(i):
        return np.zeros(0, bool)
    size = np.array([len(x) for x in lines])
    order = np.argsort(np.maximum(size[i], size[j]), kind="stable")
    ok = np.zeros(len(i), bool)
    k = 0
    while k < len(order):
        longest = max(64, int(max(size[i[order[min(k + 4095, len(order) - 1)]]], size[j[order[min(k + 4095, len(order) - 1)]]])))
        at = order[k : k + max(1, min(4096, (8 << 20) // (4 * longest)))]
        names, back = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        points, length = _points([lines[x] for x in names])
        a, b = back[: len(at)], back[len(at) :]
        near = np.abs(length[a] - length[b]) <= tau
        at, a, b = at[near], a[near], b[near]
        if len(at):
            ok[at] = within_distance(points[a], points[b], length[a], length[b], tau)
        k += max(1, min(4096, (8 << 20) // (4 * longest)))
    return ok


def verified_edges(met: DataFrame, lines: DataFrame, tau: int) -> DataFrame:
    """Edges ``src, dst`` among lines within distance ``tau``: for each bucket a forest, so never all pairs."""
    sizes = met.groupBy("key").agg(F.count("*").alias("size"))
    rows = (
        met.join(sizes, "key")
        .withColumn("chunks", F.ceil(F.col("size") / BUCKET).cast("int"))
        .withColumn("c", F.pmod(F.xxhash64("h"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("key", F.least("c", "other").alias("ta"), F.greatest("c", "other").alias("tb"), "c", "h", "role")
        .join(lines, "h")
    )

    @tidied
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(table: pa.Table) -> pa.RecordBatch:
            key, ta, tb, c, h, role = (table.column(x).to_numpy() for x in ("key", "ta", "tb", "c", "h", "role"))
            line = table.column("line").to_pylist()
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (ta[1:] != ta[:-1]) | (tb[1:] != tb[:-1])
            group = np.cumsum(new) - 1
            left, right = [], []
            for d in range(1, len(key)):
                i = np.flatnonzero(group[:-d] == group[d:])
                if not len(i):
                    break
                # one of the two must own the segment; a pair inside a chunk is compared in the chunk's own tile
                i = i[((role[i] | role[i + d]) == 1) & ((ta[i] == tb[i]) | (c[i] != c[i + d]))]
                left.append(i)
                right.append(i + d)
            i = np.concatenate(left) if left else np.zeros(0, np.int64)
            j = np.concatenate(right) if right else np.zeros(0, np.int64)
            # the same two lines may meet in several segments
            lo, hi = np.minimum(h[i], h[j]), np.maximum(h[i], h[j])
            _, once = np.unique(mix(lo.view(np.uint64)) + hi.view(np.uint64), return_index=True)
            i, j = i[once], j[once]
            ok = bucket_pairs(line, i, j, tau)
            root = label_pairs(len(key), i[ok], j[ok])
            at = np.flatnonzero(root != np.arange(len(key)))
            pairs = np.unique(np.stack([h[at], h[root[at]]], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["src", "dst"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            if table.num_rows < 2000:
                continue
            key, ta, tb = (table.column(x).to_numpy() for x in ("key", "ta", "tb"))
            other = np.flatnonzero((key != key[-1]) | (ta != ta[-1]) | (tb != tb[-1]))
            whole = int(other[-1]) + 1 if len(other) else 0
            if whole:
                yield flush(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    dealt = rows.repartition("key", "ta", "tb").sortWithinPartitions("key", "ta", "tb", "h")
    return dealt.select("key", "ta", "tb", "c", "h", "role", "line").mapInArrow(compare, "src long, dst long").distinct()


def line_classes(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """``lid, class_lid, chars`` of every line of ``docs(doc_id, text)`` that has a class.

    class_lid is the first line (by doc_id, then line number) of those that are equal or linked, directly or in
    turn, by an edit distance of at most ``tau``. Empty lines have no class, those shorter than
    MIN_EDIT_CHARS only equal ones.
    """
    bits = bits_for(docs)
    bounded_batches(docs.sparkSession)
    table = written(line_table(docs), "lines").where(F.col("chars") >= MIN_CHARS)
    met = written(meeting_lines(docs, tau, bits), "met")
    wanted = distinct_files(met.select("h"), min(bits, 6), "wanted")
    edges = cut(verified_edges(met, written(lines_in(docs, wanted), "wantedlines"), tau))
    remove(docs.sparkSession, wanted.uri)
    groups = connected_components(edges).select(F.col("node").alias("h"), "component")
    first = table.groupBy("h").agg(F.min("lid").alias("low"))
    classes = first.join(groups, "h", "left").select("h", F.coalesce("component", "h").alias("g"), "low")
    heads = classes.groupBy("g").agg(F.min("low").alias("class_lid"))
    return table.join(classes.select("h", "g").join(heads, "g").select("h", "class_lid"), "h").select("lid", "class_lid", "chars")


def duplicate_lines(docs: DataFrame, tau: int = TAU, units: DataFrame | None = None) -> DataFrame:
    """``doc_id, dup_lines array<struct<line, class_lid>>``: the lines that repeat an earlier one, by document.

    With ``units`` (see ``in_units``) the ids of ``docs`` are numbers of units, and the documents' own are given back.
    """
    again = line_classes(docs, tau).where("lid <> class_lid").withColumn("unit", F.shiftright("lid", LINE_BITS))
    if units is None:
        again = again.withColumn("doc_id", F.col("unit")).withColumn("first_unit", F.col("unit"))
    else:
        again = again.join(units, "unit")
    line = (F.col("lid") - F.shiftleft("first_unit", LINE_BITS)).cast("int").alias("line")
    return again.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(line, "class_lid"))).alias("dup_lines"))


def in_units(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs(doc_id, text)`` with ids that leave room for line numbers, and the way back to their own ids.

    Ids within 2**39 and texts of fewer than 2**24 lines are left as they are (None for the way back). Else a document
    gets one unit for each 2**24 lines, in the order of ids, so that any id and any length have places of their own:
    ids are cut into ranges, and only a count for each range reaches the driver. ``units`` has ``unit, doc_id, first_unit``.
    """
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    limit = F.lit(1 << (63 - LINE_BITS))
    wide = docs.where((F.col("doc_id") >= limit) | (F.col("doc_id") <= -limit) | ((F.octet_length("text") >= (1 << LINE_BITS) - 1) & (lines >= (1 << LINE_BITS) - 1)))
    if wide.isEmpty():
        return docs, None
    sized = docs.select("doc_id", (F.shiftright(lines.cast("long"), LINE_BITS) + 1).alias("n"))
    sized = written(sized.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "units")
    at, offsets = 0, []
    for part, n in sized.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        offsets.append((part, at))
        at += n
    starts = docs.sparkSession.createDataFrame(offsets, "part int, at long")
    before = F.sum("n").over(Window.partitionBy("part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = sized.join(F.broadcast(starts), "part").select(
        "doc_id", "n", (F.col("at") + F.coalesce(before, F.lit(0))).alias("first_unit")
    )
    placed = written(placed, "unitplaces")
    units = placed.select(
        F.explode(F.sequence("first_unit", F.col("first_unit") + F.col("n") - 1)).alias("unit"), "doc_id", "first_unit"
    )
    return docs.join(placed, "doc_id").select(F.col("first_unit").alias("doc_id"), "text"), units


def dedup_lines(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """``docs`` without the lines that repeat an earlier line, with ``n_lines, n_removed, dup_lines``.

    Keeps every row and column, but for columns of its own three names, which are replaced; the text column of a row
    that loses lines is joined anew from the rest. Rows with a null id or text keep their text, an empty table stays
    empty, and a text of any length is taken whole. Of rows that repeat an id (their lines could not be told apart)
    one is looked at and the rest keep their text. ``class_lid`` is the place of a class's first line: the id (where
    ``in_units`` had to number the documents: the unit) times 2**24, and the line's number.
    """
    plain = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    plain, units = in_units(plain.dropDuplicates(["doc_id"]) if _repeats(docs) else plain)
    again = duplicate_lines(plain, tau, units).withColumnRenamed("doc_id", "__id").withColumnRenamed("dup_lines", "__dup")
    again = again.withColumn("__gone", F.transform("__dup", lambda d: d["line"]))
    joined = docs.join(again, docs["doc_id"] == F.col("__id"), "left")
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__gone")
    # the one-element array holds the lines, so that a text is cut once
    kept = F.transform(
        F.array(F.split("text", "\n")), lambda lines: F.array_join(F.transform(stay(lines), lambda i: F.get(lines, i)), "\n")
    )[0]
    return joined.select(
        *[docs[c] for c in docs.columns if c not in ("text", "n_lines", "n_removed", "dup_lines")],
        F.when(F.col("__dup").isNotNull(), kept).otherwise(F.col("text")).alias("text"),
        F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"),
        F.when(F.col("__dup").isNotNull(), F.size("__dup")).otherwise(0).cast("long").alias("n_removed"),
        F.coalesce("__dup", F.array().cast("array<struct<line:int,class_lid:long>>")).alias("dup_lines"),
    )


def _repeats(docs: DataFrame) -> bool:
    """Whether some id occurs twice; one bit reaches the driver."""
    return not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those removed and their classes, and the digest of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_removed",
        F.transform("dup_lines", lambda d: d["line"]).alias("removed_lines"),
        F.transform("dup_lines", lambda d: d["class_lid"]).alias("class_ids"),
        F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256).alias("kept_sha256"),
    )
