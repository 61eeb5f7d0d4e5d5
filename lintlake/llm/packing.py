"""Packing of token sequences: first-fit decreasing over a tournament tree of bin capacities, in random groups.

A text is tokenised once; each stretch of ``capacity`` tokens is a sequence by itself. What is left of the documents,
less than a sequence each, is dealt at random to groups of some ``GROUP`` rests. A task packs one group: rests by
falling length, each into the first bin that has room, found by descending a tournament tree that holds the most room
under each node. The room that is then left is filled by cutting up the rests of the emptiest bins, so that a group has
one sequence that is not full, at most.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.bpe import load
from lintlake.llm.textnp import LOWER, SPACE, text_batches, tidied
from lintlake.plans.lineage import bounded_batches, written

CAPACITY = 4096
#: Id that ends each document.
END_ID = 2
#: Rests of a group on average; a group's ids are in one task: GROUP x CAPACITY x 4 bytes (32 MB) if all were full.
GROUP = 2048
#: Bytes of text that are looked at together; bytes that the memory of words may hold in a worker.
TEXT_BYTES, KNOWN_BYTES = 4 << 20, 64 << 20
ENCODE_BYTES = 1 << 18

#: Kinds of bytes: 1 ASCII letters, 2 marks, 3 white space, 0 all others.
_KIND = np.where(SPACE, 3, 0).astype(np.uint8)
_KIND[65:91] = _KIND[97:123] = 1
_KIND[[*b".,;:!?"]] = 2


class WordIds:
    """Token ids of texts by way of their words.

    A word is a run between ASCII white space, cut once more between an ASCII letter and a mark of ``.,;:!?``; words of
    ASCII only are lower-cased, unless they may hold a special token. That is right for tokenizers that drop white
    space, lower-case and split between letters and marks, as the one with word ends does: its normaliser, splitting
    pattern and special tokens never look across such a place. A word's ids are remembered, in two ages: once one age
    fills ``KNOWN_BYTES``, only what was used since then is kept.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.kind = id_kind(self.tokenizer)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.size = 0

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words."""
        if self.size > KNOWN_BYTES:
            self.older, self.known, self.size = self.known, {}, 0
        known, older = self.known, self.older
        found = [known.get(w) for w in words]
        new = []
        for k in [k for k, x in enumerate(found) if x is None]:
            found[k] = older.get(words[k])
            if found[k] is None:
                new.append(k)
            else:
                self._keep(words[k], found[k])
        i = 0
        while i < len(new):
            j, size = i, 0
            while j < len(new) and (j == i or size + len(words[new[j]]) <= ENCODE_BYTES):
                size += len(words[new[j]])
                j += 1
            for k, one in zip(new[i:j], self.tokenizer.encode_batch_fast([words[k].decode() for k in new[i:j]], add_special_tokens=False)):
                found[k] = _narrow(one.ids, self.kind)
                self._keep(words[k], found[k])
            i = j
        return found

    def _keep(self, word: bytes, ids: bytes) -> None:
        self.known[word] = ids
        self.size += len(word) + len(ids) + 160

    def __call__(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and the bounds of the rows (n + 1 values)."""
        if not len(buf):
            return np.zeros(0, self.kind), np.zeros(len(offsets), np.int64)
        kind = _KIND[buf]
        solid = kind < 3
        start = solid.copy()
        edge = np.zeros(len(buf) + 1, bool)
        edge[offsets] = True
        # letter next to mark: kinds 1 and 2
        start[1:] &= (kind[1:] + kind[:-1] == 3) & (kind[:-1] > 0) & (kind[1:] > 0) | ~solid[:-1] | edge[1:-1]
        starts = np.flatnonzero(start)
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(len(offsets), np.int64)
        sizes = np.diff(np.append(np.cumsum(solid)[starts] - 1, np.count_nonzero(solid)))
        data = buf[solid]
        first = np.searchsorted(starts, offsets)
        ids, counts, i = [], [], 0
        ends = np.cumsum(sizes)
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - sizes[i] + TEXT_BYTES, "right")))
            a, b = self._some(data[ends[i] - sizes[i] : ends[j - 1]], sizes[i:j])
            ids.append(a)
            counts.append(b)
            i = j
        total = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return np.concatenate(ids), total[first]

    def _some(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that lie in ``data`` one after the other, and the number of ids of each."""
        bounds = np.zeros(len(sizes) + 1, np.int32)
        np.cumsum(sizes, out=bounds[1:])
        plain = np.logical_and.reduceat((data < 128) & (data != 124), bounds[:-1])
        data = np.where(np.repeat(plain, sizes), LOWER[data], data)
        words = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        blobs = self._ids(words.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(blobs), self.kind)
        size = np.array([len(b) for b in blobs], np.int64) // flat.itemsize
        first = np.cumsum(size) - size
        codes = words.indices.to_numpy()
        counts = size[codes]
        at = np.repeat(first[codes] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        return flat[at], counts


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One memory of words in a worker, for all its tasks."""
    return WordIds(path)


def _narrow(ids: list[int], kind: str) -> bytes:
    packed = array("H" if kind == "<u2" else "I", ids)
    if sys.byteorder != "little" or packed.itemsize != int(kind[2]):
        return np.array(ids, kind).tobytes()
    return packed.tobytes()


def id_kind(tokenizer) -> str:
    return "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


class Tournament:
    """Bins of equal capacity in a row; each inner node holds the most room of a bin below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Put ``size`` into the first bin with room for it and return its number."""
        room, node = self.room, 1
        if room[1] < size:
            raise ValueError("no bin has room")
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        room[node] -= size
        found = node - self.leaves
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return found


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[list[int]]]:
    """Bins of ``[item, start, length]``; items of equal length keep their order."""
    tree, bins = Tournament(len(lengths), capacity), []
    for item in np.argsort(-lengths, kind="stable"):
        size = int(lengths[item])
        number = tree.place(size)
        if number == len(bins):
            bins.append([])
        bins[number].append([int(item), 0, size])
    return bins


def fill_room(bins: list[list[list[int]]], capacity: int) -> list[list[list[int]]]:
    """The same tokens in as few bins as can be: the emptiest bins are cut up to fill the room of the fullest."""
    bins = sorted(([*b] for b in bins), key=lambda b: -sum(x[2] for x in b))
    room = [capacity - sum(x[2] for x in b) for b in bins]
    to, last = 0, len(bins) - 1
    while to < last:
        if not room[to]:
            to += 1
        elif not bins[last]:
            last -= 1
        else:
            item, start, size = bins[last].pop()
            take = min(size, room[to])
            bins[to].append([item, start, take])
            room[to] -= take
            room[last] += take
            if take < size:
                bins[last].append([item, start + take, size - take])
    return [b for b in bins if b]


_CUT = "row long, doc_id long, start long, length long, doc_tokens long, ids binary"
_PACKED = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of each row of ``docs(doc_id, text)``; ``row`` numbers the pieces.

    ids are little-endian, of two bytes each where the vocabulary allows it, else of four.
    """
    bounded_batches(docs.sparkSession)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, made = word_ids(tokenizer_path), TaskContext.get().partitionId() << 36, 0
        last = np.array([end_id], words.kind).tobytes()
        for part, buf, offsets in text_batches(batches, "text", TEXT_BYTES):
            flat, bounds = words(buf, offsets)
            rows: list[list] = [[] for _ in range(6)]
            for doc, a, b in zip(part.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                n = b - a + 1
                for start in range(0, n, capacity):
                    stop = min(n, start + capacity)
                    ids = flat[a + start : min(b, a + stop)].tobytes() + (last if stop == n else b"")
                    for column, value in zip(rows, (task + made, doc, start, stop - start, n, ids)):
                        column.append(value)
                    made += 1
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], ["row", "doc_id", "start", "length", "doc_tokens", "ids"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, _CUT)


def _wide(ids: bytes, kind: str) -> bytes:
    return np.frombuffer(ids, kind).astype("<u4").tobytes()


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """Sequences of at most ``capacity`` tokens from all rows of ``docs(doc_id, text)``, one row a piece.

    Gives ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``: the piece's ids (little-endian, four bytes),
    its place in its document and in its sequence. Offsets of a sequence run from 0 without a gap; only one sequence of
    each group is not full. A document's ids end with ``end_id``, so that an empty or null text has one token. Every row
    is packed by itself: repeated rows and ids each have their pieces, a null id stays null. An empty table gives no
    rows; other columns are not looked at. Groups are dealt by a hash of the piece's number, which depends on nothing
    in the data, so no id, source or copy can fill one. The tokens are written once to the shared folder, so a lost
    task never numbers them anew.
    """
    kind = id_kind(load(tokenizer_path))
    pieces = written(cut_documents(docs, tokenizer_path, capacity, end_id), "packing")
    rests = pieces.where(F.col("length") < capacity)
    groups = -(-rests.count() // group) or 1

    @tidied
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, doc, start, length, tokens, ids = batch.columns
            number = pa.array(row.to_numpy() * 2 + 1, pa.int64())
            wide = pa.array([_wide(x, kind) for x in ids.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [doc, start, length, tokens, number, pa.array(np.zeros(len(doc), np.int64)), wide],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    def one_group(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        doc, start, tokens, ids = (table.column(n).to_pylist() for n in ("doc_id", "start", "doc_tokens", "ids"))
        number = table.column("grp")[0].as_py() << 25
        out = []
        for k, content in enumerate(fill_room(first_fit_decreasing(table.column("length").to_numpy(), capacity), capacity)):
            offset = 0
            for item, a, size in content:
                wide = _wide(memoryview(ids[item])[a * int(kind[2]) : (a + size) * int(kind[2])], kind)
                out.append((doc[item], start[item] + a, size, tokens[item], number + 2 * k, offset, wide))
                offset += size
        kinds = [pa.int64()] * 6 + [pa.binary()]
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

    grouped = rests.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return (
        pieces.where(F.col("length") == capacity)
        .mapInArrow(whole, _PACKED)
        .unionByName(grouped.groupBy("grp").applyInArrow(one_group, _PACKED))
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op13_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens: one row a piece, its ids as a CRC-32."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, default_tokenizer()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
