"""Byte-pair encoding of whole texts, with long texts encoded in pieces and joined exactly.

A long text is cut into pieces that are encoded in parallel tasks. Neighbours are then concatenated pairwise,
level by level: a window around each join, growing on both sides, is encoded again until its tokens agree
with the left piece's before the join and with the right piece's after it.
"""

from __future__ import annotations

import hashlib
import os
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.textnp import text_batches, tidied
from lintlake.plans.lineage import bounded_batches

#: Characters of a piece; longer texts are encoded in pieces. Characters added to a window's side at a time.
PIECE_CHARS = 32_768
WINDOW_CHARS = 64
#: Bytes of text that are encoded at once; an encoding takes some thirty times its text.
ENCODE_BYTES = 1 << 18


@lru_cache(maxsize=2)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Encoded:
    """A stretch of text with its token ids and the character offsets at which tokens start and end."""

    def __init__(self, text: str, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.text, self.ids, self.starts, self.ends = text, ids, starts, ends


def encode(tokenizer, text: str) -> Encoded:
    found = tokenizer.encode(text, add_special_tokens=False)
    spans = np.array(found.offsets, np.int64).reshape(-1, 2)
    return Encoded(text, np.array(found.ids, np.uint32), spans[:, 0], spans[:, 1])


def _seams(tokenizer, text: str, lo: int, hi: int) -> set[int]:
    """Positions lo < p < hi at which the pre-tokenizer (or a special token) ends one unit and begins another."""
    return {lo + a for _, (a, _) in tokenizer.pre_tokenizer.pre_tokenize_str(text[lo:hi]) if a}


def join(tokenizer, left: Encoded, right: Encoded, step: int = WINDOW_CHARS) -> Encoded:
    """The encoding of ``left.text + right.text``.

    The window's tokens are taken between two seams, one in each side: places where the window's units agree
    with the piece's own units and where token boundaries of window and piece coincide, with a whole unit
    between the seam and the window's edge, so that what lies beyond the edge cannot reach it. If no such pair
    of seams exists (one unit fills the sides), the window grows until it is the whole of both.
    """
    text = left.text + right.text
    cut = len(left.text)
    reach = step
    while True:
        lo, hi = max(0, cut - reach), min(len(text), cut + reach)
        whole = lo == 0 and hi == len(text)
        window = encode(tokenizer, text[lo:hi])
        if whole:
            return window
        a = 0 if lo == 0 else _left_seam(tokenizer, left, window, lo, cut)
        b = len(text) if hi == len(text) else _right_seam(tokenizer, right, window, lo, cut, hi)
        if a is not None and b is not None:
            take_left = int(np.searchsorted(left.starts, a)) if a else 0
            w0 = int(np.searchsorted(window.starts, a - lo)) if a else 0
            if b == len(text):
                w1, take_right = len(window.ids), len(right.ids)
            else:
                w1 = int(np.searchsorted(window.starts, b - lo))
                take_right = int(np.searchsorted(right.starts, b - cut))
            return Encoded(
                text,
                np.concatenate([left.ids[:take_left], window.ids[w0:w1], right.ids[take_right:]]),
                np.concatenate([left.starts[:take_left], window.starts[w0:w1] + lo, right.starts[take_right:] + cut]),
                np.concatenate([left.ends[:take_left], window.ends[w0:w1] + lo, right.ends[take_right:] + cut]),
            )
        reach *= 2


def _agreed(first: Encoded, shift: int, second: Encoded, start: int, stop: int) -> bool:
    """Whether both have the same tokens at the same places between two text positions."""
    a0, a1 = np.searchsorted(first.starts, [start - shift, stop - shift])
    b0, b1 = np.searchsorted(second.starts, [start, stop])
    return (
        a1 - a0 == b1 - b0 > 0
        and np.array_equal(first.ids[a0:a1], second.ids[b0:b1])
        and np.array_equal(first.starts[a0:a1] + shift, second.starts[b0:b1])
    )


def _left_seam(tokenizer, left: Encoded, window: Encoded, lo: int, cut: int) -> int | None:
    """The last seam well inside the left side, with the two units around it encoded alike."""
    # the units of the window's left side depend on where it starts; those that a longer view has too are real
    seen = _seams(tokenizer, left.text, lo, cut)
    far = _seams(tokenizer, left.text, max(0, lo - WINDOW_CHARS), cut)
    joined = {lo + a for _, (a, _) in tokenizer.pre_tokenizer.pre_tokenize_str(window.text)}
    seams = sorted(p for p in seen & far & joined if p < cut)
    for i in range(len(seams) - 3, 0, -1):
        if _agreed(window, lo, left, seams[i - 1], seams[i + 1]) and _special_free(tokenizer, window.text, seams[i] - lo):
            return seams[i]
    return None


def _right_seam(tokenizer, right: Encoded, window: Encoded, lo: int, cut: int, hi: int) -> int | None:
    seen = {cut + p for p in _seams(tokenizer, right.text, 0, hi - cut)}
    far = {cut + p for p in _seams(tokenizer, right.text, 0, min(len(right.text), hi - cut + WINDOW_CHARS))}
    joined = {lo + a for _, (a, _) in tokenizer.pre_tokenizer.pre_tokenize_str(window.text)}
    seams = sorted(p for p in seen & far & joined if p > cut)
    for i in range(1, len(seams) - 2):
        if _agreed(window, lo - cut, right, seams[i - 1] - cut, seams[i + 1] - cut) and _special_free(
            tokenizer, window.text, seams[i] - lo
        ):
            return seams[i]
    return None


@lru_cache(maxsize=2)
def _added(tokenizer) -> list[str]:
    return [token.content for token in tokenizer.get_added_tokens_decoder().values()]


def _special_free(tokenizer, text: str, at: int) -> bool:
    """No special token lies across a position."""
    for content in _added(tokenizer):
        k = len(content)
        if content in text[max(0, at - k + 1) : at + k - 1]:
            return False
    return True


def pieces_of(text: str, size: int) -> list[str]:
    """Halves of halves, none longer than ``size``."""
    if len(text) <= size:
        return [text]
    parts = 1 << ((len(text) - 1) // size).bit_length()
    step = -(-len(text) // parts)
    return [text[i : i + step] for i in range(0, len(text), step)]


def merge_tree(tokenizer, parts: list[Encoded]) -> Encoded:
    while len(parts) > 1:
        parts = [
            join(tokenizer, parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i]
            for i in range(0, len(parts), 2)
        ]
    return parts[0]


def encode_long(tokenizer, text: str, size: int = PIECE_CHARS) -> np.ndarray:
    """The ids of a text by pieces and joins, within one task."""
    return merge_tree(tokenizer, [encode(tokenizer, p) for p in pieces_of(text, size)]).ids


def _packed(e: Encoded) -> list[bytes]:
    """ids, steps between the starts of tokens and lengths of tokens; the last two in one byte each where all fit."""
    out = [e.ids.astype("<u4").tobytes()]
    for x in (np.diff(e.starts, prepend=0), e.ends - e.starts):
        small = not len(x) or (x.max() < 256 and x.min() >= 0)
        out.append((b"\1" + x.astype("u1").tobytes()) if small else (b"\4" + x.astype("<i4").tobytes()))
    return out


def _unpacked(text: str, ids: bytes, steps: bytes, lengths: bytes) -> Encoded:
    numbers = [np.frombuffer(x, "u1" if x[0] == 1 else "<i4", offset=1).astype(np.int64) for x in (steps, lengths)]
    starts = np.cumsum(numbers[0])
    return Encoded(text, np.frombuffer(ids, "<u4"), starts, starts + numbers[1])


#: A piece, or several joined: number k of last + 1 of its text. A whole text keeps its ids only.
_PIECE = [
    ("doc_id", "long", pa.int64()), ("text_sha", "string", pa.string()), ("copies", "long", pa.int64()),
    ("k", "int", pa.int32()), ("last", "int", pa.int32()), ("part", "string", pa.string()),
    ("ids", "binary", pa.binary()), ("steps", "binary", pa.binary()), ("lengths", "binary", pa.binary()),
]
_PIECE_SQL = ", ".join(f"{name} {kind}" for name, kind, _ in _PIECE)
_PIECE_ARROW = pa.schema([(name, kind) for name, _, kind in _PIECE])


def encoded_pieces(long: DataFrame, tokenizer_path: str, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``doc_id, copies, ids`` of texts ``(doc_id, text)`` longer than a piece, each different row once.

    Pieces are rows, dealt out by text and place. Each level of the tree joins rows 2 k and 2 k + 1 of a text, so a
    task holds two neighbours, and only its last join holds a whole text. Equal rows are encoded once and counted:
    no number depends on the order in which rows arrive, so a stage that runs again gives the same rows.
    """
    longest = long.agg(F.max(F.length("text"))).first()[0] or 0
    levels = ((longest - 1) // piece_chars).bit_length() if longest > piece_chars else 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(*(batch.column(k).to_pylist() for k in range(2))):
                parts = pieces_of(text, piece_chars)
                sha = hashlib.sha256(text.encode()).hexdigest()
                for k, part in enumerate(parts):
                    row = {"doc_id": doc, "text_sha": sha, "k": k, "last": len(parts) - 1, "part": part}
                    yield pa.RecordBatch.from_pylist([row], pa.schema([_PIECE_ARROW.field(n) for n in row]))

    @tidied
    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(tokenizer_path)
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                packed = _packed(encode(tokenizer, one.column(5)[0].as_py()))
                yield pa.RecordBatch.from_arrays([*one.columns, *(pa.array([x], pa.binary()) for x in packed)], schema=_PIECE_ARROW)

    def neighbours(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["k"])
        one = rows[0]
        if len(rows) > 1:
            whole = join(load(tokenizer_path), *(_unpacked(r["part"], r["ids"], r["steps"], r["lengths"]) for r in rows))
            one |= {"part": whole.text} | dict(zip(("ids", "steps", "lengths"), _packed(whole)))
        one |= {"k": one["k"] >> 1, "last": one["last"] >> 1}
        if not one["last"]:
            one |= dict.fromkeys(("part", "steps", "lengths"))
        return pa.Table.from_pylist([one], _PIECE_ARROW)

    rows = (
        long.mapInArrow(cut, "doc_id long, text_sha string, k int, last int, part string")
        .groupBy("doc_id", "text_sha", "k", "last")
        .agg(F.count("*").alias("copies"), F.first("part").alias("part"))
        .select("doc_id", "text_sha", "copies", "k", "last", "part")
        .mapInArrow(encode_parts, _PIECE_SQL)
    )
    for _ in range(levels):
        rows = rows.groupBy("doc_id", "text_sha", F.shiftright("k", 1)).applyInArrow(neighbours, _PIECE_SQL)
    return rows.select("doc_id", "copies", "ids")


def _split(docs: DataFrame, piece_chars: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text`` of the texts of one piece, nulls as empty texts, and of the longer ones."""
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return base.where(F.length("text") <= piece_chars), base.where(F.length("text") > piece_chars)


def _encoded(tokenizer, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[list[int]]]]:
    """doc ids and token ids of slices of a bounded number of bytes."""
    for part, _, _ in text_batches(batches, "text", ENCODE_BYTES):
        found = tokenizer.encode_batch_fast(part.column(1).to_pylist(), add_special_tokens=False)
        yield part.column(0), [x.ids for x in found]


def bpe_encode(docs: DataFrame, tokenizer_path: str, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``(doc_id, ids binary)`` for every row of ``docs(doc_id, text)``.

    ids are little-endian unsigned 32-bit integers. A null text is empty; rows that repeat an id, or are equal, are
    each encoded or counted; null ids stay. Texts of up to ``piece_chars`` are encoded where they are read, longer
    ones in pieces. An empty table gives none; other columns are not looked at.
    """
    short, long = _split(docs, piece_chars)

    @tidied
    def encode_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, found in _encoded(load(tokenizer_path), batches):
            yield pa.RecordBatch.from_arrays([doc, pa.array([_packed_ids(x) for x in found], pa.binary())], ["doc_id", "ids"])

    pieces = encoded_pieces(long, tokenizer_path, piece_chars)
    each = pieces.select("doc_id", "ids", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "ids")
    return short.mapInArrow(encode_short, "doc_id long, ids binary").unionByName(each)


def _packed_ids(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if packed.itemsize != 4 or sys.byteorder != "little":
        return np.array(ids, "<u4").tobytes()
    return packed.tobytes()


class Decoder:
    """A tokenizer's decode of whole lists of ids, special tokens kept.

    Where the decoder is the byte-level one, the text is the tokens' bytes in a row (invalid ones replaced), so one
    table of bytes by id does; any other decoder, or an id outside the table, goes through the library.
    """

    def __init__(self, tokenizer):
        from tokenizers.decoders import ByteLevel

        self.tokenizer, self.table = tokenizer, None
        if isinstance(tokenizer.decoder, ByteLevel):
            # a byte stands for itself where it is a visible character, else for the next free one from 256 on
            seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
            letters = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(seen))}
            size = 1 + max(tokenizer.get_vocab(with_added_tokens=True).values(), default=-1)
            self.table = [self._bytes(tokenizer.id_to_token(i) or "", letters) for i in range(size)]

    @staticmethod
    def _bytes(token: str, letters: dict[str, int]) -> bytes:
        return bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    def __call__(self, ids: list[int]) -> str:
        if self.table is not None:
            try:
                return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")
            except IndexError:
                pass
        return self.tokenizer.decode(ids, skip_special_tokens=False)


@lru_cache(maxsize=1)
def decoder(path: str) -> Decoder:
    return Decoder(load(path))


def bpe_decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Add ``decoded`` (special tokens kept) to rows of ``(doc_id, ids)``; null or empty ids give an empty text."""

    @tidied
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = decoder(tokenizer_path)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = [turn(np.frombuffer(x or b"", "<u4").tolist()) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, ids binary, decoded string")


_DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digest_batch(doc: pa.Array, found: list[list[int]], turn: Decoder) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            doc,
            pa.array([len(x) for x in found], pa.int64()),
            pa.array([hashlib.sha256(_packed_ids(x)).hexdigest() for x in found], pa.string()),
            pa.array([hashlib.sha256(turn(x).encode()).hexdigest() for x in found], pa.string()),
        ],
        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def digests(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Decode rows of ``(doc_id, ids)`` and give ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return bpe_decode(encoded, tokenizer_path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )


def round_trip(docs: DataFrame, tokenizer_path: str, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Encode and decode every row and give ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Rows, nulls and long texts as in ``bpe_encode``; ids and decoded text of a text of one piece stay in the task that
    encodes it.
    """
    short, long = _split(docs, piece_chars)

    @tidied
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, turn = load(tokenizer_path), decoder(tokenizer_path)
        for doc, found in _encoded(tokenizer, batches):
            yield _digest_batch(doc, found, turn)

    @tidied
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = decoder(tokenizer_path)
        for batch in batches:
            for i in range(batch.num_rows):
                doc, copies, ids = (c.slice(i, 1) for c in batch.columns)
                one = _digest_batch(doc, [np.frombuffer(ids[0].as_py(), "<u4").tolist()], turn)
                for _ in range(copies[0].as_py()):
                    yield one

    return short.mapInArrow(whole, _DIGEST).unionByName(encoded_pieces(long, tokenizer_path, piece_chars).mapInArrow(joined, _DIGEST))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, one row a row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, default_tokenizer())


def reference_digest(tokenizer, text: str | None) -> tuple[int, str, str]:
    """What one text must give, straight from the tokenizer; used by the tests."""
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    packed = np.array(ids, "<u4").tobytes()
    out = tokenizer.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(out.encode()).hexdigest()
