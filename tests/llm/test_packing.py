"""Packing: against the library's ids, a plain first fit, and the rules of sequences."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from lintlake.llm import packing
from lintlake.llm.bpe import load

ODD = "aB éß́İΣς  ​\t\n\r\x0b\x0c\x1c'sT'll12٣,.;<|endoftext|>{}あ\U0001f600ẛ̣"


def random_text(r, n):
    pool = [*ODD, "<|startoftext|>", "<|endoftext|>", "don't", "They'LL", "x" * 90, "  "]
    return "".join(r.choice(pool) for _ in range(n))


def test_word_ids_are_the_library_s():
    r, path = random.Random(4), packing.default_tokenizer()
    tokenizer, words = load(path), packing.WordIds(path)
    texts = [random_text(r, r.randint(0, 60)) for _ in range(1500)] + ["", " ", "\n\n"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    flat, bounds = words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for k, t in enumerate(texts):
        assert flat[bounds[k] : bounds[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_word_ids_in_slices_and_with_little_memory(monkeypatch):
    monkeypatch.setattr(packing, "TEXT_BYTES", 40)
    monkeypatch.setattr(packing, "KNOWN_BYTES", 500)
    monkeypatch.setattr(packing, "ENCODE_BYTES", 30)
    test_word_ids_are_the_library_s()


def test_first_fit_decreasing_is_the_plain_one():
    r = random.Random(6)
    for _ in range(200):
        sizes = np.array([r.randint(1, 50) for _ in range(r.randint(1, 60))])
        plain = []
        for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            for content in plain:
                if sum(sizes[x] for x in content) + sizes[item] <= 50:
                    content.append(item)
                    break
            else:
                plain.append([item])
        got = packing.first_fit_decreasing(sizes, 50)
        assert [[x[0] for x in b] for b in got] == plain
        full = packing.fill_room(got, 50)
        assert len(full) == -(-int(sizes.sum()) // 50) and all(sum(x[2] for x in b) == 50 for b in full[:-1])
        seen = Counter((i, p) for b in full for i, s, n in b for p in range(s, s + n))
        assert seen == Counter((i, p) for i, n in enumerate(sizes) for p in range(n))


def held(rows, wanted, capacity):
    """Checks pieces against the documents' ids; returns the padding and the number of sequences."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for x in rows:
        pieces[x.doc_id].append((x.start, x.length, x.doc_tokens, bytes(x.ids)))
        sequences[x.sequence_id].append((x.offset, x.length))
    got = Counter()
    for doc, found in pieces.items():
        whole = defaultdict(list)
        for s, n, total, ids in found:
            assert len(ids) == 4 * n > 0
            whole[total].append((s, ids))
        for total, parts in whole.items():
            got[doc, total] += sum(len(x) for _, x in parts) // 4
    want = Counter()
    for doc, ids in wanted:
        want[doc, len(ids)] += len(ids)
    assert got == want
    for content in sequences.values():
        at = 0
        for offset, n in sorted(content):
            assert offset == at
            at += n
        assert at <= capacity
    return sum(capacity - sum(n for _, n in c) for c in sequences.values()), len(sequences)


def test_packing_job(spark):
    r, path = random.Random(7), packing.default_tokenizer()
    tokenizer = load(path)
    texts = {k: random_text(r, r.choice([0, 3, 40, 300, 900])) for k in range(120)} | {500: None, 501: ""}
    rows = list(texts.items()) + [(None, "a b"), (None, "a b"), (7, texts[7]), (7, "other words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(3), "grp": F.lit("x"), "length": F.lit(None)})
    got = packing.pack(df.repartition(3), path, capacity=64, group=30).collect()
    ids = [(k, [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID]) for k, t in rows]
    padding, sequences = held(got, ids, 64)
    total = sum(len(x) for _, x in ids)
    assert padding <= 64 * 6 and sequences <= total // 64 + 7
    by_doc = defaultdict(list)
    for x in got:
        by_doc[x.doc_id].append((x.start, np.frombuffer(x.ids, "<u4").tolist()))
    for k, t in texts.items():
        if k != 7:
            assert sum((x for _, x in sorted(by_doc[k])), []) == dict(ids)[k]
            assert [s for s, _ in sorted(by_doc[k])] == list(np.cumsum([0, *(len(x) for _, x in sorted(by_doc[k]))])[:-1])


def test_packing_query(spark, tmp_path):
    path, tokenizer = str(tmp_path / "in"), load(packing.default_tokenizer())
    rows = [(1, "one two " * 5000), (2, None), (3, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    got = packing.op13_first_fit_packing(spark, path).collect()
    for k, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted((x for x in got if x.doc_id == k), key=lambda x: x.start)
        assert all(x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes()) and x.doc_tokens == len(ids) for x in mine)
        assert sum(x.length for x in mine) == len(ids)
    assert len({x.sequence_id for x in got}) == 3


def test_packing_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), packing.default_tokenizer()).count() == 0
