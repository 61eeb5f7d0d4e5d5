"""The dealt operators against brute force, exact round trips and held-out accuracy, on small inputs."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintlake.llm import bpe, decontam, embed, kneser, langid, lines, repeats, shingles, suffix, textnp, toxicity, warc

DOCS = "doc_id long, text string"


def docs(spark, rows, extra=False):
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"h": F.lit(1), "n": F.lit("x"), "rep": F.lit(2)}) if extra else df


def prose(r, n, words=400):
    stems = ["".join(r.choice("abcdeéü") for _ in range(r.randint(2, 6))) for _ in range(words)]
    return " ".join(r.choice(stems) for _ in range(n))


# -- 1 -----------------------------------------------------------------------------------------------------------


def warc_rows(spark, tmp_path, rows):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(path + "/pages.parquet")
    return {r.page_id: r for r in warc.op1_warc_transactions(spark, path).collect()}


def test_warc_round_trip(spark, tmp_path):
    import base64

    html = {1: "<p>é</p>", 2: None, 3: "<p>é</p>", 4: "", 5: "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nxyz", 6: "x" * 200_000}
    got = warc_rows(spark, tmp_path, [(k, f"http://e/{k} b\nc" if k > 1 else None, v) for k, v in html.items()])
    for k, v in html.items():
        raw = (v or "").encode()
        assert got[k].payload_bytes == len(raw)
        assert got[k].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {
        1: ("revisit", 3), 2: ("revisit", 4), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    assert all(r.n_requests == r.n_metadata == 1 for r in got.values())


def test_warc_null_and_repeated_ids(spark, tmp_path):
    """A row a page, whatever its id; clashing extra columns; one payload on most pages."""
    rows = [(1, "u", "aaaa"), (1, "u", "bbbb"), (1, "u", "bbbb"), (None, "v", "aaaa"), (None, "v", "zz"), (None, None, "zz"), (2, None, None)]
    rows += [(k, f"w{k}", "same") for k in range(10, 60)]
    path = str(tmp_path / "in")
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.withColumns({"payload_digest": F.lit("x"), "occurrence": F.lit(7), "holder": F.lit(1)}).write.parquet(path + "/pages.parquet")
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.n_requests, r.n_metadata) for r in warc.op1_warc_transactions(spark, path).collect())
    want = Counter({(1, 4, "response", None, 1, 1): 3, (None, 4, "revisit", 1, 1, 1): 1, (None, 2, "response", None, 1, 1): 2, (2, 0, "response", None, 1, 1): 1})
    want.update({(k, 4, "revisit", 59, 1, 1): 1 for k in range(10, 59)})
    want[(59, 4, "response", None, 1, 1)] += 1
    assert got == want


def test_warc_reads_by_chunks(monkeypatch):
    """Members, plain files and records across chunk borders give the same records."""
    import gzip

    monkeypatch.setattr(warc, "CHUNK", 37)
    one = lambda k: f"WARC/1.1\r\nWARC-Record-ID: <{k}>\r\nContent-Length: {k * 40}\r\n\r\n".encode() + bytes([65 + k]) * (k * 40) + b"\r\n\r\n"
    parts = [one(k) for k in range(5)]
    for data in (b"".join(parts), gzip.compress(b"".join(parts)), b"".join(gzip.compress(x) for x in parts)):
        assert [(r["record_id"], len(r["payload"])) for r in warc.parse_records(data)] == [(f"<{k}>", k * 40) for k in range(5)]
        assert len(list(warc.parse_records(data[:-60]))) < 5


def test_warc_empty(spark, tmp_path):
    assert warc_rows(spark, tmp_path, []) == {}


def test_warc_min_payload_and_torn_file(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    assert {r.record_type for r in warc.plan_captures(pages, 3).collect()} == {"response"}
    warc.write_warc(warc.plan_captures(pages), str(tmp_path / "w"))
    whole = warc._members(next((tmp_path / "w").glob("part*")).read_bytes())
    assert len(list(warc.parse_records(whole))) in (3, 6)
    assert len(list(warc.parse_records(whole[:-20]))) < len(list(warc.parse_records(whole)))


# -- 2 -----------------------------------------------------------------------------------------------------------


def test_suffix_arrays():
    r = random.Random(5)
    for k in range(300):
        t = [r.randint(1, r.choice([1, 2, 5, 40])) for _ in range(r.randint(1, 50))]
        t = (t[:6] * 9)[: len(t)] if k % 3 == 0 else t
        sa = suffix.suffix_array(np.array(t))
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        phi, plcp = suffix.permuted_lcp(np.array(t), sa)
        for a, b in zip(sa, sa[1:]):
            common = next((q for q in range(len(t)) if max(a, b) + q >= len(t) or t[a + q] != t[b + q]), len(t))
            assert phi[b] == a and plcp[b] == common


def repeat_cases():
    r = random.Random(1)
    base = ["".join(r.choice("abé ") for _ in range(300)) for _ in range(5)]
    out = {}
    for i in range(90):
        kind = r.random()
        if kind < 0.2:
            out[i] = "a" * r.randint(0, 400)
        elif kind < 0.4:
            out[i] = "ab" * r.randint(20, 150) + r.choice(base)[:120]
        else:
            out[i] = "".join(r.choice(base)[r.randint(0, 100) : r.randint(90, 300)] + r.choice(["", "x", "yy"]) for _ in range(r.randint(0, 4)))
    out[90], out[91] = None, ""
    return out


@pytest.mark.parametrize("split", [400, 3])
def test_repeats(spark, monkeypatch, split):
    monkeypatch.setattr(repeats, "SPLIT", split)
    cases = repeat_cases()
    rows = repeats.remove_repeats(docs(spark, list(cases.items()), extra=True).repartition(3)).collect()
    got = {r.doc_id: (r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.text).hexdigest()) for r in rows}
    assert got == repeats.brute_force(cases)


def test_repeats_edges(spark):
    assert repeats.remove_repeats(docs(spark, [])).count() == 0
    rows = repeats.remove_repeats(docs(spark, [(None, "z" * 300), (1, "q" * 150), (1, "q" * 150)])).collect()
    assert sorted((r.doc_id is None, r.n_bytes, len(r.spans)) for r in rows) == [(False, 150, 1), (True, 300, 0)]


def test_long_text_is_cut_in_blocks(monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 500)
    r = random.Random(2)
    raw = np.frombuffer("".join(r.choice("abc") for _ in range(2000)).encode(), np.uint8)
    low, high, _, _ = repeats.segments(raw)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(low, high)])
    assert sorted(covered.tolist()) == list(range(len(raw) - repeats.LENGTH + 1))


# -- 3 -----------------------------------------------------------------------------------------------------------


def test_embeddings(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 16))
    vectors = {i: (centres[i % 20] + r.normal(size=16) * r.choice([0.05, 0.25, 0.6])).tolist() for i in range(300)}
    vectors[300] = vectors[1]
    vectors[301] = [x * 1e200 for x in vectors[1]]
    odd = {400: None, 401: [0.0] * 16, 402: [float("nan")] * 16, 403: [None] * 16, 404: [float("inf")] * 16, 405: [], 406: [1.0, 2.0]}
    rows = [(k, v) for k, v in (vectors | odd).items()] + [(0, vectors[0])]
    got = {r.vec_id: r for r in embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tile=64).collect()}
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids])
    x = x / np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T) >= 0.9
    np.fill_diagonal(link, False)
    label = textnp.label_pairs(len(ids), *np.nonzero(np.triu(link)))
    assert {k: (got[k].n_links, got[k].component_id) for k in ids} == {k: (int(link[i].sum()), ids[label[i]]) for i, k in enumerate(ids)}
    assert all((got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True) for k in odd)


def test_quantisation_bound_holds():
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 33)) * r.choice([1, 1e-3, 50], size=(200, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, scale, near, error = embed.quantise(x)
    approx = embed.int8_products(codes, codes) * scale[:, None] * scale[None, :]
    assert (np.abs(approx - x @ x.T) <= np.outer(near, error) + error[:, None] + 1e-6).all()


# -- 4 -----------------------------------------------------------------------------------------------------------


def test_language(spark):
    r = random.Random(9)
    vocab = {lang: ["".join(r.choice(letters) for _ in range(5)) for _ in range(60)] for lang, letters in (("aa", "abcdefg"), ("bb", "mnopqrs"))}
    rows = [(i, " ".join(r.choice(vocab[lang]) for _ in range(30)), lang, f"s{i % 4}") for i in range(200) for lang in (["aa", "bb"][i % 2],)]
    rows += [(900, None, "aa", None), (901, "", None, "s0"), (None, "abc abc", "aa", "s1")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame(
        [(1, "http://x.example.aa/p", '<html lang="aa"><p>' + rows[0][1] + "</p></html>"), (2, None, None), (3, "http://x.example.aa/q", "<p>zz</p>")], "page_id long, url string, html string"
    )
    model = langid.train(table)
    out = langid.fuse(langid.text_evidence(langid.document_rows(table).unionByName(langid.page_rows(pages)), model), model).collect()
    assert len(out) == len(rows) + 3
    said = {r.doc_id: r.lang for r in out if r.kind == "document"}
    assert all(said[i] == lang for i, _, lang, _ in rows if i is not None and i < 200)
    page = {r.page_id: r for r in out if r.kind == "page"}
    assert page[1].lang == "aa" and page[1].declared == "aa" and page[1].suffix == "aa" and 0 < page[2].p <= 1
    empty = langid.train(table.limit(0))
    assert langid.fuse(langid.text_evidence(langid.document_rows(table.limit(0)), empty), empty).count() == 0


def test_hosts(spark):
    urls = ["https://u@Example.COM:80/a?b", "ftp://h/x", "nonsense", "", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r.h for r in df.select(langid.host_of(F.col("u")).alias("h")).collect()] == ["example.com", "h", None, None, None]


# -- 5 -----------------------------------------------------------------------------------------------------------

ITEMS = "item_id long, text string"
PLAIN = "The slow red boat went over the wide river while two old men sang on the far bank all night."


def test_decontamination(spark, monkeypatch):
    question = "A farmer named Johnson sells 12 apples for 5 dollars and then Johnson buys 12 pears at the market near town."
    items = spark.createDataFrame([(1, question), (2, "one two three"), (3, None), (4, "7 8 9"), (None, question), (1, question), (5, PLAIN)], ITEMS)
    other = question.replace("12", "40").replace("Johnson", "Miller")
    clash = question.replace("12", "40", 1)
    rows = [(1, "Before. " + question + " After."), (2, other), (3, clash), (4, None), (5, ""), (6, "nothing of the kind " * 50), (7, "so one two three end"), (8, "1 2 3 4 5 6 7 8 9"), (1, "again " + question), (10, "AND SO. " + PLAIN.upper())]
    for limit in (200_000, 0):
        monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", limit)
        got = {(r.doc_id, r.item_id): r.reparameterised for r in decontam.contaminated(docs(spark, rows, extra=True), items).collect()}
        assert got == {(1, 1): False, (2, 1): True, (10, 5): False}
    assert decontam.contaminated(docs(spark, []), items).count() == 0
    assert decontam.contaminated(docs(spark, rows), items.limit(0)).count() == 0


def test_template_keeps_token_count(spark):
    texts = ["He saw John Smith pay $3,500.75 for 12 kg.", "  (Hello) \n World-wide 5km!  ", "...", "", "É. Ça va Paul?"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(decontam.words(F.col("t")).alias("w"), decontam.template(F.col("t")).alias("m")).collect():
        assert len(r.w) == len(r.m)


# -- 6 -----------------------------------------------------------------------------------------------------------


def near_copies(r, n_groups=12, size=6):
    rows, k = [], 0
    for _ in range(n_groups):
        words = prose(r, r.randint(30, 120)).split()
        for _ in range(size):
            copy = list(words)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = "edit%d" % r.randint(0, 9)
            rows.append((k, " ".join(copy)))
            k += 1
    return rows


@pytest.mark.parametrize("tile, bucket", [(2048, 64), (3, 4)])
def test_jaccard(spark, monkeypatch, tile, bucket):
    monkeypatch.setattr(shingles, "TILE", tile)
    monkeypatch.setattr(shingles, "BUCKET", bucket)
    rows = near_copies(random.Random(11))
    rows += [(1000, rows[0][1].upper()), (1001, None), (1002, ""), (1003, "one two"), (1004, "One  two"), (1005, "one")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in shingles.jaccard_classes(docs(spark, rows, extra=True)).collect()}
    assert got == shingles.brute_force_classes(rows)


def test_jaccard_edges(spark):
    assert shingles.jaccard_classes(docs(spark, [])).count() == 0
    rows = [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e")]
    got = sorted((str(r.doc_id), r.n_links, r.kept) for r in shingles.jaccard_classes(docs(spark, rows)).collect())
    assert got == [("1", 0, True), ("None", 0, True)]
    assert shingles.runs_needed(0.8, 0.999) > shingles.runs_needed(0.8, 0.9) >= 1


# -- 7 -----------------------------------------------------------------------------------------------------------


def test_bpe_joins():
    tokenizer = bpe.load(bpe.default_tokenizer())
    r = random.Random(1)
    parts = ["a", "b", "é", "日", " ", "\n", "'s", "<|endoftext|>", "1", "  ", "😀", "-", "x" * 9]
    for k in range(300):
        text = "".join(r.choice(parts[: r.randint(1, len(parts))]) for _ in range(r.randint(2, 400)))
        text = r.choice(["a", " ", "ab", "\n"]) * r.randint(10, 500) + text if k % 5 == 0 else text
        assert bpe.encode_long(tokenizer, text, r.choice([16, 50, 200])).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_bpe_job(spark):
    r = random.Random(2)
    rows = [(1, None), (2, ""), (3, "<|endoftext|> x"), (4, prose(r, 3000)), (5, "z" * 5000), (None, "né"), (4, "twice")]
    path = bpe.default_tokenizer()
    tokenizer = bpe.load(path)
    got = sorted((str(x.doc_id), x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in bpe.digests(bpe.bpe_encode(docs(spark, rows, True), path, 700), path).collect())
    assert got == sorted((str(k), *bpe.reference_digest(tokenizer, t)) for k, t in rows)
    assert bpe.digests(bpe.bpe_encode(docs(spark, []), path), path).count() == 0


def test_bpe_round_trip_in_one_pass(spark):
    """Equal rows, null ids and texts of many levels of pieces, against the library."""
    r = random.Random(71)
    long = [(k, prose(r, r.choice([40, 300, 900]))) for k in (1, 1, 2, None)]
    rows = long + long[:2] + [(3, None), (3, ""), (None, None), (4, "a<|endoftext|>b" * 90), (5, " " * 3000), (6, "日本語" * 500), (7, "x" * 5000)]
    path = bpe.default_tokenizer()
    tokenizer = bpe.load(path)
    want = sorted((str(k), *bpe.reference_digest(tokenizer, t)) for k, t in rows)
    for size in (64, 700, bpe.PIECE_CHARS):
        got = bpe.round_trip(docs(spark, rows, True), path, size).collect()
        assert sorted((str(x.doc_id), x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in got) == want
    assert bpe.round_trip(docs(spark, []), path).count() == 0


def test_bpe_table_decodes_as_the_library():
    tokenizer = bpe.load(bpe.default_tokenizer())
    turn = bpe.Decoder(tokenizer)
    assert turn.table is not None
    r = random.Random(72)
    size = tokenizer.get_vocab_size()
    for _ in range(500):
        ids = [r.randrange(size) for _ in range(r.randint(0, 40))]
        assert turn(ids) == tokenizer.decode(ids, skip_special_tokens=False)
    assert turn([5, size + 9, 6]) == tokenizer.decode([5, size + 9, 6], skip_special_tokens=False)


# -- 8 -----------------------------------------------------------------------------------------------------------


def test_kneser_ney(spark):
    import re
    import zlib

    r = random.Random(6)
    rows = [(i, prose(r, r.randint(0, 60), 40)) for i in range(120)] + [(500, None), (501, ""), (502, "NEVER seen Words")]
    model = kneser.train(docs(spark, rows, True))
    got = {x.doc_id: x for x in kneser.score(docs(spark, rows), model).collect()}
    tokens = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None] for i, t in rows}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train for w in tokens[i])
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for i in train for p in zip([0] + tokens[i][:-1], tokens[i]))
    total, follow, contexts = Counter(), defaultdict(lambda: [0] * 4), Counter()
    for (u, w), k in pairs.items():
        total[u] += k
        follow[u][min(k, 3)] += 1
        contexts[w] += 1
    d2 = kneser.discounts(np.array([sum(x == k for x in pairs.values()) for k in (1, 2, 3, 4)]))
    d1 = kneser.discounts(np.array([sum(x == k for x in contexts.values()) for k in (1, 2, 3, 4)]))
    floor = sum(d1[min(x, 3)] for x in contexts.values()) / len(pairs)

    def p1(w):
        return max(contexts[w] - d1[min(contexts[w], 3)], 0) / len(pairs) + floor / (v + 1)

    def p(u, w):
        if not total[u]:
            return p1(w)
        k = pairs.get((u, w), 0)
        return max(k - d2[min(k, 3)], 0) / total[u] + sum(d2[j] * follow[u][j] for j in (1, 2, 3)) / total[u] * p1(w)

    for i, _ in rows:
        x = got[i]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), n)
        assert math.isclose(x.score, sum(math.log10(p(u, w)) for u, w in zip([0] + tokens[i][:-1], tokens[i])), rel_tol=1e-9)
        assert math.isclose(x.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens[i]), rel_tol=1e-9)
        assert x.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
    some = max(total, key=lambda u: total[u])
    assert math.isclose(sum(p(some, w) for w in c) + p(some, b"unknown word"), 1.0, rel_tol=1e-9)


def test_kneser_ney_empty(spark):
    assert kneser.score(docs(spark, []), kneser.train(docs(spark, []))).count() == 0
    got = kneser.score(docs(spark, [(1, "a b")]), kneser.train(docs(spark, []))).first()
    assert got.n_tokens == 3 and got.n_known == 0 and got.score == 0.0


# -- 9 -----------------------------------------------------------------------------------------------------------


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def mutated(r, s, n):
    s = list(s)
    for _ in range(n):
        k, i = r.random(), r.randrange(len(s))
        if k < 0.34:
            s[i] = r.choice("abé")
        elif k < 0.67:
            del s[i]
        else:
            s.insert(i, r.choice("abé"))
    return "".join(s)


def test_banded_distance():
    r = random.Random(3)
    for tau in (1, 2, 3):
        a = ["".join(r.choice("abé") for _ in range(r.randint(6, 24))) for _ in range(400)]
        b = [mutated(r, s, r.randint(0, tau + 2)) for s in a]
        got = lines.bucket_pairs([x.encode() for x in a + b], np.arange(400), np.arange(400, 800), tau)
        assert got.tolist() == [distance(x, y) <= tau for x, y in zip(a, b)]


@pytest.mark.parametrize("bucket", [512, 3])
def test_line_dedup(spark, monkeypatch, bucket):
    monkeypatch.setattr(lines, "BUCKET", bucket)
    r = random.Random(8)
    pool = ["".join(r.choice("abcdé ") for _ in range(r.randint(20, 60))).strip() + "." for _ in range(12)]
    cases = {}
    for i in range(40):
        cases[i] = "\n".join(mutated(r, r.choice(pool), r.choice([0, 0, 1, 2, 4])) if r.random() < 0.8 else r.choice(["", "ab", "short line here"]) for _ in range(r.randint(1, 6)))
    cases[40], cases[41] = None, ""
    got = {x.doc_id: x for x in lines.dedup_lines(docs(spark, list(cases.items()), True)).collect()}
    every = [((i << lines.LINE_BITS) + k, t) for i in sorted(cases) for k, t in enumerate((cases[i] or "").split("\n")) if len(t) >= lines.MIN_CHARS]
    first = {}
    for lid, t in every:
        first.setdefault(t, lid)
    long = [t for t in first if len(t) >= lines.MIN_EDIT_CHARS]
    pairs = [(first[a], first[b]) for x, a in enumerate(long) for b in long[x + 1 :] if distance(a, b) <= lines.TAU]
    root = {v: v for v in first.values()}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    for i, text in cases.items():
        dup = [(k, root[first[t]]) for k, t in enumerate((text or "").split("\n")) if len(t) >= lines.MIN_CHARS and root[first[t]] != (i << lines.LINE_BITS) + k]
        assert [(d.line, d.class_lid) for d in got[i].dup_lines] == dup
        gone = {k for k, _ in dup}
        assert (got[i].text or "") == "\n".join(t for k, t in enumerate((text or "").split("\n")) if k not in gone)
    assert got[40].text is None and got[0].rep == 2


def test_line_dedup_edges(spark):
    assert lines.dedup_lines(docs(spark, [])).count() == 0
    rows = [(None, "same line"), (1, "same line"), (1, "same line"), (2, "same line")]
    got = sorted((str(x.doc_id), x.text) for x in lines.dedup_lines(docs(spark, rows)).collect())
    assert got[0][1] == "same line" and ("None", "same line") in got and ("2", "") in got


# -- 10 ----------------------------------------------------------------------------------------------------------


def toxic_rows(r, n=400):
    bad = ["grobel", "snirtek", "flomunt"]
    rows, marks = [], []
    stems = ["".join(r.choice("abcde") for _ in range(5)) for _ in range(300)]
    for i in range(n):
        words = [r.choice(stems) for _ in range(r.randint(20, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(r.randint(1, 3)):
                words.insert(r.randrange(len(words)), r.choice(bad) + r.choice(["", "s", "ing", "."]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    return rows, marks


def test_toxicity(spark):
    rows, marks = toxic_rows(random.Random(4))
    rows += [(1000, None), (1001, ""), (None, "grobel"), (1002, "fine words " * 5000)]
    labels = spark.createDataFrame(marks + [(None, 1), (7, None)], "doc_id long, toxic int")
    table = docs(spark, rows, True)
    model = toxicity.train(table, labels)
    out = toxicity.score(table, model).collect()
    got = {x.doc_id: x for x in out}
    assert len(out) == len(rows) and all(0 <= x.score <= 1 for x in out)
    assert sum(got[i].predicted == t for i, t in marks) >= 0.98 * len(marks)
    assert got[1000].predicted == got[1001].predicted == got[1002].predicted == 0
    texts = dict(rows)
    for x in out:
        for s in x.spans:
            word = texts[x.doc_id].encode()[s.start : s.end].decode()
            assert word.startswith(("grobel", "snirt", "flomunt"))
    kept = toxicity.without_toxic(table, model)
    assert kept.columns == table.columns and {x.doc_id for x in kept.collect()} == {x.doc_id for x in out if not x.predicted}
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_marginals_equal_whole_chain():
    r = np.random.default_rng(1)
    model = toxicity.Model(np.arange(1, 4, dtype=np.uint64), np.array([3.0, -1.0, 2.0]), -1.5, np.array([[0.4, -0.3], [-0.2, 0.7]]))
    for _ in range(40):
        n = int(r.integers(1, 15))
        known = r.integers(-1, 3, size=(n, 1)).astype(np.int32)
        first = np.array([0, n])
        at, p = toxicity.marginals(model, known, first)
        emit = toxicity._emissions(known, model.weights, model.bias)[None]
        whole, _ = toxicity._chain(emit, model.transitions, np.ones((1, n), bool))
        assert np.allclose(whole[0][at], p)


def test_toxicity_without_labels(spark):
    table = docs(spark, [(1, "a b"), (2, None)])
    model = toxicity.train(table, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {x.predicted for x in toxicity.score(table, model).collect()} == {0}


def test_line_dedup_clashing_names(spark):
    """Columns of the operator's own names are replaced; other rows and columns stay."""
    rows = [(1, "same line of text\nown words"), (2, "same line of text\nother words"), (3, None), (None, "same line of text")]
    df = docs(spark, rows).withColumns({"n_lines": F.lit("x"), "n_removed": F.lit("y"), "dup_lines": F.lit(None).cast("int"), "h": F.lit(4)})
    got = {(r.doc_id, r.text, r.n_lines, r.n_removed, r.h) for r in lines.dedup_lines(df).collect()}
    assert got == {(1, "same line of text\nown words", 2, 0, 4), (2, "other words", 2, 1, 4), (3, None, 1, 0, 4), (None, "same line of text", 1, 0, 4)}


def test_toxicity_repeats_and_null_ids(spark, tmp_path):
    """Equal rows have equal scores; a null id is not held out; the query gives a row a row."""
    r = random.Random(91)
    rows = [(k, prose(r, 30) + (" vile scum" if k % 2 else "")) for k in range(300)]
    rows += [rows[3], (None, "vile scum"), (None, None), (7, "")]
    path = str(tmp_path)
    docs(spark, rows, extra=True).write.parquet(path + "/documents.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(300)] + [(None, 1)], "doc_id long, toxic int").write.parquet(path + "/labels.parquet")
    got = toxicity.op10_toxicity_crf(spark, path).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.held_out is not None for x in got)
    assert len({x.score for x in got if x.doc_id == 3}) == 1
    assert [x.held_out for x in got if x.doc_id is None] == [False, False]
    held = [x for x in got if x.held_out and x.doc_id != 7]
    assert sum(x.predicted == x.doc_id % 2 for x in held) >= 0.9 * len(held)
