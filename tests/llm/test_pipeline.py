"""The pipeline on a small corpus, stage by stage against plain Python."""

import random

import corpus_pipeline
from lintlake.llm import bpe, lines, shingles
from test_llm_exact import distance, prose, toxic_rows

BENCH = "The slow red boat went over the wide river while two old men sang on the far bank all night."


def without_repeated_lines(docs):
    every = [(d, k, t) for d in sorted(docs) for k, t in enumerate((docs[d] or "").split("\n")) if len(t) >= lines.MIN_CHARS]
    first, gone = {}, set()
    for d, k, t in every:
        if t in first:
            gone.add((d, k))
        first.setdefault(t, (d, k))
    long = [t for t in first if len(t) >= lines.MIN_EDIT_CHARS]
    for x, a in enumerate(long):
        for b in long[x + 1 :]:
            if abs(len(a) - len(b)) <= lines.TAU and distance(a, b) <= lines.TAU:
                gone.add(max(first[a], first[b]))
    return {d: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in docs.items()}


def test_pipeline(spark, tmp_path):
    r = random.Random(12)
    rows, marks = toxic_rows(r, 120)
    toxic = {i for i, t in marks if t}
    texts = dict(rows)
    clean = [i for i in texts if i not in toxic]
    base = prose(r, 80)
    texts[500] = base
    texts[501] = base.replace(base.split()[40], "exchanged", 1)
    texts[502] = texts[clean[0]] + "\n" + prose(r, 30)
    texts[503] = prose(r, 20) + ".\n" + BENCH + "\n" + prose(r, 20)
    texts[504], texts[505] = None, ""
    texts[506] = base[:-1] + "!"
    sf = str(tmp_path / "sf")
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(sf + "/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in marks], "doc_id long, quality int, toxic int").write.parquet(sf + "/labels.parquet")
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(sf + "/benchmark.parquet")

    left = without_repeated_lines({i: t for i, t in texts.items() if i not in toxic})
    classes = shingles.brute_force_classes(list(left.items()))
    left = {i: t for i, t in left.items() if classes[i][0] == i}
    left = {i: t for i, t in left.items() if BENCH not in (t or "")}
    assert 501 not in left and 503 not in left and texts[502].startswith(texts[clean[0]]) and not left[502].startswith(texts[clean[0]])
    tokenizer = bpe.load(bpe.default_tokenizer())
    got = {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in corpus_pipeline.run(spark, sf).collect()}
    assert got == {i: bpe.reference_digest(tokenizer, t) for i, t in left.items()}

    docs = spark.read.parquet(sf + "/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
