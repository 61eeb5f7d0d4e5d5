"""Phrase mining against counting everything."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintlake.llm import phrases


def plain(rows, min_count, top):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, 5):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        gone = set()
        for q, a in good.items():
            for i in range(len(q)):
                for j in range(i + 2, len(q) + 1):
                    if j - i < len(q) and 100 * a >= 80 * f[q[i:j]]:
                        gone.add(q[i:j])
        rows = []
        for p, a in good.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def sample(r):
    stock = ["the", "of", "Über", "éa", "x", "long", "tail", "NEW", "york", "city", "a\x0bb", "b", "\U0001f600"]
    fixed = ["new york city hall", "of the", "long tail b", "x x x x x", "über éa"]
    rows = []
    for _ in range(150):
        text = "".join(r.choice([r.choice(stock), r.choice(fixed)]) + r.choice([" ", " ", " ", "\t ", ". ", ",", "\n"]) for _ in range(r.randint(0, 25)))
        rows.append((r.choice(["en", "en", "en", "de", None, "und", ""]), r.choice([text, text, text, None]) if r.random() < 0.1 else text))
    return rows + [("one", "only once here"), ("en", "new york city " * 400)]


@pytest.mark.parametrize("top,first", [(3, 2), (10, 4), (2000, 6000)])
def test_phrases(spark, top, first):
    """With few phrases asked for, several rounds with ever lower scores; with many, all at once."""
    rows = sample(random.Random(top))
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({"n": F.lit("x"), "w1": F.lit(1), "word": F.lit(None)})
    got = phrases.mine_phrases(df.repartition(3), 4, top, first).collect()
    assert sorted(tuple(x) for x in got) == plain(rows, 4, top)


def test_phrases_in_small_portions(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FIRST_RANK", 1)
    rows = [("en", "a b c d e. " * 40), ("en", "a b x " * 31), ("fr", "a b"), ("fr", None), (None, "q r " * 30)]
    assert sorted(tuple(x) for x in phrases.mine_phrases(spark.createDataFrame(rows, "lang string, text string")).collect()) == plain(rows, 30, 2000)


def test_no_phrases(spark):
    assert phrases.mine_phrases(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert phrases.mine_phrases(spark.createDataFrame([("en", ""), (None, "a b")], "lang string, text string")).collect() == []


def test_score_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_007
    df = spark.createDataFrame([(big, big, big), (7, 9, 12)], "a long, l long, r long")
    assert [x.s for x in df.select(phrases._score("a", "l", "r").alias("s")).collect()] == [1_000_000, 2_000_000 * 7 // 21]


def test_distinct_of_wide_numbers():
    r = np.random.default_rng(1)
    columns = [r.choice([0, 5, 1 << 40, (1 << 61) + 3], 500) for _ in range(4)]
    found, times = phrases._distinct(columns)
    assert Counter(zip(*(c.tolist() for c in columns))) == dict(zip(zip(*(c.tolist() for c in found)), times.tolist()))
