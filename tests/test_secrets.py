"""The hint that lines must match loses no secret; rules fire on every provider's format."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from lintlake.operators import detect


def test_hint_covers_every_rule(spark):
    """Random lines made of pieces of tokens and assignments: the same findings as each rule's pattern by itself."""
    r = random.Random(5)
    pieces = [
        "ghp_", "gho_", "AKIA", "ASIA", "xoxb-", "xoxs-", "AIza", "sk_live_", "rk_live_", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "eyJ", ".eyJ", ".", " ", "password", "API-KEY",
        "Private_Key", "credential", "s", "_1", " = ", ":", '"', "'", "change-me", "A1B2C3D4E5F6G7H8", "a9f3kd82mz01qpwo", "x" * 35, "-", "İ", "é",
    ]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(1, 9))) for _ in range(4000)]
    texts += ["ghp_" + "a1" * 10, "AKIA" + "B2" * 8, "AIza" + "c" * 35, "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", 'TOKEN = "q8Zr2LmV"', ""]
    lines = spark.createDataFrame([("p", "f", i, t) for i, t in enumerate(texts)] + [("p", "f", -1, None)], "project_id string, rel_path string, line int, text string")
    got = {}
    for row in detect.scan_secrets(lines).collect():
        got.setdefault(row.line, set()).add(row.rule_id)
        assert row.line >= 0
    columns = [F.col("text").rlike(pattern).alias(name) for name, _, pattern in detect.SECRET_RULES]
    plain = lines.where("text is not null").select("line", F.regexp_extract("text", detect.ASSIGNMENT, 1).alias("value"), *columns).collect()
    for row in plain:
        want = {name for name, _, _ in detect.SECRET_RULES if row[name]}
        bits = -sum(n / len(row.value) * math.log2(n / len(row.value)) for n in Counter(row.value).values())
        if not want and row.value and row.value != "change-me" and bits >= detect.MIN_ENTROPY:
            want = {"secret"}
        assert got.get(row.line, set()) == want, texts[row.line]
    assert {n for names in got.values() for n in names} >= {"secret", "github-token", "aws-access-key", "google-api-key", "jwt", "private-key"}
