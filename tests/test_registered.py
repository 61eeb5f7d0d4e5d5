"""A detector of our own, rule counts, and entropy over whole texts."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lintlake.functions.scalars import shannon_entropy
from lintlake.operators import governance as G
from lintlake.operators.scan import detectors, register_detector, unregister_detector
from lintlake.plans.queries import QUERIES
from lintlake.plans import stored  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_registered_detector_is_gone_after_its_query(spark):
    before = set(detectors())
    assert QUERIES["x1_register_detector"](spark, SF).count() > 0
    assert set(detectors()) == before


def test_unregister_leaves_built_in_detectors():
    register_detector("ours", lambda files: files)
    unregister_detector("ours")
    unregister_detector("python")
    assert "ours" not in detectors() and "python" in detectors()


def test_rule_ids_are_counted_once(spark):
    rules = G.known_rules()
    assert len(set(rules)) == len(rules)
    assert QUERIES["a1_engines"](spark, SF).agg(F.max("rules_executed")).first()[0] == len(rules)


@pytest.mark.parametrize("text", ["", "a", "abab", "😀😀ab", "ab\ncd\n", "x" * 50_000 + "y"])
def test_entropy_counts_code_points(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(shannon_entropy(F.col("t"))).first()[0]
    n = len(text)
    assert got == pytest.approx(-sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0)
