"""Short equal lines."""

from lintlake.llm import lines


def test_short_equal_lines_are_removed(spark):
    rows = [(1, "To.\n\nfirst words here"), (2, "x\nTo.\n\nx"), (3, "x")]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "To.\n\nfirst words here", 2: "x\n", 3: ""}
