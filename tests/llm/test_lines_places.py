"""Lines of documents whose ids or lengths leave no room for plain places."""

import pytest

from lintlake.llm import lines

BIG = "the same long line of words that stands here"


def kept(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        keep = [t for t in text.split("\n") if not (t and (t in seen or seen.add(t)))]
        out[i] = "\n".join(keep)
    return out


@pytest.mark.parametrize("ids", [(1, 2, 3), (-(2**63), 5, 2**63 - 1), (2**39 - 1, 2**39, 2**62), (-(2**39), -4, 0)])
def test_any_id(spark, ids):
    rows = [(ids[2], f"{BIG}\nlast\n\nlast"), (ids[0], f"first\n{BIG}"), (ids[1], f"{BIG}\nfirst\nmiddle")]
    got = lines.dedup_lines(spark.createDataFrame([*rows, (None, BIG)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got if r.doc_id is not None} == kept(rows)
    assert [r.text for r in got if r.doc_id is None] == [BIG]


def test_more_lines_than_a_unit(spark, monkeypatch):
    monkeypatch.setattr(lines, "LINE_BITS", 3)
    rows = [(7, "\n".join(f"line {k % 13}" for k in range(40))), (2, "\n".join(f"line {k}" for k in range(9))), (9, "line 40\nline 3\nnew")]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == kept(rows)
    assert {r.doc_id: r.n_removed for r in got} == {2: 0, 7: 40 - 4, 9: 1}


def test_many_repeated_lines_of_one_document(spark):
    rows = [(1, "\n".join(f"a {k % 1000}" for k in range(60_000)))]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == kept(rows) and got[0].n_removed == 59_000
