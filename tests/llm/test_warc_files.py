"""Archives of bounded bytes, and payloads that many pages share."""

from collections import Counter

from pyspark.sql import functions as F

from lintlake.llm import warc


def test_files_follow_the_mean_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 100_000)
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("x"), 5_000).alias("html")).coalesce(1)
    assert warc.captures_a_file(pages) == 20
    assert warc.captures_a_file(pages.limit(0)) == warc.FILE_CAPTURES
    assert warc.captures_a_file(spark.createDataFrame([(1, "u", "x" * 200_000)], "page_id long, url string, html string")) == 1
    path = str(tmp_path / "w")
    warc.write_warc(warc.plan_captures(pages).coalesce(1), path, file_captures=20)
    names = list((tmp_path / "w").glob("part*"))
    assert len(names) == 15
    assert warc.read_warc(spark, path).groupBy("record_type").count().count() == 4


def test_one_payload_on_most_pages(spark):
    rows = [(k % 400, "u", "hot" if k % 3 else f"own {k}") for k in range(900)] + [(None, "u", "hot")] * 5 + [(None, "u", None)] * 2
    got = warc.plan_captures(spark.createDataFrame(rows, "page_id long, url string, html string"), 1).collect()
    top = max(p for p, _, h in rows if h == "hot" and p is not None)
    largest = {}
    for p, _, h in rows:
        if h and p is not None:
            largest[h] = max(largest.get(h, p), p)
    want = Counter((p, h or "", "revisit" if h and p != largest[h] else "response", largest[h] if h and p != largest[h] else None) for p, _, h in rows)
    assert Counter((r.page_id, r.html, r.record_type, r.refers_to_id) for r in got) == want
    again = Counter((r.page_id, r.html) for r in got)
    assert {(r.page_id, r.html, r.occurrence) for r in got} == {(p, h, n + 1) for (p, h), m in again.items() for n in range(m)}
    assert top == largest["hot"]
