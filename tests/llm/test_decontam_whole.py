"""Passages that templates of one alignment do not find."""

from lintlake.llm import decontam


def found(spark, texts, item):
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in decontam.contaminated(docs, items).collect()}


def test_copy_of_an_item_of_names_and_numbers(spark):
    item = "The list: Paris 12 Rome 15 Berlin 9 Madrid 31 Vienna 40 Prague 8 Warsaw 77 Lisbon 6"
    other = item.replace("Rome", "Oslo").replace("31", "32").replace("Prague", "Sofia").replace("Vienna", "Dublin")
    assert found(spark, ["So then. " + item + " and more words", other], item) == {0}


def test_consistent_copy_after_an_inconsistent_one(spark):
    item = "A farmer named Johnson sells 12 apples for 5 dollars and then Johnson buys 12 pears at the market near town."
    clash = item.replace("12", "40", 1)
    assert found(spark, [clash + " Well. " + item, clash + " Well. " + clash, clash], item) == {0}


def test_words_inserted_or_left_out_inside(spark):
    item = "the slow red boat went over the wide river while two old men sang loudly on the far bank all night until morning"
    w = item.split()
    more = " ".join([*w[:11], "very", "quietly", *w[11:]])
    less = " ".join([*w[:11], *w[12:]])
    far = " ".join([*w[:11], *["word"] * 30, *w[11:]])
    assert found(spark, ["so " + more + " end", less, far, " ".join(w[:11])], item) == {0, 1}


def test_names_in_a_text_of_one_case(spark):
    item = "Yesterday Anna Schmidt met Peter Weber in Hamburg and Maria Fischer drove Paul Wagner from Bremen to Kiel by car"
    assert found(spark, ["SO. " + item.upper(), "so " + item.lower() + " end", item.title(), "so " + " ".join(item.split()[:9])], item) == {0, 1, 2}


def test_short_items_anywhere(spark):
    """Asked for, an item shorter than a window is found inside a text; numbers and names in it must be the same."""
    items = spark.createDataFrame([(1, "four words right here"), (2, "7 8"), (3, "  "), (4, "Oslo")], "item_id long, text string")
    texts = ["so Four words, right here and on", "four words left here", "1 7 8 9", "17 8", "in oslo.", None, "four words right here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items, short_items=True).collect()}
    assert got == {(0, 1), (2, 2), (4, 4), (6, 1)}
    assert {r.doc_id for r in decontam.contaminated(docs, items).collect()} == {6}


def test_words_by_words_and_by_text(spark):
    """The word-by-word template is that of the steps over the whole text."""
    from pyspark.sql import functions as F

    texts = [
        "He saw John Smith pay $3,500.75 for 12 kg.", "  Hello (World) wide 5km! ", "...", "", None, "É. Ça va Paul? 7 days, 3 km/h",
        "A 5 Kg bag (of 2 lb) -- Mr. O'Neil's; NASA's 1.2.3 \u0661\u0662 days", "don't-stop «Ici» Straße 5 m", "x" * 3000 + " 9 min",
    ]
    df = decontam._typed(spark.createDataFrame([(t,) for t in texts], "text string"), lambda t: t).withColumn("old", decontam.template(F.col("text")))
    for r in df.collect():
        assert r.tokens == r.old and len(r.plain) == len(r.words)
