"""Benchmark decontamination by templates: typed placeholders, window hash join, slot consistency.

Everything is DataFrame functions. A text's template has the same number of tokens as the text: names
(capitalised words inside a sentence), numbers and units after numbers become placeholders, the rest is
lower-cased and stripped of outer punctuation. A document is contaminated by an item when windows of five
template tokens, on any alignment or on neighbouring ones together, cover at least 80 % of the item's tokens
and every value of the item's slots stands for one value in the document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintlake.plans.lineage import written

WIDTH = 5
COVERAGE = 0.8
#: Literal tokens that a window must have to be looked up by its template; all are looked up by their words.
MIN_LITERALS = 3
#: Words by which alignments may differ and still be added up (insertions less deletions inside a passage).
SHIFT = 8
#: Benchmark windows up to which they are broadcast (about 20 bytes each).
BROADCAST_WINDOWS = 200_000
#: Bytes of the table that tells which windows are worth a look, at most.
SLOTS = 1 << 20

NAME, NUMBER, UNIT = "\u0001", "\u0002", "\u0003"
_SPACE = r"[\t\n\x0B\f\r ]"
#: Units of measure; fixed values.
UNITS = (
    "mm cm dm m km mg g kg t ml cl l s sec min h hr hrs hz khz mhz ghz kb mb gb tb w kw kwh v ma ah "
    "inch inches foot feet ft yard yards mile miles ounce ounces pound pounds lb lbs gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms "
    "liter liters litre litres dollar dollars cent cents euro euros percent degree degrees"
).split()

#: (pattern, replacement with $1) in order; also used, in its own dialect, by the SQL form.
STEPS = [
    (rf"(^|[.!?:;][\"')\]]*{_SPACE}+)(\p{{Lu}})", "$1\u0004$2"),  # a sentence's first word is not a name
    # a word in capitals throughout is none either
    (rf"(^|{_SPACE})\p{{Lu}}\p{{Ll}}[\p{{L}}\p{{M}}'’-]*", f"$1{NAME}"),
    (r"\p{Nd}+(?:[.,:/]\p{Nd}+)*", NUMBER),
]
LATE_STEPS = [
    (rf"{NUMBER}({_SPACE}?)(?:{'|'.join(UNITS)})(^|[^\p{{L}}\p{{N}}]|$)", f"{NUMBER}$1{UNIT}$2"),
    (rf"(^|{_SPACE})[\p{{P}}\p{{S}}]+([\p{{L}}\p{{N}}\x01\x02\x03])", "$1$2"),
    (rf"([\p{{L}}\p{{N}}\x01\x02\x03])[\p{{P}}\p{{S}}]+({_SPACE}|$)", "$1$2"),
]


_LETTER = r"[\p{L}\p{N}\x01\x02\x03]"
_OUTER = rf"^[\p{{P}}\p{{S}}]+(?={_LETTER})|(?<={_LETTER})[\p{{P}}\p{{S}}]+$"
_SENTENCE_END = r"[.!?:;][\"')\]]*$"
_NAME = r"^\p{Lu}\p{Ll}[\p{L}\p{M}'’-]*"
_OWN_UNIT = rf"{NUMBER}(?:{'|'.join(UNITS)})([^\p{{L}}\p{{N}}]|$)"
_UNIT = rf"^(?:{'|'.join(UNITS)})([^\p{{L}}\p{{N}}]|$)"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"{_SPACE}+"), lambda w: w != "")


def _bare(token: Column) -> Column:
    """A token without outer punctuation; one of punctuation alone stays."""
    return F.regexp_replace(token, _OUTER, "")


def _typed(df: DataFrame, form: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """Add ``words``, ``plain`` (``form`` of the lower-cased words without outer punctuation) and ``tokens`` (``form``
    of the template), all three as long as the text has words.

    A word of small letters alone is its own plain token, and its own template token unless it is a unit after a
    number, so only other words are looked at closely.
    """
    # a text's first word begins a sentence, unless space comes before it (its first character is a space)
    first = ~F.ascii(F.substring(F.col(text), 1, 1)).isin(9, 10, 11, 12, 13, 32)
    out = df.withColumn("words", words(F.col(text)))
    out = out.withColumn("__small", F.transform("words", lambda w: w.rlike(r"^\p{Ll}+$")))
    small = lambda i: F.get("__small", i)
    # an array that a lambda names only once would be worked out anew for every element; zip_with takes it as an argument
    out = out.withColumn("plain", F.zip_with("words", "__small", lambda w, plain: form(F.when(plain, w).otherwise(_bare(F.lower(w))))))

    def close(w: Column, i: Column) -> Column:
        begins = F.when(i == 0, first).otherwise(F.get("words", i - 1).rlike(_SENTENCE_END))
        named = F.when(begins, w).otherwise(F.regexp_replace(w, _NAME, NAME))
        return F.regexp_replace(F.lower(F.regexp_replace(named, STEPS[2][0], NUMBER)), _OWN_UNIT, f"{NUMBER}{UNIT}$1")

    def token(w: Column, i: Column) -> Column:
        after_number = (i > 0) & ~small(i - 1) & F.get("words", i - 1).rlike(r"\p{Nd}$")
        special = w.rlike(r"[\p{Lu}\p{Nd}]")
        unit = F.regexp_replace(F.when(special, close(w, i)).otherwise(F.lower(w)), _UNIT, f"{UNIT}$1")
        return (
            F.when(after_number, form(_bare(unit)))
            .when(small(i), F.get("plain", i))
            .when(special, form(_bare(close(w, i))))
            .otherwise(F.get("plain", i))
        )

    return out.withColumn("tokens", F.transform("words", token)).drop("__small")


def template(text: Column) -> Column:
    """Template tokens of a text, as many as it has words: the rule as steps over the whole text."""
    out = F.coalesce(text, F.lit(""))
    for pattern, by in STEPS:
        out = F.regexp_replace(out, pattern, by)
    out = F.lower(F.translate(out, "\u0004", ""))
    for pattern, by in LATE_STEPS:
        out = F.regexp_replace(out, pattern, by)
    return words(out)


def _window_hash(hashes: str, i: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(hashes, i + k) for k in range(width)])


def item_windows(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with their tokens, and their windows: all by plain tokens, those with enough literals by template too.

    ``width`` is that of the window: WIDTH, or the item's length if it is shorter; ``typed`` tells a template's hash.
    """
    base = (
        items.where(F.col("item_id").isNotNull() & F.col("text").rlike(r"[^\t\n\x0B\f\r ]"))
        .select(F.col("item_id").cast("long").alias("item_id"), "text")
        .dropDuplicates(["item_id"])
    )
    base = _typed(base, lambda t: t).select(
        "item_id", F.transform("words", F.lower).alias("item_raw"), F.col("tokens").alias("item_tokens"), F.col("plain").alias("item_plain")
    )
    literal = lambda t: ~t.isin(NAME, NUMBER, UNIT)
    last = F.greatest(F.size("item_tokens") - WIDTH, F.lit(0))
    each = base.select(
        "item_id", "item_tokens", F.least(F.size("item_tokens"), F.lit(WIDTH)).alias("width"),
        F.col("item_plain").alias("plain"), F.col("item_tokens").alias("tokens"), F.explode_outer(F.sequence(F.lit(0), last)).alias("item_pos"),
    )
    enough = F.size(F.filter(F.slice("item_tokens", F.col("item_pos") + 1, WIDTH), literal)) >= F.least(F.lit(MIN_LITERALS), F.size("item_tokens"))
    each = each.withColumn("enough", enough).withColumns({name: F.transform(name, lambda t: F.xxhash64(t)) for name in ("plain", "tokens")})
    by_words, by_template = (_window_hash(c, F.col("item_pos"), WIDTH) for c in ("plain", "tokens"))
    hashes = F.array_distinct(F.when(F.col("enough"), F.array(by_words, by_template)).otherwise(F.array(by_words)))
    each = each.select("item_id", "item_pos", "width", F.when(F.col("enough"), by_template).alias("typed"), F.explode_outer(hashes).alias("hash"))
    return base.drop("item_plain"), each.withColumn("typed", F.coalesce(F.col("typed") == F.col("hash"), F.lit(False)))


def _slots(wanted: DataFrame, slots: int) -> Column:
    """A byte for each of ``slots`` places, "1" where a wanted hash falls: at most SLOTS bytes, whatever the benchmark's size."""
    place = wanted.select(F.pmod("hash", F.lit(slots)).cast("int").alias("at")).agg(F.array_sort(F.collect_set("at")).alias("at"))
    gap = lambda at, i: at - F.when(i == 0, F.lit(-1)).otherwise(F.get("at", i - 1))
    bits = F.array_join(F.transform("at", lambda at, i: F.lpad(F.lit("1"), gap(at, i), F.lit("0"))), "")
    # a literal: a subquery's value would be fetched anew for every window
    return F.lit(bytes(place.select(F.coalesce(bits, F.lit("")).cast("binary").alias("bits")).first().bits))


def contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, short_items: bool = False) -> DataFrame:
    """``doc_id, item_id, n_windows, covered, n_slots, reparameterised`` per document and item found in it.

    Every alignment that has windows is judged, alone and together with those up to SHIFT words away; an item's
    token takes its value from the nearest. The figures are of the accepted judgement by one alignment's template
    windows alone, else of that with the least shift, then the most windows, then the earliest alignment: covered is
    the share of the item's tokens under its windows;
    reparameterised: some slot has another value than in the item. Null or empty texts match nothing; rows that
    repeat an id count as one document, found if one of them is; a row with a null id is found under that null.
    Long texts are taken whole. An item shorter than a window is one window: with ``short_items`` it is found
    anywhere, else only as a whole document. Other columns, of any name, are not looked at.
    """
    base, wanted = (written(df, "items") for df in item_windows(items))
    n_wanted = wanted.count()
    widths = sorted(r.width for r in wanted.where(F.col("width") < WIDTH).select("width").distinct().collect())
    small = n_wanted <= BROADCAST_WINDOWS
    slots = min(SLOTS, 1 << max(16, (16 * n_wanted).bit_length()))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("text <> ''")
    tokens = _typed(texts.withColumn("row", F.xxhash64("text")), lambda t: F.xxhash64(t)).select("doc_id", "row", "words", "plain", "tokens")
    bits = _slots(wanted, slots)
    there = lambda w: F.substring(bits, F.pmod(w["hash"], F.lit(slots)).cast("int") + 1, 1) == F.lit(b"1")

    def windows_of(name: str, width: int) -> Column:
        """Those of the windows whose hash falls where a wanted one does."""
        typed = F.lit(name == "tokens").alias("typed")
        each = F.transform(name, lambda _, i: F.struct(i.alias("pos"), _window_hash(name, i, width).alias("hash"), typed))
        if width < WIDTH and not short_items:
            each = F.when(F.size(name) == width, each).otherwise(F.array().cast("array<struct<pos:int,hash:bigint,typed:boolean>>"))
        whole = F.size(name) - width
        return F.filter(each, lambda w: there(w) & (w["pos"] <= whole))

    lists = [windows_of(name, width) for width in [*widths, WIDTH] for name in ("tokens", "plain")]
    # explode would have the optimiser test the array's size before, and for that build all of it once more
    each = tokens.select("doc_id", "row", "words", F.explode_outer(F.concat(*lists)).alias("w"))
    typed = (F.col("w.typed") & F.col("typed")).alias("typed")
    if small:
        hits = each.join(F.broadcast(wanted), F.col("w.hash") == F.col("hash"))
        hits = hits.select("doc_id", "row", "item_id", "item_pos", F.col("w.pos").alias("pos"), typed, F.transform(F.slice("words", F.col("w.pos") + 1, F.col("width")), F.lower).alias("vals"))
    else:
        found = each.select("doc_id", "row", "w").join(wanted, F.col("w.hash") == F.col("hash")).select(
            "doc_id", "row", "item_id", "item_pos", F.col("w.pos").alias("pos"), typed, "width"
        )
        raws = tokens.select("doc_id", "row", "words").dropDuplicates(["doc_id", "row"]).withColumnsRenamed({"doc_id": "__doc", "row": "__row"})
        hits = found.join(raws, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("row") == F.col("__row"))).select(
            "doc_id", "row", "item_id", "item_pos", "pos", "typed", F.transform(F.slice("words", F.col("pos") + 1, F.col("width")), F.lower).alias("vals")
        )
    # windows of one alignment: no more than the item has
    pair = ["doc_id", "row", "item_id"]
    aligned = hits.groupBy(*pair, (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(
        F.collect_set(F.struct("item_pos", "vals")).alias("found"), F.collect_set(F.when(F.col("typed"), F.col("item_pos"))).alias("typed")
    )
    # windows of all alignments must be able to cover enough
    enough = F.sum(F.size("found")).over(Window.partitionBy(*pair)) * WIDTH >= F.lit(coverage) * F.col("item_len")
    lengths = base.select("item_id", F.size("item_tokens").alias("item_len"))
    aligned = aligned.join(lengths, "item_id").withColumn("enough", enough).where("enough")
    near = aligned.select(
        *pair, "found", "typed", "diagonal", F.explode(F.sequence(F.col("diagonal") - SHIFT, F.col("diagonal") + SHIFT)).alias("centre")
    )
    around = near.groupBy(*pair, "centre").agg(
        F.collect_list(F.struct(F.abs(F.col("diagonal") - F.col("centre")).alias("off"), "diagonal", "found", "typed")).alias("around")
    ).where(F.exists("around", lambda a: a["off"] == 0))
    # shift -1: the template windows of the alignment itself, without those found by words
    shifts = F.array_union(F.array(F.lit(-1).cast("bigint")), F.transform("around", lambda a: a["off"].cast("bigint")))
    by_template = F.transform(
        F.filter("around", lambda a: a["off"] == 0),
        lambda a: a.withField("found", F.filter(a["found"], lambda f: F.array_contains(a["typed"], f["item_pos"]))),
    )
    within = F.filter("around", lambda a: a["off"] <= F.col("shift"))
    joined = around.withColumn("shift", F.explode(shifts)).withColumn(
        "around", F.when(F.col("shift") < 0, by_template).otherwise(within)
    ).join(base, "item_id")
    every = F.flatten(
        F.transform(
            "around",
            lambda a: F.flatten(
                F.transform(
                    a["found"],
                    lambda f: F.transform(
                        f["vals"],
                        lambda v, i: F.struct(
                            (f["item_pos"] + i).alias("at"), a["off"].alias("off"), a["diagonal"].alias("diagonal"), v.alias("val")
                        ),
                    ),
                )
            ),
        )
    )
    # the nearest value of each of the item's tokens
    spots = F.filter("every", lambda s, i: (i == 0) | (F.get("every", i - 1)["at"] != s["at"]))
    windows = F.array_distinct(F.flatten(F.transform("around", lambda a: F.transform(a["found"], lambda f: f["item_pos"]))))
    bare = lambda v: F.regexp_replace(v, r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", "")
    slots = F.array_distinct(
        F.transform(
            F.filter("spots", lambda s: F.element_at("item_tokens", s["at"] + 1).rlike("[\u0001\u0002\u0003]")),
            lambda s: F.struct(
                F.element_at("item_tokens", s["at"] + 1).alias("kind"),
                bare(F.element_at("item_raw", s["at"] + 1)).alias("was"),
                bare(s["val"]).alias("now"),
            ),
        )
    )
    judged = (
        joined.withColumn("every", F.array_sort(F.array_distinct(every)))
        .withColumn("spots", spots)
        .withColumn("slots", slots)
        .select(
            "doc_id", "item_id", "shift", "centre",
            F.size(windows).cast("long").alias("n_windows"),
            (F.size("spots") / F.size("item_tokens")).alias("covered"),
            F.size("slots").cast("long").alias("n_slots"),
            F.exists("slots", lambda s: s["was"] != s["now"]).alias("reparameterised"),
            (F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["was"])))) == F.size("slots")).alias("consistent"),
        )
    )
    figures = ["n_windows", "covered", "n_slots", "reparameterised"]
    # accepted within the aggregation: as a filter before it the test would be pushed below the lists it looks at, which
    # would then be built anew for each of their elements
    accepted = (F.col("covered") >= coverage) & F.col("consistent")
    order = F.when(accepted, F.struct(-F.col("shift"), "n_windows", -F.col("centre"), "covered"))
    best = judged.groupBy("doc_id", "item_id").agg(F.max_by(F.struct(*figures), order).alias("best")).where("best is not null")
    return best.select("doc_id", "item_id", *[f"best.{c}" for c in figures])


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item found in it (see ``contaminated``), items of any length anywhere in a text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"), short_items=True)


def _sql_template(text: str) -> str:
    out = f"coalesce({text}, '')"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    literal = lambda s: "".join(f"' || chr({ord(c)}) || '" if ord(c) < 32 else c for c in quote(s))
    for pattern, by in STEPS:
        out = f"regexp_replace({out}, {literal(pattern)}, {literal(by.replace('$', chr(92)))}, 'g')"
    out = f"lower(replace({out}, chr(4), ''))"
    for pattern, by in LATE_STEPS:
        out = f"regexp_replace({out}, {literal(pattern)}, {literal(by.replace('$', chr(92)))}, 'g')"
    return _sql_words(out)


def _sql_words(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '{_SPACE}+'), lambda w: w <> '')"


_BARE = r"regexp_replace({}, '^[\p{{P}}\p{{S}}]+|[\p{{P}}\p{{S}}]+$', '', 'g')"

ORACLE_OP5 = f"""
WITH items AS (SELECT item_id, list_transform({_sql_words('text')}, lambda w: lower(w)) AS raw, {_sql_template('text')} AS tok
               FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT item_id, i AS item_pos, len(tok) AS n, array_to_string(list_slice(tok, i + 1, i + {WIDTH}), ' ') AS w,
       len(list_filter(list_slice(tok, i + 1, i + {WIDTH}), lambda t: NOT (t IN (chr(1), chr(2), chr(3))))) AS literals
       FROM (SELECT *, unnest(range(0, greatest(len(tok) - {WIDTH}, 0) + 1)) AS i FROM items WHERE len(tok) > 0)),
d AS (SELECT doc_id, {_sql_words('text')} AS raw, {_sql_template('text')} AS tok FROM documents WHERE coalesce(text, '') <> ''),
dw AS (SELECT doc_id, i AS pos, array_to_string(list_slice(tok, i + 1, i + {WIDTH}), ' ') AS w,
       list_transform(list_slice(raw, i + 1, i + {WIDTH}), lambda x: lower(x)) AS vals
       FROM (SELECT *, unnest(range(0, greatest(len(tok) - {WIDTH}, 0) + 1)) AS i FROM d)),
hits AS (SELECT DISTINCT doc_id, item_id, item_pos, pos, vals FROM dw JOIN iw USING (w) WHERE literals >= least({MIN_LITERALS}, n)),
diag AS (SELECT doc_id, item_id, pos - item_pos AS g, count(*) AS n,
         row_number() OVER (PARTITION BY doc_id, item_id ORDER BY count(*) DESC, pos - item_pos) AS rn
         FROM hits GROUP BY doc_id, item_id, pos - item_pos),
best AS (SELECT h.*, dg.n FROM hits h JOIN diag dg ON h.doc_id = dg.doc_id AND h.item_id = dg.item_id AND h.pos - h.item_pos = dg.g AND dg.rn = 1),
spots AS (SELECT DISTINCT doc_id, item_id, n, item_pos + k AS spot, vals[k + 1] AS val
          FROM (SELECT *, unnest(range(0, len(vals))) AS k FROM best)),
typed AS (SELECT s.*, i.tok[spot + 1] AS kind, i.raw[spot + 1] AS was, len(i.tok) AS item_len FROM spots s JOIN items i USING (item_id)),
slots AS (SELECT DISTINCT doc_id, item_id, kind, {_BARE.format('was')} AS was, {_BARE.format('val')} AS now
          FROM typed WHERE contains(kind, chr(1)) OR contains(kind, chr(2)) OR contains(kind, chr(3))),
sums AS (SELECT doc_id, item_id, count(*) AS n_slots, bool_or(was <> now) AS re, count(DISTINCT kind || chr(9) || was) AS n_was FROM slots GROUP BY ALL)
SELECT t.doc_id, t.item_id, CAST(max(t.n) AS BIGINT) AS n_windows, count(DISTINCT spot) / CAST(max(item_len) AS DOUBLE) AS covered,
       CAST(coalesce(max(n_slots), 0) AS BIGINT) AS n_slots, coalesce(bool_or(re), false) AS reparameterised
FROM typed t LEFT JOIN sums s ON t.doc_id = s.doc_id AND t.item_id = s.item_id
GROUP BY t.doc_id, t.item_id
HAVING count(DISTINCT spot) / CAST(max(item_len) AS DOUBLE) >= {COVERAGE} AND coalesce(max(n_was), 0) = coalesce(max(n_slots), 0)
"""
