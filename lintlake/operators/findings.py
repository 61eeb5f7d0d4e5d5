"""The findings table: making, ordering and merging findings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions import catalog as K
from lintlake.functions.scalars import confidence_rank, literal_map, overlap_family
from lintlake.plans.lineage import written

FIELDS = ["rule_id", "title", "severity", "confidence", "cwe", "cve", "cvss", "file", "line", "evidence", "remediation", "status"]
#: Order of the detectors in a scan.
ENGINE_ORDER = ["heuristics", "javascript", "dependencies", "secrets", "configuration", "python", "java"]


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def rule_struct(rule_id: str, title: str, severity: str, cwe: str, confidence: str, rank: int) -> Column:
    return F.struct(
        F.lit(rule_id).alias("rule_id"), F.lit(title).alias("title"), F.lit(severity).alias("severity"),
        F.lit(cwe).alias("cwe"), F.lit(confidence).alias("confidence"), F.lit(rank).alias("rule_rank"),
    )


def as_findings(rows: DataFrame, engine: str, *keys: str) -> DataFrame:
    """Findings from rows with ``project_id, rel_path, line, evidence`` and the columns of a rule."""
    keys = keys or ("project_id",)
    evidence = F.col("evidence")
    # two characters tell whether there is anything to strip
    ends = F.concat(F.substring(evidence, 1, 1), F.substring(evidence, -1, 1))
    stripped = F.when(ends.rlike(r"(?U)[\s\x1c-\x1f]"), strip(evidence)).otherwise(evidence)
    return rows.select(
        *keys,
        F.lit(engine).alias("engine_id"),
        F.lit(ENGINE_ORDER.index(engine) if engine in ENGINE_ORDER else len(ENGINE_ORDER)).alias("engine_rank"),
        "rule_rank", "rule_id", "title", "severity", "confidence", "cwe",
        F.lit(None).cast("string").alias("cve"),
        F.lit("context-dependent").alias("cvss"),
        F.col("rel_path").alias("file"),
        F.col("line").cast("int").alias("line"),
        F.substring(stripped, 1, K.MAX_EVIDENCE).alias("evidence"),
        F.coalesce(F.try_element_at(literal_map(K.ADVICE), F.col("rule_id")), F.lit(K.DEFAULT_ADVICE)).alias("remediation"),
        F.lit("open").alias("status"),
    )


def finding_order() -> list[Column]:
    """Arrival order of findings within a project: detector, file, line, rule, then what else tells them apart."""
    return [F.col(c) for c in ("engine_rank", "file", "line", "rule_rank", "rule_id", "evidence")]


def with_order(findings: DataFrame, *keys: str) -> DataFrame:
    """Add ``ord``, the arrival order, as a sortable struct (no window over a project is needed)."""
    return findings.withColumn("ord", F.struct("engine_rank", "file", "line", "rule_rank", "rule_id", "evidence"))


#: Lines of a block, by bits, within which islands of lines are found before the blocks are put together.
BLOCK_BITS = 10


def with_islands(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``__island``: the first line of the run of lines, without a gap of two or more, that a row's line is in.

    Runs are found within blocks of lines and then followed over the borders of blocks, which one row a block tells, so
    that a file with very many findings is many groups. A null line is an island of its own.
    """
    line = F.col("line").cast("long")
    rows = findings.withColumn("__block", F.shiftright(line, BLOCK_BITS))
    inside = Window.partitionBy(*keys, "__block").orderBy("line")
    gap = line - F.lag(line).over(inside)
    rows = rows.withColumn("__gap", F.when(gap.isNull() | (gap > 1), line))
    rows = rows.withColumn("__run", F.max("__gap").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    blocks = rows.groupBy(*keys, "__block").agg(F.min(line).alias("__first"), F.max(line).alias("__last"), F.max("__run").alias("__open"))
    along = Window.partitionBy(*keys).orderBy("__block")
    blocks = blocks.withColumn("__goes_on", F.coalesce(F.col("__first") == F.lag("__last").over(along) + 1, F.lit(False)))
    # where the last run of a block began, unless that is before the block
    began = F.when(~(F.col("__goes_on") & (F.col("__open") == F.col("__first"))), F.col("__open"))
    blocks = blocks.withColumn("__began", F.last(began, True).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    blocks = blocks.withColumn("__from", F.when(F.col("__goes_on"), F.lag("__began").over(along)))
    named = blocks.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__b"), "__first", "__from")
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col("__block").eqNullSafe(F.col("__b"))]
    joined = rows.join(named, same)
    island = F.when(F.col("__from").isNotNull() & (F.col("__run") == F.col("__first")), F.col("__from")).otherwise(F.col("__run"))
    return joined.withColumn("__island", island).drop("__block", "__gap", "__run", "__b", "__first", "__from", *[f"__k{i}" for i in range(len(keys))])


def lines_apart(findings: DataFrame, keys: list[str]) -> Column:
    """Whether a row is surely an island alone: its line is inside a block, and no other row of the block is at most one line away.

    Null where a row's line is, or where it is the first or last of its block, as the neighbour may be in another.
    """
    line = F.col("line").cast("long")
    inside = Window.partitionBy(*keys, F.shiftright(line, BLOCK_BITS)).orderBy(line)
    far = lambda gap: F.coalesce(gap > 1, F.lit(True))
    last = (1 << BLOCK_BITS) - 1
    return F.when((line.bitwiseAND(last) > 0) & (line.bitwiseAND(last) < last), far(line - F.lag(line).over(inside)) & far(F.lead(line).over(inside) - line))


class Fold:
    """The greedy merge of one island: rows come in arrival order, kept ones are found by exact key, or by line and family."""

    def __init__(self):
        self.known: set = set()
        self.kept: list[list] = []  # mask, line, rank, row
        self.at_line: dict = {}

    def add(self, key: tuple, mask: int, line: int | None, rank: int, row: tuple[pa.RecordBatch, int]) -> None:
        if key in self.known:
            return
        near = () if line is None else (i for d in (-1, 0, 1) for i in self.at_line.get(line + d, ()) if self.kept[i][0] & mask)
        first = min(near, default=None)
        if first is None:
            self.known.add(key)
            self.at_line.setdefault(line, set()).add(len(self.kept))
            self.kept.append([mask, line, rank, row])
        elif rank > self.kept[first][2]:
            # it stays known by the key under which it was entered, but is found by its new line and family
            self.at_line[self.kept[first][1]].discard(first)
            self.at_line.setdefault(line, set()).add(first)
            self.kept[first] = [mask, line, rank, row]

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The kept rows, those of one batch together."""
        places: dict[int, tuple[pa.RecordBatch, list[int]]] = {}
        for *_, (batch, i) in self.kept:
            places.setdefault(id(batch), (batch, []))[1].append(i)
        for batch, at in places.values():
            yield batch.take(pa.array(at))


def deduplicate(findings: DataFrame, order: list[str], keys: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """Greedy merge in arrival order: equal findings once; of adjacent ones of one CWE and term family the surer.

    Findings without a family need only the first of each equal group, and one with no other near its line stays. The rest meet by (keys, file, cwe) and island of
    lines, as no merge crosses a gap of two lines, and stream through a fold in order: a kept finding remembers
    under which exact key it was entered, is found by exact key first, then by family and a line at most one away, and
    is replaced in place by a surer one. A task holds what it keeps of one island. Rows that agree in all of
    ``order`` are taken by rule, line, evidence and rank of confidence. A null line is near no other. ``findings`` may
    have more columns; they go with their row.
    """
    mask = overlap_family(F.col("rule_id"), F.col("title"))
    named = findings.withColumn("__mask", mask)
    exact = [*keys, "rule_id", "file", "line", "evidence"]
    w = Window.partitionBy(*exact).orderBy(*([c for c in order if c not in exact] or exact[:1]))
    alone = named.where("__mask = 0").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__mask")
    columns = findings.columns
    group = [*keys, "file", "cwe"]
    # a finding without another near it stays as it is; the others are put together to islands
    near = named.where("__mask <> 0").withColumn("__apart", F.coalesce(lines_apart(named, group), F.lit(False)))
    alone = alone.select(*columns).unionByName(near.where("__apart").select(*columns))
    rows = with_islands(written(near.where("not __apart").drop("__apart"), "near-findings"), group).withColumn("__rank", confidence_rank(F.col("confidence")))
    sort = list(dict.fromkeys([*group, "__island", *order, "rule_id", "line", "evidence", "__rank"]))
    dealt = rows.repartition(*group, "__island").sortWithinPartitions(*sort)
    light = [*group, "__island", "rule_id", "line", "evidence", "__mask", "__rank"]
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fold = None, Fold()
        for batch in batches:
            whole = pa.RecordBatch.from_arrays(batch.columns[:n], names=columns)
            here: list[int] = []  # rows of this batch that are settled
            for i, x in enumerate(zip(*(batch.column(n + k).to_pylist() for k in range(len(light))))):
                if x[: len(group) + 1] != at:
                    if all(row[0] is whole for *_, row in fold.kept):
                        here += [row[1] for *_, row in fold.kept]
                    else:
                        yield from fold.rows()
                    at, fold = x[: len(group) + 1], Fold()
                key = x[len(group) + 1 : len(group) + 4]
                fold.add(key, x[-2], key[1], x[-1], (whole, i))
            yield whole.take(pa.array(here, pa.int64()))
        yield from fold.rows()

    folded = dealt.select(*columns, *(F.col(c).alias(f"__f{i}") for i, c in enumerate(light))).mapInArrow(run, findings.schema)
    return alone.select(*columns).unionByName(folded)
