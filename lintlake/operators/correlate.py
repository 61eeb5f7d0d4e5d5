"""Groups of findings that share evidence, without forming pairs of findings.

All findings of one rule family in a project are linked, so the graph that decides about groups is one of families:
those that meet in a file, those with source and those with sink evidence, those that configuration joins. Its links
come from aggregations; only this small graph is searched for components. Which kinds of link occur in a group follows
from counts. A group is one row of sums and least values, its members are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import catalog as K
from lintlake.functions.scalars import fp_asset, has_sink, has_source, is_config_file, literal_map, rule_family
from lintlake.plans.graph import connected_components
from lintlake.plans.lineage import written

# What a link is called, and what a group does not say.
SHARED_FILE, SHARED_FAMILY = "shared file", "shared rule family"
SOURCE_SINK, CONFIG_CODE = "source/sink evidence terms", "configuration and code relationship"
LIMITATIONS = [
    "Correlation indicates related evidence, not exploitability or a confirmed attack path.",
    "Dynamic behavior, deployment context, and reachability are not verified.",
]

NODE = ["project_id", "file", "family", "s", "t", "c", "e"]


def _flags(findings: DataFrame) -> DataFrame:
    text = F.coalesce("evidence", F.lit(""))
    return findings.withColumns(
        {
            "family": rule_family(F.col("rule_id")), "s": has_source(text).cast("int"), "t": has_sink(text).cast("int"),
            "c": is_config_file(F.col("file")).cast("int"), "e": (F.trim(text) != "").cast("int"),
        }
    )


def family_links(nodes: DataFrame, families: DataFrame) -> DataFrame:
    """Links ``src, dst`` between the numbered families of a project: each with the least of those it is linked to."""
    least = F.min("id").alias("least")
    known = families.select("project_id", "family", "id")
    placed = nodes.select("project_id", "file", "family").distinct().join(known, ["project_id", "family"])
    by_file = placed.join(placed.groupBy("project_id", "file").agg(least), ["project_id", "file"]).select("id", "least")
    # all with source or sink evidence, if a project has both; all with evidence, if a configuration file has some
    hubs = families.groupBy("project_id").agg(
        F.max("s").alias("ps"), F.max("t").alias("pt"), F.max("ce").alias("pc"),
        F.min(F.when(F.col("s") + F.col("t") > 0, F.col("id"))).alias("st"), F.min(F.when(F.col("e") == 1, F.col("id"))).alias("cfg"),
    )
    each = families.join(hubs, "project_id")
    st = each.where("s + t > 0 and ps + pt = 2").select("id", F.col("st").alias("least"))
    cfg = each.where("e = 1 and pc = 1").select("id", F.col("cfg").alias("least"))
    links = by_file.distinct().unionByName(st).unionByName(cfg).where("id <> least")
    return links.select(F.col("id").alias("src"), F.col("least").alias("dst"))


def components(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (distinct NODE columns, ``n`` findings) with their ``component``, and ``project_id, family, component``.

    Groups of one finding are left out of both. A null project is one of its own.
    """
    nodes = written(_flags(findings).groupBy(*NODE).agg(F.count("*").alias("n")), "correlate-nodes")
    top = lambda c, name: F.max(c).alias(name)
    families = nodes.groupBy("project_id", "family").agg(
        *(top(c, c) for c in ("s", "t", "e")), top(F.col("c") * F.col("e"), "ce"), F.sum("n").alias("n")
    ).withColumn("id", F.monotonically_increasing_id())
    families = written(families, "correlate-families")
    found = connected_components(family_links(nodes, families)).withColumnRenamed("node", "id")
    labelled = families.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = labelled.groupBy("component").agg(F.sum("n").alias("size")).where("size > 1")
    groups = written(labelled.join(sizes, "component").select("project_id", "family", "component"), "correlate-groups")
    return nodes.join(groups, ["project_id", "family"]), groups


def _pairs_outside(nodes: DataFrame, near: DataFrame, flags: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Per component and name: ordered pairs of different findings (first flag, second flag) that differ in file and family.

    Pairs in all, less those of one file, less those of one family, and back those of one file and family; each
    count is a sum of products of sums, so no pair is formed. ``near`` are the nodes dealt by component and file: very many
    files have few findings each, and their nodes are smaller than the sums of each.
    """
    n = F.col("n")
    total = None
    for keys, sign in (([], 1), (["file"], -1), (["family"], -1), (["file", "family"], 1)):
        sums = []
        for name, (a, b) in flags.items():
            x, y = a.cast("long"), b.cast("long")
            sums += [F.sum(x * n).alias(f"{name}_x"), F.sum(y * n).alias(f"{name}_y"), F.sum(x * y * n).alias(f"{name}_b")]
        by = (near if "file" in keys else nodes).groupBy("component", *keys).agg(*sums)
        part = by.select("component", *[(F.lit(sign) * (F.col(f"{k}_x") * F.col(f"{k}_y") - F.col(f"{k}_b"))).alias(k) for k in flags])
        total = part if total is None else total.unionByName(part)
    return total.groupBy("component").agg(*[F.sum(k).alias(k) for k in flags])


def group_reasons(nodes: DataFrame) -> DataFrame:
    """``component, signals``: the sorted kinds of link of each group, each pair counting for its first kind."""
    near = nodes.repartition("component", "file")
    files = near.groupBy("component", "file").agg(F.sum("n").alias("k")).groupBy("component").agg(F.max("k").alias("by_file"))
    fams = nodes.groupBy("component", "family").agg(F.countDistinct("file").alias("k")).groupBy("component").agg(F.max("k").alias("by_family"))
    # configuration links are the pairs with evidence, one of a configuration file, that are no source/sink pairs:
    # over the kinds (source, sink) of both ends, those that do not link
    kind = F.col("s") * 2 + F.col("t")
    evident = F.col("e") == 1
    flags = {"st": (F.col("s") == 1, F.col("t") == 1)}
    for i in range(4):
        for j in range(4):
            if not ((i & 2 and j & 1) or (j & 2 and i & 1)):
                flags[f"c{i}{j}"] = ((kind == i) & evident & (F.col("c") == 1), (kind == j) & evident)
    counts = _pairs_outside(nodes, near, flags)
    cfg = sum((F.col(k) for k in flags if k != "st"), F.lit(0))
    every = files.join(fams, "component").join(counts, "component")
    signals = F.array_sort(
        F.array_compact(
            F.array(
                F.when(F.col("by_file") > 1, SHARED_FILE), F.when(F.col("by_family") > 1, SHARED_FAMILY),
                F.when(F.col("st") > 0, SOURCE_SINK), F.when(cfg > 0, CONFIG_CODE),
            )
        )
    )
    return every.select("component", signals.alias("signals"))


def correlate(findings: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Groups, one row each, and their members, one row each.

    Groups: ``project_id, group_id, kind, title, severity, confidence, n_findings, rationale, has_attack_path``. The first
    member in ``order`` names the group; of the highest severity the first one's spelling is taken. Members:
    ``project_id, group_id``, the columns of ``order``, ``fingerprint, rule_id, file, line``. All of a group's columns
    are sums and least values, so a hot project is summed in many tasks. Findings without a project belong to none.
    """
    findings = findings.where("project_id is not null")
    nodes, groups = components(findings)
    reasons = group_reasons(nodes)
    rank = F.coalesce(F.try_element_at(literal_map({s: 4 - i for i, s in enumerate(K.SEVERITIES)}), F.upper("severity")), F.lit(0))
    fp = fp_asset(F.col("rule_id"), F.col("file"), F.col("line"), F.col("evidence"))
    at = F.struct(*order)
    members = _flags(findings).withColumns({"fingerprint": fp, "rank": rank}).join(groups, ["project_id", "family"])
    rolled = members.groupBy("component").agg(
        F.min("project_id").alias("project_id"),
        F.concat(F.lit("risk-"), F.min_by("fingerprint", at)).alias("group_id"),
        F.min_by("severity", F.struct((-F.col("rank")).alias("r"), at.alias("o"))).alias("severity"),
        F.when(F.bool_and(F.lower("confidence") == "high"), "high").otherwise("medium").alias("confidence"),
        F.count("*").alias("n_findings"),
    )
    rows = rolled.join(reasons, "component").select(
        "project_id", "group_id", F.lit("risk_group").alias("kind"), F.lit("Related findings requiring review").alias("title"),
        "severity", "confidence", "n_findings", F.concat_ws("; ", "signals").alias("rationale"), F.array_contains("signals", SOURCE_SINK).alias("has_attack_path"),
    )
    columns = list(dict.fromkeys(["project_id", "group_id", *order, "fingerprint", "rule_id", "file", "line"]))
    return rows, members.join(rolled.select("component", "group_id"), "component").select(columns)


def correlate_findings(findings: DataFrame, order: list[str]) -> DataFrame:
    """The record of each group as a report shows it, with lists of its members in order.

    A report is read by people, so its lists are short; work on groups goes by the rows of ``correlate``.
    """
    groups, members = correlate(findings, order)
    item = F.struct(F.struct(*order).alias("o"), *(F.col(c) for c in ("fingerprint", "rule_id", "file", "line")))
    listed = members.groupBy("project_id", "group_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    take = lambda *names: F.transform("items", lambda i: F.struct(*[i[n].alias(n) for n in names]))
    path = F.transform("items", lambda i: F.struct(i["file"].alias("from"), i["rule_id"].alias("rule_id")))
    return groups.join(listed, ["project_id", "group_id"]).select(
        "project_id", "group_id", "kind", "title", "severity", "confidence",
        F.transform("items", lambda i: i["fingerprint"]).alias("finding_fingerprints"),
        take("fingerprint", "rule_id", "file", "line").alias("finding_references"),
        "rationale",
        F.when(F.col("has_attack_path"), path).otherwise(F.slice(path, 1, 0)).alias("attack_path"),
        F.array(*[F.lit(x) for x in LIMITATIONS]).alias("limitations"),
    )
