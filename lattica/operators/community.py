"""Communities of the graph: detection, numbering, texts and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.constants import COMMUNITY_MIN_SIZE
from lattica.functions.text import json_span
from lattica.operators.calls import Generator, Policy, answered
from lattica.operators.extract import PROMPTS, filled
from lattica.plans.tables import cut

#: A level of moves ends when two rounds raise modularity by less than this, and detection when a level does.
LEAST_GAIN = 1e-3


def undirected(links: DataFrame) -> DataFrame:
    """(a, b), a < b: each connected pair once, without loops."""
    return links.where("source_entity_id <> target_entity_id").select(F.least("source_entity_id", "target_entity_id").alias("a"), F.greatest("source_entity_id", "target_entity_id").alias("b")).distinct()


def _moved(nodes: DataFrame, near: DataFrame, total: float, turn: int) -> DataFrame:
    """(x, d, c, stay): one round of parallel local moving, and the weight each node had to its community before it.

    A node goes to the neighbouring community that raises modularity most, judged by the communities before the
    round. Of two neighbours only one may be moved in a round (nodes take turns by a hash), and single nodes join only a smaller
    label, so that pairs do not swap for ever.
    """
    load = nodes.groupBy("c").agg(F.sum("d").alias("load"), F.count(F.lit(1)).alias("size"))
    placed = nodes.join(load, "c").select("x", "d", F.col("c").alias("own"), F.col("load").alias("own_load"), F.col("size").alias("own_size"))
    to = near.join(nodes.select(F.col("x").alias("y"), "c"), "y").groupBy("x", "c").agg(F.sum("w").alias("w")).join(load, "c")
    each = placed.join(to, "x", "left")
    same = F.col("c") == F.col("own")
    gain = F.coalesce("w", F.lit(0.0)) - F.col("d") * (F.col("load") - F.when(same, F.col("d")).otherwise(0.0)) / total
    allowed = same | (F.col("own_size") > 1) | (F.col("size") > 1) | (F.col("c") < F.col("own"))
    best = each.withColumn("gain", F.when(allowed & F.col("c").isNotNull(), gain)).groupBy("x").agg(
        F.first("d").alias("d"), F.first("own").alias("own"), F.max(F.when(same, F.col("w"))).alias("stay"), F.max(F.when(same, F.col("gain"))).alias("now"), F.first("own_load").alias("own_load"),
        F.max(F.when(~same & F.col("gain").isNotNull(), F.struct("gain", "c"))).alias("best"),
    )
    now = F.coalesce("now", -F.col("d") * (F.col("own_load") - F.col("d")) / total)
    go = (F.pmod(F.xxhash64("x", F.lit(turn)), F.lit(2)) == 0) & (F.col("best.gain") > now + 1e-9)
    return best.select("x", "d", F.when(go, F.col("best.c")).otherwise(F.col("own")).alias("c"), F.coalesce("stay", F.lit(0.0)).alias("stay"), F.col("own"))


def _quality(round_: DataFrame, total: float) -> float:
    """Modularity before a round of moves, from what it recorded."""
    own = round_.groupBy("own").agg(F.sum("d").alias("load"), F.sum("stay").alias("inside"))
    return own.agg(F.sum(F.col("inside") / total - F.pow(F.col("load") / total, 2))).first()[0] or 0.0


def labels(pairs: DataFrame, least_gain: float = LEAST_GAIN) -> DataFrame:
    """(entity_id, label): a partition of the nodes of `pairs` (a, b) by parallel local moving and contraction, until modularity stops rising.

    Each round is a few joins and aggregations over the edges between communities, written once; each contraction leaves
    one node per community. A node's neighbourhood is only ever an aggregate, so hubs are safe.
    """
    near = cut(pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(1.0).alias("w")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), F.lit(1.0).alias("w"))), "near")
    total = float(near.count())
    nodes = cut(near.groupBy("x").agg(F.sum("w").alias("d")).withColumn("c", F.col("x")), "nodes")
    held = nodes.select(F.col("x").alias("entity_id"), F.col("x").alias("label"))
    within = 0.0  # weight inside the contracted nodes
    last_level = -1.0
    while total:
        quality, turn, best = [], 0, nodes
        while True:
            moved = cut(_moved(nodes, near, total, turn), "moved")
            quality.append(_quality(moved, total) + within / total)
            if quality[-1] >= max(quality):
                best = nodes
            nodes, turn = moved.select("x", "d", "c"), turn + 1
            if len(quality) > 2 and quality[-1] - quality[-3] < least_gain:
                break
        held = cut(held.join(best.select(F.col("x").alias("label"), "c"), "label").select("entity_id", F.col("c").alias("label")), "held")
        if max(quality) - last_level < least_gain:
            return held
        last_level = max(quality)
        to = best.select("x", F.col("c").alias("cx"))
        merged = near.join(to, "x").join(to.select(F.col("x").alias("y"), F.col("cx").alias("cy")), "y").groupBy("cx", "cy").agg(F.sum("w").alias("w"))
        merged = cut(merged, "merged")
        within += merged.where("cx = cy").agg(F.sum("w")).first()[0] or 0.0
        near = merged.where("cx <> cy").select(F.col("cx").alias("x"), F.col("cy").alias("y"), "w")
        nodes = cut(best.groupBy("c").agg(F.sum("d").alias("d")).select(F.col("c").alias("x"), "d", "c"), "nodes")
    return held


def detect(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(entity_id, community_id): communities by modularity, one way at every size; isolated entities are communities of one."""
    found = labels(cut(undirected(links), "undirected"))
    low = found.groupBy("label").agg(F.min("entity_id").alias("low"))
    found = found.join(low, "label").select("entity_id", F.col("low").alias("label"))
    full = cut(vertices.select("entity_id").join(found, "entity_id", "left").select("entity_id", F.coalesce("label", "entity_id").alias("label")), "labels")
    return full.join(renumber(full), "label").select("entity_id", "community_id")


def renumber(labels: DataFrame) -> DataFrame:
    """(label, community_id): 0 for the largest, the smallest member first among equals; one row per community.

    Communities are put into ranges of the order, numbered in each, and shifted by what the ranges before hold.
    """
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min("entity_id").alias("low"))
    ranges = cut(sizes.repartitionByRange(F.desc("size"), F.asc("low")).withColumn("part", F.spark_partition_id()), "ranges")
    # One row per partition.
    held = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = held.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("size"), "low")) - 1
    return ranges.withColumn("place", place).join(F.broadcast(before), "part").select("label", (F.col("before") + F.col("place")).cast("int").alias("community_id"))


def modularity(pairs: DataFrame, communities: DataFrame) -> float:
    """Modularity of a partition over undirected pairs."""
    ca, cb = communities.select(F.col("entity_id").alias("a"), F.col("community_id").alias("ca")), communities.select(F.col("entity_id").alias("b"), F.col("community_id").alias("cb"))
    joined = pairs.join(ca, "a").join(cb, "b")
    m = joined.count()
    if not m:
        return 0.0
    inside = joined.where("ca = cb").count()
    degrees = joined.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("d"))
    return inside / m - degrees.agg(F.sum(F.pow(F.col("d") / (2 * m), 2))).first()[0]


def texts(vertices: DataFrame, links: DataFrame, communities: DataFrame, least: int = COMMUNITY_MIN_SIZE) -> DataFrame:
    """(community_id, size, entity_ids, member_hash, entities, relations): of each community of `least` members or more, its members and inner edges as text."""
    c = communities.where("community_id >= 0")
    text = F.coalesce(F.when(F.col("description") != "", F.col("description")), F.col("properties")["description"], F.lit(""))
    line = F.concat(F.lit("- ["), "entity_type", F.lit("] "), "name", F.when(text != "", F.concat(F.lit(": "), text)).otherwise(""))
    members = vertices.drop("community_id").join(c, "entity_id").select("community_id", "entity_id", line.alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("entity_id", "line")))
    e = members.groupBy("community_id").agg(ordered.alias("m")).where(F.size("m") >= least)
    e = e.select("community_id", F.size("m").alias("size"), F.col("m.entity_id").alias("entity_ids"), F.substring(F.sha2(F.array_join(F.col("m.entity_id"), "|"), 256), 1, 12).alias("member_hash"), F.array_join(F.col("m.line"), "\n").alias("entities"))
    s, t = c.select(F.col("entity_id").alias("source_entity_id"), F.col("community_id").alias("cs")), c.select(F.col("entity_id").alias("target_entity_id"), F.col("community_id").alias("ct"))
    inner = links.join(s, "source_entity_id").join(t, "target_entity_id").where("cs = ct")
    note = F.coalesce(F.col("description"), F.lit(""))
    rel = F.concat(F.lit("- "), "source_entity_name", F.lit(" --["), "relation_type", F.lit("]--> "), "target_entity_name", F.when(note != "", F.concat(F.lit(" ("), note, F.lit(")"))).otherwise(""))
    r = inner.groupBy(F.col("cs").alias("community_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", rel.alias("line")))), lambda x: x["line"]), "\n").alias("relations"))
    return e.join(r, "community_id", "left").withColumn("relations", F.coalesce("relations", F.lit("")))


REPORT = "title string, summary string, key_findings array<string>"


def listing_report(prompt: str) -> str:
    """Offline stand-in: the first members as title, their number as summary, the first relations as findings."""
    entities, _, relations = prompt.partition("\n\nRelations:\n")
    names = [x.split("] ", 1)[1].split(": ")[0] for x in entities.split("\n") if x.startswith("- [") and "] " in x]
    findings = [x[2:] for x in relations.split("\n\nReturn a JSON")[0].split("\n") if x.startswith("- ")]
    return json.dumps({"title": "; ".join(names[:3]), "summary": f"{len(names)} entities, {len(findings)} relations", "key_findings": findings[:3]}, ensure_ascii=False)


def reports(community_texts: DataFrame, cached: DataFrame | None = None, generator: Generator | None = None, policy: Policy = Policy()) -> DataFrame:
    """(community_id, member_hash, title, summary, key_findings, entity_ids, size, level): a report per community whose members no cached report covers.

    Communities whose call fails have no report and are asked again next time.
    """
    todo = community_texts if cached is None else community_texts.join(cached.where("coalesce(summary, '') <> ''").select("member_hash").distinct(), "member_hash", "left_anti")
    prompts = todo.select("community_id", "member_hash", "entity_ids", "size", filled(PROMPTS["community"], entities=F.col("entities"), relations=F.col("relations")).alias("prompt"))
    asked = cut(answered(prompts, "prompt", generator or listing_report, policy), "reports").where("error IS NULL")
    x = F.from_json(json_span(F.col("output")), REPORT)
    title = F.coalesce(x["title"], F.concat(F.lit("Community "), F.col("community_id").cast("string")))
    return asked.select("community_id", "member_hash", title.alias("title"), F.coalesce(x["summary"], F.lit("")).alias("summary"), F.coalesce(x["key_findings"], F.array().cast("array<string>")).alias("key_findings"), "entity_ids", "size", F.lit(0).alias("level"))
