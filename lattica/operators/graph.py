"""The property graph: writes, reads, traversals, merges and deletions over entity and triple tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from lattica.constants import LOW_CONFIDENCE
from lattica.functions.text import confidence, relation_type
from lattica.plans.tables import cut

#: So many lines make one part of a long text.
PART_LINES = 32


def latest(df: DataFrame, *keys: str, order: str = "seq") -> DataFrame:
    """Of each key the row with the largest `order`: one partial aggregation, no window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def nodes(entities: DataFrame) -> DataFrame:
    """One row per entity id, the last written."""
    return latest(entities.where(F.col("entity_id").isNotNull()), "entity_id")


def edges(triples: DataFrame, vertices: DataFrame) -> DataFrame:
    """The simple directed graph: relation types normalised, both ends present, the last written triple per ordered pair."""
    known = triples.where(F.col("source_entity_id").isNotNull() & F.col("target_entity_id").isNotNull()).withColumn("relation_type", relation_type(F.col("relation_type")))
    ids = vertices.select("entity_id")
    # Whole rows move once, by pair; only the pairs move to where their ends are.
    pairs = known.select("source_entity_id", "target_entity_id").distinct()
    there = pairs.join(ids.withColumnRenamed("entity_id", "source_entity_id"), "source_entity_id", "left_semi").join(ids.withColumnRenamed("entity_id", "target_entity_id"), "target_entity_id", "left_semi")
    return latest(known.join(there, ["source_entity_id", "target_entity_id"], "left_semi"), "source_entity_id", "target_entity_id")


def statistics(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, label, n): entities and relations in total (null label) and by type, one rollup each."""
    e = vertices.rollup("entity_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("entity").alias("kind"), F.col("entity_type").alias("label"), "n")
    r = links.rollup("relation_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("relation").alias("kind"), F.col("relation_type").alias("label"), "n")
    return e.unionByName(r)


def search(vertices: DataFrame, keyword: str, entity_type: str | None = None) -> DataFrame:
    """Entities whose name contains the keyword, whatever the case; the empty keyword matches all."""
    found = vertices.where(F.contains(F.lower("name"), F.lit(keyword.strip().lower())))
    return found.where(F.col("entity_type") == entity_type) if entity_type else found


def ego(links: DataFrame, seeds: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """((seed, node), (seed, source, target)): what each seed reaches over outgoing edges, and the edges among it.

    `seeds` has a column seed. All seeds advance in one join per hop; edges are kept per seed, as the union of
    what two seeds reach has edges that neither's own graph has.
    """
    pairs = links.select(F.col("source_entity_id").alias("s"), F.col("target_entity_id").alias("t")).distinct()
    reached = seeds.select("seed", F.col("seed").alias("node")).distinct()
    frontier = reached
    for _ in range(hops):
        step = frontier.join(pairs, frontier["node"] == pairs["s"]).select("seed", F.col("t").alias("node")).distinct()
        frontier = cut(step.join(reached, ["seed", "node"], "left_anti"), "frontier")
        reached = reached.unionByName(frontier)
    a = reached.withColumnRenamed("node", "s")
    inside = a.join(pairs, "s").join(reached.withColumnRenamed("node", "t"), ["seed", "t"])
    return reached, inside.select("seed", F.col("s").alias("source_entity_id"), F.col("t").alias("target_entity_id"))


def marked_ego(links: DataFrame, seeds: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """((word, node, bits), (word, source_entity_id, target_entity_id, bits)): `ego` of whole sets of seeds, the union over each set's seeds.

    `seeds` (word, node, bits) has a bit for each set a node is a seed of, so that a node or an edge is one row for all sets of a word and
    no row is held per seed. An edge whose source some seed reaches a step early is inside for sure; only for the others is it
    asked which seeds reach both ends, backwards from these ends and along what can still reach a seed in time.
    """
    bit_or = lambda c: F.bit_or(c).alias(c)
    pairs = links.select(F.col("source_entity_id").alias("s"), F.col("target_entity_id").alias("t"))
    within = [cut(seeds.groupBy("word", "node").agg(bit_or("bits")).withColumn("near", F.lit(0).cast("long")), "within")]
    for _ in range(hops):
        last = within[-1].select("word", "node", "bits", F.col("bits").alias("near"))
        step = last.join(pairs, last["node"] == pairs["s"]).select("word", F.col("t").alias("node"), "bits", F.lit(0).cast("long").alias("near"))
        within.append(cut(last.unionByName(step).groupBy("word", "node").agg(bit_or("bits"), bit_or("near")), "within"))
    far = within[-1]
    a, b = far.select("word", F.col("node").alias("s"), F.col("bits").alias("far"), "near"), far.select("word", F.col("node").alias("t"), F.col("bits").alias("far_t"))
    both = pairs.join(a, "s").join(b, ["word", "t"]).select("word", "s", "t", F.col("near").alias("bits"), F.col("far").bitwiseAND(F.col("far_t")).bitwiseAND(F.bitwise_not("near")).alias("open"))
    edges = cut(both.where("bits <> 0 OR open <> 0"), "inside")
    inside, left = edges.select("word", "s", "t", "bits"), edges.where("open <> 0").drop("bits")
    if left.take(1):
        ends = left.select("word", F.col("s").alias("x"), F.col("open").alias("bits")).unionByName(left.select("word", F.col("t").alias("x"), F.col("open").alias("bits")))
        back, found = ends.groupBy("word", "x").agg(bit_or("bits")).withColumn("node", F.col("x")), []
        for k in range(hops, -1, -1):
            # What leads to x in hops - k steps and is within k steps of a seed.
            held = within[k].select("word", "node", F.col("bits").alias("held"))
            back = cut(back.join(held, ["word", "node"]).withColumn("bits", F.col("bits").bitwiseAND(F.col("held"))).where("bits <> 0").groupBy("word", "x", "node").agg(bit_or("bits")), "back")
            first = within[0].select("word", "node", F.col("bits").alias("own"))
            found.append(back.join(first, ["word", "node"]).select("word", "x", F.col("node").alias("seed"), F.col("bits").bitwiseAND(F.col("own")).alias("bits")).where("bits <> 0"))
            if k:
                back = back.join(pairs, back["node"] == pairs["t"]).select("word", "x", F.col("s").alias("node"), "bits")
        seen = cut(reduce(DataFrame.unionByName, found).groupBy("word", "x", "seed").agg(bit_or("bits")), "seen")
        p, q = seen.select("word", F.col("x").alias("s"), "seed", "bits"), seen.select("word", F.col("x").alias("t"), "seed", F.col("bits").alias("bits_t"))
        met = left.join(p, ["word", "s"]).withColumn("bits", F.col("bits").bitwiseAND(F.col("open"))).where("bits <> 0").join(q, ["word", "t", "seed"])
        met = met.select("word", "s", "t", F.col("bits").bitwiseAND(F.col("bits_t")).alias("bits")).where("bits <> 0")
        inside = inside.unionByName(met).groupBy("word", "s", "t").agg(bit_or("bits"))
    inside = inside.where("bits <> 0").select("word", F.col("s").alias("source_entity_id"), F.col("t").alias("target_entity_id"), "bits")
    return far.where("bits <> 0").select("word", "node", "bits"), inside


def _pairs(links: DataFrame) -> DataFrame:
    return cut(links.select(F.col("source_entity_id").alias("s"), F.col("target_entity_id").alias("t")).distinct(), "pairs")


def _frontiers(links: DataFrame, start: str) -> Iterator[DataFrame]:
    """(node, parent, depth) of what each further step from `start` reaches first, until nothing is; smallest predecessor first among equals.

    Each frontier is written before the next, so the plan does not grow.
    """
    pairs = _pairs(links)
    seen = frontier = links.sparkSession.createDataFrame([(start, None, 0)], "node string, parent string, depth int")
    depth = 0
    while frontier.take(1):
        yield frontier
        depth += 1
        step = frontier.join(pairs, frontier["node"] == pairs["s"]).groupBy(F.col("t").alias("node")).agg(F.min("s").alias("parent")).withColumn("depth", F.lit(depth))
        frontier = cut(step.join(seen.select("node"), "node", "left_anti"), "frontier")
        seen = seen.unionByName(frontier)


def shortest_path(links: DataFrame, start: str, goal: str) -> list[str]:
    """Node ids of a shortest directed path, empty if there is none; smallest predecessor first among equals."""
    steps = []
    for frontier in _frontiers(links, start):
        steps.append(frontier)
        if frontier.where(F.col("node") == goal).take(1):
            path = [goal]
            # Each step back reads the one frontier the node was first reached in.
            for back in reversed(steps[1:]):
                path.append(back.where(F.col("node") == path[-1]).first().parent)
            return path[::-1]
    return []


def distances(links: DataFrame, start: str) -> DataFrame:
    """(node, depth) of everything reachable from `start`."""
    return reduce(DataFrame.unionByName, _frontiers(links, start)).select("node", "depth")


def degrees(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(entity_id, degree): edges an entity is an end of, a loop counting once."""
    ends = links.select(F.explode(F.array_distinct(F.array("source_entity_id", "target_entity_id"))).alias("entity_id")).groupBy("entity_id").agg(F.count(F.lit(1)).alias("degree"))
    return vertices.select("entity_id").join(ends, "entity_id", "left").select("entity_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def pattern(vertices: DataFrame, links: DataFrame, relation: str, source_type: str, target_type: str) -> DataFrame:
    """(source_id, source_name, target_id, target_name) of the edges of one relation between two types."""
    s = vertices.where(F.col("entity_type") == source_type).select(F.col("entity_id").alias("source_id"), F.col("name").alias("source_name"))
    t = vertices.where(F.col("entity_type") == target_type).select(F.col("entity_id").alias("target_id"), F.col("name").alias("target_name"))
    e = links.where(F.col("relation_type") == relation).select(F.col("source_entity_id").alias("source_id"), F.col("target_entity_id").alias("target_id"))
    return e.join(s, "source_id").join(t, "target_id").select("source_id", "source_name", "target_id", "target_name")


def delete_entities(vertices: DataFrame, links: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the entities of `doomed` (entity_id) and the edges at them."""
    kept = vertices.join(doomed, "entity_id", "left_anti")
    left = links.join(doomed.withColumnRenamed("entity_id", "source_entity_id"), "source_entity_id", "left_anti").join(doomed.withColumnRenamed("entity_id", "target_entity_id"), "target_entity_id", "left_anti")
    return kept, left


def merged_nodes(rows: DataFrame, late: str) -> DataFrame:
    """One row per entity_id of rows that stand for it: name, type and place of the first row, the longest description, the distinct chunk
    and paper ids, and of each property its distinct values in order of arrival, joined by '; '. Rows marked `late` come after the others."""
    columns = [c for c in rows.columns if c != late]
    order = F.struct(F.col(late), "seq")
    special = {"entity_id", "description", "properties", "source_chunk_ids", "source_paper_ids"}
    keep = [F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns if c not in special]
    ids = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))))).alias(c)
    lists = [ids(c) for c in ("source_chunk_ids", "source_paper_ids") if c in columns]
    longest = [F.min_by("description", F.when(F.col("description").isNotNull(), F.struct(-F.length("description"), order))).alias("description")] if "description" in columns else []
    head = rows.groupBy("entity_id").agg(*keep, *longest, *lists)
    if "properties" not in columns:
        return head.select(*columns)
    pairs = rows.select("entity_id", order.alias("at"), F.explode("properties").alias("k", "v")).where("v IS NOT NULL AND v <> ''")
    first = pairs.groupBy("entity_id", "k", "v").agg(F.min("at").alias("at"))
    values = first.groupBy("entity_id", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]), "; ").alias("v"))
    props = values.groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))
    return head.join(props, "entity_id", "left").withColumn("properties", F.coalesce("properties", F.create_map().cast("map<string,string>"))).select(*columns)


def merge_attributes(entities: DataFrame, group: Column) -> DataFrame:
    """One row per group: longest name and description (the earliest of equals), distinct chunk and paper ids, and of each
    property its distinct values in order of arrival, joined by '; '.

    Values are kept as a set, so merging the same rows again changes nothing.
    """
    rows = entities.withColumn("grp", group)
    longest = lambda c: F.max_by(c, F.struct(F.length(c), -F.col("seq")))
    ids = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))))
    head = rows.groupBy("grp").agg(longest("name").alias("name"), longest("description").alias("description"), ids("source_chunk_ids").alias("source_chunk_ids"), ids("source_paper_ids").alias("source_paper_ids"), F.count(F.lit(1)).alias("n_rows"))
    pairs = rows.select("grp", "seq", F.explode("properties").alias("k", "v")).where(F.col("v").isNotNull() & (F.col("v") != ""))
    first = pairs.groupBy("grp", "k", "v").agg(F.min("seq").alias("at"))
    values = first.groupBy("grp", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]), "; ").alias("v"))
    props = values.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("props"))
    return head.join(props, "grp", "left").withColumn("properties", F.to_json(F.coalesce("props", F.array().cast("array<struct<k:string,v:string>>")))).drop("props")


def redirect(links: DataFrame, moved: DataFrame) -> DataFrame:
    """The edges after merging `moved` (entity_id, primary_id): ends replaced, an edge the primary already has wins, then the last written."""
    to = moved.select(F.col("entity_id").alias("_id"), F.col("primary_id").alias("_to"))
    s = links.join(to, links["source_entity_id"] == to["_id"], "left").withColumn("s", F.coalesce("_to", "source_entity_id")).drop("_id", "_to")
    both = s.join(to, s["target_entity_id"] == to["_id"], "left").withColumn("t", F.coalesce("_to", "target_entity_id")).drop("_id", "_to")
    own = (F.col("s") == F.col("source_entity_id")) & (F.col("t") == F.col("target_entity_id"))
    rest = [c for c in links.columns if c not in ("source_entity_id", "target_entity_id")]
    picked = both.groupBy("s", "t").agg(F.max_by(F.struct(*rest), F.struct(own, "seq")).alias("r"))
    return picked.select(F.col("s").alias("source_entity_id"), F.col("t").alias("target_entity_id"), "r.*")


def entity_lines(vertices: DataFrame) -> Column:
    """The text line of an entity for a prompt."""
    text = F.coalesce(F.when(F.col("description") != "", F.col("description")), F.col("properties")["description"], F.lit(""))
    section = F.coalesce(F.col("source_section"), F.lit(""))
    return F.concat(F.lit("- ["), "entity_type", F.lit("] "), "name", F.when(text != "", F.concat(F.lit(": "), text)).otherwise(""), F.when(section != "", F.concat(F.lit("  [来源: "), section, F.lit("]"))).otherwise(""))


def triple_lines() -> Column:
    """The text line of a triple: names, relation, note, confidence, and a mark where it is low."""
    c = confidence(F.col("confidence"))
    note = F.coalesce(F.col("description"), F.lit(""))
    return F.concat(
        F.lit("- "), F.coalesce("source_entity_name", F.lit("")), F.lit(" --["), "relation_type", F.lit("]--> "), F.coalesce("target_entity_name", F.lit("")), F.when(note != "", F.concat(F.lit(" （"), note, F.lit("）"))).otherwise(""),
        F.lit("（置信度 "), F.format_string("%.2f", c), F.lit("）"), F.when(c < LOW_CONFIDENCE, "  【待验证】").otherwise(""),
    )


def graph_text(found: DataFrame, triples: DataFrame, key: str) -> DataFrame:
    """(key, kg_text): per key, entity lines by name then triple lines by confidence; both inputs carry `key`."""
    e = found.withColumn("line", entity_lines(found)).groupBy(key).agg(F.count(F.lit(1)).alias("n_e"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "entity_id", "line"))), lambda x: x["line"]), "\n").alias("e"))
    t = triples.withColumn("line", triple_lines()).withColumn("c", -confidence(F.col("confidence"))).groupBy(key).agg(F.count(F.lit(1)).alias("n_t"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "seq", "line"))), lambda x: x["line"]), "\n").alias("t"))
    head = F.concat(F.lit("## 相关知识图谱实体 ("), F.col("n_e").cast("string"), F.lit(" 个):\n"), "e")
    tail = F.concat(F.lit("\n\n## 相关关系 ("), F.col("n_t").cast("string"), F.lit(" 条):\n"), "t")
    return e.join(t, key, "left").select(key, F.concat(head, F.coalesce(tail, F.lit(""))).alias("kg_text"))


def line_parts(marked: DataFrame, line: Column, order: dict[str, Column], numbers: list[tuple], kind: DataType) -> DataFrame:
    """(question_id, part, text): the lines of each question in order, some to a part, each after a line end.

    `marked` has one row (word, bits, ...) for all questions of a word, `numbers` (question_id, word, bit) tells their bits. Rows are sorted once, by
    range, and no task holds more of a text than one batch.
    """
    rows = marked.select("word", "bits", line.alias("line"), *(c.alias(f"_{n}") for n, c in order.items())).where("line IS NOT NULL")
    keys = [*(f"_{n}" for n in order), "line"]
    schema = pa.schema([("question_id", to_arrow_type(kind)), ("part", pa.int64()), ("text", pa.string())])
    lines_each = PART_LINES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 36
        for batch in batches:
            words, bits = (batch.column(c).to_numpy() for c in ("word", "bits"))
            lines = np.array(batch.column("line").to_pylist(), dtype=object)
            for key, word, bit in numbers:
                own = lines[(words == word) & ((bits & bit) != 0)].tolist()
                texts = ["\n" + "\n".join(own[i : i + lines_each]) for i in range(0, len(own), lines_each)]
                yield pa.RecordBatch.from_pydict({"question_id": [key] * len(texts), "part": list(range(part, part + len(texts))), "text": texts}, schema)
                part += len(texts)

    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("word", "bits", "line").mapInArrow(run, f"question_id {kind.simpleString()}, part long, text string")


def low_confidence(triples: DataFrame) -> DataFrame:
    """Triples with their confidence band."""
    c = confidence(F.col("confidence"))
    return triples.withColumn("band", F.when(c >= 0.85, "high").when(c >= LOW_CONFIDENCE, "medium").otherwise("low"))


def export_nodes(vertices: DataFrame) -> DataFrame:
    """Node rows of a property-graph import: label, safe property names, values cut at 500 characters."""
    label = F.when(F.col("entity_type").isin("Paper", "Method", "Dataset"), F.col("entity_type")).otherwise("")
    safe = F.transform(F.map_entries(F.map_filter("properties", lambda _, v: v.isNotNull())), lambda e: F.struct(F.translate(e["key"], "- ", "__").alias("k"), F.substring(e["value"], 1, 500).alias("v")))
    return vertices.select("entity_id", "name", "entity_type", "source_paper_id", label.alias("label"), F.to_json(F.coalesce(F.array_sort(safe), F.array().cast("array<struct<k:string,v:string>>"))).alias("properties"))


def export_edges(triples: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edge rows of a property-graph import: one per (source, target, relation), the last written, weight 1 where missing."""
    known = triples.withColumn("relation_type", relation_type(F.col("relation_type")))
    ids = vertices.select("entity_id")
    both = known.join(ids.withColumnRenamed("entity_id", "source_entity_id"), "source_entity_id", "left_semi").join(ids.withColumnRenamed("entity_id", "target_entity_id"), "target_entity_id", "left_semi")
    last = latest(both.select("source_entity_id", "target_entity_id", "relation_type", "seq", "confidence"), "source_entity_id", "target_entity_id", "relation_type")
    return last.select("source_entity_id", "target_entity_id", "relation_type", confidence(F.col("confidence")).alias("weight"))
