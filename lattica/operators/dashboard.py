"""The relational part of the dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.constants import ENTITY_TYPES, EVIDENCE_ORDER, TYPE_LABELS_ZH
from lattica.operators.graph import latest


def top_names(vertices: DataFrame, types: list[str], n: int) -> DataFrame:
    """(entity_type, name, n, place): the most frequent names of each type, the first seen among equals."""
    counts = vertices.where(F.col("entity_type").isin(types)).groupBy("entity_type", "name").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy("entity_type").orderBy(F.desc("n"), "first")).cast("long"))
    return ranked.where(F.col("place") <= n).drop("first")


def shared(entities: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(keys, n_papers): what several papers mention."""
    pairs = entities.select(*keys, F.explode("source_paper_ids").alias("paper_id")).where("paper_id IS NOT NULL AND paper_id <> ''").distinct()
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_papers")).where(F.col("n_papers") >= least)


def catalogue(papers: DataFrame, vertices: DataFrame) -> DataFrame:
    """(paper_id, title, year, processed): files with what is known of them."""
    last = latest(papers.where("paper_id IS NOT NULL"), "paper_id")
    done = vertices.where("entity_type = 'Paper' AND source_paper_id IS NOT NULL").select(F.lower("source_paper_id").alias("pid")).distinct()
    title = F.coalesce(F.when(F.trim("title") != "", F.trim("title")), "paper_id")
    return last.join(done, F.lower("paper_id") == done["pid"], "left").select("paper_id", title.alias("title"), F.col("publication_year").cast("long").alias("year"), F.col("pid").isNotNull().alias("processed"))


def styled(vertices: DataFrame, highlight: str, colours: int = 12) -> DataFrame:
    """(entity_id, label, colour, boost) of the nodes of a drawing coloured by community."""
    zh = F.trim(F.coalesce(F.col("properties")["name_zh"], F.lit("")))
    none = F.coalesce("community_id", F.lit(-1)) < 0
    colour = F.when(none, "none").otherwise(F.concat(F.lit("community-"), (F.col("community_id") % colours).cast("string")))
    boost = F.when(F.contains(F.lower("name"), F.lit(highlight)), 1.4).when(none, 1.0).otherwise(1.1)
    return vertices.select("entity_id", F.substring(F.coalesce(F.when(zh != "", zh), "name"), 1, 28).alias("label"), colour.alias("colour"), boost.alias("boost"))


def ordered_types(types: DataFrame) -> DataFrame:
    """`types` plus place and label; unknown types come last under their own name."""
    place = F.create_map(*(F.lit(x) for i, t in enumerate(ENTITY_TYPES) for x in (t, i)))
    label = F.create_map(*(F.lit(x) for kv in TYPE_LABELS_ZH.items() for x in kv))
    return types.withColumn("place", F.coalesce(place[F.col("entity_type")], F.lit(99))).withColumn("label", F.coalesce(label[F.col("entity_type")], "entity_type"))


def evidence_paths(links: DataFrame, n: int) -> DataFrame:
    """(source_paper_id, place, path): the first triples of each paper as arrows between shortened names."""
    rank = F.row_number().over(Window.partitionBy("source_paper_id").orderBy("seq"))
    path = F.concat(F.substring("source_entity_name", 1, 20), F.lit(" → "), "relation_type", F.lit(" → "), F.substring("target_entity_name", 1, 20))
    return links.withColumn("place", rank.cast("long")).where(F.col("place") <= n).select("source_paper_id", "place", path.alias("path"))


def evidence_entities(vertices: DataFrame) -> DataFrame:
    """(source_paper_id, name, type_place): distinct names of each paper under the first type in display order."""
    place = F.create_map(*(F.lit(x) for i, t in enumerate(EVIDENCE_ORDER) for x in (t, i)))
    ranked = vertices.withColumn("k", place[F.col("entity_type")].cast("long")).where("k IS NOT NULL")
    return ranked.groupBy("source_paper_id", "name").agg(F.min("k").alias("type_place"))
