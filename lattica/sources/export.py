"""Sinks: conversations, the graph document, property-graph files and the export checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def conversations(messages: DataFrame, key: str, order: list[str], role: str, text: str) -> DataFrame:
    """(key, markdown, plain): each conversation rendered in order."""
    turns = F.array_sort(F.collect_list(F.struct(*order, F.col(role).alias("_role"), F.col(text).alias("_text"))))
    rows = messages.groupBy(key).agg(turns.alias("t"))
    md = F.transform("t", lambda x: F.concat(F.lit("**"), x["_role"], F.lit("**: "), x["_text"]))
    plain = F.transform("t", lambda x: F.concat(x["_role"], F.lit(": "), x["_text"]))
    return rows.select(key, F.array_join(md, "\n\n").alias("markdown"), F.array_join(plain, "\n").alias("plain"))


def write_graph(entities: DataFrame, triples: DataFrame, path: str) -> None:
    """The graph as JSON lines, entities and triples apart, written in parallel; existing files are replaced."""
    entities.write.mode("overwrite").json(f"{path}/entities")
    triples.write.mode("overwrite").json(f"{path}/triples")


def write_property_graph(nodes: DataFrame, edges: DataFrame, path: str, dry_run: bool = False) -> tuple[int, int]:
    """Node and edge files for a bulk import; with dry_run only their numbers."""
    counts = nodes.count(), edges.count()
    if not dry_run:
        nodes.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/nodes")
        edges.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/edges")
    return counts


def checkpoint(spark: SparkSession, path: str, entities: int, triples: int) -> DataFrame:
    """Writes and returns the one-row record of the last export."""
    row = spark.range(1).select(F.current_timestamp().alias("last_export"), F.lit(entities).alias("entity_count"), F.lit(triples).alias("triple_count"))
    row.write.mode("overwrite").json(path)
    return spark.read.json(path)
