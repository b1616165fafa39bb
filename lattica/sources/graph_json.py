"""JSON documents: the graph, aliases, the review queue and community reports, read with defaults for what is missing."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.text import relation_type

ENTITY = "entity_id string, entity_type string, name string, description string, properties map<string,string>, source_paper_id string, source_chunk_ids array<string>, source_section string, community_id int"
TRIPLE = "triple_id string, relation_type string, source_entity_id string, target_entity_id string, source_entity_name string, target_entity_name string, description string, source_paper_id string, source_chunk_ids array<string>, confidence double, llm_model string, prompt_version string, created_at string"
ALIAS = "alias_id string, alias_text string, canonical_entity_id string, entity_type string, source string, confidence double, created_at string"
REVIEW = "review_id string, new_entity_id string, new_entity_name string, new_entity_type string, candidate_entity_id string, candidate_entity_name string, similarity double, reason string, status string, created_at string"
REPORT = "title string, summary string, key_findings array<string>, entity_ids array<string>, size int, level int"


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per document; a missing path gives none, a malformed document a row of nulls."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _rows(document: DataFrame, field: str) -> DataFrame:
    return document.select(F.posexplode(field).alias("seq", "x")).select(F.col("seq").cast("long").alias("seq"), "x.*")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, triples) of a graph document, seq being their order in it."""
    doc = _document(spark, path, f"entities array<struct<{_nested(ENTITY)}>>, triples array<struct<{_nested(TRIPLE)}>>")
    e = _rows(doc, "entities").where("entity_id IS NOT NULL").na.fill("", ["description", "source_paper_id", "source_section"]).na.fill(-1, ["community_id"])
    e = e.withColumn("properties", F.coalesce("properties", F.create_map().cast("map<string,string>"))).withColumn("source_chunk_ids", F.coalesce("source_chunk_ids", F.array().cast("array<string>"))).withColumn("source_paper_ids", F.filter(F.split("source_paper_id", r"\|"), lambda p: p != ""))
    t = _rows(doc, "triples").where("source_entity_id IS NOT NULL AND target_entity_id IS NOT NULL").na.fill("", ["description", "source_paper_id", "llm_model"]).na.fill("v0", ["prompt_version"]).na.fill(1.0, ["confidence"])
    t = t.withColumn("relation_type", relation_type(F.col("relation_type"))).withColumn("source_chunk_ids", F.coalesce("source_chunk_ids", F.array().cast("array<string>"))).withColumn("created_at", F.try_to_timestamp("created_at").cast("timestamp_ntz"))
    return e, t


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    return _rows(_document(spark, path, f"aliases array<struct<{_nested(ALIAS)}>>"), "aliases").where("alias_text IS NOT NULL").drop("seq")


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return _rows(_document(spark, path, f"pending array<struct<{_nested(REVIEW)}>>"), "pending").where("review_id IS NOT NULL").na.fill("pending", ["status"]).drop("seq")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row per community report."""
    doc = _document(spark, path, f"generated_at string, model string, communities map<string,struct<{_nested(REPORT)}>>")
    rows = doc.select("generated_at", "model", F.explode("communities").alias("id", "x"))
    return rows.select(F.col("id").cast("int").alias("community_id"), "x.*", "generated_at", "model")


def write_document(entities: DataFrame, triples: DataFrame, path: str) -> None:
    """One graph document in order of arrival, for tools that read whole documents; its rows are encoded in parallel and only joined by one task.

    For tables of any size use `export.write_graph`, which writes in parallel.
    """
    stats = _shares(entities, "entity_type", "entity").crossJoin(_shares(triples, "relation_type", "relation"))
    tail = F.concat(F.lit('], "stats": '), F.to_json(F.struct("total_entities", "total_triples", "entity_type_distribution", "relation_type_distribution")), F.lit("}"))
    _write(path, [('{"entities": [', _lines(entities)), ('], "triples": [', _lines(triples))], stats.select(tail.alias("line")))


def _shares(rows: DataFrame, kind: str, name: str) -> DataFrame:
    """One row: the total and a map of the types' numbers."""
    n = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    plural = "entities" if name == "entity" else "triples"
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(f"total_{plural}"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(kind).isNotNull(), F.struct(F.col(kind).alias("k"), "n"))))).alias(f"{name}_type_distribution"))


def _lines(rows: DataFrame) -> DataFrame:
    """(at, line): rows as JSON objects, in order of arrival where they have one."""
    order = F.col("seq").cast("long") if "seq" in rows.columns else F.lit(0).cast("long")
    return rows.select(order.alias("at"), F.to_json(F.struct(*[c for c in rows.columns if c != "seq"])).alias("line"))


def _commas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A comma before every row of a list but its first; lists have odd part numbers."""
    last = None
    for batch in batches:
        out = []
        for part, line in zip(batch.column("part").to_pylist(), batch.column("line").to_pylist(), strict=True):
            out.append("," + line if part % 2 and part == last else line)
            last = part
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["line"])


def _write(path: str, parts: list[tuple[str, DataFrame]], tail: DataFrame) -> None:
    """One file of lines under `path`: heads, each followed by its list of (at, line), and the tail (line); rows are encoded in parallel, one task joins them."""
    spark = tail.sparkSession
    out = tail.select(F.lit(2 * len(parts)).alias("part"), F.lit(0).cast("long").alias("at"), "line")
    for k, (head, rows) in enumerate(parts):
        out = out.unionByName(spark.range(1).select(F.lit(2 * k).alias("part"), F.lit(0).cast("long").alias("at"), F.lit(head).alias("line")))
        out = out.unionByName(rows.select(F.lit(2 * k + 1).alias("part"), "at", "line"))
    out.orderBy("part", "at", "line").coalesce(1).mapInArrow(_commas, "line string").write.mode("overwrite").text(path)


def _end(spark: SparkSession, text: str) -> DataFrame:
    return spark.range(1).select(F.lit(text).alias("line"))


def write_aliases(aliases: DataFrame, path: str) -> None:
    """The alias table as one document, rewritten in full."""
    _write(path, [('{"aliases": [', _lines(aliases))], _end(aliases.sparkSession, "]}"))


def write_reviews(reviews: DataFrame, path: str) -> None:
    """The review queue as one document, rewritten in full."""
    _write(path, [('{"pending": [', _lines(reviews))], _end(reviews.sparkSession, "]}"))


def write_reports(reports: DataFrame, path: str, model: str = "") -> None:
    """The community reports as one document keyed by community, rewritten in full."""
    fields = [c for c in ("title", "summary", "key_findings", "entity_ids", "size", "level") if c in reports.columns]
    entry = F.concat(F.lit('"'), F.col("community_id").cast("string"), F.lit('": '), F.to_json(F.struct(*fields)))
    head = '{"generated_at": "' + datetime.now(timezone.utc).isoformat() + f'", "model": {json.dumps(model)}, "communities": {{'
    _write(path, [(head, reports.select(F.col("community_id").cast("long").alias("at"), entry.alias("line")))], _end(reports.sparkSession, "}}"))


def _nested(ddl: str) -> str:
    return ddl.replace("map<string,string>", "map<string§string>").replace(", ", ",").replace(" ", ":").replace("§", ",")
