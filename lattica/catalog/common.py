"""What several query modules share: the base graph in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.constants import RELATION_TYPES, RELATION_VARIANTS
from lattica.operators import graph
from lattica.plans.tables import table

NODE_COLUMNS = ("entity_id", "entity_type", "name", "description", "properties", "source_paper_id", "source_section", "community_id", "seq")
EDGE_COLUMNS = ("seq", "triple_id", "relation_type", "source_entity_id", "target_entity_id", "source_entity_name", "target_entity_name", "description", "source_paper_id", "confidence")


def vertices(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    want = dict.fromkeys(("entity_id", "seq", *(columns or NODE_COLUMNS)))
    return graph.nodes(table(spark, root, "entities", *want))


def links(spark: SparkSession, root: str, *columns: str, nodes: DataFrame | None = None) -> DataFrame:
    want = dict.fromkeys(("seq", "source_entity_id", "target_entity_id", "relation_type", *(columns or EDGE_COLUMNS)))
    return graph.edges(table(spark, root, "triples", *want), vertices(spark, root, "entity_id") if nodes is None else nodes)


def _relation_sql(col: str) -> str:
    up = f"upper(trim({col}, ' ' || chr(9) || chr(10) || chr(13)))"
    maps = " ".join(f"WHEN {up} = '{k}' THEN '{v}'" for k, v in RELATION_VARIANTS.items())
    valid = ", ".join(f"'{t}'" for t in RELATION_TYPES)
    inside = " ".join(f"WHEN contains({up}, '{t}') THEN '{t}'" for t in sorted(RELATION_TYPES, key=lambda t: (-len(t), t)))
    return f"CASE WHEN {col} IS NULL OR {col} = '' THEN '' {maps} WHEN {up} IN ({valid}) THEN {up} WHEN split_part({up}, '_', 1) IN ({valid}) THEN split_part({up}, '_', 1) {inside} ELSE {up} END"


RELATION_SQL = _relation_sql("relation_type")
NODES_SQL = "nodes AS (SELECT * FROM entities WHERE entity_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY seq DESC) = 1)"
EDGES_SQL = f"""edges AS (SELECT * REPLACE ({RELATION_SQL} AS relation_type) FROM triples
  WHERE source_entity_id IN (SELECT entity_id FROM nodes) AND target_entity_id IN (SELECT entity_id FROM nodes)
  QUALIFY row_number() OVER (PARTITION BY source_entity_id, target_entity_id ORDER BY seq DESC) = 1)"""
GRAPH_SQL = f"{NODES_SQL}, {EDGES_SQL}"
CONFIDENCE_SQL = "CASE WHEN confidence IS NULL OR isnan(confidence) OR confidence = 0 THEN 1.0 ELSE confidence END"
#: White space as a character class of RE2, and a name's form without any.
SPACE_CLASS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def norm_sql(col: str) -> str:
    return f"regexp_replace(lower({col}), '{SPACE_CLASS}+', '', 'g')"
