"""Graph reads, writes and dashboards over the entity and triple tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.catalog.common import CONFIDENCE_SQL, GRAPH_SQL, NODES_SQL, RELATION_SQL, links, norm_sql, vertices
from lattica.constants import ENTITY_TYPES, TYPE_LABELS_ZH
from lattica.functions.text import confidence, normalized_name, relation_type
from lattica.operators import dashboard, graph
from lattica.plans.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {GRAPH_SQL}
SELECT 'entity' AS kind, entity_type AS label, count(*) AS n FROM nodes GROUP BY ROLLUP (entity_type)
UNION ALL SELECT 'relation', relation_type, count(*) FROM edges GROUP BY ROLLUP (relation_type)""")
def kg_stats(spark: SparkSession, root: str) -> DataFrame:
    v = vertices(spark, root, "entity_type")
    return graph.statistics(v, links(spark, root, "relation_type", nodes=v))


@query(f"WITH {NODES_SQL} SELECT entity_id, name, description FROM nodes WHERE entity_id = (SELECT min(entity_id) FROM nodes)")
def entity_by_id(spark, root):
    first = table(spark, root, "entities", "entity_id").agg(F.min("entity_id").alias("entity_id"))
    return vertices(spark, root, "name", "description").join(F.broadcast(first), "entity_id").select("entity_id", "name", "description")


@query(f"WITH {NODES_SQL} SELECT entity_id, entity_type, name FROM nodes WHERE contains(lower(name), 'graph') AND entity_type = 'Method'")
def entity_search(spark, root):
    return graph.search(vertices(spark, root, "entity_type", "name"), " Graph ", "Method").select("entity_id", "entity_type", "name")


@query(f"WITH {NODES_SQL} SELECT entity_id, name, source_paper_id FROM nodes WHERE entity_type = 'Dataset'")
def entity_by_type(spark, root):
    return vertices(spark, root, "entity_type", "name", "source_paper_id").where("entity_type = 'Dataset'").select("entity_id", "name", "source_paper_id")


@query(f"WITH {GRAPH_SQL} SELECT source_entity_id, relation_type, target_entity_id, source_entity_name, target_entity_name, {CONFIDENCE_SQL} AS confidence FROM edges")
def all_triples(spark, root):
    e = links(spark, root, "relation_type", "source_entity_name", "target_entity_name", "confidence")
    return e.select("source_entity_id", "relation_type", "target_entity_id", "source_entity_name", "target_entity_name", confidence(F.col("confidence")).alias("confidence"))


@query(f"WITH {GRAPH_SQL} SELECT source_entity_id, target_entity_id, triple_id, seq FROM edges")
def edge_last_write(spark, root):
    return links(spark, root, "triple_id").select("source_entity_id", "target_entity_id", "triple_id", "seq")


def _hub(edges: DataFrame) -> DataFrame:
    """The entity with most outgoing edges, the smallest id among equals; one row."""
    out = edges.groupBy("source_entity_id").agg(F.count(F.lit(1)).alias("n"))
    return out.agg(F.min_by("source_entity_id", F.struct(-F.col("n"), "source_entity_id")).alias("seed"))


_HUB_SQL = "hub AS (SELECT source_entity_id AS seed FROM edges GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _ego_sql(hops: int) -> str:
    return f"""WITH RECURSIVE {GRAPH_SQL}, {_HUB_SQL},
reach(node, d) AS (SELECT seed, 0 FROM hub UNION SELECT e.target_entity_id, r.d + 1 FROM reach r JOIN edges e ON e.source_entity_id = r.node WHERE r.d < {hops})
SELECT source_entity_id, target_entity_id FROM edges WHERE source_entity_id IN (SELECT node FROM reach) AND target_entity_id IN (SELECT node FROM reach)"""


@query(_ego_sql(1))
def ego_1hop(spark, root):
    e = links(spark, root, "relation_type")
    return graph.ego(e, _hub(e), 1)[1].select("source_entity_id", "target_entity_id")


@query(_ego_sql(2))
def ego_2hop(spark, root):
    e = links(spark, root, "relation_type")
    return graph.ego(e, _hub(e), 2)[1].select("source_entity_id", "target_entity_id")


@query(f"""WITH RECURSIVE {GRAPH_SQL}, reach(seed, node, d) AS (
  SELECT entity_id, entity_id, 0 FROM nodes WHERE entity_type = 'Domain'
  UNION SELECT r.seed, e.target_entity_id, r.d + 1 FROM reach r JOIN edges e ON e.source_entity_id = r.node WHERE r.d < 2)
SELECT DISTINCT a.seed, source_entity_id, target_entity_id FROM edges JOIN (SELECT DISTINCT seed, node FROM reach) a ON a.node = source_entity_id
JOIN (SELECT DISTINCT seed, node FROM reach) b ON b.node = target_entity_id AND a.seed = b.seed""")
def subgraph_expand(spark, root):
    v = vertices(spark, root, "entity_type")
    seeds = v.where("entity_type = 'Domain'").select(F.col("entity_id").alias("seed"))
    return graph.ego(links(spark, root, "relation_type", nodes=v), seeds, 2)[1]


@query(f"""WITH RECURSIVE {GRAPH_SQL}, {_HUB_SQL}, reach(node, d) AS (SELECT seed, 0 FROM hub UNION SELECT e.target_entity_id, r.d + 1 FROM reach r JOIN edges e ON e.source_entity_id = r.node WHERE r.d < 60)
SELECT node, min(d) AS depth FROM reach GROUP BY 1""")
def path_lengths(spark, root):
    """Everything the hub reaches; the SQL's bound on steps is far above the longest of them."""
    e = links(spark, root, "relation_type")
    return graph.distances(e, _hub(e).first().seed or "")


@query(f"""WITH RECURSIVE {GRAPH_SQL}, {_HUB_SQL}, reach(node, d) AS (SELECT seed, 0 FROM hub UNION SELECT e.target_entity_id, r.d + 1 FROM reach r JOIN edges e ON e.source_entity_id = r.node WHERE r.d < 60),
dist AS (SELECT node, min(d) AS depth FROM reach GROUP BY 1),
par AS (SELECT t.node, min(s.node) AS parent FROM dist t JOIN edges e ON e.target_entity_id = t.node JOIN dist s ON s.node = e.source_entity_id AND s.depth = t.depth - 1 GROUP BY 1),
back(node, depth) AS (SELECT * FROM (SELECT node, depth FROM dist ORDER BY depth DESC, node DESC LIMIT 1) UNION ALL SELECT p.parent, b.depth - 1 FROM back b JOIN par p ON p.node = b.node WHERE b.depth > 0)
SELECT depth AS step, node AS entity_id FROM back""")
def shortest_path(spark, root):
    """A path from the hub to the farthest entity (smallest id of those)."""
    e = links(spark, root, "relation_type")
    hub = _hub(e).first().seed or ""
    far = graph.distances(e, hub).agg(F.max_by("node", F.struct("depth", "node")).alias("n")).first().n
    path = graph.shortest_path(e, hub, far) if far else []
    return spark.createDataFrame([(i, n) for i, n in enumerate(path)], "step int, entity_id string")


@query(f"""WITH {GRAPH_SQL}, ends AS (SELECT source_entity_id AS id FROM edges UNION ALL SELECT target_entity_id FROM edges WHERE source_entity_id <> target_entity_id)
SELECT entity_id, count(id) AS degree FROM nodes LEFT JOIN ends ON id = entity_id GROUP BY 1""")
def degree(spark, root):
    v = vertices(spark, root, "entity_id")
    return graph.degrees(v, links(spark, root, "relation_type", nodes=v))


@query(f"""WITH {GRAPH_SQL} SELECT p.name AS paper, m.name AS method, p.entity_id AS paper_id, m.entity_id AS method_id FROM edges e JOIN nodes p ON p.entity_id = source_entity_id AND p.entity_type = 'Paper'
JOIN nodes m ON m.entity_id = target_entity_id AND m.entity_type = 'Method' WHERE relation_type = 'PROPOSES'
ORDER BY p.name, m.name, p.entity_id, m.entity_id LIMIT 10""")
def paper_methods(spark, root):
    v = vertices(spark, root, "entity_type", "name")
    hits = graph.pattern(v, links(spark, root, "relation_type", nodes=v), "PROPOSES", "Paper", "Method")
    named = hits.select(F.col("source_name").alias("paper"), F.col("target_name").alias("method"), F.col("source_id").alias("paper_id"), F.col("target_id").alias("method_id"))
    return named.orderBy("paper", "method", "paper_id", "method_id").limit(10)


@query(f"""WITH {GRAPH_SQL} SELECT d.name AS dataset, count(*) AS method_count FROM edges e JOIN nodes m ON m.entity_id = source_entity_id AND m.entity_type = 'Method'
JOIN nodes d ON d.entity_id = target_entity_id AND d.entity_type = 'Dataset' WHERE relation_type = 'EVALUATED_ON' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def methods_per_dataset(spark, root):
    """The ten datasets that most methods are evaluated on."""
    v = vertices(spark, root, "entity_type", "name")
    hits = graph.pattern(v, links(spark, root, "relation_type", nodes=v), "EVALUATED_ON", "Method", "Dataset")
    return hits.groupBy(F.col("target_name").alias("dataset")).agg(F.count(F.lit(1)).alias("method_count")).orderBy(F.desc("method_count"), "dataset").limit(10)


@query(f"WITH {NODES_SQL} SELECT entity_id, name AS method, source_paper_id AS paper FROM nodes WHERE entity_type = 'Method' AND contains(lower(name), 'retrieval')")
def method_contains(spark, root):
    return graph.search(vertices(spark, root, "entity_type", "name", "source_paper_id"), "retrieval", "Method").select("entity_id", F.col("name").alias("method"), F.col("source_paper_id").alias("paper"))


@query(f"SELECT relation_type AS raw, {RELATION_SQL} AS relation_type, count(*) AS n FROM triples GROUP BY ALL")
def relation_normalise(spark, root):
    t = table(spark, root, "triples", "relation_type")
    return t.groupBy(F.col("relation_type").alias("raw")).agg(F.count(F.lit(1)).alias("n")).select("raw", relation_type(F.col("raw")).alias("relation_type"), "n")


@query(f"""WITH {GRAPH_SQL}, b AS (SELECT CASE WHEN {CONFIDENCE_SQL} >= 0.85 THEN 'high' WHEN {CONFIDENCE_SQL} >= 0.7 THEN 'medium' ELSE 'low' END AS band FROM edges)
SELECT band, count(*) AS n FROM b GROUP BY 1""")
def confidence_bands(spark, root):
    return graph.low_confidence(links(spark, root, "confidence")).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {GRAPH_SQL} SELECT triple_id, source_entity_name, relation_type, target_entity_name, {CONFIDENCE_SQL} AS confidence FROM edges WHERE {CONFIDENCE_SQL} < 0.7 ORDER BY {CONFIDENCE_SQL}, seq LIMIT 30""")
def provenance_low(spark, root):
    e = graph.low_confidence(links(spark, root, "triple_id", "confidence", "source_entity_name", "target_entity_name")).where("band = 'low'")
    top = e.orderBy(confidence(F.col("confidence")), "seq").limit(30)
    return top.select("triple_id", "source_entity_name", "relation_type", "target_entity_name", confidence(F.col("confidence")).alias("confidence"))


@query(f"""WITH {NODES_SQL}, c AS (SELECT entity_type, name, count(*) AS n, min(seq) AS first FROM nodes WHERE entity_type IN ('Method', 'Dataset') GROUP BY 1, 2)
SELECT entity_type, name, n, row_number() OVER (PARTITION BY entity_type ORDER BY n DESC, first) AS place FROM c QUALIFY place <= 5""")
def top_names(spark, root):
    return dashboard.top_names(vertices(spark, root, "entity_type", "name"), ["Method", "Dataset"], 5)


@query(f"""WITH p AS (SELECT DISTINCT entity_type, {norm_sql("name")} AS norm, unnest(source_paper_ids) AS paper_id FROM entities WHERE name IS NOT NULL)
SELECT entity_type, norm, count(*) AS n_papers FROM p WHERE paper_id IS NOT NULL AND paper_id <> '' GROUP BY 1, 2 HAVING count(*) >= 2""")
def shared_entities(spark, root):
    e = table(spark, root, "entities", "entity_type", "name", "source_paper_ids").where("name IS NOT NULL")
    return dashboard.shared(e.withColumn("norm", normalized_name(F.col("name"))), ["entity_type", "norm"], 2)


@query(f"""WITH {NODES_SQL}, p AS (SELECT DISTINCT lower(source_paper_id) AS pid FROM nodes WHERE entity_type = 'Paper' AND source_paper_id IS NOT NULL),
papers1 AS (SELECT * FROM papers WHERE paper_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY seq DESC) = 1)
SELECT paper_id, coalesce(nullif(trim(title), ''), paper_id) AS title, CAST(publication_year AS BIGINT) AS year, pid IS NOT NULL AS processed FROM papers1 LEFT JOIN p ON pid = lower(paper_id)""")
def paper_catalogue(spark, root):
    papers = table(spark, root, "papers", "seq", "paper_id", "title", "publication_year")
    return dashboard.catalogue(papers, vertices(spark, root, "entity_type", "source_paper_id"))


@query("""WITH papers1 AS (SELECT * FROM papers WHERE paper_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY seq DESC) = 1)
SELECT paper_id, title, CAST(publication_year AS BIGINT) AS year FROM papers1 WHERE publication_year >= 2020 AND (contains(lower(title), 'graph') OR contains(lower(authors_text), 'graph'))""")
def catalogue_filter(spark, root):
    papers = graph.latest(table(spark, root, "papers", "seq", "paper_id", "title", "authors_text", "publication_year").where("paper_id IS NOT NULL"), "paper_id")
    hit = F.contains(F.lower("title"), F.lit("graph")) | F.contains(F.lower("authors_text"), F.lit("graph"))
    return papers.where((F.col("publication_year") >= 2020) & hit).select("paper_id", "title", F.col("publication_year").cast("long").alias("year"))


@query("""SELECT paper_id, seq FROM papers ORDER BY ingested_at DESC NULLS LAST, seq DESC LIMIT 5""")
def recent_papers(spark, root):
    return table(spark, root, "papers", "paper_id", "seq", "ingested_at").orderBy(F.desc_nulls_last("ingested_at"), F.desc("seq")).limit(5).select("paper_id", "seq")


@query(f"""WITH {GRAPH_SQL} SELECT (SELECT count(DISTINCT paper_id) FROM papers) AS papers, (SELECT count(*) FROM nodes) AS entities, (SELECT count(*) FROM edges) AS relations, (SELECT count(DISTINCT chunk_id) FROM chunks) AS chunks""")
def overview(spark, root):
    v = vertices(spark, root, "entity_id")
    counts = [
        table(spark, root, "papers", "paper_id").agg(F.count_distinct("paper_id").alias("papers")),
        v.agg(F.count(F.lit(1)).alias("entities")),
        links(spark, root, "relation_type", nodes=v).agg(F.count(F.lit(1)).alias("relations")),
        table(spark, root, "chunks", "chunk_id").agg(F.count_distinct("chunk_id").alias("chunks")),
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(c)  # single rows
    return out


@query(f"""WITH {NODES_SQL} SELECT entity_id, entity_type, name FROM nodes WHERE contains(lower(name), 'model') OR contains(lower(entity_type), 'model') ORDER BY seq LIMIT 12""")
def global_search(spark, root):
    v = vertices(spark, root, "entity_type", "name")
    return v.where(F.contains(F.lower("name"), F.lit("model")) | F.contains(F.lower("entity_type"), F.lit("model"))).orderBy("seq").limit(12).select("entity_id", "entity_type", "name")


@query(f"""WITH {GRAPH_SQL}, shown AS (SELECT * FROM nodes WHERE entity_type IN ('Method', 'Dataset', 'Paper'))
SELECT e.source_entity_id, e.target_entity_id, e.relation_type, contains(lower(a.name), 'graph') OR contains(lower(b.name), 'graph') AS highlighted
FROM edges e JOIN shown a ON a.entity_id = source_entity_id JOIN shown b ON b.entity_id = target_entity_id""")
def graph_view(spark, root):
    v = vertices(spark, root, "entity_type", "name")
    shown = v.where(F.col("entity_type").isin("Method", "Dataset", "Paper")).select("entity_id", F.contains(F.lower("name"), F.lit("graph")).alias("h"))
    e = links(spark, root, "relation_type", nodes=v).select("source_entity_id", "target_entity_id", "relation_type")
    a, b = shown.select(F.col("entity_id").alias("source_entity_id"), F.col("h").alias("ha")), shown.select(F.col("entity_id").alias("target_entity_id"), F.col("h").alias("hb"))
    return e.join(a, "source_entity_id").join(b, "target_entity_id").select("source_entity_id", "target_entity_id", "relation_type", (F.col("ha") | F.col("hb")).alias("highlighted"))


@query(f"""WITH {NODES_SQL} SELECT entity_id, left(coalesce(nullif(trim(coalesce(element_at(properties, 'name_zh')[1], '')), ''), name), 28) AS label,
CASE WHEN coalesce(community_id, -1) < 0 THEN 'none' ELSE 'community-' || CAST(community_id % 12 AS VARCHAR) END AS colour,
CAST(CASE WHEN contains(lower(name), 'graph') THEN 1.4 WHEN coalesce(community_id, -1) < 0 THEN 1.0 ELSE 1.1 END AS DOUBLE) AS boost FROM nodes""")
def node_style(spark, root):
    return dashboard.styled(vertices(spark, root, "name", "properties", "community_id"), "graph")


@query(f"""WITH {NODES_SQL} SELECT entity_type, count(*) AS n, CASE entity_type {' '.join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(ENTITY_TYPES))} ELSE 99 END AS place,
CASE entity_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_LABELS_ZH.items())} ELSE entity_type END AS label FROM nodes GROUP BY 1""")
def type_order(spark, root):
    return dashboard.ordered_types(vertices(spark, root, "entity_type").groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")))


@query("SELECT event_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def activity_log(spark, root):
    return table(spark, root, "events", "event_id", "event_type", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(20)


@query(f"""WITH {GRAPH_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source_paper_id ORDER BY seq) AS k FROM edges)
SELECT source_paper_id, k AS place, left(source_entity_name, 20) || ' → ' || relation_type || ' → ' || left(target_entity_name, 20) AS path FROM r WHERE k <= 5""")
def evidence_paths(spark, root):
    return dashboard.evidence_paths(links(spark, root, "source_paper_id", "source_entity_name", "target_entity_name"), 5)


@query(f"""WITH {NODES_SQL}, o AS (SELECT *, CASE entity_type WHEN 'Method' THEN 0 WHEN 'Model' THEN 1 WHEN 'Dataset' THEN 2 WHEN 'Metric' THEN 3 WHEN 'Task' THEN 4 WHEN 'Paper' THEN 5 END AS k FROM nodes),
d AS (SELECT source_paper_id, name, min(k) AS k FROM o WHERE k IS NOT NULL GROUP BY 1, 2)
SELECT source_paper_id, name, CAST(k AS BIGINT) AS type_place FROM d""")
def evidence_entities(spark, root):
    return dashboard.evidence_entities(vertices(spark, root, "entity_type", "name", "source_paper_id"))


@query(f"""WITH {NODES_SQL} SELECT lower(source_paper_id) AS pid, count(*) AS n_entities, (SELECT count(*) FROM triples t WHERE lower(t.source_paper_id) = lower(n.source_paper_id)) AS n_triples FROM nodes n WHERE source_paper_id IS NOT NULL GROUP BY source_paper_id""")
def delete_impact(spark, root):
    e = vertices(spark, root, "source_paper_id").where("source_paper_id IS NOT NULL").groupBy(F.lower("source_paper_id").alias("pid")).agg(F.count(F.lit(1)).alias("n_entities"))
    t = table(spark, root, "triples", "source_paper_id").groupBy(F.lower("source_paper_id").alias("pid")).agg(F.count(F.lit(1)).alias("n_triples"))
    return e.join(t, "pid", "left").select("pid", "n_entities", F.coalesce("n_triples", F.lit(0)).alias("n_triples"))


@query(f"""WITH {GRAPH_SQL}, gone AS (SELECT entity_id FROM nodes WHERE lower(source_paper_id) = (SELECT min(lower(source_paper_id)) FROM nodes))
SELECT triple_id, source_entity_id, target_entity_id FROM edges WHERE source_entity_id NOT IN (SELECT * FROM gone) AND target_entity_id NOT IN (SELECT * FROM gone)""")
def delete_paper(spark, root):
    v = vertices(spark, root, "source_paper_id")
    first = v.agg(F.min(F.lower("source_paper_id")).alias("p"))
    gone = v.withColumn("p", F.lower("source_paper_id")).join(F.broadcast(first), "p", "left_semi").select("entity_id")
    return graph.delete_entities(v, links(spark, root, "triple_id", nodes=v), gone)[1].select("triple_id", "source_entity_id", "target_entity_id")


@query(f"""WITH {GRAPH_SQL}, {_HUB_SQL} SELECT (SELECT count(*) FROM nodes WHERE entity_id NOT IN (SELECT seed FROM hub)) AS entities_left,
(SELECT count(*) FROM edges WHERE source_entity_id NOT IN (SELECT seed FROM hub) AND target_entity_id NOT IN (SELECT seed FROM hub)) AS edges_left""")
def delete_cascade(spark, root):
    v = vertices(spark, root, "entity_id")
    e = links(spark, root, "relation_type", nodes=v)
    kept, left = graph.delete_entities(v, e, F.broadcast(_hub(e).withColumnRenamed("seed", "entity_id")))
    return kept.agg(F.count(F.lit(1)).alias("entities_left")).crossJoin(left.agg(F.count(F.lit(1)).alias("edges_left")))


def _same_name(v: DataFrame) -> DataFrame:
    """(entity_id, primary_id): entities whose type and normalised name an earlier one has."""
    norm = v.where("name IS NOT NULL").withColumn("norm", normalized_name(F.col("name")))
    first = norm.groupBy("entity_type", "norm").agg(F.min_by("entity_id", "seq").alias("primary_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return norm.join(first, ["entity_type", "norm"]).where("entity_id <> primary_id").select("entity_id", "primary_id")


_MOVED_SQL = f"""norm AS (SELECT *, {norm_sql("name")} AS norm FROM nodes WHERE name IS NOT NULL),
moved AS (SELECT entity_id, first_value(entity_id) OVER (PARTITION BY entity_type, norm ORDER BY seq) AS primary_id FROM norm QUALIFY entity_id <> primary_id)"""


@query(f"WITH {NODES_SQL}, {_MOVED_SQL} SELECT entity_id, primary_id FROM moved")
def name_norm_groups(spark, root):
    return _same_name(vertices(spark, root, "entity_type", "name"))


@query(f"""WITH {GRAPH_SQL}, {_MOVED_SQL}, r AS (SELECT coalesce(a.primary_id, source_entity_id) AS s, coalesce(b.primary_id, target_entity_id) AS t, triple_id, seq, a.primary_id IS NULL AND b.primary_id IS NULL AS own
  FROM edges LEFT JOIN moved a ON a.entity_id = source_entity_id LEFT JOIN moved b ON b.entity_id = target_entity_id)
SELECT s AS source_entity_id, t AS target_entity_id, triple_id FROM r QUALIFY row_number() OVER (PARTITION BY s, t ORDER BY own DESC, seq DESC) = 1""")
def merge_entities(spark, root):
    v = vertices(spark, root, "entity_type", "name")
    return graph.redirect(links(spark, root, "triple_id", nodes=v), _same_name(v)).select("source_entity_id", "target_entity_id", "triple_id")


@query("""WITH e AS (SELECT * FROM entities WHERE entity_id IS NOT NULL),
h AS (SELECT entity_id, arg_max(name, struct_pack(l := length(name), s := -seq)) AS name, arg_max(description, struct_pack(l := length(description), s := -seq)) AS description, count(*) AS n_rows FROM e GROUP BY 1),
c AS (SELECT entity_id, list(DISTINCT x ORDER BY x) AS ids FROM (SELECT entity_id, unnest(source_chunk_ids) AS x FROM e) WHERE x IS NOT NULL GROUP BY 1),
p AS (SELECT entity_id, k, v, min(seq) AS seen FROM (SELECT entity_id, seq, unnest(map_keys(properties)) AS k, unnest(map_values(properties)) AS v FROM e) WHERE v IS NOT NULL AND v <> '' GROUP BY ALL),
q AS (SELECT entity_id, k, string_agg(v, '; ' ORDER BY seen, v) AS v FROM p GROUP BY ALL)
SELECT h.entity_id, name, description, n_rows, len(coalesce(ids, [])) AS n_chunks, (SELECT count(*) FROM q WHERE q.entity_id = h.entity_id) AS n_properties,
  (SELECT coalesce(string_agg(k || '=' || v, '|' ORDER BY k), '') FROM q WHERE q.entity_id = h.entity_id) AS properties FROM h LEFT JOIN c ON c.entity_id = h.entity_id""")
def attribute_merge(spark, root):
    e = table(spark, root, "entities", "entity_id", "seq", "name", "description", "properties", "source_chunk_ids", "source_paper_ids").where("entity_id IS NOT NULL")
    m = graph.merge_attributes(e, F.col("entity_id"))
    props = F.from_json("properties", "array<struct<k:string,v:string>>")
    return m.select(
        F.col("grp").alias("entity_id"), "name", "description", "n_rows", F.size(F.filter("source_chunk_ids", lambda x: x.isNotNull())).cast("long").alias("n_chunks"),
        F.size(props).cast("long").alias("n_properties"), F.array_join(F.transform(props, lambda x: F.concat(x["k"], F.lit("="), x["v"])), "|").alias("properties"),
    )


@query(f"""WITH {NODES_SQL}, p AS (SELECT entity_id, string_agg(replace(replace(k, '-', '_'), ' ', '_') || '=' || left(v, 500), '|' ORDER BY replace(replace(k, '-', '_'), ' ', '_'), left(v, 500)) AS properties
  FROM (SELECT entity_id, unnest(map_keys(properties)) AS k, unnest(map_values(properties)) AS v FROM nodes) WHERE v IS NOT NULL GROUP BY 1)
SELECT n.entity_id, name, entity_type, source_paper_id, CASE WHEN entity_type IN ('Paper', 'Method', 'Dataset') THEN entity_type ELSE '' END AS label, coalesce(p.properties, '') AS properties FROM nodes n LEFT JOIN p ON p.entity_id = n.entity_id""")
def export_nodes(spark, root):
    out = graph.export_nodes(vertices(spark, root, "name", "entity_type", "source_paper_id", "properties"))
    pairs = F.from_json("properties", "array<struct<k:string,v:string>>")
    return out.withColumn("properties", F.array_join(F.transform(pairs, lambda x: F.concat(x["k"], F.lit("="), x["v"])), "|"))


@query(f"""WITH {NODES_SQL}, t AS (SELECT source_entity_id, target_entity_id, {RELATION_SQL} AS relation_type, confidence, seq FROM triples
  WHERE source_entity_id IN (SELECT entity_id FROM nodes) AND target_entity_id IN (SELECT entity_id FROM nodes))
SELECT source_entity_id, target_entity_id, relation_type, {CONFIDENCE_SQL} AS weight FROM t QUALIFY row_number() OVER (PARTITION BY source_entity_id, target_entity_id, relation_type ORDER BY seq DESC) = 1""")
def export_edges(spark, root):
    return graph.export_edges(table(spark, root, "triples", "seq", "source_entity_id", "target_entity_id", "relation_type", "confidence"), vertices(spark, root, "entity_id"))


@query(f"""WITH {GRAPH_SQL}, l AS (SELECT source_paper_id, seq, '- ' || coalesce(source_entity_name, '') || ' --[' || relation_type || ']--> ' || coalesce(target_entity_name, '') ||
  CASE WHEN coalesce(description, '') <> '' THEN ' （' || description || '）' ELSE '' END || '（置信度 ' || printf('%.2f', {CONFIDENCE_SQL}) || '）' || CASE WHEN {CONFIDENCE_SQL} < 0.7 THEN '  【待验证】' ELSE '' END AS line, {CONFIDENCE_SQL} AS c FROM edges)
SELECT source_paper_id, string_agg(line, chr(10) ORDER BY c DESC, seq, line) AS text FROM l GROUP BY 1""")
def triples_text(spark, root):
    e = links(spark, root, "description", "source_paper_id", "source_entity_name", "target_entity_name", "confidence")
    lines = e.select("source_paper_id", "seq", (-confidence(F.col("confidence"))).alias("c"), graph.triple_lines().alias("line"))
    return lines.groupBy("source_paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "seq", "line"))), lambda x: x["line"]), "\n").alias("text"))


@query(f"""WITH {NODES_SQL}, x AS (SELECT t.*, s.entity_id AS exact_id, l.entity_id AS lower_id FROM (SELECT DISTINCT source_paper_id, trim(source_entity_name) AS name FROM triples WHERE source_entity_name IS NOT NULL) t
LEFT JOIN (SELECT name, max_by(entity_id, seq) AS entity_id FROM nodes GROUP BY 1) s ON s.name = t.name
LEFT JOIN (SELECT lower(trim(name)) AS name, min_by(entity_id, seq) AS entity_id FROM nodes GROUP BY 1) l ON l.name = lower(t.name))
SELECT source_paper_id, name, coalesce(exact_id, lower_id) AS entity_id, CASE WHEN exact_id IS NOT NULL THEN 'exact' WHEN lower_id IS NOT NULL THEN 'lower' ELSE 'rejected' END AS how FROM x""")
def endpoint_resolve(spark, root):
    t = table(spark, root, "triples", "source_paper_id", "source_entity_name").where("source_entity_name IS NOT NULL")
    names = t.select("source_paper_id", F.trim("source_entity_name").alias("name")).distinct()
    v = vertices(spark, root, "name").where("name IS NOT NULL")
    exact = v.groupBy("name").agg(F.max_by("entity_id", "seq").alias("exact_id"))
    lower = v.groupBy(F.lower(F.trim("name")).alias("low")).agg(F.min_by("entity_id", "seq").alias("lower_id"))
    x = names.join(exact, "name", "left").join(lower, F.lower(names["name"]) == lower["low"], "left")
    how = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("lower_id").isNotNull(), "lower").otherwise("rejected")
    return x.select("source_paper_id", "name", F.coalesce("exact_id", "lower_id").alias("entity_id"), how.alias("how"))
