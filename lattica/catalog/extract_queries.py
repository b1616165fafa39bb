"""Extraction: outputs are rebuilt as JSON from the paper, author and entity tables, then read, repaired and resolved."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.constants import DOMAIN_TASKS
from lattica.operators import extract, graph
from lattica.operators.calls import Policy
from lattica.plans.tables import cut, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Where the entities of a type stand in an output.
ARRAYS = {"Method": "methods", "Model": "models", "Dataset": "datasets", "Metric": "metrics", "Result": "results"}


def _outputs(spark, root):
    """(paper_id, output): a fenced JSON object per titled paper, with a trailing comma that has to be repaired.

    Tasks are named by the paper's tasks and, in turn, by the names that are domains too.
    """
    papers = graph.latest(table(spark, root, "papers", "seq", "paper_id", "title", "publication_year").where("paper_id IS NOT NULL AND trim(title) <> ''"), "paper_id")
    authors = table(spark, root, "author_items", "mention_id", "paper_id", "pos", "name", "affiliation").dropDuplicates(["mention_id"])
    a = authors.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "affiliation"))).alias("a"))
    nodes = graph.nodes(table(spark, root, "entities", "entity_id", "seq", "entity_type", "name", "source_paper_id"))
    of = lambda t: F.array_sort(F.collect_list(F.when(F.col("entity_type") == t, F.struct("entity_id", "name"))))
    e = nodes.groupBy(F.col("source_paper_id").alias("paper_id")).agg(*(of(t).alias(f"_{k}") for t, k in ARRAYS.items()), of("Task").alias("_tasks"))
    named = lambda k: F.transform(f"_{k}", lambda x: F.struct(x["name"].alias("name")))
    results = F.transform("_results", lambda x: F.struct(x["name"].alias("method"), F.lit("d").alias("dataset"), F.lit("m").alias("metric"), F.when(F.length(x["name"]) > 12, "1.0").otherwise("").alias("value")))
    domain = F.element_at(F.array(*map(F.lit, DOMAIN_TASKS)), (F.pmod(F.length("title"), F.lit(len(DOMAIN_TASKS))) + 1).cast("int"))
    body = F.to_json(F.struct(
        F.struct("title", F.col("publication_year").cast("string").alias("year")).alias("paper"), F.transform("a", lambda x: F.struct(x["name"].alias("name"), x["affiliation"].alias("affiliation"))).alias("authors"),
        *(named(k).alias(k) for k in ARRAYS.values() if k != "results"), F.array_append(F.coalesce(named("tasks"), F.array().cast("array<struct<name:string>>")), F.struct(domain.alias("name"))).alias("tasks"), results.alias("results"),
        F.transform("a", lambda x: F.struct(F.lit("authored_by_author").alias("type"), F.col("title").alias("source"), F.upper(x["name"]).alias("target"))).alias("relations"),
    ))
    joined = papers.join(a, "paper_id", "left").join(e, "paper_id", "left")
    return joined.select("paper_id", F.concat(F.lit("Here it is:\n```json\n"), F.regexp_replace(body, r"\}$", ",}"), F.lit("\n```\nDone.")).alias("output"))


def _parsed(spark, root):
    # Parsed once: every entity type and the relations read it.
    return cut(_outputs(spark, root).select("paper_id", extract.parsed(F.col("output")).alias("parsed")), "parsed")


_DOMAINS = ", ".join(f"'{t}'" for t in DOMAIN_TASKS)
_BASE = f"""p AS (SELECT paper_id, title, publication_year FROM papers WHERE paper_id IS NOT NULL AND trim(title) <> '' QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY seq DESC) = 1),
a AS (SELECT DISTINCT ON (mention_id) mention_id, paper_id, trim(name, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS name, trim(affiliation) AS affiliation FROM author_items JOIN p USING (paper_id)),
n AS (SELECT source_paper_id AS paper_id, entity_type, trim(name, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS name, name AS raw FROM (SELECT * FROM entities WHERE entity_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY seq DESC) = 1) WHERE source_paper_id IN (SELECT paper_id FROM p)),
k AS (SELECT paper_id, [{_DOMAINS}][length(title) % {len(DOMAIN_TASKS)} + 1] AS name FROM p),
named AS (SELECT paper_id, 'Paper' AS entity_type, trim(title) AS name FROM p UNION ALL SELECT paper_id, 'Author', name FROM a WHERE name <> '' UNION ALL SELECT paper_id, entity_type, name FROM n WHERE entity_type IN ('Method', 'Model', 'Dataset', 'Metric', 'Task') AND name <> ''
UNION ALL SELECT paper_id, 'Task', name FROM k UNION ALL SELECT paper_id, 'Result', trim(raw || ' on d (m)', ' ' || chr(9) || chr(10) || chr(13) || chr(160)) FROM n WHERE entity_type = 'Result' AND length(raw) > 12),
made AS (SELECT * FROM named UNION ALL SELECT DISTINCT paper_id, 'Domain', name FROM named WHERE entity_type = 'Task' AND name IN ({_DOMAINS})
UNION ALL SELECT DISTINCT paper_id, 'Institution', affiliation FROM a WHERE affiliation <> '' AND NOT EXISTS (SELECT 1 FROM named n WHERE n.paper_id = a.paper_id AND n.name = a.affiliation))"""


@query("SELECT paper_id, title, CAST(publication_year AS VARCHAR) AS year FROM papers WHERE paper_id IS NOT NULL AND trim(title) <> '' QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY seq DESC) = 1")
def json_repair(spark, root):
    return _parsed(spark, root).select("paper_id", F.col("parsed.paper.title").alias("title"), F.col("parsed.paper.year").alias("year"))


@query(f"WITH {_BASE} SELECT paper_id, entity_type, name FROM made")
def entity_build(spark, root):
    return extract.entities(_parsed(spark, root)).select("paper_id", "entity_type", "name")


@query(f"WITH {_BASE} SELECT entity_type, count(*) AS n FROM made GROUP BY 1")
def type_histogram(spark, root):
    return extract.entities(_parsed(spark, root)).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_BASE} SELECT paper_id, 'AUTHORED_BY' AS relation_type, upper(name) AS target_entity_name FROM a WHERE name <> ''")
def relation_build(spark, root):
    rows = _parsed(spark, root)
    return extract.triples(rows, cut(extract.entities(rows), "made"))[0].select("paper_id", "relation_type", "target_entity_name")


@query("SELECT seq, 'Context:' || chr(10) || content || chr(10) || chr(10) || 'Question (method): ' || coalesce(section_title, '') AS prompt FROM chunks WHERE content IS NOT NULL")
def prompt_fill(spark, root):
    c = table(spark, root, "chunks", "seq", "content", "section_title").where("content IS NOT NULL")
    return c.select("seq", extract.filled(extract.PROMPTS["single"], context=F.col("content"), question_type=F.lit("method"), question=F.coalesce("section_title", F.lit(""))).alias("prompt"))


@query("""WITH p AS (SELECT paper_id, title, lower(left(trim(title), 1)) AS a FROM papers WHERE paper_id IS NOT NULL AND trim(title) <> '' QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY seq DESC) = 1)
SELECT paper_id, CASE WHEN a BETWEEN 'a' AND 'c' THEN 2 WHEN a BETWEEN 'd' AND 'f' THEN 3 WHEN a BETWEEN 'g' AND 'h' THEN NULL ELSE 1 END AS level, CASE WHEN a BETWEEN 'g' AND 'h' THEN NULL ELSE title END AS title FROM p""")
def extraction_levels(spark, root):
    """The three levels with an offline generator that breaks its first answers for some initials of titles, and all of them for some."""
    papers = _outputs(spark, root).select("paper_id", F.col("output").alias("text"))

    def generator(prompt: str) -> str:
        import re

        body = prompt.split("\n\n", 1)[-1]
        first = re.search(r'"title":"\s*(.)', body).group(1).lower()
        broken = "abcdefgh" if prompt.startswith("Read the paper") else "defgh" if prompt.startswith("Your last answer") else "gh"
        return body.replace('"paper":', '"paper" ') if first in broken else body

    return extract.with_levels(papers, generator, metadata_chars=1 << 20, policy=Policy(concurrent=8)).select("paper_id", "level", F.col("parsed.paper.title").alias("title"))
