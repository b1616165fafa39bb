"""From a model's output to entity and triple rows: spans, repair, parsing, levels, entities, endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.constants import DOMAIN_TASKS, RELATION_TYPES
from lattica.functions.text import json_repaired, json_span, relation_type, strip
from lattica.operators.calls import Generator, Policy, answered
from lattica.plans.tables import cut

SCHEMA = """paper struct<title:string,title_zh:string,year:string,venue:string,abstract:string,description:string>,
authors array<struct<name:string,name_zh:string,affiliation:string,description:string>>,
methods array<struct<name:string,name_zh:string,description:string>>, tasks array<struct<name:string,name_zh:string,description:string>>, metrics array<struct<name:string,name_zh:string,description:string>>,
models array<struct<name:string,name_zh:string,param_count:string,description:string>>, datasets array<struct<name:string,name_zh:string,size:string,domain:string,description:string>>,
results array<struct<method:string,dataset:string,metric:string,value:string,description:string>>, relations array<struct<type:string,source:string,target:string,description:string>>"""

PROMPTS = {
    "extract": "Read the paper and return one JSON object with the keys paper, authors, methods, tasks, metrics, models, datasets, results and relations.\n\n{paper_content}",
    "correct": "Your last answer could not be read: {error_message}.\nReturn one JSON object with the keys paper, authors, methods, tasks, metrics, models, datasets, results and relations, and nothing else.\n\n{paper_content}",
    "metadata": "Return one JSON object with the key paper only: title, year, venue and abstract.\n\n{paper_content}",
    "community": "Entities:\n{entities}\n\nRelations:\n{relations}\n\nReturn a JSON object with title, summary and key_findings.",
    "keywords": "Name the methods, datasets, papers and other things this question is about, not general terms.\nReturn one JSON object with the keys keywords (a list of strings) and question_type (method, limitation, summary, comparison or general).\n\nQuestion: {question}",
    "global": "Themes:\n{community_reports}\n\nAnswer from these themes: {question}",
    "single": "Context:\n{context}\n\nQuestion ({question_type}): {question}",
    "cross": "Context from several papers:\n{context}\n\nCompare them for the question ({question_type}): {question}",
}


def filled(template: str, **values: Column) -> Column:
    """A template with its placeholders replaced literally."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def parsed(output: Column) -> Column:
    """The validated struct of a model's output, read as it is or else repaired; null without a title."""
    span = json_span(output)
    first, second = F.from_json(span, SCHEMA), F.from_json(json_repaired(span), SCHEMA)
    good = lambda s: s["paper"]["title"].isNotNull() & (F.trim(s["paper"]["title"]) != "")
    return F.when(good(first), first).when(good(second), second)


LEVELS = ("extract", "correct", "metadata")


def with_levels(papers: DataFrame, generator: Generator, text: str = "text", metadata_chars: int = 5000, policy: Policy = Policy()) -> DataFrame:
    """`papers` plus level (1 to 3, null if all failed) and parsed: the full prompt, a correction, metadata only.

    A paper goes on to the next level if its answer does not read: no object, broken JSON, no title, or a failed call.
    Each level is asked once, of those left over, and written before the next; errors that repeating will not cure end the job.
    """
    columns, left, done = papers.columns, papers, None
    for level, name in enumerate(LEVELS, 1):
        body = F.coalesce(F.col(text), F.lit(""))
        prompt = filled(PROMPTS[name], paper_content=F.substring(body, 1, metadata_chars) if name == "metadata" else body, error_message=F.lit("it was no valid JSON object or lacked required fields"))
        read = answered(left.withColumn("_prompt", prompt), "_prompt", generator, policy).withColumn("parsed", parsed(F.col("output")))
        read = cut(read.select(*columns, "parsed"), "level")
        good = read.where("parsed IS NOT NULL").select(*columns, F.lit(level).alias("level"), "parsed")
        done = good if done is None else done.unionByName(good)
        left = read.where("parsed IS NULL").select(*columns)
    return done.unionByName(read.where("parsed IS NULL").select(*columns, F.lit(None).cast("int").alias("level"), "parsed"))


def _id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)


def entities(rows: DataFrame) -> DataFrame:
    """(paper_id, entity_id, entity_type, name, description, properties) from parsed rows (paper_id, parsed).

    Items without a name, results without a value and places already named make no entity.
    """
    p = rows.where("parsed IS NOT NULL").select("paper_id", "parsed.*")

    def of(kind: str, array: str, **props: str) -> DataFrame:
        x = p.select("paper_id", F.explode(array).alias("x"))
        values = F.create_map(*(v for k, f in props.items() for v in (F.lit(k), F.col(f"x.{f}")))) if props else F.create_map().cast("map<string,string>")
        kept = F.map_filter(values, lambda _, v: v.isNotNull())
        return x.where(strip(F.col("x.name")) != "").select("paper_id", F.lit(kind).alias("entity_type"), strip(F.col("x.name")).alias("name"), F.col("x.description").alias("description"), kept.alias("properties"))

    paper = p.select("paper_id", F.lit("Paper").alias("entity_type"), strip(F.col("paper.title")).alias("name"), F.coalesce(F.nullif("paper.description", F.lit("")), F.nullif("paper.abstract", F.lit("")), "paper.title").alias("description"), F.map_filter(F.create_map(F.lit("year"), F.col("paper.year"), F.lit("venue"), F.col("paper.venue"), F.lit("abstract"), F.col("paper.abstract"), F.lit("name_zh"), F.col("paper.title_zh")), lambda _, v: v.isNotNull()).alias("properties"))
    parts = [
        paper, of("Author", "authors", affiliation="affiliation", name_zh="name_zh"), of("Method", "methods", description="description", name_zh="name_zh"), of("Model", "models", param_count="param_count", description="description", name_zh="name_zh"),
        of("Dataset", "datasets", size="size", domain="domain", description="description", name_zh="name_zh"), of("Task", "tasks", description="description", name_zh="name_zh"), of("Metric", "metrics", description="description", name_zh="name_zh"),
    ]
    r = p.select("paper_id", F.explode("results").alias("x")).where("x.value IS NOT NULL AND x.value <> ''")
    named = F.concat(F.coalesce("x.method", F.lit("")), F.lit(" on "), F.coalesce("x.dataset", F.lit("")), F.lit(" ("), F.coalesce("x.metric", F.lit("")), F.lit(")"))
    parts.append(r.select("paper_id", F.lit("Result").alias("entity_type"), strip(named).alias("name"), F.col("x.description").alias("description"), F.map_filter(F.create_map(*(v for k in ("method", "dataset", "metric", "value") for v in (F.lit(k), F.col(f"x.{k}")))), lambda _, v: v.isNotNull()).alias("properties")))
    made = parts[0]
    for x in parts[1:]:
        made = made.unionByName(x)
    none = F.create_map().cast("map<string,string>")
    places = p.select("paper_id", F.explode("authors").alias("x")).where(strip(F.col("x.affiliation")) != "").select("paper_id", strip(F.col("x.affiliation")).alias("name")).distinct()
    places = places.join(made.select("paper_id", "name"), ["paper_id", "name"], "left_anti").select("paper_id", F.lit("Institution").alias("entity_type"), "name", F.lit("").alias("description"), none.alias("properties"))
    domains = made.where((F.col("entity_type") == "Task") & F.col("name").isin(DOMAIN_TASKS)).select("paper_id", F.lit("Domain").alias("entity_type"), "name", F.lit("").alias("description"), none.alias("properties")).dropDuplicates(["paper_id", "name"])
    return made.unionByName(places).unionByName(domains).withColumn("entity_id", _id(F.col("paper_id"), F.col("entity_type"), F.col("name")))


def triples(rows: DataFrame, made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(triples, rejects): relations whose ends are entities of the paper, by exact name or else by lower case, and the others."""
    rel = rows.where("parsed IS NOT NULL").select("paper_id", F.posexplode("parsed.relations").alias("pos", "x")).select("paper_id", "pos", relation_type(F.col("x.type")).alias("relation_type"), strip(F.col("x.source")).alias("s"), strip(F.col("x.target")).alias("t"), F.col("x.description").alias("description"))
    exact = made.groupBy("paper_id", "name").agg(F.max_by("entity_id", "entity_type").alias("id"))
    lower = made.groupBy("paper_id", F.lower("name").alias("name")).agg(F.min_by("entity_id", "entity_type").alias("id"))
    for end in ("s", "t"):
        e = exact.select("paper_id", F.col("name").alias(end), F.col("id").alias(f"{end}_exact"))
        low = lower.select("paper_id", F.col("name").alias(f"{end}_low"), F.col("id").alias(f"{end}_lower"))
        rel = rel.join(e, ["paper_id", end], "left").withColumn(f"{end}_low", F.lower(end)).join(low, ["paper_id", f"{end}_low"], "left").withColumn(f"{end}_id", F.coalesce(f"{end}_exact", f"{end}_lower"))
    good = F.col("s_id").isNotNull() & F.col("t_id").isNotNull() & F.col("relation_type").isin(RELATION_TYPES)
    out = rel.where(good).select("paper_id", _id(F.col("paper_id"), F.col("pos").cast("string"), F.col("s_id"), F.col("t_id")).alias("triple_id"), "relation_type", F.col("s_id").alias("source_entity_id"), F.col("t_id").alias("target_entity_id"), F.col("s").alias("source_entity_name"), F.col("t").alias("target_entity_name"), "description")
    return out, rel.where(~good).select("paper_id", "pos", "relation_type", F.col("s").alias("source"), F.col("t").alias("target"))


def cross_paper_answer(answer: Column) -> Column:
    """Text of a parsed comparison struct<summary, details array<struct<method, description, experiments, advantage>>, missing_papers>."""
    shown = lambda x: F.coalesce(x, F.lit("")) != ""
    runs = lambda d: F.transform(F.coalesce(d["experiments"], F.array()), lambda e: F.concat(F.lit("     · 在 "), e["paper"], F.lit(" 中，使用 "), e["dataset"], F.lit(" 数据集，"), e["metric"], F.lit("="), e["result"]))
    detail = F.transform(
        F.coalesce(answer["details"], F.array()),
        lambda d, i: F.array_join(
            F.array_compact(F.array(
                F.concat((i + 1).cast("string"), F.lit(". **"), F.coalesce(d["method"], F.lit("")), F.lit("**")),
                F.when(shown(d["description"]), F.concat(F.lit("   - 描述："), d["description"])),
                F.when(F.size(runs(d)) > 0, F.concat(F.lit("   - 实验：\n"), F.array_join(runs(d), "\n"))),
                F.when(shown(d["advantage"]), F.concat(F.lit("   - 优势："), d["advantage"])), F.lit(""),
            )), "\n",
        ),
    )
    missing = F.when(F.size(F.coalesce(answer["missing_papers"], F.array())) > 0, F.concat(F.lit("> ⚠️ **以下论文暂无数据**（请先在「论文管理」页处理）：\n"), F.array_join(F.transform(answer["missing_papers"], lambda m: F.concat(F.lit("> - "), m)), "\n")))
    return F.concat_ws("\n", F.coalesce(answer["summary"], F.lit("")), F.lit(""), F.array_join(detail, "\n"), missing)
