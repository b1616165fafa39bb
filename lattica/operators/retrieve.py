"""Questions: their type and keywords, and what the graph and the chunks hold for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.constants import CHUNK_CONTEXT, CROSS_PAPER_WORDS, GRAPH_CONTEXT, PREVIEW_CHARS, QUESTION_KEYWORDS, STOPWORDS, SYNONYMS, TYPE_PRIORITY
from lattica.functions.text import json_span
from lattica.operators.calls import Generator, Policy, answered
from lattica.operators.extract import PROMPTS, filled
from lattica.plans.tables import cut, maybe_broadcast

TOKENS = r"[a-zA-Z]+|[^\x00-\x7F]+"


def question_type(question: Column) -> tuple[Column, Column]:
    """(type, score): the type with most of its words in the question, the first declared among equals, 'general' without any."""
    q = F.lower(question)
    scores = [sum((F.contains(q, F.lit(w.lower())).cast("int") for w in words), F.lit(0)) for words in QUESTION_KEYWORDS.values()]
    best = F.greatest(*scores)
    kind = F.coalesce(*(F.when((s == best) & (best > 0), F.lit(t)) for t, s in zip(QUESTION_KEYWORDS, scores, strict=True)), F.lit("general"))
    return kind, best


def keywords(question: Column) -> Column:
    """Runs of letters or of other scripts, without stop words and scraps; case, order and repetition kept."""
    tokens = F.regexp_extract_all(question, F.lit(TOKENS), F.lit(0))
    return F.filter(tokens, lambda t: (F.length(t) >= 3) & ~F.lower(t).isin(STOPWORDS))


def analysed(questions: DataFrame, generator: Generator | None = None, policy: Policy = Policy()) -> DataFrame:
    """(question_id, question, question_type, keywords) of a stated set (question_id, question): a generator's keywords, expanded, or else by rule.

    An answer without a readable object, or a call that fails, leaves the question to the rule.
    """
    kind, words = question_type(F.col("question"))[0], keywords(F.col("question"))
    if generator is None:
        return questions.select("question_id", "question", kind.alias("question_type"), words.alias("keywords"))
    prompts = questions.select("question_id", "question", filled(PROMPTS["keywords"], question=F.col("question")).alias("prompt"))
    read = cut(answered(prompts, "prompt", generator, policy), "keywords").withColumn("x", F.from_json(json_span(F.col("output")), "keywords array<string>, question_type string, _corrupt_record string"))
    good = F.col("x").isNotNull() & F.col("x._corrupt_record").isNull()
    asked = expanded(F.filter(F.coalesce("x.keywords", F.array().cast("array<string>")), lambda w: w.isNotNull()))
    return read.select("question_id", "question", F.when(good, F.coalesce("x.question_type", F.lit("general"))).otherwise(kind).alias("question_type"), F.when(good, asked).otherwise(words).alias("keywords"))


def expanded(words: Column) -> Column:
    """The keywords plus the synonyms of each concept one of them names, sorted and distinct."""
    def names(concept: str, english: list[str]):
        return lambda w: reduce(lambda a, e: a | F.contains(F.lower(w), F.lit(e)), english, F.contains(w, F.lit(concept)))

    none = F.array().cast("array<string>")
    groups = [F.when(F.exists(words, names(zh, english)), F.array(*map(F.lit, english))).otherwise(none) for zh, english in SYNONYMS.items()]
    return F.array_sort(F.array_distinct(F.concat(words, *groups)))


def priorities(spark: SparkSession) -> DataFrame:
    """(question_type, entity_type, place): a fixed table."""
    return spark.createDataFrame([(q, t, i) for q, types in TYPE_PRIORITY.items() for i, t in enumerate(types)], "question_type string, entity_type string, place int")


def match_entities(questions: DataFrame, vertices: DataFrame) -> DataFrame:
    """(question_id, entity_id): per question the entities of the first pass that finds any.

    Pass 1 matches keywords in names of the type's entities, pass 2 in any name, pass 3 takes all of those
    types. `questions` (question_id, question_type, keywords) is a stated set; it is broadcast if small.
    """
    types = F.create_map(*(x for q, ts in TYPE_PRIORITY.items() for x in (F.lit(q), F.array(*map(F.lit, ts)))))
    q = maybe_broadcast(questions.select("question_id", "keywords", types[F.col("question_type")].alias("types")).where("types IS NOT NULL"))
    named = F.exists("keywords", lambda k: F.contains(F.lower("name"), F.lower(F.trim(k))))
    wanted = F.array_contains("types", F.col("entity_type"))
    step = F.when(named & wanted, 1).when(named, 2).when(wanted, 3)
    hits = cut(vertices.select("entity_id", "entity_type", "name").join(q, F.lit(True)).select("question_id", "entity_id", step.alias("pass")).where("pass IS NOT NULL"), "hits")
    first = hits.groupBy("question_id").agg(F.min("pass").alias("pass"))
    return hits.join(maybe_broadcast(first), ["question_id", "pass"]).select("question_id", "entity_id", "pass")


def within_papers(entities: DataFrame, triples: DataFrame, papers: list[str]) -> tuple[DataFrame, DataFrame]:
    """Entities and triples of the given papers, triples only between kept entities."""
    wanted = [p.lower().strip() for p in papers]
    kept = entities.where(F.lower(F.trim("source_paper_id")).isin(wanted))
    ids = kept.select("entity_id")
    left = triples.where(F.lower(F.trim("source_paper_id")).isin(wanted))
    left = left.join(ids.withColumnRenamed("entity_id", "source_entity_id"), "source_entity_id", "left_semi").join(ids.withColumnRenamed("entity_id", "target_entity_id"), "target_entity_id", "left_semi")
    return kept, left


def chunk_lines(place: Column, title: Column, section: Column, text: Column) -> Column:
    """A numbered chunk for a prompt: paper, section and a preview."""
    preview = F.when(F.length(text) > PREVIEW_CHARS, F.concat(F.substring(text, 1, PREVIEW_CHARS), F.lit("..."))).otherwise(text)
    named = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("（"), section, F.lit("）"))).otherwise("")
    return F.concat(place.cast("string"), F.lit(". 【"), title, F.lit("】"), named, F.lit("\n   "), preview)


def vector_text(hits: DataFrame, key: str) -> DataFrame:
    """(key, vector_text): the ranked chunks of each question under a heading; `hits` has place, title, section_title, content."""
    lines = hits.select(key, "place", chunk_lines(F.col("place"), F.col("title"), F.col("section_title"), F.col("content")).alias("line"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy(key).agg(F.concat(F.lit("## 相关论文片段（"), F.count(F.lit(1)).cast("string"), F.lit(" 个）:\n"), ordered).alias("vector_text"))


def fused(kg_text: Column, chunks: Column, overview: Column) -> Column:
    """Graph text and chunk text under their headings; the overview where there is neither."""
    kg = F.when(F.coalesce(kg_text, F.lit("")) != "", F.concat(F.lit(GRAPH_CONTEXT + "\n"), kg_text))
    ch = F.when(F.coalesce(chunks, F.lit("")) != "", F.concat(F.lit(f"\n{CHUNK_CONTEXT}\n"), chunks))
    return F.when(kg.isNull() & ch.isNull(), overview).otherwise(F.concat_ws("\n", kg, ch))


def crosses_papers(questions: DataFrame, papers: DataFrame) -> DataFrame:
    """(question_id, crosses): a comparing word, or two or more papers named by their start or first words.

    `papers` has a column name; a paper counts once per row.
    """
    asked = maybe_broadcast(questions.select("question_id", F.lower("question").alias("q")))
    by_word = F.lit(False)
    for w in CROSS_PAPER_WORDS:
        by_word = by_word | F.contains("q", F.lit(w))
    low = F.lower("name")
    heads = F.filter(F.slice(F.split(low, r"(?U)\s+"), 1, 5), lambda w: w != "")
    named = papers.where("name IS NOT NULL").select(F.substring(low, 1, 30).alias("start"), heads.alias("heads"))
    hits = named.join(asked, F.contains("q", F.col("start")) | F.exists("heads", lambda w: F.contains("q", w))).groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(hits, "question_id", "left").select("question_id", (by_word | (F.coalesce("n", F.lit(0)) >= 2)).alias("crosses"))


def select_communities(questions: DataFrame, reports: DataFrame, most: int = 5, fallback: int = 3) -> DataFrame:
    """(question_id, community_id, score, place): reports by contained keywords, those with any first; the first few where none has.

    `reports` has community_id and text. The question set is broadcast if small, reports stream past it.
    """
    asked = maybe_broadcast(questions.select("question_id", F.transform("keywords", F.lower).alias("kws")))
    score = F.when(F.size("kws") > 0, F.size(F.filter("kws", lambda k: (k != "") & F.contains(F.lower("text"), k)))).otherwise(1)
    scored = reports.select("community_id", "text").join(asked, F.lit(True)).select("question_id", "community_id", score.alias("score"), (F.size("kws") > 0).alias("asked"))
    by = Window.partitionBy("question_id")
    ranked = scored.withColumn("place", F.row_number().over(by.orderBy(F.desc("score"), "community_id"))).withColumn("top", F.max("score").over(by))
    kept = F.when(~F.col("asked"), F.col("place") <= most).when(F.col("top") > 0, (F.col("score") > 0) & (F.col("place") <= most)).otherwise(F.col("place") <= fallback)
    return ranked.where(kept).select("question_id", "community_id", "score", "place")
