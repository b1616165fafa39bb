"""Answers to a stated set of questions: what the graph, the chunks and the communities hold for each, laid out as a prompt and put to a generator.

Every step works on all questions at once, keyed by question_id. Prompts are built and answered on the executors; only answers are short.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lattica.constants import ANSWER_FAILED, CHUNK_CONTEXT, FROM_PAPER, GLOBAL_THEMES, GRAPH_CONTEXT, KG_HOPS, KNOWN_METHODS, KNOWN_PAPERS, LOCAL_HITS, NO_DATA, STATISTICS_WORDS, TOP_K_CHUNKS
from lattica.functions.text import confidence, json_span
from lattica.operators import calls, extract, graph, retrieve
from lattica.operators.calls import Generator, Policy
from lattica.plans.tables import cut, maybe_broadcast

#: Questions that share a word of marks.
MARKS = 62

NO_THEMES = "尚未生成社区摘要，请先生成后再问综述性问题。"
COMPARISON = "struct<summary:string,details:array<struct<method:string,description:string,experiments:array<struct<paper:string,dataset:string,metric:string,result:string>>,advantage:string>>,missing_papers:array<string>>"


def numbered(questions: DataFrame) -> DataFrame:
    """(question_id, word, bit): the mark of each question of a stated set."""
    ids = questions.select("question_id").distinct().orderBy("question_id").collect()
    kind = questions.schema["question_id"].dataType.simpleString()
    return questions.sparkSession.createDataFrame([(r.question_id, i // MARKS, 1 << i % MARKS) for i, r in enumerate(ids)], f"question_id {kind}, word int, bit long")


def unfolded(marked: DataFrame, numbers: DataFrame) -> DataFrame:
    """Rows (word, bits, ...) as one row per question that has a bit there, with question_id in their place."""
    return marked.join(F.broadcast(numbers), "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0).drop("word", "bits", "bit")  # a row per question


def counted(marked: DataFrame, numbers: DataFrame, n: str, **more: Column) -> DataFrame:
    """(question_id, n, ...): the rows of each question, and of them those where each further column is not null."""
    held = marked.groupBy("word", "bits").agg(F.count(F.lit(1)).alias(n), *(F.count(c).alias(k) for k, c in more.items()))
    return unfolded(held, numbers).groupBy("question_id").agg(*(F.sum(c).alias(c) for c in (n, *more)))


def marked_subgraph(asked: DataFrame, numbers: DataFrame, vertices: DataFrame, links: DataFrame, papers: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, triples): what lies within KG_HOPS outgoing steps of the matched entities, the edges each one's own; a row has word and bits for its questions."""
    matched = retrieve.match_entities(asked, vertices).join(F.broadcast(numbers), "question_id")  # a row per question
    seeds = cut(matched.groupBy("word", F.col("entity_id").alias("node")).agg(F.bit_or("bit").alias("bits")), "matched")
    reached, inside = graph.marked_ego(links, seeds, KG_HOPS)
    entities, triples = vertices.join(reached.withColumnRenamed("node", "entity_id"), "entity_id"), links.join(inside, ["source_entity_id", "target_entity_id"])
    if papers:
        wanted = [p.lower().strip() for p in papers]
        entities = entities.where(F.lower(F.trim("source_paper_id")).isin(wanted))
        ids = entities.select("word", "entity_id", F.col("bits").alias("_end"))
        triples = triples.where(F.lower(F.trim("source_paper_id")).isin(wanted))
        for end in ("source_entity_id", "target_entity_id"):
            triples = triples.join(ids.withColumnRenamed("entity_id", end), ["word", end]).withColumn("bits", F.col("bits").bitwiseAND(F.col("_end"))).drop("_end")
        triples = triples.where("bits <> 0")
    return cut(entities, "entities"), cut(triples, "triples")


def subgraph(asked: DataFrame, vertices: DataFrame, links: DataFrame, papers: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """`marked_subgraph` with a row for each question_id."""
    numbers = numbered(asked)
    entities, triples = marked_subgraph(asked, numbers, vertices, links, papers)
    return unfolded(entities, numbers), unfolded(triples, numbers)


def nearest_chunks(questions: DataFrame, embedded: DataFrame, k: int = TOP_K_CHUNKS) -> DataFrame:
    """(question_id, place, distance, chunk_id, paper_id, section_title, content, ...): a stated question set (question_id, vector) against all chunks.

    Each batch of chunks is scored for all questions at once, in the order of `cosine`, and keeps its best k of a question.
    """
    asked, kind = [(r.question_id, [float(v) for v in r.vector]) for r in questions.collect()], questions.schema["question_id"].dataType
    schema = pa.schema([("question_id", to_arrow_type(kind)), ("chunk_id", pa.string()), ("distance", pa.float64())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm = lambda values: np.sqrt(reduce(lambda s, v: s + v * v, values, 0.0))
        for batch in batches:
            ids, lists = np.array(batch.column("chunk_id").to_pylist(), dtype=object), batch.column("embedding")
            lengths, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().astype(float)
            for dim in {len(q) for _, q in asked}:
                fits = np.flatnonzero((lengths == dim) & lists.is_valid().to_numpy(zero_copy_only=False))
                columns = flat[(lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py())[fits][:, None] + np.arange(dim)].T
                own = norm(columns)
                for key, q in ((key, q) for key, q in asked if len(q) == dim):
                    similarity, scale = np.zeros(len(ids)), own * norm(q)
                    dot = reduce(lambda s, v: s + v[0] * v[1], zip(columns, q, strict=True), np.zeros(len(fits)))
                    similarity[fits] = np.divide(dot, scale, out=np.zeros(len(fits)), where=scale > 0)
                    distance = 1.0 - similarity
                    near = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1]) if len(ids) > k else np.arange(len(ids))
                    near = sorted(near, key=lambda i: (distance[i], ids[i]))[:k]  # noqa: B023
                    yield pa.RecordBatch.from_pydict({"question_id": [key] * len(near), "chunk_id": ids[near].tolist(), "distance": distance[near]}, schema)

    some = embedded.select("chunk_id", "embedding").mapInArrow(best, f"question_id {kind.simpleString()}, chunk_id string, distance double")
    ranked = some.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("distance", "chunk_id"))).where(F.col("place") <= k)
    return F.broadcast(cut(ranked, "nearest")).join(embedded.drop("embedding"), "chunk_id")  # k rows per question of a stated set


def overview(vertices: DataFrame, methods: int = 20) -> DataFrame:
    """(overview): one row naming what there is, for questions nothing was found for."""
    lines = lambda rows, line, head: rows.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n").alias("t")).select(F.when(F.col("t") != "", F.concat(F.lit(head), "t")).alias("t"))
    papers = lines(vertices.where("entity_type = 'Paper'"), F.concat(F.lit("  - "), "name"), KNOWN_PAPERS + "\n").withColumnRenamed("t", "p")
    known = vertices.where("entity_type = 'Method'").orderBy("seq").limit(methods)
    named = lines(known, F.concat(F.lit("  - "), "name", F.lit(f" ({FROM_PAPER}"), F.substring(F.coalesce("source_paper_id", F.lit("")), 1, 8), F.lit(")")), KNOWN_METHODS + "\n").withColumnRenamed("t", "m")
    return papers.crossJoin(named).select(F.coalesce(F.when(F.col("p").isNotNull(), F.concat_ws("\n", "p", "m")), F.lit(NO_DATA)).alias("overview"))


def largest_themes(reports: DataFrame, n: int = 3) -> DataFrame:
    """(themes): one row with the reports of the largest communities, null without any."""
    top = reports.orderBy(F.desc("size"), "community_id").limit(n)
    block = F.concat(F.lit("## "), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("summary", F.lit("")))
    return top.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("k"), "community_id", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("t")).select(F.when(F.col("t") != "", F.col("t")).alias("themes"))


def theme_prompts(asked: DataFrame, reports: DataFrame) -> DataFrame:
    """(question_id, prompt, n_entities): the reports that share most with each question, for an answer from themes alone; null without reports."""
    text = F.lower(F.concat_ws(" ", "title", "summary", F.array_join("key_findings", " "), F.array_join("entity_ids", " ")))
    chosen = retrieve.select_communities(asked, reports.withColumn("text", text)).join(reports, "community_id")
    findings = F.array_join(F.transform("key_findings", lambda f: F.concat(F.lit("    · "), f)), "\n")
    block = F.concat(F.lit("### Theme "), F.col("place").cast("string"), F.lit(": "), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("summary", F.lit("")), F.lit("\nKey findings:\n"), findings)
    each = chosen.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"), F.sum(F.size("entity_ids")).cast("int").alias("n_entities"))
    out = asked.select("question_id", "question").join(each, "question_id", "left")
    return out.select("question_id", extract.filled(extract.PROMPTS["global"], community_reports=F.col("context"), question=F.col("question")).alias("prompt"), F.coalesce("n_entities", F.lit(0)).alias("n_entities"))


def crossing(questions: DataFrame, vertices: DataFrame, hits: DataFrame) -> DataFrame:
    """(question_id, crosses): whether a question is about several papers, by its words, the papers it names, or the chunks it finds."""
    named = retrieve.crosses_papers(questions, vertices.where("entity_type = 'Paper'").select("name"))
    several = hits.where(F.coalesce("title", F.lit("")) != "").groupBy("question_id").agg((F.count_distinct("title") > 1).alias("several"))
    return named.join(several, "question_id", "left").select("question_id", (F.col("crosses") | F.coalesce("several", F.lit(False))).alias("crosses"))


def local_parts(asked: DataFrame, numbers: DataFrame, entities: DataFrame, triples: DataFrame, hits: DataFrame, crosses: DataFrame, vertices: DataFrame, themes: DataFrame | None = None) -> DataFrame:
    """(question_id, kind, part, text): prompts in ordered parts, context from the graph and the chunks (and themes) in the template for one paper or several.

    A question's whole subgraph is in its prompt, so no row holds a prompt: the lines of the marked entities and triples come in parts, and
    the rest around them.
    """
    lines = {"n_e": (entities, graph.entity_lines(entities)), "n_t": (triples, graph.triple_lines())}
    named = hits.withColumn("title", F.coalesce(F.when(F.col("title") != "", F.col("title")), "paper_id", F.lit("Unknown")))
    both = asked.where("question IS NOT NULL").select("question_id", "question", "question_type").join(crosses, "question_id").join(retrieve.vector_text(named, "question_id"), "question_id", "left")
    for n, (marked, line) in lines.items():
        both = both.join(counted(marked, numbers, n, **{f"{n}_lines": line}), "question_id", "left")
    both, nothing = cut(both, "contexts"), F.lit("")
    if both.where("n_e IS NULL AND coalesce(vector_text, '') = ''").take(1):
        both, nothing = both.crossJoin(F.broadcast(overview(vertices))), F.col("overview")  # one row
    before = F.lit("")
    if themes is not None:
        both = both.crossJoin(F.broadcast(largest_themes(themes)))  # one row
        before = F.when(F.col("themes").isNotNull(), F.concat(F.lit(GLOBAL_THEMES + "\n"), "themes", F.lit(f"\n\n{LOCAL_HITS}\n"))).otherwise("")
    # Each part begins with a line end, so a heading needs one only where no line follows.
    head = lambda title, n, unit: F.concat(F.lit(f"{title} ("), F.col(n).cast("string"), F.lit(f" {unit}):"), F.when(F.col(f"{n}_lines") == 0, "\n").otherwise(""))
    fill = lambda name, side: extract.filled(extract.PROMPTS[name].split("{context}")[side], question=F.col("question"), question_type=F.col("question_type"))
    around = lambda side: F.when(F.col("crosses"), fill("cross", side)).otherwise(fill("single", side))
    some = F.col("n_e").isNotNull()
    graph_head = F.when(some, F.concat(F.lit(GRAPH_CONTEXT + "\n"), head("## 相关知识图谱实体", "n_e", "个"))).otherwise("")
    triple_head = F.when(some & F.col("n_t").isNotNull(), F.concat(F.lit("\n\n"), head("## 相关关系", "n_t", "条"))).otherwise("")
    chunks = F.when(F.coalesce("vector_text", F.lit("")) != "", F.concat(F.when(some, "\n").otherwise(""), F.lit(f"\n{CHUNK_CONTEXT}\n"), "vector_text")).when(~some, nothing).otherwise("")
    texts = [F.concat(around(0), before, graph_head), triple_head, F.concat(chunks, around(1))]
    rest = F.explode(F.array(*(F.struct(F.lit(2 * i).alias("kind"), F.lit(0).cast("long").alias("part"), t.alias("text")) for i, t in enumerate(texts))))
    known = {r.question_id for r in both.select("question_id").collect()}  # a stated set
    bits, kind = [tuple(r) for r in numbers.collect() if r.question_id in known], numbers.schema["question_id"].dataType
    order = {"n_e": {"name": F.col("name"), "id": F.col("entity_id")}, "n_t": {"c": -confidence(F.col("confidence")), "seq": F.col("seq")}}
    made = [graph.line_parts(marked, line, order[n], bits, kind).select("question_id", F.lit(2 * i + 1).alias("kind"), "part", "text") for i, (n, (marked, line)) in enumerate(lines.items())]
    return reduce(DataFrame.unionByName, made, both.select("question_id", rest.alias("x")).select("question_id", "x.*"))


def whole(parts: DataFrame, crosses: DataFrame) -> DataFrame:
    """(question_id, crosses, prompt): prompts of (question_id, kind, part, text) as one text each."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "part", "text"))), lambda x: x["text"]), "")
    return parts.groupBy("question_id").agg(text.alias("prompt")).join(crosses, "question_id").select("question_id", "crosses", "prompt")


def answer_text(output, error, crosses):
    """The answer in a generator's output: its JSON's answer, a comparison laid out as text, or the output as it is."""
    span = json_span(output)
    plain = F.get_json_object(span, "$.answer")
    inner = F.coalesce(F.get_json_object(plain, "$.answer"), plain)
    compared = F.from_json(span, f"answer {COMPARISON}")["answer"]
    laid_out = F.when(compared["summary"].isNotNull() | compared["details"].isNotNull(), extract.cross_paper_answer(compared))
    read = F.when(crosses, F.coalesce(laid_out, plain, span)).otherwise(F.coalesce(inner, F.lit("")))
    return F.when(error.isNotNull(), F.concat(F.lit(ANSWER_FAILED), error)).when(span.isNull(), output).otherwise(read)


def answers(prompts: DataFrame, generator: Generator, policy: Policy = Policy()) -> DataFrame:
    """(question_id, answer) from (question_id, prompt, crosses); the prompts are answered once and written."""
    done = cut(calls.answered(prompts.select("question_id", "prompt", "crosses"), "prompt", generator, policy), "answers")
    return done.select("question_id", answer_text(F.col("output"), F.col("error"), F.col("crosses")).alias("answer"))


def answers_from_parts(parts: DataFrame, crosses: DataFrame, generator: Generator, policy: Policy = Policy()) -> DataFrame:
    """`answers` for prompts in parts (question_id, kind, part, text)."""
    done = cut(calls.answered_parts(parts, generator, policy).join(crosses, "question_id"), "answers")
    return done.select("question_id", answer_text(F.col("output"), F.col("error"), F.col("crosses")).alias("answer"))


def statistics_asked(question):
    """Whether a question asks for the graph's statistics, which need no generator."""
    asked, *of = STATISTICS_WORDS
    return F.contains(question, F.lit(asked)) & reduce(lambda a, b: a | b, (F.contains(question, F.lit(w)) for w in of))


def statistics_text(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(text): one row with the numbers of entities and relations and the types' shares."""
    s = graph.statistics(vertices, links)
    total = lambda kind: F.coalesce(F.max(F.when((F.col("kind") == kind) & F.col("label").isNull(), F.col("n"))), F.lit(0)).cast("string")
    types = F.array_join(F.array_sort(F.collect_list(F.when((F.col("kind") == "entity") & F.col("label").isNotNull(), F.concat("label", F.lit(": "), F.col("n").cast("string"))))), ", ")
    return s.agg(F.concat(F.lit("实体: "), total("entity"), F.lit("\n关系: "), total("relation"), F.lit("\n类型分布: "), types).alias("text"))


def sources(entities: DataFrame, triples: DataFrame, shown: int = 5) -> DataFrame:
    """(question_id, kind, place, line, rest): the first entities and triples behind each answer, and how many more there are."""
    e = entities.select("question_id", F.lit("entity").alias("kind"), "seq", F.concat(F.lit("["), "entity_type", F.lit("] "), F.coalesce("name", F.lit(""))).alias("line"))
    t = triples.select("question_id", F.lit("triple").alias("kind"), "seq", F.concat(F.coalesce("source_entity_name", F.lit("")), F.lit(" --["), "relation_type", F.lit("]--> "), F.coalesce("target_entity_name", F.lit(""))).alias("line"))
    rows = e.unionByName(t)
    counts = rows.groupBy("question_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("question_id", "kind").orderBy("seq", "line"))).where(F.col("place") <= shown)
    return first.join(counts, ["question_id", "kind"]).select("question_id", "kind", F.col("place").cast("int").alias("place"), "line", F.greatest(F.col("n") - shown, F.lit(0)).cast("int").alias("rest"))
