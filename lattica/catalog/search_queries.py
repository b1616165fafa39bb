"""Vectors, resolution, retrieval, communities and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.catalog.common import GRAPH_SQL, NODES_SQL, links, norm_sql, vertices
from lattica.constants import CROSS_PAPER_WORDS, QUESTION_KEYWORDS, STOPWORDS, SYNONYMS, TYPE_PRIORITY
from lattica.operators import community, graph, resolve, retrieve, vectors
from lattica.plans.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Vectors

_COS = "(1 - list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))))"


def _query_vector(spark, root):
    """The vector of the smallest id, as a literal column."""
    row = table(spark, root, "embeddings", "vec_id", "embedding").orderBy("vec_id").limit(1).collect()
    return F.array(*(F.lit(float(x)) for x in row[0].embedding)) if row else F.array().cast("array<double>")


@query(f"SELECT b.vec_id, round({_COS}, 6) + 0.0 AS distance FROM embeddings a, embeddings b WHERE a.vec_id = (SELECT min(vec_id) FROM embeddings) ORDER BY {_COS}, b.vec_id LIMIT 10")
def vector_topk(spark, root):
    hits = vectors.top_k(table(spark, root, "embeddings", "vec_id", "embedding"), _query_vector(spark, root), "vec_id", 10)
    return hits.select("vec_id", (F.round("distance", 6) + 0.0).alias("distance"))


@query(f"SELECT b.vec_id, round({_COS}, 6) + 0.0 AS distance FROM embeddings a, embeddings b WHERE a.vec_id = (SELECT min(vec_id) FROM embeddings) AND b.label = 3 ORDER BY {_COS}, b.vec_id LIMIT 10")
def vector_topk_filtered(spark, root):
    hits = vectors.top_k(table(spark, root, "embeddings", "vec_id", "embedding", "label"), _query_vector(spark, root), "vec_id", 10, F.col("label") == 3)
    return hits.select("vec_id", (F.round("distance", 6) + 0.0).alias("distance"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def vector_count(spark, root):
    return table(spark, root, "embeddings", "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH p AS (SELECT a.vec_id AS query, b.vec_id AS hit, {_COS} AS distance FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query, hit, row_number() OVER (PARTITION BY query ORDER BY distance, hit) AS place FROM p QUALIFY place <= 3""")
def vector_nearest(spark, root):
    """Queries are the rows whose id is divisible by 100, against all rows of their label."""
    v = table(spark, root, "embeddings", "vec_id", "embedding", "label")
    return vectors.nearest(v.where("vec_id % 100 = 0"), v, "vec_id", "label", 3).select("query", "hit", F.col("place").cast("long").alias("place"))


@query(f"""WITH p AS (SELECT a.vec_id AS id, b.vec_id AS m, 1 - {_COS} AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
b AS (SELECT id, max(s) AS s FROM p GROUP BY 1) SELECT id, CASE WHEN s >= 0.92 THEN 'merge' WHEN s >= 0.75 THEN 'review' ELSE 'new' END AS decision FROM b""")
def resolution_decision(spark, root):
    v = table(spark, root, "embeddings", "vec_id", "embedding", "label")
    best = vectors.nearest(v.where("vec_id % 100 = 0"), v, "vec_id", "label", 1)
    return best.select(F.col("query").alias("id"), resolve.decision(1 - F.col("distance")).alias("decision"))


@query()
def vector_search_text(spark, root):
    """Chunks nearest to a question by the offline embedder."""
    c = graph.latest(table(spark, root, "chunks", "seq", "chunk_id", "content").where("chunk_id IS NOT NULL AND content IS NOT NULL"), "chunk_id")
    q = vectors.HashingEmbedder()(["which retrieval pipeline reduces label noise"])[0]
    return vectors.top_k(vectors.embed(c, "content"), F.array(*(F.lit(float(x)) for x in q)), "chunk_id").select("chunk_id", F.round("distance", 6).alias("distance"))


# Resolution


@query(f"""WITH {NODES_SQL}, e AS (SELECT entity_id, entity_type, seq, {norm_sql("name")} AS norm FROM nodes WHERE name IS NOT NULL)
SELECT entity_id, first_value(entity_id) OVER (PARTITION BY entity_type, norm ORDER BY seq) AS match_id FROM e""")
def resolve_exact(spark, root):
    v = vertices(spark, root, "entity_type", "name").where("name IS NOT NULL")
    return resolve.exact(v, v)


_ALIASES = "aliases AS (SELECT DISTINCT t.source_entity_name AS alias_text, t.source_entity_id AS canonical_entity_id, n.entity_type FROM triples t JOIN nodes n ON n.entity_id = t.source_entity_id WHERE t.source_entity_name IS NOT NULL)"


def _aliases(spark, root, v):
    """Alias rows from the names triples use for their ends."""
    t = table(spark, root, "triples", "source_entity_id", "source_entity_name").where("source_entity_name IS NOT NULL").distinct()
    return t.join(v.select(F.col("entity_id").alias("source_entity_id"), "entity_type"), "source_entity_id").select(F.col("source_entity_name").alias("alias_text"), F.col("source_entity_id").alias("canonical_entity_id"), "entity_type")


@query(f"""WITH {NODES_SQL}, {_ALIASES}, a AS (SELECT entity_type, {norm_sql("alias_text")} AS norm, min(canonical_entity_id) AS match_id FROM aliases GROUP BY ALL)
SELECT entity_id, match_id FROM nodes n JOIN a ON a.entity_type = n.entity_type AND a.norm = {norm_sql("n.name")}""")
def alias_lookup(spark, root):
    v = vertices(spark, root, "entity_type", "name")
    return resolve.by_alias(v, _aliases(spark, root, v), v)


@query()
def similar_names(spark, root):
    return resolve.similar_pairs(vertices(spark, root, "entity_type", "name"))


@query()
def entity_resolution(spark, root):
    """Later entities resolved against earlier ones, by name, alias and the offline embedder."""
    v = vectors.embed(vertices(spark, root, "entity_type", "name").where("name IS NOT NULL"), "name")
    middle = v.select(F.expr("percentile_approx(seq, 0.5)").alias("m"))
    split = v.crossJoin(F.broadcast(middle))  # one row
    old, new = split.where("seq <= m").drop("m"), split.where("seq > m").drop("m")
    return resolve.resolve(new, old, _aliases(spark, root, old)).select("entity_id", "how", "match_id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {NODES_SQL}, {_ALIASES}, r AS (SELECT entity_id, community_id FROM nodes) SELECT (SELECT count(*) FROM aliases) AS aliases, count(*) FILTER (coalesce(community_id, -1) < 0) AS pending,
count(*) FILTER (community_id >= 0 AND community_id % 2 = 0) AS merged, count(*) FILTER (community_id >= 0 AND community_id % 2 = 1) AS rejected FROM r""")
def resolution_stats(spark, root):
    """Reviews stand for entities here: undecided without a community, else settled by its parity."""
    v = vertices(spark, root, "entity_type", "community_id")
    status = F.when(F.coalesce("community_id", F.lit(-1)) < 0, "pending").when(F.col("community_id") % 2 == 0, "merged").otherwise("rejected")
    return resolve.statistics(_aliases(spark, root, v), v.select(status.alias("status")))


_RESOLVED = """resolved AS (SELECT entity_id, name, entity_type, min(entity_id) OVER (PARTITION BY entity_type) AS match_id, CASE WHEN coalesce(community_id, -1) < 0 THEN 'new' WHEN community_id % 2 = 0 THEN 'embedding' ELSE 'review' END AS how FROM nodes WHERE name IS NOT NULL)"""


def _stand_in(spark, root):
    """(vertices, resolved): decisions stand in for an embedder's here, by the community's parity, each for the first entity of the type."""
    v = vertices(spark, root, "entity_type", "name", "community_id").where("name IS NOT NULL")
    first = v.groupBy("entity_type").agg(F.min("entity_id").alias("match_id"))
    how = F.when(F.coalesce("community_id", F.lit(-1)) < 0, "new").when(F.col("community_id") % 2 == 0, "embedding").otherwise("review")
    return v, v.join(first, "entity_type").select("entity_id", how.alias("how"), "match_id", F.lit(0.8).alias("similarity"))


@query(f"WITH {NODES_SQL}, {_RESOLVED} SELECT entity_type, match_id AS canonical_entity_id, {norm_sql('name')} AS alias, 'auto' AS source FROM resolved WHERE how = 'embedding' GROUP BY ALL")
def alias_rows(spark, root):
    """The aliases that merges by vector leave, each once."""
    v, done = _stand_in(spark, root)
    none = spark.createDataFrame([], "alias_text string, canonical_entity_id string")
    from lattica.functions.text import normalized_name

    made = resolve.new_aliases(done, v, none)
    return made.select("entity_type", "canonical_entity_id", normalized_name(F.col("alias_text")).alias("alias"), "source")


@query(f"""WITH {NODES_SQL}, {_RESOLVED} SELECT entity_id AS new_entity_id, match_id AS candidate_entity_id, substring(sha256(entity_id || '|' || match_id), 1, 12) AS review_id, CASE WHEN name < 'M' THEN 'merged' WHEN name < 'T' THEN 'rejected' ELSE 'pending' END AS status
FROM resolved WHERE how = 'review'""")
def review_settle(spark, root):
    """The review queue after verdicts on the names up to T."""
    v, done = _stand_in(spark, root)
    queue = resolve.review_rows(done, v, v)
    verdicts = queue.where("new_entity_name < 'T'").select("review_id", (F.col("new_entity_name") < "M").alias("merge"))
    return resolve.settle(queue, verdicts)[0].select("new_entity_id", "candidate_entity_id", "review_id", "status")


@query(f"""WITH m AS (SELECT quantile_disc(seq, 0.5) AS m FROM entities), o AS (SELECT * FROM entities, m WHERE entity_id IS NOT NULL AND seq <= m QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY seq DESC) = 1),
n AS (SELECT * FROM entities, m WHERE entity_id IS NOT NULL AND seq > m QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY seq DESC) = 1),
ex AS (SELECT entity_type, {norm_sql("name")} AS norm, arg_min(entity_id, seq) AS match_id FROM o WHERE name IS NOT NULL GROUP BY ALL),
t AS (SELECT entity_id AS id, name, description, seq, false AS late FROM o UNION ALL SELECT coalesce(match_id, entity_id), name, description, seq, true FROM n LEFT JOIN ex ON ex.entity_type = n.entity_type AND ex.norm = {norm_sql("n.name")})
SELECT id AS entity_id, arg_min(name, {{'l': late, 's': seq}}) AS name, arg_min(description, {{'n': -length(description), 'l': late, 's': seq}}) AS description FROM t GROUP BY 1""")
def graph_add(spark, root):
    """The later half of the entities added to the earlier half, known names merged; the embedder knows nothing here."""
    import numpy as np

    from lattica.engine import Engine

    e = table(spark, root, "entities")
    middle = e.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY seq)").cast("long").alias("m"))  # one row
    split = e.crossJoin(F.broadcast(middle))
    none = spark.createDataFrame([], "seq long, paper_id string, chunk_id string, content string, section_title string, full_text string")
    engine = Engine(spark, none, none, split.where("seq <= m").drop("m"), table(spark, root, "triples"), embedder=lambda texts: np.zeros((len(texts), 4), np.float32))
    return engine.add(split.where("seq > m").drop("m"), table(spark, root, "triples"))[0].vertices.select("entity_id", "name", "description")


# Questions

QUESTIONS = [
    (1, "What method does the paper propose?"), (2, "What are the limitations of RAG?"), (3, "Give a summary of this paper"), (4, "Compare BERT vs GAT"), (5, "What is BLEU?"), (6, "How many datasets are used?"),
    (7, "Which entities are related to Transformer?"), (8, "Hello there"), (9, "三篇论文提出了什么方法？"), (10, "哪些论文使用了 MS-MARCO？"), (11, "RAG 与 KG-LLM 的区别？"), (12, "哪种方法效果最好？"),
]
_Q = "questions(question_id, question) AS (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS) + ")"


def _questions(spark):
    return spark.createDataFrame(QUESTIONS, "question_id int, question string")


_SCORES = ", ".join("(" + " + ".join(f"CAST(contains(lower(question), '{w.lower()}') AS INTEGER)" for w in words) + f") AS s_{t}" for t, words in QUESTION_KEYWORDS.items())
_BEST = "greatest(" + ", ".join(f"s_{t}" for t in QUESTION_KEYWORDS) + ")"
_TYPED = f"scores AS (SELECT *, {_SCORES} FROM questions), typed AS (SELECT question_id, question, CASE WHEN {_BEST} = 0 THEN 'general' " + " ".join(f"WHEN s_{t} = {_BEST} THEN '{t}'" for t in QUESTION_KEYWORDS) + f" END AS question_type, {_BEST} AS score FROM scores)"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_KEYED = f"{_TYPED}, keyed AS (SELECT *, list_filter(regexp_extract_all(question, '[a-zA-Z]+|[^\\x00-\\x7F]+'), lambda w: length(w) >= 3 AND lower(w) NOT IN ({_STOP})) AS kws FROM typed)"


@query(f"WITH {_Q}, {_TYPED} SELECT question_id, question_type, score FROM typed")
def question_classify(spark, root):
    kind, score = retrieve.question_type(F.col("question"))
    return _questions(spark).select("question_id", kind.alias("question_type"), score.cast("int").alias("score"))


@query(f"WITH {_Q}, {_KEYED} SELECT question_id, array_to_string(kws, '|') AS keywords FROM keyed")
def question_keywords(spark, root):
    return _questions(spark).select("question_id", F.array_join(retrieve.keywords(F.col("question")), "|").alias("keywords"))


_EXPAND = " UNION ALL ".join(f"SELECT question_id, unnest([{', '.join(repr(e) for e in dict.fromkeys(en))}]) FROM keyed WHERE len(list_filter(kws, lambda w: contains(w, '{zh}') OR {' OR '.join(f'contains(lower(w), {e!r})' for e in en)})) > 0" for zh, en in SYNONYMS.items())


@query(f"WITH {_Q}, {_KEYED}, x AS (SELECT question_id, unnest(kws) AS w FROM keyed UNION ALL {_EXPAND}) SELECT question_id, string_agg(DISTINCT w, '|' ORDER BY w) AS keywords FROM x GROUP BY 1")
def keyword_expand(spark, root):
    out = _questions(spark).select("question_id", F.array_join(retrieve.expanded(retrieve.keywords(F.col("question"))), "|").alias("keywords"))
    return out.where("keywords <> ''")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{q}', '{t}', {i})" for q, ts in TYPE_PRIORITY.items() for i, t in enumerate(ts)) + ") v(question_type, entity_type, place)")
def type_priority(spark, root):
    return retrieve.priorities(spark)


def _asked(spark):
    q = _questions(spark)
    return q.select("question_id", "question", retrieve.question_type(F.col("question"))[0].alias("question_type"), retrieve.keywords(F.col("question")).alias("keywords"))


_TYPES = "types(question_type, types) AS (VALUES " + ", ".join(f"('{q}', [{', '.join(repr(t) for t in ts)}])" for q, ts in TYPE_PRIORITY.items()) + ")"
_MATCHED = f"""{_TYPES}, hits AS (SELECT question_id, entity_id, CASE WHEN named AND wanted THEN 1 WHEN named THEN 2 WHEN wanted THEN 3 END AS pass FROM (
  SELECT k.question_id, n.entity_id, len(list_filter(kws, lambda w: contains(lower(n.name), lower(trim(w))))) > 0 AS named, list_contains(t.types, n.entity_type) AS wanted FROM keyed k JOIN types t USING (question_type), nodes n)),
matched AS (SELECT question_id, entity_id, CAST(pass AS INTEGER) AS pass FROM hits WHERE pass IS NOT NULL QUALIFY pass = min(pass) OVER (PARTITION BY question_id))"""


@query(f"WITH {NODES_SQL}, {_Q}, {_KEYED}, {_MATCHED} SELECT question_id, entity_id, pass FROM matched")
def graph_search(spark, root):
    return retrieve.match_entities(_asked(spark), vertices(spark, root, "entity_type", "name"))


@query(f"""WITH {GRAPH_SQL}, p AS (SELECT DISTINCT source_paper_id AS p FROM nodes WHERE source_paper_id IS NOT NULL ORDER BY 1 LIMIT 20),
kept AS (SELECT entity_id FROM nodes WHERE source_paper_id IN (SELECT p FROM p))
SELECT triple_id FROM edges WHERE source_paper_id IN (SELECT p FROM p) AND source_entity_id IN (SELECT * FROM kept) AND target_entity_id IN (SELECT * FROM kept)""")
def paper_filter(spark, root):
    """A question limited to the first twenty papers."""
    v = vertices(spark, root, "source_paper_id")
    papers = [r.source_paper_id for r in v.where("source_paper_id IS NOT NULL").select("source_paper_id").distinct().orderBy("source_paper_id").limit(20).collect()]
    return retrieve.within_papers(v, links(spark, root, "triple_id", "source_paper_id", nodes=v), papers)[1].select("triple_id")


@query(f"""WITH {_Q}, n AS (SELECT title AS name FROM papers WHERE title IS NOT NULL),
h AS (SELECT question_id, count(*) AS n FROM questions, n WHERE contains(lower(question), left(lower(name), 30)) OR len(list_filter(regexp_split_to_array(lower(name), '\\s+')[1:5], lambda w: w <> '' AND contains(lower(question), w))) > 0 GROUP BY 1)
SELECT q.question_id, coalesce(h.n, 0) >= 2 OR {' OR '.join(f"contains(lower(question), '{w}')" for w in CROSS_PAPER_WORDS)} AS crosses FROM questions q LEFT JOIN h USING (question_id)""")
def cross_paper(spark, root):
    return retrieve.crosses_papers(_questions(spark), table(spark, root, "papers", "title").select(F.col("title").alias("name")))


_CHUNKS1 = "c1 AS (SELECT * FROM chunks WHERE chunk_id IS NOT NULL AND content IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY seq DESC) = 1)"


@query(f"""WITH {_CHUNKS1}, r AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY chunk_index, chunk_id) AS place FROM c1)
SELECT paper_id, '## 相关论文片段（' || count(*) || ' 个）:' || chr(10) || string_agg(place || '. 【' || paper_id || '】' || CASE WHEN coalesce(section_title, '') <> '' THEN '（' || section_title || '）' ELSE '' END || chr(10) || '   ' || CASE WHEN length(content) > 300 THEN left(content, 300) || '...' ELSE content END, chr(10) ORDER BY place) AS vector_text FROM r WHERE place <= 3 GROUP BY 1""")
def vector_context(spark, root):
    """The first three chunks of every paper laid out as a prompt shows them."""
    from pyspark.sql import Window

    c = graph.latest(table(spark, root, "chunks", "seq", "chunk_id", "paper_id", "chunk_index", "section_title", "content").where("chunk_id IS NOT NULL AND content IS NOT NULL"), "chunk_id")
    ranked = c.withColumn("place", F.row_number().over(Window.partitionBy("paper_id").orderBy("chunk_index", "chunk_id"))).where("place <= 3")
    return retrieve.vector_text(ranked.withColumn("title", F.col("paper_id")), "paper_id")


@query(f"""WITH {NODES_SQL}, e AS (SELECT source_paper_id AS paper_id, string_agg(name, ', ' ORDER BY entity_id) AS kg FROM nodes WHERE source_paper_id IS NOT NULL AND name IS NOT NULL GROUP BY 1),
c AS (SELECT paper_id, min(content) AS ch FROM chunks WHERE content IS NOT NULL GROUP BY 1), p AS (SELECT DISTINCT paper_id FROM papers WHERE paper_id IS NOT NULL)
SELECT p.paper_id, CASE WHEN coalesce(kg, '') = '' AND coalesce(ch, '') = '' THEN 'nothing' WHEN coalesce(kg, '') = '' THEN chr(10) || '=== 论文原文片段 ===' || chr(10) || ch
WHEN coalesce(ch, '') = '' THEN '=== 知识图谱信息 ===' || chr(10) || kg ELSE '=== 知识图谱信息 ===' || chr(10) || kg || chr(10) || chr(10) || '=== 论文原文片段 ===' || chr(10) || ch END AS context FROM p LEFT JOIN e USING (paper_id) LEFT JOIN c USING (paper_id)""")
def fusion(spark, root):
    e = vertices(spark, root, "name", "source_paper_id").where("source_paper_id IS NOT NULL AND name IS NOT NULL")
    kg = e.groupBy(F.col("source_paper_id").alias("paper_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entity_id", "name"))), lambda x: x["name"]), ", ").alias("kg"))
    ch = table(spark, root, "chunks", "paper_id", "content").where("content IS NOT NULL").groupBy("paper_id").agg(F.min("content").alias("ch"))
    p = table(spark, root, "papers", "paper_id").where("paper_id IS NOT NULL").distinct()
    return p.join(kg, "paper_id", "left").join(ch, "paper_id", "left").select("paper_id", retrieve.fused(F.col("kg"), F.col("ch"), F.lit("nothing")).alias("context"))


# Communities

_COMM = "comm AS (SELECT community_id, count(*) AS size, min(entity_id) AS low FROM nodes WHERE community_id >= 0 GROUP BY 1)"


@query(f"WITH {NODES_SQL}, {_COMM} SELECT community_id AS old_id, row_number() OVER (ORDER BY size DESC, low) - 1 AS new_id, size FROM comm")
def community_rank(spark, root):
    v = vertices(spark, root, "community_id").where("community_id >= 0").select("entity_id", F.col("community_id").alias("label"))
    sizes = v.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return community.renumber(v).join(sizes, "label").select(F.col("label").alias("old_id"), F.col("community_id").cast("long").alias("new_id"), "size")


@query(f"""WITH {GRAPH_SQL}, m AS (SELECT * FROM nodes WHERE community_id >= 0),
l AS (SELECT community_id, entity_id, '- [' || entity_type || '] ' || name || CASE WHEN coalesce(nullif(description, ''), element_at(properties, 'description')[1], '') <> '' THEN ': ' || coalesce(nullif(description, ''), element_at(properties, 'description')[1]) ELSE '' END AS line FROM m),
e AS (SELECT community_id, count(*) AS size, string_agg(line, chr(10) ORDER BY entity_id) AS entities FROM l GROUP BY 1 HAVING count(*) >= 3),
r AS (SELECT a.community_id, count(*) AS n FROM edges JOIN m a ON a.entity_id = source_entity_id JOIN m b ON b.entity_id = target_entity_id WHERE a.community_id = b.community_id GROUP BY 1)
SELECT e.community_id, CAST(size AS BIGINT) AS size, entities, coalesce(n, 0) AS n_relations FROM e LEFT JOIN r USING (community_id)""")
def community_text(spark, root):
    v = vertices(spark, root)
    t = community.texts(v, links(spark, root, "description", "source_entity_name", "target_entity_name", nodes=v).na.fill("", ["source_entity_name", "target_entity_name"]), v.select("entity_id", "community_id"))
    n = F.when(F.col("relations") == "", 0).otherwise(F.size(F.split("relations", "(^|\n)- ")) - 1)
    return t.select("community_id", F.col("size").cast("long").alias("size"), "entities", n.cast("long").alias("n_relations"))


_REPORTS = "rep AS (SELECT community_id, string_agg(name || ' ' || entity_type, ' ' ORDER BY entity_id) AS text FROM nodes WHERE community_id >= 0 AND name IS NOT NULL GROUP BY 1)"


@query(f"""WITH {NODES_SQL}, {_Q}, {_KEYED}, {_REPORTS}, s AS (SELECT question_id, community_id, len(kws) > 0 AS asked, CASE WHEN len(kws) > 0 THEN len(list_filter(kws, lambda w: contains(lower(text), lower(w)))) ELSE 1 END AS score FROM keyed, rep),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, community_id) AS place, max(score) OVER (PARTITION BY question_id) AS top FROM s)
SELECT question_id, community_id, CAST(score AS INTEGER) AS score, CAST(place AS INTEGER) AS place FROM r WHERE CASE WHEN NOT asked THEN place <= 5 WHEN top > 0 THEN score > 0 AND place <= 5 ELSE place <= 3 END""")
def community_select(spark, root):
    v = vertices(spark, root, "entity_type", "name", "community_id").where("community_id >= 0 AND name IS NOT NULL")
    reports = v.groupBy("community_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entity_id", F.concat_ws(" ", "name", "entity_type").alias("t")))), lambda x: x["t"]), " ").alias("text"))
    return retrieve.select_communities(_asked(spark), reports).select("question_id", "community_id", F.col("score").cast("int").alias("score"), F.col("place").cast("int").alias("place"))


@query(f"WITH {NODES_SQL}, {_COMM} SELECT community_id, size FROM comm ORDER BY size DESC, community_id LIMIT 3")
def hybrid_communities(spark, root):
    v = vertices(spark, root, "community_id").where("community_id >= 0")
    return v.groupBy("community_id").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "community_id").limit(3)


@query(f"WITH {NODES_SQL} SELECT DISTINCT community_id, 'community-' || (community_id % 12) AS colour FROM nodes WHERE community_id >= 0")
def community_legend(spark, root):
    v = vertices(spark, root, "community_id").where("community_id >= 0")
    return v.select("community_id").distinct().select("community_id", F.concat(F.lit("community-"), (F.col("community_id") % 12).cast("string")).alias("colour"))


@query()
def communities(spark, root):
    v = vertices(spark, root, "entity_id")
    return community.detect(v, links(spark, root, "relation_type", nodes=v))


_MADE_REPORTS = """cm AS (SELECT community_id, count(*) AS size, list(entity_id ORDER BY entity_id) AS ids, list(split_part(name, ': ', 1) ORDER BY entity_id) FILTER (name IS NOT NULL) AS names FROM nodes WHERE community_id >= 0 GROUP BY 1 HAVING count(*) >= 3),
cr AS (SELECT a.community_id, list(split_part(coalesce(source_entity_name, '') || ' --[' || relation_type || ']--> ' || coalesce(target_entity_name, '') || CASE WHEN coalesce(e.description, '') <> '' THEN ' (' || e.description || ')' ELSE '' END, chr(10), 1) ORDER BY e.seq) AS found
  FROM edges e JOIN nodes a ON a.entity_id = source_entity_id JOIN nodes b ON b.entity_id = target_entity_id WHERE a.community_id = b.community_id AND a.community_id >= 0 GROUP BY 1),
made_reports AS (SELECT community_id, array_to_string(names[1:3], '; ') AS title, len(names) || ' entities, ' || coalesce(len(found), 0) || ' relations' AS summary, coalesce(found[1:3], []) AS key_findings, ids AS entity_ids, size FROM cm LEFT JOIN cr USING (community_id))"""


@query(f"WITH {GRAPH_SQL}, {_MADE_REPORTS} SELECT community_id, title, summary, array_to_string(key_findings, '|') AS findings, CAST(size AS INTEGER) AS size, 0 AS level FROM made_reports")
def community_reports(spark, root):
    """Reports of the stored communities by the offline generator."""
    return _engine(spark, root).reports().select("community_id", "title", "summary", F.array_join("key_findings", "|").alias("findings"), "size", "level")


# Answers


def _engine(spark, root):
    from lattica.engine import Engine
    from lattica.operators.calls import Policy

    return Engine(spark, *(table(spark, root, t) for t in ("papers", "chunks", "entities", "triples")), policy=Policy(concurrent=8))


_REACHED = """seeds AS (SELECT DISTINCT entity_id AS seed FROM matched), reach(seed, node, d) AS (SELECT seed, seed, 0 FROM seeds UNION SELECT r.seed, e.target_entity_id, r.d + 1 FROM reach r JOIN edges e ON e.source_entity_id = r.node WHERE r.d < 2),
ego AS (SELECT DISTINCT seed, node FROM reach),
qe AS (SELECT question_id, count(DISTINCT node) AS n FROM matched JOIN ego ON seed = entity_id GROUP BY 1),
qt AS (SELECT question_id, count(DISTINCT (source_entity_id, target_entity_id)) AS n FROM matched JOIN ego a ON a.seed = entity_id JOIN edges ON source_entity_id = a.node JOIN ego b ON b.seed = a.seed AND b.node = target_entity_id GROUP BY 1)"""


def _answer_sql(mode: str) -> str:
    return f"""WITH RECURSIVE {GRAPH_SQL}, {_Q}, {_KEYED}, {_MATCHED}, {_REACHED}
SELECT question_id, '{mode}/' || question_type AS question_type, CAST(coalesce(qe.n, 0) AS INTEGER) AS n_entities, CAST(coalesce(qt.n, 0) AS INTEGER) AS n_triples, 3 AS n_chunks, true AS answered FROM keyed LEFT JOIN qe USING (question_id) LEFT JOIN qt USING (question_id)"""


def _answers(spark, root, mode):
    rows = _engine(spark, root).ask_many(_questions(spark), mode)
    return rows.select("question_id", "question_type", "n_entities", "n_triples", "n_chunks", (F.coalesce("answer", F.lit("")) != "").alias("answered"))


@query(_answer_sql("local"))
def answer_local(spark, root):
    """All questions answered from the graph and the chunks, by the offline generator."""
    return _answers(spark, root, "local")


@query(_answer_sql("hybrid"))
def answer_hybrid(spark, root):
    """The same, with the themes of the largest communities."""
    return _answers(spark, root, "hybrid")


_THEMED = f"""WITH {GRAPH_SQL}, {_Q}, {_KEYED}, {_MADE_REPORTS}, tx AS (SELECT *, lower(concat_ws(' ', title, summary, array_to_string(key_findings, ' '), array_to_string(entity_ids, ' '))) AS text FROM made_reports),
s AS (SELECT question_id, tx.*, len(kws) > 0 AS asked, CASE WHEN len(kws) > 0 THEN len(list_filter(kws, lambda w: contains(text, lower(w)))) ELSE 1 END AS score FROM keyed, tx),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, community_id) AS place, max(score) OVER (PARTITION BY question_id) AS top FROM s),
picked AS (SELECT *, '### Theme ' || place || ': ' || title || chr(10) || summary || chr(10) || 'Key findings:' || chr(10) || array_to_string(list_transform(key_findings, lambda f: '    · ' || f), chr(10)) AS block FROM r WHERE CASE WHEN NOT asked THEN place <= 5 WHEN top > 0 THEN score > 0 AND place <= 5 ELSE place <= 3 END),
themed AS (SELECT question_id, 'Themes:' || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY place) || chr(10) || chr(10) || 'Answer from these themes: ' || any_value(question) AS prompt, CAST(sum(len(entity_ids)) AS INTEGER) AS n_entities FROM picked JOIN questions USING (question_id) GROUP BY 1)"""


@query(f"{_THEMED} SELECT question_id, prompt, coalesce(n_entities, 0) AS n_entities FROM questions LEFT JOIN themed USING (question_id)")
def global_prompts(spark, root):
    """What a generator is asked for answers from themes."""
    return _engine(spark, root).prepare(_questions(spark), "global")["prompts"].select("question_id", "prompt", "n_entities")


@query(f"{_THEMED} SELECT question_id, 'global' AS question_type, coalesce(n_entities, 0) AS n_entities, 0 AS n_triples, 0 AS n_chunks, true AS answered FROM questions LEFT JOIN themed USING (question_id)")
def answer_global(spark, root):
    return _answers(spark, root, "global")


@query(f"""WITH RECURSIVE {GRAPH_SQL}, {_Q}, {_KEYED}, {_MATCHED}, {_REACHED}, found AS (SELECT DISTINCT question_id, node AS entity_id FROM matched JOIN ego ON seed = entity_id WHERE question_id <= 2),
r AS (SELECT question_id, '[' || entity_type || '] ' || coalesce(name, '') AS line, row_number() OVER (PARTITION BY question_id ORDER BY seq) AS place, count(*) OVER (PARTITION BY question_id) AS n FROM found JOIN nodes USING (entity_id))
SELECT question_id, CAST(place AS INTEGER) AS place, line, CAST(greatest(n - 5, 0) AS INTEGER) AS rest FROM r WHERE place <= 5""")
def conversation_sources(spark, root):
    """The first five entities behind the answers of a conversation of two questions, a blank one and a farewell."""
    said = spark.createDataFrame([*QUESTIONS[:2], (3, "  "), (4, "Quit"), (5, "never asked")], "question_id int, question string")
    return _engine(spark, root).converse(said)[1].where("kind = 'entity'").select("question_id", "place", "line", "rest")


@query(f"""WITH {GRAPH_SQL}, t AS (SELECT string_agg(entity_type || ': ' || n, ', ' ORDER BY entity_type || ': ' || n) AS t FROM (SELECT entity_type, count(*) AS n FROM nodes WHERE entity_type IS NOT NULL GROUP BY 1))
SELECT '实体: ' || (SELECT count(*) FROM nodes) || chr(10) || '关系: ' || (SELECT count(*) FROM edges) || chr(10) || '类型分布: ' || t AS text FROM t""")
def statistics_answer(spark, root):
    """The answer to a question for the graph's statistics."""
    from lattica.operators import answer

    v = vertices(spark, root, "entity_type")
    return answer.statistics_text(v, links(spark, root, "relation_type", nodes=v))


@query(f"""WITH {_Q} SELECT question_id, CASE WHEN question_id = 2 THEN 'RAG|limitation' ELSE array_to_string(list_sort(list_distinct(CASE WHEN question_id = 1 THEN ['Novel method', 'method', 'approach', 'algorithm', 'model', 'technique'] ELSE ['x'] END)), '|') END AS keywords, CASE WHEN question_id = 1 THEN 'method' ELSE 'general' END AS question_type FROM questions WHERE question_id <> 2
UNION ALL (WITH {_Q}, {_KEYED} SELECT question_id, array_to_string(kws, '|'), question_type FROM keyed WHERE question_id = 2)""")
def keywords_by_generator(spark, root):
    """Keywords from a generator's answers, expanded; the rule's where an answer does not read."""
    from lattica.operators.calls import Policy

    def generator(prompt: str) -> str:
        if "What method" in prompt:
            return 'Sure: {"keywords": ["Novel method"], "question_type": "method"}'
        return "{broken" if "limitations" in prompt else '{"keywords": ["x"]}'

    asked = retrieve.analysed(_questions(spark), generator, Policy(concurrent=2))
    return asked.select("question_id", F.array_join("keywords", "|").alias("keywords"), "question_type")
