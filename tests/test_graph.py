import pytest
from pyspark.sql import functions as F

from lattica.engine import Engine
from lattica.functions.text import is_heading, json_repaired, json_span, relation_type
from lattica.operators import answer, calls, community, graph, resolve
from lattica.operators.calls import Policy

NODES = [("demo_p1", "Paper", "Attention Is All You Need", "demo_p1"), ("demo_p2", "Paper", "BERT: Pre-training of Deep Bidirectional Transformers", "demo_p2"), ("demo_p3", "Paper", "Graph Attention Networks", "demo_p3"), ("demo_e1", "Method", "Self-Attention", "demo_p1"), ("demo_e2", "Model", "Transformer", "demo_p1"), ("demo_e3", "Method", "Multi-Head Attention", "demo_p1"), ("demo_e4", "Dataset", "WMT 2014 English-to-German", "demo_p1"), ("demo_e5", "Metric", "BLEU Score", "demo_p1"), ("demo_e6", "Model", "BERT", "demo_p2"), ("demo_e7", "Task", "Masked Language Modeling", "demo_p2"), ("demo_e8", "Method", "Positional Encoding", "demo_p1"), ("demo_e9", "Model", "GAT", "demo_p3"), ("demo_e10", "Author", "Ashish Vaswani", "demo_p1")]
EDGES = [("t1", "p1", "PROPOSES", "e2", 0.95, "demo_p1"), ("t2", "e2", "uses", "e1", 0.92, "demo_p1"), ("t3", "e3", "BELONGS_TO", "e1", 0.88, "demo_p1"), ("t4", "e2", "EVALUATED_ON", "e4", 0.97, "demo_p1"), ("t5", "e2", "ACHIEVES", "e5", 0.93, "demo_p1"), ("t6", "e6", "EXTENDS", "e2", 0.91, "demo_p2"), ("t7", "p2", "PROPOSES", "e7", 0.94, "demo_p2"), ("t8", "e2", "USES", "e8", 0.89, "demo_p1"), ("t9", "e2", "COMPARED_WITH", "e9", 0.65, "demo_p3"), ("t10", "p1", "AUTHORED_BY", "e10", 0.99, "demo_p1")]


@pytest.fixture(scope="module")
def engine(spark):
    e = spark.createDataFrame([(i, *n) for i, n in enumerate(NODES)], "seq long, entity_id string, entity_type string, name string, source_paper_id string")
    e = e.withColumns({"description": F.lit(""), "properties": F.create_map().cast("map<string,string>"), "source_section": F.lit(""), "community_id": F.lit(-1)})
    t = spark.createDataFrame([(i, a, f"demo_{s}", r, f"demo_{d}", c, p) for i, (a, s, r, d, c, p) in enumerate(EDGES)], "seq long, triple_id string, source_entity_id string, relation_type string, target_entity_id string, confidence double, source_paper_id string")
    t = t.withColumns({"source_entity_name": F.col("source_entity_id"), "target_entity_name": F.col("target_entity_id"), "description": F.lit("")})
    chunks = spark.createDataFrame([(1, "demo_p1::0", "demo_p1", "The Transformer uses self-attention only.", "Abstract", "success"), (2, "demo_p2::0", "demo_p2", "BERT is pre-trained on text.", "Abstract", "success")], "seq long, chunk_id string, paper_id string, content string, section_title string, extraction_status string")
    papers = spark.createDataFrame([], "seq long, paper_id string, full_text string")
    return Engine(spark, papers, chunks, e, t)


def test_ego_and_paths(engine):
    nodes, edges = engine.neighbors("demo_p1", 2)
    assert {r.entity_id for r in nodes.collect()} == {f"demo_{x}" for x in ("p1", "e2", "e10", "e1", "e4", "e5", "e8", "e9")}
    assert {r.triple_id for r in edges.collect()} == {"t1", "t10", "t2", "t4", "t5", "t8", "t9"}
    nodes, edges = engine.neighbors("demo_p1", 1)
    assert nodes.count() == 3 and edges.count() == 2
    assert engine.neighbors("nobody", 2)[0].count() == 0
    assert engine.path("demo_p1", "demo_e9") == ["demo_p1", "demo_e2", "demo_e9"] and engine.path("demo_e1", "demo_p1") == []


def test_degree_statistics_deletion(engine):
    degree = {r.entity_id: r.degree for r in graph.degrees(engine.vertices, engine.links).collect()}
    assert degree["demo_e2"] == 7 and degree["demo_p3"] == 0
    stats = {(r.kind, r.label): r.n for r in engine.stats().collect()}
    assert stats["entity", "Paper"] == 3 and stats["entity", None] == 13 and stats["relation", "USES"] == 2
    left = engine.delete_paper("DEMO_P1")
    assert left.vertices.count() == 5 and [r.triple_id for r in left.links.collect()] == ["t7"] and left.chunks.count() == 1
    bands = {r.band: r["count"] for r in graph.low_confidence(engine.links).groupBy("band").count().collect()}
    assert bands == {"high": 9, "low": 1}


def test_merge_redirects_and_drops_parallel_edges(engine):
    merged = engine.merge("demo_e2", ["demo_e6", "demo_e2", "nobody"])
    assert merged.vertices.count() == 12
    assert ("demo_e2", "demo_e2") in {(r.source_entity_id, r.target_entity_id) for r in merged.links.collect()} and merged.links.count() == 10


def test_ask(engine):
    r = engine.ask("What method does the Transformer use?").first()
    assert r.question_type == "local/method" and r.n_entities > 0 and r.n_chunks == 2 and r.answer and r.crosses is False
    assert engine.ask("What method does the Transformer use?", paper_ids=["demo_p2"]).first().n_chunks == 1


def test_ask_many_and_generators(spark, engine):
    seen = []

    def generator(prompt):
        if "broken" in prompt:
            raise RuntimeError("503 no answer")
        if prompt.startswith("Context from several"):
            return '{"answer": {"summary": "S", "details": [{"method": "GAT", "description": "d", "experiments": [], "advantage": "a"}], "missing_papers": ["X"]}}'
        return '{"answer": "plain: ' + prompt.split("Question (")[1].split(")")[0] + '"}' if "Transformer" in prompt else "no object"

    asker = engine._with(engine.vertices, engine.links)
    asker.generate, asker.policy = generator, Policy(attempts=2, wait=0.0)
    q = spark.createDataFrame([(1, "What method does the Transformer use?"), (2, "Compare BERT vs GAT"), (3, "broken?")], "question_id int, question string")
    got = {r.question_id: r for r in asker.ask_many(q).collect()}
    assert got[1].answer == "plain: method" and got[1].citations and got[1].crosses is False
    assert got[2].crosses and got[2].answer.startswith("S\n\n1. **GAT**") and "X" in got[2].answer
    assert "503" in got[3].answer and not seen
    prompts = {r.question_id: r.prompt for r in asker.prepare(q)["prompts"].collect()}
    assert "What method does the Transformer use?" in prompts[1] and "=== 知识图谱信息 ===" in prompts[1] and "=== 论文原文片段 ===" in prompts[1]
    none = asker.ask_many(q, "global").collect()
    assert {r.answer for r in none} == {answer.NO_THEMES} and {r.question_type for r in none} == {"global"}
    with pytest.raises(ValueError):
        asker.ask_many(q, "other")


def test_themes(spark, engine):
    themed = engine._with(engine.vertices.withColumn("community_id", F.when(F.col("source_paper_id") == "demo_p1", 0).otherwise(1)), engine.links)
    reports = {r.community_id: r for r in themed.reports().collect()}
    assert set(reports) == {0, 1} and reports[0].summary == "8 entities, 7 relations" and len(reports[0].key_findings) == 3
    q = spark.createDataFrame([(1, "What does BERT extend?")], "question_id int, question string")
    assert "### Theme 1: " in themed.prepare(q, "global")["prompts"].first().prompt and themed.ask_many(q, "global").first().answer
    assert "=== 全局研究主题（社区摘要）===" in themed.prepare(q, "hybrid")["prompts"].first().prompt


def test_conversation(spark, engine):
    q = spark.createDataFrame([(1, " "), (2, "统计一下实体"), (3, "What method does the Transformer use?"), (4, "Q"), (5, "late")], "question_id int, question string")
    replies, sources = engine.converse(q)
    got = {r.question_id: r.answer for r in replies.collect()}
    assert set(got) == {2, 3} and got[2].startswith("实体: 13\n关系: 10\n类型分布: Author: 1, ")
    shown = sources.where("kind = 'entity'").orderBy("place").collect()
    assert [r.place for r in shown] == [1, 2, 3, 4, 5] and shown[0].rest > 0


def test_calls_policy():
    waits, turns = [], []

    def failing(prompt):
        turns.append(prompt)
        raise RuntimeError("429 too many") if len(turns) < 3 else RuntimeError("error 401: key")

    with pytest.raises(calls.FatalError):
        calls.call(failing, "p", Policy(attempts=5, wait=2.0, sleep=waits.append))
    assert waits == [2.0, 4.0] and len(turns) == 3
    assert calls.call(lambda p: "  x ", "p") == "x" and not calls.is_fatal(RuntimeError("code 4012"))


def test_batch_is_resolved_on_entry(spark, engine):
    stored = engine.vertices.columns
    new = spark.createDataFrame([(100, "n1", "Model", " transformer ", "demo_p9", "the longest description of all"), (101, "n2", "Model", "Wholly New", "demo_p9", ""), (102, "n3", "Model", "The Old Alias", "demo_p9", "")], "seq long, entity_id string, entity_type string, name string, source_paper_id string, description string")
    new = new.withColumns({"properties": F.create_map(F.lit("year"), F.lit("2017")), "source_section": F.lit(""), "community_id": F.lit(-1)}).select(*stored)
    triples = spark.createDataFrame([(1, "x1", "n1", "uses_method", "n2", 0.9, "demo_p9"), (2, "x2", "n3", "EXTENDS", "nobody", 0.9, "demo_p9"), (3, "x3", "n3", "EXTENDS", "demo_e2", 0.9, "demo_p9")], "seq long, triple_id string, source_entity_id string, relation_type string, target_entity_id string, confidence double, source_paper_id string")
    triples = triples.withColumns({"source_entity_name": F.col("source_entity_id"), "target_entity_name": F.col("target_entity_id"), "description": F.lit("")})
    aliases = spark.createDataFrame([("the old alias", "demo_e9", "Model")], "alias_text string, canonical_entity_id string, entity_type string")
    grown, records = engine.add(new, triples, aliases)
    how = {r.entity_id: (r.how, r.match_id) for r in records["resolved"].collect()}
    assert how["n1"] == ("exact", "demo_e2") and how["n3"] == ("alias", "demo_e9") and how["n2"][0] == "new"
    v = {r.entity_id: r for r in grown.vertices.collect()}
    assert len(v) == 14 and v["demo_e2"].description == "the longest description of all" and v["demo_e2"].name == "Transformer" and v["demo_e2"].properties == {"year": "2017"} and v["demo_e2"].source_paper_id == "demo_p1"
    e = {(r.source_entity_id, r.target_entity_id): (r.triple_id, r.relation_type) for r in grown.links.collect()}
    assert e["demo_e2", "n2"] == ("x1", "USES") and e["demo_e9", "demo_e2"] == ("x3", "EXTENDS") and len(e) == 12


def test_relation_types(spark):
    cases = {"proposes_method": "PROPOSES", "evaluated_on_foo": "EVALUATED_ON", "USES_DATASET": "USES", "uses_tool": "USES", " outperforms_baseline ": "OUTPERFORMS", "FOO_EXTENDS": "EXTENDS", "extends": "EXTENDS", "is_author": "IS_AUTHOR", "": "", "authored_by_author": "AUTHORED_BY"}
    rows = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", relation_type(F.col("raw")).alias("t")).collect()
    assert {r.raw: r.t for r in rows} == cases


def test_headings(spark):
    yes, no = ["1. Introduction", "3.1. Model", "IV. Experiments", "ABSTRACT", "Methodology", "method", "摘要"], ["3.1 Model", "Results", "x" * 81, "ABCD", "", "12345"]
    rows = spark.createDataFrame([(x,) for x in yes + no], "line string").select("line", is_heading(F.col("line")).alias("h")).collect()
    assert {r.line for r in rows if r.h} == set(yes)


def test_json_spans(spark):
    cases = {'{"a": 1}': '{"a": 1}', 'x ```json\n{"a": [1,]}\n``` y': '{"a": [1]}', 'text {"a": 1,} end': '{"a": 1}', "﻿{“a”: 1}": '{"a": 1}', "none": None, "} {": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", json_repaired(json_span(F.col("t"))).alias("j")).collect()
    assert {r.t: r.j for r in rows} == cases


def test_two_cliques(spark):
    edges = [(f"{c}{i}", f"{c}{j}") for c in "ab" for i in range(5) for j in range(i)] + [("a0", "b0"), ("c0", "c1")]
    links = spark.createDataFrame(edges, "source_entity_id string, target_entity_id string")
    vertices = spark.createDataFrame([(f"{c}{i}",) for c in "ab" for i in range(5)] + [("c0",), ("c1",), ("d",)], "entity_id string")
    found = community.detect(vertices, links)
    groups = {}
    for r in found.collect():
        groups.setdefault(r.community_id, set()).add(r.entity_id)
    assert [groups[i] for i in range(4)] == [{f"a{i}" for i in range(5)}, {f"b{i}" for i in range(5)}, {"c0", "c1"}, {"d"}] and len(groups) == 4
    assert community.modularity(community.undirected(links), found) > 0.4
    assert {r.community_id for r in community.detect(vertices, links.limit(0)).collect()} == set(range(13))
    assert community.detect(vertices.limit(0), links.limit(0)).collect() == []


def test_communities_of_a_ring_of_cliques(spark):
    edges = [(f"{c:02d}-{i}", f"{c:02d}-{j}") for c in range(12) for i in range(6) for j in range(i)] + [(f"{c:02d}-0", f"{(c + 1) % 12:02d}-1") for c in range(12)]
    links = spark.createDataFrame(edges, "source_entity_id string, target_entity_id string")
    vertices = spark.createDataFrame([(f"{c:02d}-{i}",) for c in range(12) for i in range(6)], "entity_id string")
    found = community.detect(vertices, links)
    assert community.modularity(community.undirected(links), found) > 0.8
    by_clique = {}
    for r in found.collect():
        by_clique.setdefault(r.entity_id[:2], set()).add(r.community_id)
    assert all(len(x) == 1 for x in by_clique.values())


def test_long_chain_has_no_step_limit(spark):
    links = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(26)], "source_entity_id string, target_entity_id string")
    assert graph.shortest_path(links, "n00", "n26") == [f"n{i:02d}" for i in range(27)]
    assert graph.distances(links, "n00").agg(F.max("depth")).first()[0] == 26


def test_similar_names_equal_all_pairs(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(4)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 12))) for _ in range(60)]
    names = base + [b[:2] + rng.choice("xyz") + b[2:] for b in base] + [b[1:] for b in base] + base[:5] + ["", " "]
    rows = [(f"e{i}", "Model" if i % 2 else "Task", n, i) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "entity_id string, entity_type string, name string, seq long")
    got = {(r.id_a, r.id_b): r.similarity for r in resolve.similar_pairs(df).collect()}
    first, want = {}, {}
    for i, t, n, k in rows:
        n = n.strip().lower()
        if (t, n) in first:
            want[first[t, n], i] = 1.0
        else:
            for (t2, m), j in first.items():
                if t2 == t and n and m:
                    s = 0.95 if m in n or n in m else SequenceMatcher(None, m, n).ratio()
                    if s >= 0.8:
                        want[j, i] = s
            first[t, n] = i
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 6e-4 for k in got)


def test_resolution(spark):
    v = lambda x, y: [float(x), float(y)]
    old = spark.createDataFrame([("o1", "Model", "BERT base", v(1, 0), 1), ("o2", "Model", "Attention", v(0, 1), 2), ("o3", "Task", "Parsing", v(1, 1), 3)], "entity_id string, entity_type string, name string, embedding array<double>, seq long")
    new = spark.createDataFrame([("n1", "Model", "bert  BASE", v(0, 1), 4), ("n2", "Task", "BERT base", v(1, 0), 5), ("n3", "Model", "The Old Name", v(1, 0), 6), ("n4", "Model", "Attentions", v(0.1, 1), 7), ("n5", "Model", "Attentive", v(0.8, 1), 8), ("n6", "Model", "zzzz", v(0, 1), 9)], old.schema)
    aliases = spark.createDataFrame([("the old name", "o1", "Model"), ("gone", "x", "Model")], "alias_text string, canonical_entity_id string, entity_type string")
    got = {r.entity_id: (r.how, r.match_id) for r in resolve.resolve(new, old, aliases).collect()}
    assert got == {"n1": ("exact", "o1"), "n2": ("new", None), "n3": ("alias", "o1"), "n4": ("embedding", "o2"), "n5": ("review", "o2"), "n6": ("new", None)}
    done = resolve.resolve(new, old, aliases)
    reviews = resolve.review_rows(done, new, old)
    assert resolve.new_aliases(done, new, aliases.withColumn("x", F.lit(1))).select("alias_text").collect()[0][0] == "Attentions"
    verdict = reviews.select("review_id", F.lit(True).alias("merge"))
    after, made = resolve.settle(reviews, verdict)
    assert after.first().status == "merged" and made.first().canonical_entity_id == "o2"


def test_rough_candidates_equal_all_pairs(spark):
    import random
    from difflib import SequenceMatcher

    import numpy as np

    from lattica.operators import vectors

    rng = random.Random(9)
    words = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(40)]
    names = [" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(150)]
    rows = [(f"e{i:03d}", "Model" if i % 3 else "Task", n, i) for i, n in enumerate(names)]
    df = vectors.embed(spark.createDataFrame(rows, "entity_id string, entity_type string, name string, seq long"), "name")
    got = {r.entity_id: (r.match_id, round(r.similarity, 5)) for r in resolve.by_vector(df.where("seq >= 75"), df.where("seq < 75")).collect()}
    made = vectors.HashingEmbedder()(names).astype(float)
    total = hits = 0
    for i, t, n, k in rows[75:]:
        norm = n.replace(" ", "")
        ratios = sorted(((-SequenceMatcher(None, norm, m.replace(" ", "")).ratio(), j) for _, t2, m, j in rows[:75] if t2 == t))
        best = max(((float(made[k] @ made[j]) / (np.linalg.norm(made[k]) * np.linalg.norm(made[j])), -j) for r, j in ratios[:20] if -r >= 0.4), default=None)
        if best and best[0] >= 0.75:
            total += 1
            hits += got.get(i) == (f"e{-best[1]:03d}", round(best[0], 5))
    assert total > 10 and hits == total


def test_char_ratio_keeps_argument_order(spark):
    r = spark.createDataFrame([("tide", "diet")], "a string, b string").select(resolve.char_ratio("a", "b").alias("x"), resolve.char_ratio("b", "a").alias("y")).first()
    assert (r.x, r.y) == (0.25, 0.5)
