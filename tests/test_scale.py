"""What is written on the way stays in proportion to the input."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.engine import extractive
from lattica.operators import answer, calls, graph, resolve
from lattica.plans import tables


@pytest.fixture
def written(monkeypatch):
    """The number of rows of what is cut, by name."""
    real, rows = tables.cut, {}

    def cut(df, name="cut"):
        out = real(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    for module in (answer, graph, resolve):
        monkeypatch.setattr(module, "cut", cut)
    return rows


def marked(spark, sets):
    bits = {}
    for i, nodes in enumerate(sets):
        for n in nodes:
            bits[i // 3, n] = bits.get((i // 3, n), 0) | 1 << i % 3
    return spark.createDataFrame([(w, n, b) for (w, n), b in bits.items()], "word int, node string, bits long")


def test_sets_of_seeds_reach_what_their_seeds_reach(spark):
    rng = random.Random(2)
    for n, degree in ((30, 2), (60, 3)):
        edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(n * degree)} | {(0, i) for i in range(1, n, 2)})
        links = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges], "source_entity_id string, target_entity_id string")
        sets = [{f"n{i}" for i in rng.sample(range(n), size)} for size in (1, 2, 4, 8, n // 2)]
        reached, inside = graph.marked_ego(links, marked(spark, sets), 2)
        nodes, pairs = [(r.word, r.node, r.bits) for r in reached.collect()], [(r.word, r.source_entity_id, r.target_entity_id, r.bits) for r in inside.collect()]
        assert len({x[:2] for x in nodes}) == len(nodes) and len({x[:3] for x in pairs}) == len(pairs)
        for i, seeds in enumerate(sets):
            a, b = graph.ego(links, spark.createDataFrame([(s,) for s in seeds], "seed string"), 2)
            assert {x for w, x, bits in nodes if w == i // 3 and bits >> i % 3 & 1} == {r.node for r in a.collect()}
            assert {(s, t) for w, s, t, bits in pairs if w == i // 3 and bits >> i % 3 & 1} == {(r.source_entity_id, r.target_entity_id) for r in b.collect()}


def test_questions_hold_no_row_per_seed(spark, written):
    # Every entity is a seed, and all reach all others through one.
    n = 120
    ids = [f"e{i:03d}" for i in range(n)]
    v = spark.createDataFrame([(i, e, "Method", f"method {e}") for i, e in enumerate(ids)], "seq long, entity_id string, entity_type string, name string").withColumn("source_paper_id", F.lit("p"))
    links = spark.createDataFrame([(e, ids[0]) for e in ids[1:]] + [(ids[0], e) for e in ids[1:]], "source_entity_id string, target_entity_id string").withColumn("source_paper_id", F.lit("p"))
    asked = spark.createDataFrame([(i, "which method", "method", ["method"]) for i in range(70)], "question_id int, question string, question_type string, keywords array<string>")
    entities, triples = answer.subgraph(asked, v, links)
    assert entities.count() == 70 * n and triples.count() == 70 * 2 * (n - 1)
    assert max(rows for name, rows in written.items() if name != "hits") <= 2 * 2 * n


def test_prompts_come_in_parts(spark):
    read = []

    def parts():
        for x in ["Context:\n## head", "\n- one\n- t", "wo\n= no\n\n- three\n- four", "\n- five"]:
            read.append(x)
            yield x

    prompt = calls.Parts(parts())
    assert extractive(prompt) == extractive("".join(parts())) and '"- one - two - three"' in extractive(prompt)
    read.clear()
    assert "".join(calls.Parts(parts())) and extractive(calls.Parts(parts())) and len(read) == 4 + 3
    rows = [(2, 0, 0, "Context:"), (2, 1, 1, "\n- b"), (2, 1, 0, "\n- a"), (1, 0, 0, "x"), (1, 4, 0, "z"), (1, 2, 0, "y")]
    got = calls.answered_parts(spark.createDataFrame(rows, "question_id int, kind int, part long, text string"), lambda p: p, calls.Policy(concurrent=2)).collect()
    assert {r.question_id: r.output for r in got} == {1: "xyz", 2: "Context:\n- a\n- b"}


def test_names_without_a_vector_are_not_compared(spark, written):
    rows = [(f"e{i}", "Model", f"name {i % 50}", [0.0, 0.0], i) for i in range(400)]
    df = spark.createDataFrame(rows, "entity_id string, entity_type string, name string, embedding array<double>, seq long")
    none = spark.createDataFrame([], "alias_text string, canonical_entity_id string, entity_type string")
    got = resolve.resolve(df.where("seq >= 25"), df.where("seq < 25"), none).collect()
    assert {r.how for r in got if r.similarity == 0} == {"new"} and len(got) == 375 and written.get("names", 0) == written.get("grams", 0) == 0
