import json
import os
import subprocess
import sys
import zlib

import pytest
from pyspark.sql import functions as F

from lattica.operators.calls import Policy
from lattica.operators import chunking, extract, incremental, structure, vectors
from lattica.sources import documents, export, graph_json
from lattica.streaming import ingest


def test_chunk_windows():
    w = lambda t: list(chunking.windows(t))
    assert w("") == [] and w("a") == [(0, 1)] and w("a" * 801) == [(0, 800), (700, 801)]
    assert len(w("a" * 1500)) == 2 and w("a" * 1501)[-1] == (1400, 1501)
    assert w("a" * 500 + "\n\n" + "b" * 600) == [(0, 500), (400, 1102)]
    assert w(" " * 800 + "a" * 100) == [(800, 900)]


def test_chunks_fast_and_slow_agree(spark):
    texts = ["x" * n for n in (1, 799, 800, 801, 1500, 1501, 5000)] + ["é🙂" * 700, "p\n\n" * 900, " " * 900 + "tail", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, full_text string")
    got = {}
    for r in chunking.chunks(df).orderBy("seq", "chunk_index").collect():
        got.setdefault(r.seq, []).append((r.char_start, r.char_end))
        assert texts[r.seq][r.char_start : r.char_end] == r.content
    assert got == {i: list(chunking.windows(t)) for i, t in enumerate(texts) if t}


def test_pages(spark):
    df = spark.createDataFrame([(c, 100, 3) for c in range(100)] + [(5, 100, 1), (5, 0, 3), (5, 100, None)], "c int, n int, p int")
    pages = [r.page for r in df.select(chunking.page_of(F.col("c"), F.col("n"), F.col("p")).alias("page")).collect()]
    assert pages[:100] == [1] * 33 + [2] * 33 + [3] * 34 and pages[100:] == [1, 1, 1]


def test_sections_abstract_references(spark):
    text = "Title\nAbstract\nA1\n1. Introduction\nI1\n\nI2\nReferences\n[1] x"
    df = spark.createDataFrame([(1, text), (2, "no heads\nat all"), (3, None), (4, "")], "seq long, full_text string")
    parts = structure.sections(df)
    assert [(r.seq, r.heading, r.content) for r in parts.orderBy("seq", "pos").collect()] == [(1, "Abstract", "Title"), (1, "Abstract", "A1"), (1, "1. Introduction", "I1\nI2"), (1, "References", "[1] x"), (2, "Abstract", "no heads\nat all")]
    assert {r.seq: r.abstract for r in structure.abstract(df, parts).collect()} == {1: "Title", 2: "no heads\nat all", 3: "", 4: ""}
    body, refs = structure.split_references(F.col("full_text"))
    assert df.select(body.alias("b"), refs.alias("r")).first() == (text[: text.index("\nReferences")], "[1] x")


def test_reading_order(spark):
    rows = [("L", 50, 100), ("L", 50, 200), ("L", 50, 300), ("R", 320, 150), ("R", 320, 250), ("R", 320, 350), ("C", 100, 200)]
    blocks = [("p", 1, 600.0, 800.0, i, float(x), float(y), float(x + (400 if s == "C" else 200)), float(y + 10), f"block {s}{y}") for i, (s, x, y) in enumerate(rows)]
    blocks += [("p", 1, 600.0, 800.0, 90, 0.0, 50.0, 99.0, 95.9, "header"), ("p", 1, 600.0, 800.0, 91, 0.0, 704.1, 99.0, 760.0, "footer"), ("p", 1, 600.0, 800.0, 92, 0.0, 400.0, 99.0, 410.0, "abcd"), ("p", 1, 600.0, 800.0, 93, 0.0, 400.0, 99.0, 410.0, "12345")]
    df = spark.createDataFrame(blocks, "paper_id string, page_num int, page_width double, page_height double, block_no int, x0 double, y0 double, x1 double, y1 double, text string")
    ordered = structure.reading_order(structure.body_blocks(df))
    assert [r.text[6:] for r in ordered.orderBy("ord").collect()] == ["L100", "R150", "C200", "L200", "R250", "L300", "R350"]
    assert structure.full_text(ordered).first().full_text.startswith("block L100\nblock R150")


def test_extraction(spark):
    out = {"paper": {"title": "T", "abstract": "A"}, "authors": [{"name": "Ann", "affiliation": "Ann"}, {"name": "Bo", "affiliation": " Uni "}], "methods": [{"name": " "}, {"name": "M"}], "tasks": [{"name": "NLP"}], "results": [{"method": "M", "dataset": "D", "metric": "F1", "value": ""}, {"method": "M", "dataset": "D", "metric": "F1", "value": "3"}], "relations": [{"type": "uses_method", "source": "t", "target": "m"}, {"type": "USES", "source": "T", "target": "nothing"}]}
    df = spark.createDataFrame([("p", json.dumps(out)), ("q", '{"paper": {}}'), ("r", "no json")], "paper_id string, output string")
    rows = df.select("paper_id", extract.parsed(F.col("output")).alias("parsed"))
    made = extract.entities(rows).cache()
    assert sorted((r.entity_type, r.name) for r in made.collect()) == [("Author", "Ann"), ("Author", "Bo"), ("Domain", "NLP"), ("Institution", "Uni"), ("Method", "M"), ("Paper", "T"), ("Result", "M on D (F1)"), ("Task", "NLP")]
    good, bad = extract.triples(rows, made)
    assert [(r.relation_type, r.source_entity_name, r.target_entity_name) for r in good.collect()] == [("USES", "t", "m")] and bad.count() == 1


def test_levels_and_cross_paper_text(spark):
    def generator(prompt):
        if prompt.startswith("Read the paper"):
            return '{"paper": {"title": "First"}}' if "good" in prompt else '{"paper": {"title" "X"}}'
        if prompt.startswith("Your last answer"):
            if "fails" in prompt:
                raise RuntimeError("timed out")
            return '{"paper": {"title": " "}}' if "blank" in prompt else '{"paper": {"title": "Second"}}' if "second" in prompt else "sorry"
        return '{"paper": {"title": "Third"}}' if "third" in prompt or "fails" in prompt or "blank" in prompt else ""

    papers = spark.createDataFrame([("p", "good"), ("q", "second"), ("r", "third"), ("s", "fails"), ("t", "blank"), ("u", None), ("v", "never")], "paper_id string, text string")
    rows = extract.with_levels(papers, generator, policy=Policy(attempts=1)).collect()
    assert {r.paper_id: (r.level, r.parsed and r.parsed.paper.title) for r in rows} == {"p": (1, "First"), "q": (2, "Second"), "r": (3, "Third"), "s": (3, "Third"), "t": (3, "Third"), "u": (None, None), "v": (None, None)}
    schema = "a struct<summary:string,details:array<struct<method:string,description:string,experiments:array<struct<paper:string,dataset:string,metric:string,result:string>>,advantage:string>>,missing_papers:array<string>>"
    df = spark.createDataFrame([(("S", [("M", "d", [("P", "D", "F1", "3")], None)], ["Z"]),)], schema)
    text = df.select(extract.cross_paper_answer(F.col("a")).alias("t")).first().t
    assert "1. **M**\n   - 描述：d\n   - 实验：\n     · 在 P 中，使用 D 数据集，F1=3" in text and text.startswith("S\n") and text.endswith("> - Z")


def test_incremental(spark):
    c = spark.createDataFrame([("p", "h1", 1), ("p", "h2", 2), ("q", "h1", 3)], "paper_id string, chunk_hash string, seq long")
    new, reused = incremental.diff(c, c.where("seq = 1"))
    assert sorted(r.seq for r in new.collect()) == [2, 3] and [r.seq for r in reused.collect()] == [1]
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "chunk_id string, seq long, v string")
    once = incremental.upsert(rows, rows.withColumn("seq", F.lit(2).cast("long")).withColumn("v", F.lit("z")), "chunk_id")
    assert {(r.chunk_id, r.v) for r in incremental.upsert(once, once, "chunk_id").collect()} == {("a", "z"), ("b", "z")}


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1), (3, [1.0, 0.0], 1), (4, [0.0, 0.0], 1), (5, [1.0], 1)], "id int, embedding array<double>, label int")
    q = F.array(F.lit(1.0), F.lit(0.0))
    assert [(r.id, r.distance) for r in vectors.top_k(v, q, "id", 2).collect()] == [(1, 0.0), (3, 0.0)]
    assert [r.id for r in vectors.top_k(v, q, "id", 9, F.col("label") == 1).collect()] == [3, 2, 4, 5]
    assert vectors.top_k(v, q, "id", 3, F.col("label") == 7).collect() == []


def test_graph_documents(spark, tmp_path):
    path = tmp_path / "graph.json"
    path.write_text(json.dumps({"entities": [{"entity_id": "e", "name": "N", "source_paper_id": "p1|p10"}], "triples": [{"triple_id": "t", "relation_type": "uses_tool", "source_entity_id": "e", "target_entity_id": "e", "created_at": "2024-01-02T03:04:05Z"}]}))
    e, t = graph_json.read_graph(spark, str(path))
    assert e.first().source_paper_ids == ["p1", "p10"] and e.first().community_id == -1
    assert t.first().relation_type == "USES" and t.first().confidence == 1.0
    assert graph_json.read_graph(spark, str(tmp_path / "missing.json"))[0].count() == 0
    (tmp_path / "bad.json").write_text("{oops")
    assert graph_json.read_aliases(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "rep.json").write_text(json.dumps({"generated_at": "x", "model": "m", "communities": {"0": {"title": "T", "size": 3}}}))
    assert graph_json.read_reports(spark, str(tmp_path / "rep.json")).first().title == "T"
    graph_json.write_document(e.drop("properties"), t, str(tmp_path / "out"))
    assert graph_json.read_graph(spark, str(tmp_path / "out"))[0].count() == 1
    assert export.write_property_graph(e.select("entity_id"), t.select("triple_id"), str(tmp_path / "pg")) == (1, 1)
    assert export.checkpoint(spark, str(tmp_path / "cp"), 1, 2).first().triple_count == 2


def test_document_scan(spark, tmp_path):
    (tmp_path / "a.txt").write_text("First block here\n\nSecond block\fPage two")
    (tmp_path / "b.md").write_text("other")
    assert documents.files(spark, str(tmp_path), "*.txt").count() == 1
    assert [(r.page_num, r.text) for r in documents.blocks(spark, str(tmp_path), "*.txt").orderBy("page_num", "block_no").collect()] == [(1, "First block here"), (1, "Second block"), (2, "Page two")]


def small_pdf(pages, title=None, packed=False):
    """A PDF file of pages of (x, y, text) lines."""
    bodies, kids = {}, []
    for k, lines in enumerate(pages):
        ops = "BT /F1 12 Tf " + " ".join(f"1 0 0 1 {x} {y} Tm ({t}) Tj" for x, y, t in lines) + " ET"
        stream = ops.encode("cp1252")
        head = f"<< /Length {len(stream)} >>"
        if packed:
            stream = zlib.compress(stream)
            head = f"<< /Length {len(stream)} /Filter /FlateDecode >>"
        bodies[10 + 2 * k] = f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * k} 0 R >>".encode()
        bodies[11 + 2 * k] = head.encode() + b" stream\n" + stream + b"\nendstream"
        kids.append(f"{10 + 2 * k} 0 R")
    bodies[1] = b"<< /Type /Catalog /Pages 2 0 R >>"
    bodies[2] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(kids)}] /MediaBox [0 0 600 800] /Resources << /Font << /F1 5 0 R >> >> >>".encode()
    bodies[5] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"
    bodies[6] = f"<< /Title ({title or ''}) >>".encode()
    out = b"%PDF-1.4\n" + b"".join(f"{n} 0 obj ".encode() + b + b" endobj\n" for n, b in sorted(bodies.items()))
    return out + b"trailer << /Root 1 0 R /Info 6 0 R >>\nstartxref\n0\n%%EOF"


def test_pdf_files(spark, tmp_path):
    pages = [[(60, 780, "Running header"), (60, 600, "1. Introduction"), (60, 586, "We test \\(and fit\\) it."), (60, 400, "Another paragraph here")], [(60, 700, "Second page text"), (300, 40, "12")]]
    (tmp_path / "My Paper.pdf").write_bytes(small_pdf(pages, " A Title ", True))
    (tmp_path / "other.pdf").write_bytes(small_pdf([[(60, 500, "Only one line")]]))
    (tmp_path / "bad.pdf").write_bytes(b"no pdf at all")
    got = documents.blocks(spark, str(tmp_path)).withColumn("paper_id", F.col("path"))
    mine = [(r.page_num, r.page_height, r.text) for r in got.where("path LIKE '%My%20Paper.pdf' OR path LIKE '%My Paper.pdf'").orderBy("page_num", "block_no").collect()]
    assert mine == [(1, 800.0, "Running header"), (1, 800.0, "1. Introduction\nWe test (and fit) it."), (1, 800.0, "Another paragraph here"), (2, 800.0, "Second page text"), (2, 800.0, "12")]
    assert got.where("path LIKE '%bad.pdf'").first().text.startswith("error: ")
    body = structure.full_text(structure.reading_order(structure.body_blocks(got.where("page_num > 0"))))
    texts = {r.paper_id.split("/")[-1].replace("%20", " "): r.full_text for r in body.collect()}
    assert texts["My Paper.pdf"] == "1. Introduction\nWe test (and fit) it.\nAnother paragraph here\n\nSecond page text"
    assert {r.path.split("/")[-1].replace("%20", " "): r.title for r in documents.titles(spark, str(tmp_path)).collect()} == {"My Paper.pdf": "A Title", "other.pdf": "other", "bad.pdf": "bad"}


def test_scope_and_retry(spark):
    files = spark.createDataFrame([("My Paper.pdf", 2), ("x" * 60 + ".pdf", 1), ("Other.pdf", 3)], "filename string, at int")
    got = {r.label: r.paper_id for r in structure.scope(files).collect()}
    assert got == {"My Paper": "my_paper", "x" * 50: "x" * 50, "Other": "other"}
    chunks = spark.createDataFrame([("a", "text", "failed"), ("b", "text", "failed"), ("c", None, "failed"), ("d", "text", "pending")], "chunk_id string, content string, extraction_status string")
    after = incremental.retry(chunks, chunks.where("chunk_id <> 'd'").select("chunk_id"), lambda rows: rows.where("chunk_id = 'a'"))
    assert {r.chunk_id: r.extraction_status for r in after.collect()} == {"a": "success", "b": "failed", "c": "failed", "d": "pending"}


def test_document_sinks(spark, tmp_path):
    aliases = spark.createDataFrame([("x", "The \"A\"", "e1", "Model", "auto", 0.5, "now")] * 2, graph_json.ALIAS)
    graph_json.write_aliases(aliases, str(tmp_path / "aliases"))
    assert [r.alias_text for r in graph_json.read_aliases(spark, str(tmp_path / "aliases")).collect()] == ['The "A"'] * 2
    reviews = spark.createDataFrame([], graph_json.REVIEW)
    graph_json.write_reviews(reviews, str(tmp_path / "reviews"))
    assert graph_json.read_reviews(spark, str(tmp_path / "reviews")).count() == 0
    reports = spark.createDataFrame([(3, "T", "S\nline", ["f"], ["e"], 1, 0), (10, "U", "", [], [], 4, 0)], "community_id int, " + graph_json.REPORT)
    graph_json.write_reports(reports, str(tmp_path / "reports"), "m")
    assert {(r.community_id, r.title, r.summary, r.model) for r in graph_json.read_reports(spark, str(tmp_path / "reports")).collect()} == {(3, "T", "S\nline", "m"), (10, "U", "", "m")}
    entities = spark.createDataFrame([(1, "e1", "Model", "A", "p"), (0, "e0", "Task", "B", "p")], "seq long, entity_id string, entity_type string, name string, source_paper_id string")
    triples = spark.createDataFrame([(5, "t", "USES", "e1", "e0")], "seq long, triple_id string, relation_type string, source_entity_id string, target_entity_id string")
    graph_json.write_document(entities, triples, str(tmp_path / "graph"))
    e, t = graph_json.read_graph(spark, str(tmp_path / "graph"))
    assert [r.entity_id for r in e.orderBy("seq").collect()] == ["e0", "e1"] and t.count() == 1
    text = "".join(p.read_text() for p in (tmp_path / "graph").glob("part-*"))
    assert json.loads(text)["stats"] == {"total_entities": 2, "total_triples": 1, "entity_type_distribution": {"Model": 1, "Task": 1}, "relation_type_distribution": {"USES": 1}}


RESTARTED = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from lattica.streaming import ingest
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
ingest.chunk_stream(spark.readStream.schema("seq long, paper_id string, full_text string").parquet({src!r}), {store!r}).awaitTermination()
spark.stop()
"""


def test_stream_goes_on_in_another_process(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    schema, root = "seq long, paper_id string, full_text string", os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spark.createDataFrame([(1, "p", "x" * 900)], schema).write.parquet(src)
    ingest.chunk_stream(spark.readStream.schema(schema).parquet(src), store).awaitTermination()
    spark.createDataFrame([(2, "q", "new text")], schema).write.mode("append").parquet(src)
    subprocess.run([sys.executable, "-c", RESTARTED.format(root=root, src=src, store=store)], check=True, timeout=300, env={**os.environ, "PYTHONHASHSEED": "7", "PYTHONPATH": root})
    assert sorted((r.batch, r.paper_id) for r in ingest.stored(spark, store).collect()) == [(0, "p"), (0, "p"), (1, "q")]


def test_shared_folder_is_needed_on_a_cluster(spark):
    from lattica.plans import tables

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        conf = Conf({"spark.master": "local-cluster[2,1,1024]"})

    with pytest.raises(ValueError):
        tables.shared_dir(Session)
    Session.conf = Conf({"spark.master": "local[2]"})
    assert tables.shared_dir(Session).startswith("file://") and Session.conf["spark.checkpoint.dir"]
    with tables.scratch(spark):
        frame = tables.cut(spark.range(3), "t")
        path = frame.inputFiles()[0].replace("file://", "").rsplit("/", 1)[0]
        assert os.path.isdir(path)
    assert not os.path.exists(path)


def test_stream(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    schema = "seq long, paper_id string, full_text string"
    spark.createDataFrame([(1, "p", "x" * 900), (2, "q", None)], schema).write.parquet(src)
    for _ in range(2):
        ingest.chunk_stream(spark.readStream.schema(schema).parquet(src), store, str(tmp_path / "cp")).awaitTermination()
    assert ingest.stored(spark, store).count() == 2
    spark.createDataFrame([(3, "p", "x" * 900), (4, "r", "new text")], schema).write.mode("append").parquet(src)
    ingest.chunk_stream(spark.readStream.schema(schema).parquet(src), store, str(tmp_path / "cp")).awaitTermination()
    assert ingest.stored(spark, store).count() == 3
