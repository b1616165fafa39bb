"""The facade: ingest, search, traverse, merge, delete, export and ask over the four tables."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.constants import TOP_K_CHUNKS
from lattica.operators import answer, chunking, community, extract, graph, incremental, resolve, retrieve, structure, vectors
from lattica.operators.calls import Generator, Parts, Policy
from lattica.plans.tables import cut, drop, swept


def extractive(prompt: str | Parts) -> str:
    """Offline generator: the first lines of what was retrieved, as the JSON answer a prompt asks for. It reads no more than these."""

    def lines() -> Iterator[str]:
        rest = ""
        for part in [prompt] if isinstance(prompt, str) else prompt:
            *whole, rest = (rest + part).split("\n")
            yield from whole
        yield rest

    first, *found = islice((x for i, x in enumerate(lines()) if not i or x.strip() and not x.startswith(("## ", "=", "Question"))), 4)
    text = " ".join(x.strip("# ") for x in found)[:600]
    return json.dumps({"answer": {"summary": text, "details": [], "missing_papers": []} if first.startswith("Context from several") else text}, ensure_ascii=False)


extractive.streams = True


class Engine:
    """Holds the tables as frames; every method returns frames and changes nothing it was given."""

    def __init__(self, spark: SparkSession, papers: DataFrame, chunks: DataFrame, entities: DataFrame, triples: DataFrame, embedder: vectors.Embedder | None = None, generator: Generator | None = None, keyword_generator: Generator | None = None, report_generator: Generator | None = None, policy: Policy = Policy()):
        self.spark, self.papers, self.chunks = spark, papers, chunks
        self.keyword_generator, self.report_generator, self.policy = keyword_generator, report_generator, policy
        self._reports = self._embedded = None
        # Written once: every method reads these two, most of them several times.
        with swept(spark):
            self.vertices = cut(graph.nodes(entities), "vertices")
            self.links = cut(graph.edges(triples, self.vertices), "links")
        self.embedder, self.generate = embedder or vectors.HashingEmbedder(), generator or extractive

    @classmethod
    def open(cls, spark: SparkSession, root: str, **kwargs) -> Engine:
        return cls(spark, *(spark.read.parquet(f"{root}/{t}.parquet") for t in ("papers", "chunks", "entities", "triples")), **kwargs)

    # Reading

    def stats(self) -> DataFrame:
        return graph.statistics(self.vertices, self.links)

    def search(self, keyword: str, entity_type: str | None = None) -> DataFrame:
        return graph.search(self.vertices, keyword, entity_type)

    def neighbors(self, entity_id: str, hops: int = 1) -> tuple[DataFrame, DataFrame]:
        """Entities within so many outgoing steps and the edges among them; both empty for an unknown id."""
        seed = self.vertices.where(F.col("entity_id") == entity_id).select(F.col("entity_id").alias("seed"))
        reached, inside = graph.ego(self.links, seed, hops)
        found = self.vertices.join(reached.select(F.col("node").alias("entity_id")), "entity_id", "left_semi")
        return found, self.links.join(inside.drop("seed"), ["source_entity_id", "target_entity_id"], "left_semi")

    def path(self, source: str, target: str) -> list[str]:
        return graph.shortest_path(self.links, source, target)

    def communities(self) -> DataFrame:
        return community.detect(self.vertices, self.links)

    # Writing

    def merge(self, primary: str, duplicates: list[str]) -> Engine:
        """Duplicates replaced by the primary, which keeps its name and type and gains what it lacked."""
        moved = self.vertices.where(F.col("entity_id").isin(duplicates) & (F.col("entity_id") != primary)).select("entity_id", F.lit(primary).alias("primary_id"))
        links = graph.redirect(self.links, moved)
        group = self.vertices.where(F.col("entity_id").isin([primary, *duplicates]))
        first = {c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct(F.col("entity_id") != primary, "seq"))).alias(c) for c in group.columns if c not in ("entity_id", "name", "entity_type")}
        filled = group.agg(*first.values()).withColumn("entity_id", F.lit(primary))
        kept = self.vertices.where(F.col("entity_id") == primary).select("entity_id", "name", "entity_type").join(filled, "entity_id").select(self.vertices.columns)
        rest = self.vertices.where(~F.col("entity_id").isin([primary, *duplicates]))
        return self._with(rest.unionByName(kept), links)

    def delete_entity(self, entity_id: str) -> Engine:
        return self._with(*graph.delete_entities(self.vertices, self.links, self.vertices.where(F.col("entity_id") == entity_id).select("entity_id")))

    def delete_paper(self, paper_id: str) -> Engine:
        """Without the paper's entities, the edges at them, and its chunks."""
        gone = self.vertices.where(F.lower("source_paper_id") == paper_id.lower()).select("entity_id")
        out = self._with(*graph.delete_entities(self.vertices, self.links, gone))
        out.chunks = self.chunks.where(F.coalesce(F.lower("paper_id") != paper_id.lower(), F.lit(True)))
        return out

    def _with(self, vertices: DataFrame, links: DataFrame) -> Engine:
        out = object.__new__(Engine)
        out.__dict__.update(self.__dict__)
        out.vertices, out.links = vertices, links
        out._reports = out._embedded = None
        return out

    def add(self, entities: DataFrame, triples: DataFrame, aliases: DataFrame | None = None) -> tuple[Engine, dict[str, DataFrame]]:
        """(engine, records): the graph with a batch of entities and triples, entities resolved against it first, triples last.

        An entity that is known by name, alias or vector adds what it knows to the known one; a likely one waits in the review queue
        and enters as new. Triples whose ends are not in the graph afterwards are left out. `records` holds resolved, aliases and reviews.
        """
        with swept(self.spark):
            return self._added(entities, triples, aliases)

    def _added(self, entities: DataFrame, triples: DataFrame, aliases: DataFrame | None) -> tuple[Engine, dict[str, DataFrame]]:
        none = self.spark.createDataFrame([], "alias_text string, canonical_entity_id string, entity_type string")
        aliases = none if aliases is None else aliases
        new = cut(graph.nodes(entities), "new")
        embed = lambda df: vectors.embed_distinct(df.where("name IS NOT NULL").select("entity_id", "entity_type", "name", "seq"), "name", self.embedder)
        old = cut(embed(self.vertices), "old")
        done = cut(resolve.resolve(embed(new), old, aliases), "resolved")
        moved = cut(done.where(F.col("how").isin("exact", "alias", "embedding") & (F.col("entity_id") != F.col("match_id"))).select("entity_id", F.col("match_id").alias("primary_id")), "moved")
        entering = new.join(moved, "entity_id", "left").withColumn("entity_id", F.coalesce("primary_id", "entity_id")).drop("primary_id").withColumn("_late", F.lit(True))
        both = self.vertices.withColumn("_late", F.lit(False)).unionByName(entering, allowMissingColumns=True)
        vertices = cut(graph.merged_nodes(both, "_late"), "vertices")
        fresh = triples
        for end in ("source_entity_id", "target_entity_id"):
            fresh = fresh.join(moved.withColumnRenamed("entity_id", end), end, "left").withColumn(end, F.coalesce("primary_id", end)).drop("primary_id")
        # New triples are written after the stored ones.
        shift = F.lit(self.links.agg(F.max("seq")).first()[0] or 0)
        fresh = cut(fresh.withColumn("seq", F.col("seq") + shift + 1), "fresh")
        links = cut(graph.edges(self.links.unionByName(fresh, allowMissingColumns=True), vertices), "links")
        drop(fresh)
        records = {"resolved": done, "aliases": resolve.new_aliases(done, new, aliases), "reviews": resolve.review_rows(done, new, self.vertices)}
        return self._with(vertices, links), records

    def ingest(self, papers: DataFrame) -> DataFrame:
        """(seq, chunk_index, ..., reused): the chunks of new papers (seq, paper_id, full_text), and whether their hash is stored already."""
        body, refs = structure.split_references(F.col("full_text"))
        text = papers.select("seq", "paper_id", body.alias("full_text"), refs.alias("references_raw"))
        made = chunking.chunks(text).join(text.select("seq", "paper_id"), "seq")
        stored = self.chunks.where("content IS NOT NULL").select("paper_id", incremental.content_hash(F.col("content")).alias("chunk_hash"))
        new, reused = incremental.diff(made, stored)
        return new.withColumn("reused", F.lit(False)).unionByName(reused.withColumn("reused", F.lit(True)).drop("extraction_status"))

    # Asking

    def reports(self) -> DataFrame:
        """The reports of the communities, made once and kept."""
        if self._reports is None:
            known = self.vertices.where("community_id >= 0").select("entity_id", "community_id") if "community_id" in self.vertices.columns else self.communities()
            texts = community.texts(self.vertices, self.links.na.fill("", ["source_entity_name", "target_entity_name"]), known)
            self._reports = cut(community.reports(texts, generator=self.report_generator, policy=self.policy), "reports")
        return self._reports

    def embedded(self) -> DataFrame:
        """The last version of every chunk with its paper's title and its vector; equal contents are embedded once, and all only once."""
        if self._embedded is None:
            last = graph.latest(self.chunks.where("content IS NOT NULL AND chunk_id IS NOT NULL").select("seq", "chunk_id", "paper_id", "section_title", "content"), "chunk_id")
            titles = graph.latest(self.papers.where("paper_id IS NOT NULL").select("paper_id", "seq", "title"), "paper_id").select("paper_id", "title") if "title" in self.papers.columns else None
            last = last.join(titles, "paper_id", "left") if titles is not None else last.withColumn("title", F.lit(None).cast("string"))
            self._embedded = cut(vectors.embed_distinct(last, "content", self.embedder), "embedded")
        return self._embedded

    def prepare(self, questions: DataFrame, mode: str = "local", paper_ids: list[str] | None = None, k: int = TOP_K_CHUNKS) -> dict:
        """What answers to a stated set of questions (question_id, question) rest on: asked, prompts, and, but for global mode, entities, triples and hits.

        There, prompts are put together when they are read, of parts (question_id, kind, part, text) and what `crosses`; counts are the numbers of entities and triples.
        """
        with swept(self.spark):
            return self._prepared(questions, mode, paper_ids, k)

    def _prepared(self, questions: DataFrame, mode: str, paper_ids: list[str] | None, k: int) -> dict:
        asked = cut(retrieve.analysed(questions, self.keyword_generator, self.policy), "asked")
        if mode == "global":
            prompts = answer.theme_prompts(asked, self.reports()).withColumn("crosses", F.lit(False))
            return {"asked": asked, "prompts": cut(prompts, "prompts")}
        numbers = answer.numbered(asked)
        entities, triples = answer.marked_subgraph(asked, numbers, self.vertices, self.links, paper_ids)
        chunks = self.embedded()
        if paper_ids:
            chunks = chunks.where(F.lower("paper_id").isin([p.lower().strip() for p in paper_ids]))
        # A stated question set: its vectors are made here, in one batch.
        rows = questions.select("question_id", "question").collect()
        made = self.embedder([r.question or "" for r in rows]) if rows else []
        vectors_of = self.spark.createDataFrame([(r.question_id, [float(x) for x in v]) for r, v in zip(rows, made, strict=True)], "question_id int, vector array<double>")
        hits = cut(answer.nearest_chunks(vectors_of, chunks, k), "hits")
        crosses = cut(answer.crossing(questions, self.vertices, hits), "crosses")
        parts = answer.local_parts(asked, numbers, entities, triples, hits, crosses, self.vertices, self.reports() if mode == "hybrid" else None)
        counts = [answer.counted(entities, numbers, "n_entities"), answer.counted(triples, numbers, "n_triples")]
        return {"asked": asked, "entities": answer.unfolded(entities, numbers), "triples": answer.unfolded(triples, numbers), "hits": hits, "prompts": answer.whole(parts, crosses), "parts": parts, "crosses": crosses, "counts": counts}

    def ask_many(self, questions: DataFrame, mode: str = "local", paper_ids: list[str] | None = None) -> DataFrame:
        """One row per question of a stated set (question_id, question): answer, type, sources and counts. Modes: local, global, hybrid."""
        if mode not in ("local", "global", "hybrid"):
            raise ValueError(f"no mode {mode}")
        start = time.time()
        found = self.prepare(questions, mode, paper_ids)
        asked = found["asked"]
        if mode == "global":
            done, known = answer.answers(found["prompts"].where("prompt IS NOT NULL"), self.generate, self.policy), found["prompts"].select("question_id", "crosses", "n_entities")
        else:
            with swept(self.spark):
                done, known = answer.answers_from_parts(found["parts"], found["crosses"], self.generate, self.policy), found["crosses"]
        out = asked.join(done, "question_id", "left").join(known, "question_id", "left")
        none = F.array().cast("array<string>")
        if mode == "global":
            out = out.withColumns({"answer": F.coalesce("answer", F.lit(answer.NO_THEMES)), "question_type": F.lit("global"), "citations": none, "n_triples": F.lit(0), "n_chunks": F.lit(0)})
        else:
            n = lambda frame, name: frame.groupBy("question_id").agg(F.count(F.lit(1)).cast("int").alias(name))
            cited = found["hits"].groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "chunk_id"))), lambda x: x["chunk_id"]).alias("citations"))
            for frame in (*found["counts"], n(found["hits"], "n_chunks"), cited):
                out = out.join(frame, "question_id", "left")
            out = out.withColumns({c: F.col(c).cast("int") for c in ("n_entities", "n_triples")})
            out = out.withColumn("citations", F.coalesce("citations", none)).na.fill(0, ["n_entities", "n_triples", "n_chunks"]).withColumn("question_type", F.concat(F.lit(f"{mode}/"), "question_type"))
        return out.select("question_id", "question", "answer", "question_type", "crosses", "citations", "n_entities", "n_triples", "n_chunks", F.lit((time.time() - start) * 1000).alias("latency_ms"))

    def ask(self, question: str, mode: str = "local", paper_ids: list[str] | None = None) -> DataFrame:
        """One row: the answer to one question."""
        return self.ask_many(self.spark.createDataFrame([(1, question)], "question_id int, question string"), mode, paper_ids).drop("question_id")

    def converse(self, questions: DataFrame, mode: str = "local", shown: int = 5) -> tuple[DataFrame, DataFrame]:
        """((question_id, answer), sources) of a conversation: blank questions are passed over, a word of farewell ends it, questions for the
        graph's statistics are answered from it, and of the sources of the others the first few are shown and the rest counted."""
        said = questions.withColumn("question", F.trim("question")).where("question <> ''")
        end = said.where(F.lower("question").isin("exit", "quit", "q")).agg(F.min("question_id")).first()[0]
        said = said if end is None else said.where(F.col("question_id") < end)
        counted = said.where(answer.statistics_asked(F.col("question")))
        others = cut(said.where(~answer.statistics_asked(F.col("question"))).select("question_id", "question"), "questions")
        stats = counted.select("question_id").crossJoin(answer.statistics_text(self.vertices, self.links)).select("question_id", F.col("text").alias("answer"))
        replies = self.ask_many(others, mode).select("question_id", "answer")
        found = answer.subgraph(retrieve.analysed(others, self.keyword_generator, self.policy), self.vertices, self.links) if mode != "global" else (None, None)
        sources = answer.sources(*found, shown) if found[0] is not None else self.spark.createDataFrame([], "question_id int, kind string, place int, line string, rest int")
        return stats.unionByName(replies), sources
