"""Structure, chunks and incremental processing of papers and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.catalog.common import SPACE_CLASS
from lattica.constants import HEADING_PATTERNS
from lattica.operators import chunking, graph, incremental, structure
from lattica.plans.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE_CLASS}+', ''), '{SPACE_CLASS}+$', '')"


_HEAD = "(line <> '' AND length(line) <= 80 AND ((upper(line) = line AND lower(line) <> line AND length(line) BETWEEN 5 AND 40) OR " + " OR ".join(f"regexp_matches(line, '{p}')" for p in HEADING_PATTERNS) + "))"
_SECTIONS = f"""lines AS (SELECT seq, i, {_strip("l")} AS line FROM (SELECT seq, unnest(string_split(full_text, chr(10))) AS l, generate_subscripts(string_split(full_text, chr(10)), 1) AS i FROM papers WHERE full_text IS NOT NULL)),
marked AS (SELECT *, {_HEAD} AS head, sum(CASE WHEN {_HEAD} THEN 1 ELSE 0 END) OVER (PARTITION BY seq ORDER BY i) AS grp FROM lines WHERE line <> ''),
raw AS (SELECT seq, grp, coalesce(max(CASE WHEN head THEN line END), 'Abstract') AS heading, string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY i) AS content FROM marked GROUP BY 1, 2),
sections AS (SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY grp) - 1 AS pos, heading, content FROM raw WHERE content IS NOT NULL)"""


@query(f"WITH {_SECTIONS} SELECT seq, pos, heading, content FROM sections")
def sections(spark, root):
    return structure.sections(table(spark, root, "papers", "seq", "full_text")).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH {_SECTIONS}, f AS (SELECT seq, min_by(content, pos) AS c FROM sections WHERE starts_with(lower(heading), 'abstract') GROUP BY 1)
SELECT p.seq, coalesce(left(c, 2000), left(string_split(coalesce(full_text, ''), chr(10) || chr(10))[1], 1500)) AS abstract FROM papers p LEFT JOIN f ON f.seq = p.seq""")
def abstract(spark, root):
    papers = table(spark, root, "papers", "seq", "full_text")
    return structure.abstract(papers, structure.sections(papers))


_REF = r"(?i)(?:^|\n)(?:References?|Bibliography)\s*\n"


@query(rf"""SELECT seq, CASE WHEN k > 0 THEN left(full_text, k - 1) ELSE full_text END AS body, CASE WHEN k > 0 THEN substr(full_text, k + length(m)) END AS refs
FROM (SELECT *, regexp_extract(full_text, '{_REF}', 0) AS m, CASE WHEN regexp_matches(full_text, '{_REF}') THEN strpos(full_text, regexp_extract(full_text, '{_REF}', 0)) ELSE 0 END AS k FROM papers)""")
def refs_split(spark, root):
    body, refs = structure.split_references(F.col("full_text"))
    return table(spark, root, "papers", "seq", "full_text").select("seq", body.alias("body"), refs.alias("refs"))


_BLOCKS = """blocks AS (SELECT paper_id, page_num, seq AS block_no, 600.0::DOUBLE AS page_width, 800.0::DOUBLE AS page_height, (char_start % 500)::DOUBLE AS x0, (char_start % 500 + 60 + char_end % 40)::DOUBLE AS x1, (char_end % 780)::DOUBLE AS y0, (char_end % 780 + 10)::DOUBLE AS y1, content AS text FROM chunks WHERE char_start IS NOT NULL AND char_end IS NOT NULL AND page_num IS NOT NULL)"""


def _blocks(spark, root):
    c = table(spark, root, "chunks", "seq", "paper_id", "page_num", "char_start", "char_end", "content").where("char_start IS NOT NULL AND char_end IS NOT NULL AND page_num IS NOT NULL")
    x0, y0 = F.col("char_start") % 500, F.col("char_end") % 780
    return c.select("paper_id", "page_num", F.col("seq").alias("block_no"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"), x0.cast("double").alias("x0"), (x0 + 60 + F.col("char_end") % 40).cast("double").alias("x1"), y0.cast("double").alias("y0"), (y0 + 10).cast("double").alias("y1"), F.col("content").alias("text"))


@query(f"""WITH {_BLOCKS}, b AS (SELECT *, {_strip("text")} AS s FROM blocks WHERE NOT (y1 < page_height * 0.12 OR y0 > page_height * 0.88)),
k AS (SELECT *, CASE WHEN x0 < 300 AND x1 < 300 THEN 1 WHEN x0 >= 300 THEN 2 ELSE 0 END AS side FROM b WHERE length(s) >= 5 AND NOT regexp_full_match(s, '\\d+')),
t AS (SELECT *, count(*) FILTER (side = 1) OVER w >= 3 AND count(*) FILTER (side = 2) OVER w >= 3 AS two FROM k WINDOW w AS (PARTITION BY paper_id, page_num))
SELECT paper_id, page_num, block_no, row_number() OVER (PARTITION BY paper_id, page_num ORDER BY y0, CASE WHEN two THEN side ELSE x0 END, block_no) AS ord FROM t""")
def reading_order(spark, root):
    """Positioned blocks come from chunks, their places on the page from their offsets."""
    return structure.reading_order(structure.body_blocks(_blocks(spark, root))).select("paper_id", "page_num", "block_no", F.col("ord").cast("long").alias("ord"))


@query(f"""WITH RECURSIVE p AS (SELECT seq, full_text AS t, length(full_text) AS n FROM papers WHERE length(full_text) > 0),
step(seq, i, pos, done, a, b, blank) AS (
  SELECT seq, -1, 0, false, 0, 0, true FROM p
  UNION ALL
  SELECT q.seq, CASE WHEN blank2 THEN q.i ELSE q.i + 1 END, CASE WHEN blank2 THEN stop ELSE greatest(q.pos + 1, fin - 100) END, NOT blank2 AND fin >= n OR blank2 AND stop >= n, q.pos, CASE WHEN blank2 THEN stop ELSE fin END, blank2
  FROM (SELECT s.seq, s.i, s.pos, p.n, least(s.pos + 800, p.n) AS stop, {_strip("substr(p.t, s.pos + 1, 800)")} = '' AS blank2,
      CASE WHEN s.pos + 800 < p.n AND contains(substr(p.t, s.pos + 1, 800), chr(10) || chr(10)) AND 800 - strpos(reverse(substr(p.t, s.pos + 1, 800)), chr(10) || chr(10)) - 1 > 400
           THEN s.pos + 800 - strpos(reverse(substr(p.t, s.pos + 1, 800)), chr(10) || chr(10)) - 1 ELSE least(s.pos + 800, p.n) END AS fin
    FROM step s JOIN p ON p.seq = s.seq WHERE NOT s.done AND s.pos < p.n) q)
SELECT s.seq, CAST(i AS BIGINT) AS chunk_index, CAST(a AS BIGINT) AS char_start, CAST(b AS BIGINT) AS char_end, sha256(substr(t, a + 1, b - a)) AS chunk_hash FROM step s JOIN p ON p.seq = s.seq WHERE i >= 0 AND NOT blank""")
def chunks(spark, root):
    c = chunking.chunks(table(spark, root, "papers", "seq", "full_text"))
    return c.select("seq", *(F.col(x).cast("long").alias(x) for x in ("chunk_index", "char_start", "char_end")), "chunk_hash")


@query("""SELECT c.seq, CAST((SELECT max(k) FROM range(1, coalesce(greatest(p.total_pages, 1), 1) + 1) r(k) WHERE k = 1 OR CAST(floor((k - 1) * (length(p.full_text)::DOUBLE / p.total_pages)) AS BIGINT) <= c.char_start) AS BIGINT) AS page
FROM chunks c JOIN (SELECT * FROM papers WHERE length(full_text) > 0 QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY seq DESC) = 1) p ON p.paper_id = c.paper_id WHERE c.char_start IS NOT NULL""")
def chunk_page(spark, root):
    papers = graph.latest(table(spark, root, "papers", "seq", "paper_id", "full_text", "total_pages").where(F.length("full_text") > 0).select("seq", "paper_id", F.length("full_text").alias("n"), "total_pages"), "paper_id").drop("seq")
    c = table(spark, root, "chunks", "seq", "paper_id", "char_start").where("char_start IS NOT NULL")
    return c.join(papers, "paper_id").select("seq", chunking.page_of(F.col("char_start"), F.col("n"), F.col("total_pages")).cast("long").alias("page"))


@query("""WITH s AS (SELECT seq AS pseq, paper_id, unnest(sections, recursive := true) FROM papers QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY seq DESC) = 1),
z AS (SELECT *, coalesce(length(content), 0) + coalesce(length(heading), 0) + 2 AS size FROM s), w AS (SELECT *, sum(size) OVER (PARTITION BY paper_id ORDER BY pos) - size AS low FROM z)
SELECT c.seq, coalesce(w.heading, '') AS section FROM chunks c LEFT JOIN w ON w.paper_id = c.paper_id AND c.char_start >= low AND c.char_start < low + size WHERE c.char_start IS NOT NULL""")
def chunk_section(spark, root):
    papers = graph.latest(table(spark, root, "papers", "seq", "paper_id", "sections"), "paper_id")
    parts = papers.select("paper_id", F.inline("sections"))
    c = table(spark, root, "chunks", "seq", "paper_id", "char_start").where("char_start IS NOT NULL")
    return chunking.with_section(c, chunking.section_spans(parts, "paper_id"), "paper_id").select("seq", F.col("section_title").alias("section"))


@query("""WITH n AS (SELECT paper_id, chunk_index, content, coalesce(nullif(section_title, ''), '正文') AS section FROM chunks WHERE content IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY seq DESC) = 1),
b AS (SELECT paper_id, section, min(chunk_index) AS at0, string_agg(content, chr(10) ORDER BY chunk_index, content) AS body FROM n GROUP BY 1, 2)
SELECT paper_id, left(string_agg('## ' || section || chr(10) || body, chr(10) || chr(10) ORDER BY at0, section), 40000) AS text FROM b GROUP BY 1""")
def document_text(spark, root):
    c = graph.latest(table(spark, root, "chunks", "seq", "chunk_id", "paper_id", "chunk_index", "content", "section_title").where("content IS NOT NULL"), "chunk_id")
    return structure.document_text(c)


@query("""SELECT seq, left(replace(lower(regexp_replace(title, '\\.[^.]*$', '')), ' ', '_'), 50) AS paper_key FROM papers WHERE title IS NOT NULL""")
def paper_key(spark, root):
    return table(spark, root, "papers", "seq", "title").where("title IS NOT NULL").select("seq", structure.paper_key(F.col("title")).alias("paper_key"))


_WHITE = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"


@query(f"SELECT seq, coalesce(nullif(trim(title, {_WHITE}), ''), paper_id) AS title FROM papers WHERE paper_id IS NOT NULL")
def title_pick(spark, root):
    """A paper's own title, else the name of its file."""
    p = table(spark, root, "papers", "seq", "paper_id", "title").where("paper_id IS NOT NULL")
    return p.select("seq", structure.title(F.col("title"), F.concat("paper_id", F.lit(".pdf"))).alias("title"))


@query("SELECT label, arg_min(lower(replace(title, ' ', '_'))[1:50], seq) AS paper_id FROM (SELECT seq, title, left(title, 50) AS label FROM papers WHERE title IS NOT NULL AND NOT contains(title, '.')) WHERE label < 'M' GROUP BY 1")
def paper_scope(spark, root):
    """The papers of the files whose labels are picked; titles stand for file names here, the picked ones begin before M."""
    p = table(spark, root, "papers", "seq", "title").where("title IS NOT NULL AND NOT contains(title, '.')").select(F.concat("title", F.lit(".pdf")).alias("filename"), F.col("seq").alias("at"))
    return structure.scope(p).where("label < 'M'")


@query("""WITH c1 AS (SELECT * FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY seq DESC) = 1)
SELECT chunk_id, CASE WHEN extraction_status <> 'failed' OR content IS NULL THEN extraction_status WHEN length(content) > 500 THEN 'success' ELSE 'failed' END AS extraction_status FROM c1""")
def chunk_retry(spark, root):
    """Failed chunks tried once more; the long ones succeed here."""
    c = graph.latest(table(spark, root, "chunks", "seq", "chunk_id", "content", "extraction_status").where("chunk_id IS NOT NULL"), "chunk_id")
    return incremental.retry(c, c.where("extraction_status = 'failed'").select("chunk_id"), lambda rows: rows.where(F.length("content") > 500)).select("chunk_id", "extraction_status")


@query("""SELECT paper_id, count(*) AS n, count(DISTINCT sha256(content)) AS hashes, count(*) FILTER (chunk_hash IS NOT NULL AND lower(chunk_hash) <> sha256(content)) AS stale FROM chunks WHERE content IS NOT NULL GROUP BY 1""")
def chunk_hashes(spark, root):
    h = incremental.content_hash(F.col("content"))
    return table(spark, root, "chunks", "paper_id", "content", "chunk_hash").where("content IS NOT NULL").groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(h).alias("hashes"), F.count_if(F.col("chunk_hash").isNotNull() & (F.lower("chunk_hash") != h)).alias("stale"))


_SPLIT = """stored AS (SELECT DISTINCT paper_id, sha256(content) AS h FROM chunks WHERE extraction_status = 'success' AND content IS NOT NULL),
incoming AS (SELECT seq, paper_id, sha256(content) AS h FROM chunks WHERE extraction_status <> 'success' AND content IS NOT NULL)"""


@query(f"WITH {_SPLIT} SELECT seq, EXISTS (SELECT 1 FROM stored s WHERE s.paper_id = i.paper_id AND s.h = i.h) AS reused FROM incoming i")
def hash_dedupe(spark, root):
    c = table(spark, root, "chunks", "seq", "paper_id", "content", "extraction_status").where("content IS NOT NULL").select("seq", "paper_id", incremental.content_hash(F.col("content")).alias("chunk_hash"), "extraction_status")
    new, reused = incremental.diff(c.where("extraction_status <> 'success'"), c.where("extraction_status = 'success'"))
    return new.select("seq", F.lit(False).alias("reused")).unionByName(reused.select("seq", F.lit(True).alias("reused")))


_CHUNKS1 = "c1 AS (SELECT * FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY seq DESC) = 1)"


@query(f"WITH {_CHUNKS1} SELECT chunk_id, paper_id, seq, extraction_status FROM c1")
def vector_upsert(spark, root):
    c = table(spark, root, "chunks", "seq", "chunk_id", "paper_id", "extraction_status")
    # Finished chunks are stored; all chunks, these included, are written over them.
    return incremental.upsert(c.where("extraction_status = 'success'"), c, "chunk_id").select("chunk_id", "paper_id", "seq", "extraction_status")


@query(f"WITH {_CHUNKS1} SELECT paper_id, chunk_index, chunk_id, left(translate(content, chr(10) || chr(13), '  '), 120) AS preview, extraction_status FROM c1")
def chunk_listing(spark, root):
    c = table(spark, root, "chunks", "seq", "chunk_id", "paper_id", "chunk_index", "content", "extraction_status").where("chunk_id IS NOT NULL")
    return incremental.listing(graph.latest(c, "chunk_id"))


@query(f"""WITH {_CHUNKS1}, f AS (SELECT paper_id, chunk_id, row_number() OVER (PARTITION BY paper_id ORDER BY chunk_index, chunk_id) AS k FROM c1 WHERE extraction_status = 'failed')
SELECT paper_id, count(*) FILTER (extraction_status = 'success') AS success, count(*) FILTER (extraction_status = 'failed') AS failed, count(*) FILTER (extraction_status = 'pending') AS pending,
(SELECT coalesce(string_agg(chunk_id, ',' ORDER BY k), '') FROM f WHERE f.paper_id = c1.paper_id AND k <= 5) AS first_failed FROM c1 GROUP BY paper_id""")
def status_rollup(spark, root):
    c = table(spark, root, "chunks", "seq", "chunk_id", "paper_id", "chunk_index", "extraction_status").where("chunk_id IS NOT NULL")
    return incremental.rollup(graph.latest(c, "chunk_id"))


@query(f"WITH {_CHUNKS1} SELECT chunk_id, CASE WHEN content IS NOT NULL AND extraction_status IN ('failed', 'partial') THEN 'pending' ELSE extraction_status END AS extraction_status FROM c1")
def status_update(spark, root):
    """Failed and partial chunks set back for another try."""
    c = graph.latest(table(spark, root, "chunks", "seq", "chunk_id", "content", "extraction_status").where("chunk_id IS NOT NULL"), "chunk_id")
    changes = c.where(F.col("extraction_status").isin("failed", "partial")).select("chunk_id", F.lit("pending").alias("status"))
    return incremental.set_status(c, changes).select("chunk_id", "extraction_status")


@query("""WITH first AS (SELECT * FROM papers WHERE full_text IS NOT NULL AND publication_year >= 2015), stored AS (SELECT DISTINCT md5(full_text) AS d FROM papers WHERE full_text IS NOT NULL AND publication_year < 2015)
SELECT md5(full_text) AS digest, min(seq) AS seq FROM first WHERE md5(full_text) NOT IN (SELECT d FROM stored) GROUP BY 1""")
def upload_dedupe(spark, root):
    p = table(spark, root, "papers", "seq", "full_text", "publication_year").where("full_text IS NOT NULL")
    return incremental.new_uploads(p.where("publication_year >= 2015").select("seq", "full_text"), p.where("publication_year < 2015"), "full_text").select("digest", "seq")


@query("""WITH m AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, event_type AS role, props AS text FROM events)
SELECT user_id, string_agg('**' || role || '**: ' || text, chr(10) || chr(10) ORDER BY turn) AS markdown, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS plain FROM m GROUP BY 1""")
def chat_export(spark, root):
    from lattica.sources.export import conversations

    return conversations(table(spark, root, "events", "user_id", "ts", "event_id", "event_type", "props"), "user_id", ["ts", "event_id"], "event_type", "props")
