"""Registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import best_record, bpe, format_dups, leaks, name_link, near_dups, scan_repair, spam, split_items, top_n
from lattica.plans.tables import cut, table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Chunks stored again in another formatting, each with the first of its set."""
    rows = format_dups.copies(table(spark, root, "chunks", "seq", "content"), "content", "seq")
    return rows.where(F.col("order") != F.col("first")).select(F.col("first").alias("first_seq"), F.col("order").alias("seq"))


def p1_collapsed(spark: SparkSession, root: str) -> DataFrame:
    """One row per distinct chunk up to formatting, with its number of copies."""
    rows = format_dups.representatives(table(spark, root, "chunks", "seq", "content"), "content", "seq")
    return rows.select(F.col("first").alias("first_seq"), "n_copies")


def _names(spark: SparkSession, root: str) -> DataFrame:
    """(scope, human, id, name, where) of author mentions and entities."""
    authors = table(spark, root, "author_items", "mention_id", "name", "affiliation")
    entities = table(spark, root, "entities", "entity_id", "entity_type", "name")
    nowhere = F.lit(None).cast("string")
    a = authors.select(F.lit("author").alias("scope"), F.lit(True).alias("human"), F.col("mention_id").alias("id"), "name", F.col("affiliation").alias("where"))
    e = entities.select(F.concat(F.lit("entity:"), "entity_type").alias("scope"), (F.col("entity_type") == "Author").alias("human"), F.col("entity_id").alias("id"), "name", nowhere.alias("where"))
    return a.unionByName(e)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of author mentions of one person, and of entities of one thing."""
    pairs = name_link.pairs_of(name_link.linked(_names(spark, root)))
    return pairs.select(F.split("scope", ":")[0].alias("kind"), "id_a", "id_b").distinct()


def p4_groups(spark: SparkSession, root: str) -> DataFrame:
    """Every author mention and entity with the group it is linked into."""
    return name_link.linked(_names(spark, root)).select(F.split("scope", ":")[0].alias("kind"), "id", F.md5("grp").alias("group_id")).distinct()


def _entity_args(spark: SparkSession, root: str) -> tuple:
    entities = table(spark, root, "entities", "entity_id", "seq", "llm_model", "extracted_at", "description", "properties", "source_chunk_ids")
    fields = [best_record.text_field("description"), best_record.map_field("properties"), best_record.list_field("source_chunk_ids")]
    return entities, "entity_id", "llm_model", "extracted_at", "seq", table(spark, root, "extractors", "llm_model", "trust"), fields


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """The row with the best value of each field of repeatedly extracted entities."""
    won = best_record.winners(*_entity_args(spark, root), least_rows=2)
    return won.select(F.col("grp").alias("entity_id"), "field_name", F.col("ord").alias("seq"))


def p5_survivors(spark: SparkSession, root: str) -> DataFrame:
    """One surviving record per entity, fields chosen by trust- and recency-weighted votes."""
    return best_record.survivors(*_entity_args(spark, root))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """The five triples of highest confidence per source entity."""
    triples = table(spark, root, "triples", "seq", "triple_id", "source_entity_id", "confidence", "created_at")
    last = top_n.latest(triples, "triple_id", "seq", "source_entity_id", "confidence", "created_at")
    best = top_n.top_n(last, "source_entity_id", "confidence", 5, [("created_at", "desc"), ("triple_id", "asc")])
    return best.select("source_entity_id", "triple_id", "place")


def _scans(spark: SparkSession, root: str) -> scan_repair.Repair:
    chunks, papers = table(spark, root, "chunks", "seq", "content"), table(spark, root, "papers", "seq", "full_text")
    c = chunks.select(F.lit("chunk").alias("kind"), F.col("seq").alias("id"), F.col("content").alias("text"))
    return scan_repair.Repair(c.unionByName(papers.select(F.lit("paper").alias("kind"), F.col("seq").alias("id"), F.col("full_text").alias("text"))))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Rows whose text holds what scanning and page layout put in."""
    return _scans(spark, root).found().select("kind", F.col("id").alias("seq"))


def p2_repaired(spark: SparkSession, root: str) -> DataFrame:
    """All texts of chunks and papers as continuous paragraphs."""
    return _scans(spark, root).repaired().select("kind", F.col("id").alias("seq"), "text")


#: Papers are versions of each other above this share of common four-word sequences.
VERSION_SHARE = 0.4


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of papers that are versions of each other."""
    papers = table(spark, root, "papers", "seq", "paper_id", "full_text")
    found = near_dups.pairs(papers, "paper_id", "seq", "full_text", VERSION_SHARE)
    return found.select(F.col("id_a").alias("paper_id_a"), F.col("id_b").alias("paper_id_b"))


def p3_classes(spark: SparkSession, root: str) -> DataFrame:
    """Every paper with its version group and its number of links."""
    papers = table(spark, root, "papers", "seq", "paper_id", "full_text")
    return near_dups.classes(papers, "paper_id", "seq", "full_text", VERSION_SHARE).withColumnRenamed("id", "paper_id")


#: Longest piece of a chunk and of a paper, and the overlap of consecutive pieces, in characters.
CHUNK_LIMIT, PAPER_LIMIT, OVERLAP = 800, 5000, 100


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Rows whose text is over the limit: those whose planned pieces are more than one."""
    chunks = split_items.offsets(table(spark, root, "chunks", "seq", "content"), F.col("seq"), "content", CHUNK_LIMIT, OVERLAP)
    papers = split_items.offsets(table(spark, root, "papers", "seq", "full_text"), F.col("seq"), "full_text", PAPER_LIMIT, OVERLAP)
    of = lambda kind, pieces: split_items.oversized(pieces).select(F.lit(kind).alias("kind"), F.col("key").alias("seq"))
    return of("chunk", chunks).unionByName(of("paper", papers))


def p7_pieces(spark: SparkSession, root: str) -> DataFrame:
    """The pieces themselves, with their section titles."""
    chunks = split_items.split_rows(table(spark, root, "chunks", "seq", "content", "section_title"), F.col("seq"), "content", CHUNK_LIMIT, OVERLAP, F.col("section_title"))
    papers = split_items.split_rows(table(spark, root, "papers", "seq", "full_text"), F.col("seq"), "full_text", PAPER_LIMIT, OVERLAP)
    return chunks.withColumn("kind", F.lit("chunk")).unionByName(papers.withColumn("kind", F.lit("paper"))).withColumnRenamed("key", "seq")


def p7_whole(spark: SparkSession, root: str) -> DataFrame:
    """The texts that the pieces spell when their overlaps are dropped, with the longest piece: a round trip."""
    pieces = cut(p7_pieces(spark, root).select(F.struct("kind", "seq").alias("key"), "piece", "content"), "pieces")
    longest = pieces.groupBy("key").agg(F.max(F.length("content")).alias("longest"))
    return split_items.joined(pieces, OVERLAP).join(longest, "key").select("key.kind", "key.seq", "text", (F.col("longest") <= F.when(F.col("key.kind") == "chunk", CHUNK_LIMIT).otherwise(PAPER_LIMIT)).alias("within"))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(table(spark, root, "documents", "doc_id", "text"), "doc_id", "text")


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that carry passages of held-out items, with the items."""
    docs, items = table(spark, root, "documents", "doc_id", "text"), table(spark, root, "eval_items", "item_id", "text")
    return leaks.leaks(docs, "doc_id", "text", items, "item_id", "text").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """Pages stuffed with keywords, links or tags."""
    return spam.spam(table(spark, root, "documents", "doc_id", "text", "lang"), "doc_id", "text", "lang").select(F.col("id").alias("doc_id"))


QUERIES = {"p1_found": p1_found, "p1_collapsed": p1_collapsed, "p2_found": p2_found, "p2_repaired": p2_repaired, "p3_found": p3_found, "p3_classes": p3_classes, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_survivors": p5_survivors, "p6_found": p6_found, "p7_found": p7_found, "p7_pieces": p7_pieces, "p7_whole": p7_whole, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found}

_WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_STAND_INS = "'na', 'nan', 'nil', 'none', 'null', 'unknown', 'unspecified', 'undefined', 'missing', 'empty', 'notspecified', 'notavailable', 'notapplicable', 'notgiven', 'notprovided', 'notknown', 'novalue', 'nodata', 'tbd', 'tba', 'todo', '未知', '不详', '无', '暂无', '未提供', '待定'"
_VALUE = "(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g') NOT IN ('', " + _STAND_INS + "))"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"


# A list of named fields, written for RE2: a name of up to 31 characters before a colon or equals sign, at the start or after a separator.
_NAMED = r"""(?:\A|[;,|\t\r\n{\[])(?:[\s{\[(>"“”]|[-–—*•·]|'')*(\pL[\pL\pN_ ]{0,30}?)(?:[\s"“”*]|'')*[:=]"""


def _canon(x: str) -> str:
    return f"regexp_replace(replace(lower(upper({x})), 'ß', 'ss'), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g')"


_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_FORMS = f"""c AS (SELECT seq, nfc_normalize(translate(content, '{_WIDE}', '{_NARROW}')) AS content FROM chunks WHERE content IS NOT NULL),
f AS (SELECT seq, {_canon("content")} AS plain, string_split(regexp_replace(content, '{_NAMED}', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts FROM c),
g AS (SELECT seq, plain, CASE WHEN len(parts) >= 3 AND {_canon("parts[1]")} = '' THEN array_to_string(list_sort(list_transform(parts[2:], lambda x: {_canon("x")})), '') END AS fields FROM f WHERE plain <> ''),
e AS (SELECT DISTINCT plain, coalesce(fields, plain) AS fields FROM g UNION SELECT plain, plain FROM g WHERE plain IN (SELECT fields FROM g)),
l1 AS (SELECT plain, min(fields) AS r FROM g WHERE fields IS NOT NULL GROUP BY 1), l2 AS (SELECT fields, min(r) AS r FROM e JOIN l1 USING (plain) GROUP BY 1), l3 AS (SELECT plain, min(r) AS r FROM e JOIN l2 USING (fields) GROUP BY 1),
l4 AS (SELECT fields, min(r) AS r FROM e JOIN l3 USING (plain) GROUP BY 1), l5 AS (SELECT plain, min(r) AS r FROM e JOIN l4 USING (fields) GROUP BY 1),
m AS (SELECT seq, coalesce(r, plain) AS key FROM g LEFT JOIN l5 USING (plain))"""
_LONG = f"""cells AS (
  SELECT entity_id, seq, llm_model, extracted_at, 'description' AS field_name, CASE WHEN {_VALUE.format("description")} THEN {_squeeze("description")} END AS value, length({_squeeze("description")}) AS complete FROM entities
  UNION ALL SELECT entity_id, seq, llm_model, extracted_at, 'properties', CAST(to_json(list_sort(list_transform(list_filter(map_entries(properties), lambda x: x.value IS NOT NULL AND {_VALUE.format("x.value")}), lambda x: {{'k': x.key, 'v': {_squeeze("x.value")}}}))) AS VARCHAR),
    len(list_filter(map_values(properties), lambda x: x IS NOT NULL AND {_VALUE.format("x")})) FROM entities
  UNION ALL SELECT entity_id, seq, llm_model, extracted_at, 'source_chunk_ids', CAST(to_json(list_sort(list_distinct(list_transform(list_filter(source_chunk_ids, lambda x: x IS NOT NULL AND {_VALUE.format("x")}), lambda x: {_squeeze("x")})))) AS VARCHAR),
    len(list_distinct(list_transform(list_filter(source_chunk_ids, lambda x: x IS NOT NULL AND {_VALUE.format("x")}), lambda x: {_squeeze("x")}))) FROM entities)"""
_SEQUENCES = r"""t AS (SELECT seq, paper_id, lower(full_text) AS x, regexp_replace(lower(full_text), '[^\p{L}\p{N}]+', '', 'g') AS bare FROM papers WHERE full_text IS NOT NULL AND paper_id IS NOT NULL),
w AS (SELECT seq, paper_id, bare, regexp_extract_all(x, '[\p{L}\p{N}_]+') AS words, length(regexp_replace(bare, '[^\x{3400}-\x{9fff}]+', '', 'g')) > 0.3 * length(bare) AS han FROM t),
s AS (SELECT seq, paper_id, list_distinct(CASE WHEN han THEN list_transform(range(1, length(bare) - 6), lambda i: substring(bare, i, 8)) ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS g FROM w),
u AS (SELECT seq, unnest(g) AS g FROM s), c AS (SELECT a.seq AS x, b.seq AS y, count(*) AS m FROM u a JOIN u b USING (g) WHERE a.seq < b.seq GROUP BY ALL),
v AS (SELECT a.paper_id AS pa, b.paper_id AS pb, a.g AS ga, b.g AS gb FROM c JOIN s a ON a.seq = x JOIN s b ON b.seq = y WHERE m / (len(a.g) + len(b.g) - m) > 0.4)"""
_VERSIONS = f"""WITH {_SEQUENCES}
SELECT DISTINCT least(pa, pb) AS paper_id_a, greatest(pa, pb) AS paper_id_b FROM v WHERE pa <> pb"""
# Links are between different texts; a copy has those of its text.
_CLASSES = f"""WITH RECURSIVE {_SEQUENCES},
f AS (SELECT DISTINCT paper_id, md5(array_to_string(list_sort(g), '|')) AS fp FROM s WHERE len(g) > 0),
d AS (SELECT fa, count(DISTINCT fb) AS n FROM (SELECT md5(array_to_string(list_sort(ga), '|')) AS fa, md5(array_to_string(list_sort(gb), '|')) AS fb FROM v UNION ALL SELECT md5(array_to_string(list_sort(gb), '|')), md5(array_to_string(list_sort(ga), '|')) FROM v) WHERE fa <> fb GROUP BY 1),
e AS (SELECT pa AS a, pb AS b FROM v UNION SELECT pb, pa FROM v),
reach(a, b) AS (SELECT DISTINCT paper_id, paper_id FROM papers WHERE paper_id IS NOT NULL UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
SELECT a AS paper_id, min(b) AS class_id, any_value(n_links) AS n_links FROM reach LEFT JOIN (SELECT paper_id, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_links FROM f LEFT JOIN d ON fa = fp GROUP BY 1) ON paper_id = a GROUP BY 1"""
SQL = {
    "p3_found": _VERSIONS,
    "p3_classes": _CLASSES.replace("any_value(n_links)", "coalesce(any_value(n_links), 0)"),
    "p1_found": f"WITH {_FORMS} SELECT first_seq, seq FROM (SELECT seq, min(seq) OVER (PARTITION BY key) AS first_seq FROM m) WHERE seq <> first_seq",
    "p1_collapsed": f"WITH {_FORMS} SELECT min(seq) AS first_seq, CAST(count(*) AS BIGINT) AS n_copies FROM m GROUP BY key",
    "p7_whole": """
SELECT 'chunk' AS kind, seq, content AS text, true AS "within" FROM chunks WHERE length(content) > 800
UNION ALL SELECT 'paper', seq, full_text, true FROM papers WHERE length(full_text) > 5000""",
    "p5_survivors": f"""WITH {_LONG}, today AS (SELECT max(extracted_at) AS today FROM entities WHERE entity_id IS NOT NULL),
d AS (SELECT cells.*, coalesce(trust, -1) AS t, coalesce(extracted_at, TIMESTAMP '0001-01-01') AS tm, date_diff('day', extracted_at::DATE, today::DATE) AS age FROM cells LEFT JOIN extractors USING (llm_model), today WHERE entity_id IS NOT NULL AND complete > 0 AND value IS NOT NULL),
v AS (SELECT entity_id, field_name, value, sum(CASE WHEN t > 0 AND age IS NOT NULL THEN t::HUGEINT * (round(pow(2, 40 - (age % 365) / 365.0))::BIGINT >> (age // 365)) ELSE 0 END) AS votes, max({{'c': complete, 't': t, 'm': tm, 's': -seq}}) AS rank FROM d GROUP BY ALL),
w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY entity_id, field_name ORDER BY votes DESC, rank DESC) = 1)
SELECT entity_id, max(CASE WHEN field_name = 'description' THEN value END) AS description, max(CASE WHEN field_name = 'properties' THEN value END) AS properties, max(CASE WHEN field_name = 'source_chunk_ids' THEN value END) AS source_chunk_ids
FROM (SELECT DISTINCT entity_id FROM entities WHERE entity_id IS NOT NULL) LEFT JOIN w USING (entity_id) GROUP BY 1""",
    "p7_found": """
SELECT 'chunk' AS kind, seq FROM chunks WHERE length(content) > 800
UNION ALL SELECT 'paper', seq FROM papers WHERE length(full_text) > 5000""",
    "p5_found": f"""
WITH e AS (SELECT *, count(*) OVER (PARTITION BY entity_id) AS n FROM entities WHERE entity_id IS NOT NULL),
long AS (
  SELECT entity_id, seq, llm_model, extracted_at, 'description' AS field_name,
         CASE WHEN {_VALUE.format("description")} THEN length(trim(regexp_replace(description, '\\s+', ' ', 'g'))) END AS complete FROM e WHERE n >= 2
  UNION ALL SELECT entity_id, seq, llm_model, extracted_at, 'properties',
         len(list_filter(map_values(properties), lambda x: x IS NOT NULL AND {_VALUE.format("x")})) FROM e WHERE n >= 2
  UNION ALL SELECT entity_id, seq, llm_model, extracted_at, 'source_chunk_ids',
         len(list_distinct(list_transform(list_filter(source_chunk_ids, lambda x: x IS NOT NULL AND {_VALUE.format("x")}), lambda x: trim(x)))) FROM e WHERE n >= 2),
r AS (SELECT entity_id, field_name, seq, row_number() OVER (PARTITION BY entity_id, field_name
        ORDER BY complete DESC, coalesce(trust, -1) DESC, coalesce(extracted_at, TIMESTAMP '0001-01-01') DESC, seq) AS k
      FROM long LEFT JOIN extractors USING (llm_model) WHERE complete > 0)
SELECT entity_id, field_name, seq FROM r WHERE k = 1""",
    "p6_found": """
WITH last AS (SELECT * FROM triples QUALIFY row_number() OVER (PARTITION BY triple_id ORDER BY seq DESC) = 1)
SELECT source_entity_id, triple_id, CAST(place AS INTEGER) AS place FROM (
  SELECT source_entity_id, triple_id, row_number() OVER (PARTITION BY source_entity_id ORDER BY confidence DESC, created_at DESC NULLS LAST, triple_id) AS place
  FROM last WHERE source_entity_id IS NOT NULL AND confidence IS NOT NULL AND NOT isnan(confidence)) WHERE place <= 5""",
}
