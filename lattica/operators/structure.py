"""Layout and structure of papers: reading order, sections, abstract, references, document text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.constants import ABSTRACT_CHARS, DOCUMENT_CHARS, FOOTER_RATIO, HEADER_RATIO, PARAGRAPH_CHARS, REFERENCES_PATTERN
from lattica.functions.text import is_heading, strip


def body_blocks(blocks: DataFrame) -> DataFrame:
    """Positioned blocks without page headers, footers, digits and scraps of under five characters."""
    text = strip(F.col("text"))
    kept = ~((F.col("y1") < F.col("page_height") * HEADER_RATIO) | (F.col("y0") > F.col("page_height") * FOOTER_RATIO))
    return blocks.where(kept & (F.length(text) >= 5) & ~text.rlike(r"^\d+$")).withColumn("text", text)


def reading_order(blocks: DataFrame) -> DataFrame:
    """`blocks` plus `ord`: within a page by position, by column rank at equal height where there are two columns.

    One window partition is one page, whose blocks a page's area bounds.
    """
    page = Window.partitionBy("paper_id", "page_num")
    centre = F.col("page_width") / 2
    side = F.when((F.col("x0") < centre) & (F.col("x1") < centre), 1).when(F.col("x0") >= centre, 2).otherwise(0)
    sided = blocks.withColumn("side", side)
    two = (F.count(F.when(F.col("side") == 1, 1)).over(page) >= 3) & (F.count(F.when(F.col("side") == 2, 1)).over(page) >= 3)
    keyed = sided.withColumn("two", two).withColumn("k", F.when(F.col("two"), F.col("side").cast("double")).otherwise(F.col("x0")))
    return keyed.withColumn("ord", F.row_number().over(page.orderBy("y0", "k", "block_no"))).drop("two", "k")


def full_text(ordered: DataFrame) -> DataFrame:
    """(paper_id, full_text): blocks by line, pages by blank line."""
    pages = ordered.groupBy("paper_id", "page_num").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("page"))
    return pages.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "page"))), lambda x: x["page"]), "\n\n").alias("full_text"))


def sections(papers: DataFrame, key: str = "seq", text: str = "full_text") -> DataFrame:
    """(key, pos, heading, content): lines run together under the heading above them; text before any heading is the abstract.

    The lines of a paper stay in one row: headings are found and lines are grouped by array functions, so
    there is no window over a long paper and nothing to sort.
    """
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), strip), lambda x: x != "")
    # Columns of their own, so that lines are split once and judged once.
    split = papers.where(F.col(text).isNotNull()).select(key, lines.alias("_lines"))
    places = F.filter(F.transform("_lines", lambda x, i: F.when(is_heading(x), i + 1)), lambda i: i.isNotNull())
    marked = split.select(key, "_lines", F.concat(F.array(F.lit(0)), places).alias("_at"))
    stop = lambda k: F.coalesce(F.try_element_at("_at", k + 2), F.size("_lines") + 1)
    parts = F.transform("_at", lambda s, k: F.struct(F.when(s == 0, "Abstract").otherwise(F.try_element_at("_lines", F.greatest(s, F.lit(1)))).alias("heading"), F.slice("_lines", s + 1, stop(k) - s - 1).alias("body")))
    out = marked.select(key, F.posexplode(F.filter(parts, lambda s: F.size(s["body"]) > 0)).alias("pos", "s"))
    return out.select(key, "pos", F.col("s.heading").alias("heading"), F.array_join("s.body", "\n").alias("content"))


def abstract(papers: DataFrame, parts: DataFrame, key: str = "seq", text: str = "full_text") -> DataFrame:
    """(key, abstract): the first section named so, else the first paragraph."""
    first = parts.where(F.lower("heading").startswith("abstract")).groupBy(key).agg(F.min_by("content", "pos").alias("section"))
    para = F.substring(F.split(F.coalesce(F.col(text), F.lit("")), "\n\n")[0], 1, PARAGRAPH_CHARS)
    return papers.join(first, key, "left").select(key, F.coalesce(F.substring("section", 1, ABSTRACT_CHARS), para).alias("abstract"))


def split_references(text: Column) -> tuple[Column, Column]:
    """(body, references): cut at the first line that only names the references; references are null without one."""
    at = F.regexp_instr(text, F.lit(REFERENCES_PATTERN))
    mark = F.regexp_extract(text, REFERENCES_PATTERN, 0)
    body = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    return body, F.when(at > 0, F.substring(text, at + F.length(mark), F.length(text)))


def title(own: Column, filename: Column) -> Column:
    """A document's own title, stripped, else its file's name without the ending."""
    return F.coalesce(F.nullif(strip(own), F.lit("")), F.regexp_replace(filename, r"\.[^.]*$", ""))


def scope(filenames: DataFrame) -> DataFrame:
    """(label, paper_id) to pick papers by, from files (filename, at): a label is a name's first characters, the earliest file of a label keeps it."""
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    named = filenames.select(F.substring(stem, 1, 50).alias("label"), paper_key(F.col("filename")).alias("paper_id"), "at")
    return named.groupBy("label").agg(F.min_by("paper_id", "at").alias("paper_id"))


def paper_key(filename: Column) -> Column:
    """A stable id from a file's name."""
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    return F.substring(F.replace(F.lower(stem), F.lit(" "), F.lit("_")), 1, 50)


def document_text(chunks: DataFrame) -> DataFrame:
    """(paper_id, text): chunks under their section headings in order of first appearance, cut for an extractor's window."""
    named = chunks.select("paper_id", "chunk_index", "content", F.coalesce(F.when(F.col("section_title") != "", F.col("section_title")), F.lit("正文")).alias("section"))
    part = named.groupBy("paper_id", "section").agg(F.min("chunk_index").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "\n").alias("body"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("at", "section", "body"))), lambda x: F.concat(F.lit("## "), x["section"], F.lit("\n"), x["body"]))
    return part.groupBy("paper_id").agg(F.substring(F.array_join(blocks, "\n\n"), 1, DOCUMENT_CHARS).alias("text"))
