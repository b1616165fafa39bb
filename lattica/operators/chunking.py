"""Fixed-size overlapping chunks, their hashes, pages and sections."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.constants import CHUNK_OVERLAP, CHUNK_SIZE


def windows(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Iterator[tuple[int, int]]:
    """(start, end) of the chunks of one text.

    A window ends at its last blank line if that lies in its second half; blank windows are passed over whole.
    """
    at, n = 0, len(text)
    while at < n:
        end = min(at + size, n)
        part = text[at:end]
        if part.strip():
            gap = part.rfind("\n\n") if end < n else -1
            if gap > size // 2:
                end = at + gap
            yield at, end
            if end >= n:
                return
            at = max(at + 1, end - overlap)
        else:
            at = end


def _cut(size: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, index, start, end, body = [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for i, (a, b) in enumerate(windows(text or "", size, overlap)):
                    rows.append(k)
                    index.append(i)
                    start.append(a)
                    end.append(b)
                    body.append(text[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(index, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(body, pa.string())], names=["key", "chunk_index", "char_start", "char_end", "content"])

    return run


def chunks(papers: DataFrame, key: str = "seq", text: str = "full_text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(key, chunk_index, char_start, char_end, content, chunk_hash) of every text.

    Texts without a blank line and without blank windows follow a formula and stay in the JVM; the others
    need the sequential rule and pass through Arrow. Both are one scan without a shuffle.
    """
    src = papers.where(F.length(text) > 0).select(F.col(key).alias("key"), F.col(text).alias("text"))
    plain = ~F.contains("text", F.lit("\n\n")) & ~F.col("text").rlike(r"(?U)[\s\x1c-\x1f]{" + str(min(size, 200)) + "}")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - size) / step)).cast("int")
    fast = src.where(plain).select("key", "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    start = F.col("chunk_index") * step
    fast = fast.select("key", "chunk_index", start.alias("char_start"), F.least(start + size, F.length("text")).alias("char_end"), F.substring("text", start + 1, F.lit(size)).alias("content"))
    kind = src.schema["key"].dataType.simpleString()
    slow = src.where(~plain).mapInArrow(_cut(size, overlap), f"key {kind}, chunk_index int, char_start int, char_end int, content string")
    return fast.unionByName(slow).withColumn("chunk_hash", F.sha2("content", 256)).withColumnRenamed("key", key)


def page_of(start: Column, length: Column, pages: Column) -> Column:
    """The page a character lies on, pages being equal parts of the text: the largest page that starts at or before it."""
    guess = F.floor(start * pages / length) + 1
    begins = lambda p: F.floor((p - 1) * (length / pages))
    fixed = F.when(begins(guess + 1) <= start, guess + 1).when(begins(guess) > start, guess - 1).otherwise(guess)
    return F.when((pages <= 1) | pages.isNull() | (length <= 0), F.lit(1)).otherwise(F.greatest(F.lit(1), F.least(fixed, pages))).cast("int")


def section_spans(sections: DataFrame, key: str = "seq") -> DataFrame:
    """(key, heading, low, high): the stretch of characters each section covers."""
    size = F.coalesce(F.length("content"), F.lit(0)) + F.coalesce(F.length("heading"), F.lit(0)) + 2
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return sections.select(key, "pos", "heading", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("low"), size.alias("size")).select(key, "heading", "low", (F.col("low") + F.col("size")).alias("high"))


def with_section(pieces: DataFrame, spans: DataFrame, key: str = "seq") -> DataFrame:
    """`pieces` plus section_title, the section their start lies in, empty beyond all. Spans are gathered per paper, which a paper's headings bound."""
    table = spans.groupBy(key).agg(F.collect_list(F.struct("low", "high", "heading")).alias("spans"))
    hit = F.filter("spans", lambda s: (s["low"] <= F.col("char_start")) & (F.col("char_start") < s["high"]))
    return pieces.join(table, key, "left").withColumn("section_title", F.coalesce(F.try_element_at(hit, F.lit(1))["heading"], F.lit(""))).drop("spans")
