"""Scans of document files through a pluggable page parser."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lattica.operators.structure import title
from lattica.sources import pdf

BLOCKS = "path string, page_num int, page_width double, page_height double, block_no int, x0 double, y0 double, x1 double, y1 double, text string"


class PageParser(Protocol):
    """From a file's bytes to (page_num, page_width, page_height, block_no, x0, y0, x1, y1, text); must be picklable."""

    def __call__(self, content: bytes) -> Iterator[tuple]: ...


def plain_text(content: bytes) -> Iterator[tuple]:
    """Parser of plain text: pages at form feeds, one block a paragraph, placed down the page."""
    for n, page in enumerate(content.decode("utf-8", "replace").split("\f"), 1):
        for k, block in enumerate(b for b in page.split("\n\n") if b.strip()):
            yield n, 600.0, 800.0, k, 50.0, 110.0 + 12 * k, 550.0, 120.0 + 12 * k, block


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, length, modificationTime, digest) of a file or of a directory's files of that name; only the digest reads content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime", F.md5("content").alias("digest"))


def parser_of(pattern: str) -> PageParser:
    """The parser a file name pattern asks for."""
    return pdf.parse if pattern.lower().endswith(".pdf") else plain_text


def titles(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, title): the title a file's own data give it, else its name without the ending."""

    @F.pandas_udf(StringType())
    def own(contents: pd.Series) -> pd.Series:
        def one(c):
            try:
                return pdf.title_of(c)
            except Exception:  # noqa: BLE001 - one bad file must not stop the scan
                return None

        return contents.map(one)

    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return raw.select("path", title(own("content") if pattern.lower().endswith(".pdf") else F.lit(None).cast("string"), F.element_at(F.split("path", "/"), -1)).alias("title"))


def blocks(spark: SparkSession, path: str, pattern: str = "*.pdf", parser: PageParser | None = None) -> DataFrame:
    """Positioned blocks of every file; a file the parser fails on gives one block with its error and page 0."""
    parser = parser or parser_of(pattern)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        for f in frames:
            rows = []
            for p, c in zip(f["path"], f["content"], strict=True):
                try:
                    rows += [(p, *b) for b in parser(c)]
                except Exception as e:  # noqa: BLE001 - one bad file must not stop the scan
                    rows.append((p, 0, 0.0, 0.0, 0, 0.0, 0.0, 0.0, 0.0, f"error: {e}"))
            yield pd.DataFrame(rows, columns=names)

    return raw.mapInPandas(run, BLOCKS)
