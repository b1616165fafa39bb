"""Incremental processing: hash differences, upserts, statuses and deletions of chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.constants import LIST_PREVIEW_CHARS
from lattica.operators.graph import latest


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def diff(incoming: DataFrame, stored: DataFrame, keys: tuple[str, str] = ("paper_id", "chunk_hash")) -> tuple[DataFrame, DataFrame]:
    """(new, reused): incoming chunks whose hash their paper does not have yet, and the others, marked as done."""
    known = stored.select(*keys).distinct()
    return incoming.join(known, list(keys), "left_anti"), incoming.join(known, list(keys), "left_semi").withColumn("extraction_status", F.lit("success"))


def upsert(stored: DataFrame, incoming: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """The stored rows with the incoming ones written over them; replaying the same rows changes nothing."""
    return latest(stored.unionByName(incoming).where(F.col(key).isNotNull()), key, order=order)


def set_status(chunks: DataFrame, changes: DataFrame, key: str = "chunk_id") -> DataFrame:
    """`chunks` with the statuses of `changes` (key, status); rows without content keep theirs."""
    new = changes.select(key, F.col("status").alias("_new"))
    return chunks.join(new, key, "left").withColumn("extraction_status", F.when(F.col("content").isNotNull(), F.coalesce("_new", "extraction_status")).otherwise(F.col("extraction_status"))).drop("_new")


def retry(chunks: DataFrame, ids: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`chunks` after another try of those of `ids` (chunk_id): `work` takes their rows and returns the (chunk_id) that succeeded; the others have failed."""
    asked = chunks.where(F.col("content").isNotNull()).join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    good = work(asked).select("chunk_id").distinct().withColumn("ok", F.lit(True))
    changes = asked.select("chunk_id").distinct().join(good, "chunk_id", "left").select("chunk_id", F.when(F.col("ok"), "success").otherwise("failed").alias("status"))
    return set_status(chunks, changes)


def listing(chunks: DataFrame) -> DataFrame:
    """(paper_id, chunk_index, chunk_id, preview, extraction_status) with previews on one line."""
    preview = F.substring(F.translate("content", "\n\r", "  "), 1, LIST_PREVIEW_CHARS)
    return chunks.select("paper_id", "chunk_index", "chunk_id", preview.alias("preview"), "extraction_status")


def rollup(chunks: DataFrame, failed: int = 5) -> DataFrame:
    """(paper_id, success, failed, pending, first_failed) per paper."""
    s = F.col("extraction_status")
    first = F.array_join(F.slice(F.array_sort(F.collect_list(F.when(s == "failed", F.struct("chunk_index", "chunk_id")))), 1, failed)["chunk_id"], ",")
    return chunks.groupBy("paper_id").agg(F.count_if(s == "success").alias("success"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "pending").alias("pending"), first.alias("first_failed"))


def new_uploads(uploads: DataFrame, stored: DataFrame, content: str) -> DataFrame:
    """Uploads whose bytes no stored file has; of equal uploads the first by `seq`."""
    digest = F.md5(content)
    known = stored.select(digest.alias("digest")).distinct()
    fresh = uploads.withColumn("digest", digest).join(known, "digest", "left_anti")
    rest = [c for c in fresh.columns if c != "digest"]
    return fresh.groupBy("digest").agg(F.min_by(F.struct(*rest), "seq").alias("r")).select("digest", "r.*")
