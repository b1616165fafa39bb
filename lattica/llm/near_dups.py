"""Near duplicates by banded min-hash candidates and sequential Bayesian verification.

1. Every text becomes its set of word 4-sequences (character 8-sequences where Han characters
   dominate), hashed to 64 bits; one pass yields its fingerprint, its band keys and a short
   verification signature from hash functions the bands do not use.
2. Texts with equal sets are one class (`fp`); only class representatives go on, so a group of exact
   copies costs one row whatever its size.
3. Representatives that agree in all rows of a band are candidates (equi-join on the band key; AQE
   splits a skewed key; each pair counts once).
4. Candidates are compared in batches of signature positions. With a uniform prior, m matches in n
   positions leave a Beta(m+1, n-m+1) posterior of the similarity; a pair is pruned as soon as the
   posterior probability of exceeding the threshold falls below the chosen miss probability.
5. Survivors are verified exactly on their full sets.

With 128 bands of 4 rows a pair of similarity 0.5 is a candidate with probability 0.9997, one of 0.6 with
1 - 2e-8; the prune loses at most `miss` of the pairs above the threshold in each batch.

Defined cases: null and empty texts, and texts too short for one sequence, have no partner. Repeated rows are
copies of one class. Pairs at exactly the threshold are not pairs. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.tables import cut

WORD = re.compile(r"\w+")
HAN = re.compile(r"[㐀-鿿]")
JOINER = re.compile(r"[\W_]+")
BANDS, ROWS, CHECKS, BATCH = 128, 4, 128, 32
_KEEP = 200_000


class Sequences:
    """Hashed distinct sequences of a text; words are hashed once and remembered up to a bound."""

    def __init__(self, words: int = 4, chars: int = 8):
        self.words, self.chars, self.seen = words, chars, {}
        mix = np.random.default_rng(7)
        self.factors = mix.integers(1, 2**63, max(words, chars), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _codes(self, parts) -> np.ndarray:
        seen = self.seen
        if len(seen) > _KEEP:
            seen.clear()
        out = []
        for p in parts:
            h = seen.get(p)
            if h is None:
                h = seen[p] = int.from_bytes(hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            out.append(h)
        return np.array(out, dtype=np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint64)
        text = text.lower()
        k, parts = self.words, None
        if not text.isascii() and HAN.search(text):
            bare = JOINER.sub("", text)
            if len(HAN.findall(bare)) > 0.3 * len(bare):
                k, parts = self.chars, bare
        codes = self._codes(WORD.findall(text) if parts is None else parts)
        if len(codes) < k:
            return np.empty(0, np.uint64)
        n = len(codes) - k + 1
        mixed = np.zeros(n, np.uint64)
        for i in range(k):
            mixed ^= (codes[i : i + n] + np.uint64(i)) * self.factors[i]
            mixed = (mixed << np.uint64(23)) | (mixed >> np.uint64(41))
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        return np.unique(mixed ^ (mixed >> np.uint64(29)))


class Signer:
    """Band keys and verification signature of a set of hashed sequences."""

    def __init__(self, seed: int = 1):
        mix = np.random.default_rng(seed)
        n = BANDS * ROWS + CHECKS
        self.a = (mix.integers(0, 2**31, (n, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
        self.b = mix.integers(0, 2**32, (n, 1), dtype=np.uint32)
        self.f = mix.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = mix.integers(1, 2**63, BANDS, dtype=np.uint64)

    def __call__(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (items >> np.uint64(32)).astype(np.uint32)
        low = None
        for at in range(0, len(x), 256):  # blocks stay in cache
            part = (self.a * x[at : at + 256] + self.b).min(axis=1)
            low = part if low is None else np.minimum(low, part)
        key = low[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
        keys = self.salt.copy()
        for i in range(ROWS):
            keys = (keys ^ key[:, i]) * self.f[i]
            keys ^= keys >> np.uint64(31)
        return keys.view(np.int64), low[BANDS * ROWS :]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets, sign = Sequences(), Signer()
    for batch in batches:
        ids, fps, keys, sigs = [], [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            items = sets(text.as_py())
            if len(items):
                k, s = sign(items)
                ids.append(i)
                fps.append(hashlib.md5(items.tobytes()).digest())
                keys.append(k)
                sigs.append(s.tobytes())
        if ids:
            flat = pa.array(np.concatenate(keys))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(fps, pa.binary()), lists, pa.array(sigs, pa.binary())], names=["id", "fp", "keys", "sig"])


def least_matches(threshold: float, miss: float) -> dict[int, int]:
    """For each batch end n: the fewest matches with which P(similarity > threshold) is still `miss` or more."""
    out = {}
    for n in range(BATCH, CHECKS + 1, BATCH):
        # P(J > t) with a Beta(m+1, n-m+1) posterior is the binomial tail P(X <= m), X ~ B(n+1, t).
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def _verify(threshold: float, miss: float):
    least = least_matches(threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, CHECKS) for c in ("sig_a", "sig_b"))
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int32)
            for n, need in least.items():
                part = slice(n - BATCH, n)
                matches[alive] += (x[alive, part] == y[alive, part]).sum(axis=1, dtype=np.int32)
                alive = alive[matches[alive] >= need]
            yield batch.take(pa.array(alive)).select(["fp_a", "fp_b"])

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets, last = Sequences(), {}

    def items(fp: bytes, text: str) -> np.ndarray:
        if fp not in last:
            if len(last) > 64:
                last.clear()
            last[fp] = sets(text)
        return last[fp]

    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        score = []
        for fp_a, fp_b, text_a, text_b in zip(*cols, strict=True):
            x, y = items(fp_a, text_a), items(fp_b, text_b)
            both = len(np.intersect1d(x, y, assume_unique=True))
            score.append(both / (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["fp_a", "fp_b", "similarity"])


def signed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, fp, keys, sig): one row per row of `df` whose text has a sequence; written once to the shared folder."""
    src = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return cut(src.mapInArrow(_sign, f"id {kind}, fp binary, keys array<bigint>, sig binary"), "signed")


def candidates(rows: DataFrame) -> DataFrame:
    """(fp_a, fp_b): pairs of classes that share a band, fp_a < fp_b, each once."""
    reps = rows.groupBy("fp").agg(F.first("keys").alias("keys"))
    bands = reps.select("fp", F.explode("keys").alias("band"))
    pairs = bands.alias("a").join(bands.alias("b"), "band").where("a.fp < b.fp")
    return pairs.select(F.col("a.fp").alias("fp_a"), F.col("b.fp").alias("fp_b")).distinct()


def links(df: DataFrame, key: str, text: str, rows: DataFrame, threshold: float, miss: float = 1e-5) -> DataFrame:
    """(fp_a, fp_b, similarity): pairs of classes with a similarity above the threshold."""
    sigs = rows.groupBy("fp").agg(F.first("sig").alias("sig"))
    pairs = candidates(rows).join(sigs.select(F.col("fp").alias("fp_a"), F.col("sig").alias("sig_a")), "fp_a").join(sigs.select(F.col("fp").alias("fp_b"), F.col("sig").alias("sig_b")), "fp_b")
    alive = cut(pairs.select("fp_a", "fp_b", "sig_a", "sig_b").mapInArrow(_verify(threshold, miss), "fp_a binary, fp_b binary"), "alive")
    # Whole texts of the classes still in question, one row of the table each.
    asked = alive.select(F.explode(F.array("fp_a", "fp_b")).alias("fp")).distinct()
    one = rows.join(asked, "fp", "left_semi").groupBy("fp").agg(F.min("id").alias("id"))
    texts = df.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text")).join(one, "id")
    a, b = texts.select(F.col("fp").alias("fp_a"), F.col("text").alias("text_a")), texts.select(F.col("fp").alias("fp_b"), F.col("text").alias("text_b"))
    scored = alive.join(a, "fp_a").join(b, "fp_b").select("fp_a", "fp_b", "text_a", "text_b").mapInArrow(_exact, "fp_a binary, fp_b binary, similarity double")
    return scored.where(F.col("similarity") > threshold)


def pairs(df: DataFrame, key: str, order: str, text: str, threshold: float, miss: float = 1e-5) -> DataFrame:
    """(id_a, id_b): pairs of different keys whose texts exceed the threshold, exact copies included.

    `order` identifies a row, as a key may arrive with several texts.
    """
    src = df.select(order, key, text)
    rows = signed(src, order, text)
    found = links(src, order, text, rows, threshold, miss)
    names = src.select(F.col(order).alias("id"), F.col(key).alias("name"))
    members = cut(rows.select("id", "fp").join(names, "id").where(F.col("name").isNotNull()).select("fp", "name").distinct(), "members")
    a, b = members.select(F.col("fp").alias("fp_a"), F.col("name").alias("x")), members.select(F.col("fp").alias("fp_b"), F.col("name").alias("y"))
    across = found.select("fp_a", "fp_b").join(a, "fp_a").join(b, "fp_b").select("x", "y")
    within = a.join(b.withColumnRenamed("fp_b", "fp_a"), "fp_a").select("x", "y").where("x < y")
    return across.unionByName(within).where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def classes(df: DataFrame, key: str, order: str, text: str, threshold: float, miss: float = 1e-5) -> DataFrame:
    """(id, class_id, n_links): each key with the smallest key it is linked to over any number of links."""
    from lattica.plans.components import components

    src = df.select(order, key, text)
    rows = signed(src, order, text)
    found = cut(links(src, order, text, rows, threshold, miss).select("fp_a", "fp_b"), "links")
    names = src.select(F.col(order).alias("id"), F.col(key).alias("name")).where(F.col(key).isNotNull())
    members = cut(rows.select("id", "fp").join(names, "id").select("fp", "name").distinct(), "members")
    # A key with several texts ties its classes together; the smallest key names a class.
    label = members.groupBy("fp").agg(F.min("name").alias("low"))
    ties = members.join(label, "fp").select(F.col("name").alias("a"), F.col("low").alias("b"))
    steps = found.join(label.select(F.col("fp").alias("fp_a"), F.col("low").alias("a")), "fp_a").join(label.select(F.col("fp").alias("fp_b"), F.col("low").alias("b")), "fp_b").select("a", "b")
    label_of = components(ties.unionByName(steps))
    degree = found.select(F.explode(F.array("fp_a", "fp_b")).alias("fp")).groupBy("fp").count()
    counts = members.join(degree, "fp", "left").groupBy("name").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_links"))
    everyone = names.select("name").distinct()
    return everyone.join(label_of.withColumnRenamed("node", "name"), "name", "left").join(counts, "name", "left").select(F.col("name").alias("id"), F.coalesce("component", "name").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
