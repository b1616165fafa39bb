"""Held-out texts leaking into training text: BM25 index of the items, block-max WAND, alignment.

The items (a fixed, small table, cut into shards of bounded size) become an inverted index of word
3-sequences with BM25 weights, normalised by each item's own total, so that a score is the weighted share
of an item that a query repeats; each term keeps its largest weight per block of items. Every document
queries the index with all the sequences it holds, wherever they stand, by block-max WAND for all items above the
threshold. Retrieved items are aligned with the whole document: hits that advance
together in both texts form passages, short gaps (altered or inserted words) included; an item has
leaked if passages of enough words cover at least half of its words.

The index of a shard is built once and broadcast; several shards take one pass over the documents each, whose
result is written before the next shard is built, so that the driver and the executors hold one shard at a time.

Words are letters and digits in one case, Han characters one by one; case, punctuation, markup and line
breaks do not matter.

Defined cases: null, empty and blank texts carry nothing; items of fewer than three words are never found;
equal items are each reported; repeated documents are each reported. Documents of any length are read whole, and
each sequence is counted once. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.tables import cut

WORD = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")
GRAM = 3
#: Items and characters of one index; more make more shards and as many passes over the corpus.
SHARD_ITEMS, SHARD_CHARS = 50_000, 32 << 20
BLOCK = 8
K1, B = 1.2, 0.75
#: Weighted share of an item that a document must repeat to be aligned with it.
RETRIEVE = 0.2
#: A passage may skip this many words in either text, and counts from this many words on.
GAP, LEAST_WORDS = 5, 8
SHARE = 0.5


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Index:
    """Posting lists of the items' sequences: item numbers ascending and weights, and of each term the largest weight in each block of item numbers."""

    def __init__(self, items: list[tuple]):
        self.ids, self.tokens = [], []
        for i, text in items:
            tokens = words(text or "")
            if len(tokens) >= GRAM:
                self.ids.append(i)
                self.tokens.append(tokens)
        self.codes = {w: k + 1 for k, w in enumerate(sorted({w for t in self.tokens for w in t}))}
        numbers = [np.array([self.codes[w] for w in t], np.int64) for t in self.tokens]
        self.pairs = np.unique(np.concatenate([(x[:-1] << 32) | x[1:] for x in numbers])) if numbers else np.empty(0, np.int64)
        packed = [self.grams(x).tolist() for x in numbers]
        grams = [Counter(x) for x in packed]
        df = Counter(g for c in grams for g in c)
        n, mean = len(grams), sum(sum(c.values()) for c in grams) / max(1, len(grams))
        self.terms = np.array(sorted(df), np.int64)
        number = {int(g): k for k, g in enumerate(self.terms)}
        lists: list[list[tuple[int, float]]] = [[] for _ in number]
        for i, c in enumerate(grams):
            size = sum(c.values())
            w = {g: math.log(1 + (n - df[g] + 0.5) / (df[g] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean)) for g, f in c.items()}
            total = sum(w.values())
            for g, x in w.items():
                lists[number[g]].append((i, x / total))
        self.docs = [[i for i, _ in p] for p in lists]
        self.weights = [[x for _, x in p] for p in lists]
        # Of each term, the blocks of item numbers it occurs in and its largest weight there.
        flat: list[tuple[int, float]] = []
        sizes = []
        for d, w in zip(self.docs, self.weights, strict=True):
            best: dict[int, float] = {}
            for i, x in zip(d, w, strict=True):
                best[i // BLOCK] = max(best.get(i // BLOCK, 0.0), x)
            flat += best.items()
            sizes.append(len(best))
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.block_of = np.array([b for b, _ in flat], np.int64)
        self.block_max = np.array([x for _, x in flat])
        self.most = np.array([max(w) for w in self.weights])
        self.places = [dict() for _ in self.tokens]
        for i, own in enumerate(packed):
            for p, g in enumerate(own):
                self.places[i].setdefault(number[g], []).append(p)
        self.own = [np.array(sorted(x), np.int64) for x in self.places]
        self.sizes_of = [len(t) for t in self.tokens]
        del self.tokens

    @classmethod
    def of(cls, parts: dict) -> Index:
        """An index from what vars() gave of another."""
        out = object.__new__(cls)
        out.__dict__.update(parts)
        return out

    def grams(self, codes: np.ndarray) -> np.ndarray:
        """3-sequences as (number of the first two words' pair, third word); those with a word or a pair no item has are negative."""
        out = np.full(max(0, len(codes) - GRAM + 1), -1, np.int64)
        if not len(out) or not len(self.pairs):
            return out
        known = codes > 0
        at = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
        pair = (codes[at] << 32) | codes[at + 1]
        slot = np.searchsorted(self.pairs, pair)
        slot[slot == len(self.pairs)] = 0
        hit = self.pairs[slot] == pair
        out[at[hit]] = (slot[hit] << 32) | codes[at[hit] + 2]
        return out

    def hits(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(positions, term numbers) of the sequences of a text that the index has."""
        tokens = words(text)
        grams = self.grams(np.fromiter(map(self.codes.get, tokens, iter(lambda: 0, 1)), np.int64, len(tokens)))
        if not len(self.terms) or not len(grams):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.searchsorted(self.terms, grams)
        at[at == len(self.terms)] = 0
        found = np.flatnonzero(self.terms[at] == grams)
        return found, at[found]

    def wand(self, terms: np.ndarray, least: float) -> list[tuple[int, float]]:
        """All (item, score) with a score of `least` or more, by block-max WAND over blocks of item numbers.

        The terms' block maxima, summed per block, bound every item in it; only live blocks, whose bound
        reaches `least`, are entered, and inside one the cursors move by pivots over its block maxima.
        """
        starts, sizes = self.starts[terms], self.sizes[terms]
        each = np.repeat(np.arange(len(terms)), sizes)
        slot = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[each]
        block, most = self.block_of[slot], self.block_max[slot]
        live = np.flatnonzero(np.bincount(block, most) >= least)
        out = []
        for b in live.tolist():
            inside = np.flatnonzero(block == b)
            first, end = b * BLOCK, (b + 1) * BLOCK
            cursors = []  # [item, place in the list, term, block maximum]
            for j in inside.tolist():
                t = int(terms[each[j]])
                k = bisect_left(self.docs[t], first)
                cursors.append([self.docs[t][k], k, t, float(most[j])])
            while cursors:
                cursors.sort()
                bound, pivot = 0.0, -1
                for k, c in enumerate(cursors):
                    bound += c[3]
                    if bound >= least:
                        pivot = k
                        break
                if pivot < 0:
                    break
                target = cursors[pivot][0]
                if cursors[0][0] == target:
                    score = 0.0
                    for c in cursors:
                        if c[0] != target:
                            break
                        score += self.weights[c[2]][c[1]]
                    if score >= least:
                        out.append((target, score))
                    to = target + 1
                else:
                    to = target
                for c in cursors:
                    if c[0] >= to:
                        break
                    d = self.docs[c[2]]
                    c[1] = k = bisect_left(d, to, c[1])
                    c[0] = d[k] if k < len(d) else end
                cursors = [c for c in cursors if c[0] < end]
        return out

    def retrieve(self, terms: np.ndarray) -> list[int]:
        """Items of which a text with these sequences repeats RETRIEVE or more, wherever they stand in it."""
        unique = np.unique(terms)
        if self.most[unique].sum() < RETRIEVE:
            return []
        return [i for i, _ in self.wand(unique, RETRIEVE)]

    def covered(self, item: int, at: np.ndarray, terms: np.ndarray) -> float:
        """The share of the item's words in passages of the text."""
        places, n = self.places[item], self.sizes_of[item]
        mine = np.isin(terms, self.own[item])
        at, terms = at[mine].tolist(), terms[mine].tolist()
        least = min(LEAST_WORDS, math.ceil(n * SHARE))
        live: list[list] = []  # [last text place, last item place, item words]
        mark = bytearray(n)

        def close(chain) -> None:
            if len(chain[2]) >= least:
                for p in chain[2]:
                    mark[p] = 1

        for d, t in zip(at, terms, strict=True):
            where = places[t]
            keep = []
            for c in live:
                (keep.append if d - c[0] <= GAP + GRAM else close)(c)
            live, grown = keep, []
            for p in where:
                best = None
                for c in live:
                    if 0 < p - c[1] <= GAP + GRAM and d > c[0] and (best is None or (p - c[1]) + (d - c[0]) < (p - best[1]) + (d - best[0])):
                        best = c
                if best is None:
                    grown.append([d, p, set(range(p, p + GRAM))])
                else:
                    best[0], best[1] = d, p
                    best[2].update(range(p, p + GRAM))
            live += grown
        for c in live:
            close(c)
        return sum(mark) / n


def _find(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            index = index or Index.of(shipped.value)
            docs, items, shares = [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, terms = index.hits(text)
                if not len(at):
                    continue
                for i in index.retrieve(terms):
                    share = index.covered(i, at, terms)
                    if share >= SHARE:
                        docs.append(d)
                        items.append(index.ids[i])
                        shares.append(share)
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field(0).type), pa.array(items, pa.int64()), pa.array(shares)], names=["doc", "item", "share"])

    return run


def leaks(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(doc, item, share): items at least half of whose words stand as passages in a document. No shuffle."""
    spark = df.sparkSession
    src = df.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("text"))
    kind = src.schema["doc"].dataType.simpleString()
    fixed = items.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    size = fixed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("chars")).first()
    shards = max(1, math.ceil(size.n / SHARD_ITEMS), math.ceil(size.chars / SHARD_CHARS))
    out = None
    for s in range(shards):
        part = fixed.where(F.pmod(F.xxhash64("i"), F.lit(shards)) == s) if shards > 1 else fixed
        shipped = spark.sparkContext.broadcast(vars(Index([(r.i, r.t) for r in part.collect()])))
        found = src.mapInArrow(_find(shipped), f"doc {kind}, item bigint, share double")
        if shards > 1:
            found = cut(found, "leaks")
            shipped.destroy()
        out = found if out is None else out.unionByName(found)
    return out
