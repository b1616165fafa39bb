"""Oversized items cut at natural boundaries, range by range.

A long text is never needed whole. It is read in ranges (stretches of a table's column, cut in one pass; byte ranges
of files), each with a halo on both sides. A worker finds the boundaries its range owns: section, paragraph and
sentence ends, word ends, and, so that a cut is always possible, a place in every stretch of
limit / 8 characters; of each kind it keeps the last of every such stretch. Every range but an item's first
also names its seam, the best boundary near its start, where a piece must end. Slim windows over the
ranges of an item stitch them: prefix sums of lengths place a range in its item, the next range's seam ends
its last piece, and the last heading before it is carried in. Each range then plans its own pieces, and
the pieces are emitted by offset from the range they begin in. No group larger than one range's table is ever
gathered; items of one range need no stitching and skip it.

Pieces hold at most `limit` characters (Unicode code points); a piece starts exactly `overlap` characters before
the end of the one before, and without these repeats the pieces spell the item. Cuts prefer sections, then
paragraphs, sentences, words, in the second half of the window, and take the last of the best kind.

Defined cases: null texts and texts within the limit give no pieces; an item longer by one character gives
two. Repeated keys must not occur (use a row's own key); rows with a null key are left out. The section title
of a piece is the last heading at or before its start without the repeat, else the item's own title, else null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.plans.tables import cut

#: Characters of a range, two pieces at least.
RANGE_CHARS = 1 << 14
RANGE_BYTES = 32 << 20
HALO = 256
SECTION, PARAGRAPH, SENTENCE, WORD, ANY = 4, 3, 2, 1, 0
HEADING = re.compile(r"(?:^|\n)[ \t]*((?:\d{1,2}(?:\.\d{1,2}){0,3}\.?|[IVX]{1,5}\.)[ \t]+[^\W\d_][^\n]{1,70}|Abstract|Introduction|Conclusions?|References|Bibliography|Acknowledge?ments?|Appendix[^\n]{0,40}|#{1,6} [^\n]{1,70}|摘要|引言|结论|参考文献)[ \t]*(?=\n|$)", re.I)
PARA = re.compile(r"\n[ \t\r]*\n\s*")
SENT = re.compile(r"[.!?][\"'”’)\]]*\s+|[。！？；][”’」）]*\s*")
SPACE = re.compile(r"\s+")

TABLE = "array<struct<off:int,kind:tinyint,at:int>>"
RANGES = f"many boolean, n int, seam int, heads array<struct<off:int,head:string>>, tab {TABLE}"
PIECES = "r int, i int, cut bigint, begin bigint, end bigint, last boolean, many boolean, head string"


def detect(text: str, lead: int, own: int, limit: int, first: bool) -> tuple[int | None, list, list]:
    """(seam, headings, table) of a range: `text` with `lead` characters of halo before the `own` ones it owns.

    Offsets count from the first owned character; a boundary is the place where the next piece may begin.
    """
    stretch = max(1, limit // 8)
    best: dict[tuple[int, int], int] = {}
    heads = []

    def add(place: int, kind: int) -> None:
        off = place - lead
        if 0 < off <= own:
            best[(off - 1) // stretch, kind] = off

    for m in HEADING.finditer(text):
        off = m.start(1) - lead
        if 0 <= off < own:
            heads.append((off, " ".join(m.group(1).split())))
        add(m.start(1), SECTION)
    for pattern, kind in ((PARA, PARAGRAPH), (SENT, SENTENCE), (SPACE, WORD)):
        for m in pattern.finditer(text):
            add(m.end(), kind)
    for b in range((own + stretch - 1) // stretch):
        best.setdefault((b, ANY), min(own, (b + 1) * stretch))
    table = sorted((off, kind) for (_, kind), off in best.items())
    seam = None
    if not first:
        near = [(kind, -off) for off, kind in table if off <= limit // 2] or [(ANY, -min(own, max(1, limit // 2)))]
        seam = -max(near)[1]
    return seam, heads, table


def plan(start: int, stop: int, lead_in: bool, table: list[tuple[int, int]], limit: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of the pieces between two fixed cuts; all but an item's first begin `overlap` before their cut."""
    cut, k = start, 0
    while cut < stop:
        begin = cut - overlap if lead_in else cut
        most = begin + limit
        if stop <= most:
            yield begin, stop
            return
        choice, least = None, max(cut + 1, begin + limit // 2)
        while k < len(table) and table[k][0] < least:
            k += 1
        j = k
        while j < len(table) and table[j][0] <= min(most, stop - 1):
            off, kind = table[j]
            if choice is None or (kind, off) > choice:
                choice = (kind, off)
            j += 1
        end = choice[1] if choice else most
        yield begin, end
        cut, lead_in = end, True


def _detect_rows(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"n": [], "seam": [], "heads": [], "tab": []}
            for r, lead, own, text in zip(*(batch.column(c).to_pylist() for c in ("r", "lead", "own", "part")), strict=True):
                seam, heads, table = detect(text, lead, own, limit, r == 0)
                out["n"].append(own)
                out["seam"].append(seam)
                out["heads"].append([{"off": o, "head": h} for o, h in heads])
                out["tab"].append([{"off": o, "kind": k, "at": o} for o, k in table])
            yield _batch(batch.select(["key", "r", "many"]), out)

    return run


_TAB = pa.list_(pa.struct([("off", pa.int32()), ("kind", pa.int8()), ("at", pa.int32())]))
_HEADS = pa.list_(pa.struct([("off", pa.int32()), ("head", pa.string())]))


def _batch(ids: pa.RecordBatch, out: dict) -> pa.RecordBatch:
    cols = [*ids.columns, pa.array(out["n"], pa.int32()), pa.array(out["seam"], pa.int32()), pa.array(out["heads"], _HEADS), pa.array(out["tab"], _TAB)]
    return pa.RecordBatch.from_arrays(cols, names=[*ids.schema.names, "n", "seam", "heads", "tab"])


def stitched(ranges: DataFrame) -> DataFrame:
    """Each range with its place in the item, the next range's seam, and the heading it begins under."""
    order = Window.partitionBy("key").orderBy("r")
    slim = ranges.select("key", "r", "n", "seam", F.element_at(F.col("heads.head"), -1).alias("last"), (F.size("heads") > 0).alias("any"))
    slim = slim.select(
        "key", "r",
        F.coalesce(F.sum(F.col("n").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.lead("seam").over(order).alias("next_seam"),
        F.last(F.when(F.col("any"), F.col("last")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("under"),
    )
    return ranges.select("key", "r", "n", "seam", "heads", "tab").join(slim, ["key", "r"])


def _plan_ranges(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out: dict[str, list] = {c: [] for c in ("src", "i", "cut", "begin", "end", "last", "head")}
            for k, x in enumerate(rows):
                start = x["seam"] if x["seam"] is not None else 0
                final = x["next_seam"] is None
                stop = x["n"] if final else x["n"] + x["next_seam"]
                table = [(t["off"], t["kind"]) for t in x["tab"]]
                cut, head, h, heads = start, x["under"], 0, x["heads"]
                for i, (begin, end) in enumerate(plan(start, stop, x["r"] > 0, table, limit, overlap)):
                    while h < len(heads) and heads[h]["off"] <= cut:
                        head, h = heads[h]["head"], h + 1
                    for c, v in zip(out, (k, i, x["base"] + cut, x["base"] + begin, x["base"] + end, final and end == stop, head), strict=True):
                        out[c].append(v)
                    cut = end
            if out["src"]:
                take = pa.array(out["src"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(take), batch.column("r").take(take), pa.array(out["i"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in ("cut", "begin", "end")), pa.array(out["last"], pa.bool_()), batch.column("many").take(take), pa.array(out["head"], pa.string())],
                    names=["key", "r", "i", "cut", "begin", "end", "last", "many", "head"],
                )

    return run


def planned(ranges: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(key, r, i, cut, begin, end, last, many, head): the pieces of all items as offsets in code points; ordered by (r, i) in an item.

    `ranges` is read more than once and should be written.
    """
    kind = ranges.schema["key"].dataType.simpleString()
    single = ranges.where("NOT many").select("*", F.lit(0).cast("long").alias("base"), F.lit(None).cast("int").alias("next_seam"), F.lit(None).cast("string").alias("under"))
    placed = single.unionByName(stitched(ranges.where("many")).withColumn("many", F.lit(True)))
    return placed.mapInArrow(_plan_ranges(limit, overlap), f"key {kind}, {PIECES}")


def _check(limit: int, overlap: int) -> None:
    if not 0 <= overlap < limit // 4:
        raise ValueError("overlap must be under a quarter of the limit")


def _size(limit: int) -> int:
    return max(RANGE_CHARS, 2 * limit)


def ranged(rows: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """(key, r, many, lead, own, part): the text of (key, text) in stretches of `size` characters with halos, cut in one pass."""
    parts = rows.select("key", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("_p"))
    left = lambda i: F.coalesce(F.right(F.get("_p", i - 1), F.lit(before)), F.lit(""))
    right = lambda i: F.coalesce(F.left(F.get("_p", i + 1), F.lit(after)), F.lit(""))
    each = F.transform("_p", lambda x, i: F.struct(i.alias("r"), F.length(left(i)).alias("lead"), F.length(x).alias("own"), F.concat(left(i), x, right(i)).alias("part")))
    return parts.select("key", (F.size("_p") > 1).alias("many"), F.explode(each).alias("x")).select("key", "x.r", "many", "x.lead", "x.own", "x.part")


def _long(df: DataFrame, key: Column, text: str, limit: int, *more: Column) -> DataFrame:
    return df.select(key.alias("key"), F.col(text).alias("text"), *more).where((F.length("text") > limit) & F.col("key").isNotNull())


def offsets(df: DataFrame, key: Column, text: str, limit: int, overlap: int) -> DataFrame:
    """The planned pieces of the rows of a table whose text exceeds the limit."""
    _check(limit, overlap)
    parts = ranged(_long(df, key, text, limit), _size(limit), HALO, HALO)
    kind = parts.schema["key"].dataType.simpleString()
    return planned(cut(parts.mapInArrow(_detect_rows(limit), f"key {kind}, r int, {RANGES}"), "ranges"), limit, overlap)


def oversized(pieces: DataFrame) -> DataFrame:
    """(key): the items that had to be cut, which are those whose first piece is not their last."""
    return pieces.where("begin = 0 AND NOT last").select("key")


def numbered(pieces: DataFrame) -> DataFrame:
    """`pieces` plus `piece`, counted from 0 in each item; only items of several ranges need a slim window over these."""
    single = pieces.where("NOT many").withColumn("piece", F.col("i"))
    counts = pieces.where("many").groupBy("key", "r").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("key").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("key", "r", F.coalesce(F.sum("n").over(order), F.lit(0)).cast("int").alias("before"))
    more = pieces.where("many").join(before, ["key", "r"]).withColumn("piece", F.col("before") + F.col("i")).drop("before")
    return single.unionByName(more)


def split_rows(df: DataFrame, key: Column, text: str, limit: int, overlap: int, title: Column | None = None) -> DataFrame:
    """(key, piece, start, content, section_title): the pieces of oversized rows, numbered from 0.

    A piece is cut from the range it begins in, whose halos hold the overlap before and what it takes from the next range.
    """
    at = numbered(cut(offsets(df, key, text, limit, overlap), "pieces"))
    size = _size(limit)
    parts = ranged(_long(df, key, text, limit), size, overlap, limit)
    lists = at.groupBy("key", "r").agg(F.collect_list(F.struct("piece", "begin", "end", "head")).alias("pieces"))
    out = parts.join(lists, ["key", "r"]).select("key", "r", "lead", "part", F.explode("pieces").alias("p"))
    first = (F.col("p.begin") - F.col("r").cast("long") * size + F.col("lead") + 1).cast("int")
    own = (title if title is not None else F.lit(None).cast("string")).alias("own")
    pieces = out.select("key", F.col("p.piece").alias("piece"), F.col("p.begin").alias("start"), F.substring("part", first, (F.col("p.end") - F.col("p.begin")).cast("int")).alias("content"), F.col("p.head").alias("head"))
    if title is None:
        return pieces.withColumnRenamed("head", "section_title")
    titles = _long(df, key, text, limit, own).where(F.trim("own") != "").select("key", "own")
    return pieces.join(titles, "key", "left").select("key", "piece", "start", "content", F.coalesce("own", "head").alias("section_title"))


def joined(pieces: DataFrame, overlap: int) -> DataFrame:
    """(key, text): the items the pieces of split_rows spell."""
    inner = F.transform(F.array_sort(F.collect_list(F.struct("piece", "content"))), lambda p: F.when(p["piece"] == 0, p["content"]).otherwise(F.substring(p["content"], F.lit(overlap + 1), F.length(p["content"]))))
    return pieces.groupBy("key").agg(F.array_join(inner, "").alias("text"))


# Files: the same over byte ranges.


def _open(path: str):
    from pyarrow import fs

    if ":" not in path.split("/")[0]:
        return fs.LocalFileSystem().open_input_file(path)
    system, inner = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return system.open_input_file(inner)


def _aligned(data: bytes, at: int) -> int:
    """The first place from `at` on that begins a UTF-8 character."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _detect_files(limit: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"n": [], "seam": [], "heads": [], "tab": []}
            for path, r, total in zip(*(batch.column(c).to_pylist() for c in ("key", "r", "total")), strict=True):
                first, last = r * size, min(total, (r + 1) * size)
                low, high = max(0, first - 4 * HALO), min(total, last + 4 * HALO)
                with _open(path) as f:
                    f.seek(low)
                    data = f.read(high - low)
                a, b = _aligned(data, first - low), _aligned(data, last - low)
                before = data[_aligned(data, 0) : a].decode("utf-8", "replace")
                mine = data[a:b].decode("utf-8", "replace")
                after = data[b:].decode("utf-8", "ignore")
                seam, heads, table = detect(before + mine + after, len(before), len(mine), limit, r == 0)
                # Bytes from the range's first to each boundary, by one running encode.
                done, at, marks = 0, 0, []
                for off, kind in table:
                    at += len(mine[done:off].encode("utf-8"))
                    done = off
                    marks.append({"off": off, "kind": kind, "at": at})
                out["n"].append(len(mine))
                out["seam"].append(seam)
                out["heads"].append([{"off": o, "head": h} for o, h in heads])
                out["tab"].append(marks)
            yield _batch(batch.select(["key", "r", "many"]), out)

    return run


def _emit_files(size: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = []
            for path, low, high, first in zip(*(batch.column(c).to_pylist() for c in ("key", "low", "high", "first")), strict=True):
                reach = 0 if first else 4 * overlap
                with _open(path) as f:
                    f.seek(max(0, low - reach))
                    data = f.read(high - max(0, low - reach))
                at = low - max(0, low - reach)
                before = data[_aligned(data, 0) : at].decode("utf-8", "replace")
                text.append((before[-overlap:] if overlap and not first else "") + data[at:].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "r", "i", "begin", "head")), pa.array(text, pa.string())], names=["key", "r", "i", "start", "section_title", "content"])

    return run


def split_files(spark: SparkSession, paths: str | list[str], limit: int, overlap: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(key, r, i, start, section_title, content): the pieces of UTF-8 files over the limit, key being the path.

    A file is read by byte ranges twice: once for boundaries, once by the bytes of each piece. Pieces are in
    order of (r, i). Files within the limit give no pieces.
    """
    _check(limit, overlap)
    files = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("key"), F.col("length").alias("total")).where(F.col("total") > limit)
    each = files.select("key", "total", (F.col("total") > range_bytes).alias("many"), F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / range_bytes).cast("int"))).alias("r"))
    ranges = each.repartition("key", "r").mapInArrow(_detect_files(limit, range_bytes), f"key string, r int, {RANGES}")
    ranges = cut(ranges, "ranges")
    at = planned(ranges, limit, overlap)
    # A range's own bytes begin at the first character from r * range_bytes on: shift by what the one before spills over.
    sizes = ranges.select("key", "r", F.explode("tab").alias("t")).select("key", "r", F.col("t.off").alias("off"), F.col("t.at").alias("at"))
    ends = sizes.groupBy("key", "r").agg(F.max("at").alias("bytes"))
    order = Window.partitionBy("key").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    base = ends.select("key", "r", F.coalesce(F.sum(F.col("bytes").cast("long")).over(order), F.lit(0)).alias("base_bytes"))
    chars = stitched(ranges).select("key", "r", "base")
    places = sizes.join(chars, ["key", "r"]).join(base, ["key", "r"]).select("key", (F.col("base") + F.col("off")).alias("place"), (F.col("base_bytes") + F.col("at")).alias("byte")).unionByName(files.select("key", F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("byte"))).distinct()
    low = places.select("key", F.col("place").alias("cut"), F.col("byte").alias("low"))
    high = places.select("key", F.col("place").alias("end"), F.col("byte").alias("high"))
    todo = at.join(low, ["key", "cut"]).join(high, ["key", "end"]).withColumn("first", F.col("cut") == 0)
    counts = at.groupBy("key").agg((F.count(F.lit(1)) > 1).alias("many")).where("many")
    out = todo.join(counts, "key", "left_semi").mapInArrow(_emit_files(range_bytes, overlap), "key string, r int, i int, start bigint, section_title string, content string")
    return out
