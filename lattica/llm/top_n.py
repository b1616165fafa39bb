"""Top N in every group by partition lower bounds.

The N-th best row among any N or more rows of a group is a lower bound of the group's N-th best row: rows
strictly below it cannot be among the first N. Each partition keeps the N best keys of every group it has seen,
over all its batches, and reports the N-th as its bound at the end; the largest bound per group is joined back, rows
below it are dropped, and only the survivors are shuffled and ranked. A group with a third of all rows
thus sends about N rows per partition to its ranking task, never the group.

A key is the score and the descending number or time columns that follow it among the ties, so that a coarse score with
many equal rows prunes as well as a fine one. A partition's state is at most N keys per group in it, less than the
partition itself.

Defined cases: rows with a null group, or a null or NaN score, are left out. Ties of the key survive the
bound and are ordered by the remaining tie columns; nulls come last. Groups with fewer than N rows are kept whole. n must be 1 or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Types whose descending order a key can hold as a whole number.
WHOLE = ("tinyint", "smallint", "int", "bigint", "date", "timestamp", "timestamp_ntz")


def _best(group: pa.Array, keys: list[np.ndarray], n: int) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
    """The n best rows of each group, sorted by group and key, and which of them is its group's n-th."""
    index = group.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    by = np.lexsort([*(-k for k in reversed(keys)), index])
    index = index[by]
    starts = np.flatnonzero(np.r_[True, index[1:] != index[:-1]]) if len(index) else np.array([], int)
    place = np.arange(len(index)) - np.repeat(starts, np.diff(np.r_[starts, len(index)]))
    kept = by[place < n]
    return group.take(pa.array(kept)), [k[kept] for k in keys], place[place < n] == n - 1


def _bounds_of(n: int, width: int):
    names = ["_group", *(f"_b{i}" for i in range(width))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, keys, waiting, size = None, [], [], 0

        def merged():
            group = pa.concat_arrays([g for g, _ in waiting])
            return _best(group, [np.concatenate([k[i] for _, k in waiting]) for i in range(width)], n)

        for batch in batches:
            score = batch.column(1).to_numpy(zero_copy_only=False)
            rest = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 1 + width)]
            waiting.append((batch.column(0), [score, *rest]))
            size += batch.num_rows
            # Sorted again only when as much is waiting as was kept: the work stays in proportion to the rows.
            if size >= 2 * (len(kept) if kept is not None else 0) + 100_000:
                kept, keys, _ = merged()
                waiting, size = [(kept, keys)], len(kept)
        if waiting:
            kept, keys, full = merged()
            at = np.flatnonzero(full)
            if len(at):
                yield pa.RecordBatch.from_arrays([kept.take(pa.array(at)), *(pa.array(k[at]) for k in keys)], names=names)

    return run


def bounds(rows: DataFrame, group: str, score: str, n: int, more: list[str] | None = None) -> DataFrame:
    """(_group, _bound): the largest local n-th best key of each group that has n rows in a partition; a key is (score, *more)."""
    kind, more = rows.schema[group].dataType.simpleString(), more or []
    slim = rows.select(group, _score(score).alias("_b0"), *(_whole(rows, c).alias(f"_b{i}") for i, c in enumerate(more, 1)))
    local = slim.mapInArrow(_bounds_of(n, 1 + len(more)), ", ".join([f"_group {kind}", "_b0 double", *(f"_b{i} bigint" for i in range(1, 1 + len(more)))]))
    return local.groupBy("_group").agg(F.max(F.struct(*(f"_b{i}" for i in range(1 + len(more))))).alias("_bound"))


def _score(score: str):
    # Zero has one sign, so that the order of doubles is that of the ranking.
    return F.col(score).cast("double") + F.lit(0.0)


def _whole(rows: DataFrame, name: str):
    """A descending tie column as a whole number, null below all."""
    kind, c = rows.schema[name].dataType.simpleString(), F.col(name)
    if kind == "date":
        number = F.unix_date(c).cast("long")
    elif kind.startswith("timestamp"):
        # Without a zone throughout, so that no hour of a zone is counted twice.
        number = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c.cast("timestamp_ntz")) if kind == "timestamp_ntz" else F.unix_micros(c)
    else:
        number = c.cast("long")
    return F.coalesce(number, F.lit(-(1 << 62)))


def top_n(df: DataFrame, group: str, score: str, n: int, ties: list[tuple[str, str]], place: str = "place") -> DataFrame:
    """Columns of `df` plus `place`, 1 to n in each group by score descending, then `ties` (column, "asc" or "desc"), nulls last."""
    if n < 1:
        raise ValueError("n must be 1 or more")
    rows = df.where(F.col(group).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    more = []
    for name, way in ties:
        if way != "desc" or df.schema[name].dataType.simpleString() not in WHOLE:
            break
        more.append(name)
    key = F.struct(_score(score).alias("_b0"), *(_whole(rows, c).alias(f"_b{i}") for i, c in enumerate(more, 1)))
    kept = rows.join(bounds(rows, group, score, n, more), F.col(group) == F.col("_group"), "left")
    kept = kept.where(F.col("_bound").isNull() | (key >= F.col("_bound"))).drop("_group", "_bound")
    order = [F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_last() for c, way in ties]
    ranked = kept.withColumn(place, F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), *order)))
    return ranked.where(F.col(place) <= n)


def latest(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """Of each key the row with the largest `order`; combines before it shuffles. Rows with a null key count as one key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_row")).select(key, "_row.*")
