"""Best representative of each duplicate group: unpivot, vote, max_by, pivot back.

Every field of every row becomes one long row (group, field, value, completeness). A field's winner is the
max_by of an order key; which key is the caller's choice:

* ``votes``: per normalised value the votes are summed, source trust times a recency decay; the value with most
  votes wins, then completeness, trust, recency, the earliest row. Votes are whole numbers (the decay is
  halved every HALF_LIFE days, in steps of a day, from a fixed-point table), so sums do not depend on the order of rows.
* ``complete``: completeness, then trust, then recency, then the earliest row. This order leaves nothing to votes,
  so none are summed and values do not travel: one aggregation of long rows decides all fields.

All aggregations combine before they shuffle, so a group with a third of all rows reaches one task
only as partial states.

Defined cases: null, blank and stand-in values ("N/A", "unknown", "-", ...) are no values and never
win or vote; a group without any value of a field has no row for it (null after the pivot). Unknown or
null sources have no trust, which ranks below every trust; null times rank earliest and decay fully.
Rows with a null group key are left out. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands in for a missing value, compared without case, spaces and punctuation.
STAND_INS = ["na", "nan", "nil", "none", "null", "unknown", "unspecified", "undefined", "missing", "empty", "notspecified", "notavailable", "notapplicable", "notgiven", "notprovided", "notknown", "novalue", "nodata", "tbd", "tba", "todo", "未知", "不详", "无", "暂无", "未提供", "待定"]
#: No trust ranks below every trust.
NO_TRUST = -(1 << 30)
#: No time is before every time.
NO_TIME = "0001-01-01"
SPACE = r"(?U)\s+"
#: Days in which a vote loses half its weight, and the bits of a vote of trust 1 today.
HALF_LIFE, VOTE_BITS = 365, 40


def squeezed(text: Column) -> Column:
    """Outer whitespace removed, inner runs as one space."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def is_value(text: Column) -> Column:
    """Whether a string says something: not null, blank, punctuation only or a stand-in."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", "")
    return F.coalesce((bare != "") & ~bare.isin(STAND_INS), F.lit(False))


def text_field(name: str) -> tuple[str, Column, Column]:
    """(name, normalised value, completeness) of a text: its characters, null without a value."""
    value = squeezed(F.col(name))
    return name, F.when(is_value(F.col(name)), value), F.when(is_value(F.col(name)), F.length(value))


def map_field(name: str) -> tuple[str, Column, Column]:
    """Of a map: its entries with a value."""
    kept = F.map_filter(F.col(name), lambda _, v: is_value(v))
    text = F.to_json(F.array_sort(F.transform(F.map_entries(kept), lambda e: F.struct(e["key"].alias("k"), squeezed(e["value"]).alias("v")))))
    return name, F.when(F.size(kept) > 0, text), F.when(F.size(kept) > 0, F.size(kept))


def list_field(name: str) -> tuple[str, Column, Column]:
    """Of a list: its distinct entries with a value."""
    kept = F.array_distinct(F.transform(F.filter(F.col(name), is_value), squeezed))
    return name, F.when(F.size(kept) > 0, F.to_json(F.array_sort(kept))), F.when(F.size(kept) > 0, F.size(kept))


def decay(age: Column) -> Column:
    """2 ** (VOTE_BITS - age / HALF_LIFE) as a whole number, for an age in days of 0 or more."""
    steps = F.array(*(F.lit(round(2 ** (VOTE_BITS - d / HALF_LIFE))) for d in range(HALF_LIFE)))
    return F.floor(F.get(steps, F.pmod(age, F.lit(HALF_LIFE))) / F.pow(F.lit(2.0), F.least(F.floor(age / HALF_LIFE), F.lit(2 * VOTE_BITS)))).cast("decimal(20,0)")


def long_rows(df: DataFrame, group: str, source: str, time: str, order: str, trust: DataFrame, fields: Sequence[tuple[str, Column, Column]], values: bool = True) -> DataFrame:
    """(grp, field_name, value, complete, trust, at, ord): one row per row and field, value and completeness null where it has none.

    Without `values` only the completeness is worked out.
    """
    trusted = trust.groupBy(F.col(trust.columns[0]).alias("_src")).agg(F.max(trust.columns[1]).alias("_trust"))
    cells = F.array(*(F.struct(F.lit(n).alias("field_name"), *([v.alias("value")] if values else []), c.cast("long").alias("complete")) for n, v, c in fields))
    at = F.coalesce(F.col(time).cast("timestamp_ntz"), F.lit(NO_TIME).cast("timestamp_ntz"))
    wide = df.where(F.col(group).isNotNull()).select(F.col(group).alias("grp"), F.col(source).alias("_src"), at.alias("at"), F.col(order).alias("ord"), cells.alias("cells"))
    return wide.join(trusted, "_src", "left").select("grp", "at", "ord", F.coalesce("_trust", F.lit(NO_TRUST)).alias("trust"), F.explode("cells").alias("c")).select("grp", "c.*", "trust", "at", "ord")


def complete_winners(rows: DataFrame, least_rows: int = 1) -> DataFrame:
    """(grp, field_name, ord): of each field the most complete row. One shuffle of ranks; rows without a value only count."""
    rank = F.when(F.col("complete").isNotNull(), F.struct("complete", "trust", "at", (-F.col("ord")).alias("neg")))
    best = rows.select("grp", "field_name", "ord", rank.alias("rank")).groupBy("grp", "field_name").agg(F.count(F.lit(1)).alias("n"), F.max_by("ord", "rank").alias("ord"))
    return best.where(F.col("ord").isNotNull() & (F.col("n") >= least_rows)).select("grp", "field_name", "ord")


def voted_winners(rows: DataFrame, least_rows: int = 1) -> DataFrame:
    """(grp, field_name, ord, value, votes): of each field the value with most votes, and its best row."""
    today = rows.agg(F.max("at").alias("today"))  # one row
    age = F.greatest(F.datediff(F.col("today").cast("date"), F.col("at").cast("date")), F.lit(0))
    vote = F.when((F.col("trust") > 0) & (F.col("at") > F.lit(NO_TIME).cast("timestamp_ntz")), F.col("trust").cast("decimal(12,0)") * decay(age)).otherwise(F.lit(0).cast("decimal(33,0)"))
    rank = F.struct("complete", "trust", "at", (-F.col("ord")).alias("neg"))
    each = rows.crossJoin(F.broadcast(today)).where("value IS NOT NULL").select("grp", "field_name", F.md5("value").alias("v"), "value", vote.alias("vote"), "ord", rank.alias("rank"))
    # One state per distinct value: its votes, and its own best row.
    values = each.groupBy("grp", "field_name", "v").agg(F.sum("vote").alias("votes"), F.max_by(F.struct("ord", "value"), "rank").alias("row"), F.max("rank").alias("rank"))
    best = values.groupBy("grp", "field_name").agg(F.max_by(F.struct("row", "votes"), F.struct("votes", "rank")).alias("w"))
    out = best.select("grp", "field_name", F.col("w.row.ord").alias("ord"), F.col("w.row.value").alias("value"), F.col("w.votes").alias("votes"))
    if least_rows > 1:
        sizes = rows.groupBy("grp").agg(F.count_distinct("ord").alias("n")).where(F.col("n") >= least_rows)
        out = out.join(sizes.select("grp"), "grp", "left_semi")
    return out


def winners(df: DataFrame, group: str, source: str, time: str, order: str, trust: DataFrame, fields: Sequence[tuple[str, Column, Column]], rule: str = "complete", least_rows: int = 1) -> DataFrame:
    """(grp, field_name, ord, ...): the winning row of each field in each group of `least_rows` rows or more; with votes also value and votes."""
    rows = long_rows(df, group, source, time, order, trust, fields, rule == "votes")
    return voted_winners(rows, least_rows) if rule == "votes" else complete_winners(rows, least_rows)


def survivors(df: DataFrame, group: str, source: str, time: str, order: str, trust: DataFrame, fields: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """One row per group: the voted value of each field, pivoted back to columns."""
    won = winners(df, group, source, time, order, trust, fields, "votes")
    cols = (F.max(F.when(F.col("field_name") == n, F.col("value"))).alias(n) for n, _, _ in fields)
    groups = df.where(F.col(group).isNotNull()).select(F.col(group).alias("grp")).distinct()
    return groups.join(won.groupBy("grp").agg(*cols), "grp", "left").withColumnRenamed("grp", group)
