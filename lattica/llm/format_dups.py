"""Duplicates hidden by formatting: canonical form, 128-bit hash, partial aggregation, collision check.

Canonical form of a text: full-width forms of ASCII characters made plain, composed and decomposed letters made
one (NFC), full case mapping (upper, then lower, so that sharp s equals ss), then everything that is neither
letter, mark nor digit removed. A text that is a list of named fields ("Model: x; Value: 3", one field a
line, JSON-like, ...) has a second form with its fields sorted.

Two texts are copies if their canonical forms agree, or if their sorted forms agree, or if other texts join them
by these. The first relation is aggregated first; a group that contains a list then carries its sorted form
into a second aggregation over groups, so a list stored once more without its separators still joins its group.
Where the texts of one canonical form read as different lists, the sorted forms are joined by connected components.

Defined cases: null, empty and blank texts, and texts without any letter or digit, belong to no
group and have no copies. Repeated rows are copies of each other. Ties do not arise (`order` decides;
equal `order` values count as one first row). Extra columns are ignored.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lattica.plans.components import components
from lattica.plans.tables import cut

#: A field's name after the start of the text or a separator, with what layouts put around it.
FIELD = r"(?:^|[;,|\t\r\n{\[])[\s\-–—*•·>\"'“”{\[(]*(\p{L}[\p{L}\p{N}_ ]{0,30}?)[\"'“”\s*]*[:=]"
MARK, SEP = "\x01", "\x02"
#: A group of more than this part of all rows is joined by broadcast: there are fewer such groups than the number says.
HOT_SHARE = 4096
#: The full-width forms of the printable ASCII characters.
NARROWED = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}


def _unstable() -> str:
    """A character class of full-width forms and all that NFC may change, in few ranges: marks, conjoining letters, what has another canonical form.

    Ranges less than 128 apart are one, so it holds some stable characters too.
    """
    runs: list[list[int]] = [[0xFF01, 0xFF5E], [0x1100, 0x11FF], [0x2F800, 0x2FA1F]]
    for c in range(0x80, 0x10000):
        if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFC", chr(c)) != chr(c):
            if runs[-1][1] <= c < runs[-1][1] + 128:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "[\\p{M}" + "".join(f"\\x{{{x:X}}}-\\x{{{y:X}}}" for x, y in runs) + "]"


UNSTABLE = _unstable()


@F.pandas_udf(StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t.translate(NARROWED)))


def canonical(df: DataFrame, text: str) -> DataFrame:
    """`df` with full-width forms made plain and letters composed; only texts with something of either travel to Python."""
    odd = (F.octet_length(text) != F.length(text)) & F.col(text).rlike(UNSTABLE)
    return df.withColumn("_c", _canonical(F.when(odd, F.col(text)))).withColumn(text, F.coalesce("_c", text)).drop("_c")


def plain_form(text: Column) -> Column:
    """Letters, marks and digits only, in one case."""
    return F.regexp_replace(F.replace(F.lower(F.upper(text)), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{M}\p{N}]+", "")


def sorted_form(text: Column) -> Column:
    """The plain form with the named fields sorted; null unless the whole text is a list of two or more fields."""
    marked = F.regexp_replace(text, FIELD, f"{MARK}$1{SEP}")
    fields = F.split(marked, MARK)
    body = F.transform(F.slice(fields, 2, F.size(fields)), lambda f: plain_form(F.replace(f, F.lit(SEP), F.lit("="))))
    whole = (F.size(fields) >= 3) & (plain_form(F.element_at(fields, 1)) == "")
    return F.when(whole, F.array_join(F.array_sort(body), ""))


def _digest(form: Column) -> Column:
    return F.unhex(F.md5(form))


def keyed(df: DataFrame, text: str, order: str) -> DataFrame:
    """(order, plain, plain_check, fields, fields_check): hashes of each row's forms; rows without letters or digits are left out."""
    src = canonical(df.select(F.col(order).alias("order"), F.col(text).alias("text")), "text")
    listlike = F.col("text").rlike(FIELD)
    forms = src.select("order", plain_form(F.col("text")).alias("form"), F.when(listlike, sorted_form(F.col("text"))).alias("sorted"))
    return forms.where(F.col("form") != "").select(
        "order", _digest(F.col("form")).alias("plain"), F.xxhash64("form").alias("plain_check"), _digest(F.col("sorted")).alias("fields"), F.when(F.col("sorted").isNotNull(), F.xxhash64("sorted")).alias("fields_check")
    )


def _name(key: str, check: str) -> Column:
    return F.concat(F.hex(key), F.lit("-"), F.hex(check))


def collapse(keys: DataFrame) -> DataFrame:
    """One row per canonical form: (plain, plain_check, first, n) and the (key, check) of its set of copies.

    The key is the 128-bit hash; an independent 64-bit hash rides along in the grouping, so two
    forms that collide in the first stay apart. The aggregation combines before it shuffles.
    """
    form = F.when(F.col("fields").isNotNull(), F.struct("fields", "fields_check"))
    plain = keys.groupBy("plain", "plain_check").agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("n"), F.min(form).alias("f"), F.max(form).alias("g"))
    plain = cut(plain, "plain").withColumn("key", F.coalesce("f.fields", "plain")).withColumn("check", F.coalesce("f.fields_check", "plain_check"))
    torn = plain.where("f <> g").select("plain", "plain_check", _name("key", "check").alias("a"))
    if torn.take(1):
        links = keys.where("fields IS NOT NULL").join(torn, ["plain", "plain_check"]).select("a", _name("fields", "fields_check").alias("b"))
        roots = components(links).where("node <> component").select(F.col("node").alias("_name"), "component")
        root = F.col("component").isNotNull()
        plain = plain.withColumn("_name", _name("key", "check")).join(roots, "_name", "left")
        # A root's own name keeps its hashes, so that forms which need no mapping still meet it.
        part = F.split("component", "-")
        plain = plain.withColumn("key", F.when(root, F.unhex(part[0])).otherwise(F.col("key"))).withColumn("check", F.when(root, _signed(part[1])).otherwise(F.col("check")))
    return plain.select("plain", "plain_check", "first", "n", "key", "check")


def _signed(digits: Column) -> Column:
    """The 64-bit number that hex() wrote, in two's complement."""
    full = F.lpad(digits, 16, "0")
    high, low = F.conv(F.substring(full, 1, 8), 16, 10).cast("long"), F.conv(F.substring(full, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def copies(df: DataFrame, text: str, order: str) -> DataFrame:
    """(first, order, n_copies): each row with the smallest `order` of its set of copies, sets of two or more only.

    Rows of hot groups (over 1 / HOT_SHARE of all rows each, so fewer than HOT_SHARE of them) meet their group by
    broadcast where they are; only the others are shuffled, so no task gets a group with a third of the rows.
    """
    keys = cut(keyed(df, text, order), "forms")
    groups = cut(collapse(keys), "groups")
    totals = groups.groupBy("key", "check").agg(F.min("first").alias("first"), F.sum("n").alias("n_copies")).where("n_copies > 1")
    members = cut(groups.drop("first").join(totals, ["key", "check"]).select("plain", "plain_check", "n", "first", "n_copies"), "members")
    rows, on = keys.select("plain", "plain_check", "order"), ["plain", "plain_check"]
    least = keys.count() // HOT_SHARE
    hot, cold = F.broadcast(members.where(F.col("n") > least).drop("n")), members.where(F.col("n") <= least).drop("n")
    met = rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(cold, on))
    return met.select("first", "order", "n_copies")


def representatives(df: DataFrame, text: str, order: str) -> DataFrame:
    """One row per distinct text up to formatting: (first, n_copies)."""
    groups = collapse(cut(keyed(df, text, order), "forms"))
    return groups.groupBy("key", "check").agg(F.min("first").alias("first"), F.sum("n").alias("n_copies")).select("first", "n_copies")
