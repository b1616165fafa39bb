"""Entity resolution: exact, alias and vector matches, decisions, aliases and the review queue."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.constants import AUTO_MERGE, FALLBACK_RATIO, MAX_CANDIDATES, REVIEW_LOWER, ROUGH_RATIO
from lattica.functions.text import cosine, normalized_name
from lattica.plans.tables import cut


#: So many of a name's rarest pairs of neighbouring characters bring it together with others.
RARE_GRAMS = 12


@F.pandas_udf(T.DoubleType())
def char_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two strings, in argument order; 0 for empty ones."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")


def may_reach(a: Column, b: Column, ratio: float) -> Column:
    """A bound that every pair of that ratio meets: twice the shorter length over both lengths."""
    return 2 * F.least(F.length(a), F.length(b)) >= F.lit(ratio) * (F.length(a) + F.length(b))


def exact(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(entity_id, match_id): the earliest existing entity of the same type and normalised name."""
    first = existing.where("name IS NOT NULL").groupBy("entity_type", normalized_name(F.col("name")).alias("norm")).agg(F.min_by("entity_id", "seq").alias("match_id"))
    return new.withColumn("norm", normalized_name(F.col("name"))).join(first, ["entity_type", "norm"]).select("entity_id", "match_id")


def by_alias(new: DataFrame, aliases: DataFrame, existing: DataFrame) -> DataFrame:
    """(entity_id, match_id): through an alias of the same type; aliases of entities that are gone do not count."""
    known = aliases.join(existing.select(F.col("entity_id").alias("canonical_entity_id")), "canonical_entity_id", "left_semi")
    first = known.groupBy("entity_type", normalized_name(F.col("alias_text")).alias("norm")).agg(F.min("canonical_entity_id").alias("match_id"))
    return new.withColumn("norm", normalized_name(F.col("name"))).join(first, ["entity_type", "norm"]).select("entity_id", "match_id")


def _rare_grams(names: DataFrame, most: Column) -> DataFrame:
    """(entity_type, norm, gram): of each distinct name (entity_type, norm) so many of its rarest padded grams that another name of the type has too."""
    ends = names.select("entity_type", "norm", F.explode(_grams(F.col("norm"), True)).alias("gram"))
    spread = ends.groupBy("entity_type", "gram").agg(F.count(F.lit(1)).alias("n"))
    ranked = ends.join(spread, ["entity_type", "gram"]).groupBy("entity_type", "norm").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("g"))
    return ranked.select("entity_type", "norm", F.explode(F.slice("g", F.lit(1), most)).alias("x")).where("x.n > 1").select("entity_type", "norm", F.col("x.gram").alias("gram"))


def by_vector(new: DataFrame, existing: DataFrame, most: int = MAX_CANDIDATES, grams: int = RARE_GRAMS) -> DataFrame:
    """(entity_id, match_id, similarity): the nearest of the roughly similar entities of the type.

    Both frames have entity_id, entity_type, name, embedding, seq. Names are compared once each, if one of their `grams` rarest pairs of
    neighbouring characters is the same (most names have no more pairs than that); of the rough matches the `most` best by ratio go on to the
    cosine. Of equal names only the first `most` can be among these.
    """
    # Without a vector nothing is similar: such entities are new, whatever their names, and no candidates either.
    some = F.exists("embedding", lambda v: v != 0)
    new, existing = new.where(some), existing.where(some)
    a = new.select(F.col("entity_id").alias("a_id"), "entity_type", normalized_name(F.col("name")).alias("a_norm"), F.col("embedding").alias("a_vec"))
    b = existing.select(F.col("entity_id").alias("b_id"), "entity_type", normalized_name(F.col("name")).alias("b_norm"), F.col("embedding").alias("b_vec"), "seq")
    names = a.select("entity_type", F.col("a_norm").alias("norm"), F.lit(True).alias("new")).unionByName(b.select("entity_type", F.col("b_norm").alias("norm"), F.lit(False).alias("new"))).where("norm IS NOT NULL")
    sides = cut(names.groupBy("entity_type", "norm").agg(F.bool_or("new").alias("asks"), F.bool_or(~F.col("new")).alias("answers")), "names")
    rare = cut(_rare_grams(sides.select("entity_type", "norm"), F.lit(grams)).join(sides, ["entity_type", "norm"]), "grams")
    asks, answers = rare.where("asks").select("entity_type", "gram", F.col("norm").alias("a_norm")), rare.where("answers").select("entity_type", "gram", F.col("norm").alias("b_norm"))
    met = asks.join(answers, ["entity_type", "gram"]).where(may_reach(F.col("a_norm"), F.col("b_norm"), ROUGH_RATIO)).select("entity_type", "a_norm", "b_norm").distinct()
    rough = met.withColumn("ratio", char_ratio("a_norm", "b_norm")).where(F.col("ratio") >= ROUGH_RATIO)
    first = b.withColumn("k", F.row_number().over(Window.partitionBy("entity_type", "b_norm").orderBy("seq", "b_id"))).where(F.col("k") <= most + 1).drop("k")
    pairs = a.join(rough, ["entity_type", "a_norm"]).join(first, ["entity_type", "b_norm"]).where("a_id <> b_id")
    some = pairs.withColumn("k", F.row_number().over(Window.partitionBy("a_id").orderBy(F.desc("ratio"), "seq"))).where(F.col("k") <= most)
    scored = some.withColumn("similarity", cosine(F.col("a_vec"), F.col("b_vec")))
    best = scored.groupBy("a_id").agg(F.max_by(F.struct("b_id", "similarity"), F.struct("similarity", -F.col("seq"))).alias("m"))
    return best.select(F.col("a_id").alias("entity_id"), F.col("m.b_id").alias("match_id"), F.col("m.similarity").alias("similarity"))


def decision(similarity: Column) -> Column:
    return F.when(similarity >= AUTO_MERGE, "merge").when(similarity >= REVIEW_LOWER, "review").otherwise("new")


def resolve(new: DataFrame, existing: DataFrame, aliases: DataFrame, most: int = MAX_CANDIDATES) -> DataFrame:
    """(entity_id, how, match_id, similarity): exact before alias before vector; review and new keep their own entity."""
    e = exact(new, existing).withColumn("how", F.lit("exact")).withColumn("similarity", F.lit(1.0))
    rest = new.join(e, "entity_id", "left_anti")
    a = by_alias(rest, aliases, existing).withColumn("how", F.lit("alias")).withColumn("similarity", F.lit(1.0))
    # Written, as its names are read several times.
    rest = cut(rest.join(a, "entity_id", "left_anti"), "rest")
    v = rest.select("entity_id").join(by_vector(rest, existing, most), "entity_id", "left")
    v = v.select("entity_id", F.coalesce(F.when(F.col("similarity") >= AUTO_MERGE, "embedding"), decision(F.coalesce("similarity", F.lit(0.0)))).alias("how"), "match_id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
    cols = ["entity_id", "how", "match_id", "similarity"]
    return e.select(cols).unionByName(a.select(cols)).unionByName(v.select(cols))


def new_aliases(resolved: DataFrame, new: DataFrame, aliases: DataFrame) -> DataFrame:
    """Alias rows of the vector merges that the table does not have yet."""
    made = resolved.where("how = 'embedding'").join(new.select("entity_id", "name", "entity_type"), "entity_id").select(F.col("name").alias("alias_text"), F.col("match_id").alias("canonical_entity_id"), "entity_type", F.lit("auto").alias("source"), F.col("similarity").alias("confidence"))
    made = made.withColumn("norm", normalized_name(F.col("alias_text")))
    have = aliases.select(normalized_name(F.col("alias_text")).alias("norm"), "canonical_entity_id").distinct()
    fresh = made.join(have, ["norm", "canonical_entity_id"], "left_anti").dropDuplicates(["norm", "canonical_entity_id"])
    return fresh.withColumn("alias_id", F.substring(F.sha2(F.concat_ws("|", "norm", "canonical_entity_id"), 256), 1, 12)).drop("norm")


def review_rows(resolved: DataFrame, new: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows for the review queue, with stable ids."""
    r = resolved.where("how = 'review'").join(new.select("entity_id", F.col("name").alias("new_entity_name"), F.col("entity_type").alias("new_entity_type")), "entity_id")
    r = r.join(existing.select(F.col("entity_id").alias("match_id"), F.col("name").alias("candidate_entity_name")), "match_id")
    return r.select(F.substring(F.sha2(F.concat_ws("|", "entity_id", "match_id"), 256), 1, 12).alias("review_id"), F.col("entity_id").alias("new_entity_id"), "new_entity_name", "new_entity_type", F.col("match_id").alias("candidate_entity_id"), "candidate_entity_name", "similarity", F.lit("pending").alias("status"))


def settle(reviews: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reviews, aliases): statuses after the verdicts (review_id, merge), and the manual aliases of the merged ones; unknown ids change nothing."""
    done = reviews.join(verdicts, "review_id", "left").withColumn("status", F.when(F.col("merge").isNull(), F.col("status")).when(F.col("merge"), "merged").otherwise("rejected"))
    made = done.where("merge").select(F.col("new_entity_name").alias("alias_text"), F.col("candidate_entity_id").alias("canonical_entity_id"), F.col("new_entity_type").alias("entity_type"), F.lit("manual").alias("source"), F.lit(1.0).alias("confidence"))
    return done.drop("merge"), made


def statistics(aliases: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row: aliases, and reviews by status."""
    s = reviews.agg(*(F.count_if(F.col("status") == x).alias(x) for x in ("pending", "merged", "rejected")))
    return aliases.agg(F.count(F.lit(1)).alias("aliases")).crossJoin(s)


def _grams(norm: Column, padded: bool) -> Column:
    """The distinct pairs of neighbouring characters of a name; padded ones include its ends."""
    text = F.concat(F.lit("\x01"), norm, F.lit("\x02")) if padded else norm
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda p: F.substring(text, p, F.lit(2))))


def _blocked(names: DataFrame, least: float) -> DataFrame:
    """(entity_type, a, b): pairs of different names of a type that may be contained in each other or reach the ratio, a before b in no order.

    For the ratio r both names offer their rarest padded grams: of d characters dropped and i added, d + i is at most 1 - r of both
    lengths together, and they destroy 2 d + i grams at most; over all d and i that is the larger of 4 (1 - r) / (2 - r) and 2 (1 - r) / r of a
    name's length, and one gram more must be shared. A contained name meets its container by its rarest gram.
    """
    part = max(4 * (1 - least) / (2 - least), 2 * (1 - least) / least)
    rare = _rare_grams(names, F.floor(F.length("norm") * F.lit(part) + 1e-9).cast("int") + 1)
    x, y = rare.withColumnRenamed("norm", "a"), rare.withColumnRenamed("norm", "b")
    close = x.join(y, ["entity_type", "gram"]).where((F.col("a") < F.col("b")) & may_reach(F.col("a"), F.col("b"), least)).select("entity_type", "a", "b")
    inner = names.where("norm <> ''").select("entity_type", "norm", F.explode(_grams(F.col("norm"), False)).alias("gram"))
    if names.where(F.length("norm") == 1).take(1):
        inner = inner.unionByName(names.where(F.length("norm") > 1).select("entity_type", "norm", F.explode(F.array_distinct(F.split("norm", ""))).alias("gram")))
    count = inner.groupBy("entity_type", "gram").agg(F.count(F.lit(1)).alias("n"))
    one = inner.join(count, ["entity_type", "gram"]).where((F.length("gram") == 2) | (F.length("norm") == 1)).groupBy("entity_type", "norm").agg(F.min(F.struct("n", "gram")).alias("g")).select("entity_type", F.col("norm").alias("a"), F.col("g.gram").alias("gram"))
    held = one.join(inner.withColumnRenamed("norm", "b"), ["entity_type", "gram"]).where((F.length("a") < F.length("b")) & F.contains("b", F.col("a"))).select("entity_type", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return close.unionByName(held).distinct()


def similar_pairs(vertices: DataFrame, least: float = FALLBACK_RATIO) -> DataFrame:
    """(id_a, id_b, similarity): pairs of a type, earlier first: contained names 0.95, else the ratio from `least` on; equal names 1.

    Names are compared once each, by the first entity that has them; every later one of the same name is paired with that first one,
    so that a common name costs its rows and not their pairs.
    """
    rows = cut(vertices.where("name IS NOT NULL").select("entity_id", "entity_type", "seq", normalized_name(F.col("name")).alias("norm")), "rows")
    names = cut(rows.groupBy("entity_type", "norm").agg(F.min(F.struct("seq", "entity_id")).alias("first")), "names")
    same = rows.join(names, ["entity_type", "norm"]).where("entity_id <> first.entity_id").select(F.col("first.entity_id").alias("id_a"), F.col("entity_id").alias("id_b"), F.lit(1.0).alias("similarity"))
    pairs = cut(_blocked(names.where("norm <> ''").select("entity_type", "norm"), least), "blocked")
    a, b = (names.select("entity_type", F.col("norm").alias(s), F.col("first").alias(f"first_{s}")) for s in "ab")
    both = pairs.join(a, ["entity_type", "a"]).join(b, ["entity_type", "b"])
    # The earlier name is the first argument of the ratio, which depends on their order.
    swap = F.col("first_b.seq") < F.col("first_a.seq")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    ordered = both.select(pick("first_a.entity_id", "first_b.entity_id").alias("id_a"), pick("first_b.entity_id", "first_a.entity_id").alias("id_b"), pick("a", "b").alias("x"), pick("b", "a").alias("y"))
    inside = F.contains("x", F.col("y")) | F.contains("y", F.col("x"))
    sure = ordered.where(inside).select("id_a", "id_b", F.lit(0.95).alias("similarity"))
    rest = ordered.where(~inside).withColumn("similarity", char_ratio("x", "y")).where(F.col("similarity") >= least).select("id_a", "id_b", "similarity")
    return same.unionByName(sure).unionByName(rest).where(F.col("similarity") >= least).select("id_a", "id_b", F.bround("similarity", 3).alias("similarity"))
