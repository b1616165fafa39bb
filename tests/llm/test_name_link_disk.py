import os
import random

import pytest

from lattica.llm import name_link
from lattica.plans import components, tables


@pytest.fixture
def written(monkeypatch):
    """The rows of what is cut, by name; frames are deleted before a test could read them."""
    real, rows = tables.cut, {}

    def cut(df, name="cut"):
        out = real(df, name)
        rows.setdefault(name, []).extend(out.collect())
        return out

    for module in (tables, name_link, components):
        monkeypatch.setattr(module, "cut", cut)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, name string, where string").selectExpr("'author' AS scope", "true AS human", "id", "name", "where")


def test_people_of_one_given_name_are_not_compared_with_each_other(spark, written):
    # Without a place, all of one given name and one first letter of the surname.
    syllables = [a + b for a in "bdfgklmnprtvz" for b in "aeiou"]
    rng = random.Random(5)
    surnames = sorted({"T" + "".join(rng.sample(syllables, 4)) for _ in range(300)})
    rows = [(f"p{i}", f"Hiroshi {s}", None) for i, s in enumerate(surnames)] + [(f"q{i}", f"Hiroshi {s}", "Bafital College") for i, s in enumerate(surnames[:100])]
    rows += [(f"r{i}", f"H. {s}", None) for i, s in enumerate(surnames[:50])]
    got = {(r.id_a, r.id_b) for r in name_link.pairs_of(name_link.linked(frame(spark, rows))).collect()}
    assert {(f"p{i}", f"q{i}") for i in range(100)} | {(f"p{i}", f"r{i}") for i in range(50)} <= got
    assert len(written["pairs"]) < 2 * len(rows)


def test_what_is_written_on_the_way_is_deleted(spark):
    folder = tables.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    linked = name_link.linked(frame(spark, [("a", "Olga Revofal", None), ("b", "Revofal, O.", "Bakenos University"), ("c", "Wei Galatis", None)]))
    assert [x.split("-")[1] for x in set(os.listdir(folder)) - before] == ["linked"]
    assert {r.id for r in linked.collect()} == {"a", "b", "c"}


def test_candidates_hold_all_that_verification_accepts(spark, written):
    rng = random.Random(11)
    given = "Robert Bob Rob William Bill Liam Olga Hiroshi Hiroshy Xander Sasha Alexander".split()
    surnames = "Hapasort Hapasrot Hapassort Tigalols Tigalosl Tigaols Bolirand Bolirant Wolirand Robert Rosetan Li".split()

    def name():
        words = rng.sample(given, rng.choice((0, 1, 1, 1, 2))) + rng.sample(surnames, rng.choice((0, 1, 1, 1, 1, 2)))
        words += [f"{c}." for c in rng.choices("HRTBWOAS", k=rng.choice((0, 0, 1, 1, 2)))]
        rng.shuffle(words)
        return " ".join(words)

    rows = [(f"i{k}", name(), rng.choice((None, None, "Bafital College", "Bakenos University"))) for k in range(400)]
    name_link.linked(frame(spark, rows))
    records = [(bytes(r.rec), bytes(r.bare), name_link._Record(r.line)) for r in written["weighed"]]
    met = {frozenset((bytes(r.ra), bytes(r.rb))) for r in written["pairs"]}
    accepted = 0
    for k, (ra, bare_a, a) in enumerate(records):
        for rb, bare_b, b in records[:k]:
            known = a.place != "" and a.place == b.place
            if not known and a.place and b.place or not known and bare_a == bare_b:
                continue
            if name_link.match_persons((a.words, a.inits), (b.words, b.inits), a.weights, b.weights, 2 if known else 1) >= name_link.THETA:
                accepted += 1
                assert frozenset((ra, rb) if known else (bare_a, bare_b)) in met, (a.words, a.inits, b.words, b.inits, known)
    assert accepted > 500 and len(met) < len(records) ** 2 / 4
