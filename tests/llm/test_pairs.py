import random

import pytest

from lattica.llm import name_link, near_dups


def brute(texts, threshold):
    sets = {k: set(near_dups.Sequences()(t).tolist()) for k, t in texts.items()}
    return {(a, b) for a in texts for b in texts if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > threshold}


def versions(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = {}
    for i in range(25):
        base = [rng.choice(vocab) for _ in range(150)]
        texts[f"p{i:02d}"] = " ".join(base)
        for v in range(i % 3):
            other = list(base)
            for _ in range(6):
                other[rng.randrange(len(other))] = rng.choice(vocab)
            texts[f"p{i:02d}v{v}"] = " ".join(other[20:] + other[:20]) if v else " ".join(other)
    texts["zh1"] = "图结构优于实体名称的变体而我们提出的方法补充了误差传播与梯度方差" * 3
    texts["zh2"] = texts["zh1"].replace("补充", "，补充")
    return texts


def test_pairs_equal_brute_force(spark):
    texts = versions()
    rows = [(i, k, t, "x") for i, (k, t) in enumerate(texts.items())] + [(900, "nul", None, ""), (901, "empty", "", ""), (902, "short", "one two", ""), (903, None, texts["p01"], ""), (904, "p01", texts["p01"], ""), (905, "copy", texts["p01"].upper(), "")]
    df = spark.createDataFrame(rows, "seq long, paper_id string, full_text string, fp string")
    want = brute({**texts, "copy": texts["p01"].upper()}, 0.4)
    assert {tuple(r) for r in near_dups.pairs(df, "paper_id", "seq", "full_text", 0.4).collect()} == want
    rows = {r.id: (r.class_id, r.n_links) for r in near_dups.classes(df, "paper_id", "seq", "full_text", 0.4).collect()}
    assert rows["copy"][0] == rows["p01"][0] == rows["p01v0"][0] and rows["short"] == ("short", 0) and set(rows) == set(texts) | {"copy", "nul", "empty", "short"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "seq long, paper_id string, full_text string")
    assert near_dups.pairs(df, "paper_id", "seq", "full_text", 0.4).collect() == []


def test_prune_bound_keeps_what_may_exceed():
    least = near_dups.least_matches(0.4, 1e-5)
    assert list(least) == [32, 64, 96, 128] and 0 <= least[32] < least[128] < 0.4 * 128


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Veroger, Christopher", "Chris Veroger", True), ("D. Zesetock", "ZESETOCK Daniela", True), ("PF Gerabim", "Gerabim, Priya F.", True), ("Omar L. Hatofex", "Omar G. Hatofex", False), ("Wei Galatis", "Wei J Galatis¹", True),
        ("Leila Levotöv", "Timothy Levotöv", False), ("Prof. Dr. Debbie C Hibivert", "Deborah Hibievrt", True), ("Ana Petarand", "Ana Fimagert", False), ("Pepe Zikilem", "Zikilem, José", True),
    ],
)
def test_persons(a, b, same):
    assert (name_link.match_persons(name_link.person(a), name_link.person(b), {}, {}, 1) > 0) is same


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Lolapas Language Model", "Language Model, Lolapas", True), ("Lolapas LM", "Lolapas Language Model", True), ("Lolapas Language Model (LLM)", "the lolapas_language_model", True), ("Lolapas Language Model XL", "Lolapas Language Model", False),
        ("Gijehex Tagger v1", "Gijehex Tagger v2", False), ("Tevidex Attn Net", "Tevidex Attention Network", True), ("Lekehev DE", "Lekehev Dual Encoder", True), ("Joperosk Alignment", "Rejanon Alignment", False), ("Zehehanz 89.1 BLEU", "Zehehanz 89.2 BLEU", False),
    ],
)
def test_things(a, b, same):
    x, y = name_link.thing(a), name_link.thing(b)
    w = {**{k: 1.0 for k in x[0] + y[0]}, **{k: 5.0 for k in (x[0] + y[0]) if k in ("lolapas", "gijehex", "tevidex", "lekehev", "joperosk", "rejanon", "zehehanz")}}
    assert (name_link.match_things(x, y, w, w) > 0) is same


def test_linking(spark):
    rows = [
        ("author", True, "m1", "Christopher Veroger", "Bafital College of Computing"), ("author", True, "m2", "VEROGER, Chris", "Faculty of Data, Bafital Coll. of Comp."), ("author", True, "m3", "C. Verogre", "BAFITAL COLLEGE OF COMPUTING"),
        ("author", True, "m4", "Christopher Veroger", "University of Jopegolt"), ("author", True, "m5", "Olga Revofal", None), ("author", True, "m6", "Revofal, O.", "Bakenos University"), ("author", True, "m6", "Revofal, O.", "Bakenos University"),
        ("author", True, "m7", "Christopher Veroger", None), ("author", True, "m8", None, "x"), ("author", True, "m9", " 12 ", "y"), ("entity:Model", False, "e1", "Hogenev Language Model", None), ("entity:Model", False, "e2", "Hogenev Language Motel", None),
        ("entity:Method", False, "e3", "Hogenev Language Model", None), ("entity:Model", False, "e4", "Hogenev Language Model 2", None),
    ]
    df = spark.createDataFrame(rows, "scope string, human boolean, id string, name string, where string")
    got = {(r.scope, r.id_a, r.id_b) for r in name_link.pairs_of(name_link.linked(df)).collect()}
    assert got == {("author", "m1", "m2"), ("author", "m1", "m3"), ("author", "m2", "m3"), ("author", "m5", "m6"), ("entity:Model", "e1", "e2")}
    assert name_link.linked(df.limit(0)).collect() == []


def test_glued_things(spark):
    rows = [
        ("entity:Method", "g1", "HotaloskContrastiveAlignment"), ("entity:Method", "g2", "Hotalosk Contrastive Alignment"), ("entity:Method", "g3", "hotaloskcontrastivealignment"), ("entity:Method", "g4", "hotaloskcontrstivealignment"),
        ("entity:Institution", "g5", "MironinzInstituteofTechnology"), ("entity:Institution", "g6", "Mironinz Institute of Technology"), ("entity:Model", "g7", "GijehexTaggerV1"), ("entity:Model", "g8", "Gijehex Tagger v2"), ("entity:Model", "g9", "gijehextaggerv2"),
        ("entity:Result", "h1", "Zehehanz 81.7 nDCG"), ("entity:Result", "h2", "Zehehanz 8.17 nDCG"), ("entity:Dataset", "h3", "Dataset, Arxiv"), ("entity:Dataset", "h4", "ArXiv Dataset"),
    ]
    df = spark.createDataFrame(rows, "scope string, id string, name string").selectExpr("scope", "false AS human", "id", "name", "CAST(null AS string) AS where")
    got = {(r.id_a, r.id_b) for r in name_link.pairs_of(name_link.linked(df)).collect()}
    assert got == {(a, b) for g in (("g1", "g2", "g3", "g4"), ("g5", "g6"), ("g8", "g9"), ("h3", "h4")) for a in g for b in g if a < b}


def test_common_words_still_meet(spark):
    # A surname that a third of the records have, beside a rare given name written as an initial or a nickname.
    rows = [("y1", "Yolanda Zhang", "Bafital College"), ("y2", "Y. Zhang", "Bafital College"), ("r1", "Bob Zhang", "Bafital College"), ("r2", "Rob Zhang", "Bafital College"), ("y3", "Yolanda Zhnag", "Bakenos College"), ("y4", "Y. Zhang", "Bakenos College")]
    rows += [(f"z{i}", f"Qu{chr(97 + i)}ntovar Zhang", f"Place{chr(97 + i)} College") for i in range(20)] + [(f"o{i}", f"Wert{chr(97 + i)}lamo Surn{chr(97 + i)}mefi", f"Spot{chr(97 + i)} College") for i in range(20)]
    df = spark.createDataFrame(rows, "id string, name string, where string").selectExpr("'author' AS scope", "true AS human", "id", "name", "where")
    got = {(r.id_a, r.id_b) for r in name_link.pairs_of(name_link.linked(df)).collect()}
    assert got == {("y1", "y2"), ("r1", "r2"), ("y3", "y4")}


def test_crosswise_initials_need_the_heaviest_word():
    a, b = name_link.person("Hiroshi T. Hapasort"), name_link.person("Hiroshi H. Tigalols")
    w = {"hiroshi": 2.0, "hapasort": 7.0, "tigalols": 7.0}
    assert name_link.match_persons(a, b, w, w, 1) == 0
    assert name_link.match_persons(name_link.person("Hiroshi T. Hapasort"), name_link.person("H. Takeo Hapasort"), {**w, "takeo": 3.0}, {**w, "takeo": 3.0}, 1) > 0
