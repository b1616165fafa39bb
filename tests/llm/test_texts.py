import base64
import os

import pytest
from pyspark.sql import functions as F

from lattica.llm import bpe, leaks, scan_repair, spam, split_items

VOCABULARY = os.path.join(bpe.TOKENIZERS, bpe.VOCABULARY)


@pytest.fixture(scope="module")
def coder():
    with open(VOCABULARY, "rb") as f:
        return bpe.Encoder(f.read())


def test_bpe_equals_public_encoder_and_round_trips(coder):
    import tiktoken

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    ref = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ["Hello there", "a" * 5000, "图结构 \n\n x  1234", "<|endoftext|>", "\t\r\n ", "é́🙂", "x=1;y='it''s'", " ".join(f"w{i}" for i in range(3000))]:
        ids = coder.encode(text).tolist()
        assert ids == ref.encode_ordinary(text) and coder.decode(ids) == text


def test_bpe_rows(spark):
    df = spark.createDataFrame([(1, "one two", "x"), (2, None, "x"), (3, "", "x"), (4, " ", "x"), (1, "one two", "x")], "doc_id long, text string, ids string")
    rows = bpe.encode(df, "doc_id", "text")
    got = [(r.doc_id, len(r.ids)) for r in rows.orderBy("doc_id").collect()]
    assert got == [(1, 2), (1, 2), (2, 0), (3, 0), (4, 1)]
    assert sorted(r.text for r in bpe.decode(rows, "doc_id", "ids").collect()) == ["", "", " ", "one two", "one two"]
    assert bpe.encode(df.limit(0), "doc_id", "text").collect() == []


ITEM = "Which parser does the frozen window use to rescale every kernel during claim checking? The calibrated threshold separates the lattice, so that we evaluate an honest template and distil a lightweight signal over nine seeds."
OTHER = "A second held out passage speaks of rivers, bridges and the slow boats that carry grain to towns beyond the northern hills each autumn."


def found(spark, docs):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("item", F.lit("clash"))
    i = spark.createDataFrame([(7, ITEM), (8, OTHER), (9, None), (10, "two words")], "item_id long, text string")
    return {(r.doc, r.item) for r in leaks.leaks(d, "doc_id", "text", i, "item_id", "text").collect()}


def test_leaks(spark):
    words = ITEM.split()
    half = len(words) // 2
    altered = list(words)
    altered[5], altered[20] = "OTHER", "thing"
    shuffled = words[::2] + words[1::2]
    docs = [
        "Before. " + ITEM + " After.", ITEM.upper().replace(" ", "\n"), "x " * 50 + " ".join(altered), " ".join(words[half:]) + " filler " * 300 + "<p>" + " ".join(words[:half]) + "</p>", " ".join(shuffled), " ".join(words[: half // 2]), None, "", " ",
        "pad " * 5000 + ITEM + " pad" * 5000 + OTHER, "the frozen window. we evaluate. over nine seeds. claim checking.",
    ]
    assert found(spark, docs) == {(0, 7), (1, 7), (2, 7), (3, 7), (9, 7), (9, 8)}
    assert found(spark, []) == set()


def test_wand_equals_full_scores():
    items = [(i, " ".join(f"w{(i * 7 + j * (i % 5 + 1)) % 40}" for j in range(30))) for i in range(60)]
    index = leaks.Index(items)
    for text in (items[3][1], items[10][1] + " " + items[44][1], " ".join(f"w{j % 40}" for j in range(200))):
        at, terms = index.hits(text)
        unique = sorted(set(terms.tolist()))
        full = {}
        for t in unique:
            for i, w in zip(index.docs[t], index.weights[t], strict=True):
                full[i] = full.get(i, 0.0) + w
        for least in (0.05, 0.25, 0.6):
            import numpy as np

            got = dict(index.wand(np.array(unique), least))
            assert set(got) == {i for i, s in full.items() if s >= least}


def test_spam(spark):
    prose = "The calibrated encoder narrows the gap that we found in the earlier study, and it does so without any of the tricks. We measure how the label noise changes the result when the input is long. "
    pages = [
        (1, "best essay fast, " * 60, "en"), (2, prose * 3, "en"), (3, "#cheap_essay #buy_citations #free_pdf #thesis_help " * 12, None), (4, "\n".join(f"http://x{i}.example/cheap-essay | www.y{i}.test/buy" for i in range(20)), "xx"), (5, None, "en"), (6, "", "en"), (7, " \n ", "en"),
        (8, "References\n" + "\n".join(f"[{i}] Name, A. ({1990 + i}). Shared losses for link prediction. Open Notes, 3({i}), {i}0-{i}9." for i in range(1, 20)), "en"), (9, "Table\n" + "\n".join(f"Model-{i}\t{i}.5\t4{i}.1" for i in range(30)), "en"),
        (10, prose + "Buy essay now! Best essay online! Cheap essay fast! ", "en"), (11, prose + "Buy essay now! Best essay online! Cheap essay fast! " * 20, "en"), (12, "快速录用; 论文代写; " * 30, "zh"), (1, "best essay fast, " * 60, "en"),
    ]
    df = spark.createDataFrame(pages, "doc_id long, text string, lang string").withColumn("units", F.lit(1))
    assert sorted(r.id for r in spam.spam(df, "doc_id", "text", "lang").collect()) == [1, 1, 3, 4, 11, 12]
    assert spam.spam(df.limit(0), "doc_id", "text", "lang").collect() == []


RUSSIAN = "Мы исследуем, как метод обучения влияет на качество поиска в больших коллекциях документов. В работе показано, что предложенная модель улучшает результат на трёх наборах данных. Это объясняется тем, что шум в разметке снижается ещё до обучения. "
ITALIAN = "Presentiamo un metodo per la ricerca di documenti che riduce il rumore nelle etichette. Il modello è addestrato su tre raccolte di testi e migliora i risultati rispetto alle tecniche precedenti. Non è necessario alcun intervento manuale, e il costo di calcolo resta basso. "
JAPANESE = "本研究では、文書検索におけるラベル雑音を減らす方法を提案する。三つのデータで実験を行い、従来の手法より良い結果を得た。人手による作業は必要としない。"
KOREAN = "우리는 문서 검색에서 잡음을 줄이는 방법을 제안한다. 세 가지 자료로 실험하여 기존 방법보다 좋은 결과를 얻었다. 사람의 손은 필요하지 않다. "


def test_prose_of_other_languages_and_any_length(spark):
    pages = [(100 * i + n, t * n, lang) for i, t in enumerate((RUSSIAN, ITALIAN, JAPANESE, KOREAN)) for n in (1, 2, 20) for lang in (None,)]
    pages += [(900, "скачать реферат бесплатно, купить диплом недорого, скачать диплом, купить реферат, " * 12, None), (901, "tesi online gratis, scrivere tesi online, tesi gratis, comprare tesi online, " * 12, None), (902, "AI paper generator in AI del paper generator AI paper paper ai generator in paper AI. " * 9, "en")]
    df = spark.createDataFrame(pages, "doc_id long, text string, lang string")
    shares = {r.id: r.share for r in spam.judged(spam.measured(df, "doc_id", "text", "lang")).collect()}
    assert {i for i, x in shares.items() if x > 0.3} == {900, 901, 902}


def test_repetition_is_judged_against_its_length():
    usual = [spam.measure(" ".join(f"word{(i * 7) % 61}" for i in range(n)), None)[3][0] for n in (40, 400)]
    assert usual[0] < 0.2 and usual[1] > 0.9
    stuffed = spam.measure("cheap essay best essay fast essay cheap best essay")[4][0]
    assert stuffed[4] > 0.8 and stuffed[6] > 0 and stuffed[2] == 0.0


def spells(text, pieces, overlap):
    out = ""
    for k, (start, content) in enumerate(pieces):
        assert text[start : start + len(content)] == content
        assert not k or start == len(out) - overlap
        out += content if not k else content[overlap:]
    return out == text


def test_split_rows(spark, monkeypatch):
    para = "One sentence here. Another follows it, longer than before! Is this the third? "
    texts = {1: "1. Setup\n" + para * 12 + "\n\n2. Results\n" + para * 9, 2: "x" * 1700, 3: "é🙂" * 900, 4: "short", 5: None, 6: "y" * 800, 7: "z" * 801, 8: ("word " * 400 + "\n\n") * 40}
    for size in (1 << 20, 3000):
        monkeypatch.setattr(split_items, "RANGE_CHARS", size)
        df = spark.createDataFrame([(k, t, "Own" if k == 2 else None) for k, t in texts.items()], "seq long, content string, section_title string")
        got = {}
        for r in split_items.split_rows(df, F.col("seq"), "content", 800, 100, F.col("section_title")).orderBy("key", "piece").collect():
            got.setdefault(r.key, []).append(r)
        assert set(got) == {1, 2, 3, 7, 8}
        for k, rows in got.items():
            assert all(len(r.content) <= 800 for r in rows) and [r.piece for r in rows] == list(range(len(rows)))
            assert spells(texts[k], [(r.start, r.content) for r in rows], 100)
        assert got[1][0].section_title == "1. Setup" and got[1][-1].section_title == "2. Results" and got[2][0].section_title == "Own"
        assert any(r.content.endswith(("! ", ". ", "? ")) or "2. Results" in texts[1][r.start + len(r.content) :][:12] for r in got[1][:-1])
    with pytest.raises(ValueError):
        split_items.offsets(df, F.col("seq"), "content", 800, 300)


def test_split_files(spark, tmp_path):
    text = ("Ein Satz über Äpfel. Noch einer 🙂 folgt darauf! " * 30 + "\n\n") * 40
    (tmp_path / "big.txt").write_text(text, encoding="utf-8")
    (tmp_path / "small.txt").write_text("kurz", encoding="utf-8")
    rows = split_items.split_files(spark, str(tmp_path), 800, 100, range_bytes=10_000).orderBy("start").collect()
    assert len(rows) > 50 and all(len(r.content) <= 800 for r in rows) and all("big.txt" in r.key for r in rows)
    assert spells(text, [(r.start, r.content) for r in rows], 100)


CLEAN = "The calibrated encoder narrows the gap between the temporal retriever and the structured baseline. We measure every alignment of the modern schema and the shared representation. Because the threshold of the margin separates a self-supervised sampler, our classifier covers the relation extraction budget. Following earlier work, the latent graph aggregates a fine-grained corpus, and every pipeline stabilises the ranking when the input is long."


def corpus():
    rows = [("chunk", i, CLEAN + f" Number {i} of the series follows the ontology without additional supervision.") for i in range(60)]
    scan = "The calibratcd encoder narrows the gap betw-\neen the temporal retriever and the structured\nbaseline. We measure every alignment of the\n- 12 -\n\x0cmodern schema and the shared representation."
    wrapped = "The calibrated encoder narrows the gap between\nthe temporal retriever and the structured\nbaseline. Our classifier covers a self-\nsupervised sampler of the modern schema."
    return rows + [("chunk", 900, scan), ("paper", 900, wrapped), ("chunk", 901, None), ("chunk", 902, ""), ("chunk", 903, " \n "), ("chunk", 900, scan)]


def test_scan_repair(spark):
    df = spark.createDataFrame(corpus(), "kind string, id long, text string")
    repair = scan_repair.Repair(df)
    assert {tuple(r) for r in repair.found().collect()} == {("chunk", 900)}
    texts = {(r.kind, r.id): r.text for r in repair.repaired().collect()}
    assert texts["chunk", 900] == "The calibrated encoder narrows the gap between the temporal retriever and the structured baseline. We measure every alignment of the modern schema and the shared representation."
    assert "a self-supervised sampler" in texts["paper", 900] and "\n" not in texts["paper", 900]
    assert texts["chunk", 902] == "" and texts["chunk", 3] == corpus()[3][2]


def test_scan_repair_empty(spark):
    df = spark.createDataFrame([], "kind string, id long, text string")
    assert scan_repair.Repair(df).found().collect() == []


def test_character_editor_held_out():
    import random

    words = sorted({w for w in CLEAN.lower().replace(".", "").replace("-", " ").split() if len(w) > 4})
    extra = [f"{a}{b}" for a in ("model", "train", "graph", "token", "param", "signal", "hidden", "linear") for b in ("ing", "ed", "s", "ation", "ment", "less", "able")]
    vocab = words + extra
    counts = {w: 500.0 for w in vocab} | {w: 60000.0 for w in ("the", "and", "of")}
    texts = [" ".join(vocab[i::3] + ["the", "and", "of"]) for i in range(3)] * 5
    model = scan_repair.train(texts, counts, 1e6)
    rng, right, total = random.Random(5), 0, 0
    for _ in range(400):
        w = rng.choice(vocab)
        x = scan_repair.noisy_word(w, rng)
        if not x or x.lower() in counts:
            continue
        options, forms = [scan_repair.keep_features(x.lower(), 0, 1e6)], [x.lower()]
        for y, ops in scan_repair.edits(x.lower(), model["rules"]):
            if y in counts:
                options.append(scan_repair.edit_features(x.lower(), 0, counts[y], 1e6, ops))
                forms.append(y)
        total += 1
        right += forms[scan_repair.pick(model["chars"], options)] == w
    assert right > 0.9 * total


def test_bit_table_finds_all_forms(spark, monkeypatch):
    forms = [f"form{i}ä" for i in range(500)]
    table = scan_repair.bit_table(spark.createDataFrame([(f,) for f in forms], "form string"))
    assert len(table) * 64 == scan_repair.LEAST_BITS
    from zlib import crc32

    assert all(int(table[(crc32(f.encode()) & (len(table) * 64 - 1)) >> 6]) >> (crc32(f.encode()) & 63) & 1 for f in forms)
    # A table too small to tell forms apart gives the same rows, by the join.
    df = spark.createDataFrame(corpus(), "kind string, id long, text string")
    monkeypatch.setattr(scan_repair, "LEAST_BITS", 64)
    monkeypatch.setattr(scan_repair, "MOST_BITS", 64)
    repair = scan_repair.Repair(df)
    assert {tuple(r) for r in repair.found().collect()} == {("chunk", 900)}
    assert "The calibrated encoder narrows the gap between the temporal" in {(r.kind, r.id): r.text for r in repair.repaired().collect()}["chunk", 900]


def test_edge_words():
    text = "noi5e in a model of gra-\ndient edge"
    assert scan_repair.judged(text, True) == {"noi5e", "in", "a", "model", "of"}
    assert scan_repair.judged(text, False) == {"noi5e", "in", "a", "model", "of", "edge"}
    assert "gradient" in scan_repair.judged(text, True, True)
    assert scan_repair.judged("", True) == scan_repair.judged("one", True) == set()


def test_leaks_spread_over_a_long_document(spark, monkeypatch):
    words = [f"term{i}" for i in range(600)]
    item = " ".join(words)
    far = " ".join(" ".join(words[14 * k : 14 * k + 14]) + " filler" * 1500 for k in range(40))
    d = spark.createDataFrame([(1, far), (2, ITEM), (3, "nothing of it")], "doc_id long, text string")
    i = spark.createDataFrame([(70, item), (7, ITEM), (8, OTHER)], "item_id long, text string")
    want = {(1, 70), (2, 7)}
    assert {(r.doc, r.item) for r in leaks.leaks(d, "doc_id", "text", i, "item_id", "text").collect()} == want
    monkeypatch.setattr(leaks, "SHARD_ITEMS", 1)
    assert {(r.doc, r.item) for r in leaks.leaks(d, "doc_id", "text", i, "item_id", "text").collect()} == want


def test_pieces_spell_the_text_and_name_oversized_items(spark, monkeypatch):
    monkeypatch.setattr(split_items, "RANGE_CHARS", 2000)
    texts = {1: "Ein Satz 🙂 mehr. " * 700, 2: "w" * 801, 3: "w" * 800, 4: None, 5: "1. A\n" + "b c. " * 330}
    df = spark.createDataFrame(list(texts.items()), "seq long, content string").withColumn("key", F.lit("clash"))
    at = split_items.offsets(df, F.col("seq"), "content", 800, 100)
    assert sorted(r.key for r in split_items.oversized(at).collect()) == [1, 2, 5]
    whole = split_items.joined(split_items.split_rows(df, F.col("seq"), "content", 800, 100), 100)
    assert {r.key: r.text for r in whole.collect()} == {k: texts[k] for k in (1, 2, 5)}
