import datetime as dt

from pyspark.sql import functions as F

from lattica.llm import best_record, format_dups, top_n


def groups(spark, rows):
    df = spark.createDataFrame(rows, "seq long, content string, plain string, key int")
    return sorted((r.first, r.order) for r in format_dups.copies(df, "content", "seq").collect())


def test_formatting_and_field_order(spark):
    rows = [
        (1, "Model: Abc-base; Dataset: Xyz; Value: 52.5"), (2, "- VALUE : 52.5\n- dataset : XYZ\n- model : abc-base"), (3, '{"value": "52.5", "model": "Abc-Base", "dataset": "xyz"}'), (4, "Model: Xyz; Dataset: Abc-base; Value: 52.5"),
        (5, "A plain text, with marks."), (6, "a PLAIN  text\nwith marks"), (7, "with marks a plain text"), (8, None), (9, ""), (10, " .. !"), (11, " - "), (12, "STRASSE"), (13, "Straße"), (14, "model abcbase dataset xyz value 525"),
    ]
    got = groups(spark, [(s, t, "x", 1) for s, t in rows])
    assert got == [(1, 1), (1, 2), (1, 3), (1, 14), (5, 5), (5, 6), (12, 12), (12, 13)]


def test_hot_group_long_text_and_repeats(spark):
    long = "word " * 200_000
    rows = [(i, "Same, text!" if i % 2 else "same text", "", 0) for i in range(600)] + [(700, long, "", 0), (701, long.upper(), "", 0), (701, long.upper(), "", 0)]
    got = groups(spark, rows)
    assert len(got) == 603 and {a for a, _ in got} == {0, 700}
    reps = {r.first: r.n_copies for r in format_dups.representatives(spark.createDataFrame(rows, "seq long, content string, a string, b int"), "content", "seq").collect()}
    assert reps == {0: 600, 700: 3}


def test_empty_table(spark):
    assert groups(spark, []) == []


def test_joined_by_other_forms(spark):
    # One canonical form read as two different lists joins the texts that match either.
    rows = [(1, "Beta: 02; Alpha: 1; Gamma: 3"), (2, "Beta: 02; Alpha: 1 Gamma: 3"), (3, "Alpha: 1 Gamma: 3; Beta: 02"), (4, "Gamma: 3; Beta: 02; Alpha: 1"), (5, "Alpha: 1; Gamma: 4; Beta: 02")]
    assert groups(spark, [(s, t, "x", 1) for s, t in rows]) == [(1, 1), (1, 2), (1, 3), (1, 4)]
    reps = format_dups.representatives(spark.createDataFrame(rows, "seq long, content string"), "content", "seq").collect()
    assert sorted((r.first, r.n_copies) for r in reps) == [(1, 4), (5, 1)]


def test_characters_written_in_other_ways(spark):
    rows = [(1, "Résumé of Ångström"), (2, "Re\u0301sume\u0301 of A\u030angstro\u0308m"), (3, "Ｍｏｄｅｌ：ＡＢＣ１；Ｖａｌｕｅ：３"), (4, "value: 3; model: abc1"), (5, "Resume of Angstrom"), (6, "x² up"), (7, "x2 up"), (8, "각"), (9, "\u1100\u1161\u11a8")]
    assert groups(spark, [(s, t, "x", 1) for s, t in rows]) == [(1, 1), (1, 2), (3, 3), (3, 4), (8, 8), (8, 9)]


def test_hot_groups_join_like_others(spark, monkeypatch):
    rows = [(i, "hot one" if i % 3 == 0 else f"text {i % 40}", "", 0) for i in range(300)]
    want = groups(spark, rows)
    monkeypatch.setattr(format_dups, "HOT_SHARE", 5)  # now only the largest group is hot
    assert groups(spark, rows) == want and len({a for a, _ in want}) > 20


def entity_rows(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [
        ("e", 1, "a", t, "  short   text ", {"x": "N/A", "y": "1"}, ["c1", "c1", " "], "extra"), ("e", 2, "b", t, "short text", {"x": "2", "y": "1"}, ["c1"], "extra"), ("e", 3, None, None, "Unknown.", None, None, None),
        ("f", 4, "a", t, None, {}, [], None), ("f", 5, "zz", t, " - ", {"k": None}, [None, "未知"], None), ("g", 6, "a", t, "alone", {"k": "v"}, ["c"], None), (None, 7, "a", t, "no key", {"k": "v"}, ["c"], None),
    ]
    return spark.createDataFrame(rows, "entity_id string, seq long, llm_model string, extracted_at timestamp, description string, properties map<string,string>, source_chunk_ids array<string>, value string")


def args(spark, df):
    trust = spark.createDataFrame([("a", 10), ("b", 20), ("b", 5)], "llm_model string, trust int")
    return df, "entity_id", "llm_model", "extracted_at", "seq", trust, [best_record.text_field("description"), best_record.map_field("properties"), best_record.list_field("source_chunk_ids")]


def test_best_record_complete(spark):
    won = best_record.winners(*args(spark, entity_rows(spark)), least_rows=2).collect()
    assert {(r.grp, r.field_name, r.ord) for r in won} == {("e", "description", 2), ("e", "properties", 2), ("e", "source_chunk_ids", 2)}


def test_best_record_votes_and_pivot(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("e", 1, "a", t, "common", {}, []), ("e", 2, "a", t, "common", {}, []), ("e", 3, "a", t, "common", {}, []), ("e", 4, "b", t, "a longer one", {}, [])], "entity_id string, seq long, llm_model string, extracted_at timestamp, description string, properties map<string,string>, source_chunk_ids array<string>")
    out = best_record.survivors(*args(spark, df)).collect()
    assert [(r.entity_id, r.description, r.properties) for r in out] == [("e", "common", None)]
    assert best_record.survivors(*args(spark, df.limit(0))).collect() == []


def test_votes_decay_in_whole_numbers(spark):
    ages = spark.range(0, 3000, 7)
    got = [int(r[0]) for r in ages.select(best_record.decay(F.col("id"))).collect()]
    want = [round(2 ** (40 - (a % 365) / 365)) >> (a // 365) for a in range(0, 3000, 7)]
    assert got == want and got[0] == 1 << 40
    t = dt.datetime(2024, 1, 1)
    rows = [("e", 1, "a", dt.datetime(2020, 1, 1), "old", {}, []), ("e", 2, "a", t, "new", {}, []), ("e", 3, "a", None, "older", {}, []), ("e", 4, "a", None, "older", {}, [])]
    df = spark.createDataFrame(rows, "entity_id string, seq long, llm_model string, extracted_at timestamp, description string, properties map<string,string>, source_chunk_ids array<string>")
    assert [r.description for r in best_record.survivors(*args(spark, df)).collect()] == ["new"]


def test_partition_bounds_prune_and_span_batches(spark):
    rows = spark.range(40_000, numPartitions=4).selectExpr("IF(id % 2 = 0, 'hot', concat('g', id % 5000)) AS grp", "cast(id % 10 AS double) / 10 AS score", "id AS at", "cast(id AS string) AS name")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        bounds = {r[0]: tuple(r[1]) for r in top_n.bounds(rows, "grp", "score", 5, ["at"]).collect()}
        got = {(r.name, r.place) for r in top_n.top_n(rows, "grp", "score", 5, [("at", "desc"), ("name", "asc")]).where("grp = 'hot'").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    hot = sorted(((i % 10 / 10, i) for i in range(0, 40_000, 2)), reverse=True)
    assert bounds["hot"] == hot[4] and got == {(str(i), k) for k, (_, i) in enumerate(hot[:5], 1)}


def test_top_n_matches_window(spark):
    rows = [(f"g{i % 7 if i % 3 else 0}", f"t{i:05d}", float(i % 11) / 10 if i % 13 else None, i % 5, "clash") for i in range(4000)] + [(None, "n", 1.0, 1, ""), ("g1", "nan", float("nan"), 1, "")]
    df = spark.createDataFrame(rows, "grp string, id string, score double, at int, _bound string").drop("_bound").repartition(5)
    got = {(r.grp, r.id, r.place) for r in top_n.top_n(df, "grp", "score", 5, [("at", "desc"), ("id", "asc")]).collect()}
    want = set()
    groups_ = {}
    for g, i, s, a, _ in rows:
        if g is not None and s is not None and s == s:
            groups_.setdefault(g, []).append((-s, -a, i))
    for g, xs in groups_.items():
        want |= {(g, x[2], k) for k, x in enumerate(sorted(xs)[:5], 1)}
    assert got == want
    assert top_n.top_n(df.limit(0), "grp", "score", 5, [("id", "asc")]).collect() == []
