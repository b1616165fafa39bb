"""How well held-out texts come back from pages made of them: words misread, words broken at line ends, running headers, page numbers."""

import difflib
import os
import random

import pytest
from pyspark.sql import functions as F

from lattica.llm import scan_repair

DATA = "/root/testdata/sf0.01"


def page(text, rng):
    words = [scan_repair.noisy_word(w, rng) or w if rng.random() < 0.02 and w.isalpha() and len(w) > 3 else w for w in text.split()]
    width, lines, line = rng.randint(55, 72), [], ""
    for w in words:
        room = width - len(line) - 2
        if line and len(line) + 1 + len(w) > width:
            if w.isalpha() and len(w) >= 6 and 2 <= room <= len(w) - 2 and rng.random() < 0.5:
                lines.append(f"{line} {w[:room]}-")
                line = w[room:]
            else:
                lines.append(line)
                line = w
        else:
            line = f"{line} {w}" if line else w
    step, out = rng.randint(5, 8), []
    for i, x in enumerate([*lines, line]):
        if i and i % step == 0:
            out += [str(40 + i), "\fSparse Retrieval Under Noise"]
        out.append(x)
    return "\n".join(out)


def right(a, b):
    a, b = a.split(), b.split()
    return sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()), len(a), len(b)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_held_out_pages_come_back(spark):
    rows = spark.read.parquet(f"{DATA}/chunks.parquet").select(F.lit("chunk").alias("kind"), F.col("seq").alias("id"), F.col("content").alias("text")).where("text IS NOT NULL")
    truth, rng = {}, random.Random(3)
    for r in rows.where("length(text) > 500").orderBy(F.xxhash64("text")).collect():
        longest = max(r.text.split("\n"), key=len)
        if len(longest) > 400 and longest.isascii() and ". " in longest and not scan_repair.wrapped(r.text) and "\f" not in r.text and len(truth) < 60:
            truth[r.id] = longest
    held = spark.createDataFrame([("paper", 10**9 + i, page(t, rng)) for i, t in truth.items()], "kind string, id long, text string")
    repair = scan_repair.Repair(rows.where(~F.col("id").isin(list(truth))).unionByName(held))
    got = {r.id - 10**9: r.text for r in repair.repaired().where("kind = 'paper'").collect()}
    same, want, had = (sum(x) for x in zip(*(right(truth[i], got[i]) for i in truth)))
    assert len(truth) > 30 and same / want > 0.995 and same / had > 0.995 and not any("\n" in t for t in got.values())
