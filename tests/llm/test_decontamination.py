"""Winnowing against plain Python."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import decontamination
from tests.llm.helpers import corpus, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string, id string, row string, fp string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def truth(rows, items, width=10):
    windows = defaultdict(set)
    for i, text in items:
        w = words(text)
        t = min(width, len(w))
        for k in range(len(w) - t + 1 if w else 0):
            windows[tuple(w[k : k + t])].add(i)
    out = []
    for i, text in rows:
        w, hit, named = words(text), set(), set()
        for t in {len(x) for x in windows}:
            for k in range(len(w) - t + 1):
                if tuple(w[k : k + t]) in windows:
                    hit.update(range(k, k + t))
                    named |= windows[tuple(w[k : k + t])]
        out.append((i, len(w), len(hit), tuple(sorted(str(x) for x in named if x is not None))))
    return sorted(out, key=repr), {(i, n) for i, n, h, _ in out if h}


def planted(seed=5):
    """Documents with whole items, parts of items just long enough and just too short, and short items."""
    rng = random.Random(seed)
    rows = corpus(40, seed)
    texts = [" ".join(rng.choice("the of and in to a is on as was eth ann".split()) + rng.choice(["", "", "x", "é", "9"]) for _ in range(rng.randint(10, 40))) for _ in range(12)]
    items = list(enumerate(texts)) + [(20, "Only Four-words here"), (21, "zyx"), (22, None), (23, "... !!"), (24, texts[0]), (None, texts[1]), (3, texts[3])]
    for k in range(40, 90):
        w = words(rng.choice(texts))
        at, size = rng.randrange(len(w) - 9), rng.choice([9, 10, 11, 30])
        part = "; ".join(w[at : at + size]).upper()
        rows.append((100 + k, f"{rng.choice(rows)[1] or ''} {part} {rng.choice(['', 'only FOUR words', 'Only four words here', 'zyx!', part])} tail"))
    rows += [(7, texts[2]), (7, texts[2]), (None, texts[2]), (400, "a" * 100_000), (401, " ".join([texts[4]] * 300)), (402, "only four words here\x00only four words here")]
    return rows, items


@pytest.mark.parametrize("limit", [1 << 24, 0])
def test_contamination_against_brute_force(spark, limit):
    rows, items = planted()
    bench = spark.createDataFrame([(i, t, "id", "row", "fp") for i, t in items], ITEMS)
    docs = documents(spark, rows)
    got = sorted(((r.id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontamination.contamination(docs, bench, limit=limit).collect()), key=repr)
    want, bad = truth(rows, items)
    assert got == want
    assert bad and len(bad) < len(rows)
    kept = decontamination.drop_contaminated(docs, bench, limit=limit)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(((i, t) for (i, t) in rows if (i, len(words(t))) not in bad), key=repr)


def test_spans_are_whole_runs_of_covered_words(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, f"zero {item} thirteen {item}"), (2, f"{item} {item}"), (3, "one two three"), (4, None)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = sorted(tuple(r) for r in decontamination.spans(documents(spark, rows), bench).collect())
    assert got == [(1, 1, 13), (1, 14, 26), (2, 0, 24)]


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(documents(spark, []), bench).count() == 0
    rows = decontamination.contamination(documents(spark, [(1, "some words"), (2, None)]), bench).collect()
    assert {(r.id, r.n_words, r.n_hit, tuple(r["items"])) for r in rows} == {(1, 2, 0, ()), (2, 0, 0, ())}
    full = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert decontamination.contamination(documents(spark, []), full).count() == 0


def test_every_window_of_the_winnowed_layer_keeps_its_smallest_gram(spark):
    text = " ".join(str(k * k % 17) for k in range(60))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("row", F.lit(1))
    runs = decontamination.fingerprints(docs, [10], "row").where("fp is not null").orderBy("first").collect()
    assert [r.first for r in runs] == [0, *(r.last + 1 for r in runs[:-1])] and runs[-1].last == 50
    w = text.split()
    grams = [tuple(w[k : k + 5]) for k in range(56)]
    h = {tuple(r.w): r.h for r in spark.createDataFrame([(list(g),) for g in set(grams)], "w array<string>").select("w", F.xxhash64(F.lit(10), *(F.xxhash64(F.col("w")[j]) for j in range(5))).alias("h")).collect()}
    for r in runs:
        for at in range(r.first, r.last + 1):
            assert r.fp == min(h[g] for g in grams[at : at + 6])
