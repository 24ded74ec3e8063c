"""The stored keyword index against BM25 over the texts themselves."""

from __future__ import annotations

import random

import pytest

from quern.operators import search
from quern.operators.keyword_index import KeywordIndex, counted_terms
from quern.operators.snapshots import Conflict

DOCS, ASKED = "doc_id long, text string", "query_id long, text string"


def texts(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(80)]
    out = []
    for i in range(n):
        # neighbours share a topic, so that slots differ
        topic = [f"t{i // 16}{c}" for c in "abc"]
        words = [rng.choice(topic if rng.random() < 0.2 else vocabulary[: rng.choice([5, 80])]) for _ in range(rng.choice([1, 5, 40, 40, 120]))]
        out.append((i, " ".join(words).capitalize() + "."))
    return out + [(n, None), (n + 1, ""), (n + 2, "?!"), (n + 3, out[0][1])]


def asked(spark):
    rng = random.Random(9)
    rows = [(q, " ".join(rng.choice([f"w{rng.randint(0, 9)}", f"t{rng.randint(0, 12)}{rng.choice('abc')}", "nowhere"]) for _ in range(rng.randint(1, 6)))) for q in range(25)]
    return spark.createDataFrame([*rows, (90, None), (91, "nowhere at all"), (92, "w1 w1 w1 w2")], ASKED)


def same(spark, index, docs, queries, k=5, **options):
    got = index.search(queries, k, places=6, **options).collect()
    want = search.bm25(spark.createDataFrame(docs, DOCS), queries, k, places=6).collect()
    key = lambda r: (r.query_id, r.rank, r.chunk_id, round(r.score, 6))
    assert sorted(map(key, got)) == sorted(map(key, want)) and got


def test_counted_terms(spark):
    rows = spark.createDataFrame([(["b", "a", "b", "c", "b"],), (["x"],)], "t array<string>").select(counted_terms("t").alias("c")).collect()
    assert [[tuple(x) for x in r.c] for r in rows] == [[("a", 1), ("b", 3), ("c", 1)], [("x", 1)]]


def test_answers_after_arrivals_deletions_and_merges(spark, tmp_path):
    index, queries = KeywordIndex(spark, f"file://{tmp_path}/index", slot_texts=8, fan=2), asked(spark)
    assert index.search(queries).count() == 0 and index.delete(spark.createDataFrame([(1,)], "doc_id long")) == 1
    live = dict(texts(200, 1))
    index.append(spark.createDataFrame(list(live.items()), DOCS).repartition(3))
    same(spark, index, list(live.items()), queries)
    # an arrival that replaces some texts and brings others
    new = {i + 150: t for i, t in texts(120, 2)}
    new[160] = None
    index.append(spark.createDataFrame(list(new.items()), DOCS))
    live |= new
    same(spark, index, list(live.items()), queries)
    gone = [i for i in live if i % 5 == 2]
    before = index.tables.version()
    index.delete(spark.createDataFrame([(i,) for i in [*gone, gone[0], 10_000]], "doc_id long"))
    left = {i: t for i, t in live.items() if i % 5 != 2}
    same(spark, index, list(left.items()), queries)
    found, counts = index.explain(queries, 3, places=6)
    found.collect()
    counts = counts.first()
    assert 0 < counts.read < counts.asked and counts.held < counts.blocks
    # however many slots are scored at first, the result is the same
    assert sorted(found.collect()) == sorted(index.search(queries, 3, places=6, head=1000).collect())
    # nor does it matter whether the weights are shipped
    index.shipped = -1
    assert sorted((r.query_id, r.rank, r.chunk_id) for r in index.search(queries, 3, places=6).collect()) == sorted((r.query_id, r.rank, r.chunk_id) for r in found.collect())
    index.shipped = 1 << 24
    # an old version answers as it did
    same(spark, index, list(live.items()), queries, version=before)
    # merging changes what is stored and nothing else
    numbers = index.statistics()
    assert numbers["segments"] == 2 and index.merge() == index.tables.version()
    assert index.statistics() == numbers | {"segments": 1} and index.tables.read("dead").count() == 0
    assert numbers["texts"] == sum(1 for t in left.values() if any(c.isalnum() for c in t or "")) == index.live().count()
    same(spark, index, list(left.items()), queries)
    allowed = spark.createDataFrame([(i,) for i in left if i % 2], "doc long")
    got = index.search(queries, 4, places=6, allowed=allowed).collect()
    docs = spark.createDataFrame(list(left.items()), DOCS).selectExpr("*", "doc_id % 2 AS odd")
    want = search.bm25(docs, queries, 4, {"odd": 1}, "pre", places=6).collect()
    assert sorted((r.query_id, r.rank, r.chunk_id) for r in got) == sorted((r.query_id, r.rank, r.chunk_id) for r in want)
    assert index.tables.vacuum() > 0
    same(spark, index, list(left.items()), queries)


def test_arrivals_of_one_id_twice_and_two_writers(spark, tmp_path):
    index = KeywordIndex(spark, f"file://{tmp_path}/index")
    with pytest.raises(ValueError, match="distinct"):
        index.append(spark.createDataFrame([(1, "a"), (1, "b")], DOCS))
    index.append(spark.createDataFrame([(1, "one two")], DOCS))
    other = KeywordIndex(spark, f"file://{tmp_path}/index")
    base = index.tables.parts(0)
    with pytest.raises(Conflict):
        other.tables.commit(0, base)
    assert other.statistics() == {"segments": 1, "texts": 1, "tokens": 2}
