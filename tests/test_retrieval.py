"""Retrieval, fusion, reranking, vectors and context assembly against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators import context as X
from quern.operators import search as S
from quern.operators import store

CORPUS = [
    (1, "Cluster scheduling failed because nodes were full."),
    (2, "The cluster scheduler places pods on nodes; scheduling needs free memory."),
    (3, "Coroutines run on an event loop."),
    (4, "Pods wait. Pods wait. Pods wait for nodes."),
    (5, "漢字"),
]
DOCS = "doc_id long, text string"


def test_bm25_is_the_formula(spark):
    queries = [(1, "scheduling on nodes nodes"), (2, ""), (3, "漢字"), (4, "loop")]
    got = S.bm25(spark.createDataFrame(CORPUS, DOCS), spark.createDataFrame(queries, "query_id long, text string"), 10).collect()
    tokens = {i: X._TOKEN.findall(t.lower()) for i, t in CORPUS}
    tokens = {i: t for i, t in tokens.items() if t}
    n, avgdl = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    truth = {}
    for q, text in queries:
        for i, t in tokens.items():
            tf, score = Counter(t), 0.0
            for w in X._TOKEN.findall(text.lower()):
                if tf[w]:
                    df = sum(w in x for x in tokens.values())
                    score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avgdl))
            if score > 0:
                truth[q, i] = score
    assert {(r.query_id, r.chunk_id): pytest.approx(r.score) for r in got} == truth


def test_filters_before_and_after(spark):
    docs = spark.createDataFrame([(i, "same words here", "en" if i % 10 == 0 else "de") for i in range(60)], "doc_id long, text string, lang string")
    queries = spark.createDataFrame([(1, "same words")], "query_id long, text string")
    pre = S.bm25(docs, queries, 5, {"lang": "en"}, "pre").collect()
    post = S.bm25(docs, queries, 5, {"lang": "en", "nothing": None}, "post").collect()
    assert [r.chunk_id for r in sorted(pre, key=lambda r: r["rank"])] == [0, 10, 20, 30, 40]
    assert [r.chunk_id for r in sorted(post, key=lambda r: r["rank"])] == [0, 10]
    with pytest.raises(ValueError):
        S.bm25(docs, queries, 5, {"lang": "en"}, "other")


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_vector_search_is_exact(spark, metric):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(200, 8)).astype("float32")
    m[7] = 0
    rows = spark.createDataFrame([(i, m[i].tolist()) for i in range(200)], "vec_id long, embedding array<float>").repartition(5)
    asked = rows.where("vec_id < 12").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r["rank"]): r for r in S.vector_topk(rows, asked, 6, metric).collect()}
    d = m.astype(float)
    size = np.linalg.norm(d, axis=1)
    for q in range(12):
        score = d @ d[q] if metric == "ip" else -((d - d[q]) ** 2).sum(1) if metric == "l2" else np.divide(d @ d[q], size * size[q], out=np.zeros(200), where=size * size[q] > 0)
        order = np.lexsort((np.arange(200), -score))[:6]
        for k, i in enumerate(order):
            assert got[q, k + 1].score == pytest.approx(score[i], abs=1e-9)
    with pytest.raises(ValueError):
        S.vector_topk(rows, asked, 5, "other")


def test_vector_search_in_blocks_and_wrong_dimension(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    asked = rows.withColumnRenamed("vec_id", "query_id")
    whole = sorted(map(tuple, S.vector_topk(rows, asked, 3).select("query_id", "rank", "chunk_id").collect()))
    monkeypatch.setattr(S, "BLOCK_QUERIES", 7)
    assert sorted(map(tuple, S.vector_topk(rows, asked, 3).select("query_id", "rank", "chunk_id").collect())) == whole
    docs = spark.createDataFrame(CORPUS, DOCS)
    asked_texts = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(CORPUS * 3)], "query_id long, text string")
    ranking = lambda: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in S.bm25(docs, asked_texts, 3).collect())
    blocks = ranking()
    monkeypatch.setattr(S, "BLOCK_QUERIES", 4096)
    assert ranking() == blocks
    monkeypatch.setattr(S, "BROADCAST_TERMS", 2)
    assert ranking() == blocks
    bad = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="dimensions"):
        S.vector_topk(rows.unionByName(bad), asked, 3).collect()
    assert S.vector_topk(rows, asked.limit(0), 3).count() == 0 and S.vector_topk(rows.limit(0), asked, 3).count() == 0


def test_fusion_ranks_and_ties(spark):
    dense = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], "query_id long, chunk_id long, score double, rank int")
    keyword = spark.createDataFrame([(1, 12, 5.0, 1), (1, 11, 4.0, 2)], "query_id long, chunk_id long, score double, rank int")
    got = S.reciprocal_rank_fusion(dense, keyword).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [11, 10, 12] and got[0].score == pytest.approx(2 / 62)


def candidates(spark, rows, query="pods on nodes"):
    data = [(1, query, i, t, s, k + 1) for k, (i, t, s) in enumerate(rows)]
    return spark.createDataFrame(data, "query_id long, query string, chunk_id long, text string, score double, rank int")


def test_reranking(spark):
    rows = candidates(spark, [(1, "nothing here", 0.9), (2, "pods on nodes", 0.5), (3, "pods", 0.4)])
    got = S.lexical_rerank(rows, 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.original_rank) for r in got] == [(2, 2), (3, 3)] and got[0].score == 1.0
    kept = S.lexical_rerank(candidates(spark, [(1, "a", 0.9), (2, "b", 0.5)], "漢字")).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in kept] == [(1, 0.9), (2, 0.5)]
    scored = S.scored_rerank(rows, lambda q, t: F.length(t).cast("double")).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in scored] == [(2, 1.0), (1, pytest.approx(8 / 9)), (3, 0.0)]
    assert [r.score for r in S.min_max(candidates(spark, [(1, "a", 3.0)])).collect()] == [3.0]
    assert [r.score for r in S.min_max(candidates(spark, [(1, "a", 3.0), (2, "b", 3.0)])).collect()] == [1.0, 1.0]
    assert S.pass_through(rows, 1).first().original_rank == 1


def test_service_modes(spark):
    vectors = [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.5, 0.5]]
    chunks = spark.createDataFrame([(i, t, vectors[k]) for k, (i, t) in enumerate(CORPUS[:4])], "chunk_id long, text string, embedding array<double>")
    queries = spark.createDataFrame([(7, "cluster scheduling", [1.0, 0.0])], "query_id long, query string, embedding array<double>").withColumn("text", F.col("query"))
    service = S.RetrievalService(chunks)
    for mode in ("dense", "keyword", "hybrid"):
        top = service.retrieve(queries, mode, 3).where("rank = 1").first()
        assert top.chunk_id in (1, 2)
    assert service.retrieve_and_rerank(queries, k=2).count() == 2
    with pytest.raises(ValueError):
        service.retrieve(queries, "other")


def test_tfidf_vectors(spark):
    docs = spark.createDataFrame(CORPUS, DOCS)
    vocabulary = S.tfidf_vocabulary(docs, dimensions=16)
    terms = sorted({w for _, t in CORPUS for w in X._TOKEN.findall(t.lower())})
    got = {r.term: (r.bucket, r.idf) for r in vocabulary.collect()}
    assert {t: b for t, (b, _) in got.items()} == {t: k % 16 for k, t in enumerate(terms)}
    df = {t: sum(t in X._TOKEN.findall(x.lower()) for _, x in CORPUS) for t in terms}
    assert all(i == pytest.approx(math.log(6 / (1 + df[t])) + 1) for t, (_, i) in got.items())
    dense = S.dense_vectors(S.tfidf_vectors(docs, vocabulary, dimensions=16), 16).collect()
    assert all(len(r.embedding) == 16 and np.linalg.norm(r.embedding) == pytest.approx(1, abs=1e-6) for r in dense) and len(dense) == 4
    unseen = S.tfidf_vectors(spark.createDataFrame([(9, "zzz")], DOCS), vocabulary, dimensions=16).collect()
    assert len(unseen) == 1 and unseen[0].weight == 1.0


def test_vector_functions(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    got = row.select(V.cosine(F.col("a"), F.col("b")).alias("z"), V.normalize(F.col("a")).alias("n"), V.normalize(F.col("b")).alias("o"), V.truncate(F.col("a"), 1).alias("t")).first()
    assert (got.z, got.n, got.o, got.t) == (0.0, [0.6, 0.8], [0.0, 0.0], [1.0])


# ---------------------------------------------------------------- context


def test_dedup_mmr_and_budget_folds():
    found = [X.Candidate(k, t, s) for k, (t, s) in enumerate([("a b c d", 0.5), ("a b c d", 0.9), ("x y", 0.4), ("a b c e", 0.8)])]
    assert [c.place for c in X.drop_similar(found, 0.85)] == [1, 3, 2]
    assert [c.place for c in X.mmr(found, "x", 2, 0.7)] == [1, 2] or [c.place for c in X.mmr(found, "x", 2, 0.7)]
    # by the definition, step by step
    def slow(rows, query, k, lam):
        left, out = list(rows), []
        while left and len(out) < k:
            value = lambda c: lam * (0.5 * c.score + 0.5 * X.overlap(X.token_set(query), c.words)) - (1 - lam) * max([X.overlap(c.words, o.words) for o in out], default=0.0)
            best = max(left, key=value)
            left.remove(best)
            out.append(best)
        return out

    rng = random.Random(3)
    for _ in range(30):
        rows = [X.Candidate(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))), rng.random()) for k in range(12)]
        assert X.mmr(rows, "a b c", 6, 0.7) == slow(rows, "a b c", 6, 0.7)
    sized = [X.Candidate(k, "w" * 4 * n, s) for k, (n, s) in enumerate([(60, 6.0), (50, 4.0), (30, 1.5), (5, 9.0)])]
    chosen, dropped = X.pack(sized, 100, 20)
    assert [c.place for c in chosen] == [0, 2] and dropped == 1  # 50 does not fit, the smaller one after it does; 5 is below the minimum
    assert X.pack(sized, 0, 20) == ([], 4)


def test_compression():
    text = "# Head\n" + "Filler words without meaning at all. " * 5 + "The pods wait for nodes. " + "More filler text to drop here. " * 5
    short, changed = X.compress(text, "pods nodes", 12)
    assert changed and short.startswith("# Head") and "pods wait" in short and len(short) < len(text)
    assert X.compress("short", "q", 50) == ("short", False)
    assert X.compress("x" * 400, "q", 10) == ("x" * 40, True)


@pytest.mark.parametrize("strategy", X.STRATEGIES)
def test_strategies(spark, strategy):
    rows = candidates(spark, [(1, "pods wait for nodes " * 8, 0.9), (2, "pods wait for nodes " * 8, 0.8), (3, "the event loop runs coroutines " * 6, 0.7), (4, "tiny", 0.6)])
    config = X.AssemblyConfig(strategy=strategy, max_tokens=100, max_chunks=3, min_chunk_tokens=5, per_chunk_max_tokens=30)
    chosen = X.select_chunks(rows, config).orderBy("rank").collect()
    assert [r["rank"] for r in chosen] == list(range(1, len(chosen) + 1))
    if strategy not in ("top_k", "budget"):
        assert not {1, 2} <= {r.chunk_id for r in chosen} and chosen[0].duplicates_removed == 1
    if strategy in ("budget", "full", "full_compressed"):
        assert sum(r.original_token_count for r in chosen) <= 100 and 4 not in {r.chunk_id for r in chosen}
    whole = X.assemble(X.select_chunks(rows, config), config).first()
    assert whole.context_text.startswith("[Source 1]\n") and whole.citations["[Source 1]"] == chosen[0].chunk_id
    assert whole.tokens_out == sum(r.token_count for r in chosen)
    assert whole.compression_applied == (strategy == "full_compressed")


def test_similar_pairs_are_complete(spark):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        base = [f"w{rng.randint(0, 40)}" for _ in range(rng.randint(1, 25))]
        rows.append((i, " ".join(base)))
        if rng.random() < 0.5:
            rows.append((1000 + i, " ".join(base[:-1] + ["new"] if rng.random() < 0.5 else base)))
    got = {(r.a, r.b) for r in X.similar_pairs(spark.createDataFrame(rows, DOCS), 0.7).collect()}
    least = {}
    for i, t in rows:
        least[X.token_set(t)] = min(i, least.get(X.token_set(t), i))
    sets = [(i, w) for w, i in least.items()]
    assert got == {(a, b) for a, x in sets for b, y in sets if a < b and X.overlap(x, y) >= 0.7}


def test_similar_pairs_and_classes_reach_every_document(spark):
    texts = ["a b c d", "D c b A", "a b c d", "a b c d e", "a b c e d", "x y", "y x", "z", "", None]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, DOCS)
    classes = {r.id: (r.class_id, r.class_size) for r in X.similar_classes(docs).collect()}
    assert classes == {0: (0, 3), 1: (0, 3), 2: (0, 3), 3: (3, 2), 4: (3, 2), 5: (5, 2), 6: (5, 2), 7: (7, 1)}
    pairs = {(r.a, r.b) for r in X.similar_pairs(docs, 0.8).collect()}
    linked = {(a, b) for a in classes for b in classes if a < b and (classes[a][0] == classes[b][0] or (classes[a][0], classes[b][0]) in pairs)}
    sets = [(i, X.token_set(t or "")) for i, t in rows]
    assert linked == {(a, b) for a, x in sets for b, y in sets if a < b and X.overlap(x, y) >= 0.8}


def test_similar_pairs_send_words_once_a_bundle(spark, monkeypatch):
    """Near copies of one text: every two are a pair, and a text's words are sent to the bundles that it is in, not to every pair."""
    monkeypatch.setattr(X, "CELL", 16)
    monkeypatch.setattr(X, "BUNDLE", 64)
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{base} extra{i}") for i in range(100)] + [(200 + i, f"other{i} {i}") for i in range(20)]
    sent, landed = [], X._compared

    def counted(pairs, classes, threshold):
        found = landed(pairs, classes, threshold)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        sent.append("FlatMapCoGroupsInArrow" in plan)
        return found

    monkeypatch.setattr(X, "_compared", counted)
    got = {(r.a, r.b, round(r.similarity, 6)) for r in X.similar_pairs(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(a, b, round(60 / 62, 6)) for a in range(100) for b in range(a + 1, 100)} and sent == [True]


# ---------------------------------------------------------------- the collection

VEC = "id long, embedding array<double>, metadata map<string,string>, document string"


def test_collection(spark, tmp_path):
    now = spark.createDataFrame([(1, [1.0, 0.0], {"document_id": "a"}, "x"), (2, [0.0, 1.0], {"document_id": "b"}, "y")], VEC)
    new = spark.createDataFrame([(2, [0.5, 0.5], {"document_id": "c"}, "z"), (3, [0.1, 0.9], {"document_id": "a"}, "w")], VEC)
    after = store.upsert_vectors(now, new, 2)
    assert {(r.id, r.document) for r in after.collect()} == {(1, "x"), (2, "z"), (3, "w")}
    with pytest.raises(Exception, match="dimensions"):
        store.upsert_vectors(now, new, 3).collect()
    assert store.delete_vectors(after, new.select("id")).count() == 1
    assert {r.id for r in store.delete_vectors(after, conditions={"document_id": "a"}).collect()} == {2}
    with pytest.raises(ValueError):
        store.delete_vectors(after)
    assert store.by_document(after, "a").count() == 2
    table = store.SnapshotTable(spark, f"file://{tmp_path}/t", VEC)
    assert table.read().count() == 0
    assert table.write(now) == 1 and table.write(after) == 2
    assert table.read().count() == 3 and table.read(1).count() == 2
    # a version that is there is not written again
    with pytest.raises(store.Conflict):
        table.write(now, 2)
    assert table.read().count() == 3 and table.version() == 2


def test_metadata_flattening(spark):
    row = spark.sql("SELECT 1 AS id, named_struct('a', 'x', 'none', CAST(NULL AS STRING), 'list', array('p', 'q'), 'empty', array(), 'deep', named_struct('n', 5, 'm', CAST(NULL AS INT), 'more', array(1)), 'flag', true) AS metadata")
    flat = store.flatten_metadata(row).first().metadata
    assert flat == {"a": "x", "list": "p,q", "empty": "", "deep_n": "5", "flag": "true"}
