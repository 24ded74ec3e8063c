"""Embedding backends, language-model clients and the whole evaluation."""

from __future__ import annotations

import hmac
import http.server
import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import answers, context, embedding, ingest, language, platform, quality, search, store
from quern.operators.http_model import HttpModel
from quern.sources import readers


def test_embedding(spark):
    rows = spark.createDataFrame([(1, "pods wait"), (2, None), (3, "pods wait")], "id long, text string")
    model = embedding.MODELS["hashed-tfidf"]
    got = {r.id: r.embedding for r in embedding.embed(rows, model).collect()}
    assert all(len(v) == 768 for v in got.values()) and got[1] == got[3] and np.linalg.norm(got[1]) == pytest.approx(1) and not any(got[2])
    short = embedding.MODELS["nomic-embed-text"].shortened(2)
    seen = embedding.embed(rows, short, lambda: lambda texts: np.array([[len(t), 1.0, 9.0] for t in texts]), query=True).where("id = 2").first().embedding
    assert seen == pytest.approx((np.array([14, 1]) / np.hypot(14, 1)).tolist())
    with pytest.raises(ValueError):
        embedding.MODELS["all-MiniLM-L6-v2"].shortened(100)
    with pytest.raises(Exception, match="dimensions"):
        embedding.embed(rows, model, lambda: lambda texts: np.ones((len(texts), 3))).collect()
    assert model.fits(10**6) and not embedding.MODELS["all-MiniLM-L6-v2"].fits(257)
    assert embedding.fits(spark.createDataFrame([(300,)], "token_count int"), embedding.MODELS["all-MiniLM-L6-v2"]).first().fits is False


class Service(http.server.BaseHTTPRequestHandler):
    """A model server that embeds by length and repeats what it is told, and a listing that refuses twice."""

    refusals = 2

    def log_message(self, *args):
        pass

    def _json(self, *parts, status=200, headers=()):
        self.send_response(status)
        for k, v in headers:
            self.send_header(k, v)
        self.end_headers()
        for p in parts:
            self.wfile.write((json.dumps(p) + "\n").encode())

    def do_GET(self):
        if self.path == "/api/tags":
            return self._json({"models": [{"name": "m:latest"}]})
        if Service.refusals:
            Service.refusals -= 1
            return self._json({}, status=429 if Service.refusals else 403, headers=[("Retry-After", "0.05")])
        return self._json([{"id": 1}, {"id": 2, "pull_request": {}}])

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path == "/api/embeddings":
            return self._json({"embedding": [float(len(asked["prompt"])), 1.0]})
        said = asked["messages"][-1]["content"]
        if asked["stream"]:
            return self._json(*({"message": {"content": c}, "done": False} for c in said), {"done": True})
        return self._json({"message": {"content": said.upper()}})


@pytest.fixture(scope="module")
def service():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_models_over_http(spark, service):
    model = HttpModel(service, "m")
    assert model.available() and not HttpModel(service, "n").available() and not HttpModel("http://127.0.0.1:9", "m", 1).available()
    assert "".join(model.stream([{"role": "user", "content": "piece by piece"}])) == "piece by piece"
    rows = spark.createDataFrame([(1, "four"), (2, "")], "id long, text string")
    two = embedding.EmbeddingModel("m", 2, 100)
    got = {r.id: r.embedding for r in embedding.embed(rows, two, lambda: HttpModel(service, "m").embed, normalize=False).collect()}
    assert got == {1: [4.0, 1.0], 2: [0.0, 1.0]}
    prompts = rows.select(answers.messages(F.lit("c"), F.col("text")).alias("messages"))
    assert all("QUESTION" in r.answer for r in language.generate(prompts, lambda: HttpModel(service, "m").chat).collect())


def test_refused_pages_are_asked_for_again(spark, service):
    readers.register(spark)
    rows = spark.read.format("paged_json").option("urls", f"{service}/items").load().collect()
    assert [json.loads(r.payload)["id"] for r in rows] == [1] and Service.refusals == 0
    assert readers.retry_wait(500, {}, 0, 0) is None and readers.retry_wait(403, {}, 0, 0) is None and readers.retry_wait(429, {}, 0, 5) is None
    assert readers.retry_wait(429, {}, 0, 2) == 4.0 and readers.retry_wait(403, {"X-RateLimit-Remaining": "0", "X-RateLimit-Reset": "30"}, 10, 0) == 20.0


def test_signatures(spark):
    body = "a body with ü"
    for secret in ("short", "long " * 40):
        right = "sha256=" + hmac.new(secret.encode(), body.encode(), "sha256").hexdigest()
        row = spark.range(1).select(*(ingest.signature_ok(F.lit(body), F.lit(x), secret).alias(n) for n, x in (("good", right), ("upper", right.upper()), ("bad", right[:-1]), ("none", None)))).first()
        assert (row.good, row.upper, row.bad, row.none) == (True, True, False, False)
    assert spark.range(1).select(ingest.signature_ok(F.lit(body), F.lit(None), None)).first()[0]


def test_questions_see_their_document_alone(spark, corpus):
    chunks, questions = corpus
    chunks = chunks.withColumn("document_id", F.when(F.col("chunk_id") == 1, "one").otherwise("two"))
    asked = questions.withColumn("document_id", F.when(F.col("query_id") % 3 == 0, None).when(F.col("query_id") % 3 == 1, "one").otherwise("two"))
    for mode in ("dense", "keyword", "hybrid"):
        found = search.RetrievalService(chunks, scope="document_id").retrieve(asked, mode, 5)
        seen = {(r.query_id % 3, r.chunk_id) for r in found.collect()}
        assert {c for q, c in seen if q == 1} == {1} and {c for q, c in seen if q == 2} == {2} and {c for q, c in seen if q == 0} == {1, 2}


def test_indexing_is_one_step(spark):
    model = embedding.EmbeddingModel("sizes", 2, 100)
    make = lambda: lambda texts: np.array([[len(t), 1.0] for t in texts], float)
    chunks = spark.createDataFrame([("d1", "d1:0", "aaa"), ("d1", "d1:1", "bb"), ("d2", "d2:0", "c")], "document_id string, chunk_id string, text string")
    empty = spark.createDataFrame([], "id string, embedding array<float>, metadata map<string,string>, document string")
    first, marked, counts = store.index_documents(empty, chunks, model, make)
    assert counts.first() == (3, 0) and marked.where("indexed").count() == 3 and store.statistics(first).first() == (3, 2, 2)
    again, _, counts = store.index_documents(first, chunks.where("chunk_id = 'd1:1'"), model, make)
    assert counts.first() == (1, 2) and {r.id for r in again.collect()} == {"d1:1", "d2:0"}
    left, removed = store.remove_documents(again, spark.createDataFrame([("d2",)], "document_id string"))
    assert removed.first().removed == 1 and {r.id for r in left.collect()} == {"d1:1"}
    with pytest.raises(Exception, match="dimensions"):
        store.index_documents(empty, chunks, embedding.EmbeddingModel("short", 3, 100), make)


def test_inferred_sources_and_chunk_benchmark(spark):
    samples = readers.chunking_questions(spark).select(F.substring("sample_id", 2, 2).cast("long").alias("query_id"), F.col("question").alias("query"), "ground_truth", F.col("reference_context").alias("reference"), "document_id")
    sources = {r.document_id: r.text for r in quality.infer_sources(samples).collect()}
    assert sources["outage"].startswith("Requests timed out in the evening.\n\nThe queue grew for an hour.\n\nThe queue grew") and set(sources) == {"outage", "release"}
    rows = platform.chunking_benchmark(samples, [("recursive", 16, 2), ("recursive", 64, 4), ("recursive", 8, 9)], min_chunk_size=4).collect()
    assert [r.chunk_size for r in rows] == [16, 64] and rows[0].total_chunks > rows[1].total_chunks
    assert all(0 < r.context_recall <= 1 and r.f1 == pytest.approx(2 * r.context_precision * r.context_recall / (r.context_precision + r.context_recall)) for r in rows)


@pytest.fixture(scope="module")
def corpus(spark):
    chunks = readers.sample_corpus(spark).select(F.when(F.col("doc_id") == "async-guide", 2).otherwise(1).cast("long").alias("chunk_id"), "text")
    questions = readers.sample_questions(spark).select(F.substring("sample_id", 2, 2).cast("long").alias("query_id"), F.col("question").alias("query"), F.col("reference_context").alias("reference"))
    model = embedding.MODELS["hashed-tfidf"]
    return embedding.embed(chunks, model), embedding.embed(questions, model, text_col="query", query=True)


def test_clients(spark, corpus):
    chunks, questions = corpus
    found = search.lexical_rerank(search.RetrievalService(chunks).candidates(questions, search.bm25(chunks, questions, 2, doc_id="chunk_id", query_text="query")), 2)
    chosen = context.select_chunks(found)
    whole = context.assemble(chosen)
    done = language.answer_with(questions.select("query_id", "query"), whole, chosen, lambda: lambda m: f"Reply to {m[1]['content'][:8]} [1].")
    assert {r.answer for r in done.collect()} == {"Reply to Sources: [Source 1]."}
    claims = spark.createDataFrame([(1, "q", "Pods wait for nodes [Source 1]. Something else entirely [Source 1].")], "query_id long, query string, answer string")
    sources = spark.createDataFrame([(1, 1, 1, "Pods wait for nodes")], "query_id long, rank int, chunk_id long, text string")

    def make():
        def client(messages):
            if "else" in messages[0]["content"]:
                raise RuntimeError("service down")
            return "It contradicts."

        return client

    labels = {r.claim_index: r.label for r in answers.judge_claims(claims, sources, language.judge(make)).collect()}
    assert labels == {0: "CONTRADICTS", 1: "NEUTRAL"}
    ranked = search.scored_rerank(found, language.pair_scorer(lambda: lambda pairs: [len(t) for _, t in pairs]), 1).collect()
    assert all(r.score in (0.0, 1.0) or r.score > 1 for r in ranked)
    styles = language.compare_styles(questions.select("query_id", "query"), whole, chosen, lambda: lambda m: answers.REFUSAL)
    assert {r.style: r["count"] for r in styles.where("refused").groupBy("style").count().collect()} == dict.fromkeys(("citation_aware", "concise", "detailed"), questions.count())


def test_whole_evaluation(spark, corpus):
    setups = (platform.ABLATION[0], platform.ABLATION[2])
    result = platform.ablation(*corpus, setups)
    means = {(r.config, r.metric): r.value for r in result.averages().collect()}
    assert {c for c, _ in means} == {s.name for s in setups}
    assert means["production", "retrieval_recall"] == 1.0 and means["bm25_only", "retrieval_mrr"] == 1.0 and means["production", "adversarial_pass_rate"] == 1.0
    assert result.distributions().where("metric = 'faithfulness' and config = 'production'").first()["count"] == corpus[1].count()
    assert {m for c, m in means if m.endswith("_ms")} == {"retrieval_latency_ms", "rerank_latency_ms", "context_latency_ms", "generation_latency_ms", "e2e_latency_p95_ms"}
    verdicts = {r.config: r.verdict for r in quality.gate_verdict(result.gate(quality.thresholds(spark)), ["config"]).collect()}
    assert set(verdicts) == {s.name for s in setups} and set(verdicts.values()) <= {"pass", "warning", "fail"}
    assert [r.place for r in result.ranking().orderBy("place").collect()] == [1, 2]
    tasks = spark.createDataFrame([(1, "incident_rca"), (2, "incident_resolution"), (3, "how_to")], "query_id long, task_type string")
    assert platform.by_task(result, tasks).select("task_type").distinct().count() == 3
    one = platform.Evaluation(*(getattr(result, f).where("config = 'production'") for f in ("metrics", "answers", "probes")))
    feed = platform.failures(one, corpus[1], 1.1, 1.1)
    assert {r.failure_metric for r in feed.collect()} == {"faithfulness"}
    result.release()


def test_lookups_and_retries(spark):
    versions = spark.createDataFrame([("d", "v1", 1, False), ("d", "v2", 2, True)], "document_id string, version_id string, version_index int, is_active boolean")
    chunks = spark.createDataFrame([("d", "v1", 0), ("d", "v2", 1), ("d", "v2", 0)], "document_id string, version_id string, chunk_index int")
    assert [r.chunk_index for r in ingest.chunks_of_document(chunks, versions, "d").collect()] == [0, 1]
    assert ingest.chunks_of_document(chunks, versions, "d", False).count() == 3 and ingest.delete_version_chunks(chunks, "v2").count() == 1
    assert ingest.active_version(versions, "d").first().version_id == "v2" and ingest.exists(chunks, "version_id", "v1") and not ingest.exists(chunks, "version_id", "x")
    docs = spark.createDataFrame([("d", "u")], "document_id string, source_uri string")
    assert ingest.document(docs, "d").count() == ingest.document(docs, source_uri="u").count() == 1
    payloads = spark.createDataFrame([("d", 1), ("d", 2)], "document_id string, received_at int")
    assert ingest.latest_payload(payloads, "d").first().received_at == 2
    got = spark.sql("SELECT explode(array('transient_network', 'internal_unexpected')) AS c").select(ingest.retry_after(F.col("c"), F.lit(1)).alias("r")).collect()
    assert [r.r for r in got] == [60, None]
