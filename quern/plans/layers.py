"""Queries of whole layers: evaluation runs, benchmarks, indexing, files written and read again, look-ups, the ingestion stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import chunking, embedding, ingest, ops, platform, quality, search, store
from quern.operators.staging import scratch_folder, stored
from quern.plans import answering as A
from quern.plans import chunk_sql as S
from quern.plans.common import BLANKS, Catalog, rounded, table
from quern.plans.evaluation import _LEVEL, _LIMITS, _RELEVANT, _corpus, _metrics_sql, _samples
from quern.plans.operations import _PAYLOADS, OPERATIONS, _guided, _runs, payloads
from quern.plans.search import _WORDS, _asked, _hybrid_ctes, _service, bm25_ctes, candidates, jaccard_sql, top
from quern.sources import readers
from quern.streaming.pipelines import IngestionStream

LAYERS = Catalog()

# ---------------------------------------------------------------- the evaluation run


def _evaluated(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    samples = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.array("text").alias("reference"))
    return platform.evaluate(chunks, samples, platform.Setup("keyword", "keyword", places=6))


_GROUNDED = A.ANSWERING.sql["grounded_answers"]
_SCORES = f"""{_RELEVANT}, {bm25_ctes()}, few AS ({top('bm25', 20)}), {_metrics_sql('few')}, said AS MATERIALIZED (SELECT * FROM ({_GROUNDED})),
    score AS (SELECT query_id, metric, value FROM (UNPIVOT (SELECT query_id, recall AS retrieval_recall, precision AS retrieval_precision, mrr AS retrieval_mrr FROM metric) ON retrieval_recall, retrieval_precision, retrieval_mrr INTO NAME metric VALUE value)
        UNION ALL SELECT query_id, metric, value FROM (UNPIVOT (SELECT query_id, faithfulness::DOUBLE AS faithfulness, citation_precision::DOUBLE AS citation_precision, hallucination_rate::DOUBLE AS hallucination_rate, answer_relevancy::DOUBLE AS answer_relevancy FROM said) ON faithfulness, citation_precision, hallucination_rate, answer_relevancy INTO NAME metric VALUE value))"""
_MEASURED = ("retrieval_recall", "retrieval_precision", "retrieval_mrr", "faithfulness", "citation_precision", "hallucination_rate", "answer_relevancy")


@LAYERS.add(f"WITH {_SCORES} SELECT metric, round(avg(value), 5) AS value FROM score GROUP BY metric")
def evaluation_averages(spark, sf_dir):
    """Averages of retrieval and answers over all passages, from one run of the platform."""
    run = _evaluated(spark, sf_dir)
    rows = stored(run.averages().where(F.col("metric").isin(*_MEASURED)).select("metric", rounded("value", 5).alias("value")))
    run.release()
    return rows


@LAYERS.add(
    f"""WITH {_SCORES}, {_LIMITS}, m AS (SELECT metric, avg(value) AS value, quantile_cont(value, 0.1) AS p10 FROM score GROUP BY metric), l AS (SELECT metric, {_LEVEL.format(v='p10')} = 'critical' AS tail_critical, {_LEVEL.format(v='value')} AS own FROM m JOIN limits USING (metric))
    SELECT metric, CASE WHEN tail_critical THEN 'critical' ELSE own END AS level, CASE WHEN tail_critical OR own = 'critical' THEN 'fail' WHEN own = 'warning' THEN 'warning' ELSE 'pass' END AS verdict, tail_critical FROM l"""
)
def evaluation_gate(spark, sf_dir):
    """The gate over the run's own averages and tails."""
    run = _evaluated(spark, sf_dir)
    rows = stored(run.gate(quality.thresholds(spark)).where(F.col("metric").isin(*_MEASURED)).select("metric", "level", "verdict", "tail_critical"))
    run.release()
    return rows


@LAYERS.add("SELECT 'keyword' AS config, unnest(['retrieval_latency_ms', 'rerank_latency_ms', 'context_latency_ms', 'generation_latency_ms', 'e2e_latency_p95_ms']) AS metric, true AS measured")
def evaluation_latencies(spark, sf_dir):
    """That every layer was timed; the times themselves differ from run to run."""
    run = _evaluated(spark, sf_dir)
    run.release()
    return run.latencies().select("config", "metric", (F.col("value") > 0).alias("measured"))


@LAYERS.add(f"WITH p AS ({A.ANSWERING.sql['canary_probe']}) SELECT count(*) AS probes, round(avg(passed::INTEGER), 6) AS adversarial_pass_rate, sum(canary_detected::INTEGER)::BIGINT AS detected FROM p")
def adversarial_pass_rate(spark, sf_dir):
    probes = A.canary_probe(spark, sf_dir)
    return probes.agg(F.count(F.lit(1)).alias("probes"), rounded(F.avg(F.col("passed").cast("double"))).alias("adversarial_pass_rate"), F.count_if("canary_detected").alias("detected"))


# ---------------------------------------------------------------- benchmarks

_MODES = f"""{_hybrid_ctes(10)}, found AS MATERIALIZED (SELECT 'dense' AS mode, query_id, chunk_id, rank FROM dense WHERE rank <= 10 UNION ALL SELECT 'keyword', query_id, chunk_id, rank FROM keyword WHERE rank <= 10 UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM hybrid)"""


def _mode_metrics(name: str, source: str) -> str:
    """MRR and NDCG at 5 of (run, query_id, chunk_id, rank), a row for each run and passage."""
    return f"""{name} AS (SELECT r.run, b.item_id AS query_id, coalesce(1.0::DOUBLE / min(CASE WHEN v.chunk_id IS NOT NULL THEN s.rank END), 0) AS mrr,
        coalesce(sum(CASE WHEN v.chunk_id IS NOT NULL AND s.rank <= 5 THEN 1 / log2(s.rank + 1) END) / any_value(ideal), 0) AS ndcg FROM (SELECT DISTINCT run FROM {source}) r CROSS JOIN benchmark b LEFT JOIN {source} s ON s.run = r.run AND s.query_id = b.item_id
        LEFT JOIN held v ON v.query_id = s.query_id AND v.chunk_id = s.chunk_id LEFT JOIN best i ON i.query_id = b.item_id GROUP BY r.run, b.item_id)"""


@LAYERS.add(
    f"""WITH {_RELEVANT}, held AS (SELECT DISTINCT query_id, chunk_id FROM relevant), best AS (SELECT query_id, list_sum(list_transform(range(1, least(count(*), 5) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM held GROUP BY query_id), {_MODES},
    scored AS (SELECT f.*, {jaccard_sql('b.text', 'd.text')} AS o FROM found f JOIN documents d ON d.doc_id = f.chunk_id JOIN benchmark b ON b.item_id = f.query_id),
    after AS MATERIALIZED (SELECT mode || '/lexical' AS run, query_id, chunk_id, row_number() OVER (PARTITION BY mode, query_id ORDER BY o DESC, rank, chunk_id) AS rank FROM scored QUALIFY row_number() OVER (PARTITION BY mode, query_id ORDER BY o DESC, rank, chunk_id) <= 5
        UNION ALL SELECT mode || '/none', query_id, chunk_id, rank FROM found WHERE rank <= 5), before AS (SELECT mode AS run, query_id, chunk_id, rank FROM found),
    {_mode_metrics('old', 'before')}, {_mode_metrics('new', 'after')},
    moved AS (SELECT coalesce(a.run, z.run) AS run, coalesce(a.query_id, z.query_id) AS query_id, a.rank AS was, z.rank AS now, coalesce(a.chunk_id, z.chunk_id) AS chunk_id FROM (SELECT n.run, f.* EXCLUDE (mode) FROM found f JOIN (SELECT DISTINCT run, split_part(run, '/', 1) AS mode FROM after) n USING (mode) WHERE f.rank <= 5) a FULL JOIN after z ON z.run = a.run AND z.query_id = a.query_id AND z.chunk_id = a.chunk_id),
    effect AS (SELECT run, query_id, coalesce(max(CASE WHEN was = 1 THEN chunk_id END) <> max(CASE WHEN now = 1 THEN chunk_id END), false) AS changed, coalesce(avg(abs(was - now)), 0) AS d FROM moved GROUP BY run, query_id)
    SELECT split_part(n.run, '/', 1) AS mode, split_part(n.run, '/', 2) AS reranker, count(*) AS n_queries, round(avg(n.mrr), 6) AS mrr, round(avg(n.ndcg), 6) AS ndcg, round(avg(n.mrr - o.mrr), 6) AS mrr_lift, round(avg(n.ndcg - o.ndcg), 6) AS ndcg_lift,
        round(avg(coalesce(changed, false)::INTEGER), 6) AS top1_change_rate, round(avg(coalesce(d, 0)), 6) AS displacement FROM new n JOIN old o ON o.run = split_part(n.run, '/', 1) AND o.query_id = n.query_id LEFT JOIN effect e ON e.run = n.run AND e.query_id = n.query_id GROUP BY n.run"""
)
def rerank_grid(spark, sf_dir):
    """Two rerankers on the ten best of three retrieval modes."""
    service, asked = _service(spark, sf_dir)
    relevant = stored(quality.relevance(_samples(spark, sf_dir), _corpus(spark, sf_dir)))
    found = {m: stored(service.candidates(asked, service.retrieve(asked, m, 10)).select("query_id", "query", "chunk_id", "text", "score", "rank")) for m in ("dense", "keyword", "hybrid")}
    rows = quality.rerank_grid(found, {"lexical": search.lexical_rerank, "none": search.pass_through}, relevant, _samples(spark, sf_dir))
    return rows.select("mode", "reranker", "n_queries", *(rounded(c).alias(c) for c in ("mrr", "ndcg", "mrr_lift", "ndcg_lift", "top1_change_rate", "displacement")))


_CONFIGS = [(s, n, o) for s in ("recursive", "structure_aware") for n, o in ((128, 10), (256, 25))]


def _chunk_benchmark_sql() -> str:
    ctes, parts = [], []
    for i, (strategy, size, overlap) in enumerate(_CONFIGS):
        config = chunking.ChunkerConfig(size, overlap, 100, 2 * size)
        ctes.append(S.recursive(f"g{i}", "source", config) if strategy == "recursive" else S.structured(f"g{i}", "source", config))
        parts.append(f"SELECT {i} AS run, '{strategy}' AS strategy, {size} AS chunk_size, {overlap} AS chunk_overlap, k * 100000 + pos - 1 AS chunk_id, trim(t, {BLANKS}) AS text, {S.estimate('length(t)')} AS n FROM g{i}_chunk")
    return f"""WITH RECURSIVE sample AS (SELECT b.item_id, b.item_id % 7 AS k, b.text AS query, coalesce(d.text, '') AS ref FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id), source AS MATERIALIZED (SELECT k, string_agg(ref || chr(10) || chr(10), '' ORDER BY item_id) AS t FROM sample GROUP BY k),
    {', '.join(ctes)}, chunk AS MATERIALIZED ({' UNION ALL '.join(parts)}), cw AS MATERIALIZED (SELECT *, {_WORDS.format('text')} AS w FROM chunk), sw AS MATERIALIZED (SELECT item_id, {_WORDS.format('query')} AS g FROM sample),
    pair AS (SELECT run, item_id, chunk_id, g, w, round(len(list_intersect(g, w))::DOUBLE / (len(g) + len(w) - len(list_intersect(g, w))), 6) AS s FROM cw, sw WHERE len(list_intersect(g, w)) > 0 QUALIFY row_number() OVER (PARTITION BY run, item_id ORDER BY round(len(list_intersect(g, w))::DOUBLE / (len(g) + len(w) - len(list_intersect(g, w))), 6) DESC, chunk_id) <= 5),
    each AS (SELECT run, item_id, avg(CASE WHEN len(list_intersect(g, w))::DOUBLE / greatest(len(g), 1) > 0.1 THEN 1.0 ELSE 0.0 END) AS p, len(list_intersect(any_value(g), flatten(list(w))))::DOUBLE / greatest(len(any_value(g)), 1) AS r FROM pair GROUP BY ALL),
    score AS (SELECT r.run, avg(coalesce(p, 0)) AS p, avg(coalesce(r, 0)) AS r FROM (SELECT run, item_id FROM (SELECT DISTINCT run FROM chunk), sw) r LEFT JOIN each USING (run, item_id) GROUP BY r.run)
    SELECT strategy, chunk_size, chunk_overlap, round(any_value(p), 6) AS context_precision, round(any_value(r), 6) AS context_recall, round(coalesce(2 * any_value(p) * any_value(r) / nullif(any_value(p) + any_value(r), 0), 0), 6) AS f1, count(*) AS total_chunks,
        round(avg(n), 6) AS avg_chunk_tokens, min(n)::INTEGER AS min_chunk_tokens, max(n)::INTEGER AS max_chunk_tokens FROM chunk JOIN score USING (run) GROUP BY ALL"""


@LAYERS.add(_chunk_benchmark_sql())
def chunking_benchmark(spark, sf_dir):
    """Precision, recall and F1 of four chunkings of seven sources put together from the samples' references."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("ref"))
    samples = table(spark, sf_dir, "benchmark").join(docs, "item_id", "left")
    samples = samples.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("text").alias("ground_truth"), F.array(F.coalesce("ref", F.lit(""))).alias("reference"), (F.col("item_id") % 7).cast("string").alias("document_id"))
    rows = platform.chunking_benchmark(stored(samples), _CONFIGS, places=6)
    return rows.select("strategy", "chunk_size", "chunk_overlap", *(rounded(c).alias(c) for c in ("context_precision", "context_recall", "f1", "avg_chunk_tokens")), "total_chunks", "min_chunk_tokens", "max_chunk_tokens")


# ---------------------------------------------------------------- retrieval


@LAYERS.add(
    f"WITH {bm25_ctes()}, seen AS (SELECT b.* FROM bm25 b JOIN documents d ON d.doc_id = b.chunk_id WHERE b.query_id % 4 = 0 OR d.source = 'src' || (b.query_id % 5)) {top('seen', 5)}"
)
def scoped_retrieval(spark, sf_dir):
    """Questions that name a source see only its documents; every fourth names none."""
    docs = table(spark, sf_dir, "documents")
    asked = _asked(spark, sf_dir).withColumn("source", F.when(F.col("query_id") % 4 > 0, F.concat(F.lit("src"), (F.col("query_id") % 5).cast("string"))))
    return search.bm25(docs, asked, 5, places=6, scope="source")


@LAYERS.add(
    f"""WITH {_hybrid_ctes(20)}, scored AS (SELECT h.query_id, h.chunk_id, h.rank AS original_rank, {jaccard_sql('b.text', 'd.text')} AS o FROM hybrid h JOIN documents d ON d.doc_id = h.chunk_id JOIN benchmark b ON b.item_id = h.query_id)
    SELECT query_id, chunk_id, original_rank, round(o, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY o DESC, original_rank, chunk_id)::INTEGER AS rank FROM scored QUALIFY rank <= 5"""
)
def retrieve_and_rerank(spark, sf_dir):
    """Hybrid retrieval of twenty, then the lexical reranker."""
    service, asked = _service(spark, sf_dir)
    return service.retrieve_and_rerank(asked, "hybrid", 20, 5).select("query_id", "chunk_id", "original_rank", rounded("score").alias("score"), "rank")


@LAYERS.add(
    f"""WITH {bm25_ctes()}, few AS ({top('bm25', 10)}), n AS (SELECT f.*, length(d.text)::DOUBLE AS l FROM few f JOIN documents d ON d.doc_id = f.chunk_id), w AS (SELECT *, min(l) OVER q AS lo, max(l) OVER q AS hi, count(*) OVER q AS c FROM n WINDOW q AS (PARTITION BY query_id)),
    s AS (SELECT query_id, chunk_id, rank AS original_rank, CASE WHEN c = 1 THEN l WHEN hi > lo THEN (l - lo) / (hi - lo) ELSE 1 END AS v FROM w)
    SELECT query_id, chunk_id, original_rank, round(v, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, original_rank, chunk_id)::INTEGER AS rank FROM s QUALIFY rank <= 3"""
)
def scored_rerank(spark, sf_dir):
    """A scorer given as a function of two columns, here the text's length, brought to 0..1."""
    rows = search.scored_rerank(candidates(spark, sf_dir, 10), lambda query, text: F.length(text).cast("double"), 3)
    return rows.select("query_id", "chunk_id", "original_rank", rounded("score").alias("score"), "rank")


@LAYERS.add(f"WITH {bm25_ctes()}, few AS ({top('bm25', 10)}) SELECT query_id, chunk_id, rank AS original_rank, score AS rerank_score FROM few WHERE rank <= 4")
def pass_through(spark, sf_dir):
    return search.pass_through(candidates(spark, sf_dir, 10), 4).select("query_id", "chunk_id", "original_rank", "rerank_score")


# ---------------------------------------------------------------- the collection

_DIMENSIONS = 9


def _letters():
    from quern.plans.text import _letters as letters

    return letters


def _collection(spark, sf_dir):
    """The lines of all documents but odd multiples of three as an indexed collection, and those of all multiples of three to index: half of them are new."""
    docs = table(spark, sf_dir, "documents").withColumn("line", F.explode(F.split("text", "\n")))
    lines = docs.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).select(F.col("doc_id").cast("string").alias("document_id"), F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.sha2("line", 256)).alias("chunk_id"), F.col("line").alias("text"))
    model = embedding.EmbeddingModel("letters", _DIMENSIONS, 1 << 30)
    old = embedding.embed(lines.where(F.col("document_id").cast("long") % 6 != 3), model, _letters)
    current = old.select(F.col("chunk_id").alias("id"), "embedding", F.create_map(F.lit("document_id"), F.col("document_id")).alias("metadata"), F.col("text").alias("document"))
    return stored(current), lines.where(F.col("document_id").cast("long") % 3 == 0), model


_INDEXED = "line AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), kept AS (SELECT * FROM line WHERE doc_id % 3 > 0), fresh AS (SELECT * FROM line WHERE doc_id % 3 = 0)"


@LAYERS.add(
    f"""WITH {_INDEXED}, n AS (SELECT count(*) AS indexed, count(*) FILTER (WHERE doc_id % 2 = 0) AS replaced FROM fresh), s AS (SELECT count(*) AS records, count(DISTINCT doc_id) AS documents FROM (SELECT * FROM kept UNION ALL SELECT * FROM fresh))
    SELECT records, documents, {_DIMENSIONS} AS dimensions, indexed, replaced, (SELECT count(*) FROM fresh) AS marked FROM s, n"""
)
def index_documents(spark, sf_dir):
    """Embed, replace and mark in one go, with counts and the collection's statistics after it."""
    current, chunks, model = _collection(spark, sf_dir)
    after, marked, counts = store.index_documents(current, chunks, model, _letters)
    return store.statistics(after).crossJoin(counts).crossJoin(marked.where("embedded AND indexed").agg(F.count(F.lit(1)).alias("marked")))


@LAYERS.add("WITH line AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_id % 6 <> 3) SELECT count(*) AS records, count(DISTINCT doc_id) AS documents, (SELECT count(*) FROM line WHERE doc_id % 5 = 0) AS removed FROM line WHERE doc_id % 5 > 0")
def remove_documents(spark, sf_dir):
    current, _, _ = _collection(spark, sf_dir)
    gone = table(spark, sf_dir, "documents").where("doc_id % 5 = 0").select(F.col("doc_id").cast("string").alias("document_id"))
    after, removed = store.remove_documents(current, gone)
    return store.statistics(after).select("records", "documents").crossJoin(removed)


@LAYERS.add("SELECT sha256(line) AS digest FROM (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_id = 6)")
def records_of_a_document(spark, sf_dir):
    """A look-up in the collection."""
    current, _, _ = _collection(spark, sf_dir)
    return store.by_document(current, "6").select(F.sha2("document", 256).alias("digest"))


# ---------------------------------------------------------------- files written and read again


@LAYERS.add("SELECT doc_id + 1 AS id, sha256(text) AS body_sha256, strftime(timestamp '2024-01-01' + to_days((doc_id % 97)::INTEGER), '%Y%m%d') AS ingest_date FROM documents WHERE doc_id % 50 = 7")
def payload_replay(spark, sf_dir):
    """Payloads landed in day folders as JSON, and one document's read again."""
    root = scratch_folder(spark, "payloads")
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("id"), F.col("text").alias("body"), (F.col("doc_id") % 50).cast("string").alias("document_id"), F.timestamp_add("DAY", (F.col("doc_id") % 97).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("received_at"))
    readers.write_payloads(rows, root)
    held = readers.read_payloads(spark, root, "id long, body string, document_id string, received_at timestamp")
    return readers.replay(held.where("_corrupt_record is null"), "7").select("id", F.sha2("body", 256).alias("body_sha256"), "ingest_date")


def _dataset(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark")
    route = F.when(F.col("item_id") % 3 == 0, "incident").when(F.col("item_id") % 3 == 1, "async")
    meta = F.map_filter(F.create_map(F.lit("route"), route, F.lit("topic"), F.when(F.col("item_id") % 5 == 0, "taints")), lambda _, v: v.isNotNull())
    return rows.select(F.col("item_id").cast("string").alias("sample_id"), F.col("text").alias("question"), F.concat("text", F.lit("!")).alias("ground_truth"), F.array("text", F.lit("x")).alias("reference_context"), (F.col("item_id") % 4).cast("string").alias("document_id"), meta.alias("metadata"))


_ROUTED = "SELECT item_id, text, CASE item_id % 3 WHEN 0 THEN 'incident' WHEN 1 THEN 'async' END AS route, CASE WHEN item_id % 5 = 0 THEN 'taints' END AS topic FROM benchmark"


@LAYERS.add("SELECT 'golden' AS dataset, item_id::VARCHAR AS sample_id, sha256(text) AS question_sha256, 2 AS n_references, (item_id % 4)::VARCHAR AS document_id FROM benchmark")
def dataset_round_trip(spark, sf_dir):
    """An evaluation set written as one JSON document and read again."""
    path = scratch_folder(spark, "dataset")
    readers.write_samples(_dataset(spark, sf_dir), path, "golden")
    return readers.read_samples(spark, path).select("dataset", "sample_id", F.sha2("question", 256).alias("question_sha256"), F.size("reference_context").alias("n_references"), "document_id")


@LAYERS.add("SELECT event_type AS metric, round(avg(value), 6) AS value FROM events GROUP BY event_type")
def baseline_round_trip(spark, sf_dir):
    path = scratch_folder(spark, "baseline")
    readers.write_metrics(table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(rounded(F.avg("value")).alias("value")), path, "baseline")
    return readers.read_metrics(spark, path)


@LAYERS.add("SELECT item_id::VARCHAR AS record_id, sha256(text) AS question_sha256, (item_id % 10) / 10.0::DOUBLE AS failure_score FROM benchmark UNION ALL SELECT 'again-' || item_id, sha256(text), 0.0::DOUBLE FROM benchmark WHERE item_id % 2 = 0")
def failure_feed(spark, sf_dir):
    """Two appends to the feed, read together."""
    root = scratch_folder(spark, "failures")
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("record_id"), F.col("text").alias("question"), (F.col("item_id") % 10 / 10.0).alias("failure_score"), F.lit(False).alias("promoted"))
    readers.append_failures(rows, root)
    readers.append_failures(rows.where("CAST(record_id AS INT) % 2 = 0").withColumns({"record_id": F.concat(F.lit("again-"), "record_id"), "failure_score": F.lit(0.0)}), root)
    return readers.read_failures(spark, root).select("record_id", F.sha2("question", 256).alias("question_sha256"), "failure_score")


# ---------------------------------------------------------------- samples


@LAYERS.add("SELECT item_id::VARCHAR AS sample_id FROM benchmark WHERE item_id % 15 = 0")
def samples_filtered(spark, sf_dir):
    return quality.filter_samples(_dataset(spark, sf_dir), {"route": "incident", "topic": "taints"}).select("sample_id")


@LAYERS.add(
    f"""SELECT item_id::VARCHAR AS sample_id, CASE WHEN route = 'incident' AND regexp_matches(lower(text), 'resolved|resolution|fix|mitigation|implement') THEN 'incident_resolution' WHEN route = 'incident' THEN 'incident_rca' WHEN route = 'async' THEN 'how_to' WHEN topic = 'taints' THEN 'conceptual' ELSE 'how_to' END AS task_type FROM ({_ROUTED})"""
)
def samples_with_tasks(spark, sf_dir):
    """The task type inferred from metadata and question, written into the metadata."""
    return quality.with_task_types(_dataset(spark, sf_dir)).select("sample_id", F.col("metadata")["task_type"].alias("task_type"))


@LAYERS.add("SELECT count(*)::INTEGER AS n, sha256(string_agg(text, '|' ORDER BY item_id)) AS questions, sha256(string_agg(text || '!', '|' ORDER BY item_id)) AS ground_truths FROM benchmark")
def samples_columnar(spark, sf_dir):
    """The evaluation set as lists, as an outside judge takes it."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.array("text").alias("contexts"), F.concat("text", F.lit("!")).alias("ground_truth"))
    lists = quality.columnar(rows)
    return lists.select(F.size("question").alias("n"), F.sha2(F.array_join("question", "|"), 256).alias("questions"), F.sha2(F.array_join("ground_truth", "|"), 256).alias("ground_truths"))


# ---------------------------------------------------------------- ingestion


@LAYERS.add("""SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') AS hash FROM documents""")
def payload_hashes(spark, sf_dir):
    """The hash of a payload's fields in order of their names."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "lang")
    return rows.select("doc_id", ingest.payload_hash(rows).alias("hash"))


@LAYERS.add("SELECT user_id, arg_max(event_type, (ts, event_type)) AS state FROM events GROUP BY user_id")
def lifecycle_states(spark, sf_dir):
    return ingest.latest_state(table(spark, sf_dir, "events"), "user_id", "event_type", "ts").withColumnRenamed("event_type", "state")


@LAYERS.add("SELECT run_id FROM (SELECT user_id::VARCHAR AS run_id, arg_max(event_type, (ts, event_type)) AS status, min(ts) AS s FROM events GROUP BY user_id) WHERE status = 'click' ORDER BY s DESC, run_id LIMIT 5")
def runs_by_status(spark, sf_dir):
    """A page of runs under a condition."""
    return ingest.list_runs(ingest.run_states(_runs(spark, sf_dir)), 5, status="click", source_type=None).select("run_id")


_CODES = ["transient_network", "transient_rate_limited", "validation_malformed_json", "infra_storage_full", "internal_unexpected", "other"]
_CODE = "[" + ", ".join(f"'{c}'" for c in _CODES) + "][(event_id % 6 + 1)::INTEGER]"


@LAYERS.add(f"SELECT event_id, {_CODE} AS code, CASE WHEN split_part({_CODE}, '_', 1) = 'transient' AND event_id % 5 < 3 THEN 60 ELSE 0 END AS wait_seconds FROM events")
def retry_schedule(spark, sf_dir):
    """Which failures are tried again, and when: transient ones, up to three attempts."""
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", code.alias("code"), F.coalesce(ingest.retry_after(code, F.col("event_id") % 5), F.lit(0)).alias("wait_seconds"))


@LAYERS.add(
    f"""WITH {_PAYLOADS}, good AS (SELECT id::BIGINT AS external_id, doc_id FROM checked WHERE error_code = '')
    SELECT external_id, 1 AS version_index, doc_id % 2 = 1 AS is_active FROM good UNION ALL SELECT external_id, 2, true FROM good WHERE doc_id % 2 = 0"""
)
def ingestion_stream(spark, sf_dir):
    """The stream over three deliveries: all payloads, the same again, and every second one edited. Only edits make versions; bad payloads, some
    of them with an id that is no number, are quarantined by the stream."""
    landing, root = scratch_folder(spark, "landing"), scratch_folder(spark, "stream")
    rows, deliveries = payload_deliveries(spark, sf_dir)
    stream = IngestionStream(spark, landing, root)
    for lines in deliveries:
        lines.write.mode("append").text(landing)
        stream.start().awaitTermination()
    return stream.versions.read().join(external_ids(rows), "document_id").select("external_id", "version_index", "is_active")


def external_ids(rows):
    """(document_id, external_id) of valid payloads."""
    good = ingest.split_valid(ingest.validate(rows))[0].withColumn("id", F.col("id").cast("long"))
    return ingest.to_documents(good, "github_issue").select("document_id", F.col("external_id").cast("long").alias("external_id"))


def payload_deliveries(spark, sf_dir):
    """The payloads, and three deliveries of them as JSON lines: all, the same again, and every second one edited."""
    rows = payloads(spark, sf_dir)
    edited = rows.where("doc_id % 2 = 0").withColumn("body", F.concat("body", F.lit(" edited")))
    plain = [c for c in rows.columns if c not in ("doc_id", "id")]
    line = F.when(F.col("id").rlike("^-?[0-9]+$"), F.to_json(F.struct(F.col("id").try_cast("long").alias("id"), *plain))).otherwise(F.to_json(F.struct("id", *plain)))
    return rows, [d.select(line.alias("value")) for d in (rows, rows, edited)]


# ---------------------------------------------------------------- chunking service and operations


@LAYERS.add(
    f"""WITH RECURSIVE plain AS (SELECT doc_id AS k, text AS t FROM documents WHERE doc_id % 3 <> 0 AND trim(text) <> ''), {S.recursive('r', 'plain', chunking.ChunkerConfig(128, 20, 40, 192))}, issue AS (SELECT doc_id AS k, text AS t FROM documents WHERE doc_id % 3 = 0 AND trim(text) <> ''), {S.structured('s', 'issue', chunking.ChunkerConfig(128, 20, 40, 192))}
    SELECT k AS doc_id, pos - 1 AS chunk_index, 'recursive' AS strategy, sha256(trim(t, {BLANKS})) AS digest, lang FROM r_chunk JOIN documents ON doc_id = k UNION ALL SELECT k, pos - 1, 'github_issue', sha256(trim(t, {BLANKS})), lang FROM s_chunk JOIN documents ON doc_id = k"""
)
def chunks_by_source(spark, sf_dir):
    """The strategy follows from the source: comments by structure, what is unknown by separators; other columns come along."""
    docs = table(spark, sf_dir, "documents").withColumn("kind", F.when(F.col("doc_id") % 3 == 0, "github_issue_comment").otherwise("wiki"))
    rows = chunking.chunk_documents(docs, None, chunking.ChunkerConfig(128, 20, 40, 192), source_col="kind")
    return rows.where("error is null").select("doc_id", "chunk_index", "strategy", F.col("chunk_hash").alias("digest"), "lang")


@LAYERS.add("""SELECT 'requests{layer="' || (user_id % 3) || '"} ' || count(*) || '.0' AS line FROM events GROUP BY user_id % 3""")
def metrics_page(spark, sf_dir):
    """Counters as lines of text."""
    rows = table(spark, sf_dir, "events").select(F.lit("requests").alias("name"), F.create_map(F.lit("layer"), (F.col("user_id") % 3).cast("string")).alias("labels"), F.lit("counter").alias("kind"), F.lit(1.0).alias("value"), F.col("event_id").alias("ts"))
    return ops.exposition(ops.registry(rows))


@LAYERS.add(f"WITH i AS ({OPERATIONS.sql['intent_classify']}) SELECT conv_id, turn, CASE intent " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ops.GUIDE.items()) + " ELSE '' END AS answer FROM i")
def guide_answers(spark, sf_dir):
    """The canned answers to what is no question about the corpus."""
    return _guided(spark, sf_dir).select("conv_id", "turn", F.coalesce("guide_answer", F.lit("")).alias("answer"))


_SECRET = "a secret of the service"


def _hmac_sql(text: str) -> str:
    key = _SECRET.encode().ljust(64, b"\0")
    pad = lambda byte: "unhex('" + bytes(k ^ byte for k in key).hex() + "')"
    return f"sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || encode({text}))))"


@LAYERS.add(f"SELECT doc_id, doc_id % 4 > 1 AS genuine, 'sha256=' || {_hmac_sql('text')} AS expected FROM documents")
def signed_payloads(spark, sf_dir):
    """Payloads of which every other pair is signed, the others wrongly or not at all."""
    docs, right = table(spark, sf_dir, "documents"), F.concat(F.lit("sha256="), ingest.hmac_sha256(F.col("text"), _SECRET))
    given = F.when(F.col("doc_id") % 4 > 1, right).when(F.col("doc_id") % 4 == 1, F.lit("sha256=00"))
    return docs.select("doc_id", ingest.signature_ok(F.col("text"), given, _SECRET).alias("genuine"), right.alias("expected"))


@LAYERS.add(f"WITH RECURSIVE plain AS (SELECT doc_id AS k, text AS t FROM documents WHERE trim(text) <> ''), {S.recursive('r', 'plain', chunking.ChunkerConfig(256, 20, 100, 512))} SELECT k AS doc_id, pos - 1 AS chunk_index, {S.estimate('length(t)')}::INTEGER AS token_count, sha256(trim(t, {BLANKS})) AS digest FROM r_chunk")
def chunks_by_table_function(spark, sf_dir):
    """The chunkers called from SQL."""
    chunking.register_sql(spark)
    table(spark, sf_dir, "documents").select("doc_id", "text").createOrReplaceTempView("chunk_source")
    return spark.sql("SELECT doc_id, chunk_index, token_count, sha2(chunk_text, 256) AS digest FROM chunk_source, LATERAL chunk_text(text, 'recursive', 256, 20)")


@LAYERS.add(
    f"""WITH {_RELEVANT}, held AS (SELECT DISTINCT query_id, chunk_id FROM relevant), best AS (SELECT query_id, list_sum(list_transform(range(1, least(count(*), 5) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM held GROUP BY query_id), {_MODES},
    before AS (SELECT mode AS run, query_id, chunk_id, rank FROM found), {_mode_metrics('old', 'before')} SELECT run AS model, count(*) AS n_queries, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM old GROUP BY run"""
)
def retriever_comparison(spark, sf_dir):
    """MRR and NDCG of every retrieval mode."""
    service, asked = _service(spark, sf_dir)
    relevant = stored(quality.relevance(_samples(spark, sf_dir), _corpus(spark, sf_dir)))
    out = None
    for mode in ("dense", "keyword", "hybrid"):
        rows = quality.ranking_metrics(service.retrieve(asked, mode, 10), relevant, 5, _samples(spark, sf_dir)).withColumn("model", F.lit(mode))
        out = rows if out is None else out.unionByName(rows)
    rows = quality.averages(stored(out), ["model"], ["mrr", "ndcg"])
    return rows.select("model", "n_queries", rounded("mrr").alias("mrr"), rounded("ndcg").alias("ndcg"))
