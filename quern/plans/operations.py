"""Queries of ingestion, versions, runs, traces, intents, capacity, generated corpora and time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import ingest, ops, store
from quern.plans.common import BLANKS, Catalog, rounded, table
from quern.sources import readers
from quern.streaming import pipelines

OPERATIONS = Catalog()

# ---------------------------------------------------------------- payloads and documents


def payloads(spark, sf_dir):
    """Issue payloads made from the documents, titled by their first lines, a few of them bad in each way."""
    k = F.col("doc_id") % 13
    null = F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").select(
        F.when(k == 1, null).when(k == 2, "-1").when(k == 11, "12x").otherwise((F.col("doc_id") + 1).cast("string")).alias("id"),
        F.when(k == 3, "https://example.org/1").otherwise(F.concat(F.lit("https://github.com/o/r/issues/"), F.col("doc_id").cast("string"))).alias("html_url"),
        F.when(k == 4, F.repeat(F.lit("t"), 257)).otherwise(F.substring_index("text", "\n", 1)).alias("title"), F.col("text").alias("body"),
        F.when(k == 5, "2024-01-02 10:00").otherwise("2024-01-02T10:00:00Z").alias("created_at"), F.when(k == 6, "").otherwise("2024-01-03T10:00:00+00:00").alias("updated_at"),
        F.struct(F.when(k == 7, F.repeat(F.lit("u"), 40)).when(k == 8, null).otherwise(F.col("source")).alias("login")).alias("user"), F.array(F.struct(F.col("lang").alias("name"))).alias("labels"),
        F.lit("https://api/r").alias("repository_url"), F.when(k == 9, 0).otherwise(5).alias("number"), F.when(k == 10, "merged").otherwise("open").alias("state"), null.alias("pull_request"), null.alias("issue_url"), "doc_id",
    )


_STAMP = "({0} = '' OR NOT ({0} LIKE '%Z' OR contains({0}, '+') OR contains(substr({0}, 11), '-')))"
#: The same payloads, and what the rules for their fields say of them, in the order of the fields.
_PAYLOADS = f"""payload AS (SELECT doc_id, lang, source, text AS body, CASE k WHEN 1 THEN NULL WHEN 2 THEN '-1' WHEN 11 THEN '12x' ELSE (doc_id + 1)::VARCHAR END AS id,
        CASE k WHEN 3 THEN 'https://example.org/1' ELSE 'https://github.com/o/r/issues/' || doc_id END AS html_url, CASE k WHEN 4 THEN repeat('t', 257) ELSE string_split(text, chr(10))[1] END AS title,
        CASE k WHEN 5 THEN '2024-01-02 10:00' ELSE '2024-01-02T10:00:00Z' END AS created_at, CASE k WHEN 6 THEN '' ELSE '2024-01-03T10:00:00+00:00' END AS updated_at,
        CASE k WHEN 7 THEN repeat('u', 40) WHEN 8 THEN NULL ELSE source END AS login, CASE k WHEN 9 THEN 0 ELSE 5 END AS number, CASE k WHEN 10 THEN 'merged' ELSE 'open' END AS state FROM (SELECT *, doc_id % 13 AS k FROM documents)),
    checked AS (SELECT *, CASE WHEN id IS NULL THEN 'validation_missing_required_field' WHEN NOT regexp_full_match(id, '[+-]?[0-9]{{1,18}}') THEN 'validation_invalid_field_type' WHEN id::BIGINT <= 0 THEN 'validation_schema_mismatch'
        WHEN length(html_url) > 2048 THEN 'validation_payload_too_large' WHEN NOT contains(lower(html_url), 'github') THEN 'validation_field_constraint' WHEN length(title) > 256 OR length(body) > 65535 THEN 'validation_payload_too_large'
        WHEN {_STAMP.format('created_at')} OR {_STAMP.format('updated_at')} THEN 'validation_field_constraint' WHEN login IS NULL THEN 'validation_missing_required_field' WHEN length(login) < 1 THEN 'validation_schema_mismatch'
        WHEN length(login) > 39 THEN 'validation_payload_too_large' WHEN number <= 0 OR state NOT IN ('open', 'closed') THEN 'validation_schema_mismatch' ELSE '' END AS error_code FROM payload)"""


@OPERATIONS.add(f"WITH {_PAYLOADS} SELECT doc_id, error_code, CASE WHEN error_code = '' THEN '' ELSE split_part(error_code, '_', 1) END AS error_category FROM checked")
def validate_payloads(spark, sf_dir):
    return ingest.validate(payloads(spark, sf_dir)).select("doc_id", F.coalesce("error_code", F.lit("")).alias("error_code"), F.coalesce("error_category", F.lit("")).alias("error_category"))


@OPERATIONS.add(f"WITH {_PAYLOADS} SELECT error_code, count(*) AS n FROM checked WHERE error_code <> '' GROUP BY error_code")
def error_category_counts(spark, sf_dir):
    _, bad = ingest.split_valid(ingest.validate(payloads(spark, sf_dir)))
    return ingest.count_by(bad, "error_code")


@OPERATIONS.add(
    f"WITH {_PAYLOADS} SELECT id::BIGINT AS external_id, sha256(body) AS hash_content, title, html_url AS source_uri, login AS owner, lang AS label, timestamp '2024-01-02 10:00:00' AS created_at, 'received' AS lifecycle_state FROM checked WHERE error_code = ''"
)
def payload_documents(spark, sf_dir):
    good, _ = ingest.split_valid(ingest.validate(payloads(spark, sf_dir)))
    rows = ingest.to_documents(good, "github_issue", now=F.lit("2025-01-01 00:00:00").cast("timestamp"))
    return rows.select(F.col("external_id").cast("long").alias("external_id"), "hash_content", "title", "source_uri", F.col("owners")[0].alias("owner"), F.col("labels")[0].alias("label"), F.col("created_at").cast("timestamp_ntz").alias("created_at"), "lifecycle_state")


@OPERATIONS.add(
    """WITH h AS (SELECT user_id, ts, event_type, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)),
    c AS (SELECT * FROM h WHERE before IS NULL OR before <> event_type)
    SELECT user_id, event_type, row_number() OVER w::INTEGER AS version_index, epoch_us(ts) AS valid_from, coalesce(epoch_us(lead(ts) OVER w), 0) AS valid_to, lead(ts) OVER w IS NULL AS is_active FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)"""
)
def scd2_versions(spark, sf_dir):
    rows = ingest.build_versions(table(spark, sf_dir, "events").select("user_id", "ts", "event_type"), ("user_id",), "ts", "event_type")
    return rows.select("user_id", "event_type", "version_index", F.unix_micros(F.col("ts").cast("timestamp")).alias("valid_from"), F.coalesce(F.unix_micros(F.col("valid_to").cast("timestamp")), F.lit(0)).alias("valid_to"), "is_active")


def _versions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 3 < 2").select(
        F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("version_id"), F.lit(1).alias("version_index"), F.col("text").alias("body_text"),
        F.lit(None).cast("string").alias("source_payload_uri"), F.sha2("text", 256).alias("hash_payload"), F.lit("2024-01-01").cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit(True).alias("is_active"),
    )
    body = F.when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = docs.select(F.col("doc_id").cast("string").alias("document_id"), body.alias("body_text"), F.sha2(body, 256).alias("hash_payload"), F.lit("2024-02-01").cast("timestamp").alias("valid_from"))
    return old, ingest.detect_changes(new, old)


#: Two thirds of the documents have a version already; a second delivery brings all, some of them changed.
_DELIVERED = """old AS (SELECT doc_id, sha256(text) AS hash FROM documents WHERE doc_id % 3 < 2), new AS (SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 1 THEN text || '!' ELSE text END) AS hash FROM documents),
    found AS (SELECT n.doc_id, n.hash, o.hash AS before, CASE WHEN o.hash IS NULL THEN 'new' WHEN o.hash = n.hash THEN 'skipped_no_change' ELSE 'changed' END AS outcome FROM new n LEFT JOIN old o USING (doc_id)),
    version AS (SELECT o.doc_id, 1 AS version_index, f.outcome <> 'changed' AS is_active, f.outcome = 'changed' AS closed, o.hash FROM old o JOIN found f USING (doc_id)
        UNION ALL SELECT doc_id, CASE WHEN before IS NULL THEN 1 ELSE 2 END, true, false, hash FROM found WHERE outcome <> 'skipped_no_change')"""


@OPERATIONS.add(f"WITH {_DELIVERED} SELECT doc_id, outcome FROM found")
def change_detection_skip(spark, sf_dir):
    return _versions(spark, sf_dir)[1].select(F.col("document_id").cast("long").alias("doc_id"), "outcome")


@OPERATIONS.add(f"WITH {_DELIVERED} SELECT doc_id, version_index, is_active, closed, hash FROM version")
def version_table_after_batch(spark, sf_dir):
    rows = ingest.apply_changes(*_versions(spark, sf_dir))
    return rows.select(F.col("document_id").cast("long").alias("doc_id"), "version_index", "is_active", F.col("valid_to").isNotNull().alias("closed"), F.col("hash_payload").alias("hash"))


def _version_chunks(spark, sf_dir):
    """The version table and a chunk for each line of each version."""
    versions = ingest.apply_changes(*_versions(spark, sf_dir))
    return versions, versions.select("document_id", "version_id", "version_index", F.posexplode(F.split("body_text", "\n")).alias("chunk_index", "chunk_text"))


_LINES = "line AS (SELECT doc_id, version_index, is_active, unnest(l) AS chunk, generate_subscripts(l, 1) - 1 AS chunk_index FROM (SELECT v.*, string_split(CASE WHEN version_index = 2 OR (version_index = 1 AND doc_id NOT IN (SELECT doc_id FROM old) AND doc_id % 3 = 1) THEN text || '!' ELSE text END, chr(10)) AS l FROM version v JOIN documents USING (doc_id)))"


@OPERATIONS.add(f"WITH {_DELIVERED}, {_LINES} SELECT doc_id, version_index, count(*) AS chunks, sha256(string_agg(chunk, '|' ORDER BY chunk_index)) AS digest FROM line WHERE is_active GROUP BY ALL")
def chunks_of_active_versions(spark, sf_dir):
    versions, chunks = _version_chunks(spark, sf_dir)
    rows = ingest.active_chunks(chunks, versions).groupBy(F.col("document_id").cast("long").alias("doc_id"), "version_index")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))), lambda c: c["chunk_text"]), "|")
    return rows.agg(F.count(F.lit(1)).alias("chunks"), F.sha2(ordered, 256).alias("digest"))


@OPERATIONS.add(f"WITH {_DELIVERED}, {_LINES} SELECT version_index, chunk_index::INTEGER AS chunk_index, sha256(chunk) AS digest FROM line WHERE doc_id = 4 AND is_active ORDER BY chunk_index")
def chunks_of_one_document(spark, sf_dir):
    """A look-up: the chunks of document 4's active version, in order."""
    versions, chunks = _version_chunks(spark, sf_dir)
    return ingest.chunks_of_document(chunks, versions, "4").select("version_index", "chunk_index", F.sha2("chunk_text", 256).alias("digest"))


@OPERATIONS.add(f"WITH {_DELIVERED}, {_LINES} SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents FROM line WHERE NOT (doc_id = 4 AND version_index = 1)")
def version_chunks_deleted(spark, sf_dir):
    """What is left when the chunks of document 4's first version go."""
    rows = ingest.delete_version_chunks(_version_chunks(spark, sf_dir)[1], "v4")
    return rows.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("document_id").alias("documents"))


@OPERATIONS.add(
    """WITH current AS (SELECT doc_id, source, lang FROM documents WHERE doc_id % 5 > 0), incoming AS (SELECT doc_id, source || '+' AS source FROM documents WHERE doc_id % 2 = 0 OR doc_id % 5 = 0)
    SELECT doc_id, coalesce(i.source, c.source) AS source, CASE WHEN c.doc_id IS NULL THEN 'xx' ELSE c.lang END AS lang FROM current c FULL JOIN incoming i USING (doc_id)"""
)
def upsert_documents(spark, sf_dir):
    """Every second document arrives again with another source, every fifth for the first time. The language of known ones is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    incoming = docs.where("doc_id % 2 = 0 OR doc_id % 5 = 0").select("doc_id", F.concat("source", F.lit("+")).alias("source"), F.lit("xx").alias("lang"))
    return ingest.upsert(docs.where("doc_id % 5 > 0"), incoming, "doc_id", keep=("lang",))


@OPERATIONS.add("SELECT min(doc_id) AS doc_id, sha256(text) AS hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY text")
def insert_if_new(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    new = ingest.insert_new(docs.where("doc_id % 2 = 0"), docs, ["hash"]).select("hash")
    return docs.join(new, "hash").groupBy("hash").agg(F.min("doc_id").alias("doc_id"))


@OPERATIONS.add("SELECT v.vec_id, b.item_id IS NOT NULL AS embedded, coalesce(b.item_id IS NOT NULL AND v.label < 3, false) AS indexed FROM embeddings v LEFT JOIN benchmark b ON b.item_id = v.vec_id")
def mark_embedded(spark, sf_dir):
    """Chunks are marked embedded where a passage has their number, and those of three labels then indexed."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label").withColumns({"embedded": F.lit(False), "indexed": F.lit(False)})
    rows = ingest.mark(rows, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", {"embedded": F.lit(True)})
    return ingest.mark(rows, rows.where("embedded AND label < 3"), "vec_id", {"indexed": F.lit(True)}).select("vec_id", "embedded", "indexed")


# ---------------------------------------------------------------- runs


@OPERATIONS.add(
    """WITH t AS (SELECT event_id, user_id, ts, event_type, lag(event_type) OVER w AS previous_status, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, user_id, event_type, coalesce(previous_status, '') AS previous_status, coalesce((epoch_us(ts) - epoch_us(before)) // 1000, -1) AS duration_since_previous_ms FROM t WHERE previous_status IS NULL OR previous_status <> event_type"""
)
def status_transition_durations(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = ingest.transitions(rows, "user_id", "ts", "event_type", "event_id")
    return rows.select("event_id", "user_id", "event_type", F.coalesce("previous_status", F.lit("")).alias("previous_status"), F.coalesce("duration_since_previous_ms", F.lit(-1)).alias("duration_since_previous_ms"))


def _runs(spark, sf_dir):
    """Users as runs; an event's type is a status, its value the payload given only sometimes."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("run_id"), F.col("ts").cast("timestamp").alias("event_ts"), F.col("event_type").alias("status"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("payload"))


@OPERATIONS.add(
    """SELECT user_id::VARCHAR AS run_id, arg_max(event_type, (ts, event_type)) AS status, coalesce(arg_max(value, (ts, event_type)) FILTER (WHERE event_id % 3 = 0), -1) AS payload, epoch_us(min(ts)) AS started_us FROM events GROUP BY user_id"""
)
def run_states(spark, sf_dir):
    rows = ingest.run_states(_runs(spark, sf_dir))
    return rows.select("run_id", "status", F.coalesce("payload", F.lit(-1.0)).alias("payload"), F.unix_micros("started_at").alias("started_us"))


@OPERATIONS.add("SELECT status, count(*) AS n FROM (SELECT arg_max(event_type, (ts, event_type)) AS status FROM events GROUP BY user_id) GROUP BY status")
def run_status_counts(spark, sf_dir):
    return ingest.count_by(ingest.run_states(_runs(spark, sf_dir)), "status")


@OPERATIONS.add("SELECT run_id, status FROM (SELECT user_id::VARCHAR AS run_id, arg_max(event_type, (ts, event_type)) AS status, min(ts) AS s FROM events GROUP BY user_id) ORDER BY s DESC, run_id LIMIT 20 OFFSET 10")
def runs_page(spark, sf_dir):
    return ingest.list_runs(ingest.run_states(_runs(spark, sf_dir)), 20, 10).select("run_id", "status")


# ---------------------------------------------------------------- traces, metrics, health


@OPERATIONS.add(
    "SELECT event_type AS layer, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(value) AS count, round(sum(value), 3) AS sum FROM events GROUP BY event_type"
)
def layer_latency_percentiles(spark, sf_dir):
    rows = ops.layer_latencies(table(spark, sf_dir, "events").withColumnRenamed("event_type", "layer"))
    return rows.select("layer", rounded("p50").alias("p50"), rounded("p95").alias("p95"), "count", rounded("sum", 3).alias("sum"))


def _spans(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.floor(F.col("event_id") / 7).alias("trace_id"), F.col("event_id").alias("span_id"), F.col("ts").alias("start_ts"), F.col("value").alias("duration_ms"), F.when(F.col("event_id") % 11 == 0, "error").otherwise("ok").alias("status"))


_TRACE = "SELECT (event_id // 7)::BIGINT AS trace_id, count(*) AS n_spans, max(value) AS duration_ms, CASE WHEN bool_or(event_id % 11 = 0) THEN 'error' ELSE 'ok' END AS status, min(ts) AS s FROM events GROUP BY 1"


@OPERATIONS.add(f"SELECT trace_id, n_spans, duration_ms, status FROM ({_TRACE})")
def trace_rollup(spark, sf_dir):
    return ops.traces(_spans(spark, sf_dir)).select("trace_id", "n_spans", "duration_ms", "status")


@OPERATIONS.add(f"SELECT trace_id, status FROM ({_TRACE}) ORDER BY s DESC, trace_id LIMIT 50")
def recent_traces(spark, sf_dir):
    return ops.recent_traces(_spans(spark, sf_dir)).select("trace_id", "status")


@OPERATIONS.add("SELECT count(*) AS total, count(*) FILTER (WHERE event_id % 11 = 0) AS errors, round((count(*) - count(*) FILTER (WHERE event_id % 11 = 0)) / count(*), 4) AS success_rate FROM events")
def success_rate(spark, sf_dir):
    return ops.success_rate(table(spark, sf_dir, "events"), F.col("event_id") % 11 != 0)


@OPERATIONS.add(
    """WITH o AS (SELECT event_type AS name, 'layer="' || (user_id % 3) || '"' AS labels, CASE event_id % 3 WHEN 0 THEN 'counter' WHEN 1 THEN 'gauge' ELSE 'histogram' END AS kind, value, event_id FROM events),
    h AS (SELECT name, labels, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, count(*)::DOUBLE AS count FROM o WHERE kind = 'histogram' GROUP BY ALL)
    SELECT name, labels, '' AS stat, round(sum(value), 4) AS value FROM o WHERE kind = 'counter' GROUP BY ALL
    UNION ALL SELECT name, labels, '', round(arg_max(value, event_id), 4) FROM o WHERE kind = 'gauge' GROUP BY ALL
    UNION ALL SELECT name, labels, stat, round(value, 4) FROM (UNPIVOT h ON p50, p95, count INTO NAME stat VALUE value)"""
)
def metric_registry(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("counter"), F.lit("gauge"), F.lit("histogram")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.create_map(F.lit("layer"), (F.col("user_id") % 3).cast("string")).alias("labels"), kind.alias("kind"), "value", F.col("event_id").alias("ts"))
    samples = ops.registry(rows)
    return samples.withColumn("value", rounded("value", 4))


@OPERATIONS.add(
    "SELECT user_id % 50 AS grp, CASE WHEN bool_or(value > 95) THEN 'unhealthy' WHEN bool_or(value > 90) THEN 'degraded' ELSE 'healthy' END AS status FROM events GROUP BY 1"
)
def health_rollup(spark, sf_dir):
    status = F.when(F.col("value") > 95, "unhealthy").when(F.col("value") > 90, "degraded").otherwise("healthy")
    return ops.system_health(table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("grp"), status.alias("status")), ["grp"])


@OPERATIONS.add(
    """WITH r AS (SELECT event_type, value, event_id % 10 > 0 AS ok FROM events), g AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS p, count(*) OVER (PARTITION BY event_type) AS n FROM r WHERE ok),
    t AS (SELECT event_type, count(*) AS requests FROM r GROUP BY 1)
    SELECT event_type, requests, count(*) AS success, round(avg(value), 6) AS avg_ms, round(median(value), 6) AS p50_ms, max(CASE WHEN p = greatest(1, floor(n * 0.95)) THEN value END) AS p95_ms, round(count(*) / (sum(value) / 1000), 4) AS qps, requests - count(*) AS errors
    FROM g JOIN t USING (event_type) GROUP BY event_type, requests"""
)
def load_summary(spark, sf_dir):
    rows = ops.load_summary(table(spark, sf_dir, "events"), ["event_type"], "value", F.col("event_id") % 10 > 0)
    return rows.select("event_type", "requests", "success", rounded("avg_ms").alias("avg_ms"), rounded("p50_ms").alias("p50_ms"), "p95_ms", rounded("qps", 4).alias("qps"), "errors")


# ---------------------------------------------------------------- intents and capacity


def _sql_text(pattern: str) -> str:
    return pattern.replace("'", "''")


_QUESTION = "CASE turn % 8 WHEN 0 THEN 'Hello!' WHEN 1 THEN 'what else can you do for me' WHEN 2 THEN 'tell me a joke' WHEN 3 THEN 'hey bot' WHEN 4 THEN ' ' WHEN 5 THEN 'Thanks...' ELSE text END"
_INTENT = f"""CASE WHEN t = '' THEN 'capability' WHEN regexp_matches(t, '{_sql_text(ops.GREETING)}') THEN 'greeting' WHEN regexp_matches(t, '{_sql_text(ops.CAPABILITY)}') THEN 'capability'
    WHEN regexp_matches(t, '{_sql_text(ops.OFF_TOPIC)}') AND len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) < 16 THEN 'off_topic'
    WHEN len(k) BETWEEN 1 AND 2 AND k[1] IN ({", ".join(f"'{w}'" for w in ops.CHATTER)}) THEN 'greeting' ELSE 'rag' END"""


@OPERATIONS.add(f"SELECT conv_id, turn, {_INTENT} AS intent FROM (SELECT conv_id, turn, t, regexp_extract_all(lower(t), '[a-z0-9]+') AS k FROM (SELECT conv_id, turn, trim({_QUESTION}, {BLANKS}) AS t FROM conversations))")
def intent_classify(spark, sf_dir):
    return _guided(spark, sf_dir).select("conv_id", "turn", "intent")


def _guided(spark, sf_dir):
    texts = ["Hello!", "what else can you do for me", "tell me a joke", "hey bot", " ", "Thanks..."]
    question = F.col("text")
    for k, t in enumerate(texts):
        question = F.when(F.col("turn") % 8 == k, F.lit(t)).otherwise(question)
    return ops.guide(table(spark, sf_dir, "conversations").withColumn("query", question))


@OPERATIONS.add(
    """WITH t(tier, documents) AS (VALUES ('10K', 10000), ('100K', 100000), ('1M', 1000000), ('10M', 10000000)), s AS (SELECT *, documents::BIGINT * 8 * (768 * 4 + 2048) / 1048576.0 AS storage FROM t)
    SELECT tier, documents::BIGINT AS documents, round(storage::DOUBLE, 3) AS storage_mb, (documents * 8 / 1000.0 * 0.5)::DOUBLE AS build_minutes, (5 + documents / 10000.0 * 2)::DOUBLE AS query_p95_ms,
    array_to_string(list_filter([CASE WHEN documents >= 100000 THEN 'vector_index_size' END, CASE WHEN documents >= 1000000 THEN 'keyword_rebuild' END, CASE WHEN documents >= 10000000 THEN 'embedding_throughput' END, CASE WHEN storage > 500 THEN 'disk_budget' END], lambda x: x IS NOT NULL), ',') AS bottlenecks FROM s"""
)
def capacity_tiers(spark, sf_dir):
    return ops.capacity(spark).select("tier", "documents", rounded("storage_mb", 3).alias("storage_mb"), "build_minutes", "query_p95_ms", "bottlenecks")


@OPERATIONS.add(
    """SELECT 'synthetic-' || lpad(i::VARCHAR, 6, '0') AS doc_id, sha256('# Incident ' || i || chr(10) || chr(10) || 'Service degradation observed in region-' || i % 10 || '. Root cause: memory pressure on node pool ' || i % 50 || '. Resolution: scale replicas and apply resource quotas.') AS digest FROM range(1000) r(i)"""
)
def synthetic_corpus(spark, sf_dir):
    return readers.synthetic_corpus(spark, 1000).select("doc_id", F.sha2("body", 256).alias("digest"))


@OPERATIONS.add(
    f"SELECT doc_id, '/sources/' || doc_id AS url, left(string_split(trim(text, ' '), chr(10))[1], 120) AS preview FROM documents"
)
def source_catalogue(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("title", F.lit(None).cast("string"))
    return readers.list_sources(docs).select("doc_id", "url", "preview")


@OPERATIONS.add("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'src1' WHEN doc_id % 4 = 1 AND source = 'src1' THEN 'src1' WHEN doc_id % 4 = 1 AND source LIKE 'src1%' THEN 'src1' ELSE '' END AS resolved FROM documents")
def source_resolution(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 4
    meta = F.when(k == 0, F.create_map(F.lit("doc_id"), F.lit("src1"))).when(k == 1, F.create_map(F.lit("other"), F.col("source"))).otherwise(F.create_map(F.lit("other"), F.lit("none")))
    return docs.select("doc_id", store.resolve_document(meta, F.lit("c"), ["src1"]).alias("resolved"))


# ---------------------------------------------------------------- time windows


@OPERATIONS.add(
    """SELECT epoch_us(time_bucket(INTERVAL 5 MINUTES, ts)) AS window_us, event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS max, round(sum(value), 3) AS sum FROM events GROUP BY ALL"""
)
def event_window_rollup(spark, sf_dir):
    rows = pipelines.windowed_latency(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.select(F.unix_micros("window_start").alias("window_us"), "event_type", "n", rounded("mean").alias("mean"), "max", rounded("sum", 3).alias("sum"))


@OPERATIONS.add(
    """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 1800000000 THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    r AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM r GROUP BY user_id, run"""
)
def event_sessions(spark, sf_dir):
    rows = pipelines.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.select("user_id", F.unix_micros("session_start").alias("start_us"), "n")


