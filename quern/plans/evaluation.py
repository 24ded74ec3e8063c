"""Queries of ranking metrics, distributions, gates, baselines, tasks and failures."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import context, quality, search
from quern.operators.staging import stored
from quern.plans.answering import _TWENTY, _strategy_sql
from quern.plans.common import Catalog, coverage_sql, rounded, table, token_set_sql
from quern.plans.search import _RERANK, bm25, bm25_ctes, candidates, top

EVALUATION = Catalog()

# A document is relevant to a passage if one text holds the other (the benchmark's passages are planted in documents).
_RELEVANT = "relevant AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(trim(b.text))) OR contains(lower(trim(b.text)), lower(d.text)) WHERE length(trim(b.text)) > 0 AND length(d.text) > 0)"


def _samples(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array("text").alias("reference"))


def _corpus(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


@EVALUATION.add(f"WITH {_RELEVANT} SELECT DISTINCT query_id, chunk_id FROM relevant")
def relevance_resolution(spark, sf_dir):
    return quality.relevance(_samples(spark, sf_dir), _corpus(spark, sf_dir))


def _metrics_sql(source: str) -> str:
    return f"""hit AS (SELECT r.query_id, r.rank FROM {source} r JOIN (SELECT DISTINCT * FROM relevant) v USING (query_id, chunk_id)),
    total AS (SELECT query_id, count(*) AS n FROM (SELECT DISTINCT * FROM relevant) GROUP BY query_id),
    sums AS (SELECT query_id, count(*) FILTER (WHERE rank <= 5) AS hits, min(rank) AS first, sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) END) AS dcg FROM hit GROUP BY query_id),
    metric AS (SELECT item_id AS query_id, coalesce(hits::DOUBLE / n, 0) AS recall, coalesce(hits / 5.0::DOUBLE, 0) AS precision, coalesce(1.0::DOUBLE / first, 0) AS mrr,
        coalesce(dcg / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))), 0) AS ndcg
        FROM benchmark LEFT JOIN total ON total.query_id = item_id LEFT JOIN sums ON sums.query_id = item_id)"""


_ROUND = "query_id, round(recall, 6) AS recall, round(precision, 6) AS precision, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg"


def _metrics(spark, sf_dir, found):
    return quality.ranking_metrics(found, quality.relevance(_samples(spark, sf_dir), _corpus(spark, sf_dir)), 5, _samples(spark, sf_dir))


@EVALUATION.add(f"WITH {_RELEVANT}, {bm25_ctes()}, few AS ({top('bm25', 10)}), {_metrics_sql('few')} SELECT {_ROUND} FROM metric")
def recall_precision_mrr_ndcg(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = bm25(table(spark, sf_dir, "documents"), asked, 10)
    rows = _metrics(spark, sf_dir, found)
    return rows.select("query_id", *(rounded(m).alias(m) for m in ("recall", "precision", "mrr", "ndcg")))


@EVALUATION.add(
    f"""WITH {_RELEVANT}, {bm25_ctes()}, few AS ({top('bm25', 10)}), {_metrics_sql('few')}
    SELECT count(*) AS n_queries, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM metric"""
)
def retrieval_benchmark(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = bm25(table(spark, sf_dir, "documents"), asked, 10)
    names = ("recall", "precision", "mrr", "ndcg")
    rows = quality.averages(_metrics(spark, sf_dir, found), [], names)
    return rows.select("n_queries", *(rounded(m).alias(m) for m in names))


@EVALUATION.add(
    f"""WITH {bm25_ctes()}, {_RERANK}, five AS (SELECT * FROM few WHERE rank <= 5),
    j AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.rank AS old, b.rank AS new FROM five a FULL JOIN reranked b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id)
    SELECT query_id, coalesce(max(CASE WHEN old = 1 THEN chunk_id END) <> max(CASE WHEN new = 1 THEN chunk_id END), false) AS top1_changed, round(coalesce(avg(abs(old - new)), 0), 6) AS displacement FROM j GROUP BY query_id"""
)
def rerank_lift(spark, sf_dir):
    before = candidates(spark, sf_dir, 20)
    effect = quality.rerank_effect(before, search.lexical_rerank(before.withColumn("score", rounded("score")), 5))
    return effect.withColumn("displacement", rounded("displacement"))


_CONTEXT = ("context_precision", "context_recall", "token_efficiency", "dedup_rate", "budget_utilization", "compression_ratio")


def _context_sql(runs: list[tuple[str, str, int]], key: str) -> str:
    """Averages of context quality for runs of (key value, strategy, budget)."""
    parts = " UNION ALL ".join(
        f"SELECT {v} AS {key}, {most} AS most, query_id, chunk_id, rank, token_count, duplicates_removed, {'text' if name == 'full_compressed' else 'NULL::VARCHAR'} AS short FROM ({_strategy_sql(name, most)})" for v, name, most in runs
    )
    return f"""WITH {_RELEVANT}, hit AS (SELECT DISTINCT query_id, chunk_id FROM relevant), given AS (SELECT query_id, count(*) AS chunks_in, sum(t) AS tokens_in FROM (WITH {_TWENTY} SELECT query_id, t FROM cand) GROUP BY query_id),
    chosen AS MATERIALIZED (SELECT r.*, coalesce(short, d.text) AS text FROM ({parts}) r JOIN documents d ON d.doc_id = r.chunk_id),
    held AS (SELECT c.{key}, c.query_id, any_value(most) AS most, sum(token_count) AS tokens_out, max(duplicates_removed) AS removed, coalesce(sum(CASE WHEN h.chunk_id IS NOT NULL THEN token_count END), 0) AS hits, string_agg('[Source ' || rank || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS t
        FROM chosen c LEFT JOIN hit h ON h.query_id = c.query_id AND h.chunk_id = c.chunk_id GROUP BY c.{key}, c.query_id),
    m AS (SELECT {key}, h.hits / nullif(h.tokens_out, 0) AS p, CASE WHEN len({token_set_sql("lower(trim(b.text))")}) > 0 AND ({coverage_sql("lower(trim(b.text))", "h.t")} >= 0.5 OR contains(lower(h.t), lower(trim(b.text)))) THEN 1.0 ELSE 0.0 END AS r,
        tokens_out / most AS used, removed / chunks_in AS dedup, CASE WHEN tokens_out > 0 THEN tokens_in / tokens_out ELSE 1 END AS ratio FROM held h JOIN given USING (query_id) JOIN benchmark b ON b.item_id = h.query_id)
    SELECT {key}, count(*) AS n_queries, round(avg(coalesce(p, 0)), 6) AS context_precision, round(avg(r), 6) AS context_recall, round(avg(coalesce(p, 0) * r / greatest(used, 0.01)), 6) AS token_efficiency, round(avg(dedup), 6) AS dedup_rate, round(avg(used), 6) AS budget_utilization, round(avg(ratio), 6) AS compression_ratio FROM m GROUP BY {key}"""


def _context_quality(spark, sf_dir, runs, key):
    """The candidates, which all runs share, are stored."""
    found = stored(candidates(spark, sf_dir, 20))
    relevant = stored(quality.relevance(_samples(spark, sf_dir), _corpus(spark, sf_dir)))
    out = None
    for value, name, most in runs:
        config = context.AssemblyConfig(strategy=name, max_tokens=most)
        chosen = stored(context.select_chunks(found, config))
        rows = quality.context_metrics(chosen, _samples(spark, sf_dir), relevant, context.assemble(chosen, config)).withColumn(key, F.lit(value))
        out = rows if out is None else out.unionByName(rows)
    rows = quality.averages(out, [key], _CONTEXT)
    return rows.select(key, "n_queries", *(rounded(c).alias(c) for c in _CONTEXT))


@EVALUATION.add(_context_sql([(f"'{name}'", name, 1024) for name in context.STRATEGIES], "strategy"))
def context_benchmark(spark, sf_dir):
    """Context quality of every strategy."""
    return _context_quality(spark, sf_dir, [(name, name, 1024) for name in context.STRATEGIES], "strategy")


_BUDGETS = (512, 1024, 2048, 4096)


@EVALUATION.add(_context_sql([(str(most), "full", most) for most in _BUDGETS], "budget"))
def context_budget_sweep(spark, sf_dir):
    """Context quality of the full strategy under several token budgets."""
    return _context_quality(spark, sf_dir, [(most, "full", most) for most in _BUDGETS], "budget")


_WS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda w: w <> ''))"


@EVALUATION.add(
    f"""WITH {bm25_ctes()}, few AS ({top('bm25', 5)}), c AS (SELECT f.query_id, {_WS.format('b.text')} AS g, {_WS.format('d.text')} AS w FROM few f JOIN documents d ON d.doc_id = f.chunk_id JOIN benchmark b ON b.item_id = f.query_id)
    SELECT query_id, round(avg(CASE WHEN len(list_intersect(g, w))::DOUBLE / greatest(len(g), 1) > 0.1 THEN 1.0 ELSE 0.0 END), 6) AS context_precision,
           round(len(list_intersect(any_value(g), flatten(list(w))))::DOUBLE / greatest(len(any_value(g)), 1), 6) AS context_recall FROM c GROUP BY query_id"""
)
def lexical_context_quality(spark, sf_dir):
    rows = candidates(spark, sf_dir, 5).groupBy("query_id").agg(F.collect_list("text").alias("contexts"), F.first("query").alias("ground_truth"))
    return quality.lexical_context_quality(rows).select("query_id", rounded("context_precision").alias("context_precision"), rounded("context_recall").alias("context_recall"))


# ---------------------------------------------------------------- distributions over the events' values; gates, baselines and tasks over the passages' metrics


@EVALUATION.add(
    """SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50,
    round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(stddev_pop(value), 6) AS std, round(avg((value >= 50)::INTEGER), 6) AS pass_rate FROM events GROUP BY event_type"""
)
def metric_distribution(spark, sf_dir):
    rows = quality.distribution(table(spark, sf_dir, "events"), ["event_type"], threshold=F.lit(50.0))
    return rows.select("event_type", "count", rounded("mean").alias("mean"), "min", "max", *(rounded(c).alias(c) for c in ("p10", "p50", "p90", "p95", "std", "pass_rate")))


_LEXICAL = f"""words AS (SELECT f.query_id, {_WS.format('b.text')} AS g, {_WS.format('d.text')} AS w FROM few f JOIN documents d ON d.doc_id = f.chunk_id JOIN benchmark b ON b.item_id = f.query_id WHERE f.rank <= 5),
    lexical AS (SELECT query_id, avg(CASE WHEN len(list_intersect(g, w))::DOUBLE / greatest(len(g), 1) > 0.1 THEN 1.0 ELSE 0.0 END) AS context_precision, len(list_intersect(any_value(g), flatten(list(w))))::DOUBLE / greatest(len(any_value(g)), 1) AS context_recall FROM words GROUP BY query_id)"""


def _run_metrics(spark, sf_dir):
    """Five metrics of each passage's retrieval and context; the passages make up five runs."""
    found = stored(candidates(spark, sf_dir, 10))
    ranking = _metrics(spark, sf_dir, found).withColumnsRenamed({m: f"retrieval_{m}" for m in ("recall", "precision", "mrr")})
    contexts = found.where("rank <= 5").groupBy("query_id").agg(F.collect_list("text").alias("contexts"), F.first("query").alias("ground_truth"))
    lexical = quality.lexical_context_quality(contexts)
    rows = quality.long_form(ranking, ["query_id"], ["retrieval_recall", "retrieval_precision", "retrieval_mrr"]).unionByName(quality.long_form(lexical, ["query_id"], ["context_precision", "context_recall"]))
    return stored(rows.select("query_id", (F.col("query_id") % 5).alias("run"), "metric", "value"))


_RUN = f"""{_RELEVANT}, {bm25_ctes()}, few AS ({top('bm25', 10)}), {_metrics_sql('few')}, {_LEXICAL}, sample AS MATERIALIZED (SELECT query_id, query_id % 5 AS run, metric, value FROM (
    UNPIVOT (SELECT query_id, recall::DOUBLE AS retrieval_recall, precision::DOUBLE AS retrieval_precision, mrr::DOUBLE AS retrieval_mrr FROM metric) ON retrieval_recall, retrieval_precision, retrieval_mrr INTO NAME metric VALUE value)
    UNION ALL SELECT query_id, query_id % 5, metric, value FROM (UNPIVOT (SELECT query_id, context_precision::DOUBLE AS context_precision, context_recall::DOUBLE AS context_recall FROM lexical) ON context_precision, context_recall INTO NAME metric VALUE value))"""
_LIMITS = "limits(metric, good, warning, critical, higher) AS (VALUES " + ", ".join(f"('{m}', {g}::DOUBLE, {w}::DOUBLE, {c}::DOUBLE, {str(h).lower()})" for m, g, w, c, h in quality.THRESHOLDS) + ")"
_LEVEL = "CASE WHEN {v} IS NULL THEN NULL WHEN (higher AND {v} >= good) OR (NOT higher AND {v} <= good) THEN 'good' WHEN (higher AND {v} >= warning) OR (NOT higher AND {v} <= warning) THEN 'warning' ELSE 'critical' END"


@EVALUATION.add(
    f"""WITH {_RUN}, {_LIMITS}, m AS (SELECT metric, round(avg(value), 6) AS value, round(quantile_cont(value, 0.1), 6) AS p10 FROM sample GROUP BY metric),
    l AS (SELECT metric, value, p10, {_LEVEL.format(v='p10')} = 'critical' AS tail_critical, {_LEVEL.format(v='value')} AS own FROM m JOIN limits USING (metric))
    SELECT metric, value, p10, CASE WHEN tail_critical THEN 'critical' ELSE own END AS level, CASE WHEN tail_critical OR own = 'critical' THEN 'fail' WHEN own = 'warning' THEN 'warning' ELSE 'pass' END AS verdict, tail_critical FROM l"""
)
def quality_gate(spark, sf_dir):
    held = quality.distribution(_run_metrics(spark, sf_dir), ["metric"])
    metrics = held.select("metric", rounded("mean").alias("value"))
    return quality.gate_checks(metrics, quality.thresholds(spark), held.select("metric", rounded("p10").alias("p10")))


@EVALUATION.add(
    f"""WITH {_RUN}, {_LIMITS}, m AS (SELECT run, metric, round(avg(value), 6) AS value FROM sample GROUP BY ALL), l AS (SELECT run, {_LEVEL.format(v='value')} AS level FROM m JOIN limits USING (metric))
    SELECT run, CASE WHEN bool_or(level = 'critical') THEN 'fail' WHEN bool_or(level = 'warning') THEN 'warning' ELSE 'pass' END AS verdict, count(*) FILTER (WHERE level = 'critical') AS failures, count(*) FILTER (WHERE level = 'warning') AS warnings FROM l GROUP BY run"""
)
def gate_verdicts(spark, sf_dir):
    metrics = _run_metrics(spark, sf_dir).groupBy("run", "metric").agg(rounded(F.avg("value")).alias("value"))
    rows = metrics.join(quality.thresholds(spark), "metric").withColumn("level", quality.level(F.col("value")))
    verdict = F.when(F.col("level") == "critical", "fail").when(F.col("level") == "warning", "warning").otherwise("pass")
    return quality.gate_verdict(rows.select("run", verdict.alias("verdict"), F.lit(False).alias("tail_critical")), ["run"])


_TWO = f"WITH {_RUN}, cur AS (SELECT metric, round(avg(value), 6) AS value FROM sample WHERE run < 2 GROUP BY metric), base AS (SELECT metric, round(avg(value), 6) AS baseline FROM sample WHERE run >= 2 GROUP BY metric)"


def _runs(spark, sf_dir):
    """The first two runs are the current ones, the rest the baseline."""
    rows = _run_metrics(spark, sf_dir)
    return (rows.where((F.col("run") < 2) == now).groupBy("metric").agg(rounded(F.avg("value")).alias("value")) for now in (True, False))


@EVALUATION.add(
    f"""{_TWO} SELECT metric, value AS current, baseline, round(value - baseline, 6) AS delta, round(CASE WHEN baseline <> 0 THEN (value - baseline) / baseline * 100 ELSE 0 END, 4) AS delta_pct,
    CASE WHEN abs(value - baseline) < 0.01 THEN 'stable' WHEN (value > baseline) <> (metric = 'hallucination_rate') THEN 'improved' ELSE 'degraded' END AS direction FROM cur JOIN base USING (metric)"""
)
def baseline_delta(spark, sf_dir):
    rows = quality.baseline_delta(*_runs(spark, sf_dir))
    return rows.select("metric", "current", "baseline", rounded("delta").alias("delta"), rounded("delta_pct", 4).alias("delta_pct"), "direction")


_UP = ", ".join(f"'{m}'" for m in quality.HIGHER_BETTER)


@EVALUATION.add(
    f"""{_TWO}, d AS (SELECT metric, value, CASE WHEN metric IN ({_UP}) THEN value - baseline WHEN metric IN ('hallucination_rate', 'e2e_latency_p95_ms') THEN baseline - value END AS d FROM cur JOIN base USING (metric))
    SELECT count(*) FILTER (WHERE d > 0.001) AS improved, count(*) FILTER (WHERE d < -0.001 AND NOT (metric = 'e2e_latency_p95_ms' AND value < 100)) AS regressed,
    count(*) FILTER (WHERE d < -0.001 AND NOT (metric = 'e2e_latency_p95_ms' AND value < 100)) = 0 AND count(*) FILTER (WHERE d > 0.001) >= 3 AS passed FROM d"""
)
def release_gate(spark, sf_dir):
    return quality.release_gate(*_runs(spark, sf_dir))


@EVALUATION.add(
    """WITH a AS (SELECT event_type AS metric, avg(value) AS m, var_samp(value) AS v, count(value) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1),
    b AS (SELECT event_type AS metric, avg(value) AS m, var_samp(value) AS v, count(value) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1)
    SELECT metric, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, abs((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n)) > 2 AS significant FROM a JOIN b USING (metric)"""
)
def welch_ttest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumnRenamed("event_type", "metric")
    found = quality.welch(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"))
    return found.withColumn("t", rounded("t"))


_W = quality.COMPOSITE_WEIGHTS
_METRIC_OF = "CASE event_id % 13 " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(_W)) + " END"


@EVALUATION.add(
    f"""WITH s AS (SELECT user_id % 40 AS task, {_METRIC_OF} AS metric, avg(CASE WHEN event_id % 3 > 0 AND (event_id * 7) % 11 > 6 THEN (event_id * 37) % 101 / 100.0::DOUBLE END) AS value FROM events GROUP BY ALL),
    w(metric, weight, other) AS (VALUES {", ".join(f"('{m}', {w}::DOUBLE, {repr({'rerank_mrr': 'retrieval_mrr', 'rerank_ndcg': 'retrieval_ndcg'}.get(m, m))})" for m, w in _W.items())}),
    v AS (SELECT t.task, w.weight, coalesce(a.value, b.value) AS value FROM (SELECT DISTINCT task FROM s) t CROSS JOIN w LEFT JOIN s a ON a.task = t.task AND a.metric = w.metric LEFT JOIN s b ON b.task = t.task AND b.metric = w.other)
    SELECT task, round(sum(weight * value) / sum(CASE WHEN value IS NOT NULL THEN weight END), 6) AS composite FROM v GROUP BY task"""
)
def task_composite(spark, sf_dir):
    """Composite of sparse metrics: some tasks lack some, so weights are renormalised and fallbacks used."""
    metric = F.lit(None).cast("string")
    for k, m in enumerate(_W):
        metric = F.when(F.col("event_id") % 13 == k, F.lit(m)).otherwise(metric)
    given = (F.col("event_id") % 3 > 0) & (F.col("event_id") * 7 % 11 > 6)
    value = F.when(given, F.pmod(F.col("event_id") * 37, F.lit(101)) / 100.0)
    rows = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 40).alias("task"), metric.alias("metric")).agg(F.avg(value).alias("value"))
    return quality.composite(rows, ["task"]).withColumn("composite", rounded("composite"))


@EVALUATION.add(
    """SELECT item_id, CASE WHEN item_id % 6 = 0 THEN 'conceptual' WHEN item_id % 6 = 1 AND regexp_matches(lower(text), 'resolved|resolution|fix|mitigation|implement') THEN 'incident_resolution' WHEN item_id % 6 = 1 THEN 'incident_rca'
    WHEN item_id % 6 = 2 THEN 'how_to' WHEN item_id % 6 = 3 THEN 'runbook_procedure' WHEN item_id % 6 = 4 THEN 'conceptual' ELSE 'how_to' END AS task_type FROM benchmark"""
)
def task_types(spark, sf_dir):
    k = F.col("item_id") % 6
    null = F.lit(None).cast("string")
    kind = quality.task_type(F.when(k == 0, " Conceptual ").otherwise(null), F.when(k == 1, "incident").when(k == 2, "ASYNC"), F.when(k == 3, "runbook"), F.when(k == 4, "taints"), F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", kind.alias("task_type"))


@EVALUATION.add(
    f"""WITH s AS (SELECT CASE run WHEN 0 THEN 'how_to' WHEN 1 THEN 'incident_rca' WHEN 2 THEN 'incident_resolution' WHEN 3 THEN 'runbook_procedure' ELSE 'conceptual' END AS task_type, metric, round(avg(value), 6) AS value FROM (WITH {_RUN} SELECT * FROM sample) GROUP BY ALL),
    f(task_type, metric, floor) AS (VALUES {", ".join(f"('{t}', '{m}', {v}::DOUBLE)" for t, fl in quality.TASK_FLOORS.items() for m, v in zip(('retrieval_mrr', 'faithfulness', 'answer_relevancy', 'context_recall'), (*fl, 0.9)))})
    SELECT task_type, metric, value, floor FROM s JOIN f USING (task_type, metric) WHERE value < floor - 0.001"""
)
def task_failures(spark, sf_dir):
    names = ["how_to", "incident_rca", "incident_resolution", "runbook_procedure", "conceptual"]
    task = F.element_at(F.array(*map(F.lit, names)), (F.col("run") + 1).cast("int"))
    rows = _run_metrics(spark, sf_dir).groupBy(task.alias("task_type"), "metric").agg(rounded(F.avg("value")).alias("value"))
    return quality.task_failures(rows)


@EVALUATION.add(
    """WITH f AS (SELECT doc_id, text AS question, (doc_id % 10) / 10.0::DOUBLE AS failure_score FROM documents), known AS (SELECT text AS question FROM documents WHERE doc_id % 4 = 0)
    SELECT doc_id FROM f WHERE failure_score < 0.5 AND question NOT IN (SELECT question FROM known) QUALIFY row_number() OVER (PARTITION BY question ORDER BY doc_id) = 1"""
)
def failure_promotion(spark, sf_dir):
    """Every document's text is a question; of equal ones one is promoted, and none that the dataset has."""
    docs = table(spark, sf_dir, "documents").withColumn("question", F.col("text"))
    feed = docs.select("doc_id", "question", (F.col("doc_id") % 10 / 10.0).alias("failure_score"), F.lit(False).alias("promoted"), F.col("doc_id").alias("recorded_at"), F.col("doc_id").alias("record_id"))
    return quality.promote_failures(feed, docs.where("doc_id % 4 = 0").select("question")).select("doc_id")


@EVALUATION.add(
    """WITH c AS (SELECT label, avg(embedding[1])::DOUBLE AS p FROM embeddings GROUP BY label), r AS (SELECT label, round(p, 6) AS score FROM c)
    SELECT label, score, row_number() OVER (ORDER BY score DESC, label)::INTEGER AS place, round(max(score) OVER () - score, 6) AS margin FROM r"""
)
def config_ranking(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").groupBy("label").agg(rounded(F.avg(F.col("embedding")[0])).alias("score"))
    return quality.best_config(rows, "score", ["label"]).withColumn("margin", rounded("margin"))


@EVALUATION.add("SELECT doc_id, round(coalesce(2.0::DOUBLE * (doc_id % 7) * (doc_id % 5) / nullif(7.0 * (doc_id % 5) + 5.0 * (doc_id % 7), 0), 0), 6) AS f1 FROM documents")
def f1_scores(spark, sf_dir):
    p, r = F.col("doc_id") % 7 / 7.0, F.col("doc_id") % 5 / 5.0
    return table(spark, sf_dir, "documents").select("doc_id", rounded(quality.f1(p, r)).alias("f1"))


@EVALUATION.add("SELECT coalesce(CASE WHEN item_id % 3 > 0 THEN 'k' || item_id % 3 END, 'unknown') AS value, count(*) AS samples FROM benchmark GROUP BY 1")
def sample_groups(spark, sf_dir):
    key = F.when(F.col("item_id") % 3 > 0, F.concat(F.lit("k"), (F.col("item_id") % 3).cast("string")))
    meta = F.map_filter(F.create_map(F.lit("topic"), key), lambda _, v: v.isNotNull())
    return quality.group_samples(table(spark, sf_dir, "benchmark").select(meta.alias("metadata")), "topic")


