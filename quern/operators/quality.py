"""Evaluation: ranking metrics, distributions, gates, baselines, tasks, failure promotion.

Metrics are long tables (keys..., metric, value), so one aggregation serves any number of them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.staging import few, join_groups, percentiles, stored

# ---------------------------------------------------------------- relevance and ranking metrics


def relevance(samples: DataFrame, corpus: DataFrame, min_chars: int = 1) -> DataFrame:
    """(query_id, chunk_id) of relevant chunks: same document, named explicitly, or one text holds the other.

    ``samples`` has query_id, reference (array<string>) and optionally document_id and relevant_ids;
    ``corpus`` has chunk_id, text and optionally document_id. Containment pairs are found through
    shared words: the rarest word of each reference must occur in a chunk that holds it.
    """
    parts = []
    if "document_id" in samples.columns and "document_id" in corpus.columns:
        parts.append(samples.select("query_id", "document_id").join(corpus.select("chunk_id", "document_id"), "document_id").select("query_id", "chunk_id"))
    if "relevant_ids" in samples.columns:
        parts.append(samples.select("query_id", F.explode("relevant_ids").alias("chunk_id")))
    refs = samples.select("query_id", F.explode("reference").alias("ref")).select("query_id", F.lower(T.strip(F.col("ref"))).alias("ref")).where(F.length("ref") >= min_chars)
    texts = corpus.select("chunk_id", F.lower("text").alias("text"))
    parts += [_held(refs, "query_id", "ref", texts, "chunk_id", "text"), _held(texts, "chunk_id", "text", refs, "query_id", "ref")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def _held(inner: DataFrame, inner_id: str, small: str, outer: DataFrame, outer_id: str, large: str) -> DataFrame:
    """Pairs whose ``small`` text lies in the ``large`` one, found through a key that both must have.

    An inner token (one between two other tokens of the small text, so cut at both ends as in the
    large text) must be a token of the large text: the pair is joined on the longest such token.
    Small texts with fewer than three tokens are joined on their first characters, three at most,
    with the large texts' runs of as many characters. Only ids, lengths and keys are exploded and joined;
    the texts come to the pairs that are left.
    """
    word = lambda c: F.regexp_extract_all(F.col(c), F.lit("[a-z0-9]+"), F.lit(0))
    longest = F.array_max(F.transform(F.slice(F.col("__w"), F.lit(2), F.greatest(F.size("__w") - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    # what is longer than the longest large text lies in none
    most = outer.agg(F.max(F.length(large)).alias("n")).first().n or 0
    inner = inner.where(F.length(small).between(1, most))
    keyed = inner.withColumn("__w", word(small))
    keyed = stored(keyed.select(inner_id, F.length(small).alias("__s"), longest.alias("__key"), F.when(longest.isNull(), F.least(F.length(small), F.lit(3))).alias("__n"), F.substring(small, 1, 3).alias("__head")))
    size, fits = F.length(large).alias("__l"), F.col("__s") <= F.col("__l")
    found = keyed.where("__key is not null").join(outer.select(outer_id, size, F.explode(F.array_distinct(word(large))).alias("__key")), "__key").where(fits).select(inner_id, outer_id)
    short = keyed.where("__n is not null")
    if not short.isEmpty():
        for n in (1, 2, 3):
            runs = outer.select(outer_id, size, F.explode(F.array_distinct(F.regexp_extract_all(large, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))).alias("__head"))
            found = found.unionByName(short.where(F.col("__n") == n).join(runs, "__head").where(fits).select(inner_id, outer_id))
    # texts are read once more and, as long as the pairs are few, stay where they are
    pairs = few(stored(found.distinct()))
    pairs = pairs.join(inner.select(inner_id, small), inner_id).join(outer.select(outer_id, large), outer_id)
    return pairs.where(F.contains(large, small)).select("query_id", "chunk_id")


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 5, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, recall, precision, mrr, ndcg) of rankings (query_id, chunk_id, rank).

    Precision divides by k. Without relevant chunks everything is 0. ``queries`` adds queries
    that got no result.
    """
    all_queries = (queries if queries is not None else ranked).select("query_id").distinct()
    totals = relevant.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    hits = ranked.join(relevant.distinct(), ["query_id", "chunk_id"], "left_semi")
    top = F.col("rank") <= k
    found = hits.groupBy("query_id").agg(F.count_if(top).alias("hits"), F.min("rank").alias("first"), F.sum(F.when(top, 1 / F.log2(F.col("rank") + 1))).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    rows = all_queries.join(totals, "query_id", "left").join(found, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        "query_id",
        zero(F.col("hits") / F.col("relevant")).alias("recall"),
        zero(F.col("hits") / F.lit(k)).alias("precision"),
        zero(1 / F.col("first")).alias("mrr"),
        zero(F.col("dcg") / ideal).alias("ndcg"),
    )


def rerank_effect(before: DataFrame, after: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, top1_changed, displacement) between two rankings: mean rank change of the chunks in both."""
    one = before.where(F.col("rank") <= k).select("query_id", "chunk_id", F.col("rank").alias("old"))
    both = one.join(after.where(F.col("rank") <= k).select("query_id", "chunk_id", F.col("rank").alias("new")), ["query_id", "chunk_id"], "full")
    grouped = both.groupBy("query_id").agg(
        F.max(F.when(F.col("old") == 1, F.col("chunk_id"))).alias("a"), F.max(F.when(F.col("new") == 1, F.col("chunk_id"))).alias("b"), F.avg(F.abs(F.col("old") - F.col("new"))).alias("d")
    )
    return grouped.select("query_id", F.coalesce(F.col("a") != F.col("b"), F.lit(False)).alias("top1_changed"), F.coalesce("d", F.lit(0.0)).alias("displacement"))


def context_metrics(selected: DataFrame, references: DataFrame, relevant: DataFrame, contexts: DataFrame) -> DataFrame:
    """Precision by tokens, recall of references, efficiency, duplicates, sources and compression of contexts.

    ``selected`` holds chosen chunks (query_id, chunk_id, token_count), ``contexts`` the assembled rows,
    ``references`` (query_id, reference array), ``relevant`` (query_id, chunk_id).
    """
    marked = selected.join(relevant.distinct().withColumn("hit", F.lit(True)), ["query_id", "chunk_id"], "left")
    source = F.col("document_id") if "document_id" in selected.columns else F.col("chunk_id")
    precision = marked.groupBy("query_id").agg(T.ratio(F.sum(F.when(F.col("hit"), F.col("token_count"))), F.sum("token_count")).alias("precision"), F.count_distinct(source).alias("source_diversity"))
    refs = references.select("query_id", F.size("reference").alias("n"), F.explode("reference").alias("ref")).join(contexts.select("query_id", "context_text"), "query_id")
    ref = F.lower(T.strip(F.col("ref")))
    words = T.token_set(ref)
    hit = (F.size(words) > 0) & ((T.coverage(words, T.token_set(F.col("context_text"))) >= 0.5) | F.contains(F.lower("context_text"), ref))
    recall = refs.groupBy("query_id").agg((F.count_if(hit) / F.max("n")).alias("recall"))
    rows = contexts.join(precision, "query_id", "left").join(recall, "query_id", "left")
    p, r = F.coalesce("precision", F.lit(0.0)), F.coalesce("recall", F.lit(0.0))
    return rows.select(
        "query_id", p.alias("context_precision"), r.alias("context_recall"), (p * r / F.greatest("budget_utilization", F.lit(0.01))).alias("token_efficiency"),
        T.ratio(F.col("duplicates_removed"), F.col("chunks_in")).alias("dedup_rate"), "budget_utilization", F.coalesce("source_diversity", F.lit(0)).alias("source_diversity"),
        F.when(F.col("tokens_out") > 0, F.col("tokens_in") / F.col("tokens_out")).otherwise(1.0).alias("compression_ratio"), ((p > 0) | (r > 0)).alias("has_relevant_content"),
    )


def lexical_context_quality(rows: DataFrame) -> DataFrame:
    """Fallback context precision and recall by white-space words, from (query_id, contexts array, ground_truth)."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(T.strip(c)), r"\s+"), lambda w: w != ""))
    truth = F.col("__truth")
    rows = rows.withColumn("__truth", words(F.col("ground_truth")))
    n = F.greatest(F.size(truth), F.lit(1))
    good = F.size(F.filter("contexts", lambda c: F.size(F.array_intersect(truth, words(c))) / n > 0.1))
    held = F.flatten(F.transform("contexts", words))
    return rows.select("query_id", T.ratio(good, F.size("contexts")).alias("context_precision"), (F.size(F.array_intersect(truth, held)) / n).alias("context_recall"))


# ---------------------------------------------------------------- distributions and averages


def distribution(rows: DataFrame, keys: Sequence[str], value: str = "value", threshold: Column | None = None, higher_is_better: Column | None = None) -> DataFrame:
    """count, mean, min, max, p10, p50, p90, p95, population deviation and pass rate of each group."""
    better = F.lit(True) if higher_is_better is None else higher_is_better
    passed = F.lit(0.0) if threshold is None else F.when(better, F.col(value) >= threshold).otherwise(F.col(value) <= threshold).cast("double")
    grouped = rows.groupBy(*keys).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_pop(value).alias("std"), F.avg(passed).alias("pass_rate")
    )
    points = {n: F.col("p")[k] for k, n in enumerate(("p10", "p50", "p90", "p95"))}
    return join_groups(grouped, percentiles(rows, keys, value, (0.1, 0.5, 0.9, 0.95)), keys).withColumns(points).drop("p", "n")


def averages(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_queries"), *(F.avg(F.col(m).cast("double")).alias(m) for m in metrics))


def long_form(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide metric columns to (keys..., metric, value)."""
    return rows.unpivot(list(keys), [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


# ---------------------------------------------------------------- thresholds and gates

# Metric, good, warning and critical bound, whether higher is better.
THRESHOLDS = [
    ("retrieval_mrr", 0.70, 0.50, 0.30, True),
    ("retrieval_recall", 0.80, 0.60, 0.40, True),
    ("retrieval_precision", 0.70, 0.50, 0.30, True),
    ("rerank_mrr_lift", 0.05, 0.0, -0.10, True),
    ("context_precision", 0.70, 0.50, 0.30, True),
    ("context_recall", 0.70, 0.50, 0.30, True),
    ("faithfulness", 0.85, 0.70, 0.50, True),
    ("citation_precision", 0.80, 0.60, 0.40, True),
    ("hallucination_rate", 0.15, 0.30, 0.50, False),
    ("answer_relevancy", 0.70, 0.50, 0.30, True),
    ("adversarial_pass_rate", 0.90, 0.70, 0.50, True),
    ("e2e_latency_p95_ms", 5000.0, 10000.0, 30000.0, False),
]
STRICT = {"faithfulness": (0.90, 0.80, 0.70), "hallucination_rate": (0.10, 0.20, 0.35), "adversarial_pass_rate": (0.95, 0.85, 0.70)}
LENIENT = {"faithfulness": (0.50, 0.30, 0.10), "hallucination_rate": (0.50, 0.70, 0.90), "adversarial_pass_rate": (0.50, 0.30, 0.10)}


def thresholds(spark: SparkSession, profile: str = "default") -> DataFrame:
    """The threshold table of a profile: default, strict or lenient."""
    change = {"default": {}, "strict": STRICT, "lenient": LENIENT}[profile]
    rows = [(m, *change.get(m, (g, w, c)), h) for m, g, w, c, h in THRESHOLDS]
    return spark.createDataFrame(rows, "metric string, good double, warning double, critical double, higher_is_better boolean")


def level(value: Column, mode: str = "code") -> Column:
    """good, warning or critical; mode "documented" calls values between the warning and critical bound warning too."""
    bound = F.col("warning") if mode == "code" else F.col("critical")
    reaches = lambda b: F.when(F.col("higher_is_better"), value >= b).otherwise(value <= b)
    return F.when(value.isNull(), None).when(reaches(F.col("good")), "good").when(reaches(bound), "warning").otherwise("critical")


def gate_checks(metrics: DataFrame, limits: DataFrame, distributions: DataFrame | None = None, mode: str = "code") -> DataFrame:
    """A check for each metric with a threshold: level and verdict; a critical tenth percentile makes the metric critical."""
    rows = metrics.join(limits, "metric")
    rows = rows.join(distributions.select("metric", "p10"), "metric", "left") if distributions is not None else rows.withColumn("p10", F.lit(None).cast("double"))
    tail = F.coalesce(level(F.col("p10"), mode) == "critical", F.lit(False))
    rows = rows.withColumn("tail_critical", tail).withColumn("level", F.when(tail, "critical").otherwise(level(F.col("value"), mode)))
    verdict = F.when(F.col("level") == "critical", "fail").when(F.col("level") == "warning", "warning").otherwise("pass")
    return rows.select("metric", "value", "p10", "level", verdict.alias("verdict"), "tail_critical")


def gate_verdict(checks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The overall verdict: fail beats warning beats pass."""
    worst = F.max(F.when(F.col("verdict") == "fail", 2).when((F.col("verdict") == "warning") | F.col("tail_critical"), 1).otherwise(0))
    grouped = checks.groupBy(*keys).agg(worst.alias("w"), F.count_if(F.col("verdict") == "fail").alias("failures"), F.count_if(F.col("verdict") == "warning").alias("warnings"))
    return grouped.select(*keys, F.when(F.col("w") == 2, "fail").when(F.col("w") == 1, "warning").otherwise("pass").alias("verdict"), "failures", "warnings")


# ---------------------------------------------------------------- baselines

# Which metrics the release comparison counts, by direction.
HIGHER_BETTER = ["retrieval_mrr", "retrieval_recall", "retrieval_precision", "rerank_mrr_lift", "context_precision", "context_recall", "faithfulness", "citation_precision", "answer_relevancy", "adversarial_pass_rate"]
LOWER_BETTER = ["hallucination_rate", "e2e_latency_p95_ms"]


def baseline_delta(current: DataFrame, baseline: DataFrame, significance: DataFrame | None = None) -> DataFrame:
    """Change of each metric in both tables; within 0.01 it is stable; only the hallucination rate improves by falling."""
    rows = current.join(baseline.withColumnRenamed("value", "baseline"), "metric").withColumnRenamed("value", "current")
    delta = F.col("current") - F.col("baseline")
    up = (delta > 0) != (F.col("metric") == "hallucination_rate")
    direction = F.when(F.abs(delta) < 0.01, "stable").when(up, "improved").otherwise("degraded")
    if significance is not None:
        rows = rows.join(significance.select("metric", "significant"), "metric", "left")
    percent = F.when(F.col("baseline") != 0, delta / F.col("baseline") * 100).otherwise(0.0)
    flag = F.coalesce(F.col("significant"), F.lit(False)) if significance is not None else F.lit(False)
    return rows.select("metric", "current", "baseline", delta.alias("delta"), percent.alias("delta_pct"), flag.alias("significant"), direction.alias("direction"))


def welch(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("metric",), value: str = "value") -> DataFrame:
    """Welch's t of two samples for each key, and whether it is beyond 2; 0 with fewer than two values or no spread."""
    side = lambda rows, s: rows.groupBy(*keys).agg(F.avg(value).alias(f"m{s}"), F.var_samp(value).alias(f"v{s}"), F.count(value).alias(f"n{s}"))
    rows = side(a, "a").join(side(b, "b"), list(keys))
    error = F.sqrt(F.col("va") / F.col("na") + F.col("vb") / F.col("nb"))
    t = F.when((F.col("na") < 2) | (F.col("nb") < 2), 0.0).otherwise(F.coalesce(F.try_divide(F.col("ma") - F.col("mb"), error), F.lit(0.0)))
    return rows.withColumn("t", t).select(*keys, "t", (F.abs("t") > 2).alias("significant"))


def release_gate(current: DataFrame, baseline: DataFrame, min_improvements: int = 3, higher: Sequence[str] = HIGHER_BETTER, lower: Sequence[str] = LOWER_BETTER) -> DataFrame:
    """(improved, regressed, passed): no regression and enough improvements beyond 0.001; latency below 100 ms cannot regress."""
    rows = current.join(baseline.withColumnRenamed("value", "base"), "metric")
    change = F.when(F.col("metric").isin(list(higher)), F.col("value") - F.col("base")).when(F.col("metric").isin(list(lower)), F.col("base") - F.col("value"))
    excused = (F.col("metric") == "e2e_latency_p95_ms") & (F.col("value") < 100)
    counts = rows.agg(F.count_if(change > 0.001).alias("improved"), F.count_if((change < -0.001) & ~excused).alias("regressed"))
    return counts.withColumn("passed", (F.col("regressed") == 0) & (F.col("improved") >= min_improvements))


# ---------------------------------------------------------------- tasks

# Floors for each task (MRR, faithfulness, answer relevancy; context recall is one for all) and composite weights.
TASK_FLOORS = {
    "incident_rca": (0.60, 0.25, 0.20),
    "incident_resolution": (0.60, 0.25, 0.15),
    "how_to": (0.50, 0.15, 0.15),
    "runbook_procedure": (0.55, 0.55, 0.18),
    "conceptual": (0.50, 0.50, 0.15),
}
CONTEXT_RECALL_FLOOR = 0.90
COMPOSITE_WEIGHTS = {
    "retrieval_mrr": 0.14,
    "retrieval_ndcg": 0.10,
    "retrieval_recall": 0.06,
    "rerank_mrr": 0.10,
    "rerank_ndcg": 0.08,
    "rerank_ndcg_lift": 0.06,
    "rerank_mrr_lift": 0.04,
    "top1_change_rate": 0.04,
    "context_precision": 0.16,
    "context_recall": 0.04,
    "faithfulness": 0.10,
    "answer_relevancy": 0.06,
    "citation_precision": 0.02,
}


def task_type(explicit: Column, route: Column, kind: Column, topic: Column, question: Column) -> Column:
    """The task of a sample: named, else inferred from route, document type and topic."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    # fixed values: the words that tell a resolution, and those of routes, kinds and topics
    fixes = T.contains_any(low(question), ["resolved", "resolution", "fix", "mitigation", "implement"])
    inferred = (
        F.when((low(route) == "incident") & fixes, "incident_resolution")
        .when(low(route) == "incident", "incident_rca")
        .when(low(route).isin("async", "how_to", "how-to"), "how_to")
        .when(low(kind) == "runbook", "runbook_procedure")
        .when(low(topic).isin("scheduling", "resources", "taints"), "conceptual")
        .otherwise("how_to")
    )
    return F.when(explicit.isNotNull(), F.lower(T.strip(explicit))).otherwise(inferred)


def composite(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted mean of the metrics present (keys..., metric, value), weights renormalised; rerank metrics fall back to retrieval's."""
    present = metrics.where(F.col("value").isNotNull())
    wide = present.groupBy(*keys).pivot("metric", list(COMPOSITE_WEIGHTS)).agg(F.first("value"))
    value = {m: F.col(m) for m in COMPOSITE_WEIGHTS}
    value["rerank_mrr"], value["rerank_ndcg"] = F.coalesce("rerank_mrr", "retrieval_mrr"), F.coalesce("rerank_ndcg", "retrieval_ndcg")
    total = sum((F.when(v.isNotNull(), v * COMPOSITE_WEIGHTS[m]).otherwise(0.0) for m, v in value.items()), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), COMPOSITE_WEIGHTS[m]).otherwise(0.0) for m, v in value.items()), F.lit(0.0))
    return wide.select(*keys, T.ratio(total, weight).alias("composite"))


def task_failures(metrics: DataFrame) -> DataFrame:
    """(task_type, metric, value, floor) of metrics more than 0.001 below the task's floor."""
    rows = [(t, m, f) for t, floors in TASK_FLOORS.items() for m, f in zip(("retrieval_mrr", "faithfulness", "answer_relevancy", "context_recall"), (*floors, CONTEXT_RECALL_FLOOR), strict=True)]
    floors = metrics.sparkSession.createDataFrame(rows, "task_type string, metric string, floor double")
    return metrics.join(F.broadcast(floors), ["task_type", "metric"]).where(F.col("value") < F.col("floor") - 0.001).select("task_type", "metric", "value", "floor")


def best_config(results: DataFrame, score: str, order: Sequence[str]) -> DataFrame:
    """Configurations ranked by score, the first of equals first, with the winner's margin over each."""
    w = Window.orderBy(F.desc(score), *order)  # a handful of configurations
    return results.withColumn("place", F.row_number().over(w)).withColumn("margin", F.first(score).over(w) - F.col(score))


def rerank_grid(found: dict[str, DataFrame], rerankers: dict[str, Callable[[DataFrame], DataFrame]], relevant: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(mode, reranker, n_queries, mrr, ndcg, mrr_lift, ndcg_lift, top1_change_rate, displacement): every reranker on the candidates of every retrieval mode."""
    out = None
    for mode, candidates in found.items():
        before = ranking_metrics(candidates, relevant, k, queries).select("query_id", F.col("mrr").alias("old_mrr"), F.col("ndcg").alias("old_ndcg"))
        for name, rerank in rerankers.items():
            after = rerank(candidates)
            rows = ranking_metrics(after, relevant, k, queries).join(before, "query_id").join(rerank_effect(candidates, after, k), "query_id", "left")
            rows = rows.agg(
                F.count(F.lit(1)).alias("n_queries"), F.avg("mrr").alias("mrr"), F.avg("ndcg").alias("ndcg"), F.avg(F.col("mrr") - F.col("old_mrr")).alias("mrr_lift"), F.avg(F.col("ndcg") - F.col("old_ndcg")).alias("ndcg_lift"),
                F.avg(F.coalesce("top1_changed", F.lit(False)).cast("double")).alias("top1_change_rate"), F.avg(F.coalesce("displacement", F.lit(0.0))).alias("displacement"),
            ).select(F.lit(mode).alias("mode"), F.lit(name).alias("reranker"), "*")
            out = rows if out is None else out.unionByName(rows)
    return out


def infer_sources(samples: DataFrame) -> DataFrame:
    """(document_id, text): the source of each document put together from the references of its samples, in order of their ids."""
    text = F.concat(F.array_join("reference", "\n\n"), F.lit("\n\n")).alias("text")
    rows = samples.select(F.coalesce("document_id", F.lit("default")).alias("document_id"), "query_id", text)
    parts = F.array_sort(F.collect_list(F.struct("query_id", "text")))
    return rows.groupBy("document_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def f1(precision: Column, recall: Column) -> Column:
    return T.ratio(2 * precision * recall, precision + recall)


def grid(spark: SparkSession, strategies: Sequence[str], sizes: Sequence[int], overlaps: Sequence[int]) -> DataFrame:
    """Chunking configurations to compare; overlaps not below the size are left out."""
    rows = [(s, n, o) for s in strategies for n in sizes for o in overlaps if o < n]
    return spark.createDataFrame(rows, "strategy string, chunk_size int, chunk_overlap int")


# ---------------------------------------------------------------- failures


def promote_failures(failures: DataFrame, dataset: DataFrame, below: float = 0.5) -> DataFrame:
    """Failures to add to the dataset: low score, not promoted before, question not known; of equal questions the first."""
    low = failures.where(~F.coalesce("promoted", F.lit(False)) & (F.coalesce("failure_score", F.lit(1.0)) < below))
    new = low.join(dataset.select("question").distinct(), "question", "left_anti")
    first = F.row_number().over(Window.partitionBy("question").orderBy("recorded_at", "record_id"))
    return new.withColumn("__turn", first).where("__turn = 1").drop("__turn")


def mark_promoted(failures: DataFrame, promoted: DataFrame, dataset: DataFrame, below: float = 0.5) -> DataFrame:
    """The feed after a promotion: promoted rows, and low ones whose question the dataset knew or has now."""
    known = dataset.select("question").unionByName(promoted.select("question")).distinct().withColumn("__known", F.lit(True))
    rows = failures.join(known, "question", "left")
    done = F.coalesce("promoted", F.lit(False)) | (F.coalesce("__known", F.lit(False)) & (F.coalesce("failure_score", F.lit(1.0)) < below))
    return rows.withColumn("promoted", done).drop("__known").select(*failures.columns)


def filter_samples(samples: DataFrame, conditions: Mapping[str, str]) -> DataFrame:
    """Samples whose metadata map has all the given values."""
    for key, value in conditions.items():
        samples = samples.where(F.col("metadata")[key] == value)
    return samples


def group_samples(samples: DataFrame, key: str) -> DataFrame:
    return samples.groupBy(F.coalesce(F.col("metadata")[key], F.lit("unknown")).alias("value")).agg(F.count(F.lit(1)).alias("samples"))


def with_task_types(samples: DataFrame) -> DataFrame:
    """Samples with the task type written into their metadata."""
    m = F.col("metadata")
    kind = task_type(m["task_type"], m["route"], m["type"], m["topic"], F.col("question"))
    rest = F.map_filter("metadata", lambda k, _: k != "task_type")
    return samples.withColumn("metadata", F.map_concat(rest, F.create_map(F.lit("task_type"), kind)))


def columnar(samples: DataFrame) -> DataFrame:
    """One row of lists (questions, contexts, ground truths, in id order): bounded by an evaluation set."""
    row = F.array_sort(F.collect_list(F.struct("query_id", "question", "contexts", "ground_truth")))
    # a field of an array of structs is the array of the field
    return samples.agg(row.alias("r")).select(*(F.col(f"r.{f}").alias(f) for f in ("question", "contexts", "ground_truth")))
