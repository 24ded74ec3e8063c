"""The whole evaluation: every layer over one set of questions, as long metrics, with distributions and a gate.

Candidates, contexts and answers are computed once, kept in memory or on disk, and feed all layers;
``Evaluation.release`` lets go of them. A configuration is a row of settings, so
ablations and task slices are further keys of the same long table.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import answers, chunking, context, quality, search


@dataclass(frozen=True)
class Setup:
    """A pipeline configuration: retrieval mode, reranking, context strategy."""

    name: str = "production"
    mode: str = "hybrid"
    rerank: bool = True
    strategy: str = "full"
    k: int = 5
    top_n: int = 20
    max_tokens: int = 2048
    #: decimal places that retrieval scores are rounded to before they are ranked
    places: int | None = None


#: The configurations an ablation compares.
ABLATION = (Setup(), Setup("dense_only", "dense", False), Setup("bm25_only", "keyword", False), Setup("hybrid_no_rerank", "hybrid", False))


@dataclass
class Evaluation:
    """Long metrics (config, query_id, metric, value) and what they were computed from."""

    metrics: DataFrame
    answers: DataFrame
    probes: DataFrame
    held: tuple[DataFrame, ...] = ()
    #: (config, layer, milliseconds a question) of the layers, each timed while its rows were made
    timings: tuple[tuple[str, str, float], ...] = ()

    def release(self) -> None:
        for frame in self.held:
            frame.unpersist()

    def averages(self) -> DataFrame:
        passed = self.probes.groupBy("config").agg(F.avg(F.col("passed").cast("double")).alias("value")).withColumn("metric", F.lit("adversarial_pass_rate"))
        means = self.metrics.groupBy("config", "metric").agg(F.avg("value").alias("value"))
        return means.unionByName(passed.select("config", "metric", "value")).unionByName(self.latencies())

    def latencies(self) -> DataFrame:
        """(config, metric, value): milliseconds a question of each layer, and of all of them. A batch has no tail, so the whole stands for its 95th percentile too."""
        rows = [(c, f"{layer}_latency_ms", ms) for c, layer, ms in self.timings]
        for config in dict.fromkeys(c for c, _, _ in self.timings):
            rows.append((config, "e2e_latency_p95_ms", sum(ms for c, _, ms in self.timings if c == config)))
        return self.metrics.sparkSession.createDataFrame(rows, "config string, metric string, value double")

    def distributions(self) -> DataFrame:
        return quality.distribution(self.metrics, ["config", "metric"])

    def gate(self, limits: DataFrame, mode: str = "code") -> DataFrame:
        """Checks of every configuration; ``quality.gate_verdict(checks, ["config"])`` sums them up."""
        rows = self.averages().join(limits, "metric").join(self.distributions().select("config", "metric", "p10"), ["config", "metric"], "left")
        tail = F.coalesce(quality.level(F.col("p10"), mode) == "critical", F.lit(False))
        rows = rows.withColumn("tail_critical", tail).withColumn("level", F.when(tail, "critical").otherwise(quality.level(F.col("value"), mode)))
        verdict = F.when(F.col("level") == "critical", "fail").when(F.col("level") == "warning", "warning").otherwise("pass")
        return rows.select("config", "metric", "value", "p10", "level", verdict.alias("verdict"), "tail_critical")

    def ranking(self) -> DataFrame:
        """Configurations by composite score, with the winner's margin."""
        return quality.best_config(quality.composite(self.averages(), ["config"]), "composite", ["config"])


def evaluate(chunks: DataFrame, samples: DataFrame, setup: Setup = Setup()) -> Evaluation:
    """Run one configuration.

    ``chunks`` has chunk_id, text and, for dense and hybrid retrieval, embedding; ``samples`` has
    query_id, query, reference (array<string>) and, likewise, embedding. Where both have a
    document_id, a question that has one is answered from its document alone.
    """
    scope = "document_id" if "document_id" in chunks.columns and "document_id" in samples.columns else None
    service = search.RetrievalService(chunks, places=setup.places, scope=scope)
    asked = samples.withColumn("text", F.col("query"))
    n, clock = max(samples.count(), 1), {}

    def timed(layer: str, frame: DataFrame) -> DataFrame:
        start = time.perf_counter()
        frame.persist().count()
        clock[layer] = (time.perf_counter() - start) * 1000 / n
        return frame

    relevant = quality.relevance(samples, chunks.select("chunk_id", "text", *([scope] if scope else []))).persist()
    found = timed("retrieval", service.candidates(samples, service.retrieve(asked, setup.mode, setup.top_n)).drop("dense_rank", "keyword_rank"))
    order = search.lexical_rerank(found, setup.k) if setup.rerank else search.pass_through(found, setup.k)
    order = timed("rerank", order)
    config = context.AssemblyConfig(strategy=setup.strategy, max_tokens=setup.max_tokens)
    chosen = timed("context", context.select_chunks(order, config))
    questions = samples.select("query_id", "query")
    answered = timed("generation", answers.finish(answers.extract_answers(questions, chosen), chosen).select("query_id", "query", "answer"))

    before = quality.ranking_metrics(found, relevant, setup.k, questions)
    after = quality.ranking_metrics(order, relevant, setup.k, questions)
    parts = [
        quality.long_form(before, ["query_id"], ["recall", "precision", "mrr", "ndcg"]).withColumn("metric", F.concat(F.lit("retrieval_"), "metric")),
        quality.long_form(after, ["query_id"], ["mrr", "ndcg"]).withColumn("metric", F.concat(F.lit("rerank_"), "metric")),
        quality.long_form(_lift(before, after), ["query_id"], ["rerank_mrr_lift", "rerank_ndcg_lift"]),
        quality.long_form(quality.rerank_effect(found, order, setup.k).select("query_id", F.col("top1_changed").cast("double").alias("top1_change_rate")), ["query_id"], ["top1_change_rate"]),
        quality.long_form(quality.context_metrics(chosen, samples, relevant, context.assemble(chosen, config)), ["query_id"], ["context_precision", "context_recall", "token_efficiency"]),
        quality.long_form(answers.faithfulness(answered, answers.judge_claims(answered, chosen)), ["query_id"], ["faithfulness", "citation_precision", "hallucination_rate", "answer_relevancy"]),
    ]
    metrics = parts[0]
    for p in parts[1:]:
        metrics = metrics.unionByName(p)
    metrics = metrics.withColumn("config", F.lit(setup.name)).persist()
    probes = answers.probe_results(answers.extract_answers(questions, answers.inject_canary(chosen.select("query_id", "rank", "text"))))
    tag = lambda df: df.withColumn("config", F.lit(setup.name))
    return Evaluation(metrics, tag(answered), tag(probes), (metrics, answered, chosen, order, found, relevant), tuple((setup.name, layer, ms) for layer, ms in clock.items()))


def _lift(before: DataFrame, after: DataFrame) -> DataFrame:
    old = before.select("query_id", F.col("mrr").alias("m"), F.col("ndcg").alias("n"))
    return after.join(old, "query_id").select("query_id", (F.col("mrr") - F.col("m")).alias("rerank_mrr_lift"), (F.col("ndcg") - F.col("n")).alias("rerank_ndcg_lift"))


def ablation(chunks: DataFrame, samples: DataFrame, setups: tuple[Setup, ...] = ABLATION) -> Evaluation:
    """All configurations in one evaluation."""
    runs = [evaluate(chunks, samples, s) for s in setups]
    return Evaluation(*(_all([getattr(r, part) for r in runs]) for part in ("metrics", "answers", "probes")), tuple(f for r in runs for f in r.held), tuple(t for r in runs for t in r.timings))


def chunking_benchmark(samples: DataFrame, configs: Sequence[tuple[str, int, int]], k: int = 5, min_chunk_size: int = 100, places: int | None = None) -> DataFrame:
    """A row for each configuration (strategy, chunk size, overlap): lexical context precision, recall and F1 of what its chunks of the inferred sources bring back, and the chunks' sizes.

    ``samples`` has query_id, query, ground_truth, reference (array<string>) and document_id. The k chunks that
    share most words with a question are its context. Overlaps not below the size are left out.
    """
    sources, out = quality.infer_sources(samples), None
    for strategy, size, overlap in configs:
        if overlap >= size:
            continue
        config = chunking.ChunkerConfig(size, overlap, min(min_chunk_size, size), max(size, 2 * size))
        chunks = chunking.chunk_documents(sources, strategy, config, id_col="document_id").where("error is null")
        number = F.coalesce(F.col("document_id").try_cast("long") * 100_000 + F.col("chunk_index"), F.xxhash64("document_id", "chunk_index"))
        chunks = chunks.select(number.alias("chunk_id"), F.col("chunk_text").alias("text"), "token_count").persist()
        found = search.lexical_overlap(chunks, samples.select("query_id", F.col("query").alias("text")), k, doc_id="chunk_id", places=places)
        held = found.join(chunks.select("chunk_id", "text"), "chunk_id").groupBy("query_id").agg(F.collect_list("text").alias("contexts"))
        rows = samples.select("query_id", "ground_truth").join(held, "query_id", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
        score = quality.lexical_context_quality(rows).agg(F.avg("context_precision").alias("context_precision"), F.avg("context_recall").alias("context_recall"))
        sizes = chunks.agg(F.count(F.lit(1)).alias("total_chunks"), F.avg("token_count").alias("avg_chunk_tokens"), F.min("token_count").alias("min_chunk_tokens"), F.max("token_count").alias("max_chunk_tokens"))
        row = score.crossJoin(sizes).select(F.lit(strategy).alias("strategy"), F.lit(size).alias("chunk_size"), F.lit(overlap).alias("chunk_overlap"), "*")
        row = row.withColumn("f1", quality.f1(F.col("context_precision"), F.col("context_recall")))
        out = row if out is None else out.unionByName(row)
    return out


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def by_task(evaluation: Evaluation, tasks: DataFrame) -> DataFrame:
    """Averages for each task (query_id, task_type) with the metrics below the task's floors."""
    means = evaluation.metrics.join(tasks, "query_id").groupBy("task_type", "metric").agg(F.avg("value").alias("value"))
    failed = quality.task_failures(means).select("task_type", "metric", "floor")
    return means.join(failed, ["task_type", "metric"], "left")


def failures(evaluation: Evaluation, samples: DataFrame, faithfulness: float = 0.7, relevancy: float = 0.4) -> DataFrame:
    """Feed rows of unfaithful answers, else of irrelevant ones."""
    wide = evaluation.metrics.groupBy("query_id").pivot("metric", ["faithfulness", "answer_relevancy"]).agg(F.min("value"))
    low = F.when(F.col("faithfulness") < faithfulness, "faithfulness").when(F.col("answer_relevancy") < relevancy, "answer_relevancy")
    rows = wide.withColumn("failure_metric", low).where("failure_metric is not null")
    score = F.when(F.col("failure_metric") == "faithfulness", F.col("faithfulness")).otherwise(F.col("answer_relevancy"))
    rows = rows.join(samples.select("query_id", F.col("query").alias("question"), F.col("reference").alias("reference_context")), "query_id").join(evaluation.answers.select("query_id", F.col("answer").alias("actual_answer")), "query_id")
    return rows.select(F.col("query_id").cast("string").alias("record_id"), "question", "actual_answer", "failure_metric", score.alias("failure_score"), "reference_context", F.lit(False).alias("promoted"))
