"""Ranking metrics, distributions, gates, baselines, tasks and failures on cases worked out by hand."""

from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quern.operators import quality as Q

RANKED = "query_id long, chunk_id string, rank int"


def test_ranking_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, c, k + 1) for k, c in enumerate("acbd")] + [(2, "x", 1)], RANKED)
    relevant = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (3, "z")], "query_id long, chunk_id string")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = {r.query_id: r for r in Q.ranking_metrics(ranked, relevant, 3, queries).collect()}
    assert (got[1].recall, got[1].precision, got[1].mrr) == (1.0, pytest.approx(2 / 3), 1.0)
    assert got[1].ndcg == pytest.approx((1 + 1 / math.log2(4)) / (1 + 1 / math.log2(3)))
    assert all((r.recall, r.precision, r.mrr, r.ndcg) == (0, 0, 0, 0) for q, r in got.items() if q > 1)


def test_relevance_by_containment_is_complete(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "x", "yy"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 7))) for _ in range(40)]
    refs = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) + rng.choice(["", "!", " "]) for _ in range(15)] + ["", "pha bet", "漢字"]
    texts += ["漢字 text", "", "Alpha Beta!"]
    samples = spark.createDataFrame([(q, [r]) for q, r in enumerate(refs)], "query_id long, reference array<string>")
    corpus = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    got = {(r.query_id, r.chunk_id) for r in Q.relevance(samples, corpus).collect()}
    truth = {(q, c) for q, r in enumerate(refs) for c, t in enumerate(texts) if r.strip() and t and (r.lower().strip() in t.lower() or t.lower() in r.lower().strip())}
    assert got == truth


def test_relevance_by_document_and_name(spark):
    samples = spark.createDataFrame([(1, ["zzz"], "d1", ["7"])], "query_id long, reference array<string>, document_id string, relevant_ids array<string>")
    corpus = spark.createDataFrame([("5", "text", "d1"), ("6", "text", "d2")], "chunk_id string, text string, document_id string")
    assert {r.chunk_id for r in Q.relevance(samples, corpus).collect()} == {"5", "7"}


def test_distribution_is_linear_interpolation(spark):
    values = [random.Random(2).random() for _ in range(37)]
    row = Q.distribution(spark.createDataFrame([("m", v) for v in values], "metric string, value double"), ["metric"], threshold=F.lit(0.5)).first()
    s = sorted(values)
    point = lambda p: s[math.floor(36 * p)] + (s[min(36, math.floor(36 * p) + 1)] - s[math.floor(36 * p)]) * (36 * p - math.floor(36 * p))
    assert (row.p10, row.p50, row.p90, row.p95) == tuple(pytest.approx(point(p)) for p in (0.1, 0.5, 0.9, 0.95))
    assert row["std"] == pytest.approx(statistics.pstdev(values)) and row.pass_rate == pytest.approx(sum(v >= 0.5 for v in values) / 37)
    low = Q.distribution(spark.createDataFrame([("m", v) for v in values], "metric string, value double"), ["metric"], threshold=F.lit(0.5), higher_is_better=F.lit(False)).first()
    assert low.pass_rate == pytest.approx(sum(v <= 0.5 for v in values) / 37)


def test_gate_levels_tail_and_verdict(spark):
    metrics = spark.createDataFrame([("retrieval_mrr", 0.75), ("faithfulness", 0.72), ("hallucination_rate", 0.5), ("unknown", 1.0), ("context_recall", 0.45)], "metric string, value double")
    tails = spark.createDataFrame([("retrieval_mrr", 0.2)], "metric string, p10 double")
    checks = {r.metric: r for r in Q.gate_checks(metrics, Q.thresholds(spark), tails).collect()}
    assert {m: r.level for m, r in checks.items()} == {"retrieval_mrr": "critical", "faithfulness": "warning", "hallucination_rate": "critical", "context_recall": "critical"}
    documented = {r.metric: r.level for r in Q.gate_checks(metrics, Q.thresholds(spark), mode="documented").collect()}
    assert documented == {"retrieval_mrr": "good", "faithfulness": "warning", "hallucination_rate": "warning", "context_recall": "warning"}
    assert Q.gate_verdict(Q.gate_checks(metrics, Q.thresholds(spark))).first().verdict == "fail"
    good = metrics.where("metric = 'retrieval_mrr'")
    assert Q.gate_verdict(Q.gate_checks(good, Q.thresholds(spark))).first().verdict == "pass"
    levels = {p: Q.gate_checks(spark.createDataFrame([("faithfulness", 0.82)], "metric string, value double"), Q.thresholds(spark, p)).first().level for p in ("default", "strict", "lenient")}
    assert levels == {"default": "warning", "strict": "warning", "lenient": "good"}


def test_baseline_direction_and_welch(spark):
    schema = "metric string, value double"
    now = spark.createDataFrame([("a", 0.5), ("b", 0.505), ("hallucination_rate", 0.2), ("only", 1.0), ("z", 1.0)], schema)
    then = spark.createDataFrame([("a", 0.4), ("b", 0.5), ("hallucination_rate", 0.4), ("z", 0.0)], schema)
    got = {r.metric: (r.direction, round(r.delta_pct, 6)) for r in Q.baseline_delta(now, then).collect()}
    assert got == {"a": ("improved", 25.0), "b": ("stable", 1.0), "hallucination_rate": ("improved", -50.0), "z": ("improved", 0.0)}
    a, b = [1.0, 2.0, 3.0, 4.0], [6.0, 7.0, 8.0, 9.0]
    frame = lambda v: spark.createDataFrame([("m", x) for x in v] + [("one", 1.0)], schema)
    t = {r.metric: r for r in Q.welch(frame(a), frame(b)).collect()}
    expected = (statistics.mean(a) - statistics.mean(b)) / math.sqrt(statistics.variance(a) / 4 + statistics.variance(b) / 4)
    assert t["m"].t == pytest.approx(expected) and t["m"].significant and (t["one"].t, t["one"].significant) == (0.0, False)
    assert Q.baseline_delta(now, then, Q.welch(frame(a), frame(b))).where("significant").count() == 0


def test_release_gate(spark):
    schema = "metric string, value double"
    now = spark.createDataFrame([("retrieval_mrr", 0.9), ("faithfulness", 0.8), ("context_recall", 0.9), ("e2e_latency_p95_ms", 50.0)], schema)
    then = spark.createDataFrame([("retrieval_mrr", 0.8), ("faithfulness", 0.7), ("context_recall", 0.8), ("e2e_latency_p95_ms", 10.0)], schema)
    r = Q.release_gate(now, then).first()
    assert (r.improved, r.regressed, r.passed) == (3, 0, True)
    r = Q.release_gate(then, now).first()
    assert (r.improved, r.regressed, r.passed) == (1, 3, False)


def test_composite_and_floors(spark):
    rows = [("t", "retrieval_mrr", 0.5), ("t", "faithfulness", 1.0), ("u", "other", 1.0)]
    got = {r.task: r.composite for r in Q.composite(spark.createDataFrame(rows, "task string, metric string, value double"), ["task"]).collect()}
    assert got["t"] == pytest.approx((0.5 * 0.14 + 0.5 * 0.10 + 1.0 * 0.10) / 0.34) and got["u"] == 0.0
    bad = Q.task_failures(spark.createDataFrame([("how_to", "retrieval_mrr", 0.4995), ("how_to", "faithfulness", 0.1), ("conceptual", "context_recall", 0.9)], "task_type string, metric string, value double"))
    assert [(r.task_type, r.metric) for r in bad.collect()] == [("how_to", "faithfulness")]


def test_task_types_and_samples(spark):
    rows = [
        ("1", "q", {"task_type": " How_To "}, "how_to"), ("2", "How was it resolved?", {"route": "incident"}, "incident_resolution"), ("3", "Why?", {"route": "Incident"}, "incident_rca"),
        ("4", "q", {"route": "how-to"}, "how_to"), ("5", "q", {"type": "runbook"}, "runbook_procedure"), ("6", "q", {"topic": "taints"}, "conceptual"), ("7", "q", {}, "how_to"),
    ]
    samples = spark.createDataFrame(rows, "sample_id string, question string, metadata map<string,string>, expected string")
    typed = Q.with_task_types(samples).collect()
    assert all(r.metadata["task_type"] == r.expected for r in typed)
    assert Q.filter_samples(samples, {"type": "runbook"}).count() == 1
    assert {r.value: r.samples for r in Q.group_samples(samples, "route").collect()} == {"incident": 1, "Incident": 1, "how-to": 1, "unknown": 4}


def test_rerank_effect(spark):
    before = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "a", 1)], RANKED)
    after = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "d", 3), (2, "a", 1)], RANKED)
    got = {r.query_id: (r.top1_changed, r.displacement) for r in Q.rerank_effect(before, after).collect()}
    assert got == {1: (True, 1.0), 2: (False, 0.0)}


def test_failure_promotion(spark):
    schema = "record_id string, question string, failure_score double, recorded_at long, promoted boolean"
    feed = spark.createDataFrame([("1", "a", 0.1, 1, False), ("2", "a", 0.2, 2, False), ("3", "b", 0.9, 3, False), ("4", "c", 0.1, 4, True), ("5", "known", 0.1, 5, False), ("6", "n", None, 6, None)], schema)
    known = spark.createDataFrame([("known",)], "question string")
    new = Q.promote_failures(feed, known)
    assert [r.record_id for r in new.collect()] == ["1"]
    marked = {r.record_id: r.promoted for r in Q.mark_promoted(feed, new, known).collect()}
    assert marked == {"1": True, "2": True, "3": False, "4": True, "5": True, "6": False}


def test_configs(spark):
    assert {(r.strategy, r.chunk_size, r.chunk_overlap) for r in Q.grid(spark, ["r"], [32, 64], [16, 32]).collect()} == {("r", 32, 16), ("r", 64, 16), ("r", 64, 32)}
    ranked = Q.best_config(spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.9)], "name string, score double"), "score", ["name"]).orderBy("place").collect()
    assert [(r.name, round(r.margin, 6)) for r in ranked] == [("c", 0.0), ("a", 0.4), ("b", 0.4)]
    assert spark.range(1).select(Q.f1(F.lit(0.0), F.lit(0.0)).alias("z"), Q.f1(F.lit(0.5), F.lit(1.0)).alias("f")).first().f == pytest.approx(2 / 3)
    lists = Q.columnar(spark.createDataFrame([(2, "q2", ["x"], "g2"), (1, "q1", ["y", "z"], "g1")], "query_id long, question string, contexts array<string>, ground_truth string")).first()
    assert lists.question == ["q1", "q2"] and lists.contexts == [["y", "z"], ["x"]]


def test_order_statistics_by_ranges(spark):
    """Percentiles of groups, null ones too, against numpy, with many partitions."""
    import numpy as np

    from quern.operators.staging import order_statistics, percentiles

    rng = np.random.default_rng(2)
    groups = {"a": rng.integers(0, 9, 200).astype(float), None: rng.normal(size=57), "one": np.array([3.5]), "hot": np.full(400, 7.0)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("a", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: (r.n, r.p) for r in percentiles(df, ["g"], "v", (0.1, 0.5, 0.95)).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g][0] == len(values) and got[g][1] == pytest.approx(np.quantile(values, [0.1, 0.5, 0.95]).tolist())
    whole = order_statistics(df, [], "v", ["0", "n - 1", "floor(n / 2)"]).first().p
    every = np.sort(np.concatenate(list(groups.values())))
    assert whole == [every[0], every[-1], every[len(every) // 2]]
    assert percentiles(df.limit(0), ["g"], "v", (0.5,)).count() == 0
    assert {r.g: r["count"] for r in Q.distribution(df, ["g"], "v").collect()} == {g: len(v) for g, v in groups.items()} | {"empty": 0}
