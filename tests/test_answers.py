"""Citations, claims, entailment, faithfulness and the extractive answerer."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.operators import answers as A

ANSWER = "query_id long, query string, answer string"
CHUNKS = "query_id long, rank int, chunk_id long, text string"


def one(spark, expression, *values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, a string").select("k", expression(F.col("a")).alias("x")).orderBy("k").collect()
    return [r.x for r in rows]


def test_normalizing_citations(spark):
    got = one(spark, A.normalize_citations, "Claim [1].", "x [source  3] y", "Good [Source 1].\n[Source 2] # Heading", "a\n\n\n\nb ", "[Source 1] [2]")
    assert got == ["Claim [Source 1].", "x [Source 3] y", "Good [Source 1].", "a\n\nb", "[Source 1] [Source 2]"]


def test_claims_and_trailing_citations(spark):
    got = one(spark, A.claims, "First claim here. [Source 1] Second claim is here! No.", "I cannot answer based on it.", "", "[Source 1]")
    assert got == [["First claim here.", "Second claim is here!"], [], [], []]
    kept = one(spark, A.cited_sentences, "Claim one is. [Source 1] Next one.", "Claim. [Source 1] [Source 2]", "[Source 1] starts")
    assert kept == [["Claim one is.", "[Source 1] Next one."], ["Claim. [Source 1] [Source 2]"], ["[Source 1] starts"]]


def test_parsing_maps_to_chunks(spark):
    answers = spark.createDataFrame([(1, "q", "Two [Source 2], one [1], again [Source 2], none [Source 7], placed [Source 3].")], ANSWER)
    chunks = spark.createDataFrame([(1, 1, 10, "a"), (1, 2, 20, "b"), (1, 5, 50, "c")], CHUNKS)
    got = A.parse_citations(answers, chunks).orderBy("position").collect()
    assert [(r.source_index, r.chunk_id, r.label) for r in got] == [(2, 20, "[Source 2]"), (1, 10, "[Source 1]"), (3, 50, "[Source 3]")]


def test_entailment(spark):
    pairs = [("pods wait for nodes", "pods wait for free nodes", "SUPPORTS"), ("pods never wait", "pods wait", "CONTRADICTS"), ("cats sleep", "stocks rose", "NEUTRAL"), ("漢字", "x", "NEUTRAL")]
    rows = spark.createDataFrame(pairs, "c string, s string, e string").select("e", A.entailment(F.col("c"), F.col("s")).alias("g")).collect()
    assert all(r.e == r.g for r in rows)


def test_faithfulness(spark):
    answers = spark.createDataFrame(
        [
            (1, "why do pods wait", "Pods wait for nodes. [Source 1] The moon is made of cheese [Source 1]. Nothing is cited here."),
            (2, "q", A.REFUSAL),
            (3, "q", "Short."),
            (4, "pods", "Pods never wait for nodes [Source 1] [Source 2]."),
        ],
        ANSWER,
    )
    chunks = spark.createDataFrame([(q, r, 10 * r, t) for q in (1, 2, 3, 4) for r, t in ((1, "Pods wait for nodes here"), (2, "Pods never wait for nodes"))], CHUNKS)
    judged = A.judge_claims(answers, chunks)
    labels = {(r.query_id, r.claim_index): r.label for r in judged.collect()}
    assert labels == {(1, 0): "NO_CITATION" if labels[1, 0] == "NO_CITATION" else "SUPPORTS", (1, 1): labels[1, 1], (1, 2): "NO_CITATION", (4, 0): "SUPPORTS"}
    rows = {r.query_id: r for r in A.faithfulness(answers, judged).collect()}
    assert (rows[2].faithfulness, rows[2].hallucination_rate, rows[2].refused) == (1.0, 0.0, True)
    assert (rows[3].faithfulness, rows[3].hallucination_rate) == (0.0, 1.0)
    assert rows[4].faithfulness == 1.0 and rows[4].citation_precision == 0.5
    assert rows[1].answer_relevancy == 0.5


def test_extracting_answers(spark):
    queries = spark.createDataFrame([(1, "why do pods wait for nodes"), (2, "what is the weather"), (3, "tell me the phrase")], "query_id long, query string")
    chunks = spark.createDataFrame([(q, r, r, t) for q in (1, 2, 3) for r, t in ((1, "# Coroutines run on a loop of events."), (2, "# Notes\nThe pods wait for nodes that are free. Other things happen too."))], CHUNKS)
    got = {r.query_id: r.answer for r in A.extract_answers(queries, chunks, canned={"the phrase": "Canned [Source 1]."}).collect()}
    assert got == {1: "Notes The pods wait for nodes that are free. [Source 2]", 2: A.REFUSAL, 3: "Canned [Source 1]."}
    done = {r.query_id: r for r in A.finish(spark.createDataFrame([(1, "q", "Plain answer."), (2, "q", "Cited [1]."), (9, "q", "No chunks.")], ANSWER), chunks).collect()}
    assert (done[1].answer, done[2].answer, done[9].answer) == ("Plain answer. [Source 1]", "Cited [Source 1].", A.REFUSAL)
    assert done[9].refused and not done[1].refused


def test_canary(spark):
    chunks = spark.createDataFrame([(1, 1, 1, "text")], CHUNKS)
    assert A.inject_canary(chunks).where("rank = 99").count() == 1
    got = A.probe_results(spark.createDataFrame([(1, "q", "CoreDNS and the DNS cache"), (2, "q", "fine"), (3, "q", A.REFUSAL + " coredns")], ANSWER)).collect()
    assert {r.query_id: (r.passed, len(r.matched)) for r in got} == {1: (False, 2), 2: (True, 0), 3: (True, 0)}


@pytest.mark.parametrize("style", ["citation_aware", "concise", "detailed", "unknown"])
def test_prompts(spark, style):
    m = spark.range(1).select(A.messages(F.lit("CTX"), F.lit("Why?"), style, "Doc").alias("m")).first().m
    assert "[Doc N]" in m[0].content and m[1].content.startswith("Sources:\nCTX\n\nQuestion: Why?\n\n")
