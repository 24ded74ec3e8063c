"""Language models as plain functions: generation, judging and scoring by a client the caller brings.

A client is built once in each Python worker and gets batches; it is the caller's business where it
runs. A judge's reply that names no label falls back to word overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import answers

#: messages of one prompt -> reply
Client = Callable[[list[dict[str, str]]], str]

JUDGE_PROMPT = "Does the source support the claim? Source:\n{source}\n\nClaim:\n{claim}\n\nReply with one word: SUPPORTS, CONTRADICTS or NEUTRAL."


def generate(prompts: DataFrame, make: Callable[[], Client], messages_col: str = "messages") -> DataFrame:
    """Prompts (an array of role and content) with the client's ``answer``."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make()
        for prompts_ in batches:
            yield prompts_.map(lambda m: client([dict(role=x["role"], content=x["content"]) for x in m]))

    return prompts.withColumn("answer", ask(F.col(messages_col)))


def answer_with(queries: DataFrame, contexts: DataFrame, chunks: DataFrame, make: Callable[[], Client], style: str = "citation_aware", prefix: str = "Source") -> DataFrame:
    """Answers of a client for assembled contexts, finished like any answer."""
    prompts = queries.join(contexts.select("query_id", "context_text"), "query_id")
    prompts = prompts.withColumn("messages", answers.messages(F.col("context_text"), F.col("query"), style, prefix))
    return answers.finish(generate(prompts, make).select("query_id", "query", "answer"), chunks)


def judge(make: Callable[[], Client], source_chars: int | None = None) -> Callable[[Column, Column], Column]:
    """A judge for ``answers.judge_claims``; what the client fails to label is judged by word overlap. ``source_chars`` cuts sources for a client that takes no more."""

    def decide(claim: Column, source: Column) -> Column:
        @F.pandas_udf("string")
        def ask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            client = make()

            def label(c: str, s: str) -> str | None:
                try:
                    reply = client([{"role": "user", "content": JUDGE_PROMPT.format(source=s[:source_chars], claim=c)}]).upper()
                except Exception:  # noqa: BLE001  any failure of the service means falling back
                    return None
                return next((x for x in ("SUPPORTS", "CONTRADICTS", "NEUTRAL") if x in reply), None)

            for claims, sources in batches:
                yield pd.Series([label(c, s) for c, s in zip(claims, sources, strict=True)], dtype=object)

        return F.coalesce(ask(claim, source), answers.entailment(claim, source))

    return decide


def pair_scorer(make: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 16) -> Callable[[Column, Column], Column]:
    """A scorer for ``search.scored_rerank`` from a function over (query, text) pairs, such as a cross-encoder's."""

    def score(query: Column, text: Column) -> Column:
        @F.pandas_udf("double")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            scorer = make()
            for queries, texts in batches:
                pairs = list(zip(queries, texts, strict=True))
                yield pd.Series([float(s) for k in range(0, len(pairs), batch) for s in scorer(pairs[k : k + batch])])

        return run(query, text)

    return score


def compare_styles(queries: DataFrame, contexts: DataFrame, chunks: DataFrame, make: Callable[[], Client], styles: tuple[str, ...] = ("citation_aware", "concise", "detailed")) -> DataFrame:
    """Faithfulness of a client's answers for each prompt style."""
    out = None
    for style in styles:
        found = answer_with(queries, contexts, chunks, make, style)
        rows = answers.faithfulness(found, answers.judge_claims(found, chunks)).withColumn("style", F.lit(style))
        out = rows if out is None else out.unionByName(rows)
    return out
