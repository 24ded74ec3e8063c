"""Answers and their citations: prompts, an extractive answerer, parsing, claims, entailment, faithfulness.

Column expressions throughout; the regular expressions are Java's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T

# Phrases and word lists that results depend on.
REFUSAL = "I cannot answer based on the provided sources."
NEGATIONS = ["not", "never", "false", "incorrect", "wrong", "no"]
PROMPT_RULES = {
    "citation_aware": "Answer only from the sources. After each claim cite [{prefix} N]. If the sources do not hold the answer, reply exactly: \"" + REFUSAL + "\"",
    "concise": "Answer briefly from the sources alone, citing each claim with [{prefix} N]. Without an answer say \"" + REFUSAL + "\"",
    "detailed": "Answer fully from the sources alone: a direct answer, then detail, each claim cited as [{prefix} N]. Without an answer reply exactly: \"" + REFUSAL + "\"",
}

# How citations and the ends of sentences are written.
_CITED = r"(?i)\[Source\s+(\d+)\]"
_SENTENCES = r"(?<=[.!?])\s+"


def messages(context_text: Column, question: Column, style: str = "citation_aware", prefix: str = "Source") -> Column:
    """System and user message for a language model."""
    system = PROMPT_RULES.get(style, PROMPT_RULES["citation_aware"]).replace("{prefix}", prefix)
    user = F.concat(F.lit("Sources:\n"), context_text, F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer with a complete, readable response and inline citations:"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", user))


# ---------------------------------------------------------------- citations


def normalize_citations(answer: Column) -> Column:
    """[n] and [source n] to [Source n]; footnote lines that only paste a heading go; line breaks squeezed."""
    text = F.regexp_replace(answer, _CITED, "[Source $1]")
    text = F.regexp_replace(text, r"\[(\d+)\]", "[Source $1]")
    text = F.regexp_replace(text, r"(?im)(?:\n|^)\s*\[Source\s+\d+\]\s*#+\s*[^\n]*\s*$", "")
    return T.strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def cited_numbers(answer: Column) -> Column:
    """Numbers of the citations in order, repeats included."""
    return F.transform(F.regexp_extract_all(answer, F.lit(_CITED), F.lit(1)), lambda n: n.cast("int"))


def parse_citations(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, source_index, label, chunk_id) of the sources an answer cites, each once, in order of first mention.

    ``answers`` has query_id and answer; ``chunks`` has query_id, rank and chunk_id. A number without
    such a rank falls back to the chunk at that place; numbers beyond are ignored.
    """
    found = answers.select("query_id", F.posexplode(F.array_distinct(cited_numbers(normalize_citations(F.col("answer"))))).alias("mention", "source_index"))
    places = chunks.select("query_id", "rank", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("place"))
    by_rank = places.select("query_id", F.col("rank").alias("source_index"), F.col("chunk_id").alias("ranked"))
    by_place = places.select("query_id", F.col("place").alias("source_index"), F.col("chunk_id").alias("placed"))
    both = found.join(by_rank, ["query_id", "source_index"], "left").join(by_place, ["query_id", "source_index"], "left")
    both = both.withColumn("chunk_id", F.coalesce("ranked", "placed")).where(F.col("chunk_id").isNotNull())
    return both.select("query_id", "source_index", F.format_string("[Source %d]", "source_index").alias("label"), "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy("mention")).alias("position"))


def claims(answer: Column) -> Column:
    """Sentences of an answer without citations, ten characters at least; none of a refusal."""
    cleaned = T.strip(F.regexp_replace(answer, _CITED, ""))
    parts = F.transform(F.split(cleaned, _SENTENCES), lambda s: T.strip(F.regexp_replace(s, r"\s+", " ")))
    kept = F.filter(parts, lambda s: F.length(s) >= 10)
    return F.when(F.lower(cleaned).startswith("i cannot answer"), F.array().cast("array<string>")).otherwise(kept)


def cited_sentences(answer: Column) -> Column:
    """Sentences, with a tail of nothing but citations kept with the sentence before."""
    parts = F.filter(F.split(T.strip(answer), _SENTENCES), lambda s: T.strip(s) != "")
    lone = lambda s: T.strip(s).rlike(r"(?i)^(\[Source\s+\d+\]\s*)+$")
    joined = lambda out, s: F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat(F.rtrim(F.element_at(out, -1)), F.lit(" "), T.strip(s))))
    empty = F.array().cast("array<string>")
    return F.aggregate(parts, empty, lambda out, s: F.when((F.size(out) > 0) & lone(s), joined(out, s)).otherwise(F.concat(out, F.array(s))))


def bare(sentence: Column) -> Column:
    """A sentence as a claim is compared: no citations, single blanks, no final stops."""
    return F.rtrim(T.strip(F.regexp_replace(F.regexp_replace(sentence, _CITED, ""), r"\s+", " ")), F.lit("."))


def claim_citations(answers: DataFrame) -> DataFrame:
    """(query_id, claim_index, claim, numbers): the citations of the first sentence that equals, holds or lies in the claim."""
    rows = answers.select("query_id", F.posexplode(claims(F.col("answer"))).alias("claim_index", "claim"), cited_sentences(F.col("answer")).alias("sentences"))
    wanted = F.rtrim(T.strip(F.regexp_replace("claim", r"\s+", " ")), F.lit("."))
    rows = rows.withColumn("wanted", wanted)
    match = F.filter("sentences", lambda s: F.contains(bare(s), F.col("wanted")) | F.contains(F.col("wanted"), bare(s)))
    numbers = F.when(F.size(match) > 0, cited_numbers(F.get(match, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return rows.select("query_id", "claim_index", "claim", numbers.alias("numbers"))


# ---------------------------------------------------------------- entailment and faithfulness


def entailment(claim: Column, source: Column) -> Column:
    """SUPPORTS, CONTRADICTS or NEUTRAL by word overlap and whether exactly one side negates."""
    c, s = T.token_set(claim), T.token_set(source)
    words = F.array(*map(F.lit, NEGATIONS))
    shared = T.coverage(c, s)
    negated = F.arrays_overlap(c, words) != F.arrays_overlap(s, words)
    label = F.when(negated & (shared > 0.1), "CONTRADICTS").when(shared >= 0.15, "SUPPORTS").otherwise("NEUTRAL")
    return F.when(F.size(c) == 0, "NEUTRAL").otherwise(label)


def judge_claims(answers: DataFrame, chunks: DataFrame, judge=entailment) -> DataFrame:
    """(query_id, claim_index, claim, n_citations, label) of the claims of answers that did not refuse.

    A claim is supported if any cited source supports it, else contradicted if any contradicts it.
    ``chunks`` has query_id, rank, text; ``judge`` may be any function of two columns.
    """
    open_ = answers.where(~is_refusal(F.col("answer")))
    found = claim_citations(open_)
    cited = found.select("query_id", "claim_index", "claim", F.explode("numbers").alias("rank")).join(chunks.select("query_id", "rank", "text"), ["query_id", "rank"])
    labels = cited.withColumn("label", judge(F.col("claim"), F.col("text"))).groupBy("query_id", "claim_index").agg(
        F.count(F.lit(1)).alias("n_citations"), F.bool_or(F.col("label") == "SUPPORTS").alias("yes"), F.bool_or(F.col("label") == "CONTRADICTS").alias("no")
    )
    joined = found.select("query_id", "claim_index", "claim").join(labels, ["query_id", "claim_index"], "left")
    label = F.when(F.col("n_citations").isNull(), "NO_CITATION").when(F.col("yes"), "SUPPORTS").when(F.col("no"), "CONTRADICTS").otherwise("NEUTRAL")
    return joined.select("query_id", "claim_index", "claim", F.coalesce("n_citations", F.lit(0)).alias("n_citations"), label.alias("label"))


def is_refusal(answer: Column) -> Column:
    return F.contains(F.lower(answer), F.lit(REFUSAL.lower()))


def answer_relevancy(query: Column, answer: Column) -> Column:
    """Share of the question's words in the answer."""
    q, a = T.token_set(query), T.token_set(answer)
    return F.when(F.size(a) == 0, 0.0).otherwise(T.coverage(q, a))


def faithfulness(answers: DataFrame, judged: DataFrame) -> DataFrame:
    """Seven ratios for each answer (query_id, query, answer); a refusal is perfectly faithful, an answer without claims not at all."""
    counts = judged.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "SUPPORTS").alias("yes"), F.count_if(F.col("label") == "NO_CITATION").alias("none"),
        F.count_if(F.col("label") == "CONTRADICTS").alias("no"), F.count_if(F.col("label") == "NEUTRAL").alias("open"), F.sum("n_citations").alias("cites"),
    )
    rows = answers.join(counts, "query_id", "left").withColumn("refused", is_refusal(F.col("answer")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))

    def pick(refused, empty, else_):
        return F.when(F.col("refused"), F.lit(refused)).when(zero("n") == 0, empty if isinstance(empty, Column) else F.lit(empty)).otherwise(else_)

    n = zero("n")
    return rows.select(
        "query_id", "refused", n.alias("total_claims"), zero("yes").alias("supported_claims"),
        pick(1.0, 0.0, T.ratio(zero("yes"), n)).alias("faithfulness"),
        pick(1.0, 0.0, T.ratio(zero("yes"), zero("cites"))).alias("citation_precision"),
        pick(1.0, 0.0, T.ratio(zero("yes"), n)).alias("citation_recall"),
        pick(0.0, F.when(F.coalesce(F.col("answer"), F.lit("")) != "", 1.0).otherwise(0.0), T.ratio(zero("none") + zero("no") + zero("open"), n)).alias("hallucination_rate"),
        pick(0.0, 0.0, T.ratio(n - zero("none"), n)).alias("citation_coverage"),
        F.when(F.col("refused"), 0.0).otherwise(answer_relevancy(F.col("query"), F.col("answer"))).alias("answer_relevancy"),
        pick(0.0, 0.0, T.ratio(zero("none") + zero("open"), n)).alias("unsupported_claim_rate"),
    )


# ---------------------------------------------------------------- answering


def clean_sentence(sentence: Column) -> Column:
    """Heading marks out, single blanks."""
    text = F.regexp_replace(T.strip(sentence), r"^#+\s*", "")
    return T.strip(F.regexp_replace(F.regexp_replace(text, r"\s*#+\s*", " "), r"\s+", " "))


def extract_answers(queries: DataFrame, chunks: DataFrame, least: float = 0.28, canned: dict[str, str] | None = None) -> DataFrame:
    """(query_id, query, answer): the best sentence of the source that covers most of the question, cited; else a refusal.

    ``queries`` has query_id and query, ``chunks`` the assembled chunks (query_id, rank, text). Sentences
    have 20 characters at least; source and sentence must cover ``least`` of the question's words.
    ``canned`` answers questions that contain a phrase.
    """
    asked = queries.select("query_id", "query", T.token_set(F.col("query")).alias("asked"))
    rows = chunks.select("query_id", "rank", "text").join(asked, "query_id")
    rows = rows.withColumn("cover", T.coverage(F.col("asked"), T.token_set(F.col("text"))))
    top = rows.withColumn("turn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cover"), "rank"))).where((F.col("turn") == 1) & (F.col("cover") >= least))
    parts = F.filter(F.transform(F.split(F.regexp_replace("text", "\n", " "), _SENTENCES), clean_sentence), lambda s: F.length(s) >= 20)
    each = top.select("query_id", "rank", "asked", F.posexplode(parts).alias("place", "sentence")).withColumn("share", T.coverage(F.col("asked"), T.token_set(F.col("sentence"))))
    best = each.withColumn("turn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("share"), "place"))).where((F.col("turn") == 1) & (F.col("share") >= least))
    text = F.concat(F.rtrim("sentence", F.lit(".")), F.lit(". "), F.format_string("[Source %d]", "rank"))
    answered = queries.select("query_id", "query").join(best.select("query_id", text.alias("found")), "query_id", "left")
    answer = F.coalesce("found", F.lit(REFUSAL))
    for phrase, reply in reversed((canned or {}).items()):
        answer = F.when(F.contains(F.lower("query"), F.lit(phrase.lower())), F.lit(reply)).otherwise(answer)
    return answered.select("query_id", "query", answer.alias("answer"))


def finish(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Normalised answers; one that answers without citing gets source 1; a query without chunks refuses."""
    any_chunk = chunks.select("query_id").distinct().withColumn("some", F.lit(True))
    rows = answers.join(any_chunk, "query_id", "left")
    text = normalize_citations(T.strip(F.col("answer")))
    cites = F.size(cited_numbers(text)) > 0
    final = F.when(F.col("some").isNull(), F.lit(REFUSAL)).when(is_refusal(text) | cites, text).otherwise(F.concat(F.rtrim(text), F.lit(" [Source 1]")))
    rows = rows.withColumn("answer", final).withColumn("refused", is_refusal(final))
    return rows.drop("some").withColumn("completion_tokens", T.token_estimate(F.col("answer")))


# ---------------------------------------------------------------- adversarial probes

# The planted source and the words that betray its use.
CANARY_TEXT = (
    "[CANARY SOURCE] The root cause was identified as a DNS misconfiguration in the cluster's CoreDNS deployment. "
    "This was resolved by flushing the DNS cache and restarting the kube-dns pods."
)
CANARY_WORDS = ["dns misconfiguration", "coredns", "kube-dns", "dns cache", "flushing the dns"]


def inject_canary(chunks: DataFrame) -> DataFrame:
    """Assembled chunks (query_id, rank, text) with the planted source 99 for every query."""
    own, planted = F.struct(F.col("rank").cast("int").alias("rank"), F.col("text").alias("text")), F.struct(F.lit(99).alias("rank"), F.lit(CANARY_TEXT).alias("text"))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "text")) == 1
    return chunks.select("query_id", F.when(first, F.array(own, planted)).otherwise(F.array(own)).alias("c")).select("query_id", F.explode("c").alias("c")).select("query_id", "c.rank", "c.text")


def canary_words(answer: Column) -> Column:
    """Which of the betraying words the answer holds."""
    lowered = F.lower(answer)
    return F.filter(F.array(*map(F.lit, CANARY_WORDS)), lambda w: F.contains(lowered, w))


def probe_results(answers: DataFrame) -> DataFrame:
    """(query_id, matched, canary_detected, passed): a refusal passes."""
    matched = F.when(is_refusal(F.col("answer")), F.array().cast("array<string>")).otherwise(canary_words(F.col("answer")))
    rows = answers.select("query_id", matched.alias("matched"))
    return rows.withColumn("canary_detected", F.size("matched") > 0).withColumn("passed", ~F.col("canary_detected"))
