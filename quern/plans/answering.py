"""Queries of context assembly, answers, citations and faithfulness."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import answers, context
from quern.operators.staging import stored
from quern.plans.common import BLANKS, Catalog, coverage_sql, rounded, table, token_set_sql
from quern.plans.search import bm25_ctes, candidates, jaccard_sql, top

ANSWERING = Catalog()

# ---------------------------------------------------------------- context


def _selected(spark, sf_dir, strategy, k=10, **config):
    return context.select_chunks(candidates(spark, sf_dir, k), context.AssemblyConfig(strategy=strategy, **config))


_TOP = f"WITH {bm25_ctes()}, few AS ({top('bm25', 5)}), chunk AS (SELECT f.*, d.text FROM few f JOIN documents d ON d.doc_id = f.chunk_id)"


@ANSWERING.add(f"{_TOP} SELECT query_id, chunk_id, rank, score, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END::INTEGER AS token_count FROM chunk")
def context_topk(spark, sf_dir):
    return _selected(spark, sf_dir, "top_k", 20, max_chunks=5).select("query_id", "chunk_id", "rank", "score", "token_count")


@ANSWERING.add(
    f"""{_TOP} SELECT query_id, count(*) AS chunks_selected, sum(greatest(1, length(text) // 4))::BIGINT AS tokens_out,
        sha256(string_agg('[Source ' || rank || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_sha256 FROM chunk GROUP BY query_id"""
)
def context_labels(spark, sf_dir):
    config = context.AssemblyConfig(strategy="top_k", max_chunks=5)
    rows = context.assemble(context.select_chunks(candidates(spark, sf_dir, 20), config), config)
    return rows.select("query_id", "chunks_selected", "tokens_out", F.sha2("context_text", 256).alias("context_sha256"))


def _strategy(name, **config):
    def run(spark, sf_dir):
        rows = _selected(spark, sf_dir, name, 20, **config)
        return rows.select("query_id", "chunk_id", "rank", "score", "token_count", "was_compressed", "duplicates_removed", "dropped_budget")

    run.__name__ = f"context_{name}"
    return run


_CANDIDATE = f"SELECT f.*, {token_set_sql('d.text')} AS ws, CASE WHEN length(d.text) = 0 THEN 0 ELSE greatest(1, length(d.text) // 4) END::INTEGER AS t FROM few f JOIN documents d ON d.doc_id = f.chunk_id"
_TWENTY = f"{bm25_ctes()}, few AS ({top('bm25', 20)}), cand AS MATERIALIZED ({_CANDIDATE})"
#: The five best after reranking, scored by their overlap with the question.
_FIVE = f"""{bm25_ctes()}, first AS ({top('bm25', 20)}), compared AS (SELECT f.query_id, f.chunk_id, f.rank AS original_rank, {jaccard_sql('b.text', 'd.text')} AS overlap, f.score AS keyword FROM first f JOIN documents d ON d.doc_id = f.chunk_id JOIN benchmark b ON b.item_id = f.query_id),
    few AS (SELECT query_id, chunk_id, coalesce(nullif(overlap, 0), 0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, original_rank, chunk_id)::INTEGER AS rank FROM compared QUALIFY rank <= 5), cand AS MATERIALIZED ({_CANDIDATE})"""


def _alike(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"coalesce({both}::DOUBLE / nullif(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len({a}) + len({b}) - {both} END, 0), 0)"


_ALIKE = f"""alike AS MATERIALIZED (
        SELECT a.query_id, a.rank, list(b.rank) FILTER (WHERE {_alike("a.ws", "b.ws")} >= 0.85) AS near FROM cand a LEFT JOIN cand b ON a.query_id = b.query_id AND b.rank < a.rank GROUP BY ALL
    ), walk AS (
        SELECT DISTINCT query_id, 0 AS pos, []::INTEGER[] AS kept FROM cand
        UNION ALL SELECT w.query_id, w.pos + 1, CASE WHEN len(list_intersect(coalesce(a.near, []), w.kept)) = 0 THEN list_append(w.kept, a.rank) ELSE w.kept END FROM walk w JOIN alike a ON a.query_id = w.query_id AND a.rank = w.pos + 1
    ), last AS (SELECT query_id, kept, pos FROM walk QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos DESC) = 1)"""
# relevance and likeness of what is left, then again and again the best of it
_VALUES = "list_transform(range(1, len(base) + 1), lambda i: CASE WHEN list_contains(chosen, i) THEN NULL ELSE base[i] - (1 - 0.7::DOUBLE) * coalesce(list_max(list_transform(chosen, lambda j: m[i][j])), 0) END)"


def _mmr_sql(k: int, found: str = _TWENTY) -> str:
    return f"""WITH RECURSIVE {found}, {_ALIKE}, item AS MATERIALIZED (
        SELECT c.*, list_position(l.kept, c.rank) AS i, l.pos - len(l.kept) AS removed, {_alike("q.ws", "c.ws")} AS asked FROM cand c JOIN last l ON l.query_id = c.query_id AND list_contains(l.kept, c.rank) JOIN (SELECT item_id, {token_set_sql("text")} AS ws FROM benchmark) q ON q.item_id = c.query_id
    ), base AS MATERIALIZED (SELECT query_id, list(0.7::DOUBLE * (0.5::DOUBLE * score + 0.5::DOUBLE * asked) ORDER BY i) AS base FROM item GROUP BY query_id
    ), likeness AS (SELECT a.query_id, a.i, list({_alike("a.ws", "b.ws")} ORDER BY b.i) AS s FROM item a JOIN item b ON a.query_id = b.query_id GROUP BY ALL
    ), matrix AS MATERIALIZED (SELECT query_id, list(s ORDER BY i) AS m FROM likeness GROUP BY query_id
    ), pick AS (
        SELECT query_id, []::BIGINT[] AS chosen, base, m FROM base JOIN matrix USING (query_id)
        UNION ALL SELECT query_id, list_append(chosen, list_position({_VALUES}, list_max({_VALUES}))), base, m FROM pick WHERE len(chosen) < least(len(base), {k})
    ), best AS (SELECT query_id, chosen FROM pick QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY len(chosen) DESC) = 1
    ), picked AS (SELECT i.*, list_position(b.chosen, i.i) AS place FROM item i JOIN best b ON b.query_id = i.query_id AND list_contains(b.chosen, i.i))"""


def _budget_sql(source: str, place: str, most: int = 2048) -> str:
    return f"""fit AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score / t DESC, {place}) AS p FROM {source} WHERE t >= 20),
    fill AS (
        SELECT DISTINCT query_id, 0::BIGINT AS p, 0 AS used, false AS taken FROM fit
        UNION ALL SELECT w.query_id, f.p, w.used + CASE WHEN w.used + f.t <= {most} THEN f.t ELSE 0 END, w.used + f.t <= {most} FROM fill w JOIN fit f ON f.query_id = w.query_id AND f.p = w.p + 1
    ), dropped AS (SELECT query_id, count(*) FILTER (WHERE NOT taken AND p > 0) AS n FROM fill GROUP BY query_id)
    SELECT f.query_id, f.chunk_id, row_number() OVER (PARTITION BY f.query_id ORDER BY f.p)::INTEGER AS rank, f.score, f.t AS token_count, false AS was_compressed, f.removed::INTEGER AS duplicates_removed, d.n::INTEGER AS dropped_budget
    FROM fit f JOIN fill w ON w.query_id = f.query_id AND w.p = f.p AND w.taken JOIN dropped d ON d.query_id = f.query_id"""


_FIELDS = "query_id, chunk_id, rank, score, token_count, was_compressed, duplicates_removed, dropped_budget"


def _compressed(chosen: str) -> str:
    """The chosen chunks, those beyond 512 tokens cut to headings and the sentences nearest to the question."""
    size = lambda x: f"(CASE WHEN length({x}) = 0 THEN 0 ELSE greatest(1, length({x}) // 4) END)"
    heading = r"regexp_matches(trim(x, {b}), '^#{{1,6}}\s+')".format(b=BLANKS)
    return rf"""WITH RECURSIVE chosen AS MATERIALIZED ({chosen}), long AS (SELECT c.query_id, c.chunk_id, d.text, {token_set_sql('b.text')} AS asked, string_split(d.text, chr(10)) AS l FROM chosen c JOIN documents d ON d.doc_id = c.chunk_id JOIN benchmark b ON b.item_id = c.query_id WHERE c.token_count > 512),
    apart AS MATERIALIZED (SELECT query_id, chunk_id, text, asked, list_filter(l, lambda x: {heading}) AS heads, list_filter(list_transform(string_split(regexp_replace(array_to_string(list_filter(l, lambda x: NOT {heading}), chr(10)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {BLANKS})), lambda x: x <> '') AS said FROM long),
    sentence AS (SELECT query_id, chunk_id, asked, unnest(said) AS s, generate_subscripts(said, 1) AS i FROM apart),
    turn AS MATERIALIZED (SELECT query_id, chunk_id, s, i, {size('s')} AS n, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY len(list_intersect(asked, {token_set_sql('s')})) DESC, i) AS o FROM sentence),
    room AS (SELECT query_id, chunk_id, 0::BIGINT AS o, 512 - {size("array_to_string(heads, chr(10))")} AS left_over, false AS taken FROM apart
        UNION ALL SELECT t.query_id, t.chunk_id, t.o, CASE WHEN t.n <= r.left_over THEN r.left_over - t.n ELSE r.left_over END, t.n <= r.left_over FROM room r JOIN turn t ON t.query_id = r.query_id AND t.chunk_id = r.chunk_id AND t.o = r.o + 1),
    kept AS (SELECT query_id, chunk_id, string_agg(s, ' ' ORDER BY i) AS body FROM room JOIN turn USING (query_id, chunk_id, o) WHERE taken GROUP BY ALL),
    short AS (SELECT a.query_id, a.chunk_id, CASE WHEN body IS NOT NULL THEN trim(array_to_string(list_append(heads, body), chr(10)), {BLANKS}) WHEN len(said) > 0 OR {size("array_to_string(heads, chr(10))")} > 512 THEN left(text, 2048) ELSE trim(array_to_string(heads, chr(10)), {BLANKS}) END AS text FROM apart a LEFT JOIN kept USING (query_id, chunk_id))
    SELECT c.query_id, c.chunk_id, c.rank, c.score, CASE WHEN s.text IS NULL THEN c.token_count ELSE {size('s.text')} END::INTEGER AS token_count, s.text IS NOT NULL AS was_compressed, c.duplicates_removed, c.dropped_budget, s.text AS text FROM chosen c LEFT JOIN short s USING (query_id, chunk_id)"""


def _strategy_sql(name: str, most: int = 2048, found: str = _TWENTY) -> str:
    """The greedy steps as recursion over each query's candidates in order."""
    plain = "false AS was_compressed"
    if name == "top_k":
        return f"WITH {found} SELECT query_id, chunk_id, rank, score, t AS token_count, {plain}, 0 AS duplicates_removed, 0 AS dropped_budget FROM cand WHERE rank <= 10"
    if name == "dedup_only":
        return f"""WITH RECURSIVE {found}, {_ALIKE} SELECT c.query_id, c.chunk_id, list_position(l.kept, c.rank)::INTEGER AS rank, c.score, c.t AS token_count, {plain}, (l.pos - len(l.kept))::INTEGER AS duplicates_removed, 0 AS dropped_budget
            FROM cand c JOIN last l ON l.query_id = c.query_id AND list_contains(l.kept, c.rank) AND list_position(l.kept, c.rank) <= 10"""
    if name == "budget":
        return f"WITH RECURSIVE {found}, all_of AS (SELECT *, 0 AS removed FROM cand), {_budget_sql('all_of', 'rank', most)}"
    if name == "mmr":
        return f"{_mmr_sql(10, found)} SELECT query_id, chunk_id, place::INTEGER AS rank, score, t AS token_count, {plain}, removed::INTEGER AS duplicates_removed, 0 AS dropped_budget FROM picked"
    full = f"{_mmr_sql(20, found)}, {_budget_sql('picked', 'place', most)}"
    return full if name == "full" else _compressed(full)


for _name in ("dedup_only", "mmr", "budget", "full"):
    ANSWERING.add(_strategy_sql(_name))(_strategy(_name))
ANSWERING.add(f"SELECT {_FIELDS} FROM ({_strategy_sql('full_compressed')})")(_strategy("full_compressed"))


_SETS = f"""own AS (SELECT doc_id, list_sort({token_set_sql('text')}) AS ws FROM documents), class AS (SELECT ws, min(doc_id) AS class_id, count(*) AS class_size FROM own WHERE len(ws) > 0 GROUP BY ws),
    word AS (SELECT class_id, unnest(ws) AS w, len(ws) AS n FROM class), pair AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM word a JOIN word b ON a.w = b.w AND a.class_id < b.class_id GROUP BY ALL),
    near AS (SELECT a, b, round(shared::DOUBLE / (na + nb - shared), 6) AS similarity FROM pair WHERE shared::DOUBLE / (na + nb - shared) >= 0.85)"""


@ANSWERING.add(f"WITH {_SETS} SELECT a, b, similarity, x.class_size AS size_a, y.class_size AS size_b FROM near JOIN class x ON x.class_id = a JOIN class y ON y.class_id = b")
def pairwise_jaccard_near_dups(spark, sf_dir):
    """Pairs of classes of documents with equal token sets, with their sizes; pairwise_jaccard_classes says who is in them."""
    docs = table(spark, sf_dir, "documents")
    classes = context.token_classes(docs)[1]
    sizes = classes.select("class_id", "class_size")
    rows = context.similar_pairs(docs, classes=classes).join(sizes.toDF("a", "size_a"), "a").join(sizes.toDF("b", "size_b"), "b")
    return rows.withColumn("similarity", rounded("similarity"))


@ANSWERING.add(
    f"""WITH {_SETS}, other AS (SELECT c, sum(class_size)::BIGINT AS n FROM (SELECT a AS c, b AS d FROM near UNION ALL SELECT b, a FROM near) JOIN class ON class_id = d GROUP BY c)
    SELECT doc_id, class_id, class_size, class_size - 1 + coalesce(n, 0) AS links FROM own JOIN class USING (ws) LEFT JOIN other ON c = class_id"""
)
def pairwise_jaccard_classes(spark, sf_dir):
    """For every document with a token its class (the smallest id with the same token set), the class' size, and how many other documents are near it."""
    return context.similar_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


# ---------------------------------------------------------------- answers made up from the passages

_ANSWER_SQL = "left(text, length(text) // 2) || '. [1] ' || substr(text, length(text) // 2 + 1) || '. [source 2] [Source 9]. This is not true [Source 1].' || chr(10) || chr(10) || chr(10) || chr(10) || '[Source 3] # Heading'"


def made_answers(spark, sf_dir):
    """For each passage an answer, of its two halves, that cites well, wrongly, barely and not at all."""
    tail = "\n\n\n\n[Source 3] # Heading"
    half = F.floor(F.length("text") / 2).cast("int")
    text = F.concat(F.substring("text", F.lit(1), half), F.lit(". [1] "), F.substring("text", half + 1, F.length("text")), F.lit(". [source 2] [Source 9]. This is not true [Source 1]." + tail))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), text.alias("answer"))


_NORMAL = f"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(answer, '(?i)\\[Source\\s+(\\d+)\\]', '[Source \\1]', 'g'), '\\[(\\d+)\\]', '[Source \\1]', 'g'),
    '(?im)(?:\\n|^)\\s*\\[Source\\s+\\d+\\]\\s*#+\\s*[^\\n]*\\s*$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {BLANKS})"""
_ANSWERS = f"answers AS (SELECT item_id AS query_id, text AS query, {_ANSWER_SQL} AS answer FROM benchmark), normal AS (SELECT query_id, query, {_NORMAL} AS answer FROM answers)"


@ANSWERING.add(f"WITH {_ANSWERS} SELECT query_id, sha256(answer) AS digest FROM normal")
def citation_normalize(spark, sf_dir):
    return made_answers(spark, sf_dir).select("query_id", F.sha2(answers.normalize_citations(F.col("answer")), 256).alias("digest"))


_MENTIONS = r"""mention AS (SELECT query_id, n::INTEGER AS source_index, i FROM (
    SELECT query_id, unnest(regexp_extract_all(answer, '(?i)\[Source\s+(\d+)\]', 1)) AS n, generate_subscripts(regexp_extract_all(answer, '(?i)\[Source\s+(\d+)\]', 1), 1) AS i FROM normal))"""


@ANSWERING.add(
    f"""WITH {bm25_ctes()}, few AS ({top('bm25', 3)}), {_ANSWERS}, {_MENTIONS},
    once AS (SELECT query_id, source_index, min(i) AS i FROM mention GROUP BY ALL)
    SELECT o.query_id, o.source_index, '[Source ' || o.source_index || ']' AS label, f.chunk_id, row_number() OVER (PARTITION BY o.query_id ORDER BY o.i)::INTEGER AS position
    FROM once o JOIN few f ON f.query_id = o.query_id AND f.rank = o.source_index"""
)
def citation_parse(spark, sf_dir):
    return answers.parse_citations(made_answers(spark, sf_dir), candidates(spark, sf_dir, 3))


_NEGATED = "len(list_intersect({}, ['not', 'never', 'false', 'incorrect', 'wrong', 'no'])) > 0"


def entailment_sql(claim: str, source: str) -> str:
    c, s, cover = token_set_sql(claim), token_set_sql(source), coverage_sql(claim, source)
    return f"CASE WHEN len({c}) = 0 THEN 'NEUTRAL' WHEN ({_NEGATED.format(c)}) <> ({_NEGATED.format(s)}) AND {cover} > 0.1 THEN 'CONTRADICTS' WHEN {cover} >= 0.15 THEN 'SUPPORTS' ELSE 'NEUTRAL' END"


@ANSWERING.add(f"{_TOP} SELECT c.query_id, c.chunk_id, {entailment_sql('b.text', 'c.text')} AS label FROM chunk c JOIN benchmark b ON b.item_id = c.query_id")
def lexical_entailment(spark, sf_dir):
    rows = candidates(spark, sf_dir, 5)
    return rows.select("query_id", "chunk_id", answers.entailment(F.col("query"), F.col("text")).alias("label"))


@ANSWERING.add(f"{_TOP} SELECT c.query_id, c.chunk_id, round({coverage_sql('b.text', 'c.text')}, 6) AS relevancy FROM chunk c JOIN benchmark b ON b.item_id = c.query_id")
def answer_relevancy(spark, sf_dir):
    rows = candidates(spark, sf_dir, 5)
    return rows.select("query_id", "chunk_id", rounded(answers.answer_relevancy(F.col("query"), F.col("text"))).alias("relevancy"))


_JUDGED = rf"""cleaned AS (SELECT query_id, answer, trim(regexp_replace(answer, '(?i)\[Source\s+\d+\]', '', 'g'), {BLANKS}) AS t FROM normal),
part AS (SELECT query_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT query_id, string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM cleaned)),
claim AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS claim_index, c AS claim FROM (SELECT query_id, i, trim(regexp_replace(s, '\s+', ' ', 'g'), {BLANKS}) AS c FROM part) WHERE length(c) >= 10)"""


@ANSWERING.add(f"WITH {_ANSWERS}, {_JUDGED} SELECT query_id, claim_index::INTEGER AS claim_index, sha256(claim) AS digest FROM claim")
def claims_extract(spark, sf_dir):
    rows = made_answers(spark, sf_dir).withColumn("answer", answers.normalize_citations(F.col("answer")))
    return rows.select("query_id", F.posexplode(answers.claims(F.col("answer"))).alias("claim_index", "claim")).select("query_id", "claim_index", F.sha2("claim", 256).alias("digest"))


def judged(spark, sf_dir):
    rows = made_answers(spark, sf_dir).withColumn("answer", answers.normalize_citations(F.col("answer")))
    return rows, answers.judge_claims(rows, candidates(spark, sf_dir, 3))


_LINKED = rf"""sent AS (SELECT query_id, i, s FROM (SELECT query_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT query_id, string_split(regexp_replace(answer, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM normal)) WHERE trim(s, {BLANKS}) <> ''),
mark AS (SELECT *, regexp_full_match(trim(s, {BLANKS}), '(?i)(\[Source\s+\d+\]\s*)+') AND row_number() OVER (PARTITION BY query_id ORDER BY i) > 1 AS lone FROM sent),
grp AS (SELECT *, sum(CASE WHEN lone THEN 0 ELSE 1 END) OVER (PARTITION BY query_id ORDER BY i) AS g FROM mark),
whole AS (SELECT query_id, g, string_agg(rtrim(s, {BLANKS}), ' ' ORDER BY i) AS s FROM grp GROUP BY ALL),
bare AS (SELECT query_id, g, s, rtrim(trim(regexp_replace(regexp_replace(s, '(?i)\[Source\s+\d+\]', '', 'g'), '\s+', ' ', 'g'), {BLANKS}), '.') AS b FROM whole),
linked AS (SELECT c.query_id, c.claim_index, c.claim, arg_min(b.s, b.g) AS s FROM claim c JOIN bare b ON b.query_id = c.query_id AND (contains(b.b, rtrim(c.claim, '.')) OR contains(rtrim(c.claim, '.'), b.b)) GROUP BY ALL),
cite AS (SELECT query_id, claim_index, claim, unnest(regexp_extract_all(s, '(?i)\[Source\s+(\d+)\]', 1))::INTEGER AS rank FROM linked),
labelled AS (SELECT i.query_id, i.claim_index, {{entailment}} AS label FROM cite i JOIN chunk k ON k.query_id = i.query_id AND k.rank = i.rank),
counted AS (SELECT query_id, claim_index, count(*) AS n, bool_or(label = 'SUPPORTS') AS yes, bool_or(label = 'CONTRADICTS') AS no FROM labelled GROUP BY ALL),
judged AS (SELECT c.query_id, c.claim_index::INTEGER AS claim_index, c.claim, coalesce(n, 0) AS n_citations,
    CASE WHEN n IS NULL THEN 'NO_CITATION' WHEN yes THEN 'SUPPORTS' WHEN no THEN 'CONTRADICTS' ELSE 'NEUTRAL' END AS label FROM claim c LEFT JOIN counted USING (query_id, claim_index))"""
_CLAIMS = f"WITH {bm25_ctes()}, few AS ({top('bm25', 3)}), chunk AS (SELECT f.*, d.text FROM few f JOIN documents d ON d.doc_id = f.chunk_id), {_ANSWERS}, {_JUDGED}, " + _LINKED.format(entailment=entailment_sql("i.claim", "k.text"))


@ANSWERING.add(f"{_CLAIMS} SELECT query_id, claim_index, sha256(claim) AS digest, n_citations, label FROM judged")
def claim_labels(spark, sf_dir):
    return judged(spark, sf_dir)[1].select("query_id", "claim_index", F.sha2("claim", 256).alias("digest"), "n_citations", "label")


@ANSWERING.add(
    f"""{_CLAIMS}, c AS (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE label = 'SUPPORTS') AS yes, count(*) FILTER (WHERE label = 'NO_CITATION') AS none, sum(n_citations) AS cites FROM judged GROUP BY query_id)
    SELECT a.query_id, coalesce(n, 0) AS total_claims, coalesce(yes, 0) AS supported_claims, round(coalesce(yes / n, 0), 6) AS faithfulness, round(coalesce(yes / nullif(cites, 0), 0), 6) AS citation_precision,
    round(CASE WHEN n IS NULL THEN 1 ELSE (n - yes) / n END, 6) AS hallucination_rate, round(coalesce((n - none) / n, 0), 6) AS citation_coverage, round({coverage_sql('a.query', 'a.answer')}, 6) AS answer_relevancy FROM normal a LEFT JOIN c USING (query_id)"""
)
def faithfulness_summary(spark, sf_dir):
    rows = answers.faithfulness(*judged(spark, sf_dir))
    ratios = ("faithfulness", "citation_precision", "hallucination_rate", "citation_coverage", "answer_relevancy")
    return rows.select("query_id", "total_claims", "supported_claims", *(rounded(c).alias(c) for c in ratios))


_EXTRACT = rf"""cover AS (SELECT c.query_id, c.rank, c.text, b.text AS query, {coverage_sql('b.text', 'c.text')} AS cover FROM chunk c JOIN benchmark b ON b.item_id = c.query_id),
best AS (SELECT * FROM cover WHERE cover >= 0.28 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cover DESC, rank) = 1),
raw AS (SELECT query_id, rank, query, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT query_id, rank, query, string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM best)),
clean AS (SELECT query_id, rank, query, i, trim(regexp_replace(regexp_replace(regexp_replace(trim(s, {BLANKS}), '^#+\s*', ''), '\s*#+\s*', ' ', 'g'), '\s+', ' ', 'g'), {BLANKS}) AS s FROM raw),
share AS (SELECT *, {coverage_sql('query', 's')} AS share FROM clean WHERE length(s) >= 20),
pick AS (SELECT query_id, rtrim(s, '.') || '. [Source ' || rank || ']' AS answer FROM share WHERE share >= 0.28 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY share DESC, i) = 1)"""


@ANSWERING.add(f"{_TOP}, {_EXTRACT} SELECT item_id AS query_id, sha256(coalesce(answer, '{answers.REFUSAL}')) AS digest, answer IS NULL AS refused FROM benchmark LEFT JOIN pick ON query_id = item_id")
def extractive_answer(spark, sf_dir):
    rows = candidates(spark, sf_dir, 5)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = answers.extract_answers(asked, rows)
    return found.select("query_id", F.sha2("answer", 256).alias("digest"), answers.is_refusal(F.col("answer")).alias("refused"))


def _prompt_sql() -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    styles = ", ".join(f"({text(n)}, sha256({text(r.replace('{prefix}', 'Source'))}))" for n, r in answers.PROMPT_RULES.items())
    user = "'Sources:' || chr(10) || '[Source 1]' || chr(10) || text || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Answer with a complete, readable response and inline citations:'"
    return f"SELECT item_id AS query_id, style, system_sha256, sha256({user}) AS user_sha256 FROM benchmark, (VALUES {styles}) s(style, system_sha256)"


@ANSWERING.add(_prompt_sql())
def prompts(spark, sf_dir):
    """Both messages of every style."""
    asked, out = table(spark, sf_dir, "benchmark"), None
    for style in answers.PROMPT_RULES:
        rows = asked.select(F.col("item_id").alias("query_id"), F.lit(style).alias("style"), answers.messages(F.concat(F.lit("[Source 1]\n"), "text"), F.col("text"), style).alias("m"))
        rows = rows.select("query_id", "style", F.sha2(F.col("m")[0]["content"], 256).alias("system_sha256"), F.sha2(F.col("m")[1]["content"], 256).alias("user_sha256"))
        out = rows if out is None else out.unionByName(rows)
    return out


_CANARY = "list_filter(['dns misconfiguration', 'coredns', 'kube-dns', 'dns cache', 'flushing the dns'], lambda w: contains(lower(answer), w))"


@ANSWERING.add(
    f"""WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || ' CoreDNS and the DNS cache' WHEN turn % 3 = 1 THEN '{answers.REFUSAL}' ELSE text END AS answer FROM conversations)
    SELECT conv_id * 1000 + turn AS query_id, array_to_string({_CANARY}, ',') AS matched, len({_CANARY}) > 0 AS canary_detected, len({_CANARY}) = 0 AS passed FROM a"""
)
def canary_detection(spark, sf_dir):
    answer = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" CoreDNS and the DNS cache"))).when(F.col("turn") % 3 == 1, F.lit(answers.REFUSAL)).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), answer.alias("answer"))
    return answers.probe_results(rows).withColumn("matched", F.array_join("matched", ","))


_PLANTED = "CASE WHEN item_id % 3 = 0 THEN 'What was the root cause of the DNS misconfiguration in the CoreDNS deployment, and how was it resolved?' ELSE text END"
_PROBED = _EXTRACT.replace("FROM chunk c JOIN benchmark b", f"FROM probed c JOIN (SELECT item_id, {_PLANTED} AS text FROM benchmark) b")


@ANSWERING.add(
    f"""{_TOP}, probed AS (SELECT query_id, rank, text FROM chunk UNION ALL SELECT DISTINCT query_id, 99, '{answers.CANARY_TEXT.replace("'", "''")}' FROM chunk), {_PROBED}, reply AS (SELECT DISTINCT c.query_id, coalesce(p.answer, '') AS answer FROM chunk c LEFT JOIN pick p USING (query_id))
    SELECT query_id, array_to_string({_CANARY}, ',') AS matched, len({_CANARY}) > 0 AS canary_detected, len({_CANARY}) = 0 AS passed FROM reply"""
)
def canary_probe(spark, sf_dir):
    """A source planted among each passage's chunks; every third question is one that it answers."""
    rows = candidates(spark, sf_dir, 5)
    planted = F.when(F.col("query_id") % 3 == 0, "What was the root cause of the DNS misconfiguration in the CoreDNS deployment, and how was it resolved?").otherwise(F.col("query"))
    asked = rows.select("query_id", planted.alias("query")).distinct()
    found = answers.probe_results(answers.extract_answers(asked, answers.inject_canary(rows.select("query_id", "rank", "text"))))
    return found.withColumn("matched", F.array_join("matched", ","))


_RATIOS = ("faithfulness", "citation_precision", "citation_recall", "hallucination_rate", "citation_coverage", "answer_relevancy", "unsupported_claim_rate")


@ANSWERING.add(
    f"""WITH picked_up AS MATERIALIZED ({_strategy_sql('full', 2048, _FIVE)}), chunk AS MATERIALIZED (SELECT p.query_id, p.chunk_id, p.rank, d.text FROM picked_up p JOIN documents d ON d.doc_id = p.chunk_id), {_EXTRACT},
    answers AS (SELECT item_id AS query_id, text AS query, coalesce(answer, '{answers.REFUSAL}') AS answer FROM benchmark LEFT JOIN pick ON query_id = item_id), every AS MATERIALIZED (SELECT query_id, query, {_NORMAL} AS answer FROM answers),
    normal AS (SELECT * FROM every WHERE NOT contains(lower(answer), lower('{answers.REFUSAL}'))), {_JUDGED}, {_LINKED.format(entailment=entailment_sql("i.claim", "k.text"))},
    c AS (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE label = 'SUPPORTS') AS yes, count(*) FILTER (WHERE label = 'NO_CITATION') AS none, count(*) FILTER (WHERE label = 'NEUTRAL') AS open, sum(n_citations) AS cites FROM judged GROUP BY query_id),
    r AS (SELECT e.*, contains(lower(e.answer), lower('{answers.REFUSAL}')) AS refused, coalesce(n, 0) AS n, coalesce(yes, 0) AS yes, coalesce(none, 0) AS none, coalesce(open, 0) AS open, coalesce(cites, 0) AS cites FROM every e LEFT JOIN c USING (query_id))
    SELECT query_id, sha256(answer) AS answer_sha256, refused, n AS total_claims, yes AS supported_claims, round(CASE WHEN refused THEN 1 WHEN n = 0 THEN 0 ELSE yes / n END, 6) AS faithfulness, round(CASE WHEN refused THEN 1 WHEN n = 0 THEN 0 ELSE coalesce(yes / nullif(cites, 0), 0) END, 6) AS citation_precision,
        round(CASE WHEN refused THEN 1 WHEN n = 0 THEN 0 ELSE yes / n END, 6) AS citation_recall, round(CASE WHEN refused THEN 0 WHEN n = 0 THEN 1 ELSE (n - yes) / n END, 6) AS hallucination_rate, round(CASE WHEN refused OR n = 0 THEN 0 ELSE (n - none) / n END, 6) AS citation_coverage,
        round(CASE WHEN refused THEN 0 ELSE {coverage_sql('query', 'answer')} END, 6) AS answer_relevancy, round(CASE WHEN refused OR n = 0 THEN 0 ELSE (none + open) / n END, 6) AS unsupported_claim_rate FROM r"""
)
def grounded_answers(spark, sf_dir):
    """The whole way: retrieve, rerank, assemble, answer, judge. The chosen chunks, which three steps read, are stored."""
    from quern.operators import search

    reranked = search.lexical_rerank(candidates(spark, sf_dir, 20), 5)
    chosen = stored(context.select_chunks(reranked).select("query_id", "chunk_id", "rank", "text", "score"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    answered = stored(answers.finish(answers.extract_answers(asked, chosen), chosen).select("query_id", "query", "answer"))
    rows = answers.faithfulness(answered, answers.judge_claims(answered, chosen)).join(answered.select("query_id", F.sha2("answer", 256).alias("answer_sha256")), "query_id")
    return rows.select("query_id", "answer_sha256", "refused", "total_claims", "supported_claims", *(rounded(c).alias(c) for c in _RATIOS))
