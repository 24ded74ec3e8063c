"""Queries of the text functions and chunkers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import answers, chunking, context
from quern.plans import chunk_sql as S
from quern.plans.common import BLANKS, Catalog, table, tokens_sql

TEXT = Catalog()

#: The documents as Markdown: a title, and by their numbers lines become parts with headings, fences, lists and paragraphs.
MARKDOWN_SQL = """'# ' || source || chr(10) || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE (i - 1) % 9
    WHEN 1 THEN chr(10) || '## Part ' || (i - 1) || chr(10) || chr(10) || x WHEN 3 THEN chr(10) || '```' || chr(10) || x || chr(10) || '```' || chr(10) WHEN 4 THEN '- ' || x WHEN 5 THEN '- ' || x
    WHEN 6 THEN '1. ' || x WHEN 7 THEN chr(10) || x || chr(10) ELSE x END), chr(10))"""


def markdown():
    def line(x, i):
        k = i % 9
        part = F.when(k == 1, F.concat(F.lit("\n## Part "), i.cast("string"), F.lit("\n\n"), x)).when(k == 3, F.concat(F.lit("\n```\n"), x, F.lit("\n```\n")))
        return part.when(k.isin(4, 5), F.concat(F.lit("- "), x)).when(k == 6, F.concat(F.lit("1. "), x)).when(k == 7, F.concat(F.lit("\n"), x, F.lit("\n"))).otherwise(x)

    return F.concat(F.lit("# "), F.col("source"), F.lit("\n\n"), F.array_join(F.transform(F.split("text", "\n"), line), "\n"))


@TEXT.add("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END::INTEGER AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@TEXT.add(
    f"""SELECT page_id, length(t) AS chars, sha256(t) AS digest FROM (
        SELECT page_id, trim(regexp_replace(regexp_replace(html, ' +', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {BLANKS}) AS t FROM pages)"""
)
def normalize_whitespace(spark, sf_dir):
    text = T.normalize_whitespace(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(text).alias("chars"), F.sha2(text, 256).alias("digest"))


@TEXT.add(f"SELECT doc_id, len({tokens_sql('text')}) AS n_tokens, len(list_distinct({tokens_sql('text')})) AS n_distinct FROM documents")
def tokenize_counts(spark, sf_dir):
    terms = T.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(terms).alias("n_tokens"), F.size(F.array_distinct(terms)).alias("n_distinct"))


@TEXT.add(
    rf"""WITH d AS (SELECT doc_id, {MARKDOWN_SQL} AS t FROM documents), s AS (
        SELECT doc_id, len(regexp_extract_all(t, '(?m)^#{{1,6}}\s+.+$')) AS headers,
               coalesce(list_sum(list_transform(regexp_extract_all(t, '```[\s\S]*?```|~~~[\s\S]*?~~~'), lambda x: length(x))), 0) AS code, length(t) AS chars,
               len(list_filter(regexp_split_to_array(t, '\n\n+'), lambda p: trim(p, {BLANKS}) <> '')) AS paragraphs FROM d)
    SELECT doc_id, headers AS header_count, paragraphs AS paragraph_count, greatest(1, chars // 4) AS total_tokens,
           headers >= 2 AND headers / greatest(paragraphs, 1) > 0.1 AND code / chars < 0.7 AS is_well_structured FROM s"""
)
def document_structure_analysis(spark, sf_dir):
    found = T.structure(F.col("md"))
    rows = table(spark, sf_dir, "documents").select("doc_id", markdown().alias("md")).select("doc_id", found.alias("s"))
    return rows.select("doc_id", "s.header_count", "s.paragraph_count", "s.total_tokens", "s.is_well_structured")


@TEXT.add("SELECT sha256(text) AS hash_content, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_hash_dedup(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(T.sha256_text(F.col("text")).alias("hash_content")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@TEXT.add(
    f"""SELECT query_id, chunk_id FROM (SELECT doc_id % 7 AS query_id, doc_id AS chunk_id,
        row_number() OVER (PARTITION BY doc_id % 7, lower(trim(text, {BLANKS})) ORDER BY n_chars DESC, doc_id) AS turn FROM documents) WHERE turn = 1"""
)
def exact_dedup_keep_best(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select((F.col("doc_id") % 7).alias("query_id"), F.col("doc_id").alias("chunk_id"), "text", F.col("n_chars").alias("score"), F.lit(1).alias("rank"))
    return context.exact_keep_best(rows).select("query_id", "chunk_id")


_UUID = """lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12))"""


@TEXT.add(
    f"""SELECT doc_id, {_UUID} AS document_id FROM (
        SELECT doc_id, sha1(unhex('{T.DOCUMENT_NAMESPACE.replace("-", "")}') || encode('markdown_doc:' || doc_id || ':' || coalesce(nullif(lang, ''), 'default'))) AS h FROM documents)"""
)
def uuid5_document_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.document_id(F.lit("markdown_doc"), F.col("doc_id").cast("string"), F.col("lang")).alias("document_id"))


@TEXT.add(
    rf"""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '(?i)\[Source\s+\d+\]', '', 'g'), {BLANKS}) AS t FROM documents),
    s AS (SELECT doc_id, t, unnest(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM c),
    k AS (SELECT doc_id, trim(regexp_replace(s, '\s+', ' ', 'g'), {BLANKS}) AS claim FROM s WHERE NOT lower(t) LIKE 'i cannot answer%')
    SELECT doc_id, count(*) AS n_claims, sum(length(claim))::BIGINT AS chars FROM k WHERE length(claim) >= 10 GROUP BY doc_id"""
)
def sentence_split_claims(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(answers.claims(F.col("text"))).alias("claim"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_claims"), F.sum(F.length("claim")).alias("chars"))


@TEXT.add(
    rf"""WITH m AS (SELECT doc_id, {MARKDOWN_SQL} AS t FROM documents), b AS (SELECT doc_id, t, regexp_extract_all(t, '```[\s\S]*?```|~~~[\s\S]*?~~~') AS f, regexp_extract_all(t, '(?:^|\n)((?:[-*]\s+.+\n?)+)', 1) AS u, regexp_extract_all(t, '(?:^|\n)((?:\d+\.\s+.+\n?)+)', 1) AS n FROM m)
    SELECT doc_id, trim(regexp_extract(t, '^(#{{1,6}})\s+(.+?)(?:\n|$)', 2), {BLANKS}) AS header, len(f) AS fences, coalesce(list_sum(list_transform(f, lambda x: length(x))), 0)::BIGINT AS code_chars, len(u) AS bullets, sha256(array_to_string(u, '|')) AS bullets_sha256,
           len(n) AS numbered, len(list_filter(string_split(t, chr(10) || '#'), lambda x: x <> '')) AS parts, coalesce(length(f[1]), 0) > 0 AS inside FROM b"""
)
def text_blocks(spark, sf_dir):
    """Opening heading, fences, lists and parts of the Markdown form, and whether the first fence's own place lies inside it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", markdown().alias("t"))
    rows = docs.select("doc_id", "t", T.fences(F.col("t")).alias("f"), T.bullet_lists(F.col("t")).alias("u"))
    start = F.instr(F.col("t"), F.lit("```")) - 1
    ranges = F.array(F.struct(start.alias("start"), (start + F.length(F.get("f", F.lit(0)))).alias("end")))
    return rows.select(
        "doc_id", T.first_header(F.col("t")).alias("header"), F.size("f").alias("fences"), F.aggregate("f", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("code_chars"), F.size("u").alias("bullets"), F.sha2(F.array_join("u", "|"), 256).alias("bullets_sha256"),
        F.size(T.numbered_lists(F.col("t"))).alias("numbered"), F.size(T.split_keeping(F.col("t"), "\n#")).alias("parts"), F.coalesce(T.in_ranges(start, ranges), F.lit(False)).alias("inside"),
    )


# ---------------------------------------------------------------- chunkers


def _chunk_rows(source: str, strategy: str, header: str = "''", code: str = "false", summary: str = "false") -> str:
    """The columns of a chunk from (k, pos, span, t)."""
    text, index = f"trim(t, {BLANKS})", "(pos - 1)::INTEGER"
    return f"""SELECT k AS doc_id, {index} AS chunk_index, {S.chunk_id("k::VARCHAR", "(pos - 1)::VARCHAR", text)} AS chunk_id, sha256({text}) AS chunk_hash, ({S.estimate("length(t)")})::INTEGER AS token_count, length({text})::INTEGER AS char_count,
        coalesce({header}, '') AS section_header, {code} AS has_code_block, {summary} AS is_summary_chunk, '{strategy}' AS strategy FROM {source}"""


def _structured_rows(source: str, strategy: str = "structure_aware") -> str:
    return _chunk_rows(source, strategy, S.opening("span"), "contains(span, '```') OR contains(span, '~~~')", "pos = 1")


def _columns(chunks):
    header = F.coalesce("section_header", F.lit("")).alias("section_header")
    return chunks.select("doc_id", "chunk_index", "chunk_id", "chunk_hash", "token_count", "char_count", header, "has_code_block", "is_summary_chunk", "strategy")


_SMALL = chunking.ChunkerConfig(128, 20, 40, 192)
_PLAIN = chunking.ChunkerConfig(512, 25, 100, 768)
_MD = f"md AS MATERIALIZED (SELECT doc_id AS k, {MARKDOWN_SQL} AS t FROM documents)"
_TEXT = "plain AS (SELECT doc_id AS k, text AS t FROM documents WHERE trim(text) <> '')"


def _chunks(spark, sf_dir, strategy, text=None, config=None, **options):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("text") if text is None else text).alias("text"))
    return _columns(chunking.chunk_documents(docs, strategy, config, **options).where("error is null"))


@TEXT.add(f"WITH RECURSIVE {_TEXT}, {S.recursive('r', 'plain', _PLAIN)} {_chunk_rows('r_chunk', 'recursive')}")
def recursive_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir, "recursive", config=_PLAIN)


@TEXT.add(f"WITH RECURSIVE {_MD}, {S.recursive('r', 'md', _SMALL)} SELECT k AS doc_id, pos - 1 AS chunk_index, a AS start_char_offset, b AS end_char_offset FROM r_chunk")
def recursive_offsets(spark, sf_dir):
    """Where small chunks of the Markdown form begin and end in the tidied text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", markdown().alias("text"))
    return chunking.chunk_documents(docs, "recursive", _SMALL).select("doc_id", "chunk_index", "start_char_offset", "end_char_offset")


@TEXT.add(f"WITH RECURSIVE {_MD}, {S.structured('s', 'md', _SMALL)} {_structured_rows('s_chunk')}")
def structure_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir, "structure_aware", markdown(), _SMALL)


_WELL = rf"""fit AS (SELECT k, t, len(regexp_extract_all(t, '(?m)^#{{1,6}}\s+.+$')) AS heads, len(list_filter(regexp_split_to_array(t, '\n\n+'), lambda p: trim(p, {BLANKS}) <> '')) AS blocks,
    coalesce(list_sum(list_transform(regexp_extract_all(t, '```[\s\S]*?```|~~~[\s\S]*?~~~'), lambda x: length(x))), 0) AS code FROM mixed),
    good AS (SELECT k, t FROM fit WHERE heads >= 2 AND heads / greatest(blocks, 1) > 0.1 AND code < 0.7 * length(t)), bad AS (SELECT k, t FROM fit WHERE k NOT IN (SELECT k FROM good))"""


@TEXT.add(
    f"WITH RECURSIVE mixed AS MATERIALIZED (SELECT doc_id AS k, CASE WHEN doc_id % 2 = 0 THEN {MARKDOWN_SQL} ELSE text END AS t FROM documents WHERE trim(text) <> '' OR doc_id % 2 = 0), {_WELL}, {S.structured('s', 'good', _SMALL)}, {S.recursive('r', 'bad', _SMALL)} {_structured_rows('s_chunk', 'hybrid:structure_aware')} UNION ALL {_chunk_rows('r_chunk', 'hybrid:recursive')}"
)
def hybrid_chunks(spark, sf_dir):
    """Every second document in its Markdown form, the others plain."""
    return _chunks(spark, sf_dir, "hybrid", F.when(F.col("doc_id") % 2 == 0, markdown()).otherwise(F.col("text")), _SMALL)


@TEXT.add(f"WITH RECURSIVE {_TEXT}, {S.split_sentences('m', 'plain')}, {S.packed_sentences('m', 'plain', 512)}, {S.overlapped('m', 'm_join', 50)} {_chunk_rows('m_chunk', 'semantic')}")
def sentence_packed_chunks(spark, sf_dir):
    """The semantic chunker without an embedder."""
    return _chunks(spark, sf_dir, "semantic")


_LETTERS = "etaoinshr"
#: A threshold that no cosine of small counts equals, as there the last bit of a double would decide.
_TURN = 0.9013
_MEANING = chunking.SemanticConfig(128, 20, 30, 256, similarity_threshold=_TURN, min_sentences_per_chunk=2)


def _letters(texts):
    """A stand-in for an embedder: how often each of nine letters occurs."""
    import numpy as np

    return np.array([[t.count(c) for c in _LETTERS] for t in texts], float)


_COUNTS = f"list_transform(string_split('{_LETTERS}', ''), lambda c: (length(txt) - length(replace(txt, c, '')))::DOUBLE)"


@TEXT.add(
    f"""WITH RECURSIVE {_TEXT}, {S.split_sentences('m', 'plain')}, {S.by_meaning('m', _TURN, 2, _COUNTS)}, many AS MATERIALIZED (SELECT * FROM m_topic WHERE k IN (SELECT k FROM m_turn WHERE m >= 3)),
    {S.joined('j', 'many', 30, 256)}, {S.overlapped('j', 'j_join', 20)}, few AS (SELECT k, 1::BIGINT AS pos, '' AS span, {S.tidy('t')} AS t FROM plain WHERE k NOT IN (SELECT k FROM many))
    {_chunk_rows('j_chunk', 'semantic')} UNION ALL {_chunk_rows('few', 'semantic')}"""
)
def semantic_chunks(spark, sf_dir):
    """Breaks where neighbouring sentences' vectors differ."""
    return _chunks(spark, sf_dir, "semantic", config=_MEANING, embed=_letters)


_FIRST = f"split_part(body, {S._GAP}, 1)"


@TEXT.add(
    f"""WITH RECURSIVE {_MD}, tidied AS (SELECT k, '# Issue ' || source AS head, {S.tidy('t')} AS body FROM md JOIN documents ON doc_id = k), parted AS (SELECT k, head, {_FIRST} AS first, substr(body, length({_FIRST}) + 3) AS rest FROM tidied),
    cut AS MATERIALIZED (SELECT k, head, first, CASE WHEN length(head || {S._GAP} || first) <= 512 THEN head || {S._GAP} || first ELSE head END AS summary,
        CASE WHEN length(head || {S._GAP} || first) <= 512 THEN rest WHEN rest <> '' THEN first || {S._GAP} || rest ELSE first END AS rest FROM parted), more AS (SELECT k, rest AS t FROM cut WHERE trim(rest, {BLANKS}) <> ''),
    {S.structured('s', 'more', _SMALL)}, whole AS (SELECT k, 1::BIGINT AS pos, '' AS span, summary AS t FROM cut UNION ALL SELECT k, pos + 1, span, t FROM s_chunk)
    {_chunk_rows('whole', 'github_issue', S.opening('span'), f"CASE WHEN pos = 1 THEN false ELSE contains(span, '```') OR contains(span, '~~~') END", 'pos <= 2')}"""
)
def issue_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", markdown().alias("text"), F.lit("github_issue").alias("source_type"), F.concat(F.lit("Issue "), "source").alias("title"))
    return _columns(chunking.chunk_documents(docs, config=_SMALL, source_col="source_type", title_col="title"))


_THREAD = "c AS (SELECT conv_id AS thread, turn AS o, CASE WHEN turn % 5 > 1 THEN 'user' ELSE role END AS author, turn::VARCHAR AS first_at, text AS body FROM conversations)"


@TEXT.add(
    f"""WITH RECURSIVE {_THREAD}, {S.merged_comments('c', 'c', 768)}, h AS (SELECT *, '**Comment by @' || author || ':**' || {S._GAP} AS head, thread * 100000 + pos AS k FROM c_comment), long AS (SELECT k, body AS t FROM h WHERE length(head) + length(body) > 512),
    {S.structured('s', 'long', _SMALL)}, all_of AS (SELECT thread, pos, 1::BIGINT AS part, first_at, author, head || body AS t FROM h WHERE length(head) + length(body) <= 512 UNION ALL SELECT h.thread, h.pos, s.pos, first_at, author, head || trim(s.t, {BLANKS}) FROM h JOIN s_chunk s USING (k))
    SELECT thread AS conv_id, (row_number() OVER (PARTITION BY thread ORDER BY pos, part) - 1)::INTEGER AS chunk_index, first_at AS comment_id, author, ({S.estimate('length(t)')})::INTEGER AS token_count, sha256(trim(t, {BLANKS})) AS chunk_hash FROM all_of"""
)
def thread_chunks(spark, sf_dir):
    """Comments of one author merged under the size cap, long ones cut by structure."""
    turns = table(spark, sf_dir, "conversations").withColumn("role", F.when(F.col("turn") % 5 > 1, "user").otherwise(F.col("role")))
    return chunking.chunk_threads(turns, _SMALL).select("conv_id", "chunk_index", "comment_id", "author", "token_count", F.sha2("chunk_text", 256).alias("chunk_hash"))


@TEXT.add(
    f"WITH RECURSIVE {_TEXT}, {S.recursive('r', 'plain', chunking.ChunkerConfig())} SELECT k AS doc_id, count(*) AS total_chunks, sum({S.estimate('length(t)')})::BIGINT AS total_tokens, sum(length(trim(t, {BLANKS})))::BIGINT AS total_chars FROM r_chunk GROUP BY k"
)
def chunk_summary_by_doc(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.summarize(chunking.chunk_documents(docs, "recursive"))


_GRID = [(s, n, o) for s in ("recursive", "structure_aware") for n in (256, 512) for o in (25, 50)]


def _grid_sql() -> str:
    parts, ctes = [], []
    for k, (strategy, size, overlap) in enumerate(_GRID):
        config = chunking.ChunkerConfig(size, overlap, 50, 2 * size)
        ctes.append(S.recursive(f"g{k}", "md", config) if strategy == "recursive" else S.structured(f"g{k}", "md", config))
        parts.append(f"SELECT '{strategy}' AS strategy, {size} AS chunk_size, {overlap} AS chunk_overlap, count(*) AS chunks, sum({S.estimate('length(t)')})::BIGINT AS tokens FROM g{k}_chunk")
    return f"WITH RECURSIVE {_MD}, {', '.join(ctes)} {' UNION ALL '.join(parts)}"


@TEXT.add(_grid_sql())
def chunking_grid(spark, sf_dir):
    """Every configuration of the grid over the corpus: chunks and tokens."""
    from functools import reduce

    docs = table(spark, sf_dir, "documents").select("doc_id", markdown().alias("text"))
    runs = []
    for strategy, size, overlap in _GRID:
        rows = chunking.chunk_documents(docs, strategy, chunking.ChunkerConfig(size, overlap, 50, 2 * size))
        runs.append(rows.agg(F.count("chunk_text").alias("chunks"), F.sum("token_count").alias("tokens")).select(F.lit(strategy).alias("strategy"), F.lit(size).alias("chunk_size"), F.lit(overlap).alias("chunk_overlap"), "chunks", "tokens"))
    return reduce(lambda a, b: a.unionByName(b), runs)
