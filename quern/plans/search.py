"""Queries of retrieval: BM25, vectors, fusion, reranking, the vector collection."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators import search, store
from quern.operators.staging import few, stored
from quern.plans.common import Catalog, rounded, table, token_set_sql, tokens_sql

SEARCH = Catalog()


def bm25_ctes(docs: str = "documents", queries: str = "benchmark") -> str:
    """CTEs that end in bm25(query_id, chunk_id, score) over all pairs that share a term."""
    return f"""terms AS (
    SELECT doc_id, unnest(t) AS term, len(t) AS dl FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM {docs})
), corpus AS (
    SELECT count(*) AS n, avg(len(t)) AS avgdl FROM (SELECT {tokens_sql('text')} AS t FROM {docs}) WHERE len(t) > 0
), posting AS (
    SELECT doc_id, term, any_value(dl) AS dl, count(*) AS tf FROM terms GROUP BY doc_id, term
), df AS (SELECT term, count(*) AS df FROM posting GROUP BY term
), asked AS (
    SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({tokens_sql('text')}) AS term FROM {queries}) GROUP BY ALL
), bm25 AS (
    SELECT item_id AS query_id, doc_id AS chunk_id,
           round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM posting JOIN df USING (term) JOIN asked USING (term), corpus GROUP BY ALL
)"""


def top(source: str, k: int) -> str:
    return f"SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM {source} QUALIFY rank <= {k}"


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text"), F.col("text").alias("query"))


def bm25(docs, asked, k, *filters, **columns):
    """Scores are rounded before ranking, as sums of doubles differ in their last digits by order of addition."""
    return search.bm25(docs, asked, k, *filters, places=6, **columns)


@SEARCH.add(f"WITH {bm25_ctes()} {top('bm25', 5)}")
def bm25_topk(spark, sf_dir):
    return bm25(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), 5)


@SEARCH.add(f"WITH {bm25_ctes()}, allowed AS (SELECT b.* FROM bm25 b JOIN documents d ON d.doc_id = b.chunk_id WHERE d.lang = 'en') {top('allowed', 5)}")
def bm25_filtered_pre(spark, sf_dir):
    return bm25(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), 5, {"lang": "en"}, "pre")


@SEARCH.add(
    f"WITH {bm25_ctes()}, few AS ({top('bm25', 20)}), allowed AS (SELECT f.* EXCLUDE (rank) FROM few f JOIN documents d ON d.doc_id = f.chunk_id WHERE d.lang = 'en') {top('allowed', 5)}"
)
def bm25_filtered_post(spark, sf_dir):
    return bm25(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), 5, {"lang": "en"}, "post")


@SEARCH.add(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY term")
def term_document_frequency(spark, sf_dir):
    return search.term_statistics(table(spark, sf_dir, "documents"))


_VOCABULARY = f"""terms AS (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents),
    df AS (SELECT term, count(DISTINCT doc_id) AS df FROM terms GROUP BY term),
    vocabulary AS (SELECT term, df, ((row_number() OVER (ORDER BY term) - 1) % 768)::INTEGER AS bucket, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM df)"""


@SEARCH.add(f"WITH {_VOCABULARY} SELECT term, df, bucket, round(idf, 6) AS idf FROM vocabulary")
def tfidf_vocabulary(spark, sf_dir):
    return search.tfidf_vocabulary(table(spark, sf_dir, "documents")).withColumn("idf", rounded("idf"))


@SEARCH.add(
    f"""WITH {_VOCABULARY}, sums AS (SELECT doc_id, bucket, sum(idf) AS w FROM terms JOIN vocabulary USING (term) GROUP BY ALL)
    SELECT doc_id AS chunk_id, count(*) AS buckets, round(sqrt(sum(w * w)), 4) AS size, round(max(w) / sqrt(sum(w * w)), 6) AS largest FROM sums GROUP BY doc_id"""
)
def tfidf_norms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counted = stored(search.term_counts(docs))
    vocabulary = few(stored(search.tfidf_vocabulary(docs, counted=counted)))
    sizes = counted.join(vocabulary, "term").groupBy("chunk_id", "bucket").agg(F.sum(F.col("tf") * F.col("idf")).alias("w"))
    sizes = sizes.groupBy("chunk_id").agg(rounded(F.sqrt(F.sum(F.col("w") * F.col("w"))), 4).alias("size"))
    unit = search.tfidf_vectors(docs, vocabulary, counted=counted).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("buckets"), rounded(F.max("weight")).alias("largest"))
    return unit.join(sizes, "chunk_id")


# ---------------------------------------------------------------- vectors

_DOUBLE = "CAST({}.embedding AS DOUBLE[])"


def _vector_sql(score: str, where: str = "TRUE") -> str:
    q, v = _DOUBLE.format("q"), _DOUBLE.format("v")
    return f"""WITH pair AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round({score.format(q=q, v=v)}, 6) AS score
        FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND {where}) {top('pair', 10)}"""


def _vectors(spark, sf_dir, metric="cosine", conditions=None):
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.vector_topk(rows, asked, 10, metric, conditions, places=6)


@SEARCH.add(_vector_sql("list_cosine_similarity({q}, {v})"))
def dense_cosine_topk(spark, sf_dir):
    return _vectors(spark, sf_dir)


@SEARCH.add(_vector_sql("list_cosine_similarity({q}, {v})", "v.label = 1"))
def dense_topk_label_filter(spark, sf_dir):
    return _vectors(spark, sf_dir, conditions={"label": 1})


@SEARCH.add(_vector_sql("list_inner_product({q}, {v})"))
def dense_inner_product_topk(spark, sf_dir):
    return _vectors(spark, sf_dir, "ip")


@SEARCH.add(_vector_sql("(0 - power(list_distance({q}, {v}), 2))"))
def dense_l2_topk(spark, sf_dir):
    return _vectors(spark, sf_dir, "l2").withColumn("score", F.when(F.col("score") == 0, 0.0).otherwise(F.col("score")))


@SEARCH.add(
    """WITH s AS (SELECT vec_id, CAST(embedding[1:16] AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS size FROM s)
    SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / CASE WHEN size = 0 THEN 1 ELSE size END)), 5) AS total, round(e[1] / CASE WHEN size = 0 THEN 1 ELSE size END, 6) AS first FROM n"""
)
def truncated_vectors(spark, sf_dir):
    cut = V.truncate(F.col("embedding"), 16)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", cut.alias("e"))
    return rows.select("vec_id", rounded(F.aggregate("e", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), rounded(F.col("e")[0]).alias("first"))


@SEARCH.add(
    """SELECT vec_id, vec_id // 25 AS document, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(lead(embedding) OVER (PARTITION BY vec_id // 25 ORDER BY vec_id) AS DOUBLE[])), 6) AS next_similarity FROM embeddings"""
)
def adjacent_similarity(spark, sf_dir):
    """Runs of 25 vectors stand for the chunks of a document."""
    rows = table(spark, sf_dir, "embeddings").withColumn("document", F.expr("vec_id div 25"))
    return search.adjacent_similarity(rows, "document", "vec_id").select("vec_id", "document", rounded("next_similarity").alias("next_similarity"))


@SEARCH.add("SELECT conv_id, turn, sha256(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS digest FROM conversations")
def neighbour_buffers(spark, sf_dir):
    rows = search.neighbour_texts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 2)
    return rows.select("conv_id", "turn", F.sha2("combined", 256).alias("digest"))


# ---------------------------------------------------------------- hybrid and reranking


def _service(spark, sf_dir):
    """All documents and passages; those with a vector of the same number have it."""
    vectors = table(spark, sf_dir, "embeddings")
    docs = table(spark, sf_dir, "documents").join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left").withColumnRenamed("doc_id", "chunk_id")
    asked = _asked(spark, sf_dir).join(vectors.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")
    return search.RetrievalService(docs, places=6, keep=20), asked


def _hybrid_ctes(k: int = 10) -> str:
    return f"""vd AS (SELECT d.doc_id, d.text, CAST(e.embedding AS DOUBLE[]) AS e FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),
    vq AS (SELECT b.item_id, b.text, CAST(e.embedding AS DOUBLE[]) AS e FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
    pair AS (SELECT q.item_id AS query_id, v.doc_id AS chunk_id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM vq q, vd v),
    dense AS ({top('pair', 2 * k)}), {bm25_ctes()}, keyword AS ({top('bm25', 2 * k)}),
    part AS (SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) AS p, rank AS d, NULL::INTEGER AS w FROM dense UNION ALL SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank), NULL, rank FROM keyword),
    fused AS (SELECT query_id, chunk_id, sum(p) AS s, min(d) AS dense_rank, min(w) AS keyword_rank FROM part GROUP BY ALL),
    hybrid AS (SELECT query_id, chunk_id, s, dense_rank, keyword_rank, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, dense_rank NULLS LAST, keyword_rank NULLS LAST, chunk_id)::INTEGER AS rank FROM fused QUALIFY rank <= {k})"""


@SEARCH.add(f"WITH {_hybrid_ctes()} SELECT query_id, chunk_id, round(s, 6) AS score, coalesce(dense_rank, 0) AS dense_rank, coalesce(keyword_rank, 0) AS keyword_rank, rank FROM hybrid")
def hybrid_rrf_topk(spark, sf_dir):
    service, asked = _service(spark, sf_dir)
    return service.retrieve(asked, "hybrid", 10).withColumn("score", rounded("score")).fillna(0, ["dense_rank", "keyword_rank"])


def jaccard_sql(a: str, b: str) -> str:
    both = f"len(list_intersect({token_set_sql(a)}, {token_set_sql(b)}))"
    return f"coalesce({both}::DOUBLE / nullif(len({token_set_sql(a)}) + len({token_set_sql(b)}) - {both}, 0), 0)"


_RERANK = f"""few AS ({top('bm25', 20)}), scored AS (
    SELECT f.query_id, f.chunk_id, f.rank AS original_rank, round({jaccard_sql('b.text', 'd.text')}, 6) AS score
    FROM few f JOIN documents d ON d.doc_id = f.chunk_id JOIN benchmark b ON b.item_id = f.query_id
), reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, original_rank, chunk_id)::INTEGER AS rank FROM scored QUALIFY rank <= 5)"""


def candidates(spark, sf_dir, k=20):
    """Passages with their best documents by BM25: query_id, query, chunk_id, text, score, rank."""
    docs = table(spark, sf_dir, "documents")
    asked = _asked(spark, sf_dir)
    return search.with_texts(bm25(docs, asked, k), asked, docs.select(F.col("doc_id").alias("chunk_id"), "text"))


@SEARCH.add(f"WITH {bm25_ctes()}, {_RERANK} SELECT query_id, chunk_id, original_rank, score, rank FROM reranked")
def lexical_rerank(spark, sf_dir):
    rows = search.lexical_rerank(candidates(spark, sf_dir), 5)
    return rows.select("query_id", "chunk_id", "original_rank", rounded("score").alias("score"), "rank")


@SEARCH.add(
    f"""WITH {bm25_ctes()}, few AS ({top('bm25', 10)}), w AS (SELECT *, min(score) OVER q AS lo, max(score) OVER q AS hi, count(*) OVER q AS n FROM few WINDOW q AS (PARTITION BY query_id))
    SELECT query_id, chunk_id, rank, round(CASE WHEN n = 1 THEN score WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END, 6) AS score FROM w"""
)
def minmax_normalize(spark, sf_dir):
    found = bm25(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), 10)
    return search.min_max(found).select("query_id", "chunk_id", "rank", rounded("score").alias("score"))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda w: w <> ''))"


@SEARCH.add(
    f"""WITH w AS (SELECT doc_id, unnest(ws) AS word, len(ws) AS nd FROM (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents)),
    q AS (SELECT item_id, unnest(ws) AS word, len(ws) AS nq FROM (SELECT item_id, {_WORDS.format('text')} AS ws FROM benchmark)),
    pair AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(count(*)::DOUBLE / (any_value(nd) + any_value(nq) - count(*)), 6) AS score FROM w JOIN q USING (word) GROUP BY ALL)
    {top('pair', 5)}"""
)
def lexical_overlap(spark, sf_dir):
    return search.lexical_overlap(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), 5, places=6)


# ---------------------------------------------------------------- the collection

_UPDATES = "SELECT vec_id, label + 100 AS label FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE label = 2"


@SEARCH.add(f"WITH u AS ({_UPDATES}) SELECT vec_id, label FROM u UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM u)")
def vector_upsert_latest(spark, sf_dir):
    now = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    changed = now.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 100)
    added = now.where("label = 2").withColumn("vec_id", F.col("vec_id") + 1_000_000)
    return store.upsert_vectors(now, changed.unionByName(added), 64, "vec_id").select("vec_id", "label")


@SEARCH.add("SELECT vec_id, label FROM embeddings WHERE label <> 1")
def vector_delete_by_filter(spark, sf_dir):
    return store.delete_vectors(table(spark, sf_dir, "embeddings"), conditions={"label": 1}, key="vec_id").select("vec_id", "label")


@SEARCH.add("SELECT label AS document_id, count(*) AS vectors, min(vec_id) AS first FROM (SELECT vec_id, label FROM embeddings WHERE label <> 3 UNION ALL SELECT vec_id + 500000, label FROM embeddings WHERE label = 3) GROUP BY label")
def reindex_documents(spark, sf_dir):
    now = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("document_id"), "embedding")
    new = now.where("document_id = 3").withColumn("vec_id", F.col("vec_id") + 500_000)
    return store.replace_documents(now, new).groupBy("document_id").agg(F.count(F.lit(1)).alias("vectors"), F.min("vec_id").alias("first"))


@SEARCH.add("SELECT doc_id, lang AS m_lang, source AS m_nested_source, lang || ',' || source AS m_tags FROM documents")
def metadata_flatten(spark, sf_dir):
    meta = F.struct("lang", F.struct("source").alias("nested"), F.array("lang", "source").alias("tags"), F.lit(None).cast("string").alias("nothing"))
    rows = store.flatten_metadata(table(spark, sf_dir, "documents").select("doc_id", meta.alias("metadata")))
    m = F.col("metadata")
    return rows.where(F.size(m) == 3).select("doc_id", m["lang"].alias("m_lang"), m["nested_source"].alias("m_nested_source"), m["tags"].alias("m_tags"))
