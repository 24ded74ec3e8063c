"""Queries of the stored indexes: keywords and vectors, built, refreshed and asked."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators.keyword_index import KeywordIndex
from quern.operators.snapshots import Snapshots
from quern.operators.staging import scratch_folder
from quern.operators.vector_index import VectorIndex
from quern.plans.common import Catalog, table, tokens_sql
from quern.plans.search import SEARCH, bm25_ctes, top

INDEXES = Catalog()

_LIVE = "live AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || ' amended' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3)"


def keyword_index(spark, sf_dir, slot_texts: int = 256) -> KeywordIndex:
    """Even documents arrive first, then the odd ones with every fifth even one amended; every seventh of all is deleted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = KeywordIndex(spark, scratch_folder(spark, "keywords"), slot_texts=slot_texts)
    index.append(docs.where("doc_id % 2 = 0"))
    second = docs.where("doc_id % 2 = 1 OR doc_id % 10 = 0")
    index.append(second.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" amended"))).otherwise(F.col("text"))))
    index.delete(docs.where("doc_id % 7 = 3"))
    return index


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@INDEXES.add(f"WITH {_LIVE}, {bm25_ctes('live')} {top('bm25', 5)}")
def keyword_index_topk(spark, sf_dir):
    """Top five of the refreshed index, from its blocks."""
    return keyword_index(spark, sf_dir).search(_asked(spark, sf_dir), 5, places=6)


@INDEXES.add(f"WITH {_LIVE}, {bm25_ctes('live')} {top('bm25', 5)}")
def keyword_index_merged_topk(spark, sf_dir):
    """The same after its segments were merged."""
    index = keyword_index(spark, sf_dir)
    index.fan = 2
    index.merge()
    return index.search(_asked(spark, sf_dir), 5, places=6)


@INDEXES.add(
    f"WITH {_LIVE}, n AS (SELECT len({tokens_sql('text')}) AS dl FROM live) SELECT 2 AS segments, count(*) AS texts, sum(dl)::BIGINT AS tokens, true AS skipped, true AS only_asked FROM n WHERE dl > 0"
)
def keyword_index_statistics(spark, sf_dir):
    """Numbers of the index, and whether a search left blocks of a query's words unscored, and blocks of other words unread."""
    index = keyword_index(spark, sf_dir, 64)
    numbers = index.statistics()
    found, counts = index.explain(_asked(spark, sf_dir), 1, places=6)
    row = [F.lit(numbers[c]).cast("int" if c == "segments" else "long").alias(c) for c in ("segments", "texts", "tokens")]
    return counts.select(*row, (F.col("read") < F.col("asked")).alias("skipped"), (F.col("held") < F.col("blocks")).alias("only_asked"))


# ---------------------------------------------------------------- vectors


def vector_index(spark, sf_dir) -> VectorIndex:
    """All vectors: those of even ids at first, the odd ones as an arrival."""
    rows = table(spark, sf_dir, "embeddings")
    index = VectorIndex(spark, scratch_folder(spark, "vectors"))
    index.build(rows.where("vec_id % 2 = 0"))
    index.append(rows.where("vec_id % 2 <> 0"))
    return index


def _nearest_to(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@INDEXES.add(SEARCH.sql["dense_cosine_topk"])
def vector_index_exact_topk(spark, sf_dir):
    """All lists: what the exact search finds."""
    return vector_index(spark, sf_dir).search(_nearest_to(spark, sf_dir), 10, exact=True, places=6)


@INDEXES.add("SELECT count(*) FILTER (WHERE vec_id % 20 = 0) AS queries, count(*) AS indexed, true AS recall_reached, true AS lists_skipped FROM embeddings WHERE embedding IS NOT NULL")
def vector_index_recall(spark, sf_dir):
    """Recall at 10 of every twentieth vector among all, measured against the exact search, with the fewest probes that reach 0.92; and whether that left lists out."""
    index = vector_index(spark, sf_dir)
    queries = _nearest_to(spark, sf_dir)
    probes, share = index.calibrate(queries, 10, 0.92)
    lists = index.tables.read("model").select("lists")
    numbers = queries.agg(F.count(F.lit(1)).alias("queries")).crossJoin(index.live().agg(F.count(F.lit(1)).alias("indexed")))
    return numbers.crossJoin(lists).select("queries", "indexed", F.lit(share >= 0.9).alias("recall_reached"), (F.lit(probes) < F.col("lists")).alias("lists_skipped"))


@INDEXES.add(
    f"""WITH live AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 9 <> 4),
    pair AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), v.e), 6) AS score
        FROM embeddings q, live v WHERE q.vec_id % 20 = 0) {top('pair', 3)}"""
)
def vector_index_after_deletes(spark, sf_dir):
    """Every ninth vector is deleted: the best three of the others, by the codes of all lists and rescored."""
    index = vector_index(spark, sf_dir)
    index.delete(table(spark, sf_dir, "embeddings").where("vec_id % 9 = 4").select("vec_id"))
    return index.search(_nearest_to(spark, sf_dir), 3, probes=1 << 20, rescore=1 << 20, places=6)


@INDEXES.add(
    """SELECT 'odd' AS step, count(*) FILTER (WHERE doc_id % 2 = 1) AS inserted, 0 AS skipped, 0 AS deleted FROM documents
    UNION ALL SELECT 'all', count(*) FILTER (WHERE doc_id % 2 = 0), count(*) FILTER (WHERE doc_id % 2 = 1), 0 FROM documents
    UNION ALL SELECT 'sevenths', 0, 0, count(*) FILTER (WHERE doc_id % 7 = 0) FROM documents
    UNION ALL SELECT 'left', count(*) FILTER (WHERE doc_id % 7 <> 0), 0, 0 FROM documents"""
)
def counted_writes(spark, sf_dir):
    """Inserts that leave known keys alone, and a deletion, each with what the writing job itself has counted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = Snapshots(spark, scratch_folder(spark, "writes"), {"documents": "doc_id long, text string"})
    odd = kept.insert("documents", docs.where("doc_id % 2 = 1"), ["doc_id"])
    every = kept.insert("documents", docs, ["doc_id"])
    gone = kept.delete("documents", docs.where("doc_id % 7 = 0"), ["doc_id"])
    rows = [("odd", odd["inserted"], odd["skipped"], 0), ("all", every["inserted"], every["skipped"], 0), ("sevenths", 0, 0, gone["deleted"])]
    left = kept.read("documents").agg(F.lit("left").alias("step"), F.count(F.lit(1)).alias("inserted"), F.lit(0).cast("long").alias("skipped"), F.lit(0).cast("long").alias("deleted"))
    return spark.createDataFrame(rows, "step string, inserted long, skipped long, deleted long").unionByName(left)
