"""Batch retrieval: BM25, exact vector search, reciprocal-rank fusion and reranking.

All functions take a batch of queries and answer with rows keyed by (query_id, chunk_id), ranked
from 1 in a total order: score, then chunk id. Scoring all queries against a row and keeping each
query's best is done where the row is read, so what is shuffled are k rows a query and task, and never
pairs of queries and texts; texts are tokenised in the JVM, the sums are NumPy on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vectors as V
from quern.operators.staging import few, stored

#: Up to so many queries are shipped to every task; more are dealt into blocks that meet groups of rows in a shuffle.
BLOCK_QUERIES, GROUP_ROWS = 4096, 1 << 16
BROADCAST_TERMS = 500_000
#: Scores of a block that are held at a time.
_CELLS = 2_000_000
_SCORES = "query_id long, chunk_id long, score double"


def rank(rows: DataFrame, k: int | None, *order: Column, by: str = "query_id", name: str = "rank") -> DataFrame:
    """Number the rows of each query from 1, and keep the first k."""
    numbered = rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return numbered if k is None else numbered.where(F.col(name) <= k)


def where_metadata(rows: DataFrame, conditions: Mapping[str, object] | None) -> DataFrame:
    """Rows that match all conditions that are not None: a column, or a key of the ``metadata`` map."""
    for key, value in (conditions or {}).items():
        if value is not None:
            column = F.col(key) if key in rows.columns else F.col("metadata")[key]
            rows = rows.where(column == F.lit(value))
    return rows


# ---------------------------------------------------------------- the best of each query, task by task


class _Best:
    """The k best (chunk, score) of each query so far: score first, then the smaller id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.query, self.chunk, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.floor = np.full(len(ids), -np.inf)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, chunks: np.ndarray, score: np.ndarray, least: float = -np.inf, who: np.ndarray | None = None) -> None:
        """``score`` is queries (all, or those at the places ``who``) by chunks; scores not above ``least`` do not count."""
        n, floor = score.shape[1], self.floor if who is None else self.floor[who]
        floor = floor if n <= self.k else np.maximum(floor, np.partition(score, n - self.k, axis=1)[:, n - self.k])
        query, at = np.nonzero((score >= floor[:, None]) & (score > least))  # minus infinity is never above
        self.new.append((query if who is None else who[query], chunks[at], score[query, at]))
        if sum(len(x[0]) for x in self.new) >= self.k * len(self.ids):
            self._merge()

    def _merge(self) -> None:
        parts = [(self.query, self.chunk, self.score), *self.new]
        query, chunk, value = (np.concatenate([x[i] for x in parts]) for i in range(3))
        self.new = []
        order = np.lexsort((chunk, -value, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = order[place < self.k]
        full = query[place == self.k - 1]
        self.query, self.chunk, self.score = query[place < self.k], chunk[kept], value[kept]
        self.floor[full] = self.score[np.searchsorted(self.query, full, "right") - 1]

    def rows(self) -> pa.RecordBatch:
        self._merge()
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.query]), pa.array(self.chunk), pa.array(self.score)], ["query_id", "chunk_id", "score"])


_Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _best_of(rows: DataFrame, asked: DataFrame | pa.Table, kernel: Callable[[pa.Table], _Kernel], k: int) -> DataFrame:
    """The k best rows of each query; ``kernel`` turns a block of queries into a function over batches of rows."""
    return rank(_met(rows, asked, kernel, _SCORES), k, F.desc("score"), F.asc("chunk_id"))


def _met(rows: DataFrame, asked: DataFrame | pa.Table, kernel: Callable[[pa.Table], _Kernel], schema: str) -> DataFrame:
    """What ``kernel`` makes of each block of queries and each task's or group's rows."""
    block = asked if isinstance(asked, pa.Table) else asked.limit(BLOCK_QUERIES + 1).toArrow()
    if block.num_rows <= BLOCK_QUERIES:
        return rows.mapInArrow(kernel(block), schema)
    asked = rows.sparkSession.createDataFrame(asked) if isinstance(asked, pa.Table) else asked
    blocks = -(-asked.count() // BLOCK_QUERIES)
    # no more rows than a group may have, and groups for all cores
    groups = max(-(-rows.count() // GROUP_ROWS), -(-2 * rows.sparkSession.sparkContext.defaultParallelism // blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("__group", every(groups))
    right = rows.withColumn("__group", F.pmod(F.xxhash64("chunk_id"), F.lit(groups)).cast("int")).withColumn("__block", every(blocks))

    def meet(queries: pa.Table, texts: pa.Table) -> pa.Table:
        return pa.Table.from_batches(kernel(queries)(iter(texts.combine_chunks().to_batches(max_chunksize=10_000))))

    return left.groupBy("__block", "__group").cogroup(right.groupBy("__block", "__group")).applyInArrow(meet, schema)


def _rounded(score: np.ndarray, places: int | None) -> np.ndarray:
    """Halves away from zero, as SQL rounds."""
    return score if places is None else np.sign(score) * np.floor(np.abs(score) * 10**places + 0.5) / 10**places


def _scoped(queries: pa.Table, rows: pa.RecordBatch) -> np.ndarray | None:
    """Which rows are in the scope of which queries (a query without a scope sees all); None if nothing is scoped."""
    if "scope" not in queries.column_names:
        return None
    asked = queries.column("scope").combine_chunks().cast(pa.string())
    known = pc.unique(asked.drop_null())
    code = lambda a, none: pc.fill_null(pc.index_in(a, value_set=known), -1).to_numpy(zero_copy_only=False) if len(known) else np.full(len(a), none)
    wanted, given = code(asked, -1), code(rows.column("scope").cast(pa.string()), -1)
    return (wanted[:, None] == given[None, :]) | asked.is_null().to_numpy(zero_copy_only=False)[:, None]


# ---------------------------------------------------------------- BM25


def tokenized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(chunk_id, terms, dl). Texts without a token stay: a filter on the size would tokenise every text twice."""
    rows = docs.select(F.col(id_col).alias("chunk_id"), T.tokens(F.col(text_col)).alias("terms"))
    return rows.withColumn("dl", F.size("terms"))


def term_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, df): in how many texts each term occurs."""
    terms = tokenized(docs, id_col, text_col).select(F.explode(F.array_distinct("terms")).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_id, term, qtf): a term counts as often as the query repeats it."""
    terms = queries.select(F.col(id_col).alias("query_id"), F.explode(T.tokens(F.col(text_col))).alias("term"))
    return terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def corpus_counts(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """(term, df, tokens): in how many texts each of the terms occurs, and how many tokens these have.

    One scan that is summed up where it is read. An empty term, which no text has, stands for all texts with a token.
    """
    rows = tokenized(docs, doc_id, doc_text).where("dl > 0")
    held = rows.select("dl", F.explode(F.concat(F.array_distinct("terms"), F.array(F.lit("")))).alias("term")).join(terms, "term", "left_semi")
    return held.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("tokens"))


def _idf(n: int, df):
    return 1 + (n - df + 0.5) / (df + 0.5)


def _weighted(wanted: pa.Table, counts: pa.Table) -> tuple[pa.Table, float]:
    """Queries (query_id, terms, weights) from few query terms and their counts, and the mean number of tokens."""
    every = np.flatnonzero(counts.column("term").to_numpy() == "")
    df, tokens = counts.column("df").to_numpy(), counts.column("tokens").to_numpy()
    n, average = (int(df[every[0]]), tokens[every[0]] / df[every[0]]) if len(every) else (0, 1.0)
    at = pc.index_in(wanted.column("term"), value_set=counts.column("term").combine_chunks())
    wanted = wanted.append_column("at", at).filter(at.is_valid()).sort_by([("query_id", "ascending"), ("term", "ascending")])
    weight = wanted.column("qtf").to_numpy() * np.log(_idf(n, df[wanted.column("at").to_numpy()].astype(float)))
    query = wanted.column("query_id").cast(pa.int64()).to_numpy()
    ids, first = np.unique(query, return_index=True)
    offsets = pa.array(np.append(first, len(query)), pa.int32())
    term = pa.concat_arrays(wanted.column("term").cast(pa.string()).chunks) if len(query) else pa.array([], pa.string())
    return pa.table({"query_id": ids, "terms": pa.ListArray.from_arrays(offsets, term), "weights": pa.ListArray.from_arrays(offsets, pa.array(weight))}), average


def _asked(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, doc_text: str, query_text: str) -> tuple[DataFrame | pa.Table, float]:
    """Queries (query_id, terms, weights) and the mean number of tokens; few terms are weighed on the driver, more over the cluster."""
    wanted, spark = query_terms(queries, query_id, query_text), docs.sparkSession
    short = wanted.limit(BROADCAST_TERMS + 1).toArrow()
    if short.num_rows <= BROADCAST_TERMS:
        terms = spark.createDataFrame(pa.table({"term": pa.array([*pc.unique(short.column("term")).to_pylist(), ""], pa.string())}), "term string")
        return _weighted(short, corpus_counts(docs, F.broadcast(terms), doc_id, doc_text).toArrow())
    counts = stored(corpus_counts(docs, wanted.select("term").distinct().unionByName(spark.createDataFrame([("",)], "term string")), doc_id, doc_text))
    corpus = counts.where("term = ''").first()
    n, average = (corpus.df, corpus.tokens / corpus.df) if corpus else (0, 1.0)
    weight = (F.col("qtf") * F.log(_idf(n, F.col("df")))).alias("weight")
    rows = wanted.join(counts, "term").select(F.col("query_id").cast("long").alias("query_id"), F.struct("term", weight).alias("t")).groupBy("query_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return rows.select("query_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")), average


def _text_scorer(average: float | None, k: int, places: int | None, k1: float = 1.5, b: float = 0.75) -> Callable[[pa.Table], _Kernel]:
    """BM25 with a mean text length, or without one the Jaccard overlap of distinct words."""

    def kernel(queries: pa.Table) -> _Kernel:
        ids, lists = queries.column("query_id").to_numpy(), queries.column("terms").combine_chunks()
        owner = np.repeat(np.arange(len(ids)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        coded = pc.dictionary_encode(lists.flatten())
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        term = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(term, kind="stable")
        # the queries of term t, and their weights, are at start[t] .. start[t + 1]
        start = np.searchsorted(term[order], np.arange(len(coded.dictionary) + 1))
        owner, weight = owner[order], queries.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)[order]
        held = np.bincount(owner, minlength=len(ids))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, step = _Best(ids, k), max(1, _CELLS // max(len(ids), 1))
            for batch in batches:
                for a in range(0, batch.num_rows if len(ids) else 0, step):
                    part = batch.slice(a, step)
                    words = part.column("terms")
                    size = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    at = pc.index_in(words.flatten(), value_set=coded.dictionary)
                    known = at.is_valid().to_numpy(zero_copy_only=False)
                    text = np.repeat(np.arange(len(size)), size)[known]
                    # one entry for each text and query term in it, in order
                    cells, tf = np.unique(text * len(coded.dictionary) + at.drop_null().to_numpy(), return_counts=True)
                    text, found = np.divmod(cells, max(len(coded.dictionary), 1))
                    each = start[found + 1] - start[found]
                    entry = np.repeat(np.arange(len(found)), each)
                    use = np.arange(len(entry)) - np.repeat(np.cumsum(each) - each, each) + start[found][entry]
                    value = weight[use] if average is None else weight[use] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[text] / average)))[entry]
                    score = np.bincount(owner[use] * len(size) + text[entry], value, len(ids) * len(size)).reshape(len(ids), len(size))
                    if average is None:
                        score /= np.maximum(held[:, None] + size[None, :] - score, 1)
                    score, seen = _rounded(score, places), _scoped(queries, part)
                    best.add(part.column("chunk_id").to_numpy(), score if seen is None else np.where(seen, score, 0.0), 0.0)
            yield best.rows()

        return run

    return kernel


def bm25(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    conditions: Mapping[str, object] | None = None,
    filter_mode: str = "post",
    doc_id: str = "doc_id",
    query_id: str = "query_id",
    doc_text: str = "text",
    query_text: str = "text",
    places: int | None = None,
    scope: str | None = None,
) -> DataFrame:
    """The k best texts for each query: query_id, chunk_id, score, rank; texts without a term of the query are none of them.

    ``filter_mode`` "post" ranks the whole corpus, keeps 4 k candidates and filters those (a query
    may get fewer than k); "pre" filters first. Statistics are always those of the whole corpus. With
    ``places`` scores are rounded before they are ranked, so that the order of additions decides nothing. ``scope``
    names a column of both sides: a query that has a value sees only texts with that value (filtered first).
    """
    if filter_mode not in ("pre", "post"):
        raise ValueError("filter_mode is pre or post")
    asked, average = _asked(docs, queries, doc_id, query_id, doc_text, query_text)
    post = bool(conditions) and filter_mode == "post"
    given = where_metadata(docs, None if post else conditions)
    rows = given.select(F.col(doc_id).cast("long").alias("chunk_id"), T.tokens(F.col(doc_text)).alias("terms"), *_scope(scope))
    if scope:
        asked = docs.sparkSession.createDataFrame(asked) if isinstance(asked, pa.Table) else asked
        asked = asked.join(queries.select(F.col(query_id).cast("long").alias("query_id"), *_scope(scope)), "query_id")
    found = _best_of(rows, asked, _text_scorer(average, 4 * k if post else k, places), 4 * k if post else k)
    if not post:
        return found
    allowed = where_metadata(docs, conditions).select(F.col(doc_id).cast("long").alias("chunk_id"))
    return rank(found.drop("rank").join(allowed, "chunk_id", "left_semi"), k, F.desc("score"), F.asc("chunk_id"))


def _scope(column: str | None) -> list[Column]:
    return [F.col(column).cast("string").alias("scope")] if column else []


# ---------------------------------------------------------------- vectors


def vector_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    metric: str = "cosine",
    conditions: Mapping[str, object] | None = None,
    vector_id: str = "vec_id",
    query_id: str = "query_id",
    embedding: str = "embedding",
    places: int | None = None,
    scope: str | None = None,
) -> DataFrame:
    """Exact search: query_id, chunk_id, score, rank; the score is cosine similarity, inner product, or minus squared distance.

    Rows and queries without a vector take no part. ``places`` and ``scope`` as in ``bm25``.
    """
    if metric not in ("cosine", "ip", "l2"):
        raise ValueError(f"unknown metric {metric}")
    given = lambda df, i, name: df.where(F.col(embedding).isNotNull()).select(F.col(i).cast("long").alias(name), F.col(embedding).cast("array<double>").alias("embedding"), *_scope(scope))
    rows, asked = given(where_metadata(vectors, conditions), vector_id, "chunk_id"), given(queries, query_id, "query_id")
    return _best_of(rows, asked, _vector_scorer(k, metric, places), k)


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _matrix(lists: pa.ListArray, wide: int) -> np.ndarray:
    if set(pc.unique(pc.list_value_length(lists)).to_pylist()) - {wide}:
        raise ValueError(f"vectors must have {wide} dimensions like the queries")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)


def _vector_scorer(k: int, metric: str, places: int | None) -> Callable[[pa.Table], _Kernel]:
    def kernel(queries: pa.Table) -> _Kernel:
        ids, lists = queries.column("query_id").to_numpy(), queries.column("embedding").combine_chunks()
        wide = len(lists[0]) if len(ids) else 0
        given = _matrix(lists, wide) if len(ids) else np.zeros((0, 0))
        asked = _unit(given) if metric == "cosine" else given

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, step = _Best(ids, k), max(1, _CELLS // max(len(ids), 1))
            for batch in batches:
                for a in range(0, batch.num_rows if len(ids) else 0, step):
                    part = batch.slice(a, step)
                    m = _matrix(part.column("embedding"), wide)
                    score = asked @ (_unit(m) if metric == "cosine" else m).T
                    if metric == "l2":
                        score = 2 * score - (m * m).sum(1)[None, :] - (given * given).sum(1)[:, None]
                    score, seen = _rounded(score, places), _scoped(queries, part)
                    best.add(part.column("chunk_id").to_numpy(), score if seen is None else np.where(seen, score, -np.inf))
            yield best.rows()

        return run

    return kernel


def lexical_overlap(docs: DataFrame, queries: DataFrame, k: int = 5, doc_id: str = "doc_id", query_id: str = "query_id", doc_text: str = "text", query_text: str = "text", places: int | None = None) -> DataFrame:
    """Ranking by Jaccard overlap of white-space words, for when there are no vectors; pairs without a common word have score 0 and are left out."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(T.strip(F.col(c))), r"\s+"), lambda w: w != "")).alias("terms")
    rows = docs.select(F.col(doc_id).cast("long").alias("chunk_id"), words(doc_text))
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), words(query_text)).withColumn("weights", F.transform("terms", lambda w: F.lit(1.0)))
    return _best_of(rows, asked.where(F.size("terms") > 0), _text_scorer(None, k, places), k)


# ---------------------------------------------------------------- fusion and reranking


def reciprocal_rank_fusion(dense: DataFrame, keyword: DataFrame, k: int = 10, constant: int = 60, dense_weight: float = 1.0, keyword_weight: float = 1.0) -> DataFrame:
    """Fused ranking of two rankings; ties go to the better dense rank, then the better keyword rank."""
    one = dense.select("query_id", "chunk_id", (F.lit(dense_weight) / (constant + F.col("rank"))).alias("part"), F.col("rank").alias("d"), F.lit(None).cast("int").alias("w"))
    two = keyword.select("query_id", "chunk_id", (F.lit(keyword_weight) / (constant + F.col("rank"))).alias("part"), F.lit(None).cast("int").alias("d"), F.col("rank").alias("w"))
    fused = one.unionByName(two).groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"), F.min("d").alias("dense_rank"), F.min("w").alias("keyword_rank"))
    return rank(fused, k, F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("keyword_rank"), F.asc("chunk_id"))


def _as_candidates(rows: DataFrame) -> DataFrame:
    """Rank and score become the original ones, those of an earlier reranking go."""
    return rows.drop("original_rank", "original_score", "rerank_score").withColumnsRenamed({"rank": "original_rank", "score": "original_score"})


def lexical_rerank(candidates: DataFrame, k: int = 5) -> DataFrame:
    """Rerank (query_id, query, chunk_id, text, score, rank) by Jaccard overlap; a query without tokens keeps its order."""
    # the word sets are columns of their own, so each text is tokenised once
    kept = _as_candidates(candidates).withColumns({"__q": T.token_set(F.col("query")), "__c": T.token_set(F.col("text"))})
    kept = kept.withColumn("__o", T.jaccard(F.col("__q"), F.col("__c"))).withColumn("__n", F.size("__q")).drop("__q", "__c")
    kept = kept.withColumn("score", F.when(F.col("__n") == 0, F.col("original_score")).otherwise(F.col("__o"))).withColumn("rerank_score", F.col("score"))
    kept = kept.withColumn("__by", F.when(F.col("__n") == 0, F.lit(0.0)).otherwise(F.col("score")))
    return rank(kept, k, F.desc("__by"), F.asc("original_rank"), F.asc("chunk_id")).drop("__by", "__o", "__n")


def scored_rerank(candidates: DataFrame, scorer, k: int = 5, normalize: bool = True) -> DataFrame:
    """Rerank by a scorer, a function of two columns (query, text) such as a pandas UDF around a cross-encoder."""
    kept = _as_candidates(candidates).withColumn("score", scorer(F.col("query"), F.col("text")))
    if normalize:
        kept = min_max(kept)
    return rank(kept.withColumn("rerank_score", F.col("score")), k, F.desc("score"), F.asc("original_rank"), F.asc("chunk_id"))


def min_max(rows: DataFrame, column: str = "score") -> DataFrame:
    """Scores of each query to 0..1; all 1 if they are equal, a lone score as it is."""
    w = Window.partitionBy("query_id")
    low, high, n = F.min(column).over(w), F.max(column).over(w), F.count(F.lit(1)).over(w)
    scaled = F.when(n == 1, F.col(column)).when(high > low, (F.col(column) - low) / (high - low)).otherwise(1.0)
    return rows.withColumn(column, scaled)


def pass_through(candidates: DataFrame, k: int = 5) -> DataFrame:
    kept = candidates.withColumn("original_rank", F.col("rank")).withColumn("original_score", F.col("score")).withColumn("rerank_score", F.col("score"))
    return kept.where(F.col("rank") <= k)


def with_texts(found: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Retrieved rows with query and chunk columns. The rows, a few for each query, go to the chunks, which stay where they are, and so do the questions."""
    return chunks.join(few(stored(found)), "chunk_id").join(few(stored(queries.select("query_id", "query"))), "query_id")


class RetrievalService:
    """The three retrieval modes over one corpus, and retrieve-then-rerank.

    ``chunks`` has chunk_id, text and vectors in ``embedding``; queries have query_id, query and ``embedding``. What
    has no vector is found by keywords alone. With ``scope``, a column of both, a query that has a value
    (the document it asks about) sees only chunks with it. With ``keep`` the dense and the keyword ranking of a batch of queries without
    conditions are computed once, ``keep`` rows deep at least, and stored; the modes are cut from them or fuse them.
    """

    def __init__(self, chunks: DataFrame, filter_mode: str = "post", places: int | None = None, scope: str | None = None, keep: int = 0):
        self.chunks, self.filter_mode, self.places, self.scope, self.keep = chunks, filter_mode, places, scope, keep
        self._kept: dict[tuple, tuple[DataFrame, DataFrame, int]] = {}

    def retrieve(self, queries: DataFrame, mode: str = "hybrid", k: int = 10, conditions: Mapping[str, object] | None = None) -> DataFrame:
        if mode == "hybrid" or conditions or not self.keep:
            return self._retrieve(queries, mode, k, conditions)
        own, ranking, depth = self._kept.get((id(queries), mode), (None, None, 0))
        if own is not queries or depth < k:
            depth = max(k, self.keep)
            ranking = stored(self._retrieve(queries, mode, depth, None))
            self._kept[(id(queries), mode)] = queries, ranking, depth
        return ranking.where(F.col("rank") <= k)

    def _retrieve(self, queries: DataFrame, mode: str, k: int, conditions: Mapping[str, object] | None) -> DataFrame:
        if mode == "dense":
            return vector_topk(self.chunks, queries, k, conditions=conditions, vector_id="chunk_id", places=self.places, scope=self.scope)
        if mode == "keyword":
            return bm25(self.chunks, queries, k, conditions, self.filter_mode, doc_id="chunk_id", query_text="query", places=self.places, scope=self.scope)
        if mode == "hybrid":
            sides = [self.retrieve(queries, m, 2 * k, conditions) for m in ("dense", "keyword")]
            return reciprocal_rank_fusion(*sides, k=k)
        raise ValueError(f"unknown mode {mode}")

    def candidates(self, queries: DataFrame, found: DataFrame) -> DataFrame:
        """Retrieved rows with query and chunk text."""
        return with_texts(found, queries, self.chunks.select([c for c in self.chunks.columns if c not in ("embedding", "query")]))

    def retrieve_and_rerank(self, queries: DataFrame, mode: str = "hybrid", top_n: int = 50, k: int = 5, conditions: Mapping[str, object] | None = None) -> DataFrame:
        return lexical_rerank(self.candidates(queries, self.retrieve(queries, mode, top_n, conditions)).drop("dense_rank", "keyword_rank"), k)


# ---------------------------------------------------------------- TF-IDF vectors


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(chunk_id, term, tf) of every text."""
    return tokenized(docs, id_col, text_col).select("chunk_id", F.explode("terms").alias("term")).groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf_vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dimensions: int = 768, counted: DataFrame | None = None) -> DataFrame:
    """(term, df, bucket, idf): the bucket is the term's place in sorted order modulo the dimensions, the idf smoothed; ``counted``: of ``term_counts``, if they are known.

    The global place needs no global sort: terms are counted by their first three characters, of
    which there are 47,988 at most, and numbered inside such a group.
    """
    n = docs.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    terms = term_statistics(docs, id_col, text_col) if counted is None else counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = terms.withColumn("head", F.substring("term", 1, 3))
    before = Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    starts = terms.groupBy("head").agg(F.count(F.lit(1)).alias("held")).withColumn("start", F.coalesce(F.sum("held").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("head").orderBy("term")) - 1
    placed = terms.withColumn("place", place).join(F.broadcast(starts.select("head", "start")), "head")
    idf = F.log((1 + n) / (1 + F.col("df"))) + 1.0
    return placed.select("term", "df", F.pmod(F.col("start") + F.col("place"), F.lit(dimensions)).cast("int").alias("bucket"), idf.alias("idf"))


def tfidf_vectors(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text", dimensions: int = 768, counted: DataFrame | None = None) -> DataFrame:
    """(chunk_id, bucket, weight): unit-length sparse vectors; an unknown term hashes to a bucket with idf 1."""
    terms = term_counts(docs, id_col, text_col) if counted is None else counted
    found = terms.join(vocabulary.select("term", "bucket", "idf"), "term", "left")
    bucket = F.coalesce("bucket", F.pmod(F.xxhash64("term"), F.lit(dimensions)).cast("int"))
    sums = found.groupBy("chunk_id", bucket.alias("bucket")).agg(F.sum(F.col("tf") * F.coalesce("idf", F.lit(1.0))).alias("weight"))
    size = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("chunk_id")))
    return sums.withColumn("weight", F.when(size > 0, F.col("weight") / size).otherwise(F.col("weight")))


def dense_vectors(sparse: DataFrame, dimensions: int = 768) -> DataFrame:
    """(chunk_id, embedding array<float>) of sparse rows."""
    cells = F.map_from_entries(F.collect_list(F.struct("bucket", F.col("weight").cast("float"))))
    rows = sparse.groupBy("chunk_id").agg(cells.alias("cells"))
    fill = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.element_at("cells", i), F.lit(0.0).cast("float")))
    return rows.select("chunk_id", fill.alias("embedding"))


def adjacent_similarity(rows: DataFrame, group: str, order: str, embedding: str = "embedding") -> DataFrame:
    """Cosine of each row's vector with the next one's of its group."""
    following = F.lead(embedding).over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("next_similarity", F.when(following.isNotNull(), V.cosine(F.col(embedding), following)))


def neighbour_texts(rows: DataFrame, group: str, order: str, text: str, width: int) -> DataFrame:
    """Each text joined with its ``width - 1`` neighbours on either side."""
    around = Window.partitionBy(group).orderBy(order).rowsBetween(-(width - 1), width - 1)
    return rows.withColumn("combined", F.array_join(F.collect_list(text).over(around), " "))


def compare_models(vectors: DataFrame, queries: DataFrame, models: Sequence[str], k: int = 5, **columns) -> DataFrame:
    """Exact search once for each embedding column, tagged by the column."""
    out = None
    for model in models:
        found = vector_topk(vectors, queries, k, embedding=model, **columns).withColumn("model", F.lit(model))
        out = found if out is None else out.unionByName(found)
    return out
