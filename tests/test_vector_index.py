"""The inverted-file index against exact search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import search, vector_index
from quern.operators.vector_index import VectorIndex, lloyd

ROWS = "vec_id long, embedding array<float>, metadata map<string,string>"


def vectors(n=600, wide=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, wide)) * 3
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, wide))
    x[5] = 0
    x[7] = x[6]
    return [(i, [float(v) for v in row], {"kind": "even" if i % 2 == 0 else "odd"}) for i, row in enumerate(x)]


def asked(spark, rows):
    return spark.createDataFrame([(i, v) for i, v, _ in rows if i % 20 == 0] + [(9999, None)], "query_id long, embedding array<float>")


def key(rows):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 5)) for r in rows)


def test_lloyd_finds_the_clusters():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(50, 3)) + c for c in (0, 20, 40)])
    centres = lloyd(x, 3, 10, 4)
    assert sorted(np.round(centres.mean(1) / 20).astype(int)) == [0, 1, 2]
    assert len(lloyd(np.ones((5, 2)), 3, 2, 1)) == 1


def test_recall_exact_mode_and_pruning(spark, tmp_path):
    rows = vectors()
    frame, queries = spark.createDataFrame(rows, ROWS), asked(spark, rows)
    index = VectorIndex(spark, f"file://{tmp_path}/index", lists=12, pieces=4)
    assert index.search(queries).count() == 0
    with pytest.raises(ValueError, match="build"):
        index.append(frame)
    index.build(frame, metadata="metadata")
    assert index.live().count() == len(rows)
    exact = search.vector_topk(frame, queries, 10, places=5).collect()
    assert key(index.search(queries, 10, exact=True, places=5).collect()) == key(exact)
    # all lists and enough rescored rows: the same again, by the codes
    assert key(index.search(queries, 10, probes=12, rescore=1000, places=5).collect()) == key(exact)
    few = index.search(queries.where("query_id = 40"), 10, probes=2, places=5)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    probes, share = index.calibrate(queries, 10, 0.95)
    assert share >= 0.95 and probes < 12
    measured = index.recall(queries, 10, probes).first()
    assert (measured.queries, measured.recall) == (30, share)
    odd = index.search(queries, 5, exact=True, conditions={"kind": "odd"}).collect()
    assert odd and all(r.chunk_id % 2 for r in odd)
    assert all(r.chunk_id % 2 for r in index.search(queries, 5, probes=4, conditions={"kind": "odd"}).collect())


def test_arrivals_replace_and_deletions_hide(spark, tmp_path):
    rows = vectors(200)
    index = VectorIndex(spark, f"file://{tmp_path}/index", lists=6, pieces=5)
    index.build(spark.createDataFrame(rows[:150], ROWS))
    moved = [(i, rows[(i + 50) % 200][1], None) for i in range(100, 200)]
    index.append(spark.createDataFrame(moved, ROWS).withColumn("embedding", F.when(F.col("vec_id") != 150, F.col("embedding"))))
    index.delete(spark.createDataFrame([(3,), (4,), (3,), (777,)], "vec_id long"))
    now = {i: v for i, v, _ in rows[:150]} | {i: v for i, v, _ in moved if i != 150}
    now.pop(3), now.pop(4)
    queries = asked(spark, rows)
    want = search.vector_topk(spark.createDataFrame(list(now.items()), "vec_id long, embedding array<float>"), queries, 10, places=5).collect()
    assert index.live().count() == len(now)
    assert key(index.search(queries, 10, exact=True, places=5).collect()) == key(want)
    assert key(index.search(queries, 10, probes=6, rescore=1000, places=5).collect()) == key(want)
    with pytest.raises(ValueError, match="distinct"):
        index.append(spark.createDataFrame([rows[0], rows[0]], ROWS))
    with pytest.raises(Exception, match="dimensions"):
        index.append(spark.createDataFrame([(1, [1.0], None)], ROWS))


def test_blocks_of_queries_beyond_the_shipped_ones(spark, tmp_path, monkeypatch):
    rows = vectors(120)
    index = VectorIndex(spark, f"file://{tmp_path}/index", lists=4, pieces=4)
    index.build(spark.createDataFrame(rows, ROWS))
    queries = asked(spark, rows)
    one = key(index.search(queries, 5, probes=2, places=5).collect())
    monkeypatch.setattr(search, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(search, "GROUP_ROWS", 30)
    assert key(index.search(queries, 5, probes=2, places=5).collect()) == one


def test_calibration_rescores_more_where_codes_lose_neighbours(spark, tmp_path):
    """Vectors without clusters and codes of one byte: no number of probes is enough for the rows that are rescored at first."""
    x = np.random.default_rng(5).normal(size=(900, 16))
    frame = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    queries = frame.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    index = VectorIndex(spark, f"file://{tmp_path}/index", lists=8, pieces=1, rescore=2)
    index.build(frame)
    assert index.recall(queries, 10, 8).first().recall < 0.9
    probes, share = index.calibrate(queries, 10, 0.9)
    assert share >= 0.9 and probes <= 8 and index.rescore > 2
    assert index.recall(queries, 10, probes).first().recall == share


def test_codes_that_leave_nothing_out_make_no_pairs(spark, tmp_path, monkeypatch):
    """All lists and as many rescored as there are: the vectors are scored where they are read, not by pairs of all queries and rows."""
    rows = vectors(200)
    frame, queries = spark.createDataFrame(rows, ROWS), asked(spark, rows)
    index = VectorIndex(spark, f"file://{tmp_path}/index", lists=6, pieces=5)
    index.build(frame)
    index.delete(frame.where("vec_id % 9 = 4").select("vec_id"))
    monkeypatch.setattr("quern.operators.vector_index._code_scorer", None)
    want = search.vector_topk(frame.where("vec_id % 9 <> 4"), queries, 3, places=5).collect()
    assert key(index.search(queries, 3, probes=1 << 20, rescore=1 << 20, places=5).collect()) == key(want)


def test_calibration_searches_once_and_finds_the_fewest_probes(spark, tmp_path, monkeypatch):
    """One search for the exact neighbours and one for the answer's recall: a search for each number that is tried took too long at 1 GB."""
    x = np.random.default_rng(9).normal(size=(900, 16))
    x[300:400] = x[:100] + 0.01  # near copies, many in the step of another
    frame = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    queries = frame.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    index = VectorIndex(spark, f"file://{tmp_path}/index", lists=10, pieces=4, rescore=1)
    index.build(frame.where("vec_id % 2 = 0"))
    index.append(frame.where("vec_id % 2 = 1"))
    searched, search_of = [], VectorIndex.search
    monkeypatch.setattr(VectorIndex, "search", lambda self, *a, **options: searched.append(options.get("exact", False)) or search_of(self, *a, **options))
    probes, share = index.calibrate(queries, 10, 0.9)
    assert searched == [True, False]
    recall = lambda p, rescore=None: index.recall(queries, 10, p, rescore=rescore).first().recall
    assert 1 < probes < 10 and share == pytest.approx(recall(probes)) and share >= 0.9 > recall(probes - 1)
    # rescore: the first doubling of 1 with which the codes, over all lists, lose at most half of what may be lost
    assert index.rescore > 1 and recall(10) >= 0.95 > recall(10, index.rescore // 2)


@pytest.mark.parametrize("shipped", [True, False])
def test_search_ranks_the_best_by_codes_whatever_the_tasks(spark, tmp_path, monkeypatch, shipped):
    rows = vectors(500)
    queries = asked(spark, rows)
    index = VectorIndex(spark, f"file://{tmp_path}/index", lists=9, pieces=2)
    index.build(spark.createDataFrame(rows, ROWS))
    if not shipped:
        monkeypatch.setattr(search, "BLOCK_QUERIES", 7)
    centres, books = vector_index._learned(index._model(1))
    held = index.live().orderBy("id").collect()
    x, lists = search._unit(np.array([r.embedding for r in held])), np.array([r.list for r in held])
    codes = np.array([list(r.codes) for r in held])
    meant = centres[lists] + np.concatenate([b[codes[:, j]] for j, b in enumerate(books)], axis=1)
    want = []
    for q in range(0, 500, 20):
        looked = np.isin(lists, np.argsort(-(centres @ x[q]), kind="stable")[:4])
        step = np.where(looked, np.floor((meant @ x[q] + 2) * vector_index.STEPS), -1)
        chosen = np.flatnonzero(looked & (step >= np.sort(step)[::-1][4 * 3 - 1]))
        best = chosen[np.lexsort((chosen, -np.round(x[chosen] @ x[q], 5)))][:4]
        want += [(q, i + 1, int(c), round(float(x[c] @ x[q]), 5)) for i, c in enumerate(best)]
    assert key(index.search(queries, 4, probes=4, rescore=3, places=5).collect()) == want


def test_blocks_of_queries_keep_all_cores_busy(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_QUERIES", 3)
    queries = spark.range(5).withColumnRenamed("id", "query_id")
    rows = spark.range(1000).withColumnRenamed("id", "chunk_id")
    kernel = lambda block: lambda batches: iter([pa.RecordBatch.from_pylist([{"queries": block.num_rows, "rows": sum(b.num_rows for b in batches)}])])
    met = search._met(rows, queries, kernel, "queries long, rows long").collect()
    assert len(met) >= spark.sparkContext.defaultParallelism
    assert sum(r.queries * r.rows for r in met) == 5 * 1000


@pytest.mark.parametrize("shipped", [True, False])
def test_which_of_equal_vectors_are_neighbours_follows_from_their_ids(spark, tmp_path, monkeypatch, shipped):
    """Copies under other ids, more than are asked for: the search and what it is measured against name the same ones."""
    x = np.random.default_rng(2).normal(size=(37, 64))
    frame = spark.createDataFrame([(i, [float(v) for v in x[i % 37]]) for i in range(37 * 23)], "vec_id long, embedding array<float>").repartition(5)
    queries = frame.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    index = VectorIndex(spark, f"file://{tmp_path}/index", lists=6, pieces=8, rescore=12)
    index.build(frame)
    if not shipped:
        monkeypatch.setattr(search, "BLOCK_QUERIES", 15)
    known = index.neighbours(queries, 10)
    assert sorted((r.query_id, r.chunk_id) for r in known.collect()) == sorted((q, q % 37 + 37 * c) for q in range(0, 37 * 23, 20) for c in range(10))
    assert index.recall(queries, 10, 3, known).first().recall == 1.0
    assert index.calibrate(queries, 10, 0.95) == (1, 1.0)
