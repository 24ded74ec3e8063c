"""Quality rules and the classifier: counts against plain Python, models by held-out accuracy."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import features, gam, isolation
from tests.conftest import SF
from tests.llm.helpers import corpus, documents, words


def counts_truth(text):
    w, t = words(text), text or ""
    seen, dup = set(), 0
    for x in t.split("\n"):
        if words(x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_counts():
    texts = [t for _, t in corpus()] + ["a b c a b c", "a b c d a b c", "x\nx\n x\n\n\nx", "a a a a", "# $|<", "ü" * 70000]
    found = features.statistics(pa.array(texts))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert list(zip(*(found[n].tolist() for n in names), strict=True)) == [counts_truth(t) for t in texts]
    assert all(len(v) == 0 for v in features.statistics(pa.array([], pa.string())).values())
    sliced = features.statistics(pa.array(["skip me", *texts]).slice(1))
    assert all((sliced[n] == found[n]).all() for n in features.NAMES)


def test_rules_query_columns_and_base(spark):
    rows = corpus()
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r.id: r for r in isolation.judge(documents(spark, rows), labels, trees=20).collect()}
    for i, t in rows:
        n, chars, symbols, dup, repeat = counts_truth(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert r.kept == (not r.base_failed and r.anomaly <= r.threshold)


def test_rules_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = isolation.judge(documents(spark, corpus(20)), labels).collect()
    assert all(r.kept != r.base_failed for r in got)
    assert isolation.judge(documents(spark, []), labels).count() == 0


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (500, 4)), rng.normal(9, 1, (10, 4))])
    score = isolation.grow(x, 64).anomaly(x)
    assert score[500:].min() > np.quantile(score[:500], 0.95)
    assert isolation.grow(x[:1], 4).anomaly(x[:1]).shape == (1,)
    good = np.arange(510) < 500
    cut = isolation.calibrate(score, good, 5)
    balance = lambda c: (score[~good] > c).mean() - 5 * (score[good] > c).mean()
    assert balance(cut) == max(map(balance, score)) and (score[good] > cut).mean() < 0.01
    assert isolation.calibrate(score, np.ones(510, bool), 5) == float("inf")


def test_path_lengths_by_hand():
    """Scores of a forest against walking each row down each tree, and leaf lengths against the rows that end there."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 1, (90, 3)), 1)
    forest = isolation.grow(x, 25, sample=len(x), seed=2)
    average = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def leaf(t, row):
        node = level = 0
        while forest.feature[t][node] >= 0:
            node, level = 2 * node + 1 + int(row[forest.feature[t][node]] >= forest.cut[t][node]), level + 1
        return node, level

    for t in range(25):
        ends = Counter(leaf(t, row) for row in x)
        assert all(forest.length[t][node] == pytest.approx(level + average(n)) for (node, level), n in ends.items())
    for row, score in zip(x, forest.anomaly(x), strict=True):
        mean = np.mean([level + average(sum(leaf(t, r)[0] == node for r in x)) for t in range(25) for node, level in [leaf(t, row)]])
        assert score == pytest.approx(2 ** (-mean / average(len(x))))


def test_rules_on_documents_that_taught_nothing(spark):
    """The forest and its threshold come from two folds; the third is judged."""
    docs, labels = (spark.read.parquet(f"{SF.parent}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = isolation.judge(docs, labels).join(labels.withColumnRenamed("doc_id", "id"), "id").where("not base_failed").where(~gam.learnable()).toPandas()
    good = rows["quality"] == 1
    assert good.sum() > 500 and (~good).sum() > 50
    assert rows["kept"][good].mean() > 0.98 and (~rows["kept"][~good]).mean() > 0.95


def test_label_sample_counts_rows_not_ids(spark):
    """One id with many texts, and one text many times."""
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.repeat(F.lit("word "), F.col("id").cast("int") + 1).alias("text"))
    docs = docs.unionByName(spark.range(3000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("the same").alias("text")))
    counts, y = gam.labelled_rows(gam.text_statistics(docs), labels, max_rows=400)
    assert 250 < len(y) < 550 and (y == 0).sum() <= 1


def naive_tree(g, h, ridge):
    """Two greedy cuts along a line, by trying each."""
    gain = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + ridge)
    parts = [(0, len(g))]
    for _ in range(2):
        cuts = [(gain(a, c) + gain(c, b) - gain(a, b), k, c) for k, (a, b) in enumerate(parts) for c in range(a + 1, b)]
        if not cuts or max(x for x, _, _ in cuts) <= 1e-9:
            break
        top = max(x for x, _, _ in cuts)
        k = max(k for x, k, _ in cuts if x == top)
        c = min(c for x, j, c in cuts if j == k and x == top)
        a, b = parts[k]
        parts[k : k + 1] = [(a, c), (c, b)]
    return [sum(g[a:b]) / (sum(h[a:b]) + ridge) for a, b in parts for _ in range(a, b)]


def naive_plane(g, h, ridge):
    """A cut of the rows and one of the columns on either side, by trying each; gain and values."""
    n, m, best = len(g), len(g[0]), None
    total = lambda t, rows, a, b: sum(t[r][c] for r in rows for c in range(a, b))

    def side(rows):
        found = []
        for c in range(1, m):
            gs, hs = (total(g, rows, 0, c), total(g, rows, c, m)), (total(h, rows, 0, c), total(h, rows, c, m))
            found.append((sum(x * x / (y + ridge) for x, y in zip(gs, hs, strict=True)), -c, [x / (y + ridge) for x, y in zip(gs, hs, strict=True)]))
        return max(found)

    for r in range(1, n):
        low, high = side(range(r)), side(range(r, n))
        if best is None or low[0] + high[0] > best[0]:
            values = [[(low if i < r else high)[2][int(c >= -(low if i < r else high)[1])] for c in range(m)] for i in range(n)]
            best = low[0] + high[0], values
    return best


def test_gam_against_a_plain_one():
    """The same cyclic boosting with lists, row by row and cut by cut."""
    rng = np.random.default_rng(5)
    x = np.round(rng.uniform(0, 1, (70, 3)), 2)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.4)).astype(int)
    rounds, rate, ridge = 4, 0.3, 1.0
    model = gam.fit(x, y, rounds=rounds, pairs=2, bins=8, pair_bins=4, rate=rate, ridge=ridge)
    base = float(np.log(y.mean() / (1 - y.mean())))
    total, edges = [base] * len(y), {n: [gam.quantile_edges(x[:, f], n) for f in range(3)] for n in (8, 4)}
    place = lambda e, v: sum(v >= c for c in e)
    tables = []

    def sums(cells, size):
        g, h = [0.0] * size, [0.0] * size
        for i, c in enumerate(cells):
            q = 1 / (1 + np.exp(-total[i]))
            g[c] += y[i] - q
            h[c] += q * (1 - q)
        return g, h

    def boost(kinds):
        held = {k: ([0.0] * size, cells) for k, (cells, size, _) in kinds.items()}
        for _ in range(rounds):
            for k, (cells, size, tree) in kinds.items():
                step = tree(*sums(cells, size))
                for c in range(size):
                    held[k][0][c] += rate * step[c]
                for i, c in enumerate(cells):
                    total[i] += rate * step[c]
        tables.extend(held.items())

    boost({(f,): ([place(edges[8][f], v) for v in x[:, f]], len(edges[8][f]) + 1, lambda g, h: naive_tree(g, h, ridge)) for f in range(3)})
    ranked, kinds = [], {}
    for a, b in ((0, 1), (0, 2), (1, 2)):
        n, m = len(edges[4][a]) + 1, len(edges[4][b]) + 1
        cells = [place(edges[4][a], r[a]) * m + place(edges[4][b], r[b]) for r in x]
        fold = lambda t, m=m: [t[k : k + m] for k in range(0, len(t), m)]
        kinds[a, b] = cells, n * m, lambda g, h, fold=fold: [v for row in naive_plane(fold(g), fold(h), ridge)[1] for v in row]
        ranked.append((naive_plane(*map(fold, sums(cells, n * m)), ridge)[0], (a, b)))
    boost({k: kinds[k] for _, k in sorted(ranked, reverse=True)[:2]})
    assert [t.of for t in model.tables] == [k for k, _ in tables]
    for table, (_, (values, _)) in zip(model.tables, tables, strict=True):
        assert table.values.ravel() == pytest.approx(values)
    assert model.score(x) == pytest.approx([1 / (1 + np.exp(-t)) for t in total])


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)) | (x[:, 2] > 0.8)
    model = gam.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.93
    assert (0, 1) in [t.of for t in model.tables]
    # a score is the intercept and one addition for each table
    one = model.intercept + sum(float(t.values.ravel()[t.cells(x[:1])][0]) for t in model.tables)
    assert model.score(x[:1])[0] == pytest.approx(1 / (1 + np.exp(-one)))


def test_gam_of_one_class_or_none():
    x = np.ones((5, 3))
    assert gam.fit(x[:0], np.zeros(0)).score(x).tolist() == [0.5] * 5
    assert (gam.fit(x, np.ones(5)).score(x) > 0.9).all()


def test_fold_rule_and_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF.parent}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = gam.classify(docs, labels).withColumn("held", ~gam.learnable()).join(labels.withColumnRenamed("doc_id", "id"), "id").toPandas()
    assert rows["held"].tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows["id"]]
    held = rows[rows["held"]]
    assert ((held["score"] >= 0.5) == (held["quality"] == 1)).mean() > 0.95
    # labels of held-out rows teach nothing
    flipped = labels.withColumn("quality", F.when(gam.learnable("doc_id"), F.col("quality")).otherwise(1 - F.col("quality")))
    again = gam.classify(docs, flipped).toPandas().set_index("id")["score"]
    assert (again.loc[rows["id"]].to_numpy() == rows["score"].to_numpy()).all()


def test_classifier_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, None), (4, 1), (6, 0)], "doc_id long, quality int")
    docs = documents(spark, [(1, "good words here"), (1, "good words here"), (2, "$$ ## !!"), (3, None), (4, ""), (None, "x"), (6, "|| $$")])
    rows = gam.classify(docs, labels).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    assert gam.classify(documents(spark, []), labels).count() == 0
    assert gam.drop_poor(docs, labels).columns == docs.columns


def test_label_sample_is_bounded(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    stats = gam.text_statistics(labels.withColumn("text", F.lit("a b c")))
    counts, y = gam.labelled_rows(stats, labels, max_rows=500)
    assert 350 < len(y) < 650 and len(counts["n_words"]) == len(y)


def test_poor_rows_go_by_their_own_score(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    scored = gam.classify(docs, labels).join(docs.withColumnRenamed("doc_id", "id"), "id").collect()
    poor, good = (max((r for r in scored if (r.score < 0.5) == p), key=lambda r: abs(r.score - 0.5)).text for p in (True, False))
    extra = docs.limit(1).select(F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("doc_id"), F.lit(t).alias("text")) for i, t in ((None, poor), (None, good), (10**9, poor), (10**9, good))))).alias("x")).select("x.*")
    kept = gam.drop_poor(docs.select("doc_id", "text").unionByName(extra), labels).where("doc_id IS NULL OR doc_id = 1000000000").collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(None, good), (10**9, good)], key=str)


def test_threshold_counts_all_labelled_rows(spark):
    """The cluster's sums against ``calibrate`` over every labelled row, with a forest that was drawn from few of them."""
    rows = [(i, " ".join(f"{'#' * (i % 7) if i % 4 == 0 else ''}word{i % 13}n{j}{'x' * (j % (2 + i % 9))}" for j in range(60 + i % 5))) for i in range(400)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)], "doc_id long, quality int")
    got = isolation.judge(docs, labels, trees=5, sample=8)
    taught = got.join(labels.withColumnRenamed("doc_id", "id"), "id").where(gam.learnable()).where("not base_failed").toPandas()
    want = isolation.calibrate(taught["anomaly"].to_numpy(), taught["quality"].to_numpy() == 1, 5.0)
    assert len(taught) > 100 and got.first().threshold == want
