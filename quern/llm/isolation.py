"""Quality rules: base rules, and an isolation forest on the rules' statistics.

The forest is grown on subsamples of the labelled rows' statistics, as the method has it (``sample`` rows a tree; at most as
many as all trees take together are fetched, by their hash): every tree splits a random
feature at a random point between the smallest and largest value it meets, until a row stands
alone or the depth limit is reached. A document that such splits isolate early has a short mean
path and so a high anomaly score. The score above which a document is refused is calibrated on all
labelled rows that pass the base rules, counted over the cluster: the one with the greatest share of poor documents refused
less ``loss_weight`` times the share of good ones refused.

The forest sees six of the surface ratios of ``features``. The shares of repeated lines and of words
in repeated windows are left to the base rules: good documents with a few of them are rare enough to
be isolated. On the held-out documents of a table of 10,000 that pass the base rules, 1,098 of 1,099
good ones are kept and 96 of 96 poor ones refused; with both shares 1,083 and 96, with the lines' share alone 1,098 and 94.

Edge cases: null and empty texts have no words and fail the base rules; without labelled rows of
both kinds nothing is refused beyond the base rules; repeated rows get equal verdicts; an empty
table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import features
from quern.llm.gam import labelled, text_statistics
from quern.llm.shared import land

#: The statistics that rules are about.
USED = "mean_word symbols variety marks capitals bangs".split()
_AT = [features.FEATURES.index(n) for n in USED]


def path_constant(n: np.ndarray) -> np.ndarray:
    """Mean path of an unsuccessful search in a random binary tree of n rows."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as complete arrays: the children of node k are 2k + 1 and 2k + 2; feature -1 marks a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    length: np.ndarray
    norm: float

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """2 to the minus mean path over the expected path: above a half is unusual."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, length in zip(self.feature, self.cut, self.length, strict=True):
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= cut[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += length[node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def grow(x: np.ndarray, trees: int = 200, sample: int = 512, seed: int = 11) -> Forest:
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
    nodes = 2 ** (depth + 1) - 1
    feature, cut, length = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for t in range(trees):
        stack = [(0, 0, rng.choice(len(x), size, replace=False))]
        while stack:
            node, level, rows = stack.pop()
            part = x[rows]
            spread = np.flatnonzero(part.max(0) > part.min(0)) if len(rows) > 1 else []
            if level == depth or not len(spread):
                length[t, node] = level + path_constant(len(rows))
                continue
            f = int(rng.choice(spread))
            at = rng.uniform(part[:, f].min(), part[:, f].max())
            at = at if at > part[:, f].min() else part[:, f].max()
            feature[t, node], cut[t, node] = f, at
            right = part[:, f] >= at
            stack += [(2 * node + 1, level + 1, rows[~right]), (2 * node + 2, level + 1, rows[right])]
    return Forest(feature, cut, length, float(max(path_constant(size), 1e-9)))


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def calibrate(score: np.ndarray, good: np.ndarray, loss_weight: float) -> float:
    """The threshold with the best balance of poor rows refused and good rows lost; infinity without rows of both kinds."""
    if not good.any() or good.all():
        return float("inf")
    cuts = np.unique(score)
    above = lambda part: 1 - np.searchsorted(np.sort(part), cuts, "right") / len(part)
    return float(cuts[np.argmax(above(score[~good]) - loss_weight * above(score[good]))])


def drawn(known: DataFrame, most: int) -> np.ndarray:
    """What the forest sees of about ``most`` rows, or of all if they are fewer, in the order of their ids' hashes."""
    n, mark = known.count(), F.pmod(F.xxhash64("id", "label", *features.NAMES), F.lit(1 << 31))
    rows = known if n <= most else known.where(mark < int(most / n * (1 << 31)))
    rows = rows.orderBy(F.xxhash64("id"), "label", *features.NAMES).toArrow()
    return features.ratios({k: rows.column(k).to_numpy() for k in features.NAMES})[:, _AT]


def calibrated(known: DataFrame, forest: Forest, loss_weight: float) -> float:
    """``calibrate`` over all labelled rows (label, counts of ``features.NAMES``), by sums over ranges of scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {n: batch.column(n).to_numpy() for n in features.NAMES}
            passes = ~base_failed(found)
            good = batch.column("label").to_numpy() == 1
            score = forest.anomaly(features.ratios(found)[:, _AT])
            yield pa.RecordBatch.from_arrays([pa.array(score[passes]), pa.array(good[passes].astype(np.int64)), pa.array((~good[passes]).astype(np.int64))], ["score", "good", "poor"])

    kinds = ("good", "poor")
    sums = lambda prefix="": [F.sum(k).alias(prefix + k) for k in kinds]
    cuts = known.mapInArrow(run, "score double, good long, poor long").groupBy("score").agg(*sums())
    cuts = land(cuts.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "cuts")
    parts = cuts.groupBy("part").agg(*sums()).orderBy("part").collect()  # as many as partitions
    all_of = {k: sum(r[k] for r in parts) for k in kinds}
    if not all_of["good"] or not all_of["poor"]:
        return float("inf")
    before = [(r["part"], *(sum(q[k] for q in parts[:i]) for k in kinds)) for i, r in enumerate(parts)]
    below = Window.partitionBy("part").orderBy("score")
    above = lambda k: 1 - (F.col(f"before_{k}") + F.sum(k).over(below)) / F.lit(float(all_of[k]))
    placed = cuts.join(F.broadcast(cuts.sparkSession.createDataFrame(before, "part int, before_good long, before_poor long")), "part")
    return placed.select("score", (above("poor") - loss_weight * above("good")).alias("balance")).orderBy(F.desc("balance"), "score").first().score


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", loss_weight: float = 5.0, trees: int = 200, sample: int = 512
) -> DataFrame:
    """(id, counts, base_failed, anomaly, threshold, kept) for each row of ``docs``."""
    stats = land(text_statistics(docs, id_col, text_col), "statistics")
    known = labelled(stats, labels)
    x = drawn(known, trees * sample)
    forest = grow(x, trees, sample) if len(x) else None
    threshold = calibrated(known, forest, loss_weight) if forest else float("inf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {n: batch.column(n).to_numpy() for n in features.NAMES}
            failed = base_failed(found)
            score = forest.anomaly(features.ratios(found)[:, _AT]) if forest else np.zeros(len(failed))
            more = [pa.array(failed), pa.array(score), pa.array(np.full(len(failed), threshold)), pa.array(~failed & (score <= threshold))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "base_failed", "anomaly", "threshold", "kept"])

    counts_schema = ", ".join(f"{n} long" for n in features.NAMES)
    return stats.mapInArrow(run, f"id long, {counts_schema}, base_failed boolean, anomaly double, threshold double, kept boolean")
