"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over quantile bins, each chosen pair of features a table over
coarser bins. The tables are learnt by cyclic boosting of shallow trees: round by round, every
feature in turn gets a two-split tree fitted to the logistic gradient over its bins, added to its
table. Pairs are then ranked by how much a four-quadrant split explains of what is left, and the
best ones are boosted the same way with trees that split one feature and then the other. A score
is the intercept plus one addition for each table, over whole Arrow batches.

Fitting sees at most about ``max_rows`` labelled rows (a hash sample when there are more), of
whose ids the fold rule allows learning; scoring covers every row and whole texts. The features
are fourteen counts and ratios of the text's surface (see ``features``); the model never sees words.

Edge cases: null and empty texts are scored from zero counts; null labels are not used, equal rows
with equal labels teach once; without labels every score is 0.5, with labels of one class
only every score leans to it; repeated rows get equal scores; an empty table gives an empty result;
other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import features
from quern.llm.shared import LOCATOR, drop_rows, land, located, slices, small_enough

#: Expected upper bound of the rows a model is fitted on.
MAX_ROWS = 50_000


@dataclass
class Table:
    """Additions for the cells of one feature (``of`` has one entry) or of a pair."""

    of: tuple[int, ...]
    edges: tuple[np.ndarray, ...]
    values: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.values is None:
            self.values = np.zeros(tuple(len(e) + 1 for e in self.edges))

    def cells(self, x: np.ndarray) -> np.ndarray:
        at = [np.searchsorted(e, x[:, f], "right") for f, e in zip(self.of, self.edges, strict=True)]
        return at[0] if len(at) == 1 else at[0] * self.values.shape[1] + at[1]


@dataclass
class Model:
    intercept: float
    tables: list[Table]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for table in self.tables:
            total += table.values.ravel()[table.cells(x)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def quantile_edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Cut points between distinct values, at most ``bins - 1`` of them."""
    values = np.unique(x)
    if len(values) > bins:
        values = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        return values[values > x.min()]
    return (values[1:] + values[:-1]) / 2


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _stump(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Along the last axis: the best cut's gain, and after which bin it lies."""
    left_g, left_h = np.cumsum(g, -1)[..., :-1], np.cumsum(h, -1)[..., :-1]
    all_g, all_h = g.sum(-1, keepdims=True), h.sum(-1, keepdims=True)
    gain = _gain(left_g, left_h, ridge) + _gain(all_g - left_g, all_h - left_h, ridge)
    return gain.max(-1), gain.argmax(-1)


def _line_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Values of a two-split tree over the bins of one feature."""
    parts = [(0, len(g))]
    for _ in range(2):
        found = []
        for k, (a, b) in enumerate(parts):
            if b - a > 1:
                gain, cut = _stump(g[a:b], h[a:b], ridge)
                found.append((float(gain) - float(_gain(g[a:b].sum(), h[a:b].sum(), ridge)), k, a + int(cut) + 1))
        if not found or max(found)[0] <= 1e-9:
            break
        _, k, cut = max(found)
        a, b = parts[k]
        parts[k : k + 1] = [(a, cut), (cut, b)]
    out = np.empty(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _plane_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of a tree that cuts the first feature once and each side along the second."""
    low_g, low_h = np.cumsum(g, 0)[:-1], np.cumsum(h, 0)[:-1]
    high_g, high_h = g.sum(0) - low_g, h.sum(0) - low_h
    (gain_l, cut_l), (gain_h, cut_h) = _stump(low_g, low_h, ridge), _stump(high_g, high_h, ridge)
    row = int((gain_l + gain_h).argmax())
    out = np.empty_like(g)
    for rows, gs, hs, cut in ((slice(0, row + 1), low_g[row], low_h[row], int(cut_l[row]) + 1), (slice(row + 1, None), high_g[row], high_h[row], int(cut_h[row]) + 1)):
        out[rows, :cut] = gs[:cut].sum() / (hs[:cut].sum() + ridge)
        out[rows, cut:] = gs[cut:].sum() / (hs[cut:].sum() + ridge)
    return float(gain_l[row] + gain_h[row]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pairs: int = 10, bins: int = 64, pair_bins: int = 16, rate: float = 0.1, ridge: float = 1.0) -> Model:
    """Learn the tables; deterministic for given rows."""
    y = np.asarray(y, float)
    if len(y) == 0:
        return Model(0.0, [])
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Model(float(np.log(p / (1 - p))), [])
    if len(np.unique(y)) < 2:
        return model
    total = np.full(len(y), model.intercept)

    def boost(tables: list[Table], tree) -> None:
        cells = [t.cells(x) for t in tables]
        for _ in range(rounds):
            for table, cell in zip(tables, cells, strict=True):
                q = 1 / (1 + np.exp(-total))
                shape = table.values.shape
                g = np.bincount(cell, y - q, table.values.size).reshape(shape)
                h = np.bincount(cell, q * (1 - q), table.values.size).reshape(shape)
                step = rate * tree(g, h, ridge)
                table.values += step
                total[:] += step.ravel()[cell]
        model.tables += tables

    single = [Table((f,), (e,)) for f in range(x.shape[1]) if len(e := quantile_edges(x[:, f], bins))]
    boost(single, _line_tree)

    coarse = {t.of[0]: quantile_edges(x[:, t.of[0]], pair_bins) for t in single}
    q = 1 / (1 + np.exp(-total))
    ranked = []
    for a, b in combinations([f for f, e in coarse.items() if len(e)], 2):
        table = Table((a, b), (coarse[a], coarse[b]))
        cell = table.cells(x)
        g, h = (np.bincount(cell, v, table.values.size).reshape(table.values.shape) for v in (y - q, q * (1 - q)))
        ranked.append((_plane_tree(g, h, ridge)[0], (a, b)))
    chosen = [of for _, of in sorted(ranked, reverse=True)[:pairs]]
    boost([Table(of, (coarse[of[0]], coarse[of[1]])) for of in chosen], lambda g, h, r: _plane_tree(g, h, r)[1])
    return model


# ---------------------------------------------------------------- over DataFrames


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(id, counts of ``features.NAMES``) for each row of ``docs``, from whole texts. With ``row_col`` also row."""
    keys = ["id", "row"] if row_col else ["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = features.statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([*map(part.column, keys), *(pa.array(found[n].astype(np.int64)) for n in features.NAMES)], [*keys, *features.NAMES])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *([F.col(row_col).alias("row")] if row_col else []))
    return rows.mapInArrow(run, f"{_keys(row_col)}, " + ", ".join(f"{n} long" for n in features.NAMES))


def _keys(row_col: str | None) -> str:
    return f"id long, row {LOCATOR}" if row_col else "id long"


def learnable(column: str = "id"):
    """The fold rule: ids that may teach. Held out are those whose crc32 leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 != 1, F.lit(True))


def labelled_rows(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", max_rows: int = MAX_ROWS):
    """Features and labels of about ``max_rows`` labelled rows at most, in the order of their ids' hashes.

    The bound holds for rows, not only for ids: equal rows with equal labels count once, and what one id
    has many different texts for is sampled too.
    """
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    known = _sample(known.where(learnable()).distinct(), F.xxhash64("id"), max_rows)
    rows = stats.select("id", *features.NAMES).join(F.broadcast(known), "id").distinct()
    rows = _sample(rows, F.xxhash64("id", "label", *features.NAMES), max_rows)
    rows = rows.orderBy(F.xxhash64("id"), "label", *features.NAMES).toArrow()
    counts = {n: rows.column(n).to_numpy() for n in features.NAMES}
    return counts, rows.column("label").to_numpy()


def labelled(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """(id, counts, label) of all labelled rows that may teach, landed; equal rows with equal labels count once."""
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    known = land(known.where(learnable()).distinct(), "known")
    return land(stats.select("id", *features.NAMES).join(small_enough(known, 32), "id").distinct(), "labelled")


def _sample(rows: DataFrame, mark, most: int) -> DataFrame:
    """Landed rows, thinned by a hash to about ``most`` if they are more."""
    rows = land(rows, "known")
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(mark, F.lit(1 << 31)) < int(most / n * (1 << 31)))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, row_col: str | None = None, **options) -> DataFrame:
    """(id, score) for each row of ``docs``; ``score`` is the probability of label 1. With ``row_col`` also row."""
    keys = ["id", "row"] if row_col else ["id"]
    stats = land(text_statistics(docs, id_col, text_col, row_col), "statistics")
    counts, y = labelled_rows(stats, labels, label_col, max_rows=max_rows)
    model = fit(features.ratios(counts), y, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features.ratios({n: batch.column(n).to_numpy() for n in features.NAMES})
            yield pa.RecordBatch.from_arrays([*map(batch.column, keys), pa.array(model.score(x))], [*keys, "score"])

    return stats.mapInArrow(run, f"{_keys(row_col)}, score double")


def drop_poor(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5, **options) -> DataFrame:
    """``docs`` without those scored below ``at_least``; columns and texts unchanged. Each row goes by its own score."""
    docs, row = located(docs)
    scored = classify(docs, labels, id_col=id_col, text_col=text_col, row_col=row, **options)
    return drop_rows(docs, scored.where(F.col("score") < at_least).select("row"), row)
