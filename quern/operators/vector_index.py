"""An inverted-file vector index: lists around k-means centroids, product-quantised codes, exact rescoring.

``fit`` learns from a bounded sample of rows (``SAMPLE``, chosen by the hash of their ids): centroids of the lists, by k-means on unit vectors, and a code book of up
to 256 entries for each of ``pieces`` parts of what a vector differs from its centroid. Every row is then assigned to the list of its nearest
centroid and stored there, list by list as partitions, with its codes and the vector itself. Arrivals are parts of one manifest
under the same centroids; replaced and deleted vectors are addresses in a table of the dead.

A search looks into the ``probes`` nearest lists of each query, which prunes the others' partitions. It counts the scores of rows by their codes, in steps of 1/256, takes the highest
step down to which a query has ``rescore`` x k rows, and ranks all rows from that step on by the exact cosine, where they are read: at least the ``rescore`` x k best by
the codes, the same ones however rows lie in tasks. With ``exact=True`` it scores all vectors of all lists, as ``search.vector_topk``.
``recall`` measures the share of exact neighbours that a search finds, ``calibrate`` looks for the ``rescore`` and the fewest probes with which it is high enough:
the codes lose the more neighbours the more rows there are, and probes do not bring those back. It searches once, at the end: what a search with
other numbers would find follows from how many rows are in higher steps than each exact neighbour.

Edge cases: rows without a vector are not indexed; zero vectors have cosine 0 and lie in some list; ids must be longs, distinct within an arrival
and not null; all vectors have the dimensions of the index; an empty index answers with no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.search import _CELLS, _Best, _best_of, _Kernel, _matrix, _met, _rounded, _unit, vector_topk, where_metadata
from quern.operators.snapshots import Snapshots
from quern.operators.staging import few, stored

#: Rows that centroids and code books are learned from, at most about so many.
SAMPLE = 50_000
#: Scores by codes are counted in so many steps for 1, from -2 to 2.
STEPS = 256
#: Numbers of probes that calibration tries in one look.
CUTS = 32
#: Decimals in which recall compares scores: those of equal vectors differ in the last bits, by where they lie in a matrix, and which of them are nearest is to follow from their ids.
PLACES = 10
TABLES = {
    "model": "lists int, dimensions int, pieces int, centroids binary, books binary, facts string",
    "vectors": "id long, part_no int, codes binary, embedding array<float>, metadata map<string,string>, list int",
    "dead": "id long, part_no int",
}


def lloyd(x: np.ndarray, k: int, rounds: int, seed: int, unit: bool = False) -> np.ndarray:
    """k-means centres of the rows of ``x``; an empty cluster starts again at the row farthest from its centre."""
    rng = np.random.default_rng(seed)
    kinds = np.unique(x, axis=0)
    centres = kinds[rng.permutation(len(kinds))[:k]].astype(np.float64)
    for _ in range(rounds):
        near, off = _nearest(x, centres)
        size = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.divide(sums, size[:, None], out=centres, where=size[:, None] > 0)
        for j, far in zip(np.flatnonzero(size == 0), np.argsort(-off), strict=False):
            centres[j] = x[far]
        if unit:
            centres = _unit(centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and the squared distance to it."""
    near, off, own = np.empty(len(x), np.int64), np.empty(len(x)), (centres * centres).sum(1)
    for a in range(0, len(x), step):
        part = x[a : a + step]
        d = own[None, :] - 2 * part @ centres.T
        near[a : a + step] = d.argmin(1)
        off[a : a + step] = d.min(1) + (part * part).sum(1)
    return near, off


class VectorIndex:
    """An index in one folder. ``lists``: by default the square root of the rows; ``pieces``: bytes of a vector's code; ``rescore``: what searches use that state none."""

    def __init__(self, spark: SparkSession, root: str, lists: int | None = None, pieces: int = 8, rounds: int = 12, seed: int = 7, rescore: int = 20):
        self.spark, self.tables, self.lists, self.pieces, self.rounds, self.seed = spark, Snapshots(spark, root, TABLES), lists, pieces, rounds, seed
        self.rescore = rescore

    # ------------------------------------------------------------ building

    def build(self, rows: DataFrame, id_col: str = "vec_id", embedding: str = "embedding", metadata: str | None = None) -> int:
        """Learn from a sample of the rows and index all of them, as the next version, instead of what was there."""
        base = self.tables.version()
        given = self._given(rows, id_col, embedding, metadata)
        n = given.count()
        if not n:
            raise ValueError("no vectors to learn from")
        model = self._fit(given, n)
        part = self._assigned(given, model, base + 1)
        return self.tables.commit(base, {"model": [self._keep(model)], "vectors": [part], "dead": []})

    def append(self, rows: DataFrame, id_col: str = "vec_id", embedding: str = "embedding", metadata: str | None = None) -> int:
        """Index an arrival under the lists that there are; vectors whose id is indexed are replaced."""
        base = self.tables.version()
        given = self._given(rows, id_col, embedding, metadata)
        parts = self.tables.parts(base)
        dead = self._killed(given.select("id"), base, parts)
        return self.tables.commit(base, {"vectors": [*parts["vectors"], self._assigned(given, self._model(base), base + 1)], "dead": dead})

    def delete(self, ids: DataFrame, id_col: str = "vec_id") -> int:
        base = self.tables.version()
        return self.tables.commit(base, {"dead": self._killed(ids.select(F.col(id_col).cast("long").alias("id")).distinct(), base, self.tables.parts(base))})

    def _given(self, rows: DataFrame, id_col: str, embedding: str, metadata: str | None) -> DataFrame:
        facts = F.col(metadata) if metadata else F.lit(None)
        given = stored(rows.where(F.col(embedding).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(embedding).cast("array<float>").alias("embedding"), facts.cast("map<string,string>").alias("metadata")))
        if not given.groupBy("id").count().where("count > 1 OR id IS NULL").isEmpty():
            raise ValueError("ids of an arrival are distinct and not null")
        return given

    def _killed(self, ids: DataFrame, version: int, parts: dict) -> list[dict]:
        gone = stored(self.live(version).select("id", "part_no").join(ids, "id", "left_semi"))
        return parts["dead"] if gone.isEmpty() else [*parts["dead"], self.tables.put("dead", gone)]

    def _fit(self, given: DataFrame, n: int) -> dict:
        """Centroids and code books, learned by a task from the bounded sample."""
        sample = given.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // SAMPLE))) == 0) if n > SAMPLE else given
        lists, pieces, rounds, seed = self.lists or max(1, int(n**0.5)), self.pieces, self.rounds, self.seed

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(list(batches), pa.schema([("id", pa.int64()), ("embedding", pa.list_(pa.float32()))])).sort_by("id")
            lengths = table.column("embedding").combine_chunks()
            wide = len(lengths[0])
            x = _unit(_matrix(lengths, wide).astype(np.float64))
            centres = lloyd(x, lists, rounds, seed, unit=True)
            left = x - centres[_nearest(x, centres)[0]]
            books = [lloyd(part, min(256, len(part)), rounds, seed) for part in np.array_split(left, min(pieces, wide), axis=1)]
            size = [list(b.shape) for b in books]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(centres)], pa.int32()), pa.array([wide], pa.int32()), pa.array([len(books)], pa.int32()), pa.array([centres.tobytes()], pa.binary()), pa.array([b"".join(b.tobytes() for b in books)], pa.binary()), pa.array([json.dumps({"books": size, "sample": len(x)})])],
                ["lists", "dimensions", "pieces", "centroids", "books", "facts"],
            )

        return sample.select("id", "embedding").coalesce(1).mapInArrow(learn, TABLES["model"]).first().asDict()

    def _keep(self, model: dict) -> dict:
        return self.tables.put("model", self.spark.createDataFrame([tuple(model.values())], TABLES["model"]))

    def _model(self, version: int) -> dict:
        row = self.tables.read("model", version).first()
        if row is None:
            raise ValueError("build the index first")
        return row.asDict()

    def _assigned(self, given: DataFrame, model: dict, number: int) -> dict:
        """Write the rows list by list."""
        centres, books = _learned(model)
        known = self.spark.sparkContext.broadcast((centres, books))
        wide = model["dimensions"]

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, books = known.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _unit(_matrix(batch.column("embedding"), wide).astype(np.float64))
                near = _nearest(x, centres)[0]
                left = np.array_split(x - centres[near], len(books), axis=1)
                codes = np.column_stack([_nearest(part, book)[0].astype(np.uint8) for part, book in zip(left, books, strict=True)])
                columns = [batch.column("id"), pa.array(np.full(len(near), number, np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("embedding"), batch.column("metadata"), pa.array(near.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "part_no", "codes", "embedding", "metadata", "list"])

        rows = given.mapInArrow(assign, TABLES["vectors"])
        # a list may hold very many rows: it is cut by ids where it is larger than a file's worth
        return self.tables.put("vectors", rows.repartitionByRange("list", "id").sortWithinPartitions("list", "id"), ("list",), number=number)

    # ------------------------------------------------------------ reading

    def live(self, version: int | None = None) -> DataFrame:
        """The indexed rows: id, embedding, metadata, list and the rest of their table."""
        version = self.tables.version() if version is None else version
        rows = self.tables.read("vectors", version)
        dead = self.tables.read("dead", version)
        return rows.join(few(stored(dead)), ["id", "part_no"], "left_anti") if self.tables.parts(version)["dead"] else rows

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, query_id: str = "query_id", embedding: str = "embedding", exact: bool = False, rescore: int | None = None, places: int | None = None, conditions: Mapping[str, object] | None = None, version: int | None = None) -> DataFrame:
        """query_id, chunk_id, score, rank of the k vectors with the largest cosine among the lists looked into (all of them if ``exact``)."""
        version = self.tables.version() if version is None else version
        rescore = self.rescore if rescore is None else rescore
        if not self.tables.parts(version)["vectors"]:
            return self.spark.createDataFrame([], "query_id long, chunk_id long, score double, rank int")
        rows = where_metadata(self.live(version), conditions)
        # where all rows are looked at and rescored the codes choose nothing, and would only make pairs of all queries and rows
        if exact or (probes >= self._model(version)["lists"] and k * rescore >= rows.count()):
            return vector_topk(rows, queries, k, places=places, vector_id="id", query_id=query_id, embedding=embedding)
        model = self._model(version)
        asked = stored(self.probed(queries, probes, model, query_id, embedding))
        looked = sorted(r.list for r in asked.select(F.explode("lists").alias("list")).distinct().collect())  # at most the lists of the model
        rows = rows.where(F.col("list").isin(looked))
        counts = _met(self._coded(rows), asked, _code_scorer(model, k * rescore), "query_id long, step int, n long").groupBy("query_id", "step").agg(F.sum("n").alias("n"))
        down = counts.withColumn("n", F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("step"))))
        lowest = down.groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("n") >= k * rescore, F.col("step"))), F.lit(0)).alias("lowest"))
        return _best_of(self._coded(rows, "embedding"), stored(asked.join(lowest, "query_id")), _rescorer(model, k, places), k)

    def _coded(self, rows: DataFrame, *more: str) -> DataFrame:
        """Rows as the kernels read them; a task has what a block of queries takes to prepare, and answers for all queries, so tasks are not more than keep all cores busy."""
        return rows.select(F.col("id").alias("chunk_id"), "codes", "list", *more).coalesce(2 * self.spark.sparkContext.defaultParallelism)

    def probed(self, queries: DataFrame, probes: int, model: dict, query_id: str = "query_id", embedding: str = "embedding") -> DataFrame:
        """(query_id, embedding, lists): the lists whose centroids are nearest to each query."""
        known, wide = self.spark.sparkContext.broadcast(_learned(model)[0]), model["dimensions"]

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _unit(_matrix(batch.column("embedding"), wide).astype(np.float64))
                    lists = np.argsort(-(x @ known.value.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                    offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * lists.shape[1])
                    yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("embedding"), pa.ListArray.from_arrays(offsets, pa.array(lists.ravel()))], ["query_id", "embedding", "lists"])

        given = queries.where(F.col(embedding).isNotNull()).select(F.col(query_id).cast("long").alias("query_id"), F.col(embedding).cast("array<double>").alias("embedding"))
        return given.mapInArrow(near, "query_id long, embedding array<double>, lists array<int>")

    def recall(self, queries: DataFrame, k: int = 10, probes: int = 8, known: DataFrame | None = None, **options) -> DataFrame:
        """A row of (queries, recall): the mean share of the k exact neighbours that a search finds, over all queries against all rows.

        ``known``: the exact neighbours, (query_id, chunk_id), if they were computed before.
        """
        exact = self.neighbours(queries, k, **options) if known is None else known
        found = self.search(queries, k, probes, **({"places": PLACES} | options)).select("query_id", "chunk_id").withColumn("hit", F.lit(1))
        each = exact.join(found, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
        return each.agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.avg("share"), F.lit(1.0)).alias("recall"))

    def neighbours(self, queries: DataFrame, k: int, **options) -> DataFrame:
        """(query_id, chunk_id) of the exact neighbours, stored."""
        return stored(self.search(queries, k, exact=True, **({"places": PLACES} | options)).select("query_id", "chunk_id"))

    def calibrate(self, queries: DataFrame, k: int = 10, least: float = 0.95, **options) -> tuple[int, float]:
        """The fewest probes with at least this recall for the queries, and that recall, measured by a search.

        Before that ``rescore``, if none is given, is doubled until the codes alone, over all lists, lose at most half of
        what may be lost, so that the other half is left to the probes; later searches of this object use it.
        """
        version = options.get("version") or self.tables.version()
        known, model = self.neighbours(queries, k, **options), self._model(version)
        live, lists = where_metadata(self.live(version), options.get("conditions")), model["lists"]
        asked, n = stored(self.probed(queries, lists, model, options.get("query_id", "query_id"), options.get("embedding", "embedding"))), live.count()
        aims = known.join(live.select(F.col("id").alias("chunk_id"), "codes", "list"), "chunk_id").join(few(stored(asked.select("query_id", "lists"))), "query_id")
        aims = aims.withColumn("place", F.array_position("lists", F.col("list")).cast("int")).withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy("query_id")))
        aims, rows = stored(aims.drop("lists")), self._coded(live)
        aims = stored(self._above(rows, asked, aims, [lists], model).drop("cut"))
        total = aims.agg(F.sum("weight")).first()[0] or 0.0
        enough = lambda held, share=least: held >= (share - 1e-9) * total
        rescore = self.rescore if options.get("rescore") is None else options["rescore"]
        if options.get("rescore") is None:
            tried = [rescore << i for i in range(64) if i == 0 or k * rescore << (i - 1) < n]
            held = aims.agg(*(F.sum(F.when(F.col("above") < k * r, F.col("weight")).otherwise(0.0)) for r in tried)).first()
            rescore = self.rescore = next((r for r, x in zip(tried, held, strict=True) if k * r >= n or enough(x or 0.0, (1 + least) / 2)), tried[-1])
        found = F.when(F.col("above") < k * rescore, F.col("weight")).otherwise(0.0)
        by_place = {r.place: r for r in aims.groupBy("place").agg(F.sum("weight").alias("held"), F.sum(found).alias("found")).collect()}  # at most the lists of the model
        sums = np.cumsum([[0.0, 0.0], *((by_place[p].held, by_place[p].found) if p in by_place else (0.0, 0.0) for p in range(1, lists + 1))], axis=0)
        # fewer lists do not even hold enough of the neighbours; with so many, the codes lose few enough even if they choose among all lists
        low = max(0, min(int(np.argmax(enough(sums[:, 0]))), lists) - 1)
        high = int(np.argmax(enough(sums[:, 1]))) if enough(sums[-1, 1]) else lists
        high, lost = max(high, low + 1), aims.where(F.col("above") >= k * rescore).drop("above")
        while high - low > 1:
            cuts = sorted({low + (high - low) * i // (CUTS + 1) for i in range(1, CUTS + 1)} - {low})
            passed = self._above(rows, asked, lost.where(F.col("place") <= cuts[-1]), cuts, model)
            back = {r["cut"]: r.found for r in passed.where(F.col("above") < k * rescore).groupBy("cut").agg(F.sum("weight").alias("found")).collect()}
            reach = [c for c in cuts if enough(sums[c, 1] + back.get(c, 0.0))]
            high, low = (reach[0], max([c for c in cuts if c < reach[0]], default=low)) if reach else (high, cuts[-1])
        share, step = self.recall(queries, k, high, known, **options).first().recall, 1
        while share < least and high < lists:  # a row at the very edge of a step may have changed sides
            high, step = min(high + step, lists), 2 * step
            share = self.recall(queries, k, high, known, **options).first().recall
        return high, share

    def _above(self, rows: DataFrame, asked: DataFrame, aims: DataFrame, cuts: list[int], model: dict) -> DataFrame:
        """The aims (query_id, chunk_id, place, ...) once for each number of probes (cut) that looks into their list, with how many rows of those lists are in higher steps (above)."""
        each = aims.groupBy("query_id").agg(F.collect_list(F.struct("chunk_id", "list", "codes")).alias("aims"))
        higher = _met(rows, stored(asked.join(each, "query_id")), _rows_above(model, cuts), "query_id long, chunk_id long, cut int, above long")
        higher = higher.groupBy("query_id", "chunk_id", "cut").agg(F.sum("above").alias("above"))
        looks = aims.withColumn("cut", F.explode(F.lit(cuts).cast("array<int>"))).where("place <= cut")
        return looks.join(higher, ["query_id", "chunk_id", "cut"], "left").na.fill(0, ["above"])


def _learned(model: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    centres = np.frombuffer(model["centroids"]).reshape(-1, model["dimensions"])
    books, at, flat = [], 0, np.frombuffer(model["books"])
    for n, wide in json.loads(model["facts"])["books"]:
        books.append(flat[at : at + n * wide].reshape(n, wide))
        at += n * wide
    return centres, books


class _Block:
    """A block of queries, and the steps of what the codes of rows stand for."""

    def __init__(self, queries: pa.Table, model: dict, probes: int | None = None):
        self.centres, self.books = _learned(model)
        self.ids = queries.column("query_id").to_numpy()
        self.x = _unit(_matrix(queries.column("embedding").combine_chunks(), self.centres.shape[1])) if len(self.ids) else np.zeros((0, self.centres.shape[1]))
        #: the place of each list in each query's order, 0 if the query does not look into it
        self.place = np.zeros((len(self.ids), len(self.centres)), np.int32)
        if len(self.ids):
            lists = queries.column("lists").combine_chunks()
            size = lists.value_lengths().to_numpy()
            place = 1 + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            self.place[np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy()] = np.where(place <= (probes or len(self.centres)), place, 0)

    def meets(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
        """A batch list by list: the list, the queries that look into it, and its rows, few enough to be scored at once."""
        held = batch.column("list").to_numpy()
        order = np.argsort(held, kind="stable")
        lists, first = np.unique(held[order], return_index=True)
        for at, rows in zip(lists, np.split(order, first[1:]), strict=True):
            who = np.flatnonzero(self.place[:, at])
            for a in range(0, len(rows) if len(who) else 0, step := max(1, _CELLS // max(len(who), 1))):
                yield at, who, batch.take(pa.array(rows[a : a + step]))

    def decoded(self, lists: np.ndarray, codes: list[bytes]) -> np.ndarray:
        codes = np.frombuffer(b"".join(codes), np.uint8).reshape(len(lists), -1)
        return self.centres[lists] + np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], axis=1)

    def steps(self, who: np.ndarray, rows: pa.RecordBatch) -> np.ndarray:
        return _steps(self.x[who] @ self.decoded(rows.column("list").to_numpy(), rows.column("codes").to_pylist()).T)


def _steps(score: np.ndarray) -> np.ndarray:
    return np.clip((score + 2) * STEPS, 0, 4 * STEPS - 1).astype(np.int32)


def _code_scorer(model: dict, most: int):
    """(query_id, step, n): how many rows of the lists that a query looks into are in a step, down to where there are ``most``."""

    def kernel(queries: pa.Table) -> _Kernel:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = _Block(queries, model)
            counts = np.zeros((len(block.ids), 4 * STEPS), np.int32)
            for batch in batches:
                for _, who, rows in block.meets(batch):
                    np.add.at(counts.reshape(-1), (who[:, None] * counts.shape[1] + block.steps(who, rows)).ravel(), 1)
            over = np.cumsum(counts[:, ::-1], axis=1, dtype=np.int64)[:, ::-1] - counts
            query, step = np.nonzero((counts > 0) & (over < most))
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[query]), pa.array(step.astype(np.int32)), pa.array(counts[query, step].astype(np.int64))], ["query_id", "step", "n"])

        return run

    return kernel


def _rescorer(model: dict, k: int, places: int | None):
    """The cosine of queries with the rows of the lists that they look into, from each query's lowest step on."""

    def kernel(queries: pa.Table) -> _Kernel:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = _Block(queries, model)
            best, lowest = _Best(block.ids, k), queries.column("lowest").to_numpy()
            for batch in batches:
                for _, who, rows in block.meets(batch):
                    score = block.x[who] @ _unit(_matrix(rows.column("embedding"), block.x.shape[1]).astype(np.float64)).T
                    best.add(rows.column("chunk_id").to_numpy(), np.where(block.steps(who, rows) >= lowest[who, None], _rounded(score, places), -np.inf), who=who)
            yield best.rows()

        return run

    return kernel


def _rows_above(model: dict, cuts: list[int]):
    """(query_id, chunk_id, cut, above): how many rows of a query's first ``cut`` lists are in higher steps than each of its aims."""

    def kernel(queries: pa.Table) -> _Kernel:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = _Block(queries, model, max(cuts))
            aims = queries.column("aims").combine_chunks()
            size, flat = aims.value_lengths().to_numpy(), aims.flatten()
            owner = np.repeat(np.arange(len(size)), size)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
            # aims that a query does not have are in the highest step, above which there is nothing
            chunk, aim = np.zeros((len(size), size.max(initial=0)), np.int64), np.full((len(size), size.max(initial=0)), 4 * STEPS, np.int32)
            if len(owner):
                chunk[owner, nth] = flat.field("chunk_id").to_numpy()
                aim[owner, nth] = _steps((block.x[owner] * block.decoded(flat.field("list").to_numpy(), flat.field("codes").to_pylist())).sum(1))
            lowest, above = aim.min(axis=1, initial=4 * STEPS), np.zeros((len(cuts), *aim.shape), np.int64)
            for batch in batches:
                for at, who, rows in block.meets(batch):
                    step = block.steps(who, rows)
                    query, row = np.nonzero(step > lowest[who, None])
                    if not len(query):
                        continue
                    kinds, first = np.unique(query, return_index=True)
                    passed = np.add.reduceat(step[query, row, None] > aim[who[query]], first, axis=0, dtype=np.int64)
                    for i, cut in enumerate(cuts):
                        near = block.place[who[kinds], at] <= cut
                        above[i, who[kinds[near]]] += passed[near]
            cut, query, nth = np.nonzero(above)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.ids[query]), pa.array(chunk[query, nth]), pa.array(np.array(cuts, np.int32)[cut]), pa.array(above[cut, query, nth])], ["query_id", "chunk_id", "cut", "above"]
            )

        return run

    return kernel


__all__ = ["VectorIndex", "lloyd", "TABLES", "SAMPLE"]
