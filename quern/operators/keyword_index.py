"""A keyword index that is built once and refreshed: BM25 over stored postings instead of texts.

A segment is what one arrival added. Its texts lie in slots of neighbouring rows, and a posting block holds one term's texts of one
slot, with the largest count and the shortest text among them; blocks are sorted by term, with bloom filters on it. Arrivals and deletions
are versions of one manifest: texts that an arrival replaces, and deleted ones, are addresses in a table of the dead until segments
of similar size are merged. Numbers of texts and tokens are kept in the manifest, and counts of a term are those of its blocks.

A search bounds what a slot's best text can score from the blocks' facts alone, scores each query's most promising slots, and then only
those other slots whose bound reaches the k-th best score found; so what it skips could not have been among the best, and the result
is that of ``search.bm25`` over the live texts.

Edge cases: null and empty texts, and texts without a token, are not indexed; ids must be longs, distinct within an arrival, and not
null; ties go by id; an empty index, an empty arrival and queries without a known term give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.search import _CELLS, _Best, _rounded, query_terms, rank
from quern.operators.snapshots import Snapshots
from quern.operators.staging import BROADCAST_BYTES, few, stored

TABLES = {
    "texts": "doc long, segment int, slot long, dl int",
    "postings": "term string, segment int, slot long, n int, most int, shortest int, docs array<long>, counts array<int>, lengths array<int>",
    "dead": "doc long, segment int, slot long",
}
_BLOOM = {"parquet.bloom.filter.enabled#term": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
#: Up to so many asked terms are handed to the scan, which then skips what holds none of them.
PUSHED_TERMS = 4096


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def counted_terms(tokens: Column) -> Column:
    """array<struct<term, tf>>: the distinct tokens of a row and how often each occurs, from the sorted tokens."""
    starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (s[F.greatest(i - 1, F.lit(0))] != s[i]))
    runs = lambda s: _let(starts(s), lambda at: F.transform(at, lambda i, k: F.struct(s[i].alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("tf"))))
    return _let(F.array_sort(tokens), runs)


class KeywordIndex:
    """An index in one folder. ``slot_texts``: texts a slot, a power of two; ``fan``: segments of similar size that are merged."""

    def __init__(self, spark: SparkSession, root: str, slot_texts: int = 1024, fan: int = 4, k1: float = 1.5, b: float = 0.75):
        self.spark, self.tables, self.fan, self.k1, self.b = spark, Snapshots(spark, root, TABLES), fan, k1, b
        self.shift, self.shipped = slot_texts.bit_length() - 1, BROADCAST_BYTES

    # ------------------------------------------------------------ writing

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Index an arrival; texts whose id is indexed already are replaced. Returns the version."""
        base = self.tables.version()
        rows = docs.select(F.col(id_col).cast("long").alias("doc"), T.tokens(F.col(text_col)).alias("tokens"))
        rows = rows.withColumn("slot", F.shiftright(F.monotonically_increasing_id(), self.shift)).withColumn("dl", F.size("tokens"))
        named = docs.select(F.col(id_col).cast("long").alias("doc"))
        if not named.groupBy("doc").count().where("count > 1 OR doc IS NULL").isEmpty():
            raise ValueError("ids of an arrival are distinct and not null")
        # read once more by texts and postings, so that both have one slot for a text
        rows = stored(rows.select("doc", "slot", "dl", F.when(F.col("dl") > 0, counted_terms(F.col("tokens"))).alias("terms")).where("dl > 0"))
        parts = self.tables.parts(base)
        dead, alive = self._killed(named, base, parts)
        return self.tables.commit(base, {"dead": dead, **self._segment(rows, base + 1, alive, parts["postings"])})

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> int:
        """Take texts out of the index. Returns the version."""
        base = self.tables.version()
        dead, alive = self._killed(ids.select(F.col(id_col).cast("long").alias("doc")).distinct(), base, self.tables.parts(base))
        return self.tables.commit(base, {"dead": dead, "texts": alive})

    def _killed(self, ids: DataFrame, base: int, parts: dict) -> tuple[list[dict], list[dict]]:
        """The parts of dead texts with those of these ids, and the parts of texts with their new numbers."""
        gone = stored(self.live(base).join(ids, "doc", "left_semi"))
        by = {r.segment: r for r in gone.groupBy("segment").agg(F.count(F.lit(1)).alias("texts"), F.sum("dl").alias("tokens")).collect()}  # a row a segment
        alive = [p | {"texts": p["texts"] - by[p["segment"]].texts, "tokens": p["tokens"] - by[p["segment"]].tokens} if p["segment"] in by else p for p in parts["texts"]]
        return parts["dead"] + ([self.tables.put("dead", gone)] if by else []), alive

    def _segment(self, rows: DataFrame, segment: int, texts: list[dict], postings: list[dict]) -> dict[str, list[dict]]:
        """Write (doc, slot, dl, terms) as a segment; the tables' parts with it."""
        numbers = rows.agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first().asDict()
        tagged = rows.withColumn("segment", F.lit(segment))
        entries = tagged.select("segment", "slot", "doc", "dl", F.explode("terms").alias("t")).select("t.term", "segment", "slot", "doc", "t.tf", "dl")
        return {"texts": [*texts, self.tables.put("texts", tagged, segment=segment, **numbers)], "postings": [*postings, self._blocks(entries, segment)]}

    def _blocks(self, entries: DataFrame, segment: int) -> dict:
        # ranges of terms and slots: a frequent term is spread, and a range is grouped where it lies
        dealt = entries.repartitionByRange("term", "slot")
        block = F.array_sort(F.collect_list(F.struct("doc", "tf", "dl"))).alias("e")
        blocks = dealt.groupBy("term", "segment", "slot").agg(F.max("tf").alias("most"), F.min("dl").alias("shortest"), block)
        blocks = blocks.select("*", F.size("e").alias("n"), F.col("e.doc").alias("docs"), F.col("e.tf").alias("counts"), F.col("e.dl").alias("lengths"))
        return self.tables.put("postings", blocks.sortWithinPartitions("term", "slot"), options=_BLOOM, segment=segment)

    def merge(self) -> int:
        """Merge segments of similar size, if there are ``fan`` of them, without their dead texts. Returns the version."""
        base = self.tables.version()
        parts = self.tables.parts(base)
        tiers: dict[int, list[dict]] = {}
        for p in parts["texts"]:
            tiers.setdefault(len(_digits(p["texts"], self.fan)), []).append(p)
        taken = [p for group in tiers.values() if len(group) >= self.fan for p in group]
        if not taken:
            return base
        names = {p["segment"] for p in taken}
        rest = {name: [p for p in parts[name] if p["segment"] not in names] for name in ("texts", "postings")}
        live = self.live(base).where(F.col("segment").isin(sorted(names)))
        # new slots along the ids
        placed = live.repartitionByRange("doc").sortWithinPartitions("doc")
        placed = stored(placed.withColumn("place", F.shiftright(F.monotonically_increasing_id(), self.shift)))
        old = self.tables.scan("postings", [p for p in parts["postings"] if p["segment"] in names])
        old = old.select("term", "segment", F.explode(F.arrays_zip("docs", "counts", "lengths")).alias("e")).select("term", "segment", F.col("e.docs").alias("doc"), F.col("e.counts").alias("tf"), F.col("e.lengths").alias("dl"))
        entries = old.join(placed.select("doc", "segment", F.col("place").alias("slot")), ["doc", "segment"]).withColumn("segment", F.lit(base + 1))
        numbers = {"texts": sum(p["texts"] for p in taken), "tokens": sum(p["tokens"] for p in taken)}
        texts = placed.select("doc", F.lit(base + 1).alias("segment"), F.col("place").alias("slot"), "dl")
        dead = self.tables.read("dead", base).where(~F.col("segment").isin(sorted(names)))
        return self.tables.commit(base, {
            "texts": [*rest["texts"], self.tables.put("texts", texts, segment=base + 1, **numbers)],
            "postings": [*rest["postings"], self._blocks(entries, base + 1)],
            "dead": [] if dead.isEmpty() else [self.tables.put("dead", dead)],
        })

    # ------------------------------------------------------------ reading

    def live(self, version: int | None = None) -> DataFrame:
        """(doc, segment, slot, dl) of the texts that a search can find."""
        return self.tables.read("texts", version).join(self.tables.read("dead", version), ["doc", "segment", "slot"], "left_anti")

    def statistics(self, version: int | None = None) -> dict[str, int]:
        """Segments, texts and tokens, from the manifest."""
        texts = self.tables.parts(version)["texts"]
        return {"segments": len(texts), "texts": sum(p["texts"] for p in texts), "tokens": sum(p["tokens"] for p in texts)}

    def _impact(self, tf: Column, dl: Column, mean: float) -> Column:
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / mean))

    def search(self, queries: DataFrame, k: int = 10, query_id: str = "query_id", query_text: str = "text", places: int | None = None, allowed: DataFrame | None = None, head: int = 2, version: int | None = None) -> DataFrame:
        """The k best texts of each query: query_id, chunk_id, score, rank, as ``bm25`` returns them.

        ``allowed`` (doc): only these can be found. ``head``: slots of each query that are scored before the others are judged; it changes
        what is read and never what is found.
        """
        return self.explain(queries, k, query_id, query_text, places, allowed, head, version)[0]

    def explain(self, queries, k=10, query_id="query_id", query_text="text", places=None, allowed=None, head=2, version=None) -> tuple[DataFrame, DataFrame]:
        """``search``'s result, and a row of (blocks, held, asked, read): blocks of the index, those of asked terms, and the pairs of a query
        and a block of one of its terms: all of them, and those whose texts were scored."""
        version = self.tables.version() if version is None else version
        numbers = self.statistics(version)
        dead = self.tables.read("dead", version)
        postings = self.tables.read("postings", version)
        if not numbers["texts"]:
            counts = self.spark.createDataFrame([(0, 0, 0, 0)], "blocks long, held long, asked long, read long")
            return self.spark.createDataFrame([], "query_id long, chunk_id long, score double, rank int"), counts
        n, mean = numbers["texts"], numbers["tokens"] / numbers["texts"]
        wanted = stored(query_terms(queries, query_id, query_text))
        asked = few(stored(wanted.select("term").distinct()))
        short = asked.limit(PUSHED_TERMS + 1).toArrow()
        held = postings.where(F.col("term").isin(short.column("term").to_pylist())) if short.num_rows <= PUSHED_TERMS else postings
        blocks = stored(held.select("term", "segment", "slot", "n", "most", "shortest").join(asked, "term"))
        df = blocks.groupBy("term").agg(F.sum("n").alias("df"))
        if self.tables.parts(version)["dead"]:
            # dead texts still lie in their blocks
            slots = few(stored(dead.select("segment", "slot").distinct()))
            lost = held.join(asked, "term", "left_semi").join(slots, ["segment", "slot"], "left_semi").select("term", "segment", "slot", F.explode("docs").alias("doc"))
            lost = lost.join(dead, ["doc", "segment", "slot"], "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("lost"))
            df = df.join(lost, "term", "left").select("term", (F.col("df") - F.coalesce("lost", F.lit(0))).alias("df"))
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = few(stored(wanted.join(df, "term").select("query_id", "term", (F.col("qtf") * idf).alias("weight"))))
        # what the best text of a slot can reach at most
        most = F.sum(F.col("weight") * self._impact(F.col("most"), F.col("shortest"), mean)).alias("bound")
        bounds = blocks.join(weights, "term").groupBy("query_id", "segment", "slot").agg(most)
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "slot")
        first = stored(bounds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= head).drop("place"))
        scored = lambda slots: self._scored(slots, weights, held, dead, mean, places, allowed, k, version)
        best = stored(scored(first))
        floor = few(stored(best.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))))
        # sums and rounding may lift a score by this much above its bound
        open_ = bounds.join(floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") + 10.0 ** -(places or 9) >= F.col("floor")))
        rest = stored(open_.join(first.select("query_id", "segment", "slot"), ["query_id", "segment", "slot"], "left_anti").select(*first.columns))
        found = rank(best.drop("rank").unionByName(scored(rest).drop("rank")), k, F.desc("score"), F.asc("chunk_id"))
        pairs = blocks.select("term", "segment", "slot").join(weights.select("query_id", "term"), "term")
        read = first.unionByName(rest).select("query_id", "segment", "slot").join(pairs, ["query_id", "segment", "slot"])
        count = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
        return found, count(postings, "blocks").crossJoin(count(blocks, "held")).crossJoin(count(pairs, "asked")).crossJoin(count(read, "read"))

    def _scored(self, slots: DataFrame, weights: DataFrame, held: DataFrame, dead: DataFrame, mean: float, places: int | None, allowed: DataFrame | None, k: int, version: int) -> DataFrame:
        """The k best texts of each query in its slots: a slot at a time if the weights can be shipped, else by joins."""
        if allowed is None and (weights.agg(F.sum(F.octet_length("term") + 40)).first()[0] or 0) <= self.shipped:
            return self._by_slot(slots, weights.toArrow(), held, dead, mean, places, k)
        wanted = slots.select("query_id", "segment", "slot").join(weights, "query_id")
        rows = held.select("term", "segment", "slot", "docs", "counts", "lengths").join(few(stored(wanted)), ["term", "segment", "slot"])
        rows = rows.select("query_id", "weight", "segment", "slot", F.explode(F.arrays_zip("docs", "counts", "lengths")).alias("e"))
        value = F.col("weight") * self._impact(F.col("e.counts"), F.col("e.lengths"), mean)
        rows = rows.groupBy("query_id", "segment", "slot", F.col("e.docs").alias("doc")).agg(F.sum(value).alias("score"))
        if self.tables.parts(version)["dead"]:
            rows = rows.join(dead, ["doc", "segment", "slot"], "left_anti")
        if allowed is not None:
            rows = rows.join(allowed.select("doc").distinct(), "doc", "left_semi")
        score = F.col("score") if places is None else F.round("score", places)
        return rank(rows.select("query_id", F.col("doc").alias("chunk_id"), score.alias("score")), k, F.desc("score"), F.asc("chunk_id"))

    def _by_slot(self, slots: DataFrame, weights: pa.Table, held: DataFrame, dead: DataFrame, mean: float, places: int | None, k: int) -> DataFrame:
        """A slot's blocks, its open queries and its dead texts meet; the slot's best of each query go on."""
        k1, b = self.k1, self.b
        weights = weights.sort_by([("term", "ascending"), ("query_id", "ascending")])
        terms = pc.unique(weights.column("term"))
        code = pc.index_in(weights.column("term"), value_set=terms).to_numpy()
        ids, owner = np.unique(weights.column("query_id").to_numpy(), return_inverse=True)
        shipped = self.spark.sparkContext.broadcast((terms, np.searchsorted(code, np.arange(len(terms) + 1)), ids, owner, weights.column("weight").to_numpy()))

        def score(key: tuple, blocks: pa.Table, open_: pa.Table) -> pa.Table:
            terms, start, ids, owner, weight = shipped.value
            asked = np.unique(open_.column("query_id").drop_null().to_numpy())
            best = _Best(asked, k)
            if len(asked) and len(blocks):
                flat = lambda c: pc.list_flatten(blocks.column(c)).to_numpy()
                size = pc.list_value_length(blocks.column("docs")).to_numpy()
                tf, dl = flat("counts").astype(float), flat("lengths").astype(float)
                texts, text = np.unique(flat("docs"), return_inverse=True)
                impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))
                term = np.repeat(pc.index_in(blocks.column("term"), value_set=terms).to_numpy(), size)
                # the open queries of each term
                place = np.full(len(ids), -1)
                place[np.searchsorted(ids, asked)] = np.arange(len(asked))
                open_now = place[owner] >= 0
                query, value, first = place[owner][open_now], weight[open_now], np.append(0, np.cumsum(open_now))[start]
                each = first[term + 1] - first[term]
                total, done = np.cumsum(each), 0
                found = np.zeros(len(asked) * len(texts))
                while done < len(term):
                    end = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + _CELLS, "right")))
                    part = each[done:end]
                    entry = np.repeat(np.arange(done, end), part)
                    use = np.arange(len(entry)) - np.repeat(np.cumsum(part) - part, part) + first[term[entry]]
                    found += np.bincount(query[use] * len(texts) + text[entry], value[use] * impact[entry], len(found))
                    done = end
                found = found.reshape(len(asked), len(texts))
                found[:, np.isin(texts, open_.column("doc").drop_null().to_numpy())] = 0
                best.add(texts, _rounded(found, places), 0.0)
            return pa.Table.from_batches([best.rows()])

        named = slots.select("query_id", F.lit(None).cast("long").alias("doc"), "segment", "slot")
        where = few(stored(slots.select("segment", "slot").distinct()))
        gone = dead.join(where, ["segment", "slot"], "left_semi").select(F.lit(None).cast("long").alias("query_id"), "doc", "segment", "slot")
        asked = F.broadcast(self.spark.createDataFrame(pa.table({"term": terms}), "term string"))
        blocks = held.select("term", "segment", "slot", "docs", "counts", "lengths").join(asked, "term", "left_semi").join(where, ["segment", "slot"], "left_semi")
        found = blocks.groupBy("segment", "slot").cogroup(named.unionByName(gone).groupBy("segment", "slot")).applyInArrow(score, "query_id long, chunk_id long, score double")
        return rank(found, k, F.desc("score"), F.asc("chunk_id"))


def _digits(n: int, base: int) -> list[int]:
    out = []
    while n:
        n, d = divmod(n, base)
        out.append(d)
    return out


__all__ = ["KeywordIndex", "counted_terms", "TABLES"]
