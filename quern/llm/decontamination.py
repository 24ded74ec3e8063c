"""Benchmark decontamination by winnowing, in DataFrame functions only.

A benchmark window is ``width`` consecutive words of an item; an item of fewer words is one window. For
windows of t words, k-grams of k = (t + 1) // 2 words are hashed and of every t - k + 1 consecutive
k-grams, which span exactly one window, the smallest hash is kept: the winnowed fingerprint. Equal windows have
equal fingerprints, so a document that holds a window shares its fingerprint wherever the window lies in it,
and a shared run of t words or more is always found. Documents keep a fingerprint with the run of window starts
it stands for, about two for t - k + 2 words; fingerprints that the benchmark has too are hits, and a
hit is extended to its windows, which are compared in full (128 bits of the words). Overlapping windows join to spans.

There is a layer of fingerprints for each window length that the benchmark has (``width``, and the lengths of its
shorter items), so short items are found as surely as long ones.

Texts are read once for fingerprints, and once more only where a document has hits. Fingerprints of the benchmark are
broadcast if they were counted and fit; else both sides meet in a shuffle, frequent ones apart. Documents with the same
set of windows are looked up once, whatever number of copies there is.

Edge cases: null and empty texts have no words, hit nothing and are no item; rows are told apart by file and place, so
repeated rows and null ids give a row each; items without an id mark words but are not named; repeated items count once; an empty
table on either side gives documents without hits; other columns are ignored whatever their names; long texts are
arrays of one row, as long as a row can be.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import BROADCAST_BYTES, ascii_lower, drop_rows, hash128, join_spread, land, located, small_enough, whole

#: What lies between words: all of ASCII but digits and small letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and deep inside lambdas it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(column: str) -> Column:
    return F.filter(F.split(ascii_lower(whole(column)), GAP), lambda word: word != "")


def _upto(last: Column) -> Column:
    """0 .. last, nothing if last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _winnowed(hashes: Column, t: int) -> Column:
    """The fingerprint of each window of t words, from the hashes of all words."""
    k = (t + 1) // 2
    grams = F.transform(_upto(F.size(hashes) - k), lambda i: F.xxhash64(F.lit(t), *(hashes[i + j] for j in range(k))))
    wide = t - k + 1
    return _let(grams, lambda g: F.transform(_upto(F.size(g) - wide), lambda i: F.least(*(g[i + j] for j in range(wide))) if wide > 1 else g[i]))


def _layer(t: int) -> Callable[[Column], Column]:
    return lambda hashes: _winnowed(hashes, t)


def _runs(t: int) -> Callable[[Column], Column]:
    """(fp, t, first, last) for each run of neighbouring windows with one fingerprint, from the windows' fingerprints."""
    return lambda windows: _run_list(windows, t)


def _run_list(windows: Column, t: int) -> Column:
    starts = F.filter(_upto(F.size(windows) - 1), lambda i: (i == 0) | (windows[F.greatest(i - 1, F.lit(0))] != windows[i]))
    end = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(windows)) - 1
    return _let(starts, lambda at: F.transform(at, lambda s, k: F.struct(windows[s].alias("fp"), F.lit(t).alias("t"), s.alias("first"), end(at, k).alias("last"))))


def benchmark_windows(bench: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = 10) -> DataFrame:
    """(item, t, fp, h1, h2): every window of every item, with its fingerprint and the hash of its words."""
    items = land(bench.select(F.col(item_col).cast("string").alias("item"), _words(text_col).alias("words")).where(F.size("words") > 0), "items")
    items = items.withColumn("t", F.least(F.size("words"), F.lit(width)))
    out = None
    for (t,) in items.select("t").distinct().collect():  # at most ``width`` lengths
        fps = _let(F.transform("words", lambda w: F.xxhash64(w)), _layer(t))
        rows = items.where(F.col("t") == t).select("item", "t", "words", F.posexplode(fps).alias("at", "fp"))
        rows = rows.select("item", "t", "fp", *hash128(F.slice("words", F.col("at") + 1, t)))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return bench.sparkSession.createDataFrame([], "item string, t int, fp long, h1 long, h2 long")
    return land(out.distinct(), "bench")


def fingerprints(docs: DataFrame, lengths: list[int], row: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, n_words, fp, t, first, last): the fingerprint runs of each document for windows of the given lengths, and a
    row with a null fingerprint for the document itself."""
    own = F.array(F.struct(F.lit(None).cast("long").alias("fp"), F.lit(0).alias("t"), F.lit(-1).alias("first"), F.lit(-1).alias("last")))
    every = lambda h: F.concat(own, *(_let(_winnowed(h, t), _runs(t)) for t in lengths))
    found = _let(F.transform(_words(text_col), lambda w: F.xxhash64(w)), lambda h: F.struct(F.size(h).cast("long").alias("n_words"), every(h).alias("runs")))
    docs = docs.select(F.col(id_col).alias("id"), F.col(row).alias("row"), F.explode(F.array(found)).alias("s"))
    return docs.select("id", "row", "s.n_words", F.explode("s.runs").alias("r")).select("id", "row", "n_words", "r.*")


class Found:
    """What the benchmark's windows hit: ``docs`` (id, row, n_words), ``hits`` (row, first, t, h1, h2: a row for each occurrence of a window), ``windows`` of the benchmark."""

    def __init__(self, docs: DataFrame, bench: DataFrame, id_col: str, text_col: str, item_col: str, bench_text: str, width: int, limit: int, row: str | None = None):
        if row is None:
            docs, row = located(docs)
        self.windows = benchmark_windows(bench, item_col, bench_text, width)
        lengths = sorted(r.t for r in self.windows.select("t").distinct().collect())
        marked = fingerprints(docs, lengths, row, id_col, text_col)
        known = self.windows.select("fp").distinct()
        if known.limit(limit // 16 + 1).count() * 16 <= limit:
            # hits are found where the text is read, and the documents' own rows pass through
            marked = marked.join(F.broadcast(known.withColumn("known", F.lit(True))), "fp", "left").where("known or fp is null")
            marked = land(marked, "winnowed")
            hits = marked.where("known")
        else:
            # counting first combines a frequent fingerprint where it is read
            marked = land(marked, "winnowed")
            held = marked.groupBy("fp").agg(F.count(F.lit(1)).alias("rows")).join(known, "fp")
            hits = join_spread(marked, land(held, "frequent"), ["fp"], "rows")
        self.docs = marked.where("fp is null").select("id", "row", "n_words")
        hits = hits.groupBy("row").agg(F.collect_list(F.struct("t", "first", "last")).alias("runs"))
        texts = docs.select(F.col(row).alias("row"), F.col(text_col).alias("text"))
        texts = texts.join(F.broadcast(hits) if self._fits(hits, limit) else hits, "row")
        inside = lambda words: F.flatten(F.transform("runs", lambda r: F.transform(F.sequence(r["first"], r["last"]), lambda i: F.struct(i.alias("first"), r["t"].alias("t"), F.slice(words, i + 1, r["t"]).alias("words")))))
        tried = texts.select("row", F.explode(_let(_words("text"), inside)).alias("w")).select("row", "w.first", "w.t", *hash128(F.col("w.words")))
        tried = land(tried, "tried")
        same = tried.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("rows")).join(self.windows.select("h1", "h2").distinct(), ["h1", "h2"])
        self.hits = land(join_spread(tried, land(same, "same"), ["h1", "h2"], "rows"), "found")

    @staticmethod
    def _fits(hits: DataFrame, limit: int) -> bool:
        size = hits.agg(F.sum(64 + 24 * F.size("runs"))).first()[0]
        return (size or 0) <= limit

    def covered(self) -> DataFrame:
        """(row, first, end, fresh): occurrences of windows, and how many of each one's words no earlier one covers."""
        before = Window.partitionBy("row").orderBy("first", "t").rowsBetween(Window.unboundedPreceding, -1)
        rows = self.hits.withColumn("end", F.col("first") + F.col("t"))
        done = F.coalesce(F.max("end").over(before), F.lit(0))
        return rows.withColumn("done", done).withColumn("fresh", F.greatest(F.lit(0), F.col("end") - F.greatest("first", "done")))


def _find(docs: DataFrame, bench: DataFrame, id_col: str, text_col: str, item_col: str, bench_text: str, width: int, limit: int, row: str | None = None) -> Found:
    return Found(docs, bench, id_col, text_col, item_col, bench_text, width, limit, row)


def contamination(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    bench_text: str = "text",
    width: int = 10,
    limit: int = BROADCAST_BYTES,
    row_col: str | None = None,
) -> DataFrame:
    """A row for each row of ``docs``: id, n_words, n_hit (words inside a window of the benchmark), items (their ids as
    strings, sorted), and the row's locator.

    ``limit``: bytes up to which fingerprints and hits are broadcast; results do not depend on it.
    """
    found = _find(docs, bench, id_col, text_col, item_col, bench_text, width, limit, row_col)
    by_row = found.covered().groupBy("row").agg(F.sum("fresh").cast("long").alias("n_hit"), F.sort_array(F.collect_set(F.struct("h1", "h2"))).alias("windows"))
    by_row = land(by_row.select("row", "n_hit", "windows", F.xxhash64("windows").alias("k1"), F.xxhash64(F.lit("second"), "windows").alias("k2")), "rows")
    sets = by_row.groupBy("k1", "k2").agg(F.first("windows").alias("windows")).select("k1", "k2", F.explode("windows").alias("w")).select("k1", "k2", "w.*")
    named = found.windows.where("item is not null").select("h1", "h2", "item").distinct()
    named = sets.join(small_enough(named, 96), ["h1", "h2"]).groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hit = by_row.drop("windows").join(named, ["k1", "k2"], "left").select("row", "n_hit", "items")
    out = found.docs.join(hit, "row", "left")
    return out.select("id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "row")


def spans(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text: str = "text", width: int = 10, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(id, first, end): the longest runs of words that windows of the benchmark cover, as word positions (end excluded)."""
    found = _find(docs, bench, id_col, text_col, item_col, bench_text, width, limit)
    rows = found.covered()
    order = Window.partitionBy("row").orderBy("first", "t")
    rows = rows.withColumn("part", F.sum((F.col("first") > F.col("done")).cast("int")).over(order))
    merged = rows.groupBy("row", "part").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    return merged.join(found.docs.select("row", "id"), "row").select("id", "first", "end")


def drop_contaminated(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents in which a window of the benchmark occurs; columns and texts unchanged."""
    docs, row = located(docs)
    rows = contamination(docs, bench, row_col=row, **options)
    return drop_rows(docs, rows.where("n_hit > 0").select("row"), row)


__all__ = ["benchmark_windows", "fingerprints", "contamination", "spans", "drop_contaminated"]
