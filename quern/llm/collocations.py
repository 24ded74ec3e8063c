"""Phrases mined by contiguous pattern growth.

Words stand for 64-bit hashes (XXH64; a seed that gives a frequent word the hash of any other word is given up for the next, so
counts are exact). A phrase is frequent only if its parts are, so pairs of frequent words are counted first, then triples
of frequent pairs, each by a combined aggregation, and an occurrence is followed only while its triples are frequent. Bit arrays of fixed size
hold the frequent words, pairs and triples; they let some more pass and never fewer. What remains of each occurrence, up to
``longest`` words, is the pointer projected onto its first words. Equal pointers of a task are one row with a count.

Prefixes of three words are dealt over tasks, each to one, with all its pointers, and grown there
to the right, depth first: pointers are sorted, so those of each longer prefix are a range of them. A prefix with more than ``MOST``
occurrences is not mined at once: its extensions by one word are counted in the same way and become prefixes of their own, again and again
while they are too frequent, so a task's pointers are bounded whatever a language's most frequent words are.

Scores compare a phrase with the parts of each cut; parts that very many phrases have in common are joined apart.
Products are decimals of 38 digits, divided without a remainder.

Edge cases: null and empty texts have no words; a null language is ``und``; repeated rows and null ids count as rows of their own;
ties end with the phrase in byte order; an empty table gives an empty result; other columns are ignored whatever
their names; a long text is cut into words slice by slice, and needs memory in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import _LOWERED, join_spread, land, scratch_path, slices, small_enough, text_bytes
from quern.llm.simhash import xxh64

#: Occurrences of a prefix up to which one task grows it, and pointers dealt to a task.
MOST, DEALT = 1 << 17, 1 << 18
#: Words of the prefixes that are dealt; shorter phrases, and these, are counted and not grown.
PREFIX = 3
#: log2 of the bits of each array of what may be frequent: 8 MB.
BITS = 26
#: Distinct rows that a task holds before it hands them on.
HELD = 1 << 21

_KIND = np.zeros(256, np.uint8)  # 0: part of a word, 1: between words, 2: ends a piece
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_ODD, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Pieces:
    """The words of a slice: for each its number among the distinct ones, its text, and whether the next word follows in its piece."""

    def __init__(self, texts: pa.Array):
        data, offsets = text_bytes(texts)
        kind, n = _KIND[data], len(data)
        solid = kind == 0
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(solid & (np.concatenate([[True], ~solid[:-1]]) | edge[:-1])) if n else np.zeros(0, np.int64)
        ends = np.flatnonzero(solid & (np.concatenate([~solid[1:], [True]]) | edge[1:])) + 1 if n else np.zeros(0, np.int64)
        self.owner = np.searchsorted(offsets, starts, "right") - 1
        piece = np.cumsum(kind == 2)[starts]
        self.linked = np.append((piece[1:] == piece[:-1]) & (self.owner[1:] == self.owner[:-1]), False)[: len(starts)]
        at = np.append(0, np.cumsum(ends - starts))
        lowered = np.ascontiguousarray(_LOWERED[data[solid]])
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(lowered)).dictionary_encode()
        self.kinds = words.dictionary
        self.ids = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def __len__(self) -> int:
        return len(self.ids)

    def hashes(self, seed: int) -> np.ndarray:
        data, offsets = text_bytes(self.kinds)
        return xxh64(data, offsets[:-1], np.diff(offsets), seed) if len(self.kinds) else np.zeros(0, np.uint64)


def _slots(lang: str, *words: np.ndarray) -> np.ndarray:
    """The place of words, or of runs of words, of a language in a bit array."""
    with np.errstate(over="ignore"):
        h = np.full(len(words[0]), xxhash.xxh64_intdigest(lang, 7), np.uint64)
        for w in words:
            h = (h ^ w) * _ODD
            h ^= h >> np.uint64(29)
        h = (h ^ h >> np.uint64(31)) * _OTHER
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _held(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, Pieces]]:
    """The pieces of each slice and language."""
    for part in slices(batch, "text"):
        langs = part.column("lang").dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            yield lang, Pieces(part.column("text").filter(pc.equal(langs.indices, k)))


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.where(F.length(F.col(text_col)) > 0).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))


class _Sums:
    """Rows with a count, equal ones added up, handed on when there are many."""

    def __init__(self, names: list[str]):
        self.names, self.held, self.size = names, [], 0

    def add(self, *columns, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = pa.table([*columns, pa.array(n)], [*self.names, "n"])
        self.held.append(table)
        self.size += len(table)
        if self.size > HELD:
            self._merge()
            if self.size > HELD // 2:
                yield from self.rest()

    def _merge(self) -> None:
        table = pa.concat_tables(self.held).group_by(self.names, use_threads=False).aggregate([("n", "sum")]).rename_columns([*self.names, "n"])
        self.held, self.size = [table], len(table)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._merge()
            yield from self.held[0].to_batches(max_chunksize=1 << 16)
        self.held, self.size = [], 0


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", seed: int = 42) -> DataFrame:
    """(lang, word, h, n): the occurrences of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(["lang", "word", "h"])
        for batch in batches:
            for lang, x in _by_language(batch):
                if len(x):
                    yield from sums.add(pa.array([lang] * len(x.kinds)), x.kinds.cast(pa.string()), pa.array(x.hashes(seed).view(np.int64)), n=np.bincount(x.ids, minlength=len(x.kinds)))
        yield from sums.rest()

    return _rows(docs, text_col, lang_col).mapInArrow(run, "lang string, word string, h long, n long").groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))


def _clash(words: DataFrame, least: int) -> bool:
    """Whether a frequent word shares its hash with another word, or with the mark for no word."""
    kinds = words.groupBy("h").agg(F.min("word").alias("one"), F.max("word").alias("other"), F.max("n").alias("n"))
    return not kinds.where((F.col("n") >= least) & ((F.col("one") != F.col("other")) | (F.col("h") == 0))).isEmpty()


def _bit_array(slots: DataFrame) -> np.ndarray:
    """The bits at the slots; 64 to a row, so that at most 2^(BITS - 6) rows reach the driver."""
    rows = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint8)


def _bits_of(frequent: DataFrame, *names: str) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in batch.column("lang").unique().to_pylist():
                rows = batch.filter(pc.equal(batch.column("lang"), lang))
                yield pa.RecordBatch.from_arrays([pa.array(_slots(lang, *(rows.column(w).to_numpy().view(np.uint64) for w in names)))], ["slot"])

    return _bit_array(frequent.select("lang", *names).mapInArrow(run, "slot long"))


def _names(size: int) -> list[str]:
    return [f"w{k + 1}" for k in range(size)]


def _both(x: Pieces, alive: np.ndarray) -> np.ndarray:
    """For each word, whether the runs that begin there and at the next word of its piece are both alive."""
    return x.linked & alive & np.append(alive[1:], False)[: len(x)]


def _alive(lang: str, x: Pieces, h: np.ndarray, bits: list[np.ndarray]) -> np.ndarray:
    """For each word, whether the run of ``len(bits)`` words that begins there, and its parts, may be frequent."""
    alive = _held(bits[0], _slots(lang, h))[x.ids]
    for size in range(2, len(bits) + 1):
        alive = _both(x, alive)
        at = np.flatnonzero(alive)
        alive[at] = _held(bits[size - 1], _slots(lang, *(h[x.ids[at + k]] for k in range(size))))
    return alive


def _runs(docs: DataFrame, known: list, seed: int) -> DataFrame:
    """(lang, w1 .., n): the occurrences of the runs that are a word longer than the last of ``known`` and have no part that cannot be frequent."""
    size = len(known) + 1
    names = _names(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, bits = _Sums(["lang", *names]), [b.value for b in known]
        for batch in batches:
            for lang, x in _by_language(batch):
                h = x.hashes(seed)
                at = np.flatnonzero(_both(x, _alive(lang, x, h, bits)))
                ids, n = [x.ids[at + k] for k in range(size)], np.ones(len(at), np.int64)
                if size == 2:  # most words have one, so equal ones of a slice are added up first
                    pairs, n = np.unique(ids[0] * len(h) + ids[1], return_counts=True)
                    ids = list(np.divmod(pairs, max(1, len(h))))
                yield from sums.add(pa.array([lang] * len(n), pa.string()), *(pa.array(h[i].view(np.int64)) for i in ids), n=n)
        yield from sums.rest()

    counted = docs.mapInArrow(run, f"lang string, {', '.join(f'{w} long' for w in names)}, n long")
    return counted.groupBy("lang", *names).agg(F.sum("n").alias("n"))


def _pointers(docs: DataFrame, known: list, seed: int, longest: int) -> DataFrame:
    """(lang, w1 .. w<longest>, n): what follows each occurrence of a prefix that may be frequent in a longer phrase, 0 where it ends or cannot be frequent any more."""
    names, size = _names(longest), len(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, bits = _Sums(["lang", *names]), [b.value for b in known]
        for batch in batches:
            for lang, x in _by_language(batch):
                h = x.hashes(seed)
                alive = _alive(lang, x, h, bits)
                at = np.flatnonzero(_both(x, alive))
                columns, on, alive = [h[x.ids[at + k]] for k in range(size + 1)], np.ones(len(at), bool), np.append(alive, np.zeros(longest, bool))
                for k in range(size + 1, longest):
                    on = on & alive[at + k - size + 1]
                    columns.append(np.where(on, h[x.ids[np.minimum(at + k, len(x) - 1)]], np.uint64(0)) if len(at) else columns[0])
                yield from sums.add(pa.array([lang] * len(at), pa.string()), *(pa.array(c.view(np.int64)) for c in columns), n=np.ones(len(at), np.int64))
        yield from sums.rest()

    return docs.mapInArrow(run, f"lang string, {', '.join(f'{w} long' for w in names)}, n long")


def _grow(words: np.ndarray, n: np.ndarray, depth: int, least: int, out: list) -> None:
    """Frequent phrases longer than ``depth`` words that the sorted pointers, equal in their first ``depth`` words, begin with."""
    if depth == words.shape[1]:
        return
    first = np.flatnonzero(np.append(True, words[1:, depth] != words[:-1, depth]))
    sums = np.add.reduceat(n, first)
    ends = np.append(first[1:], len(n))
    for k in np.flatnonzero((sums >= least) & (words[first, depth] != 0)):
        out.append((words[first[k], : depth + 1].tolist(), int(sums[k])))
        _grow(words[first[k] : ends[k]], n[first[k] : ends[k]], depth + 1, least, out)


def _grown(pointers: DataFrame, depth: int, least: int, longest: int, tasks: int) -> DataFrame:
    """(lang, w, n): the phrases that grow from the prefixes of ``depth`` words, all of a prefix in one task."""
    names = _names(longest)

    def mine(key: tuple, part: pa.Table) -> pa.Table:
        langs, found, of = part.column("lang").combine_chunks().dictionary_encode(), [], []
        words = np.column_stack([part.column(w).to_numpy() for w in names])
        n = part.column("n").to_numpy()
        codes = langs.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort([*(words[:, k] for k in reversed(range(longest))), codes])
        words, n, codes = words[order], n[order], codes[order]
        first = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (words[1:, :depth] != words[:-1, :depth]).any(axis=1)))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(n)], strict=True):
            before = len(found)
            _grow(words[a:b], n[a:b], depth, least, found)
            of += [codes[a]] * (len(found) - before)
        kinds = langs.dictionary.take(pa.array(of, pa.int32()))
        return pa.table({"lang": kinds.cast(pa.string()), "w": pa.array([w for w, _ in found], pa.list_(pa.int64())), "n": pa.array([x for _, x in found], pa.int64())})

    task = F.pmod(F.xxhash64("lang", *names[:depth]), F.lit(tasks))
    return pointers.groupBy(task.alias("task")).applyInArrow(mine, "lang string, w array<long>, n long")


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, most: int = MOST, dealt: int = DEALT, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """All phrases of 2 to ``longest`` words with ``least`` occurrences, (lang, w, n) with the hashes of their words, and
    all words (lang, word, h, n); both stored. ``most`` and ``dealt`` set how the work is dealt and never what is found."""
    spark = docs.sparkSession
    words = land(word_counts(docs, text_col, lang_col, seed), "words")
    while _clash(words, least):
        seed += 1
        words = land(word_counts(docs, text_col, lang_col, seed), "words")
    rows = _rows(docs, text_col, lang_col)
    path, often = scratch_path(spark, "phrases"), words.where(F.col("n") >= least)
    known = [spark.sparkContext.broadcast(_bits_of(often, "h"))]
    for depth in range(2, longest + 1):
        names = _names(depth)
        # prefixes of this length: of all texts at first, then of the pointers of prefixes too frequent for one task
        counted = _runs(rows, known, seed) if depth <= PREFIX else pointers.groupBy("lang", *names).agg(F.sum("n").alias("n"))
        prefixes = land(counted.where(F.col("n") >= least), "prefixes")
        prefixes.select("lang", F.array(*names).alias("w"), "n").write.mode("append").parquet(path)
        if depth == longest:
            break
        if depth <= PREFIX:
            known.append(spark.sparkContext.broadcast(_bits_of(prefixes, *names)))
        if depth < PREFIX:
            continue
        pointers = land(_pointers(rows, known, seed, longest), "pointers") if depth == PREFIX else pointers.where(F.col(f"w{depth + 1}") != 0)
        heavy = prefixes.where(F.col("n") > most).withColumnRenamed("n", "held")
        last = heavy.isEmpty()
        light = pointers if last else pointers.join(small_enough(heavy.drop("held"), 24 + 8 * depth), ["lang", *names], "left_anti")
        _grown(light, depth, least, longest, int(light.count() // dealt) + 1).write.mode("append").parquet(path)
        if last:
            break
        pointers = land(join_spread(pointers, heavy, ["lang", *names], "held"), "pointers")
    return spark.read.schema("lang string, w array<long>, n long").parquet(path), words


def score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 a n / (l r)) as a long; exact while 1000 a has 19 digits and n and r have 18."""
    return F.expr(f"cast((cast(cast({a} as decimal(19,0)) * 1000 as decimal(19,0)) * cast({n} as decimal(18,0))) div (cast({left} as decimal(19,0)) * cast({right} as decimal(18,0))) as long)")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, first: int = 2000, **options
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, cut): each language's ``first`` phrases by score.

    A phrase with a occurrences among n words scores floor(1000 a n / (l r)) for a cut into parts with l and r occurrences, and the least of
    its cuts counts. Phrases inside a longer one that is as frequent are left out.
    """
    phrases, words = frequent_phrases(docs, text_col, lang_col, least, longest, **options)
    # a phrase is dropped by one that is a word longer and as frequent: any longer one has such a part
    inner = F.array(F.slice("w", 1, F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1))
    covering = phrases.where(F.size("w") > 2).select("lang", F.explode(inner).alias("w"), "n").distinct()
    kept = land(phrases.join(covering, ["lang", "w", "n"], "left_anti"), "kept")
    # the parts of every cut
    cuts = kept.select("lang", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("cut"))
    left, right = F.slice(F.col("w"), F.lit(1), F.col("cut")), F.slice(F.col("w"), F.col("cut") + 1, F.size("w") - F.col("cut"))
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), left.alias("part")), F.struct(F.lit("r").alias("side"), right.alias("part"))))
    parts = land(cuts.select("lang", "w", "cut", sides.alias("s")).select("lang", "w", "cut", "s.side", "s.part"), "parts")
    known = phrases.select("lang", F.col("w").alias("part"), F.col("n").alias("held")).unionByName(words.where(F.col("n") >= least).select("lang", F.array("h").alias("part"), F.col("n").alias("held")))
    asked = parts.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("rows"))
    found = join_spread(parts, land(asked.join(known, ["lang", "part"]), "asked"), ["lang", "part"], "rows")
    held = lambda side: F.max(F.when(F.col("side") == side, F.col("held")))
    found = found.groupBy("lang", "w", "cut").agg(held("l").alias("l"), held("r").alias("r"))
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))
    rows = kept.join(found, ["lang", "w"]).join(total, "lang")
    rows = rows.withColumn("score", score("n", "total", "l", "r"))
    best = rows.groupBy("lang", "w", "n", "total").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best")).select("lang", "w", F.col("n").alias("a"), F.col("total").alias("n"), "best.*")
    # texts are needed only where phrases tie with the last one
    near = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = land(best.withColumn("near", F.rank().over(near)).where(F.col("near") <= first).drop("near"), "best")
    spelled = best.select("lang", "w", F.posexplode("w").alias("at", "h")).join(words.where(F.col("n") >= least).select("lang", "h", "word"), ["lang", "h"])
    spelled = spelled.groupBy("lang", "w").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda s: s["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = best.join(spelled, ["lang", "w"]).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")


__all__ = ["word_counts", "frequent_phrases", "collocations"]
