"""SimHash near-duplicate detection by multi-index hashing.

A 64-bit fingerprint is cut into two 32-bit segments. If two fingerprints differ in at most three
bits, one of the segments differs in at most one. So each segment has a table keyed by its exact
value, every fingerprint asks each table for its own value and for the values one bit away (the
small Hamming ball), and whatever the tables return is verified over all 64 bits. A pair one bit
apart in a segment is asked for only by the fingerprint that has the bit clear, which halves the
probes. Equal fingerprints are merged first: a group of copies is one row. Table entries that hold very
many different fingerprints, as a large group of near copies may fill, are linked through the points
between them, so that no group is ever paired within itself.

Links become components by alternating large-star and small-star steps, each written to a shared
table; no link or component is ever collected.

Edge cases: null and empty texts have fingerprint zero and link like any other; repeated rows and
ids give repeated result rows; a null id never is a component's id unless all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import LOCATOR, Words, drop_rows, join_spread, land, located, slices, small_enough


#: Table entries with more distinct fingerprints than this are linked through points instead of pairs.
DENSE = 512
#: Shingles that are hashed and counted together, and bytes from which a shingle is hashed on its own.
BLOCK, LONG = 1 << 16, 512

# The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _mixed(total: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(total + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of many byte ranges of ``data`` at once: each step of the hash is taken for all ranges that have it."""
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out = np.empty(len(start), np.uint64)
    big = size > LONG
    for k in np.flatnonzero(big):
        out[k] = xxhash.xxh64_intdigest(memoryview(data[start[k] : start[k] + size[k]]), seed)
    rest = np.flatnonzero(~big)
    at, left = start[rest], size[rest]
    with np.errstate(over="ignore"):
        first = np.uint64(seed)
        h = np.full(len(rest), first + _P5)
        wide = np.flatnonzero(left >= 32)
        if len(wide):
            runs = [np.full(len(wide), v) for v in (first + _P1 + _P2, first + _P2, first, first - _P1)]
            stripes = left[wide] // 32
            for k in range(int(stripes.max())):
                now = np.flatnonzero(stripes > k)
                for j, run in enumerate(runs):
                    run[now] = _mixed(run[now], lanes[at[wide[now]] + 32 * k + 8 * j])
            joined = _turn(runs[0], 1) + _turn(runs[1], 7) + _turn(runs[2], 12) + _turn(runs[3], 18)
            for run in runs:
                joined = (joined ^ _mixed(np.zeros_like(run), run)) * _P1 + _P4
            h[wide] = joined
            at = at + left // 32 * 32
        h += left.astype(np.uint64)
        left = left % 32
        for k in range(3):
            now = np.flatnonzero(left >= 8 * k + 8)
            lane = lanes[at[now] + 8 * k]
            h[now] = _turn(h[now] ^ _mixed(np.zeros_like(lane), lane), 27) * _P1 + _P4
        at, left = at + left // 8 * 8, left % 8
        now = np.flatnonzero(left >= 4)
        h[now] = _turn(h[now] ^ (lanes[at[now]] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
        at, left = at + left // 4 * 4, left % 4
        for k in range(3):
            now = np.flatnonzero(left > k)
            h[now] = _turn(h[now] ^ data[at[now] + k].astype(np.uint64) * _P5, 11) * _P1
        h = (h ^ h >> np.uint64(33)) * _P2
        h = (h ^ h >> np.uint64(29)) * _P3
        out[rest] = h ^ h >> np.uint64(32)
    return out


def _fingerprints(texts: pa.Array, width: int, seed: int) -> np.ndarray:
    """Votes are counted over blocks of shingles, so a text of any length needs no more than its words' places."""
    words = Words(texts)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(words.count)
    if not len(some):
        return out
    data, starts, ends = words.joined()
    # shingle i of a text covers its words i .. i + width - 1; a short text is one shingle
    shingles = np.maximum(words.count[some] - width + 1, 1)
    stop = np.cumsum(shingles)
    first, end = words.first[some] - (stop - shingles), words.first[some + 1]
    votes = np.zeros((len(some), 64), np.int32)
    for a in range(0, int(stop[-1]), BLOCK):
        at = np.arange(a, min(a + BLOCK, int(stop[-1])))
        owner = np.searchsorted(stop, at, "right")
        begin = first[owner] + at
        last = np.minimum(begin + width, end[owner]) - 1
        hashes = xxh64(data, starts[begin], ends[last] - starts[begin], seed)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        votes[owner[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    out[some] = np.packbits(votes * 2 > shingles[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, row_col: str | None = None) -> DataFrame:
    """(id, fp) with fp the 64-bit fingerprint as a signed long; one row for each row of ``docs``. With ``row_col`` also row."""
    keys = ["id", "row"] if row_col else ["id"]
    kinds = f"id long, row {LOCATOR}, fp long" if row_col else "id long, fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp = _fingerprints(part.column("text"), width, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([*map(part.column, keys), pa.array(fp)], [*keys, "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *([F.col(row_col).alias("row")] if row_col else []))
    return rows.mapInArrow(run, kinds)


def hamming_links(prints: DataFrame, distance: int = 3, dense: int | None = None) -> DataFrame:
    """(a, b), a < b: every two distinct values of ``prints.fp`` that differ in 1 to ``distance`` (at most 3) bits.

    With ``dense``, table entries that hold more fingerprints than that are not paired but linked as
    ``_dense_links`` says. Each of its links is one of the above, and the ends of each link above are
    joined by two of its links, so the components are the same whatever ``dense`` is.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments with a ball of radius one find distances up to 3")
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    # the key holds the segment's number in bit 32
    own = (low, high.bitwiseOR(F.lit(_HIGH)))
    table = prints.select("fp", F.explode(F.array(*own)).alias("key"))
    bit = [F.lit(1 << i) for i in range(32)]

    def ball(segment: Column, tag: int) -> Column:
        keys = [segment] + [F.when(segment.bitwiseAND(b) == 0, segment.bitwiseOR(b)) for b in bit]
        return F.transform(F.array_compact(F.array(*keys)), lambda k: k.bitwiseOR(F.lit(tag)))

    probes = prints.select(F.col("fp").alias("probe"), F.explode(F.concat(ball(low, 0), ball(high, _HIGH))).alias("key"))
    stars = None
    if dense is not None and distance == 3:
        full = land(table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > dense).select("key"), "dense")
        if not full.isEmpty():
            full = small_enough(full, 16)
            stars = _dense_links(table.join(full, "key", "left_semi"), probes.join(full, "key", "left_semi"))
            table, probes = (t.join(full, "key", "left_anti") for t in (table, probes))
    differ = F.bit_count(F.col("probe").bitwiseXOR(F.col("fp")))
    pairs = probes.join(table, "key").where((F.col("probe") != F.col("fp")) & (differ <= distance))
    links = pairs.select(F.least("probe", "fp").alias("a"), F.greatest("probe", "fp").alias("b"))
    return (links if stars is None else links.unionByName(stars)).distinct()


_HIGH = 1 << 32
#: Masks of at most one and at most two of 32 bits.
_ONE = [0, *(1 << i for i in range(32))]
_TWO = [*_ONE, *(1 << i | 1 << j for i in range(32) for j in range(i))]


def _dense_links(table: DataFrame, probes: DataFrame) -> DataFrame:
    """Links of table entries with many fingerprints, without pairing these: 33 to 562 rows for each of them.

    Members of an entry agree in one half. Each stands at its other half and at the points one bit
    away from it; a probe stands at the points two bits away, or one if it already differs in the
    first half. Each point links all that stand at it to the smallest member there, if there is one.

    Every such link is true: members at one point are within two bits of each other, and a probe at a
    member's point is within three bits of it. No link is lost: a member and a probe within three
    bits share a point, and there both are linked to the same member. (Small entries are paired as that takes a
    handful of rows a fingerprint instead of hundreds.)
    """
    low, high = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)), lambda c: F.shiftrightunsigned(c, 32)
    first = F.col("key") < _HIGH

    def points(masks: list[int]) -> Column:
        return F.array(*map(F.lit, masks)).cast("array<long>")

    def standing(rows: DataFrame, name: str, masks: Column, member: bool) -> DataFrame:
        other = F.when(first, high(name)).otherwise(low(name))
        placed = rows.select("key", F.col(name).alias("fp"), other.alias("other"), F.explode(masks).alias("mask"))
        return placed.select("key", "fp", F.col("other").bitwiseXOR(F.col("mask")).alias("point"), F.lit(member).alias("member"))

    same = F.col("key") == F.when(first, low("probe")).otherwise(high("probe").bitwiseOR(F.lit(_HIGH)))
    both = standing(table, "fp", points(_ONE), True).unionByName(standing(probes, "probe", F.when(same, points(_TWO)).otherwise(points(_ONE)), False))
    centre = F.min(F.when(F.col("member"), F.col("fp"))).over(Window.partitionBy("key", "point"))
    linked = both.withColumn("centre", centre).where(F.col("centre") != F.col("fp"))
    return linked.select(F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node of an undirected link table (a, b) the smallest node it can reach.

    Large-star and small-star alternate until the links are stars around their roots. A node with very many
    links meets them in a broadcast of its row, so the links of one node are never brought together.
    """
    edges = land(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    state = None
    while True:
        # large star: every larger neighbour links to the smallest neighbour (the node itself included)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = land(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        large = join_spread(both.where("v > u"), least, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = land(large.distinct(), "large")
        # small star: a node and its smaller neighbours link to the smallest of them
        least = land(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        small = join_spread(large, least, ["u"], "n").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = land(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3, seed: int = 42, row_col: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: id, fp, component_id (the smallest id that links reach).

    With ``row_col``, which names the rows of ``docs``, also row and kept: of each component one row
    with its id stays, the one with the smallest locator.
    """
    rows = land(fingerprints(docs, id_col, text_col, width, seed, row_col), "prints")
    # a null id comes after all others
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")) if row_col else F.min("id")
    prints = land(rows.groupBy("fp").agg(least.alias("least"), F.count(F.lit(1)).alias("rows")), "distinct")
    found = land(components(hamming_links(prints.select("fp"), distance, DENSE)), "members")
    least = prints.join(found, prints["fp"] == found["node"]).groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    linked = join_spread(found, land(least, "least"), ["root"], "n").select(F.col("node").alias("fp"), "component_id")
    named = prints.join(linked, "fp", "left").select("fp", "rows", F.coalesce("component_id", "least").alias("component_id"))
    found = join_spread(rows, land(named, "named"), ["fp"], "rows")
    if row_col is None:
        return found.select("id", "fp", "component_id")
    best = F.col("component_id")
    return found.select("id", "fp", best["id"].alias("component_id"), "row", (F.col("row") == best["row"]).alias("kept"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row (of the smallest id) of each component; columns and texts unchanged."""
    docs, row = located(docs)
    gone = near_groups(docs, id_col, text_col, row_col=row, **options).where(~F.col("kept")).select("row")
    return drop_rows(docs, gone, row)
