"""Alignment of two tokenizers over whole texts, by elementary intervals.

Both token sequences of a text cover the same bytes, so the ends of their tokens cut it into elementary intervals:
the union of both end arrays. Each interval has one token of either side as its owner (found by binary search) and
is one overlap, a link; an end that both sides share closes a group. All documents of an Arrow slice are laid behind one
another, as their byte totals agree. A group's product, all pairs of its tokens, expands on request.

Corpus-wide counts: a task notes the distinct id pairs of each document and sums how many documents hold a pair; one
combined aggregation adds the tasks up. The pairs' table is cut into ranges of A ids with at most ``RANGE_PAIRS`` pairs (plus
one id's, which B's vocabulary bounds), the documents' noted pairs into salts of about ``SALT_BYTES``; each meets in a group
of its own, so neither the table nor a frequent token is ever gathered. Only the number of pairs an A id has, a row for each id of
the vocabulary, reaches the driver.

A's file may be a byte-level JSON tokenizer. If it has nothing but merges in the order of its ids (as the public one) the
merging is done by tiktoken with the ranks that the file states, which gives the same ids in a fifth of the time; else by tokenizers.

Edge cases: null and empty texts, and texts that a side does not give back byte by byte, have no tokens: counts are zero and the
digest is empty; special tokens' strings are plain text; repeated rows and null ids are rows of their own; an empty table gives
an empty result; other columns are ignored whatever their names. A text is encoded whole, so one row needs memory in proportion to its text.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import BROADCAST_BYTES, LOCATOR, land, located, slices, text_bytes

#: Pairs of a range of the counted table, and bytes of noted pairs in one group of documents.
RANGE_PAIRS, SALT_BYTES = 1 << 20, 2 << 20
#: Tokens whose bytes are strung together at once.
BLOCK = 1 << 18
#: Distinct pairs that a task holds before it hands their sums on.
HELD_PAIRS = 1 << 21


# ---------------------------------------------------------------- the two sides


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for the bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class ByteTokens:
    """Side A: a byte-level BPE of a tokenizers JSON file."""

    def __init__(self, blob: bytes, pattern: str):
        spec, alphabet = json.loads(blob), _byte_alphabet()
        vocabulary = spec["model"]["vocab"]
        special = {t["content"] for t in spec.get("added_tokens", [])}
        self.bytes = {i: bytes(alphabet[c] for c in token) for token, i in vocabulary.items() if token not in special}
        merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        before = spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        if plain and all(a < b for a, b in zip(merged, merged[1:], strict=False)):
            import tiktoken

            encoding = tiktoken.Encoding("shipped", pat_str=pattern, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={})
            self._all = lambda texts: [encoding.encode_to_numpy(t, disallowed_special=()) for t in texts]
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(blob.decode())
            tokenizer.encode_special_tokens = True
            self._all = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list:
        return self._all([" " + t for t in texts])


class PieceTokens:
    """Side B: a sentencepiece model with byte fallback."""

    def __init__(self, blob: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.bytes = {}
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes[i] = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list:
        return self.model.encode(texts, num_threads=1)


class Side:
    """A tokenizer, and the bytes of its ids as one flat array."""

    def __init__(self, tokens: ByteTokens | PieceTokens):
        self.tokens = tokens
        self.flat, self.at, self.size = _flat([tokens.bytes.get(i, b"") for i in range(max(tokens.bytes) + 1)])
        self.digits = _flat([b"%d," % i for i in range(max(tokens.bytes) + 1)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        found = [np.asarray(ids, np.int64) for ids in self.tokens.encode(texts)]
        return np.concatenate([np.zeros(0, np.int64), *found]), np.array([len(x) for x in found], np.int64)


def _flat(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(e) for e in entries], np.int64)
    return np.frombuffer(b"".join(entries), np.uint8), np.cumsum(size) - size, size


def _strung(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The table's entries that begin ``at``, one behind the other; blocks bound the memory of long texts."""
    out, done = np.empty(int(size.sum()), np.uint8), 0
    for k in range(0, len(at), BLOCK):
        begin, many = at[k : k + BLOCK], size[k : k + BLOCK]
        ends = np.cumsum(many)
        out[done : done + ends[-1]] = flat[np.arange(ends[-1]) + np.repeat(begin - (ends - many), many)]
        done += int(ends[-1])
    return out


_sides: dict[tuple, tuple[Side, Side]] = {}


@dataclass(frozen=True)
class Tokenizers:
    """Both tokenizers' files on their way to the executors, which need not have them."""

    blobs: Broadcast
    key: tuple

    def sides(self) -> tuple[Side, Side]:
        if self.key not in _sides:
            a, b, pattern = self.blobs.value
            _sides.clear()
            _sides[self.key] = Side(ByteTokens(a, pattern)), Side(PieceTokens(b))
        return _sides[self.key]


def tokenizers(spark: SparkSession, byte_json: str, piece_model: str, pattern: str) -> Tokenizers:
    """``pattern``: the expression that splits a text for side A, which its file only names."""
    blobs = []
    for path in (byte_json, piece_model):
        with open(path, "rb") as file:
            blobs.append(file.read(BROADCAST_BYTES + 1))
        if len(blobs[-1]) > BROADCAST_BYTES:
            raise ValueError("the tokenizer's file is too large to broadcast")
    return Tokenizers(spark.sparkContext.broadcast((*blobs, pattern)), tuple(hashlib.sha256(b).hexdigest() for b in blobs) + (pattern,))


# ---------------------------------------------------------------- one slice


class Aligned:
    """The alignment of a slice of texts; arrays over all documents that have tokens, one behind the other."""

    def __init__(self, texts: pa.Array, a: Side, b: Side):
        n = len(texts)
        data, offsets = text_bytes(texts)
        size = np.diff(offsets)
        some = np.flatnonzero(size)
        plain = texts.take(pa.array(some)).to_pylist()
        # what both sides must give back: a space before each text that is not empty
        wanted = np.insert(data, offsets[some], 32)
        stop = np.cumsum(size[some] + 1)
        sides, good = [], np.ones(len(some), bool)
        for side in (a, b):
            ids, counts = side.encode(plain)
            joined, ends = _strung(side.flat, side.at[ids], side.size[ids]), np.append(0, np.cumsum(side.size[ids]))
            last = np.cumsum(counts)
            for k, (x, y, e) in enumerate(zip(ends[last - counts].tolist(), ends[last].tolist(), stop.tolist(), strict=True)):
                good[k] &= y - x == size[some[k]] + 1 and np.array_equal(joined[x:y], wanted[e - y + x : e])
            sides.append((ids, counts))
        #: the texts that have tokens
        self.docs = some[good]
        self.n = n
        keep = [np.repeat(good, counts) for _, counts in sides]
        self.a, self.b = sides[0][0][keep[0]], sides[1][0][keep[1]]
        self.n_a, self.n_b = sides[0][1][good], sides[1][1][good]
        end_a, end_b = np.cumsum(a.size[self.a]), np.cumsum(b.size[self.b])
        # elementary intervals and their owners
        self.cuts = np.union1d(end_a, end_b)
        self.left, self.right = np.searchsorted(end_a, self.cuts), np.searchsorted(end_b, self.cuts)
        self.doc_ends = np.cumsum(size[self.docs] + 1)
        closes = (end_a[self.left] == self.cuts) & (end_b[self.right] == self.cuts)
        #: the ends that both sides share, and the group of each token
        self.shared = self.cuts[closes]
        self.group_a, self.group_b = np.searchsorted(self.shared, end_a), np.searchsorted(self.shared, end_b)

    def per_doc(self, ends: np.ndarray) -> np.ndarray:
        """How many of the sorted ends lie in each document."""
        return np.diff(np.searchsorted(ends, self.doc_ends, "right"), prepend=0)

    def digests(self, a: Side, b: Side) -> list[bytes]:
        """SHA-256 of each document's groups: ids of A, |, ids of B, groups parted by semicolons."""
        n_a, n_b = len(self.a), len(self.b)
        if not n_a:
            return []
        in_a, in_b = np.bincount(self.group_a, minlength=len(self.shared)), np.bincount(self.group_b, minlength=len(self.shared))
        # a group's tokens of A come first, then those of B
        place_a = np.arange(n_a) + (np.cumsum(in_b) - in_b)[self.group_a]
        place_b = np.arange(n_b) + np.cumsum(in_a)[self.group_b]
        (flat_a, at_a, size_a), (flat_b, at_b, size_b) = a.digits, b.digits
        at, size = np.empty(n_a + n_b, np.int64), np.empty(n_a + n_b, np.int64)
        at[place_a], size[place_a] = at_a[self.a], size_a[self.a]
        at[place_b], size[place_b] = at_b[self.b] + len(flat_a), size_b[self.b]
        text = _strung(np.concatenate([flat_a, flat_b]), at, size)
        ends = np.cumsum(size)
        both = in_a + in_b
        stop = np.cumsum(both)
        text[ends[stop - in_b - 1] - 1] = ord("|")
        text[ends[stop - 1] - 1] = ord(";")
        last = ends[np.cumsum(self.n_a + self.n_b) - 1]
        begin = np.concatenate([[0], last[:-1]])
        return [hashlib.sha256(memoryview(text[x : y - 1])).digest() for x, y in zip(begin, last, strict=True)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, A id << 32 | B id, links) of each distinct pair of each document."""
        owner = np.searchsorted(self.doc_ends, self.cuts)
        key = self.a[self.left] << 32 | self.b[self.right]
        kinds, coded = np.unique(key, return_inverse=True)
        both, links = np.unique(owner * max(len(kinds), 1) + coded, return_counts=True)
        return both // max(len(kinds), 1), kinds[both % max(len(kinds), 1)], links


def _packed(values: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    """Numbers as bytes, those of one significance together."""
    return press.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=8 * n) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).reshape(-1).view("<u8").astype(np.int64)


# ---------------------------------------------------------------- operators


def aligned_groups(docs: DataFrame, shipped: Tokenizers, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, group, start, end, a, b): the groups of every document in order, with their byte range in space+text and their token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = shipped.sides()
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                x = Aligned(part.column("text"), a, b)
                if not len(x.docs):
                    continue
                owner = np.searchsorted(x.doc_ends, x.shared)
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                begin = np.concatenate([[0], x.shared[:-1]])
                base = begin[first][owner]
                lists = [pa.ListArray.from_arrays(np.append(0, np.cumsum(np.bincount(g, minlength=len(x.shared)))).astype(np.int32), pa.array(ids.astype(np.int32))) for g, ids in ((x.group_a, x.a), (x.group_b, x.b))]
                ids = part.column("id").take(pa.array(x.docs[owner]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(len(owner)) - first[owner]), pa.array(begin - base), pa.array(x.shared - base), *lists], ["id", "group", "start", "end", "a", "b"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, group long, start long, end long, a array<int>, b array<int>")


def group_products(groups: DataFrame) -> DataFrame:
    """(id, group, a, b): all pairs of the tokens of each group of ``aligned_groups``, whether they overlap or not."""
    return groups.select("id", "group", F.explode("a").alias("a"), F.col("b").alias("bs")).select("id", "group", "a", F.explode("bs").alias("b"))


def _noted(docs: DataFrame, shipped: Tokenizers, id_col: str, text_col: str) -> DataFrame:
    """A row a document: its counts, its digest and its distinct pairs with their links, packed."""
    docs, row = located(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "row", "n_a", "n_b", "n_groups", "n_links", "digest", "n_pairs", "pairs", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = shipped.sides()
        press = zstandard.ZstdCompressor(1)
        for batch in batches:
            for part in slices(batch, "text"):
                x = Aligned(part.column("text"), a, b)
                spread = lambda values: pa.array(np.bincount(x.docs, values, len(part)).astype(np.int64)) if len(x.docs) else pa.array(np.zeros(len(part), np.int64))
                digests = [None] * len(part)
                blobs = [b""] * len(part)
                links = [b""] * len(part)
                owner, pairs, counts = x.pairs()
                cut = np.searchsorted(owner, np.arange(len(x.docs) + 1))
                for k, (at, digest) in enumerate(zip(x.docs.tolist(), x.digests(a, b), strict=True)):
                    digests[at] = digest
                    own = slice(cut[k], cut[k + 1])
                    blobs[at], links[at] = _packed(np.diff(pairs[own], prepend=0), press), _packed(counts[own], press)
                columns = [part.column("id"), part.column("row"), spread(x.n_a), spread(x.n_b), spread(x.per_doc(x.shared)), spread(x.per_doc(x.cuts))]
                columns += [pa.array(digests, pa.binary()), spread(np.diff(cut)), pa.array(blobs, pa.binary()), pa.array(links, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(row).alias("row"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, row {LOCATOR}, n_a long, n_b long, n_groups long, n_links long, digest binary, n_pairs long, pairs binary, links binary")


def pair_counts(noted: DataFrame) -> DataFrame:
    """(a, b, n, best): in how many documents two ids are linked, and whether that is the most of any pair of the A id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.RecordBatch:
            kinds, n = _summed(held)
            return pa.RecordBatch.from_arrays([pa.array(kinds >> 32), pa.array(kinds & 0xFFFFFFFF), pa.array(n)], ["a", "b", "n"])

        for batch in batches:
            for blob, n in zip(batch.column("pairs").to_pylist(), batch.column("n_pairs").to_pylist(), strict=True):
                held.append((np.cumsum(_unpacked(blob, n)), np.ones(n, np.int64)))
                size += n
                if size > HELD_PAIRS:
                    held = [_summed(held)]
                    size = len(held[0][0])
                    if size > HELD_PAIRS // 2:
                        yield summed()
                        held, size = [], 0
        if held:
            yield summed()

    counts = noted.where("n_pairs > 0").select("n_pairs", "pairs").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    counts = land(counts, "pairs")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A's vocabulary
    return counts.join(F.broadcast(most), "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held])
    kinds, coded = np.unique(keys, return_inverse=True)
    return kinds, np.bincount(coded, n, len(kinds)).astype(np.int64)


def link_statistics(docs: DataFrame, shipped: Tokenizers, id_col: str = "doc_id", text_col: str = "text", range_pairs: int = RANGE_PAIRS, salt_bytes: int = SALT_BYTES) -> DataFrame:
    """A row for each row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best (links whose pair no other pair of its A id exceeds
    in documents), count_sum (the documents that hold the pair, summed over links), digest (SHA-256 of the groups, null without tokens)."""
    noted = land(_noted(docs, shipped, id_col, text_col), "noted")
    counts = land(pair_counts(noted), "counts")
    # ranges of A ids, from a number for each id of A's vocabulary
    per_id = counts.groupBy("a").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("a")
    part = (per_id["n"].cumsum() - per_id["n"]).to_numpy() // range_pairs
    firsts = [0, *(int(x) for x in per_id["a"].to_numpy()[1:][np.diff(part) > 0])]
    salts = int((noted.agg(F.sum(F.length("pairs") + F.length("links"))).first()[0] or 0) // salt_bytes) + 1
    where = np.array(firsts, np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each range that a document's pairs touch."""
        press = zstandard.ZstdCompressor(1)
        for batch in batches:
            rows, parts, ns, blobs, links = [], [], [], [], []
            for k, (blob, link, n) in enumerate(zip(batch.column("pairs").to_pylist(), batch.column("links").to_pylist(), batch.column("n_pairs").to_pylist(), strict=True)):
                if len(where) == 1:
                    pieces = [(0, n, blob, link)]
                else:
                    keys, many = np.cumsum(_unpacked(blob, n)), _unpacked(link, n)
                    at = np.append(np.searchsorted(keys, where << 32), n)
                    pieces = [(r, at[r + 1] - at[r], _packed(np.diff(keys[at[r] : at[r + 1]], prepend=0), press), _packed(many[at[r] : at[r + 1]], press)) for r in np.flatnonzero(np.diff(at))]
                for r, size, x, y in pieces:
                    rows.append(k), parts.append(r), ns.append(size), blobs.append(x), links.append(y)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(rows, pa.int64())), pa.array(parts, pa.int32()), pa.array(ns, pa.int64()), pa.array(blobs, pa.binary()), pa.array(links, pa.binary())], ["row", "part", "n_pairs", "pairs", "links"])

    pieces = noted.where("n_pairs > 0").select("row", "n_pairs", "pairs", "links").mapInArrow(cut, f"row {LOCATOR}, part int, n_pairs long, pairs binary, links binary")
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))

    def pack(key: tuple, known: pa.Table) -> pa.Table:
        """A range of counted pairs in one row."""
        pairs = known.column("a").to_numpy() << 32 | known.column("b").to_numpy()
        order = np.argsort(pairs)
        press = zstandard.ZstdCompressor(1)
        n = known.column("n").to_numpy()[order] * 2 + known.column("best").to_numpy(zero_copy_only=False)[order]
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "size": [len(order)], "known": pa.array([_packed(np.diff(pairs[order], prepend=0), press)], pa.binary()), "n": pa.array([_packed(n, press)], pa.binary())})

    table = counts.withColumn("part", _range_of(F.col("a"), firsts)).groupBy("part").applyInArrow(pack, "part int, size long, known binary, n binary")
    table = land(table, "ranges").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def look(key: tuple, own: pa.Table, known: pa.Table) -> pa.Table:
        """Sums over the pairs of some documents, from all counted pairs of a range."""
        if not len(own):
            return pa.table({"row": own.column("row"), "n_best": pa.array([], pa.int64()), "count_sum": pa.array([], pa.int64())})
        (size,), (keys,), (n,) = (known.column(c).to_pylist() for c in ("size", "known", "n"))
        keys, n = np.cumsum(_unpacked(keys, size)), _unpacked(n, size)
        sums, tops = [], []
        for blob, link, size in zip(own.column("pairs").to_pylist(), own.column("links").to_pylist(), own.column("n_pairs").to_pylist(), strict=True):
            found, many = n[np.searchsorted(keys, np.cumsum(_unpacked(blob, size)))], _unpacked(link, size)
            sums.append(int(many @ (found >> 1))), tops.append(int(many @ (found & 1)))
        return pa.table({"row": own.column("row"), "n_best": pa.array(tops, pa.int64()), "count_sum": pa.array(sums, pa.int64())})

    found = pieces.groupBy("part", "salt").cogroup(table.groupBy("part", "salt")).applyInArrow(look, f"row {LOCATOR}, n_best long, count_sum long")
    found = found.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = noted.select("id", "row", "n_a", "n_b", "n_groups", "n_links", "digest").join(found, "row", "left")
    return out.select("id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "digest")


def _range_of(column, firsts: list[int]):
    """The last of the sorted range starts that is not above the value."""
    return (F.size(F.filter(F.lit(firsts), lambda x: x <= column)) - 1).cast("int")


__all__ = ["tokenizers", "aligned_groups", "group_products", "pair_counts", "link_statistics"]
