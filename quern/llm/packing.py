"""Best-fit packing into sequences of several permitted lengths.

Documents are encoded whole, an end token behind each; a document longer than the longest sequence
is cut into pieces that fill one and a rest. Pieces are dealt into shards of about ``shard_items``
by a hash of a row number given when their table was written, so neither a frequent id nor a
frequent length can overfill a shard, and each shard is packed on its own, token ids and all:
longest first, each item goes to the open bin that it leaves least room in, whatever the bin's
size (of equally tight ones, the one filled last); if none has room a bin is opened. Which size to open is decided jointly for the shard: the
packing is tried once for every floor (open the size with the least cost a token among the
permitted sizes not below the floor and the item) and the plan with the lowest total cost is
taken. Finally each bin shrinks to the smallest permitted length that holds its contents.

Edge cases: null and empty texts are a lone end token; repeated rows and rows with a null id are
packed one by one; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.encoding import ship
from quern.llm.shared import land, slices

RESULT = "shard int, bin int, bin_length int, bin_used int, doc_ids array<long>, pieces array<int>, piece_starts array<long>, bin_starts array<int>, tokens array<int>"


@dataclass(frozen=True)
class Cost:
    """Cost of a sequence of n tokens: ``fixed`` plus n plus n squared over ``span``."""

    fixed: int = 64
    span: int = 16384

    def __call__(self, length: int) -> float:
        return self.fixed + length + length * length / self.span


def best_fit(sizes: Sequence[int], lengths: Sequence[int], cost: Cost, floor: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and start of each item (given longest first), and what each bin holds.

    ``room`` has bit r set if an open bin has r tokens of room left, so the tightest fit is the
    lowest bit at or above the item's size.
    """
    allowed = [c for c in lengths if c >= floor]
    opens: dict[int, int] = {}
    bins: list[list[int]] = [[] for _ in range(max(lengths) + 1)]
    room, where, start, used, size = 0, [], [], [], []
    for item in sizes:
        fits = room >> item
        if fits:
            left = item + (fits & -fits).bit_length() - 1
            k = bins[left].pop()
            if not bins[left]:
                room ^= 1 << left
        else:
            if item not in opens:
                opens[item] = min((c for c in allowed if c >= item), key=lambda c: (cost(c) / c, c))
            k, left = len(used), opens[item]
            used.append(0)
            size.append(left)
        where.append(k)
        start.append(used[k])
        used[k] += item
        left -= item
        if left:
            bins[left].append(k)
            room |= 1 << left
    return where, start, used


def plan_bins(sizes: Sequence[int], lengths: Sequence[int], cost: Cost) -> tuple[list[int], list[int], list[int], list[int]]:
    """The cheapest of the plans for all floors: bin and start of each item, contents and final length of each bin."""
    lengths = sorted(lengths)
    best = None
    for floor in lengths:
        where, start, used = best_fit(sizes, lengths, cost, floor)
        final = [next(c for c in lengths if c >= u) for u in used]
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = total, (where, start, used, final)
    return best[1]


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lengths: Sequence[int] = (512, 1024, 2048, 4096),
    cost: Cost = Cost(),
    shard_items: int = 4096,
) -> DataFrame:
    """One row for each training sequence: its permitted length, its ``bin_used`` token ids, and what they come from.

    ``tokenizer`` is a file on the driver (see ``encoding.Encoder``). The lists ``doc_ids``, ``pieces``,
    ``piece_starts`` (in the document's tokens) and ``bin_starts`` (in the sequence's) have an entry
    for each piece, in order. Bin numbers count from 0 in each shard.
    """
    longest, shipped = max(lengths), ship(docs.sparkSession, tokenizer, end_id, pattern)
    # between the steps ids are bytes, as few as the vocabulary needs
    item = np.dtype("<u2" if shipped.encoder().largest < 1 << 16 else "<u4")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shipped.encoder()
        for batch in batches:
            for part in slices(batch, "text"):
                ids, counts = encoder.encode(part.column("text"))
                pieces = -(-counts // longest)
                owner = np.repeat(np.arange(len(counts)), pieces)
                piece = np.arange(len(owner)) - (np.cumsum(pieces) - pieces)[owner]
                starts = (np.cumsum(counts) - counts)[owner] + piece * longest
                offsets = (np.append(starts, len(ids)) * item.itemsize).astype(np.int32)
                tokens = pa.BinaryArray.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(item))])
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(owner)), pa.array(piece, pa.int32()), tokens], ["id", "piece", "tokens"])

    items = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    items = items.mapInArrow(encode, "id long, piece int, tokens binary").withColumn("row", F.monotonically_increasing_id())
    items = land(items, "items")
    shards = max(1, -(-items.count() // shard_items))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        table = table.append_column("size", pc.divide(pc.binary_length(table.column("tokens")), item.itemsize))
        table = table.take(pc.sort_indices(table.select(["size", "id", "row"]), [("size", "descending"), ("id", "ascending"), ("row", "ascending")]))
        where, start, used, final = plan_bins(table.column("size").to_pylist(), lengths, cost)
        order = np.lexsort((start, where))
        table, where, start = table.take(pa.array(order)).combine_chunks(), np.array(where)[order], np.array(start)[order]
        ids, piece, tokens = (table.column(n).chunk(0) for n in ("id", "piece", "tokens"))
        at = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]
        flat = np.frombuffer(tokens.buffers()[2], np.uint8)[at[0] : at[-1]].view(item).astype(np.int32)
        within, held = pa.array(np.searchsorted(where, np.arange(len(used) + 1)), pa.int32()), pa.array(np.append(0, np.cumsum(used)), pa.int32())
        lists = [ids, piece, pa.array(piece.to_numpy().astype(np.int64) * longest), pa.array(start, pa.int32())]
        lists = [pa.ListArray.from_arrays(within, x) for x in lists] + [pa.ListArray.from_arrays(held, pa.array(flat))]
        alone = [np.full(len(used), table.column("shard")[0].as_py()), np.arange(len(used)), final, used]
        names = [c.split()[0] for c in RESULT.split(", ")]
        return pa.Table.from_arrays([*(pa.array(x, pa.int32()) for x in alone), *lists], names)

    # one task a shard: shard numbers are the tasks' numbers
    return dealt.repartitionById(shards, F.col("shard")).groupBy("shard").applyInArrow(run, RESULT)


def placements(packed: DataFrame) -> DataFrame:
    """A row for each piece of each document: where it begins in the document, and where it went."""
    place = F.explode(F.arrays_zip("doc_ids", "pieces", "piece_starts", "bin_starts")).alias("p")
    rows = packed.select("shard", "bin", "bin_length", "bin_used", place)
    return rows.select(F.col("p.doc_ids").alias("id"), F.col("p.pieces").alias("piece"), F.col("p.piece_starts").alias("piece_start"), "shard", "bin", F.col("p.bin_starts").alias("bin_start"), "bin_used", "bin_length")


__all__ = ["Cost", "best_fit", "plan_bins", "pack", "placements"]
