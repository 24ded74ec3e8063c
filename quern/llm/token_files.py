"""Token-id files of independent zstandard frames.

File layout, all numbers little-endian:

* frames: each an ordinary zstandard frame of about ``FRAME_TOKENS`` token ids (2 or 4 bytes each);
  documents follow one another in id order and may run over frame borders;
* document index, a skippable frame (magic 0x184D2A50): item size, number of documents, then
  zstandard-compressed arrays of ids (int64), null marks (uint8) and token counts (int64);
* seek table, a skippable frame (magic 0x184D2A5E): for every frame before it the compressed size,
  the decompressed size (0 for the index) and the low half of the XXH64 of its content, then the
  number of frames, a descriptor byte (0x80: checksums present) and the magic 0x8F92EAB1.

A reader fetches the seek table and the index from the end of the file and decompresses only the
frames that hold the documents asked for, verifying each frame's checksum. Plain zstandard tools
can read the file too; they skip the two tables.

Each task writes one file under a name of its own, moves it into place and reports it; only files in
the manifest count, so a lost executor costs a task and never a wrong file.

Edge cases: null and empty texts are a lone end token; a null id sorts first and is kept as null;
repeated rows are written as often as they appear; an empty table gives an empty manifest; other
columns are ignored whatever their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.encoding import ship
from quern.llm.shared import land, slices

FRAME_TOKENS = 1 << 17
#: Bytes of text that are encoded in one call.
ENCODE_BYTES = 1 << 20
INDEX_MAGIC, SEEK_MAGIC, SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
MANIFEST = "part int, file string, n_docs long, n_tokens long, n_bytes long"


# ---------------------------------------------------------------- one file


class Writer:
    def __init__(self, sink, item: int = 4, frame_tokens: int = FRAME_TOKENS, level: int = 3):
        self.sink, self.item, self.frame_tokens = sink, item, frame_tokens
        self.press = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.rest: list[np.ndarray] = []
        self.held = self.tokens = self.bytes = 0
        self.seek: list[tuple[int, int, int]] = []
        self.ids, self.nulls, self.counts = [], [], []

    def add(self, ids: pa.Array, tokens: np.ndarray, counts: np.ndarray) -> None:
        self.ids.append(np.asarray(ids.fill_null(0).to_numpy(zero_copy_only=False), "<i8"))
        self.nulls.append(np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.uint8))
        self.counts.append(np.asarray(counts, "<i8"))
        self.rest.append(tokens)
        self.held += len(tokens)
        self.tokens += len(tokens)
        if self.held >= self.frame_tokens:
            data, at = np.concatenate(self.rest), 0
            while len(data) - at >= self.frame_tokens:
                self._frame(data[at : at + self.frame_tokens])
                at += self.frame_tokens
            self.rest, self.held = [data[at:]], len(data) - at

    def _put(self, data: bytes, plain: int, check: int) -> None:
        self.sink.write(data)
        self.bytes += len(data)
        self.seek.append((len(data), plain, check & 0xFFFFFFFF))

    def _frame(self, tokens: np.ndarray) -> None:
        if len(tokens) and int(tokens.max()) >> 8 * self.item:
            raise ValueError(f"token id {int(tokens.max())} does not fit {self.item} bytes")
        raw = tokens.astype(f"<u{self.item}").tobytes()
        self._put(self.press.compress(raw), len(raw), xxhash.xxh64_intdigest(raw))

    def close(self) -> int:
        """Write what is left and the two tables; returns the number of documents."""
        if self.held:
            self._frame(np.concatenate(self.rest))
        columns = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((self.ids, "<i8"), (self.nulls, np.uint8), (self.counts, "<i8"))]
        index = struct.pack("<IQ", self.item, len(columns[0])) + self.press.compress(b"".join(c.tobytes() for c in columns))
        self._put(struct.pack("<II", INDEX_MAGIC, len(index)) + index, 0, xxhash.xxh64_intdigest(index))
        table = b"".join(struct.pack("<III", *entry) for entry in self.seek) + struct.pack("<IBI", len(self.seek), 0x80, SEEK_END)
        self.sink.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)
        self.bytes += 8 + len(table)
        return len(columns[0])


class Reader:
    """Random access to one file (``source``: seekable, with read and size)."""

    def __init__(self, source):
        self.source = source
        size = source.size() if callable(getattr(source, "size", None)) else source.seek(0, 2)
        frames, descriptor, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_END or descriptor != 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        head = struct.unpack("<II", self._at(size - 9 - 12 * frames - 8, 8))
        if head != (SEEK_MAGIC, 12 * frames + 9):
            raise ValueError("the seek table is damaged")
        entries = np.frombuffer(self._at(size - 9 - 12 * frames, 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.place = np.cumsum(entries[:, 0]) - entries[:, 0]
        index = self._at(int(self.place[-1]), int(entries[-1, 0]))
        if struct.unpack("<I", index[:4])[0] != INDEX_MAGIC or xxhash.xxh64_intdigest(index[8:]) & 0xFFFFFFFF != entries[-1, 2]:
            raise ValueError("the document index is damaged")
        self.item, n = struct.unpack("<IQ", index[8:20])
        columns = zstandard.ZstdDecompressor().decompress(index[20:], max_output_size=17 * n) if n else b""
        self.ids, self.nulls = np.frombuffer(columns, "<i8", n), np.frombuffer(columns, np.uint8, n, 8 * n)
        self.counts = np.frombuffer(columns[9 * n :], "<i8", n)
        self.ends = np.cumsum(self.counts)
        self.entries = entries[:-1]
        #: first token of each frame, and the end
        self.first = np.concatenate([[0], np.cumsum(self.entries[:, 1] // self.item)])
        self.decompressed = 0

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def frame(self, k: int) -> np.ndarray:
        packed, plain, check = self.entries[k].tolist()
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.place[k]), packed), max_output_size=plain)
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        self.decompressed += 1
        return np.frombuffer(raw, f"<u{self.item}").astype("<u4")

    def documents(self, rows: Sequence[int]) -> Iterator[np.ndarray]:
        """The ids of the documents at these places of the file, decompressing only their frames."""
        kept: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))
        for row in rows:
            begin, end = int(self.ends[row] - self.counts[row]), int(self.ends[row])
            parts = []
            for k in range(int(np.searchsorted(self.first, begin, "right")) - 1, int(np.searchsorted(self.first, end, "left"))):
                kept = kept if kept[0] == k else (k, self.frame(k))
                base = int(self.first[k])
                parts.append(kept[1][max(0, begin - base) : end - base])
            yield parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def digests(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of (rows, starts, crc32) of documents, one frame in memory at a time."""
        row, crc, n = 0, 0, len(self.counts)
        for k in range(len(self.entries)):
            base, raw, rows, out = int(self.first[k]), memoryview(self.frame(k)).cast("B"), [], []
            stop = int(self.first[k + 1])
            at = base
            while row < n and (self.ends[row] <= stop):
                end = int(self.ends[row])
                rows.append(row)
                out.append(zlib.crc32(raw[4 * (at - base) : 4 * (end - base)], crc))
                row, crc, at = row + 1, 0, end
            if at < stop:
                crc = zlib.crc32(raw[4 * (at - base) :], crc)
            rows = np.array(rows, np.int64)
            yield rows, (self.ends - self.counts)[rows], np.array(out, np.int64)


# ---------------------------------------------------------------- over DataFrames


def write_files(
    docs: DataFrame,
    tokenizer: str,
    root: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    pattern: str | None = None,
    item: int = 4,
    frame_tokens: int = FRAME_TOKENS,
) -> DataFrame:
    """Encode whole texts into files under ``root``, in ascending id order over parts; returns the manifest.

    ``tokenizer`` is a file on the driver (see ``encoding.Encoder``; ``pattern`` for rank files), ``root`` a folder that
    executors share, by any address Arrow's file systems know. A vocabulary with ids beyond ``item`` bytes is refused.
    """
    shipped = ship(docs.sparkSession, tokenizer, end_id, pattern)
    if shipped.encoder().largest >> 8 * item:
        raise ValueError(f"the tokenizer has ids that do not fit {item} bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shipped.encoder()
        fs, folder = pafs.FileSystem.from_uri(root)
        part, name = TaskContext.get().partitionId(), ""
        sink = writer = None
        for batch in batches:
            for piece in slices(batch, "text", ENCODE_BYTES):
                if writer is None:
                    fs.create_dir(folder, recursive=True)
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.tokens"
                    sink = fs.open_output_stream(f"{folder}/.{name}")
                    writer = Writer(sink, item, frame_tokens)
                writer.add(piece.column("id"), *encoder.encode(piece.column("text")))
        if writer is not None:
            n_docs = writer.close()
            sink.close()
            fs.move(f"{folder}/.{name}", f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"{root}/{name}"], "n_docs": [n_docs], "n_tokens": [writer.tokens], "n_bytes": [writer.bytes]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # texts break ties between rows of one id, so a repeated id neither piles up nor moves on a retry
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "text")
    return land(rows.select("id", "text").mapInArrow(run, MANIFEST), "manifest")


def read_digests(manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) for every document, from the files of a manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, path = pafs.FileSystem.from_uri(file)
                with fs.open_input_file(path) as source:
                    reader = Reader(source)
                    for rows, starts, crc in reader.digests():
                        ids = pa.array(reader.ids[rows], pa.int64(), mask=reader.nulls[rows].astype(bool))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(starts + base), pa.array(reader.counts[rows]), pa.array(crc)], ["id", "start", "n_tokens", "ids_crc32"])

    # one row a file: the running total of a short table
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    files = manifest.withColumn("base", before).select("file", "base")
    return files.repartition(max(1, manifest.count())).mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")
