"""Token ids of whole texts, by tokenizers whose files are shipped to the executors."""

from __future__ import annotations

import base64
import hashlib
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import SparkSession

from quern.llm.shared import BROADCAST_BYTES


class Encoder:
    """A tokenizer from the content of its file: ``.json`` for tokenizers, ``.tiktoken`` ranks with the splitting pattern for tiktoken."""

    def __init__(self, blob: bytes, pattern: str | None, end_id: int):
        self.end = end_id
        if pattern is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(blob.decode())
            self._all = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self.largest = max([end_id, *tokenizer.get_vocab().values()])
        else:
            import tiktoken

            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, blob.splitlines())}
            encoding = tiktoken.Encoding("shipped", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self._all = lambda texts: [encoding.encode_to_numpy(t, disallowed_special=()) for t in texts]
            self.largest = max([end_id, *ranks.values()])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, the end id after each, and how many each text has; null reads as empty."""
        found = [np.asarray(ids, np.uint32) for ids in self._all([t or "" for t in texts.to_pylist()])]
        counts = np.array([len(ids) for ids in found], np.int64)
        return np.insert(np.concatenate([np.zeros(0, np.uint32), *found]), np.cumsum(counts), self.end), counts + 1


#: The encoders of this worker process, kept from task to task.
_encoders: dict[tuple, Encoder] = {}


@dataclass(frozen=True)
class Shipped:
    """A tokenizer's file on its way to the executors, which need not have it."""

    blob: Broadcast
    key: tuple
    pattern: str | None
    end_id: int

    def encoder(self) -> Encoder:
        if self.key not in _encoders:
            _encoders.clear()
            _encoders[self.key] = Encoder(self.blob.value, self.pattern, self.end_id)
        return _encoders[self.key]


def ship(spark: SparkSession, path: str, end_id: int, pattern: str | None = None) -> Shipped:
    with open(path, "rb") as file:
        blob = file.read(BROADCAST_BYTES + 1)
    if len(blob) > BROADCAST_BYTES:
        raise ValueError("the tokenizer's file is too large to broadcast")
    return Shipped(spark.sparkContext.broadcast(blob), (hashlib.sha256(blob).hexdigest(), pattern, end_id), pattern, end_id)
