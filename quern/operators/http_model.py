"""A model served over HTTP as backend for ``embedding.embed`` and as client for ``language.generate``.

The service speaks the common JSON protocol of local model servers: ``POST /api/embeddings`` (model,
prompt), ``POST /api/chat`` (model, messages, stream, options) and ``GET /api/tags``. An object is built in
the worker that uses it: ``embed(rows, model, lambda: HttpModel(address, name).embed)``.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class HttpModel:
    address: str
    model: str
    timeout: float = 120.0
    options: dict = field(default_factory=dict)

    def _open(self, path: str, body: dict | None = None):
        data = None if body is None else json.dumps({"model": self.model, **body}).encode()
        request = urllib.request.Request(f"{self.address.rstrip('/')}{path}", data, {"Content-Type": "application/json"})
        return urllib.request.urlopen(request, timeout=self.timeout)  # noqa: S310  the address is the user's own

    def embed(self, texts: list[str]) -> np.ndarray:
        """One request a text, as the protocol has it."""
        out = []
        for text in texts:
            with self._open("/api/embeddings", {"prompt": text}) as reply:
                out.append(json.load(reply)["embedding"])
        return np.array(out, float)

    def chat(self, messages: list[dict[str, str]]) -> str:
        with self._open("/api/chat", {"messages": messages, "stream": False, "options": self.options}) as reply:
            return json.load(reply)["message"]["content"]

    def stream(self, messages: list[dict[str, str]]) -> Iterator[str]:
        """The reply piece by piece."""
        with self._open("/api/chat", {"messages": messages, "stream": True, "options": self.options}) as reply:
            for line in reply:
                piece = json.loads(line) if line.strip() else {}
                if piece.get("message", {}).get("content"):
                    yield piece["message"]["content"]
                if piece.get("done"):
                    return

    def available(self) -> bool:
        """Does the service answer, and know the model?"""
        try:
            with self._open("/api/tags") as reply:
                names = {m["name"] for m in json.load(reply).get("models", [])}
        except (OSError, urllib.error.URLError, ValueError):
            return False
        return self.model in names or f"{self.model}:latest" in names
