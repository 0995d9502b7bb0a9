"""Embedding models as connectors: HTTP providers, failover between two, and embedding whole tables."""

from __future__ import annotations

import hashlib
import json
import struct
import time
import urllib.request
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    id: str

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


def provider_id(prefix: str, model: str, endpoint: str, dimension: int | None = None) -> str:
    """Stable for the same model at the same place."""
    digest = hashlib.sha256("\x1f".join((prefix, model, endpoint, str(dimension or ""))).encode()).hexdigest()
    return f"{prefix}:{model}:{digest[:12]}"


def post(url: str, body: dict, headers: dict[str, str], timeout: float = 30) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


@dataclass
class HttpEmbedder:
    """kind "openai": {input, model} to data[].embedding; "local": {texts} to embeddings; "gemini": batched requests to embeddings[].values."""

    kind: str
    url: str
    model: str
    key: str | None = None
    dimension: int | None = None
    send: Callable[[str, dict, dict[str, str]], dict] = post

    @property
    def id(self) -> str:
        return provider_id(self.kind, self.model, self.url, self.dimension)

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        headers = {"x-goog-api-key": self.key or ""} if self.kind == "gemini" else {"Authorization": f"Bearer {self.key}"} if self.key else {}
        if self.kind == "gemini":
            parts = [{"model": self.model, "content": {"parts": [{"text": t}]}} for t in texts]
            vectors = [e["values"] for e in self.send(self.url, {"requests": parts}, headers)["embeddings"]]
        elif self.kind == "openai":
            rows = self.send(self.url, {"model": self.model, "input": list(texts)}, headers)["data"]
            vectors = [r["embedding"] for r in sorted(rows, key=lambda r: r.get("index", 0))]
        else:
            vectors = self.send(self.url, {"model": self.model, "texts": list(texts)}, headers)["embeddings"]
        if len(vectors) != len(texts) or any(self.dimension and len(v) != self.dimension for v in vectors):
            raise ValueError("the provider's answer doesn't fit the request")
        return vectors


@dataclass
class Failover:
    """The first provider while it works; the second after a failure, until the first answers again."""

    primary: Embedder
    fallback: Embedder
    cooldown: float = 30.0
    clock: Callable[[], float] = time.monotonic
    _down_until: float = field(default=-1.0, init=False)

    @property
    def degraded(self) -> bool:
        return self._down_until >= 0

    @property
    def id(self) -> str:
        return (self.fallback if self.degraded and self.clock() < self._down_until else self.primary).id

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        if not self.degraded or self.clock() >= self._down_until:
            try:
                out = self.primary.embed(texts)
                self._down_until = -1.0
                return out
            except Exception:
                self._down_until = self.clock() + max(1.0, self.cooldown)
        return self.fallback.embed(texts)


def encode_vector(vector: Sequence[float]) -> bytes:
    """32-bit floats, least byte first, as vectors are stored outside Parquet."""
    return struct.pack(f"<{len(vector)}f", *vector)


def decode_vector(data: bytes) -> list[float]:
    return list(struct.unpack(f"<{len(data) // 4}f", data))


def embed_table(rows: DataFrame, make: Callable[[], Embedder], batch: int = 16) -> DataFrame:
    """(memory_id, provider_id, vector, content_hash, status) of rows (id, content, hash).

    make runs in each task. A batch that fails is marked failed; the others go on.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        model = make()
        for part in batches:
            for at in range(0, len(part), batch):
                some = part.slice(at, batch)
                try:
                    vectors, status = model.embed(some.column(1).to_pylist()), "ready"
                except Exception:
                    vectors, status = [None] * len(some), "failed"
                n = len(some)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([model.id] * n), pa.array(vectors, pa.list_(pa.float32())), some.column(2), pa.array([status] * n)], names=["memory_id", "provider_id", "vector", "content_hash", "status"])

    return rows.select("id", F.col("content"), "hash").mapInArrow(run, f"memory_id {kind}, provider_id string, vector array<float>, content_hash string, status string")
