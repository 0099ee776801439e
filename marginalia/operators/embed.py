"""Embedders: anything with ``embed(texts)`` and ``health()`` that can be pickled."""

from __future__ import annotations

import json
import math
import re
import urllib.request
import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.session import ship


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...

    def health(self) -> bool: ...


@dataclass
class HashingEmbedder:
    """Signed hashing of words to a unit vector: deterministic and offline."""

    size: int = 64

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.size
            for w in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(w.encode())
                v[h % self.size] += 1.0 if h & 0x80000000 else -1.0
            norm = math.sqrt(sum(x * x for x in v))
            out.append([x / norm for x in v] if norm else v)
        return out

    def health(self) -> bool:
        return True


@dataclass
class HttpEmbedder:
    """An embedding server: POST {model, prompt} to ``/api/embeddings``."""

    url: str
    model: str
    timeout: float = 120.0
    probe_timeout: float = 5.0

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            body = json.dumps({"model": self.model, "prompt": text}).encode()
            request = urllib.request.Request(f"{self.url.rstrip('/')}/api/embeddings", body, {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                out.append([float(x) for x in json.load(reply)["embedding"]])
        return out

    def health(self) -> bool:
        try:
            with urllib.request.urlopen(f"{self.url.rstrip('/')}/api/tags", timeout=self.probe_timeout) as reply:
                return 200 <= reply.status < 300
        except OSError:
            return False


def embed(chunks: DataFrame, embedder: Embedder, partitions: int | None = None, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """key, embedding: an Arrow UDF over batches of texts. ``partitions`` spreads slow calls."""
    ship(chunks.sparkSession)

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series(embedder.embed(texts.tolist()))

    rows = chunks.select(key, text)
    rows = rows.repartition(partitions) if partitions else rows
    return rows.select(key, vectors(F.col(text)).alias("embedding"))
