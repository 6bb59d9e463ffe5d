"""Embedders: text to unit vectors of a fixed length."""

from __future__ import annotations

import json
import struct
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import index_tokens


class Embedder(Protocol):
    ident: str
    dims: int

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        """Unit vectors in order; a text without tokens gives a zero vector."""
        ...


def normalize(v: np.ndarray) -> np.ndarray:
    n = float(np.sqrt((v.astype(np.float64) ** 2).sum()))
    return v.astype(np.float32) if n == 0 else (v / n).astype(np.float32)


class HashEmbedder:
    """Mean of pseudo-random token vectors: needs no weights, same on every
    worker. It knows equal words, not meaning."""

    def __init__(self, dims: int = 64) -> None:
        self.dims, self.ident = dims, f"builtin-hash:{dims}"

    def _row(self, token: str) -> np.ndarray:
        return np.random.default_rng(xxhash.xxh64_intdigest(token)).standard_normal(self.dims).astype(np.float32)

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        memo: dict[str, np.ndarray] = {}
        out = []
        for t in texts:
            total = np.zeros(self.dims, np.float32)
            tokens = index_tokens(t or "")
            for w in tokens:
                if w not in memo:
                    memo[w] = self._row(w)
                total += memo[w]
            out.append(normalize(total / max(len(tokens), 1)))
        return out


def read_safetensors(path: str) -> np.ndarray:
    """The one two-dimensional float32 tensor of a file."""
    with open(path, "rb") as f:
        raw = f.read()
    if len(raw) < 8:
        raise ValueError("file too short")
    (n,) = struct.unpack("<Q", raw[:8])
    if n > len(raw) - 8:
        raise ValueError("header beyond the file")
    head = {k: v for k, v in json.loads(raw[8 : 8 + n]).items() if k != "__metadata__"}
    found = [v for v in head.values() if v.get("dtype") == "F32" and len(v.get("shape", ())) == 2]
    if len(head) != 1 or len(found) != 1:
        raise ValueError("expected exactly one two-dimensional F32 tensor")
    rows, cols = found[0]["shape"]
    a, b = found[0]["data_offsets"]
    if b - a != rows * cols * 4 or 8 + n + b > len(raw):
        raise ValueError("offsets do not fit the shape")
    return np.frombuffer(raw, "<f4", rows * cols, 8 + n + a).reshape(rows, cols)


class StaticEmbedder:
    """Mean of a token matrix's rows, tokenised by a tokenizer file."""

    def __init__(self, tokenizer_json: str, safetensors: str, ident: str = "static") -> None:
        self.matrix = read_safetensors(safetensors)
        self.dims, self.tokenizer_json = self.matrix.shape[1], tokenizer_json
        self.ident = f"{ident}:{self.dims}"

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(self.tokenizer_json)
        out = []
        for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False):
            ids = [i for i in e.ids if 0 <= i < len(self.matrix)]
            out.append(normalize(self.matrix[ids].mean(0)) if ids else np.zeros(self.dims, np.float32))
        return out


def embed_column(df: DataFrame, text: str, embedder: Embedder, out: str = "vec") -> DataFrame:
    """Adds unit vectors; the embedder is broadcast (bounded by its model)."""
    shared = df.sparkSession.sparkContext.broadcast(embedder)

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([v.tolist() for v in shared.value.embed(list(texts))], dtype=object)

    return df.withColumn(out, run(F.col(text)))


def encode_vector(v: list[float]) -> bytes:
    return np.asarray(v, "<f4").tobytes()


def decode_vector(raw: bytes, dims: int) -> list[float]:
    if len(raw) != dims * 4:
        raise ValueError(f"{len(raw)} bytes are no vector of {dims}")
    return np.frombuffer(raw, "<f4").tolist()
