"""Remote embedding over an HTTP API with batches and retries."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request

import numpy as np

from lodestar.functions.embed import normalize


class HttpEmbedder:
    """Posts ``{"model", "input"}`` and reads ``{"data": [{"index",
    "embedding"}]}``; answers may come in any order. Too many requests, server
    errors and lost connections are tried again, other errors are not."""

    def __init__(self, url: str, model: str, dims: int, key: str = "", batch: int = 2048, waits: tuple[float, ...] = (1, 2, 4)) -> None:
        self.url, self.model, self.dims, self.key, self.batch, self.waits = url, model, dims, key, batch, waits
        self.ident = f"http:{model}:{dims}"

    def _post(self, texts: list[str]) -> list[dict]:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        body = json.dumps({"model": self.model, "input": texts}).encode()
        for wait in (*self.waits, None):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, body, head), timeout=60) as r:
                    return json.load(r)["data"]
            except urllib.error.HTTPError as e:
                if wait is None or not (e.code == 429 or e.code >= 500):
                    raise
            except urllib.error.URLError:
                if wait is None:
                    raise
            time.sleep(wait)
        raise AssertionError

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        out = [np.zeros(self.dims, np.float32) for _ in texts]
        full = [i for i, t in enumerate(texts) if t and t.strip()]
        for k in range(0, len(full), self.batch):
            part = full[k : k + self.batch]
            for x in self._post([texts[i] for i in part]):
                v = np.asarray(x["embedding"], np.float32)
                if len(v) != self.dims:
                    raise ValueError(f"expected {self.dims} dimensions, got {len(v)}")
                out[part[x["index"]]] = normalize(v)
        return out
