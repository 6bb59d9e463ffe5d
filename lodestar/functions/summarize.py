"""Summaries of conversations: a remote service behind an interface, with the
first words as the way out."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from typing import Protocol

#: Bytes of a conversation that a prompt holds from its head and its tail.
HEAD, TAIL = 24_000, 8_000


class Refused(RuntimeError):
    """The service declined to summarise."""


class Summarizer(Protocol):
    def summarize(self, title: str, text: str) -> str: ...


def elide(text: str, head: int = HEAD, tail: int = TAIL) -> str:
    """The first ``head`` and last ``tail`` bytes of a long text, cut between
    characters, with a note of how much was left out."""
    data = text.encode()
    if len(data) <= head + tail:
        return text
    first, last = data[:head].decode(errors="ignore"), data[-tail:].decode(errors="ignore")
    left = len(data) - len(first.encode()) - len(last.encode())
    return f"{first}\n\n[{left} bytes left out]\n\n{last}"


def first_words_of(text: str, n: int = 60) -> str:
    words = text.split()
    return " ".join(words[:n]) + ("…" if len(words) > n else "")


class HttpSummarizer:
    """Asks a chat service that takes ``{"model", "max_tokens", "messages"}`` and
    answers with blocks ``{"content": [{"text"}]}`` or ``{"choices": [{"message":
    {"content"}}]}``. Too many requests, server errors and lost connections are
    tried again; a refusal is an error of its own."""

    ASK = "Summarise this conversation in two or three sentences: what was asked, what was decided."

    def __init__(self, url: str, model: str, headers: dict[str, str] | None = None, waits: tuple[float, ...] = (1, 2, 4)) -> None:
        self.url, self.model, self.headers, self.waits = url, model, headers or {}, waits

    @classmethod
    def from_environment(cls) -> HttpSummarizer | None:
        """By ``LODESTAR_SUMMARY_URL``, ``_MODEL`` and ``_KEY``; None where no
        address is set."""
        url = os.environ.get("LODESTAR_SUMMARY_URL")
        key = os.environ.get("LODESTAR_SUMMARY_KEY", "")
        return cls(url, os.environ.get("LODESTAR_SUMMARY_MODEL", ""), {"Authorization": f"Bearer {key}"} if key else {}) if url else None

    def _post(self, body: bytes) -> dict:
        head = {"Content-Type": "application/json", **self.headers}
        for wait in (*self.waits, None):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, body, head), timeout=60) as r:
                    return json.load(r)
            except urllib.error.HTTPError as e:
                if wait is None or not (e.code == 429 or e.code >= 500):
                    raise
            except urllib.error.URLError:
                if wait is None:
                    raise
            time.sleep(wait)
        raise AssertionError

    def summarize(self, title: str, text: str) -> str:
        prompt = f"{self.ASK}\n\nTitle: {title}\n\n{elide(text)}"
        body = {"model": self.model, "max_tokens": 400, "messages": [{"role": "user", "content": prompt}]}
        got = self._post(json.dumps(body).encode())
        choice = (got.get("choices") or [{}])[0]
        if "refusal" in (got.get("stop_reason"), choice.get("finish_reason")) or choice.get("message", {}).get("refusal"):
            raise Refused(title)
        parts = [b.get("text") or "" for b in got.get("content") or [] if isinstance(b, dict)]
        answer = "".join(parts) or choice.get("message", {}).get("content") or ""
        if not answer.strip():
            raise Refused(title)
        return answer.strip()


def summary_of(service: Summarizer | None, title: str, text: str, first_user: str) -> tuple[str, bool]:
    """(summary, failed): the service's, or the first words of the first user
    turn where there is no service or it fails."""
    if service is not None:
        try:
            return service.summarize(title, text), False
        except Exception:  # whatever is wrong with the service, the card is written
            return first_words_of(first_user), True
    return first_words_of(first_user), False
