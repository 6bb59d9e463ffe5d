"""Model files from an address, kept by checksum."""

from __future__ import annotations

import hashlib
import os
import tempfile
import urllib.request
from collections.abc import Callable


def fetch(url: str, sha256: str, folder: str, progress: Callable[[int], None] | None = None) -> str:
    """The path of a file with the given SHA-256 below ``folder``, downloaded if it
    is not there. A file is moved into place when it is whole and its checksum is
    right, so no reader meets half of one. A checksum is required. ``progress``
    is told the bytes so far."""
    if len(sha256) != 64 or not set(sha256.lower()) <= set("0123456789abcdef"):
        raise ValueError("a SHA-256 checksum is needed")
    path = os.path.join(folder, f"{sha256.lower()[:16]}-{os.path.basename(url.split('?')[0]) or 'model'}")
    if os.path.exists(path) and _checksum(path) == sha256.lower():
        return path
    os.makedirs(folder, exist_ok=True)
    handle, aside = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "wb") as out, urllib.request.urlopen(url, timeout=60) as got:
            done = 0
            while block := got.read(1 << 20):
                out.write(block)
                done += len(block)
                if progress:
                    progress(done)
        found = _checksum(aside)
        if found != sha256.lower():
            raise ValueError(f"{url}: checksum {found} instead of {sha256}")
        os.replace(aside, path)
    finally:
        if os.path.exists(aside):
            os.remove(aside)
    return path


def _checksum(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
