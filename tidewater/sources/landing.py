"""Fetching files from the web to a landing folder, on the driver; Spark reads them from there."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from pathlib import Path


def fetch(url: str, to: str, *, headers: dict[str, str] | None = None, params: dict[str, str] | None = None, tries: int = 3, delay: float = 5.0, opener: Callable = urllib.request.urlopen) -> Path:
    """Write the reply's bytes to a file. Not found is an error at once; other failures are tried again."""
    if params:
        url = f"{url}?{urllib.parse.urlencode(params)}"
    request = urllib.request.Request(url, headers=headers or {})
    for at in range(tries):
        try:
            with opener(request) as reply:
                out = Path(to)
                out.parent.mkdir(parents=True, exist_ok=True)
                out.write_bytes(reply.read())
                return out
        except urllib.error.HTTPError as e:
            if e.code == 404 or at + 1 == tries:
                raise
        except OSError:
            if at + 1 == tries:
                raise
        time.sleep(delay)
    raise ValueError("tries must be 1 or more")


def fetch_json(url: str, to: str, **options):
    return json.loads(fetch(url, to, **options).read_text())


def batches(ids: list[str], key: str | None) -> list[list[str]]:
    """Series ids by request: 50 with a key, 25 without."""
    size = 50 if key else 25
    return [ids[a : a + size] for a in range(0, len(ids), size)]
