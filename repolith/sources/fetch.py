"""Pages of a forge's interface, fetched and saved as the JSON files that ``payloads`` reads."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

# Seconds to wait for an answer, and after a refusal because of too many requests.
TIMEOUT, PAUSE = 15, 60


class FetchError(RuntimeError):
    """The forge did not give what was asked for."""


class NotFound(FetchError):
    """There is no such thing, or it may not be seen."""


class RateLimited(FetchError):
    """Too many requests, also after the pause."""


def _limited(e: urllib.error.HTTPError) -> bool:
    return e.code == 429 or e.code == 403 and e.headers.get("X-RateLimit-Remaining") == "0"


def get(url: str, token: str | None = None, opener: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep) -> object:
    """The document at an address; after a refusal because of too many requests it is asked for once more, a minute later."""
    asked = urllib.request.Request(url, headers={"Accept": "application/json", **({"Authorization": f"Bearer {token}"} if token else {})})
    for last in (False, True):
        try:
            with opener(asked, timeout=TIMEOUT) as reply:
                return json.loads(reply.read().decode("utf-8"))
        except urllib.error.HTTPError as e:
            if e.code == 404:
                raise NotFound(url) from e
            if not _limited(e):
                raise FetchError(f"{e.code} from {url}") from e
            if last:
                raise RateLimited(url) from e
            sleep(PAUSE)
        except (urllib.error.URLError, TimeoutError, ValueError) as e:
            raise FetchError(f"{url}: {e}") from e
    raise AssertionError


def pages(url: str, token: str | None = None, per_page: int = 100, max_pages: int = 10, **how) -> Iterator[list]:
    """The pages of a list: they end at one that is short, empty or no list, and after ``max_pages``."""
    joint = "&" if urllib.parse.urlsplit(url).query else "?"
    for number in range(1, max_pages + 1):
        page = get(f"{url}{joint}per_page={per_page}&page={number}", token, **how)
        if not isinstance(page, list) or not page:
            return
        yield page
        if len(page) < per_page:
            return


def save(url: str, folder: str, name: str, token: str | None = None, per_page: int = 100, max_pages: int = 10, **how) -> int:
    """Save a list's pages as ``NAME__N.json``, ``/`` in the name as ``__``; gives the number of items."""
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    count = 0
    for number, page in enumerate(pages(url, token, per_page, max_pages, **how), 1):
        (at / f"{name.replace('/', '__')}__{number}.json").write_text(json.dumps(page, ensure_ascii=False), encoding="utf-8")
        count += len(page)
    return count
