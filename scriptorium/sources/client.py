"""Clients of servers and models: retries with growing pauses, spacing by host, and growing budgets.

The call itself is given by the caller, so that nothing here opens a connection of its own.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.udf import vectorised

# Answers after which another try may help; pauses of 0.8 seconds, doubled each time, 8 at most.
RETRIED = {408, 425, 429, 500, 502, 503, 504, 521, 522, 524}
FIRST_PAUSE, LONGEST_PAUSE = 0.8, 8.0


def pauses(retries: int) -> list[float]:
    return [min(LONGEST_PAUSE, FIRST_PAUSE * 2**n) for n in range(retries)]


def text_of(body: bytes, named: str = "") -> str:
    """A page's text: the encoding that was named unless it is the protocol's default, else that of the page, else UTF-8 with replacements."""
    from scriptorium.sources.readers import decode

    if named and named.lower() not in ("iso-8859-1", "ascii"):
        try:
            return body.decode(named, "replace")
        except LookupError:
            pass
    return decode(body)


def fetch_one(url: str, get: Callable[[str], tuple[int, bytes, str]], retries: int = 4, sleep: Callable[[float], None] = time.sleep) -> tuple[int, str | None, int]:
    """(status, text or null, tries) of one URL; get gives status, body and named encoding, or raises (SRC-20).

    An OSError is tried again as a bad status is; any other error is the URL's own and gives status 0 at once.
    """
    status = 0
    for n, pause in enumerate([*pauses(retries), None], 1):
        try:
            status, body, named = get(url)
        except OSError:
            status = 0
        except Exception:  # a malformed URL raises what the caller's client likes to
            return 0, None, n
        else:
            if status not in RETRIED:
                return status, text_of(body, named) if status < 400 else None, n
        if pause is not None:
            sleep(pause)
    return status, None, retries + 1


def host_of(url: str | None) -> str:
    """A URL's host, empty for what is none."""
    try:
        return urlparse(url or "").netloc
    except ValueError:
        return ""


def fetch(urls: DataFrame, get: Callable[[str], tuple[int, bytes, str]], retries: int = 4, spacing: float = 0.4, sleep: Callable[[float], None] = time.sleep, url: str = "url") -> DataFrame:
    """(url, status, text, tries). A host's URLs go to one task, which keeps `spacing` seconds between its calls. What is no URL, null too, gets status 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        due: dict[str, float] = {}
        for pdf in batches:
            rows = []
            for u in pdf["url"]:
                host = host_of(u)
                if (wait := due.get(host, 0.0) - time.monotonic()) > 0:
                    sleep(wait)
                due[host] = time.monotonic() + spacing
                rows.append((u, *fetch_one(u, get, retries, sleep)))
            yield pd.DataFrame(rows, columns=["url", "status", "text", "tries"])

    host = F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1)
    return urls.select(F.col(url).alias("url")).repartition(host).mapInPandas(run, "url string, status int, text string, tries int")


def ask(call: Callable[[int], tuple[str, str]], budget: int = 3000, tries: int = 3) -> str:
    """A model's answer (OPS-11): one that was cut off for its length is asked for again with twice the budget and 2000 more; of cut ones the longest counts."""
    longest = ""
    for _ in range(tries):
        text, finish = call(budget)
        longest = max(longest, text, key=len)
        if finish != "length":
            return text or longest
        budget = 2 * budget + 2000
    return longest


def absolute_link(link: str | None, base: str) -> str:
    """A link against its page; what is no URL stays as it is (SCL-22)."""
    try:
        return urljoin(base, link) if link else ""
    except ValueError:
        return link or ""


_BARE_VALUE = re.compile(r"""\[\s*(?P<name>[\w-]+)\s*=\s*(?P<value>[^\]"'][^\]]*)\]""")


def quoted_selector(selector: str) -> str:
    """A selector with the attribute values quoted that are not (SCL-22)."""
    quoted = lambda m: '[{}="{}"]'.format(m["name"], m["value"].strip().replace('"', '\\"'))
    return _BARE_VALUE.sub(quoted, selector)


@vectorised("string")
def quoted_selectors(selectors: pd.Series) -> pd.Series:
    return selectors.map(quoted_selector, na_action="ignore")


@vectorised("string")
def absolute_links(links: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([absolute_link(x, b or "") for x, b in zip(links, bases)], dtype=object)
