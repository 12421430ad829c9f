"""Fetching behind a small protocol, with retries; a table of pages can play the network."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom import config
from textloom.functions import html as H

RESPONSE = "url string, http_status int, content_type string, raw_html string, fetch_timestamp string"
#: Answers of a firewall: worth a try with a browser.
BLOCKED = (401, 403, 429, 503)


class Response(NamedTuple):
    status: int
    content_type: str
    body: str


Fetch = Callable[[str], Response]


def with_retries(fetch: Fetch, tries: int = config.SETTINGS.max_retries, base: float = config.SETTINGS.retry_backoff_base, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], Response | None]:
    """Exceptions and statuses from 500 are tried again after base ** n seconds, n the tries so far; the last try's answer counts, and an exception there is None."""

    def run(url: str) -> Response | None:
        for tried in range(1, tries + 1):
            try:
                got = fetch(url)
            except Exception:  # tried again
                got = None
            if tried == tries or got and got.status < 500:
                return got
            sleep(base**tried)
        return None

    return run


class Browser:
    """A renderer of pages, started at the first need; once starting or rendering fails it stays off, and pages keep what plain calls gave.

    ``start()`` returns a function from a url to the rendered HTML.
    """

    def __init__(self, start: Callable[[], Callable[[str], str]]):
        self.start, self.draw, self.off = start, None, False

    def render(self, url: str) -> str | None:
        if self.off:
            return None
        try:
            self.draw = self.draw or self.start()
            return self.draw(url) or None
        except Exception:  # no browser here, or a broken one
            self.off = True
            return None


def with_browser(fetch: Fetch, browser: Browser, always: bool = False) -> Callable[[str], Response | None]:
    """HTML by a plain call, by the browser where a firewall or something other than HTML answered or the call failed; None if neither gives HTML.

    ``always`` leaves out the plain call. Other errors (404, 500, ..) are not tried again by the browser.
    """

    def drawn(url: str) -> Response | None:
        html = browser.render(url)
        return Response(200, "text/html", html) if html else None

    def run(url: str) -> Response | None:
        if always:
            return drawn(url)
        try:
            got = fetch(url)
        except Exception:  # as good as blocked
            got = None
        if got is None:
            return drawn(url)
        if got.status < 400 and "text/html" in (got.content_type or "").lower() and holds_html(got.body):
            return got
        return drawn(url) if got.status < 400 or got.status in BLOCKED else None

    return run


def holds_html(body: str | None) -> bool:
    """``html.looks_like_html`` for one text in Python."""
    head = (body or "")[:4000].lower()
    return any(tag in head for tag in ("<html", "<body", "<div", "<a ", "<p>"))


def host(url: str | None) -> str:
    return ((url or "").split("/") + ["", "", ""])[2].lower()


class Throttle:
    """At most ``per_second`` calls a second to a host from this process; hosts do not wait for one another."""

    def __init__(self, per_second: float = config.SETTINGS.requests_per_second, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.next = 1 / per_second, clock, sleep, {}

    def wait(self, of: str = "") -> None:
        now, free = self.clock(), self.next.get(of, 0.0)
        if now < free:
            self.sleep(free - now)
        self.next[of] = max(now, free) + self.gap


def in_turns(urls: Sequence[str]) -> list[str]:
    """The urls with their hosts taking turns, each host's in their order, so that a pause for one host passes with calls to others."""
    seen: Counter = Counter()
    turns = []
    for i, u in enumerate(urls):
        turns.append((seen[host(u)], i, u))
        seen[host(u)] += 1
    return [u for _, _, u in sorted(turns, key=lambda t: t[:2])]


def fetch_all(urls: DataFrame, make: Callable[[], Fetch], per_second: float | None = None, browser: Callable[[], Callable[[str], str]] | None = None, always: bool = False) -> DataFrame:
    """Fetch each url; ``make()`` builds a client once a task. A failed fetch has a null status.

    Rows are dealt by host, so a host's calls are spaced by one task; hosts of a task take turns. ``browser`` starts a renderer for ``with_browser``.
    """

    def run(frames: Iterator) -> Iterator:
        import datetime

        import pandas as pd

        fetch, gate = with_retries(make()), Throttle(per_second) if per_second else None
        if browser:
            fetch = with_browser(fetch, Browser(browser), always)
        for pdf in frames:
            out = []
            for u in in_turns(list(pdf["url"])):
                if gate:
                    gate.wait(host(u))
                r = fetch(u)
                out.append((u, r.status if r else None, r.content_type if r else None, r.body if r else None, datetime.datetime.now(datetime.UTC).isoformat()))
            yield pd.DataFrame(out, columns=["url", "http_status", "content_type", "raw_html", "fetch_timestamp"]).astype({"http_status": "Int32"})

    return urls.select("url").repartition(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)).mapInPandas(run, RESPONSE)


def table_fetch(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A fetcher over a table (page_id, url, html): for tests and replays."""
    return lambda todo: pages.join(todo.select("url").distinct(), "url", "left_semi").select("page_id", "url", "html")


def wants_browser(status, html):
    """Whether a response looks like a firewall's or has no HTML in it (Columns)."""
    return status.isin(*BLOCKED) | ~F.coalesce(H.looks_like_html(html), F.lit(False))


def register_page_source(spark) -> None:
    """``spark.read.format("textloom_pages")`` with options ``urls`` (blank-separated), ``fetcher`` (module:function) and ``perPartition`` (200): a Python data source, partitioned by runs of urls of neighbouring hosts."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Part(InputPartition):
        def __init__(self, urls):
            self.urls = urls

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = options

        def partitions(self):
            urls = sorted(self.options.get("urls", "").split(), key=lambda u: (u.split("/")[2:3], u))
            size = int(self.options.get("perPartition", "200"))
            return [Part(urls[i : i + size]) for i in range(0, len(urls), size)]

        def read(self, partition):
            import datetime
            import importlib

            module, _, name = self.options["fetcher"].partition(":")
            fetch = with_retries(getattr(importlib.import_module(module), name))
            for u in partition.urls:
                r = fetch(u)
                yield (u, r.status if r else None, r.content_type if r else None, r.body if r else None, datetime.datetime.now(datetime.UTC).isoformat())

    class Pages(DataSource):
        @classmethod
        def name(cls):
            return "textloom_pages"

        def schema(self):
            return RESPONSE

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(Pages)
