"""Crawl logic without the network: link graph, frontier steps, routing of responses, render and size predicates, sitemaps and robots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom import config
from textloom.functions import html as H
from textloom.functions import text as T
from textloom.functions import urls as U
from textloom.scratch import numbered

S = config.SETTINGS


def links(pages: DataFrame) -> DataFrame:
    """(page_id, src_url, link_ord, dst_url): normalised targets of anchors; rejected ones go."""
    raw = pages.select("page_id", F.col("url").alias("src_url"), F.posexplode(H.hrefs("html")).alias("link_ord", "href"))
    return raw.select("page_id", "src_url", F.col("link_ord").cast("long"), U.normalize("href", "src_url").alias("dst_url")).filter("dst_url IS NOT NULL")


def external_counts(edges: DataFrame, allowed: tuple) -> DataFrame:
    """(domain, n): links that leave the allow-list, by registered domain."""
    return edges.select(U.external_domain("dst_url", allowed).alias("domain")).filter("domain IS NOT NULL").groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


def frontier_step(edges: DataFrame, seen: DataFrame, allowed: tuple, budget: int | None = S.max_pages) -> DataFrame:
    """The next level of a crawl: (url, class, page_id, link_ord).

    In scope, no trap, no asset, not seen before; each url once, where first discovered. Priority urls come first, the rest after, each by
    order of discovery, cut to the budget; without one the whole level stays. (A queue that puts each new priority url in front would order ties the other way round; the set
    is the same as long as the budget does not bind.)
    """
    found = edges.filter(T.let(F.col("dst_url"), lambda u: U.in_scope(u, allowed) & ~U.is_trap(u) & ~U.is_asset(u)))
    first = found.groupBy(F.col("dst_url").alias("url")).agg(F.min(F.struct("page_id", "link_ord")).alias("at"))
    fresh = first.join(seen.select("url"), "url", "left_anti").withColumn("class", F.when(U.priority("url") < 0, 0).otherwise(1).cast("long"))
    if budget is not None:
        # places are given by sorted partitions, so the frontier is not gathered in one task
        fresh = numbered(fresh, [F.col("class"), F.col("at"), F.col("url")], "place").filter(F.col("place") < budget)
    return fresh.select("url", "class", F.col("at.page_id").alias("page_id"), F.col("at.link_ord").alias("link_ord"))


def route(status: Column, content_type: Column, url: Column) -> Column:
    """fetch-failed, http-<n>, pdf, html or ignored."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(status.isNull(), "fetch-failed")
        .when(status >= 400, F.concat(F.lit("http-"), status.cast("string")))
        .when(kind.contains("pdf") | U.is_pdf(url), "pdf")
        .when((kind == "") | kind.contains("html"), "html")
        .otherwise("ignored")
    )


def needs_render(html: Column) -> Column:
    """Hardly any visible text, or little of it in a page of some size."""
    text, size = F.length(H.visible_text(html)), F.length(html)
    return F.lit(S.render_all_html) | (text < S.js_render_min_text_chars) | ((size >= S.js_render_min_html_bytes) & (text < S.js_render_max_text_html_ratio * size))


def pdf_verdict(size_bytes: Column, text: Column) -> Column:
    """too-large, no-text or ok."""
    return F.when(size_bytes > S.max_pdf_size_mb * 1024 * 1024, "pdf-too-large").when(F.coalesce(F.trim(text), F.lit("")) == "", "pdf-no-text").otherwise("ok")


def crawl_report(pages: DataFrame, max_pages: int = S.max_pages, max_pdfs: int = S.max_pdfs) -> DataFrame:
    """One row of counters over (url, html, is_pdf, route) rows, in one pass."""
    ok_html, ok_pdf = F.col("route") == "html", F.col("route") == "pdf"
    return pages.agg(
        F.count(F.lit(1)).alias("fetched"), F.count_if(ok_html).alias("html_pages"), F.count_if(ok_pdf).alias("pdfs"),
        F.count_if(F.col("route") == "ignored").alias("ignored"), F.count_if(F.col("route").startswith("http-") | (F.col("route") == "fetch-failed")).alias("failed"),
        F.count_if(F.col("trap")).alias("traps"), F.count_if(F.col("needs_js")).alias("needed_js"),
        (F.count_if(ok_html) >= max_pages).alias("page_cap_hit"), (F.count_if(ok_pdf) >= max_pdfs).alias("pdf_cap_hit"),
    )


def sitemap_locs(xml: Column) -> Column:
    """All <loc> values of a sitemap or a sitemap index, whatever the namespace."""
    return F.transform(F.xpath(xml, F.lit("//*[local-name()='loc']/text()")), lambda x: F.trim(x))


def expand_sitemaps(roots: DataFrame, fetched: DataFrame, most_depth: int = 5) -> DataFrame:
    """(url): pages of the sitemaps that ``roots`` (url) lead to; ``fetched`` (url, xml) plays the network. Depth is bounded, levels are joins."""
    spark = roots.sparkSession
    level, out = roots.select("url"), spark.createDataFrame([], "url string")
    for _ in range(most_depth + 1):
        got = level.join(fetched, "url").select(F.col("xml").rlike(r"(?i)<(\w+:)?sitemapindex\b").alias("index"), F.explode(sitemap_locs(F.col("xml"))).alias("url"))
        out = out.unionByName(got.filter("NOT index").select("url"))
        level = got.filter("index").select("url").distinct()
    return out.distinct()


def allowed_by_robots(urls: DataFrame, robots: DataFrame, agent: str = "*", url_col: str = "url") -> DataFrame:
    """``urls`` with ``allowed``, by each host's text in ``robots`` (host, robots); hosts without one, and texts that cannot be read, allow all."""

    def check(url, text):
        from urllib.robotparser import RobotFileParser

        import pandas as pd

        made: dict = {}
        out = []
        for u, t in zip(url, text, strict=True):
            try:
                if t not in made:
                    p = RobotFileParser()
                    p.parse(t.splitlines())
                    made = {t: p}  # rows of a host come together
                out.append(made[t].can_fetch(agent, u))
            except Exception:  # any failure allows, and so does no text
                out.append(True)
        return pd.Series(out, dtype=bool)

    rules = robots.select(F.lower("host").alias("__host"), F.col("robots").alias("__robots")).dropDuplicates(["__host"])
    met = urls.withColumn("__of", F.lower(U.authority(url_col))).join(rules, F.col("__of") == F.col("__host"), "left")
    return met.withColumn("allowed", F.pandas_udf(check, "boolean")(F.col(url_col), F.col("__robots"))).drop("__of", "__host", "__robots")


def crawl(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], allowed: tuple, levels: int = 20, budget: int = S.max_pages, keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Level-by-level crawl: ``fetch`` turns (url) rows into (page_id, url, html) rows; ``keep`` writes a level and returns it reread."""
    todo, pages, seen = seeds.select("url"), None, seeds.select("url")
    for _ in range(levels):
        got = keep(fetch(todo))
        pages = got if pages is None else pages.unionByName(got)
        left = budget - pages.count()
        if left <= 0:
            break
        todo = keep(frontier_step(links(got), seen, allowed, left).select("url"))
        if not todo.limit(1).count():
            break
        seen = keep(seen.unionByName(todo))
    return pages


def first_page(pages: DataFrame, variants: list[str]) -> DataFrame:
    """The first HTML page, by order, whose url without trailing slash is one of the variants."""
    return pages.filter(F.rtrim(F.lower("url"), F.lit("/")).isin([v.rstrip("/").lower() for v in variants])).orderBy("page_id").limit(1)


def pages_with_suffix(pages: DataFrame, suffix: str) -> DataFrame:
    """The first page whose url ends in ``suffix``, as text by lines."""
    hit = pages.filter(F.rtrim(F.lower("url"), F.lit("/")).endswith(suffix.lower())).orderBy("page_id").limit(1)
    return hit.select("page_id", "url", H.visible_text("html", "\n").alias("text"))


def politeness_schedule(calls: DataFrame, key: str, arrival: str, per_second: float = S.requests_per_second) -> DataFrame:
    """Start times spaced so that no key has more than ``per_second`` calls a second: start_i = max over j <= i of arrival_j + (i - j) / rate."""
    w = Window.partitionBy(key).orderBy(arrival, "call_id")
    n = calls.withColumn("i", F.row_number().over(w))
    lead = F.max(F.col(arrival) - F.col("i") / per_second).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return n.withColumn("start", lead + F.col("i") / per_second).drop("i")
