"""Queries over ``pages``: URLs, extraction, links, frontier and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import config
from textloom.functions import html as H
from textloom.functions import text as T
from textloom.functions import urls as U
from textloom.operators import blocks, brand, crawl, curated, reports

#: Allow-list of the queries: one registered domain and one exact host.
ALLOWED = ("example.org", "ththan.example.net")
#: A page of fewer visible characters gives no chunk.
LEAST_CHARS = 1200


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "pages")


def url_normalize(spark, sf):
    return pages(spark, sf).select("page_id", U.normalize("url").alias("norm"))


def url_parts(spark, sf):
    return pages(spark, sf).select("page_id", U.scheme("url").alias("scheme"), U.authority("url").alias("host"), U.path("url").alias("path"), U.query("url").alias("query"), U.path_and_query("url").alias("pq"), U.pdf_title("url").alias("last_segment"))


def url_registered_domain(spark, sf):
    return pages(spark, sf).select("page_id", U.registered_domain(U.authority("url")).alias("domain"), U.in_scope("url", ALLOWED).alias("in_scope"), U.external_domain("url", ALLOWED).alias("external"))


def url_trap_filter(spark, sf):
    p = pages(spark, sf)
    u = F.concat("url", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/page/"), (F.col("page_id") % 7).cast("string"))).when(F.col("page_id") % 3 == 1, "/2024/05/06/x").otherwise(""))
    return p.select("page_id", U.is_trap(u).alias("trap"))


def url_priority(spark, sf):
    u = F.concat("url", F.when(F.col("page_id") % 4 == 0, "/Tax-Office").when(F.col("page_id") % 4 == 1, "/agenda/2020").when(F.col("page_id") % 4 == 2, "/court/minutes").otherwise(""))
    return pages(spark, sf).select("page_id", U.priority(u).alias("priority"))


def url_asset_class(spark, sf):
    u = F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.when(F.col("page_id") % 3 == 0, ".PDF").when(F.col("page_id") % 3 == 1, ".js?x=1").otherwise(".page"))
    return pages(spark, sf).select("page_id", U.is_pdf(u).alias("pdf"), U.is_asset(u).alias("asset"))


def coverage_key_lookup(spark, sf):
    return pages(spark, sf).select("page_id", U.coverage_key("url").alias("key"))


def same_host_pairs(spark, sf):
    p = pages(spark, sf)
    nxt = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next_url"))
    return p.join(nxt, "page_id").select("page_id", U.same_host("url", "next_url").alias("same"))


def html_strip_chrome(spark, sf):
    return pages(spark, sf).select("page_id", F.length(H.strip_chrome("html")).cast("long").alias("n_chars"), F.sha2(H.strip_chrome("html"), 256).alias("h"))


def html_title(spark, sf):
    t = H.title("html")
    return pages(spark, sf).select("page_id", t.alias("title"), F.when(t == "", F.col("url")).otherwise(t).alias("shown"))


def html_visible_text(spark, sf):
    return pages(spark, sf).select("page_id", H.visible_text("html").alias("text"))


def looks_like_html(spark, sf):
    return pages(spark, sf).select("page_id", H.looks_like_html("html").alias("is_html"))


def html_links(spark, sf):
    return crawl.links(pages(spark, sf))


def external_domain_counts(spark, sf):
    """The domains that most links lead to, of those outside the allow-list."""
    return crawl.external_counts(crawl.links(pages(spark, sf)), ALLOWED).orderBy(F.desc("n"), "domain").limit(20)


def needs_js(spark, sf):
    return pages(spark, sf).select("page_id", crawl.needs_render(F.col("html")).alias("needs_js"))


def answer_of_page():
    """(status, content type) that the page's server is said to give."""
    status = F.when(F.col("page_id") % 7 == 0, F.lit(None)).when(F.col("page_id") % 7 == 1, 404).when(F.col("page_id") % 7 == 2, 503).otherwise(200)
    kind = F.when(F.col("page_id") % 5 == 0, "application/pdf").when(F.col("page_id") % 5 == 1, "image/png").when(F.col("page_id") % 5 == 2, "").otherwise("text/html; charset=utf-8")
    return status, kind


def route_responses(spark, sf):
    return pages(spark, sf).select("page_id", crawl.route(*answer_of_page(), F.col("url")).alias("route"))


def pdf_verdicts(spark, sf):
    size = F.length("html") * 600
    text = F.when(F.col("page_id") % 4 == 0, " ").otherwise(F.col("url"))
    return pages(spark, sf).select("page_id", crawl.pdf_verdict(size, text).alias("verdict"))


def crawl_report(spark, sf):
    p = pages(spark, sf).withColumn("route", F.when(F.col("page_id") % 9 == 0, "http-404").when(F.col("page_id") % 9 == 1, "pdf").when(F.col("page_id") % 9 == 2, "ignored").otherwise("html"))
    return crawl.crawl_report(p.withColumn("trap", U.is_trap("url")).withColumn("needs_js", crawl.needs_render(F.col("html"))), max_pages=100, max_pdfs=10_000_000)


def page_markdown(spark, sf):
    return pages(spark, sf).select("page_id", H.to_markdown("html").alias("md"))


def page_blocks(spark, sf):
    return blocks.page_blocks(pages(spark, sf))


def frontier_step(spark, sf):
    p = pages(spark, sf)
    seen = p.filter("page_id % 2 = 0").select(U.normalize("url").alias("url"))
    return crawl.frontier_step(crawl.links(p), seen, ALLOWED, budget=None)


def homepage_lookup(spark, sf):
    return crawl.first_page(pages(spark, sf), ["https://thther.example.org/en/685", "https://www.thther.example.org/en/685", "https://thther.example.org/en/685/"]).select("page_id", "url")


def suffix_lookup(spark, sf):
    return crawl.pages_with_suffix(pages(spark, sf), "/en/685").select("page_id", "url", F.length("text").cast("long").alias("n_chars"))


def _crawled(spark, sf):
    return pages(spark, sf).select(U.normalize("url").alias("url"), (F.col("page_id") % 10 == 3).alias("is_pdf"), F.col("page_id").alias("page_ord"))


def _page_chunks(spark, sf):
    """One chunk a page of some text; the others are crawled and not indexed."""
    return pages(spark, sf).filter(F.length(H.visible_text("html")) >= LEAST_CHARS).select(U.normalize("url").alias("source_url"), F.col("page_id").alias("chunk_index"), H.title("html").alias("page_title"), (F.col("page_id") % 10 == 3).alias("is_pdf"))


def chunk_counts(spark, sf):
    return reports.chunk_counts(_page_chunks(spark, sf))


def crawled_urls(spark, sf):
    return reports.crawled_urls(_crawled(spark, sf))


def coverage_anti_join(spark, sf):
    return reports.missing(reports.crawled_urls(_crawled(spark, sf)), reports.chunk_counts(_page_chunks(spark, sf)))


def coverage_counts(spark, sf):
    return reports.totals(reports.crawled_urls(_crawled(spark, sf)), reports.chunk_counts(_page_chunks(spark, sf)))


def coverage_lookup(spark, sf):
    asked = pages(spark, sf).filter("page_id % 5 = 0").select(F.concat("url", F.lit("/")).alias("asked"))
    return reports.lookup(asked, reports.crawled_urls(_crawled(spark, sf)), reports.chunk_counts(_page_chunks(spark, sf)))


def _sheets(spark, sf):
    """Style sheets made of table columns, the same in any engine: colours, custom properties and fonts."""
    h = F.sha2("url", 256)
    css = F.concat(
        F.lit("a{color:#"), F.substring(h, 1, 6), F.lit("} b{background:#"), F.substring(h, 7, 3), F.lit(";} :root{--brand-color: #"), F.substring(h, 10, 6), F.lit("; --Main-tone: rgb("),
        (F.col("page_id") % 256).cast("string"), F.lit(", 20, 200); --accent: #ffffff;} p{font-family: 'Font"), (F.col("page_id") % 5).cast("string"), F.lit("', serif;} i{font-family: FontAwesome;} q{font-family: inherit}"),
    )
    return pages(spark, sf).select("page_id", css.alias("css"))


def css_colour_counts(spark, sf):
    return brand.ranked(brand.colours(_sheets(spark, sf), "page_id"), "colour", ["page_id", "pos"], 8)


def css_font_counts(spark, sf):
    return brand.ranked(brand.fonts(_sheets(spark, sf), "page_id"), "font", ["page_id", "pos"])


def css_vars(spark, sf):
    return brand.css_vars(_sheets(spark, sf), "page_id").drop("pos")


def brand_roles(spark, sf):
    return brand.brand(_sheets(spark, sf), "page_id").select("page_id", "primary", "secondary", "accent", "font_body", "font_heading")


def contrast_text(spark, sf):
    c = F.concat(F.lit("#"), F.substring(F.sha2("url", 256), 1, 6))
    return pages(spark, sf).select("page_id", c.alias("colour"), brand.text_on(c).alias("text"), brand.is_neutral(c).alias("neutral"))


def html_stylesheet(spark, sf):
    return pages(spark, sf).select("page_id", H.stylesheet("html").alias("css"))


def html_rewrite(spark, sf):
    out, removed = brand.rewrite_saved_page(F.col("html"), trackers=(r"(?is)<script>var t=.*?</script>",), asset_prefixes=("/Nicht",), inject="<script src=w.js></script>")
    return pages(spark, sf).select("page_id", F.sha2(out, 256).alias("h"), removed.alias("removed"))


def html_logo(spark, sf):
    page = F.concat(F.lit('<header><img src="/a.png"><img class="site-logo" src="../img/'), F.col("page_id").cast("string"), F.lit('.png"></header>'), F.col("html"))
    return pages(spark, sf).select("page_id", H.logo(page, F.regexp_replace("url", r"[?#].*$", "")).alias("logo"))


def link_grid_text(spark, sf):
    made = F.concat(F.lit('<div id="buttonsections"><a class="x gem-button" href="/a">Pay  now</a><a class="gem-button" href="/b">PAY NOW</a><a class="gem-button" href="/c">P'), F.col("page_id").cast("string"), F.lit("</a><a class=\"other\" href=\"/d\">No</a></div>"))
    grids = curated.link_grids(pages(spark, sf).select("page_id", made.alias("html")))
    return grids.select("page_id", curated.grid_text(F.col("grids"), "buttons", "Links:").alias("text"))


def court_judge_asof(spark, sf):
    t = F.concat(F.lit("107th District Court room 1. Judge Notice Board. Judge A"), F.col("page_id").cast("string"), F.lit("x. Honorable Judge Ann B. Lee\n103rd District Court and 107th District Court: Judge Max Ort, "), F.lit("404th District Court"))
    t = F.regexp_replace(t, r"Judge A\d+x", "Judge Ada Byron")
    pairs = curated.court_judges(pages(spark, sf).select("page_id", t.alias("text")), "page_id")
    return pairs.select("page_id", "court", "judge", "number")


def court_overview(spark, sf):
    return curated.court_overview(court_judge_asof(spark, sf), "page_id", "Courts:")


def sitemap_locs(spark, sf):
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://example.org/'), F.col("page_id").cast("string"), F.lit(" </loc></url><url><loc>https://example.org/b</loc></url></urlset>"))
    return pages(spark, sf).select("page_id", F.array_join(crawl.sitemap_locs(xml), " ").alias("locs"))


def robots_admission(spark, sf):
    rules = spark.createDataFrame([("thther.example.org", "User-agent: *\nDisallow: /en/\n"), ("ththed.example.org", "User-agent: *\nDisallow: /\n")], "host string, robots string")
    return crawl.allowed_by_robots(pages(spark, sf).select("page_id", "url"), rules).select("page_id", "allowed")


QUERIES = {f.__name__: f for f in (
    url_normalize, url_parts, url_registered_domain, url_trap_filter, url_priority, url_asset_class, coverage_key_lookup, same_host_pairs, html_strip_chrome, html_title, html_visible_text, looks_like_html,
    html_links, external_domain_counts, needs_js, route_responses, pdf_verdicts, crawl_report, page_markdown, page_blocks, frontier_step, homepage_lookup, suffix_lookup, chunk_counts, crawled_urls,
    coverage_anti_join, coverage_counts, coverage_lookup, css_colour_counts, css_font_counts, css_vars, brand_roles, contrast_text, html_stylesheet, html_rewrite, html_logo, link_grid_text, court_judge_asof,
    sitemap_locs, robots_admission, court_overview,
)}

# --- SQL ---------------------------------------------------------------------------------------------------------------------------------

_HOST = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)"
_RAW = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)"
_PATH = rf"regexp_replace({_RAW}, ';[^/]*$', '')"
_QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
_BARE = rf"regexp_replace(lower({_HOST}), '^www\.', '')"
_DOMAIN = rf"array_to_string(list_slice(string_split({_BARE}, '.'), -2, -1), '.')"
_IN = rf"({_DOMAIN} IN ('example.org', 'ththan.example.net') OR {_BARE} IN ('example.org', 'ththan.example.net') OR {_BARE} LIKE '%.example.org' OR {_BARE} LIKE '%.ththan.example.net')"
_NORM = rf"""'https://' || {_BARE} || (CASE WHEN length({_PATH}) > 1 THEN regexp_replace({_PATH}, '/+$', '') ELSE '/' END) || (CASE WHEN {_QUERY} = '' THEN '' ELSE '?' || {_QUERY} END)"""
_PQ = rf"lower({_PATH} || (CASE WHEN {_QUERY} = '' THEN '' ELSE '?' || {_QUERY} END))"


def _of(expr: str, url: str) -> str:
    """An expression over ``url`` for another expression in its place."""
    import re

    return re.sub(r"\burl\b", f"({url})", expr)


def _decoded(x: str) -> str:
    for entity, char in config.ENTITIES:
        x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


def _stripped(x: str) -> str:
    for t in config.CHROME_TAGS:
        x = rf"regexp_replace({x}, '(?is)<{t}\b[^>]*>.*?</{t}\s*>', '', 'g')"
    return x


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


_VISIBLE = rf"""regexp_replace({_trim(_decoded("regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]*>', chr(10), 'g')"))}, '\s*\n\s*', ' ', 'g')"""
_TITLE = _trim(_decoded("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))
_NEEDS = f"(length({_VISIBLE}) < 200 OR (length(html) >= 5000 AND length({_VISIBLE}) < 0.012 * length(html)))"


def _trap(pq: str) -> str:
    parts = [f"contains(p, '{s}')" for s in config.TRAP_SUBSTRINGS] + [f"regexp_matches(p, '{r}')" for r in config.TRAP_PATTERNS]
    parts += [rf"coalesce(try_cast(nullif(regexp_extract(p, '{r}', 1), '') AS HUGEINT) > 3, false)" for r in (r"/(?:category|tag|author)/[^?]*?/page/(\d+)", r"/page/(\d+)")]
    return "(" + " OR ".join(x.replace("(p,", f"({pq},") for x in parts) + ")"


def _priority(pq: str) -> str:
    return f"((CASE WHEN regexp_matches({pq}, '{'|'.join(config.PRIORITY_HINTS)}') THEN -10 ELSE 0 END) + (CASE WHEN regexp_matches({pq}, '{'|'.join(config.DEPRIORITY_HINTS)}') THEN 10 ELSE 0 END))::BIGINT"


def _asset(path: str) -> str:
    return f"(contains({path}, '.') AND '.' || lower(list_extract(string_split({path}, '.'), -1)) IN ({', '.join(repr(x) for x in config.ASSET_EXTENSIONS)}))"


def _markdown() -> str:
    t = rf"regexp_replace({_stripped('html')}, '(?s)<!--.*?-->', '', 'g')"
    t = rf"""coalesce(nullif(regexp_extract({t}, '(?is)<article\b[^>]*>(.*)</article\s*>', 1), ''), nullif(regexp_extract({t}, '(?is)<body\b[^>]*>(.*)', 1), ''), {t})"""
    t = rf"regexp_replace({t}, '\s+', ' ', 'g')"
    for n in range(1, 7):
        t = rf"regexp_replace({t}, '(?i)<h{n}\b[^>]*>\s*', chr(10) || '{'#' * n} ', 'g')"
    t = rf"regexp_replace({t}, '(?i)<li\b[^>]*>\s*', chr(10) || '- ', 'g')"
    t = rf"regexp_replace({t}, '(?i)</?(p|div|br|ul|ol|li|h[1-6]|table|tr|section|article|header|blockquote|pre|dl|dt|dd)\b[^>]*>', chr(10), 'g')"
    t = _decoded(rf"regexp_replace({t}, '<[^>]*>', '', 'g')")
    return _trim(rf"regexp_replace({t}, ' *\n[ \n]*', chr(10), 'g')")


_LINKS = rf"""
    WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1)) AS href,
                      generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1), 1) - 1 AS link_ord FROM pages),
    l AS (SELECT page_id, url AS src_url, link_ord::BIGINT AS link_ord, 'https://' || {_BARE} ||
                 (CASE WHEN length(href) > 1 THEN regexp_replace(href, '/+$', '') ELSE '/' END) AS dst_url FROM a)"""
_CRAWLED = f"c AS (SELECT {_NORM} AS url, page_id % 10 = 3 AS is_pdf, page_id FROM pages), u AS (SELECT url, arg_max(is_pdf, page_id) AS is_pdf FROM c GROUP BY url)"
_CHUNKS = f"k AS (SELECT {_NORM} AS source_url, page_id, {_TITLE} AS page_title, page_id % 10 = 3 AS is_pdf FROM pages WHERE length({_VISIBLE}) >= {LEAST_CHARS}), n AS (SELECT source_url, count(*) AS n_chunks, arg_min(page_title, page_id) AS page_title, arg_max(is_pdf, page_id) AS is_pdf FROM k GROUP BY source_url)"
_KEY = rf"replace(lower({_HOST}), 'www.', '') || (CASE WHEN regexp_replace({_PATH}, '/+$', '') = '' THEN '/' ELSE regexp_replace({_PATH}, '/+$', '') END)"
_SHEET = """s AS (SELECT page_id, 'a{color:#' || substr(sha256(url), 1, 6) || '} b{background:#' || substr(sha256(url), 7, 3) || ';} :root{--brand-color: #' || substr(sha256(url), 10, 6) || '; --Main-tone: rgb(' ||
    (page_id % 256) || ', 20, 200); --accent: #ffffff;} p{font-family: ''Font' || (page_id % 5) || ''', serif;} i{font-family: FontAwesome;} q{font-family: inherit}' AS css FROM pages)"""
_HEX = "#(?:[0-9a-fA-F]{6}|[0-9a-fA-F]{3})\\b"
_RGBS = r"rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)"


def _six(x: str) -> str:
    return f"(CASE WHEN length({x}) = 4 THEN '#' || lower(substr({x},2,1)||substr({x},2,1)||substr({x},3,1)||substr({x},3,1)||substr({x},4,1)||substr({x},4,1)) ELSE lower({x}) END)"


def _neutral(c: str) -> str:
    ch = [f"('0x' || substr({c}, {2 + 2 * i}, 2))::BIGINT" for i in range(3)]
    hi, lo = f"greatest({', '.join(ch)})", f"least({', '.join(ch)})"
    return f"(({hi} > 240 AND {lo} > 220) OR {hi} < 30 OR {hi} - {lo} < 18)"


_RGBHEX = "'#' || " + " || ".join(f"printf('%02x', r[{i}]::BIGINT)" for i in (1, 2, 3))
_COLOURS = rf"""{_SHEET},
    h AS (SELECT page_id, unnest(regexp_extract_all(css, '{_HEX}')) AS raw, generate_subscripts(regexp_extract_all(css, '{_HEX}'), 1) - 1 AS pos FROM s),
    r AS (SELECT page_id, [regexp_extract(css, '{_RGBS}', 1), regexp_extract(css, '{_RGBS}', 2), regexp_extract(css, '{_RGBS}', 3)] AS r, len(regexp_extract_all(css, '{_HEX}')) AS pos FROM s),
    col AS (SELECT page_id, pos, {_six('raw')} AS colour FROM h UNION ALL SELECT page_id, pos, {_RGBHEX} FROM r WHERE r[1] <> ''),
    good AS (SELECT * FROM col WHERE NOT {_neutral('colour')})"""
_FONTS = f"""{_SHEET}, f AS (SELECT page_id, '''Font' || (page_id % 5) || ''', serif' AS raw FROM s), fonts AS (SELECT page_id, regexp_replace(raw, '^['']+', '') AS font FROM f)"""
_VARS = f"""{_SHEET}, v AS (SELECT page_id, '--brand-color' AS name, '#' || substr(regexp_extract(css, '--brand-color: #([0-9a-f]+)', 1), 1, 6) AS colour, 0 AS pos FROM s
    UNION ALL SELECT page_id, '--main-tone', '#' || printf('%02x', page_id % 256) || '14c8', 1 FROM s), vars AS (SELECT * FROM v WHERE NOT {_neutral('colour')})"""

ORACLE_SQL = {
    "url_normalize": f"SELECT page_id, {_NORM} AS norm FROM pages",
    "url_parts": rf"SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS scheme, {_HOST} AS host, {_PATH} AS path, {_QUERY} AS query, {_PQ} AS pq, list_extract(string_split({_PATH}, '/'), -1) AS last_segment FROM pages",
    "url_registered_domain": f"SELECT page_id, {_DOMAIN} AS domain, {_IN} AS in_scope, CASE WHEN NOT {_IN} THEN {_DOMAIN} END AS external FROM pages",
    "url_trap_filter": "SELECT page_id, " + _trap(_of(_PQ, "u")) + " AS trap FROM (SELECT page_id, url || (CASE page_id % 3 WHEN 0 THEN '/page/' || (page_id % 7) WHEN 1 THEN '/2024/05/06/x' ELSE '' END) AS u FROM pages)",
    "url_priority": "SELECT page_id, " + _priority(_of(_PQ, "u")) + " AS priority FROM (SELECT page_id, url || (CASE page_id % 4 WHEN 0 THEN '/Tax-Office' WHEN 1 THEN '/agenda/2020' WHEN 2 THEN '/court/minutes' ELSE '' END) AS u FROM pages)",
    "url_asset_class": "SELECT page_id, lower(" + _of(_PATH, "u") + ") LIKE '%.pdf' AS pdf, " + _asset(_of(_PATH, "u")) + r" AS asset FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') || (CASE page_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.js?x=1' ELSE '.page' END) AS u FROM pages)",
    "coverage_key_lookup": f"SELECT page_id, {_KEY} AS key FROM pages",
    "same_host_pairs": f"SELECT p.page_id, lower({_of(_HOST, 'p.url')}) = lower({_of(_HOST, 'q.url')}) AS same FROM pages p JOIN pages q ON q.page_id = p.page_id + 1",
    "html_strip_chrome": f"SELECT page_id, length(t) AS n_chars, sha256(t) AS h FROM (SELECT page_id, {_stripped('html')} AS t FROM pages)",
    "html_title": f"SELECT page_id, {_TITLE} AS title, CASE WHEN {_TITLE} = '' THEN url ELSE {_TITLE} END AS shown FROM pages",
    "html_visible_text": f"SELECT page_id, {_VISIBLE} AS text FROM pages",
    "looks_like_html": "SELECT page_id, regexp_matches(lower(substr(html, 1, 4000)), '<html|<body|<div|<a |<p>') AS is_html FROM pages",
    "html_links": _LINKS + " SELECT * FROM l",
    "external_domain_counts": _LINKS + f" SELECT {_of(_DOMAIN, 'dst_url')} AS domain, count(*) AS n FROM l WHERE NOT {_of(_IN, 'dst_url')} GROUP BY 1 ORDER BY n DESC, domain LIMIT 20",
    "needs_js": f"SELECT page_id, {_NEEDS} AS needs_js FROM pages",
    "route_responses": """
        WITH r AS (SELECT page_id, url, CASE page_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 404 WHEN 2 THEN 503 ELSE 200 END AS s,
                          CASE page_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN '' ELSE 'text/html; charset=utf-8' END AS k FROM pages)
        SELECT page_id, CASE WHEN s IS NULL THEN 'fetch-failed' WHEN s >= 400 THEN 'http-' || s WHEN contains(k, 'pdf') OR lower(url) LIKE '%.pdf' THEN 'pdf' WHEN k = '' OR contains(k, 'html') THEN 'html' ELSE 'ignored' END AS route FROM r""",
    "pdf_verdicts": "SELECT page_id, CASE WHEN length(html) * 600 > 10485760 THEN 'pdf-too-large' WHEN page_id % 4 = 0 THEN 'pdf-no-text' ELSE 'ok' END AS verdict FROM pages",
    "crawl_report": f"""
        WITH r AS (SELECT *, CASE page_id % 9 WHEN 0 THEN 'http-404' WHEN 1 THEN 'pdf' WHEN 2 THEN 'ignored' ELSE 'html' END AS route FROM pages)
        SELECT count(*) AS fetched, count(*) FILTER (route = 'html') AS html_pages, count(*) FILTER (route = 'pdf') AS pdfs, count(*) FILTER (route = 'ignored') AS ignored,
               count(*) FILTER (route LIKE 'http-%') AS failed, count(*) FILTER ({_trap(_PQ)}) AS traps, count(*) FILTER ({_NEEDS}) AS needed_js,
               count(*) FILTER (route = 'html') >= 100 AS page_cap_hit, false AS pdf_cap_hit FROM r""",
    "page_markdown": f"SELECT page_id, {_markdown()} AS md FROM pages",
    "page_blocks": rf"""
        WITH m AS (SELECT page_id, {_markdown()} AS md FROM pages),
        x AS (SELECT page_id, {_trim("regexp_replace(regexp_extract(md, '^# +([^\n]*)', 1), '^#+|#+$', '', 'g')")} AS h, {_trim("regexp_replace(md, '^# [^\n]*\n?', '')")} AS text FROM m)
        SELECT x.page_id, 0::BIGINT AS block_ord, CASE WHEN h = '' THEN {_TITLE} ELSE h END AS heading_path, text FROM x JOIN pages USING (page_id) WHERE text <> ''""",
    "frontier_step": _LINKS + f""",
        s AS (SELECT {_NORM} AS url FROM pages WHERE page_id % 2 = 0),
        f AS (SELECT dst_url AS url, min({{'p': page_id, 'l': link_ord}}) AS spot FROM l WHERE {_of(_IN, 'dst_url')} AND NOT {_trap(_of(_PQ, 'dst_url'))} AND NOT {_asset(_of(_PATH, 'dst_url'))} GROUP BY 1)
        SELECT url, (CASE WHEN {_priority(_PQ)} < 0 THEN 0 ELSE 1 END)::BIGINT AS class, spot.p AS page_id, spot.l AS link_ord FROM f WHERE url NOT IN (SELECT url FROM s)""",
    "homepage_lookup": "SELECT page_id, url FROM pages WHERE rtrim(lower(url), '/') IN ('https://thther.example.org/en/685', 'https://www.thther.example.org/en/685') ORDER BY page_id LIMIT 1",
    "suffix_lookup": f"SELECT page_id, url, length({_VISIBLE}) AS n_chars FROM pages WHERE rtrim(lower(url), '/') LIKE '%/en/685' ORDER BY page_id LIMIT 1",
    "chunk_counts": f"WITH {_CHUNKS} SELECT * FROM n",
    "crawled_urls": f"WITH {_CRAWLED} SELECT * FROM u",
    "coverage_anti_join": f"WITH {_CRAWLED}, {_CHUNKS} SELECT url FROM u WHERE NOT is_pdf AND url NOT IN (SELECT source_url FROM n)",
    "coverage_counts": f"""WITH {_CRAWLED}, {_CHUNKS} SELECT (SELECT count(*) FROM u WHERE NOT is_pdf) AS crawled_html, (SELECT count(*) FROM u WHERE is_pdf) AS crawled_pdf,
        (SELECT count(*) FROM n WHERE NOT is_pdf) AS indexed_html, (SELECT count(*) FROM n WHERE is_pdf) AS indexed_pdf, (SELECT coalesce(sum(n_chunks), 0)::BIGINT FROM n) AS chunks""",
    "coverage_lookup": f"""WITH {_CRAWLED}, {_CHUNKS}, a AS (SELECT url || '/' AS asked FROM pages WHERE page_id % 5 = 0),
        h AS (SELECT u.url, {_of(_KEY, 'u.url')} AS key, coalesce(n_chunks, 0) AS n_chunks FROM u LEFT JOIN n ON n.source_url = u.url)
        SELECT asked, h.url, coalesce(n_chunks, 0) AS n_chunks FROM a LEFT JOIN h ON h.key = {_of(_KEY, 'asked')}""",
    "css_colour_counts": f"WITH {_COLOURS}, g AS (SELECT colour, count(*) AS n, min((page_id, pos)) AS first FROM good GROUP BY colour) SELECT colour, n FROM g ORDER BY n DESC, first LIMIT 8",
    "css_font_counts": f"WITH {_FONTS} SELECT font, count(*) AS n FROM fonts GROUP BY font",
    "css_vars": f"WITH {_VARS} SELECT page_id, name, colour FROM vars",
    "brand_roles": f"""WITH {_COLOURS}, {_VARS.removeprefix(_SHEET + ', ')},
        p AS (SELECT page_id, coalesce(arg_min(colour, CASE WHEN contains(name, 'brand') THEN 0 ELSE 1 END), NULL) AS v FROM vars GROUP BY page_id),
        c AS (SELECT page_id, colour, count(*) AS n, min(pos) AS pos FROM good GROUP BY ALL),
        l AS (SELECT page_id, list(colour ORDER BY n DESC, pos) AS cs FROM c GROUP BY page_id),
        j AS (SELECT s.page_id, v, coalesce(cs, []) AS cs FROM s LEFT JOIN p USING (page_id) LEFT JOIN l USING (page_id)),
        a AS (SELECT page_id, coalesce(v, cs[1]) AS g1, cs FROM j),
        b AS (SELECT *, list_filter(cs, lambda x: x IS DISTINCT FROM g1)[1] AS g2 FROM a),
        d AS (SELECT *, list_filter(cs, lambda x: x IS DISTINCT FROM g1 AND x IS DISTINCT FROM g2)[1] AS g3 FROM b)
        SELECT page_id, coalesce(g1, '#1f4e79') AS "primary", coalesce(g2, '#4a6fa5') AS secondary, coalesce(g3, '#c8963e') AS accent, 'Font' || (page_id % 5) || ''', serif' AS font_body, 'Font' || (page_id % 5) || ''', serif' AS font_heading FROM d""",
    "contrast_text": f"""WITH c AS (SELECT page_id, '#' || substr(sha256(url), 1, 6) AS colour FROM pages)
        SELECT page_id, colour, CASE WHEN (0.299 * ('0x' || substr(colour, 2, 2))::BIGINT + 0.587 * ('0x' || substr(colour, 4, 2))::BIGINT + 0.114 * ('0x' || substr(colour, 6, 2))::BIGINT) / 255 > 0.6 THEN '#111111' ELSE '#ffffff' END AS text, {_neutral('colour')} AS neutral FROM c""",
    "html_stylesheet": r"SELECT page_id, array_to_string(list_concat(regexp_extract_all(html, '(?is)<style\b[^>]*>(.*?)</style>', 1), regexp_extract_all(html, '(?is)\bstyle\s*=\s*\"([^\"]*)\"', 1)), chr(10)) AS css FROM pages",
    "html_rewrite": r"""WITH a AS (SELECT page_id, html, regexp_extract_all(html, '(?is)<script>var t=.*?</script>') AS t FROM pages),
        b AS (SELECT page_id, len(t) AS removed, replace(regexp_replace(regexp_replace(html, '(?is)<script>var t=.*?</script>', '', 'g'), '\s+(?:data-)?srcset="[^"]*"', '', 'g'), '/Nicht', 'assets/') AS h FROM a)
        SELECT page_id, sha256(regexp_replace(h, '</body>', '<script src=w.js></script></body>')) AS h, removed FROM b""",
    "html_logo": rf"""WITH a AS (SELECT page_id, regexp_extract(url, '^[a-z]+', 0) AS sch, {_HOST} AS host, string_split(regexp_replace({_RAW}, '^/+', ''), '/') AS p FROM pages),
        b AS (SELECT *, list_slice(p, 1, len(p) - 1) AS dir FROM a)
        SELECT page_id, sch || '://' || host || '/' || array_to_string(list_concat(list_slice(dir, 1, greatest(len(dir) - 1, 0)), ['img', page_id || '.png']), '/') AS logo FROM b""",
    "link_grid_text": "SELECT page_id, 'Links:' || chr(10) || '- Pay now: /a' || chr(10) || '- P' || page_id || ': /c' AS text FROM pages",
    "sitemap_locs": "SELECT page_id, 'https://example.org/' || page_id || ' https://example.org/b' AS locs FROM pages",
    "robots_admission": f"SELECT page_id, NOT (({_HOST} = 'thther.example.org' AND {_PATH} LIKE '/en/%') OR {_HOST} = 'ththed.example.org') AS allowed FROM pages",
}

_JUDGES = rf"""t AS (SELECT page_id, '107th District Court room 1. Judge Notice Board. Judge Ada Byron. Honorable Judge Ann B. Lee' || chr(10) || '103rd District Court and 107th District Court: Judge Max Ort, 404th District Court' AS t FROM pages),
    c AS (SELECT page_id, t, unnest(list_distinct(regexp_extract_all(t, '{config.COURT}', 1))) AS court FROM t), p AS (SELECT *, position(court || ' District Court' IN t) AS pos FROM c),
    s AS (SELECT page_id, court, substr(t, pos, coalesce(lead(pos) OVER (PARTITION BY page_id ORDER BY pos), length(t) + 1) - pos) AS span FROM p),
    j AS (SELECT page_id, court, coalesce(list_filter(list_transform(regexp_extract_all(span, '{config.JUDGE}', 1), lambda x: trim(x)), lambda x: lower(x) NOT IN ('notice', 'important') AND NOT contains(x, 'District'))[1], '') AS judge,
        regexp_extract(court, '^\d+')::BIGINT AS number FROM s)"""
ORACLE_SQL["court_judge_asof"] = f"WITH {_JUDGES} SELECT * FROM j"
ORACLE_SQL["court_overview"] = f"WITH {_JUDGES} SELECT page_id, 'Courts:' || chr(10) || string_agg('- ' || court || ' District Court' || CASE WHEN judge <> '' THEN ': Judge ' || judge ELSE '' END, chr(10) ORDER BY number, court, judge) AS text FROM j GROUP BY page_id"
