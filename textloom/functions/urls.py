"""Column functions on URLs. Parts come from regular expressions, so odd input gives null or empty parts and never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom import config
from textloom.functions.text import ColumnLike, col, let, trim_all

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def scheme(u: ColumnLike) -> Column:
    return F.lower(F.regexp_extract(col(u), _SCHEME, 1))


def authority(u: ColumnLike) -> Column:
    """The part after ``//``, as written."""
    return F.regexp_extract(col(u), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def path(u: ColumnLike) -> Column:
    """The path without the last segment's ``;params``."""
    raw = F.regexp_extract(col(u), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(raw, r";[^/]*$", "")


def query(u: ColumnLike) -> Column:
    return F.regexp_extract(col(u), r"^[^?#]*\?([^#]*)", 1)


def _dots_removed(p: Column, merged: bool) -> Column:
    """An absolute path with ``.`` and ``..`` resolved; in a path merged with a base's, empty segments but the last go."""
    parts = F.split(F.regexp_replace(p, "^/+" if merged else "^/", ""), "/")
    last = F.element_at(parts, -1)
    inner = F.slice(parts, 1, F.size(parts) - 1)
    inner = F.filter(inner, lambda x: x != "") if merged else inner
    every = F.concat(inner, F.array(last))
    kept = F.aggregate(
        every,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)),
    )
    return F.concat(F.lit("/"), F.array_join(F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept), "/"))


def resolve(u: ColumnLike, base: ColumnLike) -> Column:
    """A reference against a base, both as written: absolute, ``//host``, ``/path``, ``?query``, relative and empty ones."""
    r, b = col(u), col(base)
    root = F.concat(scheme(b), F.lit("://"), authority(b))
    p = F.regexp_extract(r, r"^([^?#]*)", 1)
    tail = F.regexp_extract(r, r"^[^?#]*(\?[^#]*)", 1)
    own = F.regexp_extract(b, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    folder = F.regexp_replace(own, r"[^/]*$", "")
    base_query = F.when(query(b) == "", "").otherwise(F.concat(F.lit("?"), query(b)))
    return (
        F.when(b.isNull() | r.rlike(_SCHEME), r)
        .when(r.startswith("//"), F.concat(scheme(b), F.lit(":"), r))
        .when(p == "", F.concat(root, own, F.when(tail == "", base_query).otherwise(tail)))
        .when(p.startswith("/"), F.concat(root, _dots_removed(p, False), tail))
        .otherwise(F.concat(root, _dots_removed(F.concat(folder, p), True), tail))
    )


def normalize(u: ColumnLike, base: ColumnLike | None = None) -> Column:
    """The canonical https form, or null: mail, phone, script and fragment links, bare e-mail addresses and other schemes are rejected.

    Lower-case host without credentials and one leading ``www.``; no fragment, no params, no trailing slash but the root's; the query stays.
    """
    def canonical(full: Column) -> Column:
        host = F.regexp_replace(F.regexp_replace(F.lower(authority(full)), "^[^@]*@", ""), r"^www\.", "")
        p = let(path(full), lambda x: F.when(x == "", "/").when(F.length(x) > 1, F.regexp_replace(x, "/+$", "")).otherwise(x))
        q = let(query(full), lambda x: F.when(x == "", "").otherwise(F.concat(F.lit("?"), x)))
        return F.when(scheme(full).isin("http", "https"), F.concat(F.lit("https://"), host, p, q))

    def checked(raw: Column) -> Column:
        bad = (raw == "") | raw.rlike(r"^(?:mailto:|tel:|javascript:|#)") | (~raw.contains("://") & raw.rlike(r"^[^\s/]+@[^\s/]+\.[A-Za-z]{2,}$"))
        return F.when(~bad, let(resolve(raw, base) if base is not None else raw, canonical))

    return let(F.regexp_replace(trim_all(u), r"[\t\r\n]", ""), checked)


def registered_domain(host: ColumnLike) -> Column:
    """The last two labels, without a leading ``www.``."""
    h = F.regexp_replace(F.lower(F.trim(F.coalesce(col(host), F.lit("")))), r"^www\.", "")
    return F.substring_index(h, ".", -2)


def host_allowed(host: ColumnLike, allowed: tuple = config.SETTINGS.allowlist_domains) -> Column:
    """Registered domain, exact host or dot-suffix of an entry."""
    def listed(h: Column) -> Column:
        ok = registered_domain(h).isin(list(allowed)) if allowed else F.lit(False)
        for entry in allowed:
            ok = ok | (h == entry) | h.endswith("." + entry)
        return ok

    return let(F.regexp_replace(F.lower(F.coalesce(col(host), F.lit(""))), r"^www\.", ""), listed)


def in_scope(u: ColumnLike, allowed: tuple = config.SETTINGS.allowlist_domains) -> Column:
    return host_allowed(authority(u), allowed)


def external_domain(u: ColumnLike, allowed: tuple = config.SETTINGS.allowlist_domains) -> Column:
    """The registered domain of a URL out of scope, else null."""
    return F.when(~in_scope(u, allowed), registered_domain(authority(u)))


def path_and_query(u: ColumnLike) -> Column:
    q = query(u)
    return F.lower(F.concat(path(u), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))))


def is_trap(u: ColumnLike, max_page: int = config.SETTINGS.max_archive_page) -> Column:
    """Endless or worthless URLs: listed substrings and patterns, and archive pages beyond ``max_page``."""
    def judged(pq: Column) -> Column:
        trap = pq.rlike("|".join(config.TRAP_PATTERNS))
        for s in config.TRAP_SUBSTRINGS:
            trap = trap | pq.contains(s)
        for p in (r"/(?:category|tag|author)/[^?]*?/page/(\d+)", r"/page/(\d+)"):
            n = F.regexp_replace(F.regexp_extract(pq, p, 1), "^0+", "")  # numbers of any length, compared as text
            trap = trap | (F.length(n) > len(str(max_page))) | ((F.length(n) == len(str(max_page))) & (n > str(max_page)))
        return trap

    return let(path_and_query(u), judged)


def is_pdf(u: ColumnLike) -> Column:
    return F.lower(path(u)).endswith(".pdf")


def is_asset(u: ColumnLike) -> Column:
    """A skippable file by what follows the path's last dot."""
    return let(path(u), lambda p: p.contains(".") & F.concat(F.lit("."), F.lower(F.substring_index(p, ".", -1))).isin(config.ASSET_EXTENSIONS))


def priority(u: ColumnLike) -> Column:
    """-10 for a hint of services and departments, +10 for one of archives."""
    found = lambda pq, hints: pq.rlike("|".join(hints))
    return let(path_and_query(u), lambda pq: (F.when(found(pq, config.PRIORITY_HINTS), -10).otherwise(0) + F.when(found(pq, config.DEPRIORITY_HINTS), 10).otherwise(0)).cast("long"))


def coverage_key(u: ColumnLike) -> Column:
    """Host without any ``www.`` and the path without trailing slashes: the key by which reports look pages up."""
    p = F.regexp_replace(path(u), "/+$", "")
    return F.concat(F.replace(F.lower(authority(u)), F.lit("www.")), F.when(p == "", "/").otherwise(p))


def same_host(a: ColumnLike, b: ColumnLike) -> Column:
    return F.lower(authority(a)) == F.lower(authority(b))


def pdf_title(u: ColumnLike) -> Column:
    return F.substring_index(path(u), "/", -1)
