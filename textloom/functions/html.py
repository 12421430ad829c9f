"""Column functions on HTML: regular-expression forms that stay in the JVM."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom import config
from textloom.functions import urls
from textloom.functions.text import ColumnLike, col, let, trim_all


#: Named character references, those of config.ENTITIES first as a lookup goes through the map in order; then the numbers that stand for another character.
_NAMES = {e[1:-1]: c for e, c in config.ENTITIES if e[1] != "#"} | {n[:-1]: c for n, c in html5.items() if n.endswith(";")}
_NUMBERS = {str(n): c for n in range(128, 160) if (c := bytes([n]).decode("cp1252", "ignore"))} | {"0": "\ufffd"}


def decode_entities(c: ColumnLike) -> Column:
    """Named and numbered character references with their semicolon as characters, in one pass: what comes out is not read again. Unknown ones stay as they are.

    Numbers from 128 to 159 are windows-1252's, as browsers have it; 0, surrogates and those beyond Unicode are U+FFFD.
    """
    names, numbers = (F.from_json(F.lit(json.dumps(m)), "map<string,string>") for m in (_NAMES, _NUMBERS))

    def numbered(n: Column) -> Column:
        valid = (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("\ufffd")
        return F.coalesce(F.try_element_at(numbers, n.cast("string")), char)

    def one(after: Column) -> Column:
        def put(name: Column) -> Column:
            char = (
                F.when(name == "", F.lit(None).cast("string"))
                .when(name.rlike("^#[xX]"), numbered(F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10).cast("long")))
                .when(name.startswith("#"), numbered(F.substring(name, F.lit(2), F.length(name)).cast("long")))
                .otherwise(F.try_element_at(names, name))
            )
            return let(char, lambda x: F.when(x.isNull(), F.concat(F.lit("&"), after)).otherwise(F.concat(x, F.substring(after, F.length(name) + 2, F.length(after)))))

        return let(F.regexp_extract(after, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1), put)

    def decoded(parts: Column) -> Column:
        return F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), ""))

    return let(col(c), lambda t: F.when(F.instr(t, "&") == 0, t).otherwise(let(F.split(t, "&"), decoded)))


#: Elements whose content is text to a parser: they end at the first end tag of their name.
_RAW = ("script", "style")
#: Stands for one level of indentation until white space is squeezed; one that a text holds itself is taken out.
_INDENT = "\x01"


def _at_tags(c: Column, names: tuple) -> Column:
    """A text cut in front of each start and end tag of the names."""
    return F.split(c, rf"(?i)(?=</?(?:{'|'.join(names)})(?![\w-])[^>]*>)")


def _tag(part: Column, names: tuple) -> Column:
    """The tag that a part begins with: its name in lower case, with a slash in front if it is an end tag; empty if none."""
    return F.lower(F.regexp_extract(part, rf"(?i)^<(/?(?:{'|'.join(names)}))(?![\w-])[^>]*>", 1))


def _past(part: Column) -> Column:
    """What follows the tag that a part begins with."""
    return F.substring(part, F.instr(part, ">") + 1, F.length(part))


def without_tags(c: ColumnLike, tags: tuple) -> Column:
    """Whole elements of ``tags`` removed, with all they hold, elements of the same kind too.

    An end tag closes the last open element of its name and all opened in it. Elements that are never closed and end tags without a start stay as
    they are; script and style end at their first end tag.
    """
    out = col(c)
    for t in (x for x in tags if x in _RAW):
        out = F.regexp_replace(out, rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", "")
    names = tuple(x for x in tags if x not in _RAW)
    if not names:
        return out
    state = "struct<open:array<struct<name:string,at:int>>,out:array<string>>"
    zero = F.expr(f"cast(named_struct('open', array(), 'out', array()) as {state})")

    def step(s: Column, part: Column) -> Column:
        def by(tag: Column) -> Column:
            opened = F.struct(F.array_append(s["open"], F.struct(tag.alias("name"), F.size(s["out"]).alias("at"))).alias("open"), F.array_append(s["out"], part).alias("out"))
            plain = F.struct(s["open"].alias("open"), F.array_append(s["out"], part).alias("out"))

            def closed(at: Column) -> Column:
                cut = F.struct(F.filter(s["open"], lambda o: o["at"] < at).alias("open"), F.array_append(F.slice(s["out"], F.lit(1), at), _past(part)).alias("out"))
                return F.when(at.isNull(), plain.cast(state)).otherwise(cut.cast(state))

            last = F.try_element_at(F.filter(s["open"], lambda o: F.concat(F.lit("/"), o["name"]) == tag), F.lit(-1))["at"]
            return F.when(tag == "", plain.cast(state)).when(tag.startswith("/"), let(last, closed)).otherwise(opened.cast(state))

        return let(_tag(part, names), by)

    return let(out, lambda t: F.when(t.rlike(rf"(?i)</(?:{'|'.join(names)})(?![\w-])"), F.aggregate(_at_tags(t, names), zero, step, lambda s: F.array_join(s["out"], ""))).otherwise(t))


def strip_chrome(c: ColumnLike) -> Column:
    """Navigation, footers, scripts, styles and forms removed; headers stay."""
    return without_tags(c, config.CHROME_TAGS)


def _tables(c: Column) -> Column:
    """Tables as lines: a row is ``| cell | cell |``, with the marks inside a cell as blanks; a table in a cell follows its row, with rows of its own."""
    names = ("table", "tr", "td", "th")
    state = "struct<open:array<struct<lines:array<string>,cells:array<string>,below:array<string>>>,out:array<string>>"
    zero = F.expr(f"cast(named_struct('open', array(), 'out', array()) as {state})")
    none = F.array().cast("array<string>")

    def table(lines: Column, cells: Column, below: Column) -> Column:
        return F.struct(lines.alias("lines"), cells.alias("cells"), below.alias("below"))

    def row(cells: Column) -> Column:
        blank = lambda x: trim_all(F.regexp_replace(F.regexp_replace(x, r"(?i)</?(p|div|br|ul|ol|li|h[1-6]|section|article|header|blockquote|pre|dl|dt|dd)\b[^>]*>", " "), r"\s+", " "))
        return F.concat(F.lit("| "), F.array_join(F.transform(cells, blank), " | "), F.lit(" |"))

    def flushed(t: Column) -> Column:
        """A table with its row, if it has one, among its lines."""
        return F.when(F.size(t["cells"]) == 0, table(F.concat(t["lines"], t["below"]), none, none)).otherwise(table(F.concat(t["lines"], F.array(row(t["cells"])), t["below"]), none, none))

    def text(t: Column, x: Column) -> Column:
        """A table with a text in its last cell; between rows a text is a line."""
        n = F.size(t["cells"])
        into = table(t["lines"], F.array_append(F.slice(t["cells"], F.lit(1), n - 1), F.concat(F.element_at(t["cells"], -1), x)), t["below"])
        return F.when(trim_all(x) == "", t).when(n == 0, table(F.array_append(t["lines"], x), none, t["below"])).otherwise(into)

    def step(s: Column, part: Column) -> Column:
        deep = F.size(s["open"])
        outer = F.slice(s["open"], F.lit(1), F.greatest(deep - 1, F.lit(0)))
        top = F.try_element_at(s["open"], F.lit(-1))

        def become(opened: Column, out: Column) -> Column:
            return F.struct(opened.alias("open"), out.alias("out")).cast(state)

        def with_top(t: Column) -> Column:
            return become(F.array_append(outer, t), s["out"])

        def closing() -> Column:
            inner = flushed(top)["lines"]
            parent = F.element_at(outer, -1)
            below = text(table(parent["lines"], parent["cells"], F.concat(parent["below"], inner)), _past(part))
            at_root = become(outer, F.concat(s["out"], F.array(F.concat(F.lit("\n"), F.array_join(inner, "\n"), F.lit("\n"), _past(part)))))
            return F.when(deep == 1, at_root).otherwise(become(F.array_append(F.slice(outer, F.lit(1), deep - 2), below), s["out"]))

        def by(tag: Column) -> Column:
            rest = F.when(tag == "", part).otherwise(_past(part))
            cell = table(top["lines"], F.array_append(top["cells"], rest), top["below"])
            return (
                F.when(tag == "table", become(F.array_append(s["open"], text(table(none, none, none), rest)), s["out"]))
                .when(deep == 0, become(s["open"], F.array_append(s["out"], F.when(tag == "", part).otherwise(F.concat(F.lit("\n"), rest)))))
                .when(tag == "/table", closing())
                .when(tag.isin("tr", "/tr"), with_top(text(flushed(top), rest)))
                .when(tag.isin("td", "th"), with_top(cell))
                .otherwise(with_top(text(top, rest)))
            )

        return let(_tag(part, names), by)

    def finish(s: Column) -> Column:
        left = F.flatten(F.transform(s["open"], lambda t: flushed(t)["lines"]))  # tables that are never closed
        return F.concat(F.array_join(s["out"], ""), F.when(F.size(left) > 0, F.concat(F.lit("\n"), F.array_join(left, "\n"))).otherwise(""))

    return F.when(F.lower(c).contains("<table"), F.aggregate(_at_tags(c, names), zero, step, finish)).otherwise(c)


def _lists(c: Column) -> Column:
    """List items as lines with ``- ``, one indentation for each list around theirs."""
    names = ("ul", "ol", "li")

    def step(s: Column, part: Column) -> Column:
        def by(tag: Column) -> Column:
            deep = F.when(tag.isin("ul", "ol"), s["deep"] + 1).when(tag.isin("/ul", "/ol"), F.greatest(s["deep"] - 1, F.lit(0))).otherwise(s["deep"])
            rest = F.when(tag == "", part).when(tag == "li", F.concat(F.lit("\n"), F.repeat(F.lit(_INDENT), F.greatest(deep - 1, F.lit(0))), F.lit("- "), F.ltrim(_past(part)))).otherwise(F.concat(F.lit("\n"), _past(part)))
            return F.struct(deep.cast("int").alias("deep"), F.array_append(s["out"], rest).alias("out")).cast("struct<deep:int,out:array<string>>")

        return let(_tag(part, names), by)

    zero = F.expr("cast(named_struct('deep', 0, 'out', array()) as struct<deep:int,out:array<string>>)")
    return F.when(F.lower(c).contains("<li"), F.aggregate(_at_tags(c, names), zero, step, lambda s: F.array_join(s["out"], ""))).otherwise(c)


def visible_text(c: ColumnLike, sep: str = " ") -> Column:
    """Text nodes without markup and comments; runs of white space become ``sep``."""
    out = F.regexp_replace(col(c), r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "\n")
    out = F.replace(decode_entities(out), F.lit("\u00a0"), F.lit(" "))
    return F.regexp_replace(trim_all(out), r"\s*\n\s*", sep)


def title(c: ColumnLike) -> Column:
    """The trimmed title, empty if none."""
    return trim_all(decode_entities(F.regexp_extract(col(c), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def hrefs(c: ColumnLike) -> Column:
    """The href of each anchor, as written."""
    return F.regexp_extract_all(col(c), F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))


def looks_like_html(c: ColumnLike) -> Column:
    """Whether one of the usual tags stands in the first 4,000 characters."""
    return F.lower(F.substring(col(c), 1, 4000)).rlike("<html|<body|<div|<a |<p>")


def to_markdown(c: ColumnLike) -> Column:
    """Main content as Markdown: the article or main element (else the body) without chrome, headings as ``#``, list items as ``- ``, table rows as ``| cell | cell |``.

    A list in a list is indented, a table in a cell follows the row of the cell.
    """
    def content(t: Column) -> Column:
        parts = [F.regexp_extract(t, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}\s*>", 1) for tag in ("article", "main")]
        body = F.regexp_extract(t, r"(?is)<body\b[^>]*>(.*)", 1)
        return F.coalesce(*[F.nullif(x, F.lit("")) for x in (*parts, body)], t)

    t = let(F.translate(F.regexp_replace(strip_chrome(c), r"(?s)<!--.*?-->", ""), _INDENT, ""), content)
    t = let(let(F.regexp_replace(t, r"\s+", " "), _tables), _lists)
    for n in range(1, 7):
        t = F.regexp_replace(t, rf"(?i)<h{n}\b[^>]*>\s*", "\n" + "#" * n + " ")
    t = F.regexp_replace(t, r"(?i)</?(p|div|br|h[1-6]|section|article|header|blockquote|pre|dl|dt|dd)\b[^>]*>", "\n")
    t = decode_entities(F.regexp_replace(t, r"<[^>]*>", ""))
    return F.replace(trim_all(F.regexp_replace(t, r" *\n[ \n]*", "\n")), F.lit(_INDENT), F.lit("  "))


def stylesheet(c: ColumnLike) -> Column:
    """Text of style elements and style attributes, by lines."""
    blocks = F.regexp_extract_all(col(c), F.lit(r"(?is)<style\b[^>]*>(.*?)</style>"), F.lit(1))
    inline = F.regexp_extract_all(col(c), F.lit(r"""(?is)\bstyle\s*=\s*"([^"]*)" """.strip()), F.lit(1))
    return F.concat_ws("\n", blocks, inline)


def stylesheet_links(c: ColumnLike, base: ColumnLike) -> Column:
    """Resolved addresses of linked style sheets, to join with a table of fetched ones."""
    tags = F.filter(F.regexp_extract_all(col(c), F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)), lambda x: F.lower(x).rlike(r"rel\s*=\s*[\"'][^\"']*stylesheet"))
    return F.filter(F.transform(tags, lambda x: urls.resolve(F.regexp_extract(x, r"""(?is)\bhref\s*=\s*["']([^"']*)["']""", 1), base)), lambda x: x.isNotNull())


def logo(c: ColumnLike, base: ColumnLike) -> Column:
    """The site's logo: a header image that says so, the social-media image, the first header image, the icon; resolved, or null."""
    html = col(c)
    head = F.regexp_extract(html, r"(?is)<header\b[^>]*>(.*?)</header>", 1)
    images = F.regexp_extract_all(head, F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))
    src = lambda tag: F.regexp_extract(tag, r"""(?is)\bsrc\s*=\s*["']([^"']*)["']""", 1)
    named = F.try_element_at(F.filter(images, lambda x: x.rlike(r"""(?is)\b(src|alt|class|id)\s*=\s*["'][^"']*logo""")), F.lit(1))
    social = F.regexp_extract(html, r"""(?is)<meta\b[^>]*property\s*=\s*["']og:image["'][^>]*content\s*=\s*["']([^"']*)["']""", 1)
    icon = F.regexp_extract(html, r"""(?is)<link\b[^>]*rel\s*=\s*["'][^"']*icon[^"']*["'][^>]*href\s*=\s*["']([^"']*)["']""", 1)
    first = F.try_element_at(images, F.lit(1))
    found = F.coalesce(*[F.nullif(x, F.lit("")) for x in (src(named), social, src(first), icon)])
    return F.when(found.isNotNull(), urls.resolve(found, base))
