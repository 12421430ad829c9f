"""Brand mining: colours, fonts and custom properties of style sheets, contrast, and rewriting of saved pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom import config
from textloom.functions import text as T
from textloom.functions import urls as U


def hex6(c: Column) -> Column:
    """#rrggbb in lower case, from three or six digits."""
    h = F.lower(F.regexp_replace(c, "^#+", ""))
    return F.concat(F.lit("#"), F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h))


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb from decimal strings; a part above 255 keeps all its digits."""
    part = lambda x: F.when(x.cast("long") < 16, F.concat(F.lit("0"), F.lower(F.hex(x.cast("long"))))).otherwise(F.lower(F.hex(x.cast("long"))))
    return F.concat(F.lit("#"), part(r), part(g), part(b))


def channel(c: Column, i: int) -> Column:
    return F.conv(F.substring(c, 2 + 2 * i, 2), 16, 10).cast("long")


def is_neutral(c: Column) -> Column:
    """Near white, near black or nearly grey."""
    parts = [channel(c, i) for i in range(3)]
    hi, lo = F.greatest(*parts), F.least(*parts)
    return ((hi > 240) & (lo > 220)) | (hi < 30) | (hi - lo < 18)


def text_on(c: Column) -> Column:
    """Readable text colour on a background, by its luminance."""
    light = (0.299 * channel(c, 0) + 0.587 * channel(c, 1) + 0.114 * channel(c, 2)) / 255
    return F.when(light > 0.6, "#111111").otherwise("#ffffff")


def colours(sheets: DataFrame, key: str) -> DataFrame:
    """(key, pos, colour): colours as written in ``css``, hex forms first, then rgb forms; neutral ones go."""
    hexes = F.transform(F.regexp_extract_all("css", F.lit(config.HEX_COLOUR), F.lit(0)), hex6)
    parts = [F.regexp_extract_all("css", F.lit(config.RGB_COLOUR), F.lit(i)) for i in (1, 2, 3)]
    rgbs = F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "rgb", strict=True)]), lambda z: rgb_hex(z["r"], z["g"], z["b"]))
    each = sheets.select(key, F.posexplode(F.concat(hexes, rgbs)).alias("pos", "colour"))
    return each.select(key, F.col("pos").cast("long"), "colour").filter(~is_neutral(F.col("colour")))


def ranked(values: DataFrame, value: str, order: list[str], k: int | None = None) -> DataFrame:
    """(value, n): by count, ties to the first occurrence; the first k if asked."""
    counted = values.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first"))
    out = counted.orderBy(F.desc("n"), "first")
    return (out.limit(k) if k else out).drop("first")


def fonts(sheets: DataFrame, key: str) -> DataFrame:
    """(key, pos, font): font stacks as written, without inherited, variable and icon fonts."""
    each = sheets.select(key, F.posexplode(F.regexp_extract_all("css", F.lit(config.FONT_FAMILY), F.lit(1))).alias("pos", "raw"))
    named = each.select(key, F.col("pos").cast("long"), F.regexp_replace(F.regexp_replace(T.trim_all("raw"), r"^['\"]+", ""), r"['\"]+$", "").alias("font"))
    low = F.lower("font")
    return named.filter((F.col("font") != "") & ~low.contains("inherit") & ~low.contains("var(") & ~low.startswith("--") & ~low.rlike(config.ICON_FONT))


def css_vars(sheets: DataFrame, key: str) -> DataFrame:
    """(key, name, colour, pos): custom properties that name a colour; the last value that is not neutral, at the place of the first."""
    names, values = (F.regexp_extract_all("css", F.lit(config.CSS_VAR), F.lit(i)) for i in (1, 2))
    each = sheets.select(key, F.posexplode(F.arrays_zip(names.alias("n"), values.alias("v"))).alias("pos", "z")).select(key, F.col("pos").cast("long"), F.lower("z.n").alias("name"), F.col("z.v").alias("v"))
    hx = F.regexp_extract("v", config.HEX_COLOUR, 0)
    rgb = [F.regexp_extract("v", config.RGB_COLOUR, i) for i in (1, 2, 3)]
    value = F.when(hx != "", hex6(hx)).when(rgb[0] != "", rgb_hex(*rgb))
    good = each.withColumn("colour", value).filter(F.col("colour").isNotNull() & ~is_neutral(F.col("colour")))
    return good.groupBy(key, "name").agg(F.max_by("colour", "pos").alias("colour"), F.min("pos").alias("pos"))


def pick_var(variables: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """(key, colour): the first variable whose name holds the first of the wanted words that any name holds."""
    rank = F.coalesce(*[F.when(F.col("name").contains(w), i) for i, w in enumerate(wanted)])
    return variables.withColumn("r", rank).filter("r IS NOT NULL").groupBy(key).agg(F.min_by("colour", F.struct("r", "pos")).alias("colour"))


# The theme where a page says nothing.
NEUTRAL = {"primary": "#1f4e79", "secondary": "#4a6fa5", "accent": "#c8963e", "font_body": "system-ui, sans-serif", "font_heading": "system-ui, sans-serif"}


def brand(sheets: DataFrame, key: str) -> DataFrame:
    """(key, primary, secondary, accent, font_body, font_heading, top_colors, fallbacks) of each sheet.

    A colour role takes its variable, else the most frequent colour that no role has taken yet, else the neutral theme's (listed in fallbacks).
    """
    base = sheets.select(key)
    variables = css_vars(sheets, key)
    for role, words in (("primary", ["primary", "brand", "main"]), ("secondary", ["secondary"]), ("accent", ["accent"])):
        base = base.join(pick_var(variables, key, words).withColumnRenamed("colour", f"var_{role}"), key, "left")

    def listed(rows: DataFrame, value: str, name: str) -> DataFrame:
        counted = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
        return counted.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "first", F.col(value).alias("v"), "n"))).alias(name))

    base = base.join(listed(colours(sheets, key), "colour", "cs"), key, "left").join(listed(fonts(sheets, key), "font", "fs"), key, "left")
    rank = F.coalesce(F.transform("cs", lambda c: c["v"]), F.array().cast("array<string>"))
    taken = F.filter(F.array("var_primary", "var_secondary", "var_accent"), lambda x: x.isNotNull())
    for role in ("primary", "secondary", "accent"):
        nxt = F.try_element_at(F.array_except(rank, F.col("__taken")), F.lit(1))
        base = base.withColumn("__taken", taken if role == "primary" else F.col("__taken")).withColumn(f"got_{role}", F.coalesce(f"var_{role}", nxt))
        base = base.withColumn("__taken", F.array_union("__taken", F.filter(F.array(f"got_{role}"), lambda x: x.isNotNull())))
    font = lambda i: F.try_element_at(F.transform("fs", lambda f: f["v"]), F.lit(i))
    got = {"primary": F.col("got_primary"), "secondary": F.col("got_secondary"), "accent": F.col("got_accent"), "font_body": font(1), "font_heading": F.coalesce(font(2), font(1))}
    lost = F.filter(F.array(*[F.when(v.isNull(), k) for k, v in got.items()]), lambda x: x.isNotNull())
    top = F.coalesce(F.transform(F.slice("cs", 1, 8), lambda c: F.struct(c["v"].alias("colour"), c["n"].alias("n"))), F.array().cast("array<struct<colour:string,n:bigint>>"))
    return base.select(key, *[F.coalesce(v, F.lit(NEUTRAL[k])).alias(k) for k, v in got.items()], top.alias("top_colors"), lost.alias("fallbacks"))


def rewrite_saved_page(html: Column, trackers: tuple = config.TRACKERS, asset_prefixes: tuple = (), images: str | None = None, inject: str = "") -> tuple[Column, Column]:
    """(html, removed): trackers removed and counted, srcset dropped, asset folders renamed, images made local, ``inject`` before the first </body>."""
    out, removed = html, F.lit(0)
    for p in trackers:
        removed = removed + F.regexp_count(out, F.lit(p))
        out = F.regexp_replace(out, p, "")
    out = F.regexp_replace(out, r'\s+(?:data-)?srcset="[^"]*"', "")
    for p in asset_prefixes:
        out = F.replace(out, F.lit(p), F.lit("assets/"))
    if images:
        out = F.regexp_replace(out, images, "assets/$1")
    at = F.instr(out, "</body>")
    if inject:
        out = F.when(at > 0, F.concat(F.substring(out, F.lit(1), at - 1), F.lit(inject), F.substring(out, at, F.length(out)))).otherwise(out)
    return out, removed.cast("long")


def same_site_sheets(links: DataFrame, sheets: DataFrame) -> DataFrame:
    """(page_id, css): fetched sheets (css_url, css) of the linked addresses (page_id, css_url), in order of address."""
    got = links.join(sheets, "css_url")
    return got.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("css_url", "css"))), lambda x: x["css"]), "\n").alias("css"))


def first_by(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__r = 1").drop("__r")


def absolute(url: Column, base: Column) -> Column:
    return U.resolve(url, base)
