"""Curated chunks: link grids of saved pages, and sections with the first fitting mention in each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom import config
from textloom.functions import text as T

GRID = "array<struct<grid:string,label:string,href:string>>"


def _grids(html: str | None) -> list[tuple[str, str, str]]:
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        """Elements as [tag, attrs, children, text, parent]; void elements close themselves."""

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.root = self.at = ["", {}, [], [], None]

        def handle_starttag(self, tag, attrs):
            node = [tag, {k: v or "" for k, v in attrs}, [], [], self.at]
            self.at[2].append(node)
            self.at[3].append(node)
            if tag not in ("img", "br", "hr", "input", "meta", "link"):
                self.at = node

        def handle_endtag(self, tag):
            n = self.at
            while n[4] is not None and n[0] != tag:
                n = n[4]
            if n[4] is not None:
                self.at = n[4]

        def handle_data(self, data):
            self.at[3].append(data)

    def walk(n):
        for c in n[2]:
            yield c
            yield from walk(c)

    def text(n):
        return " ".join(" ".join(x if isinstance(x, str) else text(x) for x in n[3]).split())

    def buttons(scope, grid):
        seen = set()
        for a in walk(scope):
            if a[0] == "a" and "gem-button" in a[1].get("class", "").split():
                label = text(a)
                if label and label.lower() not in seen:
                    seen.add(label.lower())
                    yield grid, label, a[1].get("href", "")

    t = Tree()
    t.feed(html or "")
    out = []
    for n in walk(t.root):
        if n[1].get("id") == "buttonsections":
            out += buttons(n, "buttons")
            break
    for n in walk(t.root):
        if n[0] == "img" and "portals" in n[1].get("alt", "").lower():
            up = n
            for _ in range(8):
                up = up[4] if up is not None else None
                if up is not None and "vc_row" in up[1].get("class", "").split():
                    out += buttons(up, "portals")
                    break
            break
    return out


def link_grids(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``grids``: labelled buttons of the section grid and of the row that holds the portals image; labels once, by lower case."""
    def run(h):
        return h.map(lambda x: [{"grid": g, "label": b, "href": u} for g, b, u in _grids(x)])

    return pages.withColumn("grids", F.pandas_udf(run, GRID)(F.col(html)))


def grid_text(grids: Column, grid: str, intro: str) -> Column:
    """A chunk's text: an intro and ``- label: href`` lines."""
    mine = F.filter(grids, lambda g: g["grid"] == grid)
    return F.concat(F.lit(intro + "\n"), F.array_join(F.transform(mine, lambda g: F.concat(F.lit("- "), g["label"], F.lit(": "), g["href"])), "\n"))


def mentions(texts: DataFrame, key: str, pattern: str, kind: str) -> DataFrame:
    """(key, kind, pos, value): matches of a pattern's first group with the offsets at which they begin, by cutting the text at each match."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    state = "struct<rest:string,at:int,out:array<int>>"
    zero = F.struct(F.col("text").alias("rest"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")).cast(state)

    def step(s: Column, m: Column) -> Column:
        i = F.position(m, s["rest"])
        end = i + F.length(m) - 1
        return F.struct(F.substring(s["rest"], end + 1, F.length(s["rest"])).alias("rest"), (s["at"] + end).alias("at"), F.array_append(s["out"], s["at"] + i).alias("out")).cast(state)

    places = F.aggregate(found, zero, step, lambda s: s["out"])
    each = texts.select(key, F.explode(F.arrays_zip(places.alias("p"), values.alias("v"))).alias("z"))
    return each.select(key, F.lit(kind).alias("kind"), F.col("z.p").cast("long").alias("pos"), T.trim_all("z.v").alias("value"))


def court_judges(texts: DataFrame, key: str) -> DataFrame:
    """(key, court, judge, number): the first acceptable judge between a court's first mention and the next court's, as an as-of join; empty if none.

    Each judge's mention belongs to the last court mentioned before it; the bare words notice and important, and what names a district, are no judges.
    """
    courts = mentions(texts, key, config.COURT, "court")
    courts = courts.groupBy(key, "value").agg(F.min("pos").alias("pos")).select(key, F.lit("court").alias("kind"), "pos", "value")
    judges = mentions(texts, key, config.JUDGE, "judge").filter(~F.lower("value").isin("notice", "important") & ~F.col("value").contains("District"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = courts.unionByName(judges).withColumn("court", F.last(F.when(F.col("kind") == "court", F.col("value")), ignorenulls=True).over(w))
    # a court without a judge keeps its row: its own mention is in its section
    judge = F.min(F.when(F.col("kind") == "judge", F.struct("pos", "value")))["value"]
    return placed.filter("court IS NOT NULL").groupBy(key, "court").agg(F.coalesce(judge, F.lit("")).alias("judge")).withColumn("number", F.regexp_extract("court", r"^\d+", 0).cast("long"))


def court_overview(pairs: DataFrame, key: str, intro: str) -> DataFrame:
    """(key, text): an overview chunk with a line a court, by number."""
    rows = pairs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("number", "court", "judge"))).alias("ps"))
    return rows.select(key, F.concat(F.lit(intro + "\n"), F.array_join(F.transform("ps", lambda p: F.concat(F.lit("- "), p["court"], F.lit(" District Court"), F.when(p["judge"] != "", F.concat(F.lit(": Judge "), p["judge"])).otherwise(F.lit("")))), "\n")).alias("text"))
