"""Pages to heading-path blocks, paragraphs across documents, and boilerplate removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import config
from textloom.functions import html as H
from textloom.functions import text as T

BLOCKS = "array<struct<heading_path:string,text:string>>"
HEADING = r"^(#{1,6})\s+(.*)$"


def markdown_blocks(md: Column, fallback: Column) -> Column:
    """Blocks of a Markdown text: body lines under the path of headings above them, by one fold over the lines.

    A heading closes the block and pops headings of its level or deeper; an empty heading only pops. The path joins the stack with " > ",
    labels equal to the one before left out; without headings it is the fallback title. Chrome lines and shortcodes go, blank lines stay.
    """
    lines = F.split(F.regexp_replace(F.coalesce(md, F.lit("")), r"\r\n|[\r\x0B\f\x1c-\x1e\x85\u2028\u2029]", "\n"), "\n")
    state = f"struct<st:array<struct<lv:int,tx:string>>,buf:array<string>,bl:{BLOCKS}>"
    zero = F.expr(f"cast(named_struct('st', array(), 'buf', array(), 'bl', array()) as {state})")

    def path(st: Column) -> Column:
        names = F.filter(F.transform(st, lambda h: T.trim_all(h["tx"])), lambda x: x != "")
        once = F.aggregate(names, F.array().cast("array<string>"), lambda acc, x: F.when((F.size(acc) > 0) & F.try_element_at(acc, F.lit(-1)).eqNullSafe(x), acc).otherwise(F.array_append(acc, x)))
        return T.let(once, lambda o: F.when(F.size(o) > 0, F.array_join(o, " > ")).otherwise(fallback))

    def flushed(s: Column) -> Column:
        body = T.trim_all(F.array_join(s["buf"], "\n"))
        return T.let(body, lambda b: F.when(b == "", s["bl"]).otherwise(F.array_append(s["bl"], F.struct(path(s["st"]).alias("heading_path"), b.alias("text")))))

    def read(line: Column) -> Column:
        label = T.trim_all(F.regexp_replace(T.trim_all(F.regexp_extract(line, HEADING, 2)), r"^#+|#+$", ""))
        body = T.trim_all(F.regexp_replace(line, config.SHORTCODE, ""))
        dropped = T.let(body, lambda b: (line != "") & (F.lower(line).isin(list(config.CHROME_LINES)) | (b == "")))
        return F.struct(F.length(F.regexp_extract(line, HEADING, 1)).alias("level"), label.alias("label"), body.alias("body"), dropped.alias("dropped"))

    def step(s: Column, x: Column) -> Column:
        def headed() -> Column:
            above = F.filter(s["st"], lambda h: h["lv"] < x["level"])
            stack = F.when(x["label"] == "", above).otherwise(F.array_append(above, F.struct(x["level"].alias("lv"), x["label"].alias("tx"))))
            return F.struct(stack.alias("st"), F.array().cast("array<string>").alias("buf"), flushed(s).alias("bl"))

        kept = F.struct(s["st"].alias("st"), F.array_append(s["buf"], x["body"]).alias("buf"), s["bl"].alias("bl"))
        return F.when(x["level"] > 0, headed().cast(state)).when(x["dropped"], s).otherwise(kept.cast(state))

    # each line is read once, before the fold
    return F.aggregate(F.transform(lines, lambda raw: T.let(T.trim_all(raw), read)), zero, step, flushed)


def page_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block_ord, heading_path, text) of HTML pages; the title, or the url without one, is the fallback."""
    name = T.let(H.title("html"), lambda t: F.when(t == "", F.col("url")).otherwise(t))
    blocks = pages.select("page_id", T.let(name, lambda n: markdown_blocks(H.to_markdown("html"), n)).alias("blocks"))
    return blocks.select("page_id", F.posexplode("blocks").alias("block_ord", "b")).select("page_id", F.col("block_ord").cast("long"), "b.heading_path", "b.text")


def text_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, text): plain-text documents as one block each, blanks squeezed; blank ones give none."""
    return docs.select("doc_id", T.squeeze_blanks("text").alias("text")).filter("text <> ''")


def paragraphs(blocks: DataFrame, key: str, even: Column | None = None) -> DataFrame:
    """(key, pos, para, h): paragraphs by newline runs, with their hash; blank ones are left out. ``even`` (see ``text.facts``) of a text holds for its paragraphs."""
    cut = blocks.select(key, F.lit(False).alias("even") if even is None else even.alias("even"), F.posexplode(T.lines("text")).alias("pos", "raw"))
    cut = cut.select(key, F.col("pos").cast("long"), T.trim_all("raw").alias("para"), "even").filter("para <> ''")
    return cut.withColumn("h", T.text_hash("para", None if even is None else F.col("even"))).drop("even")


def paragraph_hashes(paras: DataFrame, key: str, min_chars: int = config.SETTINGS.boilerplate_min_chars) -> DataFrame:
    """(key, h, counts): the distinct hashes of a document's paragraphs, and whether one of that hash has enough characters."""
    return paras.groupBy(key, "h").agg(F.max(F.length("para") >= min_chars).alias("counts"))


def paragraph_frequency(paras: DataFrame, key: str, min_chars: int = config.SETTINGS.boilerplate_min_chars) -> DataFrame:
    """(h, n_docs): documents in which a paragraph of enough characters stands; a row a (document, hash) before counting, so no distinct sets."""
    return _frequency(paragraph_hashes(paras.filter(F.length("para") >= min_chars), key, min_chars))


def _frequency(hashes: DataFrame) -> DataFrame:
    return hashes.filter("counts").groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"))


def boilerplate(paras: DataFrame, docs: DataFrame, key: str, fraction: float = config.SETTINGS.boilerplate_doc_fraction, least: int = config.SETTINGS.boilerplate_min_pages) -> DataFrame:
    """Hashes of paragraphs on at least ``max(least, floor(n * fraction))`` of the n documents; none if there are fewer than ``least``.

    At most 1 / fraction paragraphs a document pass, so the table is small; Spark broadcasts it where its measured size allows.
    """
    return frequent(paragraph_hashes(paras, key), docs, fraction, least)


def frequent(hashes: DataFrame, docs: DataFrame, fraction: float, least: int) -> DataFrame:
    """``boilerplate`` of ``paragraph_hashes``."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    found = _frequency(hashes).join(F.broadcast(n))  # one row
    return found.filter((F.col("n") >= least) & (F.col("n_docs") >= F.greatest(F.lit(least), F.floor(F.col("n") * fraction)))).select("h", "n_docs")


def strip_boilerplate(paras: DataFrame, boiler: DataFrame, key: str) -> DataFrame:
    """(key, text): documents put together again from paragraphs that are not boilerplate; those left empty go."""
    kept = paras.join(boiler.select("h"), "h", "left_anti")
    lines = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "para"))).alias("ps"))
    return lines.select(key, F.array_join(F.transform("ps", lambda p: p["para"]), "\n").alias("text"))


def without(texts: Column, gone: Column) -> Column:
    """The text that is left of a document's ``texts`` without the paragraphs whose hashes are in ``gone`` (null: none), which need hashes only where some go; "" if nothing is."""
    def cut(text: Column) -> Column:
        return F.filter(F.transform(T.lines(text), lambda x, i: F.struct(i.alias("pos"), T.trim_all(x).alias("para"))), lambda p: p["para"] != "")

    one = T.let(F.flatten(F.transform(texts, cut)), lambda ps: F.when(F.size(texts) > 1, F.array_sort(ps)).otherwise(ps))
    left = T.let(one, lambda ps: F.when(gone.isNull(), ps).otherwise(F.filter(ps, lambda p: ~F.array_contains(gone, T.text_hash(p["para"])))))
    return F.array_join(F.transform(left, lambda p: p["para"]), "\n")
