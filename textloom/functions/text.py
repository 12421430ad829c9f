"""Column functions on text: tokens, sentences, terms, hashes and the junk predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom import config

ColumnLike = Column | str
#: White space as ``(?U)\\s`` has it.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(x: Column, f) -> Column:
    """f(x) with x worked out once, however often f uses it."""
    return F.element_at(F.transform(F.array(x), lambda v: f(v)), 1)


def trim_all(c: ColumnLike) -> Column:
    """Strip white space of any kind (Spark's trim knows U+0020 only)."""
    return F.btrim(col(c), F.lit(BLANKS))


def squeeze(c: ColumnLike) -> Column:
    """Lower case, white-space runs as one space, trimmed: the text that equality of passages is judged by. (A single space is such a run already.)"""
    return F.regexp_replace(F.lower(trim_all(c)), r"(?U)\s(?<! (?!\s))\s*", " ")


def text_hash(c: ColumnLike, even: Column | None = None) -> Column:
    """The hash of ``squeeze``; of an ``even`` text (see ``facts``) that takes no pattern."""
    if even is None:
        return F.sha2(squeeze(c), 256)
    return F.sha2(F.when(even, F.lower(F.replace(col(c), F.lit("\n"), F.lit(" ")))).otherwise(squeeze(c)), 256)


def facts(c: ColumnLike) -> Column:
    """Whether a text is ``even``, that is its only blanks are single spaces and newlines between words, and of an even one: words, words of one character, sentence marks, lines and their characters.

    Most texts are even. Those that are not have nulls: the expressions of this module tell of any text, at some times the cost. A text is counted in an Arrow batch.
    """

    def run(texts):
        import pandas as pd

        out = []
        for t in texts:
            words = (t or "").split()  # at blanks of any kind, and at some controls more
            if t is None or " ".join(words) != t.replace("\n", " "):
                out.append((False, None, None, None, None, None))
            else:
                ends = t.count("\n")
                out.append((True, len(words), sum(len(w) == 1 for w in words), t.count(".") + t.count("!") + t.count("?"), ends + 1 if t else 0, len(t) - ends))
        return pd.DataFrame(out, columns=["even", "words", "singles", "marks", "lines", "total"]).astype({x: "Int32" for x in ("words", "singles", "marks", "lines", "total")})

    return F.pandas_udf(run, "even boolean, words int, singles int, marks int, lines int, total int")(col(c))


def words(c: ColumnLike) -> Column:
    """White-space words; none for a blank text. (Only blanks at the ends make empty ones.)"""
    return F.array_remove(F.split(col(c), r"(?U)\s+"), "")


def lines(c: ColumnLike) -> Column:
    """A text cut at newline runs. (A single character is no pattern.)"""
    return F.when(F.contains(col(c), F.lit("\n\n")), F.split(col(c), r"\n+")).otherwise(F.split(col(c), "\n"))


def word_count(c: ColumnLike) -> Column:
    """The default token counter."""
    return F.size(words(c)).cast("long")


def sentences(c: ColumnLike) -> Column:
    """Newline runs cut first; then the blank after ``.!?`` and an optional closing quote or bracket (dropped), before a capital, digit or opening character."""
    lines = F.split(col(c), r"\n+")
    cut = F.flatten(F.transform(lines, lambda x: F.split(x, r"""(?<=[.!?])["')\]]?\s+(?=[A-Z0-9("'\[])""")))
    return F.filter(F.transform(cut, trim_all), lambda x: x != "")


def query_terms(c: ColumnLike, site_words: tuple = config.SETTINGS.site_words) -> Column:
    """Terms of a question: ``[a-z0-9]+`` of three characters or more but the stop words; order and repeats are kept."""
    stop = [*config.STOPWORDS, *site_words]
    return F.filter(F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: (F.length(x) >= 3) & ~x.isin(stop))


def vocab_terms(heading: ColumnLike, body: ColumnLike, site_words: tuple = config.SETTINGS.site_words) -> Column:
    """Distinct terms ``[a-z][a-z0-9]{2,}`` of heading and body but the stop words."""
    stop = [*config.STOPWORDS, *site_words]
    text = F.lower(F.concat(F.coalesce(col(heading), F.lit("")), F.lit("\n"), F.coalesce(col(body), F.lit(""))))
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit("[a-z][a-z0-9]{2,}"), F.lit(0)), lambda x: ~x.isin(stop)))


def whole_words(c: ColumnLike) -> Column:
    """Lower-case whole words."""
    return F.split(F.lower(F.coalesce(col(c), F.lit(""))), r"[^\p{L}\p{N}_]+")


def tokens_set(c: ColumnLike) -> Column:
    """Distinct lower-case whole words, for whole-word tests by ``array_contains``."""
    return F.array_distinct(whole_words(c))


def sentence_marks(c: ColumnLike) -> Column:
    return F.regexp_count(col(c), F.lit("[.!?]"))


def looks_like_nav(c: ColumnLike, known: Column | None = None) -> Column:
    """Menus and link lists: few words without a sentence mark, a menu prefix or phrase, or many short lines with hardly a mark. ``known``: the text's ``facts``, where they are at hand."""
    return let(trim_all(c), lambda t: _nav(t, known))


def _nav(t: Column, known: Column | None) -> Column:
    def of(x: Column) -> Column:
        marks, n, total = x["marks"], x["n"], x["total"]
        phrase = F.lit(False)
        for p in config.NAV_PHRASES:
            phrase = phrase | F.lower(t).contains(p)
        return (
            ((marks == 0) & (word_count(t) < 12))
            | ((marks == 0) & t.rlike(rf"(?i)^{config.NAV_PREFIX}\b"))
            | ((marks <= 1) & phrase)
            | ((n >= 10) & (marks <= F.greatest(F.lit(1), F.floor(n * 0.08))) & (total < 45 * n))
        )

    lengths = F.filter(F.transform(F.split(t, r"[\v\x1c-\x1e]+"), lambda x: F.length(trim_all(x))), lambda n: n > 0)
    counted = let(lengths, lambda ns: F.struct(sentence_marks(t).alias("marks"), F.size(ns).alias("n"), F.aggregate(ns, F.lit(0), lambda a, n: a + n).alias("total")))
    if known is not None:
        counted = F.when(known["even"], F.struct(known["marks"].alias("marks"), known["lines"].alias("n"), known["total"].alias("total"))).otherwise(counted)
    return let(counted, of)


def looks_like_garbage(c: ColumnLike, known: Column | None = None) -> Column:
    """Twenty words or more, over two fifths of them single characters. ``known`` as above."""
    said = let(words(c), lambda w: (F.size(w) >= 20) & (F.size(F.filter(w, lambda x: F.length(x) == 1)) > 0.40 * F.size(w)))
    return said if known is None else F.when(known["even"], (known["words"] >= 20) & (known["singles"] > 0.40 * known["words"])).otherwise(said)


def looks_like_shell(c: ColumnLike) -> Column:
    """An unrendered page template: two ``{{`` or more, and a ``}}``."""
    return (F.regexp_count(col(c), F.lit(r"\{\{")) >= 2) & col(c).contains("}}")


def strip_markers(c: ColumnLike) -> Column:
    """Answer text without citation markers, doubled blanks and empty parentheses."""
    out = F.regexp_replace(col(c), r"\s*\[\d+\]", "")
    return trim_all(F.regexp_replace(F.regexp_replace(out, r"\(\s*\)", ""), r"[ \t]{2,}", " "))


def squeeze_blanks(c: ColumnLike) -> Column:
    """Plain text of a page-less document: blanks and tabs squeezed, newlines kept."""
    return trim_all(F.regexp_replace(col(c), r" [ \t]+|\t[ \t]*", " "))


def indel_ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """100 * 2 * LCS / (|a| + |b|): the insert-delete similarity, by a fold of one row of the LCS table over the letters of ``a``."""
    x, y = col(a), col(b)

    def of(letters: Column) -> Column:
        def step(row: Column, ch: Column) -> Column:
            def cell(acc: Column, j: Column) -> Column:
                left, up, diag = F.element_at(acc, -1), F.element_at(row, j + 1), F.element_at(row, j)
                return F.array_append(acc, F.when(F.element_at(letters, j) == ch, diag + 1).otherwise(F.greatest(left, up)))

            return F.aggregate(F.sequence(F.lit(1), F.size(letters)), F.array(F.lit(0)), cell)

        return F.element_at(F.aggregate(F.split(x, ""), F.array_repeat(F.lit(0), F.size(letters) + 1), step), -1)

    lcs = let(F.split(y, ""), of)
    total = F.length(x) + F.length(y)
    return F.when(total == 0, 100.0).when((F.length(x) == 0) | (F.length(y) == 0), 0.0).otherwise(200.0 * lcs / total)
