"""Nested elements: balanced removal, tables in cells and lists in lists."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import html as H


def apply(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, html string").select("i", f("html").alias("x"))
    return [r["x"] for r in rows.orderBy("i").collect()]


def test_chrome_goes_with_all_it_holds(spark):
    texts = [
        "a<nav>x<nav>y</nav>tail</nav>b", "<nav class='m'>x<NAV>y</NAV ></nav>a<footer>c<form>d</form></footer>b", "a<nav>never closed <form>x</form> b", "a</nav>b<nav>c</nav>",
        "a<script>'<nav>'</script>b<nav>x</nav>c", "<navigation>a</navigation><nav-bar>b</nav-bar>", "a<form><nav>x</form>b</nav>c", "", None, "plain",
        "a<noscript><nav>x</noscript>b<nav>c</nav>d",
    ]
    assert apply(spark, texts, H.strip_chrome) == ["ab", "ab", "a<nav>never closed  b", "a</nav>b", "abc", "<navigation>a</navigation><nav-bar>b</nav-bar>", "ab</nav>c", "", None, "plain", "abd"]


def tree(rng, depth):
    """(html, html without chrome) of a random well-formed tree."""
    shown, kept = "", ""
    for _ in range(rng.randint(0, 3)):
        tag = rng.choice(["nav", "form", "footer", "div", "b"])
        inner, inner_kept = tree(rng, depth - 1) if depth else ("t", "t")
        word = rng.choice(["x", "y ", " z"])
        shown += f"<{tag} a='1'>{inner}</{tag}>{word}"
        kept += (f"<{tag} a='1'>{inner_kept}</{tag}>" if tag in ("div", "b") else "") + word
    return shown, kept


def test_chrome_of_random_trees(spark):
    rng = random.Random(1)
    pairs = [tree(rng, 4) for _ in range(120)]
    assert apply(spark, [p[0] for p in pairs], H.strip_chrome) == [p[1] for p in pairs]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<table><tr><td>A<table><tr><td>in</td><td>er</td></tr><tr><td>2</td></tr></table></td><td>z</td></tr><tr><td>last</td></tr></table>", "| A | z |\n| in | er |\n| 2 |\n| last |"),
        ("<p>x</p><table><thead><tr><th>K</th><th>F</th></tr></thead><tbody><tr><td><p>Car</p><p>new</p></td><td>$5 <b>a</b> year</td></tr></tbody></table>End", "x\n| K | F |\n| Car new | $5 a year |\nEnd"),
        ("<table><caption>Fees</caption><tr><td>a<td>b<tr><td>c</table>d", "Fees\n| a | b |\n| c |\nd"),
        ("<table><tr><td>never</td><td>closed</td></tr>", "| never | closed |"),
        ("<ul><li>a<ul><li>b</li><li>c<ol><li>d</li></ol></li></ul></li><li>e</li></ul>f", "- a\n  - b\n  - c\n    - d\n- e\nf"),
        ("<li>alone</li>t\x01x", "- alone\ntx"),
        ("<table><tr><td><ul><li>a</li><li>b</li></ul></td><td>c</td></tr></table>", "| a b | c |"),
        ("<table></table>x", "x"),
        ("a</td>b", "ab"),
        ("", ""),
    ],
)
def test_nested_tables_and_lists(spark, page, want):
    assert spark.range(1).select(H.to_markdown(F.lit(page))).first()[0] == want


def rows_of(rng, depth):
    """(html, lines) of a random table: rows in order, the tables of a row's cells after it."""
    html, lines = "", []
    for _ in range(rng.randint(1, 3)):
        cells, below, inner = [], [], ""
        for _ in range(rng.randint(1, 3)):
            word = rng.choice("abc")
            inner += f"<td>{word}"
            if depth and rng.random() < 0.5:
                h, more = rows_of(rng, depth - 1)
                inner += h
                below += more
            inner += "</td>"
            cells.append(word)
        html += f"<tr>{inner}</tr>"
        lines += ["| " + " | ".join(cells) + " |", *below]
    return f"<table>{html}</table>", lines


def test_random_tables(spark):
    rng = random.Random(2)
    made = [rows_of(rng, 3) for _ in range(40)]
    assert apply(spark, [m[0] for m in made], H.to_markdown) == ["\n".join(m[1]) for m in made]
