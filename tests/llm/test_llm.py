"""The training-data operators: odd rows, brute force on small fixtures, and SQL where there is any."""

import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import oracle
from tests.conftest import SF
from textloom.llm import bloom, chat, compaction, exact_dedup, langid, mixing, near_dedup, pieces, quality, queries, topk, wrapper
from textloom.llm.common import materialize

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __gone string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, texts, ids=None):
    rows = [(i, t, "en" if i and i % 2 else None, None if i is None else f"s{i % 3}", 0, "x") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n\t", "a", "a", "A b", "a b c d e f g", "a b c d e f g", "é" * 50_000, "x " * 60_000, "日本 語", "\x00▁ ▁", "a b c d e f h"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    oracle.check(queries.QUERIES[name](spark, SF), oracle.connect(SF), queries.ORACLE_SQL[name])


# op1 ------------------------------------------------------------------------------------------------------------------------------------


def shingle_set(text, width):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def components(sets, num, den):
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and den * n >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}


def near_copies(seed, n):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(120)] for _ in range(4)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 10_000)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_equal_brute_force(spark):
    texts = ODD + near_copies(1, 160)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs(spark, texts), 3, 85, 100).collect()}
    sets = {i: shingle_set(t, 3) for i, t in enumerate(texts)}
    want = components(sets, 85, 100)
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())


def test_near_duplicates_of_large_buckets_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    texts = near_copies(2, 140)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs(spark, texts), 5, 80, 100).collect()}
    assert got == components({i: shingle_set(t, 5) for i, t in enumerate(texts)}, 80, 100)


def test_near_duplicates_empty_and_null_ids(spark):
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0
    got = near_dedup.near_duplicates(docs(spark, ["a b", "a b", "a b"], [None, 4, 7])).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(None, None, True), (4, 4, True), (7, 4, False)}


def test_pipeline_drop_keeps_one_of_each(spark):
    kept = near_dedup.drop_near_duplicates(docs(spark, ["a b c d e f", "a b c d e f", None, "q"]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3]
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]


# op2 ------------------------------------------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op2_language_id(spark, SF).join(d.select("doc_id", "lang"), "doc_id")
    right, n = got.filter("held_out AND lang IS NOT NULL").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and right >= 0.97
    assert got.filter("score < 0 OR score > 1").count() == 0


def test_language_scores_equal_the_kernel(spark):
    """Predictions against the kernel of whole n-gram sets, without hashing, folding or batches."""
    d = spark.read.parquet(f"{SF}/documents.parquet").filter("lang IS NOT NULL AND text IS NOT NULL").orderBy("doc_id").limit(120).collect()
    grams = [{r["text"].lower()[i : i + n] for n in range(1, langid.MAX_N + 1) for i in range(len(r["text"]) - n + 1)} for r in d]
    rows = np.zeros((len(d), langid.BUCKETS), np.uint8)
    for row, r in zip(rows, d, strict=True):
        langid.presence(r["text"], row)
    model = langid.Model.fit([r["lang"] for r in d[:80]], np.packbits(rows[:80], axis=1))
    kernel = lambda a, b: np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in b] for x in a])
    marks = [grams[i] for i in langid._turns([r["lang"] for r in d[:80]])[: langid.LANDMARKS]]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    root = vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()])
    z = np.c_[kernel(grams[:80], marks) @ root, np.ones(80)]
    f = []
    for lang in model.langs:
        y = np.array([1.0 if r["lang"] == lang else -1.0 for r in d[:80]])
        each = np.where(y > 0, 1 / (y > 0).sum(), 1 / (y < 0).sum())
        each *= 80 / each.sum()
        w = np.linalg.solve(z.T @ (z * each[:, None]) + langid.RIDGE * 80 * np.eye(z.shape[1]) / 10, z.T @ (y * each))
        f.append(np.c_[kernel(grams[80:], marks) @ root, np.ones(40)] @ w)
    direct = np.exp(langid.STEEP * (np.array(f).T - np.max(f, axis=0)[:, None]))
    names, scores = model.predict([r["text"] for r in d[80:]])
    assert names == [model.langs[i] for i in direct.argmax(axis=1)]
    assert np.abs(scores - (direct / direct.sum(axis=1, keepdims=True)).max(axis=1)).max() < 0.05  # hashing to BUCKETS places


def test_language_of_odd_rows(spark):
    d = docs(spark, [*ODD, "123 !!"]).withColumn("__p", F.lit("mine")).withColumn("told", F.lit("too"))
    assert {(r["__p"], r["told"]) for r in langid.predict(d, langid.train(d, F.lit(True))).collect()} == {("mine", "too")}
    model = langid.train(d, ~langid.held_out())
    got = {r["doc_id"]: r for r in langid.predict(d, model).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, len(ODD))] == ["und"] * 4
    assert got[8]["lang_pred"] == "en"
    none = langid.train(d.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(d, none).collect()} == {"und"}
    assert langid.predict(docs(spark, []), none).count() == 0


# op3 ------------------------------------------------------------------------------------------------------------------------------------


def test_exact_duplicates_of_odd_rows(spark):
    d = docs(spark, [*ODD, None, "a", "z", "z"], [*range(len(ODD)), 50, None, 9, 9])
    got = sorted((tuple(r) for r in exact_dedup.mark_duplicates(d).collect()), key=str)
    groups = defaultdict(list)
    for r in d.collect():
        groups[r["text"] or ""].append(r["doc_id"])
    for doc, keep, size, _, sha in got:
        ids = next(v for t, v in groups.items() if hashlib.sha256(t.encode()).hexdigest() == sha)
        assert doc in ids and size == len(ids) and keep == max(x for x in ids if x is not None)
    assert sum(r[3] for r in got) == len(groups)
    kept = exact_dedup.drop_duplicates(d)
    assert kept.count() == len(groups) and kept.columns == d.columns
    assert exact_dedup.mark_duplicates(docs(spark, [])).count() == 0 and exact_dedup.drop_duplicates(docs(spark, [])).count() == 0


def test_repeated_filter_misses_nothing(spark):
    h = spark.range(20_000).select(F.xxhash64(F.col("id") % 15_000).alias("h")).repartition(7)
    maybe = bloom.repeated_filter(h, 20_000)
    assert h.groupBy("h").count().filter(F.col("count") > 1).filter(~maybe("h")).count() == 0
    assert h.groupBy("h").count().filter(F.col("count") == 1).filter(maybe("h")).count() < 1_500


# op4 ------------------------------------------------------------------------------------------------------------------------------------


def test_compaction_versions_and_commits(spark, tmp_path):
    t = compaction.ShardedTable(spark, f"file://{tmp_path}/t", 1 << 20)
    d = docs(spark, [f"text {i} " * 50 for i in range(300)])
    assert t.manifest() == [] and t.read(d.schema).count() == 0
    for k in range(6):
        t.append(d.filter(F.col("doc_id") % 6 == k).repartition(2))
    assert t.versions() == [1, 2, 3, 4, 5, 6] and len(t.manifest()) == 12
    assert t.compact(d.schema) == 7
    assert len(t.manifest()) < 6 and sum(s["rows"] for s in t.manifest()) == 300
    assert t.read(d.schema, version=3).count() == 150
    assert t.compact(d.schema) == 7  # nothing left to merge
    assert t.vacuum() == 12
    assert sorted(r["doc_id"] for r in t.read(d.schema).collect()) == list(range(300))
    assert t.append(docs(spark, [])) == 8 and t.read(d.schema).count() == 300
    # a writer that lost the race commits on top of the winner
    real, first = t.versions, [True]

    def stale():
        v = real()
        return v[:-1] if first and first.pop() else v

    t.versions = stale
    assert t.append(d.limit(1)) == 9 and t.read(d.schema).count() == 301


def test_compaction_keeps_odd_rows_and_clashing_columns(spark, tmp_path):
    d = docs(spark, [*ODD, "a", "é" * 1_000_000], [*range(len(ODD)), 3, None]).withColumn("arrival", F.concat(F.lit("mine "), F.col("doc_id"))).withColumn("path", F.lit("p")).withColumn("tier", F.lit(None).cast("int"))
    t = compaction.ShardedTable(spark, f"file://{tmp_path}/t", 1 << 20)
    with pytest.raises(ValueError):
        compaction.spread_arrivals(d, 3, "arrival")
    t.append_each(compaction.spread_arrivals(d, 3, "arrival_"), "arrival_", 3)
    t.append(d.limit(0))
    t.compact(d.schema)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(key, t.read(d.schema).collect())) == sorted(map(key, d.collect()))
    lost = tmp_path / "t" / "data" / "of-a-failed-commit"
    lost.mkdir()
    t.vacuum()
    assert lost.exists()
    t.vacuum(grace_ms=-10_000)
    assert not lost.exists() and t.read(d.schema).count() == d.count()
    table = tmp_path / "sf"
    d.write.parquet(f"file://{table}/documents.parquet")
    assert queries.op4_sharding(spark, f"file://{table}").count() == d.count()


# op5 ------------------------------------------------------------------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 12)).round(2)
    v[40:80] = v[40]
    rows = [(int(i), [float(x) for x in r]) for i, r in enumerate(v)] + [(300, None), (301, [None] * 12), (302, [float("nan")] * 12), (303, [1.0, 2.0]), (350, [2.0, 1.0]), (None, [0.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    q = np.floor(v * 256).astype(int)
    for i in range(0, 300, 50):
        s = q @ q[i]
        assert got[i] == [(int(j), int(s[j])) for j in sorted((j for j in range(300) if j != i), key=lambda j: (-s[j], j))[:5]]
    assert got[350] == [(303, 256 * 512 * 2)]
    assert topk.top_k(df.filter("vec_id IS NULL"), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_reads_fewer_slices_and_counts_repeats_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(10, 32))
    v = np.floor(256 * (middle[rng.integers(0, 10, 600)] + 0.05 * rng.normal(size=(600, 32)))).astype(np.int64)
    whole = v[:40] @ v.T
    least = np.sort(whole, axis=1)[:, -6]
    own = np.arange(600)[None, :] == np.arange(40)[:, None]
    q, c, s, read = topk.collected(v[:40], v, own, least)
    assert {(int(i), int(j), int(x)) for i, j, x in zip(q, c, s, strict=True)} == {(i, j, int(whole[i, j])) for i in range(40) for j in range(600) if i != j and whole[i, j] >= least[i]}
    assert read < 0.8 * whole.size * topk.SLICES
    monkeypatch.setattr(topk, "ROUND_BYTES", 1024)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 64)
    rows = [(i % 120, [float(x) / 256 for x in v[i % 120]], "q") for i in range(300)] + [(500, [], "q"), (501, [], "q"), (550, [1.0] * 32, "q"), (550, [0.5] * 32, "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").withColumn("rank", F.lit("x")).withColumn("v", F.lit(1)).withColumn("dim", F.lit(2))
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    pool = {i: v[i] for i in range(120)} | {550: np.full(32, 128)}
    for i in (0, 50, 100, 550):
        assert got[i] == [(j, int(pool[j] @ pool[i])) for j in sorted((j for j in pool if j != i), key=lambda j: (-int(pool[j] @ pool[i]), j))[:5]]
    assert got[500] == [(501, 0)] and set(got) == {0, 50, 100, 500, 550}


# op6 ------------------------------------------------------------------------------------------------------------------------------------


def best_path(table, text, longest=20):
    """Ids of the best path by a plain dynamic program over the whole text."""
    words = {p: (i, s) for i, (p, s, k) in enumerate(table) if k == "n"}
    byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(table) if k == "b"}
    unknown = min(s for _, s in words.values()) - pieces.UNKNOWN_PENALTY
    chars = ["\ue000" if c == "▁" else "▁" if c == " " else c for c in " " + text] if text else []
    best = [(0.0, 0, [])]
    for e in range(1, len(chars) + 1):
        at = (-np.inf, 0, [])
        for n in range(min(longest, e), 0, -1):
            p = "".join(chars[e - n : e])
            if p in words and best[e - n][0] + words[p][1] > at[0]:
                at = (best[e - n][0] + words[p][1], n, [words[p][0]])
        if chars[e - 1] not in words and best[e - 1][0] + unknown > at[0]:
            at = (best[e - 1][0] + unknown, 1, [byte[b] for b in (chars[e - 1] if chars[e - 1] != "\ue000" else "▁").encode()])
        best.append(at)
    out, e = [], len(chars)
    while e:
        out = best[e][2] + out
        e -= best[e][1]
    return out


def test_pieces_equal_a_plain_dynamic_program(spark, monkeypatch):
    table = pieces.read_model(pieces.MODEL)
    assert max(len(p) for p, _, k in table if k == "n") <= 20
    rng = random.Random(1)
    parts = ["a", "the ", "  ", "\n", "é", "漢", "字", "の", "😀", "▁", "xxxxx", "ing", " ", "thtion ", "²", ".", "http://www.", "==", "中国"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["".join(rng.choice([x for x in parts if " " not in x]) for _ in range(60)) for _ in range(30)] + [" " * 90, "a" * 300, "中国漢字の" * 30]
    for fewest in (1, 10**6):
        monkeypatch.setattr(pieces, "FEWEST", fewest)
        codec = pieces.Codec(table)
        for t, ids in zip(texts, codec.encode_all(texts), strict=True):
            assert codec.decode(ids.tolist()) == t and ids.tolist() == best_path(table, t), t


def test_pieces_take_texts_without_blanks(spark):
    import time

    rng = random.Random(2)
    codec = pieces.Codec(pieces.read_model(pieces.MODEL))
    texts = ["".join(chr(rng.choice([rng.randint(0x4E00, 0x5200), 0x3002])) for _ in range(20_000)) for _ in range(20)]
    codec.encode_all(texts[:1])
    began = time.process_time()
    got = codec.encode_all(texts)
    per_char = (time.process_time() - began) / sum(map(len, texts))
    assert [codec.decode(x.tolist()) for x in got] == texts
    print("seconds a million characters", per_char * 1e6)
    assert per_char < 2.7e-6  # 330 million characters of three bytes in 900 s
    assert codec.decode(codec.encode("ab" * 100_000 + "é" * 50_000).tolist()) == "ab" * 100_000 + "é" * 50_000


def test_pieces_round_trip_of_odd_rows(spark):
    d = docs(spark, [*ODD, "a"], [*range(len(ODD)), None]).withColumn("exact", F.lit("x")).withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit(1))
    got = pieces.with_digests(d).collect()
    assert len(got) == len(ODD) + 1 and all(r["exact"] for r in got)
    assert {r["doc_id"]: r["n_tokens"] for r in got}[0] == 0
    assert pieces.with_digests(docs(spark, [])).count() == 0
    d = docs(spark, ODD)
    assert {r["doc_id"]: r["decoded"] for r in pieces.decode(pieces.encode(d)).collect()} == {i: t or "" for i, t in enumerate(ODD)}


# op7 ------------------------------------------------------------------------------------------------------------------------------------


def page(i, body, menu="<nav><a href=/x>Home</a></nav>"):
    return f"<html><head><title>T{i}</title><style>p{{}}</style></head><body>{menu}{body}<footer>&copy; all</footer></body></html>"


def test_extraction(spark):
    rows = [
        (1, "https://a.org/1", page(1, "<article><h1>One &amp; two</h1><p>Par <b>bo</b>ld<br>x<p>Next&nbsp;one<form>no</form><div class='comments'><p>me too</p></div></article><aside>side</aside>")),
        (2, "https://b.org/1", page(2, "<div id=top>Same notice</div><div class=body><p>First story text here</p><p>more</p></div><div class='cookie-banner'>eat</div>")),
        (3, "https://b.org/2", page(3, "<div id=top>Same notice</div><div class=body><p>Second tale, longer than that</p></div>")),
        (4, "https://b.org/3", page(4, "<div id=top>Same notice</div><div class=body><p>Third</p></div><!-- x --><script>var a='</p>'</script>")),
        (5, None, None), (6, "odd", ""), (7, "https://c.org/", "<div>deep" * 2000), (1, "https://a.org/1", "<article>twice</article>"),
    ]
    got = sorted((r["page_id"], r["text"]) for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got[:6] == [(1, "One & two Par bold x Next one"), (1, "twice"), (2, "First story text here more"), (3, "Second tale, longer than that"), (4, "Third"), (5, "")]
    assert got[6] == (6, "") and got[7][1].count("deep") == 2000
    assert wrapper.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def extracted(spark, bodies):
    """Texts of pages of one host, by number."""
    rows = [(i, f"https://n.org/{i}", page(i, b)) for i, b in enumerate(bodies)]
    return [r["text"] for r in sorted(wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect(), key=lambda r: r["page_id"])]


LONG = [f"The {w} of these passages is long enough to be a text of its own, and no other page of this host has the {w} one." for w in ("first", "second", "third", "fourth")]


def test_class_words_do_not_drop_the_text(spark):
    for form in (
        "<div class='content has-sidebar'><article><p>{}</p></article></div>", "<div id='with-nav'><article><p>{}</p></article></div>", "<article><section class='post comments-open'><p>{}</p></section></article>",
        "<article><p class='related'>{}</p></article>", "<div class='content sidebar'><article><p>{}</p></article></div>", "<div class='content widget'><p>{}</p></div>", "<div class='with-banner'><p>{}</p></div>",
    ):
        assert extracted(spark, [form.format(t) for t in LONG]) == LONG, form
    noise = "<article><p>{}</p><div class='related-posts'><p>More {}</p></div><ul class='share'><li><a>{}</a></li></ul></article><div class='sidebar-left'><article>{}</article></div>"
    assert extracted(spark, [noise.format(t, t[:20], t, t) for t in LONG]) == LONG


def test_repeated_block_goes_and_its_neighbour_stays(spark):
    for form in ("<div><p>The same notice on all pages</p><p>{}</p></div>", "<div>The same notice on all pages</div><div>{}</div>", "<div><ul><li>Same notice<li>{}</ul></div>", "<div><p>{}</p><blockquote>Same</blockquote><p>And same</p></div>"):
        assert extracted(spark, [form.format(t) for t in LONG]) == LONG, form
    copies = ["<div><p>One text</p><p>in two parts</p></div>"] * 4
    assert extracted(spark, copies) == ["One text in two parts"] * 4


def test_alignment_decides_inside_and_outside_articles(spark):
    for form in ("<article><h1>Same head</h1><p>{}</p><p>Please send us your remarks</p></article>", "<main><div><p>{}</p></div><div><p>Same box</p></div></main>", "<article><p>Same teaser</p></article><div class=story><p>{}</p></div>"):
        assert extracted(spark, [form.format(t) for t in LONG]) == LONG, form
    notice = "<article><p>{}</p><p>Same notice</p></article>"
    copies = ["<article><p>One text</p><p>in two parts</p></article>"] * 4
    assert extracted(spark, copies) == ["One text in two parts"] * 4
    assert extracted(spark, [notice.format(t) for t in LONG[:3]] + [notice.format(LONG[3])] * 3) == LONG[:3] + [LONG[3]] * 3
    assert extracted(spark, [notice.format(t) for t in LONG[:2]]) == [f"{t} Same notice" for t in LONG[:2]]  # two pages tell nothing


def brute_match(a, b):
    """Size of the largest order-keeping matching of two trees (label, [children])."""
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for p, x in enumerate(a[1]):
        for q, y in enumerate(b[1]):
            best[p + 1][q + 1] = max(best[p][q + 1], best[p + 1][q], best[p][q] + brute_match(x, y))
    return 1 + best[-1][-1]


def flat(tree):
    lines, todo = [], [tree]
    for label, kids in todo:
        lines.append(f"{label}\t{','.join(str(len(todo) + k) for k in range(len(kids)))}\t0")
        todo += kids
    return "\n".join(lines)


def test_tree_matching_equals_brute_force_and_aligns_what_is_new():
    rng = random.Random(4)
    grow = lambda d: (rng.choice("abc"), [grow(d - 1) for _ in range(rng.randint(0, 4))] if d else [])
    for _ in range(150):
        a, b = (("#root", [grow(2) for _ in range(rng.randint(0, 5))]) for _ in range(2))
        x, y = wrapper._tree(flat(a)), wrapper._tree(flat(b))
        size, pairs = wrapper.match(x, y, 0, 0, {}, (wrapper._prints(x), wrapper._prints(y)))
        assert size == len(pairs) == len({i for i, _ in pairs}) == len({j for _, j in pairs}) == brute_match(a, b)
        template = wrapper.grown([flat(a), flat(b)])
        assert all(n < len(template[0]) for t in (x, y) for n in wrapper.aligned(template, t))
    one, two = "#root\t1,2\t0\na\t\t0\nb\t\t0", "#root\t1,2,3\t0\na\t\t0\nx\t\t0\nb\t\t0"
    for template in (wrapper.grown([one, two]), wrapper.grown([one])):  # with the new node, and without
        p, q = (wrapper.aligned(template, wrapper._tree(t)) for t in (one, two))
        assert q[1] == p[1] and q[3] == p[2] and q[2] not in p


def test_a_host_of_many_layouts_is_aligned_to_its_heaviest(spark, monkeypatch):
    forms = [f"<div class=top>Same notice</div><div class=x{k}><p>Same box</p></div><div class=body><p>{{}} {k}</p></div>" for k in range(12)]
    bodies = [forms[k].format(t) for k in range(12) for t in LONG]
    want = [f"{t} {k}" for k in range(12) for t in LONG]
    assert extracted(spark, bodies) == want
    monkeypatch.setattr(wrapper, "TEMPLATE_TREES", 2)
    assert extracted(spark, bodies) == want


def test_induction_decides_texts(spark, monkeypatch):
    """Without induction (no block is ever frequent enough) the same pages give other texts."""
    forms = ["<article><p>{}</p><p>Please send us your remarks</p></article>", f"<div class=a><p>{'Same teaser of this host. ' * 9}</p></div><div class=b><p>{{}}</p></div>"]
    for form in forms:
        with monkeypatch.context() as m:
            m.setattr(wrapper, "MIN_PAGES", 1_000_000)
            assert extracted(spark, [form.format(t) for t in LONG]) != LONG
        assert extracted(spark, [form.format(t) for t in LONG]) == LONG


def test_extraction_of_wide_pages_and_clashing_columns(spark):
    import time

    wide = "".join(f"<div><p>{'w' * (i % 7)} {i}</p></div><section><h2>h</h2></section>" for i in range(3000))
    rows = [(i, f"https://w.org/{i}", page(i, f"<article>{wide}<p>{t}</p></article>"), "mine") for i, t in enumerate(LONG)] + [(None, None, "<p>" * 20_000 + "deep", "mine")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumns({c: F.lit(1) for c in ("host", "skel", "blocks", "keep", "drop")})
    began = time.time()
    got = {r["page_id"]: r for r in wrapper.extract(d).collect()}
    assert time.time() - began < 60
    assert [got[i]["text"].endswith(t) for i, t in enumerate(LONG)] == [True] * 4 and got[None]["text"] == "deep"


# op8 ------------------------------------------------------------------------------------------------------------------------------------


def quotients(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda i: (Fraction(votes[i], 2 * won[i] + 1), -i))
        won[i] += 1
    return won


def test_apportionment_equals_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        votes = [rng.randint(0, 60) for _ in range(rng.randint(1, 9))]
        if sum(votes):
            seats = rng.randint(0, 80)
            assert mixing.sainte_lague(votes, seats) == quotients(votes, seats)


def test_mix_meets_targets_and_reruns(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 400), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)] + [(2000, None, "d"), (None, "x y", "e"), (7, "x", "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    for s, rs in by.items():
        assert sum(r["size"] for r in rs) == rs[0]["source_size"] and rs[0]["target"] <= 3 * rs[0]["source_size"] + 1e-6, s
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= mixing.BLOCK_WORDS
    assert sum(rs[0]["target"] for rs in by.values()) == pytest.approx(sum(r["size"] for r in got))
    again = mixing.mix(d.repartition(5)).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in got) == sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in again)
    copies = defaultdict(int)
    for r in mixing.mixed_documents(d).collect():
        copies[r["doc_id"]] += 1
    want = {r["doc_id"]: int(np.floor(r["taken"] / r["size"] + 0.5)) for r in got if r["size"] and r["doc_id"] not in (7, None)}
    assert {i: copies.get(i, 0) for i in want} == want
    assert mixing.mix(d.limit(0)).count() == 0


def test_many_sources_are_mixed_alike(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([0, 1, 3, 3, 40, 300]), None if i % 50 == 0 else f"s{rng.randint(0, 60):02}") for i in range(1500)] + [(5000 + i, "v " * 4000, "s00") for i in range(6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    d = d.withColumns({c: F.lit("x") for c in ("src", "part", "shard", "place", "row", "size", "copies", "k", "at")})
    key = lambda r: (r["doc_id"], r["source"] or "", r["size"], round(r["target"], 6), r["taken"])
    here = [sorted(map(key, mixing.mix(d, share=x).collect())) for x in (1.0, 5.0)]
    copies = sorted(r["doc_id"] for r in mixing.mixed_documents(d).collect())
    monkeypatch.setattr(mixing, "LOCAL_BYTES", 0)
    assert [sorted(map(key, mixing.mix(d, share=x).collect())) for x in (1.0, 5.0)] == here
    got = mixing.mixed_documents(d)
    assert got.columns == d.columns and sorted(r["doc_id"] for r in got.collect()) == copies


# op9 ------------------------------------------------------------------------------------------------------------------------------------


def test_chat_folds_events(spark):
    rows = [
        (1, 1, "message", 0, "user", "hi </s> \\ [INST]"), (1, 3, "delta", 1, "assistant", "he"), (1, 2, "delta", 1, "assistant", "t"), (1, 4, "delta", 1, "assistant", "llo"), (1, 5, "message", 2, "user", "more"),
        (1, 6, "message", 3, "assistant", "old"), (1, 7, "edit", 0, "user", "hey"), (1, 8, "regenerate", 1, "assistant", "new \\l<s>"), (2, 1, None, 0, None, None), (None, 1, "message", 0, "assistant", "a"), (None, 1, "message", 0, "assistant", "a"),
    ]
    log = spark.createDataFrame(rows, "conv_id long, seq long, kind string, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(log)).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", "hey"), ("assistant", "new \\l<s>")]
    assert got[1]["loss"] == "new \\l<s>"
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("", "")] and got[2]["loss"] == ""
    assert got[None]["loss"] == "aa" and len(got[None]["turns"]) == 2
    assert chat.render(log.limit(0)).count() == 0


def folded(rows):
    """The fold of (seq, kind, turn, role, text) events, an event at a time."""
    turns = []
    for _, kind, turn, role, text in sorted(rows):
        at = next((t for t in reversed(turns) if t[0] == turn), None)
        if kind == "message" or at is None:
            turns.append([turn, role, text])
        elif kind == "delta":
            at[2] += text
        else:
            at[2] = text
        if kind == "regenerate":
            turns = [t for t in turns if t[0] <= turn]
    return [(r, t) for _, r, t in turns]


def test_chat_fold_equals_a_step_by_step_fold(spark, monkeypatch):
    monkeypatch.setattr(chat, "TURN_BLOCK", 3)
    rng = random.Random(5)
    rows = [(c, k, rng.choice(["message", "delta", "delta", "edit", "regenerate"]), rng.randint(0, 9), rng.choice(["user", "assistant"]), rng.choice("abc") * rng.randint(0, 3)) for c in range(40) for k in range(rng.randint(1, 40))]
    log = spark.createDataFrame(rows, "conv_id long, seq long, kind string, turn long, role string, text string").withColumn("events", F.lit("x")).withColumn("at", F.lit("y"))
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.fold(log.repartition(5)).collect()}
    assert got == {c: folded([r[1:] for r in rows if r[0] == c]) for c in range(40)}


def test_chat_log_folds_back(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b" * 1000 + "</s>"), (1, 1, "assistant", "b" * 1000 + "</s>"), (1, 3, "user", "x\\"), (1, 4, "assistant", None), (1, None, "assistant", "first"), (2, 1, None, ""), (2, 7, "assistant", "é😀" * 300_000), (None, 0, "user", "n")]
    d = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("rows", F.lit(1)).withColumn("seq", F.lit(1))
    log = chat.as_log(d)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(log)).collect()}
    for c in (1, 2, None):
        own = sorted(((-1 if t is None else t), r or "", x or "") for i, t, r, x in rows if i == c)
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r, x) for _, r, x in own]
        assert got[c]["loss"] == "".join(x for _, r, x in own if r == "assistant")


def test_chat_folds_a_long_stream_in_linear_time(spark):
    import time

    log = spark.range(100_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("seq"), F.when(F.col("id") % 20_000 == 7, "regenerate").otherwise("delta").alias("kind"), (F.col("id") % 2).alias("turn"), F.lit("assistant").alias("role"), (F.col("id") % 10).cast("string").alias("text"))
    began = time.time()
    (got,) = chat.fold(log).collect()
    assert time.time() - began < 30
    assert [t["text"] for t in got["turns"]] == [t for _, t in folded([(r["seq"], r["kind"], r["turn"], r["role"], r["text"]) for r in log.collect()])]


def test_chat_escape_is_reversible(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["\\", "l", "b", "<", "s>", "/", "[", "INST]", "</s>", "[/ROLE]", "x"]) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).withColumn("u", chat.unescape(F.col("e")))
    assert df.filter("t <> u").count() == 0
    assert df.filter(F.col("e").rlike(r"</?s>|\[/?(INST|ROLE)\]")).count() == 0


# op10 -----------------------------------------------------------------------------------------------------------------------------------


def test_quality_tells_junk(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.classify(d, labels).collect()}
    known = [(r["quality"], got[r["doc_id"]]["score"]) for r in labels.filter("quality IS NOT NULL").collect() if r["doc_id"] in got]
    good, bad = [s for q, s in known if q == 1], [s for q, s in known if q == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc >= 0.9 and len(got) == d.count()


def test_quality_shrinks_sparse_sites_and_takes_odd_rows(spark):
    rows = [(i, "fine words here and there", "big", 0) for i in range(60)] + [(100 + i, "!! !! !!", "junk", 1) for i in range(60)] + [(300, "fine words here and there", "tiny", 1), (301, None, None, None), (None, "", "big", 0), (300, "fine words here and there", "tiny", 1)]
    d = spark.createDataFrame([(i, t, s, None) for i, t, s, _ in rows], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(s == "big")) for i, _, s, _ in rows if s in ("big", "junk") and i is not None] + [(300, None), (None, 1)], "doc_id long, quality int")
    got = quality.classify(d, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[100]["host_quality"] < by[300]["host_quality"] < by[0]["host_quality"]
    assert quality.classify(d.limit(0), labels).count() == 0
    assert {round(r["score"], 3) for r in quality.classify(d, labels.limit(0)).collect()} == {0.5}


# pipeline -------------------------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    d = spark.read.parquet(f"{SF}/documents.parquet")
    whole = {r["doc_id"]: r["text"] for r in d.collect()}
    at, seen = d, []
    for name, stage in cp.STAGES:
        at = materialize(stage(spark, at, SF), name)
        seen.append((name, at))
        assert name == "pieces" or at.columns == d.columns
    told, exact, near, mixed, coded = (x for _, x in seen)
    assert told.count() >= 0.97 * d.count()
    texts = defaultdict(list)
    for r in told.collect():
        texts[r["text"]].append(r["doc_id"])
    assert sorted(r["doc_id"] for r in exact.collect()) == sorted(max(v) for v in texts.values())
    sets = {r["doc_id"]: shingle_set(r["text"], 5) for r in exact.collect()}
    want = components(sets, 80, 100)
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(i for i in want if want[i] == i)
    assert {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in near.collect()}
    assert coded.count() == mixed.count() and all(r["exact"] for r in coded.collect())
    assert all(hashlib.sha256(whole[r["doc_id"]].encode()).hexdigest() == r["text_sha256"] for r in coded.collect())


def test_pipeline_language_stage_drops_what_it_cannot_tell(spark):
    import corpus_pipeline as cp

    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(d, ~langid.held_out())
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    names, scores = model.predict(list(texts.values()))
    good = [i for i, k, s in zip(texts, names, scores, strict=True) if k != langid.UNKNOWN and s >= 0.3]
    assert len(model.langs) == 4 and ids(cp.language_id(spark, d, SF)) == sorted(good)
    unlabelled = d.withColumn("lang", F.lit(None).cast("string"))
    assert ids(cp.language_id(spark, unlabelled, SF)) == sorted(texts)
    # twenty languages: a right answer for a text of few words scores little, but more than a guess
    rng = random.Random(9)
    words = [["".join(rng.choice("aeioubdfgklmnprst") for _ in range(5)) for _ in range(12)] for _ in range(20)]
    said = [(" ".join(rng.choice(words[k]) for _ in range(30)), k) for k in range(20) for _ in range(16)]
    said += [(f"{words[k][0]} {words[(k + 1) % 20][1]} {words[(k + 2) % 20][2]}", k) for k in range(20)] + [("123 456", 0)]
    many = spark.createDataFrame([(i, t, f"l{k:02}", "s", len(t)) for i, (t, k) in enumerate(said)], "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.train(many, ~langid.held_out())
    _, scores = model.predict([t for t, _ in said[:-1]])
    assert len(model.langs) == 20 and min(scores) < 0.3
    assert ids(cp.language_id(spark, many, SF)) == [i for i, s in enumerate(scores) if s >= 1.2 / 20] and sum(s >= 1.2 / 20 for s in scores) == len(scores)


def test_pipeline_takes_odd_rows(spark, tmp_path):
    import corpus_pipeline as cp

    texts = [*ODD, "the same words stand here again and again for all to read", "the same words stand here again and again for all to read", None]
    more = docs(spark, texts, [*range(len(ODD)), 70, 70, None]).withColumns({c: F.lit("mine") for c in ("row", "sha", "tied", "src", "part", "__p", "h")})
    more.write.parquet(f"file://{tmp_path}/odd/documents.parquet")
    got = cp.run(spark, f"file://{tmp_path}/odd").collect()
    assert all(r["exact"] for r in got) and {r["doc_id"] for r in got} <= {*range(len(ODD)), 70, None}
    at = more
    for name, stage in cp.STAGES[:-1]:
        at = materialize(stage(spark, at, ""), name)
        assert at.columns == more.columns and {r["row"] for r in at.select("row").distinct().collect()} <= {"mine"}
    more.limit(0).write.parquet(f"file://{tmp_path}/none/documents.parquet")
    assert cp.run(spark, f"file://{tmp_path}/none").count() == 0
