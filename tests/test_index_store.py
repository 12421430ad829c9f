"""The store's changes: merged on read as if each had been written whole, in files of the arrival's size, and folded."""

import random

from textloom.functions import html as H
from textloom.operators import index_store

ROWS = "chunk_id string, v int, more string"


def table(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def size(spark, path):
    fs, p = index_store.CorpusStore(spark, path)._fs(path)
    return fs.getContentSummary(p).getLength()


def test_changes_equal_whole_versions(spark, tmp_path):
    rng = random.Random(3)
    store = index_store.CorpusStore(spark, f"file://{tmp_path}/store")
    store.FOLD_AFTER = 100
    rows = [(f"{'ext::' if i % 3 == 0 else ''}{i}", i, "old") for i in range(40)] + [("1", 100, "twice"), (None, 5, "null")]
    want, whole = table(spark, rows), None
    store.rebuild(want)
    for step in range(6):
        new = [(f"{'ext::' if rng.random() < 0.5 else ''}{rng.randrange(60)}", step, f"step {step}") for _ in range(8)] + [(None, step, "null")]
        purge = "ext::" if step % 3 == 2 else None
        came = table(spark, new)
        assert store.upsert(came, "chunk_id", purge) == step + 2
        want = index_store.purge_prefix(want, came, "chunk_id", purge) if purge else index_store.upsert(want, came, "chunk_id")
        rows = want.collect()
        want = table(spark, rows)
        assert sorted(map(str, store.read().collect())) == sorted(map(str, rows))
    assert store.count() == len(rows)
    assert store.read(1).count() == 42  # older versions stay readable
    assert store.fold() == 8 and not store._is_change(8)
    assert sorted(map(str, store.read().collect())) == sorted(map(str, rows))
    assert whole is None


def test_an_upsert_writes_what_arrives(spark, tmp_path):
    store = index_store.CorpusStore(spark, f"file://{tmp_path}/store")
    store.rebuild(spark.range(200_000).selectExpr("cast(id as string) as chunk_id", "cast(id as int) as v", "sha2(cast(id as string), 256) as more"))
    store.upsert(table(spark, [("7", -1, "new")]), "chunk_id")
    assert size(spark, f"{store.path}/v2") * 100 < size(spark, f"{store.path}/v1")
    assert store.read().filter("chunk_id = '7'").collect() == [("7", -1, "new")] and store.count() == 200_000


def test_many_changes_are_folded(spark, tmp_path):
    store = index_store.CorpusStore(spark, f"file://{tmp_path}/store")
    store.FOLD_AFTER = 2
    for i in range(4):
        store.upsert(table(spark, [(str(i % 2), i, "x")]), "chunk_id")
    assert sorted((r["chunk_id"], r["v"]) for r in store.read().collect()) == [("0", 2), ("1", 3)]
    assert [v for v in store.versions() if not store._is_change(v)] == [1, 4]
    store.upsert(table(spark, []), "chunk_id", purge="0")
    assert [r["chunk_id"] for r in store.read().collect()] == ["1"]


def test_character_references(spark):
    cases = {
        "&eacute; &#233; &#x2014; &#X2014;": "é é — —", "a & b &": "a & b &", "&amp;lt; &&amp;;": "&lt; &&;", "&unknown; &#0; &#xD800; &#1114112;": "&unknown; � � �",
        "&#150;&nbsp;|&NotEqualTilde;": "– |≂̸", "": "", "&copy 2024": "&copy 2024", "&#128512;": "😀",
    }
    rows = spark.createDataFrame([(x,) for x in cases] + [(None,)], "t string").select("t", H.decode_entities("t").alias("d")).collect()
    assert {r["t"]: r["d"] for r in rows} == cases | {None: None}


def test_a_merge_has_parts_by_the_size_of_its_files(spark, tmp_path):
    """A store of twice the bytes is merged in twice the parts, each of as many rows, and the rows are the same."""
    made = []
    for n in (4000, 8000):
        store = index_store.CorpusStore(spark, f"file://{tmp_path}/s{n}")
        store.rebuild(spark.range(n).selectExpr("CAST(id AS string) AS chunk_id", "sha2(CAST(id AS string), 256) AS more"))
        store.upsert(spark.range(0, n, 7).selectExpr("CAST(id AS string) AS chunk_id", "'new' AS more"), "chunk_id")
        store.PART_BYTES = 1 << 14
        got = store.read()
        assert got.count() == n and got.filter("more = 'new'").count() == -(-n // 7)
        made.append(got.rdd.getNumPartitions())
    assert made[0] > 8 and 1.6 < made[1] / made[0] < 2.4
