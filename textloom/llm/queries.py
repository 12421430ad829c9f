"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, chat, compaction, exact_dedup, langid, mixing, near_dedup, pieces, quality, repeats, topk, wrapper
from textloom.llm.common import new_name, shared_path, table

#: Arrivals into which op4 deals the table.
ARRIVALS = 4
OP4_TARGET = 32 << 20


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, num=85, den=100)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out()
    model = langid.train(docs, F.crc32(F.col("doc_id").cast("long").cast("string")) % 4 != 2)
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append the documents in ``ARRIVALS`` arrivals, compact, drop what is superseded, and read the committed version back."""
    docs = table(spark, sf_dir, "documents")
    t = compaction.ShardedTable(spark, shared_path(spark, "shards"), OP4_TARGET)
    by = new_name(docs, "arrival")
    t.append_each(compaction.spread_arrivals(docs, ARRIVALS, by), by, ARRIVALS)
    t.compact(docs.schema)
    t.vacuum()
    back = t.read(docs.schema)
    return back.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "lang", "source")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.with_digests(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = wrapper.extract(table(spark, sf_dir, "pages"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.render(chat.as_log(said.unionByName(more))))
    said_again = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said_again.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")
    return bpe.decode(coded).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth text (by the checksum of its id) is turned into one with a period before its runs are looked for."""
    h, n = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.size("words").cast("long")
    g = F.floor(h / 10)
    docs = table(spark, sf_dir, "documents").select("doc_id", repeats.words_of("text").alias("words"))
    docs = docs.withColumns({"n": n, "a": F.when((h % 10 == 0) & (n > 0), g % n), "g": g}).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    periodic = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int"))))
    docs = docs.select("doc_id", F.when(F.col("a").isNull(), F.col("words")).otherwise(periodic).alias("words"))
    found = repeats.periodic_runs(docs, "words")
    # cross products compare exponents without a fraction
    after = lambda x, y: F.signum(y["length"] * x["period"] - x["length"] * y["period"]).cast("int")
    first = lambda x, y: F.when(after(x, y) != 0, after(x, y)).when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(x["period"] - y["period"])).cast("int")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", F.get(F.array_sort("runs", first), F.lit(0))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_sharding": op4_sharding,
    "op5_topk": op5_topk,
    "op6_pieces": op6_pieces,
    "op7_html": op7_html,
    "op8_mixing": op8_mixing,
    "op9_chat": op9_chat,
    "op10_quality": op10_quality,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_runs": op12_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op4_sharding": """
        SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, strlen(coalesce(text, '')) AS n_bytes, lang, source FROM documents""",
    "op5_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 5""",
    "op7_html": r"""
        WITH a AS (SELECT page_id, url, lower(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1), '^www\.', '')) AS host,
                          string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1|div|ul|li)\b[^>]*>') AS parts FROM pages),
        b AS (SELECT page_id, url, host, unnest(parts) AS t, generate_subscripts(parts, 1) AS i FROM a),
        c AS (SELECT page_id, url, host, i, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS block FROM b),
        whole AS (SELECT page_id, host, string_agg(block, chr(10) ORDER BY i) AS page FROM c WHERE block <> '' GROUP BY ALL),
        hosts AS (SELECT host, count(DISTINCT page) AS texts FROM whole GROUP BY host),
        fixed AS (SELECT c.host, block FROM c JOIN whole USING (page_id) JOIN hosts ON hosts.host = c.host WHERE block <> '' GROUP BY c.host, block, texts HAVING count(DISTINCT page) >= greatest(3, texts / 2)),
        d AS (SELECT c.*, f.block IS NULL AS own FROM c LEFT JOIN fixed f ON f.host = c.host AND f.block = c.block WHERE c.block <> ''),
        e AS (SELECT page_id, coalesce(string_agg(block, ' ' ORDER BY i) FILTER (own), string_agg(block, ' ' ORDER BY i)) AS text FROM d GROUP BY page_id)
        SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM pages LEFT JOIN e USING (page_id)""",
    "op9_chat": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, length(replace(role, '\', '\\')) + len(regexp_extract_all(role, '</?s>|\[/?(INST|ROLE)\]'))
                      + length(replace(text, '\', '\\')) + len(regexp_extract_all(text, '</?s>|\[/?(INST|ROLE)\]')) + 20 AS chars FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    # a run moved by its period agrees in 16 words at least, so only places whose next 16 words are alike are met; stretches of such pairs are runs
    "op12_runs": r"""
        WITH t AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
        d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                     xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                                     lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM documents, t),
        e AS (SELECT doc_id, words, len(words) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) END AS a FROM d),
        f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
        x AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN words ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN words[i + 1] ELSE words[a + (i - a) % p + 1] END) END AS words FROM f),
        w AS (SELECT doc_id, n, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM x),
        s AS (SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS next FROM w QUALIFY i <= n - 16),
        pairs AS (SELECT s.doc_id, s.i, o.i - s.i AS q FROM s JOIN s o ON s.doc_id = o.doc_id AND s.next = o.next AND s.i < o.i AND o.i - s.i <= s.n / 3),
        stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + 15 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island),
        runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(24, 3 * q) GROUP BY ALL),
        best AS (SELECT r.*, row_number() OVER (PARTITION BY doc_id ORDER BY length::DECIMAL(38, 18) / period DESC, start, period) AS k FROM runs r),
        listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM w
                 WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = w.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length) GROUP BY doc_id)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.words, '')) AS collapsed_sha256
        FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN (FROM best WHERE k = 1) USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
