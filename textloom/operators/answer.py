"""Answers: context blocks, citations, refusals and the grounding downgrade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import config
from textloom.embedders import Answerer, ExtractiveAnswerer, IdentityRewriter, Rewriter
from textloom.functions import text as T
from textloom.operators import search
from textloom.scratch import materialize

S = config.SETTINGS


def citation_numbers(answer: Column, count: Column) -> Column:
    """Distinct numbers of ``[n]`` markers from 1 to ``count`` in order of first use; digit strings of any length are read."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("bigint"))
    return F.filter(F.array_distinct(found), lambda n: n.isNotNull() & (n >= 1) & (n <= count))


def is_refusal(answer: Column) -> Column:
    said = F.regexp_replace(T.squeeze(answer), r"\.+$", "")
    return said == config.SETTINGS.not_available_message.strip().lower().rstrip(".")


def passages(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, passages array<struct<rank, chunk_id, source_url, page_title, heading_path, text, score>>), at most k a question."""
    whole = results.join(chunks.select("chunk_id", "source_url", "page_title", "heading_path", "text"), "chunk_id")
    return whole.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "source_url", "page_title", "heading_path", "text", "score"))).alias("passages"))


def context_block(ps: Column, escape: bool = False) -> Column:
    """Numbered passages as data; ``escape`` protects quotes and angle brackets, which the plain form leaves as they are."""
    safe = (lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))) if escape else (lambda c: c)
    each = F.transform(ps, lambda p: F.concat(F.lit('<passage n="'), p["rank"].cast("string"), F.lit('" source="'), safe(p["source_url"]), F.lit('" heading="'), safe(p["heading_path"]), F.lit('">\n'), safe(p["text"]), F.lit("\n</passage>")))
    return F.array_join(F.concat(F.array(F.lit("<context>")), each, F.array(F.lit("</context>"))), "\n")


def citations(answer: Column, ps: Column) -> Column:
    """The passages that an answer cites: n, source_url, page_title, heading_path and the first 200 characters."""
    return F.transform(
        citation_numbers(answer, F.size(ps)),
        lambda n: F.struct(n.alias("n"), F.element_at(ps, n.cast("int"))["source_url"].alias("source_url"), F.element_at(ps, n.cast("int"))["page_title"].alias("page_title"), F.element_at(ps, n.cast("int"))["heading_path"].alias("heading_path"), F.substring(F.element_at(ps, n.cast("int"))["text"], 1, 200).alias("snippet")),
    )


def grounded(rows: DataFrame, answer: str = "raw_answer", cited: str = "citations") -> DataFrame:
    """A refusal, or an answer without a valid citation, becomes the standard refusal without citations."""
    ok = ~is_refusal(F.col(answer)) & (F.size(cited) > 0)
    return rows.withColumn("grounded", ok).withColumn("answer", F.when(ok, F.col(answer)).otherwise(S.not_available_message)).withColumn(cited, F.when(ok, F.col(cited)).otherwise(F.slice(cited, 1, 0)))


def answer(queries: DataFrame, chunks: DataFrame, vocab: DataFrame, embedder, answerer: Answerer | None = None, rewriter: Rewriter | None = None, k: int = S.retrieval_top_k) -> DataFrame:
    """(query_id, question, answer, citations, grounded) for questions (query_id, question[, history]); the gate comes before the answerer."""
    answerer, rewriter = answerer or ExtractiveAnswerer(), rewriter or IdentityRewriter()
    history = F.col("history") if "history" in queries.columns else F.lit("")
    asked = queries.select("query_id", F.col("question").alias("original"), rewriter.rewrite(F.col("question"), history).alias("question"))
    asked = embedder.embed(asked, "question", "q_vec", query=True)
    asked = materialize(asked, "asked")
    found = materialize(search.hybrid(asked, chunks, vocab, k), "found")
    gated = search.gate(found, asked)
    whole = asked.join(gated, "query_id").join(passages(found, chunks), "query_id", "left")
    said = F.when(F.col("relevant"), answerer.answer(F.col("original"), F.col("passages"))).otherwise(F.lit(S.not_available_message))
    drafted = whole.withColumn("raw_answer", said).withColumn("citations", citations(F.col("raw_answer"), F.coalesce("passages", F.slice("passages", 1, 0))))
    drafted = drafted.withColumn("citations", F.coalesce("citations", F.array().cast("array<struct<n:bigint,source_url:string,page_title:string,heading_path:string,snippet:string>>")))
    return grounded(drafted).select("query_id", F.col("original").alias("question"), "answer", "citations", "grounded")


def health(store, model: str = "extractive") -> dict:
    """State of the service; a store that is missing or cannot be read gives None chunks, never an error."""
    try:
        count = store.count() if store.versions() else None
    except Exception:  # a cold or broken index
        count = None
    return {"status": "ok", "indexed_chunks": count, "model": model}
