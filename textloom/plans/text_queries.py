"""Queries over documents, embeddings, benchmark questions, conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom import config
from textloom.embedders import HashingEmbedder, get_embedder
from textloom.functions import text as T
from textloom.functions import vectors as V
from textloom.operators import answer, blocks, brand, chunks, index_store, search, sessions
from textloom.operators.dense_index import DenseIndex
from textloom.operators.dense_index import ALL as DENSE_ALL
from textloom.operators.lexical_index import LexicalIndex, lexical
from textloom.scratch import materialize, shared_path

S = config.SETTINGS
FRACTION = 0.02
DIM = 64


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark, sf):
    return _read(spark, sf, "documents")


def sentence_split(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(T.sentences("text")).alias("p", "sentence")).select("doc_id", F.col("p").cast("long").alias("pos"), "sentence")


def word_counts(spark, sf):
    return docs(spark, sf).select("doc_id", T.word_count("text").alias("n_words"))


def text_hashes(spark, sf):
    return docs(spark, sf).select("doc_id", T.text_hash("text").alias("h"))


def nav_filter(spark, sf):
    return docs(spark, sf).select("doc_id", T.looks_like_nav("text").alias("nav"))


def garbage_filter(spark, sf):
    return docs(spark, sf).select("doc_id", T.looks_like_garbage("text").alias("garbage"))


def short_filter(spark, sf):
    return docs(spark, sf).filter(T.word_count("text") < S.chunk_min_tokens).select("doc_id", T.word_count("text").alias("n_words"))


def shell_filter(spark, sf):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("{{a}} {{b}} "), "text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("{{a }"), "text")).otherwise(F.col("text"))
    return docs(spark, sf).select("doc_id", T.looks_like_shell(t).alias("shell"))


def shortcode_strip(spark, sf):
    t = F.concat(F.lit("[caption id=1]x[/caption] [VC_row a] "), "text", F.lit(" [keep]"))
    return docs(spark, sf).select("doc_id", F.sha2(F.regexp_replace(t, config.SHORTCODE, ""), 256).alias("h"))


def pdf_text_blocks(spark, sf):
    return blocks.text_blocks(docs(spark, sf))


def exact_dedup(spark, sf):
    d = docs(spark, sf).select("doc_id", T.text_hash("text").alias("h"))
    return d.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def _paras(spark, sf):
    return blocks.paragraphs(docs(spark, sf).select("doc_id", "text"), "doc_id")


def paragraph_doc_freq(spark, sf):
    return blocks.paragraph_frequency(_paras(spark, sf), "doc_id")


def boilerplate_hashes(spark, sf):
    return blocks.boilerplate(_paras(spark, sf), docs(spark, sf), "doc_id", FRACTION)


def boilerplate_strip(spark, sf):
    p = materialize(_paras(spark, sf), "paragraphs")  # read for the frequencies and for the texts
    return blocks.strip_boilerplate(p, blocks.boilerplate(p, docs(spark, sf), "doc_id", FRACTION), "doc_id")


def hard_window_split(spark, sf):
    cut = docs(spark, sf).filter(T.word_count("text") > S.chunk_max_tokens).select("doc_id", F.posexplode(chunks.hard_windows(F.col("text"))).alias("p", "window"))
    return cut.select("doc_id", F.col("p").cast("long").alias("pos"), T.word_count("window").alias("n_words"), F.sha2("window", 256).alias("h"))


def chunk_documents(spark, sf):
    c = chunks.pieces(blocks.text_blocks(docs(spark, sf)), ["doc_id"], [])
    return c.select("doc_id", "piece_ord", "token_count", F.sha2("text", 256).alias("h"))


def chunk_drop_reasons(spark, sf):
    return chunks.chunk_documents(docs(spark, sf)).select("doc_id", "piece_ord", F.coalesce("reason", F.lit("kept")).alias("reason"))


def process_stats(spark, sf):
    return chunks.process_stats(chunks.chunk_documents(docs(spark, sf)))


def chunk_index(spark, sf):
    c = chunks.chunk_documents(docs(spark, sf)).filter("reason IS NULL").withColumn("site", F.col("doc_id"))  # a document is a page here
    return chunks.numbered(c, "site", ["piece_ord"]).select("doc_id", "piece_ord", "site", "chunk_index", "chunk_id")


def _corpus(spark, sf):
    """Documents as chunks: the source is the heading, the text the body."""
    return docs(spark, sf).filter("text IS NOT NULL").select(
        F.col("doc_id").alias("chunk_id"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source_url"), F.coalesce("source", F.lit("")).alias("page_title"), F.coalesce("source", F.lit("")).alias("heading_path"), "text"
    )


def vocabulary(spark, sf):
    return search.vocabulary(_corpus(spark, sf)).orderBy("term")


def embedding_inputs(spark, sf):
    h = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(" ")
    return docs(spark, sf).select("doc_id", F.sha2(chunks.embedding_input(h, F.col("text")), 256).alias("h"))


def chunk_metadata(spark, sf):
    c = docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("source_url"), F.when(F.col("doc_id") % 5 > 0, F.col("n_chars")).alias("token_count"))
    return chunks.metadata(c)


def snippets(spark, sf):
    return docs(spark, sf).select("doc_id", F.substring("text", 1, 200).alias("snippet"))


def hashing_embeddings(spark, sf):
    d = get_embedder("hashing").embed(docs(spark, sf).select("doc_id", "text"), "text", "v")
    return d.select("doc_id", F.posexplode("v").alias("p", "x")).select("doc_id", F.col("p").cast("long").alias("place"), F.round("x", 6).alias("x"))


def knn_cosine(spark, sf):
    e = _read(spark, sf, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vec"))
    return search.knn(q, e, S.retrieval_candidate_pool, "q_vec", "embedding", "query_id", "vec_id")


def knn_topk_per_query(spark, sf):
    e = _read(spark, sf, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vec"))
    return search.knn(q, e, S.retrieval_top_k, "q_vec", "embedding", "query_id", "vec_id")


def _dense_index(spark, sf):
    """The embeddings, indexed anew in the shared folder."""
    e = _read(spark, sf, "embeddings")
    index = DenseIndex(spark, shared_path(spark, "dense"))
    index.build(e, "vec_id", "embedding")
    return index, e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vec"))


def dense_index_exact(spark, sf):
    """The index with all cells probed: the exact search."""
    index, q = _dense_index(spark, sf)
    return index.search(q, "query_id", "q_vec", "vec_id", "embedding", probes=DENSE_ALL)


def dense_index_recall(spark, sf):
    """Of each query's exact nearest, how many the index finds with the probes that it chose."""
    index, q = _dense_index(spark, sf)
    want, got = knn_cosine(spark, sf).select("query_id", "vec_id"), index.search(q, "query_id", "q_vec", "vec_id", "embedding").select("query_id", "vec_id", F.lit(1).alias("hit"))
    return want.join(got, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"))


def relevance_gate(spark, sf):
    e = _read(spark, sf, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vec"))
    found = search.knn(q, e, S.retrieval_top_k, "q_vec", "embedding", "query_id", "vec_id").filter("query_id <> vec_id")
    return search.gate(found, q)


def index_count(spark, sf):
    return _read(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n"))


def _asked(spark, sf):
    """Benchmark texts as questions: their first words, one of them misspelt."""
    w = T.words("text")
    typo = F.concat(F.substring(F.element_at(w, 2), 1, 1), F.element_at(w, 2))
    q = F.concat_ws(" ", F.array_join(F.slice(w, 1, 6), " "), typo)
    return _read(spark, sf, "benchmark").filter(F.size(w) >= 6).select(F.col("item_id").alias("query_id"), q.alias("question"))


def query_terms(spark, sf):
    q = _asked(spark, sf).select("query_id", F.posexplode(T.query_terms("question")).alias("p", "term"))
    return q.select("query_id", F.col("p").cast("long").alias("pos"), "term")


def vocab_anti_join(spark, sf):
    q = _asked(spark, sf).select("query_id", F.explode(F.array_distinct(T.query_terms("question"))).alias("term"))
    return q.join(search.vocabulary(_corpus(spark, sf)).select("term"), "term", "left_anti").select("query_id", "term")


def fuzzy_corrections(spark, sf):
    vocab = search.vocabulary(_corpus(spark, sf))
    terms = _asked(spark, sf).select(F.explode(T.query_terms("question")).alias("term"))
    return search.fuzzy_matches(terms, vocab).select("term", "match", F.round("score", 6).alias("score"), "rank")


def keyword_boost(spark, sf):
    asked = materialize(_asked(spark, sf).select("query_id", T.query_terms("question").alias("terms")), "asked")
    return search.boosts(asked, _corpus(spark, sf)).withColumn("boost", F.round("boost", 6))


def _embedded(spark, sf):
    return HashingEmbedder(DIM).embed(_corpus(spark, sf), "text", "embedding")


def lexical_topk(spark, sf):
    asked = HashingEmbedder(DIM).embed(_asked(spark, sf), "question", "q_vec", query=True)
    asked = asked.select("query_id", "q_vec", T.query_terms("question").alias("terms"), F.array().cast("array<string>").alias("fuzzy"))
    return search.lexical(asked, _embedded(spark, sf)).select("query_id", F.col("variant_ord").cast("long"), "variant", "chunk_id", "score", "rank")


def lexical_index_topk(spark, sf):
    """The same through a persisted index: only rows that may hold a term are read."""
    index = LexicalIndex(spark, shared_path(spark, "lexical"))
    index.build(_embedded(spark, sf))
    asked = HashingEmbedder(DIM).embed(_asked(spark, sf), "question", "q_vec", query=True)
    asked = asked.select("query_id", "q_vec", T.query_terms("question").alias("terms"), F.array().cast("array<string>").alias("fuzzy"))
    return lexical(asked, index).select("query_id", F.col("variant_ord").cast("long"), "variant", "chunk_id", "score", "rank")


def hybrid_search(spark, sf):
    """Flagship: questions against all documents, dense pool and lexical branch merged and boosted."""
    asked = HashingEmbedder(DIM).embed(_asked(spark, sf), "question", "q_vec", query=True)
    corpus = _embedded(spark, sf)
    return search.hybrid(asked, corpus, search.vocabulary(corpus))


def chunked_hybrid_search(spark, sf):
    """The same over overlapping chunks of the documents, as the index holds them."""
    asked = HashingEmbedder(DIM).embed(_asked(spark, sf), "question", "q_vec", query=True)
    corpus = HashingEmbedder(DIM).embed(chunks.corpus(docs(spark, sf)), "text", "embedding")
    return search.hybrid(asked, corpus, search.vocabulary(corpus))


def answers(spark, sf):
    corpus = _embedded(spark, sf)
    got = answer.answer(_asked(spark, sf), corpus, search.vocabulary(corpus), HashingEmbedder(DIM))
    return got.select("query_id", "question", "answer", F.size("citations").cast("long").alias("n_citations"), "grounded")


def conversations(spark, sf):
    return _read(spark, sf, "conversations")


def history_last_n(spark, sf):
    return sessions.last_messages(conversations(spark, sf), "conv_id", "turn").select("conv_id", "turn", "role", "age")


def history_prompt(spark, sf):
    last = sessions.last_messages(conversations(spark, sf), "conv_id", "turn")
    return sessions.history_prompt(last, "conv_id", "turn")


def question_guard(spark, sf):
    c = conversations(spark, sf)
    q = F.when(F.col("turn") % 3 == 1, " \n").otherwise(F.col("text"))
    session = F.repeat(F.lit("x"), (F.col("conv_id") % 150).cast("int"))
    return c.select("conv_id", "turn", sessions.question_guard(q).alias("verdict"), sessions.session_id_ok(session).alias("session_ok"))


def _said(spark, sf):
    """Assistant turns as answers with markers; some are refusals or cite nothing that exists."""
    c = conversations(spark, sf).filter("role = 'assistant'")
    k, t = F.col("conv_id") % 4, F.col("text")
    text = F.when(k == 0, F.concat(t, F.lit(" [1][3] (x) [1] [99]"))).when(k == 1, F.concat(F.lit(S.not_available_message), F.lit(" "))).when(k == 2, t).otherwise(F.concat(t, F.lit(" [2] [0] ( ) [99999999999999999999]")))
    return c.select("conv_id", "turn", text.alias("said"))


def citation_extract(spark, sf):
    n = answer.citation_numbers(F.col("said"), F.lit(3))
    said = _said(spark, sf).select("conv_id", "turn", F.posexplode(n).alias("p", "n"))
    return said.select("conv_id", "turn", F.col("p").cast("long").alias("pos"), "n")


def citation_strip(spark, sf):
    return _said(spark, sf).select("conv_id", "turn", F.sha2(T.strip_markers("said"), 256).alias("h"))


def refusals(spark, sf):
    return _said(spark, sf).select("conv_id", "turn", answer.is_refusal(F.col("said")).alias("refusal"))


def grounding_downgrade(spark, sf):
    rows = _said(spark, sf).withColumn("raw_answer", F.col("said")).withColumn("citations", answer.citation_numbers(F.col("said"), F.lit(3)))
    return answer.grounded(rows).select("conv_id", "turn", F.sha2("answer", 256).alias("h"), F.size("citations").cast("long").alias("n_citations"), "grounded")


def context_blocks(spark, sf):
    c = conversations(spark, sf).withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long"))
    p = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("c:"), F.col("turn").cast("string")).alias("source_url"), F.col("role").alias("heading_path"), "text"))).alias("ps"))
    return p.select("conv_id", F.sha2(answer.context_block(F.col("ps")), 256).alias("h"))


def events(spark, sf):
    return _read(spark, sf, "events")


def rate_limit(spark, sf):
    return sessions.rate_limited(events(spark, sf), ["user_id"], "ts", "event_id", window_us=86_400_000_000, limit=3)


def rate_limit_hot(spark, sf):
    return sessions.rate_limited(events(spark, sf), ["event_type"], "ts", "event_id", window_us=86_400_000_000, limit=20)


def session_reset(spark, sf):
    return sessions.with_epoch(events(spark, sf), "user_id", "ts", "event_id", F.col("event_type") == "signup").select("event_id", "user_id", "epoch")


def rate_limit_with_resets(spark, sf):
    e = sessions.with_epoch(events(spark, sf), "user_id", "ts", "event_id", F.col("event_type") == "signup")
    return sessions.rate_limited(e, ["user_id", "epoch"], "ts", "event_id", window_us=86_400_000_000, limit=2).select("event_id", "limited")


def attempts_in_window(spark, sf):
    return sessions.attempts_in_window(events(spark, sf), "user_id", "ts", 86_400).select("event_id", "attempts")


def politeness_schedule(spark, sf):
    from textloom.operators import crawl

    e = events(spark, sf).select((F.col("user_id") % 10).alias("host"), F.col("event_id").alias("call_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("arrival"))
    return crawl.politeness_schedule(e, "host", "arrival", per_second=0.001).select("call_id", F.round("start", 3).alias("start"))


def _new(spark, sf):
    """An arrival: new versions of some documents, and new ones."""
    return docs(spark, sf).filter("doc_id % 7 = 0").select((F.col("doc_id") + F.when(F.col("doc_id") % 2 == 0, 0).otherwise(1_000_000)).alias("doc_id"), F.concat(F.lit("new "), "text").alias("text"), "lang", "source", F.lit(-1).cast("long").alias("n_chars"))


def upsert_replace(spark, sf):
    """Through a store: only the arrival is written."""
    store = index_store.CorpusStore(spark, shared_path(spark, "store"))
    store.rebuild(docs(spark, sf))
    store.upsert(_new(spark, sf), "doc_id")
    return store.read().select("doc_id", F.sha2("text", 256).alias("h"), "n_chars")


def purge_prefix(spark, sf):
    d = docs(spark, sf).select(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("ext::"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string")).alias("chunk_id"), "n_chars")
    new = _new(spark, sf).select(F.concat(F.lit("ext::new::"), F.col("doc_id").cast("string")).alias("chunk_id"), "n_chars")
    store = index_store.CorpusStore(spark, shared_path(spark, "store"))
    store.rebuild(d)
    store.upsert(new, "chunk_id", purge="ext::")
    return store.read()


def _seeds(spark, sf):
    seeds = docs(spark, sf).select(F.col("source").alias("label")).distinct().withColumn("always_add_fallback", F.substring("label", -1, 1) == "1")
    found = docs(spark, sf).filter(F.substring("source", -1, 1) != "3").select(F.col("source").alias("label"), F.col("doc_id").cast("string").alias("chunk_id"))
    curated = seeds.select("label", F.concat(F.lit("ext::"), "label", F.lit("::desc")).alias("chunk_id"))
    return seeds, found, curated


def seed_fallback(spark, sf):
    seeds, found, curated = _seeds(spark, sf)
    return index_store.seed_chunks(found, seeds, curated)


def seed_summary(spark, sf):
    seeds, found, curated = _seeds(spark, sf)
    return index_store.seed_summary(docs(spark, sf).select(F.col("source").alias("label")), index_store.seed_chunks(found, seeds, curated))


def first_wins(spark, sf):
    """The first document of each text, whatever its case."""
    d = docs(spark, sf).select("doc_id", F.lower("text").alias("label"))
    return brand.first_by(d, ["label"], ["doc_id"]).select("doc_id", F.sha2("label", 256).alias("h"))


def event_props(spark, sf):
    p = F.from_json("props", "map<string,string>")
    return events(spark, sf).select("event_id", F.size(F.map_keys(p)).cast("long").alias("n_keys"))


QUERIES = {f.__name__: f for f in (
    sentence_split, word_counts, text_hashes, nav_filter, garbage_filter, short_filter, shell_filter, shortcode_strip, pdf_text_blocks, exact_dedup, paragraph_doc_freq, boilerplate_hashes, boilerplate_strip,
    hard_window_split, chunk_documents, chunk_drop_reasons, process_stats, chunk_index, vocabulary, embedding_inputs, chunk_metadata, snippets, hashing_embeddings, knn_cosine, knn_topk_per_query,
    relevance_gate, dense_index_exact, dense_index_recall, index_count, query_terms, vocab_anti_join, fuzzy_corrections, keyword_boost, lexical_topk, lexical_index_topk, hybrid_search, chunked_hybrid_search, answers, history_last_n, history_prompt, question_guard,
    citation_extract, citation_strip, refusals, grounding_downgrade, context_blocks, rate_limit, rate_limit_hot, session_reset, rate_limit_with_resets, attempts_in_window, politeness_schedule, upsert_replace, purge_prefix,
    seed_fallback, seed_summary, first_wins, event_props,
)}

# --- SQL ---------------------------------------------------------------------------------------------------------------------------------


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _squeeze(x: str) -> str:
    return rf"regexp_replace(lower({_trim(x)}), '\s+', ' ', 'g')"


def _nw(x: str) -> str:
    return rf"(CASE WHEN {_trim(x)} = '' THEN 0 ELSE len(regexp_split_to_array({_trim(x)}, '\s+')) END)"


def _marks(x: str) -> str:
    return f"(length({x}) - length(regexp_replace({x}, '[.!?]', '', 'g')))"


def _nav(x: str) -> str:
    t = _trim(x)
    lines = f"list_filter(list_transform(string_split({t}, chr(10)), lambda z: {_trim('z')}), lambda z: z <> '')"
    phrase = " OR ".join(f"contains(lower({t}), '{p}')" for p in config.NAV_PHRASES)
    return rf"""(({_marks(t)} = 0 AND {_nw(x)} < 12) OR ({_marks(t)} = 0 AND regexp_matches({t}, '(?i)^{config.NAV_PREFIX}\b')) OR ({_marks(t)} <= 1 AND ({phrase}))
        OR (len({lines}) >= 10 AND {_marks(t)} <= greatest(1, floor(len({lines}) * 0.08)) AND list_sum(list_transform({lines}, lambda z: length(z))) < 45 * len({lines})))"""


def _garbage(x: str) -> str:
    w = rf"regexp_split_to_array({_trim(x)}, '\s+')"
    return f"({_nw(x)} >= 20 AND len(list_filter({w}, lambda z: length(z) = 1)) > 0.40 * len({w}))"


_STOP = ", ".join(f"'{w}'" for w in config.STOPWORDS)
_BLOCK = rf"""{_trim("regexp_replace(text, '[ \t]+', ' ', 'g')")}"""
_PARAS = rf"""r AS (SELECT doc_id, regexp_split_to_array(text, '\n+') AS ps FROM documents), s AS (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS pos, {_trim('unnest(ps)')} AS para FROM r),
    p AS (SELECT doc_id, pos, para, sha256({_squeeze('para')}) AS h FROM s WHERE para <> '')"""
_FREQ = "f AS (SELECT h, count(DISTINCT doc_id) AS n_docs FROM p WHERE length(para) >= 20 GROUP BY h)"
_BOILER = f"b AS (SELECT h, n_docs FROM f WHERE n_docs >= greatest(5, floor((SELECT count(*) FROM documents) * {FRACTION})) AND (SELECT count(*) FROM documents) >= 5)"
_VOCAB = f"""vt AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(coalesce(source, '') || chr(10) || text), '[a-z][a-z0-9]{{2,}}'), lambda x: x NOT IN ({_STOP})))) AS term FROM documents WHERE text IS NOT NULL),
    voc AS (SELECT term, count(*) AS n_chunks FROM vt GROUP BY term HAVING count(*) >= 2)"""
_ASKED = rf"""w AS (SELECT item_id, regexp_split_to_array({_trim('text')}, '\s+') AS w FROM benchmark), asked AS (SELECT item_id AS query_id, array_to_string(w[1:6], ' ') || ' ' || substr(w[2], 1, 1) || w[2] AS question FROM w WHERE len(w) >= 6)"""
_TERMS = f"""tq AS (SELECT query_id, question, list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN ({_STOP})) AS terms FROM asked)"""


def _embed(name: str, source: str, key: str, text: str) -> str:
    """Hashing embeddings in SQL, as unit lists."""
    return f"""{name}_t AS (SELECT {key}, unnest(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]{{3,}}')) AS t FROM {source}),
    {name}_n AS (SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT AS n FROM {name}_t),
    {name}_p AS (SELECT {key}, n % {DIM} AS p, sum(CASE WHEN (n // {DIM}) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS s FROM {name}_n GROUP BY ALL),
    {name}_l AS (SELECT {key}, sqrt(sum(s * s)) AS len FROM {name}_p GROUP BY ALL)"""


def _cosine(q: str, d: str, qk: str, dk: str) -> str:
    return f"""dots AS (SELECT q.{qk}, d.{dk}, sum(q.s * d.s) AS dot FROM {q}_p q JOIN {d}_p d USING (p) GROUP BY ALL),
    cos AS (SELECT a.{qk}, b.{dk}, round(coalesce(dot / nullif(ql.len * dl.len, 0), 0.0), 4) AS score FROM (SELECT DISTINCT {qk} FROM asked) a CROSS JOIN (SELECT {dk} FROM corpus) b
        LEFT JOIN dots USING ({qk}, {dk}) LEFT JOIN {q}_l ql USING ({qk}) LEFT JOIN {d}_l dl USING ({dk}) )"""


_CORPUS = "corpus AS (SELECT doc_id AS chunk_id, coalesce(source, '') AS heading_path, text FROM documents WHERE text IS NOT NULL)"
_FUZZY = f"""ty AS (SELECT DISTINCT unnest(terms) AS term FROM tq), tz AS (SELECT term FROM ty WHERE length(term) >= 4 AND term NOT IN (SELECT term FROM voc)),
    cand AS (SELECT tz.term, voc.term AS match FROM tz JOIN voc ON 2 * least(length(tz.term), length(voc.term)) >= 0.82 * (length(tz.term) + length(voc.term))
             AND levenshtein(tz.term, voc.term) <= floor(0.18 * (length(tz.term) + length(voc.term)) + 1e-9)),
    lcs AS (SELECT term, match, list_reduce(string_split(term, ''), lambda row, ch: list_reduce(range(1, length(match) + 1), lambda acc, j: list_append(acc, CASE WHEN substr(match, j, 1) = ch THEN row[j] + 1 ELSE greatest(acc[j], row[j + 1]) END), [0::BIGINT]),
             list_transform(range(0, length(match) + 1), lambda z: 0::BIGINT))[-1] AS l FROM cand),
    fz AS (SELECT term, match, 200.0::DOUBLE * l / (length(term) + length(match)) AS score FROM lcs),
    fm AS (SELECT term, match, score, row_number() OVER (PARTITION BY term ORDER BY score DESC, match) AS rank FROM fz WHERE score >= 82 QUALIFY rank <= 3)"""
_TOKENS = r"regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}_]+')"


def _boost(terms: str, heading: str, text: str) -> str:
    h, t = _TOKENS.format(heading), _TOKENS.format(text)
    d = f"list_distinct({terms})"
    return f"(CASE WHEN len({d}) = 0 THEN 0.0::DOUBLE ELSE {S.keyword_boost_weight} * least(1.0, list_sum(list_transform({d}, lambda z: CASE WHEN list_contains({h}, z) THEN 1.0::DOUBLE WHEN list_contains({t}, z) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)) / len({d})) END)"


def _variants(terms: str) -> str:
    """variants of the first eight terms in order, repeats out."""
    return f"""vx AS (SELECT query_id, unnest(list_concat({terms}[1:8], [])) AS t, generate_subscripts({terms}[1:8], 1) AS i FROM bt),
    vy AS (SELECT query_id, i, 1 AS j, t AS variant FROM vx UNION ALL SELECT query_id, i, 2, upper(substr(t, 1, 1)) || substr(t, 2) FROM vx UNION ALL SELECT query_id, i, 3, upper(t) FROM vx),
    vz AS (SELECT query_id, variant, min(i * 3 + j) AS o FROM vy GROUP BY ALL), va AS (SELECT query_id, variant, row_number() OVER (PARTITION BY query_id ORDER BY o) - 1 AS variant_ord FROM vz)"""


_LEX = """lex AS (SELECT va.query_id, variant_ord, variant, corpus.chunk_id, score, row_number() OVER (PARTITION BY va.query_id, variant_ord ORDER BY score DESC, corpus.chunk_id) AS rank
    FROM va JOIN corpus ON contains(corpus.text, variant) JOIN cos ON cos.query_id = va.query_id AND cos.chunk_id = corpus.chunk_id QUALIFY rank <= 5)"""
_HYBRID = f"""{_ASKED}, {_TERMS}, {_VOCAB}, {_FUZZY}, {_CORPUS},
    fx AS (SELECT query_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM tq),
    fl AS (SELECT term, list(match ORDER BY rank) AS ms FROM fm GROUP BY term),
    fp AS (SELECT query_id, list(ms ORDER BY pos)[1:4] AS mss FROM fx JOIN fl USING (term) GROUP BY query_id),
    fd AS (SELECT query_id, unnest(flatten(mss)) AS m, generate_subscripts(flatten(mss), 1) AS o FROM fp),
    fe AS (SELECT query_id, m, min(o) AS o FROM fd GROUP BY ALL),
    ff AS (SELECT fe.query_id, list(m ORDER BY o) AS fuzzy FROM fe JOIN tq USING (query_id) WHERE NOT list_contains(terms, m) GROUP BY fe.query_id),
    bt AS (SELECT query_id, list_concat(terms, coalesce(fuzzy, [])) AS bterms FROM tq LEFT JOIN ff USING (query_id)),
    {_variants('bterms')}, {_embed('qe', 'asked', 'query_id', 'question')}, {_embed('de', 'corpus', 'chunk_id', 'text')}, {_cosine('qe', 'de', 'query_id', 'chunk_id')},
    dense AS (SELECT query_id, chunk_id, score, -1 AS variant_ord, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM cos QUALIFY rank <= 40), {_LEX},
    un AS (SELECT query_id, chunk_id, score, variant_ord, rank FROM dense UNION ALL SELECT query_id, chunk_id, score, variant_ord, rank FROM lex),
    me AS (SELECT query_id, chunk_id, min(score) AS score, min(variant_ord * 1000 + rank) AS o FROM un GROUP BY ALL),
    rr AS (SELECT me.query_id, me.chunk_id, score, o, round(score + {_boost('bterms', 'heading_path', 'text')}, 4) AS rerank_score FROM me JOIN bt USING (query_id) JOIN corpus USING (chunk_id)),
    hy AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, o, chunk_id) AS rank, chunk_id, score, rerank_score FROM rr QUALIFY rank <= 8)"""
_MSG = S.not_available_message.replace("'", "''")
_SAID = f"""said AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN text || ' [1][3] (x) [1] [99]' WHEN 1 THEN '{_MSG} ' WHEN 2 THEN text
    ELSE text || ' [2] [0] ( ) [99999999999999999999]' END AS said FROM conversations WHERE role = 'assistant'),
    nums AS (SELECT conv_id, turn, said, list_filter(list_transform(regexp_extract_all(said, '\\[(\\d+)\\]', 1), lambda x: try_cast(x AS BIGINT)), lambda x: x IS NOT NULL AND x >= 1 AND x <= 3) AS ns FROM said),
    each AS (SELECT conv_id, turn, unnest(ns) AS n, generate_subscripts(ns, 1) AS o FROM nums), once AS (SELECT conv_id, turn, n, min(o) AS o FROM each GROUP BY ALL)""".replace("\\\\", "\\")
_REFUSAL = f"(regexp_replace({_squeeze('said')}, '\\.+$', '') = '{_MSG.strip().lower().rstrip('.')}')"
_LAST = "SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations QUALIFY age <= 6"


def _chunks() -> str:
    """The chunker as a recursive walk over each long document's sentences: ``lo`` is the first sentence of the open chunk, ``n`` its words."""
    size, overlap = S.chunk_max_tokens, S.chunk_overlap_tokens
    step = size - overlap
    return rf"""RECURSIVE tb AS (SELECT doc_id, text, {_nw('text')} AS nw FROM (SELECT doc_id, {_BLOCK} AS text FROM documents) WHERE text <> ''),
    la AS (SELECT doc_id, regexp_split_to_array(text, '\n+') AS ls FROM tb WHERE nw > {size}),
    lb AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS l FROM la),
    lc AS (SELECT doc_id, i, string_split(regexp_replace(l, '([.!?])["'')\]]?\s+([A-Z0-9("''\[])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ss FROM lb),
    ld AS (SELECT doc_id, i, generate_subscripts(ss, 1) AS j, {_trim('unnest(ss)')} AS sentence FROM lc),
    se AS MATERIALIZED (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM (SELECT doc_id, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS i, {_nw('sentence')} AS w FROM ld WHERE sentence <> '')),
    tl AS (SELECT a.doc_id, a.i, min(b.i) AS tail FROM se a JOIN se b ON a.doc_id = b.doc_id AND b.i < a.i AND b.i >= a.i - {overlap} AND a.c - a.w - (b.c - b.w) <= {overlap} GROUP BY ALL),
    st AS MATERIALIZED (SELECT se.doc_id, se.i, se.w, se.c, coalesce(tail, se.i) AS tail FROM se LEFT JOIN tl USING (doc_id, i)),
    go AS (SELECT doc_id, i, CASE WHEN w > {size} THEN i + 1 ELSE i END AS lo, CASE WHEN w > {size} THEN 0 ELSE w END AS n, NULL::BIGINT AS cut FROM st WHERE i = 1 UNION ALL
           SELECT s.doc_id, s.i, CASE WHEN s.w > {size} THEN s.i + 1 WHEN g.n + s.w > {size} AND g.lo < s.i THEN greatest(g.lo, s.tail) ELSE g.lo END,
                  CASE WHEN s.w > {size} THEN 0 WHEN g.n + s.w > {size} AND g.lo < s.i THEN s.c - (p.c - p.w) ELSE g.n + s.w END,
                  CASE WHEN g.lo < s.i AND (s.w > {size} OR g.n + s.w > {size}) THEN g.lo END
           FROM go g JOIN st s ON s.doc_id = g.doc_id AND s.i = g.i + 1 JOIN st p ON p.doc_id = g.doc_id AND p.i = greatest(g.lo, s.tail)),
    en AS (SELECT doc_id, max(i) AS last FROM se GROUP BY doc_id),
    ra AS (SELECT doc_id, i AS spot, cut AS lo, i - 1 AS hi FROM go WHERE cut IS NOT NULL UNION ALL SELECT doc_id, i + 1, lo, i FROM go JOIN en USING (doc_id) WHERE i = last AND lo <= i),
    mo AS (SELECT doc_id, i, regexp_split_to_array(sentence, '\s+') AS w FROM se WHERE w > {size}),
    mw AS (SELECT doc_id, i, w, unnest(range(0, floor((len(w) - {overlap}) / {step})::BIGINT * {step} + 1, {step})) AS s FROM mo),
    pc AS (SELECT doc_id, 0 AS spot, 0 AS k, 0 AS s, text FROM tb WHERE nw <= {size}
           UNION ALL SELECT ra.doc_id, spot, 0, 0, string_agg(sentence, ' ' ORDER BY se.i) FROM ra JOIN se ON se.doc_id = ra.doc_id AND se.i BETWEEN lo AND hi GROUP BY ra.doc_id, spot, lo, hi
           UNION ALL SELECT doc_id, i, 1, s, array_to_string(w[s + 1 : s + {size}], ' ') FROM mw),
    pieces AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY spot, k, s) - 1 AS piece_ord, text, {_nw('text')}::BIGINT AS token_count FROM pc WHERE {_trim('text')} <> ''),
    jr AS (SELECT *, sha256({_squeeze('text')}) AS h, CASE WHEN token_count < {S.chunk_min_tokens} THEN 'short' WHEN {_nav('text')} THEN 'nav' WHEN {_garbage('text')} THEN 'garbage' END AS bad FROM pieces),
    judged AS (SELECT *, CASE WHEN bad IS NULL AND row_number() OVER (PARTITION BY h, bad IS NULL ORDER BY doc_id, piece_ord) > 1 THEN 'duplicate' ELSE bad END AS reason FROM jr)"""


def _limiter(part: str, source: str, window: int, limit: int) -> str:
    """The admitted-only window as a recursive walk over each session's events."""
    return f"""RECURSIVE {source},
    o AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY us, event_id) AS i FROM ev),
    go AS (SELECT {part}, event_id, us, i, false AS limited, [us] AS hits FROM o WHERE i = 1 UNION ALL
           SELECT o.*, len(l.live) >= {limit} AS limited, CASE WHEN len(l.live) < {limit} THEN list_append(l.live, o.us) ELSE l.live END AS hits
           FROM (SELECT {part}, event_id, us, i FROM o) o JOIN go ON {' AND '.join(f'o.{c.strip()} = go.{c.strip()}' for c in part.split(','))} AND o.i = go.i + 1, LATERAL (SELECT list_filter(go.hits, lambda h: o.us - h <= {window}) AS live) l)"""


_EV = "ev AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events)"
_EPOCH = "ep AS (SELECT event_id, user_id, coalesce(sum((event_type = 'signup')::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS epoch, epoch_us(ts) AS us FROM events)"
_NEW = "n AS (SELECT doc_id + (CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1000000 END) AS doc_id, 'new ' || text AS text, -1::BIGINT AS n_chars FROM documents WHERE doc_id % 7 = 0)"
_SEEDS = """s AS (SELECT DISTINCT source AS label FROM documents), f AS (SELECT source AS label, doc_id::VARCHAR AS chunk_id FROM documents WHERE right(source, 1) <> '3'),
    c AS (SELECT label, chunk_id FROM f UNION ALL SELECT label, 'ext::' || label || '::desc' FROM s WHERE label NOT IN (SELECT label FROM f) OR right(label, 1) = '1')"""

ORACLE_SQL = {
    "sentence_split": rf"""
        WITH a AS (SELECT doc_id, regexp_split_to_array(text, '\n+') AS ls FROM documents),
        b AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS l FROM a),
        c AS (SELECT doc_id, i, string_split(regexp_replace(l, '([.!?])["'')\]]?\s+([A-Z0-9("''\[])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ss FROM b),
        d AS (SELECT doc_id, i, generate_subscripts(ss, 1) AS j, {_trim('unnest(ss)')} AS sentence FROM c)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS pos, sentence FROM d WHERE sentence <> ''""",
    "word_counts": f"SELECT doc_id, {_nw('text')}::BIGINT AS n_words FROM documents",
    "text_hashes": f"SELECT doc_id, sha256({_squeeze('text')}) AS h FROM documents",
    "nav_filter": f"SELECT doc_id, {_nav('text')} AS nav FROM documents",
    "garbage_filter": f"SELECT doc_id, {_garbage('text')} AS garbage FROM documents",
    "short_filter": f"SELECT doc_id, {_nw('text')}::BIGINT AS n_words FROM documents WHERE {_nw('text')} < 25",
    "shell_filter": r"SELECT doc_id, len(regexp_extract_all(t, '\{\{')) >= 2 AND contains(t, '}}') AS shell FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{{a}} {{b}} ' || text WHEN 1 THEN '{{a }' || text ELSE text END AS t FROM documents)",
    "shortcode_strip": f"SELECT doc_id, sha256(regexp_replace('[caption id=1]x[/caption] [VC_row a] ' || text || ' [keep]', '{config.SHORTCODE}', '', 'g')) AS h FROM documents",
    "hashing_embeddings": f"""WITH {_embed('de', 'documents', 'doc_id', 'text')}
        SELECT a.doc_id, place, round(coalesce(s / nullif(len, 0), 0.0), 6) AS x FROM documents a CROSS JOIN (SELECT unnest(range(0, {DIM})) AS place) LEFT JOIN de_p ON de_p.doc_id = a.doc_id AND de_p.p = place LEFT JOIN de_l ON de_l.doc_id = a.doc_id""",
    "keyword_boost": f"""WITH {_ASKED}, {_TERMS}, {_CORPUS}, words AS MATERIALIZED (SELECT chunk_id, {_TOKENS.format('heading_path')} AS h, list_distinct({_TOKENS.format('text')}) AS t FROM corpus),
        terms AS (SELECT query_id, list_distinct(terms) AS d FROM tq), hits AS (SELECT query_id, chunk_id, len(d) AS n, len(list_intersect(d, h)) AS a, len(list_intersect(d, list_concat(h, t))) AS b FROM terms CROSS JOIN words)
        SELECT query_id, chunk_id, round(CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE {S.keyword_boost_weight}::DOUBLE * least(1.0::DOUBLE, (0.5::DOUBLE * (a + b)) / n) END, 6) AS boost FROM hits""",
    "pdf_text_blocks": f"SELECT doc_id, t AS text FROM (SELECT doc_id, {_BLOCK} AS t FROM documents) WHERE t <> ''",
    "exact_dedup": f"SELECT sha256({_squeeze('text')}) AS h, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "paragraph_doc_freq": f"WITH {_PARAS}, {_FREQ} SELECT * FROM f",
    "boilerplate_hashes": f"WITH {_PARAS}, {_FREQ}, {_BOILER} SELECT * FROM b",
    "boilerplate_strip": f"WITH {_PARAS}, {_FREQ}, {_BOILER} SELECT doc_id, string_agg(para, chr(10) ORDER BY pos) AS text FROM p WHERE h NOT IN (SELECT h FROM b) GROUP BY doc_id",
    "hard_window_split": rf"""WITH a AS (SELECT doc_id, regexp_split_to_array({_trim('text')}, '\s+') AS w FROM documents), b AS (SELECT doc_id, w, unnest(range(0, floor((len(w) - 100) / 380)::BIGINT * 380 + 1, 380)) AS s FROM a WHERE len(w) > 480),
        c AS (SELECT doc_id, s // 380 AS pos, w[s + 1 : s + 480] AS x FROM b) SELECT doc_id, pos, len(x)::BIGINT AS n_words, sha256(array_to_string(x, ' ')) AS h FROM c""",
    "chunk_documents": f"WITH {_chunks()} SELECT doc_id, piece_ord, token_count, sha256(text) AS h FROM pieces",
    "chunk_drop_reasons": f"WITH {_chunks()} SELECT doc_id, piece_ord, coalesce(reason, 'kept') AS reason FROM judged",
    "process_stats": f"""WITH {_chunks()} SELECT count(*) AS pieces, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason = 'short') AS dropped_short, count(*) FILTER (reason = 'nav') AS dropped_nav,
        count(*) FILTER (reason = 'garbage') AS dropped_garbage, count(*) FILTER (reason = 'duplicate') AS dropped_duplicate, coalesce(avg(token_count) FILTER (reason IS NULL), 0.0) AS avg_tokens FROM judged""",
    "chunk_index": f"""WITH {_chunks()}, k AS (SELECT doc_id, piece_ord, doc_id AS site, row_number() OVER (PARTITION BY doc_id ORDER BY piece_ord) - 1 AS chunk_index FROM judged WHERE reason IS NULL)
        SELECT *, sha256(site || '|' || chunk_index) AS chunk_id FROM k""",
    "vocabulary": f"WITH {_VOCAB} SELECT * FROM voc ORDER BY term",
    "embedding_inputs": f"SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 AND {_trim('source')} <> '' THEN source || chr(10) || text ELSE text END) AS h FROM documents",
    "chunk_metadata": "SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 > 0 THEN source ELSE '' END AS source_url, '' AS page_title, '' AS heading_path, 0::BIGINT AS chunk_index, '' AS crawl_timestamp, CASE WHEN doc_id % 5 > 0 THEN n_chars ELSE 0 END AS token_count, false AS is_pdf FROM documents",
    "snippets": "SELECT doc_id, substr(text, 1, 200) AS snippet FROM documents",
    "knn_cosine": """SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 4) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, c.vec_id) AS rank
        FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0 QUALIFY rank <= 40""",
    "dense_index_exact": """SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 4) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, c.vec_id) AS rank
        FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0 QUALIFY rank <= 40""",
    "knn_topk_per_query": """SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 4) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, c.vec_id) AS rank
        FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0 QUALIFY rank <= 8""",
    "relevance_gate": """WITH k AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 4) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, c.vec_id) AS rank
        FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0 QUALIFY rank <= 8) SELECT query_id, coalesce(max(score) FILTER (query_id <> vec_id), 0.0) AS best, best >= 0.35 AS relevant FROM k GROUP BY query_id""",
    "index_count": "SELECT count(*) AS n FROM embeddings",
    "query_terms": f"WITH {_ASKED}, {_TERMS} SELECT query_id, generate_subscripts(terms, 1) - 1 AS pos, unnest(terms) AS term FROM tq",
    "vocab_anti_join": f"WITH {_ASKED}, {_TERMS}, {_VOCAB}, u AS (SELECT query_id, unnest(list_distinct(terms)) AS term FROM tq) SELECT * FROM u WHERE term NOT IN (SELECT term FROM voc)",
    "fuzzy_corrections": f"WITH {_ASKED}, {_TERMS}, {_VOCAB}, {_FUZZY} SELECT term, match, round(score, 6) AS score, rank FROM fm",
    "lexical_topk": f"""WITH {_ASKED}, {_TERMS}, {_CORPUS}, bt AS (SELECT query_id, terms AS bterms FROM tq), {_variants('bterms')}, {_embed('qe', 'asked', 'query_id', 'question')}, {_embed('de', 'corpus', 'chunk_id', 'text')},
        {_cosine('qe', 'de', 'query_id', 'chunk_id')}, {_LEX} SELECT query_id, variant_ord, variant, chunk_id, score, rank FROM lex""",
    "hybrid_search": f"WITH {_HYBRID} SELECT * FROM hy",
    "history_last_n": f"SELECT conv_id, turn, role, age FROM ({_LAST})",
    "history_prompt": f"SELECT conv_id, string_agg(upper(coalesce(role, '')) || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS history FROM ({_LAST}) GROUP BY conv_id",
    "question_guard": f"""SELECT conv_id, turn, CASE WHEN turn % 3 = 1 OR {_trim('text')} = '' THEN 'empty' WHEN length({_trim('text')}) > 1000 THEN 'too_long' ELSE 'ok' END AS verdict, conv_id % 150 BETWEEN 1 AND 128 AS session_ok FROM conversations""",
    "citation_extract": f"WITH {_SAID} SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY o) - 1 AS pos, n FROM once",
    "citation_strip": rf"WITH {_SAID} SELECT conv_id, turn, sha256(" + _trim(r"regexp_replace(regexp_replace(regexp_replace(said, '\s*\[\d+\]', '', 'g'), '\(\s*\)', '', 'g'), '[ \t]{2,}', ' ', 'g')") + ") AS h FROM said",
    "refusals": f"WITH {_SAID} SELECT conv_id, turn, {_REFUSAL} AS refusal FROM said",
    "grounding_downgrade": f"""WITH {_SAID}, g AS (SELECT conv_id, turn, said, (NOT {_REFUSAL}) AND len(ns) > 0 AS grounded, (SELECT count(*) FROM once x WHERE x.conv_id = nums.conv_id AND x.turn = nums.turn) AS c FROM nums)
        SELECT conv_id, turn, sha256(CASE WHEN grounded THEN said ELSE '{_MSG}' END) AS h, CASE WHEN grounded THEN c ELSE 0 END AS n_citations, grounded FROM g""",
    "context_blocks": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
        SELECT conv_id, sha256('<context>' || chr(10) || string_agg('<passage n="' || k || '" source="c:' || turn || '" heading="' || role || '">' || chr(10) || text || chr(10) || '</passage>', chr(10) ORDER BY k) || chr(10) || '</context>') AS h FROM r GROUP BY conv_id""",
    "rate_limit": f"WITH {_limiter('user_id', _EV, 86_400_000_000, 3)} SELECT user_id, event_id, limited FROM go",
    "rate_limit_hot": f"WITH {_limiter('event_type', _EV.replace('user_id', 'event_type'), 86_400_000_000, 20)} SELECT event_type, event_id, limited FROM go",
    "session_reset": f"WITH {_EPOCH} SELECT event_id, user_id, epoch FROM ep",
    "rate_limit_with_resets": f"WITH {_limiter('user_id, epoch', _EPOCH + ', ev AS (SELECT user_id, epoch, event_id, us FROM ep)', 86_400_000_000, 2)} SELECT event_id, limited FROM go",
    "attempts_in_window": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS attempts FROM events",
    "politeness_schedule": """WITH e AS (SELECT user_id % 10 AS host, event_id, epoch_us(ts) / 1e6 AS a, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS i FROM events)
        SELECT event_id AS call_id, round(max(a - i / 0.001) OVER (PARTITION BY host ORDER BY i) + i / 0.001, 3) AS start FROM e""",
    "upsert_replace": f"WITH {_NEW}, u AS (SELECT doc_id, text, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n) SELECT doc_id, sha256(text) AS h, n_chars FROM u",
    "purge_prefix": f"WITH {_NEW} SELECT doc_id::VARCHAR AS chunk_id, n_chars FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT 'ext::new::' || doc_id, n_chars FROM n",
    "seed_fallback": f"WITH {_SEEDS} SELECT * FROM c",
    "seed_summary": f"WITH {_SEEDS}, p AS (SELECT source AS label, count(*) AS pages FROM documents GROUP BY 1), k AS (SELECT label, count(*) AS chunks FROM c GROUP BY 1) SELECT label, coalesce(pages, 0) AS pages, coalesce(chunks, 0) AS chunks FROM p FULL JOIN k USING (label)",
    "first_wins": "SELECT min(doc_id) AS doc_id, sha256(lower(text)) AS h FROM documents GROUP BY lower(text)",
    "event_props": "SELECT event_id, len(json_keys(props))::BIGINT AS n_keys FROM events",
}
ORACLE_SQL["lexical_index_topk"] = ORACLE_SQL["lexical_topk"]
_CHUNKED = """corpus AS MATERIALIZED (SELECT sha256(doc_id || '|' || (row_number() OVER (PARTITION BY doc_id ORDER BY piece_ord) - 1)) AS chunk_id, substr(split_part(text, chr(10), 1), 1, 60) AS heading_path, text FROM judged WHERE reason IS NULL)"""
_CHUNK_VOCAB = _VOCAB.replace("doc_id, unnest", "chunk_id, unnest").replace("coalesce(source, '')", "heading_path").replace("FROM documents WHERE text IS NOT NULL", "FROM corpus")
ORACLE_SQL["chunked_hybrid_search"] = f"WITH {_chunks()}, {_CHUNKED}, {_HYBRID.replace(_VOCAB, _CHUNK_VOCAB).replace(_CORPUS + ',', '')} SELECT * FROM hy"
