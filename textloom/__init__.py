"""textloom: a Spark-first engine for crawled pages, text corpora and hybrid retrieval."""
