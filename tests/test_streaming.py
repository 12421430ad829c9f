"""The streaming limiter and memory against their batch forms."""

from pyspark.sql import functions as F

from tests.conftest import SF
from textloom.operators import sessions
from textloom.streaming import sessions as streaming


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_limiter_and_memory(spark, tmp_path):
    streaming.state_store(spark)
    events = spark.read.parquet(f"{SF}/events.parquet")
    rows = events.select(F.col("user_id").alias("session"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", F.col("event_type").alias("kind"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/events")
    got = run(spark, streaming.rate_limited(stream, 86_400_000_000, 3), "limited", "append")
    want = sessions.rate_limited(events, ["user_id"], "ts", "event_id", window_us=86_400_000_000, limit=3)
    assert sorted((r["event_id"], r["limited"]) for r in got.collect()) == sorted((r["event_id"], r["limited"]) for r in want.collect())

    said = spark.read.parquet(f"{SF}/conversations.parquet").select(F.col("conv_id").alias("session"), "turn", "role", "text")
    said.coalesce(1).write.parquet(f"{tmp_path}/said")
    stream = spark.readStream.schema(said.schema).parquet(f"{tmp_path}/said")
    got = run(spark, streaming.conversation_memory(stream), "memory_out", "update")
    last = sessions.last_messages(said, "session", "turn")
    want = sessions.history_prompt(last, "session", "turn")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


EVENTS = "session bigint, us bigint, event_id bigint, kind string, ts timestamp"


def arrivals(spark, path, batches):
    """One file a batch, in order."""
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(s, t * 1_000_000, e, "x") for s, t, e in rows], "session bigint, us bigint, event_id bigint, kind string")
        df.withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(path)


def take(spark, path, out, mark, most=1):
    """What a limiter of 2 calls a minute says, and the rows of its state after each batch."""
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", most).parquet(path)
    limited = streaming.rate_limited(stream, 60_000_000, 2, watermark="10 seconds")
    q = limited.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
    q.awaitTermination(200)
    return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


def test_state_of_idle_sessions_goes_and_results_stay(spark, tmp_path):
    streaming.state_store(spark)
    first = [[(s, 100 + s, 10 * s + k) for k in range(3)] for s in range(6)]
    batches = [sum(first, []), [(99, 500, 900)], [(99, 501, 901), (1, 520, 902)], [(99, 2000, 903)], [(99, 2001, 904)]]
    for rows in batches[:2]:
        arrivals(spark, f"{tmp_path}/in", [rows])
    one = take(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark")
    # a restart goes on from the checkpoint
    for rows in batches[2:]:
        arrivals(spark, f"{tmp_path}/in", [rows])
    two = take(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark")
    assert max(one) >= 6 and two[-1] <= 2, (one, two)
    got = sorted((r["event_id"], r["limited"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    rows = [(s, t, e) for b in batches for s, t, e in b]
    events = spark.createDataFrame(rows, "user_id bigint, t bigint, event_id bigint").withColumn("ts", F.timestamp_seconds("t"))
    want = sessions.rate_limited(events, ["user_id"], "ts", "event_id", window_us=60_000_000, limit=2)
    assert got == sorted((r["event_id"], r["limited"]) for r in want.collect())
    assert sum(limited for _, limited in got) == 6
