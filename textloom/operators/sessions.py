"""Per-session logic in batch form: history, rate limiting, resets and request guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom import config
from textloom.functions import text as T
from textloom.operators import hot_session
from textloom.scratch import materialize

S = config.SETTINGS

#: Sessions of more events than this are not folded in one row but cut into blocks of at most so many events.
FOLD_EVENTS, BLOCK_EVENTS = 1024, 1 << 18


def last_messages(messages: DataFrame, key: str, order: str, n: int = S.conversation_memory_turns) -> DataFrame:
    """The last n messages of each session; tasks cut to n before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return messages.withColumn("age", F.row_number().over(w).cast("long")).filter(F.col("age") <= n)


def history_prompt(messages: DataFrame, key: str, order: str) -> DataFrame:
    """(key, history): ``ROLE: text`` lines in order."""
    line = F.concat(F.upper(F.coalesce("role", F.lit(""))), F.lit(": "), F.coalesce("text", F.lit("")))
    rows = messages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("ls"))
    return rows.select(key, F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("history"))


def question_guard(question: Column, most: int = S.max_question_chars) -> Column:
    """'empty', 'too_long' or 'ok'."""
    t = T.trim_all(F.coalesce(question, F.lit("")))
    return F.when(t == "", "empty").when(F.length(t) > most, "too_long").otherwise("ok")


def session_id_ok(session: Column) -> Column:
    return F.coalesce(F.length(session).between(1, 128), F.lit(False))


def admitted(times: Column, window_us: int, limit: int) -> Column:
    """array<boolean> for sorted microsecond times: admitted unless ``limit`` admitted calls are at most ``window_us`` old. Rejected calls leave no trace."""
    state = "struct<hits:array<bigint>,out:array<boolean>>"
    zero = F.expr(f"cast(named_struct('hits', array(), 'out', array()) as {state})")

    def step(s: Column, t: Column) -> Column:
        live = F.filter(s["hits"], lambda h: t - h <= window_us)
        ok = F.size(live) < limit
        return F.struct(F.when(ok, F.array_append(live, t)).otherwise(live).alias("hits"), F.array_append(s["out"], ok).alias("out")).cast(state)

    return F.aggregate(times, zero, step, lambda s: s["out"])


def rate_limited(
    events: DataFrame, keys: list[str], ts: str, event_id: str, window_us: int = 60_000_000, limit: int = S.rate_limit_per_minute,
    fold: int = FOLD_EVENTS, block: int = BLOCK_EVENTS,
) -> DataFrame:
    """(keys.., event_id, limited): the admitted-only sliding window over each session's events in order of time and id.

    Sessions of at most ``fold`` events are folded in one row each; larger ones go through ``hot_session.limited``, which never gathers more than
    ``block`` events and gives the same result. Events without a time are admitted and leave no trace; null keys are a session.
    """
    rows = events.select(F.struct(*keys).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(event_id).alias("id"))
    timed = rows.filter("us IS NOT NULL")
    hot = materialize(timed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > fold).select("k"), "hot")
    some = hot.limit(1).count() > 0
    usual = timed.join(hot, "k", "left_anti") if some else timed
    lists = usual.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("us", "id"))).alias("es"))
    judged = lists.withColumn("ok", admitted(F.transform("es", lambda e: e["us"]), window_us, limit))
    each = F.explode(F.arrays_zip(F.transform("es", lambda e: e["id"]).alias("id"), F.col("ok").alias("ok"))).alias("z")
    out = judged.select("k", each).select("k", F.col("z.id").alias("id"), (~F.col("z.ok")).alias("limited"))
    if some:
        out = out.unionByName(hot_session.limited(timed.join(hot, "k", "left_semi"), window_us, limit, block))
    out = out.unionByName(rows.filter("us IS NULL").select("k", "id", F.lit(False).alias("limited")))
    return out.select(*[F.col("k")[c].alias(c) for c in keys], F.col("id").alias(event_id), "limited")


def with_epoch(events: DataFrame, key: str, ts: str, event_id: str, is_reset: Column) -> DataFrame:
    """Events with ``epoch``: how many resets of the session came before them; a reset clears history and limiter, so both key on it."""
    w = Window.partitionBy(key).orderBy(ts, event_id).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("epoch", F.coalesce(F.sum(is_reset.cast("long")).over(w), F.lit(0)))


def attempts_in_window(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Attempts (admitted or not) of the session within the trailing window, for monitoring."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("us").rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("us", us).withColumn("attempts", F.count(F.lit(1)).over(w)).drop("us")


def throttled(arrivals: Column, spacing: float) -> Column:
    """array<double>: start times of calls that arrive at the given sorted times and must be ``spacing`` apart."""
    return F.aggregate(arrivals, F.array().cast("array<double>"), lambda acc, t: F.array_append(acc, F.when(F.size(acc) == 0, t).otherwise(F.greatest(t, F.try_element_at(acc, F.lit(-1)) + spacing))))


def reset(messages: DataFrame, hits: DataFrame, key: str, session) -> tuple[DataFrame, DataFrame]:
    """(messages, hits) without those of a session: its history and its calls are forgotten, other and null sessions stay."""
    other = ~F.col(key).eqNullSafe(F.lit(session))
    return messages.filter(other), hits.filter(other)
