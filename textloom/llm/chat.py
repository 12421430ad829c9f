"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A log holds events (conv_id, seq, kind, turn, role, text), in order of seq, a number or a struct. Folded, they give a conversation's turns:

* ``message``  starts a turn (a later one of the same turn number starts another turn),
* ``delta``    appends streamed text to the latest turn of its number, which it starts if need be,
* ``edit``     replaces that turn's text,
* ``regenerate`` replaces that turn's text and drops every turn of a higher number.

The fold is linear in the events and split within a conversation. Events are gathered by conversation and turn, so the deltas of a long
conversation lie in many tasks. What a regeneration drops is a prefix of each later turn's events: all up to the last ``regenerate`` of a
lower number. That running maximum goes over one narrow row a turn, in blocks of ``TURN_BLOCK`` turns that take over the maximum of the
blocks before them. What is left of a turn's events is cut at its messages; each cut's text is its last replacement and the deltas after it.

Template: each turn is ``<s>[ROLE]role[/ROLE]text</s>``. In roles and texts a backslash becomes ``\\\\``, and the first character of each
control string (``<s> </s> [INST] [/INST] [ROLE] [/ROLE]``) becomes ``\\l`` or ``\\b``, so no control string is left in a text and
unescaping is exact. The loss mask is kept as segments (text, loss): their concatenation is the formatted string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.functions.text import let

CONTROL = r"<(?=/?s>)", r"\[(?=/?(?:INST|ROLE)\])"
LOSS_ROLE = "assistant"
TURN_BLOCK = 64
#: Characters of a delta of ``as_log``.
PART = 200
DRAFT = "A draft that is </s> [INST] replaced"


def escape(c: Column) -> Column:
    out = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(out, CONTROL[0], r"\\l"), CONTROL[1], r"\\b")


def unescape(c: Column) -> Column:
    """Exact inverse of ``escape``: doubled backslashes first cut the text, so no other escape can straddle a cut."""
    return F.array_join(F.transform(F.split(c, r"\\\\"), lambda x: F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))), "\\")


def _turns(events: Column) -> Column:
    """array<struct<seq, kind, first_role, first_text, role, text>> of one turn number's sorted events: cut at messages; a cut's text is its last replacement and what follows."""
    places = F.when(F.size(events) > 0, F.sequence(F.lit(0), F.size(events) - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | (F.get(events, i)["kind"] == "message"))

    def turn(own: Column) -> Column:
        replaced = F.array_max(F.filter(F.sequence(F.lit(1), F.size(own)), lambda i: (i == 1) | (F.get(own, i - 1)["kind"] != "delta")))
        text = F.array_join(F.transform(F.slice(own, replaced, F.size(own)), lambda e: e["text"]), "")
        return let(F.get(own, F.lit(0)), lambda e: F.struct(e["seq"].alias("seq"), e["kind"].alias("kind"), F.col("turn"), e["role"].alias("first_role"), e["text"].alias("first_text"), e["role"].alias("role"), text.alias("text")))

    # ``let``: a lambda would work out what it captures once for each element
    return let(starts, lambda st: F.transform(st, lambda s, k: let(F.slice(events, s + 1, F.coalesce(F.get(st, k + 1), F.size(events)) - s), turn)))


def _dropped(narrow: DataFrame) -> DataFrame:
    """(conv, number, upto): the last ``regenerate`` (seq, kind, turn) of a lower turn number, from rows (conv_id, turn, again) of each turn's own last one."""
    rows = narrow.withColumn("block", F.coalesce(F.floor(F.col("turn") / TURN_BLOCK), F.lit(-1 << 62)))  # turns without a number come first
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("conv_id", "block").agg(F.max("again").alias("again")).select(F.col("conv_id").alias("conv"), F.col("block").alias("at"), F.max("again").over(before).alias("carried"))
    within = Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    both = rows.withColumn("own", F.max("again").over(within)).join(carried, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("block") == F.col("at")))
    return both.select("conv", F.col("turn").alias("number"), F.greatest("own", "carried").alias("upto")).filter("upto IS NOT NULL")


def fold(log: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, turns array<struct<role, text>> after the last event, in the order in which the turns started.

    A null text or role is empty, a null kind is a message; an unknown kind replaces its turn's text as an edit does. Events of equal sequence
    are ordered by all their fields, so repeated rows give repeated turns. Null conv_ids form one conversation, events without a turn number
    one number below all others, events without a seq come first. Extra columns are ignored, an empty log gives no rows. The result
    is one row a conversation, so its turns meet in one task in the end; that is the contract's, not the plan's.
    """
    seq = F.col("seq") if isinstance(log.schema["seq"].dataType, StructType) else F.col("seq").cast("long")
    e = log.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.struct(seq.alias("seq"), F.coalesce(F.col("kind").cast("string"), F.lit("message")).alias("kind"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("e"),
    )
    again = F.max(F.when(F.col("e.kind") == "regenerate", F.struct(F.col("e.seq").alias("seq"), F.col("e.kind").alias("kind"), F.col("turn")))).alias("again")
    narrow = e.groupBy("conv_id", "turn").agg(again)
    having = narrow.filter("again IS NOT NULL").select(F.col("conv_id").alias("c")).distinct()
    gone = _dropped(narrow.join(having, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi"))
    per = e.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list("e")).alias("events"))
    met = per.join(gone, F.col("conv_id").eqNullSafe(F.col("conv")) & F.col("turn").eqNullSafe(F.col("number")), "left")
    stay = F.filter("events", lambda x: F.struct(x["seq"].alias("seq"), x["kind"].alias("kind"), F.col("turn")) > F.col("upto"))
    left = met.select("conv_id", "turn", F.when(F.col("upto").isNull(), F.col("events")).otherwise(stay).alias("left"))
    whole = left.select("conv_id", _turns(F.col("left")).alias("turns")).groupBy("conv_id").agg(F.array_sort(F.flatten(F.collect_list("turns"))).alias("turns"))
    return whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def render(log: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments array<struct<text, loss>>, from the log's fold."""
    pieces = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(F.concat(F.lit("<s>[ROLE]"), escape(t["role"]), F.lit("[/ROLE]")).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(t["text"]).alias("text"), (t["role"] == LOSS_ROLE).alias("loss")),
                F.struct(F.lit("</s>").alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return fold(log).select("conv_id", pieces.alias("segments")).select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>> parsed from ``formatted``; loss: the unescaped text under the mask."""
    cut = F.filter(F.split("formatted", "</s>"), lambda x: x != "")
    turns = F.transform(cut, lambda x: F.struct(unescape(F.substring_index(F.substring(x, len("<s>[ROLE]") + 1, 1 << 30), "[/ROLE]", 1)).alias("role"), unescape(F.substring(x, F.instr(x, "[/ROLE]") + len("[/ROLE]"), F.lit(1 << 30))).alias("text")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return rendered.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))


def as_log(conversations: DataFrame) -> DataFrame:
    """A table (conv_id, turn, role, text) as the log of a chat service, (conv_id, seq, kind, turn, role, text), whose fold is the table again.

    The loss role's texts are streamed in deltas of ``PART`` characters, the others come as messages. A turn of odd number has a draft first: the loss
    role's is regenerated, which drops a turn that was begun after it; another's is edited. Turn numbers are longs, seq is (turn, place of the event in it); rows of one conversation
    and number follow one another by role and text, repeated rows too. Null roles and texts are empty.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = conversations.groupBy("conv_id", F.col("turn").cast("long").alias("at")).agg(F.array_sort(F.collect_list(F.struct(role, text))).alias("rows"))
    at = F.col("at")
    drafted = (at % 2 != 0) & (at < (1 << 63) - 1)  # the last number has none after it
    event = lambda kind, role, text, turn=at: F.struct(F.lit(kind).alias("kind"), turn.alias("turn"), role.alias("role"), text.alias("text"))

    def events(r: Column) -> Column:
        streamed = F.transform(F.regexp_extract_all(r["text"], F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), lambda p: event("delta", r["role"], p))
        draft, nothing = F.lit(DRAFT), F.lit("")
        begun = F.array(event("message", r["role"], draft), event("delta", r["role"], draft), event("message", F.lit("user"), draft, F.try_add(at, F.lit(1))), event("regenerate", r["role"], nothing))
        return (
            F.when((r["role"] == LOSS_ROLE) & drafted, F.concat(begun, streamed))
            .when(r["role"] == LOSS_ROLE, F.concat(F.array(event("message", r["role"], nothing)), streamed))
            .when(drafted, F.array(event("message", r["role"], draft), event("edit", r["role"], r["text"])))
            .otherwise(F.array(event("message", r["role"], r["text"])))
        )

    each = rows.select("conv_id", "at", F.posexplode(F.flatten(F.transform("rows", events))).alias("k", "e"))
    return each.select("conv_id", F.struct("at", "k").alias("seq"), "e.*")
