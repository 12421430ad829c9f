"""The limiter over sessions that are cut into blocks, against a plain walk."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import hot_session, sessions


def model(events, window, limit):
    hits, out = {}, {}
    for u, t, i in sorted((e for e in events if e[1] is not None), key=lambda e: (e[1], e[2])):
        live = [h for h in hits.get(u, []) if t - h <= window]
        out[i] = len(live) >= limit
        hits[u] = live if out[i] else [*live, t]
    return out | {i: False for _, t, i in events if t is None}


def busy(seed):
    """A session that is crowded throughout, one with calm spells, one with gaps, a small one, one without a key, and events without a time."""
    rng = random.Random(seed)
    rows = [("crowded", rng.randrange(600)) for _ in range(400)]
    rows += [("spells", 100 * rng.randrange(10) + rng.randrange(15) + 30 * rng.randrange(2)) for _ in range(150)] + [("spells", 25 * n) for n in range(60)]
    rows += [("gaps", 1000 * rng.randrange(8) + rng.randrange(40)) for _ in range(200)]
    rows += [("small", rng.randrange(50)) for _ in range(8)] + [(None, rng.randrange(300)) for _ in range(90)]
    rows += [("crowded", None), ("small", None), (None, None)] + [("same", 7)] * 70
    rng.shuffle(rows)
    return [(u, t, i) for i, (u, t) in enumerate(rows)]


@pytest.mark.parametrize(("limit", "window", "block"), [(3, 60, 16), (1, 10, 7), (20, 60, 33), (0, 60, 16)])
def test_blocks_equal_a_walk(spark, limit, window, block):
    events = busy(limit)
    df = spark.createDataFrame(events, "u string, t long, id int").withColumn("ts", F.timestamp_seconds("t"))
    got = sessions.rate_limited(df, ["u"], "ts", "id", window * 1_000_000, limit, fold=10, block=block).collect()
    assert len(got) == len(events) and {r["id"]: r["limited"] for r in got} == model(events, window, limit)
    assert {r["id"]: r["u"] for r in got} == {i: u for u, _, i in events}


def test_no_events(spark):
    df = spark.createDataFrame([], "u string, ts timestamp, id int")
    assert sessions.rate_limited(df, ["u"], "ts", "id").collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_live_calls_do_not_depend_on_what_came_before(seed):
    """Where a block claims to know its live calls, every beginning leads to them; a crowded block claims nothing."""
    import numpy as np

    rng = random.Random(seed)
    limit, window, claims = rng.randint(1, 5), rng.randint(3, 12), 0
    for _ in range(150):
        times = np.array(sorted(rng.randrange(rng.choice([30, 120, 400])) for _ in range(rng.randint(1, 40))), dtype=np.int64)
        known = hot_session.known_live(times, window, limit)
        claims += known is not None
        for _ in range(8 if known is not None else 0):
            begin = sorted(int(times[0]) - rng.randrange(window + 3) for _ in range(rng.randint(0, limit)))
            assert hot_session.walk(times, begin, window, limit)[1] == known
    assert claims
    assert hot_session.known_live(np.arange(50), 100, limit) is None
