"""Token bucket: effects of runs of events, and hot callers over several tasks."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import rate_limit
from factloom.operators.rate_limit import Bucket, Effect, token_bucket


@pytest.mark.parametrize(("rate", "capacity"), [(1.0, 5.0), (1 / 43200, 3.0), (2.5, 0.5), (0.3, 7.25), (1000.0, 1.0)])
def test_effect_of_a_run_is_the_fold_at_every_level(rate, capacity):
    r, bucket = random.Random(1), Bucket.of(rate, capacity)
    for n in (1, 2, 7, 60):
        gaps = [0, *(r.choice([0, 1, int(0.3e6 / rate), int(1e6 / rate), int(1.7e6 / rate)]) for _ in range(n - 1))]
        times = [sum(gaps[: i + 1]) for i in range(n)]
        effect = Effect.none()
        for gap in gaps:
            effect = effect.then(bucket, gap)
        assert len(effect.starts) <= 3 * capacity + 6
        levels = {0, 1, bucket.full, bucket.token, bucket.token - 1, *(r.randrange(bucket.full + 1) for _ in range(200)), *effect.starts, *(s - 1 for s in effect.starts if s)}
        assert all(effect(x) == bucket.fold(x, 0, times)[0] for x in levels if x <= bucket.full)


def by_hand(rows, bucket):
    out, state = {}, {}
    for user, n, us in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[2], r[1])):
        level, last = state.get(user, (bucket.full, us))
        level, (ok,), (left,) = bucket.fold(level, last, [us])
        state[user], out[n] = (level, us), (ok, round(left / bucket.token, 6))
    return out


def decide(spark, rows, rate, capacity, parts=7):
    events = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "user string, n long, us long").withColumn("ts", F.timestamp_micros("us"))
    found = token_bucket(events, "user", "ts", "n", rate, capacity)
    return found, {r.n: (r.allowed, round(r.tokens_left, 6)) for r in found.collect()}


def test_one_dense_caller_lies_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(rate_limit, "BLOCK_EVENTS", 10_000)
    r, us, rows = random.Random(3), 0, []
    for n in range(200_000):
        us += r.choice([0, 50_000, 150_000])  # ten a second, never idle long enough to fill the bucket
        rows.append(("hot", n, us))
    rows += [(f"u{i % 50}", 200_000 + i, r.randrange(10**9)) for i in range(500)]
    found, got = decide(spark, rows, 3.0, 5.0)
    assert got == by_hand(rows, Bucket.of(3.0, 5.0))
    tasks = found.filter("user = 'hot'").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(tasks) > 5 and max(t["count"] for t in tasks) < 40_000


@pytest.mark.parametrize("block", [1_000_000, 20])
def test_callers_ties_and_nulls(spark, monkeypatch, block):
    monkeypatch.setattr(rate_limit, "BLOCK_EVENTS", block)
    r = random.Random(5)
    rows = [(r.choice(["a", "b", "c", None]), n, r.choice([0, 1_000_000, 1_500_000, 7_000_000, r.randrange(10**8)])) for n in range(400)]
    for rate, capacity in ((1.0, 3.0), (0.25, 2.0), (1.0, 0.5)):
        assert decide(spark, rows, rate, capacity)[1] == by_hand(rows, Bucket.of(rate, capacity))
    timeless = spark.createDataFrame([("a", 1, None), ("a", 2, 5)], "user string, n long, us long").withColumn("ts", F.timestamp_micros("us"))
    assert sorted((x.n, x.allowed, x.tokens_left) for x in token_bucket(timeless, "user", "ts", "n", 1.0, 3.0).collect()) == [(1, False, None), (2, True, 2.0)]
    assert token_bucket(timeless.limit(0), "user", "ts", "n").isEmpty()
