"""Streams over several micro-batches must end where the batch job ends."""

from datetime import datetime, timedelta
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from paymend.operators import drift, experiments, health, locks
from paymend.streaming import io, jobs, stores
from paymend.streaming import locks as stream_locks, queries as stream_queries
from paymend.streaming.locks import settle, walk

T0 = datetime(2024, 1, 1)


def as_files(spark, path, df, parts):
    """The rows as a folder of files that arrive one after the other, in the given order."""
    n = df.count()
    rows = df.collect()
    for i in range(parts):
        chunk = rows[i * n // parts:(i + 1) * n // parts]
        spark.createDataFrame(chunk, df.schema).coalesce(1).write.mode("append").parquet(f"{path}/calls.parquet")
    return io.file_events(spark, str(path), "calls", files_per_batch=1)


@pytest.fixture(scope="module")
def calls(spark):
    rng = random.Random(21)
    at, rows = T0, []
    for i in range(1200):
        at += timedelta(seconds=rng.choice([5, 30, 70, 400]))
        key = "hot" if rng.random() < 0.4 else f"k{rng.randint(0, 5)}"
        rows.append((i, key, at, rng.choice(["sms", "email"]), rng.random() < 0.35, rng.randint(0, 6), rng.uniform(500, 15000) * (1 + (i > 800)), rng.choice(["control", "variant"]), i % 3))
    return spark.createDataFrame(
        rows, "call_id long, key string, at timestamp_ntz, channel string, ok boolean, code int, amount double, arm string, n int"
    )


def same(a, b):
    a, b = a.select(sorted(a.columns)), b.select(sorted(b.columns))
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0


def test_first_seen(spark, calls, tmp_path):
    stream = as_files(spark, tmp_path, calls.select("key", "at", "call_id"), 4)
    want = locks.first_seen(calls, "key", "at", "call_id", ttl_seconds=7200)
    same(jobs.first_seen_stream(stream, "key", "at", "call_id", ttl_seconds=7200), want)


def test_a_restarted_job_remembers_its_locks(spark, calls, tmp_path):
    part = calls.select("key", "at", "call_id")
    job = str(tmp_path / "job")
    as_files(spark, tmp_path, part.filter("call_id < 500"), 2)
    jobs.first_seen_stream(io.file_events(spark, str(tmp_path), "calls", 1), "key", "at", "call_id", 7200, label=job)
    as_files(spark, tmp_path, part.filter("call_id >= 500"), 2)
    out = jobs.first_seen_stream(io.file_events(spark, str(tmp_path), "calls", 1), "key", "at", "call_id", 7200, label=job)
    same(out, locks.first_seen(calls, "key", "at", "call_id", ttl_seconds=7200))


def test_health(spark, calls, tmp_path):
    stream = as_files(spark, tmp_path, calls.select("channel", "call_id", "at", "ok"), 5)
    out = jobs.health_stream(stream).withColumn("at", F.col("at").cast("timestamp_ntz"))
    same(out, health.provider_health(calls))


def test_drift(spark, calls, tmp_path):
    part = calls.select("key", "call_id", "code", "amount")
    stream = as_files(spark, tmp_path, part, 4)
    reference = part.filter("call_id < 600")
    args = ("key", "call_id", "code", "amount", 50, 20)
    same(jobs.drift_stream(stream, reference, *args), drift.monitor(part, reference, *args))


def test_counters_and_posteriors(spark, calls, tmp_path):
    stream = as_files(spark, tmp_path, calls, 3)
    out = jobs.minute_counters(stream, "at", width="5 minutes", amount="n", by=("channel",))
    want = calls.groupBy(F.window("at", "5 minutes").start.alias("window_start"), "channel").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n").alias("amount_paise")
    )
    same(out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), want)
    named = dict(context="key", reward="ok_int")
    post = jobs.bandit_stream(stream.withColumn("ok_int", F.col("ok").cast("int")), **named)
    same(post, experiments.posteriors(calls.withColumn("ok_int", F.col("ok").cast("int")), **named))


def test_counters_of_files_out_of_time_order(spark, calls, tmp_path):
    stream = as_files(spark, tmp_path, calls.orderBy(F.desc("at")), 4)
    out = jobs.minute_counters(stream, "at", width="5 minutes", amount="n", by=("channel",), label="backfill")
    want = calls.groupBy(F.window("at", "5 minutes").start.alias("window_start"), "channel").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n").alias("amount_paise")
    )
    same(out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), want)


def test_events_long_before_their_lock_pass(spark, tmp_path):
    hours = [(120, 1), (0, 2), (1, 3), (97, 4), (96, 5), (121, 6), (144, 7), (24, 8), (47, 9), (150, 10)]
    df = spark.createDataFrame([("k", T0 + timedelta(hours=h), i) for h, i in hours], "key string, at timestamp_ntz, call_id long")
    out = jobs.first_seen_stream(as_files(spark, tmp_path, df, 10), "key", "at", "call_id", label="late")
    # In order of arrival: 3, 4, 6, 9 and 10 lie less than 24 hours from an event kept before.
    assert sorted(r.call_id for r in out.collect()) == [1, 2, 5, 7, 8]


def test_a_decision_five_days_late_is_made(spark, tmp_path):
    body = '{"event":"payment.failed","payload":{"payment":{"entity":{"id":"pay_1","order_id":"o","amount":500000,"error_code":"GATEWAY_ERROR","created_at":1704100000}}}}'
    df = spark.createDataFrame([(body, T0 + timedelta(days=5)), (body, T0), (body, T0 + timedelta(hours=2))], "raw string, received_at timestamp_ntz")
    decisions, rejects, *_ = jobs.decision_stream(as_files(spark, tmp_path, df, 3), label="late-decisions")
    assert decisions.count() == 2 and rejects.count() == 0


def test_retries_wait_and_end(spark, calls, tmp_path):
    stream = as_files(spark, tmp_path, calls.select("call_id"), 3)
    done, dead = jobs.retry_stream(stream, F.col("attempt") < F.col("call_id") % 6)
    assert {(r.call_id % 6, r.attempt) for r in done.collect()} == {(0, 0), (1, 1), (2, 2), (3, 3)}
    assert {(r.call_id % 6, r.attempt) for r in dead.collect()} == {(4, 4), (5, 4)}
    assert done.count() + dead.count() == 1200


def test_decisions_once_and_dead_letters_all(spark, tmp_path):
    def body(i, amount=500_000):
        return (
            '{"event":"payment.failed","payload":{"payment":{"entity":{"id":"pay_%d","order_id":"o","amount":%d,'
            '"error_code":"GATEWAY_ERROR","created_at":1704100000}}}}' % (i, amount)
        )

    rows = [(body(i % 20), T0 + timedelta(minutes=i)) for i in range(60)]
    rows += [("{broken", T0 + timedelta(minutes=5))] * 3 + [(body(99, 0), T0), (body(3), T0 + timedelta(hours=30))]
    df = spark.createDataFrame(rows, "raw string, received_at timestamp_ntz")
    decisions, rejects, *_ = jobs.decision_stream(as_files(spark, tmp_path, df, 4))
    seen = [r.payment_id for r in decisions.collect()]
    assert sorted(seen) == sorted([f"pay_{i}" for i in range(20)] + ["pay_3"])
    assert sorted(r.reason for r in rejects.collect()) == ["amount not positive"] + ["malformed"] * 3
    assert jobs.replayable(rejects).count() == 4
    assert jobs.replayable(rejects.withColumn("attempt", F.lit(3))).count() == 0


def test_walk_of_one_key():
    assert walk([0, 5, 10, 19, 20], None, None, 10, -1000) == ([0, 2, 4], [], 20, None)
    assert walk([3, 25, 31], 20, None, 10, 0) == ([2], [0], 31, None)  # 3 comes late, 25 is held back
    assert walk([5, 12, 40], None, None, 10, 100) == ([], [0, 1, 2], None, 40)  # state may be gone
    assert walk([95], None, None, 10, 100) == ([0], [], 95, None)
    assert walk([18, 29], None, 12, 10, 12) == ([1], [0], 29, 18)


def test_state_of_twenty_batches_stays_flat():
    ttl, live, sizes, kept = 100, pd.DataFrame({"k": pd.Series([], dtype="int64"), "lock": [], "doubt": []}).astype("int64"), [], []
    rng = random.Random(3)
    every, seen = [], 0
    for b in range(20):
        rows = pd.DataFrame([(rng.randint(0, 10**9), b * 300 + rng.randint(0, 299), i) for i in range(200)], columns=["k", "_t", "e"])
        rows = pd.concat([rows, pd.DataFrame([(7, b * 300 + rng.randint(0, 299), 1000 + i) for i in range(30)], columns=["k", "_t", "e"])])
        every.append(rows)
        out, live = settle(rows, live, "k", "e", ttl, seen)
        seen = max(seen, rows["_t"].max())
        sizes.append(len(live))
        kept += out[out["sure"] & (out["k"] == 7)]["_t"].tolist()
    assert max(sizes[5:]) <= 2.5 * max(sizes[:2])
    want = []
    for t in sorted({t for r in every for t in r[r["k"] == 7]["_t"]}):
        if not want or t >= want[-1] + ttl:
            want.append(t)
    assert kept == want


def test_buckets_of_keys_are_small_enough_for_many_new_events(spark):
    """The new events of a bucket are in a worker's memory at once."""
    keys = spark.range(256_000).select(F.concat(F.lit("pay_"), "id").alias("k"))
    sizes = keys.groupBy(F.pmod(F.xxhash64("k"), F.lit(stream_locks.BUCKETS))).count().agg(F.max("count")).first()
    assert sizes[0] < 256_000 // 200


def test_one_event_of_a_key_and_time_is_settled():
    """Keys without state and with one event, ties of a time, null keys and held keys, in any order of the rows."""
    rows = pd.DataFrame(
        [("b", 500, "z"), ("a", 900, "y"), ("b", 500, "c"), (None, 700, "n"), ("old", 90, "o"), ("held", 120, "h"), ("b", 650, "d"), (None, 700, "m")],
        columns=["k", "_t", "e"],
    )
    live = pd.DataFrame({"k": ["held", "gone"], "lock": [110, 10], "doubt": [stream_locks.NO_TIME] * 2})
    out, left = settle(rows, live, "k", "e", 100, 300)
    found = {(None if pd.isna(k) else k, t, e, bool(sure)) for k, t, e, sure in out.itertuples(index=False)}
    assert found == {("b", 500, "c", True), ("b", 650, "d", True), ("a", 900, "y", True), (None, 700, "m", True), ("old", 90, "o", False)}
    assert {(None if pd.isna(k) else k, a, b) for k, a, b in left.itertuples(index=False)} == {
        ("b", 650, stream_locks.NO_TIME), ("a", 900, stream_locks.NO_TIME), (None, 700, stream_locks.NO_TIME), ("held", 110, stream_locks.NO_TIME),
    }


def test_more_envelopes_are_more_files(spark, tmp_path, monkeypatch):
    """A stream's input is cut by its rows, not into a fixed number of files."""
    orders = spark.createDataFrame(
        [(i, 1, "O", 10.0, datetime(2024, 1, 1)) for i in range(100)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz"
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "BUILDING")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 5)
    rows = spark.read.parquet(f"{stream_queries.envelope_files(spark, str(tmp_path))}/envelopes.parquet")
    assert rows.count() == 100 and len(rows.inputFiles()) == 20


def test_expired_keys_are_looked_up(spark, tmp_path):
    """Events from long before the watermark of keys without state are held against the table of kept events."""
    day = lambda d, i, k="k": (k, T0 + timedelta(days=d), i)
    rows = [day(0, 1), day(400, 2, "far"), day(400.1, 3, "far"), day(0.5, 4), day(0.2, 5), day(2, 6), day(1.5, 7), day(3.1, 8), day(1.0, 9)]
    df = spark.createDataFrame(rows, "key string, at timestamp_ntz, call_id long")
    out = jobs.first_seen_stream(as_files(spark, tmp_path, df, 9), "key", "at", "call_id", label=str(tmp_path / "expired"))
    # 3 lies in the lock of 2; 4, 5 in that of 1; 7 within a day of 6; 9 is a day after 1 and a day before 6.
    assert sorted(r.call_id for r in out.collect()) == [1, 2, 6, 8, 9]


def test_fifty_merged_parts_are_few_files(spark, tmp_path):
    table = stores.MergedTable(spark, str(tmp_path / "merged"), lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n")))
    for b in range(50):
        table.write(spark.range(3).select(F.col("id").alias("k"), F.lit(b).cast("bigint").alias("n")), b)
        assert len(table.sources()) <= stores.MERGE_EVERY + 2
    assert {tuple(r) for r in table.read().collect()} == {(k, sum(range(50))) for k in range(3)}
    assert {tuple(r) for r in table.read(49).collect()} == {(k, sum(range(49))) for k in range(3)}
    # The last batch again, as after a crash: it counts once.
    table.write(spark.range(3).select(F.col("id").alias("k"), F.lit(49).cast("bigint").alias("n")), 49)
    assert {tuple(r) for r in table.read().collect()} == {(k, sum(range(50))) for k in range(3)}


def test_retries_resume_with_and_without_input(spark, tmp_path):
    job = str(tmp_path / "job")
    failed = F.col("attempt") < F.col("call_id") % 5
    run = lambda: jobs.retry_stream(io.file_events(spark, str(tmp_path), "calls", 1), failed, label=job)
    as_files(spark, tmp_path, spark.range(10).select(F.col("id").alias("call_id")), 1)
    first = [sorted(map(tuple, t.collect())) for t in run()]
    assert [sorted(map(tuple, t.collect())) for t in run()] == first  # no new input
    as_files(spark, tmp_path, spark.range(10, 20).select(F.col("id").alias("call_id")), 1)
    done, dead = run()
    assert sorted(r.call_id for r in done.collect()) == [i for i in range(20) if i % 5 != 4]
    assert sorted(r.call_id for r in dead.collect()) == [i for i in range(20) if i % 5 == 4]


def envelope(i, amount=500_000):
    return (
        '{"event":"payment.failed","payload":{"payment":{"entity":{"id":"pay_%d","order_id":"o","amount":%d,'
        '"error_code":"GATEWAY_ERROR","created_at":1704100000}}}}' % (i, amount)
    )


def test_a_decision_job_broken_off_ends_with_the_same_tables(spark, tmp_path, monkeypatch):
    rows = [(envelope(i), T0 + timedelta(minutes=i)) for i in range(12)] + [("{broken", T0)]
    failed = F.col("attempt") < F.substring("payment_id", 5, 3).cast("int") % 5
    as_files(spark, tmp_path, spark.createDataFrame(rows, "raw string, received_at timestamp_ntz"), 1)

    def run(label):
        out = jobs.decision_stream(io.file_events(spark, str(tmp_path), "calls", 1), label=label, failed=failed)
        return [sorted(map(str, t.select(sorted(t.columns)).collect())) for t in out]

    want = run(str(tmp_path / "whole"))
    assert len(want[0]) == 10 and len(want[1]) == 3 and want[2] and run(str(tmp_path / "whole")) == want
    job = str(tmp_path / "broken")
    write, calls_made = stores.BatchTable.write, [0]
    for stop in (2, 4, 9, 14):

        def limited(self, *args, **kwargs):
            calls_made[0] += 1
            if calls_made[0] > stop:
                raise RuntimeError("stopped")
            return write(self, *args, **kwargs)

        calls_made[0] = 0
        monkeypatch.setattr(stores.BatchTable, "write", limited)
        with pytest.raises(Exception, match="stopped"):
            run(job)
        monkeypatch.setattr(stores.BatchTable, "write", write)
    assert run(job) == want


def test_a_replayed_batch_counts_once(spark):
    table = stores.BatchTable(spark, "replay")
    table.write(spark.range(5), 0)
    table.write(spark.range(3), 1)
    table.write(spark.range(3), 1)
    assert table.read().count() == 8 and table.read(up_to=1).count() == 5 and table.last_before(1).count() == 5


def test_builtin_deduplication_runs(spark, calls, tmp_path):
    stream = as_files(spark, tmp_path, calls.select("key", "at"), 1)
    out = io.run_to_parquet(jobs.recent_only(stream, "key", "at", "30 days"), "recent")
    assert out.count() == 7
