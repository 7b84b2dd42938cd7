from datetime import datetime, timedelta
import random
import statistics

import pytest
from pyspark.sql import functions as F

from paymend.operators import health, locks, review, timeseries
from paymend.sources import envelope, tables

T0 = datetime(2024, 1, 1)


def test_upsert_first_identity_last_failure(spark):
    snapshot = spark.createDataFrame(
        [("p1", "o1", 100, "RECOVERING", "A", "old", 1)],
        "payment_id string, order_id string, amount_paise long, status string, failure_code string, failure_reason string, recovery_attempts int",
    )
    batch = spark.createDataFrame(
        [("p1", "oX", 999, "B", "new", 5), ("p1", "oY", 998, "C", None, 9), ("p2", "o2", 50, "D", "x", 3), ("p2", "o3", 60, "E", "y", 4)],
        "payment_id string, order_id string, amount_paise long, failure_code string, failure_reason string, event_time int",
    )
    got = {r.payment_id: r for r in tables.upsert_transactions(snapshot, batch).collect()}
    assert tuple(got["p1"])[1:] == ("o1", 100, "RECOVERING", "C", None, 1)
    assert tuple(got["p2"])[1:] == ("o2", 50, "FAILED", "E", "y", 0)
    # The same batch again changes nothing.
    again = tables.upsert_transactions(spark.createDataFrame(list(got.values()), snapshot.schema), batch)
    assert again.exceptAll(spark.createDataFrame(list(got.values()), snapshot.schema)).count() == 0


def test_insert_or_ignore_and_partial_update(spark):
    stored = spark.createDataFrame([("a",)], "k string")
    rows = spark.createDataFrame([("a", 1), ("b", 3), ("b", 2)], "k string, n int")
    assert [tuple(r) for r in tables.insert_or_ignore(stored, rows, "k", F.col("n")).collect()] == [("b", 2)]
    snapshot = spark.createDataFrame([("a", "X", "C", 0.5), ("b", "X", "C", 0.5)], "payment_id string, status string, failure_category string, score double")
    updates = spark.createDataFrame([("a", "Y", None, 0.7)], snapshot.schema)
    got = {r.payment_id: tuple(r)[1:] for r in tables.partial_update(snapshot, updates).collect()}
    assert got == {"a": ("Y", "C", 0.7), "b": ("X", "C", 0.5)}


def test_tenants_are_apart_and_no_tenant_sees_nothing(spark):
    df = spark.createDataFrame([("alpha", 1), ("beta", 2)], "merchant_id string, id int")
    one, two = tables.tenant_view(df, "alpha"), tables.tenant_view(df, "beta")
    assert one.intersect(two).count() == 0 and one.count() == two.count() == 1
    assert tables.tenant_view(df, None).count() == 0 == tables.tenant_view(df, "").count()


def test_monthly_layout_prunes_partitions(spark, tmp_path):
    df = spark.createDataFrame([(i, T0 + timedelta(days=i)) for i in range(90)], "id int, created_at timestamp_ntz")
    path = str(tmp_path / "txn")
    tables.write_monthly(df, path)
    back = spark.read.parquet(path).filter(F.col("created_month") == "2024-02")
    assert back.count() == 29
    assert "PartitionFilters: [isnotnull(created_month" in back._jdf.queryExecution().executedPlan().toString()


def test_envelopes(spark):
    good = '{"event":"payment.failed","extra":1,"payload":{"payment":{"entity":{"id":"p","order_id":"o","amount":5,"currency":"inr","error_description":"","error_reason":"why","card":{"last4":"1"}}}}}'
    cases = {
        good: ("accepted", None),
        good.replace('"entity"', '"other"'): ("accepted", None),
        good.replace("payment.failed", "payment.captured"): ("ignored", None),
        good.replace('"amount":5', '"amount":0'): ("rejected", "amount not positive"),
        good.replace('"id":"p"', '"id":""'): ("rejected", "no id"),
        good[:50]: ("rejected", "malformed"),
        "": ("rejected", "malformed"),
        "[]": ("rejected", "malformed"),
        '{"event":"payment.failed"}': ("rejected", "no payment"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    got = {r.raw: r for r in envelope.parse_events(df).collect()}
    for raw, want in cases.items():
        assert (got[raw].outcome, got[raw].reject_reason) == want, raw
    row = got[good]
    assert (row.payment_id, row.amount_paise, row.currency, row.failure_reason) == ("p", 5, "INR", "why")


def walk_first_seen(rows, ttl):
    kept, last = [], {}
    for key, at, event in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or (at - last[key]).total_seconds() >= ttl:
            last[key] = at
            kept.append((key, at, event))
    return sorted(kept)


@pytest.mark.parametrize("cells", [1024, 3])
def test_first_seen_equals_a_walk_for_normal_and_hot_keys(spark, monkeypatch, cells):
    monkeypatch.setattr(locks, "CELLS", cells)
    rng = random.Random(11)
    rows = [("hot", T0 + timedelta(seconds=rng.randint(0, 20000)), i) for i in range(300)]
    rows += [(f"k{i % 40}", T0 + timedelta(seconds=rng.randint(0, 20000)), 1000 + i) for i in range(120)]
    rows += [("edge", T0, 5000), ("edge", T0 + timedelta(seconds=3599), 5001), ("edge", T0 + timedelta(seconds=3600), 5002)]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, e int")
    out = locks.first_seen(df, "k", "at", "e", ttl_seconds=3600)
    assert sorted(tuple(r) for r in out.collect()) == walk_first_seen(rows, 3600)


@pytest.mark.parametrize("ttl", [86400, 3600, 17])
def test_one_key_with_200_000_events(spark, ttl):
    df = spark.range(200_000).selectExpr("cast(null as string) AS k", "timestamp_micros(1700000000000000 + (id * id * 7919) % 8000000000000) AS at", "id AS e")
    got = [r[0] for r in locks.first_seen(df, "k", "at", "e", ttl).select(F.unix_micros(F.col("at").cast("timestamp"))).collect()]
    want = []
    for t in sorted({r[0] for r in df.select(F.unix_micros("at")).collect()}):
        if not want or t >= want[-1] + ttl * 1_000_000:
            want.append(t)
    assert sorted(got) == want


def test_first_seen_of_nothing_and_of_rows_without_time(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", T0, 3), ("a", T0, 2), (None, T0, 4), ("b", datetime(1901, 5, 1), 5)], "k string, at timestamp_ntz, e int")
    assert sorted(r.e for r in locks.first_seen(df, "k", "at", "e").collect()) == [2, 4, 5]
    assert locks.first_seen(df.limit(0), "k", "at", "e").count() == 0


def test_gaps_of_years_are_filled_bin_by_bin(spark):
    late = T0 + timedelta(days=900, minutes=7)
    rows = [("far", T0 + timedelta(minutes=3), 5), ("far", late, None), ("far", late, 2), ("far", None, 9)]
    rows += [("edge", T0 + timedelta(days=d), 1) for d in (0, 288, 576)] + [("one", T0, 4)]
    bins = timeseries.resample(spark.createDataFrame(rows, "merchant_id string, created_at timestamp_ntz, amount_paise long"))
    got = {r.merchant_id: r for r in bins.groupBy("merchant_id").agg(
        F.count("*").alias("n"), F.countDistinct("bin").alias("bins"), F.max("position").alias("last"), F.max(F.col("bin") - F.col("position") * 300).alias("start"),
        F.min(F.col("bin") - F.col("position") * 300).alias("same"), F.sum("failures").alias("failures"), F.sum("amount_paise").alias("amount"),
    ).collect()}
    want = {"far": (900 * 288 + 2, 3, 7), "edge": (576 * 288 + 1, 3, 3), "one": (1, 1, 4)}
    for key, (n, failures, amount) in want.items():
        r = got[key]
        assert (r.n, r.bins, r.last, r.failures, r.amount) == (n, n, n - 1, failures, amount) and r.start == r.same
    assert bins.where("failures > 0").count() == 6


def test_rolling_score_across_days_equals_plain_frames(spark):
    rng = random.Random(4)
    rows = [("m", T0 + timedelta(minutes=5 * i, seconds=j), 10) for i in range(700) for j in range(rng.choice([0, 1, 1, 2, 9]))]
    bins = timeseries.resample(spark.createDataFrame(rows, "merchant_id string, created_at timestamp_ntz, amount_paise long"))
    counts = [r.failures for r in bins.orderBy("bin").collect()]
    assert sum(counts) == len(rows) and 0 in counts
    got = [(r.failure_zscore, r.threshold_anomaly) for r in timeseries.rolling_z(bins).orderBy("bin_start").collect()]
    assert len(got) == len(counts) and got[0] == (None, False)
    for i in range(1, len(counts)):
        frame = counts[max(0, i - 5): i + 1]
        std = statistics.stdev(frame) or 1
        assert got[i][0] == pytest.approx((counts[i] - statistics.mean(frame)) / std, abs=2e-6)
    ahead = [r.predicted_failures for r in timeseries.forecast(bins).collect()]
    assert len(ahead) == 12 and set(ahead) == {round(sum(counts[-6:]) / 6, 6)}


def walk_health(calls):
    fails, last, out = 0, None, []
    for at, ok in calls:
        if fails < 3:
            before = "CLOSED"
        else:
            before = "HALF_OPEN" if (at - last).total_seconds() >= 60 else "OPEN"
        fails = 0 if ok else fails + 1
        out.append((before, "OPEN" if fails >= 3 else "CLOSED"))
        last = at
    return out


@pytest.mark.parametrize("per_block", [1, 7, 10_000])
def test_provider_health_equals_a_walk(spark, per_block):
    rng = random.Random(9)
    at, calls = T0, []
    for i in range(400):
        at += timedelta(seconds=rng.choice([1, 5, 59, 60, 90]))
        calls.append((at, rng.random() < 0.3))
    df = spark.createDataFrame([("sms", i, a, ok) for i, (a, ok) in enumerate(calls)], "channel string, call_id long, at timestamp_ntz, ok boolean")
    out = health.provider_health(df, block=F.floor(F.col("call_id") / per_block)).orderBy("call_id").collect()
    assert [(r.state_before, r.state_after) for r in out] == walk_health(calls)
    head = health.provider_health(df.filter("call_id < 150"))
    tail = health.provider_health(df.filter("call_id >= 150"), carry=health.carry_of(head))
    parts = head.unionByName(tail).orderBy("call_id").collect()
    assert [(r.state_before, r.state_after) for r in parts] == walk_health(calls)


def test_open_half_open_closed(spark):
    steps = [(0, False), (1, False), (2, False), (10, False), (80, True), (81, True)]
    df = spark.createDataFrame([("sms", i, T0 + timedelta(seconds=s), ok) for i, (s, ok) in enumerate(steps)], "channel string, call_id long, at timestamp_ntz, ok boolean")
    got = [(r.state_before, r.state_after) for r in health.provider_health(df).orderBy("call_id").collect()]
    assert got == [("CLOSED", "CLOSED"), ("CLOSED", "CLOSED"), ("CLOSED", "OPEN"), ("OPEN", "OPEN"), ("HALF_OPEN", "CLOSED"), ("CLOSED", "CLOSED")]


def test_review_decisions(spark):
    queue = spark.createDataFrame([("h1", "p1", None), ("h2", "p2", "APPROVED"), ("h3", "p3", None)], "hitl_id string, transaction_id string, decision string")
    made = spark.createDataFrame(
        [("h1", "APPROVED", "a", 2), ("h1", "REJECTED", "b", 1), ("h2", "REJECTED", "a", 1), ("h3", "MODIFIED", "a", 1), ("h9", "APPROVED", "a", 1)],
        "hitl_id string, decision string, decided_by string, decided_at int",
    )
    out = review.apply_decisions(queue, made)
    got = {(r.hitl_id, r.decided_by): (r.result, r.new_status, r.audit_action) for r in out.collect()}
    assert got == {
        ("h1", "a"): ("conflict", None, None), ("h1", "b"): ("applied", None, None), ("h2", "a"): ("conflict", None, None),
        ("h3", "a"): ("applied", "RECOVERING", "HITL_RESOLVED"), ("h9", "a"): ("not found", None, None),
    }
    left = {r.hitl_id: r.decision for r in review.resolve_queue(queue, out).collect()}
    assert left == {"h1": "REJECTED", "h2": "APPROVED", "h3": "MODIFIED"}
