import math
import random

import pytest
from pyspark.sql import functions as F

from paymend.operators import anomaly, drift, experiments, models, ranks
from paymend.operators.reports import modal_cause


def two_samples(spark, ref, live):
    rows = [(float(v), False) for v in ref] + [(float(v), True) for v in live]
    return spark.createDataFrame(rows, "v double, live boolean")


def test_ks_and_psi_golden(spark):
    shifted = two_samples(spark, range(100), range(50, 150))
    row = drift.ks_two_sample(shifted, [], "v", F.col("live")).first()
    assert row.ks_stat == pytest.approx(0.5) and row.ks_pval == pytest.approx(1.055e-11, rel=1e-3)
    scaled = two_samples(spark, range(100), [10 * i for i in range(100)])
    assert drift.psi(scaled, [], "v", F.col("live")).first().psi == 11.4578
    same = two_samples(spark, range(100), range(100))
    assert drift.psi(same, [], "v", F.col("live")).first().psi == 0.0
    small = two_samples(spark, range(5), range(100))
    row = drift.ks_two_sample(small, [], "v", F.col("live")).first()
    assert (row.ks_stat, row.ks_pval) == (0.0, 1.0)
    flat = two_samples(spark, [1] * 20, [1] * 20)
    assert drift.psi(flat, [], "v", F.col("live")).first().psi == 0.0


def test_ks_equals_brute_force_with_negative_and_repeated_values(spark):
    rng = random.Random(5)
    ref = [round(rng.gauss(0, 3), 1) for _ in range(400)]
    live = [round(rng.gauss(0.5, 3), 1) for _ in range(300)]
    want = max(abs(sum(x <= v for x in ref) / 400 - sum(x <= v for x in live) / 300) for v in ref + live)
    got = drift.ks_two_sample(two_samples(spark, ref, live), [], "v", F.col("live")).first().ks_stat
    assert got == pytest.approx(want, abs=1e-12)


def test_nearest_rank_and_running_index(spark):
    rng = random.Random(3)
    values = [round(rng.expovariate(0.05), 2) for _ in range(997)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7.5)], "k string, v double")
    got = {r.k: r for r in ranks.nearest_rank(df, ["k"], "v", (50, 95, 99)).collect()}
    ordered = sorted(values)
    for p in (50, 95, 99):
        assert got["a"][f"p{p}"] == ordered[math.ceil(p / 100 * 997) - 1]
        assert got["b"][f"p{p}"] == 7.5
    placed = ranks.running_index(df.withColumn("o", F.monotonically_increasing_id()).filter("k = 'a'"), ["k"], "v", F.floor("v"))
    assert sorted(r.position for r in placed.collect()) == list(range(1, 998))


def test_crowded_values_are_cut_into_blocks_of_bounded_size(spark):
    many = 1_000_000
    # All within one per cent, in an order that has nothing to do with their size.
    df = spark.range(many).select((100 + F.pmod(F.col("id") * 7919, F.lit(many)) / many).alias("v"))
    cells = ranks.finer(df, [], "v", "cell").groupBy("cell").count()
    low, high, n = cells.agg(F.min("count"), F.max("count"), F.count("*")).first()
    assert high <= ranks.FULL and high <= 2 * many / n
    got = ranks.nearest_rank(df, [], "v", (1, 50, 99)).first()
    assert [round((got[f"p{p}"] - 100) * many) + 1 for p in (1, 50, 99)] == [many // 100 * p for p in (1, 50, 99)]
    # Times in microseconds: a busy second, a quiet year, a hot key beside small ones and an id that is null.
    times = spark.range(300_000).select(
        F.when(F.col("id") % 1000 == 0, "small").otherwise("hot").alias("k"),
        (1_700_000_000_000_000 + F.col("id") + F.when(F.col("id") >= 150_000, 31_536_000_000_000).otherwise(0)).alias("o"),
    )
    sizes = ranks.ordered_blocks(times, ["k"], "o").groupBy("k", "_block").count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * ranks.FULL and sizes.count() < 40
    placed = ranks.running_index(times, ["k"], "o")
    number = F.col("o") - 1_700_000_000_000_000 - F.when(F.col("o") > 1_710_000_000_000_000, 31_536_000_000_000).otherwise(0)
    small = F.floor(number / 1000) + 1
    want = F.when(F.col("k") == "small", small).otherwise(number + 1 - small)
    assert placed.count() == 300_000 and placed.filter(F.col("position") != want).count() == 0


def test_reference_sketch_is_read_once_per_version(spark, tmp_path):
    rows = spark.range(1500).select(
        F.concat(F.lit("g"), (F.col("id") % 2).cast("string")).alias("k"), F.col("id").alias("o"),
        (F.col("id") % 7).cast("int").alias("c"), F.when(F.col("id") % 50 != 0, F.pmod(F.col("id") * 37, F.lit(211)) * 1.5).alias("a"),
    )
    sample = rows.filter("o < 700")
    folder = str(tmp_path / "v1")
    sketch = drift.reference_sketch(sample, "k", "c", "a", folder)
    other = sample.withColumn("a", F.col("a") * 9)
    # The stored version counts, whatever sample is at hand.
    again = drift.reference_sketch(other, "k", "c", "a", folder)
    args = ("k", "o", "c", "a", 100, 40)
    want = sorted(drift.monitor(rows, sample, *args).collect())
    assert len(want) == 2 * (750 // 40)
    assert sorted(drift.monitor(rows, sketch, *args).collect()) == want == sorted(drift.monitor(rows, again, *args).collect())
    assert sorted(drift.monitor(rows, other, *args).collect()) != want


def test_z_test_golden(spark):
    rows = [("control", int(i < 310), 100) for i in range(1000)] + [("variant", int(i < 510), 100) for i in range(1000)]
    df = spark.createDataFrame(rows, "arm string, recovered int, amount_paise long")
    row = experiments.z_test(experiments.two_arms(df)).first()
    assert row.z_score == 9.0928 and row.sig_95 and row.sig_99
    few = experiments.z_test(experiments.two_arms(df.limit(5))).first()
    assert few.z_score == 0.0 and not few.sig_95


def test_posteriors(spark):
    rows = [("control", "c", 0.8)] * 10 + [("stranger", "c", 1.0)] * 3
    df = spark.createDataFrame(rows, "arm string, context string, reward double")
    found = experiments.posteriors(df).collect()
    assert len(found) == 1
    assert (round(found[0].alpha, 9), round(found[0].beta, 9), found[0].pulls, round(found[0]["mean"], 9)) == (9.0, 3.0, 10, 0.75)
    half = experiments.posteriors(df.limit(4))
    rest = experiments.posteriors(spark.createDataFrame(rows[4:], df.schema))
    merged = experiments.merge_posteriors(half, rest).first()
    assert (round(merged.alpha, 9), merged.pulls) == (9.0, 10)


def test_thompson_prefers_the_better_arm_and_repeats(spark):
    rows = [("variant", "c", 1.0)] * 50 + [("control", "c", 0.0)] * 5
    post = experiments.posteriors(spark.createDataFrame(rows, "arm string, context string, reward double"))
    asked = spark.range(100).select(F.concat(F.lit("p"), "id").alias("payment_id"), F.lit("c").alias("context"))
    first = {r.payment_id: r.chosen_arm for r in experiments.choose_arm(asked, post).collect()}
    again = {r.payment_id: r.chosen_arm for r in experiments.choose_arm(asked.repartition(7), post).collect()}
    assert first == again and sum(v == "variant" for v in first.values()) > 60
    unseen = experiments.choose_arm(asked.withColumn("context", F.lit("new")), post, mode="ucb")
    assert {r.chosen_arm for r in unseen.collect()} == {"control"}


def test_beta_draw_has_the_right_mean_and_spread(spark):
    draws = [
        r[0]
        for a, b in ((3.0, 5.0), (0.5, 0.5))
        for r in spark.range(4000).select(
            experiments.beta_draw(F.col("id").cast("string"), F.lit(a), F.lit(b))
        ).collect()
    ]
    for part, a, b in ((draws[:4000], 3, 5), (draws[4000:], 0.5, 0.5)):
        mean = sum(part) / 4000
        var = sum((x - mean) ** 2 for x in part) / 4000
        assert mean == pytest.approx(a / (a + b), abs=0.02)
        assert var == pytest.approx(a * b / ((a + b) ** 2 * (a + b + 1)), rel=0.1)


def test_modal_cause_breaks_ties_by_name(spark):
    df = spark.createDataFrame(
        [("m", "B", None), ("m", "A", None), ("n", None, "X"), ("n", "", "X"), ("o", None, None)],
        "merchant_id string, failure_category string, failure_code string",
    )
    got = {r.merchant_id: (r.root_cause, r.n) for r in modal_cause(df, "merchant_id").collect()}
    assert got == {"m": ("A", 1), "n": ("X", 2), "o": ("UNKNOWN", 1)}


def test_isolation_forest_finds_the_outliers(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(10, 1), rng.gauss(100, 5)) for i in range(600)] + [(900, 60.0, 400.0), (901, -30.0, 10.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    out = anomaly.isolation_flags(df.drop("id"), ["a", "b"], trees=40)
    scores = sorted(((r.isolation_score, r.a) for r in out.collect()), reverse=True)
    assert {scores[0][1], scores[1][1]} == {60.0, -30.0}
    assert scores[0][0] > 0.6
    # A row that is repeated without end makes no tree larger than its sample.
    same = spark.range(30_000).selectExpr("if(id % 3 = 0, 1.0D, id * 0.001D) as a", "if(id % 3 = 0, 2.0D, (id % 97) * 1.0D) as b")
    scored = anomaly.isolation_flags(same, ["a", "b"], trees=10, sample=64)
    assert scored.where("isolation_score between 0 and 1").count() == 30_000
    few = anomaly.isolation_flags(df.limit(7), ["a", "b"])
    assert not any(r.isolation_anomaly for r in few.collect())


def test_models_learn_and_survive_bad_rows(spark):
    rng = random.Random(2)
    rows = []
    for i in range(1500):
        code = i % 7
        y = int(rng.random() < (0.9 if code < 3 else 0.1))
        rows.append((f"p{i}", float(rng.randint(500, 15000)), code, i % 24, i % 3, y))
    df = spark.createDataFrame(
        rows, "payment_id string, amount_rupees double, code_index int, hour_of_day int, retry_count int, label int"
    )
    model, brier, ok = models.train(df, "payment_id", "boosted", trees=10)
    assert ok and brier < 0.2
    broken = df.limit(3).withColumn("amount_rupees", F.lit(None).cast("double"))
    assert [r.score for r in models.score(model, broken).collect()] == [0.5] * 3
    registry = models.publish(spark, model)
    a = models.score(model, df).agg(F.sum("score")).first()[0]
    b = models.score(models.current(spark, registry), df).agg(F.sum("score")).first()[0]
    assert a == pytest.approx(b)


def test_retrain_only_on_drift(spark):
    df = spark.range(600).select(
        F.concat(F.lit("p"), "id").alias("payment_id"), (F.col("id") * 10.0).alias("amount_rupees"),
        (F.col("id") % 7).cast("int").alias("code_index"), (F.col("id") % 24).cast("int").alias("hour_of_day"),
        (F.col("id") % 3).cast("int").alias("retry_count"), (F.col("id") % 7 < 3).cast("int").alias("label"),
    )
    assert models.retrain_on_drift(df, df, "payment_id", kind="logistic")["drift"] is False
    moved = df.withColumn("amount_rupees", F.col("amount_rupees") * 100)
    result = models.retrain_on_drift(df, moved, "payment_id", kind="logistic")
    assert result["drift"] and result["accepted"] and result["reference"] is moved


def test_registry_keeps_model_score_and_reference_together(spark, tmp_path):
    df = spark.range(600).select(
        F.concat(F.lit("p"), "id").alias("payment_id"), (F.col("id") * 10.0).alias("amount_rupees"),
        (F.col("id") % 7).cast("int").alias("code_index"), (F.col("id") % 24).cast("int").alias("hour_of_day"),
        (F.col("id") % 3).cast("int").alias("retry_count"), (F.col("id") % 7 < 3).cast("int").alias("label"),
    )
    moved = df.withColumn("amount_rupees", F.col("amount_rupees") * 100)
    again = moved.withColumn("amount_rupees", F.col("amount_rupees") * 100)
    registry = str(tmp_path / "registry")
    model, value, _ = models.train(df, "payment_id", "logistic")
    models.publish(spark, model, registry, value, df)
    scores = {}
    for version, live in ((2, moved), (3, again)):
        result = models.retrain_on_drift(None, live, "payment_id", registry, "logistic")
        assert result["drift"] and result["accepted"]
        _, held = models.split(live, "payment_id")
        stored = str(tmp_path / f"scores-{version}")
        models.score(models.current(spark, registry), held).write.parquet(stored)
        scores[version] = spark.sql(f"SELECT avg(pow(score - label, 2)) FROM parquet.`{stored}`").first()[0]
        assert models.retrain_on_drift(None, live, "payment_id", registry, "logistic")["drift"] is False
    found = {r.step: r for r in models.history(spark, registry).collect()}
    assert [(found[i].version, found[i].reference_rows, found[i].in_use) for i in (1, 2, 3)] == [(1, 600, False), (2, 600, False), (3, 600, True)]
    for version, value in scores.items():
        assert found[version].brier == pytest.approx(value, abs=1e-9)
    models.rollback(spark, registry)
    assert models.current_reference(spark, registry).exceptAll(moved).count() == 0
    models.rollback(spark, registry)
    assert models.current_reference(spark, registry).exceptAll(df).count() == 0
    with pytest.raises(LookupError):
        models.rollback(spark, registry)
    assert [r.version for r in models.history(spark, registry).orderBy("step").collect()] == [1, 2, 3, 2, 1]
    # A publisher that died before its pointer changes nothing.
    model.write().save(f"{registry}/versions/half/model")
    assert [r.in_use for r in models.history(spark, registry).orderBy("step").collect()] == [False] * 4 + [True]
