import math
import re

import pytest
from pyspark.sql import functions as F

from paymend.functions.messages import template_rows
from paymend.operators import retrieval


def vectors(texts):
    split = {k: re.findall("[a-z₹0-9]+", t.lower()) for k, t in texts.items()}
    df = {}
    for words in split.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log((len(texts) + 1) / (n + 1)) + 1 for w, n in df.items()}
    return idf, {k: unit(words, idf) for k, words in split.items()}


def unit(words, idf):
    raw = {w: words.count(w) / len(words) * idf[w] for w in set(words) if w in idf}
    norm = math.sqrt(sum(v * v for v in raw.values())) or 1.0
    return {w: v / norm for w, v in raw.items()}


def test_library_is_complete():
    rows = template_rows()
    assert len(rows) == 42 and len({r[0] for r in rows}) == 42 == len({r[7] for r in rows})
    assert [r[1] for r in rows] == list(range(42))


def test_weights(spark):
    texts = {1: "Pay now, pay later!", 2: "later ₹500", 3: "pay ₹500 now"}
    _, want = vectors(texts)
    got = retrieval.term_weights(spark.createDataFrame(list(texts.items()), "id int, text string"), "id", "text").collect()
    assert len(got) == sum(len(v) for v in want.values())
    for r in got:
        assert r.weight == pytest.approx(want[r.id][r.token])


def test_ranking_equals_brute_force(spark):
    rows = template_rows()
    idf, weights = vectors({r[0]: r[7] for r in rows})
    asked = [
        ("GATEWAY_DOWN", 50_000, "whatsapp", "gateway was down"), ("BANK_DECLINE", 5_000_000, "sms", None),
        ("UNKNOWN", 0, "email", "xyzzy"), ("INSUFFICIENT_FUNDS", 999_900, "email", "balance too low"),
    ]
    df = spark.createDataFrame([(f"p{i}", *a) for i, a in enumerate(asked)], "payment_id string, failure_category string, amount_paise long, channel string, reason string")
    df = df.withColumn("q", retrieval.query_text(F.col("failure_category"), F.col("amount_paise"), F.col("channel"), F.col("reason")))
    for r in retrieval.rank_templates(df, retrieval.template_library(spark), "q").collect():
        q = unit(re.findall("[a-z₹0-9]+", r.q.lower()), idf)
        band = "small" if r.amount_paise < 100_000 else "medium" if r.amount_paise < 1_000_000 else "large"
        scores = []
        for t in rows:
            cosine = sum(v * weights[t[0]].get(w, 0) for w, v in q.items())
            bonus = 0.15 * (t[2] == r.failure_category) + 0.10 * (t[4] == band) + 0.05 * (t[3] == r.channel)
            scores.append((-round(cosine + bonus, 9), t[1], t[0]))
        assert [h.template_id for h in r.hits] == [s[2] for s in sorted(scores)[:3]]


def test_a_large_template_library_is_ranked_in_blocks(spark, monkeypatch):
    asked = spark.range(40).select(
        F.concat(F.lit("p"), "id").alias("payment_id"), F.lit("BANK_DECLINE").alias("failure_category"),
        (F.col("id") * 90_000).alias("amount_paise"), F.lit("sms").alias("channel"),
        F.concat(F.lit("word"), F.col("id") * 49, F.lit(" kind"), F.col("id") % 7).alias("q"),
    )
    big = spark.range(2000).select(
        F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("template_id"), F.col("id").cast("int").alias("rank"),
        F.when(F.col("id") % 3 == 0, "BANK_DECLINE").otherwise("UNKNOWN").alias("category"), F.lit("sms").alias("channel"),
        F.lit("small").alias("amount_band"), F.lit("x").alias("outcome"), F.lit(0.1).alias("recovery_rate"),
        F.concat(F.lit("kind"), F.col("id") % 7, F.lit(" word"), "id").alias("text"),
    )
    shape = lambda: sorted((r.payment_id, tuple(r.hits), r.best_text) for r in retrieval.rank_templates(asked, big, "q").collect())
    blocks = shape()
    assert all(h[1][0].template_id == f"t{int(h[0][1:]) * 49:05d}" for h in blocks)
    monkeypatch.setattr(retrieval, "BLOCK", 5000)
    assert shape() == blocks


def test_given_draft_is_kept_and_amount_sign_is_not_doubled(spark):
    df = spark.createDataFrame(
        [("p1", "GATEWAY_DOWN", 123_450, "email", "down", 1.0, None), ("p2", "GATEWAY_DOWN", 100, "email", None, 1.0, "ready text")],
        "payment_id string, failure_category string, amount_paise long, channel string, failure_reason string, latency_ms double, draft string",
    ).withColumn("created_at", F.current_timestamp())
    got = {r.payment_id: r for r in retrieval.personalise(df, retrieval.template_library(spark), drafted="draft").collect()}
    assert "1234 rupees" in got["p1"].drafted_message and not got["p1"].llm_used
    assert got["p2"].drafted_message == "ready text" and got["p2"].llm_used
    audit = retrieval.dispatch_audit(retrieval.personalise(df, retrieval.template_library(spark)))
    assert {r.action_taken for r in audit.collect()} == {"RAG_PERSONALIZED"}


def test_dense_neighbours(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0), (3, [0.0, 2.0], 1)], "vec_id int, embedding array<double>, label int")
    out = retrieval.dense_top_k(df, retrieval.centroids(df), "vec_id", top_k=1).collect()
    assert sorted((r.vec_id, r.hits[0].label) for r in out) == [(1, 0), (2, 0), (3, 1)]


def test_a_large_vector_library_is_searched_in_parts(spark, monkeypatch):
    df = spark.range(40).select("id", F.array(F.cos("id"), F.sin("id")).alias("embedding"), F.col("id").alias("label"))
    library = retrieval.centroids(df)
    whole = retrieval.dense_top_k(df, library, "id").collect()
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    monkeypatch.setattr(retrieval, "PACK", 3)
    assert sorted(retrieval.dense_top_k(df, library, "id").collect()) == sorted(whole) and len(whole) == 40


def test_keyword_hits(spark):
    df = spark.createDataFrame([("a", "card declined", 1), ("b", "card", 2), ("c", "none", 3)], "id string, note string, at int")
    assert [r.id for r in retrieval.keyword_hits(df, "declined card?", "at", "id").collect()] == ["a", "b"]
    assert [r.id for r in retrieval.keyword_hits(df, "?", "at", "id").collect()] == ["c", "b", "a"]
    assert retrieval.question_terms("Is it the Card, card?") == ["card", "the"]
