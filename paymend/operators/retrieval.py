"""Text and vector retrieval: TF-IDF weights, template ranking, keyword hits, dense top-k."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from paymend.functions.classify import amount_band
from paymend.functions.messages import fill, template_rows, whole_rupees
from paymend.sources.scratch import materialise

TOKEN = "[a-z₹0-9]+"
BOOSTS = (0.15, 0.10, 0.05)  # category, amount band, channel
TOP_K = 3
MIN_SIMILARITY = 0.0
#: Library entries of a block, rows of a pack, and copies of a block that share its packs.
BLOCK, PACK, SIDES = 500, 1024, 16
#: Tokens that a task counts at once; the words of one document count together in any case.
GATHER = 1_000_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def term_counts(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc, token, tf`` for every distinct token of every document, counted in the tasks that read it: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.list_value_length(batch.column("t")).fill_null(0))
            ends, start = np.cumsum(sizes), 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + GATHER, side="right")))
                part = batch.slice(start, stop - start)
                start = stop
                words = pc.list_flatten(part.column("t")).dictionary_encode()
                if not len(words):
                    continue
                kinds = len(words.dictionary)
                cell, n = np.unique(np.asarray(pc.list_parent_indices(part.column("t"))).astype(np.int64) * kinds + np.asarray(words.indices), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(doc).take(pa.array(cell // kinds)), words.dictionary.take(pa.array(cell % kinds)), pa.array(n, pa.int64())], [doc, "token", "tf"]
                )

    split = docs.select(doc, tokens(F.col(text)).alias("t"))
    return split.mapInArrow(run, f"`{doc}` {dict(split.dtypes)[doc]}, token string, tf bigint")


def term_weights(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Sparse TF-IDF rows ``doc, token, idf, weight``; every document has length 1.

    Texts are read and split once: the counts are stored, and both the document
    frequencies and the weights come from them. The planner joins the two by
    their sizes; a word found in a third of the documents makes a skewed
    partition that is split at run time. The number of words of a document
    scales all its weights alike, so it cancels.
    """
    counts = materialise(term_counts(docs, doc, text), "terms")
    size = docs.agg(F.count(F.lit(1))).scalar()
    frequency = counts.groupBy("token").agg(F.count(F.lit(1)).alias("_df"))
    raw = counts.join(frequency, "token").withColumn("idf", F.log((size + 1) / (F.col("_df") + 1)) + 1.0)
    raw = raw.withColumn("_w", F.col("tf") * F.col("idf"))
    # One window partition is one document, which already fitted into one row.
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(doc)))
    return raw.withColumn("_norm", norm).select(doc, "token", "idf", (F.col("_w") / F.col("_norm")).alias("weight"))


def template_library(spark: SparkSession) -> DataFrame:
    """The message templates as a table."""
    return spark.createDataFrame(
        template_rows(),
        "template_id string, rank int, category string, channel string, amount_band string, "
        "outcome string, recovery_rate double, text string",
    )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in packs of ``PACK``, each one binary value."""
    for batch in batches:
        for start in range(0, batch.num_rows, PACK):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch.slice(start, PACK))
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["_pack"])


def _grid(rows: DataFrame, library: DataFrame, name: str, score: Callable[[pa.Table, pa.StructArray], list[pa.RecordBatch]], schema: str) -> DataFrame:
    """``score`` of every pack of rows against every block of library entries, in cells of a grid.

    ``library`` is cut into blocks of some ``BLOCK`` entries by a hash of ``name``, and rows into packs. A
    cell joins one pack with one block, so neither side is held or collected whole; the planner
    sends a small library to the packs, or else deals cells by block and side.
    """
    count = F.greatest(F.lit(1), F.ceil(library.agg(F.count(F.lit(1))).scalar() / BLOCK)).cast("int")
    block = F.pmod(F.xxhash64(name), count).cast("int").alias("_block")
    blocks = library.select(block, F.struct("*").alias("_entry")).groupBy("_block").agg(F.collect_list("_entry").alias("_entries"))
    blocks = blocks.withColumn("_side", F.explode(F.sequence(F.lit(0), F.lit(SIDES - 1))))
    packs = rows.mapInArrow(_pack, "_pack binary")
    cells = packs.withColumns({"_side": F.pmod(F.xxhash64("_pack"), F.lit(SIDES)).cast("int"), "_block": F.explode(F.sequence(F.lit(0), count - 1))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pack = pa.ipc.open_stream(batch.column("_pack")[i].as_py()).read_all()
                yield from score(pack, batch.column("_entries")[i].values)

    return cells.join(blocks, ["_block", "_side"]).select("_pack", "_entries").mapInArrow(run, schema)


def _best(hits: DataFrame, key: str, top_k: int) -> DataFrame:
    """``key, hits``: the first ``top_k`` of the hits of all blocks, in the order of their fields."""
    return hits.groupBy(key).agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, top_k).alias("hits"))


def query_text(category: Column, amount_paise: Column, channel: Column, reason: Column) -> Column:
    """What is known about a failed payment, as a search text."""
    return F.concat_ws(
        " ",
        F.lit("failed payment recovery"),
        F.replace(F.lower(category), F.lit("_"), F.lit(" ")),
        F.lit("amount"),
        whole_rupees(amount_paise),
        F.lit("rupees"),
        channel,
        F.coalesce(reason, F.lit("")),
    )


def _score_templates(top_k: int):
    kind = pa.list_(pa.struct([("order", pa.float64()), ("rank", pa.int32()), ("template_id", pa.string()), ("cosine", pa.float64()), ("score", pa.float64())]))

    def run(asked: pa.Table, block: pa.StructArray) -> list[pa.RecordBatch]:
        entries = block.to_pylist()
        words = {w: i for i, w in enumerate(sorted({t["token"] for e in entries for t in e["terms"] or ()}))}
        weights = np.zeros((len(words), len(entries)))
        for j, e in enumerate(entries):
            for t in e["terms"] or ():
                weights[words[t["token"]], j] = t["weight"]
        vectors = np.zeros((asked.num_rows, len(words)))
        for i, terms in enumerate(asked.column("terms").to_pylist()):
            for t in terms or ():
                at = words.get(t["token"])
                if at is not None:
                    vectors[i, at] = t["value"]
        cosine = vectors @ weights
        score = cosine.copy()
        for column, label, bonus in zip(("_cat", "_band", "_chan"), ("category", "amount_band", "channel"), BOOSTS):
            have = np.array([str(e[label]).upper() for e in entries])
            score += (np.array(asked.column(column).to_pylist(), str)[:, None] == have[None, :]) * bonus
        rank = np.array([e["rank"] for e in entries])
        order = np.lexsort((np.broadcast_to(rank, score.shape), -np.round(score, 9)), axis=1)[:, :top_k]
        hits = [
            [{"order": -round(float(score[i, j]), 9), "rank": int(rank[j]), "template_id": entries[j]["template_id"], "cosine": float(cosine[i, j]), "score": float(score[i, j])} for j in row]
            for i, row in enumerate(order)
        ]
        return [pa.RecordBatch.from_arrays([asked.column("_id").combine_chunks(), pa.array(hits, kind)], ["_id", "hits"])]

    return run


def rank_templates(
    df: DataFrame,
    library: DataFrame,
    text: str,
    category: str = "failure_category",
    amount: str = "amount_paise",
    channel: str = "channel",
    top_k: int = TOP_K,
    min_score: float = MIN_SIMILARITY,
) -> DataFrame:
    """Add ``hits`` (best templates with ``cosine`` and boosted ``score``) and ``best_text``.

    Rows that ask the same are scored once. Their words meet the library's
    weights in a join, which gives each its vector; vectors meet the library in
    a grid of blocks (``_grid``), a matrix product per cell, and the best of the
    blocks are merged by an aggregate. So a library may have any size and is
    never collected. Library order (``rank``) breaks ties.
    """
    band = amount_band(F.col(amount) / F.lit(100.0))
    upper = lambda c: F.upper(F.coalesce(c.cast("string"), F.lit("")))
    asks = {"_q": F.coalesce(F.col(text), F.lit("")), "_cat": upper(F.col(category)), "_band": upper(band), "_chan": upper(F.col(channel))}
    asked = df.select(*(c.alias(n) for n, c in asks.items())).distinct().withColumn("_id", F.monotonically_increasing_id())
    asked = materialise(asked, "asked")
    weights = materialise(term_weights(library, "template_id", "text"), "weights")
    known = weights.groupBy("token").agg(F.max("idf").alias("idf"))
    found = asked.select("_id", F.explode(tokens(F.col("_q"))).alias("token")).join(known, "token").groupBy("_id", "token").agg((F.count(F.lit(1)) * F.max("idf")).alias("value"))
    vectors = found.groupBy("_id").agg(F.collect_list(F.struct("token", "value")).alias("terms"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("n"))
    vectors = vectors.select("_id", F.transform("terms", lambda t: F.struct(t["token"].alias("token"), (t["value"] / F.col("n")).alias("value"))).alias("terms"))
    rows = asked.join(vectors, "_id", "left").select("_id", "_cat", "_band", "_chan", "terms")
    entries = library.join(weights.groupBy("template_id").agg(F.collect_list(F.struct("token", "weight")).alias("terms")), "template_id", "left")
    entries = entries.select("template_id", F.col("rank").cast("int").alias("rank"), "category", "amount_band", "channel", "terms")
    hits = "array<struct<order: double, rank: int, template_id: string, cosine: double, score: double>>"
    merged = _best(_grid(rows, entries, "template_id", _score_templates(top_k), f"_id bigint, hits {hits}"), "_id", top_k)
    merged = merged.withColumn("hits", F.filter("hits", lambda h: -h["order"] >= min_score))
    texts = library.select(F.col("template_id").alias("_first"), F.col("text").alias("best_text"))
    merged = merged.withColumn("_first", F.get(F.col("hits"), 0)["template_id"]).join(texts, "_first", "left")
    shown = F.transform("hits", lambda h: F.struct(h["template_id"].alias("template_id"), F.round(h["cosine"], 4).alias("cosine"), F.round(h["score"], 4).alias("score")))
    answers = asked.join(merged, "_id").select(*asks, shown.alias("hits"), "best_text")
    none = F.array().cast("array<struct<template_id: string, cosine: double, score: double>>")
    out = df.withColumns(asks).join(answers, list(asks), "left").drop(*asks)
    return out.withColumn("hits", F.coalesce("hits", none))


def personalise(
    df: DataFrame,
    library: DataFrame,
    category: str = "failure_category",
    channel: str = "channel",
    amount: str = "amount_paise",
    reason: str = "failure_reason",
    latency: str = "latency_ms",
    drafted: str | None = None,
) -> DataFrame:
    """Dispatch-log rows: best templates, the message and what it was based on.

    ``drafted`` may name a column with a text another system wrote; no model is
    called here, so without it the best template is rendered.
    """
    asked = df.withColumn(
        "_query", query_text(F.col(category), F.col(amount), F.col(channel), F.col(reason))
    )
    ranked = rank_templates(asked, library, "_query", category, amount, channel)
    best = F.get(F.col("hits"), 0)
    money = whole_rupees(F.col(amount))
    plain = F.concat(
        F.lit("Your payment of "), money, F.lit(" rupees failed ("),
        F.coalesce(F.col(reason), F.col(category)), F.lit("). Please try again: {link}"),
    )
    rendered = F.coalesce(fill(F.col("best_text"), amount=money), plain)
    written = F.col(drafted) if drafted else F.lit(None).cast("string")
    return ranked.select(
        F.sha2(F.concat_ws("|", F.col("payment_id"), F.col(channel)), 256).alias("rag_log_id"),
        "payment_id",
        F.col(category).alias("failure_category"),
        amount_band(F.col(amount) / F.lit(100.0)).alias("amount_band"),
        F.col(channel).alias("channel"),
        F.transform("hits", lambda h: h.getField("template_id")).alias("retrieved_ids"),
        F.coalesce(best.getField("score"), F.lit(0.0)).alias("top_similarity"),
        F.coalesce(written, rendered).alias("drafted_message"),
        written.isNotNull().alias("llm_used"),
        F.col(latency).alias("latency_ms"),
        "created_at",
    )


def dispatch_audit(log: DataFrame) -> DataFrame:
    """Audit row for each personalised message."""
    return log.select(
        F.col("payment_id").alias("transaction_id"),
        F.lit("RAG_PERSONALIZED").alias("action_taken"),
        F.concat(
            F.lit("templates "), F.array_join("retrieved_ids", ","),
            F.lit(" similarity "), F.col("top_similarity").cast("decimal(6,3)").cast("string"),
            F.lit(" channel "), F.col("channel"),
        ).alias("decision_rationale"),
        F.lit("system").alias("source"),
    )


def question_terms(question: str) -> list[str]:
    """Distinct lower-case words longer than two characters."""
    return sorted({w.lower() for w in re.findall(r"[a-zA-Z0-9_₹]+", question) if len(w) > 2})


def keyword_hits(df: DataFrame, question: str, at: str, key: str, top_k: int = 12) -> DataFrame:
    """Best rows by the number of question words in any of their columns, newest first on ties."""
    terms = question_terms(question)
    text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns]))
    score = F.lit(0)
    for term in terms:
        score = score + F.when(F.contains(F.col("_text"), F.lit(term)), 1).otherwise(0)
    rows = df.withColumn("_text", text).withColumn("hits", score).drop("_text")
    if terms:
        rows = rows.filter(F.col("hits") > 0)
    return rows.orderBy(F.col("hits").desc(), F.col(at).desc(), F.col(key)).limit(top_k)


def centroids(df: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Unit-length mean vector per label, as one combinable aggregate per dimension."""
    flat = df.select(label, F.posexplode(vector).alias("_i", "_x"))
    means = flat.groupBy(label, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    packed = means.groupBy(label).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda s: s.getField("_m")).alias("_v")
    )
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    return packed.withColumn("_n", norm).select(
        label, F.transform("_v", lambda x: x / F.col("_n")).alias("vector")
    )


def _score_vectors(label: str, top_k: int):
    def run(rows: pa.Table, block: pa.StructArray) -> list[pa.RecordBatch]:
        # By label, so that a stable order breaks ties by it.
        labels, library = zip(*sorted((e[label], e["vector"]) for e in block.to_pylist()))
        library = np.array(library, float)
        given = rows.column("vector").to_pylist()
        good = [i for i, v in enumerate(given) if v is not None and len(v) == library.shape[1] and any(v)]
        vectors = np.array([given[i] for i in good], float).reshape(len(good), library.shape[1])
        near = vectors @ library.T / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
        order = np.argsort(-np.round(near, 9), axis=1, kind="stable")[:, :top_k]
        hits = [[{"order": -round(float(near[i, j]), 9), "label": labels[j]} for j in row] for i, row in enumerate(order)]
        kind = pa.list_(pa.struct([("order", pa.float64()), ("label", block.field(label).type)]))
        keys = rows.column("key").combine_chunks().take(pa.array(good, pa.int64()))
        return [pa.RecordBatch.from_arrays([keys, pa.array(hits, kind)], ["key", "hits"])]

    return run


def dense_top_k(
    df: DataFrame, library: DataFrame, key: str, label: str = "label", vector: str = "embedding", top_k: int = TOP_K
) -> DataFrame:
    """``key, hits``: the nearest library vectors (unit length) of each row by cosine, ties by label.

    Packs of rows meet blocks of the library in a grid, a matrix product per
    cell, and the best of the blocks are merged by an aggregate: the plan is the
    same whatever the library's size, and nothing is collected. ``key`` names a
    row; rows without a vector, with a vector of zeros or of another length have none.
    """
    kinds = dict(df.dtypes) | {"label": dict(library.dtypes)[label]}
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    entries = library.select(label, F.col("vector").cast("array<double>").alias("vector"))
    hits = f"array<struct<order: double, label: {kinds['label']}>>"
    found = _grid(rows, entries, label, _score_vectors(label, top_k), f"key {kinds[key]}, hits {hits}")
    return _best(found, "key", top_k).withColumnRenamed("key", key)
