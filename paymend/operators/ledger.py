"""Tamper-evident audit ledger: append, verify and seal hash chains.

A single chain over everything cannot be written or checked in parallel. Rows
are therefore chained inside blocks of a bounded sequence range per chain key,
and the block heads are folded level by level into one root per chain key, so
order and completeness across blocks stay provable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paymend.functions.crypto import hmac_sha256

BLOCK_SPAN = 1024
#: What a row's hash covers. ``seq`` is always there; the others where the ledger has them.
FIELDS = (
    "action_taken", "decision_rationale", "logged_at", "merchant_id", "recoverability_score", "seq", "source", "transaction_id",
)
#: Folds after which one hash is left of any 64-bit block number.
LEVELS = 7


def genesis(chain: Column, block: Column) -> Column:
    """Start value of a block."""
    return F.sha2(F.concat_ws("|", F.lit("GENESIS"), chain, block.cast("string")), 256)


def canonical(columns: list[str], fields: tuple[str, ...] = FIELDS) -> Column:
    """One text per row: the fields that ``columns`` has, in name order, each with its length; null is marked."""
    parts = []
    for name in sorted(f for f in fields if f in columns):
        if name == "logged_at":
            text = F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        else:
            text = F.col(name).cast("string")
        parts.append(
            F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))
        )
    return F.concat_ws(";", *parts)


def block_of(seq: Column, span: int = BLOCK_SPAN) -> Column:
    return F.floor(seq / span).cast("bigint")


def append(
    rows: DataFrame, key: str | bytes, heads: DataFrame | None = None, span: int = BLOCK_SPAN
) -> DataFrame:
    """Add ``block, previous_hash, current_hash, hmac_signature`` to new rows.

    ``rows`` holds ``chain_key, seq`` (unique per chain) and the ledger fields.
    ``heads`` (``chain_key, block, head``) carries blocks that are still open. A
    block is at most ``span`` rows, so it folds inside one row of one task.
    """
    payload = canonical(rows.columns)
    names = [c for c in rows.columns if c not in ("chain_key", "seq")]
    shaped = rows.withColumns({"block": block_of(F.col("seq"), span), "_text": payload})
    shaped = shaped.withColumn("hmac_signature", hmac_sha256(F.col("_text"), key))
    item = F.struct("seq", "_text", "hmac_signature", *names)
    blocks = shaped.groupBy("chain_key", "block").agg(F.sort_array(F.collect_list(item)).alias("_rows"))
    start = genesis(F.col("chain_key"), F.col("block"))
    if heads is not None:
        blocks = blocks.join(heads.select("chain_key", "block", "head"), ["chain_key", "block"], "left")
        start = F.coalesce(F.col("head"), start)
    hashes = F.aggregate(
        F.col("_rows"),
        F.array(start),
        lambda acc, r: F.concat(
            acc, F.array(F.sha2(F.concat(F.element_at(acc, -1), r.getField("_text")), 256))
        ),
    )
    chained = blocks.withColumn("_h", hashes).select(
        "chain_key", "block", "_h", F.posexplode("_rows").alias("_i", "_r")
    )
    return chained.select(
        "chain_key",
        "block",
        "_r.seq",
        *[F.col(f"_r.{n}").alias(n) for n in names],
        F.get("_h", F.col("_i")).alias("previous_hash"),
        F.get("_h", F.col("_i") + 1).alias("current_hash"),
        "_r.hmac_signature",
    )


def heads(chain: DataFrame) -> DataFrame:
    """Last hash of every block."""
    return chain.groupBy("chain_key", "block").agg(F.max_by("current_hash", "seq").alias("head"))


def seal_blocks(chain: DataFrame) -> DataFrame:
    """What must be kept apart from the ledger: ``first_seq, last_seq, records, head`` of every block.

    The rows of a chain alone cannot show that its last rows, or whole blocks, are gone. Their
    root (``seal``) proves that this table is complete itself.
    """
    return chain.groupBy("chain_key", "block").agg(
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        F.count(F.lit(1)).alias("records"),
        F.max_by("current_hash", "seq").alias("head"),
    )


def missing(chain: DataFrame, sealed: DataFrame) -> DataFrame:
    """Blocks of ``chain`` that differ from the sealed ones: ``chain_key, block, kind, lost``.

    ``kind``: missing block, unsealed block, missing rows, added rows, or head (as many rows,
    another last hash). ``lost`` is the number of rows that are gone (negative: too many).
    """
    now = seal_blocks(chain).select("chain_key", "block", F.col("records").alias("_n"), F.col("head").alias("_h"))
    both = sealed.join(now, ["chain_key", "block"], "full")
    lost = F.coalesce("records", F.lit(0)) - F.coalesce("_n", F.lit(0))
    kind = (
        F.when(F.col("_n").isNull(), "missing block")
        .when(F.col("records").isNull(), "unsealed block")
        .when(lost > 0, "missing rows")
        .when(lost < 0, "added rows")
        .when(F.col("head") != F.col("_h"), "head")
    )
    return both.select("chain_key", "block", kind.alias("kind"), lost.alias("lost")).where("kind IS NOT NULL")


def seal(chain: DataFrame, fan: int = 256, levels: int = LEVELS) -> DataFrame:
    """One root hash per chain key: block heads are folded ``fan`` at a time in block order until one is left."""
    level = heads(chain).select("chain_key", F.col("block").alias("_n"), F.col("head").alias("_h"))
    for _ in range(levels):
        level = _fold(level.withColumn("_g", F.floor(F.col("_n") / fan)), ["chain_key", "_g"]).select(
            "chain_key", F.col("_g").alias("_n"), "_h"
        )
    return _fold(level, ["chain_key"]).select("chain_key", F.col("_h").alias("root"))


def _fold(level: DataFrame, keys: list[str]) -> DataFrame:
    joined = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("_n", "_h"))), lambda x: x.getField("_h")), ""
    )
    return level.groupBy(*keys).agg(F.sha2(joined, 256).alias("_h"))


def with_breaks(chain: DataFrame, key: str | bytes, span: int = BLOCK_SPAN) -> DataFrame:
    """Row-local checks: ``link_break, hash_break, hmac_break``.

    A row stores the hash it builds on, so each row is checked against its
    neighbour and itself only, in parallel.
    """
    order = Window.partitionBy("chain_key", "block").orderBy("seq")
    checked = chain.withColumns({"block": block_of(F.col("seq"), span), "_text": canonical(chain.columns)})
    expected = F.coalesce(
        F.lag("current_hash").over(order), genesis(F.col("chain_key"), F.col("block"))
    )
    recomputed = F.sha2(F.concat(F.col("previous_hash"), F.col("_text")), 256)
    signed = F.coalesce("hmac_signature", F.lit(""))
    return checked.withColumns(
        {
            "link_break": F.coalesce(F.col("previous_hash") != expected, F.lit(True)),
            "hash_break": F.coalesce(F.col("current_hash") != recomputed, F.lit(True)),
            "hmac_break": (signed != "") & (signed != hmac_sha256(F.col("_text"), key)),
            "_recomputed": recomputed,
        }
    ).drop("_text")


def verify(chain: DataFrame, key: str | bytes, span: int = BLOCK_SPAN, sealed: DataFrame | None = None) -> DataFrame:
    """One row per chain key: ``ok, records, kind, first_bad_seq, hmac_failures``.

    ``kind`` is link, hash (a link break on the same row goes first), hmac
    (counted only while the chain holds) or ok. No rows, no broken chains.
    With ``sealed`` (``seal_blocks`` at writing time) lost and added rows count too:
    where the rows that are there hold, ``kind`` is the first such finding in block order
    and ``first_bad_seq`` the first sequence number of its block. A chain that is gone
    as a whole has a row with no records.
    """
    checked = with_breaks(chain, key, span)
    broken = F.col("link_break") | F.col("hash_break")
    agg = checked.groupBy("chain_key").agg(
        F.count(F.lit(1)).alias("records"),
        F.min(F.when(broken, F.struct("seq", F.when(F.col("link_break"), "link").otherwise("hash").alias("kind")))).alias("_b"),
        F.sum(F.when(F.col("hmac_break"), 1).otherwise(0)).alias("_m"),
    )
    holds = F.col("_b").isNull()
    out = agg.select(
        "chain_key",
        "records",
        F.when(~holds, F.col("_b.kind")).when(F.col("_m") > 0, "hmac").otherwise("ok").alias("kind"),
        F.col("_b.seq").alias("first_bad_seq"),
        F.when(holds, F.col("_m")).otherwise(0).alias("hmac_failures"),
        (holds & (F.col("_m") == 0)).alias("ok"),
    )
    if sealed is None:
        return out
    gaps = missing(chain, sealed).groupBy("chain_key").agg(F.min(F.struct("block", "kind")).alias("_g"))
    both = out.join(gaps, "chain_key", "full")
    sound = F.coalesce("ok", F.lit(True))
    return both.select(
        "chain_key",
        F.coalesce("records", F.lit(0)).alias("records"),
        F.when(sound & F.col("_g").isNotNull(), F.col("_g.kind")).otherwise(F.col("kind")).alias("kind"),
        F.when(sound & F.col("_g").isNotNull(), F.col("_g.block") * span).otherwise(F.col("first_bad_seq")).alias("first_bad_seq"),
        F.coalesce("hmac_failures", F.lit(0)).alias("hmac_failures"),
        (sound & F.col("_g").isNull()).alias("ok"),
    )


def tampered_rows(chain: DataFrame, key: str | bytes, span: int = BLOCK_SPAN) -> DataFrame:
    """Every row that fails when a reader walks the block from its start.

    After a break the reader keeps the last good hash, so later rows fail until
    one links to it again. ``own_break`` marks rows wrong in themselves,
    ``propagated`` those that only follow. Blocks without a break of their own
    are left out before the walk; a walk is at most ``span`` rows.
    """
    checked = with_breaks(chain, key, span)
    own = F.col("link_break") | F.col("hash_break") | F.col("hmac_break")
    item = F.struct(
        "seq", "previous_hash", F.col("_recomputed").alias("re"), "current_hash",
        "link_break", "hash_break", "hmac_break",
    )
    blocks = (
        checked.groupBy("chain_key", "block")
        .agg(F.max(own).alias("_any"), F.sort_array(F.collect_list(item)).alias("_rows"))
        .filter("_any")
    )
    walked = F.aggregate(
        F.col("_rows"),
        F.struct(
            genesis(F.col("chain_key"), F.col("block")).alias("head"),
            F.array().cast("array<boolean>").alias("bad"),
        ),
        lambda acc, r: _step(acc, r),
    )
    out = blocks.withColumn("_bad", walked.getField("bad")).select(
        "chain_key", "block", "_bad", F.posexplode("_rows").alias("_i", "_r")
    )
    follows = F.get("_bad", F.col("_i"))
    return (
        out.select(
            "chain_key",
            "_r.seq",
            (F.col("_r.link_break") | F.col("_r.hash_break") | F.col("_r.hmac_break")).alias("own_break"),
            follows.alias("_f"),
        )
        .filter(F.col("own_break") | F.col("_f"))
        .select("chain_key", "seq", "own_break", (F.col("_f") & ~F.col("own_break")).alias("propagated"))
    )


def _step(acc: Column, row: Column) -> Column:
    good = (row.getField("previous_hash") == acc.getField("head")) & (
        row.getField("re") == row.getField("current_hash")
    )
    good = F.coalesce(good, F.lit(False))
    return F.struct(
        F.when(good, row.getField("current_hash")).otherwise(acc.getField("head")).alias("head"),
        F.concat(acc.getField("bad"), F.array(~good)).alias("bad"),
    )
