import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from paymend.operators import ledger

KEY = b"k"


@pytest.fixture(scope="module")
def seed(spark):
    return spark.range(3000).select(
        F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("chain_key"), F.col("id").alias("seq"),
        F.concat(F.lit("pay_"), "id").alias("transaction_id"), F.lit("RETRY").alias("action_taken"),
        F.when(F.col("id") % 5 == 0, None).otherwise("system").alias("source"),
        F.lit("0.500000").cast("decimal(7,6)").alias("recoverability_score"),
        F.timestamp_seconds(F.col("id") + 1_700_000_000).cast("timestamp_ntz").alias("logged_at"),
    )


def test_hashes_equal_a_plain_walk(spark, seed):
    rows = ledger.append(seed, KEY, span=100).orderBy("chain_key", "seq").collect()
    heads = {}
    for r in rows:
        part = lambda v: "-" if v is None else f"{len(v)}:{v}"
        at = r.logged_at.strftime("%Y-%m-%d %H:%M:%S.%f")
        text = ";".join(part(v) for v in (r.action_taken, at, str(r.recoverability_score), str(r.seq), r.source, r.transaction_id))
        start = hashlib.sha256(f"GENESIS|{r.chain_key}|{r.seq // 100}".encode()).hexdigest()
        previous = heads.get((r.chain_key, r.seq // 100), start)
        assert r.previous_hash == previous
        assert r.current_hash == hashlib.sha256((previous + text).encode()).hexdigest()
        assert r.hmac_signature == hmac.new(KEY, text.encode(), hashlib.sha256).hexdigest()
        heads[(r.chain_key, r.seq // 100)] = r.current_hash


def test_append_in_parts_equals_append_at_once(spark, seed):
    whole = ledger.append(seed, KEY)
    first = ledger.append(seed.filter("seq < 1500"), KEY)
    second = ledger.append(seed.filter("seq >= 1500"), KEY, heads=ledger.heads(first))
    assert first.unionByName(second).exceptAll(whole).count() == 0
    assert all(r.ok for r in ledger.verify(whole, KEY).collect())


def test_empty_ledger_has_no_broken_chain(spark, seed):
    assert ledger.verify(ledger.append(seed.limit(0), KEY), KEY).count() == 0


def test_breaks_are_found_and_spread_inside_the_block(spark, seed):
    chain = ledger.append(seed.filter("chain_key = 'm0' AND seq < 18"), KEY)
    bad = chain.withColumn("current_hash", F.when(F.col("seq") == 3, "x" * 64).otherwise(F.col("current_hash")))
    summary = ledger.verify(bad, KEY).first()
    assert (summary.ok, summary.kind, summary.first_bad_seq) == (False, "hash", 3)
    rows = {r.seq: (r.own_break, r.propagated) for r in ledger.tampered_rows(bad, KEY).collect()}
    assert rows == {3: (True, False), 6: (True, False), 9: (False, True), 12: (False, True), 15: (False, True)}


def test_forged_signature_and_other_key(spark, seed):
    chain = ledger.append(seed.filter("seq < 30"), KEY)
    blank = chain.withColumn("hmac_signature", F.lit(""))
    assert all(r.ok for r in ledger.verify(blank, KEY).collect())
    rotated = ledger.verify(chain, b"another").collect()
    assert all(r.kind == "hmac" and r.hmac_failures == r.records for r in rotated)


def test_root_changes_with_any_row(spark, seed):
    chain = ledger.append(seed, KEY, span=100)
    roots = {r.chain_key: r.root for r in ledger.seal(chain, fan=4, levels=2).collect()}
    cut = {r.chain_key: r.root for r in ledger.seal(chain.filter("seq <> 2999"), fan=4, levels=2).collect()}
    assert sum(roots[k] != cut[k] for k in roots) == 1


def test_lost_rows_and_blocks_are_found(spark, seed):
    chain = ledger.append(seed, KEY, span=100)
    sealed = ledger.seal_blocks(chain)
    assert ledger.missing(chain, sealed).count() == 0
    assert all(r.ok for r in ledger.verify(chain, KEY, 100, sealed).collect())
    gone = {r.chain_key: r for r in ledger.verify(chain.filter("block <> 3 OR chain_key <> 'm1'"), KEY, 100, sealed).collect()}
    assert (gone["m1"].kind, gone["m1"].first_bad_seq, gone["m1"].ok) == ("missing block", 300, False) and gone["m0"].ok
    tail = {(r.chain_key, r.block): (r.kind, r.lost) for r in ledger.missing(chain.filter("seq <> 2999"), sealed).collect()}
    assert tail == {("m2", 29): ("missing rows", 1)}
    whole = {r.chain_key: (r.records, r.kind) for r in ledger.verify(chain.filter("chain_key <> 'm0'"), KEY, 100, sealed).collect()}
    assert whole["m0"] == (0, "missing block")
    swapped = ledger.append(seed.withColumn("action_taken", F.lit("WAIT")), KEY, span=100)
    assert {r.kind for r in ledger.missing(swapped, sealed).collect()} == {"head"}
    more = ledger.missing(chain, sealed.filter("block <> 0")).collect()
    assert {r.kind for r in more} == {"unsealed block"} and len(more) == 3


def test_every_field_is_covered(spark, seed):
    rows = seed.withColumns({"decision_rationale": F.lit("why"), "merchant_id": F.lit("m")})
    chain = ledger.append(rows, KEY)
    for name in ("decision_rationale", "merchant_id", "action_taken", "transaction_id"):
        forged = chain.withColumn(name, F.lit("forged"))
        assert not any(r.ok for r in ledger.verify(forged, KEY).collect()), name
    moved = chain.withColumn("seq", F.col("seq") + 3)
    assert not any(r.ok for r in ledger.verify(moved, KEY).collect())
