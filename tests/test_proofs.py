import hashlib

import pytest
from pyspark.sql import functions as F

from paymend.operators import proofs
from paymend.sources.scratch import materialise


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_root(leaves):
    """The tree by its definition: split at the largest power of two below the number of leaves."""
    if len(leaves) == 1:
        return leaves[0]
    cut = 1
    while cut * 2 < len(leaves):
        cut *= 2
    return sha("node|" + plain_root(leaves[:cut]) + plain_root(leaves[cut:]))


SIZES = {"one": 1, "two": 2, "seven": 7, "long": 2500}


def sealed_blocks(spark, first, last):
    """Blocks of every chain, of which numbers from ``first`` to ``last`` are taken; block numbers have holes."""
    rows = spark.createDataFrame(list(SIZES.items()), "chain_key string, n bigint")
    out = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))).filter(F.col("i").between(first, last))
    return out.select(
        "chain_key", (F.col("i") * 3).alias("block"), (F.col("i") * 3072).alias("first_seq"), (F.col("i") * 3072 + 9).alias("last_seq"),
        F.lit(10).cast("bigint").alias("records"), F.concat("chain_key", F.col("i").cast("string")).alias("head"),
    )


def plain_leaves(name, n):
    return [sha(f"leaf|{i * 3}|{i * 3072}|{i * 3072 + 9}|10|{name}{i}") for i in range(n)]


@pytest.fixture(scope="module")
def stored(spark):
    """Nodes of three appends, each of which reads what the earlier ones stored."""
    nodes = None
    for first, last in ((0, 4), (5, 1100), (1101, 5000)):
        new = proofs.grow(proofs.leaves(sealed_blocks(spark, first, last), nodes), nodes)
        nodes = materialise(new if nodes is None else nodes.unionByName(new), "test-nodes")
    return nodes


def test_appends_store_the_nodes_of_one_append(spark, stored):
    whole = proofs.grow(proofs.leaves(sealed_blocks(spark, 0, 5000)))
    assert stored.count() == whole.count() == stored.distinct().count()
    assert stored.exceptAll(whole).count() == 0


def test_roots_equal_the_definition(spark, stored):
    sizes = spark.createDataFrame([("long", n) for n in (1, 2, 3, 5, 64, 1023, 1024, 1025, 2047, 2500)] + [("seven", 7)], "chain_key string, size bigint")
    for r in proofs.roots(stored, sizes).collect():
        assert r.root == plain_root(plain_leaves(r.chain_key, r.size)), (r.chain_key, r.size)
    now = {r.chain_key: r.size for r in proofs.roots(stored).collect()}
    assert now == SIZES


def test_every_leaf_has_a_proof(spark, stored):
    leaves = stored.filter("level = 0").select("chain_key", F.col("node").alias("leaf"), "hash")
    asked = leaves.join(proofs.tree_sizes(stored), "chain_key")
    earlier = leaves.filter("chain_key = 'long' AND leaf < 1037").withColumn("size", F.lit(1037).cast("bigint"))
    asked = asked.unionByName(earlier, allowMissingColumns=True)
    known = proofs.roots(stored, asked)
    out = materialise(proofs.included(proofs.inclusion(stored, asked), known), "test-proofs")
    assert out.count() == sum(SIZES.values()) + 1037 and out.filter("NOT ok").count() == 0
    assert out.agg(F.max(F.size("path"))).first()[0] == 12
    assert out.filter("chain_key = 'one' AND size(path) = 0").count() == 1
    # Another leaf, another root or a changed step is not proved.
    forged = out.drop("ok").withColumn("hash", F.sha2("hash", 256))
    assert proofs.included(forged, known).filter("ok").count() == 0
    moved = out.drop("ok").filter("chain_key = 'long' AND size = 2500").withColumn("size", F.lit(1037).cast("bigint"))
    assert proofs.included(moved, known).filter("ok").count() == 0


def test_growth_is_proved_and_a_rewritten_past_is_not(spark, stored):
    pairs = [("long", a, b) for a, b in ((1, 2), (3, 7), (4, 8), (6, 6), (5, 1100), (1024, 2500), (1037, 2047), (2499, 2500))] + [("seven", 5, 7)]
    asked = spark.createDataFrame(pairs, "chain_key string, old bigint, new bigint")
    sizes = asked.select("chain_key", F.col("old").alias("size")).union(asked.select("chain_key", "new")).distinct()
    known = proofs.roots(stored, sizes)
    given = proofs.consistency(stored, asked)
    out = proofs.consistent(given, known).collect()
    assert len(out) == len(pairs) and all(r.ok for r in out)
    assert max(len(r.proof) for r in out) <= 22
    # The same chains with one early block rewritten: its roots don't follow from the old ones.
    changed = sealed_blocks(spark, 0, 5000).withColumn("records", F.when(F.col("block") == 0, 9).otherwise(F.col("records")).cast("bigint"))
    other = proofs.grow(proofs.leaves(changed))
    mixed = known.join(asked.select("chain_key", F.col("new").alias("size")).distinct(), ["chain_key", "size"], "left_anti").unionByName(
        proofs.roots(other, asked.select("chain_key", F.col("new").alias("size")))
    )
    bad = proofs.consistent(proofs.consistency(other, asked.filter("old < new")), mixed.dropDuplicates(["chain_key", "size"])).collect()
    assert bad and not any(r.ok for r in bad)


def test_no_blocks_no_tree(spark):
    empty = proofs.grow(proofs.leaves(sealed_blocks(spark, 9000, 9001)))
    assert empty.count() == 0 and proofs.roots(empty).count() == 0
