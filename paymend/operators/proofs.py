"""Merkle trees over sealed ledger blocks: stored as they grow, with proofs of inclusion and of consistency.

A leaf is one sealed block (``ledger.seal_blocks``). A tree of n leaves splits at the largest power of
two below n, so a node over 2**level leaves never changes once its last leaf is there. Only such whole
nodes are stored; a later append adds nodes and rewrites none. Everything else, the root too, comes
from at most one whole node per level. Chain keys are not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paymend.operators.ranks import running_index
from paymend.sources.scratch import materialise

#: Levels that are built in one row of one task: a stretch of 1,024 nodes and all that stand on it.
BAND = 10
#: Bands, so at most 2**30 sealed blocks in a chain.
BANDS = 3
TOP = BAND * BANDS


def _span(level: Column) -> Column:
    """Leaves below a whole node."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), level.cast("int"))


def _up(number: Column, level: Column) -> Column:
    """Number of the node of ``level`` that a leaf stands under."""
    return F.call_function("shiftright", number.cast("bigint"), level.cast("int"))


def _pair(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.lit("node|"), left, right), 256)


def leaf_hash() -> Column:
    """Hash of one sealed block: where it starts and ends, how many rows it holds, its last hash."""
    return F.sha2(F.concat_ws("|", F.lit("leaf"), "block", "first_seq", "last_seq", "records", "head"), 256)


def leaves(sealed: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``chain_key, leaf, block, hash``: sealed blocks numbered from 0 in block order, after those already ``stored``.

    Blocks sealed later must have higher numbers than the stored ones. Written once, as every band reads it.
    """
    out = running_index(sealed.withColumn("hash", leaf_hash()), ["chain_key"], "block", F.floor(F.col("block") / 65536))
    number = F.col("position") - 1
    if stored is not None:
        out = out.join(tree_sizes(stored), "chain_key", "left")
        number = number + F.coalesce("size", F.lit(0))
    return materialise(out.select("chain_key", number.cast("bigint").alias("leaf"), "block", "hash"), "leaves")


def tree_sizes(nodes: DataFrame) -> DataFrame:
    """``chain_key, size``: leaves of every stored tree."""
    return nodes.filter("level = 0").groupBy("chain_key").agg((F.max("node") + 1).alias("size"))


def grow(new: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Whole nodes that ``new`` leaves complete: ``chain_key, level, node, hash``, to be added to the ``stored`` ones.

    A band of levels is built over stretches of 1,024 nodes, in one shuffle each; of the stored nodes
    only those in the last open stretch of a chain are read again.
    """
    base = new.select("chain_key", F.lit(0).alias("level"), F.col("leaf").alias("node"), "hash")
    out = base
    for low in range(0, TOP, BAND):
        stretch = _up(F.col("node"), F.lit(BAND))
        now = base.select("chain_key", "node", "hash", F.lit(True).alias("_new"))
        if stored is not None:
            first = base.groupBy("chain_key").agg(F.min("node").alias("_first"))
            open_ones = stored.filter(F.col("level") == low).join(first, "chain_key").filter(
                (F.col("node") < F.col("_first")) & (stretch == _up(F.col("_first"), F.lit(BAND)))
            )
            now = now.unionByName(open_ones.select("chain_key", "node", "hash", F.lit(False).alias("_new")))
        groups = now.groupBy("chain_key", stretch.alias("_g")).agg(
            F.sort_array(F.collect_list(F.struct("node", "hash"))).alias("_n"),
            F.min(F.when(F.col("_new"), F.col("node"))).alias("_from"),
        )
        hashes = F.transform("_n", lambda x: x.getField("hash"))
        tiers = F.aggregate(
            F.sequence(F.lit(1), F.lit(BAND)),
            F.array(hashes),
            lambda acc, _: F.concat(acc, F.array(_halved(F.element_at(acc, -1)))),
        )
        built = (
            groups.withColumn("_t", tiers)
            .select("chain_key", "_g", "_from", F.posexplode("_t").alias("_up", "_h"))
            .select("chain_key", "_g", "_from", "_up", F.posexplode("_h").alias("_i", "hash"))
            .withColumn("node", F.col("_g") * _span(F.lit(BAND) - F.col("_up")) + F.col("_i"))
            .filter((F.col("_up") > 0) & ((F.col("node") + 1) * _span(F.col("_up")) > F.col("_from")))
            .select("chain_key", (F.col("_up") + low).alias("level"), "node", "hash")
        )
        out = out.unionByName(built)
        base = built.filter(F.col("level") == low + BAND)
    return out


def _halved(hashes: Column) -> Column:
    """Parents of neighbours; a last one without a neighbour has none yet."""
    pairs = F.floor(F.size(hashes) / 2).cast("int")
    none = F.array().cast("array<string>")
    return F.when(
        pairs > 0,
        F.transform(F.sequence(F.lit(0), pairs - 1), lambda i: _pair(F.get(hashes, i * 2), F.get(hashes, i * 2 + 1))),
    ).otherwise(none)


def _cover(df: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Whole nodes that make up the leaves ``lo`` to ``hi - 1``, at most two of a level: adds ``level, node, start``."""
    levels = df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(TOP))))
    span = _span(F.col("level"))
    first, end = F.floor((lo + span - 1) / span), F.floor(hi / span)
    left = F.when((first % 2 == 1) & (first < end), first)
    right = F.when((end % 2 == 1) & (end > first), end - 1)
    both = levels.withColumn("node", F.explode(F.array(left, right))).filter(F.col("node").isNotNull())
    return both.withColumn("start", F.col("node") * span)


def _bag(parts: Column) -> Column:
    """Hash over whole nodes of falling size, joined from the right."""
    turned = F.reverse(F.transform(parts, lambda x: x.getField("hash")))
    return F.aggregate(F.slice(turned, 2, TOP * 2 + 2), F.get(turned, F.lit(0)), lambda acc, h: _pair(h, acc))


def _peaks(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """``chain_key, size, _p``: the whole nodes of a tree of ``size`` leaves from the left."""
    found = _cover(asked.select("chain_key", "size").distinct(), F.lit(0), F.col("size")).join(
        nodes, ["chain_key", "level", "node"]
    )
    item = F.struct("start", F.col("level").cast("int").alias("level"), "hash")
    return found.groupBy("chain_key", "size").agg(F.sort_array(F.collect_list(item)).alias("_p"))


def roots(nodes: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """``chain_key, size, root`` of the trees as stored, or of the earlier sizes ``asked`` for (``chain_key, size``)."""
    return _peaks(nodes, tree_sizes(nodes) if asked is None else asked).select("chain_key", "size", _bag(F.col("_p")).alias("root"))


def inclusion(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """Proofs that leaves are in trees: ``chain_key, leaf, size, hash, path`` of ``asked`` (``chain_key, leaf, size, hash``).

    ``path`` holds the neighbours from the leaf up (``level, left, hash``; left: the neighbour comes first).
    A neighbour at the right edge may not be whole; it is joined from the whole nodes below it. One row
    per level and leaf meets the stored nodes in a join; nothing depends on the width of the tree.
    """
    level, size = F.col("level"), F.col("size")
    steps = asked.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(TOP - 1))))
    steps = steps.filter(_up(size - 1, level) > 0)
    mine = _up(F.col("leaf"), level)
    steps = steps.withColumns({"node": mine.bitwiseXOR(F.lit(1).cast("bigint")), "left": mine % 2 == 1})
    steps = steps.filter(F.col("node") * _span(level) < size)
    edge = (
        _peaks(nodes, asked)
        .withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(TOP))))
        .withColumn("_low", F.filter("_p", lambda x: x.getField("level") < F.col("level")))
        .filter(F.size("_low") > 0)
        .select("chain_key", "size", "level", _bag(F.col("_low")).alias("_edge"))
    )
    whole = (F.col("node") + 1) * _span(level) <= size
    kept = nodes.select("chain_key", "level", "node", F.col("hash").alias("_whole"))
    found = steps.join(kept, ["chain_key", "level", "node"], "left").join(edge, ["chain_key", "size", "level"], "left")
    step = F.struct("level", "left", F.when(whole, F.col("_whole")).otherwise(F.col("_edge")).alias("hash"))
    paths = found.groupBy("chain_key", "leaf", "size").agg(F.sort_array(F.collect_list(step)).alias("path"))
    return asked.select("chain_key", "leaf", "size", "hash").join(paths, ["chain_key", "leaf", "size"], "left").withColumn(
        "path", F.coalesce("path", F.array().cast(paths.schema["path"].dataType))
    )


def climbed(leaf: Column, path: Column) -> Column:
    """The root that a leaf's hash and its path lead to; null where a step is missing."""
    return F.aggregate(
        path,
        leaf,
        lambda acc, s: F.when(s.getField("left"), _pair(s.getField("hash"), acc)).otherwise(_pair(acc, s.getField("hash"))),
    )


def included(proofs: DataFrame, known: DataFrame) -> DataFrame:
    """Adds ``ok``: the proof leads to the root in ``known`` (``chain_key, size, root``), which the checker keeps."""
    joined = proofs.join(known, ["chain_key", "size"], "left")
    return joined.withColumn("ok", F.coalesce(climbed(F.col("hash"), F.col("path")) == F.col("root"), F.lit(False))).drop("root")


def consistency(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """Proofs that a tree grew only at its end: ``chain_key, old, new, proof`` of ``asked`` (``chain_key, old, new``; old >= 1).

    ``proof`` holds the whole nodes of the old tree and then those over the leaves added since, from the
    left (``start, level, hash``).
    """
    pairs = asked.select("chain_key", "old", "new").distinct()
    before = _cover(pairs, F.lit(0), F.col("old"))
    after = _cover(pairs, F.col("old"), F.col("new"))
    item = F.struct("start", F.col("level").cast("int").alias("level"), "hash")
    return (
        before.unionByName(after)
        .join(nodes, ["chain_key", "level", "node"])
        .groupBy("chain_key", "old", "new")
        .agg(F.sort_array(F.collect_list(item)).alias("proof"))
    )


def _stacked(parts: Column) -> Column:
    """Whole nodes from the left, neighbours of equal size joined into their parent as soon as both are there."""
    empty = F.array().cast("array<struct<level:int,hash:string>>")

    def push(stack: Column, part: Column) -> Column:
        start = F.struct(part.getField("level").alias("level"), part.getField("hash").alias("hash"), empty.alias("kept"))

        def step(now: Column, top: Column) -> Column:
            joins = (F.size(now.getField("kept")) == 0) & (top.getField("level") == now.getField("level"))
            return F.struct(
                F.when(joins, now.getField("level") + 1).otherwise(now.getField("level")).alias("level"),
                F.when(joins, _pair(top.getField("hash"), now.getField("hash"))).otherwise(now.getField("hash")).alias("hash"),
                F.when(joins, now.getField("kept")).otherwise(F.concat(now.getField("kept"), F.array(top))).alias("kept"),
            )

        return F.aggregate(
            F.reverse(stack),
            start,
            step,
            lambda s: F.concat(F.reverse(s.getField("kept")), F.array(F.struct(s.getField("level").alias("level"), s.getField("hash").alias("hash")))),
        )

    return F.aggregate(parts, empty, push)


def consistent(proofs: DataFrame, known: DataFrame) -> DataFrame:
    """Adds ``ok``: the proof's nodes lie side by side, and lead to the old and to the new root in ``known``."""
    first = known.select("chain_key", F.col("size").alias("old"), F.col("root").alias("_old"))
    last = known.select("chain_key", F.col("size").alias("new"), F.col("root").alias("_new"))
    joined = proofs.join(first, ["chain_key", "old"], "left").join(last, ["chain_key", "new"], "left")
    tiled = F.aggregate(
        "proof",
        F.lit(0).cast("bigint"),
        lambda at, x: F.when(x.getField("start") == at, at + _span(x.getField("level"))).otherwise(F.lit(-1).cast("bigint")),
    ) == F.col("new")
    earlier = F.filter("proof", lambda x: x.getField("start") < F.col("old"))
    ok = tiled & (_bag(earlier) == F.col("_old")) & (_bag(_stacked(F.col("proof"))) == F.col("_new"))
    return joined.withColumn("ok", F.coalesce(ok, F.lit(False))).drop("_old", "_new")
