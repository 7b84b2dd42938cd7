"""Prefix trie of conversations with subtree totals by depth-band rollup.

A node is a distinct sequence of first turns. It is named by its depth and a 128-bit prefix hash,
the exclusive or of a hash of every turn with its place, so a parent's name follows from the
child's. Prefix hashes are running sums: rows are sorted by range over all tasks, each task sums its
own stretch, and what a conversation had in the tasks before is added from one or two rows a task.
So a conversation that holds a third of all rows is spread over tasks like the rest.

Subtree totals go up in bands of ``height`` levels. Inside a band a path adds to its own nodes
only; band roots with the sums of their bands form a tree a ``height``-th as deep, which is
rolled up the same way, and their completed totals are handed to the nodes above them before the band
itself is summed. A row meets at most ``height`` others, and a trie of depth D takes log D rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from paymend.llm.batches import emit, raw
from paymend.sources.scratch import materialise

#: Levels of a band.
HEIGHT = 16
#: Turns that a rebuilt conversation may take from another one, and how many neighbours share it.
MOST_COPIED, FAMILY = 8, 5
#: Conversation numbers whose ends are gathered in one row: two to this power.
BLOCK_BITS = 16
NODE = ["depth", "id1", "id2"]
_ENDS = pa.schema([("depth", pa.int64()), ("id1", pa.int64()), ("id2", pa.int64()), ("ends_sha256", pa.string())])


def running(rows: DataFrame, order: list[Column], xors: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``at`` (place in its conversation by ``order``, from 1) and the long columns ``xors`` replaced by their running exclusive or.

    No conv_id may be null.
    """
    ranged = rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    ranged = ranged.withColumns({"part": F.spark_partition_id(), "at": F.lit(0).cast("long")})
    names = ranged.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, dict.fromkeys(("at", *xors), 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = np.asarray(batch.column("conv_id"))
            new = np.concatenate([[last is None or conv[0] != last], conv[1:] != conv[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(len(conv)), 0))
            goes_on = (start == 0) & ~new[0]
            out = {"at": np.arange(len(conv)) - start + 1 + np.where(goes_on, carried["at"], 0)}
            for c in xors:
                total = np.bitwise_xor.accumulate(np.asarray(batch.column(c)))
                before = np.concatenate([[0], total[:-1]])
                out[c] = total ^ before[start] ^ np.where(goes_on, carried[c], 0)
            last, carried = conv[-1], {c: v[-1] for c, v in out.items()}
            yield pa.RecordBatch.from_arrays([pa.array(out[c], pa.int64()) if c in out else batch.column(c) for c in names], names=names)

    local = materialise(ranged.mapInArrow(run, ranged.schema), "running")
    # Only the first and the last conversation of a task can go on in another one: two rows a task at most.
    of = [F.col(c) for c in ("at", *xors)]
    edges = local.groupBy("part").agg(F.max(F.struct("conv_id", *of)).alias("high"), F.max(F.struct(F.bitwise_not("conv_id").alias("conv_id"), *of)).alias("low"))
    marks = edges.select("part", "high.*").unionByName(edges.select("part", "low.*").withColumn("conv_id", F.bitwise_not("conv_id"))).distinct()
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select("part", "conv_id", F.sum("at").over(before).alias("more_at"), *(F.bit_xor(c).over(before).alias(f"more_{c}") for c in xors))
    # Bounded by the number of shuffle partitions, not by the data.
    joined = local.join(F.broadcast(marks.where("more_at is not null")), ["part", "conv_id"], "left")
    full = {"at": F.col("at") + F.coalesce("more_at", F.lit(0))}
    full |= {c: F.col(c).bitwiseXOR(F.coalesce(f"more_{c}", F.lit(0))) for c in xors}
    return joined.withColumns(full).select([c for c in names if c != "part"])


def sequences(rows: DataFrame) -> DataFrame:
    """(conv_id, at, digest, bytes) of every turn, in order: by turn, nulls first, then by the SHA-256 of role and text.

    Null roles and texts are empty; rows with a null conv_id are in no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return running(materialise(turns, "turns"), [F.col("turn").asc_nulls_first(), F.col("digest")]).drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) with shared beginnings: conversation c takes the first h turns of c - c % 5 (all if there are
    fewer, none if it is not there) and its own after its first h; h is crc32 of c in decimal, modulo 9."""
    copied = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % (MOST_COPIED + 1)
    convs = turns.where("at = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), copied("conv_id").alias("h"))
    heads = turns.where(F.col("at") <= MOST_COPIED).where(F.col("conv_id") % FAMILY == 0).withColumnRenamed("conv_id", "base")
    taken = convs.join(heads, "base").where("at <= h").select("conv_id", F.col("at").alias("depth"), "digest", "bytes")
    there = heads.groupBy("base").agg(F.max("at").alias("n"))
    shift = convs.join(there, "base", "left").select("conv_id", (F.least(F.coalesce("n", F.lit(0)), "h") - F.col("h")).alias("shift")).where("shift < 0")
    own = turns.where(F.col("at") > copied("conv_id")).join(shift, "conv_id", "left")
    own = own.select("conv_id", (F.col("at") + F.coalesce("shift", F.lit(0))).alias("depth"), "digest", "bytes")
    return taken.unionByName(own), convs.select("conv_id")


def _rollup(path: DataFrame, deepest: int, height: int) -> DataFrame:
    """(conv_id, depth, id1, id2, leaf, saved, own) of whole paths -> per node sums of its subtree, and the smallest conversation that owns it."""
    sums = ("leaf", "saved", "own")
    banded = path.withColumn("band", F.expr(f"depth div {height}"))
    if deepest >= height:
        roots = banded.groupBy("conv_id", "band").agg(F.min_by(F.struct("id1", "id2"), "depth").alias("id"), *(F.sum(c).alias(c) for c in sums))
        roots = roots.select("conv_id", F.col("band").alias("depth"), "id.*", *sums)
        done = _rollup(materialise(roots, "bands"), deepest // height, height).where("depth > 0")
        above = done.select(F.col("owner").alias("conv_id"), (F.col("depth") * height - 1).alias("depth"), *(F.lit(None).cast("long").alias(c) for c in ("id1", "id2")), "leaf", "saved", F.lit(0).cast("long").alias("own"))
        banded = path.unionByName(above).withColumn("band", F.expr(f"depth div {height}"))
    # A path has at most ``height`` nodes in a band, and one total from below.
    groups = banded.groupBy("conv_id", "band").agg(F.collect_list(F.struct("depth", "id1", "id2", *sums)).alias("all"))

    def under(x: Column, c: str) -> Column:
        return F.aggregate(F.filter("all", lambda y: y["depth"] >= x["depth"]), F.lit(0).cast("long"), lambda total, y: total + y[c]).alias(c)

    parts = F.transform(F.filter("all", lambda x: x["id1"].isNotNull()), lambda x: F.struct(x["depth"].alias("depth"), x["id1"].alias("id1"), x["id2"].alias("id2"), *(under(x, c) for c in sums)))
    partial = groups.select("conv_id", F.explode(parts).alias("node")).select("conv_id", "node.*").where("leaf > 0 or saved > 0 or own > 0")
    return materialise(partial.groupBy(NODE).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"), F.min(F.when(F.col("own") > 0, F.col("conv_id"))).alias("owner"), F.lit(0).cast("long").alias("own")), "totals")


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined conversations that end at a node; numbers travel in blocks, and the hash from block to block."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = ends.groupBy(*NODE, F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(ids.cast("binary").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        for batch in batches:
            done = []
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in NODE), raw(batch, "ids")):
                if node != last:
                    if last is not None:
                        done.append((*last, total.hexdigest()))
                    last, total = node, hashlib.sha256(ids)
                else:
                    total.update(b"," + ids)
            if done:
                yield emit(_ENDS, **dict(zip(_ENDS.names, map(list, zip(*done)))))
        if last is not None:
            yield emit(_ENDS, **dict(zip(_ENDS.names, ([v] for v in (*last, total.hexdigest())))))

    return blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block").mapInArrow(run, "depth long, id1 long, id2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per node of the trie of (conv_id, depth, digest, bytes) sequences, the textless root included.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (summed
    over the subtree: members but one, times the bytes of the last turn), ends_sha256. ``convs`` has
    every conversation once, those without turns too; they are members of the root only. Without
    any conversation there is no node.
    """
    if height < 2:
        raise ValueError("a band has two levels at least")
    hashed = turns.select("conv_id", "depth", "bytes", F.xxhash64("depth", "digest").alias("z1"), F.xxhash64("digest", "depth").alias("z2"))
    hashed = hashed.withColumns({"id1": F.col("z1"), "id2": F.col("z2")})
    path = running(hashed, [F.col("depth")], ("id1", "id2")).drop("at")
    none = F.lit(0).cast("long")
    path = path.unionByName(convs.select("conv_id", *(none.alias(c) for c in ("depth", "bytes", "z1", "z2", "id1", "id2"))))
    nodes = path.groupBy(NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *(F.max(c).alias(c) for c in ("bytes", "z1", "z2")))
    nodes = materialise(nodes, "nodes")
    deepest, root = nodes.agg(F.max("depth"), F.min("conv_id")).first()
    up = [(F.col("depth") - 1).alias("depth"), F.col("id1").bitwiseXOR(F.col("z1")).alias("id1"), F.col("id2").bitwiseXOR(F.col("z2")).alias("id2")]
    children = nodes.where("depth > 0").select(*up).groupBy(NODE).agg(F.count("*").alias("n_children"))
    nodes = materialise(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", none)), "nodes")
    # From where a conversation is the smallest member, it is so in all deeper nodes of its path: only the first of them has another one's node above.
    first = nodes.where("depth > 0").groupBy("conv_id").agg(F.min_by(F.struct(*NODE, F.struct(*up).alias("up")), "depth").alias("entry")).select("entry.*")
    # Most of these hang on the root, which needs no join.
    owner = nodes.select(F.struct(*NODE).alias("up"), F.col("conv_id").alias("parent"))
    entries = first.where("depth > 1").join(owner, "up").select(*NODE, "parent")
    entries = entries.unionByName(first.where("depth = 1").select(*NODE, F.lit(root).cast("long").alias("parent")))
    own = nodes.select("conv_id", "depth", F.lit(1).cast("long").alias("own"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    paths = path.join(own, ["conv_id", "depth"], "left").select("conv_id", *NODE, *(F.coalesce(c, none).alias(c) for c in ("leaf", "saved", "own")))
    totals = _rollup(paths, deepest or 0, height).select(*NODE, F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    ends = path.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("end")).select("conv_id", "end.*")
    out = nodes.join(totals, NODE).join(entries, NODE, "left").join(_digests(ends), NODE, "left")
    return out.select(
        "conv_id",
        "depth",
        F.coalesce("parent", F.when(F.col("depth") > 0, F.col("conv_id"))).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The trie of conversations as they are: see ``sequences`` and ``prefix_trie``."""
    turns = sequences(rows)
    return prefix_trie(turns.withColumnRenamed("at", "depth"), turns.where("at = 1").select("conv_id"), height)
