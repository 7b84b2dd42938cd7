"""Time-to-live locks over a whole table: one way for all keys, whatever their number of events.

Time is cut into slots one lifetime long and a slot into cells. At most one event of a slot is let
through. The event after it lies in the cell of the same place one slot on, or it is the first
event of a later cell. So a chain of kept events runs down a column (cells of one place) and goes
over to the first event, the head, of another cell. Columns are worked on by themselves, in tasks
that hold a thousandth of a hot key; a key's heads, bounded by its time span and not by its rows,
are then followed from the first one on, and the columns fill in what lies between.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Cells of a slot, and rows that a task gathers before it works on the whole groups among them.
CELLS, GATHER = 1024, 100_000


def _codes(table: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    """The number of its group for each row of a sorted table; a null key is a key."""
    change = np.zeros(table.num_rows, bool)
    for name in names:
        column = table.column(name).combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        code = np.asarray(pc.dictionary_encode(column, null_encoding="encode").indices)
        change[1:] |= code[1:] != code[:-1]
    return np.cumsum(change)


def whole_groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], gather: int = GATHER) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches put together to tables of whole groups, with the number of each row's group."""
    held, size, least = [], 0, gather
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= least:
            table = pa.Table.from_batches(held)
            groups = _codes(table, names)
            cut = int(np.searchsorted(groups, groups[-1]))
            if cut:
                yield table.slice(0, cut), groups[:cut]
            held, size = table.slice(cut).to_batches(), table.num_rows - cut
            least = max(gather, 2 * size)
    if held:
        table = pa.Table.from_batches(held)
        yield table, _codes(table, names)


def _seek(groups: np.ndarray, times: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The first row of each row's group that is not before ``wanted``; the number of rows if there is none. Rows are sorted by group and time."""
    n = len(groups)
    order = np.lexsort((np.repeat([1, 0], n), np.concatenate([times, wanted]), np.concatenate([groups, groups])))
    asked = order >= n
    before = np.cumsum(~asked)[asked]
    out = np.empty(n, np.int64)
    out[order[asked] - n] = before
    good = out < n
    good[good] = groups[out[good]] == groups[good]
    return np.where(good, out, n)


def _links(groups: np.ndarray, times: np.ndarray, slots: np.ndarray, ttl: int) -> np.ndarray:
    """The event of the same column that follows each one, or its own number where the chain leaves the column."""
    n, own = len(groups), np.arange(len(groups))
    at = _seek(groups, times, times + ttl)
    stays = at < n
    stays[stays] = slots[at[stays]] == slots[stays] + 1
    return np.where(stays, at, own)


def _heads(ttl: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in whole_groups(batches, ("_k", "_c")):
            times, slots, cell = (np.asarray(table.column(c)) for c in ("_t", "_s", "_c"))
            last = _links(groups, times, slots, ttl)
            while True:
                further = last[last]
                if (further == last).all():
                    break
                last = further
            head = np.concatenate([[True], (groups[1:] != groups[:-1]) | (slots[1:] != slots[:-1])])
            # The chain goes on after the cell that it did not enter.
            leaves = (slots[last] + 1) * ttl + -(-(cell + 1) * ttl // CELLS)
            out = table.select(["_k", "_c", "_t"]).append_column("_x", pa.array(leaves)).filter(pa.array(head))
            yield from out.to_batches()

    return run


def _visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, groups in whole_groups(batches, ("_k",)):
        target = _seek(groups, np.asarray(table.column("_t")), np.asarray(table.column("_x")))
        seen = np.zeros(table.num_rows, bool)
        at = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        while len(at):
            seen[at] = True
            at = target[at]
            at = at[at < table.num_rows]
        yield from table.select(["_k", "_c", "_t"]).filter(pa.array(seen)).to_batches()


def _filled(ttl: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in whole_groups(batches, ("_k", "_c")):
            # A visited head stands just before its event.
            mark = np.asarray(table.column("_v"))
            start = np.concatenate([[False], mark[:-1]])[~mark]
            rows, groups = table.filter(pa.array(~mark)), groups[~mark]
            links = _links(groups, np.asarray(rows.column("_t")), np.asarray(rows.column("_s")), ttl)
            kept, at = start.copy(), np.flatnonzero(start)
            while len(at):
                after = links[at]
                at = after[(after != at) & ~kept[after]]
                kept[at] = True
            yield from rows.select(["_k", "_t", "_e"]).filter(pa.array(kept)).to_batches()

    return run


def first_seen(df: DataFrame, key: str, at: str, event: str, ttl_seconds: int = 86400) -> DataFrame:
    """Events that a time-to-live idempotency lock lets through.

    The first event of a key passes and locks the key for ``ttl_seconds``; repeats inside the lock
    are dropped; the first event after it passes again. Events with one (key, time) are one event;
    the smallest id stands for them. Rows without a time are left out; a null key is a key.
    """
    ttl = ttl_seconds * 1_000_000
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    events = (
        df.filter(F.col(at).isNotNull())
        .groupBy(F.col(key).alias("_k"), F.unix_micros(F.col(at).cast("timestamp")).alias("_t"))
        .agg(F.min(event).alias("_e"))
    )
    phase = f"pmod(_t, {ttl})"
    events = events.withColumns({"_s": F.expr(f"(_t - {phase}) div {ttl}"), "_c": F.expr(f"({phase} * {CELLS}) div {ttl}")})
    columns = events.select("_k", "_c", "_s", "_t").repartition("_k", "_c").sortWithinPartitions("_k", "_c", "_t")
    heads = columns.mapInArrow(_heads(ttl), f"_k {kind[key]}, _c bigint, _t bigint, _x bigint")
    visited = heads.repartition("_k").sortWithinPartitions("_k", "_t").mapInArrow(_visited, f"_k {kind[key]}, _c bigint, _t bigint")
    marks = visited.select("_k", "_c", F.lit(0).cast("bigint").alias("_s"), "_t", F.lit(None).cast(events.schema["_e"].dataType).alias("_e"), F.lit(True).alias("_v"))
    rows = events.select("_k", "_c", "_s", "_t", "_e", F.lit(False).alias("_v")).unionByName(marks)
    rows = rows.repartition("_k", "_c").sortWithinPartitions("_k", "_c", "_t", F.col("_v").desc())
    kept = rows.mapInArrow(_filled(ttl), f"_k {kind[key]}, _t bigint, _e {events.schema['_e'].dataType.simpleString()}")
    return kept.select(F.col("_k").alias(key), F.timestamp_micros("_t").cast("timestamp_ntz").alias(at), F.col("_e").alias(event))
