"""Time-to-live locks as keyed stream state that expires."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paymend.operators import locks
from paymend.streaming.stores import BatchTable

#: Lifetimes in one folder of the table of kept events, buckets of keys (a bucket's new events are in memory at once), and
#: what stands for no time. A checkpoint keeps the number of buckets it began with, so it is not to be read with another.
SPAN, BUCKETS, NO_TIME = 366, 256, -(1 << 62)


def walk(times: Sequence[int], lock: int | None, doubt: int | None, ttl: int, watermark: int) -> tuple[list[int], list[int], int | None, int | None]:
    """(events that pass, events to look up, lock, doubt) for one key's distinct times in order.

    ``lock`` is the last event let through in order, ``doubt`` the last one left to be looked up. An event up to the
    lock, one that an event in doubt may stand for, and one of a key without state from before the
    watermark by a lifetime or more, are to be looked up: no state tells what was kept around them.
    """
    n = len(times)
    i = 0 if lock is None else bisect_right(times, lock)
    passed, asked = [], list(range(i))
    while i < n:
        t = int(times[i])
        if lock is not None and t < lock + ttl:
            i = bisect_left(times, lock + ttl, i)
            continue
        if (doubt is not None and t < doubt + ttl) or (lock is None and t <= watermark - ttl):
            asked.append(i)
            doubt = t if doubt is None else max(doubt, t)
        else:
            passed.append(i)
            lock = t
        i += 1
    return passed, asked, lock, doubt


def settle(rows: pd.DataFrame, live: pd.DataFrame, key: str, event: str, ttl: int, watermark: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(rows to pass or look up with ``sure``, locks that go on) of a bucket's new events and live locks (key, lock, doubt).

    A lock goes two lifetimes after the key's last event has fallen behind the watermark: by then any event that it
    could hold back would be looked up anyway.
    """
    rows, codes, keys = _in_order(rows, key, event)
    held = pd.Index(live[key]).get_indexer(pd.Index(keys)) if len(live) else np.full(len(keys), -1)
    locks_, doubts = live["lock"].to_numpy(), live["doubt"].to_numpy()
    times, stops = rows["_t"].to_numpy(), np.searchsorted(codes, np.arange(1, len(keys) + 1))
    starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)
    new_locks, new_doubts = np.full(len(keys), NO_TIME, np.int64), np.full(len(keys), NO_TIME, np.int64)
    # Most keys have one event and no state; they need no walk.
    plain = (stops - starts == 1) & (held < 0)
    lone = starts[plain]
    fresh = times[lone] > watermark - ttl
    new_locks[plain] = np.where(fresh, times[lone], NO_TIME)
    new_doubts[plain] = np.where(fresh, NO_TIME, times[lone])
    found, sure = [], []
    for k in np.flatnonzero(~plain).tolist():
        start, at = int(starts[k]), int(held[k])
        lock, doubt = (None, None) if at < 0 else (_time(locks_[at]), _time(doubts[at]))
        passed, asked, lock, doubt = walk(times[start : stops[k]], lock, doubt, ttl, watermark)
        found += [start + i for i in passed + asked]
        sure += [True] * len(passed) + [False] * len(asked)
        new_locks[k] = NO_TIME if lock is None else lock
        new_doubts[k] = NO_TIME if doubt is None else doubt
    found, sure = np.concatenate([lone, np.array(found, np.int64)]), np.concatenate([fresh, np.array(sure, bool)])
    now = pd.DataFrame({key: pd.Series(keys, dtype=rows[key].dtype), "lock": new_locks, "doubt": new_doubts}).astype({"lock": "int64", "doubt": "int64"})
    if len(live):
        rest = np.ones(len(live), bool)
        rest[held[held >= 0]] = False
        now = pd.concat([now, live[rest]], ignore_index=True) if rest.any() else now
    last = np.maximum(now["lock"].to_numpy(), now["doubt"].to_numpy())
    return rows.iloc[found][[key, "_t", event]].assign(sure=sure), now[last + 2 * ttl > watermark]


def _in_order(rows: pd.DataFrame, key: str, event: str) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """(rows by key and time, the smallest event of each; the number of each row's key; keys by number). Only events of one key and time are sorted."""
    codes, keys = pd.factorize(rows[key], use_na_sentinel=False)
    times = rows["_t"].to_numpy()
    order = np.lexsort((times, codes))
    codes, times = codes[order], times[order]
    same = (codes[1:] == codes[:-1]) & (times[1:] == times[:-1])
    if same.any():
        tied = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        events = pd.DataFrame({"code": codes[tied], "time": times[tied], "event": rows[event].iloc[order[tied]].to_numpy()})
        order[tied] = order[tied][events.sort_values(["code", "time", "event"]).index]
        first = np.concatenate([[True], ~same])
        order, codes = order[first], codes[first]
    return rows.iloc[order], codes, keys


def _time(time: int) -> int | None:
    return None if time == NO_TIME else int(time)


def guarded(events: DataFrame, key: str, at: str, event: str, ttl_seconds: int, buckets: int = BUCKETS) -> DataFrame:
    """A stream of (key, at in microseconds, event) with ``sure``: False for events that must be looked up.

    State is a row per bucket of keys with the live locks in it, two numbers a key; some ten thousand
    live keys a bucket are a good size. A bucket in which nothing is left is removed by a timer. The
    watermark comes from a copy of each event's time that is taken out again, so that late events are not dropped.
    """
    ttl = ttl_seconds * 1_000_000

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames))
        if state.exists:
            live = pa.ipc.open_stream(bytes(state.get[0])).read_pandas()
        else:
            live = pd.DataFrame({key: rows[key].iloc[:0], "lock": np.empty(0, np.int64), "doubt": np.empty(0, np.int64)})
        watermark = state.getCurrentWatermarkMs()
        out, live = settle(rows, live, key, event, ttl, watermark * 1000)
        if len(live):
            batch = pa.RecordBatch.from_pandas(live, preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            state.update((sink.getvalue().to_pybytes(),))
            last = int(max(live["lock"].max(), live["doubt"].max()))
            state.setTimeoutTimestamp(max((last + 2 * ttl) // 1000 + 1, watermark + 1))
        elif state.exists:
            state.remove()
        yield out

    time = F.col(at).cast("timestamp")
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_bucket")
    rows = events.select(bucket, key, F.unix_micros(time).alias("_t"), event, F.explode(F.array(F.lit(None).cast("timestamp"), time)).alias("_clock"))
    rows = rows.withWatermark("_clock", "0 seconds").where("_clock is null and _t is not null")
    kinds = dict(rows.dtypes)
    return rows.groupBy("_bucket").applyInPandasWithState(
        run, f"`{key}` {kinds[key]}, _t bigint, `{event}` {kinds[event]}, sure boolean", "live binary", "append", GroupStateTimeout.EventTimeTimeout
    )


class TtlLocks:
    """Time-to-live locks across micro-batches, exact also for events that come late.

    Events in order are decided by keyed state (``guarded``). One that comes after later ones of its
    key passes if it lies the time to live or more from every event kept before, on both sides;
    else one of them stands for it, as what was let through is not taken back. Those are looked up
    in the table of kept events, of which only the folders around their times are read.
    """

    def __init__(self, spark: SparkSession, label: str, key: str, at: str, event: str, ttl_seconds: int):
        self.names, self.ttl = (key, at, event), ttl_seconds
        self.kept = BatchTable(spark, label)

    def guard(self, events: DataFrame) -> DataFrame:
        key, at, event = self.names
        return guarded(events, key, at, event, self.ttl)

    def pass_through(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Rows ``key, at, event`` that are not repeats, of a stored batch of ``guard``."""
        key, at, event = self.names
        rows = batch.select(key, F.timestamp_micros("_t").cast("timestamp_ntz").alias(at), event, "sure", "_t")
        out = rows.filter("sure").select(key, at, event)
        late = rows.filter("not sure")
        first, last = late.agg(F.min("_t"), F.max("_t")).first()
        if first is not None:
            out = out.unionByName(self._looked_up(late, first, last, batch_id))
        span = F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / (SPAN * self.ttl)).alias("span")
        self.kept.write(out.select("*", span), batch_id, ("span",))
        return self.kept.part(batch_id).select(key, at, event)

    def _looked_up(self, late: DataFrame, first: int, last: int, batch_id: int) -> DataFrame:
        key, at, event = self.names
        ttl = self.ttl * 1_000_000
        free = late.drop("sure")
        kept = self.kept.read(batch_id)
        if kept is not None:
            near = kept.filter(F.col("span").between((first - ttl) // (SPAN * ttl), (last + ttl) // (SPAN * ttl)))
            # Kept events of a key are a lifetime apart, so an event meets at most one in its own stretch of time and one in each beside it.
            micros = F.unix_micros(F.col(at).cast("timestamp"))
            slot = F.floor(F.col("_kept") / ttl)
            near = near.select(F.col(key).alias("_key"), micros.alias("_kept")).select("*", F.explode(F.array(slot - 1, slot, slot + 1)).alias("_near"))
            close = F.col(key).eqNullSafe(F.col("_key")) & (F.floor(F.col("_t") / ttl) == F.col("_near")) & (F.abs(F.col("_t") - F.col("_kept")) < ttl)
            free = free.join(near, close, "left_anti")
        return locks.first_seen(free.select(key, at, event), key, at, event, self.ttl)

    def all(self) -> DataFrame | None:
        rows = self.kept.read()
        return None if rows is None else rows.drop("batch_id", "span")
