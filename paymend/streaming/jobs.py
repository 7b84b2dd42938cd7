"""Streaming jobs. Each micro-batch runs the batch operators; what must outlive a
batch is keyed stream state or a small table on shared storage, so a lost executor or a
replayed batch changes nothing."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paymend.operators import drift, experiments, health
from paymend.operators.ranks import running_index
from paymend.plans.decision import audit_rows, decide, review_rows, shadow_rows
from paymend.policy import DEFAULT_POLICY, Policy
from paymend.sources import envelope
from paymend.streaming.io import run_batches
from paymend.streaming.locks import TtlLocks
from paymend.streaming.stores import BatchTable, MergedTable

MAX_RETRIES = 3
BACKOFF_BASE = 2
#: Part numbers that a micro-batch has for itself and the retry rounds after it.
ROUNDS = 1000

BODY = (
    "order_id string, amount_paise bigint, currency string, failure_code string, failure_reason string, "
    "event_epoch bigint, merchant_id string"
)
_FIELDS = tuple(field.split()[0] for field in BODY.split(", "))
_INPUT = ("payment_id", *_FIELDS, "created_at", "attempt")
_DECIDED = (
    *_INPUT, "recovery_attempts", "failure_category", "score", "arm", "action", "source", "discount_pct", "review_reason",
    "recoverable_amt", "total_cost", "ev_rupees", "ev_decision", "ev_reason", "final_status",
)


class DecisionTables(NamedTuple):
    """What the decision job has written so far."""

    decisions: DataFrame
    rejects: DataFrame
    audit: DataFrame
    reviews: DataFrame
    shadow: DataFrame


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("payment_id").agg(F.sum("n").cast("bigint").alias("n"))


def decision_stream(
    raw: DataFrame,
    label: str = "decisions",
    policy: Policy = DEFAULT_POLICY,
    text: str = "raw",
    event_time: str = "received_at",
    ttl_seconds: int = 86400,
    attempts: DataFrame | None = None,
    failed: Column | None = None,
    seconds_per_batch: int = 1,
    start: int = 0,
) -> DecisionTables:
    """Envelopes in; decisions, dead letters, audit, review and shadow rows out.

    Accepted events pass the payment id's time-to-live lock once, then are
    decided by the same plan as in batch, with the attempts made so far: those
    of ``attempts`` (payment_id, recovery_attempts) and the actions this job
    triggered in earlier batches, kept as one merged count per payment. Rejected
    ones all go to the dead-letter table with payload, reason, attempt, time and
    tenant. ``failed`` may say which decided rows could not be carried out (it
    may use ``attempt``): these wait 2^attempt seconds and are decided again,
    and after the third retry they are dead letters too. A batch is stored
    before it is worked on, and every table has a part per batch, so a replay
    or a restart at any point ends with the same tables.
    """
    spark = raw.sparkSession
    table = lambda name: BatchTable(spark, f"{label}{name}")
    intake, decisions, rejects = table("-intake"), table(""), table("-rejects")
    audit, reviews, shadow = table("-audit"), table("-reviews"), table("-shadow")
    made = MergedTable(spark, f"{label}-attempts", _added)
    locks = TtlLocks(spark, f"{label}-seen", "payment_id", event_time, "body", ttl_seconds)
    queue = RetryQueue(spark, label, seconds_per_batch, start) if failed is not None else None
    merchant = F.col("merchant_id") if "merchant_id" in raw.columns else F.lit("default")
    attempt = F.col("attempt").cast("int") if "attempt" in raw.columns else F.lit(0)

    parsed = envelope.parse_events(raw, text).withColumn("merchant_id", merchant)
    good = parsed.filter("outcome = 'accepted'").select("payment_id", event_time, F.to_json(F.struct(*_FIELDS)).alias("body"))
    bad = parsed.filter("outcome = 'rejected'").select(
        F.struct(
            F.col(text).alias("payload"), F.col("reject_reason").alias("reason"), attempt.alias("attempt"),
            F.col(event_time).cast("timestamp_ntz").alias("failed_at"), "merchant_id",
        ).alias("bad")
    )
    stream = locks.guard(good).unionByName(bad, allowMissingColumns=True)

    def work_on(new: DataFrame, lost: DataFrame | None, number: int, now: int) -> None:
        work, rest = (new, None) if queue is None else queue.due(new, number, now)
        known = _attempts_before(work, attempts, made.read(number))
        planned = decide(known, policy).select(*_DECIDED).withColumn("_failed", F.lit(False) if failed is None else F.coalesce(failed, F.lit(False)))
        decisions.write(planned, number)
        stored = decisions.part(number)
        done = stored.filter("not _failed")
        audit.write(audit_rows(done, policy), number)
        reviews.write(review_rows(done), number)
        shadow.write(shadow_rows(done, policy), number)
        made.write(_added(done.filter("final_status = 'ACTION_TRIGGERED'").select("payment_id", F.lit(1).alias("n"))), number)
        if queue is not None:
            again, dead = retry_split(stored.filter("_failed").select(*_INPUT), F.lit(now).cast("bigint"))
            spent = dead.select(
                F.to_json(F.struct(*_INPUT)).alias("payload"), F.lit("retries used up").alias("reason"), "attempt",
                F.col("created_at").cast("timestamp_ntz").alias("failed_at"), "merchant_id",
            )
            lost = spent if lost is None else lost.unionByName(spent)
        if lost is not None:
            rejects.write(lost, number)
        if queue is not None:
            queue.settle(again, rest, number, now)

    def step(batch: DataFrame, batch_id: int) -> None:
        number = batch_id * ROUNDS
        # The batch holds what the state has let through, so it is run once only.
        intake.write(batch, number)
        rows = intake.part(number)
        intake.forget(number)
        if batch_id and rows.isEmpty():
            return
        body = F.from_json("body", BODY).alias("b")
        once = locks.pass_through(rows.filter("bad is null"), number).select("payment_id", body).select(
            "payment_id", "b.*", F.timestamp_seconds("b.event_epoch").alias("created_at"), F.lit(0).alias("attempt")
        )
        now = start + batch_id * seconds_per_batch
        work_on(once, rows.filter("bad is not null").select("bad.*"), number, now if queue is None else queue.now(now))

    run_batches(stream, step, label)
    while queue is not None and (later := queue.later()) is not None:
        work_on(queue.nothing(), None, *later)
    tables = [t.read() for t in (decisions, rejects, audit, reviews, shadow)]
    if tables[0] is None:
        raise ValueError("no batch of this job has ended yet")
    tables[0] = tables[0].filter("not _failed").drop("_failed")
    return DecisionTables(*(t.drop("batch_id") for t in tables))


def _attempts_before(work: DataFrame, known: DataFrame | None, made: DataFrame | None) -> DataFrame:
    """``work`` with the attempts per payment: those known from outside and the actions triggered since."""
    parts = []
    if known is not None:
        parts.append(known.select("payment_id", F.col("recovery_attempts").cast("bigint").alias("n")))
    if made is not None:
        parts.append(made)
    if not parts:
        return work.withColumn("recovery_attempts", F.lit(0))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # Only the payments at hand are summed.
    counts = _added(rows.join(work.select("payment_id"), "payment_id", "left_semi"))
    return work.join(counts, "payment_id", "left").withColumn("recovery_attempts", F.coalesce("n", F.lit(0)).cast("int")).drop("n")


def replayable(rejects: DataFrame, limit: int = MAX_RETRIES) -> DataFrame:
    """Dead letters to put back into the input, one attempt higher, while attempts are left."""
    return rejects.filter(F.col("attempt") + 1 <= limit).select(
        F.col("payload").alias("raw"), (F.col("attempt") + 1).alias("attempt"), F.col("failed_at").alias("received_at"), "merchant_id"
    )


def first_seen_stream(
    events: DataFrame, key: str, at: str, event: str, ttl_seconds: int = 86400, label: str = "first-seen", progress: list | None = None
) -> DataFrame:
    """Time-to-live idempotency on a stream: the rows that are not repeats. ``progress`` takes the query's progress reports."""
    locks = TtlLocks(events.sparkSession, label, key, at, event, ttl_seconds)
    intake = BatchTable(events.sparkSession, f"{label}-intake")

    def step(batch: DataFrame, batch_id: int) -> None:
        # The batch holds what the state has let through, so it is run once only.
        intake.write(batch, batch_id)
        locks.pass_through(intake.part(batch_id), batch_id)
        intake.forget(batch_id)

    ended = run_batches(locks.guard(events), step, label)
    if progress is not None:
        progress.extend(ended.recentProgress)
    return locks.all()


def recent_only(events: DataFrame, key: str, at: str, within: str = "24 hours") -> DataFrame:
    """The built-in approximation: first event per key until the watermark passes it."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def minute_counters(events: DataFrame, at: str, width: str = "1 minute", by: tuple[str, ...] = (),
                    amount: str = "amount_paise", label: str = "counters") -> DataFrame:
    """Tumbling counts and sums, whatever the order in which the events come.

    A part holds what one micro-batch adds to its windows, and parts are merged:
    no window is ever closed, so no event is too late.
    """
    keys = ["window_start", *by]
    added = lambda rows: rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("amount_paise").alias("amount_paise"))
    table = MergedTable(events.sparkSession, label, added)

    def step(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(F.window(at, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("amount_paise"))
        table.write(counts.select(F.col("w.start").alias("window_start"), *by, "n", "amount_paise"), batch_id)

    run_batches(events, step, label)
    return table.read()


def bandit_stream(updates: DataFrame, label: str = "bandit", **names) -> DataFrame:
    """Posterior per (arm, context): each micro-batch adds its wins, losses and pulls to those before."""
    keys = ("arm", "context")
    counts = ("won", "lost", "pulls")
    added = lambda rows: rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counts))
    table = MergedTable(updates.sparkSession, label, added)

    def step(batch: DataFrame, batch_id: int) -> None:
        new = experiments.posteriors(batch, **names)
        table.write(new.select(*keys, (F.col("alpha") - 1).alias("won"), (F.col("beta") - 1).alias("lost"), "pulls"), batch_id)

    run_batches(updates, step, label)
    alpha, beta = F.col("won") + 1, F.col("lost") + 1
    return table.read().select(*keys, alpha.alias("alpha"), beta.alias("beta"), "pulls", (alpha / (alpha + beta)).alias("mean"))


def drift_stream(
    calls: DataFrame, reference: DataFrame | drift.Sketch, key: str, order: str, code: str, amount: str,
    window: int = 500, every: int = 200, label: str = "drift",
) -> DataFrame:
    """Drift checks every ``every`` calls over the last ``window``, across micro-batches.

    State per group: the last ``window - 1 + every`` calls. They are put in
    front of the new ones, and the checks they already took part in are left out.
    The reference sample is read once, not per batch; a ``drift.reference_sketch``
    kept under its version's name is not read from the sample again by any run.
    """
    spark = calls.sparkSession
    sketch = reference if isinstance(reference, drift.Sketch) else drift.reference_sketch(reference, key, code, amount)
    found, tails = BatchTable(spark, label), BatchTable(spark, f"{label}-tails")
    keep = -(-(window - 1 + every) // every) * every

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(key, order, code, amount, F.lit(True).alias("_new"))
        held = tails.last_before(batch_id)
        if held is not None:
            rows = rows.unionByName(held.select(key, order, code, amount, F.lit(False).alias("_new")))
            starts = held.groupBy(key).agg(F.max("skipped").alias("_base"), F.count(F.lit(1)).alias("_old"))
        else:
            starts = rows.groupBy(key).agg(F.lit(0).cast("bigint").alias("_base"), F.lit(0).cast("bigint").alias("_old"))
        checks = drift.monitor(rows, sketch, key, order, code, amount, window, every)
        local = F.col("tick") * every
        old = F.coalesce("_old", F.lit(0))
        base = F.coalesce("_base", F.lit(0))
        checks = checks.join(starts, key, "left").filter(local > old).withColumn(
            "tick", (F.col("tick") + base / every).cast("bigint")
        )
        found.write(checks.drop("_base", "_old"), batch_id)
        # Whole multiples of the check interval are dropped, so that checks stay aligned.
        sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        placed = running_index(rows, [key], order)
        gone = F.greatest(F.lit(0), F.floor((F.col("_n") - keep) / every) * every)
        tail = placed.join(sizes, key).join(starts, key, "left").withColumn("_gone", gone).filter(F.col("position") > F.col("_gone"))
        tails.write(
            tail.select(key, order, code, amount, (base + F.col("_gone")).cast("bigint").alias("skipped")), batch_id
        )
        tails.forget(batch_id)

    run_batches(calls, step, label)
    return found.read().drop("batch_id")


def health_stream(calls: DataFrame, order: str = "call_id", label: str = "health") -> DataFrame:
    """Provider circuit states across micro-batches; one carried row per channel."""
    spark = calls.sparkSession
    states, carries = BatchTable(spark, label), BatchTable(spark, f"{label}-carry")

    def step(batch: DataFrame, batch_id: int) -> None:
        held = carries.last_before(batch_id)
        states.write(health.provider_health(batch, order=order, carry=held), batch_id)
        new = health.carry_of(states.part(batch_id), order)
        if held is not None:
            new = new.unionByName(held.join(new.select("channel"), "channel", "left_anti"))
        carries.write(new, batch_id)
        carries.forget(batch_id)

    run_batches(calls, step, label)
    return states.read().drop("batch_id")


def retry_split(lost: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(pending, dead) of rows that failed: they wait 2^attempt seconds (``not_before``), the fourth failure makes a dead letter."""
    lost = lost.withColumn("attempt", F.col("attempt") + 1)
    wait = F.pow(F.lit(BACKOFF_BASE), F.col("attempt")).cast("bigint")
    return lost.filter(F.col("attempt") <= MAX_RETRIES).withColumn("not_before", now + wait), lost.filter(F.col("attempt") > MAX_RETRIES)


class RetryQueue:
    """Rows that wait for another attempt, and the clock of the job that makes it.

    A round writes its results first, then the clock and last what waits now: only then it has happened.
    Micro-batch b is round b * ROUNDS, and the numbers after it are for the rounds that are
    left when the input ends, so a later run goes on behind them.
    """

    def __init__(self, spark: SparkSession, label: str, seconds_per_batch: int, start: int):
        self.waiting, self.clock = BatchTable(spark, f"{label}-waiting"), BatchTable(spark, f"{label}-clock")
        self.seconds_per_batch, self.start = seconds_per_batch, start

    def now(self, planned: int) -> int:
        """The planned time of a round, or the clock's if that is ahead."""
        done = self.waiting.numbers()
        return max(planned, self.clock.part(done[-1]).first()["now"]) if done else planned

    def due(self, new: DataFrame, number: int, now: int) -> tuple[DataFrame, DataFrame | None]:
        """(new rows and those whose time has come, rows that wait on)."""
        held = self.waiting.last_before(number)
        if held is None:
            return new, None
        return new.unionByName(held.filter(F.col("not_before") <= now).drop("not_before")), held.filter(F.col("not_before") > now)

    def settle(self, again: DataFrame, rest: DataFrame | None, number: int, now: int) -> None:
        self.clock.write(again.sparkSession.range(1).select(F.lit(now).cast("bigint").alias("now")), number)
        self.waiting.write(again if rest is None else again.unionByName(rest), number)
        self.waiting.forget(number)
        self.clock.forget(number)

    def later(self) -> tuple[int, int] | None:
        """(number, time) of the next round without input; None if nothing waits."""
        done = self.waiting.numbers()
        if not done:
            return None
        first = self.waiting.part(done[-1]).agg(F.min("not_before")).first()[0]
        return None if first is None else (done[-1] + 1, max(first, self.clock.part(done[-1]).first()["now"] + 1))

    def nothing(self) -> DataFrame:
        """No rows, with the columns of those that wait."""
        return self.waiting.part(self.waiting.numbers()[-1]).drop("not_before").limit(0)


def retry_stream(
    events: DataFrame, failed: Column, label: str = "retries", seconds_per_batch: int = 1, start: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Process events with bounded retries; returns (done, dead).

    Every micro-batch takes the pending rows that are due along with the new
    ones. When the input ends, rounds go on until nothing is pending: the
    back-off doubles, so that is a handful of rounds.
    """
    spark = events.sparkSession
    done, dead = (BatchTable(spark, f"{label}-{n}") for n in ("done", "dead"))
    queue = RetryQueue(spark, label, seconds_per_batch, start)

    def take(new: DataFrame, number: int, now: int) -> None:
        work, rest = queue.due(new, number, now)
        tried = work.withColumn("_failed", F.coalesce(failed, F.lit(False)))
        done.write(tried.filter("not _failed").drop("_failed"), number)
        again, lost = retry_split(tried.filter("_failed").drop("_failed"), F.lit(now).cast("bigint"))
        dead.write(lost, number)
        queue.settle(again, rest, number, now)

    def step(batch: DataFrame, batch_id: int) -> None:
        take(batch.withColumn("attempt", F.lit(0)), batch_id * ROUNDS, queue.now(start + batch_id * seconds_per_batch))

    run_batches(events, step, label)
    while (later := queue.later()) is not None:
        take(queue.nothing(), *later)
    empty = spark.createDataFrame([], events.schema).withColumn("attempt", F.lit(0))
    return tuple(empty if rows is None else rows.drop("batch_id") for rows in (done.read(), dead.read()))
