"""Loans followed through their life: purposes that lead so far, overdue applications, decisions merged.

Events of a loan are (id, username, intent, status, event_time); a loan is submitted with the
status of a pending one and decided later. Events may be repeated and come in any order within the
watermark's delay.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fathom import domain
from fathom.operators.dashboard import DECIDED
from fathom.sources.shipping import ship
from fathom.streaming.scoring import first_arrivals

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000
OUTPUT = "username string, kind string, id string, accepted_purpose string, rejected_purpose string"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which map state and timers ask for."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


# What a slot holds of a loan: [state, ms], with the time it was submitted or is to be forgotten.
WAITING, TOLD, COUNTED = 0, 1, 2
# Slots of a user, and the most rows worked on before their slots are written.
SLOTS, HELD_ROWS = 1024, 100_000


class Lifecycle(StatefulProcessor):
    """State of one user.

    ``counts``: decided loans by status and purpose, as many entries as there are purposes.
    ``loans``: by slot of the id's hash, the ids of pending loans, until they are decided or
    forgotten, and those that were counted, so that repeats are not; forgotten after a time.

    A slot is read and written once for many rows: each access is a message to the state server.
    """

    def __init__(self, timeout_ms: int, remember_ms: int, slots: int = SLOTS, held_rows: int = HELD_ROWS):
        self.timeout_ms, self.remember_ms = timeout_ms, remember_ms
        self.slots, self.held_rows = slots, held_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "status string, intent string", "n bigint")
        self.loans = handle.getMapState("loans", "slot int", "held string")

    def _note(self, rows: list[Row], more: dict[tuple, int], timers: set[int]) -> None:
        """Bring the slots of the rows up to date, in the order of the rows."""
        by_slot: dict[int, list[Row]] = {}
        for row in rows:
            by_slot.setdefault(zlib.crc32(row.id.encode()) % self.slots, []).append(row)
        for slot, some in by_slot.items():
            text = self.loans.getValue((slot,))
            loans = json.loads(text[0]) if text else {}
            changed = False
            for row in some:
                known = loans.get(row.id)
                if known and known[0] == COUNTED:
                    continue
                if row.status == domain.PENDING:
                    if not known:
                        loans[row.id] = [WAITING, row.event_ms]
                        timers |= {row.event_ms + self.timeout_ms, row.event_ms + self.remember_ms}
                        changed = True
                elif row.status in DECIDED:
                    loans[row.id] = [COUNTED, row.event_ms + self.remember_ms]
                    timers.add(row.event_ms + self.remember_ms)
                    of = (row.status, row.intent)
                    more[of] = more.get(of, 0) + 1
                    changed = True
            if changed:
                self.loans.updateValue((slot,), (json.dumps(loans),))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        more: dict[tuple, int] = {}
        timers: set[int] = set()
        while some := list(islice(rows, self.held_rows)):
            self._note(some, more, timers)
        for ms in timers:
            self.handle.registerTimer(ms)
        for of, n in more.items():
            held = self.counts.getValue(of)
            self.counts.updateValue(of, (n + (held[0] if held else 0),))
        best: dict[str, tuple] = {}
        for of, n in self.counts.iterator():
            # Most loans first, then the smaller name, a missing one before all.
            rank = (-n[0], of[1] is not None, of[1] or "")
            if of[0] not in best or rank < best[of[0]][0]:
                best[of[0]] = (rank, of[1])
        leading = [best[s][1] if s in best and best[s][1] is not None else "N/A" for s in DECIDED]
        yield Row(username=key[0], kind="purpose", id=None, accepted_purpose=leading[0], rejected_purpose=leading[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        changed = {}
        for slot, text in self.loans.iterator():
            loans = json.loads(text[0])
            kept, late = {}, []
            for loan, (state, ms) in loans.items():
                if state == WAITING and ms + self.timeout_ms <= now:
                    late.append(loan)
                    state = TOLD
                if (ms if state == COUNTED else ms + self.remember_ms) > now:
                    kept[loan] = [state, ms]
            for loan in late:
                yield Row(username=key[0], kind="overdue", id=loan, accepted_purpose=None, rejected_purpose=None)
            if kept != loans:
                changed[slot[0]] = json.dumps(kept) if kept else None
        for slot, text in changed.items():
            if text:
                self.loans.updateValue((slot,), (text,))
            else:
                self.loans.removeKey((slot,))

    def close(self) -> None:
        pass


def follow(
    events: DataFrame,
    event_time: str = "event_time",
    delay: str = "1 hour",
    timeout_ms: int = 7 * DAY,
    remember_ms: int = 30 * DAY,
) -> DataFrame:
    """username, kind, id, accepted_purpose, rejected_purpose as loans are submitted and decided.

    Rows of kind ``purpose`` give a user's most common purposes so far, for every batch with events
    of the user; ties go by name and N/A stands for none, as in the batch report. Rows of kind
    ``overdue`` name loans, each once, that were pending for ``timeout_ms`` of event time. The
    first decision of a loan counts; repeats within ``remember_ms`` do not, and a submission that
    comes after its decision changes nothing. Events behind the watermark are dropped by Spark.

    State per user: counts by purpose, ids of pending loans, and ids decided within
    ``remember_ms``, in slots that are read and written once for many rows. Write the result in update mode, under ``rocksdb_state``.
    """
    ship(events.sparkSession)
    timed = events.select(
        "username",
        F.col("id").cast("string").alias("id"),
        "intent",
        "status",
        F.unix_millis(event_time).alias("event_ms"),
        F.col(event_time).alias("event_time"),
    ).filter("id IS NOT NULL AND event_time IS NOT NULL")
    processor = Lifecycle(timeout_ms, max(remember_ms, timeout_ms))
    by_user = timed.withWatermark("event_time", delay).groupBy("username")
    return by_user.transformWithState(processor, OUTPUT, "Update", "eventTime")


def latest_purposes(spark: SparkSession, path: str) -> DataFrame:
    """The newest leading purposes of each user from the folders ``update_to`` wrote."""
    rows = spark.read.parquet(path).filter("kind = 'purpose'")
    newest = rows.groupBy("username").agg(
        F.max_by(F.struct("accepted_purpose", "rejected_purpose"), "batch").alias("newest")
    )
    return newest.select("username", "newest.*")


def overdue_loans(spark: SparkSession, path: str) -> DataFrame:
    """(username, id) of the loans that were reported as overdue."""
    return spark.read.parquet(path).filter("kind = 'overdue'").select("username", "id")


def merge_decisions(
    applications: DataFrame,
    decisions: DataFrame,
    key: str = "id",
    submitted: str = "submitted_at",
    decided: str = "decided_at",
    wait: str = "30 days",
    delay: str = "1 hour",
) -> DataFrame:
    """Each application once, with its decision if one comes within ``wait``, else as it was.

    Both sides are streams with event times. A decision belongs to the application of its key if it
    is made at the submission or up to ``wait`` after it; its columns replace those of the same
    name. Repeats of an application or of a decision within the watermark's delay count once. An
    application without a decision comes out when the watermark passes the end of its wait, so the
    state holds no more than ``wait`` and ``delay`` of both streams.
    """
    updated = [c for c in decisions.columns if c not in (key, decided)]
    unknown = [c for c in updated if c not in applications.columns]
    if unknown:
        raise ValueError(f"decisions have columns the applications lack: {unknown}")
    left = first_arrivals(applications, key, submitted, delay).alias("a")
    right = first_arrivals(decisions, key, decided, delay)
    right = right.select(*(F.col(c).alias(f"_new_{c}") for c in decisions.columns))
    until = F.col(f"a.{submitted}") + F.expr(f"INTERVAL {wait}")
    same = (
        (F.col(f"a.{key}") == F.col(f"_new_{key}"))
        & (F.col(f"_new_{decided}") >= F.col(f"a.{submitted}"))
        & (F.col(f"_new_{decided}") <= until)
    )
    joined = left.join(right, same, "leftOuter")
    return joined.select(
        *(
            F.coalesce(F.col(f"_new_{c}"), F.col(f"a.{c}")).alias(c) if c in updated else F.col(f"a.{c}")
            for c in applications.columns
        )
    )
