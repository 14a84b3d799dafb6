"""Loans followed by a stream: leading purposes, overdue loans, merged decisions."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fathom.operators import applications as apps
from fathom.operators import dashboard
from fathom.streaming import lifecycle
from fathom.streaming import scoring as streaming

START = dt.datetime(2024, 1, 1)
EVENT = "id string, username string, intent string, status string, event_time timestamp"


def at(days):
    return START + dt.timedelta(days=days)


def run_batches(spark, folder, batches, schema, make, start, out, progress):
    """One run of the stream after each batch of rows is written."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        with lifecycle.rocksdb_state(spark):
            start(make(stream), out, progress, once=True).awaitTermination()
    return out


def follow(spark, tmp_path, batches, **settings):
    folder, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    return run_batches(
        spark, folder, batches, EVENT, lambda s: lifecycle.follow(s, **settings), streaming.update_to, out, progress
    )


def test_purposes_equal_the_batch_report_with_repeats_and_any_order(spark, tmp_path):
    loans = []
    for i in range(60):
        status = ("ACCEPTED", "REJECTED", "-")[i % 3]
        loans.append((f"{i}", f"u{i % 4}", ("MEDICAL", "VENTURE", None, "EDUCATION")[i * 7 % 4], status))
    submitted = [(i, u, p, "-", at(0)) for i, u, p, _ in loans]
    decided = [(i, u, p, s, at(0.01)) for i, u, p, s in loans if s != "-"]
    # Decisions before submissions, repeats within and across batches, opposite repeats, a row without id.
    batches = [decided[:20] + submitted[:30], submitted[20:] + decided[10:] + decided[:5], decided + submitted[:9]]
    opposite = [(i, u, p, "REJECTED", at(0.02)) for i, u, p, s in loans if s == "ACCEPTED"]
    batches.append([*opposite, (None, "u0", "VENTURE", "ACCEPTED", at(0.02))])
    out = follow(spark, tmp_path, batches)
    got = sorted(tuple(r) for r in lifecycle.latest_purposes(spark, out).collect())
    frame = spark.createDataFrame(loans, "id string, username string, intent string, status string")
    want = dashboard.top_purpose(frame).select("username", "accepted_purpose", "rejected_purpose")
    named = [(u, a or "N/A", r or "N/A") for u, a, r in want.collect()]
    assert got == sorted(named)
    assert lifecycle.overdue_loans(spark, out).count() == 0


def test_a_pending_loan_is_overdue_once_and_may_still_be_decided(spark, tmp_path):
    batches = [
        [("a", "u", "MEDICAL", "-", at(0)), ("b", "u", "VENTURE", "-", at(0))],
        [("b", "u", "VENTURE", "ACCEPTED", at(2)), ("c", "v", "VENTURE", "-", at(3))],
        # Time passes: a is overdue, c not yet.
        [("x", "w", "MEDICAL", "-", at(9))],
        # A repeat of a is not reported again, and its late decision counts.
        [("a", "u", "MEDICAL", "-", at(9)), ("a", "u", "MEDICAL", "ACCEPTED", at(9)), ("y", "w", "MEDICAL", "-", at(12))],
        [("a", "u", "MEDICAL", "ACCEPTED", at(12))],
        # Behind the watermark by days: dropped.
        [("z", "u", "EDUCATION", "ACCEPTED", at(1))] * 3,
    ]
    out = follow(spark, tmp_path, batches, timeout_ms=7 * lifecycle.DAY)
    overdue = sorted(tuple(r) for r in lifecycle.overdue_loans(spark, out).collect())
    assert overdue == [("u", "a"), ("v", "c")]
    purposes = {r.username: (r.accepted_purpose, r.rejected_purpose) for r in lifecycle.latest_purposes(spark, out).collect()}
    # One accepted loan of each purpose: the smaller name.
    assert purposes == {"u": ("MEDICAL", "N/A"), "v": ("N/A", "N/A"), "w": ("N/A", "N/A")}


APPLICATION = "id string, username string, status string, loan_grade string, submitted_at timestamp"
DECISION = "id string, status string, loan_grade string, decided_at timestamp"


def merged(spark, tmp_path, batches, **settings):
    folders = [str(tmp_path / n) for n in ("applications", "decisions")]
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    for batch in batches:
        for rows, schema, folder in zip(batch, (APPLICATION, DECISION), folders):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        streams = [spark.readStream.schema(s).parquet(f) for s, f in zip((APPLICATION, DECISION), folders)]
        streaming.append_to(lifecycle.merge_decisions(*streams, **settings), out, progress, once=True).awaitTermination()
    return spark.read.schema(APPLICATION).parquet(out)


def test_merged_stream_equals_the_batch_merge(spark, tmp_path):
    waiting = [(f"{i}", f"u{i % 3}", "-", "-", at(i / 10)) for i in range(40)]
    made = [(f"{i}", "ACCEPTED" if i % 4 else "REJECTED", "ABCDEFG"[i % 7], at(i / 10 + 0.5)) for i in range(0, 40, 3)]
    end = at(100)
    batches = [
        (waiting[:25], made[:5] + made[:2]),
        # The rest, repeats of both, a decision of no application, one that is too early and one too late.
        (waiting[25:] + waiting[23:25], made[5:] + [("none", "ACCEPTED", "A", at(4)), ("37", "REJECTED", "B", at(0))]),
        ([("end", "", "-", "-", end)], [("38", "REJECTED", "B", at(30)), ("end", "-", "-", end)]),
    ]
    got = merged(spark, tmp_path, batches, wait="10 days").filter("id <> 'end'")
    rows = sorted(tuple(r)[:4] for r in got.collect())
    frame = spark.createDataFrame(waiting, APPLICATION)
    scores = spark.createDataFrame(made, DECISION).drop("decided_at")
    want = apps.merge_scores(frame, scores).select("id", "username", "status", "loan_grade")
    assert rows == sorted(tuple(r) for r in want.collect())
    assert len(rows) == 40


def test_an_open_application_waits_for_its_time(spark, tmp_path):
    batches = [
        ([("a", "u", "-", "-", at(0))], [("b", "ACCEPTED", "A", at(0))]),
        ([("c", "u", "-", "-", at(5))], [("c", "ACCEPTED", "B", at(5))]),
    ]
    rows = [r.id for r in merged(spark, tmp_path, batches, wait="10 days").collect()]
    assert rows == ["c"]


def test_columns_must_be_known(spark):
    with pytest.raises(ValueError, match="lack"):
        lifecycle.merge_decisions(
            spark.createDataFrame([], APPLICATION), spark.createDataFrame([], DECISION).withColumn("more", F.lit(1))
        )


class Held:
    """A map state that counts the messages it would send."""

    def __init__(self):
        self.values, self.messages = {}, 0

    def getValue(self, key):
        self.messages += 1
        return self.values.get(key)

    containsKey = getValue

    def updateValue(self, key, value):
        self.messages += 1
        self.values[key] = value

    def removeKey(self, key):
        self.messages += 1
        del self.values[key]

    def iterator(self):
        return iter(list(self.values.items()))


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Held())

    def registerTimer(self, ms):
        self.timers.append(ms)


def test_many_loans_of_a_user_need_few_messages_to_the_state():
    handle, processor = Handle(), lifecycle.Lifecycle(10, 30)
    processor.init(handle)
    statuses = ("ACCEPTED", "REJECTED", "-")
    rows = [Row(id=str(i), intent="MEDICAL", status=statuses[i % 3], event_ms=5) for i in range(30_000)]
    first = list(processor.handleInputRows(("u",), iter(rows + rows[:1000]), None))
    assert [(r.kind, r.accepted_purpose) for r in first] == [("purpose", "MEDICAL")]
    assert sum(s.messages for s in handle.states.values()) < 3000 and sorted(handle.timers) == [15, 35]
    assert handle.states["counts"].values == {("ACCEPTED", "MEDICAL"): (10_000,), ("REJECTED", "MEDICAL"): (10_000,)}
    late = list(processor.handleExpiredTimer(("u",), None, Expired(15)))
    assert len(late) == 10_000 == len({r.id for r in late})
    assert list(processor.handleExpiredTimer(("u",), None, Expired(20))) == []
    # Counted ones are still known, and late ones may be decided, until all are forgotten.
    again = [Row(id=str(i), intent="VENTURE", status="ACCEPTED", event_ms=6) for i in (0, 1, 2)]
    list(processor.handleInputRows(("u",), iter(again), None))
    assert handle.states["counts"].values[("ACCEPTED", "VENTURE")] == (1,)
    list(processor.handleExpiredTimer(("u",), None, Expired(36)))
    assert handle.states["loans"].values == {}


class Expired:
    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):
        return self.ms
