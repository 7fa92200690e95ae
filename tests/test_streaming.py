"""Watermarks that go back, timers of silent sources, and state that settles."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import freshness, watermarks

DAY = datetime.date(2024, 3, 1)


def day(k):
    return DAY + datetime.timedelta(days=k)


def land(spark, folder, rows):
    spark.createDataFrame([(s, day(d), v, n, x) for s, d, v, n, x in rows], watermarks.DELIVERY).coalesce(1).write.mode("append").parquet(folder)


def marks(ledger, epoch):
    return {r["source"]: (r["watermark"], r["rewound"], r["reopened"]) for r in ledger.marks(epoch).collect()}


def test_a_restated_day_rewinds_and_comes_back(spark, tmp_path):
    ledger, landing = watermarks.Ledger(spark, f"file://{tmp_path}/ledger"), f"file://{tmp_path}/landing"
    land(spark, landing, [("a", d, 1, 2, 10 * d + k) for d in range(6) for k in range(2)] + [("b", d, 1, 1, 1) for d in (0, 1, 3)] + [("c", 2, 1, 1, 1)])
    first = ledger.run(landing)
    # b lacks a day, and c its first ones
    assert marks(ledger, first) == {"a": (day(5), False, 0), "b": (day(1), False, 0), "c": (None, False, 0)}
    land(spark, landing, [("a", 2, 2, 2, 500), ("b", 2, 1, 1, 7)])
    second = ledger.run(landing)
    assert second == first + 1
    assert marks(ledger, second) == {"a": (day(1), True, 4), "b": (day(3), False, 0), "c": (None, False, 0)}
    final = {(r["source"], r["period"]): (r["n"], r["value"], r["final"]) for r in ledger.gold(second).collect()}
    assert final["a", day(2)] == (1, 500, False) and final["a", day(5)] == (2, 101, False) and final["a", day(1)] == (2, 21, True)
    land(spark, landing, [("a", 2, 2, 2, 501)])
    third = ledger.run(landing)
    assert marks(ledger, third)["a"] == (day(5), False, 0)
    assert {(r["source"], r["period"]): r["value"] for r in ledger.gold(third).collect()}["a", day(2)] == 1001
    assert ledger.run(landing) == third  # nothing new, nothing done


def test_a_batch_that_is_tried_again_changes_nothing(spark, tmp_path):
    ledger = watermarks.Ledger(spark, f"file://{tmp_path}/ledger")
    rows = lambda *x: spark.createDataFrame([(s, day(d), v, n, k) for s, d, v, n, k in x], watermarks.DELIVERY)
    ledger.apply(rows(("a", 0, 1, 1, 5), ("a", 1, 1, 2, 6), ("a", 1, 1, 2, 7)), 0)
    for _ in range(3):
        ledger.apply(rows(("a", 0, 2, 2, 50)), 1)
        assert marks(ledger, 1) == {"a": (None, True, 2)}
        assert sorted((r["period"], r["n"], r["value"], r["final"]) for r in ledger.gold(1).collect()) == [(day(0), 1, 50, False), (day(1), 2, 13, False)]


HOUR, BEGIN = 3_600_000, 1_700_000_000_000


def told(spark, tmp_path, *batches):
    root, landing = f"file://{tmp_path}/freshness", f"file://{tmp_path}/marks"
    for rows in batches:
        rows = [(s, BEGIN + at, kind) for s, at, kind in rows]
        spark.createDataFrame(rows, freshness.MARKS).coalesce(1).write.mode("append").parquet(landing)
        freshness.tell(spark, landing, root, 2 * HOUR, 4 * HOUR)
    return sorted((r["source"], (r["at_ms"] - BEGIN) // HOUR, r["status"]) for r in freshness.told(spark, root).collect())


def every_hour(source, *spans):
    return [(source, h * HOUR, "data") for a, b in spans for h in range(a, b)]


def test_a_silent_source_turns_red(spark, tmp_path):
    """Nothing more of 'mute' arrives; rows of the other source move the watermark that fires its timers."""
    got = told(spark, tmp_path, every_hour("live", (0, 3)) + every_hour("mute", (0, 3)), every_hour("live", (3, 6)), every_hour("live", (6, 12)))
    assert got == [("live", 0, "green"), ("mute", 0, "green"), ("mute", 4, "amber"), ("mute", 6, "red")]


@pytest.mark.parametrize("cuts", [(24,), (1, 6, 7, 15, 24), (12, 24)])
def test_batches_make_no_difference(spark, tmp_path, cuts):
    paused = [("paused", 0, "data"), ("paused", HOUR, "pause"), ("paused", 12 * HOUR, "data"), ("paused", 15 * HOUR, "resume"), ("paused", 16 * HOUR, "data")]
    rows = every_hour("live", (0, 24)) + every_hour("gappy", (0, 2), (5, 6), (14, 16)) + paused
    want = [("gappy", 0, "green"), ("gappy", 3, "amber"), ("gappy", 5, "green"), ("gappy", 7, "amber"), ("gappy", 9, "red"), ("gappy", 14, "green"), ("gappy", 17, "amber"), ("gappy", 19, "red")]
    want += [("live", 0, "green"), ("paused", 0, "green"), ("paused", 1, "paused"), ("paused", 15, "green"), ("paused", 18, "amber"), ("paused", 20, "red")]
    parts = [[r for r in rows if a <= r[1] // HOUR < b] for a, b in zip((0, *cuts), cuts)]
    assert told(spark, tmp_path, *parts) == want


def test_old_slots_settle(spark, tmp_path):
    """A stream longer than the horizon counts all its gaps."""
    from tidemark.streaming.arrivals import EVENTS, HORIZON, SLOT, freshness_state

    slots = [*range(0, 20), 30, 35, *range(HORIZON, HORIZON + 10), *range(3 * HORIZON, 3 * HORIZON + 5)]
    for part in (slots[:15], slots[15:25], slots[25:]):
        rows = spark.createDataFrame([(i, s * SLOT) for i, s in enumerate(part)], "event_id long, at long")
        full = {"event_id": F.col("event_id"), "ts": F.timestamp_seconds("at"), "user_id": F.lit(1), "event_type": F.lit("click"), "value": F.lit(1.0), "props": F.lit("{}")}
        rows.select(*[full[c.split()[0]].cast(c.split()[1]).alias(c.split()[0]) for c in EVENTS.split(", ")]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    r = freshness_state(spark, str(tmp_path)).first()
    assert (r["slots"], r["amber"], r["red"]) == (len(slots), 1, 3)
