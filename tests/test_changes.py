"""Change capture: exactly the due events, and batches that survive failures."""

import datetime as dt
import json
import random

import pytest

from tickloom.operators.changes import ChangeLog, changed_since, last_successful_runs

T0 = dt.datetime(2024, 1, 1)
D = "delivery_id long, session_id long, event_index long, fields string, ingested_at timestamp"
R = "snapshot_id long, session_id long, last_event_index long, status string, taken_at timestamp"


def at(m):
    return T0 + dt.timedelta(minutes=m)


def due(spark, deliveries, runs):
    out = changed_since(spark.createDataFrame(deliveries, D), last_successful_runs(spark.createDataFrame(runs, R)))
    return sorted((r.session_id, r.event_index) for r in out.collect())


def test_spellings_of_equal_values(spark):
    runs = [(1, 1, 9, "committed", at(10))]
    same = ['{"a": 1.50, "b": null}', '{"a":15e-1}', '{"b":null, "a":1.5}', '{"a": 1.500}']
    deliveries = [(i, 1, 1, f, at(20 * i)) for i, f in enumerate(same)]
    assert due(spark, deliveries, runs) == []
    assert due(spark, [*deliveries, (9, 1, 1, '{"a": 1.51}', at(99))], runs) == [(1, 1)]
    # changed and changed back
    assert due(spark, [*deliveries, (9, 1, 1, '{"a": 2}', at(99)), (10, 1, 1, '{"a": 1.5}', at(100))], runs) == []


def test_reasons(spark):
    runs = [(1, 1, 2, "committed", at(10)), (2, 1, 9, "failed", at(50)), (3, 1, None, "running", at(60)), (4, 3, None, "committed", at(10)), (5, 4, 5, "committed", None)]
    deliveries = [
        (1, 1, 1, "{}", at(1)),  # done
        (2, 1, 3, "{}", at(1)),  # beyond the run
        (3, 1, 2, "{}", at(11)),  # late
        (4, 2, 1, "{}", at(1)),  # no run at all
        (5, 3, 1, "{}", at(1)),  # a run that processed nothing
        (6, 4, 1, "{}", at(1)),  # a run of no known time
        (7, None, 1, "{}", at(1)),
        (8, 1, None, "{}", at(1)),
        (9, 1, 1, "{}", at(1)),  # repeated
    ]
    assert due(spark, deliveries, runs) == [(1, 2), (1, 3), (2, 1), (3, 1), (4, 1)]


def test_texts_that_are_no_objects(spark):
    runs = [(1, 1, 9, "committed", at(10))]
    rows = [(1, 1, 1, None, at(1)), (2, 1, 1, None, at(20)), (3, 1, 2, "x", at(1)), (4, 1, 2, "y", at(20)), (5, 1, 3, "", at(1)), (6, 1, 3, None, at(20))]
    assert due(spark, rows, runs) == [(1, 2), (1, 3)]


def test_empty(spark):
    assert due(spark, [], []) == []
    assert due(spark, [(1, 1, 1, "{}", at(1))], []) == [(1, 1)]


def test_random_against_brute_force(spark):
    rnd = random.Random(5)
    deliveries = [(i, rnd.choice([1, 1, 1, 2, 3]), rnd.randrange(12), json.dumps({"a": rnd.randrange(3)}), at(rnd.randrange(100))) for i in range(600)]
    runs = [(i, rnd.choice([1, 2]), rnd.randrange(12), rnd.choice(["committed", "failed"]), at(rnd.randrange(100))) for i in range(12)]
    last = {}
    for i, s, o, st, t in runs:
        if st == "committed" and (s not in last or (t, i) > last[s][:2]):
            last[s] = (t, i, o)
    want = set()
    for s, e in {(r[1], r[2]) for r in deliveries}:
        rows = sorted((r[4], r[0], r[3]) for r in deliveries if r[1:3] == (s, e))
        seen = [r for r in rows if s in last and r[0] <= last[s][0]]
        if s not in last or e > last[s][2] or not seen or seen[-1][2] != rows[-1][2]:
            want.add((s, e))
    assert due(spark, deliveries, runs) == sorted(want)


def test_numbers_compare_exactly_and_by_kind(spark):
    runs = [(1, 1, 9, "committed", at(10))]
    pairs = [('{"a": 9007199254740993}', '{"a": 9007199254740992}', True), ('{"a": "1"}', '{"a": 1}', True), ('{"a": 1e2}', '{"a": 100.0}', False), ('{"a": 1e30}', '{"a": 1000000000000000000000000000000}', False), ('{"a": 1e-20}', '{"a": 0}', True), ('{"a": -0.0}', '{"a": 0}', False), ('{"a": 1, "a": 2}', '{"a": 2}', True), ('{"a": {"x": 1, "y": [2]}}', '{"a": {"y": [2], "x": 1.0}}', False)]
    rows = [r for i, (x, y, _) in enumerate(pairs) for r in ((2 * i, 1, i, x, at(1)), (2 * i + 1, 1, i, y, at(20)))]
    assert due(spark, rows, runs) == [(1, i) for i, p in enumerate(pairs) if p[2]]


def test_changes_come_through_a_plan_that_is_replayed(spark, tmp_path):
    """A change below the offset, a failure between plan and done, and rows that came meanwhile."""
    root = f"file://{tmp_path}/log"
    runs = last_successful_runs(spark.createDataFrame([(1, 1, 5, "committed", at(10))], R))
    rows = [(1, 1, 1, '{"a": 1}', at(1)), (2, 1, 2, '{"a": 1}', at(2)), (3, 1, 1, '{"a": 2}', at(11)), (4, 1, 2, '{"a": 1.0}', at(12)), (5, 1, 6, "{}", at(3)), (6, 2, 1, "{}", at(4)), (7, 1, 2, '{"a": 3}', at(20)), (8, 3, 1, "{}", at(20))]
    source = lambda n: spark.createDataFrame(rows[:n], D)
    broken = ChangeLog(spark, root, "session_id", "event_index", ("ingested_at", "delivery_id"), "fields")
    broken._mark_whole, broken._mark = broken._mark, lambda n: n and (_ for _ in ()).throw(RuntimeError("lost")) or broken._mark_whole(n)
    start = runs.selectExpr("__key AS key", "struct(__at AS ingested_at, 9223372036854775807L AS delivery_id) AS end", "__offset AS floor")
    broken.begin(start)
    with pytest.raises(RuntimeError):
        broken.run(source(6))
    log = ChangeLog(spark, root, "session_id", "event_index", ("ingested_at", "delivery_id"), "fields")
    assert log.plan(source(8)) == 1
    assert log.run(source(8)) == 1  # the same ranges again
    assert sorted((r.session_id, r.event_index, r.delivery_id) for r in log.read().collect()) == [(1, 1, 3), (1, 6, 5), (2, 1, 6)]
    assert log.run(source(8)) == 2
    assert sorted((r.session_id, r.event_index, r.delivery_id) for r in log.read().collect()) == [(1, 1, 3), (1, 2, 7), (1, 6, 5), (2, 1, 6), (3, 1, 8)]
    assert log.run(source(8)) == 3 and log.rows(source(8), 3).count() == 0


def test_log_survives_failures(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/log", "session_id", "event_index")
    rows = lambda n: spark.createDataFrame([(s, e, s * 100 + e) for s in (1, 2) for e in range(n)], "session_id long, event_index long, v long")
    assert log.run(rows(3), lambda df: df) == 1

    def broken(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        log.run(rows(5), broken)
    # more has come meanwhile: the failed batch is replayed with its own ranges
    assert log.plan(rows(9)) == 2
    assert sorted((r[0], r[1]) for r in log.rows(rows(9), 2).select("session_id", "event_index").collect()) == [(s, e) for s in (1, 2) for e in (3, 4)]
    assert log.run(rows(9), lambda df: df) == 2
    assert log.run(rows(9), lambda df: df) == 3
    assert log.run(rows(9), lambda df: df) == 4  # nothing new
    got = sorted(tuple(r) for r in log.read().select("session_id", "event_index", "v").collect())
    assert got == [(s, e, s * 100 + e) for s in (1, 2) for e in range(9)]


def test_log_gives_late_and_changed_ticks_again(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/log", "session_id", "event_index", order=("ingested_at", "delivery_id"))
    rows = [
        (1, 1, 1, "a", at(1)),
        (2, 1, 5, "b", at(2)),
        (3, 1, 2, "late", at(3)),
        (4, 1, 5, "changed", at(4)),
        (6, 1, 1, "last", at(5)),  # several deliveries of one event in one batch
        (5, 1, 1, "not last", at(5)),
        (7, 2, 1, "new", at(5)),
        (8, 1, 7, "no instant", None),
        (9, 1, 1, "no instant", None),
        (10, None, 1, "", at(5)),
        (11, 1, None, "", at(5)),
    ]
    source = lambda n: spark.createDataFrame(rows[:n], D)

    def broken(df):
        raise RuntimeError("lost")

    assert log.run(source(2), lambda df: df) == 1
    with pytest.raises(RuntimeError):
        log.run(source(4), broken)
    assert sorted(r.delivery_id for r in log.rows(source(7), log.plan(source(7))).collect()) == [3, 4]
    assert log.run(source(7), lambda df: df) == 2
    assert log.run(source(11), lambda df: df.repartition(3)) == 3
    assert sorted((r.session_id, r.event_index, r.fields) for r in log.read().collect()) == [(1, 1, "last"), (1, 2, "late"), (1, 5, "changed"), (1, 7, "no instant"), (2, 1, "new")]
    with pytest.raises(ValueError):
        log.run(source(11), lambda df: df.drop("ingested_at"))


def test_log_holds_the_latest_of_every_tick(spark, data, tmp_path):
    ticks = spark.read.parquet(f"{data}/tick_updates.parquet")
    log = ChangeLog(spark, f"file://{tmp_path}/log", "session_id", "event_index", order=("ingested_at", "delivery_id"))
    for share in (0.3, 0.6, 1.0):
        upto = ticks.selectExpr(f"percentile_approx(ingested_at, {share})").first()[0]
        log.run(ticks.where(ticks.ingested_at <= upto), lambda df: df)
    want = {}
    for r in ticks.collect():
        if None not in (r.session_id, r.event_index):
            k = r.session_id, r.event_index
            want[k] = max(want.get(k, ()), (r.ingested_at, r.delivery_id))
    assert {(r.session_id, r.event_index): (r.ingested_at, r.delivery_id) for r in log.read().collect()} == want
