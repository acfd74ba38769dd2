from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fondaco.operators import ledger as led

T0 = datetime(2025, 1, 1)
HOUR = timedelta(hours=1)


def versions(spark, rows):
    return spark.createDataFrame(rows, "id long, created_at timestamp_ntz")


def keys(df):
    return sorted(r["key"] for r in df.collect())


def test_newest_version_counts_repeated_and_null_rows_once(spark):
    rows = versions(spark, [(1, T0), (1, T0), (1, T0 + HOUR), (2, None), (None, T0)]).withColumn("key", F.lit("clash"))
    assert [tuple(r) for r in led.newest_versions(rows, "id", "created_at").collect()] == [(1, T0 + HOUR)]


def test_runs_that_failed_leave_their_items_unhandled(spark):
    source = versions(spark, [(1, T0), (2, T0), (3, T0), (4, T0), (4, T0 + HOUR)])
    items = spark.createDataFrame([(1, 1, T0), (1, 1, T0), (2, 2, T0), (3, 3, T0), (1, 4, T0)], "run_id int, chunk_id long, chunk_created_at timestamp_ntz")
    runs = spark.createDataFrame([(1, T0, T0 + HOUR / 2, "success"), (2, T0, T0, "failed"), (3, T0, None, "running")], "run_id int, started_at timestamp_ntz, finished_at timestamp_ntz, status string")
    newest = led.newest_versions(source, "id", "created_at")
    events = led.events_of_runs(items, runs, key="chunk_id", version="chunk_created_at")
    state = led.ledger_state(events, T0 + HOUR)
    assert {(r["key"], r["state"]) for r in state.collect()} == {(1, "done"), (2, "pending"), (3, "leased"), (4, "done")}
    assert keys(led.unhandled(newest, state)) == [2, 3, 4]  # 4 changed after it was handled
    assert keys(led.claimable(newest, state)) == [2, 4]
    later = led.ledger_state(events, T0 + 9 * HOUR)
    assert keys(led.claimable(newest, later)) == [2, 3, 4]


def test_empty_source_and_log(spark):
    newest = led.newest_versions(versions(spark, []), "id", "created_at")
    state = led.ledger_state(spark.createDataFrame([], led.EVENTS), T0)
    assert led.unhandled(newest, state).count() == 0


def test_leases_expire_and_stale_writers_are_rejected(spark, tmp_path):
    work = led.WorkLedger(spark, str(tmp_path / "ledger"))
    newest = led.newest_versions(versions(spark, [(1, T0), (2, T0)]), "id", "created_at")
    first, mine = work.lease(newest, T0, HOUR)
    assert keys(mine) == [1, 2]
    second, none = work.lease(newest, T0 + HOUR / 2, HOUR)
    assert keys(none) == []
    third, taken = work.lease(newest, T0 + 2 * HOUR, HOUR)
    assert keys(taken) == [1, 2] and third > second > first
    with pytest.raises(led.StaleToken):
        work.commit(first, T0 + 2 * HOUR)
    work.commit(third, T0 + 2 * HOUR)
    work.commit(third, T0 + 2 * HOUR)  # a retry changes nothing
    assert keys(led.unhandled(newest, led.ledger_state(work.events(), T0 + 9 * HOUR))) == []
    assert work.output_path(third) == work.output_path(third)


def event(kind, token, seq, key=1):
    return (key, T0, kind, token, seq, T0 + HOUR)


def test_fencing_by_the_order_of_events(spark):
    log = [
        event("lease", 1, 1), event("done", 1, 2), event("lease", 2, 3),  # done before the later lease: final
        event("lease", 1, 1, 2), event("lease", 2, 2, 2), event("done", 1, 3, 2),  # taken over before it was done: rejected
        event("lease", 1, 1, 3), event("lease", 2, 2, 3), event("done", 1, 3, 3), event("done", 2, 4, 3), event("done", 2, 4, 3),
    ]
    state = {r["key"]: (r["state"], r["token"]) for r in led.ledger_state(spark.createDataFrame(log, led.EVENTS), T0 + 2 * HOUR).collect()}
    assert state == {1: ("done", 1), 2: ("pending", 2), 3: ("done", 2)}


def test_a_late_lease_does_not_reopen_what_is_done(spark, tmp_path, monkeypatch):
    work = led.WorkLedger(spark, str(tmp_path / "ledger"))
    newest = led.newest_versions(versions(spark, [(1, T0), (2, T0)]), "id", "created_at")
    take, raced = work._take, []

    def late(place, token, folder):
        """Before the first writer's entry lands, another one leases, works and commits."""
        if not raced:
            raced.append(token)
            other = led.WorkLedger(spark, work.path)
            first, mine = other.lease(newest, T0, HOUR)
            mine.write.mode("overwrite").parquet(other.output_path(first))
            other.commit(first, T0)
        return take(place, token, folder)

    monkeypatch.setattr(work, "_take", late)
    token, mine = work.lease(newest, T0, HOUR)
    assert raced == [1] and token == 2 and keys(mine) == []
    assert {r["state"] for r in led.ledger_state(work.events(), T0 + 9 * HOUR).collect()} == {"done"}
    work.commit(token, T0)
    assert work.events().where("event = 'done'").count() == 2


def test_a_writer_that_dies_between_write_and_commit_repeats_no_record(spark, tmp_path):
    work = led.WorkLedger(spark, str(tmp_path / "ledger"))
    source = [(i, T0) for i in range(6)]
    newest = led.newest_versions(versions(spark, source), "id", "created_at")
    dead, mine = work.lease(newest, T0, HOUR)
    mine.write.parquet(work.output_path(dead))  # and no commit
    (tmp_path / "ledger" / "rows" / "9-dead").mkdir()  # rows of an entry that never took its place
    token, again = work.lease(newest, T0 + 2 * HOUR, HOUR)
    for _ in range(2):  # the write is tried twice
        again.write.mode("overwrite").parquet(work.output_path(token))
    work.commit(token, T0 + 2 * HOUR)
    with pytest.raises(led.StaleToken):
        work.commit(dead, T0 + 2 * HOUR)
    done = work.events().where("event = 'done'").select("token").distinct().collect()
    assert [r["token"] for r in done] == [token]
    assert keys(spark.read.parquet(work.output_path(token))) == list(range(6))
