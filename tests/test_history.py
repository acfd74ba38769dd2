from datetime import date, datetime

from pyspark.sql import functions as F

from fondaco.operators import history

SCHEMA = "id long, testo string, inizio date, fine date, version string, created timestamp_ntz"


def run(spark, rows):
    rows = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("clash"))
    out = history.text_history(rows, key="id", text="testo", begin="inizio", end="fine", version="version", created="created")
    return sorted((tuple(r) for r in out.collect()), key=repr)


def row(i, text, version, begin=None, end=None, day=1):
    return (i, text, begin, end, version, datetime(2025, 1, day))


def test_runs_join_over_white_space_and_spellings_of_the_date(spark):
    rows = [row(1, "a  b", "20200101"), row(1, "a b ", "V2_20200401"), row(1, "a c", "2020-07-01"), row(1, "a b", "2020.10.01")]
    assert run(spark, rows) == [
        (1, date(2020, 1, 1), date(2020, 7, 1)), (1, date(2020, 10, 1), None), (1, date(2020, 7, 1), date(2020, 10, 1)),
    ]


def test_stated_dates_hold_and_sentinels_do_not(spark):
    rows = [row(1, "a", "20200101", date(1900, 1, 1), date(9999, 12, 31)), row(1, "a", "20200401", date(2019, 5, 1), date(2020, 5, 1)), row(1, "b", "20200701")]
    assert run(spark, rows) == [(1, date(2019, 5, 1), date(2020, 5, 1)), (1, date(2020, 7, 1), None)]


def test_repeated_late_null_and_unreadable_rows(spark):
    rows = [row(1, "b", "20200101", day=2), row(1, "a", "20200101", day=1), row(1, "b", "20200101", day=2), row(1, None, "20200401"), row(2, "x", "none"), row(None, "x", "20200101")]
    assert run(spark, rows) == [(1, date(2020, 1, 1), date(2020, 4, 1)), (1, date(2020, 4, 1), None)]
    assert history.unreadable_snapshots(spark.createDataFrame(rows, SCHEMA), "version").count() == 1
    assert run(spark, []) == []


def test_satellite_appends_only_changes(spark):
    snaps = spark.createDataFrame([(1, date(2020, 1, 1), "a"), (1, date(2020, 2, 1), "a"), (1, date(2020, 3, 1), "b"), (2, date(2020, 1, 1), None)], "key long, snapshot date, v string")
    stored = history.satellite(snaps, ["v"])
    assert sorted((r["key"], r["load_date"].month) for r in stored.collect()) == [(1, 1), (1, 3), (2, 1)]
    fresh = spark.createDataFrame([(1, date(2020, 4, 1), "b"), (1, date(2020, 5, 1), "c"), (3, date(2020, 4, 1), "z")], "key long, snapshot date, v string")
    assert sorted((r["key"], r["load_date"].month) for r in history.append_satellite(stored, fresh, ["v"]).collect()) == [(1, 5), (3, 4)]
    ends = {(r["key"], r["load_date"].month): r["end_date"] for r in history.satellite_view(stored).collect()}
    assert ends[(1, 1)] == date(2020, 3, 1) and ends[(1, 3)] is None


def test_history_is_built_from_satellites(spark, monkeypatch):
    built, satellite = [], history.satellite
    monkeypatch.setattr(history, "satellite", lambda rows, attributes: built.append(attributes) or satellite(rows, attributes))
    # The stated dates of the first snapshot still hold when the text changes.
    rows = [row(1, "a", "20200101", date(2020, 2, 1)), row(1, "b", "20200401", date(2020, 2, 1)), row(1, "b", "20200701")]
    assert run(spark, rows) == [(1, date(2020, 2, 1), None), (1, date(2020, 2, 1), date(2020, 2, 1))]
    assert built == [["_digest"], ["_from", "_to"]]


def test_snapshots_appended_in_any_order_give_the_full_history(spark):
    import itertools
    import random

    versions = "a a b a a c".split()
    snaps = [(1, date(2020, 1 + i, 1), v) for i, v in enumerate(versions)] + [(2, date(2020, 1, 1), None), (2, date(2020, 3, 1), "x")]
    schema = "key long, snapshot date, v string"
    view = lambda stored: sorted((r["key"], r["load_date"], r["v"], r["end_date"]) for r in history.satellite_view(stored).collect())
    full = view(history.satellite(spark.createDataFrame(snaps, schema), ["v"]))
    for seed in range(3):
        order = random.Random(seed).sample(snaps, len(snaps))
        stored, tracked = [], []
        for chunk in itertools.batched(order, 2):
            table = spark.createDataFrame(stored, "key long, load_date date, hash_diff string, v string")
            fresh = history.append_satellite(table, spark.createDataFrame(list(chunk), schema), ["v"], spark.createDataFrame(tracked, schema))
            stored += [tuple(r) for r in fresh.collect()]
            tracked += chunk
        assert view(spark.createDataFrame(stored, "key long, load_date date, hash_diff string, v string")) == full
