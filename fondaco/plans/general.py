"""Queries of the general data-processing operators, with the SQL they are held against."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from fondaco.operators import history, ledger
from fondaco.session import table

def _ledger(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The newest versions and the state of their items when the last run of the log began or ended."""
    runs = table(spark, sf, "sync_run")
    newest = ledger.newest_versions(table(spark, sf, "normativa_chunk"), "id", "created_at")
    events = ledger.events_of_runs(table(spark, sf, "sync_item"), runs, key="chunk_id", version="chunk_created_at")
    clock = runs.agg(F.max(F.greatest("started_at", "finished_at"))).first()[0] or datetime(1970, 1, 1)
    return newest, ledger.ledger_state(events, clock)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    newest, state = _ledger(spark, sf)
    return ledger.unhandled(newest, state).select(F.col("key").alias("id"))


def p3_states(spark: SparkSession, sf: str) -> DataFrame:
    """Newest chunk versions by state of their work item; versions without an event are pending."""
    newest, state = _ledger(spark, sf)
    return newest.join(state, ["key", "version"], "left").groupBy(F.coalesce("state", F.lit("pending")).alias("state")).agg(F.count("*").alias("n"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    runs = history.text_history(
        table(spark, sf, "normativa_vigenza"), key="normativa_id", text="testo", begin="inizio_vigore", end="fine_vigore", version="opendata_version", created="created_at"
    )
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    return runs.select(F.col("key").alias("normativa_id"), day("valid_from").alias("valid_from"), day("valid_to").alias("valid_to"))


def p6_satellite_dates(spark: SparkSession, sf: str) -> DataFrame:
    """The fast satellite: the stated dates of each article, a row per change, with lead-based ends."""
    rows = table(spark, sf, "normativa_vigenza")
    dates = {"inizio": history.stated(F.col("inizio_vigore")), "fine": history.stated(F.col("fine_vigore"))}
    stored = history.satellite(history.per_snapshot(rows, "normativa_id", "opendata_version", "created_at", dates), list(dates))
    return history.satellite_view(stored).select(F.col("key").alias("normativa_id"), "load_date", "inizio", "fine", "end_date")


_SNAPSHOT = r"try_strptime(regexp_replace(regexp_extract(opendata_version, '(\d{4}[-./]?\d{2}[-./]?\d{2})($|[^0-9])', 1), '[^0-9]', '', 'g'), '%Y%m%d')::date"
_STATED = "CASE WHEN {0} NOT IN (DATE '1900-01-01', DATE '9999-12-31') THEN {0} END"

QUERIES = {"p3_found": p3_found, "p3_states": p3_states, "p6_found": p6_found, "p6_satellite_dates": p6_satellite_dates}

SQL = {
    "p3_found": """
        WITH newest AS (SELECT id, max(created_at) AS v FROM normativa_chunk GROUP BY id)
        SELECT id FROM newest n WHERE NOT EXISTS (
            SELECT 1 FROM sync_item i JOIN sync_run r ON i.run_id = r.run_id
            WHERE r.status = 'success' AND i.chunk_id = n.id AND i.chunk_created_at = n.v)""",
    "p3_states": """
        WITH newest AS (SELECT id, max(created_at) AS v FROM normativa_chunk GROUP BY id),
        clock AS (SELECT max(greatest(started_at, finished_at)) AS now FROM sync_run),
        seen AS (SELECT i.chunk_id, i.chunk_created_at, bool_or(r.status = 'success') AS ok,
            bool_or(r.status = 'running' AND r.started_at + INTERVAL 6 HOUR > (SELECT now FROM clock)) AS held FROM sync_item i JOIN sync_run r ON i.run_id = r.run_id GROUP BY ALL)
        SELECT CASE WHEN ok THEN 'done' WHEN held THEN 'leased' ELSE 'pending' END AS state, count(*) AS n
        FROM newest LEFT JOIN seen ON chunk_id = id AND chunk_created_at = v GROUP BY 1""",
    "p6_found": f"""
        WITH seen AS (SELECT normativa_id, {_SNAPSHOT} AS snap, regexp_replace(testo, '\\s+', '', 'g') AS t, created_at,
                {_STATED.format('inizio_vigore')} AS b, {_STATED.format('fine_vigore')} AS e FROM normativa_vigenza),
        snaps AS (SELECT normativa_id, snap, arg_max(t, created_at) AS t, min(b) AS b, min(e) AS e FROM seen GROUP BY ALL),
        marked AS (SELECT *, CASE WHEN t = lag(t) OVER w THEN 0 ELSE 1 END AS new FROM snaps WINDOW w AS (PARTITION BY normativa_id ORDER BY snap)),
        runs AS (SELECT *, sum(new) OVER (PARTITION BY normativa_id ORDER BY snap) AS r FROM marked),
        folded AS (SELECT normativa_id, r, coalesce(min(b), min(snap)) AS f, min(e) AS e FROM runs GROUP BY ALL),
        ended AS (SELECT *, least(e, lead(f) OVER (PARTITION BY normativa_id ORDER BY r)) AS t FROM folded)
        SELECT normativa_id, strftime(f, '%Y-%m-%d') AS valid_from, coalesce(strftime(t, '%Y-%m-%d'), '') AS valid_to FROM ended""",
    "p6_satellite_dates": f"""
        WITH seen AS (SELECT normativa_id, {_SNAPSHOT} AS snap, created_at,
                {_STATED.format('inizio_vigore')} AS b, {_STATED.format('fine_vigore')} AS e FROM normativa_vigenza),
        snaps AS (SELECT normativa_id, snap, last(b ORDER BY created_at) AS b, last(e ORDER BY created_at) AS e FROM seen GROUP BY ALL),
        marked AS (SELECT *, row_number() OVER w = 1 OR b IS DISTINCT FROM lag(b) OVER w OR e IS DISTINCT FROM lag(e) OVER w AS new
            FROM snaps WINDOW w AS (PARTITION BY normativa_id ORDER BY snap))
        SELECT normativa_id, snap AS load_date, b AS inizio, e AS fine, lead(snap) OVER (PARTITION BY normativa_id ORDER BY snap) AS end_date FROM marked WHERE new""",
}
