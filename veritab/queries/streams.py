"""Streaming queries (ST1, ST2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritab.queries.common import Registry, load, r
from veritab.queries.relational import LEDGER_ROWS, _ledger_rows
from veritab.session import scratch_folder
from veritab.sources.ledger import conform, read_ledger
from veritab.streaming import monitor

area = Registry()
query, QUERIES, SQL = area.query, area.queries, area.sql


@query("st1_generation_monitor", """SELECT event_type, count(*) AS total_sampled, count(*) FILTER (value > 50) AS total_processed, round(sum(value), 4) AS measure FROM events GROUP BY event_type""")
def _(spark, folder):
    """Events arrive in two halves; the second start resumes from the checkpoint."""
    base = scratch_folder(spark, "stream-events")
    events = load(spark, folder, "events").select("event_id", "event_type", "value")
    half = F.xxhash64("event_id") > 0
    for part in (half, ~half):
        events.filter(part).write.mode("append").parquet(f"{base}/in")
        state = monitor.generation_monitor(
            spark, f"{base}/in", events.schema, "event_type", F.col("value") > 50, f"{base}/state", f"{base}/checkpoint", measure="value"
        )
    return state.select("event_type", "total_sampled", "total_processed", r("measure", 4).alias("measure"))


@query("st2_ledger_stream", LEDGER_ROWS.format("'F', 'O'") + " UNION " + LEDGER_ROWS.format("'O', 'P'"))
def _(spark, folder):
    """Overlapping result rows arrive twice and are recorded once."""
    base = scratch_folder(spark, "stream-ledger")
    for statuses in (["F", "O"], ["O", "P"]):
        conform(_ledger_rows(spark, folder, statuses)).write.mode("append").parquet(f"{base}/in")
        monitor.ledger_stream_upsert(spark, f"{base}/in", f"{base}/ledger", f"{base}/checkpoint")
    return read_ledger(spark, f"{base}/ledger").select("real_path", "fake_path", "fake_size", "score")
