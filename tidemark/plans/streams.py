"""Stream queries, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import enrich
from tidemark.functions.columns import day, iso, seconds_between
from tidemark.operators.sessions import fold_sessions
from tidemark.plans import ops
from tidemark.plans.events import _PRODUCT_SPLIT, _STAGES_SQL, raw_records
from tidemark.plans.registry import Inputs, query, ts_text
from tidemark.session import work_dir
from tidemark.sources import files, lake
from tidemark.sources.adapters import SESSION_SQL, VIEWS
from tidemark.streaming import alerts, ingest, late, metrics, sessions, sinks, sources

EVENTS_NOW = "(SELECT max(ts) FROM events)"


def _events_stream(t: Inputs):
    return sources.read_table_stream(t.spark, t.base, "events", t.events.schema)


def _view_stream(t: Inputs, name: str):
    """A view of the event table over its stream."""
    return t.spark.sql(VIEWS[name], events=_events_stream(t))


def _finished(t: Inputs, label: str, stream):
    """What a stream has written at the end of its input, which may be nothing."""
    base = work_dir(t.spark, label)
    sinks.run_available(stream, f"{base}/checkpoint", path=f"{base}/out")
    return t.spark.read.schema(stream.schema).parquet(f"{base}/out") if files.is_folder(t.spark, f"{base}/out") else t.spark.createDataFrame([], stream.schema)


def _records(t: Inputs) -> str:
    path = work_dir(t.spark, "records")
    raw_records(t).write.parquet(path)
    return path


def _validate(t: Inputs) -> str:
    base = work_dir(t.spark, "validate")
    stream = ingest.judge(ingest.to_events(ingest.decode_envelope(sources.read_record_files(t.spark, _records(t)))), t.events_as_of)
    sinks.run_available(stream, f"{base}/checkpoint", sinks.split_sink(base))
    return base


@query("s03_validation_stream", _STAGES_SQL + "GROUP BY stage")
def validation_stream(t: Inputs):
    base = _validate(t)
    valid = t.spark.read.parquet(f"{base}/validated").select(F.lit("valid").alias("stage"))
    dead = t.spark.read.parquet(f"{base}/deadletter").select("stage")
    return valid.unionByName(dead).groupBy("stage").agg(F.count("*").alias("records"))


@query("snk04_dead_letter_split", "SELECT sink, count(*) AS records FROM (SELECT CASE stage WHEN 'valid' THEN 'validated' ELSE 'deadletter' END AS sink, records FROM (" + _STAGES_SQL
       + " GROUP BY stage)) x, generate_series(1, records) GROUP BY sink")
def dead_letter_split(t: Inputs):
    base = _validate(t)
    parts = [t.spark.read.parquet(f"{base}/{n}").agg(F.count("*").alias("records")).select(F.lit(n).alias("sink"), "records") for n in ("validated", "deadletter")]
    return parts[0].unionByName(parts[1])


@query("s04_dedup_stream", "SELECT tenant_id AS tenant, count(*) AS events, count(DISTINCT event_id) AS identities FROM a_events GROUP BY tenant_id")
def dedup_stream(t: Inputs):
    """Every event twice in the stream, once in the result."""
    twice = _view_stream(t, "a_events").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).withColumnsRenamed({"tenant_id": "tenant", "ts": "event_ts"})
    once = _finished(t, "dedup", ingest.deduplicated(twice.select("tenant", "event_id", "event_ts")))
    return once.groupBy("tenant").agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("identities"))


_CLOSED = f"""SELECT * REPLACE ({ts_text('started_at')} AS started_at, {ts_text('ended_at')} AS ended_at) FROM a_sessions s
WHERE s.ended_at + INTERVAL 30 MINUTE <= {EVENTS_NOW} - INTERVAL 10 SECOND"""


@query("s06_session_stream", _CLOSED)
def session_stream(t: Inputs):
    """Sessions the watermark has closed by the end of the input."""
    return _finished(t, "sessions", sessions.session_stream(_view_stream(t, "a_events"))).withColumn("started_at", iso("started_at")).withColumn("ended_at", iso("ended_at"))


# Arrivals: every 13th event comes five days late, every 7th six minutes; files end with the weeks of arrival.
_ARRIVES = "ts + CASE WHEN src_key % 13 = 0 THEN INTERVAL 5 DAY WHEN src_key % 7 = 0 THEN INTERVAL 6 MINUTE ELSE INTERVAL 0 DAY END"
_ARRIVED = f"""arrived AS (SELECT *, CAST(floor((epoch_us({_ARRIVES}) - epoch_us(TIMESTAMP '2024-01-01')) / 604800000000.0) AS BIGINT) AS file FROM a_events),
marks AS (SELECT file, date_trunc('milliseconds', max(max(ts)) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) - INTERVAL 10 SECOND AS watermark FROM arrived GROUP BY file),
judged AS (SELECT a.*, watermark, coalesce(ts <= watermark, false) AS late FROM arrived a JOIN marks USING (file))"""


def _in_arrivals(t: Inputs, label: str, each) -> str:
    """a_events in files by arrival, each stream run to its end before the next file comes; `each` gets the stream and the folder."""
    base = work_dir(t.spark, label)
    file = F.floor((F.unix_micros(F.expr(_ARRIVES)) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 604800000000.0)
    rows = t.a_events.withColumn("file", file)
    rows.write.partitionBy("file").parquet(f"{base}/arrived")
    for number in files.folder_numbers(t.spark, f"{base}/arrived", "file"):
        t.spark.read.parquet(f"{base}/arrived/file={number}").write.mode("append").parquet(f"{base}/in")
        each(t.spark.readStream.schema(t.a_events.schema).parquet(f"{base}/in"), base)
    return base


_S09 = SESSION_SQL.replace("{a_events}", "(SELECT * FROM judged WHERE NOT late)")


@query("s09_bounded_session_stream", f"""WITH {_ARRIVED}, s AS ({_S09}) SELECT * REPLACE ({ts_text('started_at')} AS started_at, {ts_text('ended_at')} AS ended_at)
FROM s WHERE s.ended_at + INTERVAL 30 MINUTE <= {EVENTS_NOW} - INTERVAL 10 SECOND""")
def bounded_session_stream(t: Inputs):
    """Sessions of events that come out of order in several files; the late ones are left out."""
    base = _in_arrivals(t, "bounded", lambda stream, base: sinks.run_available(sessions.bounded_session_stream(stream), f"{base}/checkpoint", path=f"{base}/out"))
    return t.spark.read.parquet(f"{base}/out").withColumn("started_at", iso("started_at")).withColumn("ended_at", iso("ended_at"))


@query("s08_late_events", f"""WITH {_ARRIVED} SELECT tenant_id, event_id, {ts_text('ts')} AS ts, {ts_text('watermark')} AS watermark,
  (epoch_us(watermark) - epoch_us(ts)) / 1000000.0 AS behind_seconds FROM judged WHERE late""")
def late_events(t: Inputs):
    """The events that the session stream leaves out, with the watermark they missed."""
    base = _in_arrivals(t, "late", lambda stream, base: sinks.run_available(stream, f"{base}/checkpoint", late.late_split(base)))
    rows = late.read_split(t.spark, base, "late", t.a_events.schema)
    return rows.select("tenant_id", "event_id", iso("ts").alias("ts"), iso("watermark").alias("watermark"), seconds_between("ts", "watermark").alias("behind_seconds"))


@query("s08_on_time_split", f"""WITH {_ARRIVED} SELECT tenant_id, count(*) FILTER (WHERE NOT late) AS on_time, count(*) FILTER (WHERE late) AS late FROM judged GROUP BY tenant_id""")
def on_time_split(t: Inputs):
    """Events per tenant that came ahead of the watermark, and those that did not."""
    base = _in_arrivals(t, "split", lambda stream, base: sinks.run_available(stream, f"{base}/checkpoint", late.late_split(base)))
    on_time, behind = (late.read_split(t.spark, base, name, t.a_events.schema).select("tenant_id", F.lit(name).alias("side")) for name in ("on_time", "late"))
    return on_time.unionByName(behind).groupBy("tenant_id").agg(F.count_if(F.col("side") == "on_time").alias("on_time"), F.count_if(F.col("side") == "late").alias("late"))


@query("s11_metric_stream", f"""
SELECT tenant_id, {ts_text('b')} AS window_start, count(*) AS events, CAST(printf('%.4f', CAST(count(*) FILTER (WHERE topic = 'events.deadletter') AS DOUBLE) / count(*)) AS DOUBLE) AS error_rate
FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, processed_at) AS b FROM a_journal) WHERE b + INTERVAL 5 MINUTE <= {EVENTS_NOW} - INTERVAL 10 SECOND GROUP BY tenant_id, b""")
def metric_stream(t: Inputs):
    return _finished(t, "metric", metrics.windowed_errors(_view_stream(t, "a_journal"))).select("tenant_id", iso("window_start").alias("window_start"), "events", "error_rate")


def _lake_batch(t: Inputs):
    """Click and product events; those of the home page have no time."""
    clicks = t.a_ev_clicks.select(
        "event_id", F.col("tenant").alias("tenant_id"), "event_type", "source", F.lit("session").alias("entity_type"), F.col("session_id").alias("entity_id"),
        F.lit(None).cast("string").alias("operation"), F.when(F.col("page_url") != "/", F.col("timestamp").cast("timestamp")).alias("occurred_at"), F.to_json(F.struct("page_url")).alias("payload_json"))
    products = t.a_ev_products.select(
        "event_id", F.col("tenant").alias("tenant_id"), "event_type", "source", F.lit("product").alias("entity_type"), F.col("product_id").alias("entity_id"),
        F.lit(None).cast("string").alias("operation"), F.col("timestamp").cast("timestamp").alias("occurred_at"), F.to_json(F.struct("price")).alias("payload_json"))
    return clicks.unionByName(products)


@query("snk03_idempotent_append", """
WITH n AS (SELECT (SELECT count(*) FROM a_events) + (SELECT count(*) FROM a_ev_products) AS n)
SELECT 'first' AS run, n * 2 AS consumed, n AS appended, n AS duplicates FROM n
UNION ALL SELECT 'second', n, 0, n FROM n UNION ALL SELECT 'stored', n, n, 0 FROM n""")
def idempotent_append(t: Inputs):
    """A batch that repeats itself, then the same batch again."""
    base = work_dir(t.spark, "lake")
    batch = _lake_batch(t)
    first = lake.append_idempotent("validated_events", batch.unionAll(batch), base, "one")
    second = lake.append_idempotent("validated_events", batch, base, "two")
    stored = lake.read_lake(t.spark, "validated_events", base).agg(F.count("*").alias("n"))
    runs = [("first", *first.values()), ("second", *second.values())]
    return t.spark.createDataFrame(runs, "run string, consumed long, appended long, duplicates long").unionByName(
        stored.select(F.lit("stored").alias("run"), F.col("n").alias("consumed"), F.col("n").alias("appended"), F.lit(0).cast("long").alias("duplicates")))


@query("snk01_append_lake", """SELECT 'dead_letter' AS "table", count(*) AS row_count, count(DISTINCT date_trunc('day', received_at)) AS folders FROM a_dead_letters
UNION ALL SELECT 'clickstream', count(*), count(DISTINCT date_trunc('hour', ts)) FROM a_events""")
def append_lake(t: Inputs):
    """Day folders for dead letters, hour folders for clicks."""
    base = work_dir(t.spark, "append")
    lake.append_lake("dead_letter", t.a_dead_letters, base)
    lake.append_lake("clickstream", t.a_events.withColumn("created_at", F.col("ts")), base)
    dead = t.spark.read.parquet(f"{base}/dead_letter").agg(F.count("*").alias("row_count"), F.count_distinct("dt").alias("folders"))
    clicks = t.spark.read.parquet(f"{base}/clickstream").agg(F.count("*").alias("row_count"), F.count_distinct("dt", "hr").alias("folders"))
    return dead.select(F.lit("dead_letter").alias("table"), "*").unionByName(clicks.select(F.lit("clickstream").alias("table"), "*"))


@query("snk02_partition_columns", """
SELECT 'hours' AS kind, event_id, strftime(ts, '%Y-%m-%d') AS dt, CAST(hour(ts) AS INTEGER) AS hr FROM a_events
UNION ALL SELECT 'days', event_id, strftime(received_at, '%Y-%m-%d'), NULL FROM a_dead_letters""")
def partition_columns(t: Inputs):
    """The folders that declared partition transforms give to the rows of a table."""
    hours, _ = lake.partition_columns(t.a_events.withColumn("created_at", F.col("ts")), lake.LAKE_TABLES["clickstream"][1])
    days, _ = lake.partition_columns(t.a_dead_letters, lake.LAKE_TABLES["dead_letter"][1])
    return hours.select(F.lit("hours").alias("kind"), "event_id", day("dt").alias("dt"), "hr").unionByName(
        days.select(F.lit("days").alias("kind"), "event_id", day("dt").alias("dt"), F.lit(None).cast("int").alias("hr")))


@query("s05_session_keys", """
SELECT tenant_id, session_id, count(*) AS events, count(DISTINCT user_id) AS users FROM a_events WHERE coalesce(session_id, '') <> '' GROUP BY tenant_id, session_id""")
def session_keys(t: Inputs):
    """Keyed events of the session job, as its stream hands them on."""
    keyed = _finished(t, "keys", sessions.session_events(_view_stream(t, "a_events")).select("tenant_id", "session_id", "user_id"))
    return keyed.groupBy("tenant_id", "session_id").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"))


@query("s12_apply_stream", """
SELECT 'journal' AS "table", tenant_id, event_id AS id FROM a_events UNION ALL SELECT 'serving_log', tenant_id, event_id FROM a_events WHERE session_id IS NOT NULL
UNION ALL SELECT DISTINCT 'sessions_aggregated', tenant_id, session_id FROM a_events WHERE session_id IS NOT NULL""")
def apply_stream(t: Inputs):
    """Click events as a stream of files, delivered again two days later, applied to the serving log and the journal."""
    base = work_dir(t.spark, "apply")
    rows = t.a_events.select(
        "event_id", "tenant_id", "event_type", F.lit(None).cast("string").alias("order_id"), F.lit(None).cast("string").alias("status"), "session_id",
        "user_id", enrich.page_category(F.col("page_url")).alias("page_category"), F.col("session_id").isNull().alias("is_dead"),
        F.lit(5).alias("latency_ms"), "ts", "src_key", F.col("ts").alias("processed_at"), F.lit(None).cast("string").alias("branch"))
    late = rows.withColumn("processed_at", F.col("processed_at") + F.expr("INTERVAL 2 DAYS"))
    rows.write.parquet(f"{base}/in/day=1")
    late.write.parquet(f"{base}/in/day=2")
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/in/*")
    sinks.run_available(stream, f"{base}/checkpoint", sinks.apply_sink(base))
    log = t.spark.read.parquet(f"{base}/serving_log")
    parts = {"journal": t.spark.read.parquet(f"{base}/journal").withColumnRenamed("event_id", "id"), "serving_log": log.withColumnRenamed("event_id", "id"),
             "sessions_aggregated": fold_sessions(log).withColumnRenamed("session_id", "id")}
    out = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias("table"), "tenant_id", "id")
        out = part if out is None else out.unionByName(part)
    return out


# product events come bare and in an envelope: two deliveries of one identity
@query("s03_validated_job", f"""
WITH s AS ({_STAGES_SQL} GROUP BY stage), p AS (SELECT count(*) AS n FROM ({_PRODUCT_SPLIT}) WHERE stage = 'valid')
SELECT stage, records - CASE WHEN stage = 'valid' THEN n ELSE 0 END AS records FROM s, p""")
def validated_job(t: Inputs):
    """Raw records through decode, judge and the identity check, the whole delivery twice: every record counts once."""
    base, path = work_dir(t.spark, "job"), _records(t)
    judged = ingest.judge(ingest.to_events(ingest.decode_envelope(sources.read_record_files(t.spark, path))), t.events_as_of)
    sinks.run_available(judged, f"{base}/checkpoint", sinks.validated_job(base))
    again = t.spark.read.parquet(path)
    again.write.mode("append").parquet(path)
    sinks.run_available(judged, f"{base}/checkpoint", sinks.validated_job(base))
    valid = t.spark.read.parquet(f"{base}/validated").select(F.lit("valid").alias("stage"))
    dead = t.spark.read.parquet(f"{base}/deadletter").select("stage")
    return valid.unionByName(dead).groupBy("stage").agg(F.count("*").alias("records"))


@query("o25_alert_stream", ops.STATES_SQL)
def alert_stream(t: Inputs):
    base = work_dir(t.spark, "alerts")
    rows = ops.rule_ticks(t)
    rows.write.parquet(f"{base}/in")
    stream = t.spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    sinks.run_available(alerts.alert_stream(stream), f"{base}/checkpoint", path=f"{base}/out")
    return t.spark.read.parquet(f"{base}/out").withColumn("tick_at", iso("tick_at")).withColumn("fired_at", iso("fired_at"))


@query("snk07_compaction", "SELECT count(*) AS row_count, 1 AS files, true AS fewer FROM orders")
def compaction(t: Inputs):
    """Many small files of a table become files of the target size."""
    base = work_dir(t.spark, "compact")
    t.orders.repartition(16).write.parquet(f"{base}/t/part_no=1")
    before, after = lake.compact(t.spark, f"{base}/t", {"part_no": 1}, ["o_orderkey"])
    rows = t.spark.read.parquet(f"{base}/t").agg(F.count("*").alias("row_count"))
    return rows.select("row_count", F.lit(after).alias("files"), F.lit(after < before).alias("fewer"))


@query("s02_event_time_stream", f"""
SELECT tenant_id AS tenant, {ts_text('b')} AS window_start, count(*) AS events FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS b FROM a_events)
WHERE b + INTERVAL 1 HOUR <= {EVENTS_NOW} - INTERVAL 5 SECOND GROUP BY ALL""")
def event_time_stream(t: Inputs):
    """Hours of the event time that the watermark has closed."""
    stream = ingest.in_event_time(_view_stream(t, "a_events").select(F.col("tenant_id").alias("tenant"), F.col("ts").alias("event_ts")))
    closed = stream.groupBy("tenant", F.window("event_ts", "1 hour").alias("w")).agg(F.count("*").alias("events"))
    return _finished(t, "time", closed.select("tenant", F.col("w.start").alias("window_start"), "events")).withColumn("window_start", iso("window_start"))
