"""Sessions against a plain loop, and the stream forms against the batch form."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators.sessions import fold_sessions, sessionize, value_sessions
from tidemark.session import work_dir
from tidemark.streaming import metrics, sessions, sinks

T0 = datetime(2024, 1, 1)
DDL = "tenant_id string, session_id string, user_id string, page_url string, product_id string, event_type string, ts timestamp, src_key long, value decimal(18,2)"


def make(rows):
    return [(t, s, u, p, d, k, T0 + timedelta(seconds=sec), i, Decimal(1)) for i, (t, s, u, p, d, k, sec) in enumerate(rows)]


def brute(rows, cap=1000):
    out, groups = [], {}
    for r in sorted(rows, key=lambda r: (r[6], r[7])):
        if r[1]:
            groups.setdefault((r[0], r[1]), []).append(r)
    for (tenant, sid), events in groups.items():
        parts = [[events[0]]]
        for e in events[1:]:
            (parts.append([e]) if e[6] - parts[-1][-1][6] > timedelta(minutes=30) else parts[-1].append(e))
        for p in parts:
            pages, products = {e[3] for e in p if e[3]}, {e[4] for e in p if e[4]}
            checkout, cart = any("/checkout" in (e[3] or "") for e in p), any(e[5] == "add_to_cart" for e in p)
            stage = "checkout" if checkout else "add_to_cart" if cart else "product_view" if products else "browse" if len(p) > 1 else "bounce"
            out.append((tenant, sid, p[0][2], p[0][6], p[-1][6], len(p), min(len(pages), cap), min(len(products), cap), stage, len(pages) > cap, len(products) > cap))
    return sorted(out, key=repr)


COLS = ["tenant_id", "session_id", "user_id", "started_at", "ended_at", "event_count", "unique_pages", "products_viewed", "funnel_stage", "pages_truncated", "products_truncated"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLS).collect()), key=repr)


def random_rows(n=1500, hot=0.5):
    rng = random.Random(1)
    out = []
    for _ in range(n):
        sid = "hot" if rng.random() < hot else rng.choice(["a", "b", "c", None, ""])
        out.append((rng.choice(["t1", "t2"]), sid, rng.choice(["u", "v", None]), rng.choice(["/a", "/b", "/checkout/x", "", None, "/c"]),
                    rng.choice([None, "p1", "p2"]), rng.choice(["click", "page_view", "add_to_cart"]), rng.randint(0, 4_000_000) if rng.random() < 0.5 else 60 * rng.randint(0, 3000)))
    return make(out)


def test_random_sessions_equal_a_loop(spark):
    rows = random_rows()
    assert rows_of(sessionize(spark.createDataFrame(rows, DDL))) == brute(rows)


def test_gap_of_exactly_thirty_minutes_joins(spark):
    rows = make([("t", "s", "u", "/a", None, "click", x) for x in (0, 1800, 3600, 5401)])
    assert [r[5] for r in rows_of(sessionize(spark.createDataFrame(rows, DDL)))] == [3, 1]


def test_caps_set_the_flags(spark):
    rows = make([("t", "s", "u", f"/p{i}", f"d{i % 3}", "click", i) for i in range(10)])
    got = rows_of(sessionize(spark.createDataFrame(rows, DDL), max_pages=4, max_products=3))
    assert got == [("t", "s", "u", rows[0][6], rows[-1][6], 10, 10, 3, "product_view", True, False)]


def test_funnel_stages(spark):
    rows = make([("t", "1", "u", "/checkout", "p", "add_to_cart", 0), ("t", "2", "u", "/x", "p", "add_to_cart", 0), ("t", "3", "u", "/x", "p", "click", 0),
                 ("t", "4", "u", "/x", None, "click", 0), ("t", "4", "u", "/y", None, "click", 5), ("t", "5", "u", "/x", None, "click", 0)])
    assert [r[8] for r in rows_of(sessionize(spark.createDataFrame(rows, DDL)))] == ["checkout", "add_to_cart", "product_view", "browse", "bounce"]


def test_value_sessions_close_on_a_later_event(spark):
    rows = make([("t", "s", "u", "/a", None, "click", x) for x in (0, 10, 5000, 9000)])
    got = sorted((r["event_count"], float(r["total_value"]), r["status"]) for r in value_sessions(spark.createDataFrame(rows, DDL)).collect())
    assert got == [(1, 1.0, "closed"), (1, 1.0, "open"), (2, 2.0, "closed")]


def test_fold_advances_only_on_a_higher_rank(spark):
    steps = ["other", "search", "home", "product_detail", "cart", "search"]
    rows = [("t", "s", "u", c, T0 + timedelta(seconds=i), i) for i, c in enumerate(steps)] + [("t", None, "w", "home", T0, 99)]
    df = spark.createDataFrame(rows, "tenant_id string, session_id string, user_id string, page_category string, ts timestamp, src_key int")
    got = {r["session_id"]: (r["funnel_stage"], r["event_count"], r["is_conversion"], r["unique_pages"]) for r in fold_sessions(df).collect()}
    assert got == {"s": ("cart", 6, False, 1), "unknown": ("home", 1, False, 1)}
    stored = fold_sessions(df)
    more = spark.createDataFrame([("t", "s", "z", "product_detail", T0 + timedelta(hours=1), 7), ("t", "s", "z", "checkout", T0 + timedelta(hours=2), 8)], df.schema)
    row = fold_sessions(more, stored).filter("session_id = 's'").first()
    assert (row["funnel_stage"], row["event_count"], row["is_conversion"], row["user_id"], row["started_at"]) == ("checkout", 8, True, "u", T0)


def write_stream(spark, batches):
    path = work_dir(spark, "in")
    for rows in batches:
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(path)
        import time

        time.sleep(1.1)  # file order is by modification time
    return spark.readStream.schema(spark.createDataFrame([], DDL).schema).option("maxFilesPerTrigger", 1).parquet(path)


SENTINEL = [("t9", "end", "u", "/", None, "click", T0 + timedelta(days=400), 10**6, Decimal(1))]


def test_streams_equal_batch_on_a_closed_input(spark):
    rows = sorted(random_rows(400), key=lambda r: (r[6], r[7]))
    half = [rows[:200], rows[200:], SENTINEL]
    want = brute(rows)
    for build in (sessions.session_stream, sessions.bounded_session_stream):
        base = work_dir(spark, "out")
        sinks.run_available(build(write_stream(spark, half)), f"{base}/cp", path=f"{base}/o")
        assert rows_of(spark.read.parquet(f"{base}/o").filter("session_id <> 'end'")) == want


def test_bounded_state_stops_counting_at_the_cap(spark):
    rows = make([("t", "s", "u", f"/p{i}", f"d{i}", "click", i) for i in range(9)])
    base = work_dir(spark, "out")
    stream = sessions.bounded_session_stream(write_stream(spark, [rows, SENTINEL]), max_pages=4, max_products=2)
    sinks.run_available(stream, f"{base}/cp", path=f"{base}/o")
    row = spark.read.parquet(f"{base}/o").filter("session_id = 's'").first()
    assert (row["event_count"], row["unique_pages"], row["products_viewed"], row["pages_truncated"], row["products_truncated"]) == (9, 4, 2, True, True)


def test_late_event_is_dropped_and_counted(spark):
    first = make([("t", "s", "u", "/a", None, "click", 0), ("t", "s", "u", "/b", None, "click", 7200)])
    between = make([("t", "other", "u", "/a", None, "click", 7205)])  # lateness is judged by the watermark one batch before
    late = make([("t", "s", "u", "/late", None, "click", 100)])
    counted = {}
    for build in (sessions.session_stream, sessions.bounded_session_stream):
        base = work_dir(spark, "out")
        query = sinks.run_available(build(write_stream(spark, [first, between, late, SENTINEL])), f"{base}/cp", path=f"{base}/o")
        assert spark.read.parquet(f"{base}/o").filter("session_id = 's'").agg(F.sum("event_count")).first()[0] == 2
        counted[build.__name__] = metrics.dropped_late(query)
    assert counted["bounded_session_stream"] == 1, counted


def test_out_of_order_event_ahead_of_the_watermark_counts(spark):
    first = make([("t", "s", "u", "/a", None, "click", 0), ("t", "s", "u", "/b", None, "click", 600)])
    early = make([("t", "s", "u", "/c", None, "click", 595)])
    base = work_dir(spark, "out")
    sinks.run_available(sessions.session_stream(write_stream(spark, [first, early, SENTINEL])), f"{base}/cp", path=f"{base}/o")
    row = spark.read.parquet(f"{base}/o").filter("session_id = 's'").first()
    assert (row["event_count"], row["duration_seconds"]) == (3, 600.0)


def stream_of(spark, build, batches):
    """A stream that gets one file after the other, each run to its end, so the watermark of a file holds for the next."""
    base, ddl = work_dir(spark, "steps"), spark.createDataFrame([], DDL).schema
    for rows in batches:
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(f"{base}/in")
        sinks.run_available(build(spark.readStream.schema(ddl).parquet(f"{base}/in")), f"{base}/cp", path=f"{base}/o")
    return spark.read.parquet(f"{base}/o")


def test_an_event_between_two_runs_joins_them(spark):
    # 0:00, 30:05, 29:57: the second comes before the watermark has closed the first
    batches = [make([("t", "s", "u", "/a", "p", "click", 0)]), make([("t", "s", "v", "/b", "q", "click", 1805)]), make([("t", "s", "w", "/a", "q", "click", 1797)]), SENTINEL]
    got = []
    for build in (sessions.session_stream, sessions.bounded_session_stream):
        out = stream_of(spark, build, batches).filter("session_id = 's'")
        got.append([tuple(r) for r in out.select(*COLS, "duration_seconds", "is_conversion").collect()])
    assert got[0] == got[1] and [(r[2], *r[5:8], r[11], r[12]) for r in got[1]] == [("u", 3, 2, 2, 1805.0, False)]


def test_bounded_stream_over_shuffled_batches(spark):
    # steps of five minutes, arrivals up to an hour out of order, within a delay of two hours
    rng = random.Random(5)
    rows = make([("t", rng.choice("ab"), rng.choice("uv"), rng.choice(["/a", "/b", "/checkout", None]), rng.choice([None, "p", "q"]),
                  rng.choice(["click", "add_to_cart"]), 300 * rng.randint(0, 600)) for _ in range(240)])
    shuffled = sorted(rows, key=lambda r: (r[6] + timedelta(seconds=rng.randint(0, 3600)), r[7]))
    batches = [*(shuffled[i : i + 40] for i in range(0, 240, 40)), SENTINEL]
    out = stream_of(spark, lambda s: sessions.bounded_session_stream(s, delay="2 hours"), batches)
    assert rows_of(out.filter("session_id <> 'end'")) == brute(rows)


def test_sessions_past_the_flag_are_counted_whole(spark):
    rows = make([("t", "s", "u", f"/p{i % 1300}", f"d{i % 1100}", "click", i) for i in range(2600)])
    few = make([("t", "few", "u", f"/p{i}", None, "click", i) for i in range(1000)])
    flagged = []
    for build in (sessions.session_stream, sessions.bounded_session_stream):
        base = work_dir(spark, "out")
        sinks.run_available(build(write_stream(spark, [rows[:1000] + few, rows[1000:], SENTINEL])), f"{base}/cp", path=f"{base}/o")
        flagged.append(rows_of(spark.read.parquet(f"{base}/o").filter("session_id <> 'end'")))
    assert flagged[0] == flagged[1]
    assert [(r[1], *r[5:8], *r[9:]) for r in flagged[1]] == [("few", 1000, 1000, 0, False, False), ("s", 2600, 1300, 1100, True, True)]


def test_batches_of_a_key_are_folded_in_any_order():
    rows = random_rows(600, hot=1)
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in DDL.split(", ")]).sample(frac=1, random_state=1)
    frames = [frame.iloc[i : i + 50] for i in range(0, len(frame), 50)]
    one, many = (sessions.BoundedSessions()._parts(iter(x)) for x in ([frame], frames))
    assert one == many and sum(p[3] for p in one) == 600
