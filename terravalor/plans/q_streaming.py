"""Streaming queries, run to the end of the given rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravalor.plans.registry import query
from terravalor.session import landing_path
from terravalor.streaming import jobs


def _drops(t):
    """Listings in sale order as files, older ones first."""
    folder = landing_path(t.spark, "drops")
    rows = t("px_sold")
    for part in (rows.where(F.col("sold_date") < "1998-01-01"), rows.where(F.col("sold_date") >= "1998-01-01")):
        part.write.mode("append").parquet(folder)
    return jobs.read_drops(t.spark, folder, rows.schema)


@query("z01_z02_listing_upserts", "SELECT mls_number, sold_price, sold_date, f AS first_seen_date FROM (SELECT * FROM o_sold) s JOIN (SELECT mls_number, min(first_seen_date) AS f FROM px_sold GROUP BY 1) m USING (mls_number)")
def z02(t):
    store = jobs.upsert_stream(t.spark, _drops(t), landing_path(t.spark, "store"), landing_path(t.spark, "store-state"))
    return store.latest().select("mls_number", "sold_price", "sold_date", "first_seen_date")


def _in_files(t, name: str, parts: list) -> str:
    """Rows as files, one after another: a batch of the stream takes one."""
    folder = landing_path(t.spark, name)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder


@query("z03_new_articles", "SELECT url, min_by(doc_id, (coalesce(published_day, 20240101), doc_id)) AS doc_id FROM px_news GROUP BY 1")
def z03(t):
    """The first article of every url, as articles come in by day of publication."""
    seen = F.to_timestamp(F.coalesce("published_day", F.lit(20240101)).cast("string"), "yyyyMMdd")
    rows = t("px_news").select("url", "doc_id", seen.alias("seen_at"))
    parts = [rows.where(F.dayofmonth("seen_at").between(a, a + 6)) for a in (1, 8, 15, 22)]
    drops = jobs.read_drops(t.spark, _in_files(t, "news", parts), rows.schema, 1)
    log = jobs.article_stream(t.spark, drops, landing_path(t.spark, "articles"), landing_path(t.spark, "articles-state"), fold_every=2)
    return log.current().select("url", "doc_id")


#: Every fiftieth event of the first ten days comes with the last ones, long after the watermark.
LATE = "event_id % 50 = 0 AND day(ts) <= 10"


def _events(t):
    """Events in four files by time; late ones in the last."""
    rows = t("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    on_time = rows.where(f"NOT ({LATE})")
    parts = [on_time.where(f"day(ts) > {a} AND day(ts) <= {b}") for a, b in ((0, 10), (10, 20), (20, 25))]
    parts.append(on_time.where("day(ts) > 25").unionByName(rows.where(LATE)))
    return jobs.read_drops(t.spark, _in_files(t, "events", parts), rows.schema, 1)


@query(
    "z04_rolling_week",
    f"""WITH e AS (SELECT event_type, value, unnest([0, 1, 2, 3, 4, 5, 6]) AS k, date_trunc('day', ts) AS d FROM events WHERE NOT ({LATE}))
       SELECT CAST(d - to_days(CAST(k AS INTEGER)) AS DATE) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM e GROUP BY 1, 2""",
)
def z04(t):
    windows = jobs.rolling_counts(_events(t), "ts", "event_type")
    out = jobs.window_stream(t.spark, windows, ["window_start", "event_type"], landing_path(t.spark, "rolling"), landing_path(t.spark, "rolling-state"), fold_every=2).current()
    return out.select(F.to_date("window_start").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query(
    "z05_daily_totals",
    f"SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, round(avg(value), 6) AS mean_value, max(value) AS max_value FROM events WHERE NOT ({LATE}) GROUP BY 1",
)
def z05(t):
    windows = jobs.daily_totals(_events(t), "ts")
    out = jobs.window_stream(t.spark, windows, ["day"], landing_path(t.spark, "daily"), landing_path(t.spark, "daily-state")).current()
    return out.select(F.to_date("day").alias("day"), "n", F.round("mean_value", 6).alias("mean_value"), "max_value")


@query("z05_late_events", f"SELECT event_id, event_type, CAST(ts AS DATE) AS day FROM events WHERE {LATE}")
def z05l(t):
    """Events that came after their day was closed: none is lost without a trace."""
    end = F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY")
    out = jobs.late_rows(t.spark, _events(t), "ts", end, "2 days", landing_path(t.spark, "late"), landing_path(t.spark, "late-state"))
    return out.select("event_id", "event_type", F.to_date("ts").alias("day"))


@query("z06_retrain_signal", "SELECT CAST(count(*) AS BIGINT) AS new_rows FROM px_sold")
def z06(t):
    arrived: list[tuple[int, int]] = []
    jobs.upsert_stream(
        t.spark, _drops(t), landing_path(t.spark, "store"), landing_path(t.spark, "store-state"), lambda batch, rows: arrived.append((batch, rows))
    )
    signals = t.spark.createDataFrame(arrived, "batch long, rows long")
    return signals.agg(F.sum("rows").alias("new_rows"))
