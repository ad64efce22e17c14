"""Structured Streaming jobs: listing upserts, article dedup, rolling and daily figures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from terravalor.operators import ingest
from terravalor.session import materialize, names_in, path_exists


def read_drops(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a drop folder; the checkpoint remembers which were seen."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_to_end(stream, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; a restart with the same checkpoint skips seen files."""
    query = stream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


class BatchLog:
    """A table kept as a log of batches, folded now and then, that reads resolve.

    A batch is written to a folder that bears its number, so a replay changes nothing. Every
    ``fold_every`` batches the log so far is resolved into one folder; reads take the newest that
    is whole and the batches after it, so they never grow with the age of the log.
    """

    def __init__(self, spark: SparkSession, root: str, schema, resolve: Callable[[DataFrame], DataFrame], fold_every: int = 16) -> None:
        self.spark, self.root, self.resolve, self.fold_every = spark, root, resolve, fold_every
        self.stored = StructType([*schema.fields, StructField("batch", LongType())])

    def put(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.root}/log/batch={batch_id}")
        if (batch_id + 1) % self.fold_every == 0:
            self.fold(batch_id)

    def folded(self) -> int:
        """The last batch that is folded; -1 for none."""
        whole = [n for n in names_in(self.spark, f"{self.root}/folded") if path_exists(self.spark, f"{self.root}/folded/{n}/_SUCCESS")]
        return max((int(n.split("=")[1]) for n in whole), default=-1)

    def rows(self, upto: int | None = None) -> DataFrame:
        """What reads resolve: the newest fold and the batches after it."""
        last = self.folded()
        after = [int(n.split("=")[1]) for n in names_in(self.spark, f"{self.root}/log") if n.startswith("batch=")]
        wanted = [f"{self.root}/log/batch={n}" for n in after if n > last and (upto is None or n <= upto)]
        log = self.spark.createDataFrame([], self.stored)
        if wanted:
            log = self.spark.read.schema(self.stored).option("basePath", f"{self.root}/log").parquet(*wanted)
        return log.unionByName(self.spark.read.schema(self.stored).parquet(f"{self.root}/folded/upto={last}")) if last >= 0 else log

    def fold(self, upto: int) -> None:
        if upto > self.folded():
            self.resolve(self.rows(upto)).write.mode("overwrite").parquet(f"{self.root}/folded/upto={upto}")

    def current(self) -> DataFrame:
        return self.resolve(self.rows()).drop("batch")


def newest(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Of each key the row of its last batch."""
    return lambda log: ingest.latest_by_key(log, keys, [F.col("batch").desc()])


class ListingStore:
    """Listings by number: the newest version with the earliest first-seen date."""

    def __init__(self, spark: SparkSession, root: str, schema, fold_every: int = 16) -> None:
        self.log = BatchLog(spark, root, schema, self._resolve, fold_every)

    @staticmethod
    def _resolve(log: DataFrame) -> DataFrame:
        seen = log.groupBy("mls_number").agg(F.min("first_seen_date").alias("_seen"))
        latest = newest(["mls_number"])(log)
        return latest.join(seen, "mls_number").withColumn("first_seen_date", F.col("_seen")).drop("_seen")

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """A batch writes only its own newest rows: its cost follows the batch, not the table."""
        self.log.put(ingest.upsert_listings(batch.limit(0), batch), batch_id)

    def latest(self) -> DataFrame:
        return self.log.current()


def upsert_stream(
    spark: SparkSession, drops: DataFrame, root: str, checkpoint: str, on_new: Callable[[int, int], None] | None = None, fold_every: int = 16
) -> ListingStore:
    """Merge every batch of listings; ``on_new(batch_id, rows)`` fires when rows arrived."""
    store = ListingStore(spark, root, drops.schema, fold_every)

    def merge(batch: DataFrame, batch_id: int) -> None:
        arrived = materialize(batch)  # read from the source once: merged and counted from here
        store.upsert(arrived, batch_id)
        rows = arrived.count() if on_new is not None else 0
        if rows:
            on_new(batch_id, rows)

    run_to_end(drops.writeStream.foreachBatch(merge), checkpoint, "update")
    return store


def first_of_url(rows: DataFrame) -> DataFrame:
    """The article of each url that was seen first: by batch, then by time and id."""
    batch = [F.col("batch").asc()] if "batch" in rows.columns else []
    return ingest.latest_by_key(rows, ["url"], [*batch, F.col("seen_at").asc_nulls_last(), F.col("doc_id").asc()])


def article_stream(spark: SparkSession, articles: DataFrame, root: str, checkpoint: str, fold_every: int = 16) -> BatchLog:
    """Insert-or-ignore by url over all time; ``articles`` has url, doc_id and seen_at.

    A batch keeps the first article of each url. What came in an earlier batch is one more row
    of the log, which reads ignore and the next fold drops. So there is no state to bound, a url
    that comes again after years is still ignored, and which article stays does not hang on the
    order of tasks, as it would with Spark's own dropping of duplicates.
    """
    log = BatchLog(spark, root, articles.schema, first_of_url, fold_every)
    run_to_end(articles.writeStream.foreachBatch(lambda batch, n: log.put(first_of_url(batch), n)), checkpoint)
    return log


def rolling_counts(events: DataFrame, ts: str, key: str, size: str = "7 days", step: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Counts and sums over sliding windows; rows later than the delay are dropped."""
    return (
        events.withWatermark(ts, delay).groupBy(F.window(ts, size, step), key)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("window_start"), key, "n", "total")
    )


def daily_totals(events: DataFrame, ts: str, delay: str = "2 days") -> DataFrame:
    return (
        events.withWatermark(ts, delay).groupBy(F.window(ts, "1 day"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value"))
        .select(F.col("window.start").alias("day"), "n", "mean_value", "max_value")
    )


def window_stream(spark: SparkSession, windows: DataFrame, keys: list[str], root: str, checkpoint: str, fold_every: int = 16) -> BatchLog:
    """Figures of all windows as data arrives, from a watermarked aggregate.

    A batch hands on only the windows it changed, and windows that the watermark has passed leave
    the state for good. They are merged by (window, batch): the last batch of a window holds it.
    """
    log = BatchLog(spark, root, windows.schema, newest(keys), fold_every)
    run_to_end(windows.writeStream.foreachBatch(log.put), checkpoint, "update")
    return log


def late_rows(spark: SparkSession, events: DataFrame, ts: str, window_end: Column, delay: str, root: str, checkpoint: str) -> DataFrame:
    """The rows that came after the watermark had passed their (last) window, which no window holds.

    Spark holds a batch's rows against the watermark of the batch before: the latest time of all
    batches up to the last but one, less the delay. Each batch notes the latest time so far.
    """
    log = BatchLog(spark, root, events.schema, lambda rows: rows, fold_every=1 << 40)

    def latest_at(batch_id: int) -> Column:
        known = batch_id >= 0 and path_exists(spark, f"{root}/marks/{batch_id}")
        return F.lit(spark.read.schema("latest timestamp").parquet(f"{root}/marks/{batch_id}").first().latest if known else None).cast("timestamp")

    def put(batch: DataFrame, batch_id: int) -> None:
        arrived = materialize(batch)
        arrived.agg(F.greatest(F.max(ts), latest_at(batch_id - 1)).alias("latest")).write.mode("overwrite").parquet(f"{root}/marks/{batch_id}")
        log.put(arrived.where(window_end <= latest_at(batch_id - 2) - F.expr(f"INTERVAL {delay}")), batch_id)

    run_to_end(events.writeStream.foreachBatch(put), checkpoint)
    return log.current()
