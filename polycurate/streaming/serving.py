"""The serving log as streams and tables. Each batch function takes a static or a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import anonymised_ip, lookup

REQUESTS = "question_id string, language string, latency_ms double, ip_hash string, ts timestamp"
FEEDBACK = "question_id string, rating int, comment string, flagged boolean, ts timestamp"
#: Limits of the service.
REQUEST_LIMIT, FEEDBACK_LIMIT, LOW_RATING = 100, 30, 2
SERIOUS_FLAGS, PAUSE_WINDOW = 5, "7 days"
LATENESS = "10 minutes"


def request_events(df: DataFrame, question: Column, language: Column, latency: Column, client: Column, ts: Column) -> DataFrame:
    return df.select(question.cast("string").alias("question_id"), language.alias("language"), F.bround(latency, 1).alias("latency_ms"), anonymised_ip(client.cast("string")).alias("ip_hash"), ts.cast("timestamp").alias("ts"))


def feedback_events(df: DataFrame, question: Column, rating: Column, comment: Column, ts: Column) -> DataFrame:
    return df.select(question.cast("string").alias("question_id"), rating.cast("int").alias("rating"), comment.alias("comment"), (rating <= LOW_RATING).alias("flagged"), ts.cast("timestamp").alias("ts"))


def flagged(feedback: DataFrame) -> DataFrame:
    return feedback.filter("flagged")


def metrics(requests: DataFrame) -> DataFrame:
    """Requests and average latency by language."""
    return requests.groupBy("language").agg(F.count("*").alias("requests"), F.avg("latency_ms").alias("avg_latency_ms"))


def feedback_totals(feedback: DataFrame) -> DataFrame:
    return feedback.agg(F.count("*").alias("feedback_total"), F.count_if("flagged").alias("flagged_total"))


def over_limit(events: DataFrame, client: str, limit: int, ts: str = "ts", width: str = "1 minute") -> DataFrame:
    """(client, window_start, n, limited): events of each client and window, and whether they exceed the limit."""
    watched = events.withWatermark(ts, LATENESS) if events.isStreaming else events
    counts = watched.groupBy(client, F.window(ts, width).alias("w")).agg(F.count("*").alias("n"))
    return counts.select(client, F.col("w.start").alias("window_start"), "n", (F.col("n") > limit).alias("limited"))


def pauses(flags: DataFrame, ts: str = "ts", limit: int = SERIOUS_FLAGS, width: str = PAUSE_WINDOW, slide: str = "1 day") -> DataFrame:
    """Sliding windows with enough serious flags to pause the service (policy text, no reference code)."""
    watched = flags.withWatermark(ts, LATENESS) if flags.isStreaming else flags
    counts = watched.groupBy(F.window(ts, width, slide).alias("w")).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "n").filter(F.col("n") >= limit)


def retained(events: DataFrame, now: Column, days: int, ts: str = "ts") -> DataFrame:
    """Events of the last days (policy text, no reference code)."""
    return events.filter(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


def routed(detected: list[Column], text: Column, known: dict[str, str], default: str = "Eng") -> Column:
    """The first detector's known code, else Amharic by its script, else the default."""
    codes = [lookup(d, known) for d in detected]
    return F.coalesce(*codes, F.when(text.rlike("[\\u1200-\\u137F]"), F.lit(known.get("am", default))), F.lit(default))


def disclaimer(subset: Column, texts: dict[str, str], default: str) -> Column:
    return lookup(subset, texts, F.lit(default))


def monthly_flags(flags: DataFrame, ts: str = "ts", by: tuple[str, ...] = ("category", "status")) -> DataFrame:
    return flags.groupBy(F.date_trunc("month", ts).alias("month"), *by).agg(F.count("*").alias("n"))


def append_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _write_batch(rows: DataFrame, folder: str, batch: int) -> None:
    """One batch's rows in a folder of their own, so that writing the batch again replaces them."""
    rows.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={batch}")


def append_feedback(stream: DataFrame, log: str, flags: str, checkpoint: str, written: Callable[[str, int], None] = lambda sink, batch: None) -> StreamingQuery:
    """Every feedback event goes to `log`, and those that are flagged to `flags` as well.

    Both sinks are keyed by the stream's batch number: a query that ends between the two writes and is started again with its
    checkpoint replaces what the unfinished batch wrote, so each event stands in each sink once. `written` is called after each write.
    """

    def write(rows: DataFrame, batch: int) -> None:
        _write_batch(rows, log, batch)
        written("log", batch)
        _write_batch(flagged(rows), flags, batch)
        written("flags", batch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_batches(spark: SparkSession, folder: str, schema: str = FEEDBACK) -> DataFrame:
    """The rows of a sink of `append_feedback`."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder)


def live_table(stream: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    return stream.writeStream.format("memory").outputMode(mode).queryName(name).trigger(availableNow=True).start()


def read_log(spark: SparkSession, path: str, schema: str = REQUESTS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
