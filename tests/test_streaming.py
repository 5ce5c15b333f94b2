from __future__ import annotations

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from polycurate import scorers
from polycurate.plans import views
from polycurate.streaming import serving


def test_stream_equals_batch(spark, small, tmp_path):
    requests = views.requests(spark, small)
    requests.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = serving.read_log(spark, f"{tmp_path}/in", requests._jdf.schema().toDDL())
    serving.append_log(stream, f"{tmp_path}/log", f"{tmp_path}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/log").count() == requests.count()
    serving.live_table(serving.metrics(stream), "live_metrics").awaitTermination()
    rounded = lambda df: sorted((r.language, r.requests, round(r.avg_latency_ms, 6)) for r in df.collect())
    assert rounded(spark.table("live_metrics")) == rounded(serving.metrics(requests))
    serving.live_table(serving.over_limit(stream, "ip_hash", 1), "live_limits", "update").awaitTermination()
    assert spark.table("live_limits").filter("limited").count() == serving.over_limit(requests, "ip_hash", 1).filter("limited").count()


def test_two_sinks_survive_an_end_between_their_writes(spark, small, tmp_path):
    feedback = views.feedback(spark, small)
    feedback.repartition(4).write.parquet(f"{tmp_path}/in")
    ended = []

    def end_once(sink, batch):
        if sink == "log" and batch == 2 and not ended:
            ended.append(batch)
            raise RuntimeError("ended between the two writes")

    def start():
        stream = spark.readStream.schema(feedback.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return serving.append_feedback(stream, f"{tmp_path}/log", f"{tmp_path}/flags", f"{tmp_path}/checkpoint", end_once)

    with pytest.raises(StreamingQueryException):
        start().awaitTermination()
    ids = lambda rows: sorted(r.question_id for r in rows.collect())
    assert len(ids(serving.read_batches(spark, f"{tmp_path}/log"))) > len(ids(serving.read_batches(spark, f"{tmp_path}/flags"))) > 0
    start().awaitTermination()
    assert ended == [2]
    assert ids(serving.read_batches(spark, f"{tmp_path}/log")) == ids(feedback)
    assert ids(serving.read_batches(spark, f"{tmp_path}/flags")) == ids(serving.flagged(feedback))
    start().awaitTermination()  # nothing new
    assert ids(serving.read_batches(spark, f"{tmp_path}/log")) == ids(feedback)


def test_routing_and_disclaimer(spark):
    rows = spark.createDataFrame([("sw", "habari"), (None, "ሰላም"), (None, "hello"), ("xx", "hi")], "code string, text string")
    known = {"am": "Amh_Eth", "sw": "Swa_Eas", "en": "Eng"}
    out = rows.select(serving.routed([F.col("code")], F.col("text"), known).alias("s")).select("s", serving.disclaimer(F.col("s"), {"Eng": "info only"}, "ask").alias("d")).collect()
    assert [(r.s, r.d) for r in out] == [("Swa_Eas", "ask"), ("Amh_Eth", "ask"), ("Eng", "info only"), ("Eng", "info only")]


def test_scorers(spark):
    from pyspark.sql.types import DoubleType

    rows = spark.createDataFrame([(1, "a"), (2, "bbb")], "id int, t string")
    table = spark.createDataFrame([(1, 0.5)], "id int, p double")
    assert {r.id: r.s for r in scorers.ColumnScorer("p", table, "id").score(rows, [], "s").collect()} == {1: 0.5, 2: None}
    load = lambda: lambda texts: texts.str.len().astype(float)
    assert {r.id: r.n for r in scorers.ArrowScorer(load, DoubleType(), batch=1).score(rows, ["t"], "n").collect()} == {1: 1.0, 2: 3.0}
    assert scorers.with_retries(lambda p: 1 / 0, tries=2, base=0.0, default="none")("x") == "none"
