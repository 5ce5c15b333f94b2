"""Sources and sinks that survive failures: one scan of many files, marked partitions, the bucketed cache, counts taken while writing."""

from __future__ import annotations

import gzip
import time
import uuid

import pytest
from pyspark.sql import functions as F

from polycurate.sources import io

ROWS = "ID int, subset string"


def jobs_of(spark, work):
    """work() and how many Spark jobs it ran."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        made = work()
        return made, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()


def test_a_thousand_files_in_one_scan(spark, tmp_path):
    for k in range(1000):
        (tmp_path / f"f{k:04d}.csv").write_text(f"input,output,subset\nquestion {k},answer {k},en\n ,blank,en\n")
    (tmp_path / "f0007.csv").write_text("subset,input,other,output,source\nde,q7,x,a7,own\nde,q8,x,a8,\n")  # another order of columns
    (tmp_path / "f0010.csv").write_text("input,output\nq,a\n")
    (tmp_path / "f0011.csv").write_text("input,output,subset\nq,a,en\nq,a,en,more\n")
    (tmp_path / "f0012.csv").write_text('input,output,subset\n"two\nlines, ""quoted""",a,en\nshort,a\n')
    (tmp_path / "f0013.csv").write_text("")
    (rows, wrong), jobs = jobs_of(spark, lambda: io.read_external(spark, str(tmp_path)))
    got = {(r.input, r.source) for r in rows.collect()}
    assert {n.rsplit("/", 1)[-1]: w for n, w in wrong.items()} == {
        "f0010.csv": "lacks subset", "f0011.csv": "has rows of more fields than its header", "f0013.csv": "lacks input, output, subset",
    }
    assert len(got) == 995 + 2 + 1
    assert {("q7", "own"), ("q8", "f0007"), ('two\nlines, "quoted"', "f0012"), ("question 999", "f0999")} <= got
    assert jobs <= 5  # the listing of the files, one scan that writes, and what tells the torn files


def test_a_file_that_cannot_be_read_stands_alone(spark, tmp_path):
    for k in range(9):
        (tmp_path / f"{k}.csv").write_text(f"input,output,subset\nq{k},a,en\n")
    (tmp_path / "torn.csv.gz").write_bytes(gzip.compress(b"input,output,subset\n" + b"q,a,en\n" * 20_000)[:-40])
    rows, wrong = io.read_external(spark, str(tmp_path))
    assert rows.count() == 9
    assert [n.rsplit("/", 1)[-1] for n in wrong] == ["torn.csv.gz"]
    assert io.read_external(spark, f"{tmp_path}/nothing") == (None, {})


def test_partitions_without_a_mark_are_made_again(spark, tmp_path):
    path, asked = f"{tmp_path}/parts", []
    rows = spark.createDataFrame([(i, s) for i in range(6) for s in ("de", "en", "fr/x y")], ROWS)

    def make(value):
        asked.append(value)
        own = rows.filter(F.col("subset") == value)
        return own.withColumn("ID", F.expr("if(ID = 3, raise_error('failed midway'), ID)").cast("int")) if value == "en" and asked.count("en") == 1 else own

    with pytest.raises(Exception, match="failed midway"):
        io.write_missing_partitions(make, path, values=["de", "en", "fr/x y", "es"], spark=spark)
    assert io.finished_partitions(spark, path) == ["de"]
    rows.filter("subset = 'en' and ID < 2").drop("subset").write.parquet(f"{path}/subset=en")  # half of a partition, no mark
    assert io.write_missing_partitions(make, path, values=["de", "en", "fr/x y", "es"], spark=spark) == ["de"]
    assert asked == ["de", "en", "en", "fr/x y", "es"]
    assert io.write_missing_partitions(make, path, values=["de", "en", "fr/x y", "es"], spark=spark) == ["de", "en", "es", "fr/x y"]
    key = lambda r: (r.ID, r.subset)
    assert sorted(map(key, spark.read.parquet(path).collect())) == sorted(map(key, rows.collect()))


def test_a_whole_frame_by_partitions(spark, tmp_path):
    path = f"{tmp_path}/parts"
    rows = spark.createDataFrame([(1, "de"), (2, "en"), (3, None)], ROWS)
    assert io.write_missing_partitions(rows.filter("ID <> 2"), path) == []
    assert sorted(io.write_missing_partitions(rows, path)) == [io.NO_VALUE, "de"]
    assert sorted(r.ID for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_cache_is_read_where_it_lies(spark, tmp_path):
    vectors = spark.range(500).select(F.col("id").alias("ID"), F.array(F.col("id") * 1.0, F.lit(2.0)).alias("v"))
    cached = io.cached_embeddings(vectors, f"{tmp_path}/cache", "ID", {"v": F.col("v")}, buckets=4)
    rows = spark.range(0, 1000, 5).select(F.col("id").alias("ID"), F.lit("t").alias("text"))
    joined = io.with_cached(rows, cached, "ID")
    assert joined.filter("v is not null").count() == 100 and joined.count() == 200
    plan = joined._jdf.queryExecution().executedPlan().toString()
    left, right = plan[plan.index("SortMergeJoin") :].split("FileScan parquet spark_catalog")[0], "Exchange"
    assert left.count(right) == 1 and left.index(right) < left.index("Range")  # only the rows move, nothing above the cache's scan
    again = io.cached_embeddings(vectors.filter("ID < 0"), f"{tmp_path}/cache", "ID", {"v": F.col("v")}, buckets=4)
    assert again.count() == 500  # what is there is not made again
    spark.sql(f"drop table {[t.name for t in spark.catalog.listTables() if t.name.startswith('polycurate_cache_')][0]}")
    assert io.with_cached(rows, io.cached_embeddings(vectors, f"{tmp_path}/cache", "ID", {"v": F.col("v")}, buckets=4), "ID").filter("v[0] = ID").count() == 100


def test_counts_come_from_the_writing_job(spark, tmp_path):
    rows = spark.createDataFrame([(" q ", "a", "en"), ("q", " ", "en"), (None, "a", "en"), ("q", "a", "")] * 5, "input string, output string, subset string")
    (kept, counts), jobs = jobs_of(spark, lambda: io.written_clean(rows, f"{tmp_path}/clean"))
    assert counts == {"n": 20, "kept": 5, "dropped": 15} and kept.count() == 5 and kept.first().input == "q"
    assert jobs == 1
    expected = io.clean_counts(rows).first()
    assert (expected.n, expected.kept, expected.dropped) == (20, 5, 15)
    _, counts = io.written_clean(rows.limit(0), f"{tmp_path}/none")
    assert counts == {"n": 0, "kept": 0, "dropped": 0}


def test_settled_leaves_no_shuffles(spark):
    from polycurate.sources import scratch

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {f for f in files if "/shuffle_" in f}

    was, before = spark.conf.get(scratch.SHUFFLE_CLEANUP), shuffled()
    made = scratch.settled(spark.range(20_000).selectExpr("id % 1009 as k", "sha2(string(id), 256) as t").groupBy("k").agg(F.max("t").alias("t")), "test")
    end = time.monotonic() + 10
    while shuffled() - before and time.monotonic() < end:  # deleted in the background
        time.sleep(0.1)
    assert not shuffled() - before and made.count() == 1009
    assert spark.conf.get(scratch.SHUFFLE_CLEANUP) == was
