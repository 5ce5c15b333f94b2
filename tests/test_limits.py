"""The moving-window limit: table against brute force, stream against table, request by request."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest

from polycurate.streaming import limits

START = datetime(2024, 1, 1, 12)
SCHEMA = "client string, request string, ts timestamp"


def made_up(n: int):
    """Requests of one hot client and some others, many at equal times, in an order that is up to 40 seconds late."""
    draw = random.Random(8)
    rows = []
    for i in range(n):
        at = START + timedelta(seconds=draw.choice([i // 4, i // 4, i // 4 + draw.random()]))
        rows.append((draw.choice(["hot", "hot", "hot", f"c{i % 7}", None]), f"r{i:05d}", at))
    return sorted(rows, key=lambda r: (r[2] + timedelta(seconds=draw.uniform(0, 40)), r[1]))


def by_hand(rows, limit, seconds):
    out = {}
    for client, request, ts in rows:
        if ts is not None:
            earlier = [r for c, r, t in rows if t is not None and c == client and (t, r) < (ts, request) and t > ts - timedelta(seconds=seconds)]
            out[request] = len(earlier) < limit
    return out


def test_table_equals_brute_force(spark):
    rows = [*made_up(900), ("hot", "none", None)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for limit, seconds in ((5, 10), (1, 3), (100, 60)):
        got = {r.request: r.admitted for r in limits.decided(frame, "client", "request", limit, seconds=seconds).collect()}
        assert got == by_hand(rows, limit, seconds)
    assert limits.decided(frame.limit(0), "client", "request").count() == 0


def test_stream_equals_table(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rows = made_up(600)
    parts = [rows[i : i + 120] for i in range(0, 600, 120)] + [[("end", "end", START + timedelta(hours=2))], [("end", "end2", START + timedelta(hours=3))]]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    files = sorted((p for p in (tmp_path / "in").glob("part-*")), key=lambda p: p.stat().st_mtime_ns)
    assert len(files) == len(parts)
    with limits.state_store(spark):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        made = limits.decided_stream(stream, "client", "request", 5, seconds=10, lateness="1 minute")
        query = made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    got = [(r.request, r.admitted) for r in spark.read.parquet(f"{tmp_path}/out").collect() if not r.request.startswith("end")]
    expected = {r.request: r.admitted for r in limits.decided(spark.createDataFrame(rows, SCHEMA), "client", "request", 5, seconds=10).collect()}
    assert len(got) == len(expected) == 600 and dict(got) == expected
    assert not all(expected.values())
    assert sum(s["numRowsTotal"] for s in json.loads(query.lastProgress.json)["stateOperators"]) < 20  # clients whose windows ran empty are gone


@pytest.mark.parametrize("limit", [1, 2, 5])
def test_a_bucket_is_judged_in_few_calls(spark, tmp_path, limit):
    """Python was called and the state asked for each client: now for each bucket, whatever clients it holds, an unnamed one and an empty name apart."""
    pytest.importorskip("google.protobuf")
    rows = [(f"c{i % 150}" if i % 5 else [None, ""][i // 5 % 2], f"r{i}", START + timedelta(seconds=i // 40, milliseconds=i % 3)) for i in range(600)]
    for part in (rows, [("end", "end", START + timedelta(hours=2))]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    with limits.state_store(spark):
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        made = limits.decided_stream(stream, "client", "request", limit, seconds=10, lateness="1 minute", buckets=3)
        query = made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    got = {(r.client, r.request): r.admitted for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.request != "end"}
    assert got == {(r.client, r.request): r.admitted for r in limits.decided(spark.createDataFrame(rows, SCHEMA), "client", "request", limit, seconds=10).collect()}
    most = max(s["numRowsTotal"] for p in query.recentProgress for s in json.loads(p.json)["stateOperators"])
    assert len(got) == 600 and most < 50  # a state row for each bucket, its length and its timer
