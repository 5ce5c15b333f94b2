"""A hosted model with a client that fails, delays and ends its task: each prompt is answered once."""

from __future__ import annotations

import os
import time
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from polycurate.hosted import HostedScorer, Pace


def client(folder, ends_on=None, fails=()):
    """Connects to a call that notes its begin and its answer in files, fails once for some prompts, and ends the task once for one."""

    def connect():
        def call(prompt):
            began = time.time()
            once = f"{folder}/once-{prompt}"
            if (prompt == ends_on or prompt in fails) and not os.path.exists(once):
                open(once, "w").close()
                raise KeyboardInterrupt if prompt == ends_on else ConnectionError("try again")
            if prompt == "never":
                raise ConnectionError("never")
            time.sleep(0.01)
            with open(f"{folder}/answer-{uuid.uuid4().hex}", "w") as f:
                f.write(f"{prompt}\t{began}\t{time.time()}\t{os.getpid()}")
            return prompt.upper()

        return call

    return connect


def answered(folder):
    return [open(f"{folder}/{n}").read().split("\t") for n in os.listdir(folder) if n.startswith("answer-")]


def test_each_prompt_is_answered_once(spark, tmp_path):
    os.makedirs(f"{tmp_path}/calls")
    rows = spark.createDataFrame([(i, f"prompt {i % 60}") for i in range(150)] + [(150, None), (151, "never")], "i int, prompt string")
    connect = client(f"{tmp_path}/calls", fails=[f"prompt {k}" for k in range(0, 60, 7)])
    scorer = HostedScorer(connect, f"{tmp_path}/journal", concurrency=4, tasks=2, per_task=10, tries=2, base=0.0, default="none")
    got = {r.i: r.answer for r in scorer.score(rows, ["prompt"], "answer").collect()}
    assert got == {i: f"PROMPT {i % 60}" for i in range(150)} | {150: "none", 151: "none"}
    calls = answered(f"{tmp_path}/calls")
    assert Counter(c[0] for c in calls) == {f"prompt {k}": 1 for k in range(60)}
    for process in {c[3] for c in calls}:
        own = [(float(c[1]), float(c[2])) for c in calls if c[3] == process]
        assert max(sum(b <= at < e for b, e in own) for at, _ in own) <= 4 * 2  # a worker may hold both tasks in turn
    again = scorer.score(rows.withColumn("prompt", F.when(F.col("i") == 0, "new").otherwise(F.col("prompt"))), ["prompt"], "answer")
    assert again.filter("answer = 'NEW'").count() == 1
    assert Counter(c[0] for c in answered(f"{tmp_path}/calls")) == {f"prompt {k}": 1 for k in range(60)} | {"new": 1}
    assert scorer.score(rows.limit(0), ["prompt"], "answer").count() == 0


def test_a_job_that_ended_asks_for_what_is_left(spark, tmp_path):
    os.makedirs(f"{tmp_path}/calls")
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(80)], "i int, prompt string")
    scorer = HostedScorer(client(f"{tmp_path}/calls", ends_on="p33"), f"{tmp_path}/journal", concurrency=2, tasks=2, per_task=4, tries=1)
    with pytest.raises(Exception):  # noqa: B017  the task ends as a whole
        scorer.score(rows, ["prompt"], "answer").collect()
    kept = {r.answer.lower() for r in scorer.kept(spark).collect()}
    assert 0 < len(kept) < 80 and "p33" not in kept
    assert scorer.score(rows, ["prompt"], "answer").filter("answer = upper(prompt)").count() == 80
    calls = Counter(c[0] for c in answered(f"{tmp_path}/calls"))
    assert all(calls[p] == 1 for p in kept)  # ended rounds are not asked again
    assert set(calls) == {f"p{i}" for i in range(80)} and sum(calls.values()) <= 80 + 2 * 8  # at most the round that failed is


def test_pace():
    pace, began = Pace(50), time.monotonic()
    for _ in range(11):
        pace.wait()
    assert 0.19 < time.monotonic() - began < 1.0
    Pace(None).wait()
