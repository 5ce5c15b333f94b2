"""Hosted models: many calls at once, within a shared rate, and answers that are kept as rounds of them end."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scorers import with_retries
from .sources.io import exists, folders_of
from .sources.scratch import discard, settled

ANSWERS = "key string, answer string"


class Pace:
    """Lets callers through at most `rate` times a second, whichever thread they come from; None: at once."""

    def __init__(self, rate: float | None):
        self.gap, self.next, self.lock = 1.0 / rate if rate else 0.0, 0.0, Lock()

    def wait(self) -> None:
        with self.lock:
            now = time.monotonic()
            at = max(now, self.next)
            self.next = at + self.gap
        time.sleep(max(0.0, at - now))


class HostedScorer:
    """A model behind a remote call, as a scorer: every distinct prompt is asked once, however many rows have it.

    connect: gives the call, once for each task. Prompts are dealt by their hash into rounds of about `tasks * per_task`; a round is one
    job of `tasks` tasks, each with up to `concurrency` calls under way. Tasks share `rate` calls a second evenly, so all of them
    together stay within it. Each round's answers are a folder of `journal`: after a failure only prompts without an answer there are
    asked, and a lost task asks again for its own prompts of one round at most. A prompt whose tries all fail gives the default, and is
    asked again by the next call. Null prompts are not asked and give the default.
    """

    def __init__(
        self, connect: Callable[[], Callable[[str], str]], journal: str, concurrency: int = 8, rate: float | None = None, tasks: int = 8, per_task: int = 64,
        tries: int = 3, base: float = 2.0, default: str = "",
    ):
        self.connect, self.journal, self.concurrency, self.rate, self.tasks, self.per_task = connect, journal.rstrip("/"), concurrency, rate, tasks, per_task
        self.tries, self.base, self.default = tries, base, default

    def kept(self, spark: SparkSession) -> DataFrame:
        """(key, answer) of the journal's ended rounds."""
        folders = [f for f in folders_of(spark, self.journal) if exists(spark, f"{f}/_SUCCESS")]
        rows = spark.read.schema(ANSWERS).parquet(*folders) if folders else spark.createDataFrame([], ANSWERS)
        return rows.filter("answer is not null").groupBy("key").agg(F.max("answer").alias("answer"))

    def _asked(self, prompts: DataFrame) -> DataFrame:
        """(key, answer) of distinct prompts (key, prompt); null where all tries failed."""
        connect, concurrency, tries, base, rate = self.connect, self.concurrency, self.tries, self.base, self.rate and self.rate / self.tasks

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call, pace = connect(), Pace(rate)

            def paced(prompt: str) -> str:
                pace.wait()
                return call(prompt)

            one = with_retries(paced, tries, base, None)
            with ThreadPoolExecutor(concurrency) as pool:
                for frame in batches:
                    yield frame[["key"]].assign(answer=list(pool.map(one, frame["prompt"])))

        return prompts.repartition(self.tasks, "key").select("key", "prompt").mapInPandas(ask, ANSWERS)

    def answers(self, prompts: DataFrame) -> DataFrame:
        """(key, answer) of the journal, after all prompts (key, prompt) that it lacks have been asked."""
        spark = prompts.sparkSession
        left = settled(prompts.join(self.kept(spark), "key", "left_anti"), "prompts")
        rounds = -(-left.count() // (self.tasks * self.per_task))
        number = F.pmod(F.xxhash64("key"), F.lit(max(1, rounds)))
        dealt = settled(left.repartitionByRange(number).sortWithinPartitions(number).withColumn("round", number), "rounds")  # a round reads its own stretch
        for r in range(rounds):
            self._asked(dealt.filter(F.col("round") == r)).write.parquet(f"{self.journal}/{uuid.uuid4().hex}")
        discard(left, dealt)
        return self.kept(spark)

    def score(self, df: DataFrame, inputs: list[str], output: str) -> DataFrame:
        """df with the answer to the prompt, the one column of inputs."""
        (prompt,) = inputs
        key = F.sha2(F.col(prompt), 256)
        prompts = df.filter(F.col(prompt).isNotNull()).groupBy(key.alias("key")).agg(F.any_value(prompt).alias("prompt"))
        found = self.answers(prompts).select(F.col("key").alias("_key"), F.col("answer").alias(output))
        return df.join(found, key == F.col("_key"), "left").withColumn(output, F.coalesce(output, F.lit(self.default))).drop("_key")
