"""Stages of the second generation from the command line, each reading what the stages before it wrote.

    python -m polycurate.plans.runner --train rows.csv --out folder [--config clean.yaml] [--skip merge] [--table stage=path ...]

No model is shipped. Stages that need one read its outputs from tables given by --table: `scores` (ID, q_lang, q_lang_conf, a_lang,
a_lang_conf, qa_cos), `backtranslated` (ID, rewritten), `transferred` (input, output, subset, source, relevance, code, confidence)
and `paraphrased` (ID, rewritten, relevance). A stage without its table is left out, as one that is skipped.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cascade, sampling
from ..scorers import ACCEPTED_CODES, codes_of, language_accepted
from ..sources import config as C
from ..sources import io
from . import pipelines as P
from .views import with_metrics

STAGES = ("diagnose", "clean", "backtranslate", "transfer", "paraphrase", "merge")
NEEDS = {"backtranslate": "backtranslated", "transfer": "transferred", "paraphrase": "paraphrased"}
# Rows wanted of each language, and what cleaning allows by default.
DEFAULTS = {
    "targets": {"Amh_Eth": 1500, "Lug_Uga": 1500, "Swa_Ken": 1500},
    "min_q_tokens": 3, "min_a_tokens": 5, "max_a_tokens": 400, "max_repetition_ratio": 0.5, "near_dup_threshold": 0.88, "merge_threshold": 0.85,
    "max_per_language": {}, "per_language": {},
}


class Run:
    """One folder of stage outputs."""

    def __init__(self, spark: SparkSession, train: str, out: str, config: dict, tables: dict[str, str]):
        self.spark, self.train, self.out, self.config = spark, train, out.rstrip("/"), config
        self.tables = {name: self._table(path) for name, path in tables.items()}

    def _table(self, path: str) -> DataFrame:
        return io.read_csv(self.spark, path) if path.endswith(".csv") else self.spark.read.parquet(path)

    def read(self, name: str) -> DataFrame | None:
        path = f"{self.out}/{name}"
        return self.spark.read.parquet(path) if io.exists(self.spark, path) else None

    def write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.out}/{name}")

    def diagnose(self) -> None:
        source = io.require_columns(io.read_csv(self.spark, self.train), ("input", "output", "subset"))
        rows = source if "ID" in source.columns else source.withColumn("ID", F.lit(None).cast("string"))
        rows = sampling.positions(rows.select("ID", "input", "output", "subset"), [F.col("subset"), F.md5(F.concat_ws("|", "input", "output"))], "ord")
        rows = with_metrics(io.clean_rows(rows.withColumns({c: T.clean_whitespace(F.col(c)) for c in ("input", "output")})))
        scores = self.tables.get("scores")
        if scores is not None:
            rows = rows.join(scores.select("ID", "q_lang", F.col("q_lang_conf").cast("double"), "a_lang", F.col("a_lang_conf").cast("double"), F.col("qa_cos").cast("double")), "ID", "left")
            accepted = codes_of(F.col("subset"), ACCEPTED_CODES)
            rows = rows.withColumns({f"{x}_lang_ok": language_accepted(F.col(f"{x}_lang"), F.col(f"{x}_lang_conf"), accepted) for x in "qa"})
        else:  # nothing is known of them: rules that need them hold no row back
            rows = rows.withColumns({"q_lang_ok": F.lit(True), "a_lang_ok": F.lit(True), "qa_cos": F.lit(None).cast("double")})
        self.write(rows, "diagnostic")
        rows = self.read("diagnostic")
        summary = P.summary_of(rows, P.near_dup_rates(rows, P.DIAGNOSED_SAMPLE))
        self.write(summary, "summary")
        io.write_json_report(P.issues_of(self.read("summary")), f"{self.out}/issues")

    def clean(self) -> None:
        c = self.config
        own = {tag: (entry or {}).get("qa_cos_min") for tag, entry in c["per_language"].items()}
        limits = P.CleanLimits(c["min_q_tokens"], c["min_a_tokens"], c["max_a_tokens"], c["max_repetition_ratio"], c["near_dup_threshold"])
        limits = P.CleanLimits(**{**limits.__dict__, "qa_cos_min": limits.qa_cos_min | {tag: x for tag, x in own.items() if x is not None}})
        kept, dropped = P.clean_second_generation(self.read("diagnostic"), limits)
        self.write(kept, "clean")
        io.write_json_report(cascade.drop_report(dropped), f"{self.out}/drops")
        both = self.read("diagnostic").select("ord").join(self.read("clean").select("ord", F.lit(True).alias("kept")), "ord", "left")
        io.write_json_report(cascade.kept_totals(both.withColumn("drop_reason", F.when(F.col("kept").isNull(), F.lit("dropped")))), f"{self.out}/totals")

    def backtranslate(self) -> None:
        made = self.tables["backtranslated"].select("ID", "rewritten")
        self.write(P.back_translations(self.read("clean"), lambda rows: rows.join(made, "ID"), self.config["targets"]), "backtranslated")

    def transfer(self) -> None:
        rows = self.tables["transferred"].withColumns({c: F.col(c).cast("double") for c in ("relevance", "confidence")})
        union = None
        for tag, n in self.config["targets"].items():
            part = P.transferred(rows.filter(F.col("subset") == tag), n, tag, "Eng_Gha", F.col("relevance"), (F.col("code"), F.col("confidence")))
            union = part if union is None else union.unionByName(part)
        if union is not None:
            self.write(union, "transferred")

    def paraphrase(self) -> None:
        made = self.tables["paraphrased"].select("ID", "rewritten", F.col("relevance").cast("double").alias("relevance"))
        asked = P.paraphrase_candidates(self.read("diagnostic"), self.config["targets"])
        self.write(P.paraphrases(asked.join(made, "ID"), self.config["targets"], F.col("relevance")), "paraphrased")

    def merge(self) -> None:
        added = [df.select("input", "output", "subset", "aug_method") for name in ("backtranslated", "transferred", "paraphrased") if (df := self.read(name)) is not None]
        io.write_with_provenance(P.merge(self.read("clean"), added, self.config["max_per_language"], self.config["merge_threshold"]), f"{self.out}/final")


def run(spark: SparkSession, train: str, out: str, config: dict | None = None, tables: dict[str, str] | None = None, skip: tuple[str, ...] = (), only: tuple[str, ...] = STAGES) -> list[str]:
    """Runs the stages in order; returns those that ran."""
    work = Run(spark, train, out, C.merged(DEFAULTS, config), tables or {})
    ran = []
    for name in STAGES:
        if name in skip or name not in only or NEEDS.get(name, "") not in {"", *work.tables}:
            continue
        getattr(work, name)()
        ran.append(name)
    return ran


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("--train", required=True, help="CSV of ID, input, output, subset")
    parser.add_argument("--out", required=True, help="folder of the stages' outputs")
    parser.add_argument("--config", help="YAML or JSON over the defaults")
    parser.add_argument("--skip", nargs="*", default=[], choices=STAGES)
    parser.add_argument("--only", nargs="*", default=list(STAGES), choices=STAGES)
    parser.add_argument("--table", nargs="*", default=[], metavar="NAME=PATH", help="outputs of models")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    given = arguments(argv)
    spark = SparkSession.builder.appName("polycurate").getOrCreate()
    ran = run(spark, given.train, given.out, C.read_config(given.config, DEFAULTS), dict(t.split("=", 1) for t in given.table), tuple(given.skip), tuple(given.only))
    print("ran:", ", ".join(ran))


if __name__ == "__main__":
    main()
