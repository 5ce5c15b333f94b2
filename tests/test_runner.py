"""Configuration files and the command line."""

from __future__ import annotations

import json

import pytest
from test_pipelines import qa_rows

from polycurate.operators import sampling
from polycurate.plans import runner
from polycurate.sources import config as C
from polycurate.sources import io


def test_configuration_is_merged_by_whole_entries(tmp_path, spark):
    default = {"a": 1, "limits": {"x": 1, "y": 2}, "per_language": {"Lug_Uga": {"least": 0.1, "most": 9}, "Swa_Ken": {"least": 0.2}}}
    path = tmp_path / "c.yaml"
    path.write_text("limits: {x: 5}\nper_language:\n  Lug_Uga:\n    least: 0.3\n")
    if C.yaml is None:
        path.write_text(json.dumps({"limits": {"x": 5}, "per_language": {"Lug_Uga": {"least": 0.3}}}))
    config = C.read_config(str(path), default)
    assert config == {"a": 1, "limits": {"x": 5}, "per_language": {"Lug_Uga": {"least": 0.3}, "Swa_Ken": {"least": 0.2}}}
    assert C.read_config(str(tmp_path / "none.yaml"), default) == C.read_config(None, default) == default
    rows = {r.subset: r.least for r in C.language_table(spark, config, {"least": 0.0}).collect()}
    assert rows == {"Lug_Uga": 0.3, "Swa_Ken": 0.2}
    best = sampling.best_of_grid(spark.createDataFrame([("en", 0, 4, 0.5), ("en", 1, 8, 0.5), ("de", 0, 4, 0.1), ("de", 1, 8, 0.2)], "subset string, ord int, beams int, score double"), "subset", "score")
    C.write_back(str(path), "decoding", best.select("subset", "beams"))
    again = C.read_config(str(path), {})
    assert again["decoding"]["per_language"] == {"en": {"beams": 4}, "de": {"beams": 8}} and again["limits"] == {"x": 5}


def test_stages_from_the_command_line(spark, tmp_path):
    rows = qa_rows(spark, 45)
    io.write_csv(rows.drop("ord"), f"{tmp_path}/train.csv")
    out = f"{tmp_path}/out"
    assert runner.run(spark, f"{tmp_path}/train.csv", out, only=("diagnose", "clean")) == ["diagnose", "clean"]
    kept = spark.read.parquet(f"{out}/clean").count()
    totals = spark.read.json(f"{out}/totals").first()
    assert (totals.n_before, totals.n_after) == (45, kept) and 0 < kept <= 45
    assert spark.read.json(f"{out}/drops").agg({"count": "sum"}).first()[0] in (None, 45 - kept)
    made = rows.selectExpr("ID", "concat_ws(' ', reverse(split(input, ' '))) as rewritten")
    made.write.parquet(f"{tmp_path}/made")
    ran = runner.run(spark, f"{tmp_path}/train.csv", out, {"targets": {"Lug_Uga": 4}, "max_per_language": {"Eng_Uga": 3}}, {"backtranslated": f"{tmp_path}/made"}, skip=("diagnose", "clean"))
    assert ran == ["backtranslate", "merge"]
    final = spark.read.parquet(f"{out}/final/provenance")
    assert final.filter("subset = 'Eng_Uga'").count() == 3 and spark.read.parquet(f"{out}/final/training").columns == ["input", "output", "subset"]
    assert 0 < spark.read.parquet(f"{out}/backtranslated").count() <= 4


def test_arguments():
    given = runner.arguments(["--train", "a", "--out", "b", "--skip", "merge", "--table", "scores=x"])
    assert given.skip == ["merge"] and given.only == list(runner.STAGES) and given.table == ["scores=x"]
    with pytest.raises(SystemExit):
        runner.arguments(["--train", "a", "--out", "b", "--skip", "nothing"])


def test_sinks_that_write_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 2.0], "q", "r", "en", "x")], "ID string, v array<double>, input string, output string, subset string, source string")
    cached = io.write_embeddings(rows, f"{tmp_path}/emb", "ID", {"q": rows["v"]})
    assert cached.dtypes == [("ID", "string"), ("q", "array<float>")] and cached.first().q == [1.0, 2.0]
    io.write_with_provenance(rows, f"{tmp_path}/both")
    assert spark.read.parquet(f"{tmp_path}/both/training").columns == ["input", "output", "subset"] and spark.read.parquet(f"{tmp_path}/both/provenance").columns == rows.columns
    made = []
    for _ in range(2):
        assert io.unless_written(spark, f"{tmp_path}/once", lambda: made.append(1) or rows).count() == 1
    assert made == [1]
    assert io.training_export(spark.createDataFrame([([1], [2]), ([], [2]), ([1], []), ([1], None)], "input_ids array<int>, labels array<int>")).count() == 1
