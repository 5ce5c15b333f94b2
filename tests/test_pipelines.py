from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from polycurate import scorers
from polycurate.operators import profile, sampling
from polycurate.plans import pipelines as P
from polycurate.plans import views


def test_first_generation(spark):
    rows = [("a", 1, "what is malaria", "a disease", "eng"), ("b", 2, "what is malaria", "a disease", "eng"), ("c", 3, "call +256 700 123456", "ok then", "Swa_Ken"), ("d", 4, "q <b>x</b>", "take 10 tablets at once", "Lug_Uga"), ("e", 5, "q2", "r2", "nowhere")]
    kept, held, log = P.clean_first_generation(spark.createDataFrame(rows, "ID string, ord int, input string, output string, subset string"), "train")
    assert sorted((r.ID, r.input, r.subset, r._safety_flag) for r in kept.collect()) == [("a", "what is malaria", "Eng_Uga", False), ("d", "q x", "Lug_Uga", True)]
    assert sorted(r.ID for r in held.collect()) == ["c", "e"]
    assert sorted((r.row_id, r.change_type) for r in log.collect()) == [
        ("a", "SUBSET_TAG_FIXED"), ("b", "REMOVED_DUPLICATE"), ("c", "QUARANTINE_PII"), ("d", "FLAGGED_UNSAFE_ANSWER"), ("d", "TEXT_NORMALISED_INPUT"), ("e", "QUARANTINE_INVALID_SUBSET"),
    ]


def diagnosed(spark, small):
    rows = views.diagnostic(spark, small).withColumn("subset", F.when(F.col("subset") == "en", F.lit("Eng_Gha")).otherwise(F.lit("Lug_Uga")))
    return rows.withColumns({"q_lang_ok": F.lit(True), "a_lang_ok": F.lit(True)})


def test_second_generation_accounts_for_every_row(spark, small):
    rows = diagnosed(spark, small)
    kept, dropped = P.clean_second_generation(rows)
    assert kept.count() + dropped.count() == rows.count() and kept.count() > 0
    assert dropped.filter("drop_reason is null").count() == 0


def test_gate_and_selection(spark, small):
    rows = diagnosed(spark, small)
    kept, report = P.quality_gate(rows, F.coalesce("tox", F.lit(0.0)), F.col("qa_cos"), relevant=-1.0)
    assert report.filter("gate = 'length_ratio'").agg(F.sum("total")).first()[0] == rows.count()
    assert kept.count() == report.filter("gate = 'semantic_relevance'").agg(F.sum("passing")).first()[0]
    assert P.english_seeds(rows, 3, "Eng_Ken", -1.0).count() == 6
    assert (P.SEED_COSINE, P.CANDIDATE_COSINE, P.TRANSFER_COSINE, P.PARAPHRASE_COSINE) == (0.55, 0.45, 0.55, 0.65)
    near = rows.limit(2).withColumns({"qa_cos": F.lit(0.5), "q_tokens": F.lit(10), "a_tokens": F.lit(50), "a_repetition": F.lit(0.0), "subset": F.lit("Eng_Gha")})
    near = near.withColumns({"q_script_ok": F.lit(True), "a_script_ok": F.lit(True)})
    assert P.english_seeds(near, 3).count() == 0 and P.paraphrase_candidates(near, {"Eng_Gha": 2}).count() == 2
    asked = P.paraphrase_candidates(rows, {"Lug_Uga": 2}, -1.0).collect()
    assert len(asked) == 4 and all("Luganda" in r.prompt for r in asked)


def test_gate_judges_both_sides(spark):
    rows = [(i, "what helps against fever", "water and rest and a doctor", "Eng", q, a) for i, (q, a) in enumerate([(0.1, 0.2), (0.5, 0.1), (0.1, 0.9), (None, 0.2), (0.3, None), (None, 0.7), (None, None)])]
    frame = spark.createDataFrame(rows, "ID int, input string, output string, subset string, q double, a double")
    kept, report = P.quality_gate(frame, (F.col("q"), F.col("a")), F.lit(1.0))
    assert sorted(r.ID for r in kept.collect()) == [0, 3, 4, 6]
    assert report.filter("gate = 'toxicity'").first().failing == 3
    kept, _ = P.quality_gate(frame, F.col("q"), F.lit(1.0))
    assert sorted(r.ID for r in kept.collect()) == [0, 2, 3, 4, 5, 6]  # one probability for the row; a missing one passes


def test_augment_and_merge(spark, small):
    rows = diagnosed(spark, small)
    shout = lambda df: df.withColumn("rewritten", F.concat_ws(" ", F.reverse(F.split("input", " "))))
    made = P.back_translations(rows, shout, {"Lug_Uga": 3})
    assert made.count() <= 3
    copies = rows.limit(5).select("input", "output", "subset", F.lit("llm_paraphrase").alias("aug_method"))
    merged = P.merge(rows, [made, copies], {"Eng_Gha": 4})
    assert merged.filter("source = 'llm_paraphrase'").count() == 0
    assert merged.filter("subset = 'Eng_Gha'").count() == 4


def test_evaluation_and_search(spark, small):
    rows = views.predictions(spark, small).withColumns({"output": F.col("reference"), "ord": F.col("ID")})
    judge, bert = scorers.ColumnScorer("fixed"), scorers.ColumnScorer("bert")
    scored = rows.withColumns({"fixed": F.lit('{"overall": 3}'), "bert": F.struct(F.lit(0.5).alias("precision"), F.lit(0.7).alias("recall"), F.lit(0.6).alias("f1"))})
    out = P.evaluate(scored, judge=judge, bert=bert, per_language=5)
    summary = out["summary"].first()
    assert (summary.bertscore_f1, summary.bertscore_recall) == pytest.approx((0.6, 0.7)) and summary.composite == out["composite"].first().score
    assert P.evaluate(scored, limit=3)["rows"].count() == 3
    assert np.isnan(scorers.bert_means(rows, scorers.ColumnScorer("none"))["bertscore_f1"])
    overall = out["rouge"].filter("language = 'OVERALL'").first()
    assert overall.n == rows.count() and 0.7 < overall.rouge1_f1 <= 1
    assert out["composite"].first().score == round(0.37 * overall.rouge1_f1 + 0.37 * overall.rougeL_f1 + 0.13, 5)
    cut = lambda df: df.withColumn("prediction", F.expr("array_join(slice(split(reference, ' '), 1, beams), ' ')"))
    best = P.decode_search(rows.drop("prediction"), cut, sampling.grid(spark, beams=[5, 500]), 2)
    assert {r.beams for r in best.collect()} == {500}


def qa_rows(spark, n=60):
    words = "malaria fever water clean doctor child sleep medicine clinic mother night hands wash drink rest safe".split()
    text = lambda i, k: " ".join(words[(i * 7 + j * (i % 5 + 1)) % 16] for j in range(k))
    tags = ("Eng_Uga", "Lug_Uga", "Swa_Ken")
    rows = [(f"r{i}", i, f"{text(i, 9)} {i}", f"{text(i + 3, 20)} {i}", tags[i % 3]) for i in range(n)]
    return spark.createDataFrame(rows, "ID string, ord int, input string, output string, subset string")


def test_diagnosis(spark):
    detect = lambda df: df.withColumns({"q_lang": F.lit("en"), "q_lang_conf": F.lit(0.9), "a_lang": F.when(F.col("ord") % 2 == 0, F.lit("lg")), "a_lang_conf": F.lit(0.8)})
    embed = lambda df: df.withColumns({"q_emb": F.array(F.lit(1.0), F.lit(0.0)), "a_emb": F.array((F.col("ord") % 10) / 10.0, F.lit(0.5))})
    df = qa_rows(spark).unionByName(spark.createDataFrame([("x", 99, " \n", "a", "Eng_Uga")], "ID string, ord int, input string, output string, subset string"))
    out = P.diagnose(df, detect, embed)
    rows = {r.ID: r for r in out["rows"].collect()}
    assert len(rows) == 60 and rows["r3"].a_lang == "und" and rows["r3"].a_lang_conf == 0.0 and rows["r4"].a_lang_ok and not rows["r3"].a_lang_ok
    summary = {r.language: r for r in out["summary"].collect()}
    assert (summary["Lug_Uga"].n, summary["Lug_Uga"].q_lang_ok_rate, summary["Lug_Uga"].a_lang_ok_rate, summary["Eng_Uga"].q_lang_ok_rate) == (20, 0.0, 0.5, 1.0)
    assert out["worst"].count() == 60 and out["worst"].filter("qa_cos = 0").count() == 6
    issues = {r.language: r.issues for r in out["issues"].collect()}
    assert "answer-language mismatch" in issues["Lug_Uga"] and "script" not in issues["Lug_Uga"]


def test_the_first_generation_augments_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def load():
        def model(target, texts):
            (calls / f"{target}-{uuid.uuid4().hex}").write_text("")
            return [t if target == "eng_Latn" else f"{t} {target}" for t in texts]

        return model

    translate = lambda df, text, output: scorers.translated(df, load, text, F.col("source_code"), F.col("target_code"), output)
    codes = {"Eng_Uga": "eng_Latn", "Lug_Uga": "lug", "Swa_Ken": "swh"}
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "book.csv").write_text("input,output,subset\nhow much water,enough water,Eng_Uga\n")
    run = lambda: P.augment(spark, qa_rows(spark), str(tmp_path / "out"), translate, scorers.ColumnScorer("_english"), codes, 0.1, {"Swa_Ken": 0.99}, {"Lug_Uga": 0.5}, str(tmp_path / "more"))
    rows = run().collect()
    by = Counter((r.subset, r.source) for r in rows)
    # 20 + 1 English rows forward to Luganda (Swahili's threshold stops all); 20 + 21 rows of Luganda and 20 of Swahili back
    assert by["Eng_Uga", "original"] == 20 and by["Eng_Uga", "book"] == 1 and by["Swa_Ken", "original"] == by["Swa_Ken", "back_bt"] == 20
    assert sum(n for (tag, _), n in by.items() if tag == "Lug_Uga") == (20 + 21 + 41) // 2 and ("Swa_Ken", "forward_mt") not in by
    ids = [r.ID for r in rows]
    assert None not in ids and "aug_00000000" in ids and any(i.endswith("_bt") for i in ids) and any(i == "nan_bt" for i in ids) == any(r.ID == "nan_bt" for r in rows)
    seen = len(list(calls.iterdir()))
    assert run().count() == len(rows) and len(list(calls.iterdir())) == seen


def test_ids_with_a_suffix(spark):
    rows = spark.createDataFrame([("a", 1, "x"), (None, 2, "x"), ("c", 3, "y")], "ID string, ord int, subset string")
    assert sorted(r.ID for r in P.suffixed_ids(rows).collect()) == ["a_bt", "c_bt", "nan_bt"]
    assert sorted(r.ID for r in P.suffixed_ids(rows.drop("ID")).collect()) == ["bt_x_0_bt", "bt_x_1_bt", "bt_y_0_bt"]


def test_transfer_needs_the_language_where_it_is_known(spark):
    rows = qa_rows(spark, 12)
    assert P.transferred(rows, 5, "Lug_Uga", "Eng_Gha", F.lit(0.6)).count() == 5
    assert P.transferred(rows, 5, "Lug_Uga", "Eng_Gha", F.lit(0.54)).count() == 0
    with pytest.raises(ValueError):
        P.transferred(rows, 5, "Swa_Ken", "Eng_Gha", F.lit(0.6))
    assert P.transferred(rows, 50, "Swa_Ken", "Eng_Gha", F.lit(0.6), (F.when(F.col("ord") > 3, F.lit("sw")), F.lit(0.4))).count() == 8


def test_training_data(spark, tmp_path):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    train, held = P.training_data(qa_rows(spark), qa_rows(spark, 9), path, ("Lug_Uga",))
    rows = train.collect()
    assert len(rows) == 20 and all(0 < len(r.input_ids) <= 256 and 0 < len(r.labels) <= 384 for r in rows)
    assert sorted(r.val_index for r in held.collect()) == list(range(9))
    with pytest.raises(ValueError):
        P.training_data(qa_rows(spark), qa_rows(spark), path, ("none",))
    made = P.submit(qa_rows(spark, 5), lambda df: df.withColumn("prediction", F.upper("input")), f"{tmp_path}/sub")
    assert made.count() == 5 and spark.read.option("header", True).csv(f"{tmp_path}/sub").columns == ["ID", "TargetRLF1", "TargetR1F1", "TargetLLM"]


def test_one_answer(spark):
    rows = spark.createDataFrame([("1", "how are you", "Lug_Uga", "1.2.3.4", 12.34), ("2", "ሰላም", "xx", None, 1.0), ("3", "habari", None, "a", 2.0)], "question_id string, question string, language string, client string, latency_ms double")
    generate = lambda df: df.withColumns({"answer": F.lit("well"), "probabilities": F.when(F.col("question_id") == "1", F.array(F.lit(0.5), F.lit(0.7))).otherwise(F.array().cast("array<double>"))})
    known = {"lg": "Lug_Uga", "am": "Amh_Eth", "sw": "Swa_Ken", "en": "Eng"}
    out = {r.question_id: r for r in P.answered(rows.withColumn("ts", F.current_timestamp()), generate, [F.when(F.col("question") == "habari", F.lit("sw"))], known, {"Swa_Ken": "tahadhari"}, "ask a doctor").collect()}
    assert [out[k].language for k in "123"] == ["Lug_Uga", "Amh_Eth", "Swa_Ken"]
    assert [round(out[k].confidence, 2) for k in "123"] == [0.6, 0.85, 0.85] and out["3"].disclaimer == "tahadhari" and out["1"].disclaimer == "ask a doctor"
    assert len(out["1"].ip_hash) == 16 and out["1"].latency_ms == 12.3


def test_scorers_at_the_boundary(spark):
    rows = spark.createDataFrame([(i, f"t{i}", "ab"[i % 2], i % 3 == 0) for i in range(10)], "i int, t string, g string, w boolean").repartition(1)

    def small():
        def model(texts):
            if len(texts) > 2:
                raise MemoryError
            return [t.upper() for t in texts]

        return model

    def by_group():
        return lambda group, texts: [f"{group}{len(texts)}" for _ in texts]

    def broken():
        def model(texts):
            raise RuntimeError("no model")

        return model

    def never():
        def model(texts):
            raise MemoryError

        return model

    score = lambda s: [r.o for r in s.score(rows, ["t"], "o").orderBy("i").collect()]
    assert score(scorers.ArrowScorer(small, StringType())) == [f"T{i}" for i in range(10)]
    assert score(scorers.ArrowScorer(by_group, StringType(), group="g")) == ["a5", "b5"] * 5
    assert score(scorers.ArrowScorer(broken, StringType(), keep="t")) == [f"t{i}" for i in range(10)]
    assert score(scorers.ArrowScorer(never, StringType(), on_error="?")) == ["?"] * 10
    assert score(scorers.ArrowScorer(small, StringType(), keep="t", where="w")) == [f"T{i}" if i % 3 == 0 else f"t{i}" for i in range(10)]
    with pytest.raises(Exception):  # noqa: B017
        score(scorers.ArrowScorer(broken, StringType()))
    hosted = scorers.hosted(lambda: lambda prompt: prompt + "!" if prompt != "t3" else 1 / 0, 2, 0.0, "none")
    assert score(hosted) == [f"t{i}!" if i != 3 else "none" for i in range(10)]
    e5 = rows.limit(1).select(scorers.prefixed(F.lit("x"), "query").alias("q"), scorers.prefixed(F.lit("x"), "passage").alias("p")).first()
    assert tuple(e5) == ("query: x", "passage: x")


def test_profile_tables(spark):
    tables = profile.profile(qa_rows(spark), F.col("input"), F.col("output"))
    assert {r.subset: r.n for r in tables["counts"].collect()} == {"Eng_Uga": 20, "Lug_Uga": 20, "Swa_Ken": 20}
    assert {(r.q_max, r.a_max, r.q_median) for r in tables["lengths"].collect()} == {(10, 21, 10.0)}
    assert tables["histogram"].agg(F.sum("n")).first()[0] == 60 and tables["anomalies"].first().anomalies == 0
    assert tables["missing"].agg(F.sum("missing")).first()[0] == 0 and {r.ratio for r in tables["imbalance"].collect()} == {1.0}
