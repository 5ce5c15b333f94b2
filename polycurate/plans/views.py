"""Question/answer views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..sources.io import table


def qa(spark: SparkSession, d: str) -> DataFrame:
    """ID, ord, input (first line), output (the rest), subset (lang); both parts not blank."""
    at = F.instr("text", "\n")
    rows = table(spark, d, "documents").filter(at > 0).select(
        F.col("doc_id").alias("ID"), F.col("doc_id").alias("ord"),
        F.expr("substring(text, 1, instr(text, '\n') - 1)").alias("input"), F.expr("substring(text, instr(text, '\n') + 1)").alias("output"),
        F.col("lang").alias("subset"), "source",
    )
    return rows.filter((T.strip(F.col("input")) != "") & (T.strip(F.col("output")) != ""))


def with_metrics(rows: DataFrame, scripts: dict[str, str] | None = None) -> DataFrame:
    """The native columns of a diagnostic row; each text is cut into words once."""
    q, a, script = F.col("input"), F.col("output"), F.col("expected_script")
    return with_tokens(rows, scripts).withColumns({
        "a_repetition": T.repeated_share(F.col("_a")), "q_script_ok": T.script_ok(q, script), "a_script_ok": T.script_ok(a, script),
    }).drop("_a")


def with_tokens(rows: DataFrame, scripts: dict[str, str] | None = None) -> DataFrame:
    """expected_script, token counts, and the answer's words as `_a`, for rules that are tried in turn."""
    expected = T.lookup(F.col("subset"), scripts or T.EXPECTED_SCRIPT, F.lit("LATIN") if scripts is None else F.lit("UNKNOWN"))
    cut = rows.withColumn("expected_script", expected).withColumns({"_a": T.once(T.tokens(F.col("output"))), "q_tokens": T.once(T.token_count(F.col("input")))})
    return cut.withColumn("a_tokens", F.size("_a"))


LATIN = {lang: "LATIN" for lang in ("de", "en", "es", "fr")}


def detections(rows: DataFrame) -> DataFrame:
    """A language detector's answers, made up by rule from the label: every seventh question and every fifth answer is taken for another language."""
    code = lambda n: F.when(F.col("ord") % n == 0, F.lit("und")).otherwise(F.col("subset"))
    return rows.withColumns({
        "q_lang": code(7), "q_lang_conf": (F.col("ord") % 10) / 10.0 + 0.1, "a_lang": code(5), "a_lang_conf": (F.col("ord") % 8) / 8.0 + 0.3,
    })


def diagnostic(spark: SparkSession, d: str) -> DataFrame:
    """qa with metrics, detected languages, toxicity (labels) and the cosine of each vector with the next, the last with the first."""
    from ..scorers import language_accepted

    rows = with_metrics(qa(spark, d), LATIN)
    accepted = F.array(F.col("subset"))
    rows = detections(rows).withColumns({f"{x}_lang_ok": language_accepted(F.col(f"{x}_lang"), F.col(f"{x}_lang_conf"), accepted) for x in "qa"})
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("ID"), F.col("toxic").cast("double").alias("tox"))
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = vectors.agg(F.count("*").alias("_n"))  # one row
    a = vectors.join(F.broadcast(n)).select(F.col("vec_id").alias("ID"), F.col("embedding").alias("va"), ((F.col("vec_id") + 1) % F.col("_n")).alias("other"))
    b = vectors.select(F.col("vec_id").alias("other"), F.col("embedding").alias("vb"))
    cosines = a.join(b, "other").select("ID", S.dot(F.col("va"), F.col("vb")).alias("qa_cos"))
    return rows.join(labels, "ID", "left").join(cosines, "ID", "left")


def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    """User turns with the assistant turn that follows."""
    rows = with_following(table(spark, d, "conversations"), "conv_id", "turn", ["text", "role"])
    return rows.filter("role = 'user' and following.role = 'assistant'").select("conv_id", "turn", F.col("text").alias("input"), F.col("following.text").alias("output"))


def with_following(rows: DataFrame, by: str, order: str, columns: list[str], chunk: int = 1024) -> DataFrame:
    """rows with `following`: a struct of columns of the next row of its group, null for the last. order is a whole number.

    Neighbours are found within stretches of the order; only the first row of each stretch is looked at for its whole group.
    """
    cut = rows.withColumn("_chunk", F.floor(F.col(order) / chunk))
    own = F.struct(*columns)
    cut = cut.withColumn("_next", F.lead(own).over(Window.partitionBy(by, "_chunk").orderBy(order)))
    heads = cut.groupBy(by, "_chunk").agg(F.min_by(own, order).alias("_head"))
    heads = heads.select(by, "_chunk", F.lead("_head").over(Window.partitionBy(by).orderBy("_chunk")).alias("_head")).filter("_head is not null")
    return cut.join(heads, [by, "_chunk"], "left").withColumn("following", F.coalesce("_next", "_head")).drop("_chunk", "_next", "_head")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """ID, subset, reference (the answer), prediction: the answer without every fifth word."""
    words = T.tokens(F.col("output"))
    kept = F.array_join(F.filter(words, lambda w, i: (i + 1) % 5 != 0), " ")
    return qa(spark, d).select("ID", "subset", "input", F.col("output").alias("reference"), kept.alias("prediction"))


def moved_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Like `predictions`, but of every seven words the third and fourth change places before words are left out."""
    rows = qa(spark, d).withColumn("_w", T.once(T.tokens(F.col("output"))))
    at = lambda i: F.get(F.col("_w"), i)
    moved = F.transform("_w", lambda w, i: F.when(i % 7 == 2, F.coalesce(at(i + 1), w)).when(i % 7 == 3, at(i - 1)).otherwise(w))
    kept = F.array_join(F.filter(moved, lambda w, i: (i + 1) % 5 != 0), " ")
    return rows.select("ID", "subset", F.col("output").alias("reference"), kept.alias("prediction"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.serving import request_events

    e = table(spark, d, "events")
    return request_events(e, F.col("event_id"), F.col("event_type"), F.col("value"), F.col("user_id"), F.col("ts"))


def feedback(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.serving import feedback_events

    return feedback_events(table(spark, d, "events"), F.col("event_id"), 1 + F.col("event_id") % 5, F.lit(None).cast("string"), F.col("ts"))
