"""Every query of the reference's operators, as (spark, sf_dir) -> DataFrame; oracles.py has the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import scorers as M
from ..functions import overlap as O
from ..functions import scores as S
from ..functions import text as T
from ..functions import udfs
from ..hosted import HostedScorer
from ..operators import cascade, cosines, profile, sampling, similarity
from ..sources import io
from ..sources.scratch import scratch_folder
from ..streaming import limits, serving
from . import pipelines as P
from . import views
from .oracles import ORACLES as ORACLES
from .oracles import SCRIPT_TEXTS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r6(c):
    return F.round(c, 6)


def _measured(s: SparkSession, d: str) -> DataFrame:
    return views.with_metrics(views.qa(s, d), views.LATIN)


def _judged(s: SparkSession, d: str) -> DataFrame:
    """qa with `_a` (the answer's words) and drop_reason; a rule's measure is taken only where no earlier rule holds."""
    c = F.col
    mismatch = ~T.script_ok(c("output"), c("expected_script"))
    rules = [
        ("Q < 3 tokens", c("q_tokens") < 3), ("A < 5 tokens", c("a_tokens") < 5), ("A > 400 tokens", c("a_tokens") > 400),
        ("A repetition > 0.5", T.repeated_share(c("_a")) > 0.5),
        *[(f"[{lang}] answer script mismatch", (c("subset") == lang) & mismatch) for lang in views.LATIN],
    ]
    return cascade.with_drop_reason(views.with_tokens(views.qa(s, d), views.LATIN), rules)


# --- cleaning cascade and text functions


@query
def clean_drop_report(s, d):
    return _judged(s, d).filter("drop_reason is not null").groupBy(F.col("drop_reason").alias("reason"), "subset").agg(F.count("*").alias("n"))


@query
def clean_survivors(s, d):
    rows = _judged(s, d).filter("drop_reason is null")
    return rows.select(F.col("ID").alias("id"), "subset", "q_tokens", "a_tokens", r6(T.repeated_share(F.col("_a"))).alias("a_repetition"))


@query
def token_stats(s, d):
    return _measured(s, d).select(F.col("ID").alias("id"), "q_tokens", "a_tokens")


@query
def script_ok_rates(s, d):
    rate = lambda c: r6(F.avg(F.col(c).cast("double")))
    return _measured(s, d).groupBy("subset").agg(F.count("*").alias("n"), rate("q_script_ok").alias("q_rate"), rate("a_script_ok").alias("a_rate"))


@query
def repetition_ratio(s, d):
    return _measured(s, d).select(F.col("ID").alias("id"), r6("a_repetition").alias("a_repetition"))


@query
def strip_noise(s, d):
    return io.table(s, d, "pages").select("page_id", F.md5(T.strip_noise(F.col("html"))).alias("text_md5"))


@query
def clean_whitespace(s, d):
    return io.table(s, d, "pages").select("page_id", F.md5(T.clean_whitespace(F.col("html"))).alias("text_md5"))


@query
def nfc_normalise(s, d):
    return io.table(s, d, "documents").select("doc_id", F.md5(udfs.nfc("text")).alias("text_md5"))


@query
def dominant_script(s, d):
    literal = s.createDataFrame([(-i, t) for i, t in enumerate(SCRIPT_TEXTS, 1)], "doc_id long, text string")
    return io.table(s, d, "documents").select("doc_id", "text").union(literal).select("doc_id", T.dominant_script(F.col("text")).alias("script"))


@query
def script_heuristic(s, d):
    """First lines under tags of several scripts, and answers' digits alone."""
    tags = T.lookup(F.col("subset"), {"en": "Aka_Gha", "de": "Amh_Eth", "fr": "Swa_Ken"}, F.lit("Lug_Uga"))
    digits = F.regexp_replace("output", "[^0-9]", "")
    return views.qa(s, d).select(F.col("ID").alias("id"), T.script_present(F.col("input"), tags).alias("ok"), T.script_present(digits, tags).alias("digits_ok"))


@query
def exact_dedup_first(s, d):
    return sampling.first_of_group(views.qa(s, d), T.row_hash(F.col("input"), F.col("output")), "ord").select(F.col("ID").alias("id"), "subset")


@query
def dup_groups_all(s, d):
    rows = views.qa(s, d).select(F.col("ID").alias("id"), T.row_hash(F.col("input"), F.col("output"), separator="|||").alias("h"))
    return rows.join(rows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "h").select("id", "n")


@query
def hash_separator(s, d):
    i, o = F.col("input"), F.col("output")
    return views.qa(s, d).groupBy(T.row_hash(i, o).alias("plain"), T.row_hash(i, o, separator="|||").alias("separated")).agg(F.count("*").alias("n"))


@query
def pii_flags(s, d):
    t = F.col("text")
    return io.table(s, d, "documents").select("doc_id", t.rlike(T.PHONE).alias("phone"), t.rlike(T.EMAIL).alias("email"), t.rlike(T.TITLED_NAME).alias("titled_name"))


@query
def unsafe_flags(s, d):
    return views.qa(s, d).groupBy("subset").agg(F.count("*").alias("n"), F.count_if(T.flag_unsafe(F.col("output"))).alias("unsafe"))


@query
def tag_normalise(s, d):
    """Each document under a tag as it may be written, by its language and source."""
    written = T.lookup(F.col("lang"), {"en": " Eng ", "de": "KISWAHILI", "fr": "amh_eth", "es": "Eng_Kenya"}, F.col("lang"))
    tag = F.when(F.col("doc_id") % 5 == 0, F.col("source")).when(F.col("doc_id") % 5 == 1, F.lit("Swa_Ken")).otherwise(written)
    return io.table(s, d, "documents").select("doc_id", tag.alias("tag"), T.normalise_tag(tag).alias("fixed"))


@query
def change_log(s, d):
    i, o = F.col("input"), F.col("output")
    rows = views.qa(s, d)
    first = rows.groupBy(T.row_hash(i, o).alias("h")).agg(F.min("ord").alias("first"))
    rows = rows.withColumn("h", T.row_hash(i, o)).join(first, "h").withColumn("again", F.col("ord") > F.col("first"))
    tidy = T.strip(F.regexp_replace(i, T.WIDE_SPACE, " "))
    cut = lambda c: F.substring(c, 1, 120)
    own = ~F.col("again")
    return cascade.change_log(rows, "ID", [
        ("REMOVED_DUPLICATE", F.col("again"), cut(i), F.lit("DROPPED")),
        ("TEXT_NORMALISED_INPUT", own & (tidy != i), cut(i), cut(tidy)),
        ("QUARANTINE_PII", own & F.concat_ws(" ", i, o).rlike(T.EMAIL), cut(i), F.lit("QUARANTINED")),
    ])


@query
def quarantine_split(s, d):
    return views.qa(s, d).groupBy("subset", F.col("output").rlike(T.EMAIL).alias("quarantined")).agg(F.count("*").alias("n"))


@query
def prompts(s, d):
    q = F.col("input")
    return views.qa(s, d).select(F.col("ID").alias("id"), F.md5(T.answer_prompt(q, F.col("subset"))).alias("answer_md5"), F.md5(T.serving_prompt(q, F.col("subset"))).alias("serving_md5"))


@query
def imputed_model_text(s, d):
    return io.table(s, d, "conversations").select("conv_id", "turn", F.md5(T.model_text(F.col("text"))).alias("text_md5"))


@query
def turn_pairs(s, d):
    return views.turn_pairs(s, d).select("conv_id", "turn", F.md5("input").alias("q_md5"), F.md5("output").alias("a_md5"))


@query
def synthetic_source(s, d):
    """As many placeholder rows as there are documents."""
    return io.synthetic_rows(s, "train", io.table(s, d, "documents").count()).select("ID", "subset")


@query
def parameters_join(s, d):
    parameters = io.parameter_table(s, {"min_a": 20}, {"de": {"min_a": 50}, "fr": {"min_a": 80}})
    rows = _measured(s, d).join(F.broadcast(parameters), "subset", "left")  # one row for each language
    return rows.groupBy("subset").agg(F.count("*").alias("n"), F.count_if(F.col("a_tokens") < F.coalesce("min_a", F.lit(20))).alias("short"))


@query
def decoding_overlay(s, d):
    """Each document's settings: the defaults, its language's own over them."""
    base = F.create_map(F.lit("beams"), F.lit(4.0), F.lit("penalty"), F.lit(1.0))
    rows = s.createDataFrame([("en", {}), ("de", {"beams": 2.0, "penalty": 1.3}), ("fr", {"penalty": 1.1})], "lang string, own map<string,double>")
    pick = lambda key: F.coalesce(F.try_element_at("own", F.lit(key)), base[key])
    known = io.table(s, d, "documents").select("doc_id", "lang").join(F.broadcast(rows), "lang", "left")  # three rows
    return known.select("doc_id", "lang", pick("beams").cast("int").alias("beams"), pick("penalty").alias("penalty"))


# --- profile


@query
def lang_counts(s, d):
    return io.table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@query
def source_counts(s, d):
    return io.table(s, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query
def languages_present(s, d):
    wanted = s.createDataFrame([("de",), ("fr",), ("it",)], "lang string")
    return wanted.join(io.table(s, d, "documents").select("lang").distinct(), "lang", "left_semi")


@query
def length_stats(s, d):
    measures = [(f"{x}_{name}", F.round(f(F.col(f"{x}_tokens")), 1)) for x in "qa" for name, f in (("mean", F.avg), ("median", lambda c: F.percentile(c, 0.5)), ("p95", lambda c: F.percentile(c, 0.95)), ("max", F.max))]
    return _measured(s, d).groupBy("subset").agg(F.count("*").alias("n"), *[c.alias(n) for n, c in measures])


@query
def imbalance(s, d):
    counts = io.table(s, d, "documents").groupBy("lang").agg(F.count("*").cast("double").alias("n"))
    over = Window.partitionBy(F.lit(0))
    return counts.select("lang", "n", F.round(100.0 * F.col("n") / F.sum("n").over(over), 2).alias("pct"), F.round(F.col("n") / F.max("n").over(over), 3).alias("ratio"))


@query
def temperature_shares(s, d):
    counts = io.table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return counts.select("lang", r6(S.tempered(F.col("n"), 5.0, Window.partitionBy(F.lit(0)))).alias("share"))


@query
def length_histogram(s, d):
    rows = _measured(s, d).select(F.col("q_tokens").cast("double").alias("q"))
    ends = rows.agg(F.min("q").alias("lo"), F.max("q").alias("hi"))
    place = F.least(F.floor((F.col("q") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 40)), F.lit(39)).cast("int")
    return rows.join(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))  # ends is one row


@query
def missing_values(s, d):
    names = ["doc_id", "text", "lang", "source"]
    wide = io.table(s, d, "documents").agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return wide.unpivot([], names, "column_name", "missing")


@query
def vocab_overlap(s, d):
    words = views.qa(s, d).select((F.col("ID") % 5 == 0).alias("val"), F.explode(T.tokens(F.lower("input"))).alias("w"))
    held = words.groupBy("w").agg(F.bool_or("val").alias("val"), F.bool_or(~F.col("val")).alias("train")).filter("val")
    return held.agg(F.count("*").alias("val_words"), F.count_if("train").alias("common"), F.round(100.0 * F.count_if("train") / F.count("*"), 2).alias("pct"))


@query
def multiset_overlap(s, d):
    rows = views.predictions(s, d)
    counts = lambda c, n: rows.select("subset", F.explode(T.tokens(F.col(c))).alias("w")).groupBy("subset", "w").agg(F.count("*").alias(n))
    return counts("prediction", "x").join(counts("input", "y"), ["subset", "w"]).groupBy("subset").agg(F.sum(F.least("x", "y")).alias("common"))


# --- similarity


@query
def shingle_jaccard_edges(s, d):
    """Per row its class of equal shingle sets, how many rows are similar, and how similar the most similar other class is."""
    rows = similarity.linked_classes(views.qa(s, d), "ID", "subset", F.col("input"), 0.85)
    return rows.select(F.col("key").alias("id"), F.col("group").alias("subset"), "class_id", "n_links", r6("nearest").alias("nearest"))


@query
def near_dup_greedy(s, d):
    rows = similarity.near_duplicates(views.qa(s, d), "ord", "subset", F.col("input"), 0.85)
    return rows.select(F.col("key").alias("id"), F.col("group").alias("subset"), "kept")


@query
def near_dup_rate_by_lang(s, d):
    rows = similarity.near_duplicates(views.qa(s, d), "ord", "subset", F.col("input"), 0.85)
    return rows.groupBy(F.col("group").alias("subset")).agg(F.count("*").alias("n"), r6(F.avg((~F.col("kept")).cast("double"))).alias("near_dup_rate"))


def _augmented(s, d):
    return io.table(s, d, "benchmark").select("item_id", F.col("text").alias("input"), F.col("text").alias("output"), F.lit("en").alias("subset"))


def _new_augmented(s, d):
    """Augmented rows that no original of their language resembles."""
    shingled = lambda rows, key: similarity.shingle_rows(rows.select(F.col(key).alias("key"), F.col("subset").alias("group"), "input"), "key", "group", F.col("input"), 5)
    rows = _augmented(s, d)
    hit = similarity.similar_across(shingled(rows, "item_id"), shingled(views.qa(s, d).join(F.broadcast(rows.select("subset").distinct()), "subset"), "ID"), 0.85)  # languages
    return rows.join(hit.select(F.col("a").alias("item_id")).distinct(), "item_id", "left_anti")


@query
def aug_vs_original_antijoin(s, d):
    return _new_augmented(s, d).select("item_id")


@query
def cosine_pairs_gt_090(s, d):
    return cosines.count_cosine_pairs(io.table(s, d, "embeddings"), "vec_id", "embedding", 0.9)


# --- gates and diagnosis


def _ratio_ok():
    return T.length_ratio(F.col("input"), F.col("output")).between(0.5, 20)


def _measured_ratio_ok():
    return (F.greatest("a_tokens", F.lit(1)) / F.greatest("q_tokens", F.lit(1))).between(0.5, 20)


@query
def length_ratio_gate(s, d):
    return views.qa(s, d).select(F.col("ID").alias("id"), _ratio_ok().alias("ok"))


def gates():
    return [("length_ratio", _measured_ratio_ok()), ("language_id", F.col("a_script_ok")), ("toxicity", F.coalesce(F.col("tox") < 0.5, F.lit(True))), ("semantic_relevance", S.at_least(F.col("qa_cos"), 0.0))]


@query
def gate_funnel(s, d):
    return cascade.gate_funnel(views.diagnostic(s, d), gates())


def _summary(s, d):
    measures = ("subset", "q_script_ok", "a_script_ok", "q_lang_ok", "a_lang_ok", "q_tokens", "a_tokens", "a_repetition", "qa_cos")
    rows = sampling.settled(views.diagnostic(s, d).select(*measures), "measures")  # read for totals and again for percentiles
    return P.summary_of(rows, P.near_dup_rates(views.qa(s, d), None))


@query
def diagnostic_summary(s, d):
    names = ("q_script_ok_rate", "a_script_ok_rate", "q_lang_ok_rate", "a_lang_ok_rate", "qa_cos_mean", "qa_cos_median", "qa_cos_p10", "a_repetition_mean", "near_dup_rate")
    return _summary(s, d).select("language", "n", "q_tokens_median", "a_tokens_median", *[r6(F.col(n)).alias(n) for n in names])


@query
def issue_classification(s, d):
    return P.issues_of(_summary(s, d))


@query
def either_side_gate(s, d):
    """The first generation's gate: the question's label is its document's, the answer's that of the next document."""
    tags = T.lookup(F.col("subset"), {"en": "Eng", "de": "Aka_Gha", "fr": "Amh_Eth"}, F.lit("Swa_Eas"))
    answers = io.table(s, d, "labels").select((F.col("doc_id") - 1).alias("ID"), F.col("toxic").cast("double").alias("a_tox"))
    rows = views.diagnostic(s, d).withColumn("subset", tags).join(answers, "ID", "left")
    _, report = P.quality_gate(rows, (F.col("tox"), F.col("a_tox")), F.col("qa_cos"), relevant=0.0)
    return report


@query
def worst20_per_lang(s, d):
    rows = sampling.per_group(views.diagnostic(s, d).filter("qa_cos is not null"), "subset", 20, [F.col("qa_cos"), F.col("ord")])
    return rows.select(F.col("ID").alias("id"), "subset", r6("qa_cos").alias("qa_cos"))


# --- selection and mixing


@query
def seed_topk(s, d):
    c = F.col
    good = (c("subset") == "en") & c("q_script_ok") & c("a_script_ok") & S.at_least(c("qa_cos"), 0.0)
    rows = views.diagnostic(s, d).filter(good & c("q_tokens").between(5, 80) & c("a_tokens").between(10, 200) & (c("a_repetition") < 0.2))
    return sampling.top(rows, 40, [c("qa_cos").desc(), c("ord")]).select(c("ID").alias("id"), r6("qa_cos").alias("qa_cos"))


@query
def per_group_topn(s, d):
    c = F.col
    rows = views.diagnostic(s, d).filter(c("a_script_ok") & c("a_tokens").between(10, 250) & c("qa_cos").isNotNull())
    rows = sampling.per_group(rows, "subset", {"de": 6, "en": 20, "fr": 10}, [c("qa_cos").desc(), c("ord")])
    return rows.select(c("ID").alias("id"), "subset", r6("qa_cos").alias("qa_cos"))


@query
def stratified_sample(s, d):
    return sampling.stratified(views.qa(s, d).select("ID", "subset"), "subset", 25, "ID", 42).select(F.col("ID").alias("id"), "subset")


@query
def simple_sample(s, d):
    return sampling.simple_sample(views.qa(s, d).select("ID"), 100, "ID", 7).select(F.col("ID").alias("id"))


@query
def quota_backfill(s, d):
    return sampling.quota_and_backfill(views.qa(s, d).select("ID", "subset"), "subset", 150, "ID", 42).select(F.col("ID").alias("id"), "subset")


@query
def hash_shuffle(s, d):
    rows = views.qa(s, d).select(F.col("ID").alias("id"))
    return sampling.numbered(rows, [sampling.draw(3, "id"), F.col("id")]).select("id", "place")


@query
def ratio_mix(s, d):
    rows = sampling.mixed_by_ratio(views.qa(s, d).select(F.col("ID").alias("id"), "subset"), "subset", {"de": 1.7, "en": 0.5, "es": 2.0}, "id", 42)
    return rows.groupBy("id", "subset").agg(F.count("*").alias("copies"))


@query
def fallback_ids(s, d):
    rows = views.qa(s, d).select(F.when(F.col("ID") % 3 != 0, F.col("ID")).alias("id"), "ord")
    return sampling.fallback_ids(rows, "id", [F.col("ord")])


# --- evaluation


def _rouge(rows, name):
    return rows.select("subset", O.rouge(F.col("prediction"), F.col("reference"), subsequences=name == "rougeL")[name].alias("f"))


def _by_language(rows, name):
    totals = rows.cube("subset").agg(F.grouping("subset").alias("g"), F.count("*").alias("n"), r6(F.avg("f")).alias(name))
    return totals.select(F.when(F.col("g") == 1, "OVERALL").otherwise(F.col("subset")).alias("language"), "n", name)


@query
def rouge1_by_lang(s, d):
    return _by_language(_rouge(views.predictions(s, d), "rouge1"), "rouge1_f1")


@query
def rougeL_by_lang(s, d):  # noqa: N802
    return _by_language(_rouge(views.moved_predictions(s, d), "rougeL"), "rougeL_f1")


def _thinned(c, n=5):
    """Every nth word left out."""
    return F.array_join(F.filter(T.tokens(c), lambda w, i: (i + 1) % n != 0), " ")


@query
def chrf_pairs(s, d):
    return views.qa(s, d).select(F.col("ID").alias("id"), r6(O.chrf(F.col("input"), _thinned(F.col("input")))).alias("chrf"))


@query
def sentence_chrf_pairs(s, d):
    return views.qa(s, d).select(F.col("ID").alias("id"), r6(O.sentence_chrf(F.col("input"), _thinned(F.col("input")))).alias("chrf"))


@query
def judge_parse(s, d):
    replies = ['{"overall": 4.5}', '{"accuracy": 4, "completeness": 2}', "4.5 / 5", "n/a", "I give it 4 of 5", 'so: {"overall": 2, "x": 1} 5', "{oops} 2"]
    literal = s.createDataFrame([(-i, r) for i, r in enumerate(replies, 1)], "i long, reply string")
    rows = io.table(s, d, "events").select(F.col("event_id").alias("i"), F.col("props").alias("reply")).union(literal)
    return rows.groupBy(S.judge_score(F.col("reply")).alias("score")).agg(F.count("*").alias("n"), F.min("i").alias("first_i"))


@query
def composite_score(s, d):
    v = F.col("vec_id")
    return io.table(s, d, "embeddings").select("vec_id", F.round(S.composite((v % 11) / 10.0, (v % 7) / 6.0, (v % 6) + 0.5), 4).alias("score"))


@query
def argmax_grid(s, d):
    grid = sampling.grid(s, beams=[1, 2, 4], penalty=[0.8, 1.0, 1.2])
    scored = io.table(s, d, "documents").select("lang").distinct().join(F.broadcast(grid))  # nine rows for each language
    scored = scored.withColumn("score", F.when(F.col("lang") == "en", F.col("beams").cast("double")).otherwise(F.col("penalty") * 2))
    return sampling.best_of_grid(scored, "lang", "score").select("lang", "beams", "penalty")


@query
def submission(s, d):
    rows = io.submission(views.predictions(s, d).withColumn("prediction", F.md5("prediction")))
    return rows


# --- merge


def _merged(s, d):
    original = views.qa(s, d).select(F.col("ID").cast("string").alias("id"), "input", "output", "subset", F.lit("original").alias("source"), "ord")
    added = _new_augmented(s, d).select(F.concat(F.lit("b"), "item_id").alias("id"), "input", "output", "subset", F.lit("benchmark").alias("source"), (1_000_000_000 + F.col("item_id")).alias("ord"))
    return original.unionByName(added).dropna(subset=["input", "output", "subset"])


@query
def merge_provenance(s, d):
    return _merged(s, d).select("id", "subset", "source")


@query
def lang_source_pivot(s, d):
    return _merged(s, d).groupBy("subset").pivot("source", ["benchmark", "original"]).count().na.fill(0)


@query
def cap_prefer_original(s, d):
    return sampling.capped(_merged(s, d), "subset", {"en": 620, "de": 50}, F.col("source") == "original", [F.col("ord")]).select("id", "subset", "source")


# --- serving


@query
def request_metrics(s, d):
    return serving.metrics(views.requests(s, d)).withColumn("avg_latency_ms", F.round("avg_latency_ms", 4))


@query
def rate_limit_windows(s, d):
    return serving.over_limit(views.requests(s, d), "ip_hash", 1).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query
def rate_limit_requests(s, d):
    """Two requests of a client in six hours: the table's clients ask a few times a day."""
    rows = limits.decided(views.requests(s, d), "ip_hash", "question_id", 2, seconds=6 * 3600)
    return rows.select(F.col("request").cast("long").alias("event_id"), "earlier", "admitted")


@query
def rate_limit_stream(s, d):
    """The limit of `rate_limit_requests` as a stream; a request far ahead lets the watermark pass all others."""
    folder = scratch_folder(s, "limit-stream")
    rows = views.requests(s, d).select("ip_hash", "question_id", "ts")
    ahead = rows.agg(F.max("ts").alias("ts")).select(F.lit("ahead").alias("ip_hash"), F.lit("ahead").alias("question_id"), (F.col("ts") + F.expr("interval 1 day")).alias("ts"))
    rows.union(ahead).write.parquet(f"{folder}/in")
    stream = s.readStream.schema(rows.schema).parquet(f"{folder}/in")
    with limits.state_store(s):
        made = limits.decided_stream(stream, "ip_hash", "question_id", 2, seconds=6 * 3600)
        serving.append_log(made, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    out = s.read.schema(made.schema).parquet(f"{folder}/out")
    return out.select(F.col("request").cast("long").alias("event_id"), "admitted")


@query
def feedback_sinks(s, d):
    """Feedback as a stream, in its log and its flagged log."""
    folder = scratch_folder(s, "feedback-stream")
    rows = views.feedback(s, d)
    rows.write.parquet(f"{folder}/in")
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    serving.append_feedback(stream, f"{folder}/log", f"{folder}/flags", f"{folder}/checkpoint").awaitTermination()
    counted = lambda name: serving.read_batches(s, f"{folder}/{name}").groupBy("rating").agg(F.count("*").alias("n")).select(F.lit(name).alias("sink"), "rating", "n")
    return counted("log").union(counted("flags"))


@query
def feedback_flags(s, d):
    return serving.flagged(views.feedback(s, d)).select("question_id", "rating", "flagged")


@query
def feedback_totals(s, d):
    return serving.feedback_totals(views.feedback(s, d))


@query
def pause_windows(s, d):
    return serving.pauses(serving.flagged(views.feedback(s, d))).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query
def retention(s, d):
    return serving.retained(io.table(s, d, "events"), F.lit("2024-01-30 00:00:00").cast("timestamp"), 10).select("event_id")


@query
def ip_anonymise(s, d):
    return io.table(s, d, "events").select("user_id", T.anonymised_ip(F.col("user_id").cast("string")).alias("ip_hash")).distinct()


# --- operators of single stages, on scores and translations made up by rule


@query
def clean_totals(s, d):
    return cascade.kept_totals(_judged(s, d))


@query
def clean_counts(s, d):
    rows = io.table(s, d, "documents").select(F.when(F.col("doc_id") % 9 == 0, F.lit(" \n")).otherwise(F.col("text")).alias("input"), "text", F.when(F.col("doc_id") % 11 != 0, F.col("lang")).alias("subset"))
    return io.clean_counts(rows, ("input", "text", "subset"))


@query
def utf8_anomalies(s, d):
    return io.table(s, d, "documents").agg(F.count("*").alias("n"), F.count_if(T.encoding_anomaly(F.col("text"))).alias("anomalies"))


@query
def clean_log(s, d):
    """All kinds of changes of the first cleaning."""
    tags = T.lookup(F.col("subset"), {"en": "eng", "de": "swahili", "fr": "Amh_Eth"}, F.lit("nowhere"))
    _, _, log = P.clean_first_generation(views.qa(s, d).select("ID", "ord", "input", "output", tags.alias("subset")), "train")
    return log.select("row_id", "split", "change_type", F.md5("original_value").alias("old_md5"), F.md5("new_value").alias("new_md5"))


@query
def batch_tiers(s, d):
    """Events as free memory, their types as models."""
    kind = T.lookup(F.col("event_id") % 6, {0: "mt0-XXL", 1: "mt0-xl", 2: "mt5-large", 3: "mt5-base", 4: "mt5-small"}, F.lit("other"))
    size = S.model_size(kind)
    return io.table(s, d, "events").select("event_id", size.alias("size_b"), S.batch_size(F.floor("value"), size).alias("batch"))


@query
def l2_norms(s, d):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 3))
    v = S.l2_normalised(scaled)
    return io.table(s, d, "embeddings").select("vec_id", r6(S.dot(v, v)).alias("norm"), r6(F.get(v, F.lit(0))).alias("first"))


@query
def mean_confidence(s, d):
    p = F.array_repeat(F.col("value") / 100.0, (F.col("event_id") % 4).cast("int"))
    return io.table(s, d, "events").select("event_id", r6(S.mean_confidence(p)).alias("confidence"))


@query
def language_accepted(s, d):
    rows = views.detections(views.qa(s, d)).withColumn("subset", T.lookup(F.col("subset"), {"en": "Eng_Uga", "de": "Aka_Gha", "fr": "Swa_Ken"}, F.lit("other")))
    code = F.when(F.col("ord") % 7 == 0, F.lit(None).cast("string")).otherwise(T.lookup(F.col("subset"), {"Eng_Uga": "en", "Aka_Gha": "ak"}, F.lit("sw")))
    found = M.detected(F.col("input"), code, F.col("q_lang_conf"))
    ok = M.language_accepted(found["code"], found["confidence"], M.codes_of(F.col("subset"), M.ACCEPTED_CODES))
    return rows.select(F.col("ID").alias("id"), found["code"].alias("code"), r6(found["confidence"]).alias("confidence"), ok.alias("ok"))


@query
def language_gate(s, d):
    rows = views.qa(s, d).withColumn("tag", T.lookup(F.col("subset"), {"en": "Eng", "de": "Swa_Eas", "fr": "Amh_Eth"}, F.lit("Eng_Ken")))
    code = F.when(F.col("ord") % 4 == 0, F.lit("en")).when(F.col("ord") % 4 == 1, F.lit("sw"))
    asked = M.detector_input(F.col("input"))
    return rows.select(F.col("ID").alias("id"), F.length(asked).alias("asked"), M.language_consistent(F.col("input"), F.col("tag"), code).alias("ok"))


@query
def toxicity_gate(s, d):
    rows = io.table(s, d, "labels").select("doc_id", M.toxic_probability(F.when(F.col("toxic") == 1, F.lit("Toxic")).otherwise(F.lit("neutral")), (F.col("doc_id") % 10) / 10.0).alias("q"), F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 4) / 4.0).alias("a"))
    return rows.select("doc_id", r6("q").alias("q"), M.free_of_toxicity(F.col("q"), F.col("a")).alias("ok"))


@query
def stage1_drops(s, d):
    """The second cleaning's drops, near duplicates last."""
    rows = views.diagnostic(s, d).withColumn("subset", F.when(F.col("subset") == "en", F.lit("Eng_Gha")).otherwise(F.lit("Lug_Uga")))
    _, dropped = P.clean_second_generation(rows)
    return dropped.groupBy(F.col("drop_reason").alias("reason"), "subset").agg(F.count("*").alias("n"))


@query
def english_seeds(s, d):
    rows = views.diagnostic(s, d).withColumn("subset", F.when(F.col("subset") == "en", F.lit("Eng_Ken")).otherwise(F.col("subset")))
    return P.english_seeds(rows, 10, least=0.0).select(F.col("ID").alias("id"), r6("qa_cos").alias("qa_cos"))


@query
def transfer_topn(s, d):
    rows = views.qa(s, d).withColumns({"rel": 0.5 + (F.col("ord") % 50) / 100.0, "code": F.when(F.col("ord") % 3 == 0, F.lit("en")).otherwise(F.lit("sw")), "conf": (F.col("ord") % 10) / 10.0})
    out = P.transferred(rows.withColumn("rel", F.col("rel") + F.col("ord") / 1e9), 40, "Swa_Ken", "Eng_Gha", F.col("rel"), (F.col("code"), F.col("conf")))
    return out.select(F.md5("input").alias("input_md5"), "subset", "aug_method", r6("semantic_preserved").alias("kept_meaning"))


@query
def forward_translation(s, d):
    """English rows to two languages; the translation is every fifth word left out."""
    rows = views.qa(s, d).select("input", "output", F.lit("Eng_Ken").alias("subset"))
    thin = lambda df, text, output: df.withColumn(output, F.when(F.col("target_code") == "swh_Latn", _thinned(F.col(text))).otherwise(_thinned(F.col(text), 3)))
    made = P.forward_translations(rows, thin, {"Swa_Ken": "swh_Latn", "Lug_Uga": "lug_Latn", "Eng_Uga": "eng_Latn"}, 0.7, {"Lug_Uga": 0.55})
    return made.groupBy("subset", "source", F.md5("input").alias("input_md5"), F.md5("output").alias("output_md5")).agg(F.count("*").alias("n"))


@query
def back_translation(s, d):
    """Rows that are not English, there and back; the translations add a word, the paraphrase is the text itself."""
    rows = views.qa(s, d).withColumn("subset", T.lookup(F.col("subset"), {"en": "Eng_Ken", "de": "Swa_Ken"}, F.lit("Lug_Uga")))
    rows = rows.select(F.when(F.col("ID") % 10 != 0, F.col("ID")).alias("ID"), "ord", "input", "output", "subset")
    via = lambda df, text, output: df.withColumn(output, F.concat_ws(" ", text, F.substring("target_code", 1, 3)))
    made = P.paraphrased_back(rows, via, M.ColumnScorer("_english"), {"Swa_Ken": "swh_Latn", "Lug_Uga": "lug_Latn", "Eng_Ken": "eng_Latn"})
    return made.groupBy("ID", "subset", "source", F.md5("input").alias("input_md5"), F.md5("output").alias("output_md5")).agg(F.count("*").alias("n"))


@query
def training_prompts(s, d):
    rows = P.training_rows(views.qa(s, d), ("de", "fr"))
    return sampling.positions(rows.select("ord", "prompt", "output"), [F.col("ord")], "val_index").select("val_index", F.md5("prompt").alias("prompt_md5"), F.md5("output").alias("output_md5"))


@query
def prediction_dump(s, d):
    rows = P.prediction_dump(views.predictions(s, d), 60, phase=2, step=300, epoch=1.5)
    return rows.select("phase", "global_step", "epoch", F.col("ID").alias("id"), "subset", r6("rouge1").alias("rouge1"), r6("rougeL").alias("rougel"), "reference_chars", "prediction_chars")


@query
def judge_means(s, d):
    reply = F.when(F.col("ID") % 5 == 0, F.lit("n/a")).otherwise(F.format_string('{"overall": %d}', F.col("ID") % 5))
    return views.qa(s, d).withColumn("score", S.judge_score(reply)).groupBy("subset").agg(F.bround(F.avg("score"), 3).alias("score"), F.count("*").alias("n"))


@query
def stage2_back_translated(s, d):
    """Twice the target drawn, rewritten by leaving out every fifth word, filtered, cut to the target."""
    thin = lambda df: df.withColumn("rewritten", _thinned(F.col("input")))
    made = P.back_translations(views.qa(s, d).select("ID", "input", "output", "subset"), thin, {"en": 30, "de": 10, "fr": 10})
    return made.select("subset", "aug_method", F.md5("input").alias("input_md5"), F.md5("output").alias("output_md5"), r6("chrf_qq").alias("chrf_qq"))


@query
def stage4_paraphrased(s, d):
    """Candidates' answers without every third word; how much is preserved is told by the words that both have."""
    targets = {"en": 20, "de": 8, "fr": 8}
    asked = P.paraphrase_candidates(views.diagnostic(s, d), targets, least=0.0)
    made = asked.withColumn("rewritten", _thinned(F.col("output"), 3)).withColumns({"_p": T.once(T.tokens(F.col("rewritten"))), "_r": T.once(T.tokens(F.col("output")))})
    out = P.paraphrases(made, targets, T.once(O.rouge1(F.col("_p"), F.col("_r"))))
    return out.select("subset", "aug_method", F.md5("input").alias("input_md5"), F.md5("output").alias("output_md5"), r6("chrf_aa").alias("chrf_aa"), r6("semantic_preserved").alias("semantic_preserved"))


@query
def first_generation(s, d):
    """Originals, forward translations (words left out) and back translations, each language written once."""
    tags = T.lookup(F.col("subset"), {"en": "Eng_Ken", "de": "Swa_Ken"}, F.lit("Lug_Uga"))
    rows = views.qa(s, d).select(F.col("ID").cast("string").alias("ID"), "input", "output", tags.alias("subset"))
    thin = lambda df, text, output: df.withColumn(output, F.when(F.col("target_code") == "swh_Latn", _thinned(F.col(text))).otherwise(_thinned(F.col(text), 7)))
    codes = {"Swa_Ken": "swh_Latn", "Lug_Uga": "lug_Latn", "Eng_Ken": "eng_Latn"}
    made = P.augment(s, rows, scratch_folder(s, "generation"), thin, M.ColumnScorer("_english"), codes, 0.7)
    return made.groupBy("subset", "source", F.md5("input").alias("input_md5"), F.md5("output").alias("output_md5")).agg(F.count("*").alias("n"))


@query
def evaluation_summary(s, d):
    """The first 300 rows; the judge's reply is the document's quality label."""
    quality = io.table(s, d, "labels").select(F.col("doc_id").alias("ID"), F.format_string('{"overall": %d}', 1 + 4 * F.col("quality")).alias("reply"))
    rows = views.moved_predictions(s, d).join(quality, "ID", "left").select("ID", F.col("ID").alias("ord"), F.col("reference").alias("input"), F.col("reference").alias("output"), "subset", "prediction", F.col("reply").alias("said"))
    out = P.evaluate(rows, judge=M.ColumnScorer("said"), per_language=20, limit=300)
    return out["summary"].select("n", *[r6(c).alias(c) for c in ("rouge1_f1", "rougeL_f1", "judge", "composite")])


@query
def decode_search(s, d):
    """Which words are left out is the setting that is searched."""
    rows = views.qa(s, d).select("ID", "subset", F.col("output").alias("reference"), T.once(T.tokens(F.col("output"))).alias("_w"))
    cut = lambda df: df.withColumn("prediction", F.array_join(F.filter("_w", lambda w, i: (i + F.col("shift")) % F.col("every") != 0), " "))
    best = P.decode_search(rows, cut, sampling.grid(s, every=[2, 3, 4], shift=[0, 1]), 10)
    return best.select("subset", "every", "shift", r6("score").alias("score"))


@query
def answers(s, d):
    """User turns as requests; the answer is the assistant's turn that follows."""
    c = F.col
    asked = views.turn_pairs(s, d).select(
        F.concat_ws("-", "conv_id", "turn").alias("question_id"), c("input").alias("question"), F.when(c("turn") % 4 == 0, "Lug_Uga").alias("language"), c("conv_id").alias("client"),
        (F.length("input") / 7.0).alias("latency_ms"), F.timestamp_seconds("conv_id").alias("ts"), c("output").alias("_answer"), c("turn"),
    )
    made = lambda df: df.withColumns({"answer": c("_answer"), "probabilities": F.array(F.lit(0.5), 1.0 / (1 + c("turn")))})
    out = P.answered(asked, made, [F.when(c("client") % 3 == 0, "sw")], {"am": "Amh_Eth", "sw": "Swa_Eas", "en": "Eng", "lg": "Lug_Uga"}, {"Eng": "information only", "Swa_Eas": "taarifa tu"}, "ask a professional")
    return out.select("question_id", "language", F.md5("prompt").alias("prompt_md5"), F.md5("answer").alias("answer_md5"), r6("confidence").alias("confidence"), "disclaimer", "latency_ms", "ip_hash")


# --- sources, sinks and the boundary to models, over the tables


@query
def csv_roundtrip(s, d):
    """Written as CSV and read again; cells that stand for a missing value come back as null."""
    path = scratch_folder(s, "csv")
    io.write_csv(views.qa(s, d).select(F.col("ID").alias("id"), "input", "output", "subset"), path)
    rows = io.read_csv(s, path, "id long, input string, output string, subset string")
    return rows.select("id", F.md5("input").alias("input_md5"), F.md5("output").alias("output_md5"), "subset")


@query
def external_rows(s, d):
    """Many files in a folder, read by one scan and cleaned."""
    path = scratch_folder(s, "external")
    io.write_csv(views.qa(s, d).select("input", "output", "subset", "source").repartition(8), path)
    rows, _ = io.read_external(s, path)
    return rows.groupBy("subset", "source", F.md5("input").alias("input_md5"), F.md5("output").alias("output_md5")).agg(F.count("*").alias("n"))


@query
def json_report(s, d):
    path = scratch_folder(s, "report")
    io.write_json_report(cascade.drop_report(_judged(s, d)), path)
    return s.read.schema("reason string, count long, per_language map<string, long>").json(path).select("reason", F.col("count").alias("n"), F.explode("per_language").alias("subset", "n_subset"))


@query
def dual_sink(s, d):
    path = scratch_folder(s, "both")
    io.write_with_provenance(views.qa(s, d).select("input", "output", "subset", "source"), path)
    counted = lambda rows, name: rows.groupBy("subset").agg(F.count("*").alias("n")).select(F.lit(name).alias("sink"), "subset", "n")
    return counted(s.read.parquet(f"{path}/training"), "training").union(counted(s.read.parquet(f"{path}/provenance").filter("source is not null"), "provenance"))


@query
def partition_checkpoint(s, d):
    """Two languages first, then the others; what is finished stays as it is."""
    path = scratch_folder(s, "languages")
    rows = views.qa(s, d).select("ID", "subset", F.md5("output").alias("output_md5"))
    io.write_missing_partitions(lambda v: rows.filter(F.col("subset") == v).withColumn("written", F.lit(1)), path, values=["de", "fr"], spark=s)
    io.write_missing_partitions(rows.withColumn("written", F.lit(2)), path)
    return s.read.parquet(path).select(F.col("ID").alias("id"), "subset", "output_md5", "written")


@query
def cached_relevance(s, d):
    """Each row's cosine of its vector with the next one, both from the bucketed cache."""
    vectors = io.table(s, d, "embeddings")
    cached = io.cached_embeddings(vectors, scratch_folder(s, "cache"), "vec_id", {"v": F.col("embedding")})
    rows = views.qa(s, d).select(F.col("ID").alias("id"), F.col("ID").alias("vec_id"))
    own = io.with_cached(rows, cached, "vec_id", "inner").select("id", F.col("v").alias("a"), (F.col("id") + 1).alias("vec_id"))
    return io.with_cached(own, cached, "vec_id").select("id", r6(S.dot(F.col("a"), F.col("v"))).alias("cosine"))


@query
def observed_clean(s, d):
    """What cleaning keeps, with the counts that its writing job took."""
    rows = io.table(s, d, "documents").select(F.when(F.col("doc_id") % 9 == 0, F.lit(" \n")).otherwise(F.col("text")).alias("input"), F.col("text").alias("output"), F.when(F.col("doc_id") % 11 != 0, F.col("lang")).alias("subset"))
    kept, counts = io.written_clean(rows, scratch_folder(s, "clean"))
    return kept.groupBy("subset").agg(F.count("*").alias("n")).select("subset", "n", *[F.lit(counts[c]).cast("long").alias(f"all_{c}") for c in ("n", "kept", "dropped")])


@query
def request_log(s, d):
    return views.requests(s, d).select(F.col("question_id").cast("long").alias("event_id"), "language", "latency_ms", "ip_hash")


@query
def embedding_inputs(s, d):
    texts = [F.md5(M.prefixed(F.col(c), kind)).alias(f"{kind}_md5") for c, kind in (("input", "query"), ("output", "passage"))]
    return views.qa(s, d).select(F.col("ID").alias("id"), *texts)


@query
def translated_rows(s, d):
    """A model that adds its target's code; rows that are in the target's language already never reach it."""
    rows = views.qa(s, d).select(F.col("ID").alias("id"), "input", "subset")
    load = lambda: lambda target, texts: [f"{t} {target}" for t in texts]
    made = M.translated(rows, load, "input", F.col("subset"), F.when(F.col("id") % 2 == 0, "en").otherwise("fr"), "moved")
    return made.select("id", F.md5("moved").alias("moved_md5"))


@query
def hosted_answers(s, d):
    """A remote call that gives a prompt's number of characters; equal prompts are asked once."""
    model = HostedScorer(lambda: lambda prompt: str(len(prompt)), scratch_folder(s, "answers"), tasks=8, per_task=4096)
    rows = io.table(s, d, "conversations").select("conv_id", "turn", "text")
    return model.score(rows, ["text"], "answer").select("conv_id", "turn", "answer")


@query
def agreement_alpha(s, d):
    rows = io.table(s, d, "events").select(F.floor(F.col("event_id") / 4).alias("unit"), (1 + (F.col("event_id") * 7 + F.floor(F.col("value")).cast("long")) % 5).alias("rating"))
    both = [profile.agreement(rows, "unit", "rating", m).select(F.lit(m).alias("metric"), r6("alpha").alias("alpha")) for m in ("interval", "nominal")]
    return both[0].union(both[1])


@query
def rouge_drop(s, d):
    """ROUGE-1 of the rows with even ids against that of those with odd ids."""
    rows = views.predictions(s, d)
    half = lambda rest: _by_language(_rouge(rows.filter(F.col("ID") % 2 == rest), "rouge1"), "rouge")
    out = profile.regressed(half(0), half(1), "language", "rouge", 0.0001)
    return out.select("language", r6("now").alias("now"), r6("before").alias("before"), "paused")


@query
def monthly_flags(s, d):
    rows = serving.flagged(views.feedback(s, d)).withColumns({"category": F.concat(F.lit("c"), (F.col("question_id").cast("long") % 3).cast("string")), "status": F.when(F.col("rating") == 1, "open").otherwise("closed")})
    return serving.monthly_flags(rows).withColumn("month", F.col("month").cast("timestamp_ntz"))
