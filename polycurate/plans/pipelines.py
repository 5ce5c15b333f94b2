"""The reference's stages, composed from the operators. Scores come from scorers (columns); thresholds are parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scorers as M
from ..functions import overlap as O
from ..functions import scores as S
from ..functions import text as T
from ..functions import udfs
from ..operators import cascade, profile, sampling, similarity
from ..scorers import Scorer
from ..sources import io

# Thresholds and names of the stages, in the order of the stages.
DIAGNOSED_NEAR_DUP, DIAGNOSED_SAMPLE, WORST = 0.85, 5000, 20
ISSUE_LIMITS = {"a_script_ok_rate": 0.8, "a_lang_ok_rate": 0.6, "qa_cos_median": 0.4, "near_dup_rate": 0.15, "a_repetition_mean": 0.2}
BACK_Q_TOKENS, BACK_CHRF, BACK_CHARS = (5, 80), (0.35, 0.85), (5, 500)
SEED_COSINE, SEED_Q_TOKENS, SEED_A_TOKENS, SEED_REPETITION = 0.55, (5, 80), (10, 200), 0.2
TRANSFER_Q_TOKENS, TRANSFER_A_TOKENS, TRANSFER_COSINE = (3, 100), (5, 300), 0.55
TRANSFER_LANGUAGE_CHECKED, TRANSFER_CONFIDENCE = ("Amh_Eth", "Swa_Ken"), 0.4
CANDIDATE_COSINE, CANDIDATE_A_TOKENS, CANDIDATE_REPETITION = 0.45, (10, 250), 0.25
PARAPHRASE_CHARS, PARAPHRASE_CHRF, PARAPHRASE_COSINE, PARAPHRASE_TOKENS, PARAPHRASE_REPETITION = 10, (0.20, 0.80), 0.65, (5, 350), 0.3
ENGLISH = ("Eng_Uga", "Eng_Gha", "Eng_Eth", "Eng_Ken")
ENGLISH_CODE = "eng_Latn"


@dataclass(frozen=True)
class CleanLimits:
    min_q_tokens: int = 3
    min_a_tokens: int = 5
    max_a_tokens: int = 400
    max_repetition: float = 0.5
    near_dup: float = 0.88
    qa_cos_min: dict[str, float] = field(default_factory=lambda: {s: 0.15 if s.startswith("Eng") else 0.10 for s in T.SUBSETS})
    language_checked: tuple[str, ...] = ("Amh_Eth",)


# --- the second generation: diagnosis, cleaning, three augmentations, merge


def summary_of(rows: DataFrame, near_dup: DataFrame | None = None, key: str = "subset") -> DataFrame:
    """language, n, the rates of scripts and languages, cosine mean, median and 10th percentile, median lengths, mean repetition, near-duplicate rate.

    rows: diagnostic rows; near_dup: (key, near_dup_rate). Cosines take nearly as many values as there are rows, so their
    percentiles come from ranks; token counts take few.
    """
    rate = lambda c: F.avg(F.col(c).cast("double"))
    totals = rows.groupBy(F.col(key).alias("language")).agg(
        F.count("*").alias("n"), *[rate(c).alias(f"{c}_rate") for c in ("q_script_ok", "a_script_ok", "q_lang_ok", "a_lang_ok")], rate("qa_cos").alias("qa_cos_mean"),
        *[F.percentile(f"{x}_tokens", 0.5).alias(f"{x}_tokens_median") for x in "qa"], rate("a_repetition").alias("a_repetition_mean"),
    )
    cosines = profile.percentiles(rows, key, "qa_cos", {"qa_cos_median": 0.5, "qa_cos_p10": 0.1}).withColumnRenamed(key, "language")
    out = totals.join(cosines, "language", "left")
    return out if near_dup is None else out.join(near_dup.withColumnRenamed(key, "language"), "language", "left")


def issues_of(summary: DataFrame) -> DataFrame:
    """(language, issues): what the summary's rates and medians hint at, joined by `; `."""
    c, limit = F.col, ISSUE_LIMITS
    tests = [
        ("answer-script mismatch", c("a_script_ok_rate") < limit["a_script_ok_rate"]), ("answer-language mismatch", c("a_lang_ok_rate") < limit["a_lang_ok_rate"]),
        ("low coherence", c("qa_cos_median") < limit["qa_cos_median"]), ("high duplication", c("near_dup_rate") > limit["near_dup_rate"]),
        ("repetitive answers", c("a_repetition_mean") > limit["a_repetition_mean"]),
    ]
    return summary.select("language", cascade.issues(tests).alias("issues"))


def near_dup_rates(rows: DataFrame, sample: int | None, key: str = "ord", by: str = "subset", threshold: float = DIAGNOSED_NEAR_DUP, seed: int = 42) -> DataFrame:
    """(by, near_dup_rate): the share of a sample of each group's questions (None: of all) that near-duplicate an earlier one."""
    taken = rows if sample is None else sampling.stratified(rows, by, sample, key, seed)
    decided = similarity.near_duplicates(taken, key, by, F.col("input"), threshold)
    return decided.groupBy(F.col("group").alias(by)).agg(F.avg((~F.col("kept")).cast("double")).alias("near_dup_rate"))


def diagnose(df: DataFrame, detect: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame], sample: int | None = DIAGNOSED_SAMPLE) -> dict[str, DataFrame]:
    """rows (per-row diagnosis), summary, worst (20 of least cosine by language), issues. No row is deleted but those without text.

    df: ID, ord, input, output, subset. detect adds q_lang, q_lang_conf, a_lang, a_lang_conf; embed adds q_emb and a_emb, of length 1.
    """
    tidy = io.clean_rows(df.withColumns({c: T.clean_whitespace(F.col(c)) for c in ("input", "output")}))
    q, a, script = F.col("input"), F.col("output"), F.col("expected_script")
    rows = tidy.withColumns({"expected_script": T.lookup(F.col("subset"), T.EXPECTED_SCRIPT, F.lit("UNKNOWN")), "_a": T.once(T.tokens(a)), "q_tokens": T.once(T.token_count(q))})
    rows = rows.withColumns({
        "a_tokens": F.size("_a"), "a_repetition": T.once(T.repeated_share(F.col("_a"))), "q_script": T.dominant_script(q), "a_script": T.dominant_script(a),
        "q_script_ok": T.script_ok(q, script), "a_script_ok": T.script_ok(a, script),
    }).drop("_a")
    rows = detect(rows)
    accepted = M.codes_of(F.col("subset"), M.ACCEPTED_CODES)
    for x, text in (("q", q), ("a", a)):
        found = M.detected(text, F.col(f"{x}_lang"), F.col(f"{x}_lang_conf"))
        rows = rows.withColumns({f"{x}_lang": found["code"], f"{x}_lang_conf": found["confidence"]}).withColumn(f"{x}_lang_ok", M.language_accepted(F.col(f"{x}_lang"), F.col(f"{x}_lang_conf"), accepted))
    rows = embed(rows).withColumn("qa_cos", S.dot(F.col("q_emb"), F.col("a_emb")))
    rows = sampling.settled(rows, "diagnosed")  # models have run: they do not run again
    summary = summary_of(rows, near_dup_rates(rows, sample))
    worst = sampling.per_group(rows.filter("qa_cos is not null and not isnan(qa_cos)"), "subset", WORST, [F.col("qa_cos"), F.col("ord")])
    return {"rows": rows, "summary": summary, "worst": worst.drop("q_emb", "a_emb"), "issues": issues_of(summary)}


def clean_second_generation(df: DataFrame, limits: CleanLimits | None = None) -> tuple[DataFrame, DataFrame]:
    """(survivors, rows with their drop_reason): the cascade, then greedy near duplicates within each language. df: diagnostic rows with ord."""
    p, c = limits or CleanLimits(), F.col
    rules = [
        (f"Q < {p.min_q_tokens} tokens", c("q_tokens") < p.min_q_tokens), (f"A < {p.min_a_tokens} tokens", c("a_tokens") < p.min_a_tokens),
        (f"A > {p.max_a_tokens} tokens", c("a_tokens") > p.max_a_tokens), (f"A repetition > {p.max_repetition}", c("a_repetition") > p.max_repetition),
    ]
    for tag, least in p.qa_cos_min.items():
        own = c("subset") == tag
        rules.append((f"[{tag}] answer script mismatch", own & ~c("a_script_ok")))
        if tag in p.language_checked:
            rules.append((f"[{tag}] answer language mismatch", own & ~c("a_lang_ok")))
        rules.append((f"[{tag}] cosine < {least}", own & S.below(c("qa_cos"), least)))
    judged = cascade.with_drop_reason(df, rules)
    left = judged.filter("drop_reason is null")
    decided = similarity.near_duplicates(left, "ord", "subset", c("input"), p.near_dup).select(c("key").alias("ord"), "kept")
    left = left.join(decided, "ord").withColumn("drop_reason", F.when(~c("kept"), F.lit("near-duplicates within language")))
    return left.filter("kept").drop("kept", "drop_reason"), judged.filter("drop_reason is not null").unionByName(left.filter("drop_reason is not null").drop("kept"))


def back_translations(df: DataFrame, translate: Callable[[DataFrame], DataFrame], targets: dict[str, int], key: str = "ID", seed: int = 42) -> DataFrame:
    """Questions rewritten by `translate` (adds `rewritten`): twice the target drawn, filtered, trimmed to the target."""
    order = [sampling.draw(seed, key), F.col(key)]
    drawn = sampling.per_group(df.filter(T.token_count(F.col("input")).between(*BACK_Q_TOKENS)), "subset", {s: 2 * n for s, n in targets.items()}, order)
    made = translate(drawn).withColumn("chrf_qq", T.once(O.chrf(F.col("input"), F.col("rewritten"))))
    good = made.filter(F.col("chrf_qq").between(*BACK_CHRF) & F.length("rewritten").between(*BACK_CHARS) & T.script_ok(F.col("rewritten"), T.lookup(F.col("subset"), T.EXPECTED_SCRIPT)))
    return sampling.per_group(good, "subset", targets, order).select(F.col("rewritten").alias("input"), "output", "subset", F.lit("backtranslation").alias("aug_method"), "chrf_qq")


def english_seeds(df: DataFrame, n: int, preferred: str = "Eng_Gha", least: float = SEED_COSINE) -> DataFrame:
    """The 2n best strictly clean rows of the preferred subset, or of all English ones where that is empty."""
    c = F.col
    own = df.filter(c("subset") == preferred)
    source = own if own.limit(1).count() else df.filter(c("subset").startswith("Eng_"))
    flags = c("q_script_ok") & c("a_script_ok") & c("q_lang_ok") & c("a_lang_ok")
    good = flags & S.at_least(c("qa_cos"), least) & c("q_tokens").between(*SEED_Q_TOKENS) & c("a_tokens").between(*SEED_A_TOKENS) & (c("a_repetition") < SEED_REPETITION)
    return sampling.top(source.filter(good), 2 * n, [c("qa_cos").desc(), c("ord")])


def transferred(df: DataFrame, n: int, subset: str, source: str, relevance: Column, detection: tuple[Column, Column] | None = None) -> DataFrame:
    """Translated seeds (input, output) that look right in their language, the n most alike their seeds.

    detection: code and confidence of each answer's language, enforced only for the languages that detectors know well.
    """
    q, a = F.col("input"), F.col("output")
    script = F.lit(T.EXPECTED_SCRIPT.get(subset))
    kept = df.withColumn("semantic_preserved", relevance).filter(T.script_ok(a, script) & T.script_ok(q, script) & T.token_count(q).between(*TRANSFER_Q_TOKENS) & T.token_count(a).between(*TRANSFER_A_TOKENS))
    if subset in TRANSFER_LANGUAGE_CHECKED:
        if detection is None:
            raise ValueError(f"answers in {subset} need their detected language")
        found = M.detected(a, *detection)
        kept = kept.filter(M.language_accepted(found["code"], found["confidence"], M.codes_of(F.lit(subset), M.ACCEPTED_CODES), TRANSFER_CONFIDENCE))
    kept = kept.filter(S.at_least(F.col("semantic_preserved"), TRANSFER_COSINE))
    return sampling.top(kept, n, [F.col("semantic_preserved").desc(), q]).select("input", "output", F.lit(subset).alias("subset"), F.lit(f"crosslingual_from_{source}").alias("aug_method"), "semantic_preserved")


def paraphrase_candidates(df: DataFrame, targets: dict[str, int], least: float = CANDIDATE_COSINE) -> DataFrame:
    """The best 2n answers of each language, with their prompts."""
    c = F.col
    rows = df.filter(c("q_script_ok") & c("a_script_ok") & S.at_least(c("qa_cos"), least) & c("a_tokens").between(*CANDIDATE_A_TOKENS) & (c("a_repetition") < CANDIDATE_REPETITION))
    rows = sampling.per_group(rows, "subset", {s: 2 * n for s, n in targets.items()}, [c("qa_cos").desc(), c("ord")])
    return rows.withColumn("prompt", T.paraphrase_prompt(c("input"), c("output"), c("subset")))


def paraphrases(df: DataFrame, targets: dict[str, int], relevance: Column) -> DataFrame:
    """Rewritten answers (`rewritten`) that pass the gate, the n most faithful of each language."""
    r = F.col("rewritten")
    made = df.withColumns({"chrf_aa": T.once(O.chrf(F.col("output"), F.col("rewritten"))), "semantic_preserved": relevance})
    good = (F.length(r) >= PARAPHRASE_CHARS) & T.script_ok(r, T.lookup(F.col("subset"), T.EXPECTED_SCRIPT)) & F.col("chrf_aa").between(*PARAPHRASE_CHRF)
    good = good & S.at_least(F.col("semantic_preserved"), PARAPHRASE_COSINE) & T.token_count(r).between(*PARAPHRASE_TOKENS) & (T.repetition_ratio(r) < PARAPHRASE_REPETITION)
    rows = sampling.per_group(made.filter(good), "subset", targets, [F.col("semantic_preserved").desc(), r])
    return rows.select("input", r.alias("output"), "subset", F.lit("llm_paraphrase").alias("aug_method"), "chrf_aa", "semantic_preserved")


def merge(original: DataFrame, augmented: list[DataFrame], caps: dict[str, int] | None = None, threshold: float = 0.85) -> DataFrame:
    """Originals and the augmented rows that no original of their language resembles; capped, originals first. Columns: input, output, subset, source."""
    base = original.select("input", "output", "subset").withColumn("source", F.lit("original"))
    if augmented:
        added = augmented[0].select("input", "output", "subset", F.col("aug_method").alias("source"))
        for more in augmented[1:]:
            added = added.unionByName(more.select("input", "output", "subset", F.col("aug_method").alias("source")))
        added = sampling.settled(added.withColumn("_id", F.xxhash64("input", "output", "subset", "source")), "augmented")  # models have run: they do not run again
        shingled = lambda rows, key: similarity.shingle_rows(rows.select(key.alias("key"), F.col("subset").alias("group"), "input"), "key", "group", F.col("input"), 5)
        hit = similarity.similar_across(shingled(added, F.col("_id")), shingled(base, F.xxhash64("input", "output", "subset")), threshold)
        base = base.unionByName(added.join(hit.select(F.col("a").alias("_id")).distinct(), "_id", "left_anti").drop("_id"))
    base = base.dropna(subset=["input", "output", "subset"])
    return sampling.capped(base, "subset", caps or {}, F.col("source") == "original", [F.md5(F.concat_ws("|", "input", "output"))])


# --- the first generation: cleaning and gate


def clean_first_generation(df: DataFrame, split: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clean rows, quarantined rows, change log). Order: exact duplicates before normalising, then text, privacy, safety, tag. df: ID, ord, input, output, subset."""
    i, o = F.col("input"), F.col("output")
    first = df.groupBy(T.row_hash(i, o).alias("_hash")).agg(F.min("ord").alias("_first"))
    rows = df.withColumn("_hash", T.row_hash(i, o)).join(first, "_hash").withColumn("_again", F.col("ord") > F.col("_first"))
    rows = rows.withColumns({"_input": T.strip_noise(udfs.nfc("input")), "_output": T.strip_noise(udfs.nfc("output")), "_subset": T.normalise_tag(F.col("subset"))})
    rows = rows.withColumns({"_pii": T.contains_pii(F.col("_input")) | T.contains_pii(F.col("_output")), "_safety_flag": T.flag_unsafe(F.col("_output"))})
    own = ~F.col("_again")
    cut = lambda c, n=120: F.substring(c, 1, n)
    log = cascade.change_log(rows, "ID", [
        ("REMOVED_DUPLICATE", F.col("_again"), cut(i), F.lit("DROPPED")),
        ("TEXT_NORMALISED_INPUT", own & (F.col("_input") != i), cut(i), cut(F.col("_input"))),
        ("TEXT_NORMALISED_OUTPUT", own & (F.col("_output") != o), cut(o), cut(F.col("_output"))),
        ("QUARANTINE_PII", own & F.col("_pii"), cut(F.col("_input")), F.lit("QUARANTINED")),
        ("FLAGGED_UNSAFE_ANSWER", own & F.col("_safety_flag"), cut(F.col("_output"), 200), F.lit("FLAGGED")),
        ("SUBSET_TAG_FIXED", own & (F.col("_subset") != F.col("subset")), F.col("subset"), F.col("_subset")),
        ("QUARANTINE_INVALID_SUBSET", own & F.col("_subset").isNull(), F.col("subset"), F.lit("QUARANTINED")),
    ], split=F.lit(split))
    out = rows.filter(own).select("ID", "ord", F.col("_input").alias("input"), F.col("_output").alias("output"), F.coalesce("_subset", "subset").alias("subset"), "_safety_flag", (F.col("_pii") | F.col("_subset").isNull()).alias("_held"))
    return out.filter(~F.col("_held")).drop("_held"), out.filter("_held").drop("_held"), log


def quality_gate(
    df: DataFrame, toxicity: Column | tuple[Column, Column], relevance: Column, language: Column | None = None, least: float = 0.5, most: float = 20.0, relevant: float = 0.5
) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all gates, funnel report). toxicity: the probabilities of question and answer, of which neither may reach the limit, or one for the row."""
    sides = toxicity if isinstance(toxicity, tuple) else (toxicity, F.lit(None).cast("double"))
    seen = T.script_present(F.col("input"), F.col("subset"))
    gates = [
        ("length_ratio", T.length_ratio(F.col("input"), F.col("output")).between(least, most)),
        ("language_id", seen if language is None else seen & F.coalesce(language, F.lit(True))),
        ("toxicity", M.free_of_toxicity(*sides)), ("semantic_relevance", S.at_least(relevance, relevant)),
    ]
    return cascade.passing(df, gates), cascade.gate_funnel(df, gates)


# --- the first generation's augmentation


def forward_translations(df: DataFrame, translate: Callable[[DataFrame, str, str], DataFrame], codes: dict[str, str], least: float, thresholds: dict[str, float] | None = None) -> DataFrame:
    """English rows in every language of codes (tag -> model code) that is not English, kept where translation and original are alike in characters.

    translate(rows, text, output) translates a column from `source_code` to `target_code`; both texts of a pair go through it.
    """
    wanted = {tag: code for tag, code in codes.items() if code != ENGLISH_CODE}
    targets = F.explode(F.array(*[F.struct(F.lit(t).alias("subset"), F.lit(c).alias("target_code")) for t, c in wanted.items()]).cast("array<struct<subset:string,target_code:string>>"))
    rows = df.filter(F.col("subset").isin(*ENGLISH)).select("input", "output", F.lit(ENGLISH_CODE).alias("source_code"), targets.alias("t")).select("input", "output", "source_code", "t.*")
    made = translate(translate(rows, "input", "_input"), "output", "_output")
    tidy = made.withColumns({"_input": T.strip(F.col("_input")), "_output": T.strip(F.col("_output"))})
    alike = T.once(O.sentence_chrf(T.strip(F.col("input")), F.col("_input")))
    enough = T.lookup(F.col("subset"), thresholds, F.lit(least)) if thresholds else F.lit(least)
    kept = tidy.withColumn("_alike", alike).filter((F.col("_alike") >= enough) & (F.col("_input") != "") & (F.col("_output") != ""))
    return kept.select(F.col("_input").alias("input"), F.col("_output").alias("output"), "subset", F.lit("forward_mt").alias("source"))


def suffixed_ids(df: DataFrame, suffix: str = "_bt", order: str = "ord") -> DataFrame:
    """ID with a suffix; where the column exists a null is written `nan`, where it is missing rows are numbered within their subset."""
    if "ID" in df.columns:
        return df.withColumn("ID", F.concat(F.coalesce(F.col("ID").cast("string"), F.lit("nan")), F.lit(suffix)))
    ranked = sampling.group_ranks(df, "subset", [F.col(order)], "_nth")
    return ranked.withColumn("ID", F.concat(F.lit("bt_"), F.col("subset"), F.lit("_"), (F.col("_nth") - 1).cast("string"), F.lit(suffix))).drop("_nth")


def paraphrased_back(df: DataFrame, translate: Callable[[DataFrame, str, str], DataFrame], paraphrase: Scorer, codes: dict[str, str]) -> DataFrame:
    """Questions that are not English, to English, paraphrased and back, with their own answers. No filter but that for blank texts. df: ID?, ord, input, output, subset."""
    wanted = {tag: code for tag, code in codes.items() if code != ENGLISH_CODE}
    if not wanted:
        return suffixed_ids(df.limit(0)).select("ID", "input", "output", "subset", F.lit("back_bt").alias("source"))
    rows = suffixed_ids(df.filter(F.col("subset").isin(*wanted))).withColumn("_own", T.lookup(F.col("subset"), wanted))
    there = translate(rows.withColumns({"source_code": F.col("_own"), "target_code": F.lit(ENGLISH_CODE)}), "input", "_english")
    said = paraphrase.score(there, ["_english"], "_said")
    back = translate(said.withColumns({"source_code": F.lit(ENGLISH_CODE), "target_code": F.col("_own")}), "_said", "_back")
    return back.withColumn("_back", T.strip(F.col("_back"))).filter("_back <> ''").select("ID", F.col("_back").alias("input"), "output", "subset", F.lit("back_bt").alias("source"))


def augment(
    spark: SparkSession, df: DataFrame, folder: str, translate: Callable[[DataFrame, str, str], DataFrame], paraphrase: Scorer, codes: dict[str, str], least: float,
    thresholds: dict[str, float] | None = None, ratios: dict[str, float] | None = None, external: str | None = None, seed: int = 42,
) -> DataFrame:
    """The first generation's training rows: originals and external rows, forward translations, back translations of both, mixed by ratio, with ids.

    Written to folder/final once; a second call only reads it. Both translations are written language by language, and languages
    that are there already are not translated again. Rows that were translated forward are translated back too. df: ID, input, output, subset.
    """

    def by_language(make: Callable[[str], DataFrame], name: str) -> DataFrame:
        io.write_missing_partitions(make, f"{folder}/{name}", values=[tag for tag, code in codes.items() if code != ENGLISH_CODE], spark=spark)
        return spark.read.schema("ID string, input string, output string, source string, subset string").parquet(f"{folder}/{name}")

    def make() -> DataFrame:
        base = io.clean_rows(df.select(F.col("ID").cast("string").alias("ID"), "input", "output", "subset")).withColumn("source", F.lit("original"))
        if external is not None:
            more, _ = io.read_external(spark, external)
            base = base if more is None else base.unionByName(more, allowMissingColumns=True)
        forward = by_language(lambda tag: forward_translations(base, translate, {tag: codes[tag]}, least, thresholds).withColumn("ID", F.lit(None).cast("string")), "forward")
        rows = sampling.settled(base.unionByName(forward).withColumn("ord", F.xxhash64("ID", "input", "output", "subset", "source")), "rows")
        back = by_language(lambda tag: paraphrased_back(rows, translate, paraphrase, {tag: codes[tag]}), "back")
        whole = rows.drop("ord").unionByName(back)
        keyed = whole.withColumn("_key", F.md5(F.concat_ws("|", F.coalesce("ID", F.lit("")), "input", "output", "subset", "source")))
        mixed = sampling.mixed_by_ratio(keyed, "subset", ratios or {}, "_key", seed)
        return sampling.fallback_ids(mixed, "ID", [sampling.draw(seed, "_key", F.col("copy").cast("string")), F.col("copy")]).drop("_key", "copy")

    return io.unless_written(spark, f"{folder}/final", make)


# --- training, evaluation, serving


def training_rows(df: DataFrame, phase_one: tuple[str, ...] | None = None) -> DataFrame:
    """Clean rows with their prompts, of the first phase's subsets only if these are given. Columns are checked before rows."""
    rows = io.clean_rows(io.require_columns(df, ("input", "output", "subset")))
    rows = rows.filter(F.col("subset").isin(*phase_one)) if phase_one else rows
    return rows.withColumn("prompt", T.answer_prompt(F.col("input"), F.col("subset")))


def training_data(train: DataFrame, validation: DataFrame, tokenizer_path: str, phase_one: tuple[str, ...] | None = None, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(training examples: input_ids and labels; validation examples with their texts and val_index). Empty examples are left out."""
    rows = training_rows(train, phase_one)
    if not rows.limit(1).count():
        raise ValueError("no training rows are left")
    held = sampling.positions(training_rows(validation), [F.col(order)], "val_index")
    tokens = lambda df: io.training_export(io.tokenised(df, tokenizer_path))
    return tokens(rows.select("prompt", "output")).select("input_ids", "labels"), tokens(held).select("val_index", "input", "output", "subset", "prompt", "input_ids", "labels")


def prediction_dump(df: DataFrame, n: int = 50, phase: int = 1, step: int = 0, epoch: float = 0.0, key: str = "ID", seed: int = 42) -> DataFrame:
    """A quota sample of validation rows with their scores over ASCII tokens and their lengths. df: key, subset, input, reference, prediction."""
    rows = sampling.quota_and_backfill(df, "subset", n, key, seed)
    p, r = (T.strip(F.coalesce(F.col(c), F.lit(""))) for c in ("prediction", "reference"))
    a, b = T.rouge_tokens(p, "ascii"), T.rouge_tokens(r, "ascii")
    return rows.select(
        F.lit(phase).alias("phase"), F.lit(step).alias("global_step"), F.lit(epoch).alias("epoch"), key, "subset", "input", r.alias("reference"), p.alias("prediction"),
        O.rouge1(a, b).alias("rouge1"), O.rouge_l(a, b).alias("rougeL"), F.length(r).alias("reference_chars"), F.length(p).alias("prediction_chars"),
    )


def with_rouge(df: DataFrame, kind: str = "unicode") -> DataFrame:
    """df with rouge1 and rougeL of prediction and reference."""
    both = df.withColumn("_rouge", O.rouge(F.col("prediction"), F.col("reference"), kind))
    return both.withColumns({"rouge1": F.col("_rouge.rouge1"), "rougeL": F.col("_rouge.rougeL")}).drop("_rouge")


def means_by_language(rows: DataFrame) -> DataFrame:
    """(language, n, rouge1_f1, rougeL_f1) with OVERALL, the means over all rows."""
    means = rows.cube("subset").agg(F.grouping("subset").alias("_all"), F.count("*").alias("n"), F.avg("rouge1").alias("rouge1_f1"), F.avg("rougeL").alias("rougeL_f1"))
    return means.select(F.when(F.col("_all") == 1, F.lit("OVERALL")).otherwise(F.col("subset")).alias("language"), "n", "rouge1_f1", "rougeL_f1")


def evaluate(
    df: DataFrame, generate: Callable[[DataFrame], DataFrame] | None = None, judge: Scorer | None = None, bert: Scorer | None = None, per_language: int = 100, limit: int | None = None,
    order: str = "ord", key: str = "ID", seed: int = 42,
) -> dict[str, DataFrame]:
    """rows with ROUGE, ROUGE by language with OVERALL, judge means of a stratified sample, BERTScore means, the composite score, a one-row summary.

    df: key, subset, input, output and, without `generate` (which adds it), prediction. `limit` keeps the first rows by `order`.
    """
    rows = io.clean_rows(df)
    rows = rows.orderBy(order).limit(limit) if limit else rows
    rows = (generate(rows) if generate else rows).withColumn("reference", F.col("output"))
    rows = sampling.settled(with_rouge(rows), "evaluated")  # models have run: they do not run again
    out = {"rows": rows, "rouge": means_by_language(rows)}
    summary = out["rouge"].filter("language = 'OVERALL'").select("n", "rouge1_f1", "rougeL_f1")
    if judge is not None:
        scored = sampling.settled(judge.score(sampling.stratified(rows, "subset", per_language, key, seed), ["reference", "prediction"], "reply").withColumn("score", S.judge_score(F.col("reply"))), "judged")
        out["judge"] = scored.groupBy("subset").agg(F.bround(F.avg("score"), 3).alias("score"), F.count("*").alias("n"))
        summary = summary.join(F.broadcast(scored.agg(F.avg("score").alias("judge"))))  # one row each
        summary = summary.withColumn("composite", S.composite(F.col("rouge1_f1"), F.col("rougeL_f1"), F.col("judge")))
        out["composite"] = summary.select(F.col("composite").alias("score"))
    if bert is not None:
        summary = summary.withColumns({name: F.lit(value) for name, value in M.bert_means(rows, bert).items()})
    return out | {"summary": summary}


def submit(df: DataFrame, generate: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Predictions for test rows (ID, input, subset), written as a submission."""
    made = sampling.settled(generate(io.clean_rows(df, ("input", "subset"))), "predicted")
    io.write_submission(made, path)
    return made


def decode_search(df: DataFrame, generate: Callable[[DataFrame], DataFrame], grid: DataFrame, per_language: int, key: str = "ID", seed: int = 42) -> DataFrame:
    """The best grid row of each language by mean ROUGE-L over ASCII tokens; `generate` adds `prediction` to samples joined with the grid."""
    sample = sampling.stratified(df, "subset", per_language, key, seed).drop(*grid.columns)
    made = with_rouge(generate(sample.join(F.broadcast(grid))), "ascii")  # a grid has tens of rows
    means = made.groupBy("subset", *grid.columns).agg(F.avg("rougeL").alias("score"))
    return sampling.best_of_grid(means, "subset", "score")


def answered(requests: DataFrame, generate: Callable[[DataFrame], DataFrame], detectors: list[Column], known: dict[str, str], disclaimers: dict[str, str], default: str) -> DataFrame:
    """Requests as the service answers them: language, prompt, answer, confidence, disclaimer, and what is logged of them.

    requests: question_id, question, language, client, latency_ms, ts. generate adds answer and probabilities (of the tokens chosen).
    """
    from ..streaming import serving

    explicit = F.when(F.col("language").isin(*set(known.values())), F.col("language"))
    rows = requests.withColumn("language", F.coalesce(explicit, serving.routed(detectors, F.col("question"), known)))
    rows = generate(rows.withColumn("prompt", T.serving_prompt(F.col("question"), F.col("language"))))
    return rows.select(
        "question_id", "language", "prompt", "answer", S.mean_confidence(F.col("probabilities")).alias("confidence"),
        serving.disclaimer(F.col("language"), disclaimers, default).alias("disclaimer"), F.bround("latency_ms", 1).alias("latency_ms"),
        T.anonymised_ip(F.col("client").cast("string")).alias("ip_hash"), "ts",
    )
