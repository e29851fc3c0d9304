"""Life cycles: dump to masked chat records with their profile, predictions to inference, and human evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import constants as K
from textloom.operators import audit, chat, cleaning, contracts, evaluation, inference, masking, profile
from textloom.plans.manifest import Timings, compression_hint, narrative


def build_corpus(raw: DataFrame, prompt: str, test_share: float = K.TEST_SHARE) -> dict[str, DataFrame]:
    """Raw pairs (ordinal, id, source, target, data_cadastro) to cleaned, masked and split chat records.

    One lineage: reject -> clean -> mask -> split. The masked table is kept by the
    caller (persist or write it), as split, audit and profile all read it.
    """
    judged = cleaning.with_reject_reason(raw)
    dated = contracts.require_dates(cleaning.kept(judged), "data_cadastro", "corpus")
    masked = masking.mask_pairs(dated)
    usable = masked.filter("NOT too_short")
    split = evaluation.chronological_split(usable, "data_cadastro", "ordinal", test_share)
    records = split.select("ordinal", "split", chat.chat_record("source", "target", prompt).alias("contents"))
    return {"judged": judged, "masked": masked, "split": split, "train": records.filter("split = 'train'"), "test": records.filter("split = 'test'")}


def audit_records(records: DataFrame) -> DataFrame:
    """Residual personal data in chat records, prompt left aside."""
    pairs = chat.extract_pair(records)
    text = F.array_join(F.filter(F.array("source", "target"), lambda t: t != ""), " ")
    return audit.audit_report(pairs.select("ordinal", text.alias("text")), "text")


def _one(df: DataFrame) -> dict:
    row = df.first()
    return {k: (round(v, 2) if isinstance(v, float) else v) for k, v in row.asDict().items()} if row else {}


def profile_report(split: DataFrame, raw: DataFrame, judged: DataFrame, masked: DataFrame, timings: Timings | None = None) -> dict:
    """The profile as a dictionary: every part is an aggregate of bounded size, rounded here and not before."""
    pairs = profile.with_ratio(split).persist()
    rejects = _one(cleaning.reject_counts(judged))
    n_raw, n_clean = rejects["total"], rejects["kept"]
    n_split = {r["split"]: r["n"] for r in pairs.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    counters = {r["counter"]: r["n"] for r in masking.mask_totals(masked).collect()}
    source, target = _one(profile.distribution(pairs, "n_source")), _one(profile.distribution(pairs, "n_target"))
    report = {
        "funnel": profile.funnel([("raw", n_raw), ("clean", n_clean), ("usable", sum(n_split.values())), ("train", n_split.get("train", 0))]),
        "rejects": rejects, "masking": counters, "source_words": source, "target_words": target,
        "source_outliers": _one(profile.iqr_outliers(pairs, "n_source")), "target_outliers": _one(profile.iqr_outliers(pairs, "n_target")),
        "source_histogram": {r["label"]: r["n"] for r in profile.histogram(pairs, "n_source", 200).orderBy("bin").collect()},
        "target_histogram": {r["label"]: r["n"] for r in profile.histogram(pairs, "n_target", 10).orderBy("bin").collect()},
        "ratio": _one(profile.ratio_stats(pairs)), "novel_ngrams": {r["n"]: round(r["mean"], 1) for r in profile.novel_ngrams(pairs).collect()},
        "vocabulary": _one(profile.vocabulary(pairs)), "terms": [r.asDict() for r in profile.top_terms(pairs, "target").collect()],
        "topics": [r.asDict() for r in profile.topic_distribution(pairs, profile.topic_of("target")).orderBy(F.desc("n"), "topic").collect()],
        "anomalies": {r["kind"]: r.asDict() for r in profile.anomaly_summary(pairs).collect()},
        "years": {r["year"]: r["n"] for r in profile.temporal_profile(raw, profile.wall_clock("data_cadastro")).orderBy("year").collect()},
        "spearman": _one(profile.spearman(pairs, "n_source", "n_target")), "trend": _one(profile.linear_trend(pairs, "n_source", "n_target")),
        "hint": compression_hint(source["median"], target["median"]), "timings": dict(timings.seconds) if timings else {},
    }
    report["narrative"] = narrative(n_raw, n_clean, sum(v for k, v in counters.items() if k != "descartados_pos_anon"), report["ratio"]["median"])
    pairs.unpersist()
    return report


def statistics(metrics: DataFrame, primary: list[str], iterations: int = K.ITERATIONS, families: dict | None = None) -> dict[str, DataFrame]:
    """The long metric table (case_id, condition_id, metric, score) to adjusted comparisons and summaries."""
    contracts.require_empty(contracts.invalid_scores(metrics), "invalid scores")
    contracts.require_empty(contracts.duplicate_keys(metrics, "case_id", "condition_id", "metric"), "duplicate scores")
    pairs = evaluation.metric_pairs(metrics, families or evaluation.condition_families())
    contracts.require_empty(pairs.filter("ft is null or zs is null").select("family", "metric", "case_id"), "unpaired scores")
    compared = inference.compare(pairs, iterations).persist()
    inference.require_primary(compared, primary)
    return {"comparisons": inference.adjust(compared, primary), "success": inference.success_by_family(inference.adjust(compared, primary)), "directions": inference.direction_consistency(compared)}


def prepare_human_evaluation(cases: DataFrame, predictions: DataFrame, per_stratum: int = K.CASES_PER_STRATUM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sample, key, template) for blind rating: cases by length quartile, items by seeded permutations."""
    from textloom.functions.text import word_count

    strata = evaluation.quartile_strata(cases.withColumn("n_source", word_count("source")), "n_source", "case_id")
    sample = evaluation.seeded_sample(strata, "stratum", "case_id", ["n_source", "case_id"], per_stratum)
    joined = evaluation.join_predictions(sample.select("case_id", "source", "reference"), predictions.join(sample.select("case_id"), "case_id", "left_semi"))
    in_order = joined.join(sample.select("case_id", "stratum", "test_index"), "case_id")
    items = evaluation.seeded_blinded_items(in_order, ["stratum", "test_index", "case_id"]).drop("stratum", "test_index")
    package, key = evaluation.blind_package(items)
    return package.join(sample.select("case_id", "stratum", "source", "reference"), "case_id"), key, evaluation.rating_grid(items)


def human_report(ratings: DataFrame, grid: DataFrame, key: DataFrame, raters: list[str]) -> dict[str, DataFrame]:
    """Checked ratings to agreement by criterion and means by condition."""
    contracts.require_empty(contracts.invalid_ratings(ratings).select("item_id"), "invalid ratings")
    contracts.require_raters(ratings, n=len(raters))
    evaluation.require_grid(grid, ratings)
    named = evaluation.unblind(ratings, key)
    kappa = evaluation.cohen_kappa(evaluation.rater_pairs(named, raters), raters[0], raters[1], ["criterion"])
    return {"kappa": kappa, "means": evaluation.rating_means(named)}
