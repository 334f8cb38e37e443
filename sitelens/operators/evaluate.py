"""Evaluation of decisions against labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lists import present

POSITIVE, NEGATIVE = "gaming_media", "not_gaming_media"


def binary_outcome(expected: Column, status: Column) -> Column:
    """IGNORE, ABSTAIN, TP, FP, FN or TN."""
    return (
        F.when(~expected.isin(POSITIVE, NEGATIVE) | expected.isNull(), "IGNORE")
        .when(status == "verified", F.when(expected == POSITIVE, "TP").otherwise("FP"))
        .when(status == "rejected", F.when(expected == POSITIVE, "FN").otherwise("TN"))
        .otherwise("ABSTAIN")
    )


def strict_correct(expected: Column, status: Column) -> Column:
    return ((expected == POSITIVE) & (status == "verified")) | ((expected == NEGATIVE) & (status == "rejected")) | ((expected == "uncertain") & status.isin("uncertain", "fetch_failed"))


def _ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    r = F.try_divide(a.cast("double"), b.cast("double"))
    return F.round(r if empty is None else F.coalesce(r, F.lit(empty)), 6)


def _counts() -> list[Column]:
    o, s = F.col("outcome"), F.col("predicted_status")
    return [
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(s == x).alias(f"n_{x}") for x in ("verified", "rejected", "uncertain", "fetch_failed")],
        *[F.count_if(o == x).alias(x.lower()) for x in ("TP", "FP", "FN", "TN", "ABSTAIN", "IGNORE")],
        F.count_if(F.col("correct")).alias("n_correct"),
    ]


def judged(preds: DataFrame) -> DataFrame:
    return preds.withColumn("outcome", binary_outcome(F.col("expected_label"), F.col("predicted_status"))).withColumn("correct", strict_correct(F.col("expected_label"), F.col("predicted_status")))


def eval_metrics(preds: DataFrame, by: str = "dataset_split") -> DataFrame:
    """Metrics per split and over all (scope ``overall``), 0 where a denominator is 0; one pass with a rollup."""
    d = judged(preds).rollup(by).agg(F.grouping(by).alias("g"), *_counts())
    c = F.col
    p, r = _ratio(c("tp"), c("tp") + c("fp")), _ratio(c("tp"), c("tp") + c("fn"))
    decided = c("tp") + c("fp") + c("fn") + c("tn")
    return d.select(
        F.when(c("g") == 1, "overall").otherwise(c(by)).alias("scope"),
        "total", "n_verified", "n_rejected", "n_uncertain", "n_fetch_failed", "tp", "fp", "fn", "tn",
        _ratio(decided, decided + c("abstain")).alias("coverage"),
        p.alias("precision"),
        r.alias("recall"),
        _ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"),
        _ratio(c("tn"), c("tn") + c("fp")).alias("specificity"),
        _ratio(c("tp") + c("tn"), decided).alias("accuracy"),
        _ratio(c("fp"), c("fp") + c("tn")).alias("fpr"),
        _ratio(c("fn"), c("fn") + c("tp")).alias("fnr"),
        _ratio(c("n_correct"), c("total")).alias("strict_accuracy"),
    )


def review_aware_metrics(preds: DataFrame) -> DataFrame:
    """One row; recalls over all positives and over decided ones, null where a denominator is 0."""
    c = F.col
    d = judged(preds).agg(*_counts(), F.count_if(c("expected_label") == POSITIVE).alias("positives"))
    return d.select(
        "total", "tp", "fp", "fn", "tn", "abstain",
        _ratio(c("tp"), c("tp") + c("fp"), None).alias("precision"),
        _ratio(c("tp"), c("positives"), None).alias("operational_recall"),
        _ratio(c("tp"), c("tp") + c("fn"), None).alias("decided_recall"),
        _ratio(c("tp") + c("tn"), c("tp") + c("fp") + c("fn") + c("tn"), None).alias("relevance_accuracy"),
    )


def confusion_matrix(preds: DataFrame) -> DataFrame:
    return preds.groupBy("expected_label", "predicted_status").agg(F.count(F.lit(1)).alias("n"))


def sweep_status(policy: str) -> Column:
    """Status under one threshold configuration; minimums apply to verified."""
    c = F.col
    enough = (c("gaming_score") >= c("gaming_minimum")) & (c("media_score") >= c("media_minimum")) & (c("market_score") >= c("market_minimum")) & (c("technical_score") >= c("technical_minimum"))
    base = F.when((c("total_score") >= c("verified_threshold")) & enough, "verified").when(c("total_score") < c("uncertain_threshold"), "rejected").otherwise("uncertain")
    return F.when(c("high_conf_neg") & (c("hard_rejection_confidence") >= 0.8), "rejected").otherwise(base) if policy == "5C" else base


def threshold_sweep(preds: DataFrame, grid: DataFrame, policy: str = "5C") -> DataFrame:
    """Metrics of every configuration in ``grid``, whose rows are a parameter set and are broadcast.

    Policies 5 and 5B count every prediction that is not positive, abstentions and uncertain labels too, as TN or FN; 5C leaves both out.
    """
    d = preds.join(F.broadcast(grid)).withColumn("status", sweep_status(policy))
    pos, ver = F.col("expected_label") == POSITIVE, F.col("status") == "verified"
    if policy == "5C":
        o = binary_outcome(F.col("expected_label"), F.col("status"))
    else:
        o = F.when(pos & ver, "TP").when(ver, "FP").when(pos, "FN").otherwise("TN")
    d = d.withColumn("o", o).groupBy("config_id").agg(*[F.count_if(F.col("o") == x).alias(x.lower()) for x in ("TP", "FP", "FN", "TN")], F.count_if(F.col("status") != "uncertain").alias("decided"), F.count(F.lit(1)).alias("total"))
    c = F.col
    return d.select(
        "config_id", "tp", "fp", "fn", "tn",
        _ratio(c("tp"), c("tp") + c("fp")).alias("precision"),
        _ratio(c("tp"), c("tp") + c("fn")).alias("recall"),
        _ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"),
        _ratio(c("decided"), c("total")).alias("coverage"),
    )


def _config(v: int, u: int, g: int, m: int, k: int, t: int, negative: bool = False) -> dict:
    return {"verified_threshold": v, "uncertain_threshold": u, "gaming_minimum": g, "media_minimum": m, "market_minimum": k, "technical_minimum": t, "high_conf_neg": negative}


#: The three published grids.
GRIDS = {
    "5": [_config(v, 50, g, m, k, t) for v in (70, 75, 80) for g in (18, 20, 22) for m in (14, 16, 18) for k in (8, 10) for t in (3, 4)],
    "5B": [_config(v, 45, g, m, k, 3) for v in (65, 70, 75) for g in (16, 18) for m in (12, 14) for k in (4, 8)] + [_config(60, 35, 14, 10, 0, 2)],
    "5C": [_config(v, u, 14, 10, 0, t, n) for v, u, t, n in ((60, 40, 2, False), (60, 40, 2, True), (60, 40, 0, True), (62, 40, 0, True), (58, 40, 0, True), (60, 40, 3, True), (58, 40, 2, True), (60, 38, 2, True), (62, 38, 2, True), (60, 38, 0, True))],
}
#: The score that each threshold is held against.
_HELD = {"verified_threshold": "total_score", "uncertain_threshold": "total_score", "gaming_minimum": "gaming_score", "media_minimum": "media_score", "market_minimum": "market_score", "technical_minimum": "technical_score"}
#: Fixed value: the rule that 5C judges by its confidence.
IDENTITY_RULE = "high_confidence_negative_identity"


def score_cells(preds: DataFrame, configs: Sequence[dict]) -> DataFrame:
    """Predictions by label, flags and, for each threshold, how many of the grid's values their score reaches, with their number ``n``.

    There are at most as many cells as combinations of these, whatever the number of predictions. Null scores reach
    nothing, a null confidence is not 1.
    """
    c = F.col
    reached = {name: sum((F.when(c(score) >= v, 1).otherwise(0) for v in sorted({x[name] for x in configs})), F.lit(0)).alias(name) for name, score in _HELD.items()}
    strong = F.coalesce((c("hard_rejection_confidence") == 1.0) & (c("gaming_score") <= 20) & (c("media_score") <= 15), F.lit(False))
    flags = c("hard_rule").isNotNull().alias("hard"), F.coalesce(c("hard_rule") != IDENTITY_RULE, F.lit(False)).alias("other"), strong.alias("strong")
    return preds.groupBy("expected_label", *flags, *reached.values()).agg(F.count(F.lit(1)).alias("n"))


def grid_sweep(preds: DataFrame, configs: Sequence[dict], policy: str) -> DataFrame:
    """Metrics of every configuration (config_id from 1), from the cells of ``score_cells`` alone.

    ``preds``: expected_label, hard_rule, hard_rejection_confidence and the scores. Policies 5 and 5B count every
    prediction, abstentions and uncertain labels too, as TN or FN unless it is positive; positive is verified under 5, and
    under 5B what reaches the thresholds without regard to the market. 5C leaves uncertain labels and abstentions out,
    lets a rule of confident negative identity reject only if asked to, and ignores the market.
    """
    cells = score_cells(preds, configs)
    steps = {name: {v: i + 1 for i, v in enumerate(sorted({x[name] for x in configs}))} for name in _HELD}
    made = [F.struct(F.lit(i + 1).alias("config_id"), *[F.lit(steps[n][x[n]]).alias(n) for n in _HELD], F.lit(bool(x.get("high_conf_neg"))).alias("negative")) for i, x in enumerate(configs)]
    d = cells.withColumn("x", F.explode(F.array(*made)))
    c, at_least = F.col, lambda n: F.col(n) >= F.col(f"x.{n}")
    scores = at_least("verified_threshold") & at_least("gaming_minimum") & at_least("media_minimum") & at_least("technical_minimum")
    low = ~at_least("uncertain_threshold") & at_least("technical_minimum")
    pos = c("expected_label") == POSITIVE
    if policy == "5C":
        rejected = c("other") | (c("x.negative") & c("strong"))
        status = F.when(rejected, "rejected").when(scores, "verified").when(low, "rejected").otherwise("uncertain")
        o = F.when(c("expected_label") == "uncertain", "IGNORE").when(status == "uncertain", "ABSTAIN").when(status == "verified", F.when(pos, "TP").otherwise("FP")).otherwise(F.when(pos, "FN").otherwise("TN"))
        decided, eligible = o.isin("TP", "FP", "FN", "TN"), o != "IGNORE"
    else:
        verified = ~c("hard") & scores & at_least("market_minimum")
        status = F.when(c("hard"), "rejected").when(at_least("verified_threshold"), F.when(verified, "verified").otherwise("uncertain")).when(low, "rejected").otherwise("uncertain")
        hit = verified if policy == "5" else ~c("hard") & scores
        o = F.when(pos & hit, "TP").when(hit, "FP").when(pos, "FN").otherwise("TN")
        decided, eligible = status != "uncertain", F.lit(True)
    total = lambda cond, name: F.coalesce(F.sum(F.when(cond, c("n"))), F.lit(0)).alias(name)
    d = d.groupBy(c("x.config_id").alias("config_id")).agg(*[total(o == k, k.lower()) for k in ("TP", "FP", "FN", "TN")], total(decided, "decided"), total(eligible, "total"))
    return d.select(
        "config_id", "tp", "fp", "fn", "tn", (c("total") - c("decided")).alias("abstentions"),
        _ratio(c("tp"), c("tp") + c("fp")).alias("precision"),
        _ratio(c("tp"), c("tp") + c("fn")).alias("recall"),
        _ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"),
        _ratio(c("decided"), c("total")).alias("coverage"),
        _ratio(c("tp") + c("tn"), c("total")).alias("accuracy"),
    )


def select_config(metrics: DataFrame, policy: str = "5", grid: DataFrame | None = None) -> DataFrame:
    """The best configuration under a policy, the lowest id on a tie.

    "5": fewest false positives, recall, F1, coverage. "5B": no false positives at recall 0.5 and coverage 0.6, at most one,
    then recall, F1, coverage, least sum of thresholds. "5C": at most one false positive, recall 0.5, coverage 0.6, then
    fewest false positives, recall, coverage, F1, least sum of thresholds. ``grid`` has the thresholds of 5B and 5C.
    """
    c, yes = F.col, lambda x: x.cast("int").desc()
    fewest, most = c("fp").asc(), lambda n: c(n).desc()
    if policy == "5":
        return metrics.orderBy(fewest, most("recall"), most("f1"), most("coverage"), "config_id").limit(1)
    names = ["verified_threshold", "gaming_minimum", "media_minimum", "technical_minimum", *(["market_minimum"] if policy == "5B" else [])]
    total = sum((c(n) for n in names[1:]), c(names[0]))
    d = metrics.join(F.broadcast(grid.select("config_id", total.alias("_sum"))), "config_id")  # a parameter set
    if policy == "5B":
        order = [yes((c("fp") == 0) & (c("recall") >= 0.5) & (c("coverage") >= 0.6)), yes(c("fp") <= 1), most("recall"), most("f1"), most("coverage")]
    else:
        order = [yes(c("fp") <= 1), yes(c("recall") >= 0.5), yes(c("coverage") >= 0.6), fewest, most("recall"), most("coverage"), most("f1")]
    return d.orderBy(*order, "_sum", "config_id").limit(1).drop("_sum")


def error_slices(preds: DataFrame) -> DataFrame:
    """Rows to look at, by slice; a row stands in each slice it belongs to."""
    o, pos = F.col("outcome"), F.col("expected_label") == POSITIVE
    slices = present(
        F.when(o == "FP", "false_positive"),
        F.when(o == "FN", "false_negative"),
        F.when((o == "ABSTAIN") & pos, "abstained_positive"),
        F.when((o == "ABSTAIN") & ~pos, "abstained_negative"),
        F.when(F.col("decision_override").isNotNull(), "gate_override"),
    )
    return judged(preds).select("domain", "expected_label", "predicted_status", F.explode(slices).alias("slice"))


def fetch_reliability(log: DataFrame, scope: str) -> DataFrame:
    """Totals, successes, usable rows, mean attempts and failures by category, per scope and overall."""
    d = log.rollup(scope).agg(F.grouping(scope).alias("g"), F.count(F.lit(1)).alias("total"), F.count_if("success").alias("n_success"), F.count_if("usable").alias("n_usable"), F.avg("attempts").alias("a"))
    return d.select(F.when(F.col("g") == 1, "overall").otherwise(F.col(scope)).alias("scope"), "total", "n_success", "n_usable", F.round("a", 6).alias("mean_attempts"))


def failure_histogram(log: DataFrame, scope: str) -> DataFrame:
    return log.where(~F.col("success")).groupBy(scope, "category").agg(F.count(F.lit(1)).alias("n"))


#: Columns that a tuned or scored feature table may have; labels and reviews are not among them.
FEATURES = (
    "domain", "dataset_split", "predicted_status", "gaming_score", "media_score", "market_score", "activity_score", "technical_score", "contextual_deductions",
    "total_score", "hard_rejection_rule", "hard_rejection_confidence", "decision_override", "usable",
)


def leakage(dev: DataFrame, test: DataFrame, key: str = "domain") -> DataFrame:
    """Keys in both sets; must be empty."""
    return dev.select(key).intersect(test.select(key))


def tuning_rows(rows: DataFrame, split: str = "dataset_split", key: str = "domain") -> DataFrame:
    """Rows that may be used for tuning: those of the development split whose key no test row has."""
    test = rows.where(F.col(split) == "test").select(key).distinct()
    return rows.where(F.col(split) == "development").join(test, key, "left_anti").select(*rows.columns)


def feature_columns(rows: DataFrame, allowed: Sequence[str] = FEATURES) -> DataFrame:
    """Only the columns on the list, so that no label reaches a score."""
    return rows.select(*[c for c in rows.columns if c in allowed])


def abstention_audit(preds: DataFrame, minimums: dict[str, int], verified: int) -> DataFrame:
    """Undecided rows with the minimums they miss, their distance to the threshold and the first cause."""
    missing = present(*[F.when(F.col(k) < v, k) for k, v in minimums.items()])
    d = preds.where(F.col("predicted_status") == "uncertain").withColumn("unmet", missing)
    return d.select("domain", "unmet", (F.lit(verified) - F.col("total_score")).alias("distance"), F.coalesce(F.get("unmet", F.lit(0)), F.lit("below_threshold")).alias("cause"))


def decision_audit(preds: DataFrame) -> DataFrame:
    decided = F.col("predicted_status").isin("verified", "rejected")
    return judged(preds).agg(
        F.count_if(decided & ~F.col("usable")).alias("decided_without_evidence"),
        F.count_if(decided & (F.col("technical_score") == 0)).alias("decided_without_technical"),
        F.count_if(F.col("outcome") == "TP").alias("tp"),
        F.count_if(F.col("outcome") == "FP").alias("fp"),
    )


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Rows and an order-insensitive content sum; md5 parts keep it equal across engines. Strings stand for values."""
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in df.columns]).cast("binary"))
    part = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(18,0)")  # 48 bits: a sum of longs is full after some 65,000 rows
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(part).cast("decimal(38,0)").alias("content"))


def compare_runs(a: DataFrame, b: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Metric by metric, both runs side by side."""
    long = lambda d, n: d.unpivot(key, list(metrics), "metric", n)
    return long(a, "a").join(long(b, "b"), [key, "metric"], "full_outer").withColumn("change", F.round(F.col("b") - F.col("a"), 6))


def label_summary(labels: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Counts by each dimension and in total, in one grouping-sets pass."""
    d = labels.groupingSets([[F.col(x)] for x in dims] + [[]], *dims)
    name = F.lit("total")
    for x in dims:
        name = F.when(F.grouping(x) == 0, x).otherwise(name)
    return d.agg(name.alias("dimension"), F.coalesce(*[F.col(x).cast("string") for x in dims], F.lit("all")).alias("value"), F.count(F.lit(1)).alias("n")).select("dimension", "value", "n")


#: Fixed values of the label rules.
WEBSITE_TYPES = (
    "gaming_publication", "general_media_gaming_section", "game_developer", "game_publisher", "gaming_retailer", "esports_organization",
    "forum_or_community", "hardware_or_technology", "creator_or_streaming_profile", "single_game_site", "inactive_or_archived_media", "unrelated", "ambiguous",
)
DIFFICULT_TYPES = ("game_developer", "game_publisher", "gaming_retailer", "general_media_gaming_section", "ambiguous", "inactive_or_archived_media")
ACTIVITY_STATUSES = ("active", "inactive", "unknown")
FICTITIOUS = ("example.com", "localhost", "test")
REVIEW_METHOD = "manual_public_web_review"


def validate_labels(labels: DataFrame, split_sizes: dict[str, int] | None = None) -> DataFrame:
    """(domain, violation): every rule that a row breaks, and, with a null domain, those that a split breaks.

    Only rules whose columns are there are applied. ``split_sizes``: rows a split must have. Null counts as blank.
    """
    has = set(labels.columns)
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    canonical = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c("domain"))), r"^https?://", ""), r"^www\.|/.*$", "")
    known = {"expected_label": (POSITIVE, NEGATIVE, "uncertain"), "website_type": WEBSITE_TYPES, "activity_status": ACTIVITY_STATUSES, "dataset_split": ("development", "test"), "review_method": (REVIEW_METHOD,)}
    rules = {f"blank_{n}": (n, F.trim(c(n)) == "") for n in ("domain", "homepage_url", "expected_label", "website_type", "label_reason", "evidence_summary", "reviewed_at", "review_method", "evidence_url_1")}
    rules |= {f"unknown_{n}": (n, ~c(n).isin(*values)) for n, values in known.items()}
    rules |= {f"{n}_too_short": (n, F.length(c(n)) < 10) for n in ("label_reason", "evidence_summary")}
    rules |= {f"{n}_scheme": (n, ~c(n).startswith("http")) for n in ("homepage_url", "evidence_url_1")}
    rules["domain_syntax"] = ("domain", ~canonical.contains(".") | canonical.contains(" "))
    rules["fictitious_domain"] = ("domain", canonical.rlike("|".join(x.replace(".", r"\.") for x in FICTITIOUS)))
    broken = present(*[F.when(cond, name) for name, (n, cond) in rules.items() if n in has])
    out = labels.select("domain", F.explode(broken).alias("violation"))
    twice = labels.groupBy(canonical.alias("domain")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out = out.unionByName(twice.select("domain", F.lit("duplicate_domain").alias("violation")))
    kinds = {"one_sided_split_": ~(F.max(F.col("expected_label") == POSITIVE) & F.max(F.col("expected_label") == NEGATIVE))}
    if "website_type" in has:
        kinds |= {"one_type_in_split_": F.min("website_type") == F.max("website_type"), "no_difficult_type_in_split_": ~F.max(F.col("website_type").isin(*DIFFICULT_TYPES))}
    splits = labels.where(F.col("dataset_split").isin("development", "test")).groupBy("dataset_split").agg(F.count(F.lit(1)).alias("n"), *[x.alias(k) for k, x in kinds.items()])
    found = [F.when(F.col(k), F.concat(F.lit(k), "dataset_split")) for k in kinds]
    found += [F.when((F.col("dataset_split") == s) & (F.col("n") != n), F.lit(f"size_of_split_{s}")) for s, n in (split_sizes or {}).items()]
    return out.unionByName(splits.select(F.lit(None).cast("string").alias("domain"), F.explode(present(*found)).alias("violation")))
