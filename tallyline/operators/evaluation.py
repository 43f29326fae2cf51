"""Judging scored pairs against known duplicates, and the numbers a dashboard needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SWEEP = (0.80, 0.85, 0.88, 0.90, 0.92, 0.95)


def pair_key(a: str = "id_a", b: str = "id_b") -> tuple[Column, Column]:
    """Both ids in string order: the same for either orientation."""
    return F.least(a, b).alias("key_a"), F.greatest(a, b).alias("key_b")


def known_pairs(invoices: DataFrame) -> DataFrame:
    """(key_a, key_b, variant): each invoice with a non-empty ``duplicate_of`` and what that names; 'unknown' if no variant."""
    tied = invoices.where("duplicate_of <> ''")
    variant = F.when(F.col("variant") != "", F.col("variant")).otherwise("unknown")
    return tied.select(*pair_key("id", "duplicate_of"), variant.alias("v")).groupBy("key_a", "key_b").agg(F.max("v").alias("variant"))


def pair_scores(pairs: DataFrame) -> DataFrame:
    """(key_a, key_b, score): one score for each pair, of its latest row (of the latest, the highest)."""
    order = F.struct("created_at", "score") if "created_at" in pairs.columns else F.struct("score")
    return pairs.where("score is not null").select(*pair_key(), "score", order.alias("o")).groupBy("key_a", "key_b").agg(F.max_by("score", "o").alias("score"))


def judged(invoices: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key_a, key_b, variant, score): scored or known pairs; ``variant`` is null for pairs that are no known duplicates."""
    return known_pairs(invoices).join(pair_scores(pairs), ["key_a", "key_b"], "full_outer")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _measures(df: DataFrame) -> DataFrame:
    precision, recall = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("gt_pairs"))
    out = df.withColumn("fp", F.col("flagged_pairs") - F.col("tp")).withColumn("fn", F.col("gt_pairs") - F.col("tp"))
    out = out.withColumn("precision", precision).withColumn("recall", recall)
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def evaluate(invoices: DataFrame, pairs: DataFrame, flag: float = 0.90, review: float = 0.70) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1, known, flagged and queued pairs. Pairs without a score count as 0.

    Thresholds must be above 0, where an unscored known pair would count as found. Empty denominators give 0.
    """
    if flag <= 0:
        raise ValueError("the threshold must be above 0")
    s, known = F.coalesce("score", F.lit(0.0)), F.col("variant").isNotNull()
    queued = (s >= review) & (s < flag)
    counts = judged(invoices, pairs).agg(
        F.count_if(known & (s >= flag)).alias("tp"), F.count_if(known).alias("gt_pairs"), F.count_if(s >= flag).alias("flagged_pairs"),
        F.count_if(queued).alias("review_pairs"), F.count_if(queued & known).alias("gt_in_review"),
    )
    return _measures(counts).select(F.lit(flag).alias("threshold"), "tp", "fp", "fn", "precision", "recall", "f1", "gt_pairs", "flagged_pairs", "review_pairs", "gt_in_review")


def recall_by_variant(invoices: DataFrame, pairs: DataFrame, flag: float = 0.90) -> DataFrame:
    """(variant, total, found, recall) of the known duplicates."""
    known = judged(invoices, pairs).where("variant is not null")
    out = known.groupBy("variant").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("score") >= flag).alias("found"))
    return out.withColumn("recall", F.col("found") / F.col("total"))


def sweep(invoices: DataFrame, pairs: DataFrame, thresholds: tuple[float, ...] = SWEEP) -> DataFrame:
    """(threshold, precision, recall, f1, fp, flagged), all thresholds from one pass over the pairs."""
    s, known = F.coalesce("score", F.lit(0.0)), F.col("variant").isNotNull()
    per = judged(invoices, pairs).select(s.alias("s"), known.alias("known"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    over = F.col("s") >= F.col("threshold")
    counts = per.groupBy("threshold").agg(F.count_if(F.col("known") & over).alias("tp"), F.count_if("known").alias("gt_pairs"), F.count_if(over).alias("flagged_pairs"))
    return _measures(counts).select("threshold", *(F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")), "fp", F.col("flagged_pairs").alias("flagged"))


def distribution(invoices: DataFrame, pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id_a, id_b, score, gt, value, decision) of each stored pair.

    ``gt``: one names the other in ``duplicate_of``; ``value``: the larger of the two amounts, 0 for none; ``decision``:
    the latest verdict in either orientation. The two lookups are equi joins on ids, the verdicts one on the ordered key.
    """
    half = invoices.select("id", "amount", "duplicate_of")
    a = half.select(F.col("id").alias("id_a"), F.col("amount").alias("amount_a"), F.col("duplicate_of").alias("dup_a"))
    b = half.select(F.col("id").alias("id_b"), F.col("amount").alias("amount_b"), F.col("duplicate_of").alias("dup_b"))
    both = pairs.select("id_a", "id_b", "score").join(a, "id_a").join(b, "id_b")
    gt = F.coalesce(F.col("dup_a") == F.col("id_b"), F.lit(False)) | F.coalesce(F.col("dup_b") == F.col("id_a"), F.lit(False))
    value = F.greatest(F.coalesce("amount_a", F.lit(0)), F.coalesce("amount_b", F.lit(0)))
    rows = both.select("id_a", "id_b", *pair_key(), F.round("score", 6).alias("score"), gt.alias("gt"), value.alias("value"))
    return rows.join(decisions.select("key_a", "key_b", "decision"), ["key_a", "key_b"], "left").drop("key_a", "key_b")


def threshold_metrics(rows: DataFrame, flag: float, gt_total: int | None = None) -> DataFrame:
    """One row of counts at a threshold; precision estimates are null where nothing was decided or nothing is known."""
    return curve(rows, (flag,), gt_total)


def curve(rows: DataFrame, thresholds: tuple[float, ...], gt_total: int | None = None) -> DataFrame:
    """``threshold_metrics`` at many thresholds from one pass. A threshold that no pair reaches has zeros."""
    per = rows.select("score", "gt", "value", "decision", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    over = F.col("score") >= F.col("threshold")
    decided = over & (F.col("decision") != "")
    counts = per.groupBy("threshold").agg(
        F.count_if(over).alias("flagged"), F.coalesce(F.sum(F.when(over, F.col("value"))), F.lit(0)).alias("value_at_risk"),
        F.count_if(decided).alias("decided"), F.count_if(decided & (F.col("decision") == "duplicate")).alias("decided_duplicate"),
        F.count_if(over & F.col("gt")).alias("tp"),
    )
    estimate = F.when(F.col("decided") > 0, F.round(F.col("decided_duplicate") / F.col("decided"), 4))
    out = counts.withColumn("estimated_precision", estimate)
    if not gt_total:
        return out.drop("tp")
    return out.withColumns({
        "fp": F.col("flagged") - F.col("tp"), "precision": F.round(_ratio(F.col("tp"), F.col("flagged")), 4), "recall": F.round(F.col("tp") / F.lit(float(gt_total)), 4),
    })


def histogram(rows: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, known, other): pairs by score in equal bins of 0..1; scores outside fall into the first or last."""
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col("score") * bins))).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count_if("gt").alias("known"), F.count_if(~F.col("gt")).alias("other"))


def rule_fires(invoices: DataFrame, pairs: DataFrame) -> DataFrame:
    """(same_period, known, pairs): how often the re-invoice rule fired within a month or across, on duplicates or not."""
    month = F.coalesce(F.date_format("invoice_date", "yyyy-MM"), F.lit(""))
    a = invoices.select(F.col("id").alias("id_a"), month.alias("month_a"))
    b = invoices.select(F.col("id").alias("id_b"), month.alias("month_b"))
    fired = pairs.where("breakdown.rule = 'reinvoice_pattern'").select("id_a", "id_b", *pair_key()).join(a, "id_a").join(b, "id_b")
    known = known_pairs(invoices).select("key_a", "key_b", F.lit(True).alias("known"))
    rows = fired.join(known, ["key_a", "key_b"], "left")
    same = (F.col("month_a") != "") & (F.col("month_a") == F.col("month_b"))
    return rows.groupBy(same.alias("same_period"), F.coalesce("known", F.lit(False)).alias("known")).agg(F.count(F.lit(1)).alias("pairs"))
