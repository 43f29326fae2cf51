"""Finding probable duplicates: normalise, block, score, label."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import normalize as N
from tallyline.functions import similarity as S
from tallyline.plans.lineage import Scratch, spread

FLAG, REVIEW, PASS = "flag", "review", "pass"
REINVOICE = "reinvoice_pattern"
#: Members from which on a blocking key says too little to compare all of them.
MAX_BLOCK = 1000


# Weights of the fields and all numbers of the scoring contract.
@dataclass(frozen=True)
class FieldWeights:
    invoice_no: float = 0.35
    vendor: float = 0.25
    amount: float = 0.30
    date: float = 0.10

    def __post_init__(self) -> None:
        if not math.isclose(math.fsum(asdict(self).values()), 1.0, abs_tol=1e-9):
            raise ValueError("the weights of the fields must add up to 1")


@dataclass(frozen=True)
class ScoringConfig:
    weights: FieldWeights = field(default_factory=FieldWeights)
    flag_threshold: float = 0.90
    review_threshold: float = 0.70
    date_decay_days: float = 45.0
    reinvoice_window_days: int = 14
    reinvoice_floor: float = 0.92
    tax_mismatch_cap: float = 0.55
    invno_mismatch_factor: float = 0.70


def normalized(invoices: DataFrame) -> DataFrame:
    """(id, place, vendor, vendor_key, invoice_no, amount, day, tax_id, period) of every invoice.

    ``place`` is where the invoice stands in load order (created_at, then id; null dates first) and decides which one of a
    pair comes first. A missing amount counts as 0, as it does when invoices are loaded from a table.
    """
    vendor = N.vendor_canonical(F.col("vendor_name"))
    base = invoices.select(
        "id",
        F.struct(F.coalesce(F.col("created_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("at"), F.col("id").alias("id")).alias("place"),
        vendor.alias("vendor"),
        N.invoice_no_canonical(F.col("invoice_no")).alias("invoice_no"),
        F.coalesce("amount", F.lit(0)).cast("bigint").alias("amount"),
        F.col("invoice_date").alias("day"),
        N.tax_id_canonical(F.col("tax_id")).alias("tax_id"),
    )
    return base.withColumns({"vendor_key": N.vendor_key(F.col("vendor")), "period": N.billing_period(F.col("day"))})


def blocking_keys(rows: DataFrame) -> DataFrame:
    """(key, id, place): vendor with number, and amount. Pairs are compared only if they share a key."""
    number = F.when((F.col("vendor_key") != "") & (F.col("invoice_no") != ""), F.concat(F.lit("vn|"), "vendor_key", F.lit("|"), "invoice_no"))
    amount = F.concat(F.lit("amt|"), F.col("amount").cast("string"))
    return rows.select(F.explode(F.array_compact(F.array(number, amount))).alias("key"), "id", "place")


def _block_sizes(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("members"))


#: Keys of oversized blocks up to which they are broadcast to the rows; beyond, the rows are joined with them by a shuffle.
BROADCAST_KEYS = 1_000_000
#: What is compared of two invoices.
COMPARED = ("vendor", "invoice_no", "amount", "day", "tax_id", "period")


def _blocked(rows: DataFrame, large: DataFrame, few: bool) -> DataFrame:
    """(id_a, id_b and COMPARED of both), a before b in load order: each pair that shares a key not in ``large``, once.

    Rows meet in one self join on the keys, whatever is compared travels along. A pair that shares both keys is emitted
    by the first only, so nothing has to be made distinct. Members of an oversized block have lost its key before.
    """
    number = F.when((F.col("vendor_key") != "") & (F.col("invoice_no") != ""), F.concat(F.lit("vn|"), "vendor_key", F.lit("|"), "invoice_no"))
    keyed = rows.select("id", "place", *COMPARED, number.alias("vn"), F.concat(F.lit("amt|"), F.col("amount").cast("string")).alias("amt"))
    for kind in ("vn", "amt"):
        left_out = large.where(F.startswith("key", F.lit(f"{kind}|"))).select(F.col("key").alias(kind), F.lit(True).alias("_large"))
        joined = keyed.join(F.broadcast(left_out) if few else left_out, kind, "left")
        keyed = joined.withColumn(kind, F.when(F.col("_large").isNull(), F.col(kind))).drop("_large")
    held = keyed.withColumn("key", F.explode(F.array_compact(F.array("vn", "amt"))))
    a = held.select("key", *(F.col(c).alias(f"{c}_a") for c in ("id", "place", "vn", *COMPARED)))
    b = held.select("key", *(F.col(c).alias(f"{c}_b") for c in ("id", "place", "vn", *COMPARED)))
    once = F.startswith("key", F.lit("vn|")) | ~F.coalesce(F.col("vn_a") == F.col("vn_b"), F.lit(False))
    return a.join(b, "key").where((F.col("place_a") < F.col("place_b")) & once).drop("key", "place_a", "place_b", "vn_a", "vn_b")


def _oversized(scratch: Scratch, rows: DataFrame, max_block: int) -> tuple[DataFrame, bool]:
    """Keys with more than ``max_block`` members (at most one in ``max_block`` rows), kept; whether they are few."""
    large = _block_sizes(blocking_keys(rows)).where(F.col("members") > max_block).select("key")
    kept, seen = scratch.measured(large, n=F.count(F.lit(1)))
    return kept, seen["n"] <= BROADCAST_KEYS


def candidate_pairs(rows: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """(id_a, id_b), a before b in load order: every pair that shares a key of 2 to ``max_block`` members.

    A larger block is left out as a whole, which is part of the definition: such a key tells too little. Sizes come from a
    partial aggregate, and the members of a huge block lose its key before anything is paired.
    """
    return _blocked(rows, *_oversized(Scratch(rows.sparkSession, "blocks"), rows, max_block)).select("id_a", "id_b")


def blocking_stats(rows: DataFrame, max_block: int = MAX_BLOCK, pairs: DataFrame | None = None) -> DataFrame:
    """One row: invoices, keys, keys left out for their size, candidate pairs, all pairs, and the share saved.

    ``pairs``: the candidates, if they are at hand.
    """
    keys = _block_sizes(blocking_keys(rows)).agg(F.count(F.lit(1)).alias("n_blocks"), F.count_if(F.col("members") > max_block).alias("n_skipped_blocks"))
    n = rows.agg(F.count(F.lit(1)).alias("n_invoices"))
    found = (candidate_pairs(rows, max_block) if pairs is None else pairs).agg(F.count(F.lit(1)).alias("n_candidates"))
    one = n.withColumn("one", F.lit(1)).join(keys.withColumn("one", F.lit(1)), "one").join(found.withColumn("one", F.lit(1)), "one").drop("one")
    naive = (F.col("n_invoices") * (F.col("n_invoices") - 1) / 2).cast("bigint")
    saved = F.when(F.col("naive_candidates") == 0, 0.0).otherwise(F.round(1.0 - F.col("n_candidates") / F.col("naive_candidates"), 6))
    return one.withColumn("naive_candidates", naive).withColumn("reduction", saved)


def label_of(score: Column, flag: float, review: float) -> Column:
    return F.when(score >= flag, FLAG).when(score >= review, REVIEW).otherwise(PASS)


def scored(rows: DataFrame, pairs: DataFrame, config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """(id_a, id_b, score, label, breakdown) of each pair of ids.

    Weighted similarities; a floor where vendor and amount agree, the number differs and the dates are 1 to
    ``reinvoice_window_days`` apart; a cap where both tax ids are there and differ, which comes last.
    """
    a = rows.select(*(F.col(c).alias(f"{c}_a") for c in ("id", *COMPARED)))
    b = rows.select(*(F.col(c).alias(f"{c}_b") for c in ("id", *COMPARED)))
    return _scored(pairs.join(a, "id_a").join(b, "id_b"), config)


def _scored(both: DataFrame, config: ScoringConfig) -> DataFrame:
    """``scored`` of pairs that carry COMPARED of both; the two string measures are taken in one Arrow pass."""
    both = both.withColumn("s", S.text_similarities("invoice_no_a", "invoice_no_b", "vendor_a", "vendor_b"))
    both = both.withColumns({"s_no": F.col("s.no"), "s_vendor": F.col("s.vendor")})
    differs = (F.col("invoice_no_a") != F.col("invoice_no_b")) & (F.col("invoice_no_a") != "") & (F.col("invoice_no_b") != "")
    w = config.weights
    parts = both.withColumns({
        "s_no": F.when(differs, config.invno_mismatch_factor * F.col("s_no")).otherwise(F.col("s_no")),
        "s_amount": S.amount_similarity(F.col("amount_a"), F.col("amount_b")),
        "s_date": S.date_similarity(F.col("day_a"), F.col("day_b"), config.date_decay_days),
        "period": S.period_match(F.col("period_a"), F.col("period_b")),
    })
    total = w.invoice_no * F.col("s_no") + w.vendor * F.col("s_vendor") + w.amount * F.col("s_amount") + w.date * F.col("s_date")
    gap = F.abs(F.date_diff("day_a", "day_b"))
    again = (F.col("s_vendor") == 1.0) & (F.col("s_amount") == 1.0) & (F.col("invoice_no_a") != F.col("invoice_no_b")) & gap.between(1, config.reinvoice_window_days)
    again = F.coalesce(again, F.lit(False))
    tax = F.when((F.col("tax_id_a") == "") | (F.col("tax_id_b") == ""), "n/a").when(F.col("tax_id_a") == F.col("tax_id_b"), "match").otherwise("mismatch")
    raised = F.when(again, F.greatest(total, F.lit(config.reinvoice_floor))).otherwise(total)
    capped = F.when(tax == "mismatch", F.least(raised, F.lit(config.tax_mismatch_cap))).otherwise(raised)
    score = F.round(F.least(capped, F.lit(1.0)), 9)
    breakdown = F.struct(
        F.col("s_no").alias("invoice_no"), F.col("s_vendor").alias("vendor"), F.col("s_amount").alias("amount"), F.col("s_date").alias("date"),
        F.col("period").alias("billing_period_match"), tax.alias("tax_id"), F.when(again, REINVOICE).alias("rule"),
    )
    return parts.select("id_a", "id_b", score.alias("score"), label_of(score, config.flag_threshold, config.review_threshold).alias("label"), breakdown.alias("breakdown"))


@dataclass(frozen=True)
class Detection:
    pairs: DataFrame
    stats: DataFrame


def detect(invoices: DataFrame, config: ScoringConfig = ScoringConfig(), max_block: int = MAX_BLOCK) -> Detection:
    """All scored pairs of a table of invoices, and one row of counts. Empty tables give no pairs and zeros."""
    scratch = Scratch(invoices.sparkSession, "detect")
    needed = ("id", "vendor_name", "invoice_no", "amount", "invoice_date", "tax_id", "created_at")
    rows = scratch.keep(normalized(spread(invoices.select(*needed))))
    pairs = scratch.keep(_scored(_blocked(rows, *_oversized(scratch, rows, max_block)), config))
    counts = pairs.agg(F.count(F.lit(1)).alias("scored_pairs"), F.count_if(F.col("label") == FLAG).alias("flagged"), F.count_if(F.col("label") == REVIEW).alias("review"))
    stats = blocking_stats(rows, max_block, pairs).withColumn("one", F.lit(1)).join(counts.withColumn("one", F.lit(1)), "one").drop("one")
    return Detection(pairs, stats)
