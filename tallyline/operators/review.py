"""The store that reviewers work on: latest verdicts, the queue of pairs, counts and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.operators import evaluation as E
from tallyline.operators.evaluation import pair_key
from tallyline.operators.matching import ScoringConfig
from tallyline.sources.store import Store

DECISIONS = ("duplicate", "not_duplicate")
LABELS = ("flag", "review", "pass")
MAX_PAGE = 1000


def tidy(c: Column) -> Column:
    """Lower case, no surrounding blanks, inner blanks as underscores: how labels and verdicts are compared."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", "_")


def latest_decisions(log: DataFrame) -> DataFrame:
    """(key_a, key_b, decision, reviewer, decided_at): the last verdict on each unordered pair.

    Verdicts other than DECISIONS are ignored. Null times count as earliest; equal times: the larger verdict, then reviewer.
    ``max_by`` merges on the map side, so a pair decided a million times is one row a task in the shuffle.
    """
    rows = log.select(*pair_key(), tidy(F.col("decision")).alias("decision"), "reviewer", "decided_at").where(F.col("decision").isin(*DECISIONS))
    last = F.max_by(F.struct("decision", "reviewer", "decided_at"), F.struct("decided_at", "decision", F.coalesce("reviewer", F.lit("")).alias("r")))
    return rows.groupBy("key_a", "key_b").agg(last.alias("x")).select("key_a", "key_b", "x.*")


def review_queue(pairs: DataFrame, invoices: DataFrame, decisions: DataFrame, label: str | None = None, undecided: bool = False) -> DataFrame:
    """Stored pairs with both invoices (``a`` and ``b``), their verdict, and which fields differ."""
    if label is not None and label not in LABELS:
        raise ValueError(f"label must be one of {LABELS}")
    fields = ("id", "vendor_name", "invoice_no", "amount", "currency", "invoice_date", "tax_id")
    half = invoices.select(F.struct(*fields).alias("x"), F.col("id").alias("_id"))
    rows = pairs.withColumn("label", tidy(F.col("label")))
    rows = rows.where(F.col("label") == label) if label else rows
    rows = rows.select("id_a", "id_b", "score", "label", *pair_key())
    rows = rows.join(half.select(F.col("_id").alias("id_a"), F.col("x").alias("a")), "id_a").join(half.select(F.col("_id").alias("id_b"), F.col("x").alias("b")), "id_b")
    rows = rows.join(decisions.select("key_a", "key_b", "decision", "reviewer", "decided_at"), ["key_a", "key_b"], "left").drop("key_a", "key_b")
    return rows.where("decision is null") if undecided else rows


def page(df: DataFrame, order: list, limit: int = 100, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in ``order`` (a top-k: no full sort)."""
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"limit must be 1 to {MAX_PAGE}, offset 0 or more")
    return df.orderBy(*order).offset(offset).limit(limit)


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(tidy(F.col(column)).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The row with one id; the filter reaches the scan."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


DECISION_LOG = "id_a string, id_b string, decision string, reviewer string, decided_at timestamp"


def record_decision(store: Store, pairs: DataFrame, id_a: str, id_b: str, decision: str, reviewer: str = "") -> DataFrame:
    """Add a verdict on a stored pair to the log and return its row; ``latest_decisions`` makes it the one that counts.

    ValueError for a verdict other than DECISIONS, KeyError for a pair that isn't stored in this orientation.
    """
    if decision not in DECISIONS:
        raise ValueError(f"a verdict is one of {DECISIONS}")
    if pairs.where((F.col("id_a") == id_a) & (F.col("id_b") == id_b)).limit(1).isEmpty():
        raise KeyError((id_a, id_b))
    row = store.spark.createDataFrame([(id_a, id_b, decision, reviewer)], "id_a string, id_b string, decision string, reviewer string").withColumn("decided_at", F.current_timestamp())
    kept = store.spark.createDataFrame(row.collect(), DECISION_LOG)  # one row, with the time it got
    store.append("decisions", kept)
    return kept


def simulated_decisions(invoices: DataFrame, pairs: DataFrame, reviewer: str = "simulated") -> DataFrame:
    """(id_a, id_b, decision, reviewer): what a reviewer without error would say of each flagged or queued pair."""
    known = E.known_pairs(invoices).select("key_a", "key_b", F.lit("duplicate").alias("d"))
    seen = pairs.where(tidy(F.col("label")).isin("flag", "review")).select(*pair_key()).distinct()
    rows = seen.join(known, ["key_a", "key_b"], "left")
    return rows.select(F.col("key_a").alias("id_a"), F.col("key_b").alias("id_b"), F.coalesce("d", F.lit("not_duplicate")).alias("decision"), F.lit(reviewer).alias("reviewer"))


def contributions(pairs: DataFrame, config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """(id_a, id_b, field, similarity, weight, contribution, band) of each stored pair and field.

    ``band``: high from 0.99, middle from 0.85, else low. A similarity that is null counts as 0.
    """
    w = config.weights
    cells = F.array(*(F.struct(F.lit(n).alias("field"), F.coalesce(F.col(f"breakdown.{n}"), F.lit(0.0)).alias("similarity"), F.lit(getattr(w, n)).alias("weight")) for n in ("invoice_no", "vendor", "amount", "date")))
    rows = pairs.select("id_a", "id_b", F.inline(cells))
    band = F.when(F.col("similarity") >= 0.99, "high").when(F.col("similarity") >= 0.85, "middle").otherwise("low")
    return rows.withColumns({"contribution": F.round(F.col("similarity") * F.col("weight"), 9), "band": band})


def dashboard(invoices: DataFrame, pairs: DataFrame, log: DataFrame, model=None, flag: float | None = None) -> DataFrame:
    """One row: counts of invoices, pairs by label, verdicts, and the figures at a threshold.

    The threshold is ``flag``, else that of the active model (a ``tuning.TunedModel``), whose scale the scores are then in,
    else 0.90. ``known`` and what is measured by it are null where no duplicate is known; nothing decided gives no estimate.
    """
    at = flag if flag is not None else model.flag_threshold if model else ScoringConfig().flag_threshold
    latest = latest_decisions(log)
    rows = E.distribution(invoices, pairs, latest)
    over = F.col("score") >= at
    decided = over & (F.col("decision") != "")
    figures = rows.agg(
        F.count_if(over).alias("flagged"), F.coalesce(F.sum(F.when(over, F.col("value"))), F.lit(0)).alias("value_at_risk"), F.count_if(over & F.col("gt")).alias("tp"),
        F.count_if(decided).alias("decided"), F.count_if(decided & (F.col("decision") == "duplicate")).alias("decided_duplicate"),
    )
    n = invoices.agg(F.count(F.lit(1)).alias("n_invoices"), F.nullif(F.count_if(F.col("duplicate_of") != ""), F.lit(0)).alias("known"))
    labels = pairs.agg(*(F.count_if(tidy(F.col("label")) == x).alias(f"label_{x}") for x in LABELS))
    verdicts = latest.agg(*(F.count_if(F.col("decision") == x).alias(f"verdict_{x}") for x in DECISIONS))
    out = figures
    for more in (n, labels, verdicts):
        out = out.join(F.broadcast(more), F.lit(True), "left")  # one row each
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4))
    known = F.col("known").isNotNull()
    return out.withColumns({
        "threshold": F.lit(at), "fp": F.when(known, F.col("flagged") - F.col("tp")), "precision": F.when(known, F.coalesce(ratio("tp", "flagged"), F.lit(0.0))),
        "recall": F.when(known, ratio("tp", "known")), "estimated_precision": ratio("decided_duplicate", "decided"), "tp": F.when(known, F.col("tp")),
    })
