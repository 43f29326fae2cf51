"""Learning weights and thresholds from verdicts.

Rows meet the driver only as counts of distinct feature vectors in steps of 1e-6, summed in Spark; the descent runs on
those with numpy. Rescoring is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.operators import evaluation as E
from tallyline.operators.evaluation import pair_key
from tallyline.operators.matching import REINVOICE, ScoringConfig, label_of

# Features in order, weights that stay, prior means and strengths of those learned, verdicts needed.
FEATURES = ("invoice_no", "vendor", "amount", "date", "period_match", "rule_period_match", "rule_period_diff")
PINNED = {"vendor": 0.25, "amount": 0.30}
PRIOR_MEAN = {"invoice_no": 0.35, "date": 0.10, "period_match": 0.0, "rule_period_match": 0.0, "rule_period_diff": 0.0}
PRIOR_STRENGTH = {"invoice_no": 1.0, "date": 4.0, "period_match": 1.0, "rule_period_match": 1.0, "rule_period_diff": 1.0}
MIN_DECISIONS = 20
#: Distinct vectors the driver takes; with more, the model isn't made.
MAX_VECTORS = 2_000_000


@dataclass
class TunedModel:
    weights: dict[str, float] = field(default_factory=lambda: dict(PRIOR_MEAN))
    bias: float = 0.0
    flag_threshold: float = 0.90
    review_threshold: float = 0.70
    n_decisions: int = 0
    train_metrics: dict = field(default_factory=dict)
    model_id: str = ""

    def column(self) -> Column:
        z = F.lit(self.bias)
        for name in FEATURES:
            z = z + F.lit(self.weights.get(name, 0.0) + PINNED.get(name, 0.0)) * F.col(f"f_{name}")
        return 1.0 / (1.0 + F.exp(-z))

    def scores(self, x: np.ndarray) -> np.ndarray:
        w = np.array([self.weights.get(n, 0.0) + PINNED.get(n, 0.0) for n in FEATURES])
        return _sigmoid(self.bias + x @ w)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def with_features(pairs: DataFrame, invoices: DataFrame) -> DataFrame:
    """Adds ``f_...`` columns; similarities that are null count as 0."""
    month = F.coalesce(F.date_format("invoice_date", "yyyy-MM"), F.lit(""))
    a = invoices.select(F.col("id").alias("id_a"), month.alias("_ma"))
    b = invoices.select(F.col("id").alias("id_b"), month.alias("_mb"))
    rows = pairs.join(a, "id_a", "left").join(b, "id_b", "left")
    same = F.when((F.col("_ma") != "") & (F.col("_ma") == F.col("_mb")), 1.0).otherwise(0.0)
    rule = F.when(F.col("breakdown.rule") == REINVOICE, 1.0).otherwise(0.0)
    made = {f"f_{n}": F.coalesce(F.col(f"breakdown.{n}"), F.lit(0.0)) for n in FEATURES[:4]}
    return rows.withColumns(made | {"f_period_match": same, "f_rule_period_match": rule * same, "f_rule_period_diff": rule * (1.0 - same)}).drop("_ma", "_mb")


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, rate: float = 0.004, epochs: int = 30_000, tolerance: float = 1e-7) -> tuple[dict[str, float], float]:
    """Gradient descent on the summed log loss with Gaussian priors; ``n`` counts equal rows.

    Only the weights with a prior move, and the bias, which has none. The step falls to a quarter for the last fifth of
    the epochs; it ends when no parameter moves by ``tolerance``. No rows leave the prior means.
    """
    names = list(PRIOR_MEAN)
    mean, strength = np.array(list(PRIOR_MEAN.values())), np.array(list(PRIOR_STRENGTH.values()))
    w, b = mean.copy(), 0.0
    if not len(x):
        return dict(zip(names, w.tolist())), b
    n = np.ones(len(x)) if n is None else n
    learned = x[:, [FEATURES.index(k) for k in names]]
    fixed = sum(PINNED[k] * x[:, FEATURES.index(k)] for k in PINNED)
    for epoch in range(epochs):
        error = n * (_sigmoid(b + learned @ w + fixed) - y)
        step = rate if epoch < epochs * 4 // 5 else rate * 0.25
        move_w, move_b = step * (learned.T @ error + 2.0 * strength * (w - mean)), step * error.sum()
        w, b = w - move_w, b - move_b
        if max(np.abs(move_w).max(), abs(move_b)) < tolerance:
            break
    return dict(zip(names, w.tolist())), float(b)


def select_thresholds(scores: np.ndarray, positive: np.ndarray, n: np.ndarray | None = None) -> tuple[float, float]:
    """(flag, review): the best F1 on a grid of thousandths (ties: the larger), and the best F2 below it (the smaller)."""
    n = np.ones(len(scores)) if n is None else n
    grid = np.arange(20, 990) / 1000
    order = np.argsort(scores)
    start = np.searchsorted(scores[order], grid, "left")

    def at_or_above(weight: np.ndarray) -> np.ndarray:
        return np.append(np.cumsum(weight[order][::-1])[::-1], 0.0)[start]

    tp, over, total = at_or_above(n * positive), at_or_above(n), float((n * positive).sum())
    precision = np.divide(tp, over, out=np.zeros_like(tp), where=over > 0)
    recall = tp / total if total else np.zeros_like(tp)

    def f(beta: float) -> np.ndarray:
        below = beta * beta * precision + recall
        return np.round(np.divide((1 + beta * beta) * precision * recall, below, out=np.zeros_like(tp), where=below > 0), 9)

    f1, f2 = f(1.0), f(2.0)
    at = int(np.flatnonzero(f1 == f1.max())[-1])
    flag = float(grid[at])
    return flag, float(grid[int(np.argmax(f2[:at]))]) if at else flag / 2


def build_model(pairs: DataFrame, invoices: DataFrame, decisions: DataFrame, model_id: str = "", epochs: int = 30_000) -> TunedModel:
    """A model from the verdicts on pairs that a reviewer could see (label flag or review).

    At least MIN_DECISIONS verdicts, and both kinds among the visible pairs, are needed.
    """
    if decisions.limit(MIN_DECISIONS).count() < MIN_DECISIONS:
        raise ValueError(f"at least {MIN_DECISIONS} verdicts are needed")
    seen = pairs.where(F.lower(F.trim("label")) != "pass").withColumns(dict(zip(("key_a", "key_b"), pair_key())))
    seen = seen.groupBy("key_a", "key_b").agg(F.max_by(F.struct("id_a", "id_b", "breakdown"), F.struct("score", "id_a")).alias("x")).select("key_a", "key_b", "x.*")
    rows = with_features(seen, invoices).join(decisions.select("key_a", "key_b", "decision"), ["key_a", "key_b"])
    y = (F.col("decision") == "duplicate").cast("double").alias("y")
    counted = rows.groupBy(*(F.round(f"f_{n}", 6).alias(n) for n in FEATURES), y).agg(F.count(F.lit(1)).alias("n"))
    got = counted.limit(MAX_VECTORS + 1).toPandas()
    if len(got) > MAX_VECTORS:
        raise ValueError(f"more than {MAX_VECTORS} different vectors: round the similarities first")
    got = got.sort_values([*FEATURES, "y"])
    x, target, n = got[list(FEATURES)].to_numpy(float), got["y"].to_numpy(float), got["n"].to_numpy(float)
    positives = float((n * target).sum())
    if not 0 < positives < n.sum():
        raise ValueError("verdicts of both kinds are needed")
    weights, bias = fit(x, target, n, epochs=epochs)
    model = TunedModel(weights, round(bias, 9), n_decisions=int(n.sum()), model_id=model_id)
    scores = model.scores(x)
    model.flag_threshold, model.review_threshold = select_thresholds(scores, target, n)
    over = scores >= model.flag_threshold
    tp, flagged = float((n * target)[over].sum()), float(n[over].sum())
    model.train_metrics = {
        "n_decisions": int(n.sum()), "n_duplicate": int(positives), "n_not_duplicate": int(n.sum() - positives),
        "decision_precision_at_flag": round(tp / flagged, 4) if flagged else 0.0, "decision_recall_at_flag": round(tp / positives, 4),
    }
    return model


def rescored(pairs: DataFrame, invoices: DataFrame, model: TunedModel) -> DataFrame:
    """All pairs with the model's score and label; what was before stays in ``breakdown.tuned``.

    Differing tax ids cap the score at half the review threshold.
    """
    score = model.column()
    score = F.when(F.col("breakdown.tax_id") == "mismatch", F.least(score, F.lit(0.5 * model.review_threshold))).otherwise(score)
    tuned = F.struct(F.col("score").alias("score_before"), F.col("label").alias("label_before"), F.lit(model.model_id or None).cast("string").alias("model"))
    rows = with_features(pairs, invoices).withColumn("_new", F.round(F.least(score, F.lit(1.0)), 9))
    audited = F.col("breakdown").withField("tuned", tuned)
    return rows.select("id_a", "id_b", F.col("_new").alias("score"), label_of(F.col("_new"), model.flag_threshold, model.review_threshold).alias("label"), audited.alias("breakdown"))


@dataclass
class Tuning:
    """What tuning did: the model, figures before and after, rule fires, and pairs that were passed before and no longer are."""

    model: TunedModel
    before: dict
    after: dict
    rule_fires: list[dict]
    no_longer_passed: int
    pairs: DataFrame


def tune(store, invoices: DataFrame, pairs: DataFrame, decisions: DataFrame, model_id: str, apply: bool = True, epochs: int = 30_000) -> Tuning:
    """Learn a model from the verdicts, compare before and after, and (unless ``apply`` is False) make it the active one.

    ``pairs`` are those of the untuned scoring. Applied, the model is recorded and the stored pairs are replaced.
    """
    from tallyline.sources.store import log_model

    model = build_model(pairs, invoices, decisions, model_id, epochs)
    rescored_pairs = rescored(pairs, invoices, model)
    base = ScoringConfig()
    before = E.evaluate(invoices, pairs, base.flag_threshold, base.review_threshold).first().asDict()
    after = E.evaluate(invoices, rescored_pairs, model.flag_threshold, model.review_threshold).first().asDict()
    fires = [r.asDict() for r in E.rule_fires(invoices, pairs).collect()]  # four rows at most
    passed = pairs.where("label = 'pass'").select("id_a", "id_b")
    lost = passed.join(rescored_pairs.where("label = 'pass'").select("id_a", "id_b"), ["id_a", "id_b"], "left_anti").count()
    if apply:
        store.replace("pairs", rescored_pairs)
        log_model(store, model)
    return Tuning(model, before, after, fires, lost, rescored_pairs)


def reset(store, pairs: DataFrame) -> bool:
    """Make no model the active one and store the untuned ``pairs``; whether a model had been active."""
    from tallyline.sources.store import active_model, log_model

    had = active_model(store) is not None
    if had:
        log_model(store, None, active=False)
    store.replace("pairs", pairs)
    return had
