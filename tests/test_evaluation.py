from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.operators import evaluation as E
from tallyline.operators import review as R
from tallyline.operators import tuning as L
from tallyline.operators.heavy_keys import heavy_values, totals_by_key

ROWS = [(0.95, True, 100, None), (0.92, True, 250, "duplicate"), (0.91, False, 90, "not_duplicate"), (0.80, False, 500, "duplicate"), (0.50, True, 10, None)]


def dist(spark):
    return spark.createDataFrame(ROWS, "score double, gt boolean, value bigint, decision string")


def test_metrics(spark):
    m = E.threshold_metrics(dist(spark), 0.90, 3).first()
    assert (m.flagged, m.value_at_risk, m.tp, m.fp, m.decided, m.decided_duplicate, m.estimated_precision) == (3, 440, 2, 1, 2, 1, 0.5)
    assert (m.precision, m.recall) == (0.6667, 0.6667)
    none = E.threshold_metrics(dist(spark), 0.99).first()
    assert none.flagged == 0 and none.value_at_risk == 0 and none.estimated_precision is None
    assert E.curve(dist(spark), tuple(i / 100 for i in range(50, 101))).count() == 51


def test_histogram(spark):
    assert {r.bin: (r.known, r.other) for r in E.histogram(dist(spark)).collect()} == {19: (1, 0), 18: (1, 1), 16: (0, 1), 10: (1, 0)}


def test_evaluate(spark):
    inv = spark.createDataFrame([("a", None, None), ("b", "a", "format"), ("c", "a", ""), ("d", "", None)], "id string, duplicate_of string, variant string")
    pairs = spark.createDataFrame([("b", "a", 0.95), ("d", "a", 0.93), ("a", "c", 0.75)], "id_a string, id_b string, score double")
    r = E.evaluate(inv, pairs).first()
    assert (r.tp, r.fp, r.fn, r.gt_pairs, r.review_pairs, r.gt_in_review) == (1, 1, 1, 2, 1, 1)
    assert (r.precision, r.recall, r.f1) == (0.5, 0.5, 0.5)
    assert {v.variant: (v.total, v.found) for v in E.recall_by_variant(inv, pairs).collect()} == {"format": (1, 1), "unknown": (1, 0)}
    assert E.evaluate(inv.limit(0), pairs.limit(0)).first().f1 == 0.0
    assert E.sweep(inv, pairs).where("threshold = 0.95").first().flagged == 1
    with pytest.raises(ValueError):
        E.evaluate(inv, pairs, 0.0)


def test_latest_decision_wins_in_either_orientation(spark):
    t = [datetime(2024, 1, i) for i in (1, 2, 3)]
    log = spark.createDataFrame(
        [("a", "b", "Duplicate ", "x", t[0]), ("b", "a", "not duplicate", "y", t[1]), ("a", "b", "maybe", "z", t[2]), ("c", "d", "duplicate", None, None)],
        "id_a string, id_b string, decision string, reviewer string, decided_at timestamp",
    )
    got = {(r.key_a, r.key_b): (r.decision, r.reviewer) for r in R.latest_decisions(log).collect()}
    assert got == {("a", "b"): ("not_duplicate", "y"), ("c", "d"): ("duplicate", None)}
    pairs = spark.createDataFrame([("b", "a", 0.9, "FLAG"), ("c", "e", 0.8, " review")], "id_a string, id_b string, score double, label string")
    inv = spark.createDataFrame([(i, "V", "1", 5, "USD", date(2024, 1, 1), "") for i in "abcde"], "id string, vendor_name string, invoice_no string, amount bigint, currency string, invoice_date date, tax_id string")
    queue = R.review_queue(pairs, inv, R.latest_decisions(log))
    assert {r.id_a: r.decision for r in queue.collect()} == {"b": "not_duplicate", "c": None}
    assert R.review_queue(pairs, inv, R.latest_decisions(log), "review", True).count() == 1
    with pytest.raises(ValueError):
        R.review_queue(pairs, inv, log, "bad")
    with pytest.raises(ValueError):
        R.page(pairs, ["id_a"], limit=0)
    assert [r.id_a for r in R.page(pairs, [F.desc("score")], 1, 1).collect()] == ["c"]
    assert R.lookup(inv, "id", "c").count() == 1


def test_fit_separates_and_keeps_priors():
    x = np.array([[0.6, 0.25, 0.3, 0.2, 1, 0, 0]] * 60 + [[0.6, 0.25, 0.3, 0.2, 0, 0, 1]] * 60)
    y = np.array([1.0] * 60 + [0.0] * 60)
    w, b = L.fit(x, y)
    assert w["period_match"] > 0 > w["rule_period_diff"]
    grouped, bg = L.fit(x[[0, 60]], y[[0, 60]], np.array([60.0, 60.0]))
    assert all(abs(w[k] - grouped[k]) < 1e-6 for k in w) and abs(b - bg) < 1e-6
    assert L.fit(np.empty((0, 7)), np.empty(0)) == (L.PRIOR_MEAN, 0.0)


def test_thresholds():
    flag, review = L.select_thresholds(np.array([0.9] * 5 + [0.05] * 10), np.array([1.0] * 5 + [0.0] * 10))
    assert flag == 0.9 and review == 0.051
    again = L.select_thresholds(np.array([0.9, 0.05]), np.array([1.0, 0.0]), np.array([5.0, 10.0]))
    assert again == (flag, review)


def test_heavy_keys(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", 1, t, "x")] * 60 + [("b", 2, None, "y")] * 3 + [(None, None, t, "z"), ("", 2**62, t, "z"), ("", 2**62, t, "z")], "k string, amount bigint, at timestamp, n_rows string")
    got = {r.k: (r.n_rows, r.sum_amount, r.latest) for r in totals_by_key(df, "k", "amount", "at").collect()}
    assert got == {"a": (60, 60, t), "b": (3, 6, None), None: (1, None, t), "": (2, None, t)}
    assert {r.k for r in heavy_values(df, "k", 10).collect()} == {"a"}
    assert totals_by_key(df.limit(0), "k", "amount", "at").isEmpty() and heavy_values(df.limit(0), "k").isEmpty()


def test_decisions_tuning_and_dashboard(spark, tmp_path):
    from tallyline.operators import matching as M
    from tallyline.sources import jsonl, synthetic
    from tallyline.sources.store import Store, active_model

    store = Store(spark, str(tmp_path / "w"))
    inv = synthetic.generate(spark, 600, 0.1, 5).cache()
    pairs = M.detect(inv).pairs.cache()
    first = pairs.where("label = 'flag'").orderBy("id_a", "id_b").first()
    with pytest.raises(ValueError):
        R.record_decision(store, pairs, first.id_a, first.id_b, "maybe")
    with pytest.raises(KeyError):
        R.record_decision(store, pairs, "x", "y", "duplicate")
    assert R.record_decision(store, pairs, first.id_a, first.id_b, "duplicate", "me").first().reviewer == "me"
    assert store.read("decisions", R.DECISION_LOG).count() == 1
    log = R.simulated_decisions(inv, pairs).withColumn("decided_at", F.current_timestamp())
    latest = R.latest_decisions(log)
    done = L.tune(store, inv, pairs, latest, "m1", apply=False)
    assert active_model(store) is None and done.no_longer_passed == 0 and done.after["recall"] >= done.before["recall"] * 0.99
    done = L.tune(store, inv, pairs, latest, "m1")
    assert active_model(store).model_id == "m1"
    stored = store.read("pairs", jsonl.PAIR)
    assert stored.where("breakdown.tuned.model = 'm1' and breakdown.tuned.score_before is not null").count() == pairs.count()
    jsonl.write_pairs(stored, str(tmp_path / "out"), ordered=True)
    assert jsonl.read_pairs(spark, str(tmp_path / "out")).where("breakdown.tuned.label_before = 'flag'").count() == pairs.where("label = 'flag'").count()
    shown = R.dashboard(inv, stored, log, done.model).first()
    assert shown.threshold == done.model.flag_threshold and shown.known == 60 and shown.n_invoices == 660 and shown.recall >= 0.9
    assert R.dashboard(inv.limit(0), stored.limit(0), log.limit(0)).first().asDict() | {"threshold": 0} == {
        "flagged": 0, "value_at_risk": 0, "tp": None, "decided": 0, "decided_duplicate": 0, "n_invoices": 0, "known": None, "label_flag": 0, "label_review": 0, "label_pass": 0,
        "verdict_duplicate": 0, "verdict_not_duplicate": 0, "threshold": 0, "fp": None, "precision": None, "recall": None, "estimated_precision": None,
    }
    assert L.reset(store, pairs) and active_model(store) is None and not L.reset(store, pairs)
