from datetime import date, datetime, timedelta

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyline.functions.similarity import common_subsequence, jaro_winkler, jaro_winkler_pairs, token_similarity
from tallyline.operators import matching as M
from tallyline.sources import synthetic

SCHEMA = "id string, vendor_name string, invoice_no string, amount bigint, currency string, invoice_date date, tax_id string, duplicate_of string, variant string, created_at timestamp"
BASE = ("Northwind Logistics", "INV-2024/0001", 5000, "USD", date(2024, 3, 10), "12-3456789-401", None, None)
T0 = datetime(2024, 1, 1)


def invoice(id, **change):
    names = ("vendor_name", "invoice_no", "amount", "currency", "invoice_date", "tax_id", "duplicate_of", "variant")
    row = dict(zip(names, BASE)) | change
    return (id, *(row[n] for n in names), T0)


def score(spark, **change):
    rows = M.normalized(spark.createDataFrame([invoice("A"), invoice("B", **change)], SCHEMA))
    return M.scored(rows, spark.createDataFrame([("A", "B")], "id_a string, id_b string")).first()


@pytest.mark.parametrize(
    "change, check",
    [
        ({}, lambda r: r.score == 1.0 and r.breakdown.tax_id == "match" and r.label == "flag"),
        ({"invoice_no": "INV-2024/OOO1"}, lambda r: r.score > 0.8),
        ({"invoice_no": "INV-2024/0002", "invoice_date": date(2024, 4, 8)}, lambda r: r.breakdown.invoice_no < 0.7 and r.score < 0.9),
        ({"tax_id": "99-0000000-000"}, lambda r: r.score <= 0.55 and r.breakdown.tax_id == "mismatch" and r.label == "pass"),
        ({"invoice_no": "SJ-2024-7777", "invoice_date": date(2024, 3, 18)}, lambda r: r.score >= 0.92 and r.breakdown.rule == "reinvoice_pattern"),
        ({"invoice_no": "SJ-2024-7777", "invoice_date": date(2024, 8, 10)}, lambda r: r.score < 0.9 and r.breakdown.rule is None),
        ({"invoice_no": "SJ-2024-7777"}, lambda r: r.breakdown.rule is None),
        ({"vendor_name": "Acme", "invoice_no": "Q-9", "amount": 17}, lambda r: r.score < 0.7),
        ({"amount": -5000}, lambda r: r.breakdown.amount == 1.0),
        ({"vendor_name": None, "invoice_no": None, "amount": None, "invoice_date": None, "tax_id": None}, lambda r: r.score == 0.0 and r.breakdown.tax_id == "n/a"),
    ],
)
def test_scores(spark, change, check):
    assert check(score(spark, **change))


def test_lookalikes_are_equal(spark):
    r = M.normalized(spark.createDataFrame([invoice("A", invoice_no="INV-O78I"), invoice("B", invoice_no="INV-0781")], SCHEMA)).select("invoice_no").distinct()
    assert r.count() == 1


def test_weights_must_add_up():
    with pytest.raises(ValueError):
        M.FieldWeights(date=0.2)


def test_blocking(spark):
    rows = [invoice("A"), invoice("B", invoice_no="inv 2024 0001", amount=7), invoice("C", vendor_name="Other", invoice_no="X", amount=9)]
    df = M.normalized(spark.createDataFrame(rows, SCHEMA))
    assert [tuple(r) for r in M.candidate_pairs(df).collect()] == [("A", "B")]
    s = M.blocking_stats(df).first()
    assert (s.n_invoices, s.naive_candidates, s.n_candidates, s.n_skipped_blocks) == (3, 3, 1, 0)


@pytest.mark.parametrize("n, pairs", [(30, 435), (31, 0)])
def test_large_blocks_are_left_out(spark, n, pairs):
    rows = [invoice(f"I{i:04d}", vendor_name=f"V{i}", invoice_no=f"N{i}") for i in range(n)]
    df = M.normalized(spark.createDataFrame(rows, SCHEMA))
    assert M.candidate_pairs(df, max_block=30).count() == pairs
    assert M.blocking_stats(df, max_block=30).first().n_skipped_blocks == (pairs == 0)


def test_no_invoices(spark):
    found = M.detect(spark.createDataFrame([], SCHEMA))
    assert found.pairs.isEmpty() and found.stats.first().scored_pairs == 0


def test_orientation_follows_load_order(spark):
    rows = [invoice("B"), invoice("A")]
    late = [r[:-1] + (T0 + timedelta(days=i),) for i, r in enumerate(rows)]
    assert tuple(M.candidate_pairs(M.normalized(spark.createDataFrame(late, SCHEMA))).first()) == ("B", "A")


def test_generated_corpus(spark):
    from tallyline.operators import evaluation as E

    inv = synthetic.generate(spark, 400, 0.06, 11).cache()
    again = synthetic.generate(spark, 400, 0.06, 11)
    assert inv.exceptAll(again).isEmpty() and inv.count() == 424
    assert inv.select("id").distinct().count() == 424
    meta = synthetic.meta(inv).first()
    assert meta.n_invoices == 400 and meta.n_duplicates == 24
    assert inv.where("duplicate_of is null").groupBy("vendor_name", F.date_format("invoice_date", "yyyy-MM"), "amount").count().where("count > 1").isEmpty()
    pairs = inv.where("duplicate_of is not null").alias("c").join(inv.alias("o"), F.col("c.duplicate_of") == F.col("o.id"))
    for r in pairs.select("c.variant", *(F.array(f"o.{c}", f"c.{c}").alias(c) for c in ("vendor_name", "invoice_no", "invoice_date", "amount"))).collect():
        kept = {"vendor_variant": ("invoice_no", "invoice_date"), "reinvoice": ("vendor_name",), "date_shift": ("vendor_name", "invoice_no")}.get(r.variant, ("vendor_name", "invoice_date"))
        assert all(r[c][0] == r[c][1] for c in (*kept, "amount"))
        gap = abs((r.invoice_date[1] - r.invoice_date[0]).days)
        assert gap in {"reinvoice": range(1, 15), "date_shift": range(1, 26)}.get(r.variant, (0,))
    found = M.detect(inv)
    report = E.evaluate(inv, found.pairs).first()
    assert report.recall == 1.0 and report.precision >= 0.95
    assert found.stats.first().n_candidates < 400 * 399 / 2 / 100


def test_generator_of_any_size(spark):
    for n in (0, 5, 40):
        assert synthetic.generate(spark, n, 0.1, 3).where("duplicate_of is null").count() == n


def test_jaro_winkler_against_another_engine():
    import random

    rng = random.Random(3)
    pairs = [("".join(rng.choice("AB12") for _ in range(rng.randint(1, 9))), "".join(rng.choice("AB12") for _ in range(rng.randint(1, 9)))) for _ in range(3000)]
    con = duckdb.connect()
    for a, b in pairs:
        assert jaro_winkler_pairs([a], [b])[0] == jaro_winkler(a, b)
        assert abs(jaro_winkler(a, b) - con.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]) < 1e-9


def test_jaro_winkler_of_many_pairs_at_once():
    import random

    rng = random.Random(5)
    a, b = (["".join(rng.choice("AB12Ж") for _ in range(rng.choice([1, 2, 5, 9, 14, 48, 49, 300]))) for _ in range(1500)] for _ in range(2))
    assert jaro_winkler_pairs(a, b).tolist() == [jaro_winkler(x, y) for x, y in zip(a, b)] and len(jaro_winkler_pairs([], [])) == 0


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert common_subsequence(a, b) == table[-1][-1]


@pytest.mark.parametrize(
    "a, b, expected",
    [("ACME TRADING", "TRADING ACME", 1.0), ("ACME", "ACME TRADING", 1.0), ("ABC", "ABD", 2 / 3), ("NORTHWIND LOGISTICS", "NORTHWIND LOGISTIC", 36 / 37)],
)
def test_token_similarity(a, b, expected):
    assert token_similarity(a, b) == pytest.approx(expected)
