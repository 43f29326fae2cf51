from datetime import date, datetime

from tallyline.llm.survivors import best_copies, duplicate_groups, voted_records

SCHEMA = (
    "id string, source_type string, extraction_confidence double, vendor_name string, invoice_no string, amount bigint, currency string, "
    "invoice_date date, tax_id string, created_at timestamp, duplicate_of string, field_name string, kind string"
)
T = [datetime(2024, 1, d) for d in range(1, 10)]


def rows(spark):
    day = date(2024, 1, 1)
    return spark.createDataFrame(
        [
            ("a", "pdf", 0.5, "Acme", "N/A", 0, "EUR", None, "--", T[0], None, "x", "y"),
            ("b", " EDI ", float("nan"), "ACME", "7", 5, None, day, "un-known", T[1], "a", "x", "y"),
            ("c", "fax", 0.9, "Acme Ltd", "8", None, "usd", None, "12", T[2], "b", "x", "y"),
            ("d", None, 7.0, None, "9", 6, "?", None, None, None, "c", "x", "y"),
            ("e", "pdf", 0.5, "Solo", "1", 1, "EUR", day, "1", T[0], "", "x", "y"),
            ("f", "pdf", 0.5, "Self", "1", 1, "EUR", day, "1", T[0], "f", "x", "y"),
            ("g", "pdf", 0.5, "Lost", "1", 1, "EUR", day, "1", T[0], "gone", "x", "y"),
            ("h", "pdf", 0.5, "One", "1", 1, "EUR", day, "1", T[0], "away", "x", "y"),
            ("i", "pdf", 0.5, "Two", "1", 1, "EUR", day, "1", T[0], "away", "x", "y"),
        ],
        SCHEMA,
    )


def trust(spark):
    return spark.createDataFrame([("EDI", 1), ("pdf ", 2)], "source_type string, trust_rank int")


def test_groups(spark):
    assert {(r.group_id, r.id) for r in duplicate_groups(rows(spark)).collect()} == {("a", x) for x in "abcd"} | {("h", "h"), ("h", "i")}


def test_best_copies(spark):
    got = {(r.group_id, r.field_name): r.id for r in best_copies(rows(spark), trust(spark)).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "a"} == {"vendor_name": "b", "invoice_no": "b", "amount": "b", "currency": "a", "invoice_date": "b", "tax_id": "c"}
    # trust, confidence and age are equal: the smaller id
    assert {v for k, v in got.items() if k[0] == "h"} == {"h"} and len(got) == 12


def test_voted_records(spark):
    got = {r.group_id: r for r in voted_records(rows(spark), trust(spark)).collect()}
    # 'Acme' and 'ACME' vote together and the heavier vote gives the spelling
    assert (got["a"].vendor_name, got["a"].amount, got["a"].tax_id) == ("ACME", 5, "12") and set(got) == {"a", "h"}


def test_signs_ties_and_repeated_rows(spark):
    day = date(2024, 1, 1)
    base = [("a", "pdf", 0.5, "B", "1", -500, "EUR", day, "1", T[0], None), ("b", "pdf", 0.5, "A", "1", 500, "EUR", day, "1", T[0], "a"), ("c", "EDI", 0.5, None, "1", 700, "EUR", day, "1", T[0], "a")]
    df = spark.createDataFrame([(*r, "x", "y") for r in base + base[:1]], SCHEMA)
    r = voted_records(df.dropDuplicates(["id"]), trust(spark)).first()
    assert (r.amount, r.vendor_name) == (700, "A")  # neither sign lends the other its vote; of equal votes the smaller value wins
    got = {r.field_name: r.id for r in best_copies(df, trust(spark)).collect()}
    assert (got["amount"], got["vendor_name"]) == ("c", "a")
    assert duplicate_groups(df).count() == 3


def test_empty(spark):
    assert best_copies(rows(spark).limit(0), trust(spark)).isEmpty() and voted_records(rows(spark).limit(0), trust(spark).limit(0)).isEmpty()
