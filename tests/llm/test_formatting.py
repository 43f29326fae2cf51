import random
from collections import defaultdict
from datetime import date
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallyline.llm import formatting as M

SCHEMA = "id string, vendor_name string, invoice_no string, amount bigint, currency string, invoice_date date, tax_id string, form string, bucket string"


def df(spark, numbers, **change):
    base = {"vendor_name": "V", "amount": 1, "currency": None, "invoice_date": date(2024, 1, 1), "tax_id": ""} | change
    return spark.createDataFrame([(f"i{k:05d}", base["vendor_name"], n, base["amount"], base["currency"], base["invoice_date"], base["tax_id"], "x", "y") for k, n in enumerate(numbers)], SCHEMA)


def groups(found):
    out = defaultdict(set)
    for r in found.collect():
        out[r.group_id].add(r.id)
    return dict(out)


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("fac2025005016", "fac 2025 005 016", True), ("00065 re 01 2025", "01 2025 00065 re", True), ("001956bil042023", "001 956 2023 04 bil", True),
        ("re 00271", "re 00217", False), ("2022 006834", "2022 006843", False), ("fac2025005016", "2025 005016 fac", True), ("a", "a", True), ("ab", "ba", False), ("2024re 001", "001re 2024", True),
        ("a b c d e f g 1", "1 g f e d c b a", True), ("12 3", "1 23", True), ("12 3", "31 2", True), ("12 3", "13 2", False),
    ],
)
def test_same_number(a, b, same):
    assert M.same_number(a, b) is same and M.same_number(b, a) is same


def test_against_brute_force(spark):
    rng = random.Random(2)
    numbers = []
    for _ in range(40):
        parts = [f"{rng.randrange(300):05d}", rng.choice(["RE", "fac"]), f"{rng.randint(1, 3):02d}", "2024"]
        for _ in range(rng.randint(1, 6)):
            p = parts[:]
            rng.shuffle(p)
            text = rng.choice("-/. \t").join(p) if rng.random() < 0.8 else "".join(p)
            numbers.append(rng.choice([text, text.upper(), text.lower(), f" {text}."]))
    numbers += [None, "", " - ", "N/A", "None", "unknown"]
    found = groups(M.copies_of_records(df(spark, numbers), budget=20))
    forms = {f"i{k:05d}": " ".join("".join(c if c.isalnum() else " " for c in n.lower()).split()) for k, n in enumerate(numbers) if n and n[:3] not in ("N/A", "Non", "unk") and any(map(str.isalnum, n))}
    head = {i: i for i in forms}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i, j in combinations(sorted(forms), 2):
        if sorted(forms[i].replace(" ", "")) == sorted(forms[j].replace(" ", "")) and M.same_number(forms[i], forms[j]):
            a, b = find(i), find(j)
            head[max(a, b)] = min(a, b)
    want = defaultdict(set)
    for i in forms:
        want[find(i)].add(i)
    assert found == {k: v for k, v in want.items() if len(v) > 1}
    counted = {r.group_id: r.copies for r in M.collapsed(df(spark, numbers), budget=20).collect()}
    assert counted == {k: len(v) for k, v in want.items()}


def test_classes_are_those_of_all_pairs():
    rng = random.Random(9)
    for parts in (["re", "12", "2024"], ["a", "b", "1", "22", "3", "c", "4", "55"], ["12", "21", "1"]):
        forms = []
        for _ in range(40):
            p = parts[:]
            rng.shuffle(p)
            forms.append("".join(x + rng.choice(["", " "]) for x in p).strip())
        forms = list(dict.fromkeys(forms))
        head = list(range(len(forms)))
        for _ in forms:  # to the fixed point
            for i, j in combinations(range(len(forms)), 2):
                if M.same_number(forms[i], forms[j]):
                    head[i] = head[j] = min(head[i], head[j])
        assert M._classes(forms) == head


def test_exact_fields_matter(spark):
    both = df(spark, ["A-1"]).unionByName(df(spark, ["a 1"], amount=2).withColumn("id", F.lit("z"))).unionByName(df(spark, ["a1"], currency="").withColumn("id", F.lit("y")))
    assert groups(M.copies_of_records(both)) == {}
    null = df(spark, ["A-1", "a/1"], vendor_name=None, amount=None, invoice_date=None, tax_id=None)
    assert groups(M.copies_of_records(null)) == {"i00000": {"i00000", "i00001"}}


def test_one_form_holds_most_rows_and_empty(spark):
    many = df(spark, ["INV-1"] * 500 + ["1 inv", "Z" * 5000, "z" * 5000])
    assert sorted(map(len, groups(M.copies_of_records(many, budget=2)).values())) == [2, 501]
    assert M.collapsed(many.limit(0)).isEmpty() and M.copies_of_records(many.limit(0)).isEmpty()
