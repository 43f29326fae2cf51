import random

import pytest

from tallyline.llm.components import connected_components, flagged_pairs


def brute(pairs):
    head = {}

    def find(x):
        head.setdefault(x, x)
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            head[max(a, b)] = min(a, b)
    return {x: find(x) for x in head}


def graphs():
    rng = random.Random(5)
    path = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(150)]
    rng.shuffle(path)
    ring = [(f"r{i:02d}", f"r{(i + 1) % 37:02d}") for i in range(37)]
    star = [("hub", f"s{i:03d}") for i in range(120)]
    comb = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(30)] + [(f"c{i:02d}", f"t{i:02d}") for i in range(30)]
    strip = [(f"q{i:02d}", f"q{i + j:02d}") for i in range(40) for j in (1, 2)]
    dense = [(f"d{i}", f"d{j}") for i in range(12) for j in range(i)]
    noise = [(f"n{rng.randrange(200):03d}", f"n{rng.randrange(200):03d}") for _ in range(170)]
    tied = [("z9", "r05"), ("z9", "q07"), ("x1", "x1"), (None, "x2"), ("x3", None), ("y1", "y2"), ("y2", "y1"), ("y1", "y2")]
    return {"mixed": path + ring + star + comb + noise + tied + strip, "core": dense + strip, "ring": ring, "none": [], "selves": [("x1", "x1"), (None, "a")]}


@pytest.mark.parametrize("name", list(graphs()))
def test_against_union_find(spark, name):
    pairs = graphs()[name]
    df = spark.createDataFrame(pairs, "id_a string, id_b string").withColumnRenamed("group_id", "x")
    for core in (0, 40) if name == "mixed" else (0,):  # all rounds to the end, and some
        found = connected_components(df, core_edges=core).collect()
        assert {r["id"]: r["group_id"] for r in found} == brute(pairs) and len(found) == len(brute(pairs))


def test_labels_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", "b", " FLAG "), ("b", "c", "review"), ("c", "d", None), ("d", "c", "Flag")], "id_a string, id_b string, label string").selectExpr("*", "1 as u", "2 as id", "'x' as group_id")
    got = {r["id"]: r["group_id"] for r in connected_components(flagged_pairs(df)).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c"}
