import random
from itertools import combinations

import pytest

from tallyline.llm import names as N
from tallyline.llm import variants as V


def edits(a, b):
    """Edit distance with swaps of neighbours."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_and_shards_against_brute_force():
    rng = random.Random(1)
    keys = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(400)} | {"engineering", "enginering", "enigneering"})
    trie = V.build_trie(keys)
    for k in keys:
        assert sorted(V.neighbours(trie, k)) == [o for o in keys if edits(k, o) <= 1]
    for a, b in combinations(keys, 2):
        if edits(a, b) == 1 and min(len(a), len(b)) >= V.FUZZY_FROM:
            assert set(V.shards(a)) & set(V.shards(b)), (a, b)
        assert N.near(a, b) == (edits(a, b) <= 1)


def test_trie_join(spark):
    rng = random.Random(2)
    keys = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(3, 9))) for _ in range(250)})
    kinds = [f"{kind}:{k}" for kind in "pw" for k in keys]
    for bound in (V.SHARD_KEYS, 3):  # whole shards, and all of them split again
        got = {(r.key, r.near) for r in V.trie_join(spark.createDataFrame([(k,) for k in kinds], "key string"), bound).collect()}
        assert got == {(f"{kind}:{a}", f"{kind}:{b}") for kind in "pw" for a in keys for b in keys if edits(a, b) <= 1}


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Fehudos Mobus Laboratories SARL", "FEHUDOS MOBUS LABS, S.à r.l.", True), ("Fehudos Mobus Laboratories SARL", "Fehudos M. Laboratories", True),
        ("Fehudos Mobus Laboratories SARL", "Mobus, Fehudos (Laboratories)", True), ("Fehudos Mobus Laboratories SARL", "FehudosMobus Laboratories SARL", True),
        ("Fehudos Mobus Laboratories SARL", "Fehudos Laboratories SARL", True), ("Jodesil Gitolt Chemicals GmbH", "J.G.C. GmbH", True),
        ("Jodesil Gitolt Chemicals GmbH", "Jodesil Gitolt Chemicals Gesellschaft mbH", True), ("Susanna Dehigin-Nahi Consulting", "Sanna Dehigin-Nahi Cons.", True),
        ("Teheral Solelt Elektrotechnik Pte Ltd", "Teeheral Solelt E-Technik Pte Limited", True), ("Baginix Sugim Instruments S.p.A.", "Baginix Sugim Percetakan B.V.", False),
        ("Friedrich Dojipe-Dirirt Consulting", "Elizabeth Dojipe-Dirirt Consulting", False), ("Acme Trading GmbH", "Acme Trading Ltd", False), ("c/o Dr. Anna Berg", "Anna Berg", True),
        ("Arvid Bumato Core Dojip Elsin Fehud Gitolt Hanix Engineering GmbH", "Arvid Bumato Core Dojip Elsin Fehud Gitolt Hanix Engng GmbH", True),
        ("Arvid Bumato Core Dojip Elsin Fehud Gitolt Hanix Engineering GmbH", "Arvid Kope Irido Jodesil Elsin Fehud Gitolt Hanix Engineering GmbH", False),
    ],
)
def test_names(a, b, same):
    assert (N.name_cost(N.parse(a), N.parse(b)) is not None) is same
    assert (N.name_cost(N.parse(b), N.parse(a)) is not None) is same


def test_pairs(spark):
    counts = {
        "Fehudos Mobus Laboratories SARL": 300, "fehudos mobus laboratories sarl": 2, "Fehudos Mobus Labs SARL": 3, "Feudos Mobus Laboratories SARL": 1, "FML SARL": 2,
        "Bumato Kope Elektrotechnik LLC": 9, "Bumato Kope Waste Management Pte Ltd": 9, "Bumato Kope Waste Mgmt Pte Ltd": 1, "N/A": 50, "": 4, "Ω" * 3000: 1, "12": 1,
    }
    rows = [(n, "x", "y") for n, k in counts.items() for _ in range(k)] + [(None, "x", "y")] * 5
    df = spark.createDataFrame(rows, "vendor_name string, key string, form string")
    got = {(r.name_a, r.name_b) for r in V.variant_pairs(df).collect()}
    f = sorted([n for n in counts if "ehudos" in n or "Feudos" in n or n == "FML SARL"])
    assert got == set(combinations(f, 2)) | {("Bumato Kope Waste Management Pte Ltd", "Bumato Kope Waste Mgmt Pte Ltd")}
    classes = {r.vendor_name: r.n_rows for r in V.vendor_classes(df).collect()}
    assert classes == {n: k for n, k in counts.items() if n not in ("N/A", "")}
    assert V.variant_pairs(df.limit(0)).isEmpty()


def test_long_acronyms(spark):
    counts = {"Arvid Bumato Core Dojip Elsin GmbH": 5, "A.B.C.D.E. GmbH": 1, "ABCDE GmbH": 1, "Fehudos Gitolt Hanix Irido Jodesil Kope SARL": 4, "FGHIJK SARL": 1, "FGHIJ SARL": 1}
    df = spark.createDataFrame([(n,) for n, k in counts.items() for _ in range(k)], "vendor_name string")
    long, short = list(counts)[:3], list(counts)[3:5]
    assert {"A.B.C.D.E. GmbH", "ABCDE GmbH"} < set(long)
    got = {(r.name_a, r.name_b) for r in V.variant_pairs(df).collect()}
    assert set(combinations(sorted(long), 2)) <= got and tuple(sorted(short)) in got
