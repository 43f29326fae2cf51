import os

import pytest
from pyspark.sql import functions as F

from tallyline.llm import mixing as M
from tallyline.llm import tokenize as K

pytestmark = pytest.mark.skipif(not os.path.isfile(f"{K.TOKENIZERS}/{K.VOCABULARY}"), reason="needs the vocabulary files")


def docs(spark):
    rows = [(i, "big", "word " * 50) for i in range(300)] + [(1000 + i, "small", "word " * 40) for i in range(20)] + [(2000 + i, "mid", "word " * 10 * (i % 9)) for i in range(90)]
    rows += [(3000, None, "lost"), (3001, "unknown", "lost"), (3002, "big", None), (3003, "big", "")]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, source string, text string, begin string, h int")


def targets(spark, *rows):
    return spark.createDataFrame(list(rows) or [("big", 0.5, 2), ("small", 0.2, 3), ("mid", 0.3, 2), ("none", 0.1, 1)], "source string, target_share double, max_repeats int")


def test_shares_and_repeats(spark):
    m = M.Mixture(docs(spark), targets(spark), block_tokens=200, total_tokens=8000)
    mixed = m.documents().cache()
    per = {r.source: r for r in m.shares(mixed).collect()}
    uses = mixed.groupBy("source", "doc_id").agg(F.count_distinct("use").alias("n"), F.max("use").alias("u")).groupBy("source").agg(F.max("n").alias("n"), F.max("u").alias("u")).collect()
    assert {r.source: r.n for r in uses} == {r.source: r.u for r in uses}
    assert all(r.n <= {"big": 2, "small": 3, "mid": 2}[r.source] for r in uses)
    assert per["none"].used_tokens == 0 and per["none"].actual_share == 0.0
    for s, share in (("big", 0.5 / 1.1), ("small", 0.2 / 1.1), ("mid", 0.3 / 1.1)):
        assert per[s].used_tokens == m.quota[s] and abs(per[s].share_of_total - share) < 0.001
    assert mixed.select("source", "doc_id", "use", "from_token").distinct().count() == mixed.count()
    # blocks are equal but for the last of each source, and there is one for every slot
    blocks = mixed.groupBy("slot", "source").agg(F.sum("n_tokens").alias("t")).collect()
    assert sorted(b.slot for b in blocks) == list(range(len(blocks))) and sum(b.t != 200 for b in blocks) <= 3
    # the pieces of one use of a document are the document, but where the quota ends
    whole = mixed.groupBy("source", "doc_id", "use").agg(F.sum("n_tokens").alias("t"), F.max(F.col("from_token") + F.col("n_tokens")).alias("end")).join(m.sizes, ["source", "doc_id"])
    assert whole.where("t <> end").isEmpty() and whole.where("t <> n_tokens").count() <= 3
    # every stretch has the shares: of the first half of the slots, each source holds about half of its tokens
    half = mixed.agg(F.max("slot")).first()[0] / 2
    first = {r.source: r.t for r in mixed.where(F.col("slot") < half).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    assert all(abs(first[s] / per[s].used_tokens - 0.5) < 0.12 for s in ("big", "mid"))


def test_caps(spark):
    m = M.Mixture(docs(spark), targets(spark, ("big", 0.5, 1), ("small", 0.5, 2)), block_tokens=64, total_tokens=100_000)
    per = {r.source: r for r in m.shares().collect()}
    assert (per["big"].used_tokens, per["small"].used_tokens) == (per["big"].available_tokens, 2 * per["small"].available_tokens)
    assert per["small"].most_uses == 2 and per["big"].documents == 300


def test_same_again_and_empty(spark):
    a, b = (M.Mixture(docs(spark), targets(spark), block_tokens=200).documents() for _ in range(2))
    assert a.exceptAll(b).isEmpty()
    nothing = M.Mixture(docs(spark).limit(0), targets(spark))
    assert nothing.documents().isEmpty() and nothing.shares().count() == 4
    assert M.Mixture(docs(spark), targets(spark).limit(0)).documents().isEmpty()


def test_slots_of_ranks(spark):
    def point(i):
        return int(format(i, "052b")[::-1], 2)

    for n in (1, 2, 3, 7, 64, 100):
        got = [r[0] for r in spark.range(n).select(M.slot_of_rank(F.col("id"), n)).collect()]
        assert got == sorted(range(n), key=point)
    n = 2**40 + 12345  # far beyond 32 bits: ranks of chosen slots by counting
    chosen = [0, 1, 2**32, 2**33 + 7, 2**40, n - 1]

    def rank(i):
        return sum((n - 1 - (i & ((1 << b) - 1))) // (2 << b) + 1 for b in range(41) if i >> b & 1 and (i & ((1 << b) - 1)) < n)

    ranks = spark.createDataFrame([(rank(i),) for i in chosen], "r bigint")
    assert sorted(r[0] for r in ranks.select(M.slot_of_rank(F.col("r"), n)).collect()) == sorted(chosen)


def test_a_long_document_fills_blocks(spark):
    df = spark.createDataFrame([(1, "big", "word " * 5000), (2, "big", "word " * 3), (3, "small", "word " * 90)], "doc_id bigint, source string, text string")
    mixed = M.Mixture(df, targets(spark, ("big", 0.9, 1), ("small", 0.1, 10)), block_tokens=100).documents().groupBy("source", "slot").agg(F.sum("n_tokens").alias("t")).collect()
    assert sum(r.t != 100 for r in mixed) <= 2 and sum(r.t for r in mixed if r.source == "big") > 4500


def test_running_sums(spark):
    df = spark.range(1000).selectExpr("id % 3 as g", "id as o", "id % 7 as n")
    got = {(r.g, r.o): r.b for r in M.running(df, "g", F.col("o") / 1000.0, ["o"], F.col("n"), 10, "b").collect()}
    total = {}
    for i in range(1000):
        assert got[i % 3, i] == total.get(i % 3, 0)
        total[i % 3] = total.get(i % 3, 0) + i % 7
