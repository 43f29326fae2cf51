"""Mixing sources to target weights by a low-discrepancy schedule.

The points of the van der Corput sequence (the bits of the slot's number mirrored at the point) fall evenly into any
interval, in every stretch of slots. The n points of n slots are ranked, and the ranks divided among the sources by their
weights in blocks: every source gets exactly the slots it needs, none is made in vain, and every stretch of the mixture
has nearly the target shares. Rank and slot follow from each other by counting, without a sort (``slot_of_rank``).

The k-th slot of a source takes its k-th block: the source's documents, shuffled by hash and repeated at most
``max_repeats`` times, are one stream of tokens, cut into blocks of equal size wherever the cut falls. A document may so
be in two blocks or more; each piece says where among the document's tokens it begins.

Ranks and running sums within a source are taken in two steps (sums of hash ranges first, then within each range), so no
task holds a source: a source with most rows has as many ranges as its size needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.tokenize import TOKENIZERS, VOCABULARY, count_tokens
from tallyline.plans.lineage import Scratch

#: Rows in one range of a running sum.
RANGE_ROWS = 50_000
#: The targets are configuration: at most so many sources.
MAX_SOURCES = 10_000


def running(df: DataFrame, group: str, position: Column, order: list[str], size: Column, n_ranges: int, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``size`` over the rows of ``group`` before this one, by (``position`` in 0..1, order).

    Two levels: rows fall into ``n_ranges`` ranges of their position; the ranges' sums are accumulated over one row a
    range, the rows' within their range.
    """
    ranged = df.withColumn("_range", F.least(F.lit(n_ranges - 1), F.floor(position * n_ranges)).cast("int")).withColumn("_size", size)
    sums = ranged.groupBy(group, "_range").agg(F.sum("_size").alias("_sum"))
    ahead = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(group, "_range", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start"))
    within = Window.partitionBy(group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_before", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    return summed.join(starts, [group, "_range"]).withColumn(name, F.col("_start") + F.col("_before")).drop("_range", "_size", "_start", "_before")


def slot_of_rank(rank: Column, n: int) -> Column:
    """Which of the slots 0..n-1 has the ``rank``-th smallest point of the van der Corput sequence.

    From the lowest bit up: among the slots that agree so far, those with a 0 in the next bit have the smaller points.
    There are (left + 1) // 2 of ``left`` such slots.
    """
    bits = max(1, (n - 1).bit_length())
    begin = F.struct(rank.cast("bigint").alias("r"), F.lit(n).cast("bigint").alias("left"), F.lit(0).cast("bigint").alias("slot"))

    def step(state: Column, bit: Column) -> Column:
        zeros = F.shiftright(state["left"] + 1, 1)
        one = state["r"] >= zeros
        return F.struct(
            F.when(one, state["r"] - zeros).otherwise(state["r"]).alias("r"), F.when(one, state["left"] - zeros).otherwise(zeros).alias("left"),
            F.when(one, state["slot"] + bit).otherwise(state["slot"]).alias("slot"),
        )

    return F.aggregate(F.array(*(F.lit(1 << b).cast("bigint") for b in range(bits))), begin, step, lambda state: state["slot"])


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = targets.where("source is not null and target_share > 0 and max_repeats > 0").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources to mix")
    return {r["source"]: (r["target_share"], r["max_repeats"]) for r in rows}


class Mixture:
    """A mixture of ``documents`` (doc_id, source, text) by ``targets`` (source, target_share, max_repeats).

    ``total_tokens``: size to build; by default as many tokens as the documents of all target sources have. A source
    gives its share of that, or all of its documents ``max_repeats`` times if that is less; the others do not fill in.

    Sources that are null or no target give nothing; a target without tokens gives nothing. Documents without tokens are
    left out. Documents of one source with equal text and id are kept apart by nothing and used alike.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, block_tokens: int = 4096, total_tokens: int | None = None, seed: int = 0, folder: str = TOKENIZERS, name: str = VOCABULARY):
        self.scratch, self.block, self.seed = Scratch(documents.sparkSession, "mixing"), block_tokens, seed
        self.wanted = _targets(targets)
        sources = self.scratch.spark.createDataFrame([(s,) for s in self.wanted], "source string")
        known = documents.select("doc_id", "source", "text").join(F.broadcast(sources), "source", "left_semi")  # MAX_SOURCES rows at most
        counted = count_tokens(known, ["doc_id", "source"], "text", folder, name)
        self.sizes = self.scratch.keep(counted.where("n_tokens > 0"))
        self.held = {r[0]: (r[1], r[2]) for r in self.sizes.groupBy("source").agg(F.sum("n_tokens"), F.count(F.lit(1))).collect()}
        self.total = total = total_tokens if total_tokens is not None else sum(t for t, _ in self.held.values())
        whole = sum(s for s, _ in self.wanted.values())
        #: Tokens to take from each source.
        self.quota = {s: min(int(share / whole * total), repeats * self.held[s][0]) for s, (share, repeats) in self.wanted.items() if s in self.held}

    def _plan(self) -> DataFrame:
        """(source, held, quota, blocks, first): for each source with a quota its tokens, slots and first rank. One row a
        source, at most MAX_SOURCES."""
        rows, first = [], 0
        for s, q in self.quota.items():
            if q > 0:
                rows.append((s, self.held[s][0], q, -(-q // self.block), first))
                first += rows[-1][3]
        return F.broadcast(self.scratch.spark.createDataFrame(rows, "source string, held bigint, quota bigint, blocks bigint, first bigint"))

    def _pieces(self, plan: DataFrame) -> DataFrame:
        """(source, nth, doc_id, use, from_token, n_tokens): what each block holds."""
        n_ranges = max(1, -(-max((n for _, n in self.held.values()), default=0) // RANGE_ROWS))
        shuffled = self.sizes.withColumn("h", F.xxhash64(F.lit(self.seed), "doc_id"))
        position = (F.shiftrightunsigned("h", 11)).cast("double") / 2.0**53
        placed = running(shuffled, "source", position, ["h", "doc_id"], F.col("n_tokens"), n_ranges, "begin").drop("h").join(plan, "source")
        used = placed.withColumn("use", F.explode(F.sequence(F.lit(1), F.ceil(F.col("quota") / F.col("held")).cast("int"))))
        used = used.withColumn("begin", (F.col("use") - 1) * F.col("held") + F.col("begin"))
        used = used.withColumn("end", F.least(F.col("begin") + F.col("n_tokens"), F.col("quota"))).where("begin < end")
        whole = lambda c: F.floor(c / self.block)
        cut = used.select("source", "doc_id", "use", "begin", "end", F.explode(F.sequence(whole(F.col("begin")), whole(F.col("end") - 1))).alias("nth"))
        a, z = F.greatest(F.col("begin"), F.col("nth") * self.block), F.least(F.col("end"), (F.col("nth") + 1) * self.block)
        return cut.select("source", "nth", "doc_id", "use", (a - F.col("begin")).alias("from_token"), (z - a).alias("n_tokens"))

    def _slots(self, plan: DataFrame) -> DataFrame:
        """(slot, source, nth): the schedule, with each source's slots numbered from 0 in their order."""
        n = sum(-(-q // self.block) for q in self.quota.values())
        runs = plan.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / RANGE_ROWS))))
        ranks = runs.repartition("source", "run").select("source", F.explode(F.sequence(F.col("first") + F.col("run") * RANGE_ROWS, F.col("first") + F.least(F.col("blocks"), (F.col("run") + 1) * RANGE_ROWS) - 1)).alias("rank"))
        slots = ranks.select("source", slot_of_rank(F.col("rank"), max(1, n)).alias("slot"))
        ranked = running(slots, "source", F.col("slot") / float(max(1, n)), ["slot"], F.lit(1), max(1, n // RANGE_ROWS), "nth")
        return ranked.select("slot", "source", "nth")

    def documents(self) -> DataFrame:
        """(slot, source, doc_id, use, from_token, n_tokens): the mixture in order of ``slot``.

        ``use`` numbers a document's uses from 1; a piece holds ``n_tokens`` tokens of the document from ``from_token`` on.
        """
        if not any(self.quota.values()):
            none = {"slot": "bigint", "source": "string", "doc_id": None, "use": "int", "from_token": "bigint", "n_tokens": "bigint"}
            return self.sizes.where("false").select(*(F.col(c) if t is None else F.lit(None).cast(t).alias(c) for c, t in none.items()))
        plan = self._plan()
        return self._pieces(plan).join(self._slots(plan), ["source", "nth"]).select("slot", "source", "doc_id", "use", "from_token", "n_tokens")

    def shares(self, mixed: DataFrame | None = None) -> DataFrame:
        """(source, target_share, available_tokens, used_tokens, documents, most_uses, ...) of every target.

        ``share_of_total``: of the size asked for, equal to the target unless ``max_repeats`` forbids; ``actual_share``: of
        the tokens that the mixture has, in which a source that could not fill its share leaves more to the others.
        """
        mixed = self.documents() if mixed is None else mixed
        by_doc = mixed.groupBy("source", "doc_id").agg(F.max("use").alias("uses"), F.sum("n_tokens").alias("t"))
        got = by_doc.groupBy("source").agg(F.sum("t").alias("used_tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"))
        rows = [(s, share, int(self.held.get(s, (0, 0))[0])) for s, (share, _) in self.wanted.items()]
        named = self.scratch.spark.createDataFrame(rows, "source string, target_share double, available_tokens bigint")
        filled = named.join(got, "source", "left").na.fill(0, ["used_tokens", "documents", "most_uses"])
        total = max(1, self.total)
        everything = Window.partitionBy()  # over one row for each target
        filled = filled.withColumn("share_of_total", F.col("used_tokens") / F.lit(float(total)))
        return filled.withColumn("actual_share", F.coalesce(F.try_divide(F.col("used_tokens"), F.sum("used_tokens").over(everything)), F.lit(0.0)))
