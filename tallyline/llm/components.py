"""Consolidating pairwise matches into groups: connected components by rake and compress.

Every round works on the whole edge table with joins and partial aggregates:

* degrees and smallest and largest neighbour of every vertex in one aggregate;
* *compress*: maximal chains of degree-two vertices shrink to one edge between their ends. The ends are found by list
  ranking (pointer doubling over the directed arcs of the chains, two doublings a job), so a chain of n vertices takes
  log2(n) joins;
* *rake*: vertices of degree one hang themselves under their neighbour and leave.

A tree halves its leaves each round, so rounds grow with the logarithm. They end when the reduced core fits into one task
(at most ``CORE_EDGES`` edges), where union by size solves it; at least one round is made. A larger core of which fewer
than a tenth of the vertices have a degree below three has nothing to strip: there every vertex hooks under its smallest
neighbour, pointer jumping turns the hooks into stars, and the edges contract to the stars' roots.

A removed vertex points to one that was left after its round. Labels are therefore restored round by round, the last one
first: one join for each round, all of them in one job. Hubs: degrees are partial aggregates, and in each join the side
with the hub's many rows meets exactly one row of a unique key, which adaptive execution splits freely.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.plans.lineage import Scratch

#: Share of vertices of degree one or two below which the core is solved instead.
PEEL_SHARE = 0.1
#: Edges that one task solves: some ten megabytes.
CORE_EDGES = 50_000


def _distinct_edges(df: DataFrame) -> DataFrame:
    return df.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where(F.col("u") < F.col("v")).distinct()


def _jump(scratch: Scratch, forest: DataFrame) -> DataFrame:
    """Pointers (child, parent) of a forest, each moved to its root; four steps up a job."""
    while True:
        twice = forest
        for _ in range(2):
            up = twice.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
            twice = twice.select("child", "parent").join(up, "parent", "left").select("child", F.coalesce("above", "parent").alias("parent"), F.col("above").alias("above"))
        moved, seen = scratch.measured(twice, moved=F.count("above"))
        scratch.release(forest)
        forest = moved.select("child", "parent")
        if not seen["moved"]:
            return forest


def _core_labels(edges: DataFrame) -> DataFrame:
    """(vertex, label): for each vertex of few edges one vertex of its component, by union in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: dict[str, str] = {}
        size: dict[str, int] = {}

        def find(x: str) -> str:
            while head.setdefault(x, x) != x:
                head[x] = x = head[head[x]]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                u, v = find(u), find(v)
                if u != v:
                    u, v = (u, v) if size.get(u, 1) >= size.get(v, 1) else (v, u)
                    head[v], size[u] = u, size.get(u, 1) + size.get(v, 1)
        names = list(head)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([find(x) for x in names], pa.string())], names=["vertex", "label"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "vertex string, label string")


def _rank_chains(scratch: Scratch, inner: DataFrame) -> DataFrame:
    """For each chain vertex (v, lo, hi): where either direction ends, or the smallest vertex if the chain is a ring.

    An arc (x -> v) enters v from x; its pointer (p -> t) is the arc reached so far, ``low`` the smallest vertex passed.
    """
    inside = inner.select(F.col("v").alias("t"), F.lit(True).alias("inside"))
    arcs = inner.select(F.col("lo").alias("x"), "v", F.col("hi").alias("t")).unionByName(
        inner.select(F.col("hi").alias("x"), "v", F.col("lo").alias("t"))
    )
    arcs = arcs.join(inside, "t", "left").select(
        "x", "v", F.col("v").alias("p"), "t", F.col("v").alias("low"), F.col("inside").isNull().alias("done"), F.lit(True).alias("news")
    )
    active = F.count_if(~F.col("done") & F.col("news"))
    arcs, seen = scratch.measured(arcs, active=active)
    while seen["active"]:
        moved = _doubled(_doubled(arcs))
        moved, seen = scratch.measured(moved, active=active)
        scratch.release(arcs)
        arcs = moved
    ends = arcs.groupBy("v").agg(F.min(F.when(F.col("done"), F.col("t"))).alias("end_a"), F.max(F.when(F.col("done"), F.col("t"))).alias("end_b"), F.min("low").alias("low"))
    return scratch.keep(ends)


def _doubled(arcs: DataFrame) -> DataFrame:
    """Every pointer that is not done moved on to where the arc it has reached points."""
    ahead = arcs.select(
        F.col("x").alias("p"), F.col("v").alias("t"), F.col("p").alias("p2"), F.col("t").alias("t2"), F.col("low").alias("low2"), F.col("done").alias("done2")
    )
    step = arcs.where("not done").join(ahead, ["p", "t"]).select(
        "x", "v", F.col("p2").alias("p"), F.col("t2").alias("t"), F.least("low", "low2").alias("low"), F.col("done2").alias("done"),
        (F.col("done2") | (F.col("low2") < F.col("low"))).alias("news"),
    )
    return arcs.where("done").withColumn("news", F.lit(False)).unionByName(step)


def connected_components(pairs: DataFrame, a: str = "id_a", b: str = "id_b", core_edges: int = CORE_EDGES) -> DataFrame:
    """One row (id, group_id) for every id linked to another one; ``group_id`` is the smallest id of its group.

    Orientation and repeats of a pair don't matter; rows where either id is null, and an id paired with itself, link
    nothing; an id that has only such rows does not appear. Other columns are ignored. No pairs give no rows.
    """
    scratch = Scratch(pairs.sparkSession, "components")
    many = {"n": F.count(F.lit(1))}
    edges, seen = scratch.measured(_distinct_edges(pairs.select(F.col(a).cast("string").alias("u"), F.col(b).cast("string").alias("v"))), **many)
    removed: list[DataFrame] = []
    while seen["n"] and (not removed or seen["n"] > core_edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        degree = both.groupBy("u").agg(F.count(F.lit(1)).alias("d"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        degree, shape = scratch.measured(degree, n=F.count(F.lit(1)), low=F.count_if(F.col("d") < 3), chained=F.count_if(F.col("d") == 2))
        if not removed or shape["low"] >= PEEL_SHARE * shape["n"]:
            gone, left = _peeled(scratch, edges, degree, bool(shape["chained"]))
        else:
            gone, left = _hooked(scratch, edges, degree)
        removed.append(gone)
        rest, seen = scratch.measured(_distinct_edges(left), **many)
        scratch.release(edges, degree)
        edges = rest
    labels = _core_labels(edges) if seen["n"] else edges.select(F.col("u").alias("vertex"), F.col("v").alias("label"))
    for gone in reversed(removed):
        # what a vertex hangs under was left after its round: it has a label by now, or is the last of its component
        under = gone.join(labels.withColumnRenamed("vertex", "parent"), "parent", "left")
        restored = under.select(F.col("child").alias("vertex"), F.coalesce("label", "parent").alias("label"))
        alone = under.where("label is null").select(F.col("parent").alias("vertex"), F.col("parent").alias("label")).distinct()
        labels = labels.unionByName(restored).unionByName(alone)
    labels = scratch.keep(labels)
    named = labels.groupBy("label").agg(F.min("vertex").alias("group_id"))
    return labels.join(named, "label").select("group_id", F.col("vertex").alias("id"))


def _peeled(scratch: Scratch, edges: DataFrame, degree: DataFrame, chained: bool) -> tuple[DataFrame, DataFrame]:
    """One round of rake and compress: ((child, parent) of the vertices removed, edges left)."""
    d = degree.select(F.col("u").alias("w"), F.col("d").cast("int").alias("dw"))
    marked = edges.join(d.select(F.col("w").alias("u"), F.col("dw").alias("du")), "u").join(d.select(F.col("w").alias("v"), F.col("dw").alias("dv")), "v")
    marked = scratch.keep(marked)
    # a leaf at a chain stays for now: its neighbour leaves in this round
    gone = marked.where("(du = 1 or dv = 1) and greatest(du, dv) <> 2").select(
        F.when(F.col("dv") == 1, F.col("v")).otherwise(F.col("u")).alias("child"), F.when(F.col("dv") == 1, F.col("u")).otherwise(F.col("v")).alias("parent")
    )
    left = marked.where("du > 2 and dv > 2").select("u", "v")
    if chained:
        ends = _rank_chains(scratch, degree.where("d = 2").select(F.col("u").alias("v"), "lo", "hi"))
        inner = ends.select(F.col("v").alias("child"), F.coalesce("end_a", "low").alias("parent"))
        gone = gone.unionByName(inner.where("child <> parent"))
        left = left.unionByName(ends.where("end_a is not null").select(F.col("end_a").alias("u"), F.col("end_b").alias("v")))
    return gone, left


def _hooked(scratch: Scratch, edges: DataFrame, degree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One contraction of a core without leaves and chains: ((child, root), edges between roots)."""
    hooks = degree.where(F.col("lo") < F.col("u")).select(F.col("u").alias("child"), F.col("lo").alias("parent"))
    roots = _jump(scratch, scratch.keep(hooks))
    at = roots.select(F.col("child").alias("u"), F.col("parent").alias("ru"))
    moved = edges.join(at, "u", "left").join(at.select(F.col("u").alias("v"), F.col("ru").alias("rv")), "v", "left")
    return roots, moved.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))


def flagged_pairs(pairs: DataFrame, label: str = "flag") -> DataFrame:
    """Rows of an invoice_pairs table whose label is ``label`` without regard to case and surrounding blanks."""
    return pairs.where(F.lower(F.trim("label")) == label).select("id_a", "id_b")
