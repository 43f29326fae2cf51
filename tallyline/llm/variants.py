"""Variant spellings of names: a trie join finds names that share a part up to a typo, a comparison in any order decides.

1. Names are reduced to distinct forms (folded parts and legal form) with partial counts; all else works on forms.
2. Each form is known by *keys*: its two rarest parts (if one is left out or abbreviated, the other stays), all parts
   written together, and for acronyms the initials.
3. The distinct keys are sharded so that two keys one edit apart meet in a shard: a single edit leaves either the first or
   the last half of the shorter key intact. Of a shard with too many keys the other half is halved again in the same way.
   Each shard is a trie; a bit-parallel Levenshtein automaton (with swaps) walks it for every key of the shard and
   enumerates the neighbours.
4. Forms whose keys are neighbours are compared part by part in any order (``names.name_cost``). Each form links to the
   most similar, most frequent form among those more frequent than itself; linked forms are one vendor.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm import names
from tallyline.llm.components import connected_components
from tallyline.llm.texts import missing
from tallyline.plans.lineage import Scratch

#: Parts by which a form is looked up.
RAREST = 2
#: Shortest key for which one edit is tolerated.
FUZZY_FROM = 3
#: Keys of one shard above which it is split by a further piece of the keys.
SHARD_KEYS = 20_000


def shards(key: str) -> list[str]:
    """Shards in which this key meets every key one edit apart: halves from the front and from the back.

    For the shorter key of a pair, with n letters, h = (n - 1) // 2 letters at one of its ends are intact. A key can be the
    shorter or the longer one, so it is in the shards of both lengths.
    """
    n = len(key)
    if n < FUZZY_FROM:
        return []
    halves = {h for h in ((n - 1) // 2, (n - 2) // 2) if h >= 1}
    return [f"{side}{h}{key[:h] if side == 'f' else key[-h:]}" for h in halves for side in "fb"]


def build_trie(keys: list[str]) -> dict:
    root: dict = {}
    for key in keys:
        node = root
        for c in key:
            node = node.setdefault(c, {})
        node[""] = key
    return root


def neighbours(trie: dict, key: str) -> list[str]:
    """Keys in the trie at most one insertion, deletion, substitution or swap from ``key``.

    The automaton's states are bit sets over positions of ``key``: ``exact`` without an edit, ``edited`` with one, and
    ``swapping`` after the second letter of a swap was read first.
    """
    m, at = len(key), {}
    for i, c in enumerate(key):
        at[c] = at.get(c, 0) | 1 << i
    last, out = 1 << m, []
    stack = [(trie, 1, 2, 0)]
    while stack:
        node, exact, edited, swapping = stack.pop()
        for c, child in node.items():
            if c == "":
                if (exact | edited) & last:
                    out.append(child)
                continue
            here = at.get(c, 0)
            exact2 = (exact & here) << 1
            edited2 = (edited & here) << 1 | exact | exact << 1 | exact2 << 1 | (swapping & here) << 2
            edited2 &= (last << 1) - 1
            swapping2 = exact & here >> 1
            if exact2 | edited2 | swapping2:
                stack.append((child, exact2, edited2, swapping2))
    return out


def _join_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Neighbours within each shard; the rows of a partition come sorted by shard, so one trie is held at a time."""

    def solve(shard: str, keys: list[str]) -> pd.DataFrame:
        trie = build_trie(keys)
        kind = shard.partition(":")[0]
        pairs = [(kind, k, other) for k in keys for other in neighbours(trie, k) if k < other]
        return pd.DataFrame(pairs, columns=["kind", "key", "near"])

    shard, held = None, []
    for pdf in batches:
        for s, k in zip(pdf["shard"].tolist(), pdf["key"].tolist()):
            if s != shard:
                if len(held) > 1:
                    yield solve(shard, held)
                shard, held = s, []
            held.append(k)
    if len(held) > 1:
        yield solve(shard, held)


def _tasks(df: DataFrame) -> int:
    """Tasks for passes that cost more than their bytes tell: named, so that adaptive execution does not merge them."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def trie_join(keys: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(key, near): every two distinct keys at most one edit apart, both ways, and each key with itself.

    What stands before a ``:`` in a key is its kind: it is the same in both, and no letter of theirs.
    """
    scratch = Scratch(keys.sparkSession, "tries")
    bare = keys.select("key", F.substring_index("key", ":", 1).alias("kind"), F.substring_index("key", ":", -1).alias("body"))
    sharded = bare.select("kind", "body", F.explode(_shards("body")).alias("s")).select("kind", "body", "s.*")
    sharded = sharded.select("body", "n", "side", F.concat_ws(":", "kind", F.concat("side", F.col("n").cast("string"), "piece")).alias("shard"))
    large, seen = scratch.measured(sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > shard_keys).select("shard"), n=F.count(F.lit(1)))
    if seen["n"]:
        again = sharded.join(large, "shard", "left_semi").select("body", F.explode(_halves_again()).alias("t"), "shard").select("body", F.concat("shard", "t").alias("shard"))
        sharded = sharded.join(large, "shard", "left_anti").select("body", "shard").unionByName(again)
    placed = sharded.select("shard", F.col("body").alias("key")).repartition(_tasks(keys), "shard").sortWithinPartitions("shard")
    joined = placed.mapInPandas(_join_shards, "kind string, key string, near string")
    joined = joined.select(F.concat_ws(":", "kind", "key").alias("key"), F.concat_ws(":", "kind", "near").alias("near")).distinct()
    return joined.unionByName(joined.select(F.col("near").alias("key"), F.col("key").alias("near"))).unionByName(keys.select("key", F.col("key").alias("near")))


def _shards(column: str):
    """``shards`` as a native expression: (side, n, piece), n the length of the intact half."""
    n, key = F.length(column), F.col(column)
    every = []
    for less in (1, 2):
        h = F.floor((n - less) / 2).cast("int")
        usable = (n >= FUZZY_FROM) & (h >= 1)
        for side, part in (("f", F.substring(key, F.lit(1), h)), ("b", F.substring(key, n - h + 1, h))):
            every.append(F.when(usable, F.struct(F.lit(side).alias("side"), h.alias("n"), part.alias("piece"))))
    return F.array_distinct(F.filter(F.array(*every), lambda x: x.isNotNull()))


def _halves_again():
    """Further pieces of ``body`` beside the half (``side``, ``n``) that is intact: the edit is in the other part, of which
    again one end is intact. The shorter of two keys in a shard has n + 1 or n + 2 letters there, so q letters of it are
    n // 2 or (n + 1) // 2; where that is none, the shard stays whole."""
    other = F.when(F.col("side") == "f", F.substring("body", F.col("n") + 1, F.length("body"))).otherwise(F.substring("body", F.lit(1), F.length("body") - F.col("n")))
    every = []
    for more in (0, 1):
        q = F.floor((F.col("n") + more) / 2).cast("int")
        every += [F.concat(F.lit("/f"), q.cast("string"), F.substring(other, F.lit(1), q)), F.concat(F.lit("/b"), q.cast("string"), F.when(q > 0, F.substring(other, F.length(other) - q + 1, q)).otherwise(""))]
    return F.array_distinct(F.array(*every))


_PARSED = T.StructType([T.StructField("core", T.StringType()), T.StructField("legal", T.StringType()), T.StructField("acronyms", T.ArrayType(T.StringType()))])


@F.pandas_udf(_PARSED)
def _parsed(column: pd.Series) -> pd.DataFrame:
    rows = [names.parse(x) for x in column]
    return pd.DataFrame({"core": [" ".join(p) for p, _ in rows], "legal": [x for _, x in rows], "acronyms": [names.acronyms(p) for p, _ in rows]})


@F.pandas_udf(T.DoubleType())
def _cost(a: pd.Series, b: pd.Series) -> pd.Series:
    def split(form: str) -> tuple[tuple[str, ...], str]:
        core, _, legal = form.rpartition("|")
        return tuple(core.split()), legal

    return pd.Series([names.name_cost(split(x), split(y)) for x, y in zip(a, b)], dtype="float64")


def _keys(forms: DataFrame) -> DataFrame:
    """(form, key): the two rarest parts, all parts together, and the acronym."""
    parts = forms.select("form", F.explode(F.array_distinct(F.split("core", " "))).alias("part")).where(F.length("part") >= FUZZY_FROM)
    seen = parts.groupBy("part").agg(F.count(F.lit(1)).alias("seen"))
    rank = Window.partitionBy("form").orderBy("seen", F.length("part").desc(), "part")
    rare = parts.join(seen, "part").withColumn("nth", F.row_number().over(rank)).where(F.col("nth") <= RAREST).select("form", F.concat(F.lit("p:"), "part").alias("key"))
    whole = forms.select("form", F.concat(F.lit("w:"), F.replace("core", F.lit(" "), F.lit(""))).alias("key"))
    short = forms.where("legal <> '' and core not like '% %' and length(core) >= 2").select("form", F.concat(F.lit("a:"), "core", F.lit("|"), "legal").alias("key"))
    initials = forms.where("legal <> ''").select("form", "legal", F.explode("acronyms").alias("initials"))
    initials = initials.select("form", F.concat(F.lit("a:"), "initials", F.lit("|"), "legal").alias("key"))
    wanted = short.select("key").distinct()
    return rare.unionByName(whole).unionByName(short).unionByName(initials.join(wanted, "key", "left_semi").select("form", "key")).distinct()


def vendor_classes(rows: DataFrame, name: str = "vendor_name") -> DataFrame:
    """(name, n_rows, vendor): every usable distinct name as stored, and the class of names it belongs to.

    ``vendor`` is the same for all spellings of a vendor and nothing else is to be read into it. Null, empty and
    placeholder names are left out. Names that differ in case, accents, punctuation or blanks only are always linked.
    """
    scratch = Scratch(rows.sparkSession, "variants")
    counted = rows.where(~missing(F.col(name))).groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n_rows"))
    parsed = counted.withColumn("x", _parsed("name")).select("name", "n_rows", "x.*")
    known = scratch.keep(parsed.withColumn("form", F.concat("core", F.lit("|"), "legal")))
    forms = scratch.keep(known.groupBy("form", "core", "legal", "acronyms").agg(F.sum("n_rows").alias("n")))
    keyed = scratch.keep(_keys(forms).join(forms.select("form", "n"), "form"))
    near = trie_join(keyed.select("key").distinct())
    one, two = keyed.select("key", F.col("form").alias("form"), "n"), keyed.select(F.col("key").alias("near"), F.col("form").alias("parent"), F.col("n").alias("parent_n"))
    ahead = (F.col("parent_n") > F.col("n")) | (F.col("parent_n") == F.col("n")) & (F.col("parent") < F.col("form"))
    pairs = one.join(near, "key").join(two, "near").where(ahead).select("form", "parent", "parent_n").distinct()
    judged = pairs.repartition(_tasks(pairs), "form", "parent").withColumn("cost", _cost("form", "parent")).where("cost is not null")
    links = judged.groupBy("form").agg(F.min_by("parent", F.struct("cost", -F.col("parent_n"), "parent")).alias("parent"))
    classes = connected_components(links, "form", "parent").select(F.col("id").alias("form"), F.col("group_id").alias("class"))
    return known.join(classes, "form", "left").select(F.col("name").alias(name), "n_rows", F.coalesce("class", "form").alias("vendor"))


def variant_pairs(rows: DataFrame, name: str = "vendor_name") -> DataFrame:
    """(name_a, name_b): all pairs of different stored names of one vendor, the smaller string first.

    Pairs of distinct names, not of rows: however many rows a name has, it is one name here.
    """
    classes = Scratch(rows.sparkSession, "variants").keep(vendor_classes(rows, name))
    a = classes.select("vendor", F.col(name).alias("name_a"))
    b = classes.select("vendor", F.col(name).alias("name_b"))
    return a.join(b, "vendor").where("name_a < name_b").select("name_a", "name_b")
