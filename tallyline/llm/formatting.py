"""Duplicates hidden by formatting: recursive radix partitioning on canonical bytes, tries with terminal counters.

Canonical bytes of a record are its exactly compared fields and the sorted characters of its number, which neither
case, blanks, punctuation nor the order of parts can change. What differs most comes first: the digits of the amount from
the last one on, then the number, then the rest. The distinct written forms (counted with partial aggregates, so a form
with a third of all rows is one row) are split by the first bytes; buckets above the budget are split by further bytes
until each fits. Each bucket is then one trie over the canonical bytes, whose terminals count copies and hold the written
forms met there.

Equal sorted characters are necessary, not sufficient. At a terminal two forms are one number if the parts of one, in
some order, spell out the other; forms linked this way, directly or through others, are one record. What a form spells is
looked up among the texts met at the terminal, so forms aren't compared in pairs.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.texts import missing
from tallyline.plans.lineage import Scratch

EXACT = ("vendor_name", "amount", "currency", "invoice_date", "tax_id")
#: Written forms in one bucket at most, unless all its canonical bytes are equal.
BUCKET_FORMS = 50_000
#: Bytes by which each level of partitioning divides.
DIGITS = 2
#: Orders of a form's parts that are spelled out; with more, it is compared with the texts at its terminal one by one.
ORDERS = 720
STRIDE = 6


def spells(parts: list[str], target: str) -> bool:
    """Whether all parts, in some order and without gaps, spell ``target``."""
    if not parts:
        return not target
    tried = set()
    for i, part in enumerate(parts):
        if part not in tried and target.startswith(part):
            if spells(parts[:i] + parts[i + 1 :], target[len(part) :]):
                return True
        tried.add(part)
    return False


def _runs(text: str) -> list[str]:
    """Letter runs and digit runs, the parts of a number written without any separator."""
    out: list[str] = []
    for ch in text:
        if out and out[-1][-1].isdigit() == ch.isdigit():
            out[-1] += ch
        else:
            out.append(ch)
    return out


def same_number(a: str, b: str) -> bool:
    """Two written forms (lower-case parts joined by blanks) that differ in punctuation and order of parts only."""
    ca, cb = "".join(a.split()), "".join(b.split())
    return ca == cb or any(spells(p, cb) for p in _parts(a)) or any(spells(p, ca) for p in _parts(b))


def _parts(form: str) -> list[list[str]]:
    """The parts of a form as written, and with letters and digits apart where that makes more of them."""
    written = form.split()
    runs = [r for p in written for r in _runs(p)]
    return [written] if runs == written else [written, runs]


class Trie:
    """Byte trie with ``STRIDE`` bytes an edge. A terminal counts copies and lists the forms that ended there."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.terminals: list[list] = []

    def add(self, key: bytes, row: int, copies: int) -> None:
        node = self.root
        for at in range(0, len(key), STRIDE):
            node = node.setdefault(key[at : at + STRIDE], {})
        end = node.get(None)
        if end is None:
            end = node[None] = [0, []]
            self.terminals.append(end)
        end[0] += copies
        end[1].append(row)


def _classes(forms: list[str]) -> list[int]:
    """For each form, the index of the first form of its class."""
    head = list(range(len(forms)))

    def find(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    def link(i: int, j: int) -> None:
        i, j = find(i), find(j)
        head[max(i, j)] = min(i, j)

    # texts and sets of parts first; what is left is looked up among the texts
    texts: dict[str, int] = {}
    first: dict = {}
    for i, f in enumerate(forms):
        link(i, texts.setdefault("".join(f.split()), i))
        for parts in _parts(f):
            link(i, first.setdefault(tuple(sorted(parts)), i))
    for i, parts in {key: (i, key) for key, i in first.items()}.values():
        if factorial(len(parts)) <= ORDERS:
            for order in set(permutations(parts)):
                j = texts.get("".join(order))
                if j is not None:
                    link(i, j)
        else:
            for text, j in texts.items():
                if find(i) != find(j) and spells(list(parts), text):
                    link(i, j)
    return [find(i) for i in range(len(forms))]


def _count_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    trie = Trie()
    for row, (key, copies) in enumerate(zip(pdf["canonical"], pdf["n"])):
        trie.add(key.encode(), row, int(copies))
    forms, ids, counts = pdf["form"].tolist(), pdf["least_id"].tolist(), pdf["n"].tolist()
    group, copies = [None] * len(pdf), [0] * len(pdf)
    for total, rows in trie.terminals:
        if len(rows) == 1:
            group[rows[0]], copies[rows[0]] = ids[rows[0]], total
            continue
        heads = _classes([forms[r] for r in rows])
        least: dict[int, str] = {}
        held: dict[int, int] = {}
        for r, h in zip(rows, heads):
            least[h] = min(least.get(h, ids[r]), ids[r])
            held[h] = held.get(h, 0) + counts[r]
        for r, h in zip(rows, heads):
            group[r], copies[r] = least[h], held[h]
    return pdf[["canonical", "form", "n"]].assign(group_id=group, copies=copies)


def _canonical(df: DataFrame) -> DataFrame:
    """Adds ``form`` (lower-case parts joined by blanks) and ``canonical`` to the rows with a number."""
    form = F.trim(F.regexp_replace(F.lower("invoice_no"), r"[^\p{L}\p{N}]+", " "))

    def exact(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~"))

    letters = F.array_join(F.array_sort(F.split(F.replace("form", F.lit(" "), F.lit("")), "")), "")
    kept = df.where(~missing(F.col("invoice_no"))).select("id", form.alias("form"), *EXACT)
    spread = F.reverse(exact("amount"))
    whole = F.concat_ws("|", spread, letters, *(exact(c) for c in EXACT if c != "amount"))
    return kept.select("id", "form", whole.alias("canonical"))


def _buckets(scratch: Scratch, forms: DataFrame, budget: int) -> DataFrame:
    """Adds ``bucket``, a prefix of ``canonical``, long enough for each bucket to fit or its keys to be all equal."""
    depth, done = DIGITS, None
    forms = forms.withColumn("bucket", F.substring("canonical", 1, depth))
    while True:
        sizes = forms.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("canonical").alias("a"), F.max("canonical").alias("b"))
        large, seen = scratch.measured(sizes.where((F.col("size") > budget) & (F.col("a") != F.col("b"))).select("bucket"), n=F.count(F.lit(1)))
        if not seen["n"]:
            return forms if done is None else done.unionByName(forms)
        # what fits is done with; only the rest is split further
        fits, depth = forms.join(large, "bucket", "left_anti"), depth + DIGITS
        done = fits if done is None else done.unionByName(fits)
        forms = scratch.keep(forms.join(large, "bucket", "left_semi").withColumn("bucket", F.substring("canonical", 1, depth)))


def written_forms(invoices: DataFrame, budget: int = BUCKET_FORMS) -> tuple[DataFrame, DataFrame]:
    """(rows with their canonical bytes and form, forms with ``n``, ``group_id`` and ``copies`` of their record)."""
    scratch = Scratch(invoices.sparkSession, "formatting")
    rows = _canonical(invoices)
    forms = scratch.keep(rows.groupBy("canonical", "form").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least_id")))
    counted = _buckets(scratch, forms, budget).groupBy("bucket").applyInPandas(
        _count_bucket, "canonical string, form string, n long, group_id string, copies long"
    )
    return rows, counted


def collapsed(invoices: DataFrame, budget: int = BUCKET_FORMS) -> DataFrame:
    """(group_id, copies): one row for each distinct record, with how many copies it had (1 for a record without any).

    ``group_id`` is the smallest id. Null equals null in the exactly compared fields. Rows without a number (null, no
    letter or digit, or a word for a missing one) are left out, as they can't be told apart. An empty table gives none.
    """
    _, forms = written_forms(invoices, budget)
    return forms.groupBy("group_id").agg(F.first("copies").alias("copies"))


def copies_of_records(invoices: DataFrame, budget: int = BUCKET_FORMS) -> DataFrame:
    """(group_id, id) of every record present at least twice; ``group_id`` is the smallest id of its copies.

    The many rows of a form that holds much of the table meet exactly one row of that form, whichever task they are in.
    """
    rows, forms = written_forms(invoices, budget)
    repeated = forms.where("copies > 1").select("canonical", "form", "group_id")
    return rows.join(repeated, ["canonical", "form"]).select("group_id", "id")
