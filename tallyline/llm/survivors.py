"""Best representative of each duplicate group, field by field.

The fields are unpivoted to long rows (one for each copy and field that holds something), every copy votes, votes are
summed for each candidate, the candidate with most votes wins, and the winners are pivoted back. A group of any size is
thus reduced by mergeable aggregates and never gathered in one task.

* ``voted_records``: candidates are the normalised values, a vote weighs source trust x recency decay.
* ``best_copies``: candidates are the copies themselves. Where one criterion outranks the next whatever their values, a
  vote has to weigh them in orders of magnitude: it is an exact number with the trust before the point's tens, the
  confidence after them, and the age in a second number below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.components import connected_components
from tallyline.llm.texts import missing
from tallyline.plans.lineage import Scratch

FIELDS = ("vendor_name", "invoice_no", "amount", "currency", "invoice_date", "tax_id")
#: Rows up to which the table of trust ranks is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 10_000


def duplicate_groups(invoices: DataFrame) -> DataFrame:
    """(group_id, id) of all invoices tied by a non-empty ``duplicate_of``, directly or indirectly.

    ``group_id`` is the smallest id that is an invoice. A ``duplicate_of`` that names no invoice still ties those that
    share it; an invoice tied to nothing else is in no group.
    """
    return _grouped(invoices, invoices.select("id")).select("group_id", "id").distinct()


def _grouped(invoices: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` of invoices that are in a group, with ``group_id`` in front."""
    ties = invoices.where(F.trim("duplicate_of") != "").select("id", "duplicate_of")
    # kept, so that its size is known: few ids are broadcast to the invoices, which then aren't shuffled
    tied = Scratch(invoices.sparkSession, "survivors").keep(connected_components(ties, "id", "duplicate_of").withColumnRenamed("group_id", "tie"))
    held = rows.join(tied, "id")
    heads = held.groupBy("tie").agg(F.min("id").alias("group_id"), F.max("id").alias("last")).where("group_id <> last")
    return held.join(heads.select("tie", "group_id"), "tie").select("group_id", *rows.columns)


def _long(invoices: DataFrame, trust: DataFrame) -> DataFrame:
    """(group_id, field_name, value, order columns) of every copy and field that holds something."""
    ranks = trust.select(F.lower(F.trim("source_type")).alias("kind"), "trust_rank").groupBy("kind").agg(F.min("trust_rank").alias("trust_rank"))
    few = len(ranks.limit(BROADCAST_ROWS + 1).take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS
    confidence = F.col("extraction_confidence")
    usable = confidence.isNotNull() & ~F.isnan(confidence) & confidence.between(0.0, 1.0)
    rows = _grouped(invoices, invoices.select("id", "source_type", "extraction_confidence", "created_at", *FIELDS))
    rows = rows.withColumn("kind", F.lower(F.trim("source_type"))).join(F.broadcast(ranks) if few else ranks, "kind", "left")

    def held(name: str) -> Column:
        c = F.col(name)
        if name == "amount":
            return F.when(c != 0, c.cast("string"))
        if name == "invoice_date":
            return c.cast("string")
        return F.when(~missing(c), c)

    cells = F.array(*(F.struct(F.lit(f).alias("field_name"), held(f).alias("value")) for f in FIELDS))
    return rows.select(
        "group_id", "id", "trust_rank", "created_at", F.when(usable, confidence).alias("confidence"),
        F.inline(F.filter(cells, lambda x: x["value"].isNotNull())),
    )


def _elected(votes: DataFrame, candidate: str, *weights: str) -> DataFrame:
    """(group_id, field_name, candidate and what else ``votes`` says of it by ``shown``): who has most votes.

    ``weights`` are exact numbers, the first counts most. Equal votes: the smaller candidate.
    """
    summed = votes.groupBy("group_id", "field_name", candidate).agg(*(F.sum(w).alias(w) for w in weights), F.max("shown").alias("shown"))
    order = F.struct(*((-F.col(w)).alias(w) for w in weights), F.col(candidate))
    return summed.groupBy("group_id", "field_name").agg(F.min_by(F.struct(candidate, "shown"), order).alias("x")).select("group_id", "field_name", "x.*")


def best_copies(invoices: DataFrame, trust: DataFrame) -> DataFrame:
    """(group_id, field_name, id): the copy each field is taken from.

    The first of the copies where the field is not missing (nor 0 for amount) by ``trust_rank`` (unknown and null
    source types last), confidence descending (null, NaN and values outside 0..1 last), ``created_at`` descending
    (null last), id. A field that no copy holds gives no row; no ties between invoices give no rows at all. An invoice
    that is there twice votes once, by its stronger row.
    """
    unknown = 2**31 - 1
    standing = F.lit(unknown) - F.coalesce("trust_rank", F.lit(unknown)).cast("bigint")
    sure = F.coalesce(1 + F.col("confidence").cast("decimal(20,19)"), F.lit(0))
    vote = F.struct(
        (standing.cast("decimal(12,0)") * 10 + sure).cast("decimal(34,19)").alias("standing"),
        F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")).cast("decimal(20,0)") + F.lit(2**62), F.lit(0)).cast("decimal(28,0)").alias("age"),
    )
    cast = _long(invoices, trust).groupBy("group_id", "field_name", "id").agg(F.max(vote).alias("vote"))
    return _elected(cast.select("group_id", "field_name", "id", "vote.*", F.lit(True).alias("shown")), "id", "standing", "age").drop("shown")


def voted_records(invoices: DataFrame, trust: DataFrame, half_life_days: float = 180.0) -> DataFrame:
    """One record for each group: per field the value with most votes, a vote weighing 1/(trust rank + 1) x recency.

    Names, numbers, currencies and tax ids vote together when they agree without case, blanks and punctuation, amounts
    and dates when they are equal; the winner appears in the spelling of its heaviest single vote. Recency halves every
    ``half_life_days`` before the latest copy of all groups. Copies without trust rank or date vote with a hundredth.
    Equal votes: the smaller normalised value. Fields nobody holds are null.
    """
    long = _long(invoices, trust)
    latest = invoices.agg(F.max("created_at").alias("m")).first()["m"]
    age = F.greatest(F.lit(0.0), F.date_diff(F.lit(latest).cast("timestamp"), F.col("created_at")).cast("double"))
    weight = F.coalesce(1.0 / (F.col("trust_rank") + 1), F.lit(0.01)) * F.coalesce(F.pow(F.lit(0.5), age / half_life_days), F.lit(0.01))
    bare = F.lower(F.regexp_replace("value", r"[^\p{L}\p{N}]+", ""))
    key = F.when(F.col("field_name").isin("amount", "invoice_date"), F.col("value")).otherwise(bare)
    # fixed point keeps the sum independent of the order in which partial sums meet
    votes = long.withColumn("w", weight).withColumns({"candidate": key, "votes": F.round(F.col("w") * 1e9).cast("decimal(28,0)"), "shown": F.struct("w", "value")})
    won = _elected(votes, "candidate", "votes").select("group_id", "field_name", F.col("shown.value").alias("value"))
    wide = won.groupBy("group_id").pivot("field_name", list(FIELDS)).agg(F.first("value"))
    return wide.select("group_id", *[F.col(f).cast("bigint" if f == "amount" else "date" if f == "invoice_date" else "string").alias(f) for f in FIELDS])
