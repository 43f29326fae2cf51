"""Reading invoice fields out of plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions import normalize as N
from tallyline.plans.lineage import spread

# How lines that hold a field begin, in the order in which they are tried; the fields that count.
VENDOR = r"(?i)^\s*(?:vendor|supplier|seller|billed\s*by|from)\s*:\s*(.+?)\s*$"
NUMBER_MARKED = r"(?i)^\s*(?:invoice|inv)\s*(?:number|no\.?|#)?\s*[:#]\s*(.+?)\s*$"
NUMBER_WORD = r"(?i)^\s*(?:invoice|inv)\s+(?:number|no\.?)\s+(.+?)\s*$"
DATE = r"(?i)^\s*(?:invoice\s*)?date\s*:\s*(.+?)\s*$"
AMOUNT = r"(?i)^\s*(?:amount(?:\s*due)?|total(?:\s*amount)?|grand\s*total)\s*:\s*(.+?)\s*$"
TAX_ID = r"(?i)^\s*(?:tax\s*(?:id|no\.?|number)?|vat(?:\s*(?:id|no\.?|number))?)\s*:\s*(.+?)\s*$"
CORE_FIELDS = ("vendor_name", "invoice_no", "invoice_date", "amount")


def _first(lines: Column, patterns: tuple[str, ...], read=lambda x: x) -> Column:
    """What ``read`` makes of the first line of a pattern for which it gives anything; only such lines are read."""

    def value(line: Column) -> Column:
        found = F.regexp_extract(line, patterns[0], 1)
        for p in patterns[1:]:
            found = F.when(found != "", found).otherwise(F.regexp_extract(line, p, 1))
        return F.nullif(F.trim(found), F.lit(""))

    held = F.filter(lines, lambda x: x.rlike("|".join(f"(?:{p})" for p in patterns)))
    return F.get(F.filter(F.transform(held, lambda x: read(value(x))), lambda x: x.isNotNull()), F.lit(0))


def fields_of(text: Column) -> Column:
    """Struct (vendor_name, invoice_no, amount, invoice_date, tax_id) read from labelled lines.

    The first line that gives a field wins; a date or an amount that can't be read leaves the field to a later line. Texts
    not found are '', numbers and dates null; so for a null text.
    """
    # lines with a label only: the patterns are tried on few lines of a long text
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda x: x.rlike(r"(?i)^\s*(?:vendor|supplier|seller|billed|from|inv|date|amount|total|grand|tax|vat)"))
    return F.struct(
        F.coalesce(_first(lines, (VENDOR,)), F.lit("")).alias("vendor_name"),
        F.coalesce(_first(lines, (NUMBER_MARKED, NUMBER_WORD)), F.lit("")).alias("invoice_no"),
        _first(lines, (AMOUNT,), N.amount_parsed).alias("amount"),
        _first(lines, (DATE,), N.date_parsed).alias("invoice_date"),
        F.coalesce(_first(lines, (TAX_ID,)), F.lit("")).alias("tax_id"),
    )


def missing_of(fields: Column) -> Column:
    """Names of the core fields that are empty, null or 0."""

    def empty(name: str) -> Column:
        c = fields[name]
        return c.isNull() | ((c == 0) if name == "amount" else (c == "") if name != "invoice_date" else F.lit(False))

    return F.array_compact(F.array(*(F.when(empty(n), F.lit(n)) for n in CORE_FIELDS)))


def extracted(df: DataFrame, text: str) -> DataFrame:
    """Adds ``fields``, ``missing`` and ``confidence`` (share of core fields found, two decimals)."""
    out = spread(df).withColumn("fields", fields_of(F.col(text))) if not df.isStreaming else df.withColumn("fields", fields_of(F.col(text)))
    out = out.withColumn("missing", missing_of(F.col("fields")))
    return out.withColumn("confidence", F.round((len(CORE_FIELDS) - F.size("missing")) / float(len(CORE_FIELDS)), 2))


def as_invoices(df: DataFrame, currency: str = "USD") -> DataFrame:
    """Rows of ``extracted`` as invoices; a missing amount is 0."""
    f = F.col("fields")
    return df.select("id", f["vendor_name"].alias("vendor_name"), f["invoice_no"].alias("invoice_no"), F.coalesce(f["amount"], F.lit(0)).alias("amount"), F.lit(currency).alias("currency"), f["invoice_date"].alias("invoice_date"), f["tax_id"].alias("tax_id"))


_ANSWER = "struct<vendor_name:variant,invoice_no:variant,tax_id:variant,invoice_date:variant,amount:variant,extraction_confidence:variant>"


def validated(answer: Column) -> Column:
    """Struct (error, vendor_name, invoice_no, tax_id, invoice_date, amount, confidence) of a recogniser's JSON answer.

    ``error`` is null for a valid answer. Texts must be strings or null, the date one that can be read, the amount a number
    or a text with digits, the confidence a number in 0..1 (0 if left out).
    """
    v = F.try_parse_json(answer)

    def kind(name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))

    def text(name: str) -> Column:
        return F.try_variant_get(v, f"$.{name}", "string")

    number = ("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")

    def is_number(name: str) -> Column:
        return kind(name).isin(*number) | kind(name).startswith("DECIMAL")

    absent = lambda name: kind(name).isNull() | (kind(name) == "VOID")
    bad_text = lambda name: ~absent(name) & (kind(name) != "STRING")
    confidence = F.coalesce(F.when(is_number("extraction_confidence"), F.try_variant_get(v, "$.extraction_confidence", "double")), F.lit(0.0))
    amount_text = (kind("amount") == "STRING") & text("amount").rlike(r"\d")
    error = (
        F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "not a JSON object")
        .when(bad_text("vendor_name"), "vendor_name is no text").when(bad_text("invoice_no"), "invoice_no is no text").when(bad_text("tax_id"), "tax_id is no text")
        .when(~absent("invoice_date") & ((kind("invoice_date") != "STRING") | N.date_parsed(text("invoice_date")).isNull()), "invoice_date is no date")
        .when(~absent("amount") & (kind("amount") != "BOOLEAN") & ~is_number("amount") & ~amount_text, "amount is no number")
        .when((~kind("extraction_confidence").isNull()) & ~is_number("extraction_confidence"), "extraction_confidence is no number")
        .when(~confidence.between(0.0, 1.0), "extraction_confidence is outside 0..1")
    )
    amount = F.when(is_number("amount") | amount_text, N.amount_parsed(text("amount")))
    return F.struct(
        error.alias("error"), *(F.coalesce(F.trim(text(n)), F.lit("")).alias(n) for n in ("vendor_name", "invoice_no", "tax_id")),
        N.date_parsed(text("invoice_date")).alias("invoice_date"), amount.alias("amount"), confidence.alias("confidence"),
    )
