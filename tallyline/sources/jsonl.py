"""Invoices and scored pairs as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INVOICE = "id string, vendor_name string, invoice_no string, amount bigint, currency string, invoice_date date, tax_id string, duplicate_of string, variant string"
_BREAKDOWN = "struct<invoice_no:double,vendor:double,amount:double,date:double,billing_period_match:double,tax_id:string,rule:string,tuned:struct<score_before:double,label_before:string,model:string>>"
PAIR = f"id_a string, id_b string, score double, label string, breakdown {_BREAKDOWN}"


def read_invoices(spark: SparkSession, path: str) -> DataFrame:
    """Invoices of a file or folder: blank lines are skipped, unknown keys ignored, absent texts '', absent currency 'USD'.

    A malformed line, or one without id or amount, fails the read.
    """
    df = spark.read.schema(INVOICE).option("mode", "FAILFAST").json(path)
    needed = [F.coalesce(c, F.raise_error(F.lit(f"invoice without {c}")).cast(df.schema[c].dataType)).alias(c) for c in ("id", "amount")]
    texts = [F.coalesce(c, F.lit(d)).alias(c) for c, d in (("vendor_name", ""), ("invoice_no", ""), ("currency", "USD"), ("tax_id", ""))]
    return df.select(*needed, *texts, "invoice_date", "duplicate_of", "variant").select(*[c.split()[0] for c in INVOICE.split(", ")])


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIR).option("mode", "FAILFAST").json(path)


def write_invoices(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One line an invoice; null fields are written as null."""
    df.select(*[c.split()[0] for c in INVOICE.split(", ")]).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_pairs(df: DataFrame, path: str, mode: str = "errorifexists", ordered: bool = False) -> None:
    """One line a pair; score and similarities are rounded to four decimals here and nowhere before.

    ``ordered``: by both ids, over all files; what is written is sorted, nothing before.
    """
    b = F.col("breakdown")
    fields = [f.name for f in df.schema["breakdown"].dataType.fields]
    numbers = ("invoice_no", "vendor", "amount", "date", "billing_period_match")
    parts = F.struct(*((F.round(b[f], 4) if f in numbers else b[f]).alias(f) for f in fields))
    rows = df.select("id_a", "id_b", F.round("score", 4).alias("score"), "label", parts.alias("breakdown"))
    (rows.orderBy("id_a", "id_b") if ordered else rows).write.mode(mode).json(path)
