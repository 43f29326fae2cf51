"""Queries on sources: generated rows, PDF files read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.plans.catalog import query
from tallyline.sources import documents, synthetic
from tallyline.sources.tables import table


@query("synthetic_corpus")
def synthetic_corpus(spark, d):
    return synthetic.generate(spark, 10_000, 0.02, 42)


@query("synthetic_meta")
def synthetic_meta(spark, d):
    return synthetic.meta(synthetic.generate(spark, 10_000, 0.02, 42))


@F.pandas_udf(T.BinaryType())
def _as_pdf(text: pd.Series) -> pd.Series:
    return pd.Series([documents.make_pdf(x.split("\n")) for x in text])


@query("pdf_fields")
def pdf_fields(spark, d):
    """The raw text of every invoice as a PDF file, and the fields read from that."""
    rows = table(spark, d, "invoices", "id", "raw_text").where("raw_text <> ''").select(F.col("id").alias("path"), _as_pdf("raw_text").alias("content"))
    kinds = rows.select("path", "content", documents.kind_of(F.col("content")).alias("kind"))
    return documents.read_documents(kinds).select(F.col("path").alias("id"), "method", "error", "fields.*", "missing", "confidence")
