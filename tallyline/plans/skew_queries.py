"""Queries on heavily skewed keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.operators.heavy_keys import heavy_values, totals_by_key
from tallyline.plans.catalog import query
from tallyline.sources.tables import table


@query(
    "p1_vendor_totals",
    """SELECT vendor_name, count(*) AS n_rows, CAST(sum(amount) AS BIGINT) AS sum_amount, max(created_at) AS latest
       FROM invoices GROUP BY vendor_name""",
)
def p1_vendor_totals(spark, folder):
    return totals_by_key(table(spark, folder, "invoices"), "vendor_name", "amount", "created_at")


@query(
    "p1_found",
    """SELECT vendor_name FROM invoices WHERE vendor_name IS NOT NULL AND vendor_name <> ''
       GROUP BY vendor_name HAVING count(*) * 50 >= (SELECT count(*) FROM invoices)""",
)
def p1_found(spark, folder):
    usable = F.col("key").isNotNull() & (F.col("key") != "")
    return heavy_values(table(spark, folder, "invoices"), "vendor_name", 50, usable).select("vendor_name")
