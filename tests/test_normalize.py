from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyline.functions import normalize as N


def values(spark, cases, f):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    return [r[0] for r in df.select("i", f(F.col("c")).alias("x")).orderBy("i").select("x").collect()]


@pytest.mark.parametrize(
    "f, cases",
    [
        (N.invoice_no_canonical, {"INV-2024/0012": "INV20240012", "inv 2024-0012": "INV20240012", "INV/O78/L": "INV0781", "": "", None: "", "OL7": "O17", "BIL-2024-0001": "BI120240001"}),
        (N.vendor_canonical, {"Northwind Logistics, Ltd.": "NORTHWIND LOGISTICS", "PT. Maju Jaya Abadi, Tbk": "MAJU JAYA ABADI", "CV Berkah Sentosa": "BERKAH SENTOSA", "Acme Trading GmbH": "ACME TRADING", "X B.V.": "X B V", None: "", "Ltd": ""}),
        (N.tax_id_canonical, {"12-3456789-401": "123456789401", "01.234.567.8-091.000": "012345678091000", None: ""}),
        (N.amount_parsed, {"USD 1,250,000.00": 1250000, "1.250.000,00": 1250000, "12,345": 12345, "125000": 125000, "n/a": None, None: None, "1.250": 1250, "0.500": 500, "(100)": 100, "1,234.567,89": None, "-2.5": -3, "EUR 12,50": 13, "": None}),
        (N.date_parsed, {"2024-03-14": date(2024, 3, 14), "2024/3/4": date(2024, 3, 4), "14 Mar 2024": date(2024, 3, 14), "14  march 2024.": date(2024, 3, 14), "March 14, 2024": date(2024, 3, 14), "14/03/2024": date(2024, 3, 14), "31/02/2024": None, "soon": None, None: None}),
    ],
)
def test_scalars(spark, f, cases):
    assert values(spark, list(cases), f) == list(cases.values())


def test_key_period_and_clamp(spark):
    r = spark.sql("select date'2024-03-14' d, cast(null as date) n").select(
        N.vendor_key(F.lit("NORTHWIND LOGISTICS")), N.billing_period(F.col("d")), N.billing_period(F.col("n")),
        N.clamped_date(F.lit(2023), F.lit(2), F.lit(31)), N.clamped_date(F.lit(2024), F.lit(2), F.lit(0)), N.loose_text(F.lit("A-b C!")),
    ).first()
    assert tuple(r) == ("LOGISTICS NORTHWIND", "2024-03", "", date(2023, 2, 28), date(2024, 2, 1), "abc")
