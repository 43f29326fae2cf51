"""Documents dropped into a folder: read, stored and matched by Structured Streaming.

The checkpoint is the queue: a file is taken once, a run that stops goes on where it was, and a document that can't be
read becomes a row with an error instead of stopping its batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.extraction import as_invoices
from tallyline.operators.matching import ScoringConfig, detect
from tallyline.operators.tuning import rescored
from tallyline.plans.lineage import Scratch
from tallyline.sources.documents import read_documents, scan_documents
from tallyline.sources.store import Store, active_model
from tallyline.sources.vision import VisionClient

INVOICES = (
    "id string, vendor_name string, invoice_no string, amount bigint, currency string, invoice_date date, tax_id string, "
    "source_name string, extraction_method string, extraction_confidence double, created_at timestamp"
)
AUDIT = "source_name string, status string, error string, batch bigint"


def invoice_stream(spark: SparkSession, inbox: str, client: VisionClient | None = None) -> DataFrame:
    """The documents of ``inbox`` as a stream of read documents; files that aren't accepted come with an error."""
    return read_documents(scan_documents(spark, inbox, stream=True, rejects=True), client)


def refresh_pairs(store: Store, config: ScoringConfig = ScoringConfig()) -> None:
    """Match all stored invoices again and replace the pairs, rescored if a model is active."""
    rows = store.read("invoices", INVOICES)
    pairs = detect(rows, config).pairs
    model = active_model(store)
    store.replace("pairs", rescored(pairs, rows, model) if model else pairs)


def _take(store: Store, config: ScoringConfig):
    def batch(documents: DataFrame, number: int) -> None:
        with Scratch(store.spark, "ingest") as scratch:
            read = scratch.keep(documents.withColumn("id", F.concat(F.lit("doc-"), F.substring(F.sha2("path", 256), 1, 16))))
            good = read.where("error is null")
            extra = good.select("id", F.col("path").alias("source_name"), F.col("method").alias("extraction_method"), F.col("confidence").alias("extraction_confidence"))
            known = store.read("invoices", INVOICES).select("id")  # a batch that is run again adds nothing twice
            rows = as_invoices(good).join(extra, "id").join(known, "id", "left_anti").withColumn("created_at", F.current_timestamp())
            store.append("invoices", rows.select(*[c.split()[0] for c in INVOICES.split(", ")]))
            status = F.when(F.col("error").isNull(), "done").otherwise("failed")
            audit = read.select(F.col("path").alias("source_name"), status.alias("status"), "error", F.lit(number).cast("bigint").alias("batch"))
            told = store.read("audit", AUDIT).where(F.col("batch") == number).select("source_name")
            store.append("audit", audit.join(told, "source_name", "left_anti").select(*[c.split()[0] for c in AUDIT.split(", ")]))
            refresh_pairs(store, config)

    return batch


def run(spark: SparkSession, inbox: str, root: str, once: bool = True, config: ScoringConfig = ScoringConfig(), client: VisionClient | None = None):
    """Start the stream; with ``once`` it ends when all files present are done, else it looks again every second."""
    store = Store(spark, root)
    writer = invoice_stream(spark, inbox, client).writeStream.foreachBatch(_take(store, config)).option("checkpointLocation", f"{root}/checkpoint")
    query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
    if once:
        query.awaitTermination()
    return query
