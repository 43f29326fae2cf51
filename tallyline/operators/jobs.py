"""The log of jobs: states, what waits longest, what failed, payloads that can't be read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("pending", "running", "done", "failed")
PAYLOAD = "file string, bytes bigint"


def current_jobs(jobs: DataFrame) -> DataFrame:
    """One row for each id: of several deliveries the one that got furthest (last finished, else started, else created).

    Null times count as earliest; of equal times the later state in STATES, then the larger error text counts.
    """
    rest = [c for c in jobs.columns if c != "id"]
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.lower(F.trim("status")))
    order = F.struct("finished_at", "started_at", "created_at", F.coalesce(rank, F.lit(0)).alias("state"), F.coalesce("error_text", F.lit("")).alias("e"))
    return jobs.where("id is not null").groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("x")).select("id", "x.*")


def states(jobs: DataFrame) -> DataFrame:
    """(job_type, status, n) of the current rows."""
    return current_jobs(jobs).groupBy("job_type", F.lower(F.trim("status")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def waiting(jobs: DataFrame, limit: int = 1) -> DataFrame:
    """The pending jobs that a worker would take next: oldest first, then by id. A pending job without a time comes first."""
    return current_jobs(jobs).where(F.lower(F.trim("status")) == "pending").orderBy(F.asc_nulls_first("created_at"), "id").limit(limit).select("id", "job_type", "created_at")


def failed(jobs: DataFrame) -> DataFrame:
    """(id, job_type, error, finished_at) of jobs that failed; a failure without a text has ''."""
    return current_jobs(jobs).where(F.lower(F.trim("status")) == "failed").select("id", "job_type", F.coalesce("error_text", F.lit("")).alias("error"), "finished_at")


def payloads(jobs: DataFrame) -> DataFrame:
    """(id, file, bytes, readable): what a job was given; a payload that is cut off isn't readable and gives nulls."""
    value = F.try_parse_json(F.col("payload"))
    read = F.from_json("payload", PAYLOAD)
    return current_jobs(jobs).select("id", *(F.when(value.isNotNull(), read[n]).alias(n) for n in ("file", "bytes")), value.isNotNull().alias("readable"))
