"""Jobs: lists, states, clean-up, and rows of older tables brought into one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.catalog import conditional

#: States in which a job is not done. Fixed values.
OPEN = ("Queued", "Running")


def active(jobs: DataFrame, status: str = "status") -> DataFrame:
    return jobs.where(F.col(status).isin(*OPEN))


def listed(jobs: DataFrame, created: str, key: str, limit: int, kind: Column | None = None, status: Column | None = None, library: Column | None = None) -> DataFrame:
    """The newest ``limit`` jobs that fit, ties by key: of the newest 2 * ``limit`` jobs of a kind, as lists have shown them."""
    rows = jobs if kind is None else jobs.where(kind)
    recent = rows.orderBy(F.desc(created), key).limit(2 * limit)
    for c in (status, library):
        recent = recent if c is None else recent.where(c)
    return recent.orderBy(F.desc(created), key).limit(limit)


def cleaned(jobs: DataFrame, audit: DataFrame, key: str, clauses: dict[str, Column | None]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jobs and audit rows that stay, and the jobs that go, with the number of their audit rows. Open jobs always stay; without
    a clause nothing goes."""
    gone = active_free(conditional(jobs, clauses)).select(key)
    counts = audit.groupBy(key).agg(F.count(F.lit(1)).alias("audit_rows"))
    report = gone.join(counts, key, "left").select(key, F.coalesce("audit_rows", F.lit(0).cast("long")).alias("audit_rows"))
    return jobs.join(gone, key, "left_anti"), audit.join(gone, key, "left_anti"), report


def active_free(jobs: DataFrame, status: str = "status") -> DataFrame:
    return jobs.where(~F.col(status).isin(*OPEN))


def ingest_state(running: Column, suspect: Column, has_profile: Column, chunks: Column, stale: Column, force: Column) -> Column:
    """What to do about a library next, the first that holds."""
    return (
        F.when(running, "IN_PROGRESS").when(suspect, "URL_SUSPECT").when(~has_profile, "RECON_NEEDED").when(chunks == 0, "READY_TO_SCRAPE")
        .when(stale, "STALE").when(force, "READY_TO_SCRAPE").otherwise("READY")
    )


def unified(sources: dict[str, tuple[DataFrame, dict[str, Column]]], key: str, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of older tables as one table, and the rows that don't fit, by table; a table with such rows must be kept.

    ``sources``: by name, a table and the columns of the new one.  Columns that a table lacks are null; of rows of one key, that of
    the last table in order counts.
    """
    each = [df.select(*[c.alias(n) for n, c in columns.items()]).withColumn("origin", F.lit(name)) for name, (df, columns) in sorted(sources.items())]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)
    ok = F.coalesce(valid, F.lit(False))
    good = every.where(ok)
    whole = F.struct(*[c for c in every.columns if c != key])
    return good.groupBy(key).agg(F.max_by(whole, "origin").alias("row")).select(key, "row.*"), every.where(~ok)
