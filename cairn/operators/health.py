"""Counts and verdicts over ingested tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.text import collapse
from cairn.functions.web import host
from cairn.operators.catalog import running_total
from cairn.sources.scratch import written


def mix(rows: DataFrame, column: str, empty: str = "unfenced") -> DataFrame:
    """value, n, ratio of ``column``'s values; the total comes from the counts, a row for each value."""
    counts = rows.groupBy(F.coalesce(F.col(column), F.lit(empty)).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("ratio", F.col("n") / F.sum("n").over(Window.partitionBy()))


def hosts(pages: DataFrame) -> DataFrame:
    return pages.groupBy(F.coalesce(host(F.col("url")), F.lit("(unknown)")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


def duplicate_share(chunks: DataFrame, key: str) -> DataFrame:
    """key, n, duplicate_pct, suspect: repeats among collapsed contents; suspect from five rows and 60 percent on."""
    hashed = chunks.groupBy(key, F.xxhash64(collapse(F.col("content"))).alias("h")).agg(F.count(F.lit(1)).alias("c"))
    rows = hashed.groupBy(key).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("kinds"))
    pct = 100.0 * (F.col("n") - F.col("kinds")) / F.col("n")
    return rows.select(key, "n", pct.alias("duplicate_pct"), ((F.col("n") >= 5) & (pct >= 60)).alias("suspect"))


def repeated_texts(rows: DataFrame, text: str) -> DataFrame:
    """text, n of texts that come twice or more: hashes are counted, and only texts whose hash repeats are compared."""
    h = F.xxhash64(text)
    again = written(rows.groupBy(h.alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    return rows.withColumn("h", h).join(again, "h", "left_semi").groupBy(text).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def group_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """kind, value, n: counts by each of ``columns`` in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns])).alias("e")
    return rows.select(each).groupBy("e.kind", "e.value").agg(F.count(F.lit(1)).alias("n"))


def quantiles(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """key and a column for each of ``shares``: exact quantiles, interpolated, of each key's non-null values.

    Equal values are counted first, counts are summed over ranges of (key, value), and a quantile is read off where the sums pass
    it: no task holds the values of a key.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("count"))
    summed = running_total(counts, [key, value], "count")
    sizes = summed.groupBy(key).agg(F.sum("count").alias("n"), F.min(F.col("total") - F.col("count")).alias("base"))
    met = summed.join(sizes, key).withColumn("up_to", F.col("total") - F.col("base"))
    place = lambda p: (F.col("n") - 1) * F.lit(p)
    at = lambda x: F.min(F.when(F.col("up_to") > x, F.col(value)))
    ends = met.groupBy(key, "n").agg(*[at(f(place(p))).alias(f"{name}_{side}") for name, p in shares.items() for side, f in (("low", F.floor), ("high", F.ceil))])
    part = lambda p: place(p) - F.floor(place(p))
    return ends.select(key, *[(F.col(f"{name}_low") * (1 - part(p)) + F.col(f"{name}_high") * part(p)).alias(name) for name, p in shares.items()])


def latency(rows: DataFrame, operation: str, duration: str, failed: Column) -> DataFrame:
    """Count, failures, mean, median, 95th percentile and maximum by operation."""
    facts = rows.groupBy(operation).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("failures"), F.avg(duration).alias("mean"), F.max(duration).alias("top"))
    return facts.join(quantiles(rows, operation, duration, {"p50": 0.5, "p95": 0.95}), operation, "left").select(operation, "n", "failures", "mean", "p50", "p95", "top")


def suspect_reasons(pages: Column, links: Column, hosts_n: Column, languages: Column, declared_share: Column, readme_only: Column) -> Column:
    """Why a version looks badly ingested, in order; an empty array if it doesn't."""
    return F.array_compact(
        F.array(F.when(pages <= 3, "FewPages"), F.when(links < 10, "SparseLinks"), F.when((hosts_n == 1) & (languages > 1), "SingleHostManyLanguages"), F.when(declared_share < 0.30, "LanguageMismatch"), F.when(readme_only, "ReadmeOnly"))
    )


def stale(state: Column, progress: Column, created: Column, now: Column, hours: int = 4) -> Column:
    return (state == "Running") & (F.coalesce(progress, created) < now - F.make_interval(hours=F.lit(hours)))
