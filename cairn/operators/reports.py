"""Reports over versions, crawls, dependencies and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.text import collapse

#: Shares of broken chunks from which rechunking may help and is advised; rows sampled for repeats, and from which share and
#: number they are suspect; hosts and suspects shown. Fixed values.
MAY_HELP, ADVISED, SAMPLE, SUSPECT_SHARE, SUSPECT_ROWS, HOSTS, SUSPECTS = 5.0, 10.0, 200, 60.0, 5, 20, 20

#: Pages of a dry run's sample. A fixed value.
SAMPLES = 50


def boundary_pct(issues: Column, chunks: Column) -> Column:
    return 100.0 * issues / F.greatest(chunks, F.lit(1))


def boundary_hint(pct: Column) -> Column:
    return F.when(pct >= ADVISED, "rechunk_recommended").when(pct >= MAY_HELP, "rechunk_may_help")


def page_counts(chunks: DataFrame) -> DataFrame:
    """page, chunks, category, depth of ``chunks`` (url, nth, category, depth): pages are urls in any case; the last category, the
    first depth."""
    return chunks.groupBy(F.lower("url").alias("page")).agg(F.count(F.lit(1)).alias("chunks"), F.max_by("category", "nth").alias("category"), F.min_by("depth", "nth").alias("depth"))


def sampled_duplicates(chunks: DataFrame, n: int = SAMPLE) -> DataFrame:
    """library_id, rows, duplicate_pct, suspect: repeats among the first ``n`` chunks (chunk_id, library_id, content) of each library."""
    place = F.row_number().over(Window.partitionBy("library_id").orderBy("chunk_id"))
    rows = chunks.withColumn("place", place).where(F.col("place") <= n).groupBy("library_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.sha2(collapse(F.col("content")), 256)).alias("kinds"))
    pct = 100.0 * (F.col("rows") - F.col("kinds")) / F.col("rows")
    return rows.select("library_id", "rows", pct.alias("duplicate_pct"), ((F.col("rows") >= SUSPECT_ROWS) & (pct >= SUSPECT_SHARE)).alias("suspect"))


def next_action(content_suspect: Column, suspect: Column, pct: Column) -> Column:
    return F.when(content_suspect, "rescrape_library").when(suspect, "submit_url_correction").when(pct >= ADVISED, "rechunk_library")


def snapshot(versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row for each of ``versions`` (library_id, suspect, boundary_pct): hosts, duplicates, and what to do next.

    ``chunks``: chunk_id, library_id, host, content.
    """
    counts = chunks.groupBy("library_id", "host").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("library_id").orderBy(F.desc("n"), "host"))
    top = counts.withColumn("place", place).groupBy("library_id").agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("chunks"), F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= HOSTS, F.struct("place", "host")))), lambda x: x["host"]).alias("top_hosts"),
    )
    repeats = sampled_duplicates(chunks).select("library_id", F.round("duplicate_pct", 1).alias("duplicate_pct"), F.col("suspect").alias("content_suspect"))
    met = versions.join(top, "library_id", "left").join(repeats, "library_id", "left")
    action = next_action(F.coalesce("content_suspect", F.lit(False)), F.col("suspect"), F.col("boundary_pct"))
    return met.select("library_id", "hosts", "chunks", "top_hosts", "duplicate_pct", "content_suspect", boundary_hint(F.col("boundary_pct")).alias("boundary_hint"), action.alias("next_action"))


def dashboard(versions: DataFrame, jobs: DataFrame, now: Column, hours: int = 4) -> DataFrame:
    """One row: libraries, versions, suspects, stale jobs, and what to do next.

    ``versions``: library_id, version, suspect; ``jobs``: status, last_progress, created.
    """
    v = versions.agg(F.count_distinct("library_id").alias("libraries"), F.count(F.lit(1)).alias("versions"), F.least(F.count_if("suspect"), F.lit(SUSPECTS).cast("long")).alias("suspects"))
    stale = (F.col("status") == "Running") & (F.coalesce("last_progress", "created") < now - F.make_interval(hours=F.lit(hours)))
    both = v.withColumn("k", F.lit(1)).join(jobs.agg(F.count_if(stale).alias("stale_jobs")).withColumn("k", F.lit(1)), "k").drop("k")
    action = F.when(F.col("libraries") == 0, "scrape_docs").when(F.col("suspects") > 0, "submit_url_correction").when(F.col("stale_jobs") > 0, "cancel_job")
    return both.withColumn("next_action", action)


def dry_run(pages: DataFrame, stages: tuple[str, ...] = (), order: list[str] | None = None, samples: int = SAMPLES) -> DataFrame:
    """kind, value, n, ms of ``pages`` (host, depth, category, in_scope, outcome): totals and histograms, and of each of ``stages``
    (columns of milliseconds, null where a page did not come so far) how many pages it took and their time, in one pass.

    With ``order``, which must end with a unique column, rows of kind sample follow: the first ``samples`` pages by it, with its last
    column as value, n their place and their stages' time.  Each partition keeps its own first ones, so a sample is bounded.
    """
    nothing = F.lit(None).cast("long")
    entry = lambda kind, value, ms=nothing: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), ms.cast("long").alias("ms"))
    flag = lambda c, name: F.when(c, entry("total", F.lit(name)))
    each = F.array_compact(F.array(
        flag(F.lit(True), "pages"), flag(F.col("in_scope"), "in_scope"), flag(~F.col("in_scope"), "out_of_scope"), flag(F.col("outcome") == "Filtered", "filtered"),
        flag(F.col("outcome") == "DepthLimited", "depth_limited"), flag(F.col("outcome") == "Error", "errors"), *[entry(k, F.col(k)) for k in ("host", "depth", "category")],
        *[F.when(F.col(s).isNotNull(), entry("stage", F.lit(s), F.col(s))) for s in stages],
    ))
    out = pages.select(F.explode(each).alias("e")).groupBy("e.kind", "e.value").agg(F.count(F.lit(1)).alias("n"), F.sum("e.ms").alias("ms"))
    if order is None:
        return out
    whole = F.aggregate(F.array(*[F.coalesce(F.col(s).cast("long"), F.lit(0)) for s in stages]), F.lit(0).cast("long"), lambda a, x: a + x) if stages else nothing
    first = pages.select(*order, whole.alias("ms")).orderBy(*order).limit(samples)
    place = F.row_number().over(Window.orderBy(*order)).cast("long")
    return out.unionByName(first.select(F.lit("sample").alias("kind"), F.col(order[-1]).cast("string").alias("value"), place.alias("n"), "ms"))


def previews(errors: DataFrame, kind: str, order: list[str], n: int = 3) -> DataFrame:
    """The first ``n`` rows of each kind, with the kind's number of rows and how many more there are."""
    counts = errors.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    return errors.withColumn("place", place).where(F.col("place") <= n).join(counts, kind).withColumn("more", F.greatest(F.col("n") - n, F.lit(0).cast("long")))


def histogram(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """One row: how many of ``rows`` have each of ``values``, and all."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(column) == v).alias(v.replace("-", "_")) for v in values])


def first_of_each(rows: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key, for keys that are expressions (an id in any case, say)."""
    named = rows.select("*", *[k.alias(f"key_{i}") for i, k in enumerate(keys)])
    window = Window.partitionBy(*[f"key_{i}" for i in range(len(keys))]).orderBy(*order)
    return named.withColumn("nth", F.row_number().over(window)).where("nth = 1").select(*rows.columns)


def totals(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def rendered_tables(cells: DataFrame) -> DataFrame:
    """table_id, text of ``cells`` (table_id, row, col, text): cells joined by bars, rows by line feeds."""
    cell = lambda name: F.struct("col", F.trim(F.coalesce(name, F.lit(""))).alias("text"))
    lines = cells.groupBy("table_id", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(cell("text"))), lambda c: c["text"]), " | ").alias("line"))
    return lines.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("text"))


def titles(pages: DataFrame, n: int) -> DataFrame:
    """title: distinct titles of the first ``n`` pages (page_id, title)."""
    return pages.orderBy("page_id").limit(n).select("title").distinct()


def summaries(libraries: DataFrame, versions: DataFrame) -> DataFrame:
    """``libraries`` (library_id, current) with the counts of their current version, and all their versions, the newest first."""
    listed = versions.groupBy("library_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("scraped_at", "version")), asc=False), lambda v: v["version"]).alias("versions"))
    now = versions.select("library_id", F.col("version").alias("current"), "pages", "chunks")
    return libraries.join(now, ["library_id", "current"], "left").join(listed, "library_id", "left").select("library_id", "current", "pages", "chunks", F.array_join("versions", ",").alias("versions"))
