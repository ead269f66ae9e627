"""Tables of a catalog: upserts, deletes, latest rows, differences, orphans, running totals, islands."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.sources.scratch import written


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` in place of ``old`` ones with their keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``, which must end with a unique column."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth = 1").drop("nth")


def difference(a: DataFrame, b: DataFrame, key: str, content: str) -> DataFrame:
    """key, change: added, removed or changed from ``a`` to ``b``."""
    old, new = a.select(key, F.col(content).alias("was")), b.select(key, F.col(content).alias("now"))
    both = old.withColumn("in_old", F.lit(True)).join(new.withColumn("in_new", F.lit(True)), key, "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def valid_parents(catalog: DataFrame, versions: DataFrame, jobs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` that data may belong to: those of the catalog, of ``versions`` (state) that are being built, and of ``jobs``
    (status) that wait or run."""
    building, at_work = versions.where("state = 'Building'"), jobs.where("status IN ('Queued', 'Running')")
    return catalog.select(*keys).unionByName(building.select(*keys)).unionByName(at_work.select(*keys)).distinct()


def orphans(tables: dict[str, DataFrame], parents: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that no parent has, with the number of rows in each table."""
    tagged = None
    for name, df in tables.items():
        part = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    lost = tagged.join(parents.select(*keys).distinct(), keys, "left_anti")
    return lost.groupBy(*keys).agg(*[F.sum(F.when(F.col("place") == t, F.col("n")).otherwise(0)).alias(f"in_{t}") for t in tables])


def conditional(df: DataFrame, clauses: dict[str, Column | None], limit: int | None = None) -> DataFrame:
    """All given clauses together; none given: no rows."""
    given = [c for c in clauses.values() if c is not None]
    if not given:
        return df.where("false")
    for c in given:
        df = df.where(c)
    return df if limit is None else df.limit(limit if limit > 0 else 50)


def running_totals(rows: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds, for each of ``sums`` (name: column), the sum of the column up to each row in ``order``.

    Rows are range-partitioned, summed in their partitions, and shifted by the sums of those before: no partition holds all.
    """
    ranged = written(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    totals = ranged.groupBy("range").agg(*[F.sum(c).alias(f"all_{n}") for n, c in sums.items()])
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = totals.select("range", *[F.coalesce(F.sum(f"all_{n}").over(earlier), F.lit(0)).alias(f"base_{n}") for n in sums])
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = ranged.join(before, "range")
    return met.select(*rows.columns, *[(F.sum(c).over(inside) + F.col(f"base_{n}")).alias(n) for n, c in sums.items()])


def running_total(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """Adds ``total``, the sum of ``value`` up to each row in ``order``."""
    return running_totals(rows, order, {"total": value})


def islands(lines: DataFrame, file: str, number: str, starts: Column) -> DataFrame:
    """``lines`` with the entry that each belongs to: an entry begins where ``starts`` holds."""
    order = Window.partitionBy(file).orderBy(number)
    return lines.withColumn("entry", F.sum(starts.cast("int")).over(order))


def rates(samples: DataFrame, key: str, at: str, counter: str) -> DataFrame:
    """Adds rate: the counter's change a second since the row before; 0 on the first and where time stands still."""
    order = Window.partitionBy(key).orderBy(at, counter)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    dt = micros(F.col(at)) - micros(F.lag(at).over(order))
    change = F.col(counter) - F.lag(counter).over(order)
    return samples.withColumn("rate", F.when(dt > 0, change / (dt / 1e6)).otherwise(F.lit(0.0)))


def third(index: Column, n: Column) -> Column:
    """0, 1 or 2; what is left over goes to the last third."""
    return F.least(F.floor(index / F.greatest(F.floor(n / 3), F.lit(1))), F.lit(2)).cast("int")


def repointed(versions: DataFrame, deleted: str) -> DataFrame:
    """library_id, current after ``deleted`` versions go: the latest of the rest that is published, where ``versions`` have a state;
    libraries without one go."""
    rest = versions.where(F.col("version") != deleted)
    rest = rest.where("state = 'Published'") if "state" in versions.columns else rest
    return rest.groupBy("library_id").agg(F.max_by("version", F.struct("scraped_at", "version")).alias("current"))


#: Beginnings of packages that are tools or parts of a platform, by ecosystem. Fixed values.
TOOLS = {
    "nuget": ("Microsoft.Extensions.", "Microsoft.AspNetCore.", "Microsoft.EntityFrameworkCore.", "System.", "Microsoft.NET.", "Microsoft.NETCore.", "NETStandard.", "xunit", "NUnit", "Moq", "FluentAssertions", "coverlet.", "Microsoft.TestPlatform", "MSTest.", "CodeStructure.Analyzers"),
    "npm": ("@types/", "eslint", "prettier", "typescript", "webpack", "jest", "mocha", "babel", "postcss", "autoprefixer", "vite", "rollup"),
    "pip": ("setuptools", "pip", "wheel", "pytest", "black", "flake8", "mypy", "pylint", "isort", "tox", "coverage", "twine"),
}


def is_tool(package: Column, ecosystem: Column) -> Column:
    """Whether a package begins, in any case, as one of its ecosystem's ``TOOLS``; packages of other ecosystems don't."""
    begins = {e: F.lower(package).rlike("^(?:" + "|".join(re.escape(p.lower()) for p in prefixes) + ")") for e, prefixes in TOOLS.items()}
    return F.coalesce(*[F.when(ecosystem == e, b) for e, b in begins.items()], F.lit(False))


def dependency_status(packages: DataFrame, libraries: DataFrame, skipped: list[str], failed: Column | None = None) -> DataFrame:
    """package_id, version, status: filtered by prefix, cached, cached in another version, failed, or queued.

    ``libraries``: library_id, version, a row for each version; ``failed``: of a package that could not be queued.
    """
    known = libraries.groupBy("library_id").agg(F.collect_set("version").alias("versions"))
    joined = packages.join(known, F.lower(packages["package_id"]) == F.lower(known["library_id"]), "left")
    drop = F.lower("package_id").rlike("^(?:" + "|".join(p.lower().replace(".", r"\.") for p in skipped) + ")") if skipped else F.lit(False)
    status = F.when(drop, "filtered").when(F.array_contains("versions", F.col("version")), "cached").when(F.col("versions").isNotNull(), "cached-different-version").when(F.lit(False) if failed is None else failed, "failed").otherwise("queued")
    return joined.select("package_id", "version", status.alias("status"))


def scoped(rows: DataFrame, library: str | None = None, version: str | None = None) -> DataFrame:
    """Rows of a library, of one version of it, or all; over a table with those folders, only theirs are read."""
    rows = rows if library is None else rows.where(F.col("library_id") == library)
    return rows if version is None else rows.where(F.col("version") == version)


def lookup(rows: DataFrame, **keys) -> DataFrame:
    """The row of a key, or none."""
    for name, value in keys.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows.limit(1)


def updated(rows: DataFrame, where: Column, column: str, value: Column) -> DataFrame:
    return rows.withColumn(column, F.when(F.coalesce(where, F.lit(False)), value).otherwise(F.col(column)))


def deleted(rows: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """What stays, and one row with the number of rows that go."""
    hit = F.coalesce(where, F.lit(False))
    return rows.where(~hit), rows.agg(F.count_if(hit).alias("deleted"))


def has_stale(rows: DataFrame, column: str, current: int) -> DataFrame:
    """One row: whether any of ``rows`` is older than ``current``."""
    return rows.agg(F.coalesce(F.bool_or(F.col(column) < current), F.lit(False)).alias("stale"))


def resolved_versions(asked: DataFrame, libraries: DataFrame, versions: DataFrame) -> DataFrame:
    """library_id, asked, version: the version asked for, else the library's current one, if it is published; else null.

    ``asked``: library_id, asked; ``libraries``: library_id, current; ``versions``: library_id, version, state.
    """
    wanted = asked.join(libraries, "library_id", "left").withColumn("version", F.coalesce(F.nullif("asked", F.lit("")), "current"))
    published = versions.where("state = 'Published'").select("library_id", "version", F.lit(True).alias("ok")).distinct()
    return wanted.join(published, ["library_id", "version"], "left").select("library_id", "asked", F.when(F.col("ok"), F.col("version")).alias("version"))


def selected_versions(versions: DataFrame, selector: str | list[str] | None) -> DataFrame:
    """``versions`` (library_id, version, is_current) by "current" (also for none), "all" or a list; ValueError for another
    word, an empty list, or versions that no row has."""
    if isinstance(selector, list):
        if not selector:
            raise ValueError("the list of versions is empty; say current or all")
        found = {r["version"] for r in versions.where(F.col("version").isin(selector)).select("version").distinct().collect()}
        if missing := [v for v in selector if v not in found]:
            raise ValueError(f"versions that are not there: {', '.join(missing)}")
        return versions.where(F.col("version").isin(selector))
    word = (selector or "current").strip().lower()
    if word not in ("", "current", "all"):
        raise ValueError(f"unknown selector {selector!r}; say current, all, or a list")
    return versions if word == "all" else versions.where("is_current")


def renamed_parameter(new, old, name: str):
    """The value of a parameter that has two names; ValueError if both are given and differ."""
    if new is not None and old is not None and new != old:
        raise ValueError(f"{name} is given twice, with different values")
    return new if new is not None else old


def previous_versions(versions: DataFrame) -> DataFrame:
    """library_id, version, previous of ``versions`` (library_id, versions array, in order): null for the first."""
    each = versions.select("library_id", "versions", F.posexplode("versions").alias("nth", "version"))
    return each.select("library_id", "version", F.when(F.col("nth") > 0, F.get("versions", F.col("nth") - 1)).alias("previous"))


def endpoints(diffs: DataFrame) -> DataFrame:
    """library_id, version: both ends of ``diffs`` (library_id, from_version, to_version), each once."""
    return diffs.select("library_id", F.explode(F.array("from_version", "to_version")).alias("version")).distinct()


def cascaded(tables: dict[str, DataFrame], library: str, version: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table without a version, and place, deleted: how many rows of each went."""
    gone = (F.col("library_id") == library) & (F.col("version") == version)
    counts = [df.agg(F.count_if(gone).alias("deleted")).select(F.lit(name).alias("place"), "deleted") for name, df in tables.items()]
    report = counts[0]
    for c in counts[1:]:
        report = report.unionByName(c)
    return {name: df.where(~F.coalesce(gone, F.lit(False))) for name, df in tables.items()}, report


def unreferenced(revisions: DataFrame, deleting: DataFrame) -> DataFrame:
    """hash: artifacts of the revisions that go (``deleting``: id) which no other of ``revisions`` (id, original, extraction) names."""
    hashes = lambda rows: rows.select(F.explode(F.array_compact(F.array("original", "extraction"))).alias("hash"))
    going = deleting.select("id").distinct()
    return hashes(revisions.join(going, "id", "left_semi")).distinct().join(hashes(revisions.join(going, "id", "left_anti")), "hash", "left_anti")


def reuse(documents: DataFrame, prior: DataFrame) -> DataFrame:
    """path, extraction, vectors: what of a document can be taken from the run before.

    ``documents`` and ``prior``: path, source_hash, media_type, fingerprint, inputs (texts to embed, in order).  An extraction is
    reused if source, media type (in any case) and fingerprint are the same, vectors if the texts to embed are.
    """
    old = prior.select("path", *[F.col(c).alias(f"old_{c}") for c in ("source_hash", "media_type", "fingerprint", "inputs")])
    met = documents.join(old, "path", "left")
    same = (F.col("source_hash") == F.col("old_source_hash")) & (F.lower("media_type") == F.lower("old_media_type")) & (F.col("fingerprint") == F.col("old_fingerprint"))
    return met.select("path", F.coalesce(same, F.lit(False)).alias("extraction"), F.coalesce(F.col("inputs") == F.col("old_inputs"), F.lit(False)).alias("vectors"))


def collisions(files: DataFrame, identity: Column, shown: str) -> DataFrame:
    """``files`` with reason: of files whose paths are the same by ``identity``, all but the first by ``shown`` collide."""
    nth = F.row_number().over(Window.partitionBy("same").orderBy(shown))
    return files.withColumn("same", identity).withColumn("nth", nth).withColumn("reason", F.when(F.col("nth") > 1, "PathIdentityCollision")).drop("same", "nth")


def outside_namespace(rows: DataFrame, key: str) -> DataFrame:
    """key, problem of ids that are repeated, or don't begin with their library and version."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.startswith(F.col(key), F.concat_ws("/", "library_id", "version", F.lit("")))).alias("inside"))
    return counts.select(key, F.when(F.col("n") > 1, "Repeated").when(~F.coalesce("inside", F.lit(False)), "OutsideNamespace").alias("problem")).where("problem IS NOT NULL")


def wrong_vectors(rows: DataFrame, dims: int) -> DataFrame:
    """One row: vectors, those of another length than ``dims``, and bytes that all should have."""
    return rows.agg(F.count(F.lit(1)).alias("vectors"), F.count_if(~F.coalesce(F.size("embedding") == dims, F.lit(False))).alias("wrong"), (F.count(F.lit(1)) * dims * 4).alias("bytes"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with at, their place in ``order``, from 0: for zips by place, which physical order must not decide."""
    return running_total(rows.withColumn("one", F.lit(1).cast("long")), order, "one").withColumn("at", F.col("total") - 1).drop("one", "total")


def zipped(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of equal place (``numbered``); ValueError if one has more than the other."""
    if a.count() != b.count():
        raise ValueError("tables to be zipped differ in length")
    return a.join(b, "at")


def documentation_url(package: Column, homepage: Column, repository: Column, reachable: Column) -> Column:
    """Struct (url, source, confidence): the homepage unless it is a repository, the repository, else the first guess of which
    ``reachable`` (an array of URLs) holds one."""
    name = F.lower(package)
    guesses = [F.concat(F.lit(a), name, F.lit(b)) for a, b in (("https://", ".readthedocs.io"), ("https://docs.", ".io"), ("https://", ".github.io"), ("https://", ".dev"))]
    guess = F.coalesce(*[F.when(F.array_contains(reachable, g), g) for g in guesses])
    is_repo = homepage.rlike(r"(?i)^https?://(www\.)?github\.com/")
    is_home = F.coalesce((homepage != "") & ~is_repo, F.lit(False))
    made = lambda url, source, confidence: F.struct(url.alias("url"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))
    return F.when(is_home, made(homepage, "registry", "High")).when(F.coalesce(repository != "", F.lit(False)), made(repository, "github-repo", "Medium")).when(guess.isNotNull(), made(guess, "pattern", "Low")).otherwise(
        made(F.lit(None).cast("string"), "none", "Low")
    )


def corrected(tables: dict[str, DataFrame], versions: DataFrame, library: str, version: str, url: str) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """After a wrong root URL: each table without the version, ``versions`` with it no longer suspect, and the scrape to queue."""
    stays, _ = cascaded(tables, library, version)
    own = (F.col("library_id") == library) & (F.col("version") == version)
    reset = updated(updated(versions, own, "suspect", F.lit(False)), own, "reasons", F.array().cast("array<string>"))
    queued = versions.where(own).limit(1).select("library_id", "version", F.lit("Scrape").alias("job_type"), F.lit("Queued").alias("status"), F.lit(url).alias("url"))
    return stays, reset, queued


def snapshots(revisions: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """revision_id, pages, chunks: how many rows published ``revisions`` (revision_id, state) have, if they have both."""
    count = lambda rows, name: rows.groupBy("revision_id").agg(F.count(F.lit(1)).alias(name))
    return revisions.where("state = 'Published'").select("revision_id").join(count(pages, "pages"), "revision_id").join(count(chunks, "chunks"), "revision_id")


def compared_counts(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, before, after: rows of each key in two tables, 0 where one has none."""
    count = lambda rows, name: rows.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    met = count(before, "before").join(count(after, "after"), key, "full_outer")
    return met.select(key, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("before", "after")])
