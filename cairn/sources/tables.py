"""Tables of libraries in folders by library, told by a manifest: renames that go on after a stop, gated imports, a queue to embed.

The rows of a library in a table lie in a folder of their own, which is never changed.  A generation of the manifest names the folders
of all tables, so what changes several tables is seen in all of them at once, when the next generation is there.

A rename writes the library's rows, table by table, under their new names, and notes each table that is done in a journal.  A
rename that was stopped is asked for again and goes on with the tables that the journal lacks; readers see the old names
until the last step.  One writer at a time.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources import paths
from cairn.sources.scratch import written

FOLDERS = "table string, library_id string, folder string, schema string"
#: Jobs with these states are still at work. Fixed values.
AT_WORK = ("Queued", "Running")


class Tables:
    """Tables with a library_id, and perhaps a version and ids that begin with ``library/version/``, below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _generation(self) -> int:
        found = (int(n.split("=")[1]) for n in paths.children(self.spark, f"{self.root}/manifest"))
        return next((n for n in sorted(found, reverse=True) if paths.exists(self.spark, f"{self.root}/manifest/generation={n}/_SUCCESS")), -1)

    def folders(self) -> list[dict]:
        """table, library_id, folder and schema: a row for each library of each table."""
        n = self._generation()
        return [] if n < 0 else [r.asDict() for r in self.spark.read.schema(FOLDERS).parquet(f"{self.root}/manifest/generation={n}").collect()]

    def _commit(self, rows: list[dict]) -> None:
        order = FOLDERS.replace(" string", "").split(", ")
        df = self.spark.createDataFrame([tuple(r[c] for c in order) for r in rows], FOLDERS)
        df.coalesce(1).write.parquet(f"{self.root}/manifest/generation={self._generation() + 1}")

    def libraries(self) -> set[str]:
        return {r["library_id"] for r in self.folders()}

    def read(self, table: str, library: str | None = None) -> DataFrame:
        """Rows of a table, of one library or all: only their folders are listed and read."""
        own = [r for r in self.folders() if r["table"] == table and library in (None, r["library_id"])]
        if not own:
            raise ValueError(f"no rows of {table}")
        return self.spark.read.schema(own[0]["schema"]).parquet(*[r["folder"] for r in own])

    def _write(self, table: str, library: str, rows: DataFrame) -> dict:
        folder = f"{self.root}/{table}/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return {"table": table, "library_id": library, "folder": folder, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)}

    def put(self, tables: dict[str, DataFrame]) -> None:
        """Replaces the libraries of ``tables``' rows in each of them, all at once."""
        new = []
        for name, rows in tables.items():
            rows = written(rows)
            new += [self._write(name, r["library_id"], rows.where(F.col("library_id") == r["library_id"])) for r in rows.select("library_id").distinct().collect()]
        replaced = {(r["table"], r["library_id"]) for r in new}
        self._commit([r for r in self.folders() if (r["table"], r["library_id"]) not in replaced] + new)

    def rename(self, old: str, new: str, version: tuple[str, str] | None = None, after: Callable[[str], None] | None = None) -> dict[str, int]:
        """Renames a library, or with ``version`` (old, new) one version of it, in every table; the rows of each table.

        ValueError if the library or version isn't there, if the new one is, or if another rename of the library was stopped and
        has to be finished first.  ``after`` is called with each table that is done.
        """
        to = ("library", old, new) if version is None else ("version", old, *version)
        own = [r for r in self.folders() if r["library_id"] == old]
        journal, name = f"{self.root}/renames/{hashlib.sha256(old.encode()).hexdigest()[:16]}", hashlib.sha256("/".join(to).encode()).hexdigest()[:16]
        begun = [n for n in paths.children(self.spark, journal) if n != name]
        if begun:
            raise ValueError(f"another rename of {old} was begun and has to be finished first")
        if not own:
            raise ValueError(f"no library {old}")
        if version is None and new in self.libraries():
            raise ValueError(f"library {new} is there")
        has_version = [r for r in own if "`version`" in r["schema"]]
        if version is not None:
            there = lambda v: any(not self.spark.read.schema(r["schema"]).parquet(r["folder"]).where(F.col("version") == v).isEmpty() for r in has_version)
            if not there(version[0]):
                raise ValueError(f"no version {version[0]} of {old}")
            if there(version[1]):
                raise ValueError(f"version {version[1]} of {old} is there")
        noted = f"{journal}/{name}"
        done = {r["table"]: r.asDict() for r in self.spark.read.schema(FOLDERS).parquet(noted).collect()} if paths.exists(self.spark, noted) else {}
        for r in sorted(own if version is None else has_version, key=lambda r: r["table"]):
            if r["table"] in done:
                continue
            rows = self.spark.read.schema(r["schema"]).parquet(r["folder"])
            made = self._write(r["table"], new if version is None else old, renamed(rows, old, new, version))
            self.spark.createDataFrame([tuple(made.values())], FOLDERS).coalesce(1).write.mode("append").parquet(noted)
            done[r["table"]] = made
            if after is not None:
                after(r["table"])
        self._commit([r for r in self.folders() if r["library_id"] != old or (version is not None and r["table"] not in done)] + list(done.values()))
        paths.remove(self.spark, journal)
        return {t: self.spark.read.schema(r["schema"]).parquet(r["folder"]).count() for t, r in done.items()}


def renamed(rows: DataFrame, old: str, new: str, version: tuple[str, str] | None) -> DataFrame:
    """Rows of a library with its name, or its version's, and the ids that begin with them rewritten."""
    before, now = (f"{old}/", f"{new}/") if version is None else (f"{old}/{version[0]}/", f"{old}/{version[1]}/")
    hit = F.lit(True) if version is None else F.col("version") == version[0]
    for c in [c for c in rows.columns if c == "id" or c.endswith("_id")]:
        if c != "library_id" and rows.schema[c].dataType.simpleString() == "string":
            rows = rows.withColumn(c, F.when(hit & F.startswith(c, F.lit(before)), F.concat(F.lit(now), F.substring(c, F.lit(len(before) + 1), F.length(c)))).otherwise(F.col(c)))
    return rows.withColumn("library_id", F.lit(new)) if version is None else rows.withColumn("version", F.when(hit, F.lit(version[1])).otherwise(F.col("version")))


def gates(incoming: DataFrame, existing: DataFrame, jobs: DataFrame, encoder: str) -> DataFrame:
    """One row of what stands against an import: versions, conflicts (versions that are there), at_work (jobs on one of them), foreign
    (versions of another encoder).

    ``incoming``: library_id, version, encoder; ``existing``: library_id, version; ``jobs``: library_id, version, status.
    """
    pair = ["library_id", "version"]
    own = written(incoming.groupBy(*pair).agg(F.max("encoder").alias("encoder")))
    met = own.join(existing.select(*pair).distinct().withColumn("is_there", F.lit(True)), pair, "left")
    busy = jobs.where(F.col("status").isin(*AT_WORK)).groupBy(*pair).agg(F.count(F.lit(1)).alias("jobs"))
    met = met.join(busy, pair, "left")
    return met.agg(F.count(F.lit(1)).alias("versions"), F.count_if(F.col("is_there").isNotNull()).alias("conflicts"), F.coalesce(F.sum("jobs"), F.lit(0).cast("long")).alias("at_work"), F.count_if(~F.col("encoder").eqNullSafe(F.lit(encoder))).alias("foreign"))


def import_rows(tables: Tables, rows: DataFrame, jobs: DataFrame, encoder: str, overwrite: bool = False, chunks: str = "chunks", queue: str = "to_embed") -> dict:
    """Puts ``rows`` (library_id, version, chunk_id, content, encoder, embedding, ...) into a table, past its gates; their counts.

    ValueError if a job is at work on a version, or if a version is there and not to be overwritten.  Vectors of another encoder are
    left out, and their chunks put into the queue (library_id, version, chunk_id), in the same generation.
    """
    rows = written(rows)
    there = {r["table"] for r in tables.folders()}
    old = tables.read(chunks) if chunks in there else rows.limit(0)
    facts = gates(rows, old, jobs, encoder).first().asDict()
    if facts["at_work"]:
        raise ValueError(f"{facts['at_work']} jobs are at work on versions that are imported")
    if facts["conflicts"] and not overwrite:
        raise ValueError(f"{facts['conflicts']} versions are there")
    pair = ["library_id", "version"]
    incoming, libraries = rows.select(*pair).distinct(), rows.select("library_id").distinct()
    left = lambda t: t.join(libraries, "library_id", "left_semi").join(incoming, pair, "left_anti")
    own = F.col("encoder").eqNullSafe(F.lit(encoder))
    new = rows.withColumn("embedding", F.when(own, F.col("embedding"))).unionByName(left(old).select(*rows.columns))
    asked = rows.where(~own).select(*pair, "chunk_id")
    waiting = left(tables.read(queue)) if queue in there else asked.limit(0)
    tables.put({chunks: new, queue: asked.unionByName(waiting)})
    return facts


def drain(tables: Tables, embed: Callable[[Column], Column], encoder: str, chunks: str = "chunks", queue: str = "to_embed") -> int:
    """Embeds the contents of the queued chunks, without a prefix, and empties the queue; how many there were.

    Each different content is embedded once and sent back to its chunks by hash and text.
    """
    if queue not in {r["table"] for r in tables.folders()}:
        return 0
    asked = written(tables.read(queue).distinct())
    n = asked.count()
    keys = ["library_id", "version", "chunk_id"]
    rows = tables.read(chunks).join(asked.select("library_id").distinct(), "library_id", "left_semi")
    waiting = rows.join(asked, keys, "left_semi")
    vectors = written(waiting.select("content").distinct().select("content", embed(F.col("content")).alias("made")))
    done = waiting.join(vectors, "content").withColumn("embedding", F.col("made").cast(rows.schema["embedding"].dataType)).withColumn("encoder", F.lit(encoder)).select(*rows.columns)
    tables.put({chunks: rows.join(asked, keys, "left_anti").unionByName(done)})
    tables._commit([r for r in tables.folders() if r["table"] != queue])
    return n
