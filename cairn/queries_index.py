"""Queries of index segments and of streams into them, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import bm25, segments
from cairn.queries import NORMAL_SQL, POSTINGS_SQL, TEXT_QUERY, chunks, query, table
from cairn.sources.scratch import folder
from cairn.streaming import pages

REPLACED_SQL = "SELECT doc_id, source, lang, CASE WHEN source = 'src1' AND lang = 'en' THEN 'the ' || substr(text, 1, length(text) // 2) ELSE text END AS text FROM documents WHERE NOT (source = 'src2' AND lang = 'de')"


def versions(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).withColumnRenamed("category", "version")


def replaced(spark: SparkSession, d: str) -> segments.Index:
    """An index of all documents, in which one version was replaced and one taken out, each as a load of its own."""
    rows = versions(spark, d)
    index = segments.build(rows, folder(spark))
    shorter = F.concat(F.lit("the "), F.substring("content", F.lit(1), F.floor(F.length("content") / 2).cast("int")))
    index.load(rows.where("library_id = 'src1' AND version = 'en'").withColumn("content", shorter))
    index.remove(spark.createDataFrame([("src2", "de")], "library_id string, version string"))
    return index


@query(f"WITH {POSTINGS_SQL.replace('FROM documents', f'FROM ({REPLACED_SQL})')} SELECT chunk_id, round(bm25, 6) AS bm25 FROM scores")
def replaced_version_search(spark, d):
    return bm25.search(replaced(spark, d), TEXT_QUERY).select("chunk_id", F.round("bm25", 6).alias("bm25"))


@query(f"WITH {POSTINGS_SQL.replace('FROM documents', f'FROM ({REPLACED_SQL})')} SELECT source AS library_id, lang AS version, count(*) AS n_docs, CAST(sum(doc_length) AS BIGINT) AS total_length FROM lengths JOIN documents ON doc_id = chunk_id GROUP BY ALL")
def merged_manifest(spark, d):
    """Segments merged, and what nobody reads removed: facts of all pairs stay."""
    index = replaced(spark, d)
    index.merge()
    index.vacuum()
    return index.manifest.where("n_docs > 0").select("library_id", "version", "n_docs", "total_length")


def arrivals(rows: DataFrame, nth, n: int, target: str) -> Iterator[str]:
    """``rows`` in ``n`` folders below ``target`` that arrive one after another, by ``nth``, in as many files as they are read in.

    What all of them match comes with each: a stream that then takes what is there makes one micro-batch of an arrival.
    """
    for i in range(n):
        rows.where(nth == i).write.parquet(f"{target}/{i}")
        yield f"{target}/*"


@query(f"WITH {POSTINGS_SQL} SELECT chunk_id, round(bm25, 6) AS bm25 FROM scores")
def streamed_search(spark, d):
    """Documents that arrive in four micro-batches, each a segment, found by a search of the index."""
    rows = versions(spark, d)
    index, checkpoint = segments.Index(spark, folder(spark)), folder(spark)
    for arrived in arrivals(rows, F.pmod(F.xxhash64("chunk_id"), F.lit(4)), 4, folder(spark)):
        pages.index_chunks(spark.readStream.schema(rows.schema).parquet(arrived), index, checkpoint).awaitTermination()
    return bm25.search(index, TEXT_QUERY).select("chunk_id", F.round("bm25", 6).alias("bm25"))


@query(f"""WITH p AS (SELECT page_id, {NORMAL_SQL} AS url, page_id % 3 AS nth, page_id % 11 = 0 AS broken FROM pages),
g AS (SELECT *, row_number() OVER (PARTITION BY url, broken OR url IS NULL ORDER BY nth, page_id) AS place FROM p)
SELECT page_id, url, CASE WHEN url IS NULL THEN 'NoUrl' WHEN broken THEN 'Parse' WHEN place > 1 THEN 'Seen' ELSE 'Indexed' END AS outcome FROM g""")
def streamed_pages(spark, d):
    """Pages that arrive in three micro-batches; every eleventh one breaks the parser."""
    rows = table(spark, d, "pages").select("page_id", "url", F.when(F.col("page_id") % 11 == 0, F.concat("html", F.lit("<![broken[ >"))).otherwise(F.col("html")).alias("html"))
    target, checkpoint = folder(spark), folder(spark)
    for arrived in arrivals(rows, F.col("page_id") % 3, 3, folder(spark)):
        pages.ingest(pages.read_pages(spark, arrived, 1_000_000), target, checkpoint).awaitTermination()
    new = spark.read.schema("page_id long, url string").parquet(f"{target}/new").select("page_id", "url", F.lit("Indexed").alias("outcome"))
    no = spark.read.schema("page_id long, url string, stage string, reason string").parquet(f"{target}/rejected")
    return new.unionByName(no.select("page_id", "url", F.when(F.col("stage") == "Parse", "Parse").otherwise(F.col("reason")).alias("outcome")))
