"""Queries of stored tables: scopes, renames, imports and what they queue; and the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import vectors
from cairn.queries import COSINE_SQL, first_vector, query, table
from cairn.sources.scratch import folder
from cairn.sources.tables import Tables, drain, gates, import_rows

SCOPES_SQL = "SELECT chunk_id, cosine, round(cosine, 6) AS shown FROM cosines JOIN embeddings ON vec_id = chunk_id WHERE label % 2 = 0"


@query(f"""WITH {COSINE_SQL}, s AS ({SCOPES_SQL}), l AS (SELECT s.* FROM s JOIN embeddings ON vec_id = chunk_id WHERE label = 4), v AS (SELECT * FROM l WHERE chunk_id % 3 = 1)
SELECT 'profile' AS scope, chunk_id, shown AS cosine FROM (SELECT * FROM s ORDER BY shown DESC, chunk_id LIMIT 5) UNION ALL SELECT 'library', chunk_id, shown FROM (SELECT * FROM l ORDER BY shown DESC, chunk_id LIMIT 5)
UNION ALL SELECT 'version', chunk_id, shown FROM (SELECT * FROM v ORDER BY shown DESC, chunk_id LIMIT 5)""")
def vector_scopes(spark, d):
    """The nearest vectors in one version, in all versions of a library, and in a whole profile of a stored index."""
    path = folder(spark)
    rows = table(spark, d, "embeddings").where("embedding IS NOT NULL AND label IS NOT NULL").select(F.col("vec_id").cast("long").alias("chunk_id"), F.col("embedding").cast("array<float>").alias("embedding"), (F.col("label") % 2).cast("string").alias("profile"), F.col("label").cast("string").alias("library_id"), (F.col("vec_id") % 3).cast("string").alias("version"))
    vectors.stored(rows, path)
    q, out = first_vector(spark, d), None
    for scope, args in (("profile", ("0",)), ("library", ("0", "4")), ("version", ("0", "4", "1"))):
        found = vectors.top_k(vectors.scoped(spark, path, *args), q, 5).select(F.lit(scope).alias("scope"), "chunk_id", F.round("cosine", 6).alias("cosine"))
        out = found if out is None else out.unionByName(found)
    return out


def library_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("library_id"), F.col("lang").alias("version"), "doc_id", F.col("text").alias("content"))
    return docs.withColumn("chunk_id", F.concat_ws("/", "library_id", "version", F.col("doc_id").cast("string")))


@query("""WITH r AS (SELECT CASE WHEN source = 'src3' THEN 'renamed' ELSE source END AS library_id, CASE WHEN source = 'src1' AND lang = 'en' THEN 'en2' ELSE lang END AS version, doc_id FROM documents)
SELECT 'chunks' AS name, library_id || '/' || version || '/' || doc_id AS id, library_id, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'pages', library_id || '/' || version || '/p', library_id, count(*) FROM r GROUP BY ALL""")
def rename_library(spark, d):
    """A library and a version renamed in two stored tables."""
    tables, rows = Tables(spark, folder(spark)), library_rows(spark, d)
    pages = rows.select("library_id", "version", F.concat_ws("/", "library_id", "version", F.lit("p")).alias("page_id"))
    tables.put({"chunks": rows.drop("doc_id", "content"), "pages": pages})
    tables.rename("src3", "renamed")
    tables.rename("src1", "src1", ("en", "en2"))
    count = lambda name, c: tables.read(name).groupBy(F.lit(name).alias("name"), F.col(c).alias("id"), "library_id").agg(F.count(F.lit(1)).alias("n"))
    return count("chunks", "chunk_id").unionByName(count("pages", "page_id"))


IMPORT_SQL = "v AS (SELECT DISTINCT source, lang FROM documents), j AS (SELECT source, lang, count(*) AS n FROM documents WHERE doc_id % 17 = 0 GROUP BY ALL)"


@query(f"""WITH {IMPORT_SQL} SELECT count(*) AS versions, count(*) FILTER (lang = 'en') AS conflicts, CAST(coalesce(sum(n), 0) AS BIGINT) AS at_work, count(*) FILTER (lang IN ('de', 'fr')) AS "foreign" FROM v LEFT JOIN j USING (source, lang)""")
def import_gates(spark, d):
    rows = library_rows(spark, d)
    incoming = rows.select("library_id", "version", F.when(F.col("version").isin("de", "fr"), "e2").otherwise("e1").alias("encoder"))
    jobs = rows.where("doc_id % 17 = 0").select("library_id", "version", F.when(F.col("doc_id") % 2 == 0, "Queued").otherwise("Running").alias("status"))
    done = rows.select("library_id", "version", F.lit("Completed").alias("status"))
    return gates(incoming, rows.where("version = 'en'"), jobs.unionByName(done), "e1")


@query("SELECT source || '/' || lang || '/' || doc_id AS chunk_id, 'e1' AS encoder, CAST(CASE WHEN lang IN ('de', 'fr') THEN length(text) ELSE doc_id END AS DOUBLE) AS first FROM documents")
def import_and_embed(spark, d):
    """Versions of another encoder are imported without vectors, queued, and embedded from their contents."""
    tables = Tables(spark, folder(spark))
    rows = library_rows(spark, d).withColumn("encoder", F.when(F.col("version").isin("de", "fr"), "e2").otherwise("e1")).withColumn("embedding", F.array(F.col("doc_id").cast("double")))
    jobs = spark.createDataFrame([], "library_id string, version string, status string")
    import_rows(tables, rows.where("version = 'en'").drop("doc_id"), jobs, "e1")
    import_rows(tables, rows.drop("doc_id"), jobs, "e1", overwrite=True)
    drain(tables, lambda content: F.array(F.length(content).cast("double")), "e1")
    return tables.read("chunks").select("chunk_id", "encoder", F.get("embedding", F.lit(0)).alias("first"))
