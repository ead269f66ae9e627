"""Queries of tables, jobs, reports and subjects over the driver's tables, and the same in SQL for DuckDB.

Sources stand for libraries and languages for versions of them, orders for jobs, lineitem for their rows, parts for packages,
events for audit rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions import web as W
from cairn.operators import catalog, jobs, reports, subjects, symbols
from cairn.queries import query, table
from cairn.sources import files
from cairn.sources.scratch import folder


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("library_id"), F.col("lang").alias("version"), "text", "n_chars")


def versions(spark: SparkSession, d: str) -> DataFrame:
    """library_id, version, scraped_at, pages, state: a version is published unless its number of documents ends in 0."""
    rows = documents(spark, d).groupBy("library_id", "version").agg(F.max("doc_id").alias("scraped_at"), F.count(F.lit(1)).alias("pages"), F.sum("n_chars").alias("chunks"))
    return rows.withColumn("state", F.when(F.col("pages") % 10 == 0, "Building").otherwise("Published"))


VERSIONS_SQL = """v AS (SELECT source AS library_id, lang AS version, max(doc_id) AS scraped_at, count(*) AS pages, CAST(sum(n_chars) AS BIGINT) AS chunks,
  CASE WHEN count(*) % 10 = 0 THEN 'Building' ELSE 'Published' END AS state FROM documents GROUP BY ALL),
l AS (SELECT library_id, arg_max(version, {'a': scraped_at, 'b': version}) AS current FROM v GROUP BY 1)"""


def libraries(spark: SparkSession, d: str) -> DataFrame:
    return versions(spark, d).groupBy("library_id").agg(F.max_by("version", F.struct("scraped_at", "version")).alias("current"))


# Scans and writes


@query("SELECT doc_id, CASE WHEN lang = 'de' AND doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS state FROM documents WHERE lang = 'de' AND (doc_id % 2 = 0) UNION ALL SELECT doc_id, 'old' FROM documents WHERE lang = 'en'")
def partition_replace(spark, d):
    """A table with a folder for each version: one version replaced by half of its rows, two read."""
    path = folder(spark)
    rows = documents(spark, d).select("doc_id", F.lit("all").alias("library_id"), "version").withColumn("state", F.lit("old"))
    rows.write.partitionBy("library_id", "version").parquet(path)
    files.replace_version(rows.where("version = 'de' AND doc_id % 2 = 0").withColumn("state", F.lit("new")), path)
    stored = spark.read.parquet(path)
    return catalog.scoped(stored, "all", "de").unionByName(catalog.scoped(stored, "all", "en")).select("doc_id", "state")


@query("SELECT doc_id, source, lang, n_chars FROM documents WHERE doc_id = 17")
def point_lookup(spark, d):
    return catalog.lookup(table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), doc_id=17)


@query("SELECT sha256(text) AS content FROM (SELECT doc_id, text FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 200)")
def content_sample(spark, d):
    rows = catalog.scoped(documents(spark, d), version="en").orderBy("doc_id").limit(reports.SAMPLE)
    return rows.select(F.sha2("text", 256).alias("content"))


@query("SELECT 'stays' AS kind, count(*) AS n FROM documents WHERE lang <> 'de' UNION ALL SELECT 'deleted', count(*) FROM documents WHERE lang = 'de'")
def delete_by_key(spark, d):
    stays, gone = catalog.deleted(documents(spark, d), F.col("version") == "de")
    return stays.agg(F.count(F.lit(1)).alias("n")).select(F.lit("stays").alias("kind"), "n").unionByName(gone.select(F.lit("deleted").alias("kind"), F.col("deleted").alias("n")))


@query("SELECT page_id, CASE WHEN url LIKE '%/en/%' THEN 'HowTo' ELSE 'Unclassified' END AS category FROM pages")
def conditional_update(spark, d):
    rows = table(spark, d, "pages").select("page_id", "url").withColumn("category", F.lit("Unclassified"))
    return catalog.updated(rows, F.col("url").contains("/en/"), "category", F.lit("HowTo")).select("page_id", "category")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY AND ts >= TIMESTAMP '2000-01-01'")
def ttl_unexpired(spark, d):
    rows = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    latest = F.lit(rows.agg(F.max("at")).first()[0])
    return files.unexpired(rows, "at", latest, 30).select("event_id")


@query("SELECT CASE WHEN o_orderstatus = 'O' THEN 'Queued' WHEN o_orderstatus = 'P' THEN 'Running' END AS status, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1")
def active_jobs(spark, d):
    return jobs.active(order_jobs(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def order_jobs(spark, d) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "Queued").when(F.col("o_orderstatus") == "P", "Running").otherwise("Done")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderpriority").alias("library_id"), F.col("o_orderdate").alias("created"), F.col("o_custkey").alias("owner"))


JOBS_SQL = "j AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'Queued' WHEN 'P' THEN 'Running' ELSE 'Done' END AS status, o_orderpriority AS library_id, o_orderdate AS created, o_custkey AS owner FROM orders)"


@query(f"WITH {JOBS_SQL}, recent AS (SELECT * FROM j ORDER BY created DESC, job_id LIMIT 200) SELECT job_id, status, library_id FROM recent WHERE status = 'Queued' AND contains(lower(library_id), 'high') ORDER BY created DESC, job_id LIMIT 100")
def job_list(spark, d):
    found = jobs.listed(order_jobs(spark, d), "created", "job_id", 100, status=F.col("status") == "Queued", library=F.lower("library_id").contains("high"))
    return found.select("job_id", "status", "library_id")


@query(f"""WITH {JOBS_SQL}, gone AS (SELECT job_id FROM j WHERE status = 'Done' AND library_id = '5-LOW' AND created < TIMESTAMP '1996-01-01')
SELECT job_id, (SELECT count(*) FROM lineitem WHERE l_orderkey = job_id) AS audit_rows FROM gone""")
def job_cleanup(spark, d):
    audit = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"))
    clauses = {"library": F.col("library_id") == "5-LOW", "before": F.col("created") < F.lit("1996-01-01").cast("timestamp_ntz"), "status": None}
    return jobs.cleaned(order_jobs(spark, d), audit, "job_id", clauses)[2]


@query(f"""WITH {JOBS_SQL} SELECT job_id, CASE WHEN status = 'Running' THEN 'IN_PROGRESS' WHEN owner % 11 = 0 THEN 'URL_SUSPECT' WHEN owner % 7 = 0 THEN 'RECON_NEEDED' WHEN owner % 5 = 0 THEN 'READY_TO_SCRAPE'
 WHEN owner % 3 = 0 THEN 'STALE' WHEN owner % 2 = 0 THEN 'READY_TO_SCRAPE' ELSE 'READY' END AS state FROM j""")
def ingest_states(spark, d):
    by = lambda n: F.col("owner") % n == 0
    state = jobs.ingest_state(F.col("status") == "Running", by(11), ~by(7), F.when(by(5), 0).otherwise(1), by(3), by(2))
    return order_jobs(spark, d).select("job_id", state.alias("state"))


@query("""SELECT key, kind, name, origin FROM (
 SELECT c_custkey AS key, 'customer' AS kind, c_name AS name, 'a' AS origin FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)
 UNION ALL SELECT s_suppkey, NULL, s_name, 'b' FROM supplier)""")
def jobs_unified(spark, d):
    customers, suppliers = table(spark, d, "customer"), table(spark, d, "supplier")
    name = F.when(F.col("c_custkey") % 13 != 0, F.col("c_name"))
    sources = {"a": (customers, {"key": F.col("c_custkey"), "name": name, "kind": F.lit("customer")}), "b": (suppliers, {"key": F.col("s_suppkey"), "name": F.col("s_name")})}
    return jobs.unified(sources, "key", F.col("name").isNotNull())[0].select("key", "kind", "name", "origin")


@query("SELECT c_custkey AS key, 'a' AS origin FROM customer WHERE c_custkey % 13 = 0")
def jobs_unfit(spark, d):
    name = F.when(F.col("c_custkey") % 13 != 0, F.col("c_name"))
    return jobs.unified({"a": (table(spark, d, "customer"), {"key": F.col("c_custkey"), "name": name})}, "key", F.col("name").isNotNull())[1].select("key", "origin")


# Filters


@query("SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(text, '[A-Za-z]+'), 'the')")
def array_membership(spark, d):
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    return table(spark, d, "documents").where(F.array_contains(words, "the")).select("doc_id")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a_') UNION ALL SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ed')")
def name_filter(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name")
    return symbols.named(rows, "p_name", "A_").unionByName(symbols.named(rows, "p_name", "ED"))


@query("SELECT count(*) FILTER (l_linenumber < 2) > 0 AS stale FROM lineitem")
def has_stale(spark, d):
    return catalog.has_stale(table(spark, d, "lineitem"), "l_linenumber", 2)


@query(r"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '(\?[^#]*)', 1) AS q FROM pages)
SELECT page_id, CASE WHEN p <> '' AND NOT ends_with(p, '/') AND NOT regexp_matches(lower(p), '\.(html|htm|aspx)$') THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || p || '.html' || q ELSE url END AS url FROM u""")
def known_extension(spark, d):
    return table(spark, d, "pages").select("page_id", W.with_extension(F.col("url"), ".html").alias("url"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN greatest(CAST(epoch(TIMESTAMP '2024-03-05 06:07:08') AS BIGINT) - CAST(epoch(TIMESTAMP '2024-03-05 06:00:00') AS BIGINT), 0) WHEN 2 THEN 0 END AS seconds,
 (event_id % 5 IN (1, 2, 3)) AS limited, CAST(least(5, 2 ** (event_id % 4)) AS INTEGER) AS backoff, (event_id % 6 = 0) OR (event_id % 20 >= 10 AND event_id % 20 > 10 * (event_id % 6)) AS failed FROM events""")
def crawl_verdicts(spark, d):
    e = F.col("event_id")
    header = F.when(e % 4 == 0, e.cast("string")).when(e % 4 == 1, "Tue, 05 Mar 2024 06:07:08 GMT").when(e % 4 == 2, "Tue, 05 Mar 2024 05:00:00 GMT").otherwise("soon")
    status = F.element_at(F.array(*map(F.lit, (200, 429, 503, 509, 404))), (e % 5 + 1).cast("int"))
    now = F.lit("2024-03-05 06:00:00").cast("timestamp")
    return table(spark, d, "events").select("event_id", W.retry_after(header, now).alias("seconds"), W.is_rate_limited(status, (509,)).alias("limited"), W.backoff_seconds(e % 4).alias("backoff"), W.failed_crawl(e % 6, e % 20).alias("failed"))


@query("SELECT p_partkey, regexp_matches(p_name || '.' || p_partkey, '^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$') AS safe FROM part")
def safe_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", T.is_safe_id(F.concat_ws(".", "p_name", F.col("p_partkey").cast("string"))).alias("safe"))


@query(f"WITH {VERSIONS_SQL} SELECT v.library_id, v.version, 'current' AS kind FROM v JOIN l ON l.library_id = v.library_id AND l.current = v.version UNION ALL SELECT library_id, version, 'list' FROM v WHERE version IN ('de', 'fr')")
def version_selection(spark, d):
    rows = versions(spark, d).join(libraries(spark, d), "library_id").select("library_id", "version", (F.col("version") == F.col("current")).alias("is_current"))
    one = catalog.selected_versions(rows, None).withColumn("kind", F.lit("current"))
    return one.unionByName(catalog.selected_versions(rows, ["de", "fr"]).withColumn("kind", F.lit("list"))).select("library_id", "version", "kind")


# Versions


@query(f"WITH {VERSIONS_SQL}, a AS (SELECT library_id, CASE WHEN library_id < 'src5' THEN 'de' ELSE '' END AS asked, current FROM l) SELECT a.library_id, asked, (SELECT v.version FROM v WHERE v.library_id = a.library_id AND v.version = coalesce(nullif(asked, ''), current) AND state = 'Published') AS version FROM a")
def version_resolve(spark, d):
    current = libraries(spark, d)
    asked = current.select("library_id", F.when(F.col("library_id") < "src5", "de").otherwise("").alias("asked"))
    return catalog.resolved_versions(asked, current, versions(spark, d))


@query(f"WITH {VERSIONS_SQL} SELECT library_id, version, lag(version) OVER (PARTITION BY library_id ORDER BY version) AS previous FROM v")
def previous_version(spark, d):
    listed = versions(spark, d).groupBy("library_id").agg(F.array_sort(F.collect_list("version")).alias("versions"))
    return catalog.previous_versions(listed)


@query(f"WITH {VERSIONS_SQL}, p AS (SELECT library_id, version, lag(version) OVER (PARTITION BY library_id ORDER BY version) AS previous FROM v) SELECT DISTINCT library_id, version FROM (SELECT library_id, version FROM p WHERE previous IS NOT NULL UNION ALL SELECT library_id, previous FROM p WHERE previous IS NOT NULL)")
def diff_endpoints(spark, d):
    steps = previous_version(spark, d).where("previous IS NOT NULL")
    return catalog.endpoints(steps.select("library_id", F.col("previous").alias("from_version"), F.col("version").alias("to_version")))


@query(f"WITH {VERSIONS_SQL} SELECT l.library_id, current, v.pages, v.chunks, (SELECT string_agg(w.version, ',' ORDER BY w.scraped_at DESC, w.version DESC) FROM v w WHERE w.library_id = l.library_id) AS versions FROM l LEFT JOIN v ON v.library_id = l.library_id AND v.version = l.current")
def library_summaries(spark, d):
    return reports.summaries(libraries(spark, d), versions(spark, d))


@query("SELECT 'documents' AS place, count(*) FILTER (source = 'src3' AND lang = 'en') AS deleted FROM documents UNION ALL SELECT 'lines', coalesce(sum(len(string_split(text, chr(10)))) FILTER (source = 'src3' AND lang = 'en'), 0)::BIGINT FROM documents")
def cascade_delete(spark, d):
    rows = documents(spark, d)
    lines = rows.select("library_id", "version", F.explode(F.split("text", "\n")).alias("line"))
    return catalog.cascaded({"documents": rows, "lines": lines}, "src3", "en")[1]


@query("""WITH r AS (SELECT doc_id AS id, md5(text) AS original, CASE WHEN doc_id % 3 <> 0 THEN md5(source || lang) END AS extraction FROM documents), g AS (SELECT * FROM r WHERE id % 4 = 0), k AS (SELECT * FROM r WHERE id % 4 <> 0)
SELECT DISTINCT hash FROM (SELECT original AS hash FROM g UNION ALL SELECT extraction FROM g) WHERE hash IS NOT NULL AND hash NOT IN (SELECT original FROM k UNION ALL SELECT extraction FROM k WHERE extraction IS NOT NULL)""")
def artifact_garbage(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("original"), F.when(F.col("doc_id") % 3 != 0, F.md5(F.concat("source", "lang"))).alias("extraction"))
    return catalog.unreferenced(rows, rows.where("id % 4 = 0"))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, doc_id % 2 = 0 AND doc_id % 3 <> 0 AS extraction, doc_id % 2 = 0 AND doc_id % 5 <> 0 AS vectors FROM documents")
def incremental_reuse(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("source_hash"), F.lit("text/PLAIN").alias("media_type"), F.lit("f1").alias("fingerprint"), F.array("source", "lang").alias("inputs"))
    prior = rows.where("doc_id % 2 = 0").withColumn("source_hash", F.when(F.col("doc_id") % 3 == 0, "other").otherwise(F.col("source_hash"))).withColumn("media_type", F.lower("media_type"))
    prior = prior.withColumn("inputs", F.when(F.col("doc_id") % 5 == 0, F.reverse("inputs")).otherwise(F.col("inputs")))
    return catalog.reuse(rows, prior)


@query("SELECT page_id, CASE WHEN row_number() OVER (PARTITION BY lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) ORDER BY page_id) > 1 THEN 'PathIdentityCollision' END AS reason FROM pages")
def path_collisions(spark, d):
    rows = table(spark, d, "pages").select("page_id", "url")
    return catalog.collisions(rows, F.coalesce(W.host(F.col("url")), F.lit("")), "page_id").select("page_id", "reason")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'https://site' || p_partkey || '.org' WHEN p_partkey % 4 IN (1, 2) THEN 'https://github.com/o/r' WHEN p_partkey % 8 = 3 THEN 'https://docs.part' || p_partkey || '.io' END AS url,
 CASE WHEN p_partkey % 4 = 0 THEN 'registry' WHEN p_partkey % 4 IN (1, 2) THEN 'github-repo' WHEN p_partkey % 8 = 3 THEN 'pattern' ELSE 'none' END AS source,
 CASE WHEN p_partkey % 4 = 0 THEN 'High' WHEN p_partkey % 4 IN (1, 2) THEN 'Medium' ELSE 'Low' END AS confidence FROM part""")
def documentation_urls(spark, d):
    k = F.col("p_partkey")
    name = F.concat(F.lit("Part"), k.cast("string"))
    home = F.when(k % 4 == 0, F.concat(F.lit("https://site"), k.cast("string"), F.lit(".org"))).when(k % 4 == 1, "https://GitHub.com/o/r")
    repo = F.when(k % 4 != 3, F.lit("https://github.com/o/r"))
    reachable = F.when(k % 8 == 3, F.array(F.concat(F.lit("https://"), F.lower(name), F.lit(".dev")), F.concat(F.lit("https://docs."), F.lower(name), F.lit(".io")))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select("p_partkey", catalog.documentation_url(name, home, repo, reachable).alias("u")).select("p_partkey", "u.*")


# Integrity


@query("""SELECT id, CASE WHEN count(*) > 1 THEN 'Repeated' ELSE 'OutsideNamespace' END AS problem FROM (
 SELECT CASE WHEN doc_id % 7 = 0 THEN 'src0/en/same' WHEN doc_id % 11 = 0 THEN 'x/' || doc_id ELSE source || '/' || lang || '/' || doc_id END AS id, doc_id % 11 = 0 AND doc_id % 7 <> 0 AS outside FROM documents)
GROUP BY id HAVING count(*) > 1 OR bool_or(outside) OR (id = 'src0/en/same' AND count(*) = 1)""")
def namespace_check(spark, d):
    own = F.concat_ws("/", "library_id", "version", F.col("doc_id").cast("string"))
    key = F.when(F.col("doc_id") % 7 == 0, "src0/en/same").when(F.col("doc_id") % 11 == 0, F.concat(F.lit("x/"), F.col("doc_id").cast("string"))).otherwise(own)
    return catalog.outside_namespace(documents(spark, d).withColumn("id", key), "id")


@query("SELECT count(*) AS vectors, count(*) FILTER (len(embedding) IS DISTINCT FROM 64) AS wrong, count(*) * 256 AS bytes FROM embeddings")
def vector_bytes(spark, d):
    return catalog.wrong_vectors(table(spark, d, "embeddings"), 64)


@query("SELECT a.doc_id, b.doc_id AS other FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS pos FROM documents) a JOIN (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS pos FROM documents) b USING (pos)")
def positional_zip(spark, d):
    """Documents in two orders, zipped by their places."""
    docs = table(spark, d, "documents")
    a = catalog.numbered(docs.select("doc_id"), ["doc_id"])
    b = catalog.numbered(docs.select("n_chars", F.col("doc_id").alias("other")), ["n_chars", "other"])
    return catalog.zipped(a, b).select("doc_id", "other")


# Reports


@query("SELECT DISTINCT source AS title FROM (SELECT source FROM documents ORDER BY doc_id LIMIT 50)")
def sample_titles(spark, d):
    return reports.titles(table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("title")), 50)


@query("SELECT user_id AS library_id, round(100.0 * count(*) FILTER (event_type = 'click') / greatest(count(*), 1), 6) AS pct, CASE WHEN 100.0 * count(*) FILTER (event_type = 'click') / count(*) >= 10 THEN 'rechunk_recommended' WHEN 100.0 * count(*) FILTER (event_type = 'click') / count(*) >= 5 THEN 'rechunk_may_help' END AS hint FROM events GROUP BY 1")
def boundary_share(spark, d):
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("library_id")).agg(F.count_if(F.col("event_type") == "click").alias("issues"), F.count(F.lit(1)).alias("n"))
    pct = reports.boundary_pct(F.col("issues"), F.col("n"))
    return rows.select("library_id", F.round(pct, 6).alias("pct"), reports.boundary_hint(pct).alias("hint"))


@query("SELECT lower(props) AS page, count(*) AS chunks, arg_max(event_type, event_id) AS category, arg_min(user_id, event_id) AS depth FROM events GROUP BY 1")
def page_chunk_counts(spark, d):
    return reports.page_counts(table(spark, d, "events").select(F.col("props").alias("url"), F.col("event_id").alias("nth"), F.col("event_type").alias("category"), F.col("user_id").alias("depth")))


@query(r"""WITH s AS (SELECT source, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents)
SELECT source AS library_id, count(*) AS rows, round(100.0 * (count(*) - count(DISTINCT t)) / count(*), 6) AS duplicate_pct, count(*) >= 5 AND 100.0 * (count(*) - count(DISTINCT t)) / count(*) >= 60 AS suspect FROM s WHERE place <= 200 GROUP BY 1""")
def sampled_duplicates(spark, d):
    rows = documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "library_id", F.col("text").alias("content"))
    return reports.sampled_duplicates(rows).withColumn("duplicate_pct", F.round("duplicate_pct", 6))


@query(r"""WITH h AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS place FROM h),
s AS (SELECT source, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents),
q AS (SELECT source, round(100.0 * (count(*) - count(DISTINCT t)) / count(*), 1) AS pct, count(*) >= 5 AND 100.0 * (count(*) - count(DISTINCT t)) / count(*) >= 60 AS bad FROM s WHERE place <= 200 GROUP BY 1)
SELECT r.source AS library_id, count(*) AS hosts, CAST(sum(n) AS BIGINT) AS chunks, string_agg(lang, ',' ORDER BY place) AS top_hosts, any_value(pct) AS duplicate_pct, any_value(bad) AS content_suspect,
 CASE WHEN sum(n) % 20 >= 10 THEN 'rechunk_recommended' WHEN sum(n) % 20 >= 5 THEN 'rechunk_may_help' END AS boundary_hint,
 CASE WHEN any_value(bad) THEN 'rescrape_library' WHEN sum(n) % 3 = 0 THEN 'submit_url_correction' WHEN sum(n) % 20 >= 10 THEN 'rechunk_library' END AS next_action FROM r JOIN q ON q.source = r.source GROUP BY 1""")
def health_snapshot(spark, d):
    rows = documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "library_id", F.col("version").alias("host"), F.col("text").alias("content"))
    known = rows.groupBy("library_id").agg(F.count(F.lit(1)).alias("n")).select("library_id", (F.col("n") % 3 == 0).alias("suspect"), (F.col("n") % 20).cast("double").alias("boundary_pct"))
    return reports.snapshot(known, rows).withColumn("top_hosts", F.array_join("top_hosts", ","))


@query(f"""WITH {VERSIONS_SQL}, {JOBS_SQL}, a AS (SELECT count(DISTINCT library_id) AS libraries, count(*) AS versions, least(count(*) FILTER (pages % 4 = 0), 20) AS suspects FROM v),
b AS (SELECT count(*) FILTER (status = 'Running' AND created < (SELECT max(created) FROM j) - INTERVAL 4 HOUR) AS stale_jobs FROM j)
SELECT libraries, versions, suspects, stale_jobs, CASE WHEN libraries = 0 THEN 'scrape_docs' WHEN suspects > 0 THEN 'submit_url_correction' WHEN stale_jobs > 0 THEN 'cancel_job' END AS next_action FROM a, b""")
def dashboard(spark, d):
    rows = order_jobs(spark, d).withColumn("last_progress", F.lit(None).cast("timestamp_ntz"))
    now = F.lit(rows.agg(F.max("created")).first()[0])
    return reports.dashboard(versions(spark, d).withColumn("suspect", F.col("pages") % 4 == 0), rows, now)


@query("""WITH p AS (SELECT event_id, event_type AS host, user_id % 5 AS depth, CASE WHEN event_id % 2 = 0 THEN 'HowTo' END AS category, event_id % 3 = 0 AS in_scope, CASE event_id % 7 WHEN 0 THEN 'Filtered' WHEN 1 THEN 'DepthLimited' WHEN 2 THEN 'Error' ELSE 'Fetched' END AS outcome,
 CASE WHEN event_id % 7 > 1 THEN user_id % 900 END AS fetched, CASE WHEN event_id % 7 > 2 THEN event_id % 40 END AS cut FROM events),
e AS (SELECT 'total' AS kind, 'pages' AS value, NULL::BIGINT AS ms FROM p UNION ALL SELECT 'total', CASE WHEN in_scope THEN 'in_scope' ELSE 'out_of_scope' END, NULL FROM p
 UNION ALL SELECT 'total', CASE outcome WHEN 'Filtered' THEN 'filtered' WHEN 'DepthLimited' THEN 'depth_limited' ELSE 'errors' END, NULL FROM p WHERE outcome <> 'Fetched'
 UNION ALL SELECT 'host', host, NULL FROM p UNION ALL SELECT 'depth', CAST(depth AS VARCHAR), NULL FROM p UNION ALL SELECT 'category', category, NULL FROM p
 UNION ALL SELECT 'stage', 'fetched', fetched FROM p WHERE fetched IS NOT NULL UNION ALL SELECT 'stage', 'cut', cut FROM p WHERE cut IS NOT NULL)
SELECT kind, value, count(*) AS n, CAST(sum(ms) AS BIGINT) AS ms FROM e GROUP BY ALL
UNION ALL (SELECT 'sample', CAST(event_id AS VARCHAR), row_number() OVER (ORDER BY host, event_id), coalesce(fetched, 0) + coalesce(cut, 0) FROM p ORDER BY host, event_id LIMIT 50)""")
def dry_run_report(spark, d):
    e = F.col("event_id")
    outcome = F.when(e % 7 == 0, "Filtered").when(e % 7 == 1, "DepthLimited").when(e % 7 == 2, "Error").otherwise("Fetched")
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("host"), (F.col("user_id") % 5).alias("depth"), F.when(e % 2 == 0, "HowTo").alias("category"), (e % 3 == 0).alias("in_scope"), outcome.alias("outcome"), F.when(e % 7 > 1, F.col("user_id") % 900).alias("fetched"), F.when(e % 7 > 2, e % 40).alias("cut"))
    return reports.dry_run(rows, ("fetched", "cut"), ["host", "event_id"])


@query("SELECT event_type, event_id, place, n, greatest(n - 3, 0) AS more FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE place <= 3")
def error_previews(spark, d):
    rows = reports.previews(table(spark, d, "events").select("event_type", "event_id"), "event_type", ["event_id"])
    return rows.select("event_type", "event_id", F.col("place").cast("long").alias("place"), "n", "more")


@query("SELECT count(*) AS total, count(*) FILTER (l_shipmode = 'x') AS x, count(*) FILTER (l_returnflag = 'R') AS r FROM (SELECT l_returnflag, 'x' AS l_shipmode FROM lineitem)")
def status_histogram(spark, d):
    flags = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", "r").otherwise("other").alias("flag"), F.lit("x").alias("mode"))
    modes = reports.histogram(flags, "mode", ("x",)).withColumn("k", F.lit(1))
    return modes.join(reports.histogram(flags, "flag", ("r",)).select("r", F.lit(1).alias("k")), "k").select("total", "x", "r")


@query("SELECT p_partkey, p_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY lower(p_name), p_partkey % 3 ORDER BY p_partkey) AS nth FROM part) WHERE nth = 1")
def dependency_first(spark, d):
    return reports.first_of_each(table(spark, d, "part").select("p_partkey", "p_name"), [F.lower("p_name"), F.col("p_partkey") % 3], ["p_partkey"])


@query("SELECT CAST(sum(s) AS BIGINT) AS size, CAST(sum(l) AS BIGINT) AS linenumber FROM (SELECT l_orderkey AS s, l_linenumber AS l FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'N')")
def deletion_totals(spark, d):
    rows = table(spark, d, "lineitem")
    part = lambda flag: reports.totals(rows.where(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("size"), F.col("l_linenumber").alias("linenumber")), ["size", "linenumber"])
    return reports.totals(part("A").unionByName(part("N")), ["size", "linenumber"])


@query("SELECT o_custkey AS table_id, string_agg(o_orderstatus || ' | ' || o_orderpriority, chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY 1")
def tables_rendered(spark, d):
    two = F.array(F.struct(F.lit(1).alias("col"), F.concat(F.lit(" "), "o_orderpriority").alias("text")), F.struct(F.lit(0).alias("col"), F.col("o_orderstatus").alias("text")))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("table_id"), F.col("o_orderkey").alias("row"), F.explode(two).alias("c"))
    return reports.rendered_tables(rows.select("table_id", "row", "c.col", "c.text"))


@query("SELECT event_type AS host, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, host LIMIT 20")
def top_hosts(spark, d):
    counts = table(spark, d, "events").groupBy(F.col("event_type").alias("host")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "host").limit(reports.HOSTS)


@query("SELECT page_id, row_number() OVER (ORDER BY lower(url), url, page_id) AS place FROM pages")
def sorted_urls(spark, d):
    rows = table(spark, d, "pages").select("page_id", "url")
    return catalog.numbered(rows.select("page_id", F.lower("url").alias("key"), "url"), ["key", "url", "page_id"]).select("page_id", (F.col("at") + 1).alias("place"))


# Sets


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 5")
def set_difference(spark, d):
    return table(spark, d, "part").select("p_partkey").join(table(spark, d, "lineitem").where("l_quantity < 5").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query("SELECT DISTINCT c_nationkey AS nation FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def set_intersection(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).join(table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")), "nation", "left_semi").distinct()


@query("""WITH p AS (SELECT source AS library_id, list_sort(list(DISTINCT lang)) AS langs FROM documents GROUP BY 1)
SELECT library_id, array_to_string(list_sort(list_distinct(list_concat(langs, ['de', 'xx']))), ',') AS likely, array_to_string(list_filter(['de', 'en', 'zz'], lambda x: x NOT IN ('de', 'xx')), ',') AS stoplist FROM p""")
def list_moves(spark, d):
    profiles = documents(spark, d).groupBy("library_id").agg(F.array_sort(F.collect_set("version")).alias("likely")).withColumn("stoplist", F.array(*map(F.lit, ("de", "en", "zz"))))
    rows = symbols.moved(profiles, ["de", "xx"], "likely")
    return rows.select("library_id", F.array_join(F.array_sort("likely"), ",").alias("likely"), F.array_join("stoplist", ",").alias("stoplist"))


@query(f"""WITH {VERSIONS_SQL}, p AS (SELECT library_id, version, scraped_at, CASE WHEN pages % 2 = 0 THEN version || '-stop' END AS stop FROM v)
SELECT library_id, version, coalesce(stop, (SELECT arg_max(q.stop, {{'a': q.scraped_at, 'b': q.version}}) FROM p q WHERE q.library_id = p.library_id AND q.version <> p.version AND q.stop IS NOT NULL), '') AS stoplist FROM p""")
def carry_forward(spark, d):
    own = F.when(F.col("pages") % 2 == 0, F.array(F.concat("version", F.lit("-stop")))).otherwise(F.array().cast("array<string>"))
    rows = versions(spark, d).select("library_id", "version", F.col("scraped_at").alias("created"), own.alias("stoplist"))
    return symbols.carried_forward(rows, "stoplist").select("library_id", "version", F.array_join("stoplist", ",").alias("stoplist"))


@query("SELECT doc_id AS chunk_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def changed_symbols(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.array("source", "lang").alias("symbols"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("name"), F.lit(2).alias("parser_version"), F.col("lang").alias("category"))
    after = rows.withColumn("symbols", F.when(F.col("chunk_id") % 3 == 0, F.slice("symbols", 2, 1)).otherwise(F.col("symbols"))).withColumn("category", F.when(F.col("chunk_id") % 5 == 0, F.lit(None)).otherwise(F.col("category")))
    return symbols.changed_symbols(rows, after)


@query("SELECT user_id, count(*) FILTER (event_type = 'click') >= 20 AND count(*) FILTER (event_type = 'click') / count(*) >= 0.05 AS hint FROM events GROUP BY 1")
def rescrub_hint(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("excluded"), F.count_if(F.col("event_type") != "click").alias("kept"))
    return rows.select("user_id", symbols.hint(F.col("excluded"), F.col("kept")).alias("hint"))


@query("""SELECT library_id, upper(sha256('{"languages":[' || string_agg('"' || lang || '"', ',' ORDER BY lang) || '],"library":"' || library_id || '"}')) AS hash FROM (SELECT DISTINCT source AS library_id, lang FROM documents) GROUP BY 1""")
def profile_hashes(spark, d):
    rows = documents(spark, d).groupBy("library_id").agg(F.collect_set("version").alias("languages"))
    return rows.select("library_id", symbols.profile_hash({"library": F.col("library_id"), "languages": F.array_sort("languages")}).alias("hash"))


# Subjects


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'HowTo' WHEN 1 THEN 'Sample' WHEN 2 THEN 'Unclassified' WHEN 3 THEN 'ApiReference' WHEN 4 THEN 'Unclassified' ELSE 'Code' END AS category,
 CAST(CASE event_id % 6 WHEN 0 THEN 0.75 WHEN 1 THEN 0.5 WHEN 2 THEN 0.9 WHEN 3 THEN 0.0 WHEN 4 THEN 0.0 ELSE 1.0 END AS DOUBLE) AS confidence,
 CASE event_id % 6 WHEN 0 THEN 'HowTo' WHEN 1 THEN 'Sample' WHEN 5 THEN 'Code' ELSE 'Unclassified' END AS accepted FROM events""")
def reply_categories(spark, d):
    replies = ('```json\n{"category": "howto", "confidence": 0.75}\n```', "it is a SAMPLE, or code", '{"category": "Novel", "confidence": 0.9}', '{"category": "ApiReference", "confidence": "high"}', "no idea", '{"confidence": 1, "category": "Code"}')
    reply = F.element_at(F.array(*map(F.lit, replies)), (F.col("event_id") % 6 + 1).cast("int"))
    rows = table(spark, d, "events").select("event_id", subjects.parsed_category(reply).alias("c")).select("event_id", "c.category", "c.confidence")
    return rows.withColumn("accepted", subjects.accepted_category(F.col("category"), F.col("confidence")))


@query("""WITH r AS (SELECT s_suppkey, s_suppkey % 8 AS k FROM supplier) SELECT s_suppkey, CASE k WHEN 1 THEN 'PrimaryMissing' WHEN 2 THEN 'UnknownSubject' WHEN 3 THEN 'Confidence' WHEN 4 THEN 'NoEvidence' WHEN 5 THEN 'EvidenceRepeated' WHEN 6 THEN 'SubjectRepeated' END AS error,
 CASE WHEN k IN (0, 7) THEN 'n1' ELSE 'n0' END AS primary_id, k <> 0 AS needs_review, CASE WHEN k = 7 THEN 1 ELSE 0 END AS secondary FROM r""")
def subject_replies(spark, d):
    k = F.col("s_suppkey") % 8
    one = F.array(F.lit("seen"))
    evidence = F.when(k == 4, F.array().cast("array<string>")).when(k == 5, F.array(F.lit("Seen  it"), F.lit("seen it"))).otherwise(one)
    primary = F.when(k != 1, F.struct(F.when(k == 2, "zz").otherwise("n1").alias("subject_id"), F.when(k == 3, 1.5).otherwise(0.9).alias("confidence"), evidence.alias("evidence")).cast(subjects.SELECTION))
    other = F.struct(F.when(k == 6, "n1").otherwise("n2").alias("subject_id"), F.lit(0.6).alias("confidence"), one.alias("evidence")).cast(subjects.SELECTION)
    replies = table(spark, d, "supplier").select("s_suppkey", F.lit("l").alias("library_id"), primary.alias("primary"), F.when(k >= 6, F.array(other)).alias("secondary"))
    known = table(spark, d, "nation").select(F.lit("l").alias("library_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("subject_id"))
    return subjects.assigned(replies, known).select("s_suppkey", "error", F.col("primary.subject_id").alias("primary_id"), "needs_review", F.size("secondary").alias("secondary"))


@query("""WITH s AS (SELECT o_custkey AS document_id, o_orderkey AS i, 'H' || o_orderstatus AS title, o_orderpriority || o_orderkey AS content, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
h AS (SELECT document_id, title, min(i) AS f FROM s GROUP BY ALL), hh AS (SELECT document_id, string_agg(title, ' ' ORDER BY f) AS contents FROM h GROUP BY 1),
r AS (SELECT document_id, title, content, n, row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS i FROM s), t AS (SELECT DISTINCT document_id, j * (n - 1) // greatest(least(n, 6) - 1, 1) AS i FROM r, (SELECT unnest(range(6)) AS j) WHERE j < least(n, 6))
SELECT document_id, any_value(contents) AS contents, string_agg(title || ': ' || content, ' ' ORDER BY i) AS summary FROM t JOIN r USING (document_id, i) JOIN hh USING (document_id) GROUP BY 1""")
def subject_descriptors(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("nth"), F.concat(F.lit("H"), "o_orderstatus").alias("title"), F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).alias("content"))
    return subjects.descriptors(rows).select("document_id", "contents", "summary")


@query("""SELECT name, CASE WHEN name = 'N3' THEN 'n3' WHEN name = 'every' THEN NULL WHEN name = 'nothing' THEN NULL ELSE (SELECT 'n' || n_nationkey FROM nation WHERE lower(n_name) = lower(name)) END AS subject_id, CASE WHEN name = 'every' THEN 'Ambiguous' END AS error
FROM (SELECT n_name AS name FROM nation UNION ALL SELECT * FROM (VALUES ('N3'), ('every'), ('nothing')))""")
def subject_explicit(spark, d):
    nation = table(spark, d, "nation")
    concepts = nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("label"), F.array(F.lit("Every")).alias("aliases"))
    asked = nation.select(F.col("n_name").alias("name")).union(spark.createDataFrame([("N3",), ("every",), ("nothing",)], "name string"))
    return subjects.resolved(concepts, asked)


@query("""SELECT o_orderkey AS chunk_id, 't' || (r % 2) AS taxonomy_version, r % 3 = 0 AS needs_review, 'primary:n' || (r % 25) || ':' || p.n_name || CASE WHEN s.n_name IS NULL THEN '' ELSE ',secondary:n' || ((r + 1) % 30) || ':' || s.n_name END AS subjects
FROM (SELECT o_orderkey, o_custkey % 40 AS r FROM orders) JOIN nation p ON p.n_nationkey = r % 25 LEFT JOIN nation s ON s.n_nationkey = (r + 1) % 30 WHERE NOT (o_orderkey % 4 = 0 AND r % 2 = 1)""")
def subject_enrichment(spark, d):
    chunks = table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), (F.col("o_custkey") % 40).alias("revision_id"), F.when(F.col("o_orderkey") % 4 == 0, "t0").alias("taxonomy_version"))
    r = F.col("id")
    selection = lambda n: F.struct(F.concat(F.lit("n"), n.cast("string")).alias("subject_id"), F.lit(0.9).alias("confidence"), F.array(F.lit("e")).alias("evidence")).cast(subjects.SELECTION)
    latest = spark.range(40).select(r.alias("revision_id"), F.lit("v2").alias("version"), F.lit("l").alias("library_id"), F.concat(F.lit("t"), (r % 2).cast("string")).alias("taxonomy_version"), (r % 3 == 0).alias("needs_review"), selection(r % 25).alias("primary"), F.array(selection((r + 1) % 30)).alias("secondary"))
    older = latest.withColumn("version", F.lit("v1")).withColumn("needs_review", F.lit(None).cast("boolean"))
    nation = table(spark, d, "nation")
    catalogs = nation.select(F.lit("l").alias("library_id"), F.explode(F.array(F.lit("t0"), F.lit("t1"))).alias("taxonomy_version"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("label"))
    rows = subjects.enriched(chunks, older.unionByName(latest), catalogs)
    spelled = F.array_join(F.transform("subjects", lambda s: F.concat_ws(":", s["role"], s["id"], s["label"])), ",")
    return rows.select("chunk_id", "taxonomy_version", "needs_review", spelled.alias("subjects"))
