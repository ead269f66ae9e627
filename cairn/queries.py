"""Queries of the retrieval operators over the driver's tables, and the same in SQL for DuckDB.

Documents stand for chunks (source: library, lang: category), pages for crawled pages, embeddings for chunk vectors, events
for audit and metric rows, and orders, parts and suppliers for jobs, packages and libraries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions import web as W
from cairn.operators import bm25, candidates, catalog, chunking, health, segments, symbols, taxonomy, vectors
from cairn.plans import search
from cairn.sources.scratch import folder
from cairn.streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("library_id"), F.col("lang").alias("category"), F.col("text").alias("content"))


def chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("library_id"), "embedding")


_STORED: dict[tuple[str, str], segments.Index] = {}


def stored_index(spark: SparkSession, d: str) -> segments.Index:
    """The index of the documents, built once an application and read by every search of them."""
    key = spark.sparkContext.applicationId, d
    if key not in _STORED:
        _STORED[key] = segments.build(chunks(spark, d), folder(spark))
    return _STORED[key]


def first_vector(spark: SparkSession, d: str) -> list[float]:
    row = table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0]) if row else [0.0]


TEXT_QUERY = "the tion and thereon"
#: SQL's patterns have no possessive form.
TOKEN_SQL = candidates.TOKEN.replace("*+", "*")
PROSE_SQL = "list_transform(regexp_extract_all(text, '([A-Za-z][A-Za-z0-9]+)', 1), lambda x: lower(x))"
IDENT_SQL = r"list_filter(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*(?:(?:\.|::|->)[A-Za-z_][A-Za-z0-9_]*)*)', 1), lambda x: length(x) >= 2)"
POSTINGS_SQL = f"""
tokens AS (
  SELECT doc_id AS chunk_id, unnest({PROSE_SQL}) AS term FROM documents
  UNION ALL SELECT doc_id, unnest({IDENT_SQL}) FROM documents
  UNION ALL SELECT doc_id, lower(i) FROM (SELECT doc_id, unnest({IDENT_SQL}) AS i FROM documents) WHERE lower(i) <> i),
postings AS (SELECT chunk_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
lengths AS (SELECT chunk_id, count(*) AS doc_length FROM tokens GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(doc_length) AS avg_length FROM lengths),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY ALL),
scores AS (
  SELECT p.chunk_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_length / avg_length))) AS bm25
  FROM postings p JOIN dfs USING (term) JOIN lengths l ON l.chunk_id = p.chunk_id, stats
  WHERE term IN ('the', 'tion', 'and', 'thereon') GROUP BY ALL)"""
COSINE_SQL = """
q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0),
cosines AS (
  SELECT vec_id AS chunk_id, CAST(label AS VARCHAR) AS library_id,
    list_sum(list_transform(list_zip(embedding, qv), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))
    / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) * list_sum(list_transform(qv, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS cosine
  FROM embeddings, q WHERE embedding IS NOT NULL)"""


@query(f"WITH {POSTINGS_SQL} SELECT chunk_id, term, tf FROM postings")
def bm25_postings(spark, d):
    return bm25.postings(chunks(spark, d))


@query(f"WITH {POSTINGS_SQL} SELECT n AS n_docs, round(avg_length, 6) AS avg_length FROM stats")
def bm25_stats(spark, d):
    return bm25.statistics(bm25.lengths(chunks(spark, d))).withColumn("avg_length", F.round("avg_length", 6))


@query(f"WITH {POSTINGS_SQL} SELECT chunk_id, round(bm25, 6) AS bm25 FROM scores ORDER BY round(bm25, 6) DESC, chunk_id LIMIT 10")
def bm25_topn(spark, d):
    return bm25.top_n(bm25.search(stored_index(spark, d), TEXT_QUERY), 10).select("chunk_id", F.round("bm25", 6).alias("bm25"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS n FROM (SELECT doc_id, unnest({PROSE_SQL}) AS term FROM documents) GROUP BY ALL")
def prose_tokens_df(spark, d):
    rows = chunks(spark, d).select("chunk_id", F.explode(T.prose_tokens(F.col("content"))).alias("term")).groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("c"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("c").alias("n"))


@query(f"SELECT doc_id, len({IDENT_SQL}) AS n, list_count(list_distinct({IDENT_SQL})) AS kinds FROM documents")
def identifier_tokens_count(spark, d):
    names = T.identifiers(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(names).cast("long").alias("n"), F.size(F.array_distinct(names)).cast("long").alias("kinds"))


@query(f"WITH {COSINE_SQL} SELECT chunk_id, round(cosine, 6) AS cosine FROM cosines ORDER BY round(cosine, 6) DESC, chunk_id LIMIT 10")
def cosine_topk(spark, d):
    return vectors.top_k(chunk_vectors(spark, d), first_vector(spark, d), 10).select("chunk_id", F.round("cosine", 6).alias("cosine"))


@query(f"WITH {COSINE_SQL} SELECT chunk_id, round(cosine, 6) AS cosine FROM cosines WHERE library_id = '3' ORDER BY round(cosine, 6) DESC, chunk_id LIMIT 10")
def cosine_topk_category_filter(spark, d):
    return vectors.top_k(chunk_vectors(spark, d), first_vector(spark, d), 10, F.col("library_id") == "3").select("chunk_id", F.round("cosine", 6).alias("cosine"))


@query(f"WITH {COSINE_SQL} SELECT library_id, chunk_id, round(cosine, 6) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY round(cosine, 6) DESC, chunk_id) AS rank FROM cosines) WHERE rank <= 5")
def cross_library_topk(spark, d):
    return vectors.top_k_by_library(chunk_vectors(spark, d), first_vector(spark, d), 5).select("library_id", "chunk_id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


HYBRID_SQL = f"""{POSTINGS_SQL}, {COSINE_SQL},
candidates AS (SELECT * FROM cosines ORDER BY round(cosine, 6) DESC, chunk_id LIMIT 50),
hybrid AS (SELECT c.chunk_id, 0.6 * cosine + 0.4 * coalesce(bm25, 0) / (SELECT max(bm25) FROM scores) AS score FROM candidates c LEFT JOIN scores s ON s.chunk_id = c.chunk_id)"""


def hybrid(spark, d) -> DataFrame:
    found = vectors.top_k(chunk_vectors(spark, d), first_vector(spark, d), vectors.candidate_count(10))
    return vectors.blended(found, bm25.search(stored_index(spark, d), TEXT_QUERY))


@query(f"WITH {HYBRID_SQL} SELECT chunk_id, round(score, 6) AS score FROM hybrid ORDER BY round(score, 6) DESC, chunk_id LIMIT 10")
def hybrid_topk(spark, d):
    return hybrid(spark, d).orderBy(F.round("score", 6).desc(), "chunk_id").limit(10).select("chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {HYBRID_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY round(score, 6) DESC, chunk_id) AS ord FROM hybrid) SELECT chunk_id, ord FROM o ORDER BY ord LIMIT 30")
def hybrid_rerank_passthrough(spark, d):
    return vectors.reranked(hybrid(spark, d), 30).select("chunk_id", F.col("ord").cast("long").alias("ord"))


@query(f"""WITH {HYBRID_SQL}, top AS (SELECT chunk_id, score FROM hybrid ORDER BY round(score, 6) DESC, chunk_id LIMIT 10),
new AS (SELECT doc_id FROM documents WHERE lower(regexp_extract(text, '([A-Za-z]+)', 1)) IN ('the', 'and', 'la') AND doc_id NOT IN (SELECT chunk_id FROM top) ORDER BY doc_id LIMIT 5)
SELECT doc_id AS chunk_id, 0.0 AS score, 0 AS ord FROM new UNION ALL SELECT chunk_id, round(score, 6), 1 FROM top""")
def identifier_injection(spark, d):
    top = hybrid(spark, d).orderBy(F.round("score", 6).desc(), "chunk_id").limit(10)
    named = chunks(spark, d).withColumn("qualified_name", F.regexp_extract("content", "([A-Za-z]+)", 1))
    return vectors.injected(search.known_names(search.names_asked(spark, "The and La"), named), top).withColumn("score", F.round("score", 6))


@query(r"""WITH q AS (SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN w || 'Linear' WHEN 1 THEN w || '.Connect' WHEN 2 THEN w || '()' WHEN 3 THEN 'std::' || w WHEN 4 THEN 'move_' || w WHEN 5 THEN 'how do I ' || w WHEN 6 THEN 'i.e ' || w WHEN 7 THEN ':: ' || w WHEN 8 THEN 'aB' ELSE w || ' ' || w END AS q FROM (SELECT doc_id, lower(regexp_extract(text, '([A-Za-z]{2,})', 1)) AS w FROM documents) WHERE w <> '')
SELECT doc_id, doc_id % 10 < 5 AS identifier_shaped FROM q""")
def query_shape(spark, d):
    w = F.lower(F.regexp_extract("text", "([A-Za-z]{2,})", 1))
    k = F.col("doc_id") % 10
    shapes = (F.concat("w", F.lit("Linear")), F.concat("w", F.lit(".Connect")), F.concat("w", F.lit("()")), F.concat(F.lit("std::"), "w"), F.concat(F.lit("move_"), "w"), F.concat(F.lit("how do I "), "w"), F.concat(F.lit("i.e "), "w"), F.concat(F.lit(":: "), "w"), F.lit("aB"))
    q = F.coalesce(*[F.when(k == i, s) for i, s in enumerate(shapes)], F.concat_ws(" ", "w", "w"))
    return table(spark, d, "documents").select("doc_id", w.alias("w")).where("w <> ''").select("doc_id", T.is_identifier_shaped(q).alias("identifier_shaped"))


@query("SELECT coalesce(lang, 'unfenced') AS value, count(*) AS n, count(*) / sum(count(*)) OVER () AS ratio FROM documents GROUP BY 1")
def language_mix(spark, d):
    return health.mix(table(spark, d, "documents"), "lang")


HOST_SQL = "lower(nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#:]*)', 2), ''))"
SCHEME_SQL = "lower(nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1), ''))"
PATH_SQL = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://[^/?#]*([^?#]*)', 2)"
NORMAL_SQL = rf"""CASE WHEN {HOST_SQL} IS NOT NULL THEN {SCHEME_SQL} || '://' || {HOST_SQL} || regexp_replace(regexp_replace({PATH_SQL}, '(?i)\.(html|htm|aspx)$', ''), '/+$', '') || regexp_extract(url, '(\?[^#]*)', 1) END"""


@query(f"SELECT coalesce({HOST_SQL}, '(unknown)') AS host, count(*) AS n FROM pages GROUP BY 1")
def host_distribution(spark, d):
    return health.hosts(table(spark, d, "pages"))


@query(f"SELECT page_id, {NORMAL_SQL} AS url, sha256({NORMAL_SQL}) AS hash, {SCHEME_SQL} || '://' || {HOST_SQL} AS host_key, regexp_extract({PATH_SQL}, '^(/[^/]*/?)', 1) AS segment FROM pages")
def url_normalize(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", W.normalized(u).alias("url"), W.canonical_hash(u).alias("hash"), W.host_key(u).alias("host_key"), W.first_segment(u).alias("segment"))


ALLOW, DENY = [r"example\.(com|org)"], ["/de/", "#"]
BINARY_SQL = r"(?i)\.(png|jpe?g|gif|svg|webp|ico|bmp|css|js|map|zip|tar|gz|7z|exe|dmg|msi|mp3|mp4|webm|mov|woff2?|ttf|eot)(\?|$)"
REFUSAL_SQL = rf"""CASE WHEN regexp_matches(url, '{BINARY_SQL}') OR regexp_matches(url, '\.(pdf|docx)$') THEN 'BinaryExtension' WHEN NOT regexp_matches(url, 'example\.(com|org)') THEN 'PatternMissAllowed' WHEN regexp_matches(url, '/de/|#') THEN 'PatternExclude' END"""


@query(f"""WITH r AS (SELECT page_id, url, {REFUSAL_SQL} AS reason FROM pages)
SELECT page_id, reason, CASE reason WHEN 'BinaryExtension' THEN lower(regexp_extract(url, '\\.([A-Za-z0-9]+)(\\?|$)', 1)) WHEN 'PatternExclude' THEN CASE WHEN contains(url, '/de/') THEN '/de/' ELSE '#' END END AS detail FROM r""")
def url_allow_deny(spark, d):
    return table(spark, d, "pages").select("page_id", W.refused(F.col("url"), ALLOW, DENY).alias("r")).select("page_id", "r.reason", "r.detail")


ROOT = "https://www.ththing.example.com/en/1"


@query(f"SELECT page_id, coalesce({SCHEME_SQL} = 'https' AND {HOST_SQL} = 'www.ththing.example.com' AND starts_with({PATH_SQL}, '/en/'), false) AS in_scope FROM pages")
def root_scope(spark, d):
    return table(spark, d, "pages").select("page_id", W.in_root_scope(F.col("url"), ROOT).alias("in_scope"))


@query(f"""WITH r AS (SELECT page_id, page_id % 4 AS depth, page_id % 7 = 0 AS seen, {REFUSAL_SQL} AS no,
  coalesce({SCHEME_SQL} = 'https' AND {HOST_SQL} = 'www.ththing.example.com' AND starts_with({PATH_SQL}, '/en/'), false) AS scoped, coalesce({HOST_SQL} = 'www.ththing.example.com', false) AS same FROM pages),
s AS (SELECT page_id, CASE WHEN seen THEN 'AlreadyVisited' WHEN no IS NOT NULL THEN no WHEN scoped THEN NULL WHEN same AND depth > 2 THEN 'SameHostDepth' WHEN NOT same AND depth > 1 THEN 'OffSiteDepth' END AS reason FROM r)
SELECT page_id, CASE WHEN reason IS NULL THEN 'Fetched' ELSE 'Skipped' END AS decision, coalesce(reason, '') AS reason FROM s""")
def crawl_decision(spark, d):
    made = W.crawl_decision(F.col("url"), F.col("page_id") % 4, F.col("page_id") % 7 == 0, ROOT, ALLOW, DENY)
    return table(spark, d, "pages").select("page_id", made.alias("d")).select("page_id", "d.decision", "d.reason")


@query("SELECT kind, value, count(*) AS n FROM (SELECT 'event_type' AS kind, event_type AS value FROM events UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR) FROM events) GROUP BY ALL")
def audit_summary(spark, d):
    return health.group_counts(table(spark, d, "events"), ["event_type", "user_id"])


@query("SELECT event_id, event_type FROM events WHERE user_id < 50 AND contains(props, '1') AND event_type = 'click'")
def audit_filter(spark, d):
    rows = catalog.conditional(table(spark, d, "events"), {"user": F.col("user_id") < 50, "text": F.col("props").contains("1"), "kind": F.col("event_type") == "click", "host": None})
    return rows.select("event_id", "event_type")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value < 0) AS failures, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS top FROM events GROUP BY 1")
def query_latency_stats(spark, d):
    rows = health.latency(table(spark, d, "events"), "event_type", "value", F.col("value") < 0)
    return rows.select("event_type", "n", "failures", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "top")])


@query("SELECT event_id FROM events WHERE event_type = 'click' AND ts < (SELECT max(ts) FROM events) - INTERVAL 4 HOUR")
def stale_jobs(spark, d):
    rows = table(spark, d, "events").withColumn("state", F.when(F.col("event_type") == "click", "Running").otherwise("Done"))
    now = F.lit(rows.agg(F.max("ts")).first()[0])
    return rows.where(health.stale(F.col("state"), F.lit(None).cast("timestamp"), F.col("ts"), now)).select("event_id")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' UNION SELECT * FROM (SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50)")
def recent_union_running(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    recent = rows.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50)
    return rows.where("o_orderstatus = 'O'").unionByName(recent).select("o_orderkey", "o_orderstatus").distinct()


@query("""WITH r AS (SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS dt, event_id - lag(event_id) OVER w AS dc FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(CASE WHEN dt > 0 THEN dc / (dt / 1e6) ELSE 0 END, 6) AS rate FROM r""")
def rates_lag(spark, d):
    return catalog.rates(table(spark, d, "events"), "user_id", "ts", "event_id").select("event_id", F.round("rate", 6).alias("rate"))


@query(r"""WITH c AS (SELECT source, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) SELECT source AS library_id, count(*) AS n, round(100.0 * (count(*) - count(DISTINCT t)) / count(*), 6) AS duplicate_pct, count(*) >= 5 AND 100.0 * (count(*) - count(DISTINCT t)) / count(*) >= 60 AS suspect FROM c GROUP BY 1""")
def duplicate_content_pct(spark, d):
    return health.duplicate_share(chunks(spark, d), "library_id").withColumn("duplicate_pct", F.round("duplicate_pct", 6))


@query(r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id AS page_id, trim(line) AS heading, count(*) AS n FROM p WHERE trim(line) <> '' GROUP BY ALL""")
def heading_chunks(spark, d):
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    marked = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("# "), x, F.lit("\nbody"))), "\n")
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("title"), marked.alias("text"))
    return chunking.by_headings(pages).where("heading <> ''").groupBy("page_id", "heading").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, source || '/' || lang || '/' || substr(sha256(source || lang), 1, 12) || '/' || doc_id AS chunk_id FROM documents")
def chunk_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", chunking.chunk_id(F.col("source"), F.col("lang"), F.concat("source", "lang"), F.col("doc_id")).alias("chunk_id"))


@query("SELECT doc_id, sha256(substr('[' || lang || '] [' || source || '] [' || doc_id || ']' || chr(10) || text, 1, 6000)) AS input_sha256, length(text) // 4 AS tokens FROM documents")
def embedding_input_text(spark, d):
    made = T.embedding_input(F.col("lang"), F.col("source"), F.col("doc_id").cast("string"), F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(made, 256).alias("input_sha256"), T.token_estimate(F.col("text")).cast("long").alias("tokens"))


CUTS_SQL = r"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
c AS (SELECT doc_id AS page, i, 'p' || doc_id || '/' || (i // 2) || '-' || (i % 2) AS chunk_id, CASE WHEN doc_id % 5 = 0 AND i % 2 = 1 THEN '.' || line WHEN doc_id % 2 = 0 THEN replace(replace(line, '. ', '.'), ', ', '.') ELSE line END AS content FROM l)"""


@query(rf"""WITH {CUTS_SQL}, segs AS (SELECT DISTINCT string_split(unnest(regexp_extract_all(content, '[\pL\pN_.]+')), '.') AS p FROM c),
ok AS (SELECT p, list_transform(p, lambda x: regexp_full_match(x, '[A-Za-z_][A-Za-z0-9_]*')) AS v FROM segs WHERE len(p) > 1),
pairs AS (SELECT p[j] || '.' || p[j + 1] AS name, bool_or(NOT (j > 1 AND v[j - 1]) AND NOT coalesce(v[j + 2], false)) AS whole FROM (SELECT p, v, unnest(range(1, len(p))) AS j FROM ok) WHERE v[j] AND v[j + 1] GROUP BY 1),
n AS (SELECT *, lag(chunk_id) OVER w AS prev_id, lag(content) OVER w AS prev FROM c WINDOW w AS (PARTITION BY page ORDER BY i)),
j AS (SELECT *, reverse(regexp_extract(reverse(prev), '^\s*\.([\pL\p{{Nd}}_]*)', 1)) AS a, regexp_extract(content, '^\s*([\pL\p{{Nd}}_]*)', 1) AS b FROM n WHERE prev_id IS NOT NULL)
SELECT page, prev_id, chunk_id AS next_id, CASE WHEN whole THEN 'Name' ELSE 'Pair' END AS kind, name, right(prev, 80) AS tail, left(content, 80) AS head FROM j JOIN pairs ON name = a || '.' || b AND regexp_matches(a, '^\pL') AND regexp_matches(b, '^\pL')
UNION ALL SELECT page, NULL, chunk_id, 'LeadingDot', NULL, NULL, left(content, 80) FROM j WHERE regexp_matches(content, '^\s*\.')""")
def boundary_issues(spark, d):
    """Lines as chunks, those of every other document with words joined by dots."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    dotted = F.replace(F.replace(F.col("line"), F.lit(". "), F.lit(".")), F.lit(", "), F.lit("."))
    content = F.when((F.col("page") % 5 == 0) & (F.col("i") % 2 == 1), F.concat(F.lit("."), "line")).when(F.col("page") % 2 == 0, dotted).otherwise(F.col("line"))
    ids = F.concat(F.lit("p"), "page", F.lit("/"), F.expr("i div 2"), F.lit("-"), F.expr("i % 2"))
    return chunking.boundary_issues(lines.select(ids.alias("chunk_id"), "page", content.alias("content")))


@query("SELECT DISTINCT source AS library_id, lang AS category FROM documents")
def distinct_pairs(spark, d):
    return chunks(spark, d).select("library_id", "category").distinct()


@query("""WITH t AS (SELECT c_nationkey AS k, 1 AS c, 0 AS s FROM customer UNION ALL SELECT s_nationkey, 0, 1 FROM supplier),
v AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey IN (0, 2) UNION ALL SELECT n_nationkey FROM nation WHERE n_regionkey = 3 AND n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey FROM nation WHERE n_regionkey = 4 AND n_nationkey % 3 < 2)
SELECT k AS nation, sum(c) AS in_customer, sum(s) AS in_supplier FROM t WHERE k NOT IN (SELECT k FROM v) GROUP BY 1""")
def orphan_pairs(spark, d):
    """Nations as pairs: two regions are in the catalog, one has versions that are being built, one has jobs."""
    tables = {"customer": table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")), "supplier": table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))}
    nation, key = table(spark, d, "nation").withColumnRenamed("n_nationkey", "nation"), F.col("nation")
    versions = nation.where("n_regionkey = 3").withColumn("state", F.when(key % 2 == 0, "Building").otherwise("Failed"))
    jobs = nation.where("n_regionkey = 4").withColumn("status", F.when(key % 3 == 0, "Running").when(key % 3 == 1, "Queued").otherwise("Completed"))
    return catalog.orphans(tables, catalog.valid_parents(nation.where("n_regionkey IN (0, 2)"), versions, jobs, ["nation"]), ["nation"])


OLD, NEW = "doc_id % 5 <> 0", "doc_id % 7 <> 0"


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE NOT (doc_id % 5 = 0 AND doc_id % 7 = 0) AND (doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 3 = 0)""")
def version_diff(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.xxhash64("text").alias("h"))
    new = docs.where(NEW).withColumn("h", F.when(F.col("doc_id") % 3 == 0, F.bitwise_not("h")).otherwise(F.col("h")))
    return catalog.difference(docs.where(OLD), new, "doc_id", "h")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'new' ELSE o_orderstatus END AS state FROM orders")
def upsert_replace(spark, d):
    old = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"))
    return catalog.upsert(old, old.where("o_orderkey % 10 = 0").withColumn("state", F.lit("new")), ["o_orderkey"])


@query("SELECT source AS library_id, arg_max(lang, {'a': doc_id, 'b': lang}) AS current FROM documents WHERE lang <> 'en' AND doc_id % 3 <> 0 GROUP BY 1")
def delete_repoint(spark, d):
    state = F.when(F.col("doc_id") % 3 == 0, "Building").otherwise("Published").alias("state")
    rows = table(spark, d, "documents").select(F.col("source").alias("library_id"), F.col("lang").alias("version"), F.col("doc_id").alias("scraped_at"), state)
    return catalog.repointed(rows, "en")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def latest_per_group(spark, d):
    return catalog.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.desc("ts"), F.col("event_id")]).drop("ts")


@query("""WITH p AS (SELECT p_partkey, 'src' || (p_partkey % 40) AS package_id, CASE p_partkey % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' WHEN 3 THEN 'es' ELSE 'xx' END AS version FROM part),
k AS (SELECT DISTINCT source, lang FROM documents)
SELECT package_id, version, CASE WHEN package_id LIKE 'src3%' THEN 'filtered' WHEN EXISTS (SELECT 1 FROM k WHERE source = package_id AND lang = version) THEN 'cached' WHEN EXISTS (SELECT 1 FROM k WHERE source = package_id) THEN 'cached-different-version' WHEN version = 'xx' THEN 'failed' ELSE 'queued' END AS status FROM p""")
def dependency_status(spark, d):
    version = F.element_at(F.array(*map(F.lit, ["en", "de", "fr", "es", "xx"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    packages = table(spark, d, "part").select(F.concat(F.lit("src"), (F.col("p_partkey") % 40).cast("string")).alias("package_id"), version.alias("version"))
    libraries = table(spark, d, "documents").select(F.col("source").alias("library_id"), F.col("lang").alias("version")).distinct()
    return catalog.dependency_status(packages, libraries, ["src3"], F.col("version") == "xx")


@query("""WITH s AS (SELECT source, count(*) AS pages, sum(n_chars) // 1000 AS links, count(DISTINCT lang) AS languages, avg(CASE WHEN lang = 'de' THEN 1.0 ELSE 0.0 END) AS declared FROM documents GROUP BY 1)
SELECT source AS library_id, array_to_string(list_filter([CASE WHEN pages <= 3 THEN 'FewPages' END, CASE WHEN links < 10 THEN 'SparseLinks' END, CASE WHEN languages > 1 THEN 'SingleHostManyLanguages' END, CASE WHEN declared < 0.30 THEN 'LanguageMismatch' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s""")
def suspect_reasons(spark, d):
    s = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.floor(F.sum("n_chars") / 1000).alias("links"), F.count_distinct("lang").alias("languages"), F.avg((F.col("lang") == "de").cast("double")).alias("declared"))
    reasons = health.suspect_reasons(F.col("pages"), F.col("links"), F.lit(1), F.col("languages"), F.col("declared"), F.lit(False))
    return s.select(F.col("source").alias("library_id"), F.array_join(reasons, ",").alias("reasons"))


SUBJECTS = [("s1", "the"), ("s2", "la de"), ("s3", "und"), ("s4", "that"), ("s5", "de la")]


@query(r"""WITH w AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '([\p{L}\p{Nd}]+)', 1), ' ') || ' ' AS t FROM documents),
s AS (SELECT * FROM (VALUES ('s1', 'the'), ('s2', 'la de'), ('s3', 'und'), ('s4', 'that'), ('s5', 'de la')) v(subject_id, term))
SELECT doc_id, subject_id FROM w, s WHERE contains(t, ' ' || term || ' ') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(term) DESC, subject_id) = 1""")
def subject_infer(spark, d):
    return symbols.inferred_subject(table(spark, d, "documents"), spark.createDataFrame(SUBJECTS, "subject_id string, term string"), "doc_id", "text")


@query("""WITH e AS (SELECT user_id, event_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS entry FROM events)
SELECT user_id, entry, min(event_id) AS first_line, count(*) AS lines FROM e GROUP BY ALL""")
def log_entry_islands(spark, d):
    rows = catalog.islands(table(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "click")
    return rows.groupBy("user_id", "entry").agg(F.min("event_id").alias("first_line"), F.count(F.lit(1)).alias("lines"))


@query("SELECT doc_id, total FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id) AS total FROM documents) WHERE total <= (SELECT sum(n_chars) // 2 FROM documents)")
def running_budget_cut(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars")
    budget = rows.agg(F.floor(F.sum("n_chars") / 2)).first()[0]
    return catalog.running_total(rows, ["doc_id"], "n_chars").where(F.col("total") <= budget).select("doc_id", "total")


@query("SELECT l_returnflag AS name, count(DISTINCT l_orderkey) AS chunks, min(CAST(least(l_orderkey // greatest((SELECT max(l_orderkey) FROM lineitem) // 3, 1), 2) AS INTEGER)) AS first_third FROM lineitem GROUP BY 1")
def rejection_thirds(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_returnflag").alias("name"), F.lit("Unit").alias("reason"))
    n = rows.agg(F.max("i")).first()[0]
    return symbols.rejections(rows, "i", n).select("name", "chunks", F.get("thirds", F.lit(0)).alias("first_third"))


@query("SELECT text, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, d):
    return health.repeated_texts(table(spark, d, "documents"), "text")


@query(rf"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '{TOKEN_SQL}') AS names, regexp_split_to_array(text, '{TOKEN_SQL}') AS gaps FROM documents),
e AS (SELECT doc_id, unnest(names) AS name, unnest(gaps[2:]) AS after, unnest(gaps[:len(names)]) AS gap, unnest(list_prepend('', names[:len(names) - 1])) AS prev, unnest(list_prepend('', gaps[:len(names) - 1])) AS prev_gap, unnest(range(0, len(names))) AS nth FROM t WHERE len(names) > 0),
w AS (SELECT *, CASE WHEN nth > 0 AND regexp_full_match(gap, '\s*') THEN lower(regexp_extract(prev_gap || prev, '([\pL_]+)$', 1)) END AS word FROM e)
SELECT CAST(doc_id AS VARCHAR) AS chunk_id, name, after[1] = '(' AS callable, after[1] = '<' AS generic, coalesce(word IN ({", ".join(f"'{k}'" for k in candidates.KEYWORDS)}), false) AS declared, CAST(min(nth) AS INTEGER) AS nth FROM w GROUP BY ALL""")
def candidate_names(spark, d):
    rows = candidates.candidates(chunks(spark, d))
    return rows.select(F.col("chunk_id").cast("string").alias("chunk_id"), "name", "callable", "generic", "declared", "nth")


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS library_id, CASE WHEN max(max(s_suppkey)) OVER (PARTITION BY n_regionkey) IS NULL THEN 1 ELSE 2 END AS revision, CAST(n_nationkey AS VARCHAR) AS id,
  CASE WHEN max(s_suppkey) IS NULL THEN n_name ELSE lower(n_name) END AS label, coalesce(max_by(s_name, s_suppkey), n_name) AS description
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_regionkey, n_nationkey, n_name""")
def catalog_reconciled(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("library_id"), "n_nationkey", "n_name")
    none = F.array().cast("array<string>")
    old = nation.select("library_id", F.lit(1).alias("revision"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("label"), none.alias("aliases"), F.col("n_name").alias("description"))
    met = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    document = F.lpad(F.col("s_suppkey").cast("string"), 12, "0").alias("document_id")
    new = met.select("library_id", document, F.lit(0).alias("nth"), F.lit(None).cast("string").alias("subject_id"), F.lower("n_name").alias("label"), F.array("s_name").alias("aliases"), F.col("s_name").alias("description"))
    return taxonomy.reconciled(old, new).select("library_id", "revision", F.explode("concepts").alias("c")).select("library_id", "revision", "c.id", "c.label", "c.description")


@query("SELECT date_trunc('hour', ts)::TIMESTAMPTZ AT TIME ZONE 'UTC' AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_event_counts(spark, d):
    from cairn.streaming.pages import windowed_counts

    return windowed_counts(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_id, event_type, round(value, 6) AS value FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000")
def recent_samples(spark, d):
    rows = state.recent_samples(table(spark, d, "events").select("event_id", "event_type", "value", "ts"), "ts", "event_id")
    return rows.select("event_id", "event_type", F.round("value", 6).alias("value"))


@query("""SELECT user_id, is_error, event_id, nth FROM (SELECT user_id, event_type = 'click' AS is_error, event_id, row_number() OVER (PARTITION BY user_id, event_type = 'click' ORDER BY ts DESC, event_id DESC) AS nth FROM events)
WHERE nth <= CASE WHEN is_error THEN 20 ELSE 50 END""")
def recent_feeds(spark, d):
    rows = state.recent_feeds(table(spark, d, "events"), "user_id", F.col("event_type") == "click", "ts", "event_id")
    return rows.select("user_id", "is_error", "event_id", F.col("nth").cast("long").alias("nth"))


@query("""WITH RECURSIVE e AS (SELECT event_type AS host, epoch_us(ts) AS at, event_id, CASE WHEN event_id % 97 = 0 THEN 'limited' WHEN event_id % 89 = 0 THEN 'error' ELSE 'success' END AS outcome,
  row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id) AS i FROM events),
r AS (SELECT host, 0::BIGINT AS i, 0::BIGINT AS at, 0::BIGINT AS event_id, 4::BIGINT AS c, 0::BIGINT AS streak, 0::BIGINT AS pause_until FROM (SELECT DISTINCT host FROM e)
  UNION ALL SELECT e.host, e.i, e.at, e.event_id,
    CASE WHEN outcome = 'limited' THEN greatest(1, c // 2) WHEN outcome = 'success' AND streak >= 24 AND c < 16 THEN c + 1 ELSE c END,
    CASE WHEN outcome <> 'success' OR (streak >= 24 AND c < 16) THEN 0 ELSE streak + 1 END,
    CASE WHEN outcome = 'limited' THEN greatest(pause_until, e.at + 30000000) ELSE pause_until END
  FROM r JOIN e ON e.host = r.host AND e.i = r.i + 1)
SELECT host, "at", event_id, c AS "limit", streak, pause_until FROM r WHERE i > 0""")
def request_limits(spark, d):
    outcome = F.when(F.col("event_id") % 97 == 0, "limited").when(F.col("event_id") % 89 == 0, "error").otherwise("success")
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    return state.replay_limits(table(spark, d, "events").select(F.col("event_type").alias("host"), at, "event_id", outcome.alias("outcome")))
