"""Queries of the stored index, searches, chunks, symbols, pages and files, and the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import html
from cairn.functions import text as T
from cairn.operators import bm25, chunking, subjects, symbols, vectors
from cairn.plans import search
from cairn.queries import COSINE_SQL, POSTINGS_SQL, TOKEN_SQL, chunks, first_vector, query, stored_index, table
from cairn.sources import files
from cairn.sources.scratch import folder, spread, written

LIBRARY = "src1"
OWN_SQL = POSTINGS_SQL.replace("FROM documents", "FROM (SELECT * FROM documents WHERE source = 'src1')")

# The stored index


@query(f"WITH {OWN_SQL} SELECT chunk_id, round(bm25, 6) AS bm25 FROM scores")
def bm25_library_search(spark, d):
    return bm25.search(stored_index(spark, d), "the tion and thereon", LIBRARY).select("chunk_id", F.round("bm25", 6).alias("bm25"))


@query(f"WITH {POSTINGS_SQL} SELECT chunk_id, CAST(sum(tf) FILTER (NOT (chunk_id % 3 = 0 AND term = 'the')) AS BIGINT) AS total, CASE WHEN chunk_id % 5 = 0 THEN any_value(doc_length) + 1 ELSE any_value(doc_length) END AS doc_length FROM postings JOIN lengths USING (chunk_id) GROUP BY chunk_id HAVING chunk_id % 5 = 0 OR (chunk_id % 3 = 0 AND bool_or(term = 'the'))")
def bm25_integrity(spark, d):
    """A stored index of which postings and lengths were lost or changed."""
    index = stored_index(spark, d)
    lengths = index.lengths.withColumn("doc_length", F.when(F.col("chunk_id") % 5 == 0, F.col("doc_length") + 1).otherwise(F.col("doc_length")))
    return bm25.damaged(index.postings.where("NOT (chunk_id % 3 = 0 AND term = 'the')"), lengths)


@query(f"WITH {POSTINGS_SQL} SELECT term, chunk_id, CASE WHEN chunk_id % 4 = 0 THEN 'Repeated' WHEN chunk_id % 5 = 0 THEN 'NotCounted' WHEN chunk_id % 7 = 0 THEN 'UnknownChunk' END AS problem FROM postings WHERE term = 'the' AND (chunk_id % 4 = 0 OR chunk_id % 5 = 0 OR chunk_id % 7 = 0) UNION ALL SELECT ' ', 1, 'Blank'")
def bm25_malformed(spark, d):
    index = stored_index(spark, d)
    rows = index.postings.where("term = 'the'").select("term", "chunk_id", "bucket", "buckets", F.when(F.col("chunk_id") % 5 == 0, 0).otherwise(F.col("tf")).alias("tf"))
    blank = spark.createDataFrame([(" ", 1, 0, 1, 1)], "term string, chunk_id long, bucket int, buckets int, tf long")
    rows = rows.unionByName(rows.where("chunk_id % 4 = 0")).unionByName(blank)
    return bm25.malformed(rows, index.lengths.where("chunk_id % 7 <> 0 OR chunk_id % 4 = 0 OR chunk_id % 5 = 0"))


@query("SELECT source AS library_id, CASE WHEN source = 'src2' THEN 'Count' ELSE 'Average' END AS problem FROM (SELECT DISTINCT source FROM documents WHERE source IN ('src2', 'src3') AND length(text) > 2)")
def bm25_miscounted(spark, d):
    index = stored_index(spark, d)
    stats = index.stats.withColumn("n_docs", F.when(F.col("library_id") == "src2", F.col("n_docs") + 1).otherwise(F.col("n_docs"))).withColumn("avg_length", F.when(F.col("library_id") == "src3", F.col("avg_length") + 1).otherwise(F.col("avg_length")))
    return bm25.miscounted(stats, index.lengths)


# Searches: documents and vectors of equal number are one chunk


def search_chunks(spark: SparkSession, d: str) -> DataFrame:
    names = F.regexp_extract("text", r"([A-Za-z]+)", 1)
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("library_id"), F.col("lang").alias("version"), F.when(F.expr("doc_id div 20 % 2 = 0"), "HowTo").otherwise("Overview").alias("category"), F.col("text").alias("content"), F.array("lang").alias("subject_ids"), names.alias("qualified_name"))


def search_vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def published(spark, d) -> DataFrame:
    return table(spark, d, "documents").where("lang <> 'es'").select(F.col("source").alias("library_id"), F.col("lang").alias("version")).distinct()


SEARCH_SQL = f"""WITH {OWN_SQL}, {COSINE_SQL}, c AS (SELECT doc_id AS chunk_id, source AS library_id, CASE WHEN doc_id // 20 % 2 = 0 THEN 'HowTo' ELSE 'Overview' END AS category, lang FROM documents WHERE lang <> 'es')"""


@query(f"""{SEARCH_SQL}, near AS (SELECT chunk_id, cosine, lang FROM cosines JOIN (SELECT chunk_id, lang FROM c WHERE library_id = 'src1' AND category = 'HowTo') USING (chunk_id) ORDER BY round(cosine, 6) DESC, chunk_id LIMIT 50),
h AS (SELECT chunk_id, 0.6 * cosine + 0.4 * coalesce(bm25, 0) / (SELECT max(bm25) FROM scores) + CASE WHEN lang = 'en' THEN 0.05 ELSE 0 END AS score FROM near LEFT JOIN scores USING (chunk_id))
SELECT chunk_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, chunk_id) AS place FROM h ORDER BY place LIMIT 10""")
def search_library(spark, d):
    found = search.search_docs(search_chunks(spark, d), search_vectors(spark, d), published(spark, d), stored_index(spark, d), "the tion and thereon", first_vector(spark, d), 10, library=LIBRARY, category="HowTo", inferred="en")
    return found.select("chunk_id", F.round("score", 6).alias("score"), "place")


NAMES_SQL = SEARCH_SQL.replace("('the', 'tion', 'and', 'thereon')", "('the', 'and', 'of', 'The', 'and_of')")


@query(f"""{NAMES_SQL}, own AS (SELECT c.*, text FROM c JOIN documents ON doc_id = chunk_id WHERE library_id = 'src1'), near AS (SELECT chunk_id, cosine, lang FROM cosines JOIN (SELECT chunk_id, lang FROM own WHERE category = 'HowTo') USING (chunk_id) ORDER BY round(cosine, 6) DESC, chunk_id LIMIT 50),
h AS (SELECT chunk_id, 1 AS block, 0.6 * cosine + 0.4 * coalesce(bm25, 0) / (SELECT max(bm25) FROM scores) + CASE WHEN lang = 'en' THEN 0.05 ELSE 0 END AS score FROM near LEFT JOIN scores USING (chunk_id)),
a AS (SELECT * FROM h UNION ALL (SELECT chunk_id, 0, 0.0 FROM own WHERE lower(regexp_extract(text, '([A-Za-z]+)', 1)) IN ('the', 'and_of') AND chunk_id NOT IN (SELECT chunk_id FROM h) ORDER BY chunk_id LIMIT 5))
SELECT chunk_id, round(score, 6) AS score, row_number() OVER (ORDER BY CASE WHEN (SELECT count(*) FROM a) >= 6 THEN block ELSE 0 END, round(score, 6) DESC, chunk_id) AS place, CASE WHEN lang IN ('en', 'fr') THEN 'primary:' || lang || ':about ' || lang END AS subjects
FROM a JOIN own USING (chunk_id) ORDER BY place LIMIT 10""")
def search_identifier(spark, d):
    """All of a search: the subject inferred from the query, names of the query in front, rerank if there are enough, subjects with the results."""
    rows = search_chunks(spark, d).withColumn("revision_id", F.col("version")).withColumn("taxonomy_version", F.lit("t1"))
    terms = spark.createDataFrame([("en", "the and"), ("de", "and")], "subject_id string, term string")
    selection = F.struct(F.col("revision_id").alias("subject_id"), F.lit(0.9).alias("confidence"), F.array(F.lit("e")).alias("evidence")).cast(subjects.SELECTION)
    some = spark.createDataFrame([("en",), ("fr",)], "revision_id string")
    assignments = some.select("revision_id", F.lit("v1").alias("version"), F.lit(LIBRARY).alias("library_id"), F.lit("t1").alias("taxonomy_version"), F.lit(False).alias("needs_review"), selection.alias("primary"), F.array().cast(f"array<{subjects.SELECTION}>").alias("secondary"))
    catalogs = some.select(F.lit(LIBRARY).alias("library_id"), F.lit("t1").alias("taxonomy_version"), F.col("revision_id").alias("id"), F.concat(F.lit("about "), "revision_id").alias("label"))
    found = search.search_docs(rows, search_vectors(spark, d), published(spark, d), stored_index(spark, d), "The and_of", first_vector(spark, d), 10, library=LIBRARY, category="HowTo", terms=terms, assignments=assignments, catalogs=catalogs)
    spelled = F.array_join(F.transform("subjects", lambda s: F.concat_ws(":", s["role"], s["id"], s["label"])), ",")
    return found.select("chunk_id", F.round("score", 6).alias("score"), "place", spelled.alias("subjects"))


@query(f"{SEARCH_SQL} SELECT chunk_id, round(cosine, 6) AS score, row_number() OVER (ORDER BY round(cosine, 6) DESC, chunk_id) AS place FROM cosines JOIN c USING (chunk_id) WHERE lang = 'de' ORDER BY place LIMIT 10")
def search_every_library(spark, d):
    """Without a library there is no BM25; an explicit subject filters."""
    found = search.search_docs(search_chunks(spark, d), search_vectors(spark, d), published(spark, d), None, "the", first_vector(spark, d), 10, subject="de", strategy="None")
    return found.select("chunk_id", F.round("score", 6).alias("score"), "place")


@query(f"WITH {COSINE_SQL} SELECT library_id, chunk_id, round(cosine, 6) AS cosine FROM (SELECT chunk_id, cosine FROM cosines) JOIN (SELECT doc_id AS chunk_id, source AS library_id FROM documents WHERE lang <> 'es') USING (chunk_id) ORDER BY round(cosine, 6) DESC, chunk_id LIMIT 10")
def published_topk(spark, d):
    rows = search_vectors(spark, d).join(search_chunks(spark, d).select("chunk_id", "library_id", "version"), "chunk_id")
    return vectors.over_published(rows, published(spark, d), first_vector(spark, d), 10).withColumn("cosine", F.round("cosine", 6))


@query(f"WITH {COSINE_SQL} SELECT chunk_id, round(cosine, 6) AS cosine FROM cosines WHERE chunk_id IN (SELECT doc_id FROM documents WHERE source = 'src1' AND doc_id // 20 % 2 = 1) ORDER BY round(cosine, 6) DESC, chunk_id LIMIT 5")
def library_overview(spark, d):
    return search.library_overview(search_chunks(spark, d), search_vectors(spark, d), first_vector(spark, d), LIBRARY).withColumn("cosine", F.round("cosine", 6))


@query("SELECT doc_id AS chunk_id, 'exact' AS kind FROM documents WHERE regexp_extract(text, '([A-Za-z]+)', 1) = 'The' AND lang <> 'es' UNION ALL SELECT doc_id, 'pattern' FROM documents WHERE regexp_matches(regexp_extract(text, '([A-Za-z]+)', 1), '(?i)^th.$') AND lang <> 'es'")
def class_reference(spark, d):
    rows = search_chunks(spark, d)
    exact, pattern = search.class_reference(rows, "The", published(spark, d)), search.class_reference(rows, "^th.$", published(spark, d))
    return exact.select("chunk_id", F.lit("exact").alias("kind")).unionByName(pattern.select("chunk_id", F.lit("pattern").alias("kind")))


@query("SELECT doc_id AS chunk_id FROM documents WHERE lower(regexp_extract(text, '([A-Za-z]+)', 1)) IN ('the', 'and', 'of', 'foo.bar')")
def known_names(spark, d):
    terms = spark.range(1).select(F.posexplode(F.array_distinct(T.identifiers(F.lit("The and of Foo.Bar la de")))).alias("nth", "term"))
    return search.known_names(terms, search_chunks(spark, d))


@query(r"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) - 1 AS INTEGER) AS nth, term FROM (SELECT doc_id, unnest(terms) AS term, unnest(range(0, len(terms))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*(?:(?:\.|::|->)[A-Za-z_][A-Za-z0-9_]*)*)', 1) AS terms FROM documents)) WHERE length(term) >= 2 GROUP BY doc_id, term""")
def distinct_identifiers(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.array_distinct(T.identifiers(F.col("text")))).alias("nth", "term"))


# Chunks


@query(r"""WITH RECURSIVE r AS (SELECT doc_id, source, text AS rest, 0 AS nth, CAST(NULL AS VARCHAR) AS piece, length(text) > 2400 AS cut FROM documents
 UNION ALL SELECT doc_id, source, substr(rest, pos + 1), nth + 1, substr(rest, 1, pos), cut FROM (SELECT *, CASE WHEN length(rest) <= 2400 THEN length(rest) ELSE coalesce(list_max(list_filter(range(1202, 2401), lambda j: w[j] IN (chr(10), '!', '?') OR (w[j] = '.' AND regexp_matches(w[j + 1], '\s')))), 2400) END AS pos
   FROM (SELECT *, CASE WHEN length(rest) > 2400 THEN string_split(substr(rest, 1, 2401), '') END AS w FROM r WHERE length(rest) > 0)))
SELECT doc_id || CASE WHEN cut THEN '-' || (nth - 1) ELSE '' END AS chunk_id, CASE WHEN cut THEN sha256(regexp_replace(piece, '^\s+|\s+$', '', 'g')) ELSE sha256(piece) END AS content FROM r WHERE nth > 0
UNION ALL SELECT CAST(doc_id AS VARCHAR), sha256(text) FROM documents WHERE length(text) = 0""")
def capped_chunks(spark, d):
    return chunking.capped(chunks(spark, d)).select("chunk_id", F.sha2("content", 256).alias("content"))


def packs_sql(paragraphs: str, limit: int) -> str:
    """A list of paragraphs packed in order while they fit."""
    step = f"CASE WHEN length(acc[-1]) + length(x[1]) + 2 <= {limit} THEN acc[:-2] || [acc[-1] || chr(10) || chr(10) || x[1]] ELSE acc || x END"
    return f"CASE WHEN len({paragraphs}) > 0 THEN list_reduce(list_transform({paragraphs}, lambda p: [p]), lambda acc, x: {step}) END"


@query(rf"""WITH l AS (SELECT doc_id AS page_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents),
e AS (SELECT page_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i, len(ls) AS n FROM l WHERE page_id % 3 <> 0),
s AS (SELECT page_id, unnest({packs_sql('ls', 3200)}) AS content FROM l WHERE page_id % 3 = 0)
SELECT page_id, CASE page_id % 3 WHEN 1 THEN 'ChangeLog' ELSE 'HowTo' END AS category, sha256(CASE page_id % 3 WHEN 1 THEN '## v1.' ELSE '# ' END || line || chr(10) || 'body' || CASE WHEN i < n THEN chr(10) ELSE '' END) AS content FROM e UNION ALL SELECT page_id, 'Sample', sha256(content) FROM s""")
def category_chunks(spark, d):
    """Lines as paragraphs of samples, as version headings of change logs, or as headings, with the chunks' contents."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    mark = F.when(F.col("doc_id") % 3 == 1, "## v1.").otherwise("# ")
    marked = F.array_join(F.transform(lines, lambda x: F.concat(mark, x, F.lit("\nbody"))), "\n")
    category = F.when(F.col("doc_id") % 3 == 1, "ChangeLog").when(F.col("doc_id") % 3 == 2, "HowTo").otherwise("Sample")
    text = F.when(F.col("doc_id") % 3 == 0, F.array_join(lines, "\n\n")).otherwise(marked)
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("title"), category.alias("category"), text.alias("text"))
    return chunking.by_category(pages).select("page_id", "category", F.sha2("content", 256).alias("content"))


@query(rf"""WITH l AS (SELECT doc_id AS page_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents), s AS (SELECT page_id, {packs_sql('ls', 400)} AS ps FROM l WHERE len(ls) > 0)
SELECT page_id, unnest(range(0, len(ps)))::INTEGER AS part, sha256(unnest(ps)) AS content FROM s""")
def packed_samples(spark, d):
    """Lines as paragraphs, packed to samples of 400 characters."""
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n \n")).alias("text"))
    return chunking.packed_paragraphs(pages, 400).select("page_id", "part", F.sha2("content", 256).alias("content"))


@query(r"""WITH RECURSIVE r AS (SELECT doc_id, text AS rest, 0 AS nth, CAST(NULL AS VARCHAR) AS piece FROM documents UNION ALL
 SELECT doc_id, substr(rest, pos + 1), nth + 1, substr(rest, 1, pos) FROM (SELECT *, CASE WHEN length(rest) <= 1000 THEN length(rest) ELSE coalesce(500 + nullif(length(regexp_extract(substr(rest, 501, 500), '^((?s).*\s)', 1)), 0), 1000) END AS pos FROM r WHERE length(rest) > 0))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1 AS INTEGER) AS nth, sha256(regexp_replace(piece, '^\s+|\s+$', '', 'g')) AS section FROM r WHERE nth > 0 AND regexp_matches(piece, '\S')""")
def bounded_sections(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(html.bounded(F.col("text"), 1000)).alias("nth", "section")).withColumn("section", F.sha2("section", 256))


# Symbols: texts with capitals, dots and calls made from the documents' words


def symbol_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose words stand behind keywords, in containers, or before brackets in turn; written, as they are read more than once."""
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]{2,})"), F.lit(1))
    made = F.transform(words, lambda w, i: F.when(i % 8 == 0, F.concat(F.lit("class "), w)).when(i % 8 == 1, F.concat(F.lit("My."), w)).when(i % 8 == 2, F.concat(w, F.lit("()"))).when(i % 8 == 3, F.concat(w, F.lit("<T>"))).when(i % 8 == 4, F.concat(F.lit("enum "), w)).when(i % 8 == 5, F.concat(F.lit("get"), F.initcap(w))).when(i % 8 == 6, F.concat(F.lit("of_"), F.lower(w))).otherwise(w))
    return written(spread(table(spark, d, "documents")).select(F.col("doc_id").alias("chunk_id"), F.array_join(made, ", ").alias("content")))


def listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


SYMBOLS_SQL = rf"""w AS (SELECT doc_id, regexp_extract_all(text, '([A-Za-z]{{2,}})', 1) AS ws FROM documents),
m AS (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM w WHERE len(ws) > 0),
x AS (SELECT doc_id, CASE i % 8 WHEN 0 THEN 'class ' || w WHEN 1 THEN 'My.' || w WHEN 2 THEN w || '()' WHEN 3 THEN w || '<T>' WHEN 4 THEN 'enum ' || w WHEN 5 THEN 'get' || upper(w[1]) || lower(w[2:]) WHEN 6 THEN 'of_' || lower(w) ELSE w END AS piece, i FROM m),
c AS (SELECT doc_id AS chunk_id, string_agg(piece, ', ' ORDER BY i) AS text FROM x GROUP BY 1),
t AS (SELECT chunk_id, regexp_extract_all(text, '{TOKEN_SQL}') AS names, regexp_split_to_array(text, '{TOKEN_SQL}') AS gaps FROM c),
e AS (SELECT chunk_id, unnest(names) AS name, unnest(gaps[2:]) AS after, unnest(gaps[:len(names)]) AS gap, unnest(list_prepend('', names[:len(names) - 1])) AS prev, unnest(range(0, len(names))) AS nth FROM t),
u AS (SELECT chunk_id, name, regexp_extract(name, '([^.]*)$', 1) AS leaf, contains(name, '.') AS has_container, after[1] = '(' AS callable, after[1] = '<' AS generic, CASE WHEN nth > 0 AND regexp_full_match(gap, '\s*') AND lower(prev) IN ('class', 'interface', 'struct', 'enum', 'record', 'type', 'def', 'function') THEN lower(prev) END AS keyword, nth FROM e),
p AS (SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\b([A-Z][A-Za-z0-9_]+)\b', 1)) AS name FROM c) GROUP BY 1),
g AS (SELECT chunk_id, name, any_value(leaf) AS leaf, bool_or(has_container) AS has_container, bool_or(callable) AS callable, bool_or(generic) AS generic, bool_or(keyword IS NOT NULL) AS declared FROM u GROUP BY ALL),
j AS (SELECT g.*, coalesce(a.n, 0) AS n, coalesce(b.n, 0) AS leaf_n FROM g LEFT JOIN p a ON a.name = g.name LEFT JOIN p b ON b.name = g.leaf),
k AS (SELECT *, CASE WHEN lower(name) IN ({listed(symbols.STOPLIST)}) OR lower(leaf) IN ({listed(symbols.STOPLIST)}) THEN 'GlobalStoplist' WHEN lower(name) IN ('ou', 'que') OR lower(leaf) IN ('ou', 'que') THEN 'LibraryStoplist'
 WHEN name IN ({listed(symbols.UNITS)}) OR leaf IN ({listed(symbols.UNITS)}) OR (length(name) <= 4 AND lower(name) IN ({listed(symbols.UNITS_IN_ANY_CASE)})) OR (length(leaf) <= 4 AND lower(leaf) IN ({listed(symbols.UNITS_IN_ANY_CASE)})) THEN 'Unit' WHEN length(name) < 2 THEN 'BelowMinLength'
 WHEN declared OR callable OR generic OR has_container OR regexp_matches(name, '[a-z][A-Z]') OR regexp_matches(name, '[A-Z][A-Z][a-z][a-z]') OR contains(name, '_') OR (n >= 3 AND NOT regexp_matches(name, '^[A-Z0-9]{{1,4}}$')) OR (leaf_n >= 3 AND NOT regexp_matches(leaf, '^[A-Z0-9]{{1,4}}$')) THEN NULL
 WHEN (n >= 3 AND regexp_matches(name, '^[A-Z0-9]{{1,4}}$')) OR (leaf_n >= 3 AND regexp_matches(leaf, '^[A-Z0-9]{{1,4}}$')) THEN 'LikelyAbbreviation' ELSE 'NoStructureSignal' END AS reason FROM j),
s AS (SELECT u.chunk_id, name, arg_min(CASE WHEN keyword IN ('class', 'interface', 'struct', 'record', 'type') THEN 'Type' WHEN keyword = 'enum' THEN 'Enum' WHEN keyword IN ('def', 'function') THEN 'Function' WHEN callable THEN 'Function' WHEN generic THEN 'Type' WHEN has_container THEN 'Property'
 WHEN regexp_matches(leaf, '^[A-Z]') AND (regexp_matches(leaf, '[a-z][A-Z]') OR regexp_matches(leaf, '[A-Z][A-Z][a-z][a-z]')) AND NOT contains(leaf, '_') THEN 'Type' WHEN contains(leaf, '_') AND regexp_matches(leaf, '^[a-z0-9_]+$') THEN 'Function' ELSE 'Unknown' END, nth) AS kind, min(nth) AS nth
 FROM u WHERE EXISTS (SELECT 1 FROM k WHERE k.chunk_id = u.chunk_id AND k.name = u.name AND k.reason IS NULL) GROUP BY u.chunk_id, name)"""
LISTS = {"library_stoplist": ["ou", "que"]}


@query(f"WITH {SYMBOLS_SQL} SELECT chunk_id, name, reason FROM k")
def symbol_candidates(spark, d):
    return symbols.judged(symbol_chunks(spark, d), **LISTS)


def kept_symbols(spark, d) -> DataFrame:
    return symbols.symbols(symbol_chunks(spark, d), methods_snake=True, **LISTS)


@query(f"WITH {SYMBOLS_SQL} SELECT chunk_id, name, kind, CAST(nth AS INTEGER) AS nth FROM s")
def symbol_kinds(spark, d):
    return kept_symbols(spark, d)


@query(f"WITH {SYMBOLS_SQL} SELECT chunk_id, arg_min(name, {{'a': CASE kind WHEN 'Type' THEN 0 WHEN 'Enum' THEN 1 WHEN 'Function' THEN 2 WHEN 'Property' THEN 3 ELSE 6 END, 'b': nth}}) AS primary FROM s GROUP BY 1")
def primary_names(spark, d):
    return symbols.primary_names(kept_symbols(spark, d))


@query(f"WITH {SYMBOLS_SQL} SELECT DISTINCT name FROM s WHERE kind = 'Enum' AND contains(lower(name), 'th')")
def symbols_of_kind(spark, d):
    return symbols.of_kind(kept_symbols(spark, d), "Enum", "TH")


@query(f"WITH {SYMBOLS_SQL} SELECT name, kind, min(chunk_id) AS chunk_id FROM s GROUP BY ALL")
def distinct_symbols(spark, d):
    return symbols.distinct_symbols(kept_symbols(spark, d))


@query(f"WITH {SYMBOLS_SQL} SELECT name FROM s WHERE kind = 'Type' UNION SELECT source FROM documents WHERE doc_id % 2 = 0")
def type_names(spark, d):
    legacy = table(spark, d, "documents").select(F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(" ").alias("qualified_name"))
    return symbols.type_names(kept_symbols(spark, d), legacy)


@query(f"WITH {SYMBOLS_SQL} SELECT name, count(DISTINCT chunk_id) AS chunks FROM k WHERE reason IS NOT NULL GROUP BY 1 ORDER BY chunks DESC, name LIMIT 50")
def excluded_names(spark, d):
    n = table(spark, d, "documents").count()
    return symbols.rejections(symbols.judged(symbol_chunks(spark, d), **LISTS), "chunk_id", n).orderBy(F.desc("chunks"), "name").limit(50).select("name", "chunks")


def window_sql(rows: str, text: str, token: str) -> str:
    """CTEs from ``rows``, a table with a text and a token, to ``windows``, the same with ``sample``."""
    run = lambda c: rf"length(regexp_extract({c}, '^(\S*)', 1))"
    return rf"""a0 AS (SELECT *, instr({text}, {token}) AS pos FROM {rows}), a1 AS (SELECT *, greatest(pos - 100, 1) AS f, least(pos + length({token}) + 100, length({text}) + 1) AS l FROM a0),
a2 AS (SELECT *, f - {run(f'reverse(substr({text}, 1, f - 1))')} AS f2, l + {run(f'substr({text}, l)')} AS l2 FROM a1), a3 AS (SELECT *, trim(regexp_replace(substr({text}, f2, l2 - f2), '\s+', ' ', 'g')) AS w FROM a2),
a4 AS (SELECT *, instr(w, {token}) - 1 AS nb, length(w) - instr(w, {token}) + 1 - length({token}) AS na, 200 - length({token}) AS room FROM a3), a5 AS (SELECT *, least(na, room - least(nb, room // 2)) AS r FROM a4),
windows AS (SELECT *, CASE WHEN pos IS NULL OR pos = 0 THEN NULL WHEN length(w) <= 200 THEN w ELSE trim(substr(w, nb - least(nb, room - r) + 1, least(nb, room - r) + length({token}) + r)) END AS sample FROM a5)"""


@query(rf"""WITH {SYMBOLS_SQL}, total AS (SELECT count(*) AS all_docs FROM documents), y AS (SELECT name, least(chunk_id // greatest(all_docs // 3, 1), 2) AS third, chunk_id, reason FROM k, total WHERE reason IS NOT NULL),
picks AS (SELECT name, third, count(*) AS chunks, min(chunk_id) AS chunk_id, arg_min(reason, chunk_id) AS reason FROM y GROUP BY ALL), z AS (SELECT picks.*, text FROM picks JOIN c USING (chunk_id)), {window_sql('z', 'text', 'name')}
SELECT name, arg_min(reason, chunk_id) AS reason, CAST(sum(chunks) AS BIGINT) AS chunks, sha256(string_agg(sample, chr(10) ORDER BY third)) AS samples FROM windows GROUP BY name""")
def rejected_samples(spark, d):
    """Rejected names with a window of text from each third of the documents."""
    texts = symbol_chunks(spark, d)
    rows = symbols.judged(texts, **LISTS).withColumnRenamed("chunk_id", "index")
    found = symbols.rejected_samples(rows, texts.withColumnRenamed("chunk_id", "index"), table(spark, d, "documents").count())
    return found.select("name", "reason", "chunks", F.sha2(F.array_join("samples", "\n"), 256).alias("samples"))


@query(rf"""WITH d AS (SELECT doc_id, text, nullif(regexp_extract(substr(text, length(text) // 2 + 1), '([A-Za-z]{{4,}})', 1), '') AS token FROM documents), {window_sql('d', 'text', 'token')} SELECT doc_id, sample FROM windows""")
def sample_windows(spark, d):
    """The window around a word from the middle of each text, wherever it stands first."""
    half = F.expr("substr(text, length(text) div 2 + 1)")
    rows = table(spark, d, "documents").withColumn("token", F.regexp_extract(half, "([A-Za-z]{4,})", 1))
    return rows.withColumn("token", F.when(F.col("token") != "", F.col("token"))).select("doc_id", T.sample_window(F.col("text"), F.col("token")).alias("sample"))


@query(r"SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\pL\pN_]+')) AS name FROM documents) WHERE regexp_full_match(name, '[A-Z][A-Za-z0-9_]+') GROUP BY 1")
def prose_mentions(spark, d):
    return symbols.mentions(chunks(spark, d))


# Pages


@query(r"""WITH p AS (SELECT page_id, regexp_replace(html, '(?s)<(script|style|nav|footer)[^>]*>.*?</(script|style|nav|footer)>', '', 'g') AS h, html FROM pages)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS title,
 contains(h, '<article>') AS article FROM p""")
def page_titles(spark, d):
    page = table(spark, d, "pages").withColumn("page", html.parsed("html"))
    return page.select("page_id", F.col("page.title").alias("title"), F.exists("page.containers", lambda c: c["tag"] == "article").alias("article"))


def plain_sql(html_sql: str) -> str:
    """Text of a piece of HTML in SQL: without tags, entities read, white space collapsed."""
    text = f"regexp_replace({html_sql}, '<[^>]*>', '', 'g')"
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{sign}')"
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


def between_sql(start: str, end: str) -> str:
    return f"regexp_extract(html, '(?s){start}(.*?)({end}|$)', 1)"


@query(f"""WITH t AS (SELECT page_id, {plain_sql(between_sql('<title>', '</title>'))} AS title, {plain_sql(between_sql('<article>', '</article>'))} AS article, {plain_sql(between_sql('<div class="ad">', '</div>') + " || " + between_sql('<article>', '</article>'))} AS body, {plain_sql(between_sql('<h1>', '</h1>'))} AS h1 FROM pages)
SELECT page_id, title, CASE WHEN length(article) >= 200 THEN 'article' ELSE 'body' END AS container, CAST(CASE WHEN length(article) >= 200 THEN length(article) ELSE length(body) END AS INTEGER) AS chars, CAST(0 AS INTEGER) AS links, '# ' || h1 AS head FROM t""")
def html_extraction(spark, d):
    page = table(spark, d, "pages").withColumn("page", html.parsed("html"))
    chosen = html.container(F.col("page"))
    head = F.substring_index(html.markdown(F.col("page")), "\n\n", 1)
    return page.select("page_id", "page.title", chosen["tag"].alias("container"), chosen["chars"].alias("chars"), chosen["links"].alias("links"), head.alias("head"))


@query("SELECT page_id, round(least(length(html) / 1000.0, 5) + (length(html) - length(url)) * 5.0 / length(html) + CASE WHEN contains(url, '/en/') THEN 3 ELSE 0 END, 6) AS score, CASE WHEN page_id % 9 = 0 THEN 'ReactCsr' WHEN page_id % 9 = 1 THEN 'BlazorWasm' END AS framework FROM pages")
def frame_scores(spark, d):
    k = F.col("page_id") % 9
    marked = F.concat("html", F.when(k == 0, "<div data-reactroot>").when(k == 1, "<p ng-version=1><script src=_framework/blazor.x.js>").when(k == 2, "<pre>__NUXT__</pre>").otherwise(""))
    return table(spark, d, "pages").select("page_id", F.round(html.frame_score(F.length("html"), F.length("url"), F.col("url").contains("/en/")), 6).alias("score"), html.framework(marked).alias("framework"))


# Files


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'INF' WHEN 1 THEN 'WRN' ELSE 'ERR' END AS level, CAST(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS details FROM events WHERE event_id % 3 > 0 AND (event_type = 'click' OR event_id % 2 = 0)""")
def log_file(spark, d):
    """Events written as a log, read back as entries, and those of a level that name a click or have a detail that does."""
    path = folder(spark)
    e = F.col("event_id")
    level = F.when(e % 3 == 0, "INF").when(e % 3 == 1, "WRN").otherwise("ERR")
    head = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" +00:00 ["), level, F.lit("] "), "event_type", F.lit(" #"), e.cast("string"))
    lines = F.when(e % 2 == 0, F.concat(head, F.lit("\n  at a Click\n  at b"))).otherwise(head)
    table(spark, d, "events").select(lines.alias("value")).write.text(path)
    found = files.log_filter(files.log_entries(spark, path), "WRN", "click")
    return found.select(F.regexp_extract("message", "#([0-9]+)", 1).cast("long").alias("event_id"), "level", F.size("details").alias("details"))


@query("SELECT doc_id AS chunk_id, source AS library_id, CAST(0 AS INTEGER) AS damaged FROM documents WHERE doc_id % 10 = 0")
def bundle_round_trip(spark, d):
    path = folder(spark)
    rows = table(spark, d, "documents").where("doc_id % 10 = 0").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("library_id"), F.col("text").alias("content"), F.lit("e1").alias("encoder"))
    files.export_bundle(rows, path)
    back = files.import_bundle(spark, path, "chunk_id long, library_id string, content string, encoder string")
    met = back.join(rows.select("chunk_id", F.col("content").alias("was")), "chunk_id")
    return met.select("chunk_id", "library_id", (F.col("content") != F.col("was")).cast("int").alias("damaged"))


@query("SELECT 'pkg' || p_partkey AS package_id, CASE WHEN p_partkey % 2 = 0 THEN '1.' || (p_partkey % 7) END AS version FROM part WHERE p_partkey % 5 <> 0")
def requirements_file(spark, d):
    path = folder(spark)
    k = F.col("p_partkey")
    name = F.concat(F.lit("pkg"), k.cast("string"))
    line = F.when(k % 5 == 0, F.lit("# note")).when(k % 2 == 0, F.concat(name, F.lit("[x] >= 1."), (k % 7).cast("string"), F.lit(",<9 # c"))).otherwise(name)
    table(spark, d, "part").select(line.alias("value")).write.text(path)
    return files.requirements(spark, path)
