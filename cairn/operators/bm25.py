"""BM25: postings, lengths and statistics as tables, scored by joins that Catalyst plans, and checks of a stored index.

A search of a stored index (``segments``) reads its manifest, the folders of its terms' buckets, and of those files the row
groups that hold them.  ``scores`` answers one query over texts that have no index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import identifier_terms, let, prose_tokens, query_terms
from cairn.operators.segments import Index, bucket_of, terms_in
from cairn.sources.scratch import written

#: Saturation and length weight. Fixed values.
K1, B = 1.5, 0.75


def postings(chunks: DataFrame) -> DataFrame:
    """chunk_id, term, tf of ``chunks`` (chunk_id, content), counted in each row: prose tokens and identifier terms together."""
    rows = chunks.select("chunk_id", F.explode(terms_in(F.col("content"))["terms"]).alias("t"))
    return rows.select("chunk_id", "t.term", "t.tf")


def lengths(chunks: DataFrame) -> DataFrame:
    """chunk_id and its number of terms, if it has any; no shuffle."""
    n = F.size(prose_tokens(F.col("content"))) + F.size(identifier_terms(F.col("content")))
    return chunks.select("chunk_id", n.cast("long").alias("doc_length")).where("doc_length > 0")


def statistics(lens: DataFrame) -> DataFrame:
    return lens.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("doc_length"), F.lit(0.0)).alias("avg_length"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def contribution(weight: Column, tf: Column, length: Column, avg: Column) -> Column:
    mean = F.when(avg <= 0, F.lit(1.0)).otherwise(avg)
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.coalesce(length, F.floor(avg)) / mean))


def scores(chunks: DataFrame, query: str) -> DataFrame:
    """chunk_id, bm25 of every chunk that has a term of ``query``.

    Texts are read once: lengths and the query's terms are written, and frequencies, statistics and scores come from those.
    """
    spark = chunks.sparkSession
    terms = spark.range(1).select(query_terms(F.lit(query)).alias("t")).first()["t"]
    every = F.concat(prose_tokens(F.col("content")), identifier_terms(F.col("content")))
    wanted = lambda ts: F.filter(ts, lambda t: t.isin(terms)) if terms else F.array().cast("array<string>")
    seen = chunks.select("chunk_id", let(every, lambda ts: F.struct(F.size(ts).cast("long").alias("doc_length"), wanted(ts).alias("hits"))).alias("s"))
    rows = written(seen.select("chunk_id", "s.doc_length", "s.hits")).where("doc_length > 0")  # a filter before would read texts twice
    stats = statistics(rows).first()
    hits = rows.select("chunk_id", "doc_length", F.explode("hits").alias("term")).groupBy("chunk_id", "doc_length", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = idf(F.lit(stats["n_docs"]), F.col("df"))
    each = hits.join(df, "term").select("chunk_id", contribution(weight, F.col("tf"), F.col("doc_length"), F.lit(float(stats["avg_length"]))).alias("s"))
    return each.groupBy("chunk_id").agg(F.sum("s").alias("bm25"))


def terms_of(spark: SparkSession, query: str) -> list[str]:
    return spark.range(1).select(query_terms(F.lit(query)).alias("t")).first()["t"]


def search(index: Index, query: str, library: str | None = None) -> DataFrame:
    """chunk_id, bm25 of every chunk of a library (of all, taken as one) that has a term of ``query``."""
    terms = terms_of(index.spark, query)
    live = index.manifest if library is None else index.manifest.where(F.col("library_id") == library)
    live = live if terms else live.limit(0)
    stats = live.agg(F.sum("n_docs").alias("n"), F.sum("total_length").alias("total")).first()
    n = stats["n"] or 0
    hits = index.postings_of(live, terms)
    hits = hits if library is None else hits.where(F.col("library_id") == library)
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    each = hits.join(df, "term").select("chunk_id", contribution(idf(F.lit(n), F.col("df")), F.col("tf"), F.col("doc_length"), F.lit((stats["total"] or 0) / max(n, 1))).alias("s"))
    return each.groupBy("chunk_id").agg(F.sum("s").alias("bm25"))


def top_n(scored: DataFrame, n: int) -> DataFrame:
    if n <= 0:
        raise ValueError("n must be positive")
    return scored.orderBy(F.round("bm25", 6).desc(), "chunk_id").limit(n)


def damaged(postings: DataFrame, lengths: DataFrame) -> DataFrame:
    """chunk_id, total, doc_length of chunks whose stored postings don't add up to their stored length, or that have only one
    of the two; none, if all is well."""
    sums = postings.groupBy("chunk_id").agg(F.sum("tf").alias("total"))
    both = sums.join(lengths.select("chunk_id", "doc_length"), "chunk_id", "full_outer")
    return both.where("NOT (total <=> doc_length)").select("chunk_id", "total", "doc_length")


def malformed(postings: DataFrame, lengths: DataFrame) -> DataFrame:
    """term, chunk_id, problem of postings that are blank, in the wrong bucket, repeated, not counted, or of an unknown chunk."""
    rows = postings.groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min("tf").alias("least"), F.bool_or(F.col("bucket") != bucket_of(F.col("term"), F.col("buckets"))).alias("astray"))
    met = rows.join(lengths.select("chunk_id", F.lit(True).alias("known")), "chunk_id", "left")
    blank = F.coalesce(F.trim("term") == "", F.lit(True))
    problem = F.when(blank, "Blank").when(F.col("astray"), "WrongBucket").when(F.col("n") > 1, "Repeated").when(F.coalesce("least", F.lit(0)) < 1, "NotCounted").when(F.col("known").isNull(), "UnknownChunk")
    return met.select("term", "chunk_id", problem.alias("problem")).where("problem IS NOT NULL")


def miscounted(stats: DataFrame, lengths: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """library_id, problem where stored statistics differ from the stored lengths, or a length is below one."""
    facts = lengths.groupBy("library_id").agg(F.count(F.lit(1)).alias("n"), F.avg("doc_length").alias("mean"), F.min("doc_length").alias("least"))
    met = stats.join(facts, "library_id", "full_outer")
    problem = F.when(~F.col("n_docs").eqNullSafe(F.col("n")), "Count").when(F.col("least") < 1, "Length").when(F.abs(F.col("avg_length") - F.col("mean")) > tolerance, "Average")
    return met.select("library_id", problem.alias("problem")).where("problem IS NOT NULL")
