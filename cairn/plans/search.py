"""Searches end to end, over chunks, their vectors, and a stored index.

Chunks: chunk_id, library_id, version, category, content; vectors: chunk_id, library_id, version, embedding; published:
library_id, version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.text import identifiers, is_identifier_shaped
from cairn.operators import bm25, segments, vectors
from cairn.operators.subjects import boost, enriched
from cairn.operators.symbols import inferred_subject
from cairn.sources.scratch import written


def in_scope(chunks: DataFrame, published: DataFrame, library: str | None, category: str | None, subject: str | None) -> DataFrame:
    """Chunks of published versions that a search may return."""
    rows = chunks.join(published.select("library_id", "version").distinct(), ["library_id", "version"], "left_semi")
    for column, value in (("library_id", library), ("category", category)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows if subject is None else rows.where(F.array_contains("subject_ids", subject))


def names_asked(spark: SparkSession, text: str) -> DataFrame:
    """nth, term: the distinct identifiers of a query, in order."""
    return spark.range(1).select(F.posexplode(F.array_distinct(identifiers(F.lit(text)))).alias("nth", "term"))


def search_docs(
    chunks: DataFrame, embedded: DataFrame, published: DataFrame, index: segments.Index | None, text: str, query_vector: list[float], k: int = 5, library: str | None = None, category: str | None = None,
    subject: str | None = None, inferred: str | None = None, strategy: str = "Onnx", terms: DataFrame | None = None, assignments: DataFrame | None = None, catalogs: DataFrame | None = None, relevance: Column | None = None,
) -> DataFrame:
    """chunk_id, library_id, category, content, score, place: hybrid search over published versions.

    BM25 takes part only inside one library, from its stored index.  A subject that the query is about (``inferred``, or the one that
    ``terms``, subject_id and term, find in it) lifts its chunks, an explicit one filters.  Inside one library, a query that
    looks like an identifier also gets the chunks of the names in it: they stand in front of the candidates with a score of 0.  If
    there is a model and enough candidates, the first ``RERANK_MOST`` go by ``relevance``, an expression over ord, their
    place; without one, all go by score.  With ``assignments`` and ``catalogs``, for chunks with a revision_id and a
    taxonomy_version, taxonomy_version, needs_review and subjects come with each result.
    """
    spark = chunks.sparkSession
    if inferred is None and subject is None and terms is not None:
        asked = inferred_subject(spark.createDataFrame([(0, text)], "q int, text string"), terms, "q", "text").first()
        inferred = asked["subject_id"] if asked else None
    rows = in_scope(chunks, published, library, category, subject)
    keep = ["chunk_id", "subject_ids"] if inferred is not None else ["chunk_id"]
    found = vectors.top_k(embedded.join(rows.select("chunk_id"), "chunk_id", "left_semi"), query_vector, vectors.candidate_count(k))
    found = found.join(rows.select(*keep), "chunk_id") if inferred is not None else found
    lift = boost(F.col("subject_ids"), inferred) if inferred is not None else None
    if library is not None and index is not None:
        hybrid = vectors.blended(found, bm25.search(index, text, library), lift)
    else:
        hybrid = found.select("chunk_id", (F.col("cosine") + (F.lit(0.0) if lift is None else lift)).alias("score"))
    hybrid = written(hybrid)  # ``candidate_count`` rows at most
    if library is not None and "qualified_name" in chunks.columns and spark.range(1).select(is_identifier_shaped(F.lit(text)).alias("i")).first()["i"]:
        named = known_names(names_asked(spark, text), in_scope(chunks, published, library, None, subject))
        hybrid = written(vectors.injected(named, hybrid))
    else:
        hybrid = hybrid.withColumn("ord", F.lit(1))
    active = vectors.should_rerank(strategy, hybrid.count())
    order = Window.orderBy(*([F.col("block")] if active else []), F.round("score", 6).desc(), "chunk_id")
    ranked = hybrid.withColumnRenamed("ord", "block").withColumn("ord", F.row_number().over(order)).drop("block")
    ranked = vectors.by_relevance(ranked, relevance) if active else ranked.orderBy("ord")
    top = ranked.limit(k).select("chunk_id", "score", F.col("ord").cast("long").alias("place"))
    whole = chunks.join(top.select("chunk_id"), "chunk_id", "left_semi") if library is not None else rows
    out = top.join(whole, "chunk_id").select("chunk_id", "library_id", "category", "content", "score", "place", *(["revision_id", "taxonomy_version"] if assignments is not None else []))
    if assignments is None or catalogs is None:
        return out.drop("revision_id", "taxonomy_version")
    return out.drop("revision_id", "taxonomy_version").join(enriched(out, assignments, catalogs), "chunk_id", "left")


def class_reference(chunks: DataFrame, name: str, published: DataFrame | None = None, literal: bool = False) -> DataFrame:
    """Chunks of a qualified name: exact ones, else those that match it as a pattern in any case."""
    rows = chunks if published is None else chunks.join(published.select("library_id", "version").distinct(), ["library_id", "version"], "left_semi")
    exact = rows.where(F.col("qualified_name") == name)
    pattern = F.lower("qualified_name").contains(name.lower()) if literal else F.col("qualified_name").rlike(f"(?i){name}")
    return exact.unionByName(unless_any(rows.where(pattern), exact))


def unless_any(rows: DataFrame, others: DataFrame) -> DataFrame:
    """``rows`` if there are no ``others``, else none."""
    there = others.select(F.lit(1).alias("there")).limit(1)
    return rows.withColumn("there", F.lit(1)).join(there, "there", "left_anti").drop("there")


def library_overview(chunks: DataFrame, embedded: DataFrame, query_vector: list[float], library: str, k: int = 5) -> DataFrame:
    """chunk_id, cosine: the nearest Overview chunks of a library, or of any category if it has none."""
    rows = chunks.where(F.col("library_id") == library)
    some = rows.where("category = 'Overview'")
    either = some.unionByName(unless_any(rows, some))
    return vectors.top_k(embedded.join(either.select("chunk_id"), "chunk_id", "left_semi"), query_vector, k)


def known_names(text_terms: DataFrame, chunks: DataFrame, most: int = 4) -> DataFrame:
    """chunk_id of chunks whose qualified name is one of the first ``most`` identifiers of a query, in any case.

    ``text_terms``: nth, term.
    """
    names = text_terms.where(F.col("nth") < most).select(F.lower("term").alias("name")).distinct()
    return chunks.select("chunk_id", F.lower("qualified_name").alias("name")).join(names, "name", "left_semi").select("chunk_id").distinct()
