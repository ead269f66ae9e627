"""Exact vector search, blending with BM25, and rerank order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.sources.scratch import written

BM25_WEIGHT, SUBJECT_BOOST = 0.4, 0.05
RERANK_MOST, RERANK_LEAST, INJECT_MOST = 25, 6, 5


def cosine(v: Column, query: list[float]) -> Column:
    """Cosine with a constant vector; 0 for unequal lengths and zero vectors."""
    q = F.array(*[F.lit(float(x)) for x in query])
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    dot = add(F.zip_with(v, q, lambda a, b: a.cast("double") * b))
    norm = F.sqrt(add(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    q_norm = sum(float(x) ** 2 for x in query) ** 0.5
    return F.when((F.size(v) == len(query)) & (norm > 0) & F.lit(q_norm > 0), dot / (norm * (q_norm or 1.0))).otherwise(F.lit(0.0))


def top_k(vectors: DataFrame, query: list[float], k: int = 5, where: Column | None = None) -> DataFrame:
    """chunk_id, cosine of the nearest of ``vectors`` (chunk_id, embedding)."""
    rows = vectors.where(F.col("embedding").isNotNull())
    rows = rows if where is None else rows.where(where)
    return rows.select("chunk_id", cosine(F.col("embedding"), query).alias("cosine")).orderBy(F.round("cosine", 6).desc(), "chunk_id").limit(k)


def top_k_by_library(vectors: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """The nearest ``k`` of each library; partial limits come before the shuffle."""
    rows = vectors.where(F.col("embedding").isNotNull()).select("library_id", "chunk_id", cosine(F.col("embedding"), query).alias("cosine"))
    order = Window.partitionBy("library_id").orderBy(F.round("cosine", 6).desc(), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


INDEX = ["profile", "library_id", "version"]


def stored(vectors: DataFrame, path: str) -> None:
    """Writes ``vectors`` (profile, library_id, version, chunk_id, embedding) in folders by profile, library and version."""
    vectors.repartition(*INDEX).write.partitionBy(*INDEX).parquet(path)


def scoped(spark: SparkSession, path: str, profile: str | None, library: str | None = None, version: str | None = None) -> DataFrame:
    """The stored vectors of one version, of all versions of a library, or of a whole profile: only those folders are read.

    A version without a library is no scope: as without both.
    """
    schema = "chunk_id long, embedding array<float>, profile string, library_id string, version string"
    rows = spark.read.schema(schema).parquet(path).where(F.col("profile") == (profile or ""))
    if library is None:
        return rows
    rows = rows.where(F.col("library_id") == library)
    return rows if version is None else rows.where(F.col("version") == version)


def candidate_count(k: int) -> int:
    return max(50, k * 5)


def blended(candidates: DataFrame, bm25: DataFrame, boost: Column | None = None) -> DataFrame:
    """chunk_id, score: vector candidates only; BM25 is divided by the maximum over all scored chunks.

    ``boost`` is an expression over the candidates' columns.
    """
    scored = written(bm25)  # for the maximum and the join
    most = scored.agg(F.max("bm25").alias("m")).first()["m"] or 0.0
    part = F.coalesce("bm25", F.lit(0.0)) / F.lit(most) if most > 0 else F.lit(0.0)
    score = (1 - BM25_WEIGHT) * F.col("cosine") + BM25_WEIGHT * part + (F.lit(0.0) if boost is None else boost)
    return candidates.join(scored, "chunk_id", "left").select("chunk_id", score.alias("score"))


def should_rerank(strategy: str, candidates: int) -> bool:
    """Only with a model, and only if there are enough candidates for an order to matter."""
    return strategy == "Onnx" and candidates >= RERANK_LEAST


def over_published(vectors: DataFrame, published: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """The nearest ``k`` chunks over the published version of each library: ``vectors`` (library_id, version, chunk_id, embedding),
    ``published`` (library_id, version)."""
    rows = vectors.join(published.select("library_id", "version").distinct(), ["library_id", "version"], "left_semi").where(F.col("embedding").isNotNull())
    return rows.select("library_id", "chunk_id", cosine(F.col("embedding"), query).alias("cosine")).orderBy(F.round("cosine", 6).desc(), "chunk_id").limit(k)


def by_relevance(ranked: DataFrame, relevance: Column | None = None) -> DataFrame:
    """``ranked`` (ord, ...) with the first candidates by relevance and the rest behind them in their order."""
    rel = relevance if relevance is not None else 1 - 0.01 * (F.col("ord") - 1)
    rows = ranked.withColumn("block", (F.col("ord") > RERANK_MOST).cast("int")).withColumn("relevance", F.when(F.col("block") == 0, rel))
    return rows.orderBy("block", F.desc("relevance"), "ord")


def reranked(ranked: DataFrame, k: int, relevance: Column | None = None) -> DataFrame:
    """The first candidates by relevance, the rest behind them in their order; ``ranked`` (chunk_id, score) is a top list."""
    order = Window.orderBy(F.round("score", 6).desc(), "chunk_id")
    return by_relevance(ranked.withColumn("ord", F.row_number().over(order)), relevance).limit(k)


def injected(matches: DataFrame, hybrid: DataFrame) -> DataFrame:
    """Exact name matches (chunk_id) that hybrid lacks, few, in front with score 0; then hybrid (chunk_id, score)."""
    new = matches.distinct().join(hybrid, "chunk_id", "left_anti").orderBy("chunk_id").limit(INJECT_MOST)
    return new.select("chunk_id", F.lit(0.0).alias("score"), F.lit(0).alias("ord")).unionByName(hybrid.select("chunk_id", "score", F.lit(1).alias("ord")))
