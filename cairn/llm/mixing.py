"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words.  Each source's documents are laid in a random fixed order (MD5 of a seed, the id and the text), up to three
times over, and the mix takes the words before its target; so a source's taken words are its target, rounded, and only the
document at the end is cut.  The order is cut into blocks.  A tree splits each source's exact number of taken blocks between
parts of the output shards by multivariate hypergeometric draws, down to single shards; a shard so draws that many blocks,
disjoint from all others, of each source's permuted blocks, and shuffles their documents locally.

The tree is a table of (shards, source, blocks) that is split some levels at a time.  A draw over very many sources is made
over buckets of sources first and then inside each bucket, which is the same draw; so a group of the split holds a bounded
number of rows.  Blocks are permuted by swap-or-not rounds, a keyed permutation of any number of blocks, so no source's
blocks are gathered or sorted.  Targets come from running sums over ranges of sources.  The driver sees totals only.

A source may hold any share of the rows: its documents are dealt by ranges of their hash, range sizes are summed before
they are shuffled, and offsets come from the sums.

Null texts have no words and are never taken; null sources are one source, the last; null ids are told apart by their
texts.  Repeated rows are mixed like any other; rows equal in id and text share a range.  Very long texts are one
document, cut only at a source's end.  An empty table gives an empty mix.  Other columns are carried through by
``mixed_documents`` under their own names, whatever these are.  Reruns agree, as every draw follows from the seed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.storage import column, written
from cairn.llm.words import count_words, words_of

#: A source's taken words are at most so many times its own.
MOST_TIMES = 3
WEIGHTS = (1, 2, 3)
#: Words of a block, at least: blocks grow so that there are no more than so many. Words of a shard.
BLOCK_WORDS, MOST_BLOCKS, SHARD_WORDS = 4096, 1 << 28, 1 << 20
#: Documents of a range of hashes, about, over all sources.
RANGE_ROWS = 1024
#: Shards, or groups of them, that a step of the tree splits into; sources of a bucket.
FAN, BUCKET_SOURCES = 256, 4096
#: Rounds of the permutation.
ROUNDS = 24


def source_key(source: Column) -> Column:
    """Sorts like the source by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each of ``sums``, its total over the rows before this one in ``order``, which has no ties.

    Rows are ranged, summed in their ranges, and shifted by the sums of the ranges before.
    """
    named = rows.select("*", *[c.alias(f"term_{n}") for n, c in sums.items()], F.struct(*order).alias("order"))
    ranged = written(named.repartitionByRange("order").withColumn("range_no", F.spark_partition_id()))
    totals = ranged.groupBy("range_no").agg(*[F.sum(f"term_{n}").alias(f"all_{n}") for n in sums])
    earlier = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    shifts = totals.select("range_no", *[F.coalesce(F.sum(f"all_{n}").over(earlier), F.lit(0)).alias(f"shift_{n}") for n in sums])
    inside = Window.partitionBy("range_no").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    met = ranged.join(written(shifts), "range_no")
    return met.select(*rows.columns, *[(F.col(f"shift_{n}") + F.coalesce(F.sum(f"term_{n}").over(inside), F.lit(0))).alias(n) for n in sums])


def targets(sources: DataFrame) -> DataFrame:
    """Adds weight and target to ``sources`` (key, source_size), a row for each source.

    Targets are the level at which all sources' shares of it, each stopping at its limit, add up to all sizes: sources are
    taken in the order in which they reach their limit, each against what those before it have left.
    """
    nth = running(sources, [F.col("key")], {"nth": F.lit(1).cast("long")})
    weighed = nth.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("nth") % len(WEIGHTS) + 1).cast("int"))).drop("nth")
    limit = F.col("source_size") * MOST_TIMES / F.col("weight")
    before = written(running(weighed, [limit, F.col("key")], {"words_before": F.col("source_size"), "weights_before": F.col("weight").cast("long")}))
    every = before.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()
    left = F.lit(every["words"] or 0) - F.col("words_before") * MOST_TIMES
    top = before.agg(F.max(left / (F.lit(every["weights"] or 1) - F.col("weights_before")))).first()[0]
    share = F.least(F.lit(float(top or 0.0)) * F.col("weight"), F.col("source_size").cast("double") * MOST_TIMES)
    return before.select("key", "source_size", "weight", share.alias("target"))


def split(quotas: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source (columns) for each part of ``sizes`` blocks (rows), drawn down a binary tree; columns add up to ``quotas``."""
    if len(sizes) == 1:
        return quotas[None, :]
    half = len(sizes) // 2
    drawn = rng.multivariate_hypergeometric(quotas, int(sizes[:half].sum()), method="marginals")
    return np.concatenate([split(drawn, sizes[:half], rng), split(quotas - drawn, sizes[half:], rng)])


def dealt(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """key, n_blocks, shard, first, n: which of the permuted blocks of each of ``sources`` (key, n_blocks) a shard draws.

    Shard i holds blocks i * N div shards to (i + 1) * N div shards of all N, so shards are equal to a block.
    """
    facts = sources.agg(F.sum("n_blocks").alias("n"), F.count(F.lit(1)).alias("sources")).first()
    total, n_buckets = facts["n"] or 0, max(1, facts["sources"] // BUCKET_SOURCES)

    def parts(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the groups of shards that ``lo`` to ``hi`` is split into, and their numbers of blocks."""
        n = min(FAN, hi - lo)
        bounds = np.array([lo + (hi - lo) * i // n for i in range(n + 1)], dtype=np.int64)
        return bounds, np.diff(np.array([total * int(b) // shards for b in bounds], dtype=np.int64))

    def buckets(rows: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(rows["lo"].iloc[0]), int(rows["hi"].iloc[0])
        rows = rows.sort_values("bucket")
        shares = split(rows["n"].to_numpy(np.int64), parts(lo, hi)[1], np.random.default_rng([seed, lo, hi]))
        return pd.DataFrame({"lo": lo, "hi": hi, "bucket": rows["bucket"], "shares": list(shares.T.copy())})

    def inside(rows: pd.DataFrame) -> pd.DataFrame:
        lo, hi, bucket = (int(rows[c].iloc[0]) for c in ("lo", "hi", "bucket"))
        rows = rows.sort_values("key")
        quotas = rows["n"].to_numpy(np.int64)
        shares = split(quotas, np.array(rows["shares"].iloc[0], dtype=np.int64), np.random.default_rng([seed, lo, hi, bucket]))
        starts = np.concatenate([np.zeros((1, len(quotas)), np.int64), np.cumsum(shares, axis=0)[:-1]])
        bounds = parts(lo, hi)[0]
        part, source = np.nonzero(shares)
        first = rows["first"].to_numpy(np.int64)[source] + starts[part, source]
        return pd.DataFrame({"key": rows["key"].to_numpy()[source], "n_blocks": rows["n_blocks"].to_numpy()[source], "bucket": bucket, "lo": bounds[part], "hi": bounds[part + 1], "first": first, "n": shares[part, source]})

    node = "key string, n_blocks long, bucket long, lo long, hi long, first long, n long"
    zero = F.lit(0).cast("long")
    nodes = sources.where("n_blocks > 0").select("key", "n_blocks", F.pmod(F.xxhash64("key"), F.lit(n_buckets)).alias("bucket"), zero.alias("lo"), F.lit(shards).cast("long").alias("hi"), zero.alias("first"), F.col("n_blocks").alias("n"))
    width = shards
    while width > 1:
        sums = nodes.where("hi - lo > 1").groupBy("lo", "hi", "bucket").agg(F.sum("n").alias("n"))
        shares = sums.groupBy("lo", "hi").applyInPandas(buckets, "lo long, hi long, bucket long, shares array<long>")
        step = nodes.where("hi - lo > 1").join(written(shares), ["lo", "hi", "bucket"]).groupBy("lo", "hi", "bucket").applyInPandas(inside, node)
        nodes = written(step.unionByName(nodes.where("hi - lo = 1")))
        width = -(-width // FAN)
    return nodes.select("key", "n_blocks", F.col("lo").alias("shard"), "first", "n")


def permuted(at: Column, n: Column, key: Column, seed: int) -> Column:
    """The place of block ``at`` of ``n`` in a keyed permutation: rounds that swap a block with its partner, or not."""

    def step(x: Column, i: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(seed), key, i), n) - x, n)
        swap = F.xxhash64(F.lit(seed), key, i, F.greatest(x, partner)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), at, step)


def _drawn(docs: DataFrame, seed: int, carry: tuple[str, ...]) -> DataFrame:
    """A row for each draw of ``docs``, or with null words for a document without: key, range, nth (which tell a document),
    doc_id, size, source_size, target, copy, words, shard, place, and ``carry`` columns as carried_0 and so on."""
    n_rows, digits = docs.count(), 0
    while n_rows >> 4 * digits > RANGE_ROWS and digits < 7:
        digits += 1
    drawn_by = F.md5(F.concat_ws(" ", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(F.col("text").cast("string")).cast("string")))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source").cast("string")).alias("key"), count_words(F.col("text")).alias("size"), drawn_by.alias("drawn_by"), F.substring(drawn_by, 1, digits).alias("range"),
        *[column(c).alias(f"carried_{i}") for i, c in enumerate(carry)],
    )
    sized = sized if carry else written(sized)  # rows that carry texts are not written, but counted twice
    ranges = written(sized.groupBy("key", "range").agg(F.sum("size").alias("range_size")))
    per_source = written(targets(ranges.groupBy("key").agg(F.sum("range_size").alias("source_size"))))
    total = per_source.agg(F.sum("source_size")).first()[0] or 0
    block, shards = max(BLOCK_WORDS, total // MOST_BLOCKS), max(1, -(-total // SHARD_WORDS))
    a_pass = F.greatest(F.lit(1).cast("long"), F.expr(f"(source_size + {block - 1}) div {block}"))
    own = F.greatest("source_size", F.lit(1).cast("long"))
    plan = per_source.withColumn("take", F.rint("target").cast("long")).withColumn("a_pass", a_pass).withColumn("own", own)
    plan = plan.withColumn("n_blocks", F.when(F.col("source_size") > 0, F.expr(f"(take div own) * a_pass + (take % own + {block - 1}) div {block}")).otherwise(F.lit(0)).cast("long"))
    plan = written(plan.select("key", "source_size", "target", "take", "a_pass", "n_blocks"))

    wide = F.greatest(F.lit(1).cast("long"), F.expr(f"n_blocks div {shards}"))
    deal = dealt(plan.select("key", "n_blocks"), shards, seed).withColumn("wide", wide)
    bins = deal.select("key", "shard", "first", "n", F.explode(F.sequence(F.expr("first div wide"), F.expr("(first + n - 1) div wide"))).alias("bin"))
    bins = written(bins)

    offsets = ranges.select("key", "range", F.coalesce(F.sum("range_size").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("range_start"))
    order = Window.partitionBy("key", "range").orderBy("drawn_by", "doc_id", "size")
    placed = sized.join(written(offsets), ["key", "range"]).select("*", F.row_number().over(order).alias("nth"), (F.col("range_start") + F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("start"))
    piece = F.expr(f"""
        filter(transform(sequence(0, {MOST_TIMES - 1}), c -> named_struct('copy', c,
            'words', greatest(0L, least(size, take - c * source_size - start)),
            'block', c * a_pass + start div {block})), d -> d.words > 0)""")
    each = placed.join(plan, "key").withColumn("draw", F.explode_outer(piece))
    place = permuted(F.col("draw.block"), F.col("n_blocks"), F.col("key"), seed)
    each = each.withColumn("at", F.when(F.col("draw").isNotNull(), place)).withColumn("bin", F.expr(f"at div greatest(1L, n_blocks div {shards})"))
    met = each.join(bins.withColumnRenamed("key", "bin_key"), (F.col("key") == F.col("bin_key")) & (each["bin"] == bins["bin"]) & (F.col("at") >= F.col("first")) & (F.col("at") < F.col("first") + F.col("n")), "left")
    return met.select("key", "range", "nth", "doc_id", "size", "source_size", "target", "draw.copy", "draw.words", "shard", F.xxhash64("drawn_by", "draw.copy").alias("place"), *[f"carried_{i}" for i in range(len(carry))])


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """A row for each of ``docs`` (doc_id, source, text): doc_id, size, source_size, target and draws.

    ``draws`` is an array of what the mix takes of the document: copy, words (from the start), shard, and place, by which
    a shard is sorted.  Its words add up to at most three times the document's.
    """
    draw = F.when(F.col("words").isNotNull(), F.struct("copy", "words", "shard", "place"))
    rows = _drawn(docs, seed, ()).groupBy("key", "range", "nth", "doc_id", "size", "source_size", "target").agg(F.array_sort(F.collect_list(draw)).alias("draws"))
    return rows.select("doc_id", "size", "source_size", "target", "draws")


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: rows of ``docs``, as often as they are taken, shard by shard and shuffled inside each.

    The document at the end of a source's target keeps its first words, a space apart; n_chars, if there, follows the text.
    """
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select("doc_id", "source", "text", *[column(c).alias(n) for c, n in own.items()])
    drawn = _drawn(rows, seed, tuple(own.values())).where("words IS NOT NULL")
    drawn = drawn.select("size", "words", "shard", "place", *[F.col(f"carried_{i}").alias(n) for i, n in enumerate(own.values())])
    text, part = F.col(own["text"]), F.col("words") < F.col("size")
    cut = F.array_join(F.slice(words_of(text), F.lit(1), F.col("words").cast("int")), " ")
    laid = drawn.repartition("shard").sortWithinPartitions("shard", "place").withColumn(own["text"], F.when(part, cut).otherwise(text))
    if "n_chars" in own:
        kind = docs.schema["n_chars"].dataType
        laid = laid.withColumn(own["n_chars"], F.when(part, F.length(text).cast(kind)).otherwise(F.col(own["n_chars"])))
    return laid.select(*[F.col(n).alias(c) for c, n in own.items()])
