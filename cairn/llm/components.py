"""Connected components of links by alternating stars, in written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.storage import written

#: Rows of a key that one task may hold; a key with more is a hub, of which there are ``MOST_HUBS`` at most.
MOST_ROWS, MOST_HUBS = 65536, 100_000


def spread_join(rows: DataFrame, table: DataFrame, key: str, n_rows: int) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each ``key`` and ``n``, how many rows have it.

    Rows of a hub stay where they are: hubs are written apart and sent to every task.  ``n_rows`` rows hold
    n_rows / limit hubs at most, and the limit grows with them, so that table's size is bounded.
    """
    limit = max(MOST_ROWS, n_rows // MOST_HUBS)
    hubs = written(table.where(F.col("n") > limit).drop("n"))
    if hubs.isEmpty():
        return rows.join(table.drop("n"), key)
    sent = F.broadcast(hubs)
    usual = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(table.where(F.col("n") <= limit).drop("n"), key)
    return usual.unionByName(rows.join(sent, key))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that the links ``edges`` (a, b) reach; a row for each node of a link but the roots.

    A large star moves each node's larger neighbours to the smallest one around it, a small star the smaller neighbours;
    in turn they make a star of each component in few rounds.  The smallest neighbour is aggregated where links lie before
    anything is shuffled, and reaches the links of a node with many of them without gathering these.
    """

    def least(e: DataFrame, n: int) -> DataFrame:
        return spread_join(e, e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "u", n)

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    stars = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = digest(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(least(both, 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        pairs = least(large, before[0])
        small = pairs.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        stars = written(small)
        after = digest(stars)
        if after == before:
            break
        before = after
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
