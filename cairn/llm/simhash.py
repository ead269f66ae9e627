"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Fingerprints within ``RADIUS`` differing bits are linked, and a component is what links reach.  The 64 bits are cut into
m blocks; two linked fingerprints agree on m - RADIUS blocks at least, so each choice of that many blocks deals them into
buckets of equal bits, and linked ones meet in a bucket of some choice: nothing is lost.  m grows with the number of
fingerprints, so that buckets stay small.  A bucket is compared in tiles of fingerprints sorted by population count, with
numpy's exclusive-or and bit counts; tile pairs whose population counts differ beyond the radius are skipped, and so are
pairs that one component already holds.  A bucket beyond ``MOST`` fingerprints is dealt into tiles by population count and
hash, and its tile pairs go to tasks of their own.

Exact copies are one fingerprint, grouped before anything else.  Only links of a spanning forest leave a task.

Null and empty texts have fingerprint zero, linked like any other; very long ones are hashed a part at a time.  Null ids
belong to a component but never name it (unless it has no other).  Repeated rows stay rows; an empty table gives an empty
one; other columns, whatever their names, are not read, and ``first_of_each`` returns them as they are.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.components import components, spread_join
from cairn.llm.storage import column, written

RADIUS = 4
SHINGLE, SEED = 4, 42
#: Fingerprints of a bucket, on average, above which m grows; of a bucket that one task compares; of a tile.
USUAL, MOST, TILE = 2048, 65536, 512
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - shingle + 1)
    digest, votes = xxhash.xxh64_digest, np.zeros(64, np.int64)
    last = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]) - 1
    for i in range(0, n, 1 << 16):
        some = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[i : min(n, i + (1 << 16))].tolist(), last[i : i + (1 << 16)].tolist())])
        votes += np.unpackbits(np.frombuffer(some, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash and fingerprint (signed long) of ``docs`` (doc_id, text)."""

    def run(batches):
        for b in batches:
            prints = pa.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), prints], names=["doc_id", "text_hash", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fingerprint long")


def masks(n: int, radius: int = RADIUS) -> list[int]:
    """Bit masks (signed) of all choices of blocks, for ``n`` fingerprints."""
    m = radius + 1
    while m < 2 * radius + 2 and n >> (64 * (m - radius) // m) > USUAL:
        m += 1
    edges = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(m)]
    chosen = [sum(c) for c in combinations(blocks, m - radius)]
    return [c - (1 << 64) if c >= 1 << 63 else c for c in chosen]


def forest(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links between distinct ``prints`` (uint64) that connect what pairs within ``radius`` connect."""
    pops = np.bitwise_count(prints).astype(np.int64)
    order = np.argsort(pops, kind="stable")
    prints, pops = prints[order], pops[order]
    n = len(prints)
    label = np.arange(n)
    for i in range(0, n, TILE):
        a = slice(i, min(n, i + TILE))
        for j in range(i, n, TILE):
            b = slice(j, min(n, j + TILE))
            if pops[b.start] - pops[a.stop - 1] > radius:
                break
            if (label[a] == label[a.start]).all() and (label[b] == label[a.start]).all():
                continue
            x, y = np.nonzero(np.bitwise_count(prints[a, None] ^ prints[None, b]) <= radius)
            x, y = label[x + a.start], label[y + b.start]
            while (apart := x != y).any():
                x, y = x[apart], y[apart]
                to = np.arange(n)
                np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
                while (to != to[to]).any():
                    to = to[to]
                label, x, y = to[label], to[x], to[y]
    linked = np.flatnonzero(label != np.arange(n))
    return prints[linked], prints[label[linked]]


def links(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """a, b: links that connect all of ``distinct`` (fingerprint, n rows without repeats) that are within ``radius``."""
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(n, radius))])
    dealt = distinct.select("fingerprint", F.explode(keys).alias("k")).select("k.choice", "k.key", "fingerprint")
    pop = F.bit_count("fingerprint")
    by_pop = dealt.groupBy("choice", "key", pop.alias("pop")).agg(F.count(F.lit(1)).alias("n"))
    large = by_pop.groupBy("choice", "key").agg(F.sum("n").alias("all"), F.collect_list(F.struct("pop", "n")).alias("pops")).where(f"all > {MOST}")
    tiles = large.select("choice", "key", F.explode("pops").alias("p")).select("choice", "key", "p.pop", F.ceil(F.col("p.n") / MOST).cast("int").alias("parts"))
    one = tiles.select("choice", "key", F.col("pop").alias("p1"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("s1"), F.col("parts").alias("n1"))
    two = one.select("choice", "key", F.col("p1").alias("p2"), F.col("s1").alias("s2"), F.col("n1").alias("n2"))
    near = (F.col("p2") - F.col("p1")).between(0, radius) & ((F.col("p2") > F.col("p1")) | (F.col("s2") >= F.col("s1")))
    pairs = one.join(two, ["choice", "key"]).where(near).withColumn("pair", F.xxhash64("p1", "s1", "p2", "s2"))
    sides = F.array(F.struct(F.col("p1").alias("pop"), F.col("s1").alias("part"), F.col("n1").alias("parts")), F.struct(F.col("p2").alias("pop"), F.col("s2").alias("part"), F.col("n2").alias("parts")))
    sent = written(pairs.select("choice", "key", "pair", F.explode(F.array_distinct(sides)).alias("s")).select("choice", "key", "pair", "s.*"))
    usual, split = dealt, None
    if not sent.isEmpty():
        hot = sent.select("choice", "key").distinct()
        usual = dealt.join(hot, ["choice", "key"], "left_anti")
        of = F.pmod(F.xxhash64("fingerprint"), F.col("parts")) == F.col("part")
        split = dealt.withColumn("pop", pop).join(sent, ["choice", "key", "pop"]).where(of).select("choice", "key", "pair", "fingerprint")
    rows = usual.select("choice", "key", F.lit(0).cast("long").alias("pair"), "fingerprint")
    rows = rows if split is None else rows.unionByName(split)

    def run(batches):
        held: list[np.ndarray] = []
        now = None

        def batch():
            a, b = forest(np.concatenate(held).view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for b in batches:
            columns = [b.column(i).to_numpy() for i in range(4)]
            change = np.zeros(len(b), bool)
            for c in columns[:3]:
                change[1:] |= c[1:] != c[:-1]
            edges = [0, *np.flatnonzero(change).tolist(), len(b)]
            for s, e in zip(edges[:-1], edges[1:]):
                if s == e:
                    continue
                group = tuple(int(c[s]) for c in columns[:3])
                if group != now:
                    if held and sum(map(len, held)) > 1:
                        yield batch()
                    now, held = group, []
                held.append(columns[3][s:e])
        if held and sum(map(len, held)) > 1:
            yield batch()

    return rows.repartition("choice", "key", "pair").sortWithinPartitions("choice", "key", "pair").mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """The rows' fingerprints, and fingerprint, n, root and best (its first row: smallest doc_id, then text_hash)."""
    prints = written(fingerprints(docs, shingle))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    distinct = written(prints.groupBy("fingerprint").agg(F.min(row).alias("best"), F.count(F.lit(1)).alias("n")))
    joined = components(written(links(distinct.select("fingerprint"), distinct.count(), radius)))
    rooted = distinct.join(joined, distinct["fingerprint"] == joined["node"], "left").select("fingerprint", "n", F.coalesce("root", "fingerprint").alias("root"), "best")
    return prints, rooted


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (signed long) and component_id of every row of ``docs`` (doc_id, text)."""
    prints, rooted = grouped(docs, shingle, radius)
    sizes = rooted.groupBy("root").agg(F.min("best")["doc_id"].alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = spread_join(rooted.withColumnRenamed("n", "n_rows"), sizes, "root", prints.count())
    named = written(named.select("fingerprint", F.col("n_rows").alias("n"), "component_id"))
    return spread_join(prints, named, "fingerprint", prints.count()).select("doc_id", "fingerprint", "component_id")


def first_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (then hash of the text); of whole repeats, one.

    Rows are told by id and hash of the text.  Those that go are dropped where they lie while their table is small enough to
    be sent to every task, so texts are shuffled only beyond that, and once.
    """
    prints, rooted = grouped(docs, shingle, radius)
    no_id, own_id = F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("own_id")
    row = ["no_id", "own_id", "own_hash"]
    stay = rooted.groupBy("root").agg(F.min("best").alias("best")).select("best.no_id", F.coalesce("best.doc_id", F.lit(0)).alias("own_id"), F.col("best.text_hash").alias("own_hash"))
    every = prints.select(no_id, own_id, F.col("text_hash").alias("own_hash")).groupBy(*row).agg(F.count(F.lit(1)).alias("n"))
    told = written(every.join(stay.withColumn("stays", F.lit(True)), row, "left").where("stays IS NULL OR n > 1"))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(no_id, own_id, F.xxhash64(F.col("text").cast("string")).alias("own_hash"), *[column(c).alias(n) for c, n in names.items()])
    left = own.join(told.select(*row), row, "left_anti")
    again = told.where("stays").select(*row)
    if not again.isEmpty():  # repeats of a row that stays: one of each, reduced before they are shuffled
        whole = F.struct(*names.values())
        left = left.unionByName(own.join(again, row, "left_semi").groupBy(*row).agg(F.first(whole).alias("whole")).select(*row, "whole.*"))
    return left.select(*[F.col(n).alias(c) for c, n in names.items()])
