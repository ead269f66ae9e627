"""Approximate nearest neighbours by cross-polytope hashing, with exact reranking.

A table's hash takes pseudo-rotations of the unit vector (three rounds of random signs and a fast Hadamard transform), the
nearest signed axis of each, and the axes together are the bucket: the first rotation counts all axes, the others all or the
first few, which sets the number of buckets.  Every vector is in one bucket of each table.  A query looks into every bucket
whose axes' products with it add up to a limit.  Tables, axes and limit are planned for each vector length from what is
measured: ``SAMPLED`` queries are compared with every vector, and of all plans whose limit reaches ``FOUND`` of their true
neighbours the one with the fewest comparisons is taken; so larger tables cost more buckets, not neighbours.  Vectors are ranked by
inner product in the given values, in double precision, ties by smaller id; for the unit vectors that this is made for,
near by angle is near by product.

Rows are dealt by regions of buckets, a vector once a table; a query's vector goes once to each region that holds one of
its buckets and finds the buckets again there.  Regions hold about ``BLOCK_ROWS`` rows; larger ones (a bucket that is one)
are cut by id, and so are the queries of a region, each pair a group of its own: no group is larger than a bound.

Of equal vectors the k + 1 smallest ids take part, as no answer can hold more, so a vector that a third of the rows share
is compared a bounded number of times; equal queries are one query until the end.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, as query or candidate; vectors of
different lengths are never compared.  Null ids take no part.  Repeated rows are one; an id that comes with several
vectors stands for the least of them in array order.  An empty table gives an empty result; other columns, whatever their
names, are not read.  Very long vectors only cost their size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.storage import written

SEED = 11
#: Rows and queries of a group at most, about; numbers of a matrix of products.
BLOCK_ROWS, BLOCK_QUERIES, AT_ONCE = 16384, 16384, 1 << 21
#: Tables to choose from: the vectors are shuffled once for each. Axes of a last rotation, if not all.
TABLES, FEW_AXES = (1, 2, 3), 16
#: Queries and rows of each length that plans are measured on, and the share of the queries' neighbours that a plan must find.
SAMPLED, SAMPLED_ROWS, FOUND = 128, 1024, 0.94
#: Comparisons that a look into a bucket costs.
VISIT = 4.0


@dataclass(frozen=True)
class Plan:
    """How vectors of one length are hashed: axes of each rotation, tables, and the least sum of products of a bucket."""

    axes: tuple[int, ...]
    tables: int
    least: float

    @property
    def buckets(self) -> int:
        return int(np.prod([2 * a for a in self.axes], dtype=np.int64))


@lru_cache(maxsize=64)
def _signs(table: int, place: int, width: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, table, place, width]).choice([-1.0, 1.0], size=(3, width))


def width_of(dim: int) -> int:
    return 1 << max(1, (dim - 1).bit_length())


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def rotated(vectors: np.ndarray, table: int, place: int, seed: int = SEED) -> np.ndarray:
    """Pseudo-rotation of rows, padded to a power of two."""
    n, dim = vectors.shape
    width = width_of(dim)
    out, scale = np.empty((n, width)), width**-1.5
    for i in range(0, n, 256):  # a few rows at a time, turned, so that each step runs along them
        x = np.zeros((width, len(vectors[i : i + 256])))
        x[:dim] = vectors[i : i + 256].T
        for signs in _signs(table, place, width, seed):
            x *= signs[:, None]
            h = 1
            while h < width:
                pairs = x.reshape(width // (2 * h), 2, h, -1)
                x = np.stack([pairs[:, 0] + pairs[:, 1], pairs[:, 0] - pairs[:, 1]], axis=1).reshape(width, -1)
                h *= 2
        out[i : i + 256] = x.T * scale
    return out


def products(units: np.ndarray, table: int, axes: tuple[int, ...]) -> list[np.ndarray]:
    """Products of unit rows with the signed axes of each rotation."""
    out = []
    for place, n in enumerate(axes):
        x = rotated(units, table, place)[:, :n]
        out.append(np.concatenate([x, -x], axis=1))
    return out


def bucket_of(signed: list[np.ndarray]) -> np.ndarray:
    """The nearest signed axes, as one number; the first rotation's is the highest digit."""
    code = np.zeros(len(signed[0]), np.int64)
    for s in signed:
        code = code * s.shape[1] + np.argmax(s, axis=1)
    return code


def probed(signed: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all buckets whose products add up to ``least``, and of each row's own, nearest bucket."""
    rest = np.zeros(len(signed[0]))
    bound = [rest]
    for s in signed[:0:-1]:
        rest = rest + s.max(axis=1)
        bound.append(rest)
    row, code, total = np.arange(len(rest)), np.zeros(len(rest), np.int64), np.zeros(len(rest))
    for s, b in zip(signed, bound[::-1]):
        each = total[:, None] + s[row]
        at, axis = np.nonzero(each >= least - b[row][:, None])
        row, code, total = row[at], code[at] * s.shape[1] + axis, each[at, axis]
    own = bucket_of(signed)
    lost = np.setdiff1d(np.arange(len(own)), row)
    return np.concatenate([row, lost]), np.concatenate([code, own[lost]])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _by_length(column: pa.Array):
    """(length, places) of the arrays of ``column``."""
    sizes = np.diff(column.offsets.to_numpy())
    return [(int(d), np.flatnonzero(sizes == d)) for d in np.unique(sizes)]


def _valid(rows: DataFrame) -> DataFrame:
    """vec_id, embedding, and two hashes that stand for the vector."""
    v = F.col("embedding")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & whole & F.exists(v, lambda x: x != 0)
    return rows.select(F.col("vec_id").cast("long"), v).where(ok).select("vec_id", "embedding", F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(1), "embedding").alias("h2"))


def _one_each(rows: DataFrame) -> DataFrame:
    """``_valid`` rows with one vector for each id; only rows of ids that come again are shuffled."""
    again = written(rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"))
    if again.isEmpty():
        return rows
    least = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    least = least.select("vec_id", "embedding", F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    return rows.join(again, "vec_id", "left_anti").unionByName(least)


def candidates(vectors: DataFrame, k: int) -> DataFrame:
    """vec_id, embedding: one vector for each id, and of equal vectors those with the ``k`` + 1 smallest ids.

    What is shuffled are ids and hashes; vectors stay where they are, unless their id comes again.
    """
    rows = _one_each(_valid(vectors))
    order = Window.partitionBy("h", "h2").orderBy("vec_id")
    last = rows.select("vec_id", "h", "h2").withColumn("nth", F.row_number().over(order)).where(f"nth <= {k + 1}")
    many = written(last.where(f"nth = {k + 1}").select("h", "h2", F.col("vec_id").alias("last_id")))
    if not many.isEmpty():
        rows = rows.join(many, ["h", "h2"], "left").where("last_id IS NULL OR vec_id <= last_id")
    return rows.select("vec_id", "embedding")


def _merged(score: np.ndarray, owner: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each owner: by score, then smaller id."""
    order = np.lexsort((ids, -score, owner))
    own = owner[order]
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    nth = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
    return order[nth < k]


class _Best:
    """The ``k`` best rows so far of each query of a group; a row is dropped only if ``k`` others are before it."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.norms = np.linalg.norm(queries, axis=1)
        self.least = np.full(len(queries), -np.inf)
        self.held = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self.size = 0

    def add(self, at: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        """Compares the queries at ``at`` with ``rows``."""
        step = max(1, AT_ONCE // max(1, len(at)))
        for i in range(0, len(rows), step):
            some, some_ids = rows[i : i + step], ids[i : i + step]
            rough = self.queries[at] @ some.T
            # rounding depends on the shape of the product, so what is near the limit is let through
            slack = 1e-9 * self.norms[at] * np.linalg.norm(some, axis=1).max()
            least = self.least[at]
            if len(some) > self.k and np.isinf(least).any():
                least = np.maximum(least, np.partition(rough, len(some) - self.k, axis=1)[:, len(some) - self.k])
            q, r = np.nonzero(rough >= (least - slack)[:, None])
            for j in range(0, len(q), 1 << 16):
                x, y = at[q[j : j + (1 << 16)]], r[j : j + (1 << 16)]
                self.held.append((np.einsum("pd,pd->p", self.queries[x], some[y]), x, some_ids[y]))
                self.size += len(x)
            if self.size > 4 * self.k * len(self.queries) + (1 << 18):
                self.cut()

    def cut(self) -> None:
        score, owner, ids = (np.concatenate(c) for c in zip(*self.held))
        best = _merged(score, owner, ids, self.k)
        score, owner, ids = score[best], owner[best], ids[best]
        full = np.bincount(owner, minlength=len(self.queries)) >= self.k
        lows = np.full(len(self.queries), np.inf)
        np.minimum.at(lows, owner, score)
        self.least = np.where(full, lows, -np.inf)
        self.held, self.size = [(score, owner, ids)], len(score)

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.cut()
        return self.held[0]


def counts_of(rows: DataFrame) -> dict[int, int]:
    """Number of ``rows`` by length of their vectors."""
    return {r["dim"]: r["n"] for r in rows.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}


def below(rows: DataFrame, bounds: dict[int, int]) -> DataFrame:
    """dim, hash and embedding of the vectors of each length whose hash lies below a bound; of equal ones, one.

    Rows are dropped and equal ones made one where they lie, so only about as many as the bounds let through are shuffled.
    """
    size, own = F.size("embedding"), F.xxhash64("embedding")
    fits = F.lit(False)
    for dim, bound in bounds.items():
        fits = fits | ((size == dim) & (own <= bound))
    return rows.where(fits).groupBy(size.alias("dim"), own.alias("hash")).agg(F.first("embedding").alias("embedding"))


def _sampled(rows: DataFrame, n: int, counts: dict[int, int]) -> dict[int, np.ndarray]:
    """The ``n`` different vectors of each length that have the smallest hashes: a bounded sample; ``counts`` by length.

    The bound lets through four times as many rows as are wanted, and is raised where equal vectors leave too few.
    """
    share = {dim: min(1.0, 4 * n / max(1, m)) for dim, m in counts.items()}
    out: dict = {}
    while share:
        held: dict = {}
        for r in below(rows, {dim: int(-(1 << 63) + s * ((1 << 64) - 1)) if s < 1 else (1 << 63) - 1 for dim, s in share.items()}).collect():
            held.setdefault(r["dim"], []).append((r["hash"], r["embedding"]))
        out |= {dim: np.array([v for _, v in sorted(vs, key=lambda x: x[0])[:n]], dtype=np.float64) for dim, vs in held.items()}
        share = {dim: min(1.0, 16 * s) for dim, s in share.items() if s < 1 and len(held.get(dim, ())) < n}
    return out


def true_neighbours(rows: DataFrame, sample: dict[int, np.ndarray], k: int) -> dict[int, list[np.ndarray]]:
    """The ``k`` best of all ``rows`` for each vector of ``sample``, without its equals."""

    def run(batches):
        best: dict[int, _Best] = {}
        kept: dict[int, np.ndarray] = {}
        for b in batches:
            column = b.column(0)
            for dim, at in _by_length(column):
                if dim not in sample:
                    continue
                found = best.setdefault(dim, _Best(sample[dim], k + 1))
                held = kept.get(dim, np.zeros((0, dim)))
                matrix = np.concatenate([held, _matrix(column.take(pa.array(at)))])
                # the rows that are held come again as numbers of the new matrix
                found.held, found.size, found.least = [found.held[0]], 0, found.least
                found.add(np.arange(len(sample[dim])), matrix[len(held) :], np.arange(len(held), len(matrix)))
                score, owner, ids = found.result()
                used, again = np.unique(ids, return_inverse=True)
                found.held, kept[dim] = [(score, owner, again)], matrix[used]
        for dim, found in best.items():
            score, owner, ids = found.result()
            vectors = pa.array(list(kept[dim][ids]), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), dim, np.int32)), pa.array(owner.astype(np.int32)), pa.array(score), vectors], names=["dim", "at", "score", "embedding"])

    found = rows.select("embedding").mapInArrow(run, "dim int, at int, score double, embedding array<double>")
    nth = F.row_number().over(Window.partitionBy("dim", "at").orderBy(F.desc("score"), "embedding"))
    out: dict = {dim: [[] for _ in q] for dim, q in sample.items()}
    for r in found.withColumn("nth", nth).where(f"nth <= {k + 1}").orderBy("dim", "at", "nth").select("dim", "at", "embedding").collect():
        out[r["dim"]][r["at"]].append(r["embedding"])
    own = lambda q, near: np.array([x for x in near if not np.array_equal(x, q)][:k]).reshape(-1, len(q))
    return {dim: [own(q, near) for q, near in zip(sample[dim], each)] for dim, each in out.items()}


def shapes(n: int, dim: int) -> list[tuple[int, ...]]:
    """Axes to choose from: buckets of four vectors or more on average."""
    width, out, axes = width_of(dim), [], ()
    while True:
        for last in sorted({min(FEW_AXES, width), width} if axes else {width}):
            out.append((*axes, last))
        axes = (*axes, width)
        if len(axes) > 1 and n < 4 * (2 * width) ** (len(axes) - 1) * 2 * min(FEW_AXES, width):
            return [s for s in out if len(s) == 1 or n >= Plan(s, 1, 0.0).buckets]
        if len(axes) == 4:
            return out


def planned(rows: DataFrame, kinds: DataFrame, k: int) -> dict[int, Plan]:
    """The plan for each length of the queries; the driver holds samples and their neighbours, which are bounded."""
    asked = _sampled(kinds, SAMPLED, counts_of(kinds))
    if not asked:
        return {}
    counts = counts_of(rows)
    some = _sampled(rows, SAMPLED_ROWS, {dim: counts.get(dim, 0) for dim in asked})
    near = true_neighbours(rows, asked, k)
    plans = {}
    for dim, q in asked.items():
        owner = np.repeat(np.arange(len(q)), [len(x) for x in near[dim]])
        nearest_rows = np.concatenate(near[dim]) if near[dim] else np.zeros((0, dim))
        best = None
        for axes in shapes(counts.get(dim, 0), dim):
            own, other = np.full(len(owner), -np.inf), []
            for table in range(max(TABLES)):
                signed, sums = products(unit(q), table, axes), np.zeros(len(owner))
                sums_of = np.zeros((len(q), len(some.get(dim, ()))))
                theirs = products(unit(nearest_rows), table, axes) if len(owner) else None
                others = products(unit(some[dim]), table, axes) if dim in some else None
                for p, s in enumerate(signed):
                    sums += s[owner, np.argmax(theirs[p], axis=1)] if len(owner) else 0
                    sums_of += s[:, np.argmax(others[p], axis=1)] if others else 0
                own, other = np.maximum(own, sums), [*other, sums_of]
                if table + 1 in TABLES:
                    least = float(np.quantile(own, 1 - FOUND, method="lower")) - 1e-9 if len(own) else 0.0
                    share = sum(float((o >= least).mean()) for o in other) if other[0].size else 1.0
                    plan = Plan(axes, table + 1, least)
                    cost = share * counts.get(dim, 0) + VISIT * share * plan.buckets
                    if best is None or cost < best[0]:
                        best = cost, plan
        plans[dim] = best[1]
    return plans


def region_size(n: int, plan: Plan) -> int:
    """Buckets of a region: neighbours by number, which share their first axes."""
    return max(1, min(plan.buckets, plan.buckets * BLOCK_ROWS // max(1, n)))


def best_pairs(groups: DataFrame, plans: dict[int, Plan], k: int) -> DataFrame:
    """query, id, score: the ``k`` best of the rows that each query of a group looks at.

    ``groups``: dim, tab, region, part, q_part, is_row, bucket, id, embedding, sorted by these; queries come first.
    """

    def run(batches):
        now = best = ids = signed = axes = None
        queries: list = []

        def flush():
            score, owner, found = best.result()
            return pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(found), pa.array(score)], names=["query", "id", "score"])

        for b in batches:
            keys = [b.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
            change = np.zeros(len(b), bool)
            for c in keys:
                change[1:] |= c[1:] != c[:-1]
            edges = [0, *np.flatnonzero(change).tolist(), len(b)]
            for s, e in zip(edges[:-1], edges[1:]):
                if s == e:
                    continue
                group = tuple(int(c[s]) for c in keys[:5])
                if group != now:
                    if best is not None:
                        yield flush()
                    now, best, queries = group, None, []
                some, matrix = b.column(7).slice(s, e - s).to_numpy(), _matrix(b.column(8).slice(s, e - s))
                if not keys[5][s]:
                    queries.append((some, matrix))
                    continue
                if not queries:
                    continue
                plan = plans[group[0]]
                if best is None:
                    ids, all_q = np.concatenate([q[0] for q in queries]), np.concatenate([q[1] for q in queries])
                    best = _Best(all_q, k)
                    signed = [np.ascontiguousarray(x.T) for x in products(unit(all_q), group[1], plan.axes)]
                    axes = [2 * a for a in plan.axes]
                digits, code = [], int(keys[6][s])
                for a in axes[::-1]:
                    digits.append(code % a)
                    code //= a
                total = sum(x[d] for x, d in zip(signed, digits[::-1]))
                at = np.flatnonzero(total >= plan.least)
                if len(at):
                    best.add(at, matrix, some)
        if best is not None:
            yield flush()

    return groups.mapInArrow(run, "query long, id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, plans: dict[int, Plan] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each of ``queries`` the ``k`` nearest found of all other ``vectors`` (vec_id, embedding).

    Every vector is in the index.  ``queries`` is a set that is stated, and much smaller than ``vectors``.  ``plans`` may
    give the hashing of each vector length; by default it is ``planned``.
    """
    rows = candidates(vectors, k)
    asked = written(_one_each(_valid(queries)))
    kinds = written(asked.groupBy("h", "h2").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("vec_id")))
    plans = planned(rows, kinds, k) if plans is None else plans
    kind = rows.schema["embedding"].dataType.simpleString()
    counts = {r["dim"]: r["n"] for r in rows.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()} if plans else {}
    wide = {dim: region_size(counts.get(dim, 0), p) for dim, p in plans.items()}

    def deal(batches, probing: bool):
        """A row for each table, or for each region that a query looks into."""
        for b in batches:
            for dim, every in _by_length(b.column(1)):
                if dim not in plans:
                    continue
                plan, size = plans[dim], wide[dim]
                step = 128 if probing else 4096
                for i in range(0, len(every), step):
                    at = every[i : i + step]
                    units = unit(_matrix(b.column(1).take(pa.array(at))))
                    for t in range(plan.tables):
                        signed = products(units, t, plan.axes)
                        if probing:
                            row, code = probed(signed, plan.least)
                            region = code // size  # ascending for each row
                            new = np.concatenate([[True], (row[1:] != row[:-1]) | (region[1:] != region[:-1])])
                            row, region = row[new], region[new]
                            bucket = np.full(len(row), -1)
                        else:
                            row, bucket = np.arange(len(at)), bucket_of(signed)
                            region = bucket // size
                        few = pa.array(at[row])
                        keys = [pa.array(np.full(len(row), x, np.int32)) for x in (dim, t)]
                        yield pa.RecordBatch.from_arrays([*keys, pa.array(region), pa.array(bucket), b.column(0).take(few), b.column(1).take(few)], names=["dim", "tab", "region", "bucket", "id", "embedding"])

    schema = f"dim int, tab int, region long, bucket long, id long, embedding {kind}"
    index = rows.select("vec_id", "embedding").mapInArrow(lambda x: deal(x, False), schema)
    asks = kinds.select("vec_id", F.col("embedding").cast(kind)).mapInArrow(lambda x: deal(x, True), schema)
    key = ["dim", "tab", "region"]
    cut = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    n_rows = index.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    n_asks = asks.groupBy(*key).agg(F.count(F.lit(1)).alias("n_q"))
    grid = written(n_rows.join(n_asks, key).select(*key, cut("n", BLOCK_ROWS * 2).alias("parts"), cut("n_q", BLOCK_QUERIES).alias("q_parts")))
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    kept = ["bucket", "id", "embedding"]
    dealt = index.join(grid, key).select(*key, own("parts").alias("part"), every("q_parts").alias("q_part"), F.lit(1).alias("is_row"), *kept)
    asking = asks.join(grid, key).select(*key, every("parts").alias("part"), own("q_parts").alias("q_part"), F.lit(0).alias("is_row"), *kept)
    group = [*key, "part", "q_part"]
    groups = dealt.unionByName(asking).repartition(*group).sortWithinPartitions(*group, "is_row", "bucket")
    pairs = best_pairs(groups, plans, k + 1).groupBy("query", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    top = pairs.withColumn("nth", F.row_number().over(order)).where(f"nth <= {k + 1}")
    answers = top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id").alias("vec_id")))).alias("found"))
    members = asked.select(F.col("vec_id").alias("query_id"), "h", "h2").join(kinds.select("h", "h2", F.col("vec_id").alias("query")), ["h", "h2"])
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), F.lit(1), F.lit(k))
    listed = members.join(answers, "query").select("query_id", F.posexplode(others).alias("at", "f"))
    return listed.select("query_id", (F.col("at") + 1).alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.s")).alias("score"))
