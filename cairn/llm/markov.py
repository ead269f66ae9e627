"""Character Markov models of two classes as DataFrames: counts, smoothing, log-likelihood ratios; no Python on executors.

A text is an array of character codes from 1 to A - 1; code 0 stands before its start.  A model is one array of
log-likelihood ratios, in whole millionths of a nat, at ``A * A * (code two before) + A * (code before) + code``.  Its
size is fixed by the alphabet, so it may go to every task as a value.  Whole numbers make sums exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.storage import written

UNIT = 1_000_000
#: A context is used if a class has seen it this often; else the next shorter one stands for it.
LEAST_SEEN = 8
#: Weight, in characters seen, of the next shorter context's probability.
PRIOR = 4.0


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: functions over arrays evaluate what they hold for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def codes(text: Column, alphabet: str) -> Column:
    """The place of each character in ``alphabet``, or one more than its length; an empty array for null and empty texts."""
    signs = F.lit(alphabet)
    each = F.transform(F.split(text, ""), lambda c: let(F.instr(signs, c), lambda at: F.when(at > 0, at).otherwise(F.lit(len(alphabet) + 1))))
    return F.when(F.length(text) > 0, each).otherwise(F.array().cast("array<int>"))


def size_of(alphabet: str) -> int:
    return len(alphabet) + 2


def grams(coded: Column, size: int) -> Column:
    """Places in the model, one for each character."""
    padded = F.concat(F.array(F.lit(0), F.lit(0)), coded)
    each = let(padded, lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 3), lambda i: (F.get(p, i) * size + F.get(p, i + 1)) * size + F.get(p, i + 2)))
    return F.when(F.size(coded) > 0, each).otherwise(F.array().cast("array<int>"))


def train(samples: DataFrame, size: int) -> DataFrame:
    """One row, ``model``, from ``samples``: grams array<int>, label boolean, and given boolean if it is there.

    With ``given``, the other samples of a class are scaled down to as many characters as its given ones have, if they have
    more: so verdicts do not move with the input's size.

    Counts are summed where the samples lie and then by place, so their number is bounded by the alphabet.  A model
    without samples of either class holds zeros or that class's uniform start.
    """
    spark = samples.sparkSession
    given = F.col("given") if "given" in samples.columns else F.lit(True)
    each = samples.select(F.explode("grams").alias("g"), F.col("label"), given.alias("given"))
    kinds = {f"{n}_{k}": (F.col("label") == y) & (F.col("given") == w) for y, n in ((True, "yes"), (False, "no")) for w, k in ((True, "given"), (False, "found"))}
    seen = written(each.groupBy("g").agg(*[F.count_if(c).alias(n) for n, c in kinds.items()]))
    if "given" in samples.columns:
        # whole numbers, so that sums stay exact; double times double would not
        full = {n: x or 0 for n, x in seen.agg(*[F.sum(n).alias(n) for n in kinds]).first().asDict().items()}
        part = lambda n: F.expr(f"CAST(floor(CAST({n}_found AS DECIMAL(19, 0)) * {min(full[f'{n}_given'], full[f'{n}_found'])} / {max(1, full[f'{n}_found'])}) AS BIGINT)")
    else:
        part = lambda n: F.col(f"{n}_found")
    seen = seen.select("g", (F.col("yes_given") + part("yes")).alias("yes"), (F.col("no_given") + part("no")).alias("no"))
    sums = lambda *by: seen.groupBy(*[e.alias(n) for n, e in by]).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    b, c = F.expr(f"CAST(g DIV {size} % {size} AS INT)"), F.expr(f"CAST(g % {size} AS INT)")

    def smoothed(rows: DataFrame, context: list[str], shorter: str | None, name: str) -> DataFrame:
        for k in ("yes", "no"):
            n, all_n = F.coalesce(F.col(k), F.lit(0)), F.coalesce(F.sum(k).over(Window.partitionBy(*context)), F.lit(0))
            if shorter is None:
                p = (n + 1) / (all_n + size)
            else:
                p = F.when(all_n >= LEAST_SEEN, (n + PRIOR * F.col(f"{shorter}_{k}")) / (all_n + PRIOR)).otherwise(F.col(f"{shorter}_{k}"))
            rows = rows.withColumn(f"{name}_{k}", p)
        return rows.drop("yes", "no")

    alone = smoothed(spark.range(size).select(F.col("id").cast("int").alias("c")).join(sums(("c", c)), "c", "left"), [], None, "p0")
    pairs = spark.range(size * size).selectExpr(f"CAST(id DIV {size} AS INT) AS b", f"CAST(id % {size} AS INT) AS c")
    pairs = smoothed(pairs.join(sums(("b", b), ("c", c)), ["b", "c"], "left").join(alone, "c"), ["b"], "p0", "p1").drop("p0_yes", "p0_no")
    triples = spark.range(size**3).selectExpr("CAST(id AS INT) AS g", f"CAST(id DIV {size} AS INT) AS ab", f"CAST(id DIV {size} % {size} AS INT) AS b", f"CAST(id % {size} AS INT) AS c")
    triples = smoothed(triples.join(seen, "g", "left").join(pairs, ["b", "c"]), ["ab"], "p1", "p2")
    weight = F.round((F.log("p2_yes") - F.log("p2_no")) * UNIT).cast("int")
    rows = triples.agg(F.array_sort(F.collect_list(F.struct("g", weight.alias("w")))).alias("rows"))
    return rows.select(F.transform("rows", lambda r: r["w"]).alias("model"))


def as_value(model: DataFrame) -> Column:
    """The one row of ``train`` as a constant: its size is that of the alphabet, whatever the size of the input."""
    return F.split(F.lit(",".join(map(str, model.first()["model"]))), ",").cast("array<int>")


def ratio(places: Column, model: Column) -> Column:
    """Log-likelihood ratio a character, in whole millionths of a nat; 0 for no characters."""
    total = lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda s, g: s + F.get(model, g))
    return F.when(F.size(places) > 0, let(places, lambda p: F.floor(total(p) / F.size(p)))).otherwise(F.lit(0)).cast("long")
