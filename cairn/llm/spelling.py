"""Spelling variants by anagram hashing.

A word's anagram key is the sum of the fifth powers of its letters' codes.  The keys of two words that differ by one letter differ
by that letter's value, if it is added or removed, or by the difference of two, if it is exchanged.  So each word yields its own
key and, for each place, its key less the letter there: an added or removed letter makes one word's key equal to another's
key less a letter, an exchanged one makes two keys less a letter equal.  Beside the key goes a value of the order of the letters that are
left, so that the many anagrams of a key don't meet.  What meets with the same key and order is told by words, and the letters'
order is compared in full.

Rows that meet are counted, and their most frequent words found, by windows over them; no pairs are made.  A key with one order
holds a word and what one letter makes of it, ``LETTERS`` words for each place at most.  A word's places carry no word, so
the rows of a very long one are no longer than others.

Forms lead to words at least ten times as frequent, so a chain of them has few steps; its end is found by doubling.

Null texts have no words, null ids hash as an empty id; repeated rows are counted as often as they occur; ties between near
words go to the smaller one in code-point order.  An empty table gives an empty one; other columns, whatever their names,
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.storage import written

#: Letters of a run once A-Z are small. A fixed value.
LETTERS = "a-zÀ-ÿ"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS, LEAST_N, DAMAGED, TIMES = 7, 2, 31, 10
POWER = 5
#: Bases and primes of the two polynomials in the order value.
_ORDER = ((911_382_323, 2_147_483_647), (972_663_749, 2_147_483_629))
#: Letters whose rows are made together, about.
TOGETHER = 1 << 19


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_n: int = LEAST_N, damaged: int = DAMAGED) -> DataFrame:
    """word and n of the runs of letters in ``docs`` (doc_id, text): those with ``least_letters`` and ``least_n`` or more.

    One run in ``damaged`` of a document, by its hash with the document's id, has lost a letter.
    """
    runs = F.regexp_extract_all(F.translate(F.col("text").cast("string"), CAPITALS, SMALL), F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    hashed = each.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % damaged == 0, without("run", place)).otherwise(F.col("run"))
    words = hashed.select(word.alias("word")).where(F.length("word") >= least_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def without(word, place):
    """``word`` without the letter at ``place``, counted from 0."""
    word = F.col(word)
    return F.concat(word.substr(F.lit(1), place), word.substr(place + 2, F.length(word)))


def powers_of(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * (int(out[-1]) * base % prime) % prime])
    return out[:n]


def places_of(codes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of words laid end to end: word, place (-1: the whole word), key, order, and whether the letter is the first of its like in a row."""
    starts = np.cumsum(length) - length
    word = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(codes)) - starts[word]
    value = codes**POWER
    own = np.add.reduceat(value, starts)
    whole, each = np.zeros(len(length), np.int64), np.zeros(len(codes), np.int64)
    for base, prime in _ORDER:
        base_powers = powers_of(base, prime, int(length.max()))
        sums = np.concatenate([[0], np.cumsum(codes * base_powers[place] % prime)])
        before, up_to, all_of = sums[:-1] - sums[starts][word], sums[1:] - sums[starts][word], sums[starts + length] - sums[starts]
        # the letters behind the one that is left out move one place to the front
        part = (before + (all_of[word] - up_to) % prime * pow(base, -1, prime)) % prime
        whole, each = whole << 31 | all_of % prime, each << 31 | part
    lead = np.concatenate([[True], codes[1:] != codes[:-1]]) | (place == 0)
    return (
        np.concatenate([np.arange(len(length)), word]), np.concatenate([np.full(len(length), -1), place]), np.concatenate([own, own[word] - value]),
        np.concatenate([whole, each]), np.concatenate([np.ones(len(length), bool), lead]),
    )


def places(words: DataFrame) -> DataFrame:
    """id, place, key, order and lead of ``words`` (id, word): a row a word, and one for each of its letters."""

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            ends = np.cumsum([len(t) for t in texts])
            at = 0
            while at < len(texts):
                done = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + TOGETHER, "right")))
                codes = np.frombuffer("".join(texts[at:to]).encode("utf-32-le"), "<u4").astype(np.int64)
                word, place, key, order, lead = places_of(codes, np.diff(ends[at:to], prepend=done))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(word + at)), pa.array(place, pa.int32()), pa.array(key), pa.array(order), pa.array(lead)], names=["id", "place", "key", "order", "lead"])
                at = to

    return words.select("id", "word").mapInArrow(run, "id long, place int, key long, order long, lead boolean")


def meeting(rows: DataFrame) -> DataFrame:
    """The rows of ``places`` that meet another word's: exchanged letters at the same place, or a word and one with a letter more."""
    is_word = F.col("place") < 0
    by_place, by_key = Window.partitionBy("key", "order", "place"), Window.partitionBy("key", "order")
    rows = rows.withColumn("same", F.count(F.lit(1)).over(by_place))
    rows = rows.withColumn("words", F.count_if(is_word).over(by_key)).withColumn("longer", F.count_if(~is_word & F.col("lead")).over(by_key))
    meets = F.when(is_word, F.col("longer") > 0).otherwise((F.col("same") > 1) | (F.col("lead") & (F.col("words") > 0)))
    return rows.where(meets).select("id", "place", "key", "lead")


def near(words: DataFrame) -> DataFrame:
    """word, n_near and best (its near word of largest n; less, word) of those of ``words`` (word, n) that have near words."""
    words = words.withColumn("id", F.xxhash64("word"))
    rows = meeting(places(words)).join(words, "id")
    is_word = F.col("place") < 0
    rest = F.when(is_word, F.col("word")).otherwise(without("word", F.col("place")))
    this = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))
    rows = rows.select("key", rest.alias("rest"), "place", "lead", "word", this.alias("this"))
    by_key = Window.partitionBy("key", "rest")
    by_place = Window.partitionBy("key", "rest", "place").orderBy("this")
    whole = by_place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    longer = ~is_word & F.col("lead")
    rows = rows.select("*", F.row_number().over(by_place).alias("rank"), F.lead("this").over(by_place).alias("second"), F.first("this").over(whole).alias("first"), F.count(F.lit(1)).over(whole).alias("same"))
    rows = rows.select("*", F.max(F.when(is_word, F.col("this"))).over(by_key).alias("shorter"), F.min(F.when(longer, F.col("this"))).over(by_key).alias("longest"), F.count_if(longer).over(by_key).alias("n_longer"))
    has_shorter = F.col("lead") & F.col("shorter").isNotNull()
    n_near = F.when(is_word, F.col("n_longer")).otherwise(F.col("same") - 1 + has_shorter.cast("long"))
    other = F.when(F.col("rank") == 1, F.col("second")).otherwise(F.col("first"))
    best = F.when(is_word, F.col("longest")).otherwise(F.least(other, F.when(has_shorter, F.col("shorter"))))
    return rows.select("word", n_near.alias("n_near"), best.alias("best")).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best")).where("n_near > 0")


def roots(links: DataFrame) -> DataFrame:
    """word and root of ``links`` (word, form), which make no circle: what its forms lead to."""
    ends = written(links.select("word", F.col("form").alias("root")))
    while True:
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(ends.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            return ends
        ends = moved.drop("moved")


def variants(docs: DataFrame, times: int = TIMES, **limits: int) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of ``docs`` (doc_id, text); ``limits`` as for ``vocabulary``."""
    words = written(vocabulary(docs, **limits))
    found = words.join(near(words), "word", "left")
    is_form = -F.col("best.less") >= times * F.col("n")
    form = lambda c: F.when(is_form, c)
    rows = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form(F.col("best.word")).alias("form"), form(-F.col("best.less")).alias("form_n")))
    ends = roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
