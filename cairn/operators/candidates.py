"""Symbol candidates: identifiers with what stands around them."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from cairn.sources.scratch import written

#: Identifiers with dashes inside, joined by dots, double colons or arrows. A fixed value.
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*+(?:-[A-Za-z][A-Za-z0-9_]*+)*+(?:(?:\.|::|->)[A-Za-z_][A-Za-z0-9_]*+)*+"
#: Words before a declared name. Fixed values.
KEYWORDS = ["class", "interface", "struct", "enum", "record", "type", "def", "function"]
#: Between a container and a leaf: the first of these that a name holds. Fixed values.
JOINS = ["::", "->", "."]


def packed_place(number: Column, values: list[str]) -> Column:
    """The place in a number for a place and one of ``values`` (or null), in the order of places."""
    return F.floor(number / (len(values) + 1)).cast("int")


def packed_value(number: Column, values: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, values)), (number % (len(values) + 1)).cast("int"))


#: Ways of use as bits: before a bracket, before an angle bracket, behind a keyword; combinations of them.
CALLED, GENERIC, DECLARED, WAYS = 1, 2, 4, 8
_AFTER = {"(": CALLED, "<": GENERIC}
#: Chunks, and characters of texts, that are worked on together, about.
PIECE, PIECE_CHARS = 256, 2_000_000
_NONE, _KEYWORDS = len(KEYWORDS), tuple(KEYWORDS)
_TOKEN = re.compile(f"({TOKEN})")
#: A keyword at the end of an identifier, behind no other letter of it.
_ENDING = re.compile(f"(?:^|[^A-Za-z_])({'|'.join(KEYWORDS)})$", re.IGNORECASE | re.ASCII)
#: Unicode's white space.
_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _declaring(gaps: list[str], inner: np.ndarray, codes: np.ndarray, words: list[str]) -> dict[int, int]:
    """The keyword of each identifier that stands behind one: ``gaps`` are before identifiers, ``inner`` is false at a text's first."""
    endings = {}
    for code, word in enumerate(words):
        m = _ENDING.search(word) if word.lower().endswith(_KEYWORDS) else None
        if m:
            endings[code] = KEYWORDS.index(m[1].lower()), m[1] == word
    behind = np.flatnonzero(np.isin(codes[:-1], list(endings)) & inner[1:]) + 1 if endings else []
    found = {}
    for nth in map(int, behind):
        keyword, whole = endings[codes[nth - 1]]
        of_longer_word = whole and gaps[nth - 1][-1:].isalpha()  # a letter of another script
        if not of_longer_word and not gaps[nth].strip(_SPACE):
            found[nth] = keyword
    return found


def _firsts(keys: np.ndarray, *numbers: tuple[np.ufunc, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct ``keys`` in order, and each array of numbers brought together over equal keys."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[starts], *[f.reduceat(n[order], starts) for f, n in numbers]


def _uses(piece: list[list[str | None]], by_name: bool) -> tuple[np.ndarray, list[pa.Array]]:
    """How many rows each chunk of ``piece`` (lists of texts) has, and the columns of the rows.

    Identifiers and the gaps between them alternate, so what follows an identifier is the start of the next gap, and the
    word before it is the end of the identifier before, if white space alone lies between.  A row stands for a name and
    way of use in a chunk, or ``by_name`` for a name; its place and keyword are one number, the least is the first.
    """
    names, gaps, hows, lengths, owner = [], [], [], [], []
    for k, texts in enumerate(piece):
        for text in texts:
            parts = _TOKEN.split(text or "")
            names += parts[1::2]
            gaps += parts[:-1:2]
            hows += [_AFTER.get(g[:1], 0) for g in parts[2::2]]
            lengths.append(len(parts) // 2)
            owner.append(k)
    if not names:
        return np.zeros(len(piece), np.int64), []
    coded = pa.array(names, pa.string()).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    nth = np.arange(len(names)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    how, keyword = np.array(hows, np.int64), np.full(len(names), _NONE, np.int64)
    declared = _declaring(gaps, nth > 0, codes, coded.dictionary.to_pylist())
    at = np.fromiter(declared, np.int64, len(declared))
    how[at] |= DECLARED
    keyword[at] = np.fromiter(declared.values(), np.int64, len(declared))
    first, name = nth * (_NONE + 1) + keyword, np.repeat(np.array(owner, np.int64), lengths) * len(coded.dictionary) + codes
    if by_name:
        name, ways, least = _firsts(name, (np.bitwise_or, how), (np.minimum, first * WAYS + how))
        numbers = [(ways, pa.int32()), (least // WAYS, pa.int64()), (least % WAYS, pa.int32())]
    else:
        use, least = _firsts(name * WAYS + how, (np.minimum, first))
        name, numbers = use // WAYS, [(use % WAYS, pa.int32()), (least, pa.int64())]
    columns = [coded.dictionary.take(pa.array(name % len(coded.dictionary))), *[pa.array(n).cast(kind) for n, kind in numbers]]
    return np.bincount(name // len(coded.dictionary), minlength=len(piece)), columns


def _rows(chunks: pa.Array, by_name: bool, fields: list[pa.Field]) -> pa.Array:
    """The uses in each chunk (a list of texts), as lists of structs."""
    pieces: list[pa.Array] = []
    held: list[list[str | None]] = []
    chars = 0

    def together() -> None:
        sizes, columns = _uses(held, by_name)
        values = pa.StructArray.from_arrays(columns or [pa.array([], f.type) for f in fields], fields=fields)
        pieces.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values))

    for texts in chunks:
        held.append(texts.as_py() or [])
        chars += sum(len(t or "") for t in held[-1])
        if len(held) >= PIECE or chars >= PIECE_CHARS:
            together()
            held, chars = [], 0
    if held:
        together()
    return pa.concat_arrays(pieces) if pieces else pa.array([], pa.list_(pa.struct(fields)))


_USE = [pa.field("name", pa.string()), pa.field("how", pa.int32()), pa.field("first", pa.int64())]
_USED = [StructField("name", StringType()), StructField("how", IntegerType()), StructField("first", LongType())]


@F.arrow_udf(ArrayType(StructType(_USED)))
def _used(chunks: pa.Array) -> pa.Array:
    return _rows(chunks, False, _USE)


@F.arrow_udf(ArrayType(StructType([*_USED, StructField("of_first", IntegerType())])))
def _named(chunks: pa.Array) -> pa.Array:
    """Each name once: all its ways of use, its first place, the way of that."""
    return _rows(chunks, True, [*_USE, pa.field("of_first", pa.int32())])


def texts_of(chunks: DataFrame) -> DataFrame:
    """chunk_id, texts: one row a chunk.  Texts of chunks that have several rows are shuffled, so that they meet; others stay where they are."""
    repeated = written(chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("chunk_id").alias("again")))
    alone = chunks.select("chunk_id", F.array("content").alias("texts"))
    if not repeated.take(1):
        return alone
    same = F.col("chunk_id").eqNullSafe(F.col("again"))
    met = chunks.join(repeated, same, "left_semi").groupBy("chunk_id").agg(F.collect_list("content").alias("texts"))
    return alone.join(repeated, same, "left_anti").unionByName(met)


def _exploded(chunks: DataFrame, found: Callable[[str], Column]) -> DataFrame:
    """A row for each of what is ``found`` in a chunk. Uses stay where the texts are."""
    rows = texts_of(chunks).select("chunk_id", F.explode(found("texts")).alias("o")).select("chunk_id", "o.*")
    leaf = F.col("name")
    for join in reversed(JOINS):
        leaf = F.when(F.col("name").contains(join), F.substring_index("name", join, -1)).otherwise(leaf)
    used = F.lit(0)
    for join in reversed(JOINS):
        used = F.when(F.col("name").contains(join), F.lit(len(join))).otherwise(used)
    rows = rows.withColumn("leaf", leaf).withColumn("used", used)
    container = F.when(F.col("used") > 0, F.expr("substring(name, 1, length(name) - length(leaf) - used)"))
    return rows.withColumns({"container": container, "keyword": packed_value(F.col("first"), KEYWORDS), "nth": packed_place(F.col("first"), KEYWORDS)})


def _is(bits: str, way: int) -> Column:
    return F.col(bits).bitwiseAND(way) != 0


def candidates(chunks: DataFrame) -> DataFrame:
    """chunk_id, name, container, leaf, callable, generic, declared, keyword, nth of ``chunks`` (chunk_id, content).

    A row for each name and way of use in a chunk; ``nth`` and ``keyword`` are those of the first. Null texts have none.
    """
    ways = [_is("how", w).alias(c) for c, w in (("callable", CALLED), ("generic", GENERIC), ("declared", DECLARED))]
    return _exploded(chunks, _used).select("chunk_id", "name", "container", "leaf", *ways, "keyword", "nth")


def names_used(chunks: DataFrame) -> DataFrame:
    """chunk_id, name, container, leaf, callable, generic, declared, keyword, nth, first_callable, first_generic: each name once a chunk.

    It is callable, generic or declared if one of its uses is; the others are those of the first use.
    """
    ways = [_is("how", w).alias(c) for c, w in (("callable", CALLED), ("generic", GENERIC), ("declared", DECLARED))]
    first = [_is("of_first", w).alias(c) for c, w in (("first_callable", CALLED), ("first_generic", GENERIC))]
    return _exploded(chunks, _named).select("chunk_id", "name", "container", "leaf", *ways, "keyword", "nth", *first)
