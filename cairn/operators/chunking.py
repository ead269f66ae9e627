"""Chunks of page texts: by headings, by version headings, ids, estimates, and breaks between neighbours."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.text import let
from cairn.sources.scratch import written

#: Characters of a chunk at most, and of a packed sample.
MOST_CHARS, SAMPLE_CHARS = 2400, 3200
HEADING = r"(?md)(?=^#{1,3}\s+.+$)"
VERSION = r"(?md)(?=^#{1,3}\s+[vV](?:ersion)?\s*\d)"


def by_headings(pages: DataFrame) -> DataFrame:
    """page_id, part, heading, path, content of ``pages`` (page_id, title, text); blank parts go, text before a heading stays."""
    parts = pages.select("page_id", "title", F.posexplode(F.split("text", HEADING)).alias("part", "content"))
    heading = F.trim(F.regexp_extract("content", r"(?d)^#{1,3}\s+(.+)", 1))
    kept = parts.where(F.trim("content") != "")
    return kept.select("page_id", "part", heading.alias("heading"), F.when(heading == "", F.col("title")).otherwise(F.concat("title", F.lit(" > "), heading)).alias("path"), F.trim("content").alias("content"))


def by_versions(pages: DataFrame) -> DataFrame:
    """As ``by_headings``, at version headings; text before the first goes, and pages without one are cut by headings."""
    has = F.col("text").rlike(r"(?md)^#{1,3}\s+[vV](?:ersion)?\s*\d")
    parts = pages.where(has).select("page_id", "title", F.posexplode(F.split("text", VERSION)).alias("part", "content"))
    heading = F.trim(F.regexp_extract("content", r"(?d)^#{1,3}\s+(.+)", 1))
    cut = parts.where(F.col("content").rlike(r"^#{1,3}\s+[vV](?:ersion)?\s*\d")).select("page_id", "part", heading.alias("heading"), F.concat("title", F.lit(" > "), heading).alias("path"), F.trim("content").alias("content"))
    return cut.unionByName(by_headings(pages.where(~has)))


def break_at(text: str, limit: int) -> int:
    """Where to cut: behind the last sentence end in the second half of the first ``limit`` characters, else at ``limit``."""
    for i in range(limit - 1, limit // 2, -1):
        if text[i] in "\n!?" or (text[i] == "." and i + 1 < len(text) and text[i + 1].isspace()):
            return i + 1
    return limit


def pieces(text: str, limit: int = MOST_CHARS) -> list[str]:
    """``text`` cut to at most ``limit`` characters each, trimmed; blank pieces keep their place."""
    out, done = [], 0
    while len(text) - done > limit:
        at = done + break_at(text[done : done + limit + 1], limit)
        out.append(text[done:at].strip())
        done = at
    return [*out, text[done:].strip()] if done < len(text) else out


def capped(chunks: DataFrame, limit: int = MOST_CHARS) -> DataFrame:
    """``chunks`` (chunk_id, content, ...) with long ones cut; a cut chunk's pieces have its id and their number."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pieces(t or "", limit))

    short = chunks.where(F.length("content") <= limit)
    long = chunks.where(F.length("content") > limit).select("*", F.posexplode(cut("content")).alias("nth", "piece"))
    long = long.withColumn("chunk_id", F.concat(F.col("chunk_id").cast("string"), F.lit("-"), F.col("nth").cast("string"))).withColumn("content", F.col("piece"))
    return short.withColumn("chunk_id", F.col("chunk_id").cast("string")).unionByName(long.select(*chunks.columns))


def by_category(pages: DataFrame) -> DataFrame:
    """page_id, category, part, heading, path, content of ``pages`` (page_id, title, category, text): samples and code are
    packed by paragraphs, change logs cut at versions, all others at headings."""
    kind = F.coalesce(F.col("category"), F.lit(""))
    own = pages.select(F.struct("page_id", "category", "title").alias("page_id"), "title", "text", kind.alias("kind"))
    packed = packed_paragraphs(own.where(F.col("kind").isin("Sample", "Code"))).select("page_id", "part", F.lit("").alias("heading"), F.col("page_id.title").alias("path"), "content")
    cut = packed.unionByName(by_versions(own.where("kind = 'ChangeLog'"))).unionByName(by_headings(own.where(~F.col("kind").isin("Sample", "Code", "ChangeLog"))))
    return cut.select("page_id.page_id", "page_id.category", "part", "heading", "path", "content")


def packed_paragraphs(pages: DataFrame, limit: int = SAMPLE_CHARS) -> DataFrame:
    """page_id, part, content: paragraphs packed in order while they fit."""
    step = lambda done, p: F.when(
        (F.size(done) > 0) & (F.length(F.element_at(done, -1)) + F.length(p) + 2 <= limit), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.lit("\n\n"), p)))
    ).otherwise(F.array_append(done, p))
    paragraphs = F.filter(F.split("text", r"\n\s*\n"), lambda p: F.trim(p) != "")
    packs = F.aggregate(paragraphs, F.array().cast("array<string>"), step)
    return pages.select("page_id", F.posexplode(packs).alias("part", "content"))


def chunk_id(library: Column, version: Column, url: Column, ordinal: Column) -> Column:
    return F.concat_ws("/", library, version, F.substring(F.sha2(url, 256), 1, 12), ordinal.cast("string"))


#: Dotted names: each segment ends at a word's end. Characters shown on both sides of a cut. Fixed values.
DOTTED = r"(?U)\b[A-Za-z_][A-Za-z0-9_]*+(?:\.[A-Za-z_][A-Za-z0-9_]*+\b)++"
SHOWN = 80


def ordinal(chunk_id: Column) -> Column:
    """Struct (main, sub) of an id that ends with ``/main`` or ``/main-sub``; 0 for what is no number."""
    parts = F.split(F.substring_index(chunk_id, "/", -1), "-", -1)
    number = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0))
    return F.struct(number(0).alias("main"), number(1).alias("sub"))


def boundary_issues(chunks: DataFrame) -> DataFrame:
    """page, prev_id, next_id, kind, name, tail, head: cuts of ``chunks`` (chunk_id, page, content) inside names.

    Name: a chunk ends with a word and a dot, the next one of its page begins with a word, and the two joined are a dotted name of
    the corpus.  Pair: they are neighbours in a longer one.  LeadingDot: a chunk that is not its page's first begins with a dot; it
    has no prev_id, name or tail.  Pages are ordered by their ids' ordinals.  Of the corpus's names only those that cuts ask
    for are kept.
    """
    order = Window.partitionBy("page").orderBy(ordinal(F.col("chunk_id")), "chunk_id")
    sides = chunks.select(
        "chunk_id", "page", F.substring("content", 1, SHOWN).alias("head"), F.expr(f"right(content, {SHOWN})").alias("tail"),
        F.reverse(F.regexp_extract(F.reverse("content"), r"(?U)^\s*\.([\p{L}\p{Nd}_]*)", 1)).alias("last"), F.regexp_extract("content", r"(?U)^\s*([\p{L}\p{Nd}_]*)", 1).alias("first"),
        F.col("content").rlike(r"(?U)^\s*\.").alias("dot"),
    )
    rows = sides.select("*", F.lag("chunk_id").over(order).alias("prev_id"), F.lag("last").over(order).alias("prev_last"), F.lag("tail").over(order).alias("prev_tail"))
    rows = written(rows.where("prev_id IS NOT NULL"))
    letters = F.col("prev_last").rlike(r"^\p{L}") & F.col("first").rlike(r"^\p{L}")
    joined = rows.where(letters).select("page", "prev_id", F.col("chunk_id").alias("next_id"), F.concat_ws(".", "prev_last", "first").alias("name"), F.col("prev_tail").alias("tail"), "head")
    names = F.array_distinct(F.regexp_extract_all("content", F.lit(f"({DOTTED})"), F.lit(1)))
    parts = lambda n: let(F.split(n, r"\."), lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: F.struct(F.concat_ws(".", F.get(p, i), F.get(p, i + 1)).alias("name"), (F.size(p) == 2).alias("whole"))))
    found = chunks.select(F.explode(F.flatten(F.transform(names, parts))).alias("n")).select("n.*").join(joined.select("name").distinct(), "name", "left_semi")
    cut = joined.join(found.groupBy("name").agg(F.bool_or("whole").alias("whole")), "name")
    none = F.lit(None).cast("string")
    dots = rows.where("dot").select("page", none.alias("prev_id"), F.col("chunk_id").alias("next_id"), F.lit("LeadingDot").alias("kind"), none.alias("name"), none.alias("tail"), "head")
    return cut.select("page", "prev_id", "next_id", F.when(F.col("whole"), "Name").otherwise("Pair").alias("kind"), "name", "tail", "head").unionByName(dots)
