"""Tokens, identifiers and small text projections as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token patterns. Fixed values.
PROSE = "[A-Za-z][A-Za-z0-9]+"
#: Repeated groups are possessive: a group that may give back is matched by recursion, and long joined names overflow the stack.
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*+(?:(?:\.|::|->)[A-Za-z_][A-Za-z0-9_]*+)*+"
MENTION = r"\b[A-Z][A-Za-z0-9_]+\b"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, where a function over arrays would compute it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prose_tokens(text: Column) -> Column:
    """Lower-case prose tokens of two characters or more, with repeats."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({PROSE})"), F.lit(1)), F.lower)


def identifiers(text: Column, least: int = 2) -> Column:
    """Identifiers as written, dots and arrows joined, with repeats."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"({IDENTIFIER})"), F.lit(1)), lambda t: F.length(t) >= least)


def identifier_terms(text: Column, least: int = 2) -> Column:
    """Each identifier as written, and in small letters where that differs."""
    return F.flatten(F.transform(identifiers(text, least), lambda t: F.array_distinct(F.array(t, F.lower(t)))))


def counted(terms: Column) -> Column:
    """Array of (term, tf) by term: the array is sorted, and each run of equal terms is one element."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        one = lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("tf")))
        return F.when(F.size(s) > 0, let(starts, one)).otherwise(F.array().cast("array<struct<term: string, tf: bigint>>"))

    return let(F.sort_array(terms), runs)


def query_terms(text: Column) -> Column:
    """Distinct terms of a query, prose first."""
    return F.array_distinct(F.concat(prose_tokens(text), identifier_terms(text)))


def collapse(text: Column) -> Column:
    """White space, Unicode's too, collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


#: Shapes of identifiers in queries: dotted, joined by double colons, called, camel case, snake case. Fixed values.
SHAPES = (
    r"\b[A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]+\b",
    r"\b[A-Za-z_][A-Za-z0-9_]*::[A-Za-z_][A-Za-z0-9_]+\b",
    r"\b[A-Za-z_][A-Za-z0-9_]*\(",
    r"\b[A-Za-z]+[a-z]+[A-Z][A-Za-z0-9]*\b",
    r"\b[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+\b",
)


def is_identifier_shaped(query: Column) -> Column:
    """A query that holds any of ``SHAPES``; false for null."""
    return F.coalesce(query.rlike("|".join(f"(?:{s})" for s in SHAPES)), F.lit(False))


def embedding_input(category: Column, library: Column, title: Column, content: Column, limit: int = 6000) -> Column:
    """Text to embed: ``[category] [library] [title]``, a line feed and the content, cut at ``limit`` characters."""
    return F.substring(F.concat(F.lit("["), category, F.lit("] ["), library, F.lit("] ["), title, F.lit("]\n"), content), 1, limit)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def is_safe_id(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$") & ~name.contains(".."), F.lit(False))


def has_internal_structure(name: Column) -> Column:
    """A capital after a small letter, capitals before two small letters, or an inner underscore."""
    return name.rlike(r"\p{Ll}\p{Lu}") | name.rlike(r"\p{Lu}{2}\p{Ll}{2}") | name.rlike(r"[\p{L}\p{Nd}]_[\p{L}\p{Nd}]")


def is_abbreviation(name: Column) -> Column:
    return name.rlike(r"^[\p{Lu}\p{Nd}]{1,4}$")


def fenced_code(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?s)```[^\n]*\n(.*?)```"), F.lit(1))


def without_fences(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)```.*?```", " ")


#: Characters on both sides of a sample in which white space is looked for first.
NEAR = 400


def sample_window(text: Column, token: Column, around: int = 100, cap: int = 200) -> Column:
    """What stands around the token's first place, ``around`` characters on both sides and on to the next white space, collapsed.

    Longer windows are cut to ``cap`` characters around the token, as evenly as the text on both sides allows, and trimmed.
    Null if the token is not there.  Characters are code points.

    White space is looked for in ``NEAR`` characters more on both sides, and in the whole text only where they hold none, so
    that many windows of one long text don't each copy it.
    """
    run = lambda c: F.length(F.regexp_extract(c, r"(?U)^(\S*)", 1))

    def extent(text: Column, at: Column) -> Column:
        """First place of the window of the token at ``at``, and the one behind it."""
        first = F.greatest(at - around, F.lit(1))
        first = first - run(F.reverse(F.substring(text, F.lit(1), first - 1)))
        last = F.least(at + F.length(token) + around, F.length(text) + 1)
        last = last + run(F.substring(text, last, F.length(text) + 1 - last))
        return F.struct(first.alias("first"), last.alias("last"))

    def taken(text: Column, e: Column) -> Column:
        return F.substring(text, e["first"], e["last"] - e["first"])

    def window(at: Column) -> Column:
        lead = F.least(at - 1, F.lit(around + NEAR))
        size = lead + F.length(token) + around + NEAR

        def of_piece(p: Column) -> Column:
            def found(e: Column) -> Column:
                open_left = (e["first"] == 1) & (at - lead > 1)
                open_right = (e["last"] > F.length(p)) & (F.length(p) == size)
                return F.when(open_left | open_right, let(extent(text, at), lambda w: taken(text, w))).otherwise(taken(p, e))

            return let(extent(p, lead + 1), found)

        raw = let(F.substring(text, at - lead, size), of_piece)
        return let(collapse(raw), lambda w: F.when(F.length(w) <= cap, w).otherwise(cut(w)))

    def cut(window: Column) -> Column:
        before = F.instr(window, token) - 1
        after = F.length(window) - before - F.length(token)
        room = F.greatest(F.lit(cap) - F.length(token), F.lit(0))
        right = F.least(after, room - F.least(before, F.floor(room / 2).cast("int")))
        left = F.least(before, room - right)
        return F.trim(F.substring(window, before - left + 1, left + F.length(token) + right))

    return let(F.instr(text, token), lambda at: F.when(at > 0, window(at)))
