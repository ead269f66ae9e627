"""Symbols of chunk texts: candidates, reasons to reject, aggregates of rejections, subjects."""

from __future__ import annotations

from string import ascii_lowercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.text import MENTION, fenced_code, has_internal_structure, identifiers, is_abbreviation, let, sample_window, without_fences
from cairn.operators.candidates import names_used
from cairn.operators.catalog import third
from cairn.sources.scratch import written

#: First words of subject terms that texts are searched for directly; with more, runs begin at every word.
MOST_FIRST = 10_000
#: Words that are no symbols, by topic: single letters, plain English, words of documentation, call-outs and buttons. Fixed values.
STOPLIST = tuple(
    list(ascii_lowercase)
    + """the and or but if then else when where while for with without from to into onto upon off of in on at by as is are was were be
    been being have has had do does did will would should could may might must shall can this that these those there here what which
    who whom whose why how all any some not only own same so than too very just now also before after above below during each every both
    between among such more most less many much few another other others an you your yours we us our ours they them their theirs
    it its he him his she her hers""".split()
    + """represents returns values value use uses used using see note notes example examples default defaults type types name names list lists
    method methods function functions class classes interface interfaces object objects member members field fields property properties
    parameter parameters argument arguments result results output outputs input inputs true false null none undefined yes no warning
    warnings error errors exception exceptions available supports supported requires required optional deprecated obsolete internal private
    public protected static abstract virtual override sealed readonly lets let make makes set sets get gets""".split()
    + "important caution tip tips info danger notice remark remarks back next previous ok cancel close done submit menu search home exit edit view save open".split()
)
#: Units by the prefixes that they take, as written; units that short names are in any case. Fixed values.
PREFIXED = {
    "m": "f p n u m c d k M", "g": "f p n u m k M", "s": "f p n u m k", "A": "f p n u m k", "V": "u m k M", "W": "u m k M G", "Hz": "k M G T m", "Ohm": "k M", "Ω": "k M", "S": "u m k",
    "F": "p n u m", "H": "u m", "J": "k M m u", "Pa": "k M G h", "b": "K M G T P", "B": "K M G T P", "iB": "K M G T P", "bps": "K M G T", "FLOPS": "M G T",
}
UNITS = (
    """m g s A K mol cd Hz N Pa J W C V F S Wb T H lm lx Bq Gy Sv kat rad sr Ohm ohm ohms Ω mbar bar °C °F °K ° deg in ft yd mi oz lb lbs ton
    gal qt pt mph fps knot knots hp BTU btu psi psia psig rpm RPM dps dpm dB dBm dBi dBu dBV dBW b B bps MIPS FLOPS""".split()
    + [p + unit for unit, prefixes in PREFIXED.items() for p in prefixes.split()]
)
UNITS_IN_ANY_CASE = "hz khz mhz ghz thz rpm psi btu mph fps dps ohm ohms kb mb gb tb pb bps".split()
#: Characters of names that are units in any case, at most. A fixed value.
UNIT_CHARS = 4
#: Names that code and prose say something of, which are sent to all tasks; with more, those that ask are joined.
MOST_SENT = 1_000_000
#: Stands for the reason of a name while code and prose are still to be asked.
ASKED = "Asked"


def code_identifiers(chunks: DataFrame) -> DataFrame:
    """Distinct identifiers of code, fenced or in elements for it, and their parts of two characters or more."""
    marked = F.regexp_extract_all("content", F.lit(r"(?is)<pre[^>]*>\s*<code[^>]*>(.*?)</code>"), F.lit(1))
    names = F.flatten(F.transform(F.concat(fenced_code(F.col("content")), marked), lambda c: identifiers(c)))
    parts = F.flatten(F.transform(names, lambda n: F.array_append(F.split(n, r"\.|::|->"), n)))
    return chunks.select(F.explode(F.array_distinct(parts)).alias("name")).where("length(name) >= 2").distinct()


def mentions(chunks: DataFrame) -> DataFrame:
    """name, n: capitalised names in prose, over all chunks."""
    found = F.regexp_extract_all(without_fences(F.col("content")), F.lit(f"({MENTION})"), F.lit(1))
    return chunks.select(F.explode(found).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def with_reasons(chunks: DataFrame, extra: list[Column], stoplist=STOPLIST, library_stoplist=(), units=UNITS, any_case=UNITS_IN_ANY_CASE, likely=(), frequent: int = 3) -> DataFrame:
    """chunk_id, name, reason of candidates, and ``extra`` columns of ``names_used``.

    Lists and shapes are asked for the name and for its leaf, where the name was found.  What code and prose of all chunks say is
    asked only for names that nothing else decides: they have no container, and without code they begin with a capital.
    """
    code = written(code_identifiers(chunks))
    coded = bool(code.take(1))
    facts = mentions(chunks).where(F.col("n") >= frequent).select("name", F.lit(True).alias("often"), F.lit(False).alias("in_code"))
    if coded:
        facts = facts.unionByName(code.select("name", F.lit(False).alias("often"), F.lit(True).alias("in_code"))).groupBy("name").agg(F.bool_or("often").alias("often"), F.bool_or("in_code").alias("in_code"))
    either = lambda test: test(F.col("name")) | test(F.col("leaf"))
    small = lambda words: [w.lower() for w in words]
    is_unit = lambda c: c.isin(*units) | ((F.length(c) <= UNIT_CHARS) & F.lower(c).isin(*small(any_case)))
    listed = lambda words: either(lambda c: F.lower(c).isin(*small(words)))
    keeps = F.col("declared") | F.col("callable") | F.col("generic") | F.col("container").isNotNull() | either(lambda c: c.isin(*likely))
    keeps = keeps | F.col("name").rlike(r"_|\.|::|->") | has_internal_structure(F.col("name"))
    fixed = F.when(listed(stoplist), "GlobalStoplist").when(listed(library_stoplist), "LibraryStoplist").when(either(is_unit), "Unit").when(F.length("name") < 2, "BelowMinLength")
    capital = F.substring("name", 1, 1).between("A", "Z") | F.lit(coded)
    found = names_used(chunks).select("chunk_id", "name", *extra, F.coalesce(fixed, F.when(~keeps, F.when(capital, ASKED).otherwise("NoStructureSignal"))).alias("reason"))
    abbreviation = is_abbreviation(F.col("name"))
    said = F.when(F.col("in_code") | (F.col("often") & ~abbreviation), None).when(F.col("often") & abbreviation, "LikelyAbbreviation").otherwise("NoStructureSignal")
    facts, asks = written(facts), F.col("reason") == ASKED
    if facts.limit(MOST_SENT + 1).count() <= MOST_SENT:
        met = found.join(F.broadcast(facts), "name", "left")
        return met.withColumn("reason", F.when(asks, said).otherwise(F.col("reason"))).select(*found.columns)
    found = written(found)
    asked = found.where(asks).join(facts, "name", "left").withColumn("reason", said)
    return found.where(F.col("reason").isNull() | ~asks).unionByName(asked.select(*found.columns))


def judged(chunks: DataFrame, stoplist=STOPLIST, library_stoplist=(), units=UNITS, any_case=UNITS_IN_ANY_CASE, likely=(), frequent: int = 3) -> DataFrame:
    """chunk_id, name, reason of each chunk's distinct candidates; a null reason keeps one.

    In order: stop lists, units, too short, reasons to keep (declared, likely, in code, with a container, inner structure, called,
    generic, frequent in prose and no abbreviation), else rejected: as an abbreviation if it is frequent in prose.  A name that is
    used in more than one way in a chunk is kept if one of them keeps it; its other reasons do not depend on the use.
    """
    return with_reasons(chunks, [], stoplist, library_stoplist, units, any_case, likely, frequent)


def rejections(judged_rows: DataFrame, index: str, n: int) -> DataFrame:
    """name, chunks, first_reason and the thirds of the corpus in which a name was rejected."""
    rows = judged_rows.where("reason IS NOT NULL").withColumn("third", third(F.col(index), F.lit(n)))
    return rows.groupBy("name").agg(F.count_distinct(index).alias("chunks"), F.min_by("reason", index).alias("first_reason"), F.array_sort(F.collect_set("third")).alias("thirds"))


def rejected_samples(judged_rows: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """name, reason, chunks, samples: rejected names with the number of their chunks and one window of text from each third of the
    corpus that rejects them, in order.

    ``judged_rows``: index, name, reason, each name once a chunk; ``chunks``: index, content; ``n``: how many there are.  The first
    chunk of each name and third is found without any text; then a chunk meets its own few names once, and is cut for them.
    """
    rows = judged_rows.where("reason IS NOT NULL").withColumn("third", third(F.col("index"), F.lit(n)))
    picks = written(rows.groupBy("name", "third").agg(F.count(F.lit(1)).alias("chunks"), F.min("index").alias("index"), F.min_by("reason", "index").alias("reason")))
    asked = picks.groupBy("index").agg(F.collect_list(F.struct("name", "third", "chunks", "reason")).alias("picks"))  # a chunk's own names at most
    cut = F.transform("picks", lambda p: F.struct(p["name"].alias("name"), p["third"].alias("third"), p["chunks"].alias("chunks"), p["reason"].alias("reason"), sample_window(F.col("content"), p["name"]).alias("sample")))
    met = asked.join(chunks, "index", "left").select("index", F.explode(cut).alias("s")).select("index", "s.*")
    samples = F.array_sort(F.collect_list(F.when(F.col("sample").isNotNull(), F.struct("third", "sample"))))
    return met.groupBy("name").agg(F.min_by("reason", "index").alias("reason"), F.sum("chunks").alias("chunks"), F.transform(samples, lambda s: s["sample"]).alias("samples"))


def inferred_subject(texts: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """key, subject_id: the longest term (then smallest id) that a text holds as whole words; ``terms``: subject_id, term.

    Words and runs of words of the text meet the terms in an equi-join, so no pair of text and term is tried.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1))
    terms = written(terms.select("subject_id", "term"))  # so that its size is known, and it is sent if it is small
    facts = terms.agg(F.max(F.size(F.split("term", " "))).alias("m"), F.slice(F.collect_set(F.substring_index(F.lower("term"), " ", 1)), F.lit(1), F.lit(MOST_FIRST + 1)).alias("first")).first()
    longest, first = facts["m"] or 0, facts["first"]
    begins = (lambda w: w.isin(first)) if len(first) <= MOST_FIRST else (lambda w: F.lit(True))

    def runs(ws: Column) -> Column:
        """Runs of up to ``longest`` words that begin as some term does."""
        starts = F.filter(F.transform(ws, lambda w, i: F.when(begins(w), i)), lambda i: i.isNotNull())
        each = F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(ws) - i)), lambda k: F.array_join(F.slice(ws, i + 1, k), " ")))
        return F.array_distinct(F.flatten(each))

    every = let(words, runs) if longest else F.array().cast("array<string>")
    grams = texts.select(key, F.explode(every).alias("gram"))
    hits = grams.join(terms.select("subject_id", F.lower("term").alias("gram")), "gram")
    order = Window.partitionBy(key).orderBy(F.length("gram").desc(), "subject_id")
    return hits.withColumn("nth", F.row_number().over(order)).where("nth = 1").select(key, "subject_id")


#: Kinds by declaring keyword; rank of kinds as a chunk's primary name. Fixed values.
DECLARES = {"class": "Type", "interface": "Type", "struct": "Type", "record": "Type", "type": "Type", "enum": "Enum", "def": "Function", "function": "Function"}
KIND_RANK = ("Type", "Enum", "Function", "Property", "Parameter", "Namespace")


def kind(name: Column, leaf: Column, keyword: Column, callable_: Column, generic: Column, container: Column, likely: list[str], types_pascal: bool = True, methods_snake: bool = False) -> Column:
    """A symbol's kind: by its keyword, then by how it is used, then by how it is written."""
    declared = F.coalesce(*[F.when(keyword == k, v) for k, v in DECLARES.items()])
    pascal = leaf.rlike(r"^\p{Lu}") & (leaf.rlike(r"\p{Ll}\p{Lu}") | leaf.rlike(r"\p{Lu}{2}\p{Ll}{2}")) & ~leaf.contains("_")
    snake = leaf.contains("_") & leaf.rlike(r"^[\p{Ll}\p{Nd}_]+$")
    shape = F.when(callable_, "Function").when(generic, "Type").when(container.isNotNull(), "Property").when(name.isin(*likely) | leaf.isin(*likely), "Type")
    written_as = F.when(pascal & F.lit(types_pascal), "Type").when(snake & F.lit(methods_snake), "Function").otherwise("Unknown")
    return F.coalesce(declared, shape, written_as)


def symbols(chunks: DataFrame, likely: list[str] = (), types_pascal: bool = True, methods_snake: bool = False, **lists) -> DataFrame:
    """chunk_id, name, kind, nth of the symbols that ``judged`` keeps: each name once a chunk, as it is first used."""
    shape = kind(F.col("name"), F.col("leaf"), F.col("keyword"), F.col("first_callable"), F.col("first_generic"), F.col("container"), list(likely), types_pascal, methods_snake)
    return with_reasons(chunks, [shape.alias("kind"), F.col("nth")], likely=likely, **lists).where("reason IS NULL").drop("reason")


def rank(kind_: Column) -> Column:
    return F.coalesce(*[F.when(kind_ == k, F.lit(i)) for i, k in enumerate(KIND_RANK)], F.lit(len(KIND_RANK)))


def primary_names(found: DataFrame) -> DataFrame:
    """chunk_id, primary: the symbol of the first kind, then the first in the text; ``found`` (chunk_id, name, kind, nth)."""
    return found.groupBy("chunk_id").agg(F.min_by("name", F.struct(rank(F.col("kind")), "nth")).alias("primary"))


def named(names: DataFrame, column: str, part: str | None) -> DataFrame:
    """Rows whose ``column`` holds ``part`` in any case, taken literally; all for a blank one."""
    return names if part is None or not part.strip() else names.where(F.lower(column).contains(part.lower()))


def of_kind(found: DataFrame, kind_: str, part: str | None = None) -> DataFrame:
    """name: distinct names of a kind, in order."""
    return named(found.where(F.col("kind") == kind_).select("name").distinct(), "name", part).orderBy("name")


def distinct_symbols(found: DataFrame) -> DataFrame:
    """name, kind, chunk_id: each pair once, from the first chunk that has it."""
    return found.groupBy("name", "kind").agg(F.min("chunk_id").alias("chunk_id"))


def type_names(found: DataFrame, legacy: DataFrame, part: str | None = None) -> DataFrame:
    """name: types among ``found``, and the qualified names of ``legacy`` chunks (qualified_name), which have no symbols."""
    old = legacy.where("qualified_name IS NOT NULL AND trim(qualified_name) <> ''").select(F.col("qualified_name").alias("name"))
    return named(found.where("kind = 'Type'").select("name").unionByName(old).distinct(), "name", part)


def changed_symbols(before: DataFrame, after: DataFrame, columns: tuple[str, ...] = ("symbols", "name", "parser_version", "category")) -> DataFrame:
    """chunk_id of rows whose ``columns`` differ between two extractions."""
    old = before.select("chunk_id", *[F.col(c).alias(f"old_{c}") for c in columns])
    same = [F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in columns]
    apart = ~same[0]
    for x in same[1:]:
        apart = apart | ~x
    return after.join(old, "chunk_id").where(apart).select("chunk_id")


def hint(excluded: Column, kept: Column) -> Column:
    """Whether so many names were excluded that the lists should be looked at."""
    return (excluded >= 20) & (excluded / F.greatest(excluded + kept, F.lit(1)) >= 0.05)


def profile_hash(columns: dict[str, Column]) -> Column:
    """Upper-case SHA-256 of a profile's values by name; arrays are sorted first, so their order does not matter."""
    return F.upper(F.sha2(F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)])), 256))


def moved(profiles: DataFrame, names: list[str], to: str) -> DataFrame:
    """``profiles`` (likely, stoplist) with ``names`` put on the list ``to`` and taken off the other."""
    given, other = F.array(*map(F.lit, names)), {"likely": "stoplist", "stoplist": "likely"}[to]
    return profiles.withColumn(to, F.array_union(to, given)).withColumn(other, F.array_except(other, given))


def carried_forward(profiles: DataFrame, column: str) -> DataFrame:
    """``profiles`` (library_id, version, created, ...) with an empty ``column`` taken from the latest other version that has one."""
    filled = profiles.where(F.size(column) > 0)
    two = filled.withColumn("place", F.row_number().over(Window.partitionBy("library_id").orderBy(F.desc("created"), F.desc("version")))).where("place <= 2")
    listed = two.groupBy("library_id").agg(F.array_sort(F.collect_list(F.struct("place", "version", F.col(column).alias("value")))).alias("others"))
    other = F.get(F.filter("others", lambda o: o["version"] != F.col("version")), F.lit(0))["value"]
    met = profiles.join(listed, "library_id", "left")
    return met.withColumn(column, F.when(F.coalesce(F.size(column), F.lit(0)) > 0, F.col(column)).otherwise(F.coalesce(other, F.col(column)))).drop("others")
