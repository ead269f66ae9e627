"""Secret scans: patterns first, then character Markov models of random strings and ordinary identifiers; DataFrame functions only.

Patterns give spans of kinds assign, access and hex.  The models judge every long token, and of one that a pattern has taken a
part of, what is left on its sides: one model is trained on random strings, one on ordinary identifiers, and a token or
part is a span of kind random if its log-likelihood ratio a character is above a threshold.  Random strings are the secrets that patterns found in all documents and ``RANDOM_SAMPLE``
generated ones; ordinary identifiers are the words of 12 to 19 letters in all documents, and ``ORDINARY_SAMPLE`` ones joined
from ``PLAIN`` words in the usual spellings of paths, names and versions, with digits and separators.  Counts grow with the
input and are summed where they lie; what documents hold weighs as much as the generated strings of its class at most, so
verdicts do not move with the input's size.  The models' size is that of their alphabet.  The threshold is calibrated on
identifiers joined from words that the models have not seen.

Spans are in code points, end exclusive.  Spark has no function for the places of a pattern, so a text is split at the
matches, and lengths of parts and matches are added up; only texts that a quick test finds to have a match are split.

Null texts are empty and have no spans; very long ones are scanned whole; repeated rows give the same; an empty table gives
an empty one; other columns, whatever their names, are not read, and ``redacted`` returns them as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm import markov
from cairn.llm.markov import let
from cairn.llm.storage import column

#: (kind, pattern, fewest characters, group they are counted in). Fixed values.
PATTERNS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", r"AKIA[A-Z0-9]{16,}", 20, 0),
    ("hex", r"[0-9a-f]{24,}", 24, 0),
)
KINDS = ("assign", "access", "hex", "random")
#: Tokens that the models judge, and characters of a part of one beside a base span: of shorter ones a ratio says little.
TOKEN, LEAST_PART = r"[A-Za-z0-9+/_-]{20,}", 8
#: Ordinary identifiers: letters only, and too short to be judged, so that no token vouches for itself.
WORDS = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z]{12,19}(?![A-Za-z0-9+/_=-])"
#: Generated random strings and identifiers in the training sample, and nats a character above which a token may be random.
RANDOM_SAMPLE, ORDINARY_SAMPLE, LEAST_RATIO = 2000, 8000, 1.0
#: Share of held-out identifiers that the threshold gives up.
GIVEN_UP = 0.005
#: Words of generated identifiers; every fifth is only in held-out ones. Fixed values.
PLAIN = (
    "get set element class name license github action setup python config value index request response server client http handler factory "
    "manager service test build version release src main java org com apache spark common util node module package install script docs "
    "image file path read write open close stream buffer thread lock event listener callback async await promise string number array list "
    "map hash key token user account session login auth admin default public private static final abstract interface extends import export "
    "return function method object type error exception message log debug info warn trace level format parse encode decode query select "
    "insert update delete table column row database connection pool cache memory disk network socket port host address domain url web page "
    "html css style layout view model controller component render template widget button input form label text font color size width "
    "height left right top bottom center align margin border background image icon animation transition transform rotate scale translate "
    "app store assets static media upload download archive linux windows android x86 arm64 utf8 base64 sha256 md5 v1 v2 api rest json xml "
    "yaml csv apple banana machine learning training dataset batch token layer kernel vector matrix tensor gradient weight bias loss "
    "internationalization localization license copyright readme changelog contributing document number date time year month day hour "
    "minute second start end begin stop first last next previous current total count max min average sum range limit offset order group"
).split()
#: Lower-case letters, one code for capitals, one for digits, one for + and /, one for _ and -; the rest shares another.
ALPHABET = "abcdefghijklmnopqrstuvwxyzA0+_"

SPAN = "array<struct<start:int,order:int,end:int,value:string>>"


def located(text: Column, pattern: str, order: int, least: int, group: int) -> Column:
    """Spans of ``pattern``'s matches that have ``least`` characters in ``group``; value is that group's text."""

    def spans(matches: Column) -> Column:
        parts = F.transform(F.split(text, pattern, -1), F.length)
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

        def step(s: Column, pair: Column) -> Column:
            start = s["at"] + pair["part"]
            end = start + F.length(pair["m"])
            value = F.regexp_extract(pair["m"], pattern, group)
            span = F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), value.alias("value"))
            return F.struct(end.alias("at"), F.when(F.length(value) >= least, F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

        pairs = F.zip_with(matches, F.slice(parts, F.lit(1), F.size(matches)), lambda m, p: F.struct(m.alias("m"), p.alias("part")))
        return F.aggregate(pairs, zero, step, lambda s: s["spans"])

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Pattern spans by start, then kind as listed."""
    return F.array_sort(F.concat(*[located(text, p, i, n, g) for i, (_, p, n, g) in enumerate(PATTERNS)]))


def token_grams(token: Column) -> Column:
    plain = token
    for pattern, sign in (("[A-Z]", "A"), ("[0-9]", "0"), ("[+/]", "+"), ("[_-]", "_")):
        plain = F.regexp_replace(plain, pattern, sign)
    return let(markov.codes(plain, ALPHABET), lambda c: markov.grams(c, markov.size_of(ALPHABET)))


def generated(spark, n: int = RANDOM_SAMPLE) -> DataFrame:
    """``n`` random strings in each of three usual spellings: hex, capitals and digits, base 64."""
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    capitals = F.translate(F.substring(F.md5(digest), 1, 24), "0123456789abcdef", "A7BQZ2KX9MPLT4WR")
    spelled = F.array(F.substring(digest, 1, 40), capitals, F.regexp_replace(F.base64(F.unhex(F.substring(digest, 1, 60))), "=", ""))
    return spark.range(n).select(F.explode(spelled).alias("token"))


def identifiers(spark, n: int = ORDINARY_SAMPLE) -> DataFrame:
    """token, held_out: ``n`` identifiers joined from ``PLAIN`` words, a fifth of them from words that the others lack."""
    some = lambda k, m: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(m)).cast("int")
    held_out = F.pmod("id", F.lit(5)) == 0
    table = lambda words: F.array(*map(F.lit, words))
    known, other = [w for i, w in enumerate(PLAIN) if i % 5], [w for i, w in enumerate(PLAIN) if not i % 5]
    word = lambda k: F.when(held_out, F.get(table(other), some(k, len(other)))).otherwise(F.get(table(known), some(k, len(known))))
    signs = F.get(F.array(*map(F.lit, ["/", "/", "_", "-", "", "", "/", "-_"])), some("sign", 8))
    words = F.array(*[word(f"word {k}") for k in range(5)])
    version = F.get(F.array(*[F.concat(F.lit(a), b) for a in ("", "-", "_", "v") for b in (some("one", 10).cast("string"), (some("year", 60) + 1980).cast("string"), F.concat_ws("-", (some("year", 60) + 1980).cast("string"), F.lpad(some("month", 12).cast("string"), 2, "0")))]), some("version", 12))
    cased = F.transform(words, lambda w, i: F.when(some("case", 4) == 0, F.initcap(w)).when((some("case", 4) == 1) & (i > 0), F.initcap(w)).when((some("case", 4) == 2) & (i == some("upper", 5)), F.upper(w)).otherwise(w))
    whole = F.when(some("all", 12) == 0, F.transform(words, F.upper)).otherwise(F.when(signs == "", F.transform(words, lambda w, i: F.when((i > 0) | (some("case", 2) == 0), F.initcap(w)).otherwise(w))).otherwise(cased))
    at = some("place", 6)
    # a version after the last word mostly, or after an inner one
    numbered = F.transform(whole, lambda w, i: F.when(i == F.when(at < 3, F.lit(4)).otherwise(at), F.concat(w, version)).otherwise(w))
    inner = F.when(signs == "-_", F.lit("-")).otherwise(signs)
    joined = F.aggregate(F.slice(numbered, 2, 4), F.get(numbered, 0), lambda s, w: F.concat(s, F.when((signs == "-_") & (F.length(s) % 2 == 0), F.lit("_")).otherwise(inner), w))
    return spark.range(n).select(joined.alias("token"), held_out.alias("held_out"))


def limit_of(spark, model: Column) -> int:
    """The threshold, in whole millionths of a nat: ``LEAST_RATIO``, or what held-out identifiers need."""
    scores = identifiers(spark).where("held_out").select(markov.ratio(token_grams(F.col("token")), model).alias("score"))
    return max(round(LEAST_RATIO * markov.UNIT), math.ceil(scores.agg(F.percentile("score", F.lit(1 - GIVEN_UP))).first()[0] or 0))


def model_of(docs: DataFrame) -> Column:
    """The model from all of ``docs`` (text) and the generated samples."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    secrets = F.transform(base_spans(text), lambda s: F.struct(s["value"].alias("token"), F.lit(True).alias("label")))
    words = F.transform(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), lambda w: F.struct(w.alias("token"), F.lit(False).alias("label")))
    tokens = docs.select(F.explode(F.concat(secrets, words)).alias("s")).select("s.*")
    names = identifiers(docs.sparkSession).where("NOT held_out").select("token", F.lit(False).alias("label"))
    made = generated(docs.sparkSession).withColumn("label", F.lit(True)).unionByName(names)
    samples = tokens.withColumn("given", F.lit(False)).unionByName(made.withColumn("given", F.lit(True)))
    return markov.as_value(markov.train(samples.select(token_grams(F.col("token")).alias("grams"), "label", "given"), markov.size_of(ALPHABET)))


def scan(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base and spans (``SPAN``) of ``docs`` (doc_id, text), and ``carry`` columns.

    ``spans`` holds the base spans and those of the models, which never overlap a base span.
    """
    model = model_of(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("scanned"), *[column(c).alias(f"carried_{i}") for i, c in enumerate(carry)])
    found = rows.withColumn("base", base_spans(F.col("scanned"))).withColumn("tokens", located(F.col("scanned"), TOKEN, len(PATTERNS), 1, 0))
    limit = limit_of(docs.sparkSession, model)

    def parts(t: Column) -> Column:
        """What base spans leave of a token: all of it, or the parts that are long enough."""
        part = lambda at, end: F.struct(at.alias("start"), t["order"].alias("order"), end.alias("end"), F.substring(F.col("scanned"), at + 1, end - at).alias("value"))
        more = lambda s, end: F.when(end - s["at"] >= LEAST_PART, F.array_append(s["spans"], part(s["at"], end))).otherwise(s["spans"])
        step = lambda s, b: F.struct(F.greatest(s["at"], b["end"]).alias("at"), more(s, b["start"]).alias("spans"))
        inside = F.filter("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
        return F.aggregate(inside, F.struct(t["start"].alias("at"), F.array().cast(SPAN).alias("spans")), step, lambda s: more(s, t["end"]))

    judged = F.flatten(F.transform("tokens", parts))
    added = F.filter(judged, lambda t: markov.ratio(token_grams(t["value"]), model) > limit)
    spans = F.when(F.size("tokens") > 0, F.array_sort(F.concat("base", added))).otherwise(F.col("base"))
    return found.select("doc_id", "base", spans.alias("spans"), *[F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)])


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["order"]), s["start"], s["end"])), ",")


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a text replaced by ``mark``; spans that overlap go together. n_chars, if there, follows."""
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    rows = scan(docs.select("doc_id", "text", *[column(c).alias(n) for c, n in own.items()]), tuple(own.values()))
    text, hit = F.col(own["text"]), F.size("spans") > 0
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        new = (s["at"] == 0) | (x["start"] >= s["at"])
        out = F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(new, out).otherwise(s["out"]).alias("out"))

    clean = F.aggregate("spans", zero, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    rows = rows.withColumn(own["text"], F.when(hit, clean).otherwise(text))
    if "n_chars" in own:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn(own["n_chars"], F.when(hit, F.length(text).cast(kind)).otherwise(F.col(own["n_chars"])))
    return rows.select(*[F.col(n).alias(c) for c, n in own.items()])
