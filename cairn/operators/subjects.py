"""Subjects of documents: replies of a classifier parsed and checked, descriptors for it, and what searches show of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.text import collapse

#: Categories in order. Fixed values.
CATEGORIES = ("Overview", "HowTo", "Sample", "Code", "ApiReference", "ChangeLog", "Unclassified")
#: Limits of a classifier's reply: secondary subjects, pieces of evidence, their characters; confidence below which it is reviewed. Fixed values.
MOST_SECONDARY, MOST_EVIDENCE, EVIDENCE_CHARS, REVIEW_BELOW = 3, 6, 512, 0.65
#: Limits of a descriptor: headings, their characters, table of contents, summary, samples, their characters. Fixed values.
HEADINGS, HEADING_CHARS, CONTENTS_CHARS, SUMMARY_CHARS, SAMPLES, SAMPLE_CHARS = 16, 256, 2048, 1200, 6, 1200

SELECTION = "struct<subject_id:string,confidence:double,evidence:array<string>>"


def parsed_category(reply: Column, categories: tuple[str, ...] = CATEGORIES) -> Column:
    """Struct (category, confidence) of a reply: a JSON object, fenced or bare; else the first category that the text names.

    Unknown names are Unclassified; a confidence that is no number is 0, that of a named category 0.5.
    """
    plain = F.trim(F.replace(F.replace(reply, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    json = F.try_parse_json(plain)
    given = F.try_variant_get(json, "$.category", "string")
    known = F.coalesce(*[F.when(F.lower(F.trim(given)) == c.lower(), F.lit(c)) for c in categories], F.lit("Unclassified"))
    is_number = F.schema_of_variant(F.try_variant_get(json, "$.confidence", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    confidence = F.when(is_number, F.try_variant_get(json, "$.confidence", "double")).otherwise(F.lit(0.0))
    named = F.coalesce(*[F.when(F.lower(plain).contains(c.lower()), F.lit(c)) for c in categories])
    loose = F.struct(F.coalesce(named, F.lit("Unclassified")).alias("category"), F.when(named.isNotNull(), 0.5).otherwise(0.0).alias("confidence"))
    return F.when(json.isNotNull(), F.struct(known.alias("category"), F.coalesce(confidence, F.lit(0.0)).alias("confidence"))).otherwise(loose)


def accepted_category(category: Column, confidence: Column) -> Column:
    return F.when((category != "Unclassified") & (confidence > 0), category).otherwise("Unclassified")


def selection_error(selection: Column, known: Column) -> Column:
    """What is wrong with one selected subject; null if nothing is."""
    evidence = F.transform(selection["evidence"], lambda e: collapse(e))
    return (
        F.when(selection.isNull(), "SelectionMissing").when(~F.coalesce(F.array_contains(known, selection["subject_id"]), F.lit(False)), "UnknownSubject")
        .when(~F.coalesce(selection["confidence"].between(0, 1) & ~F.isnan(selection["confidence"]), F.lit(False)), "Confidence")
        .when(F.coalesce(F.size(evidence), F.lit(0)) < 1, "NoEvidence").when(F.size(evidence) > MOST_EVIDENCE, "TooMuchEvidence")
        .when(F.exists(evidence, lambda e: F.coalesce((F.length(e) == 0) | (F.length(e) > EVIDENCE_CHARS), F.lit(True))), "EvidenceLength")
        .when(F.size(F.array_distinct(F.transform(evidence, F.lower))) < F.size(evidence), "EvidenceRepeated")
    )


def reply_error(primary: Column, secondary: Column, known: Column) -> Column:
    """What is wrong with a reply, the first of it; null if nothing is."""
    others = F.coalesce(secondary, F.array().cast(f"array<{SELECTION}>"))
    ids = F.concat(F.array(primary["subject_id"]), F.transform(others, lambda s: s["subject_id"]))
    bad = F.get(F.filter(F.transform(others, lambda s: selection_error(s, known)), lambda e: e.isNotNull()), F.lit(0))
    return (
        F.when(primary.isNull(), "PrimaryMissing").when(F.size(others) > MOST_SECONDARY, "TooManySubjects").when(selection_error(primary, known).isNotNull(), selection_error(primary, known))
        .when(bad.isNotNull(), bad).when(F.size(F.array_distinct(ids)) < F.size(ids), "SubjectRepeated")
    )


def assigned(replies: DataFrame, known: DataFrame) -> DataFrame:
    """``replies`` (library_id, primary, secondary, ...) with error and needs_review; ``known``: library_id, subject_id of a catalog.

    A reply that is wrong gets the catalog's first subject, without confidence, and is reviewed.
    """
    listed = known.groupBy("library_id").agg(F.array_sort(F.collect_set("subject_id")).alias("known"))
    rows = replies.join(listed, "library_id").withColumn("error", reply_error(F.col("primary"), F.col("secondary"), F.col("known")))
    low = F.coalesce((F.col("primary.confidence") < REVIEW_BELOW) | F.exists(F.coalesce("secondary", F.array().cast(f"array<{SELECTION}>")), lambda s: s["confidence"] < REVIEW_BELOW), F.lit(False))
    fallback = F.struct(F.get("known", F.lit(0)).alias("subject_id"), F.lit(0.0).alias("confidence"), F.array(F.lit("fallback")).alias("evidence")).cast(SELECTION)
    wrong = F.col("error").isNotNull()
    return rows.select(
        *[c for c in replies.columns if c not in ("primary", "secondary")], F.when(wrong, fallback).otherwise(F.col("primary")).alias("primary"),
        F.when(wrong, F.array().cast(f"array<{SELECTION}>")).otherwise(F.coalesce("secondary", F.array().cast(f"array<{SELECTION}>"))).alias("secondary"), "error", (wrong | low).alias("needs_review"),
    )


def clipped(text: Column, most: int) -> Column:
    return F.rtrim(F.substring(collapse(F.coalesce(text, F.lit(""))), 1, most))


def descriptors(sections: DataFrame) -> DataFrame:
    """document_id, headings, contents, summary of ``sections`` (document_id, nth, title, content).

    Distinct headings in order, and up to ``SAMPLES`` sections at even steps. What a document's group holds is bounded: headings
    are ranked and cut before they are gathered, and only the sampled sections are.
    """
    heading = clipped(F.col("title"), HEADING_CHARS)
    rows = sections.select("document_id", "nth", "title", "content", heading.alias("heading"))
    firsts = rows.where("heading <> ''").groupBy("document_id", F.lower("heading").alias("h")).agg(F.min_by("heading", "nth").alias("heading"), F.min("nth").alias("nth"))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("nth"))
    few = firsts.withColumn("place", place).where(f"place <= {HEADINGS}")
    headings = few.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "heading"))), lambda x: x["heading"]).alias("headings"))
    counts = rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    numbered = rows.withColumn("i", F.row_number().over(Window.partitionBy("document_id").orderBy("nth")) - 1).join(counts, "document_id")
    k = F.least("n", F.lit(SAMPLES).cast("long"))
    wanted = F.when(k == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda j: F.floor(j * (F.col("n") - 1) / (k - 1)).cast("long")))
    sample = F.when(F.coalesce(F.trim("title"), F.lit("")) == "", F.col("content")).otherwise(F.concat_ws(": ", "title", "content"))
    taken = numbered.where(F.array_contains(wanted, F.col("i").cast("long"))).select("document_id", "i", clipped(sample, SAMPLE_CHARS).alias("sample"))
    samples = taken.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "sample"))), lambda x: x["sample"]).alias("samples"))
    met = samples.join(headings, "document_id", "left").withColumn("headings", F.coalesce("headings", F.array().cast("array<string>")))
    return met.select("document_id", "headings", clipped(F.array_join("headings", "\n"), CONTENTS_CHARS).alias("contents"), clipped(F.array_join("samples", " "), SUMMARY_CHARS).alias("summary"), "samples")


def resolved(catalog: DataFrame, asked: DataFrame) -> DataFrame:
    """name, subject_id, error of ``asked`` (name): the concept of that id in any case, else the one of that label or alias.

    ``catalog``: id, label, aliases.  More than one concept of a label is an error, none gives a null.
    """
    wanted = asked.select("name", F.lower(collapse(F.col("name"))).alias("term"))
    by_id = wanted.join(catalog.select(F.lower("id").alias("term"), "id"), "term").groupBy("name").agg(F.count_distinct("id").alias("ids"), F.min("id").alias("own"))
    terms = catalog.select("id", F.explode(F.array_distinct(F.transform(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("label")), lambda t: F.lower(t)))).alias("term"))
    by_term = wanted.join(terms, "term").groupBy("name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("one"))
    met = asked.select("name").distinct().join(by_id, "name", "left").join(by_term, "name", "left")
    found = F.when(F.col("ids") == 1, F.col("own")).when(F.col("n") == 1, F.col("one"))
    return met.select("name", found.alias("subject_id"), F.when(found.isNull() & (F.col("n") > 1), "Ambiguous").alias("error"))


def boost(subject_ids: Column, inferred: str | None, amount: float = 0.05) -> Column:
    """What a chunk gains if it has the subject that the query was found to be about."""
    return F.lit(0.0) if inferred is None else F.when(F.array_contains(subject_ids, inferred), amount).otherwise(0.0)


def enriched(chunks: DataFrame, assignments: DataFrame, catalogs: DataFrame) -> DataFrame:
    """chunk_id, taxonomy_version, needs_review, subjects of ``chunks`` (chunk_id, revision_id, taxonomy_version).

    ``assignments``: revision_id, version, library_id, taxonomy_version, needs_review, primary, secondary; of a revision the one of
    the greatest version counts.  ``catalogs``: library_id, taxonomy_version, id, label.  Subjects are struct (id, label, role,
    confidence), the primary first, without those that the catalog lacks; chunks without an assignment or catalog are left out.
    """
    latest = assignments.withColumn("nth", F.row_number().over(Window.partitionBy("revision_id").orderBy(F.desc("version"), "library_id"))).where("nth = 1").drop("nth")
    each = F.concat(F.array(F.struct(F.lit("primary").alias("role"), F.col("primary").alias("s"))), F.transform(F.coalesce("secondary", F.array().cast(f"array<{SELECTION}>")), lambda s: F.struct(F.lit("secondary").alias("role"), s.alias("s"))))
    known = catalogs.select("library_id", "taxonomy_version").distinct()
    rows = latest.join(known, ["library_id", "taxonomy_version"], "left_semi").select("revision_id", "library_id", F.col("taxonomy_version").alias("assigned"), "needs_review", F.posexplode(each).alias("nth", "e"))
    labels = catalogs.select("library_id", F.col("taxonomy_version").alias("assigned"), F.col("id").alias("subject_id"), "label")
    met = rows.withColumn("subject_id", F.col("e.s.subject_id")).join(labels, ["library_id", "assigned", "subject_id"], "left")
    subject = F.when(F.col("label").isNotNull(), F.struct("nth", F.col("subject_id").alias("id"), "label", F.col("e.role").alias("role"), F.col("e.s.confidence").alias("confidence")))
    shown = met.groupBy("revision_id", "assigned", "needs_review").agg(F.transform(F.array_sort(F.collect_list(subject)), lambda s: F.struct(s["id"].alias("id"), s["label"].alias("label"), s["role"].alias("role"), s["confidence"].alias("confidence"))).alias("subjects"))
    fits = F.col("taxonomy_version").isNull() | (F.col("taxonomy_version") == F.col("assigned"))
    return chunks.join(shown, "revision_id").where(fits).select("chunk_id", F.col("assigned").alias("taxonomy_version"), "needs_review", "subjects")
