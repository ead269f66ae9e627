"""Subject catalogs: proposals reconciled with the concepts that a library has.

Proposals are taken in order, each against what those before it have made of the catalog: it replaces the one concept that shares a
term with it, else the one of its id, else it is new.  Rows that share no term and no id don't meet, so a library falls apart into
components, found by joins.  Where a component has one concept at most and all its rows share a term, each proposal replaces
the one before, and the last one counts: that is an aggregate, however many there are.  Only the rows of other components go
through their order one by one, a component's in one task, which holds that component's concepts.

An id that the catalog doesn't have at the start is unknown to all proposals.
"""

from __future__ import annotations

from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.text import collapse, let
from cairn.operators.catalog import running_total
from cairn.sources.scratch import written

#: Most characters of labels and aliases, and of descriptions; most aliases. Fixed values.
LABEL_CHARS, DESCRIPTION_CHARS, MOST_ALIASES = 256, 1200, 16

CONCEPTS = "array<struct<id:string,label:string,aliases:array<string>,description:string>>"
NO_NAME, MANY, OTHER_ID, NO_ID = "a concept requires a label and a description", "more than one concept matches", "its id and its terms name different concepts", "unknown id"


def bounded(text: Column, most: int) -> Column:
    return F.rtrim(F.substring(F.trim(collapse(F.coalesce(text, F.lit("")))), 1, most))


def ordered(aliases: Column) -> Column:
    """Aliases that differ by more than case, the first of each, in order without case."""
    keyed = F.array_sort(F.transform(F.coalesce(aliases, F.array().cast("array<string>")), lambda a, i: F.struct(F.upper(a).alias("u"), i.alias("i"), a.alias("a"))))
    return let(keyed, lambda s: F.transform(F.filter(s, lambda x, i: (i == 0) | (x["u"] != F.get(s, i - 1)["u"])), lambda x: x["a"]))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component: nodes (node) that keys of ``edges`` (node, key) connect, named by their smallest node.

    In each round a node takes the smallest name around its keys, and then that name's name.
    """
    names = written(nodes.select("node", F.col("node").alias("component")))
    edges = written(edges)
    while True:
        least = edges.join(names, "node").groupBy("key").agg(F.min("component").alias("around"))
        around = edges.join(least, "key").groupBy("node").agg(F.min("around").alias("around"))
        nearer = written(names.join(around, "node", "left").select("node", "component", F.least("component", "around").alias("now")))
        jump = nearer.select(F.col("node").alias("now"), F.col("now").alias("then"))
        moved = written(nearer.join(jump, "now", "left").select("node", F.least("now", "then").alias("component"), (F.least("now", "then") < F.col("component")).alias("moved")))
        names = moved.select("node", "component")
        if moved.where("moved").isEmpty():
            return names


def in_order(rows: DataFrame) -> DataFrame:
    """What the rows of components with conflicts make, one after another: rows of concepts, and of the errors that end a component.

    Of ``rows`` (library_id, component, at, id, label, aliases, description, terms; an ``at`` of null marks a concept that is there).
    """
    kind = "library_id string, id string, made_at long, made_label string, label string, aliases array<string>, description string, error_at long, error string"
    names = [c.split()[0] for c in kind.split(", ")]
    schema = pa.schema([(n, pa.int64() if n.endswith("_at") else pa.list_(pa.string()) if n == "aliases" else pa.string()) for n in names])

    def of_one(group) -> list[dict]:
        concepts: dict[tuple, dict] = {}  # by id, or by place in the order for those that are new
        holders: dict[str, set] = {}

        def error(r, text):
            return [{"library_id": r["library_id"], "error_at": r["at"], "error": text}]

        for r in group:
            own = ("id", r["id"])
            if r["at"] is None:
                at = own
            elif not r["label"] or not r["description"]:
                return error(r, NO_NAME)
            else:
                found = set().union(*(holders.get(t, ()) for t in r["terms"]))
                if len(found) > 1:
                    return error(r, f"{r['label']}: {MANY}")
                if found and own in concepts and own not in found:
                    return error(r, f"{r['label']}: {OTHER_ID}")
                if not found and r["id"] is not None and own not in concepts:
                    return error(r, f"{r['label']}: {NO_ID} {r['id']}")
                at = found.pop() if found else own if r["id"] is not None else ("new", r["at"])
            before = concepts.get(at)
            for t in before["terms"] if before else ():
                holders[t].discard(at)
            for t in r["terms"]:
                holders.setdefault(t, set()).add(at)
            made = {k: before[k] for k in ("id", "made_at", "made_label")} if before else {"id": r["id"] if at == own else None, "made_at": None if at == own else r["at"], "made_label": r["label"]}
            concepts[at] = {k: r[k] for k in ("library_id", "label", "aliases", "description", "terms")} | made
        return list(concepts.values())

    def run(batches):
        each = chain.from_iterable(b.to_pylist() for b in batches)
        for _, group in groupby(each, key=lambda r: (r["library_id"], r["component"])):
            yield pa.RecordBatch.from_pylist([{n: c.get(n) for n in names} for c in of_one(group)], schema=schema)

    dealt = rows.repartition("library_id", "component").sortWithinPartitions("library_id", "component", F.col("at").isNotNull(), "at", "id")
    return dealt.select("library_id", "component", "at", "id", "label", "aliases", "description", "terms").mapInArrow(run, kind)


def reconciled(catalogs: DataFrame, proposals: DataFrame) -> DataFrame:
    """library_id, revision, taxonomy_version, previous_version, changed, error, concepts: a row for each library of either.

    ``catalogs``: library_id, revision, id, label, aliases, description. ``proposals``: library_id, document_id, nth,
    subject_id, label, aliases, description, taken by document_id and nth.  The next revision if concepts differ from
    those before, else the one before; after an error, that one and the first error.
    """
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    old = catalogs.where("library_id IS NOT NULL").select("library_id", F.col("revision").cast("int"), F.lit(None).cast("string").alias("document_id"), F.lit(None).cast("int").alias("nth"), "id", "label", ordered(F.col("aliases")).alias("aliases"), "description")
    kept = F.filter(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: bounded(a, LABEL_CHARS)), lambda a: F.length(a) > 0)
    new = proposals.where("library_id IS NOT NULL").select(
        "library_id", F.lit(None).cast("int").alias("revision"), "document_id", F.col("nth").cast("int"), blank(F.col("subject_id")).alias("id"), bounded(F.col("label"), LABEL_CHARS).alias("label"),
        F.slice(ordered(kept), 1, MOST_ALIASES).alias("aliases"), bounded(F.col("description"), DESCRIPTION_CHARS).alias("description"),
    )
    new = running_total(new.withColumn("one", F.lit(1)), ["library_id", "document_id", "nth", "id", "label", "description"], "one").withColumnRenamed("total", "at").drop("one")
    terms = F.array_distinct(F.filter(F.transform(F.concat(F.array(F.coalesce("label", F.lit(""))), "aliases"), F.upper), lambda t: F.length(t) > 0))
    numbered = old.withColumn("at", F.lit(None).cast("long")).unionByName(new.withColumn("at", F.col("at").cast("long")))
    node = F.xxhash64("library_id", F.coalesce("at", F.lit(0)), F.when(F.col("at").isNull(), F.col("id")))
    rows = written(numbered.withColumn("terms", terms).withColumn("node", node))
    key = lambda kind, c: F.xxhash64("library_id", F.lit(kind), c)
    edges = rows.select("node", F.explode("terms").alias("t"), "library_id").select("node", key("term", "t").alias("key")).unionByName(rows.where("id IS NOT NULL").select("node", key("id", "id").alias("key")))
    rows = written(rows.join(components(edges.distinct(), rows.select("node").distinct()), "node"))

    own = ["library_id", "component"]
    order = F.struct(F.col("at").isNotNull(), "at")
    whole = F.struct("id", "at", "label", "aliases", "description")
    invalid = F.col("at").isNotNull() & ((F.length("label") == 0) | (F.length("description") == 0))
    facts = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("at").isNull()).alias("n_old"), F.bool_or(invalid).alias("invalid"), F.min_by(whole, order).alias("first"), F.max_by(whole, order).alias("last"))
    shared = rows.select(*own, F.explode("terms").alias("t")).groupBy(*own, "t").agg(F.count(F.lit(1)).alias("n")).groupBy(*own).agg(F.max("n").alias("shared"))
    facts = written(facts.join(shared, own, "left"))
    plain = (F.col("n_old") <= 1) & ~F.col("invalid") & (F.coalesce("shared", F.lit(0)) == F.col("n")) & ((F.col("n_old") == 1) | F.col("first.id").isNull())
    last = facts.where(plain).select(
        "library_id", F.when(F.col("n_old") == 1, F.col("first.id")).alias("id"), F.when(F.col("n_old") == 0, F.col("first.at")).alias("made_at"), F.col("first.label").alias("made_label"),
        "last.label", "last.aliases", "last.description",
    )
    with_conflict = in_order(rows.join(facts.where(~plain).select(*own), own, "left_semi"))
    made = written(last.unionByName(with_conflict, allowMissingColumns=True))

    libraries = rows.groupBy("library_id").agg(F.coalesce(F.max("revision"), F.lit(0)).alias("before"), F.count_if(F.col("at").isNull()).alias("n_before"))
    libraries = libraries.join(made.where("error IS NOT NULL").groupBy("library_id").agg(F.min_by("error", "error_at").alias("error")), "library_id", "left")
    nth = F.row_number().over(Window.partitionBy("library_id").orderBy("made_at")) - 1
    fresh = made.where("error IS NULL AND made_at IS NOT NULL").withColumn("nth", nth).join(libraries.select("library_id", "before", "n_before"), "library_id")
    digest = F.substring(F.sha2(F.concat_ws("/", "library_id", "before", F.col("n_before") + F.col("nth"), "made_label"), 256), 1, 16)
    fresh = fresh.withColumn("id", F.concat(F.lit("subject-"), digest))
    now = made.where("error IS NULL AND made_at IS NULL").unionByName(fresh.select(*made.columns))
    concept = F.struct("id", "label", "aliases", "description")
    listed = lambda df, at: df.groupBy("library_id").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col("id").alias("by"), concept.alias("c")))).alias("cs")).select("library_id", F.transform("cs", lambda c: c["c"]).cast(CONCEPTS).alias("cs"))
    first = listed(rows.where("at IS NULL"), F.lit(0)).withColumnRenamed("cs", "old")
    second = listed(now, F.coalesce("made_at", F.lit(0))).withColumnRenamed("cs", "new")
    out = libraries.join(first, "library_id", "left").join(second, "library_id", "left")
    none = F.array().cast(CONCEPTS)
    error = F.coalesce("error", F.when(F.size(F.coalesce("new", none)) == 0, F.lit("the catalog is empty")))
    out = out.withColumn("error", error).withColumn("changed", F.col("error").isNull() & ~F.col("new").eqNullSafe(F.col("old"))).withColumn("revision", (F.col("before") + F.col("changed").cast("int")).cast("int"))
    version = lambda n: F.when(n > 0, F.concat(F.lit("taxonomy-"), F.lpad(n.cast("string"), 6, "0")))
    return out.select(
        "library_id", "revision", version(F.col("revision")).alias("taxonomy_version"), F.when(F.col("changed"), version(F.col("before"))).alias("previous_version"), "changed", "error",
        F.coalesce(F.when(F.col("error").isNull(), F.col("new")).otherwise(F.col("old")), none).alias("concepts"),
    )
