"""Documents that a converter has turned into JSON: its reply checked, blocks in reading order, cells of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.sources.scratch import written

#: Labels of headings. Fixed values.
HEADINGS = ("title", "section_header", "subtitle")
_REFS = "array<struct<`$ref`:string>>"
_PROV = "array<struct<page_no:int>>"
_CELLS = "struct<table_cells:array<struct<start_row_offset_idx:int,start_col_offset_idx:int,text:string>>>"
DOCUMENT = (
    f"body struct<children:{_REFS}>, groups array<struct<self_ref:string,children:{_REFS}>>, texts array<struct<self_ref:string,label:string,text:string,level:int,prov:{_PROV},children:{_REFS}>>, "
    f"tables array<struct<self_ref:string,label:string,prov:{_PROV},data:{_CELLS},children:{_REFS}>>"
)


def replies(rows: DataFrame) -> DataFrame:
    """document_id, error, document of ``rows`` (document_id, json): what a converter has answered; a null error is a success.

    ``document`` is the lossless document, given as an object or as a string of JSON.
    """
    json = F.try_parse_json("json")
    read = rows.select("document_id", json.alias("j"), F.try_variant_get(json, "$.status", "string").alias("status"))
    inner = F.get_json_object(F.to_json("j"), "$.document.json_content")
    text = F.coalesce(F.nullif(F.try_variant_get("j", "$.document.md_content", "string"), F.lit("")), F.nullif(F.try_variant_get("j", "$.document.text_content", "string"), F.lit("")))
    error = (
        F.when(F.col("j").isNull(), "OutputInvalid").when(F.col("status").isNull(), "ApiIncompatible").when(F.col("status") == "partial_success", "PartialConversion")
        .when(F.col("status").isin("failure", "skipped"), "ConversionFailed").when(F.col("status") != "success", "ApiIncompatible")
        .when(F.get_json_object(F.to_json("j"), "$.document").isNull(), "ApiIncompatible").when(text.isNull() | inner.isNull(), "ArtifactsUnavailable")
        .when(F.try_parse_json(inner).isNull() | ~F.startswith(F.ltrim(inner), F.lit("{")), "OutputInvalid")
    )
    return read.select("document_id", error.alias("error"), F.when(error.isNull(), inner).alias("document"))


def blocks(documents: DataFrame) -> DataFrame:
    """document_id, nth, reference, kind, level, page, text of ``documents`` (document_id, document: JSON).

    The body's children in reading order, groups in the place of their members, items before their own children; a reference
    counts where it comes first.  Levels of the tree are joined one after another.  A document whose body names nothing gives its
    texts, then its tables.
    """
    read = documents.select("document_id", F.from_json("document", DOCUMENT).alias("d"))
    ref = lambda prefix, x, i: F.coalesce(F.nullif(x["self_ref"], F.lit("")), F.concat(F.lit(prefix), i.cast("string")))
    children = lambda x: F.transform(x["children"], lambda c: c["$ref"])

    def items(field: str, prefix: str, kind, level, text):
        each = read.select("document_id", F.posexplode(f"d.{field}").alias("i", "x")).where("x IS NOT NULL")
        x = F.col("x")
        page = F.get(x["prov"], F.lit(0))["page_no"] if field != "groups" else F.lit(None).cast("int")
        return each.select("document_id", F.lit(field).alias("field"), "i", ref(prefix, x, F.col("i")).alias("reference"), kind(x).alias("kind"), level(x).alias("level"), page.alias("page"), text(x).alias("text"), children(x).alias("children"))

    none = lambda kind: lambda x: F.lit(None).cast(kind)
    heading = lambda x: F.lower(x["label"]).isin(*HEADINGS)
    level_of = lambda x: F.when(heading(x), F.coalesce(x["level"], F.when(F.lower(x["label"]) == "title", 1).otherwise(2)))
    texts = items("texts", "#/texts/", lambda x: F.when(heading(x), "Heading").when(F.lower(x["label"]) == "table", "Table").otherwise("Text"), level_of, lambda x: x["text"])
    tables = items("tables", "#/tables/", lambda x: F.lit("Table"), none("int"), none("string"))
    every = written(texts.unionByName(tables).unionByName(items("groups", "#/groups/", none("string"), none("int"), none("string"))))
    nodes = every.select("document_id", "reference", "children")

    top = read.select("document_id", F.posexplode(F.transform("d.body.children", lambda c: c["$ref"])).alias("i", "reference"))
    level = written(top.where("reference <> ''").select("document_id", "reference", F.array("i").alias("place"), F.array("reference").alias("above")))
    found = level
    while not level.isEmpty():  # once for each level of the deepest document
        down = level.join(nodes, ["document_id", "reference"]).select("document_id", "place", "above", F.posexplode("children").alias("i", "child"))
        down = down.where("child <> '' AND NOT array_contains(above, child)")
        level = written(down.select("document_id", F.col("child").alias("reference"), F.array_append("place", F.col("i")).alias("place"), F.array_append("above", F.col("child")).alias("above")))
        found = found.unionByName(level)
    first = found.groupBy("document_id", "reference").agg(F.min("place").alias("place"))
    shown = every.where("field <> 'groups'")
    ordered = first.join(shown, ["document_id", "reference"])
    bare = shown.join(ordered.select("document_id").distinct(), "document_id", "left_anti").withColumn("place", F.array(F.when(F.col("field") == "texts", 0).otherwise(1), "i"))
    nth = F.row_number().over(Window.partitionBy("document_id").orderBy("place")) - 1
    return ordered.select(*bare.columns).unionByName(bare).select("document_id", nth.alias("nth"), "reference", "kind", "level", "page", "text")


def cells(documents: DataFrame) -> DataFrame:
    """table_id, row, col, text: cells of the documents' tables; a table is its document and reference."""
    read = documents.select("document_id", F.from_json("document", DOCUMENT).alias("d")).select("document_id", F.posexplode("d.tables").alias("i", "t"))
    name = F.concat_ws(" ", F.col("document_id").cast("string"), F.coalesce(F.nullif("t.self_ref", F.lit("")), F.concat(F.lit("#/tables/"), F.col("i").cast("string"))))
    return read.select(name.alias("table_id"), F.explode("t.data.table_cells").alias("c")).select("table_id", F.col("c.start_row_offset_idx").alias("row"), F.col("c.start_col_offset_idx").alias("col"), "c.text")
