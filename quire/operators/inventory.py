"""Section reports and inventories of paragraphs, fields and contents (J-21, A-1 to A-3, A-21)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.units import field_kind

SIDES = ("top", "right", "bottom", "left", "header", "footer", "gutter")
# What an inventory of contents counts.
CONTENTS = ("tables", "images", "drawings", "text_boxes", "content_controls", "insertions", "deletions", "bookmarks", "numbering_formats", "headers", "footers")


def section_report(sections: DataFrame, refs: DataFrame, rels: DataFrame) -> DataFrame:
    """A row per section: its columns, and its header and footer references, each with the part that it resolves to.

    refs: doc_id, section_idx, kind (header or footer), ref_type, rel_id; rels: doc_id,
    rel_id, rel_type, target. Adds ``headers`` and ``footers``: arrays of (type, rel_id,
    target, rel_type) in the order of types; a reference without a relationship has
    null target. ``resolved`` tells whether each finds one part of its own kind.
    """
    to = rels.select(F.col("doc_id").alias("_d"), F.col("rel_id").alias("_r"), "target", "rel_type")
    rows = refs.join(to, (F.col("doc_id") == F.col("_d")) & (F.col("rel_id") == F.col("_r")), "left")
    ref = F.struct(F.coalesce("ref_type", F.lit("default")).alias("type"), "rel_id", "target", F.substring_index("rel_type", "/", -1).alias("rel_type"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, ref)))
    fits = F.coalesce(F.substring_index("rel_type", "/", -1) == F.col("kind"), F.lit(False))
    per = rows.groupBy(F.col("doc_id").alias("_d"), F.col("section_idx").alias("_i")).agg(of("header").alias("headers"), of("footer").alias("footers"), F.bool_and(fits).alias("resolved"))
    out = sections.join(per, (F.col("doc_id") == F.col("_d")) & (F.col("section_idx") == F.col("_i")), "left").drop("_d", "_i")
    empty = F.expr("CAST(array() AS array<struct<type:string,rel_id:string,target:string,rel_type:string>>)")
    return out.withColumns({"headers": F.coalesce("headers", empty), "footers": F.coalesce("footers", empty), "resolved": F.coalesce("resolved", F.lit(True))})


def paragraph_inventory(blocks: DataFrame, runs: DataFrame, direct: Column, formatted: Column) -> DataFrame:
    """(doc_id, paragraphs, direct_paragraphs, runs, formatted_runs): also documents that have only the one or the other."""
    of_blocks = blocks.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.count_if(direct).alias("direct_paragraphs"))
    of_runs = runs.groupBy("doc_id").agg(F.count("*").alias("runs"), F.count_if(formatted).alias("formatted_runs"))
    return of_blocks.join(of_runs, "doc_id", "full").na.fill(0, ["paragraphs", "direct_paragraphs", "runs", "formatted_runs"])


def field_inventory(fields: DataFrame) -> DataFrame:
    """(doc_id, kind, n, starts, instructions): how often each kind of field occurs, how many of them by a begin marker, and its instructions in order.

    fields: doc_id, ord, instruction, begins (whether a begin marker opens it; simple fields have none).
    """
    kind = F.coalesce(field_kind(F.col("instruction")), F.lit("UNKNOWN")).alias("kind")
    text = F.trim(F.regexp_replace("instruction", r"\s+", " "))
    lists = F.transform(F.array_sort(F.collect_list(F.struct("ord", text.alias("t")))), lambda x: x["t"])
    return fields.groupBy("doc_id", kind).agg(F.count("*").alias("n"), F.count_if("begins").alias("starts"), lists.alias("instructions"))


def content_inventory(objects: DataFrame, parts: DataFrame) -> DataFrame:
    """One row per document with a counter for each of CONTENTS. objects: doc_id, kind, name; parts: doc_id, part_name."""
    name = F.col("part_name")
    of_parts = parts.select("doc_id", F.when(name.startswith("word/media/"), "images").when(name.rlike(r"^word/header\d+\.xml$"), "headers").when(name.rlike(r"^word/footer\d+\.xml$"), "footers").alias("kind"), name.alias("name")).where("kind IS NOT NULL").distinct()
    rows = objects.select("doc_id", "kind", "name").unionByName(of_parts)
    counters = [(F.countDistinct(F.when(F.col("kind") == k, F.col("name"))) if k == "numbering_formats" else F.count_if(F.col("kind") == k)).alias(k) for k in CONTENTS]
    docs = reduce(DataFrame.unionByName, [objects.select("doc_id"), parts.select("doc_id")]).distinct()
    return docs.join(rows.groupBy("doc_id").agg(*counters), "doc_id", "left").na.fill(0, list(CONTENTS))


def marginal_flags(parts: DataFrame) -> DataFrame:
    """(doc_id, part_name, has_objects, unsupported): header and footer parts with visible content beyond text, and the layouts that can't be judged.

    parts: doc_id, part_name, element: a row for each element below the part's root and its paragraphs.
    """
    e = F.col("element")
    objects, layout = e.isin("drawing", "pict", "object", "sdt"), e.isin("tbl", "txbxContent", "AlternateContent", "ins", "del")
    return parts.groupBy("doc_id", "part_name").agg(F.bool_or(objects).alias("has_objects"), F.array_sort(F.collect_set(F.when(layout, e))).alias("unsupported"))
