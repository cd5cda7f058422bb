"""Structure of documents: sections, regions, kinds, outline, inventories (W-1 to W-6, A-1, A-4, A-5, J-1, O-1).

Every window is over one document in the order of its blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T

HEADINGS = ("chapter", "section", "subsection")
REGION_FLAGS = ("cover", "abstract_zh", "abstract_en", "references", "appendix", "declaration", "acknowledgement", "list_of_figures", "list_of_tables")


def order():
    return W.partitionBy("doc_id").orderBy("idx")


ROWS = 1 << 19  # blocks that one task sorts


def dealt(blocks: DataFrame, n: int) -> DataFrame:
    """Blocks dealt by document over partitions whose number grows with theirs (n), so that windows and groups over documents find their rows in place and sort no more of them on larger inputs."""
    return blocks.repartition(max(blocks.sparkSession.sparkContext.defaultParallelism, math.ceil(n / ROWS)), "doc_id")


def assign_sections(blocks: DataFrame) -> DataFrame:
    """section_idx: the number of section breaks before the block (a block with a break still belongs to its section)."""
    before = order().rowsBetween(W.unboundedPreceding, -1)
    return blocks.withColumn("section_idx", F.coalesce(F.sum(F.coalesce("section_break", F.lit(False)).cast("int")).over(before), F.lit(0)))


def enrich(blocks: DataFrame, styles: DataFrame) -> DataFrame:
    """Style name and outline level of each block, and keep-next of the block or else of its style."""
    names = styles.select(F.col("doc_id").alias("_d"), F.col("style_id").alias("_s"), "style_name", "outline_level", F.col("keep_next").alias("_k"))
    joined = blocks.join(names, (F.col("doc_id") == F.col("_d")) & (F.col("style_id") == F.col("_s")), "left")
    return joined.withColumn("keep_next", F.coalesce("keep_next", "_k")).drop("_d", "_s", "_k")


def classify(blocks: DataFrame, size: int | None = None) -> DataFrame:
    """Adds kind and region to each block. size, if known: how many blocks there are, which are dealt then (see ``dealt``).

    A region lasts until the next anchor: a table-of-contents style, a region title
    or a chapter. Text-box rows are no anchors while the region is ``cover``, so
    anchors of other rows are carried forward first, and those of text boxes second.
    """
    have = set(blocks.columns)
    rows = blocks
    for name, kind in (("style_name", "string"), ("outline_level", "int")):
        if name not in have:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    text, box = T.collapsed(F.col("text")), F.coalesce("in_text_box", F.lit(False))
    level = T.heading_level(F.col("style_id"), F.col("style_name"), F.col("outline_level"))
    rows = rows.withColumns({"_text": text, "_level": level, "_title": T.region_title(text), "_toc": T.is_toc(F.col("style_id"), F.col("style_name")), "_box": box})
    t, n, short = F.col("_text"), F.col("_level"), F.length("_text") < 80
    shape = T.shape_flags(t)
    titled = F.col("_title").isNotNull() & (n.isNull() | n.isin(1, 2) | (F.length(t) <= 20))
    placed = F.when(shape["is_figure"], "figure_caption").when(shape["is_table"], "table_caption").when(shape["is_equation"], "equation")
    placed = placed.when(F.coalesce("has_drawing", F.lit(False)) & (t == ""), "figure").when(F.coalesce("in_table", F.lit(False)), "table_cell")
    heading = F.when(n.eqNullSafe(1) | (shape["is_chapter"] & (n.isNull() | (n == 1)) & short), "chapter")
    heading = heading.when(n.eqNullSafe(2) | (shape["is_section"] & short), "section").when(n.eqNullSafe(3) | (shape["is_subsection"] & short), "subsection").when(t == "", "empty")
    rows = rows.withColumn("_fixed", F.when(titled, F.col("_title")).otherwise(F.coalesce(placed, heading)))
    anchor = F.when(F.col("_toc"), "toc").when(titled, F.col("_title")).when(F.col("_fixed") == "chapter", "chapter")
    rows = rows.withColumn("_anchor", anchor)
    rows = rows if size is None else dealt(rows, size)
    w = order()
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    plain = F.when(~F.col("_box") | F.col("_toc"), F.col("_anchor"))
    on_cover = F.col("_box") & ~F.col("_toc") & (F.coalesce(F.last(plain, ignorenulls=True).over(before), F.lit("cover")) == "cover")
    rows = rows.withColumn("_field", on_cover)
    chapter = (F.col("_fixed") == "chapter") & ~F.col("_toc") & ~F.col("_field")
    rows = rows.withColumns({
        "_region": F.coalesce(F.last(F.when(~F.col("_field"), F.col("_anchor")), ignorenulls=True).over(upto), F.lit("cover")),
        "_seen": F.max(F.coalesce(chapter, F.lit(False)).cast("int")).over(upto) == 1,
    })
    rows = rows.withColumn("region", F.when((F.col("_region") == "cover") & F.col("_seen"), "chapter").otherwise(F.col("_region")))
    prior = F.coalesce(F.lag("region").over(w), F.lit("cover"))
    rest = F.when(prior == "cover", "cover").when(prior.startswith("abstract"), "abstract_body").when(prior == "references", "reference_item").when(prior == "toc", "toc_entry").otherwise("body")
    kind = F.when(F.col("_toc"), "toc_entry").when(F.col("_field"), "cover_field").otherwise(F.coalesce("_fixed", rest))
    return rows.withColumn("kind", kind).drop("_text", "_level", "_title", "_toc", "_box", "_fixed", "_anchor", "_field", "_region", "_seen")


def chapter_numbers(classified: DataFrame) -> DataFrame:
    upto = order().rowsBetween(W.unboundedPreceding, 0)
    number = F.sum((F.col("kind") == "chapter").cast("int")).over(upto)
    return classified.withColumn("chapter_no", F.when(F.col("kind") == "chapter", number))


def outline(classified: DataFrame) -> DataFrame:
    """parent_chapter_idx and parent_section_idx of each block: the nearest chapter and section above, where a new chapter clears the section.

    Region anchors and their kind stay at the root and have no parents.
    """
    before = order().rowsBetween(W.unboundedPreceding, -1)
    at = lambda kind: F.last(F.when(F.col("kind") == kind, F.col("idx")), ignorenulls=True).over(before)
    inner = F.col("kind").isin("section", "subsection", "body", "figure", "figure_caption", "table_caption", "table_cell", "equation", "empty")
    rows = classified.withColumns({"_chapter": at("chapter"), "_section": at("section")})
    section = F.when(inner & (F.col("kind") != "section") & (F.col("_chapter").isNull() | (F.col("_section") > F.col("_chapter"))), F.col("_section"))
    return rows.withColumns({"parent_chapter_idx": F.when(inner, F.col("_chapter")), "parent_section_idx": section}).drop("_chapter", "_section")


def summarize(classified: DataFrame) -> DataFrame:
    """Per document: blocks, chapters, captions, equations and a flag for each region."""
    has = lambda *kinds: F.bool_or(F.col("kind").isin(*kinds))
    n = lambda kind: F.count_if(F.col("kind") == kind)
    flags = [has(kind).alias(f"has_{kind}") for kind in REGION_FLAGS] + [has("toc", "toc_entry").alias("has_toc")]
    return classified.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), n("chapter").alias("chapters"), n("figure_caption").alias("figure_captions"), n("table_caption").alias("table_captions"), n("equation").alias("equations"), *flags)


def kind_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def style_usage(blocks: DataFrame) -> DataFrame:
    """Uses of each style by document, with its rank by frequency; ties keep the order of first use."""
    used = blocks.groupBy("doc_id", F.coalesce("style_id", F.lit("(none)")).alias("style_id")).agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))
    return used.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n"), "first_idx")))


def text_inventory(blocks: DataFrame) -> DataFrame:
    """Text measures of each document, summed over its blocks."""
    sums = {"characters": "characters", "no_whitespace": "charactersNoWhitespace", "cjk": "cjkCharacters", "latin_words": "latinWords"}
    return blocks.groupBy("doc_id").agg(*[F.sum(T.text_metric(F.col("text"), F.lit(mode))).alias(name) for name, mode in sums.items()])
