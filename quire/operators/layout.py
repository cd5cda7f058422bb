"""Page layout estimated from block sizes, and its risks (P-22, A-13 to A-15, W-3, W-4, W-9, W-10, W-14 to W-16, W-18, W-19, R-15)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators.structure import HEADINGS, order


# Fixed values of the estimate: a character's width in ems, inches around figures, other drawings, headings and other text, and an empty line's height.
CHARACTER, FIGURE, DRAWING, HEADING, TEXT, EMPTY = 0.92, 0.28, 0.12, 0.18, 0.04, 0.18


def chars_per_line(width: Column, size_pt: Column) -> Column:
    em = F.greatest(size_pt, F.lit(9.0)) / 72
    return F.greatest(F.lit(8), F.floor(F.coalesce(width, F.lit(6.5)) / (em * CHARACTER)).cast("int"))


def block_height(kind: Column, text_len: Column, has_drawing: Column, drawing_height: Column, width: Column, size_pt: Column, spacing: Column) -> Column:
    """Estimated height in inches of a paragraph or drawing."""
    size, spacing = F.coalesce(size_pt, F.lit(12.0)), F.coalesce(spacing, F.lit(1.5))
    per = chars_per_line(width, size)
    lines = F.greatest(F.lit(1), F.floor((text_len + per - 1) / per))
    heading = kind.isin(*HEADINGS)
    text = F.round(size / 72 * spacing * F.when(heading, F.least(lines, F.lit(3))).otherwise(lines) + F.when(heading, HEADING).otherwise(TEXT), 4)
    drawn = drawing_height + F.when(kind == "figure", FIGURE).otherwise(DRAWING)
    return F.when(drawing_height > 0, drawn).when((text_len == 0) & ~F.coalesce(has_drawing, F.lit(False)), EMPTY * spacing).otherwise(text)


def row_heights(cells: DataFrame) -> DataFrame:
    """(table_id, row_idx, height): the tallest cell, at least the row's least height and 0.08. cells: height, min_height_in, flags."""
    return cells.groupBy("table_id", "row_idx").agg(
        F.greatest(F.max("height"), F.coalesce(F.max("min_height_in").cast("double"), F.lit(0.0)), F.lit(0.08)).alias("height"), F.bool_or("is_header").alias("is_header"), F.bool_or("cant_split").alias("cant_split")
    )


def header_prefix(rows: DataFrame) -> DataFrame:
    """Adds in_header (all rows so far are header rows) and repeat_header: the height of the header rows above a body row."""
    upto = W.partitionBy("table_id").orderBy("row_idx").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("in_header", F.every("is_header").over(upto))
    return rows.withColumn("repeat_header", F.when(F.col("is_header"), 0.0).otherwise(F.coalesce(F.sum(F.when(F.col("in_header"), F.col("height"))).over(upto), F.lit(0.0))))


def grid_offsets(cells: DataFrame) -> DataFrame:
    """First grid column of each cell: the sum of the spans before it in its row."""
    before = W.partitionBy("table_id", "row_idx").orderBy("cell_idx").rowsBetween(W.unboundedPreceding, -1)
    return cells.withColumn("grid_at", F.coalesce(F.sum("grid_span").over(before), F.lit(0)).cast("long"))


def table_flow(rows: DataFrame) -> DataFrame:
    """Table rows as items of a flow, numbered in order within their table."""
    return rows.withColumn("ord", F.row_number().over(W.partitionBy("table_id").orderBy("row_idx")))


PACKED = "page int, y double, remaining double, split boolean, end_page int"


def pack_ordered(flow: DataFrame, key: str = "doc_id") -> DataFrame:
    """Packs the items of each document onto pages, in order: (key, ord, page, y, height, remaining, split, end_page).

    flow: (key, ord, section, capacity, height, keep_next, page_break, is_row,
    cant_split, header). The items stream by in order, with page, section and used
    height as the only state, so a document may be of any length.
    """
    order = W.partitionBy(key).orderBy("ord")
    items = flow.withColumn("_next", F.coalesce(F.lead("height").over(order), F.lit(0.0))).withColumn("_first", F.row_number().over(order) == 1)
    fields = ["ord", "section", "capacity", "height", "keep_next", "page_break", "is_row", "cant_split", "header", "_next", "_first"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, at, y = 1, 0, 0.0
        for batch in batches:
            out = []
            for _, section, capacity, height, keep, turn, is_row, whole, header, after, first in zip(*(batch.column(f).to_pylist() for f in fields), strict=True):
                if first:
                    page, at, y = 1, 0, 0.0
                if section != at or (turn and y > 0):  # a new section or a forced break first, then what doesn't fit
                    page, at, y = page + 1, section, 0.0
                if y > 0 and y + height + (after if keep else 0.0) > capacity + 0.02 and (whole or not is_row):
                    page, y = page + 1, header if is_row and header < capacity else 0.0
                split = is_row and not whole and y + height > capacity + 0.02
                placed = (page, round(y, 4), round(capacity - y, 4), split)
                if split:  # a row that may split runs on over as many pages as it needs
                    top, over = header if header < capacity - 0.02 else 0.0, height - max(capacity - y, 0.0)
                    pages = max(1, math.ceil((over - 0.02) / (capacity - top)))
                    page, y = page + pages, top + over - (pages - 1) * (capacity - top)
                else:
                    y += height
                out.append((*placed, page))
            kinds = (pa.int32(), pa.float64(), pa.float64(), pa.bool_(), pa.int32())
            columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True) if out else ((),) * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("ord"), batch.column("height"), *columns], [key, "ord", "height", "page", "y", "remaining", "split", "end_page"])

    kind = flow.schema[key].dataType.simpleString()
    rows = items.select(key, F.col("ord").cast("long").alias("ord"), F.col("section").cast("long").alias("section"), *fields[2:]).sortWithinPartitions(key, "ord")
    return rows.mapInArrow(pack, f"{key} {kind}, ord long, height double, {PACKED}")


def page_rollup(placed: DataFrame, key: str = "doc_id", capacity: float = 9.0) -> DataFrame:
    """Blocks, used and remaining height of each page, whether it is nearly empty (but for the first), and the document's pages."""
    pages = placed.groupBy(key, "page").agg(F.count("*").alias("blocks"), F.max(F.col("y") + F.col("height")).alias("used"), F.max("end_page").alias("end"))
    pages = pages.withColumns({"remaining": F.greatest(F.lit(capacity) - F.col("used"), F.lit(0.0)), "near_empty": (F.col("used") < 0.4) & (F.col("page") > 1)})
    return pages.withColumn("page_count", F.max("end").over(W.partitionBy(key))).drop("end")


def page_issues(placed: DataFrame) -> DataFrame:
    """Issues of positions: a heading near a page's end, headings, figures and table captions parted from what follows, chapters amid a page."""
    w = W.partitionBy("doc_id").orderBy("ord")
    rows = placed.withColumns({"_kind": F.lead("kind").over(w), "_page": F.lead("page").over(w), "_height": F.coalesce(F.lead("height").over(w), F.lit(0.7))})
    heading, parted = F.col("kind").isin(*HEADINGS), F.col("_page") != F.col("page")
    pair = lambda a, *b: (F.col("kind") == a) & F.col("_kind").isin(*b) & parted
    found = {
        "orphan_heading": heading & (F.col("remaining") - F.col("height") < F.greatest("_height", F.lit(0.7)) - 0.05),
        "heading_body_split": heading & F.col("_kind").isin("body", "abstract_body") & parted,
        "figure_caption_split": pair("figure", "figure_caption"),
        "table_caption_split": pair("table_caption", "table_cell"),
        "chapter_midpage": (F.col("kind") == "chapter") & (F.col("y") > 1.8) & (F.col("page") > 1),
    }
    issues = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in found.items()]), lambda x: x.isNotNull())
    rows = rows.select("doc_id", "idx", "page", F.explode(issues).alias("type"))
    return rows.withColumn("severity", F.when(F.col("type") == "chapter_midpage", "info").otherwise("warning"))


def neighbour_issues(classified: DataFrame) -> DataFrame:
    """Figures without a caption behind them, captions away from figures, table captions without a table next to them."""
    w = order()
    rows = classified.withColumns({"_next": F.lead("kind").over(w), "_prev": F.lag("kind").over(w), "_next_in": F.lead("in_table").over(w), "_prev_in": F.lag("in_table").over(w)})
    near = F.coalesce(F.col("_next_in") | (F.col("_next") == "table_cell"), F.lit(False)) | F.coalesce(F.col("_prev_in") | (F.col("_prev") == "table_cell"), F.lit(False))
    issue = F.when((F.col("kind") == "figure") & (F.col("_next") != "figure_caption"), "missing_figure_caption")
    issue = issue.when((F.col("kind") == "figure_caption") & ~F.col("_prev").isin("figure", "figure_caption", "body", "empty"), "caption_detached").when((F.col("kind") == "table_caption") & ~near, "caption_detached")
    return rows.select("doc_id", "idx", issue.alias("type")).where("type IS NOT NULL")


def blank_runs(classified: DataFrame, n: int = 8) -> DataFrame:
    """An issue for each full n empty blocks in a row, at the first of them."""
    w = order()
    rows = classified.withColumn("_row", F.row_number().over(w)).where("kind = 'empty'")
    runs = rows.withColumn("_run", F.col("_row") - F.row_number().over(w)).groupBy("doc_id", "_run").agg(F.sort_array(F.collect_list("idx")).alias("at"))
    return runs.where(F.size("at") >= n).select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.size("at") / n).cast("int") - 1)).alias("k"), "at").select("doc_id", F.col("at")[F.col("k") * n].alias("idx"))


def overflow_issues(blocks: DataFrame, container: Column) -> DataFrame:
    """Drawings wider than their container, with their running number in the document."""
    drawn = blocks.where("drawing_width_in > 0").withColumn("drawing_idx", F.row_number().over(order()) - 1)
    return drawn.where(F.col("drawing_width_in") > container + 0.05).select("doc_id", "idx", "drawing_idx", "drawing_width_in")


def heading_risks(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("kind").isin(*HEADINGS) & ~F.coalesce("keep_next", F.lit(False))).select("doc_id", "idx", F.lit("orphan_heading_risk").alias("type"))


def small_outliers(items: DataFrame, group: str, size: str) -> DataFrame:
    """Items smaller than 2048 and 8 % of their group's upper median, of groups of two or more."""
    rows = items.withColumns({"_r": F.row_number().over(W.partitionBy(group).orderBy(size)), "_n": F.count("*").over(W.partitionBy(group))})
    median = F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, F.col(size))).over(W.partitionBy(group))
    rows = rows.withColumn("_m", median)
    return rows.where((F.col("_n") >= 2) & (F.col("_m") > 0) & (F.col(size) < F.greatest(F.lit(2048.0), F.col("_m") * 0.08))).drop("_r", "_n", "_m")


def apply_layout_repairs(blocks: DataFrame, issues: DataFrame, max_width: Column) -> DataFrame:
    """Sets keep-next where an issue asks for it, and scales drawings that overflow to the container."""
    asked = issues.groupBy("doc_id", "idx").agg(F.bool_or(F.col("type") != "image_overflow").alias("_keep"), F.bool_or(F.col("type") == "image_overflow").alias("_scale"))
    rows = blocks.join(asked.withColumnsRenamed({"doc_id": "_d", "idx": "_i"}), (F.col("doc_id") == F.col("_d")) & (F.col("idx") == F.col("_i")), "left")
    width = F.when(F.col("_scale") & (F.col("drawing_width_in") > max_width), max_width).otherwise(F.col("drawing_width_in"))
    return rows.withColumns({"keep_next": F.when(F.col("_keep"), True).otherwise(F.col("keep_next")), "drawing_width_in": width}).drop("_d", "_i", "_keep", "_scale")
