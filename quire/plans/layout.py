"""Queries of the page layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import layout as L
from quire.operators import structure as S
from quire.plans.registry import query
from quire.plans.structure import CLASSIFIED, classified
from quire.sources.views import view

HEIGHT = """CASE WHEN drawing_width_in > 0 THEN drawing_width_in / 2 + CASE WHEN kind = 'figure' THEN 0.28 ELSE 0.12 END WHEN length(trim(text)) = 0 AND NOT has_drawing THEN 0.18 * 1.5
 WHEN kind IN ('chapter', 'section', 'subsection') THEN round(12::DOUBLE / 72 * 1.5 * least(3, greatest(1, (length(trim(text)) + 41) // 42)) + 0.18, 4) ELSE round(12::DOUBLE / 72 * 1.5 * greatest(1, (length(trim(text)) + 41) // 42) + 0.04, 4) END"""
TALL = f"tall AS (SELECT *, ({HEIGHT})::DOUBLE AS height FROM classified)"


def tall(spark, sf_dir):
    """Classified blocks with their heights at 12 pt on lines of 6.5 inches; a drawing is half as high as wide."""
    c = F.col
    height = L.block_height(c("kind"), F.length(F.trim("text")), c("has_drawing"), c("drawing_width_in") / 2, F.lit(6.5), F.lit(12.0), F.lit(1.5))
    return classified(spark, sf_dir).withColumn("height", height)


@query("v_blocks", "SELECT doc_id, idx, height FROM tall", f"{CLASSIFIED}, {TALL}")
def p22_block_height(spark, sf_dir):
    return tall(spark, sf_dir).select("doc_id", "idx", "height")


ROWS = "trows AS (SELECT table_id, row_idx, greatest(max(text_len * 0.01), coalesce(max(min_height_in), 0), 0.08)::DOUBLE AS height, bool_or(is_header) AS is_header, bool_or(cant_split) AS cant_split FROM v_cells GROUP BY 1, 2)"


def table_rows(spark, sf_dir):
    return L.row_heights(view(spark, sf_dir, "v_cells").withColumn("height", F.col("text_len") * F.lit(0.01)))


@query("v_cells", "SELECT table_id, row_idx, height, is_header, cant_split FROM trows", ROWS)
def a13_row_heights(spark, sf_dir):
    return table_rows(spark, sf_dir)


PREFIX = "pre AS (SELECT *, bool_and(is_header) OVER (PARTITION BY table_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS in_header FROM trows)"


@query("v_cells", "SELECT table_id, row_idx, in_header, CASE WHEN is_header THEN 0.0 ELSE coalesce(sum(CASE WHEN in_header THEN height END) OVER (PARTITION BY table_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING), 0) END::DOUBLE AS repeat_header FROM pre", f"{ROWS}, {PREFIX}")
def w09_header_prefix(spark, sf_dir):
    return L.header_prefix(table_rows(spark, sf_dir)).select("table_id", "row_idx", "in_header", "repeat_header")


@query("v_cells", "SELECT table_id, row_idx, cell_idx, CAST(coalesce(sum(grid_span) OVER (PARTITION BY table_id, row_idx ORDER BY cell_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS grid_at FROM v_cells")
def w10_grid_offsets(spark, sf_dir):
    return L.grid_offsets(view(spark, sf_dir, "v_cells")).select("table_id", "row_idx", "cell_idx", "grid_at")


@query("v_cells", "SELECT table_id, row_idx, row_number() OVER (PARTITION BY table_id ORDER BY row_idx) AS ord FROM trows", ROWS)
def w14_table_flow(spark, sf_dir):
    return L.table_flow(table_rows(spark, sf_dir)).select("table_id", "row_idx", "ord")


def placed(spark, sf_dir):
    """Blocks on pages of 9 inches; a section break starts a page."""
    w = S.order()
    rows = S.assign_sections(tall(spark, sf_dir)).withColumn("ord", F.row_number().over(w).cast("long"))
    flow = rows.select(
        "doc_id", "ord", F.col("section_idx").alias("section"), F.lit(9.0).alias("capacity"), "height", F.coalesce("keep_next", F.lit(False)).alias("keep_next"), F.lit(False).alias("page_break"), F.lit(False).alias("is_row"), F.lit(False).alias("cant_split"), F.lit(0.0).alias("header")
    )
    of = L.pack_ordered(flow).withColumnsRenamed({"doc_id": "_d", "ord": "_o", "height": "_h"})
    return rows.join(of, (F.col("doc_id") == F.col("_d")) & (F.col("ord") == F.col("_o"))).drop("_d", "_o", "_h")


PACKED = """flow AS (SELECT doc_id, idx, kind, height, row_number() OVER w AS ord, coalesce(keep_next, false) AS keep_next, coalesce(lead(height) OVER w, 0) AS nxt,
 coalesce(sum(CAST(coalesce(section_break, false) AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS section FROM tall WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
placed AS (SELECT * FROM (WITH RECURSIVE r(doc_id, ord, page, section, y, height) AS (SELECT doc_id, ord, 1, section, 0.0::DOUBLE, height FROM flow WHERE ord = 1
 UNION ALL SELECT f.doc_id, f.ord, r.page + CASE WHEN f.section <> r.section OR (r.y + r.height > 0 AND r.y + r.height + f.height + CASE WHEN f.keep_next THEN f.nxt ELSE 0 END > 9.02) THEN 1 ELSE 0 END, f.section,
  CASE WHEN f.section <> r.section OR r.y + r.height + f.height + CASE WHEN f.keep_next THEN f.nxt ELSE 0 END > 9.02 THEN 0.0 ELSE r.y + r.height END, f.height FROM r JOIN flow f ON f.doc_id = r.doc_id AND f.ord = r.ord + 1) SELECT * FROM r))"""


@query("v_blocks", "SELECT doc_id, ord, page, round(y, 4) AS y FROM placed", f"{CLASSIFIED}, {TALL}, {PACKED}")
def w15_pack_ordered(spark, sf_dir):
    return placed(spark, sf_dir).select("doc_id", "ord", "page", "y")


@query("v_blocks", """SELECT doc_id, page, blocks, round(used, 3) AS used, round(greatest(9 - used, 0), 3) AS remaining, used < 0.4 AND page > 1 AS near_empty, max(page) OVER (PARTITION BY doc_id) AS page_count
 FROM (SELECT doc_id, page, count(*) AS blocks, max(round(y, 4) + height) AS used FROM placed GROUP BY 1, 2)""", f"{CLASSIFIED}, {TALL}, {PACKED}")
def a14_page_rollup(spark, sf_dir):
    return L.page_rollup(placed(spark, sf_dir)).withColumns({"used": F.round("used", 3), "remaining": F.round("remaining", 3)})


@query("v_blocks", """SELECT doc_id, idx, page, type, CASE type WHEN 'chapter_midpage' THEN 'info' ELSE 'warning' END AS severity FROM (SELECT p.doc_id, p.page, round(p.y, 4) AS y, round(9 - p.y, 4) AS remaining, p.height, f.idx, f.kind, lead(f.kind) OVER w AS nk, lead(p.page) OVER w AS np, coalesce(lead(p.height) OVER w, 0.7) AS nh
  FROM placed p JOIN flow f ON f.doc_id = p.doc_id AND f.ord = p.ord WINDOW w AS (PARTITION BY p.doc_id ORDER BY p.ord)) q, LATERAL (
 SELECT 'orphan_heading' AS type WHERE kind IN ('chapter', 'section', 'subsection') AND remaining - height < greatest(nh, 0.7) - 0.05 UNION ALL SELECT 'heading_body_split' WHERE kind IN ('chapter', 'section', 'subsection') AND nk IN ('body', 'abstract_body') AND np <> page
 UNION ALL SELECT 'figure_caption_split' WHERE kind = 'figure' AND nk = 'figure_caption' AND np <> page UNION ALL SELECT 'table_caption_split' WHERE kind = 'table_caption' AND nk = 'table_cell' AND np <> page UNION ALL SELECT 'chapter_midpage' WHERE kind = 'chapter' AND y > 1.8 AND page > 1) t""", f"{CLASSIFIED}, {TALL}, {PACKED}")
def w16_page_issues(spark, sf_dir):
    return L.page_issues(placed(spark, sf_dir))


@query("v_blocks", """SELECT doc_id, idx, type FROM (SELECT doc_id, idx, CASE WHEN kind = 'figure' AND nk <> 'figure_caption' THEN 'missing_figure_caption' WHEN kind = 'figure_caption' AND pk NOT IN ('figure', 'figure_caption', 'body', 'empty') THEN 'caption_detached'
 WHEN kind = 'table_caption' AND NOT (coalesce(ni OR nk = 'table_cell', false) OR coalesce(pi_ OR pk = 'table_cell', false)) THEN 'caption_detached' END AS type FROM (SELECT *, lead(kind) OVER w AS nk, lag(kind) OVER w AS pk, lead(in_table) OVER w AS ni, lag(in_table) OVER w AS pi_ FROM classified WINDOW w AS (PARTITION BY doc_id ORDER BY idx))) WHERE type IS NOT NULL""", CLASSIFIED)
def w03_neighbour_issues(spark, sf_dir):
    return L.neighbour_issues(classified(spark, sf_dir))


@query("v_blocks", """SELECT doc_id, ix[k * 2 + 1] AS idx FROM (SELECT doc_id, ix, unnest(range(0, len(ix) // 2)) AS k FROM (SELECT doc_id, list(idx ORDER BY idx) AS ix FROM (SELECT doc_id, idx, rn - row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS rn FROM
 (SELECT doc_id, idx, CASE WHEN idx % 5 < 4 AND kind <> 'chapter' THEN 'empty' ELSE kind END AS kind FROM classified)) WHERE kind = 'empty') GROUP BY doc_id, run))""", CLASSIFIED)
def w04_blank_runs(spark, sf_dir):
    """Runs of two, as the fixture has no long ones; most blocks count as empty here."""
    rows = classified(spark, sf_dir).withColumn("kind", F.when((F.col("idx") % 5 < 4) & (F.col("kind") != "chapter"), "empty").otherwise(F.col("kind")))
    return L.blank_runs(rows, 2)


@query("v_blocks", """SELECT doc_id, ix[k * 8 + 1] AS idx FROM (SELECT doc_id, ix, unnest(range(0, len(ix) // 8)) AS k FROM (SELECT doc_id, list(idx ORDER BY idx) AS ix FROM (SELECT doc_id, idx, idx - row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM v_blocks WHERE (doc_id + idx) % 19 < 17) GROUP BY doc_id, run))""")
def w04_blank_runs_of_eight(spark, sf_dir):
    """Runs of eight and more, where all but two of nineteen blocks count as empty."""
    rows = view(spark, sf_dir, "v_blocks").withColumn("kind", F.when((F.col("doc_id") + F.col("idx")) % 19 < 17, "empty").otherwise("body"))
    return L.blank_runs(rows)


@query("v_blocks", "SELECT doc_id, idx, drawing_idx, drawing_width_in FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS drawing_idx FROM v_blocks WHERE drawing_width_in > 0) WHERE drawing_width_in > 6.05")
def w18_overflow_issues(spark, sf_dir):
    return L.overflow_issues(view(spark, sf_dir, "v_blocks"), F.lit(6.0))


@query("v_blocks", "SELECT doc_id, idx, 'orphan_heading_risk' AS type FROM classified WHERE kind IN ('chapter', 'section', 'subsection') AND NOT coalesce(keep_next, false)", CLASSIFIED)
def w19_heading_risks(spark, sf_dir):
    return L.heading_risks(classified(spark, sf_dir))


@query("v_parts", """SELECT doc_id, part_name, size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size, part_name) AS r, count(*) OVER (PARTITION BY doc_id) AS n, list_sort(list(size) OVER (PARTITION BY doc_id)) AS s FROM v_parts) WHERE n >= 2 AND size < greatest(2048, s[n // 2 + 1] * 0.08)""")
def a15_small_outliers(spark, sf_dir):
    return L.small_outliers(view(spark, sf_dir, "v_parts"), "doc_id", "size").select("doc_id", "part_name", "size")


@query("v_blocks v_issues", """SELECT b.doc_id, b.idx, CASE WHEN i.keep THEN true ELSE b.keep_next END AS keep_next, CASE WHEN i.scale AND drawing_width_in > 6 THEN 6.0 ELSE drawing_width_in END::DOUBLE AS drawing_width_in FROM v_blocks b
 LEFT JOIN (SELECT doc_id, idx, bool_or(type <> 'image_overflow') AS keep, bool_or(type = 'image_overflow') AS scale FROM v_issues GROUP BY 1, 2) i ON i.doc_id = b.doc_id AND i.idx = b.idx""")
def r15_layout_repairs(spark, sf_dir):
    return L.apply_layout_repairs(view(spark, sf_dir, "v_blocks"), view(spark, sf_dir, "v_issues"), F.lit(6.0)).select("doc_id", "idx", "keep_next", "drawing_width_in")
