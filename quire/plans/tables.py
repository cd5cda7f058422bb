"""Queries of three-line tables, nested heights and the flow of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import layout as L
from quire.operators import tables as T
from quire.plans.registry import query
from quire.sources.views import view

RULE = {"header_rows": 1, "outer_pt": 1.5, "header_pt": 0.75, "color": "000000"}
EXTRAS = {"alignment": "center", "width_in": 4.0, "column_widths_in": [1.0, 1.0, 1.0, 1.0], "allow_row_split": True, "paragraph": {"alignment": "justify", "line_spacing": 1.5, "first_line_in": 0}, "run": {"size_pt": 10.5, "color": "#000000"}}

EXPECTED = """sized AS (SELECT *, max(row_idx) OVER (PARTITION BY table_id) + 1 AS n, bool_or(row_idx = 1 AND coalesce(v_merge, '') = 'continue') OVER (PARTITION BY table_id) AS crosses, sum(grid_span) OVER (PARTITION BY table_id, row_idx) AS spans FROM v_tcells),
wanted AS (SELECT *, CASE WHEN n < 2 THEN 'no_body' WHEN crosses THEN 'merge_across_header' END AS unsafe, CASE row_idx WHEN 0 THEN 12 WHEN 1 THEN 6 END AS xt, CASE WHEN row_idx = n - 1 THEN 12 WHEN row_idx = 0 THEN 6 END AS xb FROM sized)"""


@query("v_tcells", """SELECT table_id, problems, problems = '' AS ok FROM (SELECT table_id, coalesce(max(unsafe), concat_ws(',', CASE WHEN bool_or(top_sz IS DISTINCT FROM xt OR bottom_sz IS DISTINCT FROM xb OR left_sz IS NOT NULL OR ((xt IS NOT NULL OR xb IS NOT NULL) AND color <> '000000')) THEN 'borders' END,
 CASE WHEN bool_or(cell_spacing <> 0) THEN 'spacing' END, CASE WHEN bool_or(is_header <> (row_idx = 0)) THEN 'repeat_header' END)) AS problems FROM wanted GROUP BY 1)""", EXPECTED)
def j15_check_three_lines(spark, sf_dir):
    return T.check_table_borders(view(spark, sf_dir, "v_tcells"), RULE)


TWIPS = "wide AS (SELECT *, bool_or(spans <> 4) OVER (PARTITION BY table_id) AS unfit FROM wanted)"


@query("v_tcells", """SELECT table_id, row_idx, cell_idx, CASE WHEN bad IS NULL THEN xt ELSE top_sz END AS top_sz, CASE WHEN bad IS NULL THEN xb ELSE bottom_sz END AS bottom_sz, CASE WHEN bad IS NOT NULL THEN left_sz END AS left_sz, CASE WHEN bad IS NULL THEN '000000' ELSE color END AS color,
 CASE WHEN bad IS NULL THEN 0 ELSE cell_spacing END AS cell_spacing, CASE WHEN bad IS NULL THEN row_idx = 0 ELSE is_header END AS is_header, CASE WHEN bad IS NULL THEN false ELSE cant_split END AS cant_split, CASE WHEN bad IS NULL THEN 1440 * grid_span ELSE width_twips END AS width_twips
 FROM (SELECT *, coalesce(unsafe, CASE WHEN unfit THEN 'grid_mismatch' END) AS bad FROM wide)""", f"{EXPECTED}, {TWIPS}")
def r14_three_lines(spark, sf_dir):
    out, _ = T.apply_tables(view(spark, sf_dir, "v_tcells"), RULE | EXTRAS)
    return out.select("table_id", "row_idx", "cell_idx", "top_sz", "bottom_sz", "left_sz", "color", "cell_spacing", "is_header", "cant_split", "width_twips")


@query("v_tcells", "SELECT DISTINCT table_id, coalesce(unsafe, 'grid_mismatch') AS problem FROM wide WHERE unsafe IS NOT NULL OR unfit", f"{EXPECTED}, {TWIPS}")
def r14_unsafe_tables(spark, sf_dir):
    return T.apply_tables(view(spark, sf_dir, "v_tcells"), RULE | EXTRAS)[1]


@query("v_tcells v_tables", """SELECT DISTINCT table_id, problem FROM (SELECT table_id, 'alignment' AS problem FROM v_tables WHERE alignment <> 'center' UNION ALL SELECT table_id, 'widthIn' FROM v_tables WHERE width_twips <> 5760
 UNION ALL SELECT table_id, 'columnWidthsIn' FROM sized WHERE spans <> 4 OR width_twips <> 1440 * grid_span UNION ALL SELECT table_id, 'row[' || row_idx || '].allowRowSplit' FROM v_tcells WHERE cant_split
 UNION ALL SELECT table_id, 'paragraph[' || p || '].' || key FROM (SELECT *, row_idx * 4 + cell_idx AS p FROM v_tcells), LATERAL (SELECT 'alignment' AS key WHERE alignment <> 'both' UNION ALL SELECT 'line_spacing' WHERE abs(line_spacing - 1.5) > 0.01
  UNION ALL SELECT 'first_line_in' WHERE coalesce(first_line_chars, 0) <> 0 UNION ALL SELECT 'run.size_pt' WHERE abs(size_pt - 10.5) > 0.01 UNION ALL SELECT 'run.color' WHERE upper(color) <> '000000') k)""", EXPECTED)
def j16_check_extras(spark, sf_dir):
    cells = view(spark, sf_dir, "v_tcells")
    paras = cells.select("table_id", (F.col("row_idx") * 4 + F.col("cell_idx")).alias("para_idx"), "alignment", F.col("line_spacing").cast("double").alias("line_spacing"), F.lit(0.0).alias("first_line_in"), F.col("first_line_chars").cast("double").alias("first_line_chars"), F.lit(0.0).alias("hanging_chars"), F.col("size_pt").cast("double").alias("size_pt"), "color")
    return T.check_table_extras(view(spark, sf_dir, "v_tables"), cells, paras, EXTRAS)


@query("v_tcells", """SELECT table_id, row_idx, cell_idx, gat AS grid_at, CAST(coalesce(list_sum([1440, 2160, 720, 1440][gat + 1:gat + grid_span]), 0) AS INTEGER) AS grid_twips, spans = 4 AS fits FROM (SELECT *, CAST(coalesce(sum(grid_span) OVER (PARTITION BY table_id, row_idx ORDER BY cell_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS gat,
 sum(grid_span) OVER (PARTITION BY table_id, row_idx) AS spans FROM v_tcells)""")
def w10_grid_widths(spark, sf_dir):
    return T.grid_widths(view(spark, sf_dir, "v_tcells"), [1.0, 1.5, 0.5, 1.0]).select("table_id", "row_idx", "cell_idx", "grid_at", "grid_twips", "fits")


@query("v_tcells", """SELECT table_id, CASE WHEN ok THEN h END AS header_rows, CASE WHEN ok THEN outer_sz / 8.0 END::DOUBLE AS outer_pt, CASE WHEN ok THEN middle / 8.0 END::DOUBLE AS header_pt, CASE WHEN ok THEN color END AS color, CASE WHEN ok THEN 'confirm' ELSE 'unresolved' END AS status FROM (
 SELECT table_id, any_value(h) AS h, any_value(outer_sz) AS outer_sz, any_value(middle) AS middle, max(upper(color)) AS color, coalesce(any_value(h) > 0 AND any_value(h) < any_value(n) AND any_value(outer_sz) IS NOT NULL AND any_value(middle) IS NOT NULL AND count(DISTINCT CASE WHEN top_sz IS NOT NULL OR bottom_sz IS NOT NULL THEN upper(color) END) = 1
  AND bool_and(left_sz IS NULL AND cell_spacing = 0 AND coalesce(v_merge, '') <> 'continue' AND top_sz IS NOT DISTINCT FROM CASE WHEN row_idx = h THEN middle WHEN row_idx = 0 THEN outer_sz END AND bottom_sz IS NOT DISTINCT FROM CASE WHEN row_idx = n - 1 THEN outer_sz WHEN row_idx = h - 1 THEN middle END), false) AS ok
 FROM (SELECT *, max(CASE WHEN row_idx = 0 THEN top_sz END) OVER (PARTITION BY table_id) AS outer_sz, max(CASE WHEN row_idx = greatest(h, 1) - 1 THEN bottom_sz END) OVER (PARTITION BY table_id) AS middle FROM (SELECT *, max(row_idx) OVER (PARTITION BY table_id) + 1 AS n, max(CASE WHEN is_header THEN row_idx + 1 ELSE 0 END) OVER (PARTITION BY table_id) AS h FROM v_tcells)) GROUP BY 1)""")
def a20_infer_three_lines(spark, sf_dir):
    return T.infer_tables(view(spark, sf_dir, "v_tcells"))


NESTED = "base AS (SELECT table_id, row_idx, cell_idx, text_len * 0.01::DOUBLE AS height, min_height_in FROM v_tcells)"
LEVEL = "{0} AS (SELECT table_id, row_idx, greatest(max(h), coalesce(max(min_height_in), 0), 0.08)::DOUBLE AS height FROM (SELECT b.*, b.height + coalesce(i.s, 0) AS h FROM base b LEFT JOIN ({1}) i ON i.t = b.table_id AND i.r = b.row_idx AND i.c = b.cell_idx) GROUP BY 1, 2)"
INNER = "SELECT parent_id AS t, parent_row AS r, parent_cell AS c, sum(s) AS s FROM v_nested JOIN (SELECT table_id, sum(height) AS s FROM {0} GROUP BY 1) USING (table_id) GROUP BY 1, 2, 3"


@query("v_tcells v_nested", "SELECT table_id, row_idx, round(height, 6) AS height FROM l2", ", ".join([NESTED, LEVEL.format("l0", "SELECT NULL::BIGINT AS t, 0 AS r, 0 AS c, 0 AS s"), LEVEL.format("l1", INNER.format("l0")), LEVEL.format("l2", INNER.format("l1"))]))
def a13_nested_heights(spark, sf_dir):
    cells = view(spark, sf_dir, "v_tcells").withColumn("height", F.col("text_len") * F.lit(0.01))
    return T.nested_heights(cells, view(spark, sf_dir, "v_nested")).withColumn("height", F.round("height", 6))


@query("v_tables", "SELECT table_id, 'table_overflow' AS type, round(width_in, 4) AS width_in, container_in::DOUBLE AS container_in FROM (SELECT *, width_twips * 1.5 / 1440 AS width_in FROM v_tables) WHERE width_in > container_in + 0.08")
def w18_wide_tables(spark, sf_dir):
    rows = view(spark, sf_dir, "v_tables").select("table_id", (F.col("width_twips") * F.lit(1.5) / 1440).alias("width_in"), F.col("container_in").cast("double").alias("container_in"))
    return T.wide_tables(rows).withColumn("width_in", F.round("width_in", 4))


# A document's neighbouring blocks in tables make one table; its rows are made from its first block.
FLOW = """fb AS (SELECT doc_id, idx, CASE WHEN in_table THEN idx // 7 END AS table_idx, (0.2::DOUBLE + length(text) * 0.0037::DOUBLE) AS height, coalesce(keep_next, false) AS keep_next, style_id IS NOT DISTINCT FROM 'Heading1' AND idx % 4 = 0 AS page_break, idx // 60 AS section FROM v_blocks),
fr AS (SELECT doc_id, table_idx, r AS row_idx, (0.3013::DOUBLE + (doc_id + r * 5) % 11 * 0.4007::DOUBLE + CASE WHEN r = 4 THEN 10 ELSE 0 END)::DOUBLE AS height, r = 0 AS is_header, (doc_id + r) % 3 = 0 AS cant_split FROM (SELECT DISTINCT doc_id, table_idx FROM fb WHERE table_idx IS NOT NULL) CROSS JOIN (VALUES (0), (1), (2), (3), (4)) v(r)),
flow AS (SELECT doc_id, idx, row_idx, height, keep_next, page_break, is_row, cant_split, header, idx // 60 AS section, row_number() OVER (PARTITION BY doc_id ORDER BY idx, row_idx) AS ord FROM (SELECT doc_id, idx, 0 AS row_idx, height, keep_next, page_break, false AS is_row, false AS cant_split, 0::DOUBLE AS header FROM fb WHERE table_idx IS NULL
 UNION ALL SELECT f.doc_id, f.idx, row_idx, r.height, false, false, true, cant_split, CASE WHEN is_header THEN 0 ELSE h END FROM (SELECT doc_id, table_idx, min(idx) AS idx FROM fb WHERE table_idx IS NOT NULL GROUP BY 1, 2) f JOIN (SELECT *, first_value(height) OVER (PARTITION BY doc_id, table_idx ORDER BY row_idx) AS h FROM fr) r ON r.doc_id = f.doc_id AND r.table_idx = f.table_idx))"""


def flow(spark, sf_dir):
    blocks = view(spark, sf_dir, "v_blocks")
    of = F.floor(F.col("idx") / 7)
    blocks = blocks.select(
        "doc_id", "idx", F.when(F.col("in_table"), of).alias("table_idx"), (F.lit(0.2) + F.length("text") * F.lit(0.0037)).alias("height"), F.coalesce("keep_next", F.lit(False)).alias("keep_next"), (F.col("style_id").eqNullSafe(F.lit("Heading1")) & (F.col("idx") % 4 == 0)).alias("page_break")
    )
    rows = blocks.where("table_idx IS NOT NULL").select("doc_id", "table_idx").distinct().withColumn("row_idx", F.explode(F.sequence(F.lit(0), F.lit(4))))
    height = F.lit(0.3013) + (F.col("doc_id") + F.col("row_idx") * 5) % 11 * F.lit(0.4007) + F.when(F.col("row_idx") == 4, 10).otherwise(0)
    rows = rows.select("doc_id", "table_idx", "row_idx", height.alias("height"), (F.col("row_idx") == 0).alias("is_header"), ((F.col("doc_id") + F.col("row_idx")) % 3 == 0).alias("cant_split"))
    return T.fold_tables(blocks, rows).withColumns({"section": F.floor(F.col("idx") / 60), "capacity": F.lit(9.0)})


@query("v_blocks", "SELECT doc_id, ord, idx, row_idx, is_row, round(height, 6) AS height, round(header, 6) AS header FROM flow", FLOW)
def w14_fold_tables(spark, sf_dir):
    return flow(spark, sf_dir).select("doc_id", "ord", "idx", "row_idx", "is_row", F.round("height", 6).alias("height"), F.round("header", 6).alias("header"))


# One recursive step places an item: p and t are the page and the height at which it begins, o what is over, g the room below a repeated header.
STEP = """placed AS (SELECT * FROM (WITH RECURSIVE items AS (SELECT *, coalesce(lead(height) OVER (PARTITION BY doc_id ORDER BY ord), 0) AS nxt FROM flow),
r(doc_id, ord, page, section, y, y0, split) AS (SELECT doc_id, 0::BIGINT, 1::BIGINT, 0::BIGINT, 0::DOUBLE, 0::DOUBLE, false FROM flow WHERE ord = 1
 UNION ALL SELECT doc_id, ord, CASE WHEN s THEN p + k ELSE p END, section, CASE WHEN s THEN top + o - (k - 1) * (9 - top) ELSE t + height END, t, s FROM (SELECT *, greatest(1, ceil((o - 0.02) / (9 - top)))::BIGINT AS k FROM (
  SELECT *, is_row AND NOT cant_split AND t + height > 9.02 AS s, CASE WHEN header < 8.98 THEN header ELSE 0 END AS top, height - greatest(9 - t, 0) AS o FROM (
   SELECT *, p1 + f::INTEGER AS p, CASE WHEN f THEN CASE WHEN is_row AND header < 9 THEN header ELSE 0 END ELSE y1 END AS t FROM (
    SELECT *, y1 > 0 AND y1 + height + CASE WHEN keep_next THEN nxt ELSE 0 END > 9.02 AND (NOT is_row OR cant_split) AS f FROM (
     SELECT i.*, r.page + n.turned::INTEGER AS p1, CASE WHEN n.turned THEN 0 ELSE r.y END AS y1 FROM r JOIN items i ON i.doc_id = r.doc_id AND i.ord = r.ord + 1, LATERAL (SELECT i.section <> r.section OR (i.page_break AND r.y > 0) AS turned) n))))))
SELECT doc_id, ord, CASE WHEN split THEN page - 0 ELSE page END AS end_page, round(y0, 4) AS y, split FROM r WHERE ord > 0))"""


@query("v_blocks", "SELECT doc_id, ord, end_page, y, split FROM placed", f"{FLOW}, {STEP}")
def w15_pack_tables(spark, sf_dir):
    """Tables in the flow, rows that split or may not, repeated headers, forced breaks and sections."""
    return L.pack_ordered(flow(spark, sf_dir)).select("doc_id", "ord", F.col("end_page").cast("long").alias("end_page"), "y", "split")
