"""Queries of section reports, inventories, graph details, runs, bookmarks, narrowed profiles and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import compare as C
from quire.operators import inventory as I
from quire.operators import packages as K
from quire.operators import planning as P
from quire.operators import rules as R
from quire.operators import structure as S
from quire.plans.registry import query
from quire.sources.views import table, view


@query("v_gnodes v_gedges v_glayout", """SELECT DISTINCT graph_id, problem FROM (SELECT graph_id, p AS problem FROM v_gnodes, LATERAL (SELECT 'node_id_length' AS p WHERE length(id) > 80 UNION ALL SELECT 'node_text' WHERE trim(text) = '' OR length(text) > 200 UNION ALL SELECT 'node_type' WHERE type = 'cloud'
  UNION ALL SELECT 'grid_cell' WHERE (row IS NOT NULL OR col IS NOT NULL) AND NOT coalesce(row BETWEEN 0 AND 59 AND col BETWEEN 0 AND 59, false)) t
 UNION ALL SELECT graph_id, 'some_placed' FROM v_gnodes GROUP BY 1 HAVING bool_or(row IS NOT NULL OR col IS NOT NULL) AND NOT bool_and(row IS NOT NULL OR col IS NOT NULL)
 UNION ALL SELECT graph_id, 'overlap' FROM v_gnodes WHERE row IS NOT NULL AND col IS NOT NULL GROUP BY graph_id, row, col HAVING count(*) > 1
 UNION ALL SELECT graph_id, 'edge_label' FROM v_gedges WHERE trim(label) = '' OR length(label) > 40
 UNION ALL SELECT graph_id, CASE key WHEN 'depth' THEN 'layout_key' ELSE 'layout_range' END FROM v_glayout WHERE NOT coalesce(CASE key WHEN 'nodeWidthIn' THEN value BETWEEN 0.8 AND 4 WHEN 'fontSizePt' THEN value BETWEEN 8 AND 24 WHEN 'rowGapIn' THEN value BETWEEN 0.35 AND 2 END, false))""")
def g01_graph_details(spark, sf_dir):
    return K.check_graph_details(view(spark, sf_dir, "v_gnodes"), view(spark, sf_dir, "v_gedges"), view(spark, sf_dir, "v_glayout"))


@query("v_sections v_refs v_rels", """SELECT s.doc_id, s.section_idx, coalesce(headers, '') AS headers, coalesce(footers, '') AS footers, coalesce(resolved, true) AS resolved FROM v_sections s LEFT JOIN (SELECT f.doc_id, f.section_idx,
  string_agg(CASE WHEN kind = 'header' THEN concat(ref_type, ':', coalesce(target, '-')) END, ',' ORDER BY ref_type) AS headers, string_agg(CASE WHEN kind = 'footer' THEN concat(ref_type, ':', coalesce(target, '-')) END, ',' ORDER BY ref_type) AS footers, bool_and(coalesce(ends_with(rel_type, kind), false)) AS resolved
  FROM v_refs f LEFT JOIN v_rels r ON r.doc_id = f.doc_id AND r.rel_id = f.rel_id GROUP BY 1, 2) q ON q.doc_id = s.doc_id AND q.section_idx = s.section_idx""")
def j21_section_report(spark, sf_dir):
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["type"], F.lit(":"), F.coalesce(x["target"], F.lit("-")))), ",")
    rows = I.section_report(view(spark, sf_dir, "v_sections"), view(spark, sf_dir, "v_refs"), view(spark, sf_dir, "v_rels"))
    return rows.select("doc_id", "section_idx", told("headers").alias("headers"), told("footers").alias("footers"), "resolved")


@query("v_blocks v_runs", "SELECT doc_id, paragraphs, direct_paragraphs, runs, formatted_runs FROM (SELECT doc_id, count(*) AS paragraphs, count(*) FILTER (keep_next IS NOT NULL) AS direct_paragraphs FROM v_blocks GROUP BY 1) JOIN (SELECT doc_id, count(*) AS runs, count(*) FILTER (bold OR size_pt IS NOT NULL) AS formatted_runs FROM v_runs GROUP BY 1) USING (doc_id)")
def a01_run_inventory(spark, sf_dir):
    formatted = F.coalesce("bold", F.lit(False)) | F.col("size_pt").isNotNull()
    return I.paragraph_inventory(view(spark, sf_dir, "v_blocks"), view(spark, sf_dir, "v_runs"), F.col("keep_next").isNotNull(), formatted)


@query("v_fields", r"SELECT doc_id, CASE WHEN regexp_matches(instruction, '^\s*[A-Za-z]+') THEN upper(regexp_extract(instruction, '^\s*([A-Za-z]+)', 1)) ELSE 'UNKNOWN' END AS kind, count(*) AS n, count(*) FILTER (ord % 3 <> 0) AS starts, string_agg(trim(regexp_replace(instruction, '\s+', ' ', 'g')), '|' ORDER BY ord) AS instructions FROM v_fields GROUP BY 1, 2")
def a02_field_starts(spark, sf_dir):
    rows = I.field_inventory(view(spark, sf_dir, "v_fields").withColumn("begins", F.col("ord") % 3 != 0))
    return rows.select("doc_id", "kind", "n", "starts", F.array_join("instructions", "|").alias("instructions"))


@query("v_objects v_parts", """SELECT doc_id, coalesce(tables, 0) AS tables, coalesce(images, 0) AS images, coalesce(drawings, 0) AS drawings, coalesce(text_boxes, 0) AS text_boxes, coalesce(content_controls, 0) AS content_controls, coalesce(insertions, 0) AS insertions, coalesce(deletions, 0) AS deletions,
 coalesce(bookmarks, 0) AS bookmarks, coalesce(formats, 0) AS numbering_formats, coalesce(headers, 0) AS headers, coalesce(footers, 0) AS footers FROM (SELECT doc_id FROM v_objects UNION SELECT doc_id FROM v_parts)
 LEFT JOIN (SELECT doc_id, count(*) FILTER (kind = 'tables') AS tables, count(*) FILTER (kind = 'drawings') AS drawings, count(*) FILTER (kind = 'text_boxes') AS text_boxes, count(*) FILTER (kind = 'content_controls') AS content_controls, count(*) FILTER (kind = 'insertions') AS insertions,
  count(*) FILTER (kind = 'deletions') AS deletions, count(*) FILTER (kind = 'bookmarks') AS bookmarks, count(DISTINCT name) FILTER (kind = 'numbering_formats') AS formats FROM v_objects GROUP BY 1) USING (doc_id)
 LEFT JOIN (SELECT doc_id, count(*) FILTER (starts_with(part_name, 'word/media/')) AS images, count(*) FILTER (starts_with(part_name, 'word/header')) AS headers, count(*) FILTER (starts_with(part_name, 'word/footer')) AS footers FROM (SELECT DISTINCT doc_id, part_name FROM v_parts) GROUP BY 1) USING (doc_id)""")
def a03_content_counters(spark, sf_dir):
    return I.content_inventory(view(spark, sf_dir, "v_objects"), view(spark, sf_dir, "v_parts"))


STYLES = {"Normal": {"run": {"size_pt": 12.0}, "paragraph": {"first_line_chars": 2, "keep_next": None}}, "Heading1": {"run": {"size_pt": 16.0}, "paragraph": {"first_line_in": 0.5}}, "LoopA": {"paragraph": {"first_line_chars": 1}}}


@query("v_styles", """SELECT doc_id, name, ok FROM (SELECT doc_id, style_id, 'styles.' || style_id || '.first_line_in' AS name, abs(CASE style_id WHEN 'Normal' THEN 12 WHEN 'Heading1' THEN 16 ELSE 11 END / 36.0 + (doc_id % 3) * 0.03 - CASE style_id WHEN 'Normal' THEN 24 WHEN 'Heading1' THEN 36 ELSE 12 END / 72.0) <= 0.04 AS ok
 FROM v_styles WHERE style_id IN ('Normal', 'Heading1', 'LoopA'))""")
def j06_first_line(spark, sf_dir):
    """First lines of two characters at the style's nominal size, up to 0.06 inches off, against rules in characters and inches."""
    nominal = F.when(F.col("style_id") == "Normal", 12).when(F.col("style_id") == "Heading1", 16).otherwise(11)
    styles = view(spark, sf_dir, "v_styles").withColumn("first_line_in", nominal / 36 + (F.col("doc_id") % 3) * F.lit(0.03))
    usage = S.style_usage(view(spark, sf_dir, "v_blocks"))
    rows = C.diff_styles(table(spark, sf_dir, "documents"), styles, usage, STYLES)
    return rows.where(F.col("name").endswith("first_line_in")).select("doc_id", "name", "ok")


PARA = [
    {"match": {"style": "Heading1"}, "clear_paragraph": True, "clear_run": True},
    {"match": {"regex": r"^\d+ \S+", "style": "Normal"}, "set": {"size_pt": 10.5, "color": "#0a0b0c"}, "set_style": "Caption"},
    {"match": {"contains": "the"}, "set": {"bold": True}, "max_matches": 2},
]


@query("v_blocks", r"""SELECT doc_id, idx, CASE WHEN n1 THEN 'Caption' ELSE style_id END AS style_id, CASE WHEN h1 THEN NULL ELSE keep_next END AS keep_next, CASE WHEN n1 THEN 10.5 WHEN NOT h1 THEN 12.0 END::DOUBLE AS size_pt, CASE WHEN n1 THEN '0A0B0C' END AS color,
 CASE WHEN hit AND sum(hit::INTEGER) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) <= 2 THEN true WHEN NOT h1 THEN idx % 2 = 0 END AS bold FROM (SELECT *, coalesce(style_id = 'Heading1', false) AS h1, coalesce(style_id = 'Normal', false) AND regexp_matches(trim(text), '^\d+ \S+') AS n1, contains(text, 'the') AS hit FROM v_blocks)""")
def r08_clear_and_overlay(spark, sf_dir):
    blocks = view(spark, sf_dir, "v_blocks").withColumns({"size_pt": F.lit(12.0), "color": F.lit(None).cast("string"), "bold": F.col("idx") % 2 == 0})
    return R.apply_para_rules(blocks, PARA, ("keep_next",), ("size_pt", "color", "bold")).select("doc_id", "idx", "style_id", "keep_next", "size_pt", "color", "bold")


@query("v_runs v_blocks", """SELECT doc_id, idx, run_ord, CASE WHEN starts_with(b.text, '{{TITLE}}') THEN CASE run_ord WHEN 0 THEN '题目 $1\\' WHEN 1 THEN '' ELSE r.text END ELSE r.text END AS text, bold FROM v_runs r JOIN v_blocks b USING (doc_id, idx)""")
def r09_replace_in_runs(spark, sf_dir):
    return R.replace_in_runs(view(spark, sf_dir, "v_runs").select("doc_id", "idx", "run_ord", "text", "bold"), "{{TITLE}}", "题目 $1\\")


@query("v_blocks", r"""SELECT doc_id, idx, string_agg(c, '' ORDER BY i) FILTER (i <= 4) AS a, string_agg(c, '' ORDER BY i) FILTER (i > 4 AND i <= 9) AS b, string_agg(c, '' ORDER BY i) FILTER (i > 9) AS c FROM (
 SELECT doc_id, idx, i, CASE WHEN m > 0 AND i = m THEN '<' || w || '>' WHEN m > 0 AND i > m AND i < m + length(w) THEN '' ELSE substr(text, i::INTEGER, 1) END AS c FROM (SELECT doc_id, idx, text, unnest(range(1, length(text) + 1)) AS i, regexp_extract(text, '[a-z]{4,}') AS w, CASE WHEN regexp_matches(text, '[a-z]{4,}') THEN strpos(text, regexp_extract(text, '[a-z]{4,}')) ELSE 0 END AS m FROM v_blocks WHERE text <> '' AND idx < 40)) GROUP BY 1, 2""")
def r09_first_match_in_runs(spark, sf_dir):
    """The first word of four letters or more, in brackets, wherever the runs' borders fall; a row for each paragraph."""
    runs = view(spark, sf_dir, "v_runs").where("idx < 40")
    out = R.replace_in_runs(runs, "[a-z]{4,}", "<$0>", regex=True, every=False)
    part = lambda n: F.max(F.when((F.col("run_ord") == n) & (F.col("text") != "") | (F.col("run_ord") == n) & F.col("_had"), F.col("text")))
    had = runs.select(F.col("doc_id").alias("_d"), F.col("idx").alias("_i"), F.col("run_ord").alias("_r"), (F.col("text") != "").alias("_had"))
    rows = out.join(had, (F.col("doc_id") == F.col("_d")) & (F.col("idx") == F.col("_i")) & (F.col("run_ord") == F.col("_r")))
    return rows.groupBy("doc_id", "idx").agg(part(0).alias("a"), part(1).alias("b"), part(2).alias("c")).where("a IS NOT NULL")


@query("v_blocks", r"""SELECT doc_id, idx, 'cap_' || row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS bookmark, concat('图{SEQ 图 \* ARABIC} ', ltrim(regexp_replace(text, '^图\s*\d+(-\d+)?', ''))) AS caption FROM v_blocks WHERE regexp_matches(trim(text), '^图')""")
def r11_caption_bookmarks(spark, sf_dir):
    return R.apply_captions(view(spark, sf_dir, "v_blocks"), {"regex": "^图"}, "图", r"^图\s*\d+(?:-\d+)?", None, bookmark="cap_").select("doc_id", "idx", "bookmark", "caption")


@query("v_blocks v_bookmarks", """SELECT c.doc_id, idx, name, coalesce(top, -1) + row_number() OVER (PARTITION BY c.doc_id ORDER BY rule, n) AS id FROM (SELECT doc_id, idx, rule, n, 'fig_' || n AS name FROM (SELECT doc_id, idx, rule, row_number() OVER (PARTITION BY doc_id, rule ORDER BY idx) AS n FROM (
  SELECT doc_id, idx, 0 AS rule FROM v_blocks WHERE starts_with(trim(text), '图') UNION ALL SELECT doc_id, idx, 1 FROM v_blocks WHERE starts_with(trim(text), '表'))) WHERE rule = 0 OR n <= 3 QUALIFY row_number() OVER (PARTITION BY doc_id, n ORDER BY rule) = 1) c
 LEFT JOIN (SELECT doc_id, max(id) AS top FROM v_bookmarks GROUP BY 1) t ON t.doc_id = c.doc_id WHERE NOT EXISTS (SELECT 1 FROM v_bookmarks b WHERE b.doc_id = c.doc_id AND b.name = c.name)""")
def r12_create_bookmarks(spark, sf_dir):
    """Two rules that make the same names: what a document has, or an earlier rule made, is skipped."""
    rules = [{"match": {"starts_with": "图"}, "name": "fig_{index}"}, {"match": {"starts_with": "表"}, "name": "fig_{index}", "max_matches": 3}]
    return R.apply_bookmarks(view(spark, sf_dir, "v_blocks"), view(spark, sf_dir, "v_bookmarks"), rules)


PROFILE = [("page", "0", None, "size", "a4"), ("sections", "0", None, "orient", "portrait"), ("defaultRun", "0", None, "size_pt", "12"), ("paragraphRules", "0", None, "style", "Caption"), ("replacements", "0", None, "find", "x")] + [
    ("styles", style, bucket, key, "1") for style in ("Normal", "Heading1", "Caption") for bucket, key in (("run", "size_pt"), ("run", "bold"), ("paragraph", "line_spacing"))
] + [(family, str(i), None, "v", str(i)) for family in ("pageNumbers", "tableRules", "headersFooters") for i in range(3)]
RULES_SQL = "rules(family, item, bucket, property, value) AS (VALUES " + ", ".join("(" + ", ".join("NULL::VARCHAR" if x is None else f"'{x}'" for x in r) + ")" for r in PROFILE) + ")"


@query("v_steps", r"""SELECT doc_id, family, item, property FROM (SELECT doc_id, bool_or(action IN ('set_style', 'set_run') AND source LIKE 'styles.Heading1.%') AS h1, bool_or(source = 'styles.Normal.exists') AS nm, bool_or(action = 'set_page') AS pg, list(DISTINCT regexp_extract(source, '\[(\d+)\]', 1)) FILTER (action = 'set_page_number') AS pn,
  list(DISTINCT regexp_extract(source, '\[(\d+)\]', 1)) FILTER (action = 'set_table') AS tb, list(DISTINCT regexp_extract(source, '\[(\d+)\]', 1)) FILTER (action = 'set_header_footer') AS hf, bool_or(source LIKE 'paragraphRules%') AS mp FROM v_steps WHERE NOT visual GROUP BY 1) s JOIN rules ON
 CASE family WHEN 'page' THEN pg WHEN 'sections' THEN pg WHEN 'styles' THEN (item = 'Heading1' AND h1 AND property = 'size_pt') OR (item = 'Normal' AND nm) WHEN 'pageNumbers' THEN list_contains(pn, item) WHEN 'tableRules' THEN list_contains(tb, item) WHEN 'headersFooters' THEN list_contains(hf, item) WHEN 'defaultRun' THEN false ELSE mp END""", RULES_SQL)
def j17_narrow_profile(spark, sf_dir):
    rules = spark.createDataFrame(PROFILE, "family string, item string, bucket string, property string, value string")
    return P.narrow_profile(rules, view(spark, sf_dir, "v_steps")).select("doc_id", "family", "item", "property")


@query("v_findings v_steps", """SELECT coalesce(f.doc_id, s.doc_id) AS doc_id, coalesce(structure_failed, 0) AS structure_failed, coalesce(validation_failed, 0) AS validation_failed, concat_ws('|', asked, 'refresh field results', 'cover, floating objects, macros') AS must_review FROM (SELECT doc_id, count(*) FILTER (NOT ok AND category = 'structure') AS structure_failed,
  count(*) FILTER (NOT ok AND category = 'run') AS validation_failed FROM v_findings GROUP BY 1) f FULL JOIN (SELECT doc_id, string_agg(id || ': ' || action, '|' ORDER BY step_no) FILTER (confirm) AS asked FROM v_steps GROUP BY 1) s ON s.doc_id = f.doc_id""")
def a09_review(spark, sf_dir):
    findings = view(spark, sf_dir, "v_findings")
    rows = P.review(findings, findings.where("category = 'run'").select("doc_id", "ok"), view(spark, sf_dir, "v_steps"))
    return rows.withColumn("must_review", F.array_join("must_review", "|"))
