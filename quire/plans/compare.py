"""Queries of comparisons, plans and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import units as U
from quire.operators import compare as C
from quire.operators import planning as P
from quire.operators import structure as S
from quire.plans.registry import query
from quire.plans.structure import CLASSIFIED, SUMMARY, classified
from quire.sources.views import table, view

PAGE = {"size": "a4", "orientation": "portrait", "margins": {"left": 1.1, "top": 1.0}}
STYLES = {
    "Normal": {"run": {"size_pt": 12.0, "east_asia": "宋体"}, "paragraph": {"line_spacing": 1.5}},
    "Heading1": {"run": {"size_pt": 16.0, "bold": True}, "paragraph": {"keep_next": True, "outline_level": 0}},
    "Caption": {"run": {"size_pt": 10.5}},
}
PAGE_NUMBERS = [(0, "upper-roman", 1), (1, "decimal", 1), (2, None, None)]


def inches(spark, sf_dir):
    return measured(view(spark, sf_dir, "v_sections"))


def measured(rows):
    """Sections with their measures in inches."""
    names = {"width_in": "page_w_twips", "height_in": "page_h_twips", "left_in": "mar_left", "top_in": "mar_top", "right_in": "mar_right", "bottom_in": "mar_bottom"}
    return rows.withColumns({k: U.twips_to_in(F.col(v)) for k, v in names.items()}).withColumn("orientation", F.col("orient"))


INCHES = "inches AS (SELECT *, round(page_w_twips/1440.0, 4) AS w, round(page_h_twips/1440.0, 4) AS h, round(mar_left/1440.0, 4) AS l, round(mar_top/1440.0, 4) AS t FROM v_sections)"


@query("v_sections", """SELECT doc_id, name, ok, CASE WHEN ok THEN 'info' ELSE 'error' END AS severity FROM (
 SELECT doc_id, 'section[' || section_idx || '].widthIn' AS name, abs(w - 8.268) <= 0.05 AS ok FROM inches UNION ALL SELECT doc_id, 'section[' || section_idx || '].heightIn', abs(h - 11.693) <= 0.05 FROM inches
 UNION ALL SELECT doc_id, 'section[' || section_idx || '].orientation', coalesce(orient, '') IN ('portrait', '') FROM inches
 UNION ALL SELECT doc_id, 'section[' || section_idx || '].margins.left', abs(l - 1.1) <= 0.05 FROM inches UNION ALL SELECT doc_id, 'section[' || section_idx || '].margins.top', abs(t - 1.0) <= 0.05 FROM inches)""", INCHES)
def j04_diff_page(spark, sf_dir):
    return C.diff_page(inches(spark, sf_dir), PAGE).select("doc_id", "name", "ok", "severity")


@query("v_styles v_blocks", """SELECT doc_id, category, name, ok, affected FROM (SELECT d.doc_id, s.*, coalesce(u.n, 0) AS affected, w.style_id AS want FROM documents d CROSS JOIN (VALUES ('Normal'), ('Heading1'), ('Caption')) w(style_id)
  LEFT JOIN v_styles s ON s.doc_id = d.doc_id AND s.style_id = w.style_id LEFT JOIN (SELECT doc_id, style_id, count(*) AS n FROM v_blocks GROUP BY 1, 2) u ON u.doc_id = d.doc_id AND u.style_id = w.style_id) q,
 LATERAL (SELECT 'style' AS category, 'styles.' || want || '.exists' AS name, style_id IS NOT NULL AS ok
  UNION ALL SELECT 'run', 'styles.Normal.size_pt', abs(size_pt - 12) <= 0.25 WHERE style_id = 'Normal' UNION ALL SELECT 'run', 'styles.Normal.east_asia', east_asia IS NOT DISTINCT FROM '宋体' WHERE style_id = 'Normal'
  UNION ALL SELECT 'paragraph', 'styles.Normal.line_spacing', abs(line_spacing - 1.5) <= 0.06 WHERE style_id = 'Normal'
  UNION ALL SELECT 'run', 'styles.Heading1.size_pt', abs(size_pt - 16) <= 0.25 WHERE style_id = 'Heading1' UNION ALL SELECT 'run', 'styles.Heading1.bold', bold IS NOT DISTINCT FROM true WHERE style_id = 'Heading1'
  UNION ALL SELECT 'paragraph', 'styles.Heading1.keep_next', keep_next IS NOT DISTINCT FROM true WHERE style_id = 'Heading1' UNION ALL SELECT 'paragraph', 'styles.Heading1.outline_level', outline_level IS NOT DISTINCT FROM 0 WHERE style_id = 'Heading1') f""")
def j07_diff_styles(spark, sf_dir):
    usage = S.style_usage(view(spark, sf_dir, "v_blocks"))
    return C.diff_styles(table(spark, sf_dir, "documents"), view(spark, sf_dir, "v_styles"), usage, STYLES).select("doc_id", "category", "name", "ok", "affected")


@query("v_sections", """SELECT d.doc_id, 'pageNumbers.section[' || sec || ']' AS name, coalesce(CASE sec WHEN 0 THEN num_fmt = 'upperRoman' AND num_start = 1 WHEN 1 THEN num_fmt = 'decimal' AND num_start = 1 ELSE num_fmt IS NOT NULL OR num_start IS NOT NULL END, false) AS ok
 FROM documents d CROSS JOIN (VALUES (0), (1), (2)) e(sec) LEFT JOIN v_sections s ON s.doc_id = d.doc_id AND s.section_idx = sec""")
def j08_diff_page_numbers(spark, sf_dir):
    return C.diff_page_numbers(table(spark, sf_dir, "documents"), view(spark, sf_dir, "v_sections"), PAGE_NUMBERS).select("doc_id", "name", "ok")


@query("v_sections", """SELECT a.doc_id, a.section_idx, array_to_string(coalesce(list(b.section_idx ORDER BY b.section_idx) FILTER (b.section_idx IS NOT NULL), []), ',') AS inheriting FROM v_sections a
 LEFT JOIN v_sections b ON b.doc_id = a.doc_id AND b.section_idx > a.section_idx AND NOT EXISTS (SELECT 1 FROM v_sections c WHERE c.doc_id = a.doc_id AND c.has_default_header AND c.section_idx > a.section_idx AND c.section_idx <= b.section_idx)
 WHERE a.has_default_header GROUP BY ALL""")
def j11_inheriting_sections(spark, sf_dir):
    return C.inheriting_sections(view(spark, sf_dir, "v_sections"), F.col("has_default_header")).withColumn("inheriting", F.array_join("inheriting", ","))


STRUCTURE = """structure AS (SELECT doc_id, name, ok, CASE WHEN ok THEN 'info' ELSE sev END AS severity FROM summary, LATERAL (
 SELECT 'document.sections[0].cover' AS name, has_cover AS ok, 'error' AS sev UNION ALL SELECT 'document.sections[1].abstract', has_abstract_zh, 'error' UNION ALL SELECT 'document.abstract_en', has_abstract_en, 'warning'
 UNION ALL SELECT 'document.sections[2].toc', has_toc, 'error' UNION ALL SELECT 'document.sections[3].chapter', chapters >= 1, 'error' UNION ALL SELECT 'document.sections[4].references', has_references, 'error') f)"""


@query("v_blocks", "SELECT * FROM structure", f"{CLASSIFIED}, {SUMMARY}, {STRUCTURE}")
def j12_diff_structure(spark, sf_dir):
    return C.diff_structure(S.summarize(classified(spark, sf_dir)), T.TYPE_SECTIONS["thesis"]).select("doc_id", "name", "ok", "severity")


@query("v_blocks", "SELECT doc_id, array_to_string(coalesce(list(name ORDER BY name) FILTER (NOT ok), []), ',') AS missing, round(100.0 * count(*) FILTER (ok) / count(*), 1)::DOUBLE AS score FROM structure GROUP BY doc_id", f"{CLASSIFIED}, {SUMMARY}, {STRUCTURE}")
def flagship_structure_score(spark, sf_dir):
    """Which required regions each document lacks, and its structure score."""
    found = C.diff_structure(S.summarize(classified(spark, sf_dir)), T.TYPE_SECTIONS["thesis"])
    missing = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("name")))), ",")
    return found.groupBy("doc_id").agg(missing.alias("missing"), F.round(100 * F.count_if(F.col("ok")) / F.count("*"), 1).alias("score"))


@query("v_findings", "SELECT doc_id, category, count(*) AS total, count(*) FILTER (NOT ok) AS failed, round(100.0 * count(*) FILTER (ok) / count(*), 1)::DOUBLE AS score FROM v_findings GROUP BY 1, 2")
def a06_category_scores(spark, sf_dir):
    return C.category_scores(view(spark, sf_dir, "v_findings"))


@query("v_findings", "SELECT doc_id, round(CAST(sum(round(score*10)) AS BIGINT) / (count(*) * 10), 1) AS overall, sum(failed) = 0 AS ok FROM (SELECT doc_id, category, count(*) FILTER (NOT ok) AS failed, round(100.0 * count(*) FILTER (ok) / count(*), 1)::DOUBLE AS score FROM v_findings GROUP BY 1, 2) GROUP BY 1")
def a06_scores(spark, sf_dir):
    return C.scores(view(spark, sf_dir, "v_findings"))


@query("v_sections", "SELECT doc_id, count(*) AS sections, count(*) BETWEEN 2 AND 4 AS ok FROM v_sections GROUP BY 1")
def a10_section_count(spark, sf_dir):
    return C.check_section_count(view(spark, sf_dir, "v_sections"), 2, 4)


@query("v_sections", """SELECT doc_id, section_idx, CASE WHEN (page_w_twips, page_h_twips) IN ((11906, 16838), (16838, 11906)) THEN 'a4' WHEN (page_w_twips, page_h_twips) = (12240, 15840) THEN 'letter' END AS size FROM v_sections""")
def j20_closest_page_size(spark, sf_dir):
    return inches(spark, sf_dir).select("doc_id", "section_idx", C.closest_page_size(F.col("width_in"), F.col("height_in")).alias("size"))


CHAIN = """chain AS (SELECT doc_id, style_id, ancestor, depth FROM (WITH RECURSIVE r(doc_id, style_id, ancestor, depth, path) AS (SELECT doc_id, style_id, style_id, 0, [style_id] FROM v_styles
 UNION ALL SELECT r.doc_id, r.style_id, s.based_on, r.depth + 1, list_append(r.path, s.based_on) FROM r JOIN v_styles s ON s.doc_id = r.doc_id AND s.style_id = r.ancestor JOIN v_styles k ON k.doc_id = r.doc_id AND k.style_id = s.based_on WHERE NOT list_contains(r.path, s.based_on)) SELECT * FROM r))"""


@query("v_styles", "SELECT * FROM chain", CHAIN)
def j02_style_chain(spark, sf_dir):
    return C.style_chain(view(spark, sf_dir, "v_styles"))


@query("v_styles", """SELECT c.doc_id, c.style_id, min_by(size_pt, depth) FILTER (size_pt IS NOT NULL) AS size_pt, min_by(east_asia, depth) FILTER (east_asia IS NOT NULL) AS east_asia, min_by(line_spacing, depth) FILTER (line_spacing IS NOT NULL)::DOUBLE AS line_spacing,
 count(*) FILTER (bold) % 2 = 1 AS bold FROM chain c JOIN v_styles s ON s.doc_id = c.doc_id AND s.style_id = c.ancestor GROUP BY 1, 2""", CHAIN)
def j03_effective_props(spark, sf_dir):
    styles = view(spark, sf_dir, "v_styles").withColumn("line_spacing", F.col("line_spacing").cast("double")).withColumn("size_pt", F.col("size_pt").cast("double"))
    return C.effective_props(C.style_chain(styles), styles, ("size_pt", "east_asia", "line_spacing"), ("bold",))


STEP_SQL = """steps AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS step_no, CASE WHEN starts_with(name, 'styles.') THEN 'set_style' WHEN category = 'page' THEN 'set_page' WHEN category = 'structure' THEN 'map_structure' ELSE 'inspect' END AS action,
 CASE WHEN starts_with(name, 'styles.') THEN split_part(name, '.', 2) WHEN contains(name, 'section[') THEN name ELSE category END AS target, split_part(name, '.', -1) AS property FROM v_findings WHERE NOT ok)"""


@query("v_findings", "SELECT doc_id, idx, action, target, property FROM steps", STEP_SQL)
def p23_plan_columns(spark, sf_dir):
    return P.finding_steps(view(spark, sf_dir, "v_findings")).select("doc_id", "idx", "action", "target", "property")


@query("v_findings", "SELECT doc_id, 's' || CASE WHEN step_no < 1000 THEN lpad(step_no::VARCHAR, 3, '0') ELSE step_no::VARCHAR END || '-' || name AS id, action IN ('set_style', 'set_page') AND property <> 'exists' AS auto, action IN ('map_structure', 'inspect') OR property = 'exists' AS confirm, action NOT IN ('map_structure', 'inspect') AS reversible FROM steps", STEP_SQL)
def p24_annotate_steps(spark, sf_dir):
    return P.finding_steps(view(spark, sf_dir, "v_findings")).select("doc_id", "id", "auto", "confirm", "reversible")


@query("v_findings", "SELECT doc_id, step_no, action FROM steps WHERE action IN ('set_style', 'set_page') AND property <> 'exists' AND ('s' || lpad(step_no::VARCHAR, 3, '0') || '-' || name) <> 's001-styles.Normal.lineSpacing'", STEP_SQL)
def f05_select_steps(spark, sf_dir):
    return P.select_steps(P.finding_steps(view(spark, sf_dir, "v_findings")), skip=["s001-styles.Normal.lineSpacing"], only_auto=True).select("doc_id", "step_no", "action")


@query("v_findings", "SELECT DISTINCT doc_id, CASE action WHEN 'set_style' THEN 'styles' ELSE 'page' END AS rule, CASE action WHEN 'set_style' THEN target ELSE '*' END AS key FROM steps WHERE action IN ('set_style', 'set_page')", STEP_SQL)
def j17_narrow_profile(spark, sf_dir):
    return P.narrowed_keys(P.finding_steps(view(spark, sf_dir, "v_findings")))


@query("v_findings", "SELECT doc_id, count(*) AS failed, count(*) FILTER (action IN ('set_style', 'set_page') AND property <> 'exists') AS auto, count(*) FILTER (action IN ('map_structure', 'inspect') OR property = 'exists') AS confirm, CAST(0 AS BIGINT) AS visual FROM steps GROUP BY 1", STEP_SQL)
def a07_plan_summary(spark, sf_dir):
    return P.plan_summary(P.finding_steps(view(spark, sf_dir, "v_findings")))


@query("v_issues", "SELECT doc_id, idx, type, severity, CASE type WHEN 'image_overflow' THEN 'scale_drawing' ELSE 'set_keep_next' END AS repair FROM v_issues")
def p27_steps_to_issues(spark, sf_dir):
    return P.steps_to_issues(P.issue_steps(view(spark, sf_dir, "v_issues")))


DEDUPED = "deduped AS (SELECT DISTINCT doc_id, idx, type, severity FROM v_issues i WHERE NOT (type = 'orphan_heading_risk' AND EXISTS (SELECT 1 FROM v_issues s WHERE s.doc_id = i.doc_id AND s.idx = i.idx AND s.type IN ('orphan_heading', 'heading_body_split'))))"


@query("v_issues", "SELECT * FROM deduped", DEDUPED)
def j18_dedupe_issues(spark, sf_dir):
    return P.dedupe_issues(view(spark, sf_dir, "v_issues")).select("doc_id", "idx", "type", "severity")


@query("v_issues", "SELECT doc_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, CASE WHEN count(*) FILTER (severity = 'error') > 0 THEN 'failed' WHEN count(*) FILTER (severity = 'warning') > 0 THEN 'passed_with_warnings' ELSE 'passed' END AS status FROM deduped GROUP BY 1", DEDUPED)
def a08_layout_verdict(spark, sf_dir):
    return P.layout_verdict(P.dedupe_issues(view(spark, sf_dir, "v_issues")))


@query("v_findings v_issues", """SELECT s.doc_id, round((CAST(round(overall*10) AS BIGINT) * n + CAST(round(visual*10) AS BIGINT)) / ((n + 1) * 10), 1) AS overall, visual, fine AND errors = 0 AS ok FROM (SELECT s.*, coalesce(v.errors, 0) AS errors, greatest(0.0, 100.0 - coalesce(v.errors, 0) * 12 - coalesce(v.warnings, 0) * 3)::DOUBLE AS visual FROM
 (SELECT doc_id, round(CAST(sum(round(score*10)) AS BIGINT) / (count(*) * 10), 1) AS overall, sum(failed) = 0 AS fine, count(*) AS n FROM (SELECT doc_id, category, count(*) FILTER (NOT ok) AS failed, round(100.0 * count(*) FILTER (ok) / count(*), 1)::DOUBLE AS score FROM v_findings GROUP BY 1, 2) GROUP BY 1) s
 LEFT JOIN (SELECT doc_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM deduped GROUP BY 1) v ON v.doc_id = s.doc_id) s""", DEDUPED)
def a09_compliance(spark, sf_dir):
    found = view(spark, sf_dir, "v_findings")
    return P.compliance(C.scores(found), C.category_scores(found), P.layout_verdict(P.dedupe_issues(view(spark, sf_dir, "v_issues"))))


@query("v_findings", "SELECT doc_id, idx, name, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS rank FROM v_findings WHERE NOT ok) WHERE rank <= 40")
def o02_top_failures(spark, sf_dir):
    return P.top_failures(view(spark, sf_dir, "v_findings")).select("doc_id", "idx", "name", "rank")
