"""Queries of drafts, overrides and the whole run."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import job as J
from quire.plans.compare import INCHES, PAGE, STRUCTURE, inches, measured
from quire.plans.registry import query
from quire.plans.structure import CLASSIFIED, SUMMARY
from quire.sources.views import table, view


@query("v_fields", r"SELECT doc_id, kind, min_by(instruction, ord) AS instruction, CASE WHEN kind = 'TOC' THEN 'keep' ELSE 'note' END AS action FROM (SELECT *, upper(regexp_extract(instruction, '^\s*([A-Za-z]+)', 1)) AS kind FROM v_fields) WHERE kind IN ('TOC', 'CITATION', 'BIBLIOGRAPHY', 'SEQ', 'STYLEREF') GROUP BY 1, 2")
def t02_draft_fields(spark, sf_dir):
    return J.draft_fields(view(spark, sf_dir, "v_fields"))


SECTION_RULES = {1: {"orient": "landscape", "mar_left": 1000}, 3: {"mar_left": 2000}}


@query("v_sections", "SELECT doc_id, section_idx, CASE WHEN section_idx = 1 THEN 'landscape' ELSE orient END AS orient, CASE section_idx WHEN 1 THEN 1000 WHEN 3 THEN 2000 ELSE mar_left END AS mar_left FROM v_sections")
def r02_set_sections(spark, sf_dir):
    return J.set_sections(view(spark, sf_dir, "v_sections"), SECTION_RULES).select("doc_id", "section_idx", "orient", F.col("mar_left").cast("long").alias("mar_left"))


@query("v_sections", "SELECT doc_id, n AS section_idx FROM documents CROSS JOIN (VALUES (1), (3)) v(n) WHERE (doc_id, n) NOT IN (SELECT (doc_id, section_idx) FROM v_sections)")
def r02_out_of_range(spark, sf_dir):
    return J.out_of_range(table(spark, sf_dir, "documents"), view(spark, sf_dir, "v_sections"), SECTION_RULES)


@query("v_styles", "SELECT doc_id, style_id, based_on, CASE WHEN style_id = 'TOC1' THEN 11.5 ELSE size_pt END::DOUBLE AS size_pt FROM v_styles UNION ALL SELECT doc_id, 'Caption', 'Normal', 10.5::DOUBLE FROM documents")
def r05_upsert_styles(spark, sf_dir):
    styles = view(spark, sf_dir, "v_styles").select("doc_id", "style_id", "based_on", F.col("size_pt").cast("double").alias("size_pt"))
    return J.upsert_styles(table(spark, sf_dir, "documents"), styles, {"TOC1": {"size_pt": 11.5}, "Caption": {"size_pt": 10.5}})


@query("v_styles", "SELECT doc_id, style_id, concat('{', concat_ws(',', '\"style_name\":\"' || style_name || '\"', '\"based_on\":\"' || based_on || '\"', '\"east_asia\":\"' || east_asia || '\"', '\"bold\":' || bold::VARCHAR), '}') AS draft FROM v_styles")
def p26_compact(spark, sf_dir):
    return J.compact_json(view(spark, sf_dir, "v_styles"), ["style_name", "based_on", "east_asia", "bold"]).select("doc_id", "style_id", "draft")


RUN = """pages_ AS (SELECT doc_id, 'page' AS category, ok FROM inches, LATERAL (SELECT abs(w - 8.268) <= 0.05 AS ok UNION ALL SELECT abs(h - 11.693) <= 0.05 UNION ALL SELECT coalesce(orient, '') IN ('portrait', '') UNION ALL SELECT abs(l - 1.1) <= 0.05 UNION ALL SELECT abs(t - 1.0) <= 0.05) f),
cats AS (SELECT doc_id, category, count(*) FILTER (NOT ok) AS failed, round(100.0 * count(*) FILTER (ok) / count(*), 1)::DOUBLE AS score FROM (SELECT * FROM pages_ UNION ALL SELECT doc_id, 'structure', ok FROM structure) GROUP BY 1, 2),
risks AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, idx FROM classified WHERE kind IN ('chapter', 'section', 'subsection') AND NOT coalesce(keep_next, false) UNION ALL
 SELECT doc_id, idx FROM (SELECT *, lead(kind) OVER w AS nk, lag(kind) OVER w AS pk, lead(in_table) OVER w AS ni, lag(in_table) OVER w AS pi_ FROM classified WINDOW w AS (PARTITION BY doc_id ORDER BY idx)) WHERE (kind = 'figure' AND nk <> 'figure_caption') OR (kind = 'figure_caption' AND pk NOT IN ('figure', 'figure_caption', 'body', 'empty'))
  OR (kind = 'table_caption' AND NOT (coalesce(ni OR nk = 'table_cell', false) OR coalesce(pi_ OR pk = 'table_cell', false)))) GROUP BY 1)"""


@query("v_blocks v_sections", """SELECT doc_id, round((CAST(round(overall*10) AS BIGINT) * n + CAST(round(visual*10) AS BIGINT)) / ((n + 1) * 10), 1) AS overall, visual, fine AS ok FROM (SELECT s.*, greatest(0.0, 100.0 - 3 * coalesce(r.n, 0))::DOUBLE AS visual
 FROM (SELECT doc_id, round(CAST(sum(round(score*10)) AS BIGINT) / (count(*) * 10), 1) AS overall, sum(failed) = 0 AS fine, count(*) AS n FROM cats GROUP BY 1) s LEFT JOIN risks r ON r.doc_id = s.doc_id)""", f"{CLASSIFIED}, {SUMMARY}, {STRUCTURE}, {INCHES}, {RUN}")
def n01_compliance_run(spark, sf_dir):
    return J.compliance_run(view(spark, sf_dir, "v_blocks"), inches(spark, sf_dir), PAGE, T.TYPE_SECTIONS["thesis"])["compliance"]


# All rule families at once; what each leaves is told by a query.

STANDARD = {
    "page": {"size": "a4", "orientation": "portrait", "margins": {"left": 1.25}},
    "sections": {1: {"mar_left": 2000}},
    "pageNumbers": [(0, "lower-roman", 1)],
    "paragraphRules": [{"match": {"regex": r"^\d+ \S+", "style": "Normal"}, "set_style": "Heading1"}, {"match": {"equals": "目录"}, "remove": True}],
    "captionRules": [{"match": {"regex": "^图"}, "label": "Fig. ", "strip": r"^图\s*\d+(?:-\d+)?"}],
    "bookmarkRules": [{"match": {"starts_with": "Fig."}, "name": "fig_{index}"}],
    "replacements": [{"find": "{{TITLE}}", "by": "题目"}, {"find": "[aeiou]{2}", "by": "_", "regex": True}],
    "fieldRules": [{"placeholder": "题目", "instruction": "TITLE"}],
}


def standard(spark, sf_dir, plan=None):
    tables = {"sections": view(spark, sf_dir, "v_sections"), "blocks": view(spark, sf_dir, "v_blocks"), "bookmarks": view(spark, sf_dir, "v_bookmarks")}
    return J.standardize(tables, STANDARD, plan)


@query("v_sections", "SELECT doc_id, section_idx, 11906 AS w, 16838 AS h, CASE section_idx WHEN 1 THEN 2000 ELSE 1800 END AS mar_left, CASE section_idx WHEN 0 THEN 'lowerRoman' ELSE num_fmt END AS num_fmt, CASE section_idx WHEN 0 THEN 1 ELSE num_start END AS num_start, mar_top FROM v_sections")
def r16_standard_sections(spark, sf_dir):
    return standard(spark, sf_dir)["sections"].select("doc_id", "section_idx", F.col("page_w_twips").cast("long").alias("w"), F.col("page_h_twips").cast("long").alias("h"), F.col("mar_left").cast("long").alias("mar_left"), "num_fmt", "num_start", "mar_top")


AFTER = r"""st AS (SELECT doc_id, idx, CASE WHEN coalesce(style_id, '') = 'Normal' AND regexp_matches(trim(text), '^\d+ \S+') THEN 'Heading1' ELSE style_id END AS style_id, text FROM v_blocks WHERE trim(text) <> '目录'),
cp AS (SELECT doc_id, idx, style_id, CASE WHEN regexp_matches(trim(text), '^图') THEN 'Fig. {SEQ Fig.  \* ARABIC} ' || ltrim(regexp_replace(text, '^图\s*\d+(-\d+)?', '')) ELSE text END AS text FROM st),
fin AS (SELECT doc_id, idx, style_id, text AS captioned, regexp_replace(replace(text, '{{TITLE}}', '题目'), '[aeiou]{2}', '_', 'g') AS text FROM cp)"""


@query("v_blocks", "SELECT doc_id, idx, style_id, text FROM fin", AFTER)
def r16_standard_blocks(spark, sf_dir):
    return standard(spark, sf_dir)["blocks"].select("doc_id", "idx", "style_id", "text")


@query("v_blocks v_bookmarks", """SELECT doc_id, name, id FROM v_bookmarks UNION ALL SELECT c.doc_id, c.name, coalesce(top, -1) + row_number() OVER (PARTITION BY c.doc_id ORDER BY n) FROM (SELECT doc_id, n, 'fig_' || n AS name FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM fin WHERE starts_with(trim(captioned), 'Fig.'))) c
 LEFT JOIN (SELECT doc_id, max(id) AS top FROM v_bookmarks GROUP BY 1) t ON t.doc_id = c.doc_id WHERE NOT EXISTS (SELECT 1 FROM v_bookmarks b WHERE b.doc_id = c.doc_id AND b.name = c.name)""", AFTER)
def r16_standard_bookmarks(spark, sf_dir):
    return standard(spark, sf_dir)["bookmarks"].select("doc_id", "name", F.col("id").cast("long").alias("id"))


@query("v_sections v_blocks", "SELECT doc_id, section_idx, CASE WHEN doc_id % 2 = 0 THEN 11906 ELSE page_w_twips END AS w, CASE WHEN doc_id % 3 = 0 AND section_idx = 0 THEN 'lowerRoman' ELSE num_fmt END AS num_fmt FROM v_sections")
def r16_by_plan(spark, sf_dir):
    """A plan that touches the pages of every second document and the page numbers of every third."""
    docs = table(spark, sf_dir, "documents")
    plan = docs.where("doc_id % 2 = 0").select("doc_id", F.lit("page").alias("family")).unionByName(docs.where("doc_id % 3 = 0").select("doc_id", F.lit("pageNumbers").alias("family")))
    return standard(spark, sf_dir, plan)["sections"].select("doc_id", "section_idx", F.col("page_w_twips").cast("long").alias("w"), "num_fmt")


BEFORE_AFTER = RUN + """,
rest AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, idx FROM (SELECT *, lead(kind) OVER w AS nk, lag(kind) OVER w AS pk, lead(in_table) OVER w AS ni, lag(in_table) OVER w AS pi_ FROM classified WINDOW w AS (PARTITION BY doc_id ORDER BY idx)) WHERE (kind = 'figure' AND nk <> 'figure_caption') OR (kind = 'figure_caption' AND pk NOT IN ('figure', 'figure_caption', 'body', 'empty'))
  OR (kind = 'table_caption' AND NOT (coalesce(ni OR nk = 'table_cell', false) OR coalesce(pi_ OR pk = 'table_cell', false)))) GROUP BY 1),
cats_after AS (SELECT doc_id, category, CASE WHEN category = 'page' THEN 0 ELSE failed END AS failed, CASE WHEN category = 'page' THEN 100.0 ELSE score END AS score FROM cats)"""
SCORE = """(SELECT s.doc_id, visual, fine AS ok, round((CAST(round(overall*10) AS BIGINT) * n + CAST(round(visual*10) AS BIGINT)) / ((n + 1) * 10), 1) AS overall FROM (SELECT s.*, greatest(0.0, 100.0 - 3 * coalesce(r.n, 0))::DOUBLE AS visual
 FROM (SELECT doc_id, round(CAST(sum(round(score*10)) AS BIGINT) / (count(*) * 10), 1) AS overall, sum(failed) = 0 AS fine, count(*) AS n FROM {0} GROUP BY 1) s LEFT JOIN {1} r ON r.doc_id = s.doc_id) s)"""


@query("v_blocks v_sections", f"SELECT b.doc_id, b.overall AS before, a.overall AS after, a.ok FROM {SCORE.format('cats', 'risks')} b JOIN {SCORE.format('cats_after', 'rest')} a ON a.doc_id = b.doc_id", f"{CLASSIFIED}, {SUMMARY}, {STRUCTURE}, {INCHES}, {BEFORE_AFTER}")
def n01_rewrite(spark, sf_dir):
    """Scores before and after a run's plan is applied: pages are as expected then, and headings stay with what follows."""
    before, _, after = J.compliance_rewrite(view(spark, sf_dir, "v_blocks"), view(spark, sf_dir, "v_sections"), measured, PAGE, T.TYPE_SECTIONS["thesis"])
    return before["compliance"].select("doc_id", F.col("overall").alias("before")).join(after["compliance"].select("doc_id", F.col("overall").alias("after"), "ok"), "doc_id")
