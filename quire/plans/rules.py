"""Queries of rule matching, text checks and rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import units as U
from quire.operators import rules as R
from quire.operators import structure as S
from quire.plans.registry import query
from quire.plans.structure import CJK_SQL, CLASSIFIED, classified
from quire.sources.views import table, view

RULES = [
    {"match": {"regex": r"^\d+ \S+", "style_not_in": ["TOC1"]}, "max_matches": 1, "required": True},
    {"match": {"starts_with": "图", "in_table": False}},
    {"match": {"contains": "the", "style": "Normal", "in_text_box": False}, "max_matches": 2},
    {"match": {"equals": "Abstract"}, "required": True},
    {"match": {"not_regex": r"\S"}},
]
MATCHED = r"""n0 AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM v_blocks),
matched AS (SELECT doc_id, idx, rule FROM n0, LATERAL (SELECT 0 AS rule WHERE regexp_matches(t, '^\d+ \S+') AND coalesce(style_id, '') NOT IN ('TOC1') UNION ALL SELECT 1 WHERE starts_with(t, '图') AND NOT in_table
 UNION ALL SELECT 2 WHERE contains(t, 'the') AND style_id = 'Normal' AND NOT in_text_box UNION ALL SELECT 3 WHERE t = 'Abstract' UNION ALL SELECT 4 WHERE NOT regexp_matches(t, '\S')) r)"""


def matches(spark, sf_dir):
    return R.match_rules(view(spark, sf_dir, "v_blocks"), RULES)


@query("v_blocks", "SELECT * FROM matched", MATCHED)
def f01_match_rules(spark, sf_dir):
    return matches(spark, sf_dir)


@query("v_blocks", "SELECT doc_id, idx, rule, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, rule ORDER BY idx) AS n FROM matched) WHERE n <= CASE rule WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 99999999 END", MATCHED)
def f02_cap_matches(spark, sf_dir):
    return R.cap_matches(matches(spark, sf_dir), RULES).select("doc_id", "idx", "rule", "n")


@query("v_blocks", "SELECT doc_id, rule FROM documents CROSS JOIN (VALUES (0), (3)) v(rule) WHERE (doc_id, rule) NOT IN (SELECT (doc_id, rule) FROM matched)", MATCHED)
def f03_unmatched_required(spark, sf_dir):
    return R.unmatched_required(table(spark, sf_dir, "documents"), matches(spark, sf_dir), RULES)


@query("v_parts", "SELECT DISTINCT doc_id, part_name FROM v_parts WHERE part_name = 'word/document.xml' OR regexp_matches(part_name, '^word/footer\\d+\\.xml$') OR part_name = 'word/header2.xml'")
def f04_select_parts(spark, sf_dir):
    return R.select_parts(view(spark, sf_dir, "v_parts"), ["document", "footers", "word/header2.xml"])


@query("v_blocks", "SELECT doc_id, rule, idx, row_number() OVER (PARTITION BY doc_id, rule ORDER BY idx) AS n FROM matched", MATCHED)
def w07_number_matches(spark, sf_dir):
    return R.numbered(matches(spark, sf_dir)).select("doc_id", "rule", "idx", "n")


@query("v_blocks", r"""SELECT f.doc_id, first, last, CAST(sum(length(regexp_replace(b.text, '\s+', '', 'g'))) AS BIGINT) AS characters FROM (SELECT a.doc_id, a.first, min(e.idx) AS last FROM (SELECT doc_id, min(idx) FILTER (regexp_matches(text, '^Abstract$')) AS first FROM v_blocks GROUP BY 1) a
 LEFT JOIN v_blocks e ON e.doc_id = a.doc_id AND e.idx > a.first AND regexp_matches(e.text, '^\d+') GROUP BY 1, 2) f LEFT JOIN v_blocks b ON b.doc_id = f.doc_id AND b.idx > first AND b.idx < last GROUP BY 1, 2, 3""")
def w08_marked_span(spark, sf_dir):
    return R.marked_span(view(spark, sf_dir, "v_blocks"), "^Abstract$", r"^\d+").select("doc_id", "first", "last", "characters")


TEXTS = [{"pattern": "参考文献", "min": 1}, {"pattern": r"^\d+ ", "regex": True, "min": 1, "max": 5}, {"pattern": "{{TITLE}}", "max": 0}]
DOC_TEXT = "doc_text AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY idx) AS text FROM v_blocks GROUP BY 1)"


@query("v_blocks", r"""SELECT doc_id, rule, CAST(n AS INTEGER) AS n, CASE rule WHEN 0 THEN n >= 1 WHEN 1 THEN n BETWEEN 1 AND 5 ELSE n <= 0 END AS ok FROM doc_text, LATERAL (SELECT 0 AS rule, len(regexp_extract_all(text, '参考文献')) AS n
 UNION ALL SELECT 1, len(regexp_extract_all(text, '(?m)^\d+ ')) UNION ALL SELECT 2, len(regexp_extract_all(text, '\{\{TITLE\}\}'))) r""", DOC_TEXT)
def a11_check_texts(spark, sf_dir):
    return R.check_texts(R.document_text(view(spark, sf_dir, "v_blocks")), TEXTS)


@query("v_blocks", f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{T.PLACEHOLDER}')) AS INTEGER) AS n, NOT regexp_matches(text, '{T.PLACEHOLDER}') AS ok FROM doc_text", DOC_TEXT)
def a12_check_placeholders(spark, sf_dir):
    return R.check_texts(R.document_text(view(spark, sf_dir, "v_blocks")), [{"pattern": T.PLACEHOLDER, "regex": True, "max": 0}]).select("doc_id", "n", "ok")


@query("v_fields", r"SELECT u.doc_id, key, coalesce(n, 0) AS n, coalesce(n, 0) >= least_ AS ok FROM (SELECT DISTINCT doc_id FROM v_fields) u CROSS JOIN (VALUES ('PAGE', 1), ('TOC', 3)) w(key, least_) LEFT JOIN (SELECT doc_id, upper(regexp_extract(instruction, '^\s*([A-Za-z]+)', 1)) AS k, count(*) AS n FROM v_fields GROUP BY 1, 2) c ON c.doc_id = u.doc_id AND c.k = key")
def j19_check_required(spark, sf_dir):
    fields = view(spark, sf_dir, "v_fields")
    counts = fields.groupBy("doc_id", U.field_kind(F.col("instruction")).alias("key")).agg(F.count("*").alias("n"))
    return R.check_required(fields.select("doc_id").distinct(), counts, {"PAGE": 1, "TOC": 3})


@query("v_blocks", f"SELECT doc_id, token, string_agg(DISTINCT part, ',' ORDER BY part) AS buckets FROM (SELECT doc_id, CASE WHEN in_table THEN 'tables' ELSE 'document' END AS part, unnest(regexp_extract_all(text, '{T.PLACEHOLDER}')) AS token FROM v_blocks) GROUP BY 1, 2")
def a16_placeholder_inventory(spark, sf_dir):
    return R.placeholder_inventory(view(spark, sf_dir, "v_blocks").select("doc_id", F.when(F.col("in_table"), "tables").otherwise("document").alias("part"), "text"))


@query("v_blocks", r"""SELECT doc_id, rule FROM (SELECT doc_id, bool_or(regexp_matches(t, '^[一二三四五六七八九十]+、')) AS zh, bool_or(regexp_matches(t, '^\d+\s+\S+') AND kind = 'chapter') AS ch, bool_or(regexp_matches(t, '^\d+\.\d+\s+\S+') AND kind = 'section') AS se FROM classified WHERE kind <> 'toc_entry' GROUP BY 1) q,
 LATERAL (SELECT CASE WHEN zh THEN 'chapter_zh' WHEN ch THEN 'chapter_decimal' END AS rule UNION ALL SELECT CASE WHEN se THEN 'section_decimal' END) r WHERE rule IS NOT NULL""", CLASSIFIED)
def a17_infer_para_rules(spark, sf_dir):
    return R.infer_para_rules(classified(spark, sf_dir))


@query("v_fields v_blocks", "SELECT b.doc_id, b.idx, coalesce(top, -1) + row_number() OVER (PARTITION BY b.doc_id ORDER BY b.idx) AS id FROM v_blocks b LEFT JOIN (SELECT doc_id, max(ord) AS top FROM v_fields GROUP BY 1) f ON f.doc_id = b.doc_id WHERE b.style_id = 'Heading1'")
def a18_next_ids(spark, sf_dir):
    existing = view(spark, sf_dir, "v_fields").select("doc_id", F.col("ord").cast("string").alias("id"))
    return R.next_ids(existing, view(spark, sf_dir, "v_blocks").where("style_id = 'Heading1'").select("doc_id", "idx"), "idx")


@query("v_blocks", "SELECT doc_id, name, min(idx) AS ord FROM (SELECT doc_id, idx, substr(text, 1, 1) AS name FROM v_blocks WHERE text <> '') c WHERE NOT EXISTS (SELECT 1 FROM v_blocks e WHERE e.doc_id = c.doc_id AND e.style_id = 'Heading1' AND substr(e.text, 1, 1) = name) GROUP BY 1, 2")
def u04_new_only(spark, sf_dir):
    rows = view(spark, sf_dir, "v_blocks").where("text != ''").withColumn("name", F.substring("text", 1, 1))
    return R.new_only(rows.select("doc_id", "name", F.col("idx").alias("ord")), rows.where("style_id = 'Heading1'")).select("doc_id", "name", "ord")


@query("v_parts", "SELECT DISTINCT page_id AS doc_id, part_name FROM pages CROSS JOIN (VALUES ('[Content_Types].xml'), ('_rels/.rels'), ('word/document.xml')) r(part_name) WHERE (page_id, part_name) NOT IN (SELECT (doc_id, part_name) FROM v_parts)")
def u03_missing_parts(spark, sf_dir):
    need = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.explode(F.array(*map(F.lit, ("[Content_Types].xml", "_rels/.rels", "word/document.xml")))).alias("part_name"))
    return R.missing(need, view(spark, sf_dir, "v_parts"), ["doc_id", "part_name"])


@query("v_sections", "SELECT doc_id, section_idx, CASE WHEN wide THEN 16838 ELSE 11906 END AS page_w_twips, CASE WHEN wide THEN 11906 ELSE 16838 END AS page_h_twips, CASE WHEN wide THEN 'landscape' END AS orient, 1584 AS mar_left FROM (SELECT *, coalesce(orient = 'landscape', false) AS wide FROM v_sections)")
def r01_set_page(spark, sf_dir):
    return R.set_page(view(spark, sf_dir, "v_sections"), "a4", None, {"left": 1.1}).select("doc_id", "section_idx", "page_w_twips", "page_h_twips", "orient", "mar_left")


@query("v_styles", "SELECT doc_id, style_id, CASE WHEN style_id = 'Normal' THEN 14.0 ELSE size_pt END::DOUBLE AS size_pt, CASE WHEN style_id = 'Normal' THEN '仿宋' ELSE east_asia END AS east_asia, CASE WHEN style_id = 'Normal' THEN 'A1B2C3' END AS color FROM v_styles")
def r03_overlay_run(spark, sf_dir):
    styles = view(spark, sf_dir, "v_styles").withColumns({"color": F.lit(None).cast("string"), "size_pt": F.col("size_pt").cast("double")})
    return R.overlay(styles, F.col("style_id") == "Normal", {"size_pt": 14.0, "east_asia": "仿宋", "color": "#a1b2c3"}).select("doc_id", "style_id", "size_pt", "east_asia", "color")


@query("v_sections", "SELECT doc_id, section_idx, CASE section_idx WHEN 0 THEN 'lowerRoman' WHEN 1 THEN 'decimal' ELSE num_fmt END AS num_fmt, CASE WHEN section_idx = 1 THEN 5 ELSE num_start END AS num_start FROM v_sections")
def r06_set_page_numbers(spark, sf_dir):
    return R.set_page_numbers(view(spark, sf_dir, "v_sections"), [(0, "lower-roman", None), (1, "decimal", 5)]).select("doc_id", "section_idx", "num_fmt", "num_start")


PARA_RULES = [
    {"match": {"regex": r"^\d+ \S+", "style_not_in": ["TOC1"]}, "set_style": "Heading1", "replace": (r"^\d+ ", ""), "max_matches": 2},
    {"match": {"regex": r"^[A-Za-z]", "style": "Normal"}, "replace": ("the", "THE"), "all": True},
    {"match": {"contains": "THE", "in_text_box": False}, "replace": ("THE", "The")},
    {"match": {"equals": "目录"}, "remove": True},
]


@query("v_blocks", r"""SELECT doc_id, idx, CASE WHEN h0 THEN 'Heading1' ELSE style_id END AS style_id, CASE WHEN contains(t1, 'THE') AND NOT in_text_box THEN regexp_replace(t1, 'THE', 'The') ELSE t1 END AS text FROM (SELECT *, CASE WHEN regexp_matches(trim(t0), '^[A-Za-z]') AND style_id = 'Normal' THEN replace(t0, 'the', 'THE') ELSE t0 END AS t1 FROM
 (SELECT *, CASE WHEN h0 THEN regexp_replace(text, '^\d+ ', '') ELSE text END AS t0 FROM (SELECT *, m AND sum(CAST(m AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) <= 2 AS h0 FROM (SELECT *, regexp_matches(trim(regexp_replace(text, '\s+', ' ', 'g')), '^\d+ \S+') AND coalesce(style_id, '') <> 'TOC1' AS m FROM v_blocks)))) WHERE trim(t1) <> '目录'""")
def r08_apply_para_rules(spark, sf_dir):
    return R.apply_para_rules(view(spark, sf_dir, "v_blocks"), PARA_RULES).select("doc_id", "idx", "style_id", "text")


@query("v_blocks", "SELECT doc_id, idx, replace(text, '{{TITLE}}', '题目一') AS text FROM v_blocks")
def r09_replacements(spark, sf_dir):
    return view(spark, sf_dir, "v_blocks").select("doc_id", "idx", R.replace_literal(F.col("text"), "{{TITLE}}", "题目一").alias("text"))


@query("v_blocks", "SELECT doc_id, idx, 1 AS ord, 'field' AS kind, 'TOC 1-3' AS value FROM v_blocks WHERE contains(text, '{{TITLE}}') UNION ALL SELECT doc_id, idx, 2, 'text', replace(text, '{{TITLE}}', '') FROM v_blocks WHERE contains(text, '{{TITLE}}') AND text <> '{{TITLE}}'")
def r10_field_rules(spark, sf_dir):
    rows = view(spark, sf_dir, "v_blocks").where(F.col("text").contains("{{TITLE}}"))
    return rows.select("doc_id", "idx", F.posexplode(R.field_segments(F.col("text"), "{{TITLE}}", "TOC 1-3"))).select("doc_id", "idx", (F.col("pos") + 1).alias("ord"), "col.kind", "col.value")


@query("v_blocks", r"""SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS n, concat('图{STYLEREF "Heading 1" \n}-{SEQ 图 \* ARABIC} ', ltrim(regexp_replace(text, '^图\s*\d+(-\d+)?', ''))) AS caption FROM v_blocks WHERE regexp_matches(trim(text), '^图')""")
def r11_captions(spark, sf_dir):
    return R.apply_captions(view(spark, sf_dir, "v_blocks"), {"regex": "^图"}, "图", r"^图\s*\d+(?:-\d+)?", "styleref-as-displayed")


@query("v_blocks", "SELECT doc_id, idx, 'fig_' || row_number() OVER (PARTITION BY doc_id ORDER BY idx) || '_p' || idx AS name FROM v_blocks WHERE starts_with(trim(text), '图')")
def r12_bookmarks(spark, sf_dir):
    found = R.numbered(R.match_rules(view(spark, sf_dir, "v_blocks"), [{"match": {"starts_with": "图"}}]))
    return R.bookmark_names(found, "fig_{index}_p{paragraph}").select("doc_id", "idx", "name")


@query("v_styles v_blocks", "SELECT s.doc_id, s.style_id FROM v_styles s LEFT JOIN (SELECT doc_id, style_id, count(*) AS n FROM v_blocks GROUP BY 1, 2) u ON u.doc_id = s.doc_id AND u.style_id = s.style_id WHERE s.style_id IN ('Normal', 'Heading1', 'Heading2', 'Heading3', 'Heading4', 'Caption', 'TOC1', 'TOC2') OR starts_with(s.style_id, 'Heading') OR coalesce(n, 0) >= 3")
def f08_draft_styles(spark, sf_dir):
    used = S.style_usage(view(spark, sf_dir, "v_blocks")).select("doc_id", "style_id", "n")
    rows = view(spark, sf_dir, "v_styles").join(used, ["doc_id", "style_id"], "left")
    named = F.col("style_id").isin("Normal", "Caption", "TOC1", "TOC2") | F.col("style_id").startswith("Heading")
    return rows.where(named | (F.coalesce("n", F.lit(0)) >= 3)).select("doc_id", "style_id")
