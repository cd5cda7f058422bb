"""Queries of profiles, headers and footers, templates, numbering and nested tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import units as U
from quire.operators import marginals as M
from quire.operators import profiles as Q
from quire.operators import rules as R
from quire.operators import templates as P
from quire.plans.compare import INCHES, inches
from quire.plans.registry import query
from quire.sources.views import table, view

# Profiles


TABLE_RULES = """t AS (SELECT profile_id, i, raw::JSON -> ('$.tableRules[' || i || ']') AS r FROM (SELECT profile_id, raw, unnest(range(json_array_length(raw, '$.tableRules')::BIGINT)) AS i FROM v_profiles)),
ti AS (SELECT profile_id, i, from_json(r -> '$.tableIndexes', '["BIGINT"]') AS x FROM t)"""


@query("v_profiles", """SELECT profile_id, '/page/size' AS "at", 'value' AS problem FROM v_profiles WHERE raw::JSON ->> '$.page.size' NOT IN ('a4', 'letter')
 UNION ALL SELECT profile_id, '/page/' || k, 'unknown' FROM (SELECT profile_id, unnest(json_keys(raw, '$.page')) AS k FROM v_profiles) WHERE k NOT IN ('size', 'orientation')
 UNION ALL SELECT profile_id, '/tableRules/' || i, 'one_of' FROM t WHERE (list_contains(json_keys(r), 'widthIn'))::INT + (list_contains(json_keys(r), 'columnWidthsIn'))::INT <> 1
 UNION ALL SELECT profile_id, '/tableRules/' || i || '/tableIndexes', CASE WHEN len(x) < 1 THEN 'items' ELSE 'repeated' END FROM ti WHERE len(x) < 1 OR len(list_distinct(x)) < len(x)
 UNION ALL SELECT profile_id, '/requirements/unresolved', 'items' FROM v_profiles WHERE json_array_length(raw, '$.requirements.unresolved') < 1
 UNION ALL SELECT profile_id, '/' || k, 'missing' FROM v_profiles, (VALUES ('name'), ('title')) v(k) WHERE NOT list_contains(json_keys(raw), k)
 UNION ALL SELECT profile_id, '/name', 'value' FROM v_profiles WHERE length(raw::JSON ->> '$.name') NOT BETWEEN 2 AND 20""", TABLE_RULES)
def q01_check_profiles(spark, sf_dir):
    rules = {
        "": {"type": "object", "required": ["name", "title"]}, "page": {"type": "object", "keys": ["size", "orientation"], "one_of": [["size"], ["widthIn", "heightIn"]]}, "page.size": {"enum": ["a4", "letter"]},
        "tableRules[].tableIndexes": {"type": "array", "min_items": 1, "unique": True}, "tableRules[]": {"one_of": [["widthIn"], ["columnWidthsIn"]]}, "requirements.unresolved": {"min_items": 1}, "name": {"min_length": 2, "max_length": 20},
    }
    return Q.check_profiles(view(spark, sf_dir, "v_profiles"), rules)


@query("v_profiles", """SELECT profile_id, '/tableRules/' || i || '/color' AS "at", 'color' AS problem FROM t WHERE NOT regexp_full_match(r ->> '$.color', '(#?[0-9A-Fa-f]{6}|auto)')
 UNION ALL SELECT profile_id, '/tableRules/' || i || '/outerSizePt', 'eighths' FROM t WHERE abs((r ->> '$.outerSizePt')::DOUBLE * 8 - round((r ->> '$.outerSizePt')::DOUBLE * 8)) >= 1e-9
 UNION ALL SELECT profile_id, '/tableRules/' || i || '/run/sizePt', 'halves' FROM t WHERE abs((r ->> '$.run.sizePt')::DOUBLE * 2 - round((r ->> '$.run.sizePt')::DOUBLE * 2)) >= 1e-9
 UNION ALL SELECT profile_id, '/tableRules/' || i || '/paragraph/' || k, 'negative' FROM t, (VALUES ('lineSpacing'), ('lineSpacingExactPt')) v(k) WHERE (r -> 'paragraph' ->> k)::DOUBLE <= 0
 UNION ALL SELECT profile_id, '/tableRules/' || i || '/paragraph/' || k, 'unsupported' FROM (SELECT profile_id, i, unnest(json_keys(r, '$.paragraph')) AS k FROM t) WHERE k NOT IN ('alignment', 'lineSpacing', 'lineSpacingExactPt', 'spaceBeforePt', 'spaceAfterPt')
 UNION ALL SELECT profile_id, '/tableRules/' || i, 'conflict:lineSpacing:lineSpacingExactPt' FROM t WHERE list_contains(json_keys(r, '$.paragraph'), 'lineSpacing') AND list_contains(json_keys(r, '$.paragraph'), 'lineSpacingExactPt')
 UNION ALL SELECT profile_id, '/tableRules/' || i, 'width_sum' FROM t WHERE abs((r ->> '$.widthIn')::DOUBLE - list_sum(from_json(r -> '$.columnWidthsIn', '["DOUBLE"]'))) > 1 / 1440
 UNION ALL SELECT profile_id, '/tableRules/table=' || v, 'repeated_table' FROM (SELECT profile_id, unnest(x) AS v FROM ti) GROUP BY profile_id, v HAVING count(*) > 1
 UNION ALL SELECT profile_id, '/headingNumbering', 'numbering_lengths' FROM hn WHERE "on" AND NOT even
 UNION ALL SELECT profile_id, '/headingNumbering/patterns/' || (k - 1), 'pattern' FROM (SELECT profile_id, "on" AND even AS sound, unnest(p) AS q, generate_subscripts(p, 1) AS k FROM hn) WHERE sound AND NOT contains(q, '%' || k)
 UNION ALL SELECT profile_id, '/captionNumbering/strategy', 'no_note' FROM v_profiles WHERE raw::JSON ->> '$.captionNumbering.strategy' = 'needs-confirmation' AND json_array_length(raw, '$.requirements.unresolved') = 0
 UNION ALL SELECT profile_id, '/paragraphRules/' || i, 'toc_guard' FROM (SELECT profile_id, i, raw::JSON -> ('$.paragraphRules[' || i || ']') AS r FROM (SELECT profile_id, raw, unnest(range(json_array_length(raw, '$.paragraphRules')::BIGINT)) AS i FROM v_profiles))
  WHERE list_contains(json_keys(r), 'textRegexReplace') AND NOT list_has_any(json_keys(r, '$.match'), ['styleNameNotRegex', 'currentStyleNotIn', 'styleNameRegex'])""",
TABLE_RULES + """,
hn AS (SELECT profile_id, (raw::JSON ->> '$.headingNumbering.enabled') = 'true' AS "on", from_json(raw::JSON -> '$.headingNumbering.patterns', '["VARCHAR"]') AS p,
  json_array_length(raw, '$.headingNumbering.styles') = json_array_length(raw, '$.headingNumbering.patterns') AND json_array_length(raw, '$.headingNumbering.patterns') = json_array_length(raw, '$.headingNumbering.formats') AND json_array_length(raw, '$.headingNumbering.formats') = json_array_length(raw, '$.headingNumbering.starts') AS even FROM v_profiles)""")
def q02_profile_semantics(spark, sf_dir):
    return Q.check_profile_semantics(view(spark, sf_dir, "v_profiles"))


@query("v_profiles", """SELECT profile_id, family, item, property, value FROM (SELECT profile_id, raw::JSON AS j FROM v_profiles), LATERAL (SELECT 'page' AS family, NULL::VARCHAR AS item, 'size' AS property, j->>'$.page.size' AS value UNION ALL SELECT 'tableRules', '0', 'color', j->>'$.tableRules[0].color'
 UNION ALL SELECT 'tableRules', '0', 'sizePt', j->>'$.tableRules[0].run.sizePt' UNION ALL SELECT 'headingNumbering', NULL, 'enabled', j->>'$.headingNumbering.enabled' UNION ALL SELECT 'paragraphRules', '0', 'pattern', 'x' UNION ALL SELECT 'name', NULL, 'name', j->>'$.name') r""")
def s06_rule_rows(spark, sf_dir):
    wanted = ("size", "color", "sizePt", "enabled", "pattern", "name")
    return Q.rule_rows(view(spark, sf_dir, "v_profiles")).where(F.col("property").isin(*wanted)).select("profile_id", "family", "item", "property", "value")


@query("v_profiles", "SELECT profile_id, json_array_length(raw, '$.requirements.unresolved') + json_array_length(raw, '$.requirements.conflicts') = 0 AS free FROM v_profiles")
def f06_gate(spark, sf_dir):
    free, held = Q.gate(view(spark, sf_dir, "v_profiles"))
    return free.select("profile_id", F.lit(True).alias("free")).unionByName(held.select("profile_id", F.lit(False).alias("free")))


# Headers and footers


@query("v_mruns", """SELECT doc_id, part_name, seg - CASE WHEN first = '' THEN 1 ELSE 0 END AS seg, kind, value FROM (SELECT doc_id, part_name, max(CASE WHEN run_ord = 0 THEN text END) AS first, max(CASE WHEN run_ord = 8 THEN text END) AS last FROM v_mruns GROUP BY 1, 2),
 LATERAL (SELECT 1 AS seg, 'text' AS kind, first AS value WHERE first <> '' UNION ALL SELECT 2, 'field', 'PAGE x' UNION ALL SELECT 3, 'text', ' of ' || coalesce(last, '')) s""")
def w20_segments(spark, sf_dir):
    return M.segments(view(spark, sf_dir, "v_mruns")).select("doc_id", "part_name", "seg", "kind", "value")


@query("v_mruns", """SELECT doc_id, part_name, CASE WHEN contains(part_name, 'header') THEN 'header' ELSE 'footer' END AS kind, 1 AS paragraphs, first || ' of ' || coalesce(last, '') AS text, 'PAGE x' AS fields FROM (SELECT doc_id, part_name, max(CASE WHEN run_ord = 0 THEN text END) AS first, max(CASE WHEN run_ord = 8 THEN text END) AS last FROM v_mruns GROUP BY 1, 2)""")
def a21_marginal_inventory(spark, sf_dir):
    rows = M.marginal_inventory(M.segments(view(spark, sf_dir, "v_mruns")))
    return rows.select("doc_id", "part_name", "kind", "paragraphs", "text", F.array_join("fields", "|").alias("fields"))


@query("v_refs v_mruns", """SELECT doc_id, rule, error IS NULL AS ok, error FROM (SELECT d.doc_id, 0 AS rule, CASE WHEN coalesce(n, 0) <> 1 THEN 'reference' WHEN first || ' of ' || coalesce(last, '') <> 'en  of src1' OR first = '' THEN 'content' END AS error FROM (SELECT DISTINCT doc_id FROM v_refs) d LEFT JOIN (SELECT doc_id, count(*) AS n FROM v_refs WHERE section_idx = 0 AND kind = 'header' AND ref_type = 'default' GROUP BY 1) r ON r.doc_id = d.doc_id
  LEFT JOIN (SELECT doc_id, max(CASE WHEN run_ord = 0 THEN text END) AS first, max(CASE WHEN run_ord = 8 THEN text END) AS last FROM v_mruns WHERE part_name = 'word/header1.xml' GROUP BY 1) s ON s.doc_id = d.doc_id
 UNION ALL SELECT DISTINCT doc_id, 1, NULL FROM v_refs)""")
def j09_check_marginals(spark, sf_dir):
    """Every header reference is taken to lead to header1."""
    refs = view(spark, sf_dir, "v_refs").withColumn("part_name", F.lit("word/header1.xml"))
    want = [{"section": 0, "kind": "header", "segments": [[("text", "en "), ("field", "PAGE x"), ("text", " of src1")]]}, {"section": 3, "kind": "footer", "action": "inherit"}]
    return M.check_marginals(refs, M.segments(view(spark, sf_dir, "v_mruns")), want)


LAYOUT = [
    {"section": 0, "kind": "header", "paragraphs": [{"alignment": "justify", "first_line_in": 0, "border": {"color": "#000000"}}]},
    {"section": 1, "kind": "footer", "paragraphs": [{"alignment": "justify"}, {"alignment": "left"}]},
    {"section": 0, "kind": "footer", "type": "even", "paragraphs": []},
]
TARGETS = "tg AS (SELECT f.doc_id, f.section_idx, f.kind, f.ref_type, r.target, split_part(r.rel_type, '/', -1) AS rel_kind, (SELECT count(*) FROM v_mparas p WHERE p.doc_id = f.doc_id AND p.part_name = r.target) AS np FROM v_refs f LEFT JOIN v_rels r ON r.doc_id = f.doc_id AND r.rel_id = f.rel_id)"


@query("v_refs v_rels v_mparas", """SELECT doc_id, rule, concat_ws(',', a, b, c, d, list_aggregate(ps, 'string_agg', ',')) AS errors FROM (SELECT q.*, CASE WHEN t.doc_id IS NULL THEN 'reference' END AS a, CASE WHEN t.doc_id IS NOT NULL AND coalesce(rel_kind, '') <> want THEN 'kind' END AS b, CASE WHEN ty = 'even' AND q.doc_id % 2 = 0 THEN 'even_pages_off' END AS c, CASE WHEN t.doc_id IS NOT NULL AND coalesce(np, 0) <> k THEN 'paragraph_count' END AS d,
  CASE WHEN t.doc_id IS NULL THEN [] WHEN rule = 0 THEN list_filter([CASE WHEN p0.alignment <> 'both' THEN 'paragraph[0].alignment' END, CASE WHEN p0.first_line_in > 0.01 OR coalesce(p0.first_line_chars, 0) <> 0 THEN 'paragraph[0].first_line_in' END, CASE WHEN p0.border_size <> 6 THEN 'paragraph[0].border_size' END, CASE WHEN p0.border_color <> '000000' THEN 'paragraph[0].border_color' END], lambda x: x IS NOT NULL)
   WHEN rule = 1 THEN list_filter([CASE WHEN p0.alignment <> 'both' THEN 'paragraph[0].alignment' END, CASE WHEN p1.alignment <> 'left' THEN 'paragraph[1].alignment' END], lambda x: x IS NOT NULL) ELSE [] END AS ps
 FROM (SELECT doc_id, rule, sec, want, ty, k FROM (SELECT DISTINCT doc_id FROM v_refs) CROSS JOIN (VALUES (0, 0, 'header', 'default', 1), (1, 1, 'footer', 'default', 2), (2, 0, 'footer', 'even', 0)) v(rule, sec, want, ty, k)) q
 LEFT JOIN tg t ON t.doc_id = q.doc_id AND t.section_idx = sec AND t.kind = want AND t.ref_type = ty
 LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, part_name ORDER BY para_idx) AS n FROM v_mparas) p0 ON p0.doc_id = q.doc_id AND p0.part_name = t.target AND p0.n = 1 LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, part_name ORDER BY para_idx) AS n FROM v_mparas) p1 ON p1.doc_id = q.doc_id AND p1.part_name = t.target AND p1.n = 2)""", TARGETS)
def j09_marginal_layout(spark, sf_dir):
    rels = view(spark, sf_dir, "v_rels").select(F.col("doc_id").alias("_d"), F.col("rel_id").alias("_r"), F.col("target").alias("part_name"), F.substring_index("rel_type", "/", -1).alias("rel_kind"))
    refs = view(spark, sf_dir, "v_refs")
    refs = refs.join(rels, (F.col("doc_id") == F.col("_d")) & (F.col("rel_id") == F.col("_r")), "left")
    on = view(spark, sf_dir, "v_sections").select("doc_id", "section_idx", F.lit(True).alias("different_first"), (F.col("doc_id") % 2 == 1).alias("even_and_odd"))
    return M.check_marginal_layout(refs, view(spark, sf_dir, "v_mparas"), on, LAYOUT).withColumn("errors", F.array_join("errors", ","))


@query("v_runs", """SELECT doc_id, idx, bool_and(bold = ((idx + CASE WHEN p >= 4 THEN 1 ELSE 0 END) % 3 = 0)) AS ok FROM (SELECT doc_id, idx, bold, start + unnest(range(length(text))) AS p
 FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id, idx ORDER BY run_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM v_runs)) GROUP BY 1, 2""")
def j10_run_formats(spark, sf_dir):
    """Three runs against two that hold the same text: the second of the two has one format for what the last two of the three hold."""
    runs = R.run_offsets(view(spark, sf_dir, "v_runs"))
    blocks = view(spark, sf_dir, "v_blocks").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    text = F.when(F.col("k") == 0, F.expr("substr(text, 1, 4)")).otherwise(F.expr("substr(text, 5)"))
    want = blocks.select("doc_id", "idx", (F.col("k") * 4).alias("offset"), text.alias("text"), ((F.col("idx") + F.col("k")) % 3 == 0).alias("bold"))
    return M.run_formats_equal(runs, want, ["doc_id", "idx"], "bold")


@query("v_runs", "SELECT doc_id, idx, run_ord, CAST(coalesce(sum(length(text)) OVER (PARTITION BY doc_id, idx ORDER BY run_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ FROM v_runs")
def w11_run_offsets(spark, sf_dir):
    return R.run_offsets(view(spark, sf_dir, "v_runs")).select("doc_id", "idx", "run_ord", F.col("offset").alias("offset_"))


MRULES = "mrules AS (SELECT doc_id, section_idx, kind, 'default' AS ref_type, CASE doc_id % 3 WHEN 0 THEN 'set' WHEN 1 THEN 'clear' END AS action FROM v_sections CROSS JOIN (VALUES ('header'), ('footer')) k(kind) WHERE doc_id % 3 < 2 AND section_idx % 2 = 0)"


@query("v_refs v_sections", """SELECT doc_id, section_idx, kind, ref_type, 'old' AS part_name FROM v_refs f WHERE NOT EXISTS (SELECT 1 FROM mrules m WHERE m.doc_id = f.doc_id AND m.section_idx = f.section_idx AND m.kind = f.kind AND m.ref_type = f.ref_type)
 UNION ALL SELECT doc_id, section_idx, kind, ref_type, 'new' FROM mrules WHERE action = 'set'""", MRULES)
def r13_apply_marginals(spark, sf_dir):
    sections = view(spark, sf_dir, "v_sections").where("doc_id % 3 < 2 AND section_idx % 2 = 0")
    rules = sections.select("doc_id", "section_idx", F.explode(F.array(F.lit("header"), F.lit("footer"))).alias("kind"), F.lit("default").alias("ref_type"), F.when(F.col("doc_id") % 3 == 0, "set").otherwise("clear").alias("action"), F.lit("new").alias("part_name"))
    refs = view(spark, sf_dir, "v_refs").select("doc_id", "section_idx", "kind", "ref_type", F.lit("old").alias("part_name"))
    return M.apply_marginals(refs, rules)


@query("v_refs v_sections", "SELECT doc_id, bool_or(ref_type = 'even') AS even_and_odd, coalesce(string_agg(DISTINCT section_idx::VARCHAR, ',' ORDER BY section_idx::VARCHAR) FILTER (ref_type = 'first'), '') AS first_page_sections FROM v_refs GROUP BY 1")
def r13_switches(spark, sf_dir):
    rows = M.switches(view(spark, sf_dir, "v_refs"))
    return rows.withColumn("first_page_sections", F.array_join(F.array_sort(F.transform("first_page_sections", lambda x: x.cast("string"))), ","))


# Templates and numbering

NUMBERED = """own AS (SELECT s.doc_id, coalesce(s.ilvl, 0) AS ilvl, s.style_id AS style, pattern, format, start, suffix FROM v_nstyles s JOIN v_levels l ON l.doc_id = s.doc_id AND l.abstract_id = 1 AND l.ilvl = coalesce(s.ilvl, 0) WHERE s.num_id = 7),
lists AS (SELECT * FROM own UNION ALL SELECT doc_id, ilvl, p_style, pattern, format, start, suffix FROM v_levels WHERE p_style IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM own))"""


@query("v_nstyles v_levels", """SELECT doc_id, string_agg(style, ',' ORDER BY ilvl) AS styles, string_agg(pattern, ',' ORDER BY ilvl) AS patterns, string_agg(CASE format WHEN 'chineseCounting' THEN 'chinese-counting' ELSE 'decimal' END, ',' ORDER BY ilvl) AS formats, CASE WHEN doc_id % 4 = 0 THEN 'tab' ELSE 'space' END AS suffix,
 CASE WHEN min_by(format, ilvl) = 'chineseCounting' THEN 'styleref-arabic' ELSE 'styleref-as-displayed' END AS strategy FROM lists GROUP BY 1 HAVING bool_and(contains(pattern, '%' || (ilvl + 1)))""", NUMBERED)
def j13_heading_numbering(spark, sf_dir):
    num = table(spark, sf_dir, "documents").select("doc_id", F.lit(7).alias("num_id"), F.lit(1).alias("abstract_id"))
    rows = P.heading_numbering(view(spark, sf_dir, "v_nstyles"), num, view(spark, sf_dir, "v_levels"))
    told = lambda c: F.array_join(c, ",").alias(c)
    return rows.select("doc_id", told("styles"), told("patterns"), told("formats"), "suffix", P.caption_strategy(F.col("formats")).alias("strategy"))


@query("v_levels v_nstyles", "SELECT doc_id, CASE WHEN min(format) FILTER (ilvl = 0) = 'chineseCounting' THEN 'styleref-arabic' ELSE 'styleref-as-displayed' END AS strategy FROM v_levels WHERE abstract_id = 1 GROUP BY 1")
def t03_caption_strategy(spark, sf_dir):
    named = F.when(F.col("format") == "chineseCounting", "chinese-counting").otherwise("decimal")
    rows = view(spark, sf_dir, "v_levels").where("abstract_id = 1").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ilvl", named.alias("f")))), lambda x: x["f"]).alias("formats"))
    return rows.select("doc_id", P.caption_strategy(F.col("formats")).alias("strategy"))


NUMBERING = {"styles": ["Heading1", "Heading2"], "patterns": ["第%1章", "%1.%2"], "formats": ["chineseCounting", "decimal"], "starts": [1, 1], "suffix": "nothing"}
IDS = "ids AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE max(abstract_id) + 1 END AS id FROM v_levels GROUP BY 1)"


@query("v_levels v_nstyles", """SELECT doc_id, abstract_id, ilvl, pattern, p_style FROM v_levels l WHERE NOT EXISTS (SELECT 1 FROM ids i WHERE i.doc_id = l.doc_id AND i.id = l.abstract_id) UNION ALL SELECT doc_id, id, n, CASE n WHEN 0 THEN '第%1章' ELSE '%1.%2' END, 'Heading' || (n + 1) FROM ids CROSS JOIN (VALUES (0), (1)) v(n)""", IDS)
def r07_numbering_lists(spark, sf_dir):
    lists, _ = P.upsert_numbering(view(spark, sf_dir, "v_levels"), view(spark, sf_dir, "v_nstyles"), NUMBERING)
    return lists.select("doc_id", "abstract_id", "ilvl", "pattern", "p_style")


@query("v_levels v_nstyles", "SELECT s.doc_id, style_id, CASE style_id WHEN 'Normal' THEN num_id ELSE id END AS num_id, CASE style_id WHEN 'Heading1' THEN 0 WHEN 'Heading2' THEN 1 ELSE ilvl END AS ilvl FROM v_nstyles s JOIN ids i ON i.doc_id = s.doc_id", IDS)
def r07_numbering_styles(spark, sf_dir):
    _, styles = P.upsert_numbering(view(spark, sf_dir, "v_levels"), view(spark, sf_dir, "v_nstyles"), NUMBERING)
    return styles.select("doc_id", "style_id", "num_id", "ilvl")


@query("v_pprops", """SELECT doc_id, style_id, bad AS refused, CASE WHEN bad THEN alignment ELSE 'both' END AS alignment, CASE WHEN bad THEN line ELSE 400 END AS line, CASE WHEN bad THEN line_rule ELSE 'exact' END AS line_rule, CASE WHEN bad THEN firstLine ELSE 480 END AS first_line, CASE WHEN bad THEN hanging END AS hanging
 FROM (SELECT *, inherited_firstLineChars IS NOT NULL OR inherited_hanging IS NOT NULL AS bad FROM v_pprops)""")
def r04_overlay_para(spark, sf_dir):
    rows = view(spark, sf_dir, "v_pprops")
    longs = {c: F.col(c).cast("long") for c in rows.columns if c not in ("doc_id", "style_id", "alignment", "line_rule")}
    done, refused = P.overlay_para(rows.withColumns(longs), {"alignment": "justify", "line_exact_pt": 20, "first_line_chars": 2}, 12)
    both = done.withColumn("refused", F.lit(False)).unionByName(refused.withColumn("refused", F.lit(True)))
    return both.select("doc_id", "style_id", "refused", "alignment", "line", "line_rule", F.col("firstLine").alias("first_line"), "hanging")


UPSERT = {"Heading1": {"size_pt": 18.0, "first_line_in": 0.3}, "Heading2": {"hanging_in": 0.0}, "Note": {"name": "note", "based_on": "Heading1", "first_line_in": 0.2}, "LoopA": {"first_line_in": 0.1}}


@query("v_styles", """SELECT doc_id, style_id, name, based_on, nxt AS next_style, size_pt, CASE WHEN style_id = 'Heading1' AND doc_id % 4 = 1 THEN 'competing_indent' WHEN style_id = 'Note' AND doc_id % 4 = 1 THEN 'competing_indent' END AS problem FROM (SELECT doc_id, style_id, style_name AS name, based_on, NULL::VARCHAR AS nxt, CASE WHEN style_id = 'Heading1' THEN 18 ELSE size_pt END::DOUBLE AS size_pt FROM v_styles
 UNION ALL SELECT doc_id, 'Note', 'note', 'Heading1', 'Normal', NULL FROM documents)""")
def r05_upsert_checked(spark, sf_dir):
    """Normal has a first line in characters in every fourth document; what is based on it can't have one in inches there."""
    none = F.lit(None).cast("double")
    chars = F.when((F.col("style_id") == "Normal") & (F.col("doc_id") % 4 == 1), 2.0)
    styles = view(spark, sf_dir, "v_styles").select("doc_id", "style_id", F.col("style_name").alias("name"), "based_on", F.lit(None).cast("string").alias("next"), F.col("size_pt").cast("double").alias("size_pt"), none.alias("first_line_in"), none.alias("hanging_in"), chars.alias("first_line_chars"), none.alias("hanging_chars"))
    out = P.upsert_styles_checked(table(spark, sf_dir, "documents"), styles, UPSERT)
    return out.select("doc_id", "style_id", "name", "based_on", F.col("next").alias("next_style"), "size_pt", "problem")


DRAFT = """SELECT doc_id, 'styles' AS family, style_id AS item, 'size_pt' AS property, size_pt::DOUBLE::VARCHAR AS value FROM v_styles WHERE size_pt IS NOT NULL UNION ALL SELECT doc_id, 'styles', style_id, 'east_asia', east_asia FROM v_styles WHERE east_asia IS NOT NULL
 UNION ALL SELECT doc_id, 'pageNumbers', section_idx::VARCHAR, 'format', CASE num_fmt WHEN 'upperRoman' THEN 'upper-roman' ELSE num_fmt END FROM inches WHERE num_fmt IS NOT NULL UNION ALL SELECT doc_id, 'pageNumbers', section_idx::VARCHAR, 'start', num_start::VARCHAR FROM inches WHERE num_start IS NOT NULL
 UNION ALL SELECT doc_id, 'headersFooters', section_idx || ':' || kind || ':' || ref_type, 'action', 'inherit' FROM v_refs UNION ALL SELECT doc_id, 'defaultRun', NULL, 'east_asia', '宋体' FROM documents WHERE doc_id % 3 > 0
 UNION ALL SELECT doc_id, 'page', NULL, 'orientation', CASE WHEN doc_id % 3 = 2 THEN 'landscape' ELSE 'portrait' END FROM documents UNION ALL SELECT doc_id, 'page', NULL, 'size', CASE WHEN doc_id % 3 = 1 THEN 'letter' ELSE 'a4' END FROM documents"""


@query("v_styles v_sections v_refs", DRAFT, INCHES)
def t01_draft_profile(spark, sf_dir):
    defaults = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 > 0, "宋体").alias("east_asia"))
    styles = view(spark, sf_dir, "v_styles").select("doc_id", "style_id", F.col("size_pt").cast("double").alias("size_pt"), "east_asia")
    rows = P.draft_profile(inches(spark, sf_dir), view(spark, sf_dir, "v_refs"), defaults, styles)
    return rows.where(~((F.col("family") == "page") & F.col("property").endswith("_in")))


@query("v_sections v_fields v_blocks", r"""SELECT d.doc_id, concat_ws(',', CASE WHEN d.doc_id % 3 = 0 THEN 'no_east_asian_font' END, CASE WHEN NOT coalesce(n, false) THEN 'no_page_numbers' END, CASE WHEN NOT coalesce(p, false) THEN 'no_placeholders' END, CASE WHEN NOT coalesce(t, false) THEN 'no_toc_field' END) AS notes FROM documents d
 LEFT JOIN (SELECT doc_id, bool_or(num_fmt IS NOT NULL OR num_start IS NOT NULL) AS n FROM v_sections GROUP BY 1) s ON s.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, bool_or(regexp_matches(text, '\{\{[^{}]+\}\}')) AS p FROM v_blocks GROUP BY 1) b ON b.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, bool_or(trim(instruction) LIKE 'TOC%') AS t FROM v_fields GROUP BY 1) f ON f.doc_id = d.doc_id""")
def t04_draft_notes(spark, sf_dir):
    docs, fields = table(spark, sf_dir, "documents"), view(spark, sf_dir, "v_fields")
    tokens = view(spark, sf_dir, "v_blocks").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\{\{[^{}]+\}\}"), F.lit(0))).alias("token"))
    rows = P.draft_notes(docs, docs.select("doc_id", F.when(F.col("doc_id") % 3 > 0, "宋体").alias("east_asia")), view(spark, sf_dir, "v_sections"), tokens, fields.select("doc_id", U.field_kind(F.col("instruction")).alias("kind")))
    return rows.withColumn("notes", F.array_join("notes", ","))


@query("v_sections v_fields v_blocks", r"""SELECT s.doc_id, min_sections, coalesce(styles_used, '') AS styles_used, coalesce(required_fields, '') AS required_fields FROM (SELECT doc_id, count(*) AS min_sections FROM v_sections GROUP BY 1) s LEFT JOIN (SELECT doc_id, string_agg(DISTINCT style_id, ',' ORDER BY style_id) AS styles_used FROM v_blocks WHERE style_id IS NOT NULL GROUP BY 1) b ON b.doc_id = s.doc_id
 LEFT JOIN (SELECT doc_id, string_agg(DISTINCT k, ',' ORDER BY k) AS required_fields FROM (SELECT doc_id, upper(regexp_extract(instruction, '^\s*([A-Za-z]+)', 1)) AS k FROM v_fields) WHERE k IN ('TOC', 'PAGE') GROUP BY 1) f ON f.doc_id = s.doc_id""")
def t04_draft_checks(spark, sf_dir):
    usage = view(spark, sf_dir, "v_blocks").groupBy("doc_id", F.coalesce("style_id", F.lit("(none)")).alias("style_id")).agg(F.count("*").alias("n"))
    fields = view(spark, sf_dir, "v_fields").select("doc_id", U.field_kind(F.col("instruction")).alias("kind"))
    told = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return P.draft_checks(view(spark, sf_dir, "v_sections"), usage, fields).select("doc_id", "min_sections", told("styles_used"), told("required_fields"))


@query("v_dtables", "SELECT doc_id, table_idx, row_number() OVER (PARTITION BY doc_id ORDER BY table_idx) - 1 AS body_idx FROM v_dtables WHERE parent_idx IS NULL AND NOT in_text_box")
def f07_body_tables(spark, sf_dir):
    return P.body_tables(view(spark, sf_dir, "v_dtables")).select("doc_id", "table_idx", "body_idx")


GEOMETRY = """g0 AS (SELECT doc_id, table_idx, 6.0::DOUBLE AS c, coalesce(pref_in, 6.0)::DOUBLE AS w, table_idx AS top, columns FROM v_dtables WHERE parent_idx IS NULL)""" + "".join(
    f""", g{k} AS (SELECT t.doc_id, t.table_idx, coalesce(x.width_in, x.grid_in, p.w / p.columns)::DOUBLE AS c, coalesce(t.pref_in, x.width_in, x.grid_in, p.w / p.columns)::DOUBLE AS w, p.top, t.columns FROM v_dtables t JOIN g{k - 1} p ON p.doc_id = t.doc_id AND p.table_idx = t.parent_idx LEFT JOIN v_dcells x ON x.doc_id = t.doc_id AND x.table_idx = t.parent_idx AND x.cell_idx = t.parent_cell)"""
    for k in (1, 2)
)


@query("v_dtables v_dcells", "SELECT doc_id, table_idx, round(c, 6) AS container_in, round(w, 6) AS width_in, top AS top_idx FROM (SELECT * FROM g0 UNION ALL SELECT * FROM g1 UNION ALL SELECT * FROM g2)", GEOMETRY)
def j14_table_geometry(spark, sf_dir):
    cells = view(spark, sf_dir, "v_dcells").withColumns({"width_in": F.col("width_in").cast("double"), "grid_in": F.col("grid_in").cast("double")})
    rows = P.table_geometry(view(spark, sf_dir, "v_dtables"), cells, F.lit(6.0))
    return rows.select("doc_id", "table_idx", F.round("container_in", 6).alias("container_in"), F.round("width_in", 6).alias("width_in"), "top_idx")


# Small functions and unions


@query("v_styles", "SELECT doc_id, style_id, coalesce(abs(size_pt - 12) <= 0.25, false) AS near, size_pt IS NULL AS both_null, east_asia IS NOT DISTINCT FROM '宋体' AS same FROM v_styles")
def p12_approx(spark, sf_dir):
    size, none = F.col("size_pt").cast("double"), F.lit(None).cast("double")
    return view(spark, sf_dir, "v_styles").select("doc_id", "style_id", U.approx(size, F.lit(12.0), 0.25).alias("near"), U.approx(size, none, 0.25).alias("both_null"), F.col("east_asia").eqNullSafe(F.lit("宋体")).alias("same"))


@query("v_styles", "SELECT doc_id, style_id, CASE style_id WHEN 'Normal' THEN 'own' WHEN 'Heading1' THEN 'STYLEREF \"Heading 1\" \\n' WHEN 'Heading2' THEN 'STYLEREF \"Heading 1\" \\n \\* ARABIC' WHEN 'TOC1' THEN 'SEQ chapter \\* ARABIC' END AS instruction FROM v_styles")
def p25_caption_instruction(spark, sf_dir):
    ways = {"Normal": R.caption_instruction("seq-chapter", own="own"), "Heading1": R.caption_instruction("styleref-as-displayed"), "Heading2": R.caption_instruction("styleref-arabic"), "TOC1": R.caption_instruction("seq-chapter")}
    return view(spark, sf_dir, "v_styles").select("doc_id", "style_id", U.lookup(F.col("style_id"), ways).alias("instruction"))


@query("v_findings v_issues", "SELECT doc_id, family, count(*) AS n FROM (SELECT doc_id, 0 AS family FROM v_findings WHERE category = 'page' UNION ALL SELECT doc_id, 1 FROM v_findings WHERE category = 'run' UNION ALL SELECT doc_id, 2 FROM v_findings WHERE category = 'structure') GROUP BY 1, 2")
def u01_all_findings(spark, sf_dir):
    from quire.operators.job import numbered_union

    rows = view(spark, sf_dir, "v_findings")
    return numbered_union(*[rows.where(F.col("category") == c) for c in ("page", "run", "structure")]).groupBy("doc_id", "family").agg(F.count("*").alias("n"))


@query("v_issues", "SELECT doc_id, family, idx, type FROM (SELECT doc_id, 0 AS family, idx, type FROM v_issues WHERE type <> 'image_overflow' UNION ALL SELECT doc_id, 1, idx, type FROM v_issues WHERE type = 'image_overflow')")
def u02_all_issues(spark, sf_dir):
    from quire.operators.job import numbered_union

    rows = view(spark, sf_dir, "v_issues")
    return numbered_union(rows.where("type != 'image_overflow'"), rows.where("type = 'image_overflow'")).select("doc_id", "family", "idx", "type")
