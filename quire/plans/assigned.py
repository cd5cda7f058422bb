"""Queries of documents under profiles of their own, each reached by a plan of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import assigned as A
from quire.operators import audit as N
from quire.operators import compare as C
from quire.operators import job as J
from quire.operators import profile_schema as Z
from quire.operators import profiles as Q
from quire.operators import rule_index as X
from quire.operators import rules as R
from quire.operators import templates as P
from quire.plans import compare as D
from quire.plans.registry import query
from quire.plans.structure import CLASSIFIED, SUMMARY
from quire.sources.lineage import shared_path
from quire.sources.views import table, view


def job(spark, sf_dir, plan: bool = True) -> A.Job:
    rules = A.rule_table(view(spark, sf_dir, "v_job_profiles"))
    return A.Job(rules, view(spark, sf_dir, "v_jobs"), view(spark, sf_dir, "v_job_plan") if plan else None)


def on(family: str, planned: bool = True) -> str:
    """SQL: whether the plan reaches the document."""
    return f"(doc_id + {len(family)}) % 4 <> 0" if planned else "true"


def blocks_sql(planned: bool) -> str:
    para, cap, rep = (on(f, planned) for f in ("paragraphRules", "captionRules", "replacements"))
    return rf"""b0 AS (SELECT *, doc_id % 3 AS p, {para} AS po, sum(CASE WHEN starts_with(trim(text), 'Abstract') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS nth FROM v_blocks),
b1 AS (SELECT * REPLACE (CASE WHEN p = 1 AND po AND starts_with(trim(text), 'Abstract') AND nth = 1 THEN regexp_replace(text, '[st]', '#') ELSE text END AS text) FROM b0 WHERE NOT (p = 0 AND po AND trim(text) = '目录')),
b2 AS (SELECT doc_id, idx, p, text, CASE WHEN p = 1 AND po AND in_table THEN true ELSE keep_next END AS keep_next,
  CASE WHEN p = 0 AND po AND style_id = 'Normal' AND regexp_matches(trim(text), '^[0-9]+ [^ ]+') THEN 'Heading1' WHEN p = 1 AND po AND contains(text, '#') THEN 'Marked' ELSE style_id END AS style_id FROM b1),
b3 AS (SELECT * REPLACE (CASE WHEN p = 1 AND {cap} AND regexp_matches(trim(text), '^图') THEN 'Fig. {{SEQ Fig.  \* ARABIC}} ' || ltrim(regexp_replace(text, '^图 *[0-9]+(-[0-9]+)?', '')) ELSE text END AS text) FROM b2),
b4 AS (SELECT * REPLACE (CASE WHEN p = 0 AND {rep} THEN regexp_replace(replace(text, '{{{{TITLE}}}}', '题目'), '[aeiou]{{2}}', '_', 'g') WHEN p = 2 AND {rep} AND contains(text, 'an') THEN left(text, instr(text, 'an') - 1) || 'AN' || substr(text, instr(text, 'an') + 2) ELSE text END AS text) FROM b3)"""


def styled(spark, sf_dir, plan=True):
    return A.standardize(job(spark, sf_dir, plan), {"blocks": view(spark, sf_dir, "v_blocks")})


@query("v_blocks", "SELECT doc_id, idx, style_id, keep_next, text FROM b4", blocks_sql(True))
def r16_own_profile_blocks(spark, sf_dir):
    """Paragraph rules, captions and replacements of three kinds of profiles; each family reaches three documents of four."""
    return styled(spark, sf_dir)["blocks"].select("doc_id", "idx", "style_id", "keep_next", "text")


@query("v_blocks", "SELECT doc_id, idx, style_id, keep_next, text FROM b4", blocks_sql(False))
def r16_own_profile_unplanned(spark, sf_dir):
    return styled(spark, sf_dir, False)["blocks"].select("doc_id", "idx", "style_id", "keep_next", "text")


@query("v_blocks", f"""SELECT doc_id, idx, said, len(list_filter(string_split_regex(said, '⟦[^⟧]*⟧'), lambda x: x <> '')) + len(regexp_extract_all(said, '⟦[^⟧]*⟧')) AS pieces
 FROM (SELECT doc_id, idx, replace(replace(text, '题目', '⟦TITLE⟧'), 'th', '⟦REF x⟧') AS said FROM b4 WHERE p = 0 AND {on('fieldRules')}) WHERE contains(said, '⟦')""", blocks_sql(True))
def r10_fields_of_profiles(spark, sf_dir):
    """Two placeholders of one paragraph become fields of one list."""
    rows = styled(spark, sf_dir)["segments"]
    said = F.array_join(F.transform("segments", lambda s: F.when(s["kind"] == "field", F.concat(F.lit("⟦"), s["value"], F.lit("⟧"))).otherwise(s["value"])), "")
    return rows.select("doc_id", "idx", said.alias("said"), F.size("segments").cast("long").alias("pieces"))


@query("v_sections", f"""SELECT doc_id, section_idx, CASE WHEN p = 0 AND pg THEN 11906 WHEN p = 1 AND pg THEN CASE WHEN wide THEN 15840 ELSE 12240 END ELSE page_w_twips END AS w, CASE WHEN p = 0 AND pg THEN 16838 WHEN p = 1 AND pg THEN CASE WHEN wide THEN 12240 ELSE 15840 END ELSE page_h_twips END AS h,
 CASE WHEN p = 0 AND sc AND section_idx = 1 THEN CASE WHEN doc_id % 6 = 0 THEN 2880 ELSE 1440 END WHEN p = 0 AND pg THEN 1800 ELSE mar_left END AS mar_left, CASE WHEN p = 0 AND pn AND section_idx = 0 THEN 'lowerRoman' WHEN p = 2 AND pn AND section_idx = 1 THEN 'upperRoman' ELSE num_fmt END AS num_fmt, CASE WHEN p = 0 AND pn AND section_idx = 0 THEN 1 ELSE num_start END AS num_start
 FROM (SELECT *, doc_id % 3 AS p, coalesce(orient, '') = 'landscape' AS wide, {on('page')} AS pg, {on('sections')} AS sc, {on('pageNumbers')} AS pn FROM v_sections)""")
def r16_own_profile_sections(spark, sf_dir):
    rows = A.apply_pages(job(spark, sf_dir), view(spark, sf_dir, "v_sections"))
    return rows.select("doc_id", "section_idx", F.col("page_w_twips").alias("w"), F.col("page_h_twips").alias("h"), "mar_left", "num_fmt", "num_start")


@query("v_styles", f"""SELECT doc_id, style_id, based_on, CASE WHEN style_id = 'TOC1' AND doc_id % 3 = 1 AND {on('styles')} THEN 11.5 ELSE size_pt END::DOUBLE AS size_pt, line_spacing::DOUBLE AS line_spacing FROM v_styles
 UNION ALL SELECT doc_id, 'Caption', 'Normal', 10.5, 2.0 FROM documents WHERE doc_id % 3 = 1 AND {on('styles')}""")
def r05_styles_of_profiles(spark, sf_dir):
    rows = view(spark, sf_dir, "v_styles").select("doc_id", "style_id", "based_on", F.col("size_pt").cast("double").alias("size_pt"), F.col("line_spacing").cast("double").alias("line_spacing"))
    return A.apply_styles(job(spark, sf_dir), rows)


@query("v_blocks v_bookmarks", f"""SELECT doc_id, name, id FROM v_bookmarks UNION ALL SELECT c.doc_id, c.name, coalesce(top, -1) + row_number() OVER (PARTITION BY c.doc_id ORDER BY r, n) FROM (SELECT doc_id, name, r, n FROM (SELECT doc_id, r, n, CASE r WHEN 0 THEN 'cap_' || n ELSE 'fig_1' END AS name, row_number() OVER (PARTITION BY doc_id, CASE r WHEN 0 THEN 'cap_' || n ELSE 'fig_1' END ORDER BY r, n) AS k
  FROM (SELECT doc_id, r, row_number() OVER (PARTITION BY doc_id, r ORDER BY idx) AS n FROM (SELECT doc_id, idx, 0 AS r FROM b3 WHERE p = 1 AND {on('bookmarkRules')} AND starts_with(trim(text), 'Fig.') UNION ALL SELECT doc_id, idx, 1 FROM b3 WHERE p = 1 AND {on('bookmarkRules')} AND starts_with(trim(text), 'Abs'))) WHERE r = 1 OR n <= 2) WHERE k = 1) c
 LEFT JOIN (SELECT doc_id, max(id) AS top FROM v_bookmarks GROUP BY 1) t ON t.doc_id = c.doc_id WHERE NOT EXISTS (SELECT 1 FROM v_bookmarks b WHERE b.doc_id = c.doc_id AND b.name = c.name)""", blocks_sql(True))
def r12_bookmarks_of_profiles(spark, sf_dir):
    return A.standardize(job(spark, sf_dir), {"blocks": view(spark, sf_dir, "v_blocks"), "bookmarks": view(spark, sf_dir, "v_bookmarks")})["bookmarks"]


@query("v_refs", f"""SELECT doc_id, section_idx, kind, ref_type, 'old' AS part_name FROM v_refs WHERE NOT ({on('headersFooters')} AND (doc_id % 3 = 0 AND section_idx = 0 AND kind = 'header' AND ref_type = 'default' OR doc_id % 3 = 1 AND section_idx = 1 AND kind = 'footer' AND ref_type = 'even'))
 UNION ALL SELECT doc_id, 0, 'header', 'default', 'rule0' FROM documents WHERE doc_id % 3 = 0 AND {on('headersFooters')}""".replace("FROM v_refs WHERE", "FROM v_refs WHERE"), "")
def r13_marginals_of_profiles(spark, sf_dir):
    refs = view(spark, sf_dir, "v_refs").select("doc_id", "section_idx", "kind", "ref_type", F.lit("old").alias("part_name"))
    return A.apply_marginals(job(spark, sf_dir), refs)


BODY = f"""body AS (SELECT doc_id, table_idx, row_number() OVER (PARTITION BY doc_id ORDER BY table_idx) - 1 AS body_idx FROM v_dtables WHERE parent_idx IS NULL AND NOT in_text_box),
aims AS (SELECT doc_id, body_idx, ord, count(*) OVER (PARTITION BY doc_id, body_idx) AS n FROM documents JOIN (VALUES (0, 0, 0), (0, 9, 0), (0, 1, 1), (0, 1, 2), (0, 2, 2), (2, 1, 0)) a(p, body_idx, ord) ON p = doc_id % 3 WHERE {on('tableRules')}),
tg AS (SELECT a.*, b.table_idx FROM aims a LEFT JOIN body b ON b.doc_id = a.doc_id AND b.body_idx = a.body_idx)"""


def body(spark, sf_dir):
    return P.body_tables(view(spark, sf_dir, "v_dtables"))


@query("v_dtables", "SELECT DISTINCT doc_id, body_idx, CASE WHEN table_idx IS NULL THEN 'missing' ELSE 'conflict' END AS problem FROM tg WHERE table_idx IS NULL OR n > 1", BODY)
def r14_table_problems(spark, sf_dir):
    """Tables that a document hasn't, or that two rules aim at."""
    return A.table_targets(job(spark, sf_dir), body(spark, sf_dir))[1]


@query("v_dtables v_bcells", """SELECT c.doc_id, c.table_idx, row_idx, cell_idx, CASE WHEN t.ord IS NULL THEN top_sz WHEN row_idx = 0 THEN 12 WHEN row_idx = heads THEN 6 END AS top_sz, CASE WHEN t.ord IS NULL THEN bottom_sz WHEN row_idx = 2 THEN 12 WHEN row_idx = heads - 1 THEN 6 END AS bottom_sz,
 CASE WHEN t.ord IS NULL THEN left_sz END AS left_sz, CASE WHEN t.ord IS NULL THEN color WHEN c.doc_id % 3 = 0 AND t.ord = 0 THEN '00FF00' ELSE '000000' END AS color, CASE WHEN t.ord IS NULL THEN is_header ELSE row_idx < heads END AS is_header
 FROM v_bcells c LEFT JOIN (SELECT *, CASE WHEN doc_id % 3 = 0 AND ord = 0 THEN 1 ELSE 2 END AS heads FROM tg WHERE n = 1 AND table_idx IS NOT NULL) t ON t.doc_id = c.doc_id AND t.table_idx = c.table_idx""", BODY)
def r14_tables_of_profiles(spark, sf_dir):
    targets, _ = A.table_targets(job(spark, sf_dir), body(spark, sf_dir))
    rows = A.apply_table_lines(targets, view(spark, sf_dir, "v_bcells"))
    return rows.select("doc_id", "table_idx", "row_idx", "cell_idx", "top_sz", "bottom_sz", "left_sz", "color", "is_header")


@query("", """SELECT d.doc_id, family, count(*) AS rules FROM documents d JOIN (VALUES (0,'page',1),(0,'sections',1),(0,'pageNumbers',1),(0,'paragraphRules',2),(0,'replacements',2),(0,'fieldRules',2),(0,'headersFooters',1),(0,'tableRules',3),(1,'page',1),(1,'paragraphRules',3),(1,'captionRules',1),(1,'bookmarkRules',2),(1,'headersFooters',1),(1,'styles',2),(2,'pageNumbers',1),(2,'replacements',1),(2,'tableRules',1)) r(p, family, k)
 ON p = doc_id % 3, LATERAL (SELECT unnest(range(k))) WHERE (doc_id + length(family)) % 4 <> 0 GROUP BY 1, 2""")
def u03_rules_that_reach(spark, sf_dir):
    """How many rules of which families reach each document, through its profile and its plan."""
    work = job(spark, sf_dir)
    families = [r[0] for r in work.rules.select("family").distinct().orderBy("family").collect() if r[0] != "name"]
    rows = [work.each(f).groupBy("doc_id").agg(F.count("*").alias("rules")).select("doc_id", F.lit(f).alias("family"), "rules") for f in families]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


@query("v_lines v_text_rules", """SELECT doc_id, idx, rule FROM (SELECT doc_id, idx, regexp_replace(trim(line), '\\s+', ' ', 'g') AS t FROM v_lines) l JOIN (SELECT * FROM v_text_rules WHERE literal IS NOT NULL) r
 ON CASE kind WHEN 'textContains' THEN contains(t, literal) WHEN 'textEquals' THEN t = literal ELSE starts_with(t, literal) END""")
def f01_rule_table(spark, sf_dir):
    """Two rules for each document, against every line."""
    return X.match_rule_table(view(spark, sf_dir, "v_lines").withColumnRenamed("line", "text"), view(spark, sf_dir, "v_text_rules"))


@query("v_deep_styles", """SELECT doc_id, style_id, coalesce(size_pt, first_value(size_pt IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), CASE WHEN doc_id % 100 = 0 AND k > 197 THEN first_value(size_pt IGNORE NULLS) OVER (PARTITION BY doc_id, k >= 197 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END) AS size_pt,
 CASE WHEN doc_id % 100 = 0 AND k > 197 THEN sum(bold::INT) OVER (PARTITION BY doc_id, k >= 197) ELSE sum(bold::INT) OVER (PARTITION BY doc_id ORDER BY k DESC) END % 2 = 1 AS bold FROM v_deep_styles""")
def j03_deep_styles(spark, sf_dir):
    """Chains of 200 levels, every second one into a cycle of the last three."""
    return C.effective_styles(view(spark, sf_dir, "v_deep_styles"), ("size_pt",), ("bold",))


@query("v_deep_styles", "SELECT doc_id, style_id, concat('s', ((CASE WHEN doc_id % 100 = 0 AND k + d > 199 THEN 197 + (k + d - 197) % 3 ELSE k + d END))::VARCHAR) AS ancestor, d AS depth FROM v_deep_styles, LATERAL (SELECT unnest(range(200)) AS d) WHERE CASE WHEN doc_id % 100 = 0 THEN d < greatest(200 - k, 3) ELSE k + d <= 199 END")
def j02_deep_chain(spark, sf_dir):
    return C.style_chain(view(spark, sf_dir, "v_deep_styles"))


@query("v_steps", "SELECT doc_id, id, action, target, property, source, confirm, visual FROM v_steps")
def s07_saved_plan(spark, sf_dir):
    """Steps saved as the JSON lines of a plan for each document, and read again."""
    steps, path = view(spark, sf_dir, "v_steps"), shared_path(spark, "plans")
    key = F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("id"))
    steps.select(key.alias("id"), "action", "target", "property", "source", (~F.col("confirm")).alias("auto"), "confirm", "visual").write.json(path)
    rows = Q.read_plan(spark, path)
    return rows.select(F.substring_index("id", "/", 1).cast("long").alias("doc_id"), F.substring_index("id", "/", -1).alias("id"), "action", "target", "property", "source", "confirm", "visual")


@query("v_sections v_styles", "SELECT 'sections' AS name, doc_id, count(*) AS n FROM v_sections GROUP BY doc_id UNION ALL SELECT 'styles', doc_id, count(*) FROM v_styles GROUP BY doc_id")
def s08_run_read_back(spark, sf_dir):
    """A run over an older run: readers get the tables that the manifest names."""
    path = shared_path(spark, "run")
    J.write_run({"sections": view(spark, sf_dir, "v_styles")}, path)
    J.write_run({n: view(spark, sf_dir, f"v_{n}") for n in ("sections", "styles")}, path, force=True)
    tables = J.read_run(spark, path)
    count = lambda n: tables[n].groupBy("doc_id").agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "doc_id", "n")
    return count("sections").unionByName(count("styles"))


PROFILE = {"page": D.PAGE, "pageNumbers": D.PAGE_NUMBERS, "styles": D.STYLES, "structure": T.TYPE_SECTIONS["thesis"]}
PAGES = """changed AS (SELECT doc_id, doc_id % 4 = 1 AND bool_or(page_w_twips <> 11906 OR page_h_twips <> 16838 OR orient IS NOT NULL OR mar_left <> 1584) AS judged FROM v_sections GROUP BY 1),
inches AS (SELECT *, CASE WHEN doc_id % 4 = 1 THEN 8.268 ELSE round(page_w_twips/1440.0, 4) END AS w, CASE WHEN doc_id % 4 = 1 THEN 11.693 ELSE round(page_h_twips/1440.0, 4) END AS h, CASE WHEN doc_id % 4 = 1 THEN 1.1 ELSE round(mar_left/1440.0, 4) END AS l, round(mar_top/1440.0, 4) AS t, CASE WHEN doc_id % 4 <> 1 THEN orient END AS o FROM v_sections),
page AS (SELECT doc_id, ok FROM inches, LATERAL (SELECT abs(w - 8.268) <= 0.05 AS ok UNION ALL SELECT abs(h - 11.693) <= 0.05 UNION ALL SELECT coalesce(o, '') IN ('portrait', '') UNION ALL SELECT abs(l - 1.1) <= 0.05 UNION ALL SELECT abs(t - 1.0) <= 0.05) f),
numbers AS (SELECT d.doc_id, coalesce(CASE sec WHEN 0 THEN num_fmt = 'upperRoman' AND num_start = 1 WHEN 1 THEN num_fmt = 'decimal' AND num_start = 1 ELSE num_fmt IS NOT NULL OR num_start IS NOT NULL END, false) AS ok FROM documents d CROSS JOIN (VALUES (0), (1), (2)) e(sec) LEFT JOIN v_sections s ON s.doc_id = d.doc_id AND s.section_idx = sec)"""


@query("v_blocks v_sections", """SELECT f.doc_id, family, rows, failed, family IN ('page', 'pageNumbers') AND coalesce(judged, false) AS judged FROM (SELECT doc_id, family, count(*) AS rows, count(*) FILTER (NOT ok) AS failed
 FROM (SELECT doc_id, 'page' AS family, ok FROM page UNION ALL SELECT doc_id, 'pageNumbers', ok FROM numbers UNION ALL SELECT doc_id, 'structure', ok FROM structure) GROUP BY 1, 2) f LEFT JOIN changed c ON c.doc_id = f.doc_id""", f"{CLASSIFIED}, {SUMMARY}, {D.STRUCTURE}, {PAGES}")
def n01_audit_again(spark, sf_dir):
    """An audit, new pages for every fourth document, and an audit again: only families and documents whose rows have changed are judged anew."""
    docs, sections, blocks, path = table(spark, sf_dir, "documents"), view(spark, sf_dir, "v_sections"), view(spark, sf_dir, "v_blocks"), shared_path(spark, "audit")
    profile = {k: v for k, v in PROFILE.items() if k != "styles"}
    given = lambda s: {"documents": docs, "sections": D.measured(s), "blocks": blocks}
    N.audit_again(docs, N.families(given(sections), profile), path)
    fits = R.set_page(sections.where("doc_id % 4 = 1"), "a4", "portrait", {"left": 1.1, "top": 1.0})
    run = N.audit_again(docs, N.families(given(sections.where("doc_id % 4 <> 1").unionByName(fits)), profile), path)
    counted = run["findings"].groupBy("doc_id", "family").agg(F.count("*").alias("rows"), F.count_if(~F.col("ok")).alias("failed"))
    return counted.join(run["prints"].select("doc_id", "family", "judged"), ["doc_id", "family"])


@query("v_styles v_blocks v_sections", """SELECT doc_id, family, count(*) AS rows, count(*) FILTER (NOT ok) AS failed FROM (SELECT doc_id, 'pageNumbers' AS family, ok FROM numbers UNION ALL SELECT doc_id, 'structure', ok FROM structure
 UNION ALL SELECT doc_id, 'styles', ok FROM (SELECT d.doc_id, s.*, w.style_id AS want FROM documents d CROSS JOIN (VALUES ('Normal'), ('Heading1'), ('Caption')) w(style_id) LEFT JOIN v_styles s ON s.doc_id = d.doc_id AND s.style_id = w.style_id) q,
  LATERAL (SELECT style_id IS NOT NULL AS ok UNION ALL SELECT abs(size_pt - 12) <= 0.25 WHERE style_id = 'Normal' UNION ALL SELECT east_asia IS NOT DISTINCT FROM '宋体' WHERE style_id = 'Normal' UNION ALL SELECT abs(line_spacing - 1.5) <= 0.06 WHERE style_id = 'Normal'
   UNION ALL SELECT abs(size_pt - 16) <= 0.25 WHERE style_id = 'Heading1' UNION ALL SELECT bold IS NOT DISTINCT FROM true WHERE style_id = 'Heading1' UNION ALL SELECT keep_next IS NOT DISTINCT FROM true WHERE style_id = 'Heading1' UNION ALL SELECT outline_level IS NOT DISTINCT FROM 0 WHERE style_id = 'Heading1') f
 UNION ALL SELECT doc_id, 'page', ok FROM (SELECT *, round(page_w_twips/1440.0, 4) AS w0, round(page_h_twips/1440.0, 4) AS h0, round(mar_left/1440.0, 4) AS l0, round(mar_top/1440.0, 4) AS t0 FROM v_sections), LATERAL (SELECT abs(w0 - 8.268) <= 0.05 AS ok UNION ALL SELECT abs(h0 - 11.693) <= 0.05 UNION ALL SELECT coalesce(orient, '') IN ('portrait', '') UNION ALL SELECT abs(l0 - 1.1) <= 0.05 UNION ALL SELECT abs(t0 - 1.0) <= 0.05) f) GROUP BY 1, 2""", f"{CLASSIFIED}, {SUMMARY}, {D.STRUCTURE}, {PAGES}")
def n01_whole_audit(spark, sf_dir):
    """Findings of pages, page numbers, styles and structure in one run."""
    given = {"documents": table(spark, sf_dir, "documents"), "sections": D.inches(spark, sf_dir), "blocks": view(spark, sf_dir, "v_blocks"), "styles": view(spark, sf_dir, "v_styles")}
    return N.audit(N.families(given, PROFILE)).groupBy("doc_id", "family").agg(F.count("*").alias("rows"), F.count_if(~F.col("ok")).alias("failed"))


@query("v_bad_profiles", """SELECT profile_id, '/name' AS "at", 'length' AS problem FROM j WHERE length(j ->> '$.name') < 1 UNION ALL SELECT profile_id, '/page/size', 'value' FROM j WHERE j ->> '$.page.size' NOT IN ('a3', 'a4', 'a5', 'letter', 'legal', 'tabloid')
 UNION ALL SELECT profile_id, '/page/marginsIn/left', 'type' FROM j WHERE json_type(j, '$.page.marginsIn.left') NOT IN ('DOUBLE', 'UBIGINT', 'BIGINT') UNION ALL SELECT profile_id, '/page/marginsIn/' || k, 'unknown' FROM (SELECT profile_id, unnest(json_keys(j, '$.page.marginsIn')) AS k FROM j) WHERE k NOT IN ('top', 'right', 'bottom', 'left', 'header', 'footer', 'gutter')
 UNION ALL SELECT profile_id, '/sections/' || i || '/section', CASE WHEN json_type(j, '$.sections[' || i || '].section') IS NULL THEN 'missing' ELSE 'range' END FROM j, (VALUES (0), (1)) v(i) WHERE coalesce((j ->> ('$.sections[' || i || '].section'))::INT, -1) < 0
 UNION ALL SELECT profile_id, '/styles/Normal/run/sizePt', 'type' FROM j WHERE json_type(j, '$.styles.Normal.run.sizePt') = 'VARCHAR' UNION ALL SELECT profile_id, '/styles/Normal/paragraph/outlineLevel', 'range' FROM j WHERE (j ->> '$.styles.Normal.paragraph.outlineLevel')::INT > 8
 UNION ALL SELECT profile_id, '/headingNumbering/styles', 'items' FROM j WHERE json_array_length(j, '$.headingNumbering.styles') < 1 UNION ALL SELECT profile_id, '/tableRules/0/tableIndexes/1', 'range' FROM j WHERE (j ->> '$.tableRules[0].tableIndexes[1]')::INT < 0
 UNION ALL SELECT profile_id, '/tableRules/0/outerSizePt', 'range' FROM j WHERE (j ->> '$.tableRules[0].outerSizePt')::DOUBLE NOT BETWEEN 0.25 AND 12 UNION ALL SELECT profile_id, '/tableRules/0/border', 'unknown' FROM j WHERE json_type(j, '$.tableRules[0].border') IS NOT NULL
 UNION ALL SELECT profile_id, '/tableRules/0/preset', 'missing' FROM j WHERE json_type(j, '$.tableRules[0].preset') IS NULL UNION ALL SELECT profile_id, '/paragraphRules/0/match/currentStyleNotIn/0', 'type' FROM j WHERE json_type(j, '$.paragraphRules[0].match.currentStyleNotIn[0]') IN ('UBIGINT', 'BIGINT')
 UNION ALL SELECT profile_id, '/paragraphRules/0/maxMatches', 'range' FROM j WHERE (j ->> '$.paragraphRules[0].maxMatches')::INT < 1 UNION ALL SELECT profile_id, '/paragraphRules/0/textRegexReplace/pattern', 'missing' FROM j WHERE json_type(j, '$.paragraphRules[0].textRegexReplace.pattern') IS NULL
 UNION ALL SELECT profile_id, '/validation/sectionCount', 'range' FROM j WHERE json_type(j, '$.validation.sectionCount') <> 'OBJECT' AND (j ->> '$.validation.sectionCount')::INT < 1 UNION ALL SELECT profile_id, '/validation/sectionCount/min', 'type' FROM j WHERE json_type(j, '$.validation.sectionCount.min') = 'DOUBLE'
 UNION ALL SELECT profile_id, '/validation/requiredFields/TOC', 'range' FROM j WHERE (j ->> '$.validation.requiredFields.TOC')::INT < 0""", "j AS (SELECT profile_id, raw::JSON AS j FROM v_bad_profiles)")
def q01_profile_schema(spark, sf_dir):
    """Profiles with flaws of every kind, against the whole schema."""
    return Z.check_schema(view(spark, sf_dir, "v_bad_profiles"))
