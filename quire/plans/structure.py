"""Queries over blocks: text shapes, kinds and regions, outline, inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import units as U
from quire.operators import structure as S
from quire.plans.registry import query
from quire.sources.views import table, view

WORD_SQL = "[A-Za-z]+(?:[''’-][A-Za-z]+)*"
CJK_SQL = "[㐀-䶿一-鿿]"
COUNT = "len(regexp_extract_all({0}, '{1}'))"


def _rules_sql(rules, subject: str, flags: str = "") -> str:
    return " ".join(f"WHEN regexp_matches({subject}, '{p}') OR regexp_matches(compact, '{p}') THEN '{name}'" for name, p in rules)


LEVEL_SQL = "CASE WHEN style_id IN ('Heading1','1') THEN 1 WHEN style_id IN ('Heading2','2') THEN 2 WHEN style_id IN ('Heading3','3') THEN 3 WHEN style_id IN ('Heading4','4') THEN 4 WHEN style_id IN ('Heading5','5') THEN 5 END"
CLASSIFIED = rf"""
c0 AS (SELECT *, trim(regexp_replace(coalesce(text,''), '\s+', ' ', 'g')) AS t, regexp_replace(coalesce(text,''), '\s+', '', 'g') AS compact, {LEVEL_SQL} AS lv FROM v_blocks),
c1 AS (SELECT *, regexp_matches(coalesce(style_id,''), '(?i)^toc') AS is_toc_style, CASE {_rules_sql(T.REGIONS, "t")} END AS title FROM c0),
c2 AS (SELECT *, CASE WHEN title IS NOT NULL AND (lv IS NULL OR lv IN (1,2) OR length(t) <= 20) THEN title
  WHEN regexp_matches(t, '{T.FIGURE}') THEN 'figure_caption' WHEN regexp_matches(t, '{T.TABLE}') THEN 'table_caption' WHEN regexp_matches(t, '{T.EQUATION}') THEN 'equation'
  WHEN has_drawing AND t = '' THEN 'figure' WHEN in_table THEN 'table_cell'
  WHEN coalesce(lv = 1, false) OR ((lv IS NULL OR lv = 1) AND length(t) < 80 AND regexp_matches(t, '{"|".join(T.CHAPTER)}')) THEN 'chapter'
  WHEN coalesce(lv = 2, false) OR (length(t) < 80 AND regexp_matches(t, '{"|".join(T.SECTION)}')) THEN 'section'
  WHEN coalesce(lv = 3, false) OR (length(t) < 80 AND regexp_matches(t, '{"|".join(T.SUBSECTION)}')) THEN 'subsection'
  WHEN t = '' THEN 'empty' END AS fixed,
  CASE WHEN title IS NOT NULL AND (lv IS NULL OR lv IN (1,2) OR length(t) <= 20) THEN title END AS titled FROM c1),
c3 AS (SELECT *, CASE WHEN is_toc_style THEN 'toc' WHEN titled IS NOT NULL THEN titled WHEN fixed = 'chapter' THEN 'chapter' END AS anchor FROM c2),
c4 AS (SELECT *, in_text_box AND NOT is_toc_style AND coalesce(last_value(CASE WHEN NOT in_text_box OR is_toc_style THEN anchor END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'cover') = 'cover' AS field FROM c3),
c5 AS (SELECT *, coalesce(last_value(CASE WHEN NOT field THEN anchor END IGNORE NULLS) OVER w, 'cover') AS raw,
  max(CASE WHEN fixed = 'chapter' AND NOT is_toc_style AND NOT field THEN 1 ELSE 0 END) OVER w AS seen FROM c4 WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING)),
c6 AS (SELECT *, CASE WHEN raw = 'cover' AND seen = 1 THEN 'chapter' ELSE raw END AS region FROM c5),
c7 AS (SELECT *, coalesce(lag(region) OVER (PARTITION BY doc_id ORDER BY idx), 'cover') AS prior FROM c6),
classified AS (SELECT *, CASE WHEN is_toc_style THEN 'toc_entry' WHEN field THEN 'cover_field' WHEN fixed IS NOT NULL THEN fixed WHEN prior = 'cover' THEN 'cover'
  WHEN starts_with(prior, 'abstract') THEN 'abstract_body' WHEN prior = 'references' THEN 'reference_item' WHEN prior = 'toc' THEN 'toc_entry' ELSE 'body' END AS kind FROM c7)
"""
SUMMARY = (
    "summary AS (SELECT doc_id, count(*) AS paragraphs, count(*) FILTER (kind = 'chapter') AS chapters, count(*) FILTER (kind = 'figure_caption') AS figure_captions, count(*) FILTER (kind = 'table_caption') AS table_captions, count(*) FILTER (kind = 'equation') AS equations, "
    + ", ".join(f"bool_or(kind = '{k}') AS has_{k}" for k in S.REGION_FLAGS)
    + ", bool_or(kind IN ('toc', 'toc_entry')) AS has_toc FROM classified GROUP BY doc_id)"
)


def classified(spark, sf_dir):
    return S.classify(view(spark, sf_dir, "v_blocks"))


@query("", "SELECT page_id, replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script.*?>.*?</script>', ' ', 'gis'), '<style.*?>.*?</style>', ' ', 'gis'), '<br\\s*/?>', chr(10), 'gi'), '</p>', chr(10), 'gi'), '</h[1-6]>', chr(10), 'gi'), '</li>', chr(10), 'gi'), '<[^>]+>', ' ', 'gs'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') AS text FROM pages")
def s05_html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query("v_blocks", rf"""SELECT doc_id, idx, length(text) AS characters, length(regexp_replace(text, '\s+', '', 'g')) AS no_whitespace, {COUNT.format('text', CJK_SQL)} AS cjk, {COUNT.format('text', WORD_SQL)} AS latin_words,
 {COUNT.format('text', CJK_SQL)} + {COUNT.format('text', WORD_SQL)} AS words FROM v_blocks""")
def p06_text_metrics(spark, sf_dir):
    names = dict(zip(T.MODES, ("characters", "no_whitespace", "cjk", "latin_words", "words"), strict=True))
    return view(spark, sf_dir, "v_blocks").select("doc_id", "idx", *[T.text_metric(F.col("text"), F.lit(m)).cast("long").alias(n) for m, n in names.items()])


@query("v_blocks", r"SELECT doc_id, idx, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 120) AS preview FROM v_blocks")
def p07_preview(spark, sf_dir):
    return view(spark, sf_dir, "v_blocks").select("doc_id", "idx", T.preview(F.col("text")).alias("preview"))


@query("v_blocks v_styles", r"""SELECT b.doc_id, idx, coalesce(CASE WHEN b.style_id IN ('Heading1','1') THEN 1 WHEN b.style_id IN ('Heading2','2') THEN 2 WHEN b.style_id IN ('Heading3','3') THEN 3 WHEN b.style_id IN ('Heading4','4') THEN 4 WHEN b.style_id IN ('Heading5','5') THEN 5 END,
 TRY_CAST(regexp_extract(style_name, '(?i)^heading\s*(\d+)$', 1) AS INTEGER), CASE WHEN outline_level BETWEEN 0 AND 8 THEN outline_level + 1 END) AS level
 FROM v_blocks b LEFT JOIN v_styles s ON s.doc_id = b.doc_id AND s.style_id = b.style_id""")
def p15_heading_level(spark, sf_dir):
    rows = S.enrich(view(spark, sf_dir, "v_blocks"), view(spark, sf_dir, "v_styles"))
    return rows.select("doc_id", "idx", T.heading_level(F.col("style_id"), F.col("style_name"), F.col("outline_level")).alias("level"))


@query("v_blocks", rf"SELECT doc_id, idx, CASE {_rules_sql(T.REGIONS, 't')} END AS title FROM (SELECT *, trim(text) AS t, regexp_replace(text, '\s+', '', 'g') AS compact FROM v_blocks)")
def p16_region_title(spark, sf_dir):
    return view(spark, sf_dir, "v_blocks").select("doc_id", "idx", T.region_title(F.col("text")).alias("title"))


@query("v_blocks", f"""SELECT doc_id, idx, regexp_matches(t, '{"|".join(T.CHAPTER)}') AS is_chapter, regexp_matches(t, '{"|".join(T.SECTION)}') AS is_section, regexp_matches(t, '{"|".join(T.SUBSECTION)}') AS is_subsection,
 regexp_matches(t, '{T.FIGURE}') AS is_figure, regexp_matches(t, '{T.TABLE}') AS is_table, regexp_matches(t, '{T.EQUATION}') AS is_equation, starts_with(lower(coalesce(style_id, '')), 'toc') AS is_toc FROM (SELECT *, trim(text) AS t FROM v_blocks)""")
def p17_shape_flags(spark, sf_dir):
    flags = {**T.shape_flags(F.col("text")), "is_toc": T.is_toc(F.col("style_id"), F.lit(None).cast("string"))}
    return view(spark, sf_dir, "v_blocks").select("doc_id", "idx", *[c.alias(n) for n, c in flags.items()])


@query("v_blocks", f"SELECT doc_id, idx, unnest(regexp_extract_all(text, '{T.PLACEHOLDER}')) AS token FROM v_blocks")
def p18_placeholders(spark, sf_dir):
    return view(spark, sf_dir, "v_blocks").select("doc_id", "idx", F.explode(T.placeholders(F.col("text"))).alias("token"))


@query("", f"""SELECT doc_id, type, ord, id, required, min, languages FROM (SELECT doc_id, {"CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{n}'" for n, p in T.TYPES) + " ELSE 'thesis' END"} AS type FROM documents)
 JOIN (VALUES {", ".join(f"('{t}', {i}, '{s[0]}', {str(s[1]).lower()}, {'NULL' if s[2] is None else s[2]}, {'NULL' if s[3] is None else repr(s[3])})" for t, ss in T.TYPE_SECTIONS.items() for i, s in enumerate(ss))}) v(type, ord, id, required, min, languages) USING (type)""")
def p21_type_sections(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.doc_type(F.col("text")).alias("type"))
    wanted = spark.createDataFrame([(t, i, *s) for t, ss in T.TYPE_SECTIONS.items() for i, s in enumerate(ss)], "type string, ord int, id string, required boolean, min int, languages string")
    return rows.join(F.broadcast(wanted), "type").select("doc_id", "type", "ord", "id", "required", "min", "languages")


@query("v_blocks", "SELECT doc_id, idx, CAST(coalesce(sum(CAST(coalesce(section_break, false) AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS section_idx FROM v_blocks")
def w01_assign_sections(spark, sf_dir):
    return S.assign_sections(view(spark, sf_dir, "v_blocks")).select("doc_id", "idx", "section_idx")


@query("v_blocks v_styles", "SELECT b.doc_id, idx, style_name, outline_level, coalesce(b.keep_next, s.keep_next) AS keep_next FROM v_blocks b LEFT JOIN v_styles s ON s.doc_id = b.doc_id AND s.style_id = b.style_id")
def j01_enrich(spark, sf_dir):
    return S.enrich(view(spark, sf_dir, "v_blocks"), view(spark, sf_dir, "v_styles")).select("doc_id", "idx", "style_name", "outline_level", "keep_next")


@query("v_blocks", "SELECT doc_id, idx, kind, region FROM classified", CLASSIFIED)
def w02_classify(spark, sf_dir):
    return classified(spark, sf_dir).select("doc_id", "idx", "kind", "region")


@query("v_blocks", "SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS chapter_no FROM classified WHERE kind = 'chapter'", CLASSIFIED)
def w05_chapter_numbers(spark, sf_dir):
    return S.chapter_numbers(classified(spark, sf_dir)).where("kind = 'chapter'").select("doc_id", "idx", "chapter_no")


@query("v_blocks", """SELECT doc_id, idx, kind, CASE WHEN inner_ THEN ch END AS parent_chapter_idx, CASE WHEN inner_ AND kind <> 'section' AND (ch IS NULL OR se > ch) THEN se END AS parent_section_idx FROM
 (SELECT *, kind IN ('section','subsection','body','figure','figure_caption','table_caption','table_cell','equation','empty') AS inner_, max(CASE WHEN kind = 'chapter' THEN idx END) OVER w AS ch, max(CASE WHEN kind = 'section' THEN idx END) OVER w AS se
 FROM classified WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""", CLASSIFIED)
def w06_outline(spark, sf_dir):
    return S.outline(classified(spark, sf_dir)).select("doc_id", "idx", "kind", "parent_chapter_idx", "parent_section_idx")


@query("v_blocks", "SELECT * FROM summary", f"{CLASSIFIED}, {SUMMARY}")
def a05_summary(spark, sf_dir):
    return S.summarize(classified(spark, sf_dir))


@query("v_blocks", "SELECT doc_id, coalesce(style_id, '(none)') AS style_id, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(idx)) AS rank FROM v_blocks GROUP BY doc_id, coalesce(style_id, '(none)')")
def o01_most_common_styles(spark, sf_dir):
    return S.style_usage(view(spark, sf_dir, "v_blocks")).select("doc_id", "style_id", "n", "rank")


@query("v_blocks", "SELECT doc_id, count(*) AS paragraphs, count(*) FILTER (keep_next IS NOT NULL) AS direct_paragraphs, count(DISTINCT coalesce(style_id, '(none)')) AS styles_used FROM v_blocks GROUP BY doc_id")
def a01_paragraph_inventory(spark, sf_dir):
    return view(spark, sf_dir, "v_blocks").groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.count("keep_next").alias("direct_paragraphs"), F.countDistinct(F.coalesce("style_id", F.lit("(none)"))).alias("styles_used"))


@query("v_blocks", rf"""SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(length(regexp_replace(text, '\s+', '', 'g'))) AS BIGINT) AS no_whitespace, CAST(sum({COUNT.format('text', CJK_SQL)}) AS BIGINT) AS cjk, CAST(sum({COUNT.format('text', WORD_SQL)}) AS BIGINT) AS latin_words FROM v_blocks GROUP BY doc_id""")
def a04_text_inventory(spark, sf_dir):
    return S.text_inventory(view(spark, sf_dir, "v_blocks"))


@query("v_sections", """SELECT doc_id, section_idx, round(page_w_twips/1440.0, 4) AS width_in, round(page_h_twips/1440.0, 4) AS height_in, round(mar_left/1440.0, 4) AS left_in, mar_left/2.0 AS half_pt, round(mar_left*635/914400.0, 4) AS emu_in FROM v_sections""")
def p01_unit_readers(spark, sf_dir):
    c = F.col
    return view(spark, sf_dir, "v_sections").select("doc_id", "section_idx", U.twips_to_in(c("page_w_twips")).alias("width_in"), U.twips_to_in(c("page_h_twips")).alias("height_in"), U.twips_to_in(c("mar_left")).alias("left_in"), U.half_pt_to_pt(c("mar_left")).alias("half_pt"), U.emu_to_in(c("mar_left") * 635).alias("emu_in"))


@query("v_sections", "SELECT doc_id, section_idx, CAST(round_even(round(mar_left/1440.0, 4)*1440, 0) AS BIGINT) AS left_twips, CAST(round_even(mar_left/100.0*20, 0) AS BIGINT) AS pt_twips, CAST(round_even(mar_left/100.0*2, 0) AS BIGINT) AS half_pt, round(mar_left/2.54, 4) AS cm, round(mar_left/25.4, 4) AS mm FROM v_sections")
def p02_unit_writers(spark, sf_dir):
    left = F.col("mar_left")
    return view(spark, sf_dir, "v_sections").select("doc_id", "section_idx", U.in_to_twips(U.twips_to_in(left)).alias("left_twips"), U.pt_to_twips(left / 100).alias("pt_twips"), U.pt_to_half_pt(left / 100).alias("half_pt"), U.cm_to_in(left).alias("cm"), U.mm_to_in(left).alias("mm"))


@query("v_styles", "SELECT doc_id, style_id, bold AS bold, CASE WHEN outline_level IS NOT NULL THEN outline_level::VARCHAR NOT IN ('0', 'false', 'off') END AS outlined FROM v_styles")
def p03_toggles(spark, sf_dir):
    rows = view(spark, sf_dir, "v_styles")
    return rows.select("doc_id", "style_id", U.toggle(F.col("bold").isNotNull(), F.col("bold").cast("string")).alias("bold"), U.toggle(F.col("outline_level").isNotNull(), F.col("outline_level").cast("string")).alias("outlined"))


@query("v_cells", "SELECT table_id, row_idx, cell_idx, CASE cell_idx WHEN 0 THEN width_twips/1440.0 WHEN 1 THEN 6.5*width_twips/5000.0 WHEN 2 THEN 6.5*(text_len::DOUBLE/100) END AS width_in FROM v_cells")
def p08_measure_width(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("dxa"), F.lit("pct"), F.lit("pct"), F.lit("auto")), F.col("cell_idx") + 1)
    raw = F.when(F.col("cell_idx") == 2, F.concat(F.col("text_len").cast("string"), F.lit("%"))).otherwise(F.col("width_twips").cast("string"))
    return view(spark, sf_dir, "v_cells").select("table_id", "row_idx", "cell_idx", U.measure_width(kind, raw, F.lit(6.5)).alias("width_in"))


@query("v_sections", "SELECT doc_id, section_idx, round(page_w_twips/1440.0,4) - round(mar_left/1440.0,4) - round(mar_right/1440.0,4) AS content_width_in, round(page_h_twips/1440.0,4) - round(mar_top/1440.0,4) - round(mar_bottom/1440.0,4) AS content_height_in FROM v_sections")
def p09_content_box(spark, sf_dir):
    t = lambda c: U.twips_to_in(F.col(c))
    w, h = U.content_box(t("page_w_twips"), t("page_h_twips"), t("mar_left"), t("mar_right"), t("mar_top"), t("mar_bottom"))
    return view(spark, sf_dir, "v_sections").select("doc_id", "section_idx", w.alias("content_width_in"), h.alias("content_height_in"))


SIZE_VALUES = ", ".join(f"('{k}', {w}::DOUBLE, {h}::DOUBLE)" for k, (w, h) in U.PAGE_SIZES.items())


@query("v_sections", f"""SELECT doc_id, section_idx, CASE WHEN orient = 'landscape' THEN h ELSE w END AS width_in, CASE WHEN orient = 'landscape' THEN w ELSE h END AS height_in
 FROM (SELECT *, CASE (doc_id + section_idx) % 4 WHEN 0 THEN 'A4' WHEN 1 THEN 'letter' WHEN 2 THEN 'a3' ELSE 'folio' END AS size FROM v_sections) LEFT JOIN (VALUES {SIZE_VALUES}) s(name, w, h) ON name = lower(size)""")
def p10_expected_page_size(spark, sf_dir):
    size = F.element_at(F.array(*map(F.lit, ("A4", "letter", "a3", "folio"))), ((F.col("doc_id") + F.col("section_idx")) % 4 + 1).cast("int"))
    none = F.lit(None).cast("double")
    w, h = U.expected_page_size(size, F.col("orient"), none, none)
    return view(spark, sf_dir, "v_sections").select("doc_id", "section_idx", w.alias("width_in"), h.alias("height_in"))


@query("v_sections", "SELECT doc_id, section_idx, CASE num_fmt WHEN 'upperRoman' THEN 'upper-roman' WHEN 'decimal' THEN 'decimal' END AS profile_format FROM v_sections")
def p11_map_format(spark, sf_dir):
    return view(spark, sf_dir, "v_sections").select("doc_id", "section_idx", U.lookup(F.col("num_fmt"), {v: k for k, v in U.NUMBER_FORMATS.items()}).alias("profile_format"))


@query("v_styles", "SELECT doc_id, style_id, CASE WHEN line_spacing IS NOT NULL THEN 0.25 WHEN coalesce(size_pt, 0) <> 0 THEN round(2*size_pt*20/1440, 4) END AS first_line_in FROM v_styles")
def p13_first_line(spark, sf_dir):
    return view(spark, sf_dir, "v_styles").select("doc_id", "style_id", U.first_line_in(F.when(F.col("line_spacing").isNotNull(), 0.25), F.lit(2.0), F.col("size_pt")).alias("first_line_in"))


@query("v_fields", r"SELECT doc_id, ord, nullif(upper(regexp_extract(instruction, '^\s*([A-Za-z]+)', 1)), '') AS kind, coalesce(upper(regexp_extract(instruction, '^\s*([A-Za-z]+)', 1)) IN ('TOC','PAGE','NUMPAGES','SECTIONPAGES','SEQ','REF','PAGEREF','STYLEREF','CITATION','BIBLIOGRAPHY','NOTEREF','HYPERLINK'), false) AS allowed FROM v_fields")
def p14_field_kind(spark, sf_dir):
    kind = U.field_kind(F.col("instruction"))
    return view(spark, sf_dir, "v_fields").select("doc_id", "ord", kind.alias("kind"), F.coalesce(kind.isin(*U.FIELD_KINDS), F.lit(False)).alias("allowed"))


@query("v_fields", r"SELECT doc_id, coalesce(nullif(upper(regexp_extract(instruction, '^\s*([A-Za-z]+)', 1)), ''), 'UNKNOWN') AS kind, count(*) AS n FROM v_fields GROUP BY 1, 2")
def a02_field_inventory(spark, sf_dir):
    return view(spark, sf_dir, "v_fields").groupBy("doc_id", F.coalesce(U.field_kind(F.col("instruction")), F.lit("UNKNOWN")).alias("kind")).agg(F.count("*").alias("n"))
