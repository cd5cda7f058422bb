"""Queries of specifications, packages, tables and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import packages as K
from quire.operators import spec as X
from quire.plans.registry import query
from quire.plans.structure import classified  # noqa: F401
from quire.sources.views import table, view

SIZE_SQL = "CASE " + " ".join(f"WHEN contains(line, '{k}') THEN {v}" for k, v in T.SIZES.items()) + r" ELSE TRY_CAST(regexp_extract(line, '(?i)(\d+(?:\.\d+)?)\s*(?:pt|磅|磅字)', 1) AS DOUBLE) END"
FONT_SQL = "CASE " + " ".join(f"WHEN contains(line, '{k}') OR contains(lower(line), '{k}') THEN '{v}'" for k, v in T.FONTS.items()) + " END"
HEAD_SQL = "CASE " + " ".join(f"WHEN regexp_matches(line, '(?i){p}') THEN '{n}'" for n, p in X.HEADINGS.items()) + " END"
EXTRACTED = rf"""f0 AS (SELECT *, CAST({SIZE_SQL} AS DOUBLE) AS size, {FONT_SQL} AS font, {HEAD_SQL} AS heading FROM v_spec_lines),
f1 AS (SELECT *, NOT regexp_matches(line, '(?i)表格|三线表|\btable') AND regexp_matches(line, '(?i)正文|主体|body') AND (font IS NOT NULL OR size IS NOT NULL OR contains(line, '行距') OR contains(line, '倍')) AS body FROM f0),
extracted AS (SELECT spec_id, line_no, target, property, value FROM f1, LATERAL (
 SELECT 'page' AS target, 'size' AS property, 'a4' AS value WHERE regexp_matches(line, '\bA4\b|A4纸|纸型.{{0,4}}A4') UNION ALL SELECT 'page', 'orientation', 'portrait' WHERE regexp_matches(line, '纵向|portrait')
 UNION ALL SELECT 'body', CASE WHEN font IN ('Times New Roman', 'Arial') THEN 'latinFont' ELSE 'eastAsiaFont' END, font WHERE body AND font IS NOT NULL UNION ALL SELECT 'body', 'sizePt', printf('%.4f', size) WHERE body AND size IS NOT NULL
 UNION ALL SELECT 'body', 'lineSpacing', printf('%.4f', TRY_CAST(regexp_extract(line, '(?:行距|行间距)\s*[为是:]?\s*(\d+(?:\.\d+)?)\s*倍', 1) AS DOUBLE)) WHERE body AND regexp_matches(line, '(?:行距|行间距)\s*[为是:]?\s*(\d+(?:\.\d+)?)\s*倍')
 UNION ALL SELECT 'body', 'alignment', 'justify' WHERE body AND contains(line, '两端对齐') UNION ALL SELECT 'body', 'firstLineChars', printf('%.4f', TRY_CAST(regexp_extract(line, '首行缩进\s*(\d+(?:\.\d+)?)\s*字符', 1) AS DOUBLE)) WHERE body AND regexp_matches(line, '首行缩进\s*\d')
 UNION ALL SELECT heading, 'font', coalesce(font, '黑体') WHERE heading IS NOT NULL UNION ALL SELECT heading, 'sizePt', printf('%.4f', size) WHERE heading IS NOT NULL AND size IS NOT NULL
 UNION ALL SELECT 'tableRules', 'preset', 'three-line' WHERE contains(line, '三线表') UNION ALL SELECT 'headersFooters.header', 'present', 'true' WHERE contains(line, '页眉')
 UNION ALL SELECT 'headersFooters.footer', 'page', 'true' WHERE contains(line, '页脚') AND contains(line, '页码')
 UNION ALL SELECT 'page.margins', CASE m[1] WHEN '上' THEN 'top' WHEN '下' THEN 'bottom' WHEN '左' THEN 'left' ELSE 'right' END, printf('%.4f', round(m[2]::DOUBLE / CASE m[3] WHEN 'cm' THEN 2.54::DOUBLE WHEN 'mm' THEN 25.4::DOUBLE ELSE 1.0::DOUBLE END, 4))
  FROM (SELECT unnest(list_transform(regexp_extract_all(line, '{X.MARGIN}'), lambda x: [regexp_extract(x, '{X.MARGIN}', 1), regexp_extract(x, '{X.MARGIN}', 2), regexp_extract(x, '{X.MARGIN}', 3)])) AS m)) r)"""


def lines(spark, sf_dir):
    return view(spark, sf_dir, "v_spec_lines")


def extracted(spark, sf_dir):
    return X.extract_rules(lines(spark, sf_dir))


@query("", r"SELECT doc_id AS spec_id, CAST(i - 1 AS INTEGER) AS line_no, trim(regexp_replace(line, '\s+', ' ', 'g')) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(regexp_replace(line, '\s+', ' ', 'g')) <> ''")
def c01_spec_lines(spark, sf_dir):
    return X.spec_lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("spec_id"), "text"))


@query("v_spec_lines", "SELECT * FROM extracted", EXTRACTED)
def c02_extract_rules(spark, sf_dir):
    return extracted(spark, sf_dir).select("spec_id", "line_no", "target", "property", "value")


@query("v_spec_lines", f"SELECT spec_id, line_no, {FONT_SQL} AS font, CAST({SIZE_SQL} AS DOUBLE) AS size_pt FROM v_spec_lines")
def p19_p20_size_and_font(spark, sf_dir):
    return lines(spark, sf_dir).select("spec_id", "line_no", T.find_font(F.col("line")).alias("font"), T.find_size_pt(F.col("line")).alias("size_pt"))


@query("v_spec_lines", "SELECT spec_id, line_no, '0,2' AS indexes, 1 AS header_rows, 1.5::DOUBLE AS outer_pt, 0.75::DOUBLE AS header_pt FROM v_spec_lines WHERE line_no = 7")
def c03_table_clause(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("t", X.table_clause(F.col("line"))).where("t IS NOT NULL")
    return rows.select("spec_id", "line_no", "t.*")


@query("v_spec_lines", "SELECT spec_id, line_no, CASE line_no WHEN 5 THEN 'vague' WHEN 6 THEN 'margins' ELSE 'header' END AS reason FROM v_spec_lines WHERE line_no IN (5, 6, 8)")
def c04_unresolved(spark, sf_dir):
    return X.unresolved(lines(spark, sf_dir))


CLAUSE = r"""cl AS (SELECT *, regexp_extract(line, '索引(\d+(?:、\d+)*)', 1) AS ix, TRY_CAST(regexp_extract(line, '表头行数(\d+)', 1) AS INTEGER) AS hr, TRY_CAST(regexp_extract(line, '上下线([\d.]+)', 1) AS DOUBLE) AS ol, TRY_CAST(regexp_extract(line, '表头线 ([\d.]+)', 1) AS DOUBLE) AS hl FROM v_clauses)"""


@query("v_clauses", "SELECT spec_id, line_no, replace(ix, '、', ',') AS indexes, hr AS header_rows, ol AS outer_pt, hl AS header_pt FROM cl WHERE ix <> '' AND hr IS NOT NULL", CLAUSE)
def c03_varied_table_clauses(spark, sf_dir):
    rows = view(spark, sf_dir, "v_clauses").withColumn("t", X.table_clause(F.col("line"))).where("t IS NOT NULL")
    return rows.select("spec_id", "line_no", "t.*")


@query("v_clauses", """SELECT spec_id, line_no, reason FROM cl, LATERAL (SELECT 'table' AS reason WHERE contains(line, '三线表') AND hr IS NULL UNION ALL SELECT 'header' WHERE contains(line, '页眉') AND NOT regexp_matches(line, '“[^”]+”') UNION ALL SELECT 'footer' WHERE contains(line, '页脚') AND NOT contains(line, '页码')
 UNION ALL SELECT 'citation' WHERE contains(line, '参考文献') AND regexp_matches(line, '顺序编码|7714') UNION ALL SELECT 'margins' WHERE contains(line, '页边距') AND NOT regexp_matches(line, '边距 \\d+cm')) r""", CLAUSE)
def c04_varied_unresolved(spark, sf_dir):
    return X.unresolved(view(spark, sf_dir, "v_clauses"))


@query("v_spec_lines", """SELECT spec_id, '{' || string_agg('"' || target || '.' || property || '":"' || value || '"', ',' ORDER BY target || '.' || property) || '}' AS profile FROM (SELECT spec_id, target, property, max_by(value, line_no) AS value FROM extracted GROUP BY 1, 2, 3) GROUP BY 1""", EXTRACTED)
def c06_assemble_profile(spark, sf_dir):
    return X.assemble_profile(extracted(spark, sf_dir))


@query("v_spec_lines", """SELECT s.spec_id, property, coalesce(value, def) AS value, value IS NULL AS assumed FROM (SELECT DISTINCT spec_id FROM extracted) s CROSS JOIN (VALUES ('eastAsiaFont', '宋体'), ('sizePt', '12.0000'), ('lineSpacing', '1.5000'), ('alignment', 'justify'), ('firstLineChars', '2.0000')) d(property, def)
 LEFT JOIN (SELECT spec_id, property, max_by(value, line_no) AS value FROM extracted WHERE target = 'body' GROUP BY 1, 2) USING (spec_id, property)""", EXTRACTED)
def c05_fill_defaults(spark, sf_dir):
    return X.fill_defaults(extracted(spark, sf_dir))


@query("v_spec_lines", "SELECT spec_id, target, property, max_by(value, line_no) AS value FROM extracted GROUP BY 1, 2, 3", EXTRACTED)
def c06_last_values(spark, sf_dir):
    return X.last_values(extracted(spark, sf_dir))


@query("v_spec_lines", "SELECT spec_id, line_no, target, property, previous, value FROM (SELECT *, lag(value) OVER (PARTITION BY spec_id, target, property ORDER BY line_no) AS previous FROM extracted) WHERE previous <> value", EXTRACTED)
def w12_rule_conflicts(spark, sf_dir):
    return X.rule_conflicts(extracted(spark, sf_dir)).select("spec_id", "line_no", "target", "property", "previous", "value")


@query("v_spec_lines", "SELECT spec_id, target, property, min_by(value, line_no) AS value FROM extracted GROUP BY 1, 2, 3", EXTRACTED)
def w13_first_per_key(spark, sf_dir):
    return X.first_per_key(extracted(spark, sf_dir), ["spec_id", "target", "property"], ["line_no", "ord"]).select("spec_id", "target", "property", "value")


@query("v_parts", "SELECT doc_id, 'duplicate' AS problem, part_name FROM v_parts GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT page_id, 'missing', r FROM pages CROSS JOIN (VALUES ('[Content_Types].xml'), ('_rels/.rels'), ('word/document.xml')) v(r) WHERE (page_id, r) NOT IN (SELECT (doc_id, part_name) FROM v_parts)")
def s02_check_packages(spark, sf_dir):
    return K.check_packages(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id")), view(spark, sf_dir, "v_parts"))


@query("v_parts", "SELECT doc_id, part_name, CASE WHEN doc_id % 3 = 0 THEN part_name WHEN doc_id % 3 = 1 THEN 'word/' || part_name ELSE part_name END AS target FROM v_parts")
def s03_resolve_rels(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/"), F.col("part_name"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("media/../"), F.col("part_name"))).otherwise(F.concat(F.lit("../"), F.col("part_name")))
    return view(spark, sf_dir, "v_parts").select("doc_id", "part_name", K.resolve_target(raw).alias("target"))


@query("v_parts", "SELECT doc_id, count(*) AS parts, count(*) FILTER (part_name LIKE 'word/media/%') AS images, count(*) FILTER (regexp_matches(part_name, '^word/(header|footer)')) AS marginals, CAST(sum(size) AS BIGINT) AS bytes FROM v_parts GROUP BY 1")
def a03_content_inventory(spark, sf_dir):
    name = F.col("part_name")
    return view(spark, sf_dir, "v_parts").groupBy("doc_id").agg(F.count("*").alias("parts"), F.count_if(name.startswith("word/media/")).alias("images"), F.count_if(name.rlike("^word/(header|footer)")).alias("marginals"), F.sum("size").alias("bytes"))


@query("v_parts", "SELECT doc_id, string_agg(DISTINCT part_name, ',' ORDER BY part_name) AS names FROM v_parts GROUP BY 1")
def o03_sorted_parts(spark, sf_dir):
    return view(spark, sf_dir, "v_parts").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("part_name")), ",").alias("names"))


TROWS = "trows AS (SELECT table_id, row_idx, any_value(is_header) AS is_header, any_value(top_sz) AS top_sz FROM v_cells GROUP BY 1, 2), roles AS (SELECT *, row_idx = max(row_idx) OVER (PARTITION BY table_id) AS last, least(1 + table_id % 2, count(*) OVER (PARTITION BY table_id)) AS headers FROM trows)"


def table_rows(spark, sf_dir):
    return view(spark, sf_dir, "v_cells").groupBy("table_id", "row_idx").agg(F.first("is_header").alias("is_header"), F.first("top_sz").alias("top_sz"))


@query("v_cells", "SELECT table_id, count(*) FILTER (top_sz IS DISTINCT FROM CASE WHEN row_idx = headers THEN 6 WHEN row_idx = 0 THEN 12 END) AS wrong, count(*) FILTER (top_sz IS DISTINCT FROM CASE WHEN row_idx = headers THEN 6 WHEN row_idx = 0 THEN 12 END) = 0 AS ok FROM roles GROUP BY 1", TROWS)
def j15_check_table_borders(spark, sf_dir):
    return K.check_table_borders(table_rows(spark, sf_dir))


@query("v_cells", "SELECT table_id, row_idx, CASE WHEN row_idx = headers THEN 6 WHEN row_idx = 0 THEN 12 END AS top_sz, CASE WHEN last THEN 12 WHEN row_idx = headers - 1 THEN 6 END AS bottom_sz FROM roles", TROWS)
def r14_apply_tables(spark, sf_dir):
    return K.apply_tables(table_rows(spark, sf_dir)).select("table_id", "row_idx", "top_sz", "bottom_sz")


@query("v_cells", "SELECT table_id, max(headers) AS header_rows, 1.5::DOUBLE AS outer_pt FROM roles GROUP BY 1 HAVING max(headers) < count(*)", TROWS)
def a20_infer_tables(spark, sf_dir):
    return K.infer_tables(table_rows(spark, sf_dir))


@query("v_edges", "SELECT graph_id, dst, count(*) AS n FROM v_edges GROUP BY 1, 2 HAVING count(*) > 1")
def a19_duplicates(spark, sf_dir):
    return K.duplicates(view(spark, sf_dir, "v_edges"), ["graph_id", "dst"])


@query("v_nodes v_edges", "SELECT DISTINCT graph_id, problem FROM (SELECT graph_id, 'node_count' AS problem FROM v_nodes GROUP BY 1 HAVING count(*) > 4 UNION ALL SELECT graph_id, 'edge_count' FROM v_edges GROUP BY 1 HAVING count(*) > 18)")
def g01_check_graphs(spark, sf_dir):
    return K.check_graphs(view(spark, sf_dir, "v_nodes"), view(spark, sf_dir, "v_edges"), 4, 18)


REACH = "reach AS (SELECT * FROM (WITH RECURSIVE r(graph_id, a, b) AS (SELECT graph_id, src, dst FROM v_edges UNION SELECT r.graph_id, r.a, e.dst FROM r JOIN v_edges e ON e.graph_id = r.graph_id AND e.src = r.b) SELECT * FROM r)), back AS (SELECT e.graph_id, e.src, e.dst FROM v_edges e JOIN v_nodes s ON s.graph_id = e.graph_id AND s.id = e.src JOIN v_nodes d ON d.graph_id = e.graph_id AND d.id = e.dst WHERE d.ord <= s.ord AND (e.graph_id, e.dst, e.src) IN (SELECT (graph_id, a, b) FROM reach))"


@query("v_nodes v_edges", "SELECT * FROM back", REACH)
def g02_return_edges(spark, sf_dir):
    return K.return_edges(view(spark, sf_dir, "v_nodes"), view(spark, sf_dir, "v_edges"))


@query("v_nodes v_edges", """SELECT graph_id, id, row, 2 * (row_number() OVER (PARTITION BY graph_id, row ORDER BY ord) - 1) + max(width) OVER (PARTITION BY graph_id) - width AS col FROM (SELECT *, count(*) OVER (PARTITION BY graph_id, row) AS width FROM (SELECT n.graph_id, n.id, n.ord, max(lv) AS row FROM
 (WITH RECURSIVE p(graph_id, id, lv) AS (SELECT graph_id, id, 0 FROM v_nodes UNION SELECT f.graph_id, f.dst, p.lv + 1 FROM p JOIN fwd f ON f.graph_id = p.graph_id AND f.src = p.id) SELECT * FROM p) q JOIN v_nodes n ON n.graph_id = q.graph_id AND n.id = q.id GROUP BY 1, 2, 3))""", REACH + ", fwd AS (SELECT graph_id, src, dst FROM v_edges WHERE (graph_id, src, dst) NOT IN (SELECT (graph_id, src, dst) FROM back))")
def g03_grid_positions(spark, sf_dir):
    nodes, edges = view(spark, sf_dir, "v_nodes"), view(spark, sf_dir, "v_edges")
    forward = edges.join(K.return_edges(nodes, edges), ["graph_id", "src", "dst"], "left_anti")
    return K.grid_positions(nodes, forward)
