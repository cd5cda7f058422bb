"""Views over the supplied tables that give them the shape of shredded documents.

Each view is SQL that Spark and DuckDB read alike; only ``v_lines`` differs, as the
engines explode arrays differently. Headings, captions, styles, breaks and cells
are derived from the rows by arithmetic on keys, so the views grow with the tables.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession

_BOTH = {
    "v_blocks": """
SELECT doc_id, idx,
 CASE h WHEN 0 THEN '摘 要' WHEN 1 THEN 'Abstract' WHEN 2 THEN '目录'
  WHEN 3 THEN concat(idx+1,' ',substr(line,1,24)) WHEN 4 THEN concat(idx+1,'.1 ',substr(line,1,24))
  WHEN 5 THEN concat('图 ',idx+1,'-1 ',substr(line,1,16)) WHEN 6 THEN concat('表 ',idx+1,' ',substr(line,1,16))
  WHEN 7 THEN '' WHEN 8 THEN '参考文献' WHEN 9 THEN concat('{{TITLE}} ',line)
  WHEN 10 THEN concat(idx+1,' ',substr(line,1,12),' ',idx+3) WHEN 12 THEN '' ELSE line END AS text,
 CASE WHEN h IN (0,1,2,3,8) THEN 'Heading1' WHEN h=4 THEN 'Heading2' WHEN h=10 THEN 'TOC1'
  WHEN h=11 THEN NULL ELSE 'Normal' END AS style_id,
 h=12 AS has_drawing, CASE WHEN h=12 THEN CAST((doc_id%9)+1 AS DOUBLE) END AS drawing_width_in,
 CASE WHEN h IN (3,4) THEN (doc_id+idx)%2=0 END AS keep_next,
 h IN (13,14) AS in_table, h=15 AS in_text_box, h=22 AS section_break
FROM (SELECT doc_id, idx, line, (doc_id*7+idx*5)%23 AS h FROM v_lines) q
""",
    "v_sections": """
SELECT doc_id, section_idx,
 CASE (doc_id+section_idx)%3 WHEN 0 THEN 11906 WHEN 1 THEN 12240 ELSE 16838 END AS page_w_twips,
 CASE (doc_id+section_idx)%3 WHEN 0 THEN 16838 WHEN 1 THEN 15840 ELSE 11906 END AS page_h_twips,
 CASE WHEN (doc_id+section_idx)%3=2 THEN 'landscape' END AS orient,
 1440 AS mar_top, 1440 AS mar_bottom, 1440 AS mar_right, 1440+((doc_id*3)%5)*72 AS mar_left,
 CASE section_idx%3 WHEN 0 THEN 'upperRoman' WHEN 1 THEN 'decimal' END AS num_fmt,
 CASE WHEN section_idx<2 THEN 1 END AS num_start, (doc_id+section_idx)%2=0 AS has_default_header
FROM documents CROSS JOIN (VALUES (0),(1),(2),(3),(4)) s(section_idx) WHERE section_idx <= doc_id%5
""",
    "v_styles": """
SELECT doc_id, style_id, style_name, based_on, size_pt + CAST(doc_id%2 AS DOUBLE) AS size_pt, east_asia, bold,
 line_spacing, keep_next, outline_level
FROM documents CROSS JOIN (VALUES
 ('Normal','Normal',NULL,12.0,'宋体',NULL,1.5,NULL,NULL),
 ('Heading1','heading 1','Normal',16.0,'黑体',true,NULL,true,0),
 ('Heading2','heading 2','Heading1',NULL,NULL,true,NULL,NULL,1),
 ('TOC1','toc 1','Normal',NULL,NULL,NULL,1.0,NULL,NULL),
 ('LoopA','loop a','LoopB',11.0,NULL,NULL,NULL,NULL,NULL),
 ('LoopB','loop b','LoopA',NULL,'楷体',NULL,NULL,NULL,NULL)
) s(style_id,style_name,based_on,size_pt,east_asia,bold,line_spacing,keep_next,outline_level)
""",
    "v_cells": """
SELECT table_id, row_idx, cell_idx, (l_partkey*(cell_idx+1))%90 AS text_len, 1440+(l_suppkey%4)*360 AS width_twips,
 CASE WHEN cell_idx=0 AND row_idx=0 THEN 2 ELSE 1 END AS grid_span, row_idx < 1+table_id%2 AS is_header,
 l_returnflag='R' AS cant_split, (row_idx%3)*0.25 AS min_height_in,
 CASE WHEN row_idx=0 THEN 12 WHEN row_idx=1 THEN 6 END AS top_sz
FROM (SELECT l_orderkey AS table_id, l_partkey, l_suppkey, l_returnflag,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS row_idx
  FROM lineitem) r CROSS JOIN (VALUES (0),(1),(2),(3)) c(cell_idx)
""",
    "v_tcells": """
SELECT table_id, row_idx, cell_idx, CASE WHEN row_idx=0 AND cell_idx=0 THEN 2 ELSE 1 END AS grid_span,
 CASE WHEN row_idx=0 AND cell_idx=0 AND table_id%3>0 THEN 2880 ELSE 1440 END AS width_twips, (l_partkey*(cell_idx+1))%90 AS text_len,
 row_idx < 1+CASE WHEN table_id%6=5 THEN 1 ELSE 0 END AS is_header, l_partkey%4=1 AS cant_split, (row_idx%3)*0.25 AS min_height_in,
 CASE WHEN table_id%8=1 AND row_idx=1 AND cell_idx=1 THEN 'continue' WHEN table_id%8=1 AND row_idx=0 AND cell_idx=1 THEN 'restart' END AS v_merge,
 CASE WHEN table_id%9=0 THEN 10 ELSE 0 END AS cell_spacing,
 CASE WHEN row_idx=0 THEN CASE WHEN table_id%7=3 THEN 8 ELSE 12 END WHEN row_idx=1 THEN 6 END AS top_sz,
 CASE WHEN row_idx=n_rows-1 THEN CASE WHEN table_id%5=2 THEN 6 ELSE 12 END WHEN row_idx=0 THEN 6 END AS bottom_sz,
 CASE WHEN l_partkey%41=0 THEN 4 END AS left_sz, CAST(NULL AS INT) AS right_sz, CASE WHEN l_partkey%37=0 THEN 'ff0000' ELSE '000000' END AS color,
 CASE WHEN table_id%4=0 THEN 'left' ELSE 'both' END AS alignment, 1.5 - (l_partkey%5)*0.25 AS line_spacing, 10.5 + (l_partkey%2)*0.5 AS size_pt,
 CASE WHEN l_partkey%19=0 THEN 2.0 END AS first_line_chars
FROM (SELECT l_orderkey AS table_id, l_partkey,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS row_idx,
  count(*) OVER (PARTITION BY l_orderkey) AS n_rows
  FROM lineitem) r CROSS JOIN (VALUES (0),(1),(2),(3)) c(cell_idx) WHERE NOT (row_idx=0 AND cell_idx=3 AND table_id%10<>4)
""",
    "v_tables": """
SELECT l_orderkey AS table_id, CASE WHEN l_orderkey%3=0 THEN 'left' ELSE 'center' END AS alignment, 5760 + (l_orderkey%4)*720 AS width_twips, 6.0 + (l_orderkey%5)*0.25 AS container_in
FROM lineitem GROUP BY l_orderkey
""",
    "v_nested": """
SELECT t.table_id, p.table_id AS parent_id, 0 AS parent_row, 1 AS parent_cell
FROM (SELECT l_orderkey AS table_id FROM lineitem GROUP BY l_orderkey) t JOIN (SELECT l_orderkey AS table_id FROM lineitem GROUP BY l_orderkey) p ON p.table_id = t.table_id - 1
WHERE t.table_id%4 IN (1,2)
""",
    "v_runs": """
SELECT doc_id, idx, run_ord, CASE run_ord WHEN 0 THEN substr(text,1,4) WHEN 1 THEN substr(text,5,5) ELSE substr(text,10,100000) END AS text,
 (idx+run_ord)%3=0 AS bold, CASE WHEN (idx+run_ord)%4=0 THEN 10.5 END AS size_pt
FROM v_blocks CROSS JOIN (VALUES (0),(1),(2)) r(run_ord)
""",
    "v_refs": """
SELECT doc_id, section_idx, kind, ref_type, concat('rId', (doc_id+section_idx*3+k)%7) AS rel_id
FROM v_sections CROSS JOIN (VALUES ('header','default',0),('footer','default',1),('header','first',2),('footer','even',3)) r(kind,ref_type,k) WHERE (doc_id+section_idx+k)%3 <> 0
""",
    "v_rels": """
SELECT doc_id, concat('rId', n) AS rel_id, concat('http://x/', CASE WHEN n%2=0 THEN 'header' ELSE 'footer' END) AS rel_type, concat('word/', CASE WHEN n%2=0 THEN 'header' ELSE 'footer' END, n, '.xml') AS target
FROM documents CROSS JOIN (VALUES (0),(1),(2),(3),(4)) r(n)
""",
    "v_objects": """
SELECT doc_id, CASE h WHEN 0 THEN 'tables' WHEN 1 THEN 'drawings' WHEN 2 THEN 'text_boxes' WHEN 3 THEN 'content_controls' WHEN 4 THEN 'insertions'
 WHEN 5 THEN 'deletions' WHEN 6 THEN 'bookmarks' ELSE 'numbering_formats' END AS kind, concat('n', idx%3) AS name
FROM (SELECT doc_id, idx, (doc_id*3+idx*5)%11 AS h FROM v_lines) q WHERE h <= 7
""",
    "v_bookmarks": """
SELECT doc_id, concat('fig_', 1+idx%2) AS name, idx*2 AS id FROM v_blocks WHERE idx%5=0 AND idx < 12
""",
    "v_steps": """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS step_no, concat('s', idx) AS id, action, source, target, property, action='map_structure' AS confirm, visual
FROM (SELECT doc_id, idx, CASE h WHEN 0 THEN 'set_style' WHEN 1 THEN 'set_run' WHEN 2 THEN 'set_page' WHEN 3 THEN 'set_page_number' WHEN 4 THEN 'set_table' WHEN 5 THEN 'set_header_footer' WHEN 6 THEN 'map_structure' ELSE 'set_keep_next' END AS action,
  CASE h WHEN 0 THEN 'styles.Heading1.size_pt' WHEN 1 THEN 'styles.Normal.exists' WHEN 2 THEN 'section[0].widthIn' WHEN 3 THEN concat('pageNumbers.section[',idx%2,']') WHEN 4 THEN concat('tableRules[',idx%3,']') WHEN 5 THEN concat('headersFooters[',idx%3,']')
   WHEN 6 THEN CASE WHEN idx%2=0 THEN 'paragraphRules[0]' ELSE 'document.sections[0]' END ELSE 'orphan_heading' END AS source,
  'target' AS target, CASE h WHEN 0 THEN 'size_pt' WHEN 1 THEN 'exists' ELSE 'x' END AS property, h=7 AS visual
 FROM (SELECT doc_id, idx, (doc_id+idx*3)%13 AS h FROM v_lines) a WHERE h <= 7 AND idx < 6) b
""",
    "v_gnodes": """
SELECT graph_id, ord, CASE WHEN graph_id%13=5 AND ord=0 THEN repeat('n',81) ELSE id END AS id, CASE WHEN (graph_id+ord)%11=3 THEN '  ' WHEN (graph_id+ord)%17=4 THEN repeat('x',201) ELSE text END AS text,
 CASE (graph_id+ord)%9 WHEN 0 THEN 'start' WHEN 1 THEN 'end' WHEN 2 THEN 'decision' WHEN 3 THEN 'cloud' END AS type,
 CASE WHEN graph_id%3=0 OR (graph_id%3=1 AND ord>0) THEN CASE WHEN graph_id%19=6 THEN ord+58 ELSE ord END END AS row,
 CASE WHEN graph_id%3=0 OR (graph_id%3=1 AND ord>1) THEN CASE WHEN graph_id%5=0 THEN 0 ELSE ord%2 END END AS col
FROM v_nodes
""",
    "v_gedges": """
SELECT graph_id, src, dst, CASE WHEN (graph_id+n)%7=0 THEN repeat('y',41) WHEN (graph_id+n)%7=1 THEN '' WHEN (graph_id+n)%7<4 THEN 'yes' END AS label FROM v_edges
""",
    "v_glayout": """
SELECT user_id AS graph_id, CASE k WHEN 0 THEN 'nodeWidthIn' WHEN 1 THEN 'fontSizePt' WHEN 2 THEN 'rowGapIn' ELSE 'depth' END AS key, CAST(user_id%5 AS DOUBLE)*CASE k WHEN 1 THEN 7 WHEN 2 THEN 0.5 ELSE 1 END AS value
FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (VALUES (0),(1),(2),(3)) v(k) WHERE (user_id+k)%4 < 3
""",
    "v_mruns": """
SELECT doc_id, concat('word/', CASE k WHEN 0 THEN 'header1' ELSE 'footer1' END, '.xml') AS part_name, 0 AS para_idx, run_ord, marker, instruction,
 CASE run_ord WHEN 0 THEN CASE WHEN (doc_id+k)%4>0 THEN concat(lang,' ') ELSE '' END WHEN 5 THEN '7' WHEN 7 THEN ' of ' WHEN 8 THEN source END AS text
FROM documents CROSS JOIN (VALUES (0),(1)) p(k) CROSS JOIN (VALUES (0,NULL,NULL),(1,'begin',NULL),(2,NULL,' PA'),(3,NULL,'GE  x '),(4,'separate',NULL),(5,NULL,NULL),(6,'end',NULL),(7,NULL,NULL),(8,NULL,NULL)) r(run_ord,marker,instruction)
""",
    "v_mparas": """
SELECT doc_id, part_name, para_idx, CASE WHEN doc_id%5=0 THEN 'left' ELSE 'both' END AS alignment, CAST((doc_id%3)*0.005 AS DOUBLE) AS first_line_in, CASE WHEN doc_id%7=1 THEN 2.0 END AS first_line_chars, CAST(NULL AS DOUBLE) AS hanging_chars,
 'single' AS border_style, 6 + CASE WHEN doc_id%11=3 THEN 2 ELSE 0 END AS border_size, 1 AS border_space, CASE WHEN doc_id%13=2 THEN 'FF0000' ELSE '000000' END AS border_color
FROM documents CROSS JOIN (VALUES ('word/header0.xml',0),('word/footer1.xml',0),('word/footer1.xml',1),('word/header2.xml',0),('word/footer3.xml',0),('word/header4.xml',0)) p(part_name,para_idx) WHERE (doc_id+para_idx)%17 <> 16
""",
    "v_profiles": """
SELECT doc_id AS profile_id, concat('{"name":"p', doc_id, '","page":{"size":"', CASE WHEN doc_id%5=0 THEN 'a9' ELSE 'a4' END, '"', CASE WHEN doc_id%7=0 THEN ',"colour":1' ELSE '' END, '},"tableRules":[{"tableIndexes":[0,', doc_id%3, '],"color":"', CASE WHEN doc_id%4=0 THEN 'red' ELSE '#00ff00' END,
 '","outerSizePt":', CASE WHEN doc_id%6=1 THEN '1.3' ELSE '1.5' END, ',"columnWidthsIn":[1,1.5],"widthIn":', CASE WHEN doc_id%8=2 THEN '3' ELSE '2.5' END, ',"paragraph":{"lineSpacing":', CASE WHEN doc_id%9=0 THEN '0' ELSE '1.5' END, CASE WHEN doc_id%10=3 THEN ',"lineSpacingExactPt":20' ELSE '' END,
 CASE WHEN doc_id%11=4 THEN ',"shade":1' ELSE '' END, '},"run":{"sizePt":', CASE WHEN doc_id%12=5 THEN '10.3' ELSE '10.5' END, '}}],"headingNumbering":{"enabled":', CASE WHEN doc_id%2=0 THEN 'true' ELSE 'false' END, ',"styles":["a","b"],"patterns":["%1","', CASE WHEN doc_id%3=0 THEN 'x' ELSE '%1.%2' END, '"],"formats":["decimal"',
 CASE WHEN doc_id%14=8 THEN '' ELSE ',"decimal"' END, '],"starts":[1,1]},"captionNumbering":{"strategy":"needs-confirmation"},"requirements":{"unresolved":[', CASE WHEN doc_id%3=1 THEN '"m"' ELSE '' END, '],"conflicts":[]},"paragraphRules":[{"match":{', CASE WHEN doc_id%4=3 THEN '"styleNameNotRegex":"toc"' ELSE '' END, '},"textRegexReplace":{"pattern":"x"}}]}') AS raw
FROM documents
""",
    "v_jobs": """
SELECT doc_id, doc_id%6 AS profile_id FROM documents
""",
    "v_job_profiles": """
SELECT profile_id, concat('{"name":"p', profile_id, '",', CASE profile_id%3
 WHEN 0 THEN concat('"page":{"size":"a4","orientation":"portrait","marginsIn":{"left":1.25}},"sections":[{"section":1,"page":{"marginsIn":{"left":', CASE WHEN profile_id=0 THEN 2 ELSE 1 END, '}}}],"pageNumbers":[{"section":0,"format":"lower-roman","start":1}],"paragraphRules":[{"match":{"textRegex":"^[0-9]+ [^ ]+","currentStyle":"Normal"},"style":"Heading1"},{"match":{"textEquals":"目录"},"remove":true}],"replacements":[{"find":"{{TITLE}}","replace":"题目"},{"find":"[aeiou]{2}","replace":"_","regex":true}],"fieldRules":[{"placeholder":"题目","instruction":"TITLE"},{"placeholder":"th","instruction":"REF x"}],"headersFooters":[{"section":0,"kind":"header","action":"set"}],"tableRules":[{"tableIndexes":[0,9],"outerSizePt":1.5,"color":"#00ff00"},{"tableIndexes":[1],"headerSizePt":0.5},{"tableIndexes":[1,2],"headerRows":2}]')
 WHEN 1 THEN '"page":{"size":"letter"},"paragraphRules":[{"match":{"startsWith":"Abstract"},"textRegexReplace":{"pattern":"[st]","replacement":"#"},"maxMatches":1},{"match":{"inTable":true},"paragraph":{"keepNext":true}},{"match":{"textContains":"#"},"style":"Marked"}],"captionRules":[{"label":"Fig. ","match":{"textRegex":"^图"},"stripPattern":"^图 *[0-9]+(?:-[0-9]+)?"}],"bookmarkRules":[{"name":"cap_{index}","match":{"startsWith":"Fig."},"maxMatches":2},{"name":"fig_1","match":{"startsWith":"Abs"}}],"headersFooters":[{"section":1,"kind":"footer","type":"even","action":"clear"}],"styles":{"TOC1":{"run":{"sizePt":11.5}},"Caption":{"run":{"sizePt":10.5},"paragraph":{"lineSpacing":2}}}'
 ELSE '"pageNumbers":[{"section":1,"format":"upper-roman"}],"replacements":[{"find":"an","replace":"AN","occurrence":"first"}],"tableRules":[{"tableIndexes":[1],"headerRows":2}]' END, '}') AS raw
FROM (SELECT DISTINCT doc_id%6 AS profile_id FROM documents) q
""",
    "v_job_plan": """
SELECT doc_id, family FROM documents CROSS JOIN (VALUES ('page'),('sections'),('pageNumbers'),('styles'),('paragraphRules'),('captionRules'),('bookmarkRules'),('headersFooters'),('tableRules'),('replacements'),('fieldRules')) f(family) WHERE (doc_id+length(family))%4 <> 0
""",
    "v_deep_styles": """
SELECT doc_id, concat('s', k) AS style_id, CASE WHEN k < 199 THEN concat('s', k+1) WHEN doc_id%100=0 THEN 's197' END AS based_on, CASE WHEN (k+doc_id)%7=3 THEN CAST(8+k%9 AS DOUBLE) END AS size_pt, (k*5+doc_id)%11=0 AS bold, k
FROM (SELECT doc_id, a*20+b AS k FROM documents CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9)) x(a) CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12),(13),(14),(15),(16),(17),(18),(19)) y(b) WHERE doc_id%50=0) q
""",
    "v_text_rules": """
SELECT concat('r', doc_id, '-', n) AS rule, CASE (doc_id+n)%3 WHEN 0 THEN 'textContains' WHEN 1 THEN 'textEquals' ELSE 'startsWith' END AS kind,
 CASE WHEN doc_id%40=7 THEN NULL WHEN (doc_id+n)%3=1 THEN trim(substr(text, 1, 40)) ELSE trim(substr(text, CASE n WHEN 0 THEN 1 ELSE 9 END, 7)) END AS literal
FROM documents CROSS JOIN (VALUES (0),(1)) v(n)
""",
    "v_bad_profiles": """
SELECT doc_id AS profile_id, concat('{"name":"', CASE WHEN doc_id%9=1 THEN '' ELSE lang END, '","page":{"size":"', CASE WHEN doc_id%5=0 THEN 'b5' ELSE 'a4' END, '","odd":1,"marginsIn":{"left":', CASE WHEN doc_id%4=2 THEN '"1"' ELSE '1.5' END, CASE WHEN doc_id%7=3 THEN ',"inner":2' ELSE '' END, '}},"sections":[{"section":', doc_id%6-1, '},{', CASE WHEN doc_id%3=0 THEN '' ELSE '"section":2,' END, '"type":"oddPage"}],
"styles":{"Normal":{"run":{"sizePt":', CASE WHEN doc_id%8=4 THEN '"12"' ELSE '12' END, '},"paragraph":{"outlineLevel":', doc_id%11, '}}},"headingNumbering":{"styles":[', CASE WHEN doc_id%10=0 THEN '' ELSE '"a"' END, ']},"tableRules":[{"tableIndexes":[0,', doc_id%5-2, '],"outerSizePt":', doc_id%13, CASE WHEN doc_id%4=1 THEN ',"border":1' ELSE ',"preset":"three-line"' END, '}],
"paragraphRules":[{"match":{"currentStyleNotIn":', CASE doc_id%3 WHEN 0 THEN '"x"' WHEN 1 THEN '["x","y"]' ELSE '[1]' END, '},"maxMatches":', doc_id%3, ',"textRegexReplace":{', CASE WHEN doc_id%2=0 THEN '"pattern":"x"' ELSE '' END, '}}],"validation":{"sectionCount":', CASE WHEN doc_id%5=4 THEN '{"min":1.5}' ELSE concat(doc_id%4, '') END, ',"requiredFields":{"TOC":', doc_id%3-1, '}}}') AS raw
FROM documents
""",
    "v_bcells": """
SELECT doc_id, table_idx, row_idx, cell_idx, 4 AS top_sz, 4 AS bottom_sz, 4 AS left_sz, 4 AS right_sz, '123456' AS color, row_idx=2 AS is_header
FROM documents CROSS JOIN (VALUES (0),(1),(2),(3),(4)) t(table_idx) CROSS JOIN (VALUES (0),(1),(2)) r(row_idx) CROSS JOIN (VALUES (0),(1)) c(cell_idx)
""",
    "v_levels": """
SELECT doc_id, abstract_id, CASE WHEN abstract_id=1 AND doc_id%3=0 THEN 'quire' END AS owner, ilvl, concat(CASE ilvl WHEN 0 THEN '%1' ELSE '%1.%2' END, CASE WHEN doc_id%5=4 AND ilvl=1 THEN 'x' ELSE '' END) AS pattern,
 CASE WHEN doc_id%2=0 AND ilvl=0 THEN 'chineseCounting' ELSE 'decimal' END AS format, 1 AS start, CASE WHEN abstract_id=2 THEN CASE ilvl WHEN 0 THEN 'Heading1' ELSE 'Heading2' END END AS p_style, CASE WHEN doc_id%4=0 THEN 'tab' END AS suffix
FROM documents CROSS JOIN (VALUES (1),(2)) a(abstract_id) CROSS JOIN (VALUES (0),(1)) l(ilvl) WHERE NOT (doc_id%7=6 AND abstract_id=2)
""",
    "v_nstyles": """
SELECT doc_id, style_id, style_name, CASE WHEN doc_id%2=1 AND style_id LIKE 'Heading%' THEN 7 END AS num_id, CASE style_id WHEN 'Heading2' THEN 1 END AS ilvl
FROM v_styles WHERE style_id IN ('Normal','Heading1','Heading2')
""",
    "v_dtables": """
SELECT doc_id, table_idx, CASE WHEN table_idx=1 AND doc_id%3>0 THEN 0 WHEN table_idx=2 AND doc_id%3>1 THEN 1 WHEN table_idx=4 THEN 3 END AS parent_idx, CASE WHEN table_idx IN (1,2,4) THEN table_idx%2 END AS parent_cell,
 CASE WHEN (doc_id+table_idx)%4=0 THEN CAST(3+table_idx AS DOUBLE) END AS pref_in, 2+table_idx%2 AS columns, (doc_id+table_idx)%6=0 AS in_text_box
FROM documents CROSS JOIN (VALUES (0),(1),(2),(3),(4)) t(table_idx)
""",
    "v_dcells": """
SELECT doc_id, table_idx, cell_idx, CASE WHEN (doc_id+table_idx+cell_idx)%3=0 THEN 1.25 END AS width_in, CASE WHEN (doc_id+cell_idx)%2=0 THEN 1.75 END AS grid_in
FROM documents CROSS JOIN (VALUES (0),(1),(2),(3),(4)) t(table_idx) CROSS JOIN (VALUES (0),(1)) c(cell_idx)
""",
    "v_pprops": """
SELECT doc_id, style_id, 'left' AS alignment, 240 AS line, 'auto' AS line_rule, 0 AS before, 0 AS after, CASE WHEN doc_id%3=0 THEN 400 END AS firstLine, CAST(NULL AS INT) AS firstLineChars, CASE WHEN doc_id%3=1 THEN 300 END AS hanging, CAST(NULL AS INT) AS hangingChars,
 CAST(NULL AS INT) AS inherited_firstLine, CASE WHEN doc_id%5=2 THEN 200 END AS inherited_firstLineChars, CASE WHEN doc_id%7=3 THEN 100 END AS inherited_hanging, CAST(NULL AS INT) AS inherited_hangingChars
FROM v_styles
""",
    "v_clauses": """
SELECT doc_id AS spec_id, line_no, CASE line_no
 WHEN 0 THEN concat('正文表格索引',doc_id%4,'、',4+doc_id%7,'采用三线表，',CASE WHEN doc_id%5>0 THEN concat('表头行数',1+doc_id%3,'，') ELSE '' END,'上下线',CASE doc_id%2 WHEN 0 THEN '1.5' ELSE '2.25' END,'磅，表头线 0.',5+doc_id%3*25,' pt')
 WHEN 1 THEN concat('页眉为',CASE WHEN doc_id%2=0 THEN concat('“',source,'”') ELSE source END) WHEN 2 THEN concat('页脚居中',CASE WHEN doc_id%3=0 THEN '页码' ELSE lang END)
 WHEN 3 THEN concat('参考文献按',CASE doc_id%4 WHEN 0 THEN '顺序编码' WHEN 1 THEN 'GB/T 7714' ELSE '字母' END) ELSE concat('页边距',CASE WHEN doc_id%3=1 THEN '：上边距 2cm' ELSE '见附件' END) END AS line
FROM documents CROSS JOIN (VALUES (0),(1),(2),(3),(4)) s(line_no)
""",
    "v_parts": """
SELECT page_id AS doc_id, part_name, length(html)*k AS size
FROM pages CROSS JOIN (VALUES ('[Content_Types].xml',1,7),('_rels/.rels',1,11),('word/document.xml',9,1000),('word/header1.xml',2,3),
 ('word/header2.xml',2,1000),('word/footer1.xml',2,1000),('word/header1.xml',2,5),('word/media/image1.png',20,4)) p(part_name,k,m)
WHERE page_id%m <> 0
""",
    "v_fields": """
SELECT user_id AS doc_id, event_id AS ord, CASE event_type WHEN 'click' THEN ' PAGE ' WHEN 'view' THEN 'TOC 1-3 h'
 WHEN 'signup' THEN 'seq fig ARABIC' WHEN 'purchase' THEN 'REF fig_1' ELSE '12' END AS instruction FROM events
""",
    "v_spec_lines": """
SELECT doc_id AS spec_id, line_no, CASE line_no
 WHEN 0 THEN '纸型为 A4，纵向。' WHEN 1 THEN concat('上边距 ',2+doc_id%3,'cm，下边距 25mm，左边距 1in')
 WHEN 2 THEN '正文宋体小四，行距1.5倍，两端对齐，首行缩进 2 字符。' WHEN 3 THEN concat('一级标题黑体',CASE doc_id%2 WHEN 0 THEN '三号' ELSE '四号' END)
 WHEN 4 THEN '一级标题黑体三号' WHEN 5 THEN '封面填写线长度适当。' WHEN 6 THEN '页边距按学校标准'
 WHEN 7 THEN '正文表格索引0,2采用三线表，表头行数1，上下线1.5磅，表头线0.75磅' ELSE '页眉为学校名称，页脚居中页码' END AS line
FROM documents CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8)) s(line_no) WHERE (doc_id+line_no)%4 <> 0
""",
    "v_findings": """
SELECT doc_id, idx, CASE idx%4 WHEN 0 THEN 'page' WHEN 1 THEN 'run' WHEN 2 THEN 'paragraph' ELSE 'structure' END AS category,
 CASE idx%4 WHEN 0 THEN concat('section[',idx,'].widthIn') WHEN 1 THEN 'styles.Heading1.sizePt' WHEN 2 THEN 'styles.Normal.lineSpacing'
  ELSE concat('document.sections[',idx,'].toc') END AS name, length(text)%3 <> 0 AS ok
FROM v_blocks
""",
    "v_issues": """
SELECT doc_id, idx, type, CASE WHEN type='image_overflow' THEN 'error' ELSE 'warning' END AS severity
FROM v_blocks CROSS JOIN (VALUES ('orphan_heading_risk'),('orphan_heading'),('image_overflow')) t(type)
WHERE (type='orphan_heading_risk' AND style_id LIKE 'Heading%') OR (type='orphan_heading' AND style_id LIKE 'Heading%' AND idx%3=0)
 OR (type='image_overflow' AND drawing_width_in > 6)
""",
    "v_nodes": """
SELECT user_id AS graph_id, event_type AS id, concat('步骤 ',event_type) AS text,
 row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) - 1 AS ord FROM events GROUP BY user_id, event_type
""",
    "v_edges": """
SELECT graph_id, src, dst, count(*) AS n, min(event_id) AS ord
FROM (SELECT user_id AS graph_id, event_id, event_type AS src,
  lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) e
WHERE dst IS NOT NULL GROUP BY graph_id, src, dst
""",
}
_SPARK = {"v_lines": """
SELECT doc_id, idx, line FROM documents LATERAL VIEW posexplode(split(text, '\\n')) t AS idx, line
"""} | _BOTH
_DUCKDB = {"v_lines": """
SELECT doc_id, i-1 AS idx, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
"""} | _BOTH
_NEEDS = {
    "v_runs": ["v_lines", "v_blocks"], "v_refs": ["v_sections"], "v_objects": ["v_lines"], "v_bookmarks": ["v_lines", "v_blocks"], "v_steps": ["v_lines"], "v_gnodes": ["v_nodes"], "v_gedges": ["v_edges"], "v_nstyles": ["v_styles"], "v_pprops": ["v_styles"],
    "v_blocks": ["v_lines"], "v_findings": ["v_lines", "v_blocks"], "v_issues": ["v_lines", "v_blocks"],
}
_TABLES = ("documents", "pages", "lineitem", "events")


def ctes(names: tuple[str, ...], views: dict[str, str] = _DUCKDB) -> str:
    """The views and what they need, as the list of a WITH clause."""
    needed = dict.fromkeys(x for n in names for x in [*_NEEDS.get(n, []), n])
    return ",\n".join(f"{n} AS ({views[n]})" for n in needed)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINES = 1 << 18  # lines of lineitem whose cells one task takes


def _spread(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Lines dealt by their table, over partitions whose number grows with the lines, so that a task sorts no more of them on larger inputs.

    Windows, groups and joins by table_id find their rows in place.
    """
    return lines.repartition(max(spark.sparkContext.defaultParallelism, math.ceil(lines.count() / LINES)), "l_orderkey")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables, which are arguments of the query, so that no name in the session is taken."""
    sql = f"WITH {ctes((name,), _SPARK)} SELECT * FROM {name}"
    given = {t: table(spark, sf_dir, t) for t in _TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", sql)}
    if "PARTITION BY l_orderkey" in sql:
        given["lineitem"] = _spread(spark, given["lineitem"])
    sql = sql.replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub(rf"\b(FROM|JOIN)(\s+)({'|'.join(given)})\b", r"\1\2{\3}", sql), **given)
