"""Drafts from templates, paragraph overlays, nested tables."""

import pytest
from pyspark.sql import functions as F

from quire.operators import templates as P

FIELDS = "k int, alignment string, line long, line_rule string, before long, after long, firstLine long, firstLineChars long, hanging long, hangingChars long, inherited_firstLine long, inherited_firstLineChars long, inherited_hanging long, inherited_hangingChars long"


def rows(spark):
    return spark.createDataFrame([(1, "left", 240, "auto", None, None, None, 200, None, None, None, None, None, None), (2, None, None, None, 10, None, None, None, 300, None, None, 200, None, None)], FIELDS)


def test_overlay(spark):
    done, refused = P.overlay_para(rows(spark), {"alignment": "justify", "line_exact_pt": 20, "space_before_pt": 6, "first_line_chars": 2}, 12)
    assert [r.k for r in refused.collect()] == [2]
    r = done.first()
    assert (r.alignment, r.line, r.line_rule, r.before, r.after, r.firstLine, r.firstLineChars, r.hanging) == ("both", 400, "exact", 120, None, 480, None, None)
    done, refused = P.overlay_para(rows(spark), {"first_line_in": 0, "line_spacing": 1.5})
    assert refused.count() == 0 and {(r.firstLine, r.firstLineChars, r.hanging, r.hangingChars, r.line) for r in done.collect()} == {(0, 0, 0, 0, 360)}
    with pytest.raises(ValueError):
        P.overlay_para(rows(spark), {"line_spacing": 1, "line_exact_pt": 20})


def test_heading_numbering(spark):
    styles = spark.createDataFrame([(1, "Heading1", "heading 1", 7, 0), (1, "Heading2", "heading 2", 7, 1), (1, "Normal", "Normal", 7, 2), (2, "Heading1", "heading 1", None, None), (3, "Heading1", "heading 1", 9, 0)], "doc_id long, style_id string, style_name string, num_id int, ilvl int")
    num = spark.createDataFrame([(1, 7, 3), (3, 9, 1)], "doc_id long, num_id int, abstract_id int")
    levels = spark.createDataFrame([(1, 3, 0, "%1、", "chineseCounting", 1, None, "space"), (1, 3, 1, "%1.%2", "decimal", None, None, None), (2, 5, 0, "%1", "upperRoman", 1, "Heading1", "tab"), (3, 1, 0, "x", "decimal", 1, None, None)], "doc_id long, abstract_id int, ilvl int, pattern string, format string, start int, p_style string, suffix string")
    got = {r.doc_id: r for r in P.heading_numbering(styles, num, levels).collect()}
    assert set(got) == {1, 2}
    assert (got[1].styles, got[1].formats, got[1].starts, got[1].suffix) == (["Heading1", "Heading2"], ["chinese-counting", "decimal"], [1, 1], "space")
    assert (got[2].patterns, got[2].formats, got[2].suffix) == (["%1"], ["upper-roman"], "tab")
    linked = P.set_heading_numbering(styles.where("doc_id = 2"), ["Heading1", "Heading2"], 4).first()
    assert (linked.num_id, linked.ilvl) == (4, 0)
    ways = P.heading_numbering(styles, num, levels).select("doc_id", P.caption_strategy(F.col("formats")).alias("s")).collect()
    assert {r.doc_id: r.s for r in ways} == {1: "styleref-arabic", 2: "styleref-as-displayed"}


def test_drafts(spark):
    sections = spark.createDataFrame([(1, 0, 8.27, 11.69, None, 1.0), (1, 1, 9.0, 9.0, None, 1.0), (2, 0, 9.0, 5.0, None, 0.5)], "doc_id long, section_idx int, width_in double, height_in double, orientation string, left_in double").withColumns({f"{s}_in": F.lit(1.0) for s in ("right", "top", "bottom")})
    got = {r.doc_id: (r["size"], r.width_in, r.orientation) for r in P.draft_page(sections).collect()}
    assert got == {1: ("a4", None, "portrait"), 2: (None, 9.0, "landscape")}
    usage = spark.createDataFrame([(1, "Normal", 3), (1, "(none)", 1)], "doc_id long, style_id string, n long")
    fields = spark.createDataFrame([(1, "TOC"), (1, "SEQ")], "doc_id long, kind string")
    checks = {r.doc_id: (r.min_sections, r.styles_used, r.required_fields) for r in P.draft_checks(sections, usage, fields).collect()}
    assert checks == {1: (2, ["Normal"], ["TOC"]), 2: (1, None, None)}


def test_nested_tables(spark):
    tables = spark.createDataFrame([(1, 0, None, None, None, 2, False), (1, 1, 0, 1, 2.0, 1, False), (1, 2, 1, 0, None, 1, False), (1, 3, None, None, 4.0, 2, False), (1, 4, None, None, None, 1, True)], "doc_id long, table_idx int, parent_idx int, parent_cell int, pref_in double, columns int, in_text_box boolean")
    cells = spark.createDataFrame([(1, 0, 0, None, None), (1, 0, 1, None, None), (1, 1, 0, None, 1.5)], "doc_id long, table_idx int, cell_idx int, width_in double, grid_in double")
    got = {r.table_idx: (r.container_in, r.width_in, r.top_idx) for r in P.table_geometry(tables, cells, F.lit(6.0)).collect()}
    assert got == {0: (6.0, 6.0, 0), 1: (3.0, 2.0, 0), 2: (1.5, 1.5, 0), 3: (6.0, 4.0, 3), 4: (6.0, 6.0, 4)}
    assert [(r.table_idx, r.body_idx) for r in P.body_tables(tables).orderBy("table_idx").collect()] == [(0, 0), (3, 1)]
