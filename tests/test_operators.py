"""Small literal cases of the operators."""

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import units as U
from quire.operators import compare as C
from quire.operators import layout as L
from quire.operators import packages as K
from quire.operators import planning as P
from quire.operators import rules as R
from quire.operators import spec as X
from quire.operators import structure as S

BLOCK = "doc_id long, idx int, style_id string, text string, has_drawing boolean, in_table boolean, in_text_box boolean"


def thesis(spark):
    lines = [("Normal", "题目"), ("Heading1", "摘要"), ("Heading1", "Abstract"), ("Heading1", "目录"), ("TOC1", "1 绪论 1"), ("Heading1", "1 绪论"), ("Normal", "正文"), ("Normal", ""), ("Normal", "图 1-1 结构"), ("Heading1", "参考文献"), ("Normal", "[1] 某文")]
    return spark.createDataFrame([(1, i, s, t, i == 7, False, False) for i, (s, t) in enumerate(lines)], BLOCK)


def test_a_thesis_is_classified(spark):
    kinds = [r.kind for r in S.classify(thesis(spark)).orderBy("idx").collect()]
    assert kinds == ["cover", "abstract_zh", "abstract_en", "toc", "toc_entry", "chapter", "body", "figure", "figure_caption", "references", "reference_item"]


def test_text_boxes_on_the_cover_are_fields_and_later_ones_are_not(spark):
    rows = [(1, 0, None, "姓名", False, False, True), (1, 1, "Heading1", "1 绪论", False, False, False), (1, 2, None, "目录", False, False, True)]
    got = S.classify(spark.createDataFrame(rows, BLOCK)).orderBy("idx").collect()
    assert [(r.kind, r.region) for r in got] == [("cover_field", "cover"), ("chapter", "chapter"), ("toc", "toc")]


def test_matcher_truth_table(spark):
    rows = [(1, 0, "Normal", "第一章 绪论", False, False, False), (1, 1, "TOC1", "第一章 绪论 1", False, False, False), (1, 2, "Normal", "正文", False, True, False)]
    blocks = spark.createDataFrame(rows, BLOCK).withColumn("style_name", F.when(F.col("style_id") == "TOC1", "toc 1").otherwise("Normal"))
    hits = lambda match: sorted(r.idx for r in R.match_rules(blocks, [{"match": match}]).collect())
    assert hits({"regex": "^第"}) == [0, 1]
    assert hits({"regex": "^第", "style_name_not_regex": "^toc"}) == [0]
    assert hits({"regex": "^第", "not_regex": r"\d$"}) == [0]
    assert hits({"style_not_in": ["TOC1"]}) == [0, 2]
    assert hits({"in_table": True}) == [2]


def test_first_replacement_only(spark):
    got = spark.createDataFrame([("a-b-c",)], "t string").select(R.replaced(F.col("t"), "-", "+", False).alias("x"), R.replaced(F.col("t"), "-", "+", True).alias("y")).first()
    assert (got.x, got.y) == ("a+b-c", "a+b+c")


def test_a_long_run_of_blanks_gives_an_issue_for_each_eight(spark):
    rows = spark.createDataFrame([(1, i, "empty" if i < 17 else "body") for i in range(18)], "doc_id long, idx int, kind string")
    assert sorted(r.idx for r in L.blank_runs(rows).collect()) == [0, 8]


def pack(spark, items):
    fields = "doc_id long, ord long, section long, capacity double, height double, keep_next boolean, page_break boolean, is_row boolean, cant_split boolean, header double"
    return [(r.ord, r.page, r.y, r.split) for r in L.pack_ordered(spark.createDataFrame([(1, i, *x) for i, x in enumerate(items)], fields)).orderBy("ord").collect()]


def test_packing_keeps_with_next_breaks_and_splits_rows(spark):
    item = lambda h, keep=False, brk=False, row=False, whole=False, header=0.0, section=0: (section, 10.0, h, keep, brk, row, whole, header)
    assert [p for _, p, _, _ in pack(spark, [item(9.0), item(0.5, keep=True), item(2.0)])] == [1, 2, 2]
    assert [p for _, p, _, _ in pack(spark, [item(1.0), item(1.0, brk=True), item(1.0, section=1)])] == [1, 2, 3]
    rows = pack(spark, [item(6.0), item(8.0, row=True, header=1.0), item(1.0)])
    assert rows[1][1:] == (1, 6.0, True) and rows[2][1:3] == (2, 5.0)
    assert [p for _, p, _, _ in pack(spark, [item(6.0), item(8.0, row=True, whole=True)])] == [1, 2]
    long = pack(spark, [item(25.0, row=True), item(1.0)])
    assert long[1][1:3] == (3, 5.0)


def test_table_clause(spark):
    line = "正文表格索引0,2采用三线表，表头行数1，上下线1.5磅，表头线0.75磅"
    got = spark.createDataFrame([(line,), ("采用三线表",)], "line string").select(X.table_clause(F.col("line")).alias("t")).collect()
    assert tuple(got[0].t) == ("0,2", 1, 1.5, 0.75) and got[1].t is None


def test_size_names_are_tested_in_their_order(spark):
    rows = spark.createDataFrame([("小四号",), ("12pt",), ("无",)], "t string").select(T.find_size_pt(F.col("t")).alias("s")).collect()
    assert [r.s for r in rows] == [14.0, 12.0, None]


def test_style_cycles_end(spark):
    styles = spark.createDataFrame([(1, "A", "B"), (1, "B", "A"), (1, "C", None)], "doc_id long, style_id string, based_on string")
    assert sorted((r.style_id, r.ancestor, r.depth) for r in C.style_chain(styles).collect()) == [("A", "A", 0), ("A", "B", 1), ("B", "A", 1), ("B", "B", 0), ("C", "C", 0)]


def test_toggles_flip_along_a_chain(spark):
    styles = spark.createDataFrame([(1, "Base", None, True, 12.0), (1, "Child", "Base", True, None)], "doc_id long, style_id string, based_on string, bold boolean, size double")
    got = {r.style_id: (r.size, r.bold) for r in C.effective_props(C.style_chain(styles), styles, ("size",), ("bold",)).collect()}
    assert got == {"Base": (12.0, True), "Child": (12.0, False)}


def test_steps_that_need_confirmation_are_left_unless_listed(spark):
    rows = [(1, 0, "page", "section[0].widthIn", False), (1, 1, "structure", "document.sections[0].toc", False), (1, 2, "style", "styles.Caption.exists", False)]
    steps = P.finding_steps(spark.createDataFrame(rows, "doc_id long, idx int, category string, name string, ok boolean"))
    assert [r.step_no for r in P.select_steps(steps).orderBy("step_no").collect()] == [1, 3]
    assert [r.step_no for r in P.select_steps(steps, only=["s002-document.sections[0].toc"]).collect()] == [2]
    assert [r.step_no for r in P.select_steps(steps, only_auto=True).collect()] == [1]


def test_relationship_targets(spark):
    rows = spark.createDataFrame([("media/a.png",), ("/word/x.xml",), ("../custom/y.xml",), ("a/../b.xml",)], "t string").select(K.resolve_target(F.col("t")).alias("p")).collect()
    assert [r.p for r in rows] == ["word/media/a.png", "word/x.xml", "custom/y.xml", "word/b.xml"]


def test_graph_with_a_return_edge(spark):
    nodes = spark.createDataFrame([(1, i, n) for i, n in enumerate("abcd")], "graph_id long, ord int, id string")
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "b"), (1, "c", "d")], "graph_id long, src string, dst string")
    back = K.return_edges(nodes, edges)
    assert [(r.src, r.dst) for r in back.collect()] == [("c", "b")]
    grid = K.grid_positions(nodes, edges.join(back, ["graph_id", "src", "dst"], "left_anti"))
    assert sorted((r.id, r.row, r.col) for r in grid.collect()) == [("a", 0, 0), ("b", 1, 0), ("c", 2, 0), ("d", 3, 0)]


def test_negative_measures_are_errors(spark):
    with pytest.raises(Exception, match="negative"):
        spark.range(1).select(U.in_to_twips(F.lit(-1.0))).collect()


def test_unknown_word_count_mode_is_an_error(spark):
    with pytest.raises(Exception, match="mode"):
        spark.range(1).select(T.text_metric(F.lit("x"), F.lit("pages"))).collect()


def test_rewriting_pages_leaves_no_finding_and_twice_is_once(spark):
    fields = "doc_id long, section_idx int, page_w_twips int, page_h_twips int, orient string, mar_left int"
    rows = spark.createDataFrame([(1, 0, 12240, 15840, None, 1800), (1, 1, 16838, 11906, "landscape", 1440)], fields)
    once = R.set_page(rows, "a4", "portrait", {"left": 1.1})
    inches = once.withColumns({"width_in": U.twips_to_in(F.col("page_w_twips")), "height_in": U.twips_to_in(F.col("page_h_twips")), "left_in": U.twips_to_in(F.col("mar_left")), "orientation": F.col("orient")})
    assert C.diff_page(inches, {"size": "a4", "orientation": "portrait", "margins": {"left": 1.1}}).where("NOT ok").count() == 0
    assert sorted(once.collect()) == sorted(R.set_page(once, "a4", "portrait", {"left": 1.1}).collect())


def test_rules_that_hold_change_nothing(spark):
    """A second run over the result of the first is the same."""
    from quire.operators import job as J

    blocks = spark.createDataFrame([(1, 0, "Normal", "1 绪论"), (1, 1, "Normal", "图 1-1 a {{TITLE}}"), (1, 2, "Normal", "目录"), (2, 0, "Normal", "正文")], "doc_id long, idx int, style_id string, text string")
    sections = spark.createDataFrame([(1, 0, 16838, 11906, "landscape", 1440, None, None), (2, 0, 12240, 15840, None, 1440, "decimal", 3)], "doc_id long, section_idx int, page_w_twips int, page_h_twips int, orient string, mar_left int, num_fmt string, num_start int")
    bookmarks = spark.createDataFrame([(1, "old", 4)], "doc_id long, name string, id long")
    profile = {
        "page": {"size": "a4", "orientation": "portrait", "margins": {"left": 1.0}}, "pageNumbers": [(0, "decimal", 1)],
        "paragraphRules": [{"match": {"regex": r"^\d+ "}, "set_style": "Heading1"}, {"match": {"equals": "目录"}, "remove": True}],
        "bookmarkRules": [{"match": {"style": "Heading1"}, "name": "h_{index}"}], "replacements": [{"find": "{{TITLE}}", "by": "题目"}],
    }
    first = J.standardize({"sections": sections, "blocks": blocks, "bookmarks": bookmarks}, profile)
    again = J.standardize(first, profile)
    rows = lambda t, n: sorted(map(tuple, t[n].collect()), key=repr)
    assert all(rows(first, n) == rows(again, n) for n in ("sections", "blocks", "bookmarks"))
    assert rows(first, "bookmarks") == [(1, "h_1", 5), (1, "old", 4)]
    assert [(r.page_w_twips, r.page_h_twips, r.orient) for r in first["sections"].collect()] == [(11906, 16838, None)] * 2
    plan = spark.createDataFrame([(2, "page")], "doc_id long, family string")
    part = J.standardize({"sections": sections, "blocks": blocks, "bookmarks": bookmarks}, profile, plan)
    assert {(r.doc_id, r.page_w_twips) for r in part["sections"].collect()} == {(1, 16838), (2, 11906)} and rows(part, "blocks") == rows({"blocks": blocks}, "blocks")


def test_output_over_input_is_refused(spark, tmp_path):
    from quire.operators import job as J

    spark.range(3).write.parquet(str(tmp_path / "in" / "a"))
    df = spark.read.parquet(str(tmp_path / "in" / "a"))
    with pytest.raises(ValueError, match="the same"):
        J.write_run({"a": df}, str(tmp_path / "in"), force=True)
    J.write_run({"a": df}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_a_run_that_fails_leaves_the_old_one(spark, tmp_path):
    from quire.operators import job as J

    path, ok = str(tmp_path / "runs"), spark.range(3)
    first = J.write_run({"a": ok, "b": ok}, path)
    broken = ok.select(F.when(F.col("id") == 1, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        J.write_run({"a": spark.range(7), "b": broken}, path, force=True)  # fails between the tables
    assert {n: t.count() for n, t in J.read_run(spark, path).items()} == {"a": 3, "b": 3}
    with pytest.raises(FileExistsError):
        J.write_run({"a": ok}, path)
    second = J.write_run({"a": spark.range(5)}, path, force=True)
    assert {n: t.count() for n, t in J.read_run(spark, path).items()} == {"a": 5}
    assert first != second and [p.name for p in (tmp_path / "runs").iterdir() if p.name.startswith("run=")] == [f"run={second}"]


def test_a_plan_reaches_its_documents_alone(spark):
    """Headers, tables, fields and numbering of a document that the plan doesn't name stay as they are."""
    from quire.operators import job as J

    refs = spark.createDataFrame([(d, 0, "header", "default", "old") for d in (1, 2)], "doc_id long, section_idx int, kind string, ref_type string, part_name string")
    asked = spark.createDataFrame([(d, 0, "header", "default", "set", "new") for d in (1, 2)], "doc_id long, section_idx int, kind string, ref_type string, action string, part_name string")
    blocks = spark.createDataFrame([(d, 0, "Normal", "a {{X}} b {{Y}}{{X}}") for d in (1, 2)], "doc_id long, idx int, style_id string, text string")
    profile = {"headersFooters": asked, "fieldRules": [{"placeholder": "{{X}}", "instruction": "X"}, {"placeholder": "{{Y}}", "instruction": "Y"}]}
    plan = spark.createDataFrame([(1, "headersFooters"), (2, "fieldRules")], "doc_id long, family string")
    out = J.standardize({"refs": refs, "blocks": blocks}, profile, plan)
    assert sorted((r.doc_id, r.part_name) for r in out["refs"].collect()) == [(1, "new"), (2, "old")]
    assert [(r.doc_id, [tuple(s) for s in r.segments]) for r in out["segments"].collect()] == [(2, [("text", "a "), ("field", "X"), ("text", " b "), ("field", "Y"), ("field", "X")])]


def test_profiles_as_data_equal_a_run_for_each(spark):
    """Documents of two profiles at once, against one literal run for each profile; odd rows stay whole."""
    import json

    from quire.operators import assigned as A
    from quire.operators import job as J

    rows = [(d, i, s, t) for d in (1, 2, 3) for i, (s, t) in enumerate([("Normal", "1 Intro"), (None, None), ("Normal", ""), ("Normal", "the (end) $1 of it"), ("Normal", "1 Intro"), ("TOC1", "2 x")])]
    blocks = spark.createDataFrame(rows, "doc_id long, idx int, style_id string, text string").withColumn("keep_next", F.lit(False))
    literal = {
        7: {"paragraphRules": [{"match": {"regex": r"^\d ", "style_not_in": ["TOC1"]}, "set_style": "H1", "max_matches": 1}, {"match": {"contains": "end"}, "replace": ["the", "The"], "set": {"keep_next": True}}], "replacements": [{"find": "(end)", "by": "[$0]"}]},
        8: {"paragraphRules": [{"match": {"style": "TOC1"}, "remove": True}], "replacements": [{"find": "[a-z]+$", "by": "_", "regex": True}]},
    }
    said = {
        7: {"paragraphRules": [{"match": {"textRegex": r"^\d ", "currentStyleNotIn": ["TOC1"]}, "style": "H1", "maxMatches": 1}, {"match": {"textContains": "end"}, "textRegexReplace": {"pattern": "the", "replacement": "The"}, "paragraph": {"keepNext": True}}], "replacements": [{"find": "(end)", "replace": "[$0]"}]},
        8: {"paragraphRules": [{"match": {"currentStyle": "TOC1"}, "remove": True}], "replacements": [{"find": "[a-z]+$", "replace": "_", "regex": True}]},
    }
    profiles = spark.createDataFrame([(k, json.dumps(v)) for k, v in said.items()], "profile_id long, raw string")
    assigned = spark.createDataFrame([(1, 7), (2, 8)], "doc_id long, profile_id long")
    job = A.Job(A.rule_table(profiles), assigned)
    got = sorted(map(tuple, A.standardize(job, {"blocks": blocks})["blocks"].collect()), key=repr)
    want = []
    for doc, profile in ((1, 7), (2, 8)):
        want += map(tuple, J.standardize({"blocks": blocks.where(F.col("doc_id") == doc)}, literal[profile])["blocks"].collect())
    want += map(tuple, blocks.where("doc_id = 3").collect())  # a document without a profile
    assert got == sorted(want, key=repr)
    assert A.standardize(job, {"blocks": blocks.limit(0)})["blocks"].count() == 0


def test_html_is_read_by_its_tags(spark):
    page = "<p>a&amp;lt;b</p><BR\u3000/><script>x<b></script >y</SCRIPT>t<style a>\n.c{}</style><i\nx>u</i></h2><li>v</li>&nbsp;<>"
    got = spark.createDataFrame([(page,), (None,), ("",), ("no tag",)], "h string").select(T.html_to_text(F.col("h")).alias("t")).collect()
    assert [r.t for r in got] == [" a<b\n\n t  u \n v\n <>", None, "", "no tag"]


def test_replacements_fall_to_the_run_where_they_begin(spark):
    runs = spark.createDataFrame([(1, 0, 0, "ab{{T"), (1, 0, 1, "IT"), (1, 0, 2, "LE}}cd"), (1, 1, 0, None), (1, 1, 1, "x1y22")], "doc_id long, idx int, run_ord int, text string")
    got = lambda *a, **k: [r.text for r in R.replace_in_runs(runs, *a, **k).orderBy("idx", "run_ord").collect()]
    assert got("{{TITLE}}", "N$1\\") == ["abN$1\\", "", "cd", "", "x1y22"]
    assert got(r"(\d)+", "<$1>", regex=True) == ["ab{{T", "IT", "LE}}cd", "", "x<1>y<2>"]
    assert got(r"\d", "#", regex=True, every=False) == ["ab{{T", "IT", "LE}}cd", "", "x#y22"]


def test_style_chains_and_targets_have_no_cap(spark):
    styles = spark.createDataFrame([(1, f"s{i}", f"s{i + 1}" if i < 40 else None) for i in range(41)], "doc_id long, style_id string, based_on string")
    assert C.style_chain(styles).where("style_id = 's0'").count() == 41
    got = spark.createDataFrame([("../" * 6 + "a/b/../c.xml",), ("/word/./x//y.xml",)], "t string").select(K.resolve_target(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == ["a/c.xml", "word/x/y.xml"]


def test_entry_needs_no_session():
    """Importing the registered queries creates no column."""
    import subprocess
    import sys

    root = __file__.rsplit("/tests/", 1)[0]
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()[0] > "0"


def test_rule_tables_against_each_text(spark):
    """Several scans for one table, empty and null literals, overlapping and repeated ones."""
    from quire.operators import rule_index as X

    texts = [None, "", "ab", "abab cab", " ab  ab ", "ABC", "摘 要", "x" * 5000 + "ab"]
    said = [("r1", "textContains", "ab"), ("r2", "startsWith", "ab"), ("r3", "textEquals", "ab"), ("r4", "textContains", ""), ("r5", "textEquals", ""), ("r6", "startsWith", None), ("r7", "textEquals", "摘 要"), ("r8", "textContains", "b c"), ("r1", "textContains", "AB"), ("r9", "regex", "a")]
    blocks = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, idx int, text string")
    rules = spark.createDataFrame(said, "rule string, kind string, literal string")
    tests = {"textContains": lambda t, v: v in t, "startsWith": lambda t, v: t.startswith(v), "textEquals": lambda t, v: t == v}
    want = sorted({(1, i, r) for i, t in enumerate(texts) for r, k, v in said if v is not None and k in tests and tests[k](" ".join((t or "").split()), v)})
    for most in (1000, 2):
        assert sorted(map(tuple, X.match_rule_table(blocks, rules, most_rules=most).collect())) == want
    assert X.match_rule_table(blocks, rules.limit(0)).count() == 0


def test_styles_by_doubling_equal_their_chains(spark):
    """Also with cycles, styles that lead into them, a style based on itself and one that isn't there."""
    links = {"a": "b", "b": "c", "c": "a", "d": "a", "e": "d", "f": "f", "g": "nowhere", "h": "g", "i": None, "j": "i"}
    rows = [(d, s, up, float(ord(s)) if (ord(s) + d) % 3 == 0 else None, s in "adgi") for d in (1, 2) for s, up in links.items()]
    styles = spark.createDataFrame(rows, "doc_id long, style_id string, based_on string, size double, bold boolean")
    by_chain = C.effective_props(C.style_chain(styles), styles, ("size",), ("bold",)).select("doc_id", "style_id", "size", "bold")
    assert sorted(map(tuple, C.effective_styles(styles, ("size",), ("bold",)).collect()), key=repr) == sorted(map(tuple, by_chain.collect()), key=repr)
    depths = {(r.style_id, r.ancestor): r.depth for r in C.style_chain(styles).where("doc_id = 1").collect()}
    assert {k: v for k, v in depths.items() if k[0] == "e"} == {("e", "e"): 0, ("e", "d"): 1, ("e", "a"): 2, ("e", "b"): 3, ("e", "c"): 4} and ("f", "f") in depths and ("g", "nowhere") not in depths


def test_schema_rows_and_a_sound_profile(spark):
    import json

    from quire.operators import profile_schema as Z

    rows = {r[0]: r for r in Z.schema_rows()}
    assert rows["paragraphRules[].match.currentStyleNotIn"][1] == ["string", "array"] and rows["tableRules[].tableIndexes"][3:5] == (1.0, None)
    assert rows["styles.*.paragraph.outlineLevel"][3:5] == (0.0, 8.0) and rows["tableRules[]"][5] == ["tableIndexes", "preset"] and rows["validation.sectionCount"][1] == ["integer", "object"]
    sound = {"name": "x", "page": {"size": "a4", "marginsIn": {"left": 1}}, "styles": {"Heading 1": {"run": {"sizePt": 16}}}, "tableRules": [{"tableIndexes": [0], "preset": "three-line"}], "validation": {"sectionCount": {"min": 1}, "requiredFields": {"TOC": 1}}}
    bad = sound | {"page": [], "styles": {"H": {"run": {"bold": "yes"}}}, "tableRules": [{"preset": "two-line"}]}
    got = Z.check_schema(spark.createDataFrame([(1, json.dumps(sound)), (2, json.dumps(bad)), (3, "{}")], "profile_id long, raw string")).collect()
    assert sorted(map(tuple, got)) == [(2, "/page", "type"), (2, "/styles/H/run/bold", "type"), (2, "/tableRules/0/preset", "value"), (2, "/tableRules/0/tableIndexes", "missing")]


def test_audit_again_drops_what_has_gone(spark, tmp_path):
    from quire.operators import audit as N

    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    rows = spark.createDataFrame([(1, "a", None), (2, None, "a"), (2, "b", "b")], "doc_id long, x string, y string")
    family = lambda t: {"f": N.Family([t], lambda r: r.select("doc_id", F.coalesce("x", F.lit("-")).alias("name"), F.col("y").isNull().alias("ok")))}
    path = str(tmp_path / "audit")
    first = N.audit_again(docs, family(rows), path)
    assert {r.doc_id for r in first["prints"].where("judged").collect()} == {1, 2, 3} and first["findings"].count() == 3
    other = spark.createDataFrame([(1, None, "a"), (2, "b", "b"), (2, None, "a")], "doc_id long, x string, y string")  # 1 has moved its value, 2 is in another order
    again = N.audit_again(docs.where("doc_id < 3"), family(other), path)
    assert {(r.doc_id, r.judged) for r in again["prints"].collect()} == {(1, True), (2, False)}
    assert sorted((r.doc_id, r.name, r.ok) for r in again["findings"].collect()) == [(1, "-", False), (2, "-", False), (2, "b", False)]
