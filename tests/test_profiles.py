"""Profiles, headers and footers."""

import json

from quire.operators import marginals as M
from quire.operators import profiles as Q

GOOD = {"name": "a", "page": {"size": "a4"}, "styles": {"Normal": {"sizePt": 12}}, "headingNumbering": {"styles": ["Heading1", "Heading2"], "patterns": ["%1、", "%1.%2"]}}
BAD = {"page": {"size": "a9", "colour": 1}, "styles": {"Normal": {"sizePt": -1}}, "headingNumbering": {"styles": ["Heading1"], "patterns": ["x", "%2"]}, "requirements": {"unresolved": ["margins"], "conflicts": []}}
RULES = {"": {"type": "object", "required": ["name"]}, "page": {"type": "object", "keys": ["size", "orientation"]}, "page.size": {"enum": ["a4", "letter"]}, "styles.Normal.sizePt": {"type": "number", "min": 1, "multiple": 0.5}}


def profiles(spark):
    return spark.createDataFrame([("good", json.dumps(GOOD)), ("bad", json.dumps(BAD))], "profile_id string, raw string")


def test_profiles_are_checked(spark):
    got = {(r.profile_id, r.at, r.problem) for r in Q.check_profiles(profiles(spark), RULES).collect()}
    assert got == {("bad", "/name", "missing"), ("bad", "/page/colour", "unknown"), ("bad", "/page/size", "value"), ("bad", "/styles/Normal/sizePt", "value")}


def test_cross_field_checks_and_gate(spark):
    p = profiles(spark)
    assert [r.profile_id for r in Q.check_lengths(p, "headingNumbering.styles", "headingNumbering.patterns").collect()] == ["bad"]
    assert [(r.profile_id, r.at) for r in Q.check_patterns(p, "headingNumbering.patterns").collect()] == [("bad", "/headingNumbering/patterns/0")]
    free, held = Q.gate(p)
    assert [r.profile_id for r in free.collect()] == ["good"] and [r.profile_id for r in held.collect()] == ["bad"]
    assert Q.gate(p, allow=True)[0].count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps(GOOD, indent=1))
    assert Q.flatten(Q.read_profiles(spark, str(tmp_path / "p.json"))).where("path = 'page.size'").first().text == "a4"
    (tmp_path / "plan.json").write_text('{"id": "s001-x", "action": "set_page", "auto": true}\n')
    assert Q.read_plan(spark, str(tmp_path / "plan.json")).first().action == "set_page"


RUNS = [("Page ", None, None), (None, "begin", None), (None, None, " PA"), (None, None, "GE "), (None, "separate", None), ("7", None, None), (None, "end", None), (" of", None, None), (" it", None, None), (None, "begin", None), (None, None, "DATE"), (None, "end", None), ("", None, None)]


def test_segments_expectations_and_switches(spark):
    runs = spark.createDataFrame([(1, "word/header1.xml", 0, i, m, ins, t) for i, (t, m, ins) in enumerate(RUNS)], "doc_id long, part_name string, para_idx int, run_ord int, marker string, instruction string, text string")
    segs = M.segments(runs)
    assert [(r.kind, r.value) for r in segs.orderBy("seg").collect()] == [("text", "Page "), ("field", "PAGE"), ("text", " of it"), ("field", "DATE")]
    row = M.marginal_inventory(segs).first()
    assert (row["kind"], row.paragraphs, row.text, row.fields) == ("header", 1, "Page  of it", ["PAGE", "DATE"])
    refs = spark.createDataFrame([(1, 0, "header", "default", "word/header1.xml"), (1, 1, "header", "even", "word/header1.xml")], "doc_id long, section_idx int, kind string, ref_type string, part_name string")
    good = [("text", "Page "), ("field", "PAGE"), ("text", " of it"), ("field", "DATE")]
    want = [{"section": 0, "kind": "header", "segments": [good]}, {"section": 0, "kind": "header", "segments": [good[:1]]}, {"section": 5, "kind": "header"}, {"section": 5, "kind": "footer", "action": "inherit"}]
    assert [(r.rule, r.ok, r.error) for r in M.check_marginals(refs, segs, want).orderBy("rule").collect()] == [(0, True, None), (1, False, "content"), (2, False, "reference"), (3, True, None)]
    rules = spark.createDataFrame([(1, 0, "header", "default", "clear", None), (1, 2, "footer", "first", "set", "word/footer9.xml")], "doc_id long, section_idx int, kind string, ref_type string, action string, part_name string")
    after = M.apply_marginals(refs, rules)
    assert sorted((r.section_idx, r.kind, r.part_name) for r in after.collect()) == [(1, "header", "word/header1.xml"), (2, "footer", "word/footer9.xml")]
    s = M.switches(after).first()
    assert s.even_and_odd and s.first_page_sections == [2]


def test_run_splitting_does_not_matter(spark):
    fields = "k int, offset int, text string, bold boolean"
    a = spark.createDataFrame([(1, 0, "abcd", True), (2, 0, "ab", True)], fields)
    b = spark.createDataFrame([(1, 0, "ab", True), (1, 2, "cd", True), (2, 0, "a", True), (2, 1, "b", False)], fields)
    assert {r.k: r.ok for r in M.run_formats_equal(a, b, ["k"], "bold").collect()} == {1: True, 2: False}
