"""Operators whose work once outgrew their input, in small."""

from collections import defaultdict

import numpy as np
import pyarrow as pa

from quire.operators import audit, compare, job, marginals, planning, profile_schema, rule_index, structure, tables
from quire.plans import packages
from quire.plans.compare import PAGE, measured
from quire.sources import views


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_run_formats_are_compared_by_stretches(spark):
    runs = "doc int, offset int, text string, bold boolean"
    a = [(1, 0, "ab", True), (1, 2, "cd", True), (1, 4, "e", None), (2, 0, "ab", True), (3, 0, "ab", True), (3, 5, "cd", True), (4, 0, "", True), (5, 0, "x", None), (6, 0, "a𝒳", True), (7, 0, "ab", True)]
    b = [(1, 0, "abcd", True), (1, 4, "e", None), (1, 5, "", False), (2, 0, "ac", True), (3, 0, "abc", True), (3, 5, "d", True), (5, 0, "x", False), (6, 0, "a", True), (6, 1, "𝒳", True), (8, 0, "ab", True)]
    out = marginals.run_formats_equal(spark.createDataFrame(a, runs), spark.createDataFrame(b, runs), ["doc"], "bold")
    assert {r.doc: r.ok for r in out.collect()} == {1: True, 2: False, 3: False, 5: False, 6: True, 7: False, 8: False}
    assert "Generate" not in plan(out)  # no row for each character


def chains(spark):
    long = [(1, f"s{k}", f"s{k + 1}" if k < 99 else "s96", float(k) if k % 10 == 0 else None, k % 3 == 0) for k in range(100)]
    odd = [(2, "a", "a", None, True), (2, "b", "gone", 2.0, None), (2, "c", "b", None, True), (2, "d", None, None, None), (3, "x", "y", 5.0, True), (3, "y", "x", None, True), (3, "z", "y", None, None)]
    return spark.createDataFrame(long + odd, "doc_id long, style_id string, based_on string, size_pt double, bold boolean")


def by_walking(rows):
    """(doc, style) to its chain."""
    up = {(r.doc_id, r.style_id): r.based_on for r in rows}
    out = {}
    for doc, style in up:
        chain, at = [], style
        while (doc, at) in up and at not in chain:
            chain.append(at)
            at = up[doc, at]
        out[doc, style] = chain
    return out


def test_chains_are_walked_without_rounds(spark, monkeypatch):
    rows = chains(spark)
    monkeypatch.setattr(compare, "CHAIN_ROWS", 64)
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.checkpoint", None)
    out = compare.style_chain(rows)
    want = {(d, s, a, k) for (d, s), chain in by_walking(rows.collect()).items() for k, a in enumerate(chain)}
    got = [tuple(r) for r in out.select("doc_id", "style_id", "ancestor", "depth").collect()]
    assert set(got) == want and len(got) == len(want)


def test_effective_styles_follow_each_link_once(spark, monkeypatch):
    rows = chains(spark)
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.checkpoint", None)
    got = {(r.doc_id, r.style_id): (r.size_pt, r.bold) for r in compare.effective_styles(rows, ("size_pt",), ("bold",)).collect()}
    of = {(r.doc_id, r.style_id): r for r in rows.collect()}
    first = lambda doc, chain: next((of[doc, s].size_pt for s in chain if of[doc, s].size_pt is not None), None)
    assert got == {(doc, s): (first(doc, c), sum(of[doc, x].bold is True for x in c) % 2 == 1) for (doc, s), c in by_walking(rows.collect()).items()}


def test_packages_are_scanned_once_in_slices(spark, monkeypatch):
    taken = []
    real = packages.docx.shredded
    monkeypatch.setattr(packages.docx, "shredded", lambda *a: taken.append(1) or real(*a))
    kept = packages.scanned(spark, "/root/testdata/sf0.001", "table", "row", "cell")
    assert len(taken) == 1 and all("MapInArrow" not in plan(kept[n]) for n in ("tables", "table_rows", "table_cells"))  # stored, not read again by each
    assert "Aggregate" not in plan(packages.scanned(spark, "/root/testdata/sf0.001", "block")["blocks"])


def test_a_scan_reads_the_kinds_that_are_asked_for():
    data = packages.packed(7, [f"line {i}" for i in range(20)])
    every = list(packages.docx.shred(data))
    for kinds in ({"block"}, {"run", "rel"}, {"part"}, {"mrun", "level"}, {"section", "ref", "default"}):
        assert list(packages.docx.shred(data, frozenset(kinds))) == [r for r in every if r[0] in kinds]
    assert [r[0] for r in packages.docx.shred(b"no package", frozenset({"run"}))] == ["error"]


def test_elements_leave_a_task_in_slices(spark, monkeypatch):
    files = [(str(i), packages.packed(i, [f"line {k}" for k in range(i)])) for i in range(8)]
    rows = spark.createDataFrame(files, "path string, content binary")
    monkeypatch.setattr(packages.docx, "BATCH_ROWS", 5)
    got = packages.docx.shredded(rows).collect()
    want = [(name, kind, ord_, idx, text, props) for name, data in files for kind, ord_, idx, text, props in packages.docx.shred(data)]
    assert [tuple(r) for r in got] == want


def test_hits_of_rules_are_not_shuffled(spark):
    blocks = spark.createDataFrame([(1, 0, "aa bb"), (1, 1, "cc")], "doc_id int, idx int, text string")
    rules = spark.createDataFrame([(f"r{i % 10}", "textContains", x) for i in range(20) for x in ("aa", "bb", "cc", "dd")], "rule string, kind string, literal string")
    out = rule_index.match_rule_table(blocks, rules, most_rules=4)
    assert sorted(map(tuple, out.collect())) == sorted((1, k, f"r{i}") for k in range(2) for i in range(10))
    assert "Aggregate" not in plan(out)


def test_rules_of_one_literal_leave_a_task_as_one_key(spark, monkeypatch):
    monkeypatch.setattr(rule_index, "PAIRS", 1000)
    blocks = spark.createDataFrame([(d, 0, "aa  bb") for d in range(20)], "doc_id int, idx int, text string")
    rules = spark.createDataFrame([(f"r{i}", "textContains", "a b") for i in range(1000)] + [("x", "startsWith", "b")], "rule string, kind string, literal string")
    out = rule_index.match_rule_table(blocks, rules)
    assert "docs#" in plan(out) and out.rdd.getNumPartitions() >= 20  # tasks grow with rules times blocks
    assert sorted(map(tuple, out.collect())) == sorted((d, 0, f"r{i}") for d in range(20) for i in range(1000))
    texts = pa.array(["aa bb", "", "ba", "a b" * 1000])
    keys = rule_index.Keys(rules.toArrow())
    assert [[x.tolist() for x in found[1:]] for found in keys.of(texts)] == [[[0, 2], [0, 3, 2]]]
    monkeypatch.setattr(rule_index, "MOST_ROWS", 300)  # rows of the result that come of one row and one row of the rules
    keys = rule_index.Keys(rules.toArrow())
    assert sorted(len(x) for x in keys.rules["rules"].to_pylist()) == [1, 100, 300, 300, 300] and [len(found[0]) for found in keys.of(texts)] == [3]


def test_literals_are_found_by_words_of_eight_bytes(spark, monkeypatch):
    """Literals of all lengths, in texts that end anywhere, and rules that have several."""
    monkeypatch.setattr(rule_index, "PLACES", 5)
    monkeypatch.setattr(rule_index, "MOST_KEYS", 7)
    monkeypatch.setattr(rule_index, "MOST_ROWS", 3)
    text = "aé摘𝒳 ab\0abcabcdabcde摘摘摘abcdefgh"
    texts = ["", *(text[:k] for k in range(1, len(text) + 1)), *(text[k:] for k in range(len(text)))]
    literals = ["", "zz", "\0", *{text[a:b] for a in range(0, len(text), 3) for b in range(a + 1, len(text) + 1)}]
    said = [(f"r{i % 60}", kind, x) for i, x in enumerate(literals) for kind in rule_index.KINDS]
    tests = {"textContains": lambda t, v: v in t, "startsWith": lambda t, v: t.startswith(v), "textEquals": lambda t, v: t == v}
    keys = rule_index.Keys(pa.Table.from_pydict(dict(zip(("rule", "kind", "literal"), map(list, zip(*said, strict=True)), strict=True))))
    of = defaultdict(list)
    for key, names in zip(keys.rules["key"].to_pylist(), keys.rules["rules"].to_pylist(), strict=True):
        of[key] += names
    pieces = [(k, x.tolist()) for key, begin, rows in keys.of(pa.array(["ab", *texts]).slice(1)) for k, x in zip(key.tolist(), np.split(rows, begin[1:]), strict=True)]
    got = [(i, r) for k, x in pieces for i in x for r in of[k]]
    assert sorted(got) == sorted({(i, r) for i, t in enumerate(texts) for r, kind, v in said if tests[kind](t, v)})


def test_tables_are_dealt_over_partitions_that_grow_with_the_lines(spark, monkeypatch):
    monkeypatch.setattr(views, "LINES", 500)
    for name in ("v_tcells", "v_cells"):
        assert views.view(spark, "/root/testdata/sf0.001", name).rdd.getNumPartitions() >= 10  # of some 6,000 lines


def test_problems_of_tables_are_not_gathered_again(spark):
    t = spark.createDataFrame([(1, "left", 10), (2, "center", 1440)], "table_id long, alignment string, width_twips int")
    cells = spark.createDataFrame([(k, r, c, 1, True, 700) for k in (1, 2) for r in (0, 1) for c in (0, 1)], "table_id long, row_idx int, cell_idx int, grid_span int, cant_split boolean, width_twips int")
    paras = spark.createDataFrame([(1, 0, "left"), (1, 1, "both"), (2, 3, None), (2, None, "left")], "table_id long, para_idx int, alignment string")
    rule = {"alignment": "center", "column_widths_in": [0.5, 0.5], "allow_row_split": True, "paragraph": {"alignment": "justify"}}
    out = tables.check_table_extras(t, cells, paras, rule)
    want = [(1, "alignment"), (1, "widthIn"), (1, "paragraph[0].alignment"), (2, "paragraph[3].alignment"), (2, "paragraph[null].alignment")]
    want += [(k, p) for k in (1, 2) for p in ("columnWidthsIn", "row[0].allowRowSplit", "row[1].allowRowSplit")]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert plan(out).startswith("Union")


def test_only_rows_with_nested_tables_are_measured_in_rounds(spark, monkeypatch):
    cells = spark.createDataFrame([(t, r, c, 0.1 * t + r + c, 0.5 if r else None) for t in range(20) for r in range(3) for c in range(2)], "table_id long, row_idx int, cell_idx int, height double, min_height_in double")
    nested = [(5, 4, 0, 0), (4, 3, 1, 1), (7, 3, 1, 1), (8, 3, 1, 0), (9, 99, 0, 0), (10, 2, 7, 0)]
    parents = spark.createDataFrame(nested, "table_id long, parent_id long, parent_row int, parent_cell int")
    counts, real = [], tables.checkpointed
    monkeypatch.setattr(tables, "checkpointed", lambda df: counts.append(df.count()) or real(df))
    got = {(r.table_id, r.row_idx): r.height for r in tables.nested_heights(cells, parents).collect()}

    def height(t, r):
        inside = lambda c: sum(sum(height(child, k) for k in range(3)) for child, *at in nested if at == [t, r, c])
        return max(0.5 if r else 0, 0.08, *(0.1 * t + r + c + inside(c) for c in range(2)))

    assert {k: round(v, 9) for k, v in got.items()} == {(t, r): round(height(t, r), 9) for t in range(20) for r in range(3)}
    assert max(counts) <= len(nested)


def test_a_narrowed_profile_is_not_sorted(spark):
    rules = spark.createDataFrame([("styles", s, "run", k, "1") for s in ("Normal", "Note") for k in ("size_pt", "bold")], "family string, item string, bucket string, property string, value string")
    steps = [(1, "styles.Normal.size_pt", "size_pt"), (2, "styles.Normal.colour", "colour"), (3, "styles.Note.exists", "exists"), (3, "styles.Note.bold", "bold")]
    steps = spark.createDataFrame([(d, "set_style", s, "x", p, False) for d, s, p in steps], "doc_id int, action string, source string, target string, property string, visual boolean")
    out = planning.narrow_profile(rules, steps)
    assert sorted((r.doc_id, r.item, r.property) for r in out.collect()) == [(1, "Normal", "size_pt"), (2, "Normal", "bold"), (2, "Normal", "size_pt"), (3, "Note", "bold"), (3, "Note", "size_pt")]
    assert "Window" not in plan(out)


def test_schema_is_judged_without_a_shuffle(spark):
    raw = '{"name":"","page":{"marginsIn":{"a/b":1,"left":2,"odd":null}},"tableRules":[{"tableIndexes":[]}],"headingNumbering":{"styles":[null]}}'
    out = profile_schema.check_schema(spark.createDataFrame([(1, raw), (1, raw), (2, "{}")], "profile_id long, raw string"))
    at = [("/headingNumbering/styles/0", "type"), ("/name", "length"), ("/page/marginsIn/a/b", "unknown"), ("/page/marginsIn/odd", "unknown"), ("/tableRules/0/preset", "missing"), ("/tableRules/0/tableIndexes", "items")]
    assert sorted(tuple(r) for r in out.collect()) == sorted([(1, *x) for x in at] * 2)
    assert "Exchange hash" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_rewrite_classifies_texts_once(spark, monkeypatch):
    of, classified = structure.classify, []
    monkeypatch.setattr(structure, "classify", lambda *a: classified.append(1) or of(*a))
    blocks, sections = (views.view(spark, "/root/testdata/sf0.001", v) for v in ("v_blocks", "v_sections"))
    before, after, run = job.compliance_rewrite(blocks, sections, measured, PAGE, (("chapter", True, 1, None),))
    assert len(classified) == 1 and "RLIKE" not in plan(run["compliance"]) and "RLIKE" not in plan(before["compliance"])
    again = of(after["blocks"]).select("doc_id", "idx", "kind", "region", "keep_next", "drawing_width_in")
    kept = run["blocks"].select(*again.columns)
    assert again.exceptAll(kept).isEmpty() and kept.exceptAll(again).isEmpty()


def test_blocks_are_dealt_by_their_number(spark, monkeypatch):
    blocks = views.view(spark, "/root/testdata/sf0.001", "v_blocks")
    monkeypatch.setattr(structure, "ROWS", 10)
    want, got = structure.classify(blocks), structure.classify(blocks, 1000)
    assert "RepartitionByExpression" in plan(got) and "100" in plan(got)
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()


def test_an_audit_again_leaves_out_what_has_not_changed(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(k,) for k in range(6)], "doc_id long")
    rows = docs.selectExpr("doc_id", "doc_id > 2 AS ok")
    judged = []
    same = audit.Family([rows], lambda t: judged.append("same") or t.selectExpr("doc_id", "'n' AS name", "ok"))
    of = lambda t: audit.Family([t], lambda t: judged.append(plan(t)) or t.selectExpr("doc_id", "'n' AS name", "ok"))
    for few in (100, 0):
        monkeypatch.setattr(audit, "FEW", few)
        path = str(tmp_path / str(few))
        audit.audit_again(docs, {"same": same, "other": of(rows)}, path)
        judged.clear()
        run = audit.audit_again(docs, {"same": same, "other": of(docs.selectExpr("doc_id", "doc_id > 3 AS ok"))}, path)
        assert len(judged) == 1 and ("broadcast" in judged[0]) == (few > 0)
        assert {(r.doc_id, r.family) for r in run["prints"].where("judged").collect()} == {(3, "other")}
        assert {(r.doc_id, r.family, r.ok) for r in run["findings"].collect()} == {(k, f, k > least) for k in range(6) for f, least in (("same", 2), ("other", 3))}
