"""Three-line tables by rule: borders, spacing, widths, texts; nested heights and the flow of tables (J-15, J-16, R-14, W-10, W-14, W-18, A-13, A-20).

A rule is a dict: header_rows, outer_pt, header_pt, color, repeat_header, and if
wanted alignment, width_in, column_widths_in, allow_row_split, paragraph and run
(property to value). Cells: table_id, row_idx, cell_idx, grid_span, is_header,
cant_split, v_merge, cell_spacing, width_twips, and for each edge its size in eighths
of a point (null for none) and its colour.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.sources.lineage import checkpointed

EDGES = ("top", "bottom", "left", "right")
TWIP = 1 / 1440


def expected_cells(cells: DataFrame, rule: dict) -> DataFrame:
    """Cells with what the rule gives them (exp_<edge>, exp_header) and ``unsafe``: why the table can't take the rule, null if it can."""
    headers, outer, middle = rule.get("header_rows", 1), round(rule.get("outer_pt", 1.5) * 8), round(rule.get("header_pt", 0.75) * 8)
    whole, row = W.partitionBy("table_id"), F.col("row_idx")
    rows = cells.withColumn("_rows", F.max("row_idx").over(whole) + 1)
    crosses = F.max(((row == headers) & (F.col("v_merge") == "continue")).cast("int")).over(whole)
    rows = rows.withColumn("unsafe", F.when((F.lit(headers) < 1) | (F.col("_rows") <= headers), "no_body").when(crosses == 1, "merge_across_header"))
    if rule.get("column_widths_in"):
        spans = F.sum("grid_span").over(W.partitionBy("table_id", "row_idx"))
        rows = rows.withColumn("_spans", spans).withColumn("unsafe", F.coalesce("unsafe", F.when(F.max((F.col("_spans") != len(rule["column_widths_in"])).cast("int")).over(whole) == 1, "grid_mismatch"))).drop("_spans")
    top = F.when(row == headers, F.lit(middle)).when(row == 0, F.lit(outer))
    bottom = F.when(row == F.col("_rows") - 1, F.lit(outer)).when(row == headers - 1, F.lit(middle))
    none = F.lit(None).cast("int")
    edges = {"top": top, "bottom": bottom, "left": none, "right": none}
    return rows.withColumns({f"exp_{e}": c for e, c in edges.items()} | {"exp_header": (row < headers) & F.lit(rule.get("repeat_header", True))}).drop("_rows")


def check_table_borders(cells: DataFrame, rule: dict) -> DataFrame:
    """(table_id, problems, ok): borders, spacing and repeat_header that differ from the rule, or why the table is unsafe."""
    rows = expected_cells(cells, rule)
    color = rule.get("color", "000000").lstrip("#").upper()
    differ = reduce(lambda a, b: a | b, [~F.col(f"{e}_sz").eqNullSafe(F.col(f"exp_{e}")) | (F.col(f"exp_{e}").isNotNull() & ~F.upper("color").eqNullSafe(F.lit(color))) for e in EDGES])
    found = {"borders": differ, "spacing": F.coalesce("cell_spacing", F.lit(0)) != 0, "repeat_header": F.col("is_header") != F.col("exp_header")}
    of = rows.groupBy("table_id").agg(F.max("unsafe").alias("_unsafe"), *[F.bool_or(c).alias(n) for n, c in found.items()])
    problems = F.when(F.col("_unsafe").isNotNull(), F.col("_unsafe")).otherwise(F.concat_ws(",", *[F.when(F.col(n), n) for n in found]))
    return of.select("table_id", problems.alias("problems"), (problems == "").alias("ok"))


def grid_widths(cells: DataFrame, widths_in: list[float]) -> DataFrame:
    """Adds grid_at, the first grid column of each cell, grid_twips, the sum of the widths that it spans, and fits, whether its row fills the grid."""
    before = W.partitionBy("table_id", "row_idx").orderBy("cell_idx").rowsBetween(W.unboundedPreceding, -1)
    grid = F.array(*[F.lit(round(w * 1440)) for w in widths_in])
    rows = cells.withColumn("grid_at", F.coalesce(F.sum("grid_span").over(before), F.lit(0)).cast("int"))
    fits = F.sum("grid_span").over(W.partitionBy("table_id", "row_idx")) == len(widths_in)
    total = F.aggregate(F.slice(grid, F.col("grid_at") + 1, F.col("grid_span").cast("int")), F.lit(0), lambda a, x: a + x)
    return rows.withColumns({"grid_twips": total, "fits": fits})


def apply_tables(cells: DataFrame, rule: dict) -> tuple[DataFrame, DataFrame]:
    """Cells of the tables that can take the rule, rewritten, others as they were; and (table_id, problem) of these others."""
    rows, names = expected_cells(cells, rule), cells.columns
    safe = F.col("unsafe").isNull()
    set_to = lambda name, value: F.when(safe, value).otherwise(F.col(name)).alias(name)
    new = {f"{e}_sz": F.col(f"exp_{e}") for e in EDGES} | {"cell_spacing": F.lit(0), "is_header": F.col("exp_header"), "color": F.lit(rule.get("color", "000000").lstrip("#").upper())}
    if "allow_row_split" in rule:
        new["cant_split"] = F.lit(not rule["allow_row_split"])
    if rule.get("column_widths_in"):
        rows = grid_widths(rows, rule["column_widths_in"])
        new["width_twips"] = F.col("grid_twips")
    out = rows.select(*[set_to(c, new[c]) if c in new else F.col(c) for c in names])
    return out, rows.where(~safe).select("table_id", F.col("unsafe").alias("problem")).distinct()


def check_table_extras(tables: DataFrame, cells: DataFrame, paras: DataFrame, rule: dict) -> DataFrame:
    """(table_id, problem): what the rule asks for beyond the lines and the table hasn't, each once.

    tables: table_id, alignment, width_twips; paras: table_id, para_idx and effective
    properties, numbers within a hundredth. A first line in characters is measured
    in the rule's size; a zero indent is not met while an indent in characters competes.
    """
    found = []
    told = lambda what, at, rest: F.concat(F.lit(f"{what}["), F.coalesce(F.col(at).cast("string"), F.lit("null")), F.lit(rest))
    if "alignment" in rule:
        found.append(tables.where(~F.col("alignment").eqNullSafe(F.lit(rule["alignment"]))).select("table_id", F.lit("alignment").alias("problem")))
    widths = rule.get("column_widths_in")
    width = rule.get("width_in", sum(widths) if widths else None)
    if width is not None:
        found.append(tables.where(~F.col("width_twips").eqNullSafe(F.lit(round(width * 1440)))).select("table_id", F.lit("widthIn").alias("problem")))
    if widths:
        found.append(grid_widths(cells, widths).where(~F.col("fits") | (F.col("width_twips") != F.col("grid_twips"))).select("table_id", F.lit("columnWidthsIn").alias("problem")))
    if "allow_row_split" in rule:
        found.append(cells.where(F.col("cant_split") == F.lit(rule["allow_row_split"])).select("table_id", told("row", "row_idx", "].allowRowSplit").alias("problem")))
    size = (rule.get("run") or {}).get("size_pt", 12)
    tests: list[Column] = []
    for family, prefix in (("paragraph", ""), ("run", "run.")):
        for key, value in (rule.get(family) or {}).items():
            want, name = value, key
            if key == "alignment" and value == "justify":
                want = "both"
            if key == "first_line_chars":
                name, want = "first_line_in", value * size / 72
            if key == "color":
                want = value.lstrip("#").upper()
            got = F.upper(name) if key == "color" else F.col(name)
            bad = F.abs(got - F.lit(float(want))) > 0.01 if isinstance(want, (int, float)) and not isinstance(want, bool) else ~got.eqNullSafe(F.lit(want))
            bad = F.coalesce(bad, F.lit(True))
            if key in ("first_line_in", "hanging_in", "first_line_chars") and value == 0:
                bad = bad | (F.coalesce("first_line_chars", F.lit(0)) != 0) | (F.coalesce("hanging_chars", F.lit(0)) != 0)
            tests.append(F.when(bad, told("paragraph", "para_idx", f"].{prefix}{key}")))
    if tests:
        found.append(paras.select("table_id", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("problem")))
    return reduce(DataFrame.unionByName, [x.distinct() for x in found])  # no two of them tell the same problem


def infer_tables(cells: DataFrame) -> DataFrame:
    """(table_id, header_rows, outer_pt, header_pt, color, status): a draft rule of each table that keeps one, else ``unresolved``.

    The header is a prefix of header rows with a body below; the outer edges are
    equal, the header's lower edge is there, all of one colour, and the whole table
    passes the check of the rule it suggests.
    """
    rows = cells.groupBy("table_id", "row_idx").agg(F.bool_and("is_header").alias("_header"), F.min("top_sz").alias("t0"), F.max("top_sz").alias("t1"), F.min("bottom_sz").alias("b0"), F.max("bottom_sz").alias("b1"), F.count("top_sz").alias("tn"), F.count("bottom_sz").alias("bn"), F.count("*").alias("cells"))
    upto = W.partitionBy("table_id").orderBy("row_idx").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_prefix", F.every("_header").over(upto))
    lists = F.array_sort(F.collect_list(F.struct("row_idx", "_prefix", "t0", "t1", "b0", "b1", "tn", "bn", "cells")))
    of = rows.groupBy("table_id").agg(lists.alias("r"), F.count_if("_prefix").cast("int").alias("h"))
    other = cells.groupBy(F.col("table_id").alias("_t")).agg(F.countDistinct(F.when(F.coalesce("top_sz", "bottom_sz").isNotNull(), F.upper("color"))).alias("_colors"), F.max(F.upper("color")).alias("color"), (F.count("left_sz") + F.count("right_sz") + F.count_if(F.coalesce("cell_spacing", F.lit(0)) != 0) + F.count_if(F.col("v_merge") == "continue")).alias("_bad"))
    of = of.join(other, F.col("table_id") == F.col("_t")).withColumn("n", F.size("r"))
    outer, middle = F.col("r")[0]["t0"], F.element_at("r", F.greatest(F.col("h"), F.lit(1)))["b0"]
    fits = F.forall("r", lambda x: x["t0"].eqNullSafe(F.when(x["row_idx"] == F.col("h"), middle).when(x["row_idx"] == 0, outer)) & x["t1"].eqNullSafe(x["t0"]) & x["tn"].isin(0, x["cells"]) & x["b0"].eqNullSafe(F.when(x["row_idx"] == F.col("n") - 1, outer).when(x["row_idx"] == F.col("h") - 1, middle)) & x["b1"].eqNullSafe(x["b0"]) & x["bn"].isin(0, x["cells"]))
    ok = F.coalesce((F.col("h") > 0) & (F.col("h") < F.col("n")) & outer.isNotNull() & middle.isNotNull() & (F.col("_colors") == 1) & (F.col("_bad") == 0) & fits, F.lit(False))
    keep = lambda c: F.when(ok, c)
    return of.select("table_id", keep(F.col("h")).alias("header_rows"), keep(outer / 8).alias("outer_pt"), keep(middle / 8).alias("header_pt"), keep(F.col("color")).alias("color"), F.when(ok, "confirm").otherwise("unresolved").alias("status"))


def nested_heights(cells: DataFrame, parents: DataFrame) -> DataFrame:
    """(table_id, row_idx, height) with the tables that stand in cells, from the innermost out, until a round changes nothing.

    cells: table_id, row_idx, cell_idx, height of its own paragraphs, min_height_in;
    parents: table_id, parent_id, parent_row, parent_cell of the nested tables.
    """

    least = F.greatest(F.max("height"), F.coalesce(F.max("min_height_in").cast("double"), F.lit(0.0)), F.lit(0.08))
    plain = cells.groupBy("table_id", "row_idx").agg(least.alias("height"))
    on = {"parent_id": "table_id", "parent_row": "row_idx", "parent_cell": "cell_idx"}
    holding = parents.select(*on).distinct().withColumnsRenamed(on).join(cells.select(*on.values(), "height"), [*on.values()])
    # Only rows with a nested table can change: their plain height, and that of each cell which holds one.
    holding = holding.join(plain.withColumnRenamed("height", "_plain"), ["table_id", "row_idx"])
    sums = plain.groupBy("table_id").agg(F.sum("height").alias("_sum"))
    nested = checkpointed(parents.join(sums, "table_id").select("table_id", *on, "_sum"))
    holding, grown, before = checkpointed(holding), None, None
    while True:
        whole = nested
        if grown is not None:
            more = grown.groupBy("table_id").agg(F.sum(F.col("height") - F.col("_plain")).alias("_more"))
            whole = nested.join(more, "table_id", "left").withColumn("_sum", F.col("_sum") + F.coalesce("_more", F.lit(0.0)))
        inner = whole.drop("table_id").withColumnsRenamed(on).groupBy(*on.values()).agg(F.sum("_sum").alias("_inner"))
        taller = holding.join(inner, [*on.values()]).groupBy("table_id", "row_idx").agg(F.max(F.greatest(F.col("height") + F.col("_inner"), F.col("_plain"))).alias("height"), F.max("_plain").alias("_plain"))
        grown = checkpointed(taller)
        total = grown.agg(F.round(F.sum("height"), 6)).first()[0]
        if total == before:
            break
        before = total
    rows = plain.join(grown.select("table_id", "row_idx", F.col("height").alias("_grown")), ["table_id", "row_idx"], "left")
    return rows.select("table_id", "row_idx", F.coalesce("_grown", "height").alias("height"))


def fold_tables(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """The flow of a document: its blocks in order, but each table once, as its rows, where its first block stands.

    blocks: doc_id, idx, table_idx (null outside tables), height, keep_next,
    page_break; rows: doc_id, table_idx, row_idx, height, is_header, cant_split.
    Adds ord, is_row and header, the height of the header rows above a body row.
    """
    w = W.partitionBy("doc_id", "table_idx").orderBy("row_idx").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.every("is_header").over(w))
    rows = rows.withColumn("header", F.when(F.col("is_header"), 0.0).otherwise(F.coalesce(F.sum(F.when(F.col("_in"), F.col("height"))).over(w), F.lit(0.0))))
    first = F.row_number().over(W.partitionBy("doc_id", "table_idx").orderBy("idx"))
    plain = blocks.where("table_idx IS NULL").select("doc_id", "idx", F.lit(0).alias("row_idx"), "height", "keep_next", "page_break", F.lit(False).alias("is_row"), F.lit(False).alias("cant_split"), F.lit(0.0).alias("header"))
    at = blocks.where("table_idx IS NOT NULL").withColumn("_first", first).where("_first = 1").select("doc_id", "table_idx", "idx")
    table = at.join(rows, ["doc_id", "table_idx"]).select("doc_id", "idx", "row_idx", "height", F.lit(False).alias("keep_next"), F.lit(False).alias("page_break"), F.lit(True).alias("is_row"), "cant_split", "header")
    return plain.unionByName(table).withColumn("ord", F.row_number().over(W.partitionBy("doc_id").orderBy("idx", "row_idx")).cast("long"))


def wide_tables(tables: DataFrame) -> DataFrame:
    """Tables wider than their container, by more than 0.08 inches. tables: table_id, width_in, container_in."""
    return tables.where(F.col("width_in") > F.col("container_in") + 0.08).select("table_id", F.lit("table_overflow").alias("type"), "width_in", "container_in")
