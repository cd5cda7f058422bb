"""Packages, tables and process graphs (S-2, S-3, A-19, A-20, J-15, R-14, G-1 to G-3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.sources.lineage import checkpointed

# Parts that every package has.
REQUIRED = ("[Content_Types].xml", "_rels/.rels", "word/document.xml")


def check_packages(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, problem, part_name): parts listed twice or more, and required parts that are missing."""
    twice = parts.groupBy("doc_id", "part_name").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit("duplicate").alias("problem"), "part_name")
    need = docs.select("doc_id", F.explode(F.array(*map(F.lit, REQUIRED))).alias("part_name"))
    gone = need.join(parts, ["doc_id", "part_name"], "left_anti").select("doc_id", F.lit("missing").alias("problem"), "part_name")
    return twice.unionByName(gone)


def resolve_target(target: Column) -> Column:
    """A relationship's target as a part name: relative ones stand under ``word/``, ``.`` and ``x/..`` are undone, no leading slash."""
    path = F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("word/"), target))
    step = lambda kept, x: F.when(x.isin("", "."), kept).when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.array_append(kept, x))
    return F.array_join(F.aggregate(F.split(path, "/"), F.expr("CAST(array() AS array<string>)"), step), "/")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def row_roles(rows: DataFrame) -> DataFrame:
    """Adds first, last, header_last and body_first to table rows; header rows are a prefix."""
    w = W.partitionBy("table_id").orderBy("row_idx")
    whole = W.partitionBy("table_id")
    header = F.every("is_header").over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumns({"_header": header, "_n": F.max("row_idx").over(whole)})
    rows = rows.withColumn("_headers", F.sum(F.col("_header").cast("int")).over(whole))
    return rows.withColumns({"first": F.col("row_idx") == 0, "last": F.col("row_idx") == F.col("_n"), "header_last": F.col("row_idx") == F.col("_headers") - 1, "body_first": F.col("row_idx") == F.col("_headers")}).drop("_header", "_n", "_headers")


def expected_edges(outer: int, middle: int) -> tuple[Column, Column]:
    """Top and bottom border sizes of a three-line table by row role, null for none."""
    top = F.when(F.col("body_first"), F.lit(middle)).when(F.col("first"), F.lit(outer))
    bottom = F.when(F.col("last"), F.lit(outer)).when(F.col("header_last"), F.lit(middle))
    return top, bottom


def apply_tables(rows: DataFrame, outer: int = 12, middle: int = 6) -> DataFrame:
    """Rows of three-line tables: borders by role in eighths of a point."""
    top, bottom = expected_edges(outer, middle)
    return row_roles(rows).withColumns({"top_sz": top, "bottom_sz": bottom})


def check_table_borders(rows: DataFrame, outer: int = 12, middle: int = 6) -> DataFrame:
    """(table_id, wrong, ok): rows whose top border isn't what a three-line table has there."""
    top, _ = expected_edges(outer, middle)
    wrong = F.count_if(~F.col("top_sz").eqNullSafe(top))
    return row_roles(rows).groupBy("table_id").agg(wrong.alias("wrong"), (wrong == 0).alias("ok"))


def infer_tables(rows: DataFrame) -> DataFrame:
    """(table_id, header_rows, outer_pt): a draft rule for tables with a header prefix, a body and an explicit top border; others are left out."""
    header = F.every("is_header").over(W.partitionBy("table_id").orderBy("row_idx").rowsBetween(W.unboundedPreceding, 0))
    of = rows.withColumn("_header", header).groupBy("table_id").agg(F.count_if("_header").alias("header_rows"), F.count("*").alias("n"), F.max(F.when(F.col("row_idx") == 0, F.col("top_sz"))).alias("top"))
    return of.where("header_rows > 0 AND header_rows < n AND top IS NOT NULL").select("table_id", "header_rows", (F.col("top") / 8).alias("outer_pt"))


def check_graphs(nodes: DataFrame, edges: DataFrame, most_nodes: int = 60, most_edges: int = 120) -> DataFrame:
    """(graph_id, problem): counts out of range, bad or repeated ids, unknown ends, repeated edges."""
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    found = [
        n.where((F.col("n") < 1) | (F.col("n") > most_nodes)).select("graph_id", F.lit("node_count").alias("problem")),
        edges.groupBy("graph_id").agg(F.count("*").alias("n")).where(F.col("n") > most_edges).select("graph_id", F.lit("edge_count").alias("problem")),
        nodes.where(~F.col("id").rlike("^[A-Za-z][A-Za-z0-9_-]*$")).select("graph_id", F.lit("node_id").alias("problem")),
        duplicates(nodes, ["graph_id", "id"]).select("graph_id", F.lit("duplicate_node").alias("problem")),
        duplicates(edges, ["graph_id", "src", "dst"]).select("graph_id", F.lit("duplicate_edge").alias("problem")),
    ]
    known = nodes.select(F.col("graph_id").alias("_g"), F.col("id").alias("_id"))
    for end in ("src", "dst"):
        found.append(edges.join(known, (F.col("graph_id") == F.col("_g")) & (F.col(end) == F.col("_id")), "left_anti").select("graph_id", F.lit(f"unknown_{end}").alias("problem")))
    return reduce(DataFrame.unionByName, found).distinct()


# Node types of a graph, and the least and largest value of each layout measure.
NODE_TYPES = ("start", "end", "process", "decision")
LAYOUT_RANGES = {"nodeWidthIn": (0.8, 4.0), "nodeHeightIn": (0.4, 2.0), "columnGapIn": (0.35, 2.0), "rowGapIn": (0.35, 2.0), "fontSizePt": (8.0, 24.0)}


def check_graph_details(nodes: DataFrame, edges: DataFrame, layout: DataFrame) -> DataFrame:
    """(graph_id, problem) beyond check_graphs: node types, texts, grid places (all or none, 0 to 59, none twice), edge labels, layout measures.

    nodes: graph_id, id, text, type, row, col; edges: graph_id, src, dst, label; layout: graph_id, key, value.
    """
    told, row, col = lambda text, most: (F.trim(F.coalesce(text, F.lit(""))) != "") & (F.length(text) <= most), F.col("row"), F.col("col")
    tests = {
        "node_id_length": ~told(F.col("id"), 80), "node_text": ~told(F.col("text"), 200), "node_type": ~F.coalesce("type", F.lit("process")).isin(*NODE_TYPES),
        "grid_cell": (row.isNotNull() | col.isNotNull()) & ~F.coalesce(row.between(0, 59) & col.between(0, 59), F.lit(False)),
    }
    of_nodes = nodes.select("graph_id", F.explode(F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in tests.items()]), lambda x: x.isNotNull())).alias("problem"))
    placed = row.isNotNull() | col.isNotNull()
    per_graph = nodes.groupBy("graph_id").agg(F.count_if(placed).alias("placed"), F.count("*").alias("n"))
    found = [
        of_nodes,
        per_graph.where("placed > 0 AND placed < n").select("graph_id", F.lit("some_placed").alias("problem")),
        duplicates(nodes.where(row.isNotNull() & col.isNotNull()), ["graph_id", "row", "col"]).select("graph_id", F.lit("overlap").alias("problem")),
        edges.where(F.col("label").isNotNull() & ~told(F.col("label"), 40)).select("graph_id", F.lit("edge_label").alias("problem")),
    ]
    bounds = F.create_map(*[x for k, (low, high) in LAYOUT_RANGES.items() for x in (F.lit(k), F.array(F.lit(low), F.lit(high)))])
    within = F.coalesce(F.col("value").between(F.try_element_at(bounds, F.col("key"))[0], F.try_element_at(bounds, F.col("key"))[1]), F.lit(False))
    known = F.col("key").isin(*LAYOUT_RANGES)
    found.append(layout.where(~known | ~within).select("graph_id", F.when(known, "layout_range").otherwise("layout_key").alias("problem")))
    return reduce(DataFrame.unionByName, found).distinct()


def reachable(edges: DataFrame) -> DataFrame:
    """(graph_id, a, b): b can be reached from a. Paths double each round, until one adds nothing."""
    pairs = edges.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    n = pairs.count()
    while True:
        step = pairs.select(F.col("graph_id").alias("_g"), F.col("a").alias("_a"), F.col("b").alias("_b"))
        more = pairs.join(step, (F.col("graph_id") == F.col("_g")) & (F.col("b") == F.col("_a"))).select("graph_id", "a", F.col("_b").alias("b"))
        pairs = checkpointed(pairs.unionByName(more).distinct())
        now = pairs.count()
        if now == n:
            return pairs
        n = now


def return_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges to an equal or earlier node of the same cycle."""
    ords = nodes.select(F.col("graph_id").alias("_g"), F.col("id").alias("_id"), F.col("ord").alias("_ord"))
    at = lambda end: ords.withColumnsRenamed({"_g": f"_g_{end}", "_id": f"_id_{end}", "_ord": f"_ord_{end}"})
    rows = edges
    for end in ("src", "dst"):
        rows = rows.join(at(end), (F.col("graph_id") == F.col(f"_g_{end}")) & (F.col(end) == F.col(f"_id_{end}")))
    back = reachable(edges).select(F.col("graph_id").alias("_rg"), F.col("a").alias("_ra"), F.col("b").alias("_rb"))
    rows = rows.where(F.col("_ord_dst") <= F.col("_ord_src"))
    return rows.join(back, (F.col("graph_id") == F.col("_rg")) & (F.col("dst") == F.col("_ra")) & (F.col("src") == F.col("_rb")), "left_semi").select("graph_id", "src", "dst")


def grid_positions(nodes: DataFrame, forward: DataFrame) -> DataFrame:
    """(graph_id, id, row, col): longest-path rank over forward edges, and a centred half-grid column.

    A round raises ranks along edges; rounds end when one changes nothing. Forward
    edges hold no cycle; one that does is an error.
    """
    rank, forward = checkpointed(nodes.select("graph_id", "id", "ord", F.lit(0).alias("row"))), checkpointed(forward)
    most_rank = nodes.groupBy("graph_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    total = 0
    while True:
        up = forward.join(rank.select(F.col("graph_id").alias("_g"), F.col("id").alias("_id"), F.col("row").alias("_row")), (F.col("graph_id") == F.col("_g")) & (F.col("src") == F.col("_id")))
        most = up.groupBy(F.col("graph_id").alias("_g"), F.col("dst").alias("_id")).agg((F.max("_row") + 1).alias("_row"))
        rank = checkpointed(rank.join(most, (F.col("graph_id") == F.col("_g")) & (F.col("id") == F.col("_id")), "left").select("graph_id", "id", "ord", F.greatest("row", F.coalesce("_row", F.lit(0))).alias("row")))
        now, deepest = rank.agg(F.sum("row"), F.max("row")).first()
        if (now or 0) == total:
            break
        if deepest >= most_rank:
            raise ValueError("the forward edges hold a cycle")
        total = now
    slot = F.row_number().over(W.partitionBy("graph_id", "row").orderBy("ord")) - 1
    width = F.count("*").over(W.partitionBy("graph_id", "row"))
    rows = rank.withColumns({"_slot": slot, "_width": width})
    return rows.withColumn("_most", F.max("_width").over(W.partitionBy("graph_id"))).select("graph_id", "id", "row", (F.col("_slot") * 2 + F.col("_most") - F.col("_width")).alias("col"))
