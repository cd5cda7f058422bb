"""Templates to draft profiles, numbering, paragraph overlays, nested tables (R-4, R-7, J-13, J-14, F-7, T-1, T-3, T-4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.units import lookup, pt_to_twips
from quire.operators.compare import closest_page_size, style_chain
from quire.sources.lineage import checkpointed

INDENTS = ("firstLine", "firstLineChars", "hanging", "hangingChars")
# Names of alignments in profiles and in documents, and of heading formats.
ALIGNMENTS = {"left": "left", "center": "center", "right": "right", "justify": "both"}
HEADING_FORMATS = {"decimal": "decimal", "chineseCounting": "chinese-counting", "chineseCountingThousand": "chinese-counting-thousand", "lowerRoman": "lower-roman", "upperRoman": "upper-roman", "lowerLetter": "lower-alpha", "upperLetter": "upper-alpha", "decimalFullWidth": "decimal-full-width"}


def overlay_para(rows: DataFrame, rule: dict, size_pt: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with the rule's paragraph properties, and the rows that refuse it.

    rows: alignment, line, line_rule, before, after, firstLine, firstLineChars,
    hanging, hangingChars (twips and hundredths), and inherited_<indent> of each
    indent. Line spacing in multiples displaces an exact one and the other way
    round. A physical indent displaces the row's other indents; over an inherited
    competing one it is refused; an explicit zero cancels all four.
    """
    if "line_spacing" in rule and "line_exact_pt" in rule or "hanging_in" in rule and ({"first_line_in", "first_line_chars"} & rule.keys()) or {"first_line_in", "first_line_chars"} <= rule.keys():
        raise ValueError("contradicting keys in one rule")
    new: dict[str, Column] = {}
    if "alignment" in rule:
        new["alignment"] = F.lit(ALIGNMENTS[rule["alignment"]])
    for key, name in (("space_before_pt", "before"), ("space_after_pt", "after")):
        if key in rule:
            new[name] = pt_to_twips(F.lit(float(rule[key])))
    if "line_spacing" in rule:
        new |= {"line": F.bround(F.lit(float(rule["line_spacing"])) * 240).cast("long"), "line_rule": F.lit("auto")}
    if "line_exact_pt" in rule:
        new |= {"line": pt_to_twips(F.lit(float(rule["line_exact_pt"]))), "line_rule": F.lit("exact")}
    refused = F.lit(False)
    if "first_line_chars" in rule:
        kind, value = "firstLine", round(rule["first_line_chars"] * (size_pt or 12) * 20)
    elif "hanging_in" in rule or "first_line_in" in rule:
        kind = "hanging" if "hanging_in" in rule else "firstLine"
        value = round(rule.get("hanging_in", rule.get("first_line_in")) * 1440)
    else:
        kind, value = None, 0
    if kind and value:
        opposite = "hanging" if kind == "firstLine" else "firstLine"
        for name in ("firstLineChars", "hangingChars", opposite):
            refused = refused | F.col(f"inherited_{name}").isNotNull()
        new |= {name: F.lit(value).cast("long") if name == kind else F.lit(None).cast("long") for name in INDENTS}
    elif kind:
        new |= {name: F.lit(0).cast("long") for name in INDENTS}
    marked = rows.withColumn("_refused", refused)
    return marked.where("NOT _refused").drop("_refused").withColumns(new), marked.where("_refused").drop("_refused")


def heading_numbering(styles: DataFrame, num: DataFrame, levels: DataFrame) -> DataFrame:
    """(doc_id, styles, patterns, formats, starts, suffix): the numbering of the headings, in the order of the levels.

    styles: doc_id, style_id, style_name, num_id, ilvl; num: doc_id, num_id,
    abstract_id; levels: doc_id, abstract_id, ilvl, pattern, format, start, p_style,
    suffix. From heading styles that name a list, else from the first list that names
    headings; left out where a pattern lacks the number of its place.
    """
    heading = F.col("style_id").rlike("^(Heading)?[1-5]$") | F.lower(F.coalesce("style_name", F.lit(""))).startswith("heading")
    own = styles.where(heading & F.col("num_id").isNotNull()).select("doc_id", "style_id", "num_id", F.coalesce("ilvl", F.lit(0)).alias("ilvl")).join(num, ["doc_id", "num_id"]).join(levels, ["doc_id", "abstract_id", "ilvl"])
    fields = ("ilvl", "style", "pattern", "format", "start", "suffix")
    own = own.select("doc_id", "ilvl", F.col("style_id").alias("style"), "pattern", "format", "start", "suffix")
    named = levels.where(F.col("p_style").rlike("^([1-5]$|Heading)")).withColumn("_first", F.min("abstract_id").over(W.partitionBy("doc_id"))).where("abstract_id = _first")
    other = named.select("doc_id", "ilvl", F.col("p_style").alias("style"), "pattern", "format", "start", "suffix").join(own.select("doc_id").distinct(), "doc_id", "left_anti")
    rows = own.unionByName(other).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("l"))
    fits = F.forall(F.transform("l", lambda x, i: x["pattern"].contains(F.concat(F.lit("%"), (i + 1).cast("string")))), lambda ok: ok)
    pick = lambda f: F.transform("l", f)
    suffix = F.coalesce(F.col("l")[0]["suffix"], F.lit("space"))
    return rows.where(fits).select(
        "doc_id", pick(lambda x: x["style"]).alias("styles"), pick(lambda x: x["pattern"]).alias("patterns"), pick(lambda x: F.coalesce(lookup(x["format"], HEADING_FORMATS), F.lit("decimal"))).alias("formats"), pick(lambda x: F.coalesce(x["start"], F.lit(1))).alias("starts"),
        F.when(suffix.isin("nothing", "tab"), suffix).otherwise("space").alias("suffix"),
    )


def set_heading_numbering(styles: DataFrame, rule: list[str], num_id: int) -> DataFrame:
    """Heading styles linked to a list: the style at place i gets level i of the list; own earlier links are replaced."""
    level = F.array_position(F.array(*map(F.lit, rule)), F.col("style_id")) - 1
    hit = level >= 0
    return styles.withColumns({"num_id": F.when(hit, F.lit(num_id)).otherwise(F.col("num_id")), "ilvl": F.when(hit, level.cast("int")).otherwise(F.col("ilvl"))})


def upsert_numbering(levels: DataFrame, styles: DataFrame, rule: dict, owner: str = "quire") -> tuple[DataFrame, DataFrame]:
    """The lists of each document with one for its headings, and the styles linked to it.

    levels: doc_id, abstract_id, owner, ilvl, pattern, format, start, p_style, suffix;
    styles: doc_id, style_id, num_id, ilvl. rule: styles, patterns, formats, starts,
    suffix. A list of our own from an earlier run is replaced under its id; else the
    new one gets the id after the document's largest.
    """
    ids = levels.groupBy("doc_id").agg(F.min(F.when(F.col("owner") == owner, F.col("abstract_id"))).alias("_own"), F.max("abstract_id").alias("_top"))
    docs = styles.select("doc_id").distinct().join(ids, "doc_id", "left").select("doc_id", F.coalesce("_own", F.col("_top") + 1, F.lit(0)).cast("int").alias("abstract_id"))
    new = F.array(*[F.struct(F.lit(i).alias("ilvl"), F.lit(rule["patterns"][i]).alias("pattern"), F.lit(rule["formats"][i]).alias("format"), F.lit(rule["starts"][i]).alias("start"), F.lit(s).alias("p_style")) for i, s in enumerate(rule["styles"])])
    rows = docs.select("doc_id", "abstract_id", F.lit(owner).alias("owner"), F.explode(new).alias("l"), F.lit(rule.get("suffix", "space")).alias("suffix")).select("doc_id", "abstract_id", "owner", "l.*", "suffix")
    kept = levels.join(docs, ["doc_id", "abstract_id"], "left_anti")
    linked = styles.join(docs.withColumnRenamed("abstract_id", "_id"), "doc_id")
    level = F.array_position(F.array(*map(F.lit, rule["styles"])), F.col("style_id")) - 1
    linked = linked.withColumns({"num_id": F.when(level >= 0, F.col("_id")).otherwise(F.col("num_id")), "ilvl": F.when(level >= 0, level.cast("int")).otherwise(F.col("ilvl"))}).drop("_id")
    return kept.unionByName(rows), linked


def upsert_styles_checked(docs: DataFrame, styles: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """All styles of each document after the rules, and ``problem`` where an indent rule can't hold.

    styles: doc_id, style_id, name, based_on, next, and properties. Values of a rule
    replace those of a style; a ruled style that a document lacks is created (name: its
    id, based on and followed by Normal unless the rule says else). After all rules
    are applied, a style whose own first line or hanging indent isn't zero and which
    inherits a competing indent in characters is marked. One join for all rules.
    """
    names = [c for c in styles.columns if c not in ("doc_id", "style_id")]
    kinds = {c: styles.schema[c].dataType for c in names}
    plain = {k: {"name": v.get("name"), "based_on": v.get("based_on"), "next": v.get("next"), **{c: v.get(c) for c in names if c not in ("name", "based_on", "next")}} for k, v in rules.items()}
    entries = F.array(*[F.struct(F.lit(k).alias("style_id"), *[F.lit(v[c]).cast(kinds[c]).alias(f"_{c}") for c in names]) for k, v in plain.items()])
    wanted = docs.select("doc_id", F.explode(entries).alias("w")).select("doc_id", "w.*", F.lit(True).alias("_ruled"))
    rows = styles.withColumn("_has", F.lit(True)).join(wanted, ["doc_id", "style_id"], "full")
    new = F.col("_has").isNull()
    defaults = {"name": F.col("style_id"), "based_on": F.when(F.col("style_id") != "Normal", "Normal"), "next": F.when(F.col("style_id") != "Normal", "Normal")}
    rows = rows.select("doc_id", "style_id", *[F.coalesce(F.col(f"_{c}"), F.col(c), F.when(new, defaults[c]) if c in defaults else F.lit(None)).alias(c) for c in names], F.coalesce("_ruled", F.lit(False)).alias("_ruled"))
    chain = style_chain(rows.select("doc_id", "style_id", "based_on")).where("depth > 0")
    above = rows.select(F.col("doc_id").alias("_d"), F.col("style_id").alias("_s"), F.col("first_line_chars").alias("_f"), F.col("hanging_chars").alias("_h"))
    inherited = chain.join(above, (F.col("doc_id") == F.col("_d")) & (F.col("ancestor") == F.col("_s"))).groupBy("doc_id", "style_id").agg(F.bool_or((F.coalesce("_f", F.lit(0)) != 0) | (F.coalesce("_h", F.lit(0)) != 0)).alias("_competes"))
    own = (F.coalesce("first_line_in", F.lit(0)) != 0) | (F.coalesce("hanging_in", F.lit(0)) != 0)
    return rows.join(inherited, ["doc_id", "style_id"], "left").select("doc_id", "style_id", *names, F.when(F.col("_ruled") & own & F.coalesce("_competes", F.lit(False)), "competing_indent").alias("problem"))


def draft_profile(sections: DataFrame, refs: DataFrame, defaults: DataFrame, styles: DataFrame) -> DataFrame:
    """(doc_id, family, item, property, value): a draft profile of each template, empty values left out.

    The first section's page, the default run, the given styles, each section's page
    numbers, and a row that inherits each header and footer reference. defaults:
    doc_id and properties; styles: doc_id, style_id and properties.
    """
    def melted(rows: DataFrame, family: str, item: Column, columns: dict[str, Column]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(k).alias("property"), c.cast("string").alias("value")) for k, c in columns.items()])
        return rows.select("doc_id", F.lit(family).alias("family"), item.cast("string").alias("item"), F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("p")).select("doc_id", "family", "item", "p.*")

    page = draft_page(sections)
    own = lambda df, *skip: {c: F.col(c) for c in df.columns if c not in ("doc_id", *skip)}
    none = F.lit(None)
    numbers = {"format": F.coalesce(lookup(F.col("num_fmt"), PAGE_FORMATS), F.col("num_fmt")), "start": F.col("num_start")}
    inherit = refs.withColumn("_item", F.concat_ws(":", "section_idx", "kind", "ref_type"))
    parts = [
        melted(page, "page", none, own(page)), melted(defaults, "defaultRun", none, own(defaults)), melted(styles, "styles", F.col("style_id"), own(styles, "style_id")),
        melted(sections, "pageNumbers", F.col("section_idx"), numbers), melted(inherit, "headersFooters", F.col("_item"), {"action": F.lit("inherit")}),
    ]
    return reduce(DataFrame.unionByName, parts)


# Page number formats of documents and of profiles, and what a draft leaves open.
PAGE_FORMATS = {"decimal": "decimal", "lowerRoman": "lower-roman", "upperRoman": "upper-roman", "lowerLetter": "lower-alpha", "upperLetter": "upper-alpha"}
NOTES = ("no_east_asian_font", "no_page_numbers", "no_placeholders", "no_toc_field")


def draft_notes(docs: DataFrame, defaults: DataFrame, sections: DataFrame, placeholders: DataFrame, fields: DataFrame) -> DataFrame:
    """(doc_id, notes): what a person must settle before a draft is used.

    defaults: doc_id, east_asia; placeholders: doc_id, token; fields: doc_id, kind.
    """
    font = defaults.groupBy("doc_id").agg(F.bool_or(F.col("east_asia").isNotNull()).alias("_font"))
    numbers = sections.groupBy("doc_id").agg(F.bool_or(F.col("num_fmt").isNotNull() | F.col("num_start").isNotNull()).alias("_numbers"))
    tokens = placeholders.groupBy("doc_id").agg(F.lit(True).alias("_tokens"))
    toc = fields.groupBy("doc_id").agg(F.bool_or(F.col("kind") == "TOC").alias("_toc"))
    rows = docs.select("doc_id")
    for df in (font, numbers, tokens, toc):
        rows = rows.join(df, "doc_id", "left")
    lacks = zip(NOTES, ("_font", "_numbers", "_tokens", "_toc"), strict=True)
    return rows.select("doc_id", F.filter(F.array(*[F.when(~F.coalesce(F.col(c), F.lit(False)), n) for n, c in lacks]), lambda x: x.isNotNull()).alias("notes"))


def caption_strategy(formats: Column) -> Column:
    return F.when(F.try_element_at(formats, F.lit(1)).startswith("chinese"), "styleref-arabic").otherwise("styleref-as-displayed")


def draft_page(sections: DataFrame) -> DataFrame:
    """(doc_id, size, orientation, margins): the page of each document's first section, named where its size is near a named one."""
    first = sections.where("section_idx = 0")
    size = closest_page_size(F.col("width_in"), F.col("height_in"))
    wide = F.coalesce(F.col("orientation") == "landscape", F.lit(False)) | (F.col("width_in") > F.col("height_in"))
    return first.select("doc_id", size.alias("size"), F.when(size.isNull(), F.col("width_in")).alias("width_in"), F.when(size.isNull(), F.col("height_in")).alias("height_in"), F.when(wide, "landscape").otherwise("portrait").alias("orientation"), "left_in", "right_in", "top_in", "bottom_in")


def draft_checks(sections: DataFrame, usage: DataFrame, fields: DataFrame) -> DataFrame:
    """(doc_id, min_sections, styles_used, required_fields): what a document drafted from this template must have."""
    n = sections.groupBy("doc_id").agg(F.count("*").alias("min_sections"))
    used = usage.where("style_id != '(none)'").groupBy("doc_id").agg(F.array_sort(F.collect_set("style_id")).alias("styles_used"))
    kinds = fields.where(F.col("kind").isin("TOC", "PAGE")).groupBy("doc_id").agg(F.array_sort(F.collect_set("kind")).alias("required_fields"))
    return n.join(used, "doc_id", "left").join(kinds, "doc_id", "left")


def body_tables(tables: DataFrame) -> DataFrame:
    """Outer tables of the body, not in text boxes, with their index among these. tables: doc_id, table_idx, parent_idx, in_text_box."""
    outer = tables.where(F.col("parent_idx").isNull() & ~F.coalesce("in_text_box", F.lit(False)))
    return outer.withColumn("body_idx", F.row_number().over(W.partitionBy("doc_id").orderBy("table_idx")) - 1)


def table_geometry(tables: DataFrame, cells: DataFrame, page_width: Column) -> DataFrame:
    """(doc_id, table_idx, container_in, width_in, top_idx): widths handed down the nesting, a level a round.

    tables: doc_id, table_idx, parent_idx, parent_cell, pref_in, columns; cells:
    doc_id, table_idx, cell_idx, width_in, grid_in (what its spanned columns sum to,
    if the table has a grid). A table is as wide as its preference, else as its
    container; a cell as its own width, else its grid's, else an equal share of its table.
    """
    width = F.coalesce("pref_in", "container_in")
    done = tables.where("parent_idx IS NULL").withColumn("container_in", page_width).select("doc_id", "table_idx", "container_in", width.alias("width_in"), F.col("table_idx").alias("top_idx"), "columns")
    front, out = done, done
    while True:
        up = front.select("doc_id", F.col("table_idx").alias("parent_idx"), F.col("width_in").alias("_w"), "top_idx", F.col("columns").alias("_n"))
        inner = tables.join(up, ["doc_id", "parent_idx"]).join(cells.select("doc_id", F.col("table_idx").alias("parent_idx"), F.col("cell_idx").alias("parent_cell"), F.coalesce("width_in", "grid_in").alias("_cell")), ["doc_id", "parent_idx", "parent_cell"], "left")
        inner = inner.withColumn("container_in", F.coalesce("_cell", F.col("_w") / F.col("_n")))
        front = checkpointed(inner.select("doc_id", "table_idx", "container_in", width.alias("width_in"), "top_idx", "columns"))
        if front.isEmpty():
            return out.drop("columns")
        out = out.unionByName(front)
