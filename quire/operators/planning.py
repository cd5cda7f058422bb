"""Repair plans from findings and layout issues: steps, selection, summaries, compliance (P-23, P-24, P-27, F-5, J-17, A-7 to A-9, J-18, O-2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.units import lookup

# Actions by category of a finding and by type of a layout issue.
ACTIONS = {"page": "set_page", "pageNumbers": "set_page_number", "headersFooters": "set_header_footer", "tables": "set_table", "structure": "map_structure", "paragraph": "set_paragraph", "run": "set_run", "style": "set_style"}
VISUAL = {"orphan_heading": "set_keep_next", "orphan_heading_risk": "set_keep_next", "heading_body_split": "set_keep_next", "figure_caption_split": "set_keep_next", "table_caption_split": "set_keep_next", "image_overflow": "scale_drawing", "chapter_midpage": "set_page_break_before"}
AUTO = ("set_default_run", "set_style", "set_paragraph", "set_run", "set_page", "set_page_number", "set_header_footer", "set_table", "set_keep_next", "scale_drawing")
CONFIRM = ("map_structure", "inspect", "set_page_break_before")


def plan_columns(name: Column, category: Column) -> dict[str, Column]:
    """action, target and property of a finding."""
    action = F.when(name.startswith("defaultRun"), "set_default_run").when(name.startswith("styles.") | (category.isin("paragraph", "run") & name.contains("styles.")), "set_style").otherwise(F.coalesce(lookup(category, ACTIONS), F.lit("inspect")))
    target = F.when(name.startswith("styles."), F.split_part(name, F.lit("."), F.lit(2))).when(name.startswith("defaultRun"), "defaultRun").when(name.contains("section["), name).otherwise(F.coalesce(category, name))
    return {"action": action, "target": target, "property": F.substring_index(name, ".", -1)}


def annotated(steps: DataFrame, *order: str) -> DataFrame:
    """Numbers the steps of a document and adds id, auto and confirm."""
    number = F.row_number().over(W.partitionBy("doc_id").orderBy(*order))
    exists = F.col("property") == "exists"
    return steps.withColumn("step_no", number).withColumns({
        "id": F.concat(F.lit("s"), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")), F.lit("-"), F.col("source")),
        "auto": F.col("action").isin(*AUTO) & ~exists,
        "confirm": F.col("action").isin(*CONFIRM) | exists,
        "reversible": ~F.col("action").isin("map_structure", "inspect"),
    })


def finding_steps(findings: DataFrame) -> DataFrame:
    """Steps of the findings that failed, in the order of idx."""
    rows = findings.where("NOT ok").withColumns(plan_columns(F.col("name"), F.col("category")))
    return annotated(rows.withColumn("source", F.col("name")).withColumn("visual", F.lit(False)), "idx")


def issue_steps(issues: DataFrame) -> DataFrame:
    """Steps of layout issues; chapters amid a page are for information only."""
    rows = issues.where("NOT (severity = 'info' AND type = 'chapter_midpage')")
    rows = rows.withColumns({"action": F.coalesce(lookup(F.col("type"), VISUAL), F.lit("inspect")), "target": F.format_string("paragraph[%d]", F.col("idx")), "property": F.col("type"), "source": F.col("type"), "visual": F.lit(True)})
    return annotated(rows, "idx", "type")


def select_steps(steps: DataFrame, only: list[str] | None = None, skip: list[str] | None = None, only_auto: bool = False, page_breaks: bool = False) -> DataFrame:
    """Steps that a run may take: listed ids, and what needs no confirmation."""
    listed = F.col("id").isin(only) if only else F.lit(False)
    keep = ~F.col("id").isin(skip or [""]) & (listed if only else F.lit(True))
    if only_auto:
        keep = keep & F.col("auto")
    if not page_breaks:
        keep = keep & ((F.col("action") != "set_page_break_before") | listed)
    return steps.where(keep & (~F.col("action").isin(*CONFIRM) | listed))


def steps_to_issues(steps: DataFrame) -> DataFrame:
    rows = steps.where(F.col("visual") | F.col("action").isin("set_keep_next", "scale_drawing", "set_page_break_before"))
    return rows.select("doc_id", "idx", F.coalesce("source", "property").alias("type"), F.coalesce("severity", F.lit("warning")).alias("severity"), F.col("action").alias("repair"))


def narrowed_keys(steps: DataFrame) -> DataFrame:
    """(doc_id, rule, key): the profile rules that the selected steps touch, by family and key."""
    action, source = F.col("action"), F.col("source")
    style = F.when(action.isin("set_style", "set_paragraph", "set_run"), F.when(source.startswith("styles."), F.split_part(source, F.lit("."), F.lit(2))).otherwise(F.col("target")))
    section = F.regexp_extract(source, r"section\[(\d+)\]", 1)
    kinds = F.array(
        F.when(style.isNotNull(), F.struct(F.lit("styles").alias("rule"), style.alias("key"))),
        F.when(action == "set_page", F.struct(F.lit("page").alias("rule"), F.lit("*").alias("key"))),
        F.when((action == "set_page_number") & (section != ""), F.struct(F.lit("pageNumbers").alias("rule"), section.alias("key"))),
    )
    rows = steps.where("NOT visual").select("doc_id", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k"))
    return rows.select("doc_id", "k.rule", "k.key").distinct()


def plan_summary(steps: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(F.col(c))
    return steps.groupBy("doc_id").agg(F.count("*").alias("failed"), n("auto").alias("auto"), n("confirm").alias("confirm"), n("visual").alias("visual"))


def dedupe_issues(issues: DataFrame, keys: tuple[str, ...] = ("type", "idx")) -> DataFrame:
    """Drops heading risks where the same paragraph has a stronger issue, and repeated keys.

    One window over a paragraph's issues sees the stronger ones, so no join is needed.
    """
    stronger = F.max(F.col("type").isin("orphan_heading", "heading_body_split").cast("int")).over(W.partitionBy("doc_id", "idx"))
    rows = issues.withColumn("_strong", stronger).where("NOT (type = 'orphan_heading_risk' AND _strong = 1)").drop("_strong")
    return rows.dropDuplicates(["doc_id", *keys])


def layout_verdict(issues: DataFrame) -> DataFrame:
    errors, warnings = F.count_if(F.col("severity") == "error"), F.count_if(F.col("severity") == "warning")
    return issues.groupBy("doc_id").agg(errors.alias("errors"), warnings.alias("warnings"), F.when(errors > 0, "failed").when(warnings > 0, "passed_with_warnings").otherwise("passed").alias("status"))


def compliance(scores: DataFrame, categories: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Blends the visual score into the overall one, weighed as one category among the others."""
    n = categories.groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = scores.join(n, "doc_id").join(verdicts, "doc_id", "left")
    errors, warnings = F.coalesce("errors", F.lit(0)), F.coalesce("warnings", F.lit(0))
    visual = F.greatest(F.lit(0.0), 100.0 - errors * 12 - warnings * 3)
    tenths = F.round(F.col("overall") * 10).cast("long") * F.greatest(F.col("n"), F.lit(1)) + F.round(visual * 10).cast("long")
    overall = F.round(tenths / ((F.col("n") + 1) * 10), 1)
    return rows.select("doc_id", overall.alias("overall"), visual.alias("visual"), (F.col("ok") & (errors == 0)).alias("ok"))


def top_failures(findings: DataFrame, n: int = 40) -> DataFrame:
    return findings.where("NOT ok").withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy("idx"))).where(F.col("rank") <= n)


MAPPING = ("paragraphRules", "captionRules", "bookmarkRules", "replacements", "fieldRules", "headingNumbering")


def narrow_profile(rules: DataFrame, steps: DataFrame) -> DataFrame:
    """(doc_id and the columns of the rules): of a profile's rule rows, those that the selected steps of each document touch.

    rules: family, item (place in the family, or a style's id), bucket, property, value.
    A style keeps the properties that steps name, or all if its existence is at stake or
    none is named that it has. Page numbers, headers and tables keep the items that
    sources name; the first two all of theirs if none is named. Mapping families stay
    only where a step comes from one. Steps of the layout alone keep nothing.
    """
    s = steps.where("NOT visual")
    action, source = F.col("action"), F.col("source")
    number = F.regexp_extract(source, r"\[(\d+)\]", 1)
    style = F.when(source.startswith("styles."), F.split_part(source, F.lit("."), F.lit(2))).otherwise(F.col("target"))
    is_style = action.isin("set_style", "set_paragraph", "set_run")
    family = (
        F.when(is_style, "styles").when(action == "set_page", "page").when(action == "set_default_run", "defaultRun").when((action == "set_table") & source.startswith("tableRules["), "tableRules")
        .when(action == "set_page_number", "pageNumbers").when(action == "set_header_footer", "headersFooters")
    )
    item = F.when(is_style, style).when(action == "set_page_number", F.regexp_extract(source, r"section\[(\d+)\]", 1)).when(source.rlike(r"^(tableRules|headersFooters)\["), number)
    asked = s.select("doc_id", family.alias("_family"), F.when(item != "", item).alias("_item"), F.col("property").alias("_property")).where("_family IS NOT NULL")
    asked = asked.unionByName(asked.where("_family = 'page'").withColumn("_family", F.lit("sections")))
    # What a document's steps name of each family: its items, and of a style its properties.
    named = asked.groupBy("doc_id", "_family").agg(F.collect_set("_item").alias("_items"), F.collect_set(F.struct("_item", "_property")).alias("_pairs"))
    mapping = F.coalesce(*[F.when(source.startswith(m), F.lit(True)) for m in MAPPING], F.lit(False))
    mapped = s.groupBy("doc_id").agg(F.bool_or(mapping).alias("_m")).where("_m").select("doc_id", F.explode(F.array(*map(F.lit, MAPPING))).alias("_family"), F.expr("CAST(array() AS array<string>)").alias("_items"), F.expr("CAST(array() AS array<struct<_item:string,_property:string>>)").alias("_pairs"))
    pair = F.struct(F.col("item").alias("_item"), F.col("property").alias("_property"))
    # What a style's rules have, beside each of them, so that a document's rules needn't be sorted to tell whether any is named.
    has = rules.where("family = 'styles'").groupBy(F.col("family").alias("_f"), F.col("item").alias("_i")).agg(F.collect_set(pair).alias("_has"))
    rules = rules.join(F.broadcast(has), (F.col("family") == F.col("_f")) & (F.col("item") == F.col("_i")), "left")
    both = named.unionByName(mapped).join(rules, F.col("_family") == F.col("family"))
    listed = F.array_contains("_pairs", pair)
    here = F.array_contains("_items", F.col("item"))
    exists = F.exists("_pairs", lambda p: (p["_item"] == F.col("item")) & (p["_property"] == "exists"))
    named_one = F.coalesce(F.arrays_overlap("_pairs", "_has"), F.lit(False))
    keep = F.when(F.col("family") == "styles", here & (listed | exists | ~named_one)).when(F.col("family") == "tableRules", here).when(F.col("family").isin("pageNumbers", "headersFooters"), here | (F.size("_items") == 0)).otherwise(F.lit(True))
    return both.where(keep).select("doc_id", "family", "item", "bucket", "property", "value")


# What a person must look at after every run.
ALWAYS_REVIEW = ("refresh field results", "cover, floating objects, macros")


def review(findings: DataFrame, validation: DataFrame, steps: DataFrame) -> DataFrame:
    """(doc_id, structure_failed, validation_failed, must_review): failed structure findings and validations, and what needs a person.

    validation: doc_id, ok. must_review: the steps to be confirmed, by number, and what always stays.
    """
    structure = findings.groupBy("doc_id").agg(F.count_if(~F.col("ok") & (F.col("category") == "structure")).alias("structure_failed"))
    failed = validation.groupBy("doc_id").agg(F.count_if(~F.col("ok")).alias("validation_failed"))
    told = F.concat(F.col("id"), F.lit(": "), F.col("action"))
    asked = F.transform(F.array_sort(F.collect_list(F.when(F.col("confirm"), F.struct("step_no", told.alias("t"))))), lambda x: x["t"])
    rows = structure.join(failed, "doc_id", "full").join(steps.groupBy("doc_id").agg(asked.alias("asked")), "doc_id", "full").na.fill(0, ["structure_failed", "validation_failed"])
    always = F.array(*map(F.lit, ALWAYS_REVIEW))
    return rows.select("doc_id", "structure_failed", "validation_failed", F.concat(F.coalesce("asked", F.expr("CAST(array() AS array<string>)")), always).alias("must_review"))
