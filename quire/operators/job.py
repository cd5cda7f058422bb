"""The whole compliance run over document tables (N-1), all rule families in order (R-16), specification and report sources (S-4, S-8), unions (U-1, U-2), drafts (T-2, P-26)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import html_to_text
from quire.functions.units import field_kind
from quire.operators import compare, layout, planning, rules, structure, templates
from quire.operators import tables as three_lines
from quire.sources.lineage import stored


def read_specs(spark: SparkSession, path: str, html: bool = False) -> DataFrame:
    """(spec_id, text): one row per text, Markdown or HTML file."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("spec_id"), F.col("value").alias("text"))
    return rows.withColumn("text", html_to_text(F.col("text"))) if html else rows


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def write_run(tables: dict[str, DataFrame], path: str, force: bool = False) -> str:
    """Writes the tables of a run, all or none of them, and returns the run's id.

    Each table goes as Parquet into a folder of the run, and last a manifest, written
    aside and renamed, names that folder: readers (``read_run``) see the old run or the
    new one, whole. A run that fails leaves its folder unnamed, and the next one that
    succeeds removes what no manifest names. An existing run is an error unless forced;
    a path that the tables are read from always is, but for an older run there, which a
    new one leaves where it is until it is complete.
    """
    spark = next(iter(tables.values())).sparkSession
    plain = lambda p: "/" + p.split("://", 1)[-1].split(":", 1)[-1].strip("/") + "/"
    target, fs = _path(spark, f"{path}/_manifest.json")
    old = fs.exists(target)
    for name, df in tables.items():
        if any(plain(f).startswith(plain(path)) and not plain(f).startswith(plain(path) + "run=") for f in df.inputFiles()):
            raise ValueError(f"{name} is read from {path}: input and output are the same")
    if old and not force:
        raise FileExistsError(f"PATH_ALREADY_EXISTS: {path} holds a run")
    run = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/run={run}/artifact={name}")
    aside, _ = _path(spark, f"{path}/_manifest-{run}.json")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps({"run": run, "tables": sorted(tables)}).encode()))
    out.close()
    replaced = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    renames = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    renames[0] = replaced
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, target, renames)
    root, _ = _path(spark, path)
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("run=") and name != f"run={run}":
            fs.delete(status.getPath(), True)
    return run


def run_exists(spark: SparkSession, path: str) -> bool:
    target, fs = _path(spark, f"{path}/_manifest.json")
    return fs.exists(target)


def read_run(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the run that the manifest names."""
    target, fs = _path(spark, f"{path}/_manifest.json")
    stream = fs.open(target)
    manifest = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    stream.close()
    return {name: spark.read.parquet(f"{path}/run={manifest['run']}/artifact={name}") for name in manifest["tables"]}


def numbered_union(*families: DataFrame) -> DataFrame:
    """The rows of all families, with the number of their family as ``family``."""
    out = families[0].withColumn("family", F.lit(0))
    for i, rows in enumerate(families[1:], 1):
        out = out.unionByName(rows.withColumn("family", F.lit(i)), allowMissingColumns=True)
    return out


def draft_fields(fields: DataFrame) -> DataFrame:
    """The first field of each kind that a draft keeps (TOC) or notes (CITATION, BIBLIOGRAPHY, SEQ, STYLEREF)."""
    rows = fields.withColumn("kind", field_kind(F.col("instruction"))).where(F.col("kind").isin("TOC", "CITATION", "BIBLIOGRAPHY", "SEQ", "STYLEREF"))
    first = rows.withColumn("_r", F.row_number().over(W.partitionBy("doc_id", "kind").orderBy("ord"))).where("_r = 1")
    return first.select("doc_id", "kind", "instruction", F.when(F.col("kind") == "TOC", "keep").otherwise("note").alias("action"))


def set_sections(sections: DataFrame, rules: dict[int, dict]) -> DataFrame:
    """Overrides of listed columns of single sections."""
    columns = {}
    for at, values in rules.items():
        for key, value in values.items():
            columns[key] = F.when(F.col("section_idx") == at, F.lit(value)).otherwise(columns.get(key, F.col(key)))
    return sections.withColumns(columns)


def out_of_range(docs: DataFrame, sections: DataFrame, rules: dict[int, dict]) -> DataFrame:
    """(doc_id, section_idx) of rules for sections that a document doesn't have."""
    wanted = docs.select("doc_id", F.explode(F.array(*map(F.lit, rules))).alias("section_idx"))
    return wanted.join(sections, ["doc_id", "section_idx"], "left_anti")


def upsert_styles(docs: DataFrame, styles: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """Styles with the rules' values, and a row for each ruled style that a document lacks (based on Normal)."""
    out = styles
    for style_id, values in rules.items():
        here = F.col("style_id") == style_id
        out = out.withColumns({k: F.when(here, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})
    have = styles.select("doc_id", "style_id")
    for style_id, values in rules.items():
        new = docs.select("doc_id").join(have.where(F.col("style_id") == style_id), "doc_id", "left_anti")
        new = new.select("doc_id", F.lit(style_id).alias("style_id"), F.lit("Normal").alias("based_on"), *[F.lit(v).alias(k) for k, v in values.items()])
        out = out.unionByName(new, allowMissingColumns=True)
    return out


def compact_json(rows: DataFrame, columns: list[str], name: str = "draft") -> DataFrame:
    """The columns as one JSON object without the empty ones."""
    return rows.withColumn(name, F.to_json(F.struct(*columns)))


def kept_kinds(blocks: DataFrame) -> DataFrame:
    """What findings, issues and repairs read of classified blocks, stored: texts are classified once, and take no part in what follows."""
    kinds = structure.classify(blocks, blocks.count())
    kept = stored(kinds.select(*[c for c in ("doc_id", "idx", "kind", "region", "keep_next", "in_table", "drawing_width_in") if c in kinds.columns]))
    return structure.dealt(kept, kept.count())


def compliance_run(blocks: DataFrame, sections: DataFrame, page: dict, wanted: tuple, kinds: DataFrame | None = None) -> dict[str, DataFrame]:
    """Classified blocks (without their texts), findings, issues, steps and compliance of every document. kinds: the classified blocks, if they are known."""
    kinds = kept_kinds(blocks) if kinds is None else kinds
    summary = structure.summarize(kinds)
    findings = numbered_union(compare.diff_page(sections, page), compare.diff_structure(summary, wanted))
    findings = findings.withColumn("idx", F.row_number().over(W.partitionBy("doc_id").orderBy("family", "name")) - 1)
    plain = lambda df: df.select("doc_id", "idx", "type", F.lit("warning").alias("severity"))
    issues = planning.dedupe_issues(plain(layout.heading_risks(kinds)).unionByName(plain(layout.neighbour_issues(kinds))))
    steps = planning.finding_steps(findings)
    scores = compare.scores(findings)
    return {"blocks": kinds, "findings": findings, "issues": issues, "steps": steps, "compliance": planning.compliance(scores, compare.category_scores(findings), planning.layout_verdict(issues))}


#: The rule families of a profile, in the order in which they are applied.
ORDER = ("page", "sections", "defaultRun", "styles", "headingNumbering", "pageNumbers", "paragraphRules", "captionRules", "bookmarkRules", "headersFooters", "tableRules", "replacements", "fieldRules")


def standardize(tables: dict[str, DataFrame], profile: dict, plan: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables after all rule families of a profile, one after the other in the order of ORDER.

    tables: those that the families of the profile need: sections (twips), defaults,
    styles, levels, numbered (styles with their lists), blocks, bookmarks, refs, cells
    (with doc_id if there is a plan). plan: doc_id, family; with it a family is applied
    only to the documents whose chosen steps touch it (see ``planning.narrow_profile``). Later families see what
    earlier ones left: captions the restyled blocks, replacements the new captions.
    Adds ``segments``, one list of a block whose placeholders gave way to fields. Rules that hold already
    change nothing, so a second run over its own result is the same.
    """
    out = dict(tables)

    def reached(df: DataFrame, family: str) -> tuple[DataFrame, DataFrame]:
        """Rows of the documents that the family may change, and the others."""
        if plan is None:
            return df, df.limit(0)
        on = plan.where(F.col("family") == family).select("doc_id").distinct()
        return df.join(on, "doc_id", "left_semi"), df.join(on, "doc_id", "left_anti")

    def applied(family: str, name: str, change) -> None:
        if family not in profile:
            return
        df, rest = reached(out[name], family)
        out[name] = change(df) if plan is None else change(df).unionByName(rest, allowMissingColumns=True)

    rule = profile.get
    applied("page", "sections", lambda df: rules.set_page(df, rule("page").get("size"), rule("page").get("orientation"), rule("page").get("margins", {})))
    applied("sections", "sections", lambda df: set_sections(df, rule("sections")))
    applied("defaultRun", "defaults", lambda df: rules.overlay(df, F.lit(True), rule("defaultRun")))
    applied("styles", "styles", lambda df: templates.upsert_styles_checked(df.select("doc_id").distinct(), df, rule("styles")).drop("problem"))
    if "headingNumbering" in profile:
        levels, numbered = reached(out["levels"], "headingNumbering"), reached(out["numbered"], "headingNumbering")
        new = templates.upsert_numbering(levels[0], numbered[0], rule("headingNumbering"))
        out["levels"], out["numbered"] = (a if plan is None else a.unionByName(b[1], allowMissingColumns=True) for a, b in zip(new, (levels, numbered), strict=True))
    applied("pageNumbers", "sections", lambda df: rules.set_page_numbers(df, rule("pageNumbers")))
    applied("paragraphRules", "blocks", lambda df: rules.apply_para_rules(df, rule("paragraphRules")))

    def captioned(df: DataFrame) -> DataFrame:
        for r in rule("captionRules"):
            new = rules.apply_captions(df, r["match"], r["label"], r["strip"], r.get("strategy"), r.get("separator", "-")).select(F.col("doc_id").alias("_d"), F.col("idx").alias("_i"), "caption")
            text = F.coalesce("caption", "text")
            df = df.join(new, (F.col("doc_id") == F.col("_d")) & (F.col("idx") == F.col("_i")), "left").withColumn("text", text).select(*df.columns)
        return df

    applied("captionRules", "blocks", captioned)
    applied("bookmarkRules", "bookmarks", lambda df: df.unionByName(rules.apply_bookmarks(reached(out["blocks"], "bookmarkRules")[0], df, rule("bookmarkRules")).select("doc_id", "name", "id")))
    if "headersFooters" in profile:
        asked = reached(rule("headersFooters"), "headersFooters")[0]
        on = ["doc_id", "section_idx", "kind", "ref_type"]
        applied("headersFooters", "refs", lambda df: df.join(asked, on, "left_anti").unionByName(asked.where("action = 'set'").select(*df.columns)))
    if "tableRules" in profile:
        cells, rest = reached(out["cells"], "tableRules")
        new, out["unsafe"] = three_lines.apply_tables(cells, rule("tableRules"))
        out["cells"] = new if plan is None else new.unionByName(rest)

    def replaced(df: DataFrame) -> DataFrame:
        text = F.col("text")
        for r in rule("replacements"):
            text = rules.replaced(text, r["find"], r["by"], r.get("all", True)) if r.get("regex") else rules.replace_literal(text, r["find"], r["by"])
        return df.withColumn("text", text)

    applied("replacements", "blocks", replaced)
    if "fieldRules" in profile:
        segments = F.array(F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("value")))
        for r in rule("fieldRules"):
            segments = F.flatten(F.transform(segments, lambda s: F.when(s["kind"] == "text", rules.field_segments(s["value"], r["placeholder"], r["instruction"])).otherwise(F.array(s))))  # noqa: B023
        found = reached(out["blocks"], "fieldRules")[0].select("doc_id", "idx", segments.alias("segments"))
        out["segments"] = found.where(F.exists("segments", lambda s: s["kind"] == "field"))
    return out


def compliance_rewrite(blocks: DataFrame, sections: DataFrame, measured, page: dict, wanted: tuple) -> tuple[dict[str, DataFrame], dict[str, DataFrame], dict[str, DataFrame]]:
    """A run, the documents after its plan is applied, and a run over these.

    measured turns sections in twips into sections in inches. Page rules reach the
    documents with failed page findings, and layout repairs those with issues.
    """
    before = compliance_run(blocks, measured(sections), page, wanted)
    plan = before["steps"].where("auto AND action = 'set_page'").select("doc_id", F.lit("page").alias("family")).distinct()
    after = standardize({"sections": sections}, {"page": page}, plan)
    kinds, heads = before["blocks"], layout.heading_risks(before["blocks"])
    repair = lambda rows: layout.apply_layout_repairs(rows, heads, F.lit(6.0)).select(*rows.columns)
    after["blocks"] = repair(blocks)
    # Repairs change nothing that a block is classified by, so its kind stays.
    return before, after, compliance_run(after["blocks"], measured(after["sections"]), page, wanted, repair(kinds))
