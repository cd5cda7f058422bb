"""Profiles as data: every document under the rules of its own profile, where its own plan lets them (R-16, R-10, R-14, F-1, F-3, F-7).

Rules are rows (``profiles.rule_rows``), gathered into one ordered array a profile and
family, which is joined to the documents that carry the profile and folded in one
expression. So plans don't grow with rules or profiles, and a rule reaches a row only
through (doc_id, profile_id) of its family: with a plan, no other document can be met.

Names of properties are those of profiles, as ``match.textRegex`` or ``run.sizePt``.
Missing properties are null; items of a family apply in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.units import NUMBER_FORMATS, PAGE_SIZES
from quire.operators import marginals, rules
from quire.operators.profiles import rule_rows
from quire.sources.lineage import checkpointed

SMALL = 100_000  # rules that are sent to all tasks; more are joined by a shuffle


def rule_table(profiles: DataFrame) -> DataFrame:
    """(profile_id, family, item, ord, props): a row for each rule, its properties as a map."""
    rows = rule_rows(profiles).withColumn("key", F.concat_ws(".", "bucket", "property"))
    props = F.map_from_entries(F.collect_list(F.struct("key", "value")))
    return checkpointed(rows.groupBy("profile_id", "family", "item").agg(props.alias("props")).withColumn("ord", F.coalesce(F.col("item").try_cast("int"), F.lit(0))))


class Job:
    """Rules and the documents that they reach. assigned: doc_id, profile_id; plan: doc_id, family, or None for all families."""

    def __init__(self, rules_: DataFrame, assigned: DataFrame, plan: DataFrame | None = None):
        self.rules, self.assigned, self.plan, self.small = rules_, assigned, plan, rules_.count() <= SMALL

    def reached(self, family: str) -> DataFrame:
        """(doc_id, profile_id) of the documents that the family may change."""
        if self.plan is None:
            return self.assigned
        return self.assigned.join(self.plan.where(F.col("family") == family).select("doc_id").distinct(), "doc_id", "left_semi")

    def each(self, family: str) -> DataFrame:
        """(doc_id, ord, item, props): a row for each document and rule of the family."""
        of = self.rules.where(F.col("family") == family).select("profile_id", "ord", "item", "props")
        return self.reached(family).join(F.broadcast(of) if self.small else of, "profile_id").drop("profile_id")

    def with_rules(self, rows: DataFrame, family: str) -> DataFrame:
        """The rows with ``_rules``, the ordered rules of the family that reach their document; null if none does."""
        gathered = F.array_sort(F.collect_list(F.struct("ord", "item", "props")), lambda a, b: a["ord"] - b["ord"])
        of = self.rules.where(F.col("family") == family).groupBy("profile_id").agg(gathered.alias("_rules"))
        reached = self.reached(family).join(F.broadcast(of) if self.small else of, "profile_id").drop("profile_id")
        return rows.join(reached, "doc_id", "left")


def _get(props: Column, key: str) -> Column:
    return F.try_element_at(props, F.lit(key))


def _true(props: Column, key: str) -> Column:
    return F.coalesce(_get(props, key) == "true", F.lit(False))


def _twips(inches: Column) -> Column:
    return F.round(inches.try_cast("double") * 1440).cast("int")


def _folded(start: Column, step, keep: Column | None = None) -> Column:
    """A value after all rules of ``_rules`` (of those for which ``keep`` holds)."""
    some = F.coalesce("_rules", F.array().cast("array<struct<ord:int,item:string,props:map<string,string>>>"))
    return F.aggregate(some if keep is None else F.filter(some, keep), start, lambda s, r: step(s, r))


def takes(props: Column, text: Column, columns: tuple[str, ...]) -> Column:
    """Whether a rule takes a block: each property of its match that it has must hold; one without takes every block."""
    raw = F.coalesce(text, F.lit(""))
    value = F.when(F.coalesce(_get(props, "match.normalizeWhitespace") == "false", F.lit(False)), raw).otherwise(T.collapsed(raw))
    style = F.coalesce("style_id", F.lit(""))
    name = F.coalesce("style_name", F.lit("")) if "style_name" in columns else F.lit("")
    flag = lambda c: F.coalesce(c, F.lit(False)) if c in columns else F.lit(False)
    number = lambda c: F.col(c) if c in columns else F.lit(None).cast("int")
    tests = {
        "textEquals": lambda v: value == v, "textContains": lambda v: F.contains(value, v), "startsWith": lambda v: F.startswith(value, v),
        "textRegex": lambda v: F.rlike(value, F.concat(F.lit("(?U)"), v)), "textNotRegex": lambda v: ~F.rlike(value, F.concat(F.lit("(?U)"), v)),
        "currentStyle": lambda v: style == v, "styleNameRegex": lambda v: F.rlike(name, F.concat(F.lit("(?iU)"), v)), "styleNameNotRegex": lambda v: ~F.rlike(name, F.concat(F.lit("(?iU)"), v)),
        "section": lambda v: number("section_idx").eqNullSafe(v.try_cast("int")), "paragraphIndex": lambda v: F.col("idx") == v.try_cast("int"),
        "inTable": lambda v: flag("in_table") == (v == "true"), "inTextBox": lambda v: flag("in_text_box") == (v == "true"),
    }
    ok = F.lit(True)
    for key, test in tests.items():
        v = _get(props, f"match.{key}")
        ok = ok & (v.isNull() | F.coalesce(test(v), F.lit(False)))
    barred = F.exists(F.map_entries(props), lambda e: e["key"].rlike(r"^match\.currentStyleNotIn(\.\d+)?$") & (e["value"] == style))
    return ok & ~barred


def _first_only(text: Column, find: Column, by: Column) -> Column:
    at = F.position(find, text)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), by, F.substring(text, at + F.length(find), F.length(text)))).otherwise(text)


def _regex_first(text: Column, pattern: Column, by: Column) -> Column:
    return F.regexp_replace(text, F.concat(F.lit("(?sU)^(.*?)(?:"), pattern, F.lit(")(.*)$")), F.concat(F.lit("$1"), by, F.lit("$2")))


_SETS = "array<struct<key:string,value:string>>"


def _no_sets() -> Column:
    return F.array().cast(_SETS)


def _restyled(s: Column, props: Column, hit: Column, para: tuple[str, ...], run: tuple[str, ...]) -> Column:
    """The state of a block (text, style, gone, sets) after one rule."""
    none = lambda names: F.array(*[F.struct(F.lit(c).alias("key"), F.lit(None).cast("string").alias("value")) for c in names]).cast(_SETS) if names else _no_sets()
    snake = lambda k: F.lower(F.regexp_replace(k, "([A-Z])", "_$1"))
    own = F.transform(F.filter(F.map_entries(props), lambda e: e["key"].rlike(r"^(paragraph|run)\.")), lambda e: F.struct(snake(F.substring_index(e["key"], ".", -1)).alias("key"), e["value"].alias("value")))
    sets = F.concat(s["sets"], F.when(_true(props, "clearParagraphFormatting"), none(para)).otherwise(_no_sets()), F.when(_true(props, "clearRunFormatting"), none(run)).otherwise(_no_sets()), own)
    pattern, by = _get(props, "textRegexReplace.pattern"), F.coalesce(_get(props, "textRegexReplace.replacement"), F.lit(""))
    text = F.when(pattern.isNull(), s["text"]).when(_true(props, "textRegexReplace.all"), F.regexp_replace(s["text"], F.concat(F.lit("(?U)"), pattern), by)).otherwise(_regex_first(s["text"], pattern, by))
    after = F.struct(text.alias("text"), F.coalesce(_get(props, "style"), s["style"]).alias("style"), F.lit(False).alias("gone"), sets.alias("sets"))
    gone = F.struct(s["text"].alias("text"), s["style"].alias("style"), F.lit(True).alias("gone"), s["sets"].alias("sets"))
    return F.when(s["gone"] | ~hit, s).when(_true(props, "remove"), gone).otherwise(after)


def apply_paragraph_rules(job: Job, blocks: DataFrame, para: tuple[str, ...] = (), run: tuple[str, ...] = ()) -> DataFrame:
    """Blocks after the paragraph rules of their profiles (see ``rules.apply_para_rules``).

    Rules without ``maxMatches`` are folded at once; one with it, at its place in the
    order, by a count over the document. ``paragraph.*`` and ``run.*`` set the columns
    of these names (keepNext: keep_next), and others are left out.
    """
    names = tuple(blocks.columns)
    limited = sorted(r[0] for r in job.rules.where((F.col("family") == "paragraphRules") & _get(F.col("props"), "maxMatches").isNotNull()).select("ord").distinct().collect())
    rows = job.with_rules(blocks, "paragraphRules").withColumn("_s", F.struct(F.col("text").alias("text"), F.col("style_id").alias("style"), F.lit(False).alias("gone"), _no_sets().alias("sets")))
    free = lambda s, r: _restyled(s, r["props"], takes(r["props"], s["text"], names), para, run)
    begin = -1
    for at in limited:
        rows = rows.withColumn("_s", _folded(F.col("_s"), free, lambda r: (r["ord"] > begin) & (r["ord"] < at)))  # noqa: B023
        rows = rows.withColumn("_p", F.get(F.filter("_rules", lambda r: r["ord"] == at), F.lit(0))["props"])  # noqa: B023
        rows = rows.withColumn("_hit", F.coalesce(~F.col("_s.gone") & F.col("_p").isNotNull() & takes(F.col("_p"), F.col("_s.text"), names), F.lit(False)))
        so_far = F.sum(F.col("_hit").cast("int")).over(W.partitionBy("doc_id").orderBy("idx").rowsBetween(W.unboundedPreceding, 0))
        most = F.coalesce(_get(F.col("_p"), "maxMatches").try_cast("int"), F.lit(2**31 - 1))
        rows = rows.withColumn("_hit", F.col("_hit") & (so_far <= most)).withColumn("_s", F.when(F.col("_hit"), _restyled(F.col("_s"), F.col("_p"), F.lit(True), para, run)).otherwise(F.col("_s")))
        begin = at
    rows = rows.withColumn("_s", _folded(F.col("_s"), free, lambda r: r["ord"] > begin)).where("NOT _s.gone")
    kinds = dict(blocks.dtypes)

    def after(c: str) -> Column:
        if c in ("text", "style_id"):
            return F.col("_s.text" if c == "text" else "_s.style").alias(c)
        if c in ("doc_id", "idx"):
            return F.col(c)
        last = F.element_at(F.filter("_s.sets", lambda e: e["key"] == c), -1)
        return F.when(F.exists("_s.sets", lambda e: e["key"] == c), last["value"].try_cast(kinds[c])).otherwise(F.col(c)).alias(c)

    return rows.select(*[after(c) for c in names])


def apply_captions(job: Job, blocks: DataFrame) -> DataFrame:
    """Blocks whose captions are rebuilt: label, chapter field, sequence field, rest."""
    names = tuple(blocks.columns)

    def step(text: Column, r: Column) -> Column:
        p = r["props"]
        label, chapter, strip = F.coalesce(_get(p, "label"), F.lit("")), _get(p, "chapterFieldInstruction"), _get(p, "stripPattern")
        rest = F.when(strip.isNull(), text).otherwise(_regex_first(text, strip, F.lit("")))
        lead = F.when(chapter.isNull(), "").otherwise(F.concat(F.lit("{"), chapter, F.lit("}"), F.coalesce(_get(p, "separator"), F.lit("-"))))
        new = F.concat(label, lead, F.lit("{"), F.coalesce(_get(p, "sequenceInstruction"), F.concat(F.lit("SEQ "), label, F.lit(" \\* ARABIC"))), F.lit("} "), F.regexp_replace(rest, r"(?U)^\s+", ""))
        return F.when(takes(p, text, names), new).otherwise(text)

    return job.with_rules(blocks, "captionRules").withColumn("text", _folded(F.col("text"), step)).select(*names)


def apply_replacements(job: Job, blocks: DataFrame) -> DataFrame:
    """Texts after the replacements of their profiles, each on what the one before left; literal or regex, all or the first."""

    def step(text: Column, r: Column) -> Column:
        p = r["props"]
        find, by = _get(p, "find"), F.coalesce(_get(p, "replace"), F.lit(""))
        first, regex = F.coalesce(_get(p, "occurrence") == "first", F.lit(False)), _true(p, "regex")
        all_ = F.when(regex, F.regexp_replace(text, F.concat(F.lit("(?U)"), find), by)).otherwise(F.replace(text, find, by))
        return F.when(F.coalesce(find, F.lit("")) == "", text).when(~first, all_).when(regex, _regex_first(text, find, by)).otherwise(_first_only(text, find, by))

    return job.with_rules(blocks, "replacements").withColumn("text", _folded(F.col("text"), step)).select(*blocks.columns)


def field_segments(job: Job, blocks: DataFrame) -> DataFrame:
    """(doc_id, idx, segments) of the blocks with a placeholder: one list of (kind, value), with all fields where their placeholders stood."""
    kind = "array<struct<kind:string,value:string>>"

    def step(segments: Column, r: Column) -> Column:
        mark, field = _get(r["props"], "placeholder"), F.coalesce(_get(r["props"], "instruction"), F.lit(""))

        def cut(s: Column) -> Column:
            parts = F.split(s["value"], F.concat(F.lit("\\Q"), F.replace(mark, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
            pairs = F.transform(parts, lambda x, i: F.array(F.struct(F.when(i > 0, "field").alias("kind"), F.when(i > 0, field).alias("value")), F.struct(F.when(x != "", "text").alias("kind"), x.alias("value"))))
            return F.when((s["kind"] == "text") & (F.coalesce(mark, F.lit("")) != ""), F.filter(F.flatten(pairs), lambda x: x["kind"].isNotNull())).otherwise(F.array(s)).cast(kind)

        return F.flatten(F.transform(segments, cut)).cast(kind)

    start = F.array(F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("value"))).cast(kind)
    rows = job.with_rules(blocks, "fieldRules").where("_rules IS NOT NULL").withColumn("segments", _folded(start, step))
    return rows.where(F.exists("segments", lambda s: s["kind"] == "field")).select("doc_id", "idx", "segments")


def _on_page(s: Column, props: Column, at: str = "") -> Column:
    """A section's page (w, h, orient, mar_*) after one rule, in twips."""
    size = F.lower(_get(props, f"{at}size"))
    pick = lambda i: F.create_map(*[x for name, wh in PAGE_SIZES.items() for x in (F.lit(name), F.lit(round(wh[i] * 1440)))])[size]
    w = F.coalesce(_twips(_get(props, f"{at}widthIn")), pick(0), s["w"])
    h = F.coalesce(_twips(_get(props, f"{at}heightIn")), pick(1), s["h"])
    orient = _get(props, f"{at}orientation")
    touched = size.isNotNull() | orient.isNotNull() | _get(props, f"{at}widthIn").isNotNull() | _get(props, f"{at}heightIn").isNotNull()
    wide = F.coalesce(F.when(orient.isNotNull(), orient == "landscape").otherwise((s["orient"] == "landscape") | (w > h)), F.lit(False))
    turned = {"w": F.when(wide, F.greatest(w, h)).otherwise(F.least(w, h)), "h": F.when(wide, F.least(w, h)).otherwise(F.greatest(w, h)), "orient": F.when(wide, F.lit("landscape"))}
    sides = [F.coalesce(_twips(_get(props, f"{at}marginsIn.{x}")), s[f"mar_{x}"]).alias(f"mar_{x}") for x in ("left", "right", "top", "bottom")]
    return F.struct(*[F.when(touched, v).otherwise(s[k]).alias(k) for k, v in turned.items()], *sides)


def apply_pages(job: Job, sections: DataFrame) -> DataFrame:
    """Sections (twips) after the page, sections and pageNumbers families of their profiles."""
    names, sides = sections.columns, ("left", "right", "top", "bottom")
    state = F.struct(F.col("page_w_twips").cast("int").alias("w"), F.col("page_h_twips").cast("int").alias("h"), F.col("orient").alias("orient"), *[F.col(f"mar_{x}").cast("int").alias(f"mar_{x}") for x in sides])
    own = lambda r: _get(r["props"], "section").try_cast("int") == F.col("section_idx")
    rows = job.with_rules(sections.withColumn("_s", state), "page").withColumn("_s", _folded(F.col("_s"), lambda s, r: _on_page(s, r["props"]))).drop("_rules")
    rows = job.with_rules(rows, "sections").withColumn("_s", _folded(F.col("_s"), lambda s, r: _on_page(s, r["props"], "page."), own)).drop("_rules")
    formats = F.create_map(*[F.lit(x) for pair in NUMBER_FORMATS.items() for x in pair])
    number = lambda s, r: F.struct(F.coalesce(formats[_get(r["props"], "format")], s["fmt"]).alias("fmt"), F.coalesce(_get(r["props"], "start").try_cast("int"), s["start"]).alias("start"))
    rows = job.with_rules(rows, "pageNumbers").withColumn("_n", _folded(F.struct(F.col("num_fmt").alias("fmt"), F.col("num_start").cast("int").alias("start")), number, own))
    new = {"page_w_twips": "_s.w", "page_h_twips": "_s.h", "orient": "_s.orient", "num_fmt": "_n.fmt", "num_start": "_n.start"} | {f"mar_{x}": f"_s.mar_{x}" for x in sides}
    return rows.select(*[F.col(new[c]).alias(c) if c in new else F.col(c) for c in names])


def apply_styles(job: Job, styles: DataFrame) -> DataFrame:
    """Styles with the values of their profiles, and new ones, based on Normal unless said: ``run.*`` and ``paragraph.*`` set columns of these names."""
    kinds = dict(styles.dtypes)
    asked = job.each("styles").select("doc_id", F.col("item").alias("style_id"), "props")
    joined = styles.withColumn("_old", F.lit(True)).join(asked, ["doc_id", "style_id"], "full")

    def value(c: str) -> Column:
        if c in ("doc_id", "style_id"):
            return F.col(c)
        camel = "".join(w.capitalize() if i else w for i, w in enumerate(c.split("_")))
        new = F.coalesce(*[_get(F.col("props"), f"{b}{camel}").try_cast(kinds[c]) for b in ("", "run.", "paragraph.")], F.col(c))
        return (F.coalesce(new, F.when(F.col("_old").isNull(), F.lit("Normal"))) if c == "based_on" else new).alias(c)

    return joined.select(*[value(c) for c in styles.columns])


def apply_bookmarks(job: Job, blocks: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """(doc_id, name, id): the bookmarks, with those that the profiles create (see ``rules.apply_bookmarks``)."""
    names = tuple(blocks.columns)
    hits = job.with_rules(blocks, "bookmarkRules").withColumn("_r", F.explode(F.filter("_rules", lambda r: takes(r["props"], F.col("text"), names))))
    hits = hits.select("doc_id", "idx", F.col("_r.ord").alias("rule"), F.col("_r.props").alias("props"))
    counted = rules.numbered(hits).where(F.col("n") <= F.coalesce(_get(F.col("props"), "maxMatches").try_cast("int"), F.lit(2**31 - 1)))
    name = F.replace(F.replace(_get(F.col("props"), "name"), F.lit("{index}"), F.col("n").cast("string")), F.lit("{paragraph}"), F.col("idx").cast("string"))
    named = counted.withColumn("name", F.when(name.rlike("^[A-Za-z_][A-Za-z0-9_]{0,39}$"), name).otherwise(F.raise_error(F.concat(F.lit("invalid bookmark name: "), name)))).withColumn("ord", F.struct("rule", "n"))
    created = rules.next_ids(bookmarks.select("doc_id", "id"), rules.new_only(named, bookmarks), "ord")
    return bookmarks.select("doc_id", "name", F.col("id").cast("long").alias("id")).unionByName(created.select("doc_id", "name", F.col("id").cast("long").alias("id")))


def apply_marginals(job: Job, refs: DataFrame) -> DataFrame:
    """References (doc_id, section_idx, kind, ref_type, part_name) after the headersFooters of their profiles; a new part is named by its rule."""
    p = F.col("props")
    asked = job.each("headersFooters").select(
        "doc_id", F.coalesce(_get(p, "section").try_cast("int"), F.lit(0)).alias("section_idx"), F.coalesce(_get(p, "kind"), F.lit("header")).alias("kind"), F.coalesce(_get(p, "type"), F.lit("default")).alias("ref_type"),
        F.coalesce(_get(p, "action"), F.lit("set")).alias("action"), F.concat(F.lit("rule"), F.col("ord").cast("string")).alias("part_name"), "ord",
    )
    last = asked.withColumn("_r", F.row_number().over(W.partitionBy("doc_id", "section_idx", "kind", "ref_type").orderBy(F.desc("ord")))).where("_r = 1").drop("_r", "ord")
    return marginals.apply_marginals(refs, last)


def table_targets(job: Job, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which rule takes which table, by its place in the body, and (doc_id, body_idx, problem) of what can't be done.

    tables: doc_id, table_idx, body_idx (``templates.body_tables``). A table that two
    rules aim at is ``conflict`` and stays as it is; one that a document hasn't is
    ``missing``.
    """
    aims = job.each("tableRules").withColumn("_e", F.explode(F.map_entries("props"))).where(F.col("_e.key").rlike(r"^tableIndexes\.\d+$"))
    aims = aims.select("doc_id", F.col("_e.value").cast("int").alias("body_idx"), "ord", "props").withColumn("n", F.count("*").over(W.partitionBy("doc_id", "body_idx")))
    joined = aims.join(tables.select("doc_id", "table_idx", "body_idx"), ["doc_id", "body_idx"], "left")
    problem = F.when(F.col("table_idx").isNull(), "missing").when(F.col("n") > 1, "conflict")
    return joined.where(problem.isNull()).select("doc_id", "table_idx", "body_idx", "ord", "props"), joined.where(problem.isNotNull()).select("doc_id", "body_idx", problem.alias("problem")).distinct()


def apply_table_lines(targets: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells (doc_id, table_idx, row_idx, ..., top_sz, bottom_sz, left_sz, right_sz, color, is_header) of targeted tables as three-line tables, each by its own rule."""
    p, whole = F.col("props"), W.partitionBy("doc_id", "table_idx")
    eighths = lambda k, default: F.round(F.coalesce(_get(p, k).try_cast("double"), F.lit(default)) * 8).cast("int")
    rows = cells.withColumn("_last", F.max("row_idx").over(whole)).join(targets.select("doc_id", "table_idx", "props"), ["doc_id", "table_idx"], "left")
    heads = F.coalesce(_get(p, "headerRows").try_cast("int"), F.lit(1))
    outer, inner = eighths("outerSizePt", 1.5), eighths("headerSizePt", 0.75)
    new = {
        "top_sz": F.when(F.col("row_idx") == 0, outer).when(F.col("row_idx") == heads, inner), "bottom_sz": F.when(F.col("row_idx") == F.col("_last"), outer).when(F.col("row_idx") == heads - 1, inner),
        "left_sz": F.lit(None).cast("int"), "right_sz": F.lit(None).cast("int"), "is_header": F.col("row_idx") < heads, "color": F.upper(F.regexp_replace(F.coalesce(_get(p, "color"), F.lit("000000")), "^#", "")),
    }
    return rows.select(*[F.when(p.isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in cells.columns])


def standardize(job: Job, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All families in the order of ``job.ORDER``, on those of the tables that there are: sections, styles, blocks, bookmarks, refs, body (body tables) with cells.

    Later families see what earlier ones left. Adds segments, where placeholders gave
    way to fields, and problems of table rules.
    """
    out = dict(tables)
    if "sections" in out:
        out["sections"] = apply_pages(job, out["sections"])
    if "styles" in out:
        out["styles"] = apply_styles(job, out["styles"])
    if "blocks" in out:
        out["blocks"] = apply_captions(job, apply_paragraph_rules(job, out["blocks"]))
        if "bookmarks" in out:
            out["bookmarks"] = apply_bookmarks(job, out["blocks"], out["bookmarks"])
        out["blocks"] = apply_replacements(job, out["blocks"])
        out["segments"] = field_segments(job, out["blocks"])
    if "refs" in out:
        out["refs"] = apply_marginals(job, out["refs"])
    if "body" in out:
        targets, out["problems"] = table_targets(job, out["body"])
        if "cells" in out:
            out["cells"] = apply_table_lines(targets, out["cells"])
    return out
