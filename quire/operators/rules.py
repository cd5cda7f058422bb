"""Rules that match paragraphs, and rewrites by rules (F-1 to F-4, W-7, W-8, J-19, A-11, A-12, A-16 to A-18, U-3, U-4, R-1, R-3, R-6, R-8 to R-12).

A rule list is a Python list of dicts: short, so each rule becomes column
expressions with literal patterns, which the engine compiles once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.units import NUMBER_FORMATS, PAGE_SIZES


def predicate(match: dict, text: Column | None = None) -> Column:
    """A conjunction of the predicates of a match, on the block's columns; an empty match takes every block."""
    raw = F.coalesce(text if text is not None else F.col("text"), F.lit(""))
    value = T.collapsed(raw) if match.get("normalize", True) else raw
    style, name = F.coalesce("style_id", F.lit("")), F.coalesce("style_name", F.lit("")) if "style_name" in match.get("_columns", ()) else F.lit("")
    tests = {
        "equals": lambda v: value == v,
        "contains": lambda v: value.contains(v),
        "starts_with": lambda v: value.startswith(v),
        "regex": lambda v: value.rlike(f"(?U){v}"),
        "not_regex": lambda v: ~value.rlike(f"(?U){v}"),
        "style": lambda v: style == v,
        "style_not_in": lambda v: ~style.isin(list(v)),
        "style_name_regex": lambda v: name.rlike(f"(?iU){v}"),
        "style_name_not_regex": lambda v: ~name.rlike(f"(?iU){v}"),
        "section": lambda v: F.col("section_idx") == v,
        "idx": lambda v: F.col("idx") == v,
        "in_table": lambda v: F.coalesce("in_table", F.lit(False)) == v,
        "in_text_box": lambda v: F.coalesce("in_text_box", F.lit(False)) == v,
    }
    return reduce(lambda a, b: a & b, [tests[k](v) for k, v in match.items() if k in tests], F.lit(True))


def match_rules(blocks: DataFrame, rules: list[dict]) -> DataFrame:
    """(doc_id, idx, rule): a row for each rule that takes a block."""
    columns = {"_columns": tuple(blocks.columns)}
    hits = F.filter(F.array(*[F.when(predicate(r["match"] | columns), F.lit(i)) for i, r in enumerate(rules)]), lambda x: x.isNotNull())
    return blocks.select("doc_id", "idx", F.explode(hits).alias("rule"))


def numbered(matches: DataFrame) -> DataFrame:
    """Adds n, the occurrence of the rule in its document."""
    return matches.withColumn("n", F.row_number().over(W.partitionBy("doc_id", "rule").orderBy("idx")))


def cap_matches(matches: DataFrame, rules: list[dict]) -> DataFrame:
    """The first max_matches of each rule and document."""
    most = F.coalesce(*[F.when(F.col("rule") == i, F.lit(r["max_matches"])) for i, r in enumerate(rules) if r.get("max_matches")], F.lit(2**31 - 1))
    return numbered(matches).where(F.col("n") <= most)


def unmatched_required(docs: DataFrame, matches: DataFrame, rules: list[dict]) -> DataFrame:
    """(doc_id, rule) of the required rules that take no block of a document."""
    needed = docs.select("doc_id", F.explode(F.array(*[F.lit(i) for i, r in enumerate(rules) if r.get("required")])).alias("rule"))
    return needed.join(matches, ["doc_id", "rule"], "left_anti")


def occurrences(text: Column, pattern: str, regex: bool) -> Column:
    """Non-overlapping occurrences; a regex sees lines."""
    if regex:
        return F.regexp_count(text, F.lit(f"(?mU){pattern}"))
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(pattern), F.lit("")))) / len(pattern)).cast("int")


def document_text(blocks: DataFrame) -> DataFrame:
    """(doc_id, text): the blocks' texts in order, a line each."""
    gathered = F.array_sort(F.collect_list(F.struct("idx", F.coalesce("text", F.lit("")).alias("text"))))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(gathered, lambda x: x["text"]), "\n").alias("text"))


def check_texts(texts: DataFrame, rules: list[dict]) -> DataFrame:
    """(doc_id, rule, n, ok) for each text rule: pattern, regex, min, max."""
    def check(i: int, r: dict) -> Column:
        n = occurrences(F.col("text"), r["pattern"], r.get("regex", False))
        ok = (n >= r.get("min", 0)) & (n <= r["max"] if r.get("max") is not None else F.lit(True))
        return F.struct(F.lit(i).alias("rule"), n.alias("n"), ok.alias("ok"))

    return texts.select("doc_id", F.explode(F.array(*[check(i, r) for i, r in enumerate(rules)])).alias("c")).select("doc_id", "c.*")


def check_required(docs: DataFrame, counts: DataFrame, needs: dict[str, int]) -> DataFrame:
    """(doc_id, key, n, ok): whether each needed thing occurs often enough; counts: (doc_id, key, n)."""
    wanted = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("least")) for k, v in needs.items()])).alias("w")).select("doc_id", "w.*")
    joined = wanted.join(counts, ["doc_id", "key"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.select("doc_id", "key", "n", (F.col("n") >= F.col("least")).alias("ok"))


def marked_span(blocks: DataFrame, start: str, end: str) -> DataFrame:
    """(doc_id, first, last, characters): the blocks between the first match of start and the first match of end behind it."""
    w = W.partitionBy("doc_id")
    rows = blocks.withColumn("_first", F.min(F.when(F.coalesce("text", F.lit("")).rlike(f"(?U){start}"), F.col("idx"))).over(w))
    rows = rows.withColumn("_last", F.min(F.when((F.col("idx") > F.col("_first")) & F.coalesce("text", F.lit("")).rlike(f"(?U){end}"), F.col("idx"))).over(w))
    inside = rows.where((F.col("idx") > F.col("_first")) & (F.col("idx") < F.col("_last")))
    count = F.sum(T.text_metric(F.col("text"), F.lit("charactersNoWhitespace")))
    ends = rows.groupBy("doc_id").agg(F.min("_first").alias("first"), F.min("_last").alias("last"))
    return ends.join(inside.groupBy("doc_id").agg(count.alias("characters")), "doc_id", "left")


def placeholder_inventory(parts: DataFrame) -> DataFrame:
    """(doc_id, token, buckets): placeholders and the kinds of parts that hold them; parts: (doc_id, part, text)."""
    return parts.select("doc_id", "part", F.explode(T.placeholders(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.array_join(F.array_sort(F.collect_set("part")), ",").alias("buckets"))


def infer_para_rules(classified: DataFrame) -> DataFrame:
    """(doc_id, rule): draft rules for chapters (Chinese or decimal) and sections, by what a document uses."""
    t = T.collapsed(F.col("text"))
    rows = classified.where("kind != 'toc_entry'").groupBy("doc_id").agg(
        F.bool_or(t.rlike("(?U)^[一二三四五六七八九十]+、")).alias("zh"), F.bool_or(t.rlike(r"(?U)^\d+\s+\S+") & (F.col("kind") == "chapter")).alias("chapter"), F.bool_or(t.rlike(r"(?U)^\d+\.\d+\s+\S+") & (F.col("kind") == "section")).alias("section")
    )
    drafts = F.filter(F.array(F.when(F.col("zh"), "chapter_zh").when(F.col("chapter"), "chapter_decimal"), F.when(F.col("section"), "section_decimal")), lambda x: x.isNotNull())
    return rows.select("doc_id", F.explode(drafts).alias("rule"))


def next_ids(existing: DataFrame, new: DataFrame, *by: str) -> DataFrame:
    """Gives new rows the ids that follow the largest existing one of their document; existing: (doc_id, id)."""
    top = existing.groupBy("doc_id").agg(F.max(F.col("id").try_cast("long")).alias("_top"))
    return new.join(top, "doc_id", "left").withColumn("id", F.coalesce("_top", F.lit(-1)) + F.row_number().over(W.partitionBy("doc_id").orderBy(*by))).drop("_top")


def new_only(created: DataFrame, existing: DataFrame) -> DataFrame:
    """Created names that don't exist yet, the first of each; both: (doc_id, name, ...); created has ord."""
    left = created.join(existing.select("doc_id", "name").distinct(), ["doc_id", "name"], "left_anti")
    return left.withColumn("_r", F.row_number().over(W.partitionBy("doc_id", "name").orderBy("ord"))).where("_r = 1").drop("_r")


def missing(keys: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    return keys.join(present, on, "left_anti")


def set_page(sections: DataFrame, size: str | None, orientation: str | None, margins: dict[str, float]) -> DataFrame:
    """Page size, orientation and listed margins (inches) of all sections, in twips."""
    w, h = F.col("page_w_twips"), F.col("page_h_twips")
    if size is not None:
        w, h = (F.lit(round(x * 1440)) for x in PAGE_SIZES[size.lower()])
    wide = F.lit(orientation == "landscape") if orientation else ((F.col("orient") == "landscape") | (w > h))
    wide = F.coalesce(wide, F.lit(False))
    out = sections.withColumns({"page_w_twips": F.when(wide, F.greatest(w, h)).otherwise(F.least(w, h)), "page_h_twips": F.when(wide, F.least(w, h)).otherwise(F.greatest(w, h)), "orient": F.when(wide, "landscape")})
    return out.withColumns({f"mar_{side}": F.lit(round(v * 1440)) for side, v in margins.items()})


def set_page_numbers(sections: DataFrame, rules: list[tuple[int, str | None, int | None]]) -> DataFrame:
    fmt, start = F.col("num_fmt"), F.col("num_start")
    for at, form, first in rules:
        here = F.col("section_idx") == at
        fmt = F.when(here, F.lit(NUMBER_FORMATS[form])).otherwise(fmt) if form else fmt
        start = F.when(here, F.lit(first)).otherwise(start) if first is not None else start
    return sections.withColumns({"num_fmt": fmt, "num_start": start})


def overlay(rows: DataFrame, where: Column, values: dict[str, object]) -> DataFrame:
    """Named properties replace the old ones where a condition holds; colours are written as RRGGBB, others are errors."""
    out = {}
    for key, value in values.items():
        new = F.lit(value)
        if key == "color":
            new = F.when(new.rlike("^#?[0-9A-Fa-f]{6}$"), F.upper(F.regexp_replace(new, "^#", ""))).otherwise(F.raise_error(F.lit("color must be RRGGBB")))
        out[key] = F.when(where, new).otherwise(F.col(key))
    return rows.withColumns(out)


def apply_para_rules(blocks: DataFrame, rules: list[dict], para: tuple[str, ...] = (), run: tuple[str, ...] = ()) -> DataFrame:
    """Rules one after the other: text as earlier rules left it, style and place as they were at the start.

    A rule may clear the paragraph's (``para``) and the runs' (``run``) own columns, set
    the style, overlay columns (``set``), replace a pattern in the text (the first or
    all) and remove the block; max_matches counts in the order of the document. A
    block that ends a section isn't removed, which is an error.
    """
    names = blocks.columns
    rows = blocks.withColumns({"_text": F.col("text"), "_style": F.col("style_id"), "_gone": F.lit(False)})
    columns = {"_columns": tuple(names)}
    for rule in rules:
        hit = predicate(rule["match"] | columns, F.col("_text")) & ~F.col("_gone")
        rows = rows.withColumn("_hit", hit)
        if rule.get("max_matches"):
            order = W.partitionBy("doc_id").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
            rows = rows.withColumn("_hit", F.col("_hit") & (F.sum(F.col("_hit").cast("int")).over(order) <= rule["max_matches"]))
        when = lambda value, name: F.when(F.col("_hit"), value).otherwise(F.col(name))
        if rule.get("remove"):
            ends = F.coalesce("section_break", F.lit(False)) if "section_break" in names and rule.get("refuse_breaks") else F.lit(False)
            gone = F.when(F.col("_hit") & ends, F.raise_error(F.lit("a block that ends a section can't be removed"))).otherwise(F.col("_gone") | F.col("_hit"))
            rows = rows.withColumn("_gone", gone)
            continue
        cleared = [*(para if rule.get("clear_paragraph") else ()), *(run if rule.get("clear_run") else ())]
        rows = rows.withColumns({c: when(F.lit(None), c) for c in cleared})
        if rule.get("set_style"):
            rows = rows.withColumn("_style", when(F.lit(rule["set_style"]), "_style"))
        if rule.get("set"):
            rows = overlay(rows, F.col("_hit"), rule["set"])
        if rule.get("replace"):
            rows = rows.withColumn("_text", when(replaced(F.col("_text"), *rule["replace"], rule.get("all", False)), "_text"))
    return rows.where("NOT _gone").withColumns({"text": F.col("_text"), "style_id": F.col("_style")}).select(*names)


def replace_in_runs(runs: DataFrame, pattern: str, replacement: str, regex: bool = False, every: bool = True) -> DataFrame:
    """Runs after a replacement in the text of their paragraph, across the borders of runs.

    runs: doc_id, idx, run_ord, text, and further columns, which stay. The run in which
    an occurrence begins takes the replacement, the others lose their part of it. A
    regex sees the occurrence alone when its groups are filled in.
    """
    import re

    order = ("doc_id", "idx")
    found = f"(?U){pattern}" if regex else re.escape(pattern)
    open_, close = "\ue000", "\ue001"
    gathered = runs.groupBy(*order).agg(F.array_sort(F.collect_list(F.struct("run_ord", F.coalesce("text", F.lit("")).alias("t")))).alias("_runs"))
    whole = F.array_join(F.transform("_runs", lambda r: r["t"]), "")
    marked = F.regexp_replace(whole, found, f"{open_}$0{close}") if every else F.regexp_replace(whole, f"(?s)^(.*?)({found})(.*)$", f"$1{open_}$2{close}${{rest}}".replace("${rest}", f"${3 + re.compile(pattern).groups if regex else 3}"))
    parts = F.split(marked, f"[{open_}{close}]", -1)  # outside and inside by turns
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<at:int,n:int,t:string,inside:boolean>>)").alias("out"))
    step = lambda s, t: F.struct((s["at"] + F.length(t)).cast("int").alias("at"), F.array_append(s["out"], F.struct(s["at"].cast("int").alias("at"), F.length(t).cast("int").alias("n"), t.alias("t"), (F.size(s["out"]) % 2 == 1).alias("inside"))).alias("out"))
    rows = gathered.withColumn("_parts", F.aggregate(parts, start, step)["out"])
    new = lambda t: F.regexp_replace(t, f"^{found}$" if regex else "(?s)^.*$", replacement if regex else replacement.replace("\\", "\\\\").replace("$", "\\$"))

    def piece(p: Column, low: Column, high: Column) -> Column:
        cut = F.substring(p["t"], F.greatest(low - p["at"], F.lit(0)) + 1, F.greatest(F.least(high, p["at"] + p["n"]) - F.greatest(low, p["at"]), F.lit(0)))
        return F.when(~p["inside"], cut).when((p["at"] >= low) & (p["at"] < high), new(p["t"])).otherwise("")

    offsets = F.transform(F.sequence(F.lit(0), F.size("_runs") - 1), lambda i: F.aggregate(F.slice("_runs", 1, i), F.lit(0), lambda a, r: a + F.length(r["t"])))
    rows = rows.withColumn("_low", offsets)
    texts = F.transform("_runs", lambda r, i: F.struct(r["run_ord"].alias("run_ord"), F.array_join(F.transform("_parts", lambda p: piece(p, F.get("_low", i), F.get("_low", i) + F.length(r["t"]))), "").alias("t")))
    after = rows.select(*order, F.explode(texts).alias("_r")).select(*order, F.col("_r.run_ord").alias("run_ord"), F.col("_r.t").alias("_new"))
    return runs.join(after, [*order, "run_ord"]).withColumn("text", F.col("_new")).select(*runs.columns)


def run_offsets(runs: DataFrame) -> DataFrame:
    """Runs with the characters of their paragraph before each."""
    before = W.partitionBy("doc_id", "idx").orderBy("run_ord").rowsBetween(W.unboundedPreceding, -1)
    return runs.withColumn("offset", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))


def apply_bookmarks(blocks: DataFrame, bookmarks: DataFrame, rules: list[dict]) -> DataFrame:
    """(doc_id, idx, name, id) of the bookmarks that rules create: names that a document has are skipped, ids follow its largest.

    bookmarks: doc_id, name, id. Of a name that several rules or places make, the first stays.
    """
    found = cap_matches(match_rules(blocks, rules), rules)
    named = [bookmark_names(found.where(F.col("rule") == i), r["name"]).withColumn("ord", F.struct("rule", "n")) for i, r in enumerate(rules)]
    created = new_only(reduce(DataFrame.unionByName, named), bookmarks)
    return next_ids(bookmarks.select("doc_id", "id"), created, "ord").select("doc_id", "idx", "name", "id")


def replaced(text: Column, pattern: str, replacement: str, every: bool) -> Column:
    """Regex replacement of all or of the first occurrence."""
    if every:
        return F.regexp_replace(text, f"(?U){pattern}", replacement)
    return F.regexp_replace(text, f"(?sU)^(.*?)(?:{pattern})(.*)$", f"$1{replacement}$2")


def replace_literal(text: Column, find: str, replacement: str) -> Column:
    return F.replace(text, F.lit(find), F.lit(replacement))


def field_segments(text: Column, placeholder: str, instruction: str) -> Column:
    """Array of (kind, value): the text around a placeholder, and a field where it stood; empty texts are left out."""
    import re

    parts = F.split(text, re.escape(placeholder), -1)
    pairs = F.transform(parts, lambda p, i: F.array(F.struct(F.when(i > 0, "field").alias("kind"), F.when(i > 0, F.lit(instruction)).alias("value")), F.struct(F.when(p != "", "text").alias("kind"), p.alias("value"))))
    return F.filter(F.flatten(pairs), lambda s: s["kind"].isNotNull())


def caption_instruction(strategy: str | None, style: str = "Heading 1", own: str | None = None) -> str | None:
    if own:
        return own
    return {"styleref-as-displayed": f'STYLEREF "{style}" \\n', "styleref-arabic": f'STYLEREF "{style}" \\n \\* ARABIC', "seq-chapter": "SEQ chapter \\* ARABIC"}.get(strategy or "")


def apply_captions(blocks: DataFrame, match: dict, label: str, strip: str, strategy: str | None, separator: str = "-", bookmark: str | None = None) -> DataFrame:
    """(doc_id, idx, n, caption): captions of the matched blocks rebuilt as label, chapter field, sequence field and rest; with a prefix, their bookmark too."""
    hits = numbered(match_rules(blocks, [{"match": match}])).withColumnsRenamed({"doc_id": "_d", "idx": "_i"})
    rows = blocks.join(hits, (F.col("doc_id") == F.col("_d")) & (F.col("idx") == F.col("_i")))
    rest = F.regexp_replace(replaced(F.col("text"), strip, "", False), r"(?U)^\s+", "")
    chapter = caption_instruction(strategy)
    parts = [F.lit(label), *([F.lit("{" + chapter + "}"), F.lit(separator)] if chapter else []), F.lit("{SEQ " + label + " \\* ARABIC}"), F.lit(" "), rest]
    more = [F.concat(F.lit(bookmark), F.col("n").cast("string")).alias("bookmark")] if bookmark else []
    return rows.select("doc_id", "idx", "n", F.concat(*parts).alias("caption"), *more)


def bookmark_names(matches: DataFrame, template: str) -> DataFrame:
    """Names by a template with {index} and {paragraph}; an invalid name is an error."""
    name = F.replace(F.replace(F.lit(template), F.lit("{index}"), F.col("n").cast("string")), F.lit("{paragraph}"), F.col("idx").cast("string"))
    return matches.withColumn("name", F.when(name.rlike("^[A-Za-z_][A-Za-z0-9_]{0,39}$"), name).otherwise(F.raise_error(F.concat(F.lit("invalid bookmark name: "), name))))


def select_parts(parts: DataFrame, selectors: list[str]) -> DataFrame:
    """Parts that the selectors name: document, headers, footers, notes, all, or an exact XML part."""
    name = F.col("part_name")
    kinds = {"document": name == "word/document.xml", "headers": name.rlike(r"^word/header\d+\.xml$"), "footers": name.rlike(r"^word/footer\d+\.xml$"), "notes": name.isin("word/footnotes.xml", "word/endnotes.xml")}
    kinds["all"] = reduce(lambda a, b: a | b, kinds.values())
    return parts.where(reduce(lambda a, b: a | b, [kinds.get(s, name == s) for s in selectors])).select("doc_id", "part_name").distinct()
