"""Formatting profiles as rows: sources, structural and cross-field checks, the requirements gate (S-6, S-7, Q-1, Q-2, F-6)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.lineage import checkpointed


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(profile_id, raw): one row per JSON file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("profile_id"), F.col("value").alias("raw"))


def values(profiles: DataFrame) -> DataFrame:
    """(profile_id, path, at, v): a row for every value of every profile, as a variant.

    A path joins keys by dots; elements of arrays are ``[]`` with their number in
    ``at``, so that one pattern meets all of them. One explode per nesting level, each
    checkpointed, until a level is empty.
    """
    level = profiles.select("profile_id", F.lit("").alias("path"), F.lit("").alias("at"), F.parse_json("raw").alias("v"))
    out, spark = [level], profiles.sparkSession
    while True:
        step = spark.sql(
            "SELECT t.profile_id, concat(t.path, CASE WHEN e.key IS NULL THEN '[]' WHEN t.path = '' THEN e.key ELSE concat('.', e.key) END) AS path, concat(t.at, '/', coalesce(e.key, CAST(e.pos AS STRING))) AS at, e.value AS v FROM {level} t, LATERAL variant_explode(t.v) e",
            level=out[-1],
        )
        step = checkpointed(step)
        if step.isEmpty():
            break
        out.append(step)
    return reduce(DataFrame.unionByName, out)


def kind_and_text() -> tuple[Column, Column]:
    """The type of a value, and a scalar as text."""
    kind = F.schema_of_variant("v")
    named = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "BIGINT", "integer").when(kind == "VOID", "null").otherwise("number")
    return named.alias("type"), F.when(named.isin("string", "boolean", "integer", "number"), F.try_variant_get("v", "$", "string")).alias("text")


def flatten(profiles: DataFrame) -> DataFrame:
    """(profile_id, path, at, type, text): the rows of ``values``, with their type and, of scalars, their text."""
    return values(profiles).select("profile_id", "path", "at", *kind_and_text())


def _fits(rule: dict) -> Column:
    """Whether a value breaks no constraint of its path: type, enum, min, max, min_length, pattern."""
    kind, text = F.col("type"), F.col("text")
    number = text.try_cast("double")
    ok = F.lit(True)
    if "type" in rule:
        wanted = [rule["type"]] if isinstance(rule["type"], str) else list(rule["type"])
        ok = ok & kind.isin(*wanted, *(["integer"] if "number" in wanted else []))
    for key, test in {"enum": lambda v: text.isin(*v), "min": lambda v: number >= v, "max": lambda v: number <= v, "min_length": lambda v: F.length(text) >= v, "max_length": lambda v: F.length(text) <= v, "pattern": lambda v: text.rlike(v), "multiple": lambda v: F.abs(number / v - F.round(number / v)) < 1e-9}.items():
        if key in rule:
            ok = ok & F.coalesce(test(rule[key]), F.lit(False))
    return ok


def check_profiles(profiles: DataFrame, constraints: dict[str, dict]) -> DataFrame:
    """(profile_id, at, problem): values of a wrong type, range or vocabulary, missing required and unknown keys.

    constraints: path to type, enum, min, max, min_length, max_length, pattern, multiple,
    required (keys), keys (all that an object may have), min_items, max_items, unique
    (arrays), and one_of: lists of keys of which an object must have exactly one whole list.
    """
    flat = checkpointed(flatten(profiles))
    found = [flat.where((F.col("path") == path) & ~_fits(rule)).select("profile_id", "at", F.lit("value").alias("problem")) for path, rule in constraints.items()]
    under = F.regexp_extract("at", r"^(.*)/[^/]*$", 1)
    for path, rule in constraints.items():
        objects = flat.where((F.col("path") == path) & (F.col("type") == "object")).select("profile_id", "at")
        prefix = f"{path}." if path else ""
        if rule.get("required"):
            wanted = objects.select("profile_id", F.explode(F.array(*[F.concat("at", F.lit(f"/{k}")) for k in rule["required"]])).alias("at"))
            found.append(wanted.join(flat, ["profile_id", "at"], "left_anti").select("profile_id", "at", F.lit("missing").alias("problem")))
        if rule.get("keys"):
            inner = flat.where((F.col("path") != "") & F.col("path").startswith(prefix) & ~F.substring("path", len(prefix) + 1, 9999).contains(".") & ~F.col("path").endswith("[]") & ~F.col("path").isin([prefix + k for k in rule["keys"]]))
            found.append(inner.withColumn("_up", under).join(objects.withColumnRenamed("at", "_up"), ["profile_id", "_up"], "left_semi").select("profile_id", "at", F.lit("unknown").alias("problem")))
        if rule.keys() & {"min_items", "max_items", "unique"}:
            arrays = flat.where((F.col("path") == path) & (F.col("type") == "array")).select("profile_id", "at")
            items = flat.where(F.col("path") == f"{path}[]").groupBy(F.col("profile_id").alias("_p"), under.alias("_a")).agg(F.count("*").alias("n"), F.countDistinct("text").alias("kinds"))
            rows = arrays.join(items, (F.col("profile_id") == F.col("_p")) & (F.col("at") == F.col("_a")), "left").na.fill(0, ["n", "kinds"])
            if rule.keys() & {"min_items", "max_items"}:
                found.append(rows.where(~F.col("n").between(rule.get("min_items", 0), rule.get("max_items", 2**31))).select("profile_id", "at", F.lit("items").alias("problem")))
            if rule.get("unique"):
                found.append(rows.where("kinds < n").select("profile_id", "at", F.lit("repeated").alias("problem")))
        if rule.get("one_of"):
            keys = flat.where(F.col("path").rlike(f"^{re.escape(prefix)}[^.]+$")).groupBy(F.col("profile_id").alias("_p"), under.alias("_a")).agg(F.collect_set(F.regexp_extract("at", "([^/]*)$", 1)).alias("_keys"))
            rows = objects.join(keys, (F.col("profile_id") == F.col("_p")) & (F.col("at") == F.col("_a")), "left")
            whole = [F.coalesce(F.size(F.array_intersect("_keys", F.array(*map(F.lit, choice)))) == len(choice), F.lit(False)).cast("int") for choice in rule["one_of"]]
            found.append(rows.where(reduce(lambda a, b: a + b, whole) != 1).select("profile_id", "at", F.lit("one_of").alias("problem")))
    return reduce(DataFrame.unionByName, found).distinct()


# Keys of a table rule's paragraph and run, pairs that exclude each other, and measures that can't be negative.
PARAGRAPH_KEYS = ("alignment", "lineSpacing", "lineSpacingExactPt", "spaceBeforePt", "spaceAfterPt", "leftIn", "rightIn", "firstLineIn", "hangingIn", "firstLineChars", "keepNext", "keepLines", "pageBreakBefore", "widowControl", "outlineLevel")
RUN_KEYS = ("latinFont", "eastAsiaFont", "complexScriptFont", "sizePt", "bold", "italic", "color")
CONFLICTS = (("lineSpacing", "lineSpacingExactPt"), ("firstLineIn", "firstLineChars"), ("hangingIn", "firstLineIn"), ("hangingIn", "firstLineChars"))
MEASURES = ("lineSpacing", "lineSpacingExactPt", "spaceBeforePt", "spaceAfterPt", "leftIn", "rightIn", "firstLineIn", "hangingIn", "firstLineChars")
GUARDS = ("styleNameNotRegex", "currentStyleNotIn", "styleNameRegex")


def check_profile_semantics(profiles: DataFrame) -> DataFrame:
    """(profile_id, at, problem): what no single value shows.

    Colours; border sizes in eighths of a point and text sizes in halves; a width that
    isn't the sum of its columns; a table aimed at twice; unknown, negative and
    contradicting properties of table rules; numbering lists of unequal length and
    patterns without their own number; an open caption policy without a note;
    number-stripping rules that don't keep off the table of contents.
    """
    flat = checkpointed(flatten(profiles))
    number, text, path, at = F.col("text").try_cast("double"), F.col("text"), F.col("path"), F.col("at")
    key, rule = F.regexp_extract("at", "([^/]*)$", 1), F.regexp_extract("at", r"^(/[^/]+/\d+)", 1)
    whole = lambda x: F.abs(x - F.round(x)) < 1e-9
    numeric = F.col("type").isin("integer", "number")
    table = "tableRules[]."
    in_para, in_run = path.startswith(f"{table}paragraph."), path.startswith(f"{table}run.")
    zero = key.isin("lineSpacing", "lineSpacingExactPt") & (number == 0)
    single = {
        "color": ((path == f"{table}color") & ~text.rlike("^(#?[0-9A-Fa-f]{6}|auto)$")) | ((path == f"{table}run.color") & ~text.rlike("^#?[0-9A-Fa-f]{6}$")),
        "eighths": path.isin(f"{table}outerSizePt", f"{table}headerSizePt") & numeric & ~whole(number * 8),
        "halves": (path == f"{table}run.sizePt") & numeric & ((number <= 0) | ~whole(number * 2)),
        "unsupported": (in_para & ~key.isin(*PARAGRAPH_KEYS)) | (in_run & ~key.isin(*RUN_KEYS)),
        "negative": in_para & numeric & key.isin(*MEASURES) & ((number < 0) | zero),
        "alignment": (path == f"{table}paragraph.alignment") & ~text.isin("left", "center", "right", "justify"),
    }
    found = [flat.select("profile_id", "at", F.explode(F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in single.items()]), lambda x: x.isNotNull())).alias("problem"))]
    rules = flat.where(rule != "").groupBy("profile_id", rule.alias("at"))
    width = F.max(F.when(path == f"{table}widthIn", number))
    columns = F.sum(F.when(path == f"{table}columnWidthsIn[]", number))
    has = lambda p: F.bool_or(path == p)
    pairs = F.filter(F.array(*[F.when(has(f"{table}paragraph.{a}") & has(f"{table}paragraph.{b}"), F.lit(f"conflict:{a}:{b}")) for a, b in CONFLICTS]), lambda x: x.isNotNull())
    guarded = reduce(lambda a, b: a | b, [has(f"paragraphRules[].match.{g}") for g in GUARDS])
    more = F.array(F.when(F.abs(width - columns) > 1 / 1440, "width_sum"), F.when(has("paragraphRules[].textRegexReplace") & ~guarded, "toc_guard"))
    found.append(rules.agg(F.concat(pairs, F.filter(more, lambda x: x.isNotNull())).alias("p")).select("profile_id", "at", F.explode("p").alias("problem")))
    aimed = flat.where((path == f"{table}tableIndexes[]") & (F.col("type") == "integer")).groupBy("profile_id", "text").agg(F.count("*").alias("n")).where("n > 1")
    found.append(aimed.select("profile_id", F.concat(F.lit("/tableRules/table="), "text").alias("at"), F.lit("repeated_table").alias("problem")))
    lists, place = ("styles", "patterns", "formats", "starts"), "headingNumbering"
    counts = [F.count_if(path == f"{place}.{x}[]") for x in lists]
    arrays = [F.bool_or((path == f"{place}.{x}") & (F.col("type") == "array")) for x in lists]
    per = flat.groupBy("profile_id").agg(
        F.bool_or((path == f"{place}.enabled") & (text == "true")).alias("on"), reduce(lambda a, b: a & b, arrays).alias("lists"), F.array(*counts).alias("sizes"),
        F.bool_or((path == "captionNumbering.strategy") & (text == "needs-confirmation")).alias("open"), F.count_if(path == "requirements.unresolved[]").alias("notes"),
    )
    numbering = F.when(F.col("on") & ~F.col("lists"), "numbering_lists").when(F.col("on") & (F.size(F.array_distinct("sizes")) != 1), "numbering_lengths")
    found.append(per.select("profile_id", F.lit(f"/{place}").alias("at"), numbering.alias("problem")).where("problem IS NOT NULL"))
    found.append(per.where("open AND notes = 0").select("profile_id", F.lit("/captionNumbering/strategy").alias("at"), F.lit("no_note").alias("problem")))
    sound = per.where(F.col("on") & F.col("lists") & (F.size(F.array_distinct("sizes")) == 1)).select("profile_id")
    level = F.regexp_extract("at", r"/(\d+)$", 1).try_cast("int") + 1
    bare = flat.where((path == f"{place}.patterns[]") & ~text.contains(F.concat(F.lit("%"), level.cast("string"))))
    found.append(bare.join(sound, "profile_id", "left_semi").select("profile_id", "at", F.lit("pattern").alias("problem")))
    return reduce(DataFrame.unionByName, found).distinct()


# Families of a profile whose items are the elements of an array, and those keyed by a name.
LISTS = ("sections", "pageNumbers", "paragraphRules", "captionRules", "bookmarkRules", "headersFooters", "tableRules", "replacements", "fieldRules")


def rule_rows(profiles: DataFrame) -> DataFrame:
    """(profile_id, family, item, bucket, property, value, type): every scalar of every profile as a row of its rule.

    The item is the place in a list of rules, or a style's id; the bucket is what lies
    between the rule and the property, joined by dots, elements of arrays by number.
    """
    flat = flatten(profiles).where(F.col("type").isin("string", "boolean", "integer", "number") & (F.col("at") != ""))
    parts = F.slice(F.split("at", "/"), 2, 99)
    rows = flat.withColumn("_p", parts).withColumn("family", F.get("_p", F.lit(0)))
    keyed = (F.col("family").isin(*LISTS) | (F.col("family") == "styles")) & (F.size("_p") > 2)
    first = F.when(keyed, 3).otherwise(2)
    inner = F.slice("_p", first, F.greatest(F.size("_p") - first, F.lit(0)))
    return rows.select("profile_id", "family", F.when(keyed, F.get("_p", F.lit(1))).alias("item"), F.when(F.size(inner) > 0, F.array_join(inner, ".")).alias("bucket"), F.element_at(F.split("at", "/"), -1).alias("property"), F.col("text").alias("value"), "type")


def check_lengths(profiles: DataFrame, *paths: str) -> DataFrame:
    """(profile_id): profiles whose arrays at the paths differ in length, for example the lists of a numbering."""
    flat = flatten(profiles)
    counts = [F.count_if(F.col("path") == f"{p}[]").alias(f"n{i}") for i, p in enumerate(paths)]
    rows = flat.groupBy("profile_id").agg(*counts)
    return rows.where(reduce(lambda a, b: a | b, [F.col("n0") != F.col(f"n{i}") for i in range(1, len(paths))])).select("profile_id")


def check_patterns(profiles: DataFrame, path: str) -> DataFrame:
    """(profile_id, at): numbering patterns that don't hold the number of their own level, ``%1`` for the first."""
    level = F.regexp_extract("at", r"/(\d+)$", 1).try_cast("int") + 1
    return flatten(profiles).where(F.col("path") == f"{path}[]").where(~F.col("text").contains(F.concat(F.lit("%"), level.cast("string")))).select("profile_id", "at")


def gate(profiles: DataFrame, allow: bool = False) -> tuple[DataFrame, DataFrame]:
    """Profiles that may be applied, and those held back for unresolved or conflicting requirements."""
    open_ = flatten(profiles).where(F.col("path").isin("requirements.unresolved[]", "requirements.conflicts[]")).select("profile_id").distinct()
    if allow:
        return profiles, profiles.limit(0)
    return profiles.join(open_, "profile_id", "left_anti"), profiles.join(open_, "profile_id", "left_semi")


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """(id, action, target, property, source, auto, confirm, visual) of saved plans, which are JSON lines of steps."""
    schema = "id string, action string, target string, property string, source string, auto boolean, confirm boolean, visual boolean"
    return spark.read.schema(schema).json(path)
