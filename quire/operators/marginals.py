"""Headers and footers: segments of a run stream, expectations, replacements (W-17, W-20, A-21, J-9, J-10, R-13)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ("doc_id", "part_name", "para_idx")


def segments(runs: DataFrame) -> DataFrame:
    """(keys, seg, kind, value): text and fields of each paragraph of a part, in order.

    runs: keys, run_ord, marker (begin, separate, end or null), instruction, text.
    Between begin and end a run belongs to the field; its instruction is the text of
    the instruction runs, and its cached result isn't text. Neighbouring texts merge,
    empty ones are dropped.
    """
    w = W.partitionBy(*KEYS).orderBy("run_ord")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    begins, ends = F.count_if(F.col("marker") == "begin").over(upto), F.count_if(F.col("marker") == "end").over(upto)
    rows = runs.withColumns({"_begins": begins, "_ends": ends})
    inside = (F.col("_begins") > F.col("_ends")) | F.coalesce(F.col("marker") == "end", F.lit(False))
    rows = rows.withColumn("_field", inside).where(F.col("_field") | (F.coalesce("text", F.lit("")) != ""))
    # A new segment starts where text and field change, or where a further field begins.
    key = F.struct("_field", F.when(F.col("_field"), F.col("_begins")))
    fresh = F.coalesce(~key.eqNullSafe(F.lag(key).over(w)), F.lit(True))
    rows = rows.withColumn("_new", fresh.cast("int")).withColumn("seg", F.sum("_new").over(upto))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_ord", F.coalesce(F.col(c), F.lit("")).alias("t")))), lambda x: x["t"]), "")
    out = rows.groupBy(*KEYS, "seg", "_field").agg(joined("instruction").alias("_i"), joined("text").alias("_t"))
    instruction = F.trim(F.regexp_replace("_i", r"(?U)\s+", " "))
    return out.select(*KEYS, "seg", F.when(F.col("_field"), "field").otherwise("text").alias("kind"), F.when(F.col("_field"), instruction).otherwise(F.col("_t")).alias("value"))


def marginal_inventory(segs: DataFrame) -> DataFrame:
    """(doc_id, part_name, kind, paragraphs, text, fields) of each header and footer part."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("para_idx", "seg", "value")))), lambda x: x["value"])
    name = F.col("part_name")
    return segs.groupBy("doc_id", "part_name").agg(
        F.first(F.when(name.contains("header"), "header").otherwise("footer")).alias("kind"), F.countDistinct("para_idx").alias("paragraphs"), F.array_join(ordered(F.col("kind") == "text"), "").alias("text"), ordered(F.col("kind") == "field").alias("fields")
    )


def check_marginals(refs: DataFrame, segs: DataFrame, expected: list[dict]) -> DataFrame:
    """(doc_id, rule, ok, error): each expected header or footer against the part that its section refers to.

    refs: doc_id, section_idx, kind, ref_type, part_name. expected: section, kind,
    type, action (set, clear or inherit) and segments, a list for each paragraph of
    (kind, value). ``inherit`` always holds. Exactly one reference must fit.
    """
    shown = F.concat_ws("\u0001", F.concat_ws("\u0002", "para_idx"), "kind", "value")
    have = segs.groupBy("doc_id", "part_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "seg", shown.alias("s")))), lambda x: x["s"]), "\u0003").alias("_have"))
    docs, out = refs.select("doc_id").distinct(), []
    for i, rule in enumerate(expected):
        if rule.get("action", "set") == "inherit":
            out.append(docs.select("doc_id", F.lit(i).alias("rule"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error")))
            continue
        want = "\u0003".join("\u0001".join((str(p), kind, value)) for p, para in enumerate(rule.get("segments", []) if rule.get("action", "set") == "set" else []) for kind, value in para)
        fit = refs.where((F.col("section_idx") == rule["section"]) & (F.col("kind") == rule["kind"]) & (F.col("ref_type") == rule.get("type", "default"))).groupBy("doc_id").agg(F.count("*").alias("_n"), F.min("part_name").alias("part_name"))
        rows = docs.join(fit, "doc_id", "left").join(have, ["doc_id", "part_name"], "left")
        error = F.when(F.coalesce("_n", F.lit(0)) != 1, "reference").when(F.coalesce("_have", F.lit("")) != want, "content")
        out.append(rows.select("doc_id", F.lit(i).alias("rule"), error.isNull().alias("ok"), error.alias("error")))
    return reduce(DataFrame.unionByName, out)


def check_marginal_layout(refs: DataFrame, paras: DataFrame, switches_of: DataFrame, expected: list[dict]) -> DataFrame:
    """(doc_id, rule, errors) of expected headers and footers beyond their words; ok where errors is empty.

    refs: doc_id, section_idx, kind, ref_type, part_name, rel_kind; paras: doc_id,
    part_name, para_idx, and properties (numbers in inches and points, border_style,
    border_size, border_space, border_color); switches_of: doc_id, section_idx,
    different_first, even_and_odd. expected: section, kind, type, and paragraphs, each
    with properties and a ``border``. A reference must be the only one of its kind
    and type and lead to a part of that kind; first and even ones need their switch;
    a zero indent isn't met while an indent in characters competes.
    """
    entries = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(r["section"]).alias("_sec"), F.lit(r["kind"]).alias("_kind"), F.lit(r.get("type", "default")).alias("_type")) for i, r in enumerate(expected)])
    rows = refs.select("doc_id").distinct().select("doc_id", F.explode(entries).alias("w")).select("doc_id", "w.*")
    fit = refs.groupBy(F.col("doc_id").alias("_d"), "section_idx", "kind", "ref_type").agg(F.count("*").alias("_n"), F.min("part_name").alias("part_name"), F.min("rel_kind").alias("rel_kind"))
    rows = rows.join(fit, (F.col("doc_id") == F.col("_d")) & (F.col("_sec") == F.col("section_idx")) & (F.col("_kind") == F.col("kind")) & (F.col("_type") == F.col("ref_type")), "left").drop("_d", "section_idx", "kind", "ref_type")
    on = switches_of.select(F.col("doc_id").alias("_d"), F.col("section_idx").alias("_s"), "different_first", "even_and_odd")
    rows = rows.join(on, (F.col("doc_id") == F.col("_d")) & (F.col("_sec") == F.col("_s")), "left").drop("_d", "_s")
    of = paras.groupBy(F.col("doc_id").alias("_d"), F.col("part_name").alias("_p")).agg(F.array_sort(F.collect_list(F.struct("para_idx", *[c for c in paras.columns if c not in KEYS]))).alias("_paras"))
    rows = rows.join(of, (F.col("doc_id") == F.col("_d")) & (F.col("part_name") == F.col("_p")), "left")
    one = F.coalesce(F.col("_n") == 1, F.lit(False))
    off = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    general = [F.when(~one, "reference").when(~F.coalesce(F.col("rel_kind") == F.col("_kind"), F.lit(False)), "kind"), F.when((F.col("_type") == "first") & off("different_first"), "first_page_off"), F.when((F.col("_type") == "even") & off("even_and_odd"), "even_pages_off")]
    errors = F.filter(F.array(*general), lambda e: e.isNotNull())
    for i, rule in enumerate(expected):
        wanted = rule.get("paragraphs", [])
        own = [F.when(F.coalesce(F.size("_paras"), F.lit(0)) != len(wanted), "paragraph_count")]
        for p, want in enumerate(wanted):
            para = F.get("_paras", F.lit(p))
            for key, value in [*want.items(), *((f"border_{k}", v) for k, v in ({"style": "single", "size": 6, "space": 1, "color": "000000"} | want["border"]).items())] if "border" in want else want.items():
                if key == "border":
                    continue
                got = para[key]
                if isinstance(value, (int, float)) and not isinstance(value, bool):
                    bad = F.coalesce(F.abs(got - float(value)) > 0.01, F.lit(True))
                else:
                    bad = ~got.eqNullSafe(F.lit({"justify": "both"}.get(value, value) if key == "alignment" else value.lstrip("#").upper() if key.endswith("color") else value))
                if key in ("first_line_in", "hanging_in") and value == 0:
                    bad = bad | (F.coalesce(para["first_line_chars"], F.lit(0)) != 0) | (F.coalesce(para["hanging_chars"], F.lit(0)) != 0)
                own.append(F.when(para.isNotNull() & bad, f"paragraph[{p}].{key}"))
        errors = F.when((F.col("rule") == i) & one, F.concat(errors, F.filter(F.array(*own), lambda e: e.isNotNull()))).otherwise(errors)
    return rows.select("doc_id", "rule", errors.alias("errors"))


def run_formats_equal(actual: DataFrame, expected: DataFrame, keys: list[str], fmt: str) -> DataFrame:
    """(keys, ok): the format of each character is the same on both sides, however the runs are split. Both: keys, offset, text, fmt.

    Each side's runs are joined to stretches of one format, of which there are never more
    than runs; characters are not told apart.
    """

    def stretches(df: DataFrame, name: str) -> DataFrame:
        runs = df.where(F.length("text") > 0).select(*keys, F.col("offset").cast("long").alias("at"), F.length("text").alias("n"), F.col(fmt).alias("f"), "text")
        of = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "n", "f", "text"))).alias("r"))
        before = lambda i: F.get("r", i - 1)
        ends = lambda i: before(i)["at"] + before(i)["n"]
        same = lambda r, i: r["at"].eqNullSafe(ends(i)) & r["f"].eqNullSafe(before(i)["f"]) & (i > 0)
        marked = F.transform("r", lambda r, i: F.struct(same(r, i).alias("same"), F.struct(r["at"].alias("at"), r["f"].alias("f"), ends(i).alias("before")).alias("s")))
        spans = F.transform(F.filter(marked, lambda m: ~m["same"]), lambda m: m["s"])
        return of.select(*keys, F.struct(F.array_join(F.transform("r", lambda r: r["text"]), "").alias("text"), spans.alias("spans")).alias(name))

    both = stretches(actual, "a").join(stretches(expected, "b"), keys, "full")
    return both.select(*keys, F.col("a").eqNullSafe(F.col("b")).alias("ok"))


def apply_marginals(refs: DataFrame, rules: DataFrame) -> DataFrame:
    """References after set and clear rules: a set replaces its reference, a clear removes it, inherit leaves it away.

    rules: doc_id, section_idx, kind, ref_type, action, part_name.
    """
    on = ["doc_id", "section_idx", "kind", "ref_type"]
    kept = refs.join(rules, on, "left_anti")
    return kept.unionByName(rules.where("action = 'set'").select(*on, "part_name"))


def switches(refs: DataFrame) -> DataFrame:
    """(doc_id, even_and_odd, first_page_sections): the switches that the references need to show."""
    has: Column = F.bool_or(F.col("ref_type") == "even")
    return refs.groupBy("doc_id").agg(has.alias("even_and_odd"), F.array_sort(F.collect_set(F.when(F.col("ref_type") == "first", F.col("section_idx")))).alias("first_page_sections"))
