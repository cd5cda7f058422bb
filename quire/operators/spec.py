"""Written formatting specifications to rules (C-1 to C-5, W-12, W-13, P-19, P-20)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T

# Chinese names of page sides, and clauses that can't be measured.
SIDES = {"上": "top", "下": "bottom", "左": "left", "右": "right"}
VAGUE = "适当|美观|大致|左右|参考学校"
# Wording of measured clauses.
MARGIN = r"(上|下|左|右)[边頁页]?[距边]?\s*[为是:]?\s*(\d+(?:\.\d+)?)\s*(cm|厘米|mm|毫米|in|英寸)"
SPACING = r"(?:行距|行间距)\s*[为是:]?\s*(\d+(?:\.\d+)?)\s*倍"
INDENT = r"首行缩进\s*(\d+(?:\.\d+)?)\s*字符"
# Clauses of a set value: target, property, value, confidence, all that a line must match, and what it must not.
PAGE_CLAUSES = (
    ("page", "size", "a4", "high", (r"\bA4\b|A4纸|纸型.{0,4}A4",), None),
    ("page", "orientation", "portrait", "high", ("纵向|portrait",), None),
)
OTHER_CLAUSES = (
    ("pageNumbers.front", "format", "upper-roman", "medium", ("罗马", "页码"), None),
    ("pageNumbers.body", "format", "decimal", "medium", ("正文.{0,8}页码.{0,8}[1一]|页码.{0,6}阿拉伯",), None),
    ("headingNumbering", "enabled", "true", "medium", (r"一、|（一）|1\.", "标题"), None),
    ("tableRules", "preset", "three-line", "high", ("三线表|three[- ]line table",), None),
    ("headersFooters.header", "present", "true", "medium", ("页眉",), None),
    ("headersFooters.footer", "page", "true", "medium", ("页脚", "页码"), "(?:无|不设|不显示|不要)页码|页码.{0,3}(不显示|取消|隐藏)"),
    ("fields", "TOC", "true", "medium", ("目录", "自动|域|字段|三级|两级|1-2|1-3"), None),
    ("captions", "present", "true", "medium", ("题注|图题|表题",), None),
)
# What a table clause must name, each with its pattern.
# Wording of what a clause about tables may say.
TABLE_CLAUSE = {
    "indexes": r"(?:正文表格索引|body table indexes?)\s*[:：=]?\s*(\d+(?:\s*[,，、]\s*\d+)*)",
    "header_rows": r"(?:表头行数|header rows?)\s*[:：=]?\s*(\d+)",
    "outer_pt": r"(?:上下线|outer)\s*[:：=]?\s*([\d.]+)\s*(?:磅|pt)",
    "header_pt": r"(?:表头线|header border)\s*[:：=]?\s*([\d.]+)\s*(?:磅|pt)",
}
HEADINGS = {"Heading1": r"一级标题|章标题|Heading\s*1", "Heading2": r"二级标题|节标题|Heading\s*2", "Heading3": r"三级标题|Heading\s*3"}


def spec_lines(specs: DataFrame) -> DataFrame:
    """(spec_id, line_no, line): lines with white space collapsed, empty ones left out, numbered as they stand."""
    lines = specs.select("spec_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r\n|\n|\r", -1)).alias("line_no", "line"))
    return lines.withColumn("line", T.collapsed(F.col("line"))).where("line != ''")


def _rule(target: Column | str, prop: Column | str, value: Column, confidence: str = "high") -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_col(target).alias("target"), as_col(prop).alias("property"), value.cast("string").alias("value"), F.lit(confidence).alias("confidence"))


def _first(line: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(line, f"(?iU){pattern}", group), F.lit(""))


def number_text(c: Column) -> Column:
    """A measure as text with at most four decimals."""
    return F.format_string("%.4f", c)


def extract_rules(lines: DataFrame) -> DataFrame:
    """(spec_id, line_no, ord, target, property, value, evidence, confidence): the measurable clauses of each line, in one pass."""
    line, has = F.col("line"), lambda p: F.col("line").rlike(f"(?iU){p}")
    font, size = T.find_font(line), T.find_size_pt(line)
    table = has(r"表格|三线表|\btable")
    body = ~table & has("正文|主体|body") & (font.isNotNull() | size.isNotNull() | line.contains("行距") | line.contains("倍"))
    latin = font.isin("Times New Roman", "Arial")
    heading = F.coalesce(*[F.when(has(p), F.lit(name)) for name, p in HEADINGS.items()])
    spacing = _first(line, SPACING)
    indent = F.coalesce(_first(line, INDENT), F.when(line.contains("首行缩进") & line.contains("两"), "2"))
    text = lambda c: number_text(c.cast("double"))

    def clause(c: tuple) -> Column:
        target, prop, value, confidence, wanted, unwanted = c
        fits = reduce(lambda a, b: a & b, map(has, wanted))
        return F.when(fits & ~has(unwanted) if unwanted else fits, _rule(target, prop, F.lit(value), confidence))

    fixed = [
        *map(clause, PAGE_CLAUSES),
        F.when(body & font.isNotNull(), _rule("body", F.when(latin, "latinFont").otherwise("eastAsiaFont"), font)),
        F.when(body & size.isNotNull(), _rule("body", "sizePt", text(size))),
        F.when(body & spacing.isNotNull(), _rule("body", "lineSpacing", text(spacing))),
        F.when(body & (line.contains("两端对齐") | F.lower(line).contains("justify")), _rule("body", "alignment", F.lit("justify"))),
        F.when(body & indent.isNotNull(), _rule("body", "firstLineChars", text(indent))),
        F.when(heading.isNotNull(), _rule(heading, "font", F.coalesce(font, F.lit("黑体")))),
        F.when(heading.isNotNull() & size.isNotNull(), _rule(heading, "sizePt", text(size))),
        *map(clause, OTHER_CLAUSES),
    ]
    # Several margins may stand in one line: the three groups of each match, side by side.
    group = lambda i: F.regexp_extract_all(line, F.lit(f"(?iU){MARGIN}"), F.lit(i))
    inches = lambda amount, unit: F.round(amount.cast("double") / F.when(unit.isin("cm", "厘米"), 2.54).when(unit.isin("mm", "毫米"), 25.4).otherwise(1.0), 4)
    sides = F.create_map(*[F.lit(x) for kv in SIDES.items() for x in kv])
    margins = F.transform(F.arrays_zip(group(1).alias("s"), group(2).alias("a"), group(3).alias("u")), lambda m: _rule("page.margins", F.element_at(sides, m["s"]), number_text(inches(m["a"], F.lower(m["u"])))))
    found = F.concat(F.filter(F.array(*fixed), lambda r: r.isNotNull()), margins)
    rows = lines.select("spec_id", "line_no", F.substring(line, 1, 160).alias("evidence"), F.posexplode(found).alias("ord", "r"))
    return rows.select("spec_id", "line_no", "ord", "r.target", "r.property", "r.value", "evidence", "r.confidence")


def table_clause(line: Column) -> Column:
    """struct<indexes, header_rows, outer_pt, header_pt> of a line that names all four; null otherwise."""
    found = {name: _first(line, pattern) for name, pattern in TABLE_CLAUSE.items()}
    values = (F.regexp_replace(found["indexes"], r"(?U)\s*[,，、]\s*", ","), found["header_rows"].cast("int"), found["outer_pt"].cast("double"), found["header_pt"].cast("double"))
    return F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in found.values()]), F.struct(*[v.alias(n) for n, v in zip(found, values, strict=True)]))


def unresolved(lines: DataFrame) -> DataFrame:
    """(spec_id, line_no, reason): clauses that name no measure."""
    line, has = F.col("line"), lambda p: F.col("line").rlike(f"(?iU){p}")
    reasons = F.array(
        F.when(line.contains("页边距") & ~has(MARGIN), "margins"),
        F.when(has("三线表|three[- ]line table") & table_clause(line).isNull(), "table"),
        F.when(has("页眉") & ~has("[“\"'][^”\"']+[”\"']"), "header"),
        F.when(has("页脚") & ~line.contains("页码"), "footer"),
        F.when(has("参考文献") & has(r"著者-出版年|顺序编码|GB/T\s*7714"), "citation"),
        F.when(has(VAGUE), "vague"),
    )
    return lines.select("spec_id", "line_no", F.explode(F.filter(reasons, lambda r: r.isNotNull())).alias("reason"))


def rule_conflicts(rules: DataFrame) -> DataFrame:
    """Rules whose value differs from that of the rule before it for the same target and property."""
    before = F.lag("value").over(W.partitionBy("spec_id", "target", "property").orderBy("line_no", "ord"))
    return rules.withColumn("previous", before).where(F.col("previous").isNotNull() & (F.col("previous") != F.col("value")))


def last_values(rules: DataFrame) -> DataFrame:
    """The value that holds for each target and property: the last one."""
    return rules.groupBy("spec_id", "target", "property").agg(F.max_by("value", F.struct("line_no", "ord")).alias("value"))


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


# What a draft assumes where a specification is silent.
DEFAULTS = {"eastAsiaFont": "宋体", "sizePt": "12.0000", "lineSpacing": "1.5000", "alignment": "justify", "firstLineChars": "2.0000"}


def fill_defaults(rules: DataFrame) -> DataFrame:
    """(spec_id, property, value, assumed): body properties of each specification, with defaults for those it lacks."""
    specs = rules.select("spec_id").distinct()
    wanted = specs.select("spec_id", F.explode(F.create_map(*[F.lit(x) for kv in DEFAULTS.items() for x in kv])).alias("property", "_default"))
    given = last_values(rules).where("target = 'body'").select("spec_id", "property", "value")
    rows = wanted.join(given, ["spec_id", "property"], "left")
    return rows.select("spec_id", "property", F.coalesce("value", "_default").alias("value"), F.col("value").isNull().alias("assumed"))


def assemble_profile(rules: DataFrame) -> DataFrame:
    """(spec_id, profile): the values that hold, as one JSON object of target and property."""
    pairs = F.array_sort(F.collect_list(F.struct(F.concat_ws(".", "target", "property").alias("key"), "value")))
    return last_values(rules).groupBy("spec_id").agg(F.to_json(F.map_from_entries(pairs)).alias("profile"))
