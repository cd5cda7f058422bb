"""Actual against expected formatting: findings of pages, styles, page numbers, structure; scores (J-3 to J-8, J-11, J-12, J-20, A-6, A-10, U-1)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import units as U

FINDING = ("doc_id", "category", "name", "ok", "severity", "expected", "actual", "affected", "suggestion")


def finding(doc_id: Column, category: str, name: Column, ok: Column, expected: Column, actual: Column, severity: Column | None = None, affected: Column | None = None, suggestion: Column | None = None) -> Column:
    """One finding as a struct; expected and actual as text, severity info where it is ok."""
    ok = F.coalesce(ok, F.lit(False))
    values = (doc_id, F.lit(category), name, ok, F.when(ok, "info").otherwise(severity if severity is not None else F.lit("error")), expected.cast("string"), actual.cast("string"), affected if affected is not None else F.lit(None).cast("long"), suggestion if suggestion is not None else F.lit(None).cast("string"))
    return F.struct(*[v.alias(n) for v, n in zip(values, FINDING, strict=True)])


def exploded(rows: DataFrame, findings: list[Column]) -> DataFrame:
    """Rows of the findings that aren't null."""
    return rows.select(F.explode(F.filter(F.array(*findings), lambda f: f.isNotNull())).alias("_f")).select("_f.*")


def diff_page(sections: DataFrame, page: dict) -> DataFrame:
    """Page findings of every section. sections: measures in inches; page: size, width, height, orientation, margins by side."""
    text = lambda v, t: F.lit(v).cast(t)
    w, h = U.expected_page_size(text(page.get("size"), "string"), text(page.get("orientation"), "string"), text(page.get("widthIn"), "double"), text(page.get("heightIn"), "double"))
    at = lambda what: F.format_string(f"section[%d].{what}", F.col("section_idx"))
    found = [F.when(want.isNotNull(), finding(F.col("doc_id"), "page", at(f"{name}In"), U.approx(F.col(f"{name}_in"), want, 0.05), want, F.col(f"{name}_in"))) for name, want in (("width", w), ("height", h))]
    if page.get("orientation"):
        got = F.regexp_replace(F.coalesce("orientation", F.lit("")), "/default", "")
        ok = (got == page["orientation"]) | (F.lit(page["orientation"] == "portrait") & got.isin("portrait", ""))
        found.append(finding(F.col("doc_id"), "page", at("orientation"), ok, F.lit(page["orientation"]), F.col("orientation")))
    for side, want in (page.get("margins") or {}).items():
        found.append(finding(F.col("doc_id"), "page", at(f"margins.{side}"), U.approx(F.col(f"{side}_in"), F.lit(float(want)), 0.05), F.lit(float(want)), F.col(f"{side}_in")))
    return exploded(sections, found)


def normal_color(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "^#", ""))


def normal_alignment(c: Column) -> Column:
    return F.when(c == "both", "justify").otherwise(c)


def property_findings(expected: dict[str, object], prefix: Column, category: str, tolerances: dict[str, float], affected: Column) -> list[Column]:
    """A finding of each expected property against the column of the same name, numbers within their tolerance."""
    found = []
    for key, want in expected.items():
        got, lit = F.col(key), F.lit(want)
        if key in tolerances:
            ok = U.approx(got.cast("double"), lit.cast("double"), tolerances[key])
        elif key == "color":
            ok = normal_color(got).eqNullSafe(normal_color(lit))
        elif key == "alignment":
            ok = normal_alignment(got).eqNullSafe(normal_alignment(lit))
        else:
            ok = got.eqNullSafe(lit)
        found.append(finding(F.col("doc_id"), category, F.concat(prefix, F.lit(f".{key}")), ok, lit, got, affected=affected, suggestion=F.concat(F.lit("set "), prefix, F.lit(f" {key} to {want}"))))
    return found


def diff_properties(rows: DataFrame, expected: dict[str, object], prefix: Column, category: str, tolerances: dict[str, float], affected: Column) -> DataFrame:
    """Findings of the expected properties against columns of the same name, numbers within their tolerance."""
    return exploded(rows, property_findings(expected, prefix, category, tolerances, affected))


RUN_TOLERANCE = {"size_pt": 0.25}
PARA_TOLERANCE = {"line_spacing": 0.06, "line_exact_pt": 0.06, "space_before_pt": 0.06, "space_after_pt": 0.06}


FIRST_LINE = 0.04


def first_line_expected(paragraph: dict, size_pt: float | None) -> float | None:
    """The first line's indent in inches that a rule asks for, from inches or from characters of the rule's size (12 pt if none)."""
    if "first_line_in" in paragraph:
        return float(paragraph["first_line_in"])
    return paragraph["first_line_chars"] * (size_pt or 12) / 72 if "first_line_chars" in paragraph else None


def diff_styles(docs: DataFrame, styles: DataFrame, usage: DataFrame, expected: dict[str, dict[str, dict]]) -> DataFrame:
    """Whether each expected style exists in each document, and run and paragraph findings of those that do.

    The expected styles are exploded beside each document and joined once, however
    many a profile has; each style's findings are a branch of one array.
    """
    wanted = docs.select("doc_id", F.explode(F.array(*map(F.lit, expected))).alias("_want"))
    used = usage.select(F.col("doc_id").alias("_ud"), F.col("style_id").alias("_us"), F.col("n").alias("_n"))
    have = styles.withColumnsRenamed({"doc_id": "_sd", "style_id": "_ss"})
    rows = wanted.join(have, (F.col("doc_id") == F.col("_sd")) & (F.col("_want") == F.col("_ss")), "left").join(used, (F.col("doc_id") == F.col("_ud")) & (F.col("_want") == F.col("_us")), "left")
    rows = rows.withColumn("_used", F.coalesce("_n", F.lit(0)).cast("long"))
    doc, exists, affected, found = F.col("doc_id"), F.col("_ss").isNotNull(), F.col("_used"), []
    found.append(finding(doc, "style", F.concat(F.lit("styles."), "_want", F.lit(".exists")), exists, F.lit(True), exists, affected=affected, suggestion=F.concat(F.lit("create style "), "_want")))
    for style_id, config in expected.items():
        here, prefix = exists & (F.col("_want") == style_id), f"styles.{style_id}"
        for category, tolerances in (("run", RUN_TOLERANCE), ("paragraph", PARA_TOLERANCE)):
            own = {k: v for k, v in (config.get(category) or {}).items() if k not in ("first_line_in", "first_line_chars")}
            found += [F.when(here, f) for f in property_findings(own, F.lit(prefix), category, tolerances, affected)]
        first = first_line_expected(config.get("paragraph") or {}, (config.get("run") or {}).get("size_pt"))
        if first is not None:
            got = F.col("first_line_in").cast("double")
            found.append(F.when(here, finding(doc, "paragraph", F.lit(f"{prefix}.first_line_in"), U.approx(got, F.lit(first), FIRST_LINE), F.lit(first), got, affected=affected, suggestion=F.lit(f"set {prefix} first-line indent to {first}"))))
    return exploded(rows, found)


ENTRIES = 1 << 18  # expected page numbers that one task looks up


def diff_page_numbers(docs: DataFrame, sections: DataFrame, expected: list[tuple[int, str | None, int | None]]) -> DataFrame:
    """Each expected (section, format, start) in each document; a section out of range, or without page numbers, fails. One join for all."""
    entries = [F.struct(F.lit(at).alias("at"), F.lit(U.NUMBER_FORMATS.get(form, form) if form else None).cast("string").alias("form"), F.lit(start).cast("int").alias("start")) for at, form, start in expected]
    # Partitions grow with the documents, so that a task sorts no more of them on larger inputs.
    n = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(docs.count() * len(entries) / ENTRIES))
    wanted = docs.select("doc_id", F.explode(F.array(*entries)).alias("w")).select("doc_id", "w.*").repartition(n, "doc_id", "at")
    here = sections.select(F.col("doc_id").alias("_d"), F.col("section_idx").alias("_i"), "num_fmt", "num_start").repartition(n, "_d", "_i")
    rows = wanted.join(here, (F.col("doc_id") == F.col("_d")) & (F.col("at") == F.col("_i")), "left")
    ok = F.coalesce("num_fmt", F.col("num_start").cast("string")).isNotNull()
    ok = ok & (F.col("form").isNull() | F.coalesce(F.col("num_fmt") == F.col("form"), F.lit(False))) & (F.col("start").isNull() | F.coalesce(F.col("num_start") == F.col("start"), F.lit(False)))
    told = lambda f, s: F.concat_ws("/", F.coalesce(f, F.lit("-")), F.coalesce(F.col(s).cast("string"), F.lit("-")))
    name = F.format_string("pageNumbers.section[%d]", F.col("at"))
    return exploded(rows, [finding(F.col("doc_id"), "pageNumbers", name, ok, told("form", "start"), told("num_fmt", "num_start"), suggestion=F.lit("configure page numbers for this section"))])


def inheriting_sections(sections: DataFrame, owns: Column) -> DataFrame:
    """For each section with its own header, the later sections that show it until one has its own."""
    mine = F.last(F.when(owns, F.col("section_idx")), ignorenulls=True).over(W.partitionBy("doc_id").orderBy("section_idx").rowsBetween(W.unboundedPreceding, 0))
    rows = sections.select("doc_id", "section_idx", mine.alias("_owner"))
    later = F.array_sort(F.collect_list(F.when(F.col("section_idx") > F.col("_owner"), F.col("section_idx"))))
    return rows.where("_owner IS NOT NULL").groupBy("doc_id", F.col("_owner").alias("section_idx")).agg(later.alias("inheriting"))


# Region ids of a document specification and the summary flags that answer them.
REGION_FLAGS = {"cover": "has_cover", "declaration": "has_declaration", "abstract": "has_abstract_zh", "abstract_zh": "has_abstract_zh", "abstract_en": "has_abstract_en", "toc": "has_toc", "list_of_figures": "has_list_of_figures", "list_of_tables": "has_list_of_tables", "references": "has_references", "acknowledgement": "has_acknowledgement", "appendix": "has_appendix"}


def diff_structure(summary: DataFrame, wanted: tuple) -> DataFrame:
    """Structure findings of each document; wanted: (id, required, least number, languages) in order."""
    found, doc = [], F.col("doc_id")
    for i, (region, required, least, languages) in enumerate(wanted):
        name = F.lit(f"document.sections[{i}].{region}")
        if region == "chapter":
            least = least if least is not None else int(required)
            found.append(finding(doc, "structure", name, F.col("chapters") >= least, F.lit(least), F.col("chapters"), F.lit("error" if required else "warning"), suggestion=F.lit("map chapter headings with paragraph rules or Heading1")))
            continue
        if region in REGION_FLAGS:
            has = F.col(REGION_FLAGS[region])
            found.append(finding(doc, "structure", name, has if required else F.lit(True), F.lit(required), has, F.lit("error"), suggestion=F.lit(f"ensure a recognizable {region} region exists")))
        if region in ("abstract", "abstract_zh") and "en" in (languages or "").split(","):
            has = F.col("has_abstract_en")
            found.append(finding(doc, "structure", F.lit("document.abstract_en"), has, F.lit(True), has, F.lit("warning"), suggestion=F.lit("ensure an English Abstract heading exists")))
    return exploded(summary, found)


def category_scores(findings: DataFrame) -> DataFrame:
    passed = F.count_if(F.col("ok"))
    return findings.groupBy("doc_id", "category").agg(F.count("*").alias("total"), (F.count("*") - passed).alias("failed"), F.round(100 * passed / F.count("*"), 1).alias("score"))


def scores(findings: DataFrame) -> DataFrame:
    """Per document: overall (mean of the category scores) and whether nothing failed."""
    tenths = F.sum(F.round(F.col("score") * 10).cast("long"))  # whole numbers, so that the order of the sum doesn't matter
    return category_scores(findings).groupBy("doc_id").agg(F.round(tenths / (F.count("*") * 10), 1).alias("overall"), (F.sum("failed") == 0).alias("ok"))


def check_section_count(sections: DataFrame, least: int | None, most: int | None) -> DataFrame:
    n = F.count("*")
    ok = (n >= least if least is not None else F.lit(True)) & (n <= most if most is not None else F.lit(True))
    return sections.groupBy("doc_id").agg(n.alias("sections"), ok.alias("ok"))


def closest_page_size(width: Column, height: Column, within: float = 0.15) -> Column:
    """Name of the nearest page size in either orientation; null if none is near. Of equally near ones, the first."""
    sizes = list(U.PAGE_SIZES.items())
    deltas = [F.least(F.abs(width - w) + F.abs(height - h), F.abs(width - h) + F.abs(height - w)) for _, (w, h) in sizes]
    least = F.least(*deltas)
    return F.when(least <= within, F.coalesce(*[F.when(d == least, F.lit(name)) for (name, _), d in zip(sizes, deltas, strict=True)]))


def _by_document(styles: DataFrame, values: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, _rows): the styles of each document in one row."""
    return styles.groupBy("doc_id").agg(F.collect_list(F.struct("style_id", "based_on", *values)).alias("_rows"))


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[int], list]]:
    """(document's place, first style, parents, ids) of a batch: a parent is a place within the document, or -1."""
    flat = dict(zip([f.name for f in batch.column("_rows").type.value_type], batch.column("_rows").flatten().flatten(), strict=True))
    begin = 0
    for i, n in enumerate(batch.column("_rows").value_lengths().to_pylist()):
        ids, ups = flat["style_id"].slice(begin, n).to_pylist(), flat["based_on"].slice(begin, n).to_pylist()
        at: dict = {}
        for k, name in enumerate(ids):
            at.setdefault(name, k)
        yield i, begin, [-1 if up is None or up == name else at.get(up, -1) for name, up in zip(ids, ups, strict=True)], ids
        begin += n


CHAIN_ROWS = 1 << 16  # rows that a task gathers before it passes them on


def style_chain(styles: DataFrame) -> DataFrame:
    """(doc_id, style_id, ancestor, depth): each style and those that it is based on, a cycle stops where it would repeat.

    A document's styles come together in one row, and their chains, whose rows may be the
    square of them, are passed on in slices and never stored. Ids are unique in a document;
    of several styles with one id, the first is based on.
    """
    kind = dict(styles.dtypes)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, docs, own, ancestors, depths = batch.column("_rows").flatten().flatten()[0], [], [], [], []

            def gathered(batch=batch, ids=ids, docs=docs, own=own, ancestors=ancestors, depths=depths) -> pa.RecordBatch:
                columns = [batch.column("doc_id").take(pa.array(docs, pa.int64())), ids.take(pa.array(own, pa.int64())), ids.take(pa.array(ancestors, pa.int64())), pa.array(depths, pa.int32())]
                for x in (docs, own, ancestors, depths):
                    x.clear()
                return pa.RecordBatch.from_arrays(columns, ["doc_id", "style_id", "ancestor", "depth"])

            for i, begin, up, _ in _documents(batch):
                for k in range(len(up)):
                    chain, at = {}, k
                    while at >= 0 and at not in chain:
                        chain[at] = begin + at
                        at = up[at]
                    docs += [i] * len(chain)
                    own += [begin + k] * len(chain)
                    ancestors += chain.values()
                    depths += range(len(chain))
                    if len(own) >= CHAIN_ROWS:
                        yield gathered()
            yield gathered()

    return _by_document(styles).mapInArrow(walk, f"doc_id {kind['doc_id']}, style_id {kind['style_id']}, ancestor {kind['style_id']}, depth int")


def _resolved(up: list[int], has: list[bool]) -> tuple[list[int | None], list[bool]]:
    """For each style the nearest one of its chain that has a value, and whether an odd number of them have; each link is followed once or, on a cycle, twice."""
    nearest, odd, done = [None] * len(up), [False] * len(up), [False] * len(up)
    for k in range(len(up)):
        path, place, at = [], {}, k
        while at >= 0 and not done[at] and at not in place:
            place[at] = len(path)
            path.append(at)
            at = up[at]
        near, parity, tail = None, False, path
        if at >= 0 and done[at]:
            near, parity = nearest[at], odd[at]
        elif at >= 0:  # a cycle: each of its styles has all the others above it
            ring, tail = path[place[at] :], path[: place[at]]
            parity = sum(has[x] for x in ring) % 2 == 1
            for x in [*reversed(ring), *reversed(ring)]:
                near = x if has[x] else near
                nearest[x], odd[x], done[x] = near, parity, True
            near = nearest[at]
        for x in reversed(tail):
            near, parity = x if has[x] else near, parity != has[x]
            nearest[x], odd[x], done[x] = near, parity, True
    return nearest, odd


def effective_styles(styles: DataFrame, overlays: tuple[str, ...], toggles: tuple[str, ...]) -> DataFrame:
    """(doc_id, style_id, properties): as ``effective_props``, without the chains, whose rows are the squares of their lengths.

    A document's styles come together in one row; each takes over what its parent has,
    the nearest value that isn't null and the parity of true toggles.
    """
    kind, names = dict(styles.dtypes), [*overlays, *toggles]

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("_rows").flatten()
            flat = dict(zip([f.name for f in rows.type], rows.flatten(), strict=True))
            docs, own, found = [], [], {c: [] for c in names}

            def gathered(batch=batch, flat=flat, docs=docs, own=own, found=found) -> pa.RecordBatch:
                values = [flat[c].take(pa.array(found[c], pa.int64())) for c in overlays] + [pa.array(found[c], pa.bool_()) for c in toggles]
                columns = [batch.column("doc_id").take(pa.array(docs, pa.int64())), flat["style_id"].take(pa.array(own, pa.int64())), *values]
                for x in (docs, own, *found.values()):
                    x.clear()
                return pa.RecordBatch.from_arrays(columns, ["doc_id", "style_id", *names])

            for i, begin, up, ids in _documents(batch):
                docs += [i] * len(ids)
                own += range(begin, begin + len(ids))
                for c in overlays:
                    found[c] += [None if x is None else begin + x for x in _resolved(up, flat[c].slice(begin, len(ids)).is_valid().to_pylist())[0]]
                for c in toggles:
                    found[c] += _resolved(up, [bool(x) for x in flat[c].slice(begin, len(ids)).to_pylist()])[1]
                if len(docs) >= CHAIN_ROWS:
                    yield gathered()
            yield gathered()

    types = [f"{c} {kind[c]}" for c in ("doc_id", "style_id", *overlays)] + [f"{c} boolean" for c in toggles]
    return _by_document(styles, tuple(names)).mapInArrow(resolve, ", ".join(types))


def effective_props(chain: DataFrame, styles: DataFrame, overlays: tuple[str, ...], toggles: tuple[str, ...]) -> DataFrame:
    """Properties of each style with those that it inherits: the nearest value that isn't null; toggles flip for each true one."""
    of = styles.select(F.col("doc_id").alias("_d"), F.col("style_id").alias("_s"), *overlays, *toggles)
    rows = chain.join(of, (F.col("doc_id") == F.col("_d")) & (F.col("ancestor") == F.col("_s")))
    nearest = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("depth"))).alias(c) for c in overlays]
    flips = [(F.count_if(F.coalesce(F.col(c), F.lit(False))) % 2 == 1).alias(c) for c in toggles]
    return rows.groupBy("doc_id", "style_id").agg(*nearest, *flips)
