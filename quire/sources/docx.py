"""Scan of a corpus of Word packages (S-1, P-4, P-5): files to element rows, element rows to tables.

The Python part only unzips a package and writes its elements as rows with their
raw attributes, in document order; everything that interprets them is column
functions. Write the elements once and derive the tables from there.
"""

from __future__ import annotations

import io
import itertools
import re
import xml.etree.ElementTree as ET
import zipfile
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import units as U
from quire.operators.packages import resolve_target

MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
# Namespaces that a compatibility branch may require.
SUPPORTED = {
    "http://schemas.openxmlformats.org/wordprocessingml/2006/main",
    "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
    "http://schemas.openxmlformats.org/drawingml/2006/main",
    "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing",
    "http://schemas.microsoft.com/office/word/2010/wordprocessingShape",
    "urn:schemas-microsoft-com:vml",
}
BODY_KINDS = ("block", "run", "field", "bookmark", "section", "ref", "table", "row", "cell")
BATCH_ROWS, BATCH_CHARS = 1 << 14, 1 << 22  # element rows, and characters of their texts, that a task gathers before it passes them on
SCHEMA = "doc_id string, kind string, ord int, idx int, text string, props map<string,string>"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _parse(data: bytes) -> ET.Element:
    """The root, with of each compatibility element the first supported branch, else the fallback."""
    events = ET.iterparse(io.BytesIO(data), ("start-ns",))
    prefixes = dict(x for _, x in events)
    root = events.root
    if MC.strip("{}") not in prefixes.values():
        return root

    def choose(node: ET.Element) -> None:
        children = []
        for child in node:
            if child.tag != f"{MC}AlternateContent":
                children.append(child)
                continue
            fit = [b for b in child if b.tag == f"{MC}Choice" and b.get("Requires", "").split() and all(prefixes.get(p) in SUPPORTED for p in b.get("Requires").split())]
            children += (fit or [b for b in child if b.tag == f"{MC}Fallback"] or [[]])[0]
        if children != list(node):
            node[:] = children
            choose(node)  # a branch may hold further ones
            return
        for child in node:
            choose(child)

    choose(root)
    return root


def _props(node: ET.Element | None, prefix: str = "") -> dict[str, str]:
    """Children of a property element: ``name`` is there, and ``name@attribute`` its values."""
    out: dict[str, str] = {}
    for child in node if node is not None else ():
        name = prefix + _local(child.tag)
        out[name] = ""
        out |= {f"{name}@{_local(k)}": v for k, v in child.attrib.items()}
    return out


def _child(node: ET.Element, name: str) -> ET.Element | None:
    return next((c for c in node if _local(c.tag) == name), None)


def _val(node: ET.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _local(k) == name), None)


def _refs(section: ET.Element, at: int) -> Iterator[tuple]:
    """Header and footer references of a section."""
    for child in section:
        if _local(child.tag) in ("headerReference", "footerReference"):
            yield "ref", at, None, next((v for k, v in child.attrib.items() if k.endswith("}id")), None), {"kind": _local(child.tag).removesuffix("Reference"), "type": _val(child, "type") or "default"}


def _body(root: ET.Element, with_runs: bool = True) -> Iterator[tuple]:
    idx, sections, fields, tables = 0, 0, 0, 0
    place: tuple = (None, None, None)  # table, row and cell that the walk is in
    top = None

    def visit(node: ET.Element, table: bool, box: bool) -> Iterator[tuple]:
        nonlocal idx, sections, fields, tables, place, top
        rows = cells = 0
        for child in node:
            name = _local(child.tag)
            if name == "p":
                yield from paragraph(child, table, box)
            elif name == "sectPr":
                yield "section", sections, None, None, _props(child)
                yield from _refs(child, sections)
                sections += 1
            elif name == "tbl":
                outer, outer_top, own = place, top, tables
                tables += 1
                up = {"#parent": outer[0], "#parent_row": outer[1], "#parent_cell": outer[2]}
                grid = _child(child, "tblGrid")
                yield "table", own, None, ",".join(_val(c, "w") or "" for c in grid) if grid is not None else "", _props(_child(child, "tblPr")) | {k: str(v) for k, v in up.items() if v is not None} | {"#in_text_box": str(box).lower()}
                place, top = (own, None, None), own if outer[0] is None else outer_top
                yield from visit(child, True, box)
                place, top = outer, outer_top
            elif name == "tr" and place[0] is not None:
                place = (place[0], rows, None)
                yield "row", place[0], rows, None, _props(_child(child, "trPr"))
                yield from visit(child, table, box)
                rows += 1
            elif name == "tc" and place[1] is not None:
                place = (*place[:2], cells)
                pr = _child(child, "tcPr")
                edges = _child(pr, "tcBorders") if pr is not None else None
                yield "cell", place[0], place[1], str(cells), _props(pr) | _props(edges, "edge/")
                yield from visit(child, table, box)
                place = (*place[:2], None)
                cells += 1
            else:
                yield from visit(child, table, box or name == "txbxContent")

    def paragraph(p: ET.Element, table: bool, box: bool) -> Iterator[tuple]:
        nonlocal idx, sections, fields
        own, idx = idx, idx + 1
        pr = _child(p, "pPr")
        section = _child(pr, "sectPr") if pr is not None else None
        texts, runs, inner, drawings = [], [], [], []

        def content(node: ET.Element, run: ET.Element | None) -> None:
            nonlocal fields
            for child in node:
                name = _local(child.tag)
                if name == "p":
                    inner.append(child)
                elif name == "r":
                    runs.append((child, []))
                    content(child, child)
                elif name == "t":
                    texts.append(child.text or "")
                    if runs:
                        runs[-1][1].append(child.text or "")
                else:
                    if name == "extent" and child.get("cx"):
                        drawings.append(child.get("cx"))
                    elif name == "instrText" and (child.text or "").strip() or name == "fldSimple":
                        value = next((v for k, v in child.attrib.items() if _local(k) == "instr"), None) if name == "fldSimple" else child.text
                        found.append(("field", fields, own, " ".join((value or "").split()), {}))
                        fields += 1
                    elif name == "bookmarkStart":
                        found.append(("bookmark", own, own, next((v for k, v in child.attrib.items() if _local(k) == "name"), None), {}))
                    content(child, run)

        found: list[tuple] = []
        content(p, None)
        flags = {"in_table": str(table).lower(), "in_text_box": str(box).lower(), "section_break": str(section is not None).lower(), "drawings": ",".join(drawings)}
        flags |= {k: str(v) for k, v in zip(("table", "row", "cell", "top_table"), (*place, top), strict=True) if v is not None}
        yield "block", own, own, "".join(texts), _props(pr) | {f"#{k}": v for k, v in flags.items()}
        for n, (run, parts) in enumerate(runs if with_runs else ()):
            yield "run", n, own, "".join(parts), _props(_child(run, "rPr"))
        yield from found
        if section is not None:
            yield "section", sections, own, None, _props(section)
            yield from _refs(section, sections)
            sections += 1
        for child in inner:
            yield from paragraph(child, table, True)

    body = _child(root, "body")
    yield from visit(body if body is not None else root, False, False)


def shred(data: bytes, kinds: frozenset[str] | None = None) -> Iterator[tuple]:
    """(kind, ord, idx, text, props) rows of one package, of all kinds or of the given ones; what can't be read of what they need gives an ``error`` row."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        bad = archive.testzip()
    except (zipfile.BadZipFile, EOFError, OSError) as e:
        yield "error", 0, None, f"package: {e}", {}
        return
    if bad:
        yield "error", 0, None, f"member: {bad}", {}
    wanted = lambda *of: kinds is None or not kinds.isdisjoint(of)
    if wanted("part"):
        for i, info in enumerate(archive.infolist()):
            yield "part", i, None, info.filename, {"size": str(info.file_size)}
    names = Counter(archive.namelist())
    readers = [
        ("word/document.xml", lambda root: _body(root, wanted("run")), BODY_KINDS), ("word/styles.xml", _styles, ("default", "style")), ("word/_rels/document.xml.rels", _rels, ("rel",)),
        ("word/numbering.xml", _numbering, ("num", "level")), ("word/settings.xml", _settings, ("setting",)),
    ]
    readers += [(name, lambda root, name=name: _marginal(root, name), ("mpara", "mrun", "melement")) for name in sorted(names) if re.fullmatch(r"word/(header|footer)\d*\.xml", name)]
    for name, read, gives in readers:
        if name in names and wanted(*gives):
            try:
                yield from [row for row in read(_parse(archive.read(name))) if wanted(row[0])]
            except (ET.ParseError, zipfile.BadZipFile) as e:
                yield "error", 0, None, f"{name}: {e}", {}


def _styles(root: ET.Element) -> Iterator[tuple]:
    defaults = _child(root, "docDefaults")
    if defaults is not None:
        inner = [_child(x, n) if (x := _child(defaults, d)) is not None else None for d, n in (("pPrDefault", "pPr"), ("rPrDefault", "rPr"))]
        yield "default", 0, None, None, _props(inner[0]) | _props(inner[1], "r/")
    for i, style in enumerate(c for c in root if _local(c.tag) == "style"):
        own = {f"#{_local(k)}": v for k, v in style.attrib.items()}
        named = {f"#{n}": next((v for k, v in c.attrib.items() if _local(k) == "val"), "") for n in ("name", "basedOn", "next") if (c := _child(style, n)) is not None}
        yield "style", i, None, own.get("#styleId"), own | named | _props(_child(style, "pPr")) | _props(_child(style, "rPr"), "r/")


def _rels(root: ET.Element) -> Iterator[tuple]:
    for i, rel in enumerate(root):
        yield "rel", i, None, rel.get("Id"), {"type": rel.get("Type", ""), "target": rel.get("Target", "")}


def _numbering(root: ET.Element) -> Iterator[tuple]:
    for x in root:
        if _local(x.tag) == "num":
            to = _child(x, "abstractNumId")
            yield "num", int(_val(x, "numId") or 0), None, _val(to, "val") if to is not None else None, {}
        elif _local(x.tag) == "abstractNum":
            for level in x:
                if _local(level.tag) == "lvl":
                    yield "level", int(_val(x, "abstractNumId") or 0), int(_val(level, "ilvl") or 0), None, _props(level)


def _settings(root: ET.Element) -> Iterator[tuple]:
    yield "setting", 0, None, None, _props(root)


def _marginal(root: ET.Element, part: str) -> Iterator[tuple]:
    """Paragraphs, their runs (text, field markers, instructions) and other elements of a header or footer part."""
    for n, p in enumerate(x for x in root.iter() if _local(x.tag) == "p"):
        pr = _child(p, "pPr")
        border = _child(pr, "pBdr") if pr is not None else None
        yield "mpara", n, None, part, _props(pr) | _props(border, "edge/")
        for k, run in enumerate(r for r in p.iter() if _local(r.tag) == "r"):
            props = {"#marker": next((_val(c, "fldCharType") for c in run if _local(c.tag) == "fldChar"), None), "#instr": "".join(c.text or "" for c in run if _local(c.tag) == "instrText") or None, "#text": "".join(c.text or "" for c in run if _local(c.tag) == "t")}
            yield "mrun", n, k, part, {x: v for x, v in props.items() if v is not None}
    for tag in sorted({_local(x.tag) for x in root.iter()} & {"drawing", "pict", "object", "sdt", "tbl", "txbxContent", "ins", "del"}):
        yield "melement", 0, None, part, {"#tag": tag}


def scan_corpus(spark: SparkSession, path: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Element rows of every file that the path (a glob) names; doc_id is the file's path."""
    return shredded(spark.read.format("binaryFile").load(path).select("path", "content"), kinds)


def shredded(packages: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Element rows of packages: (path, content); of all kinds, or of the given ones and errors, for which only the parts that give them are read."""
    only = frozenset(kinds) if kinds is not None else None

    def rows_of(found: list[tuple]) -> pa.RecordBatch:
        names, kind, ords, idxs, texts, props = zip(*found, strict=True) if found else ((),) * 6
        at = pa.array([0, *itertools.accumulate(map(len, props))], pa.int32())
        keys, values = ([x for p in props for x in of(p)] for of in (dict.keys, dict.values))
        columns = [pa.array(names, pa.string()), pa.array(kind, pa.string()), pa.array(ords, pa.int32()), pa.array(idxs, pa.int32()), pa.array(texts, pa.string()), pa.MapArray.from_arrays(at, pa.array(keys, pa.string()), pa.array(values, pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "kind", "ord", "idx", "text", "props"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                path = name.as_py()
                for row in shred(content.as_py(), only):
                    found.append((path, *row))
                    size += len(row[3] or "")
                    if len(found) >= BATCH_ROWS or size >= BATCH_CHARS:
                        yield rows_of(found)
                        found, size = [], 0
        yield rows_of(found)

    return packages.mapInArrow(read, SCHEMA)


def _get(props: Column, key: str) -> Column:
    return F.try_element_at(props, F.lit(key))


def _toggle(props: Column, key: str) -> Column:
    return U.toggle(F.map_contains_key(props, key), _get(props, f"{key}@val"))


def para_props(p: Column) -> Column:
    """Paragraph properties as a struct of 17 columns."""
    get = lambda k: _get(p, k)
    line, rule = get("spacing@line"), F.coalesce(get("spacing@lineRule"), F.lit("auto"))
    fields = {
        "alignment": get("jc@val"), "line_spacing": F.when(rule == "auto", F.round(U.num(line) / 240, 4)), "line_exact_pt": F.when(rule != "auto", F.round(U.num(line) / 20, 4)), "line_rule": F.when(line.isNotNull(), rule),
        "space_before_pt": F.round(U.num(get("spacing@before")) / 20, 4), "space_after_pt": F.round(U.num(get("spacing@after")) / 20, 4),
        "left_in": U.twips_to_in(get("ind@left")), "right_in": U.twips_to_in(get("ind@right")), "first_line_in": U.twips_to_in(get("ind@firstLine")), "hanging_in": U.twips_to_in(get("ind@hanging")),
        "first_line_chars": U.num(get("ind@firstLineChars")) / 100, "hanging_chars": U.num(get("ind@hangingChars")) / 100,
        "keep_next": _toggle(p, "keepNext"), "keep_lines": _toggle(p, "keepLines"), "page_break_before": _toggle(p, "pageBreakBefore"), "widow_control": _toggle(p, "widowControl"), "outline_level": get("outlineLvl@val").try_cast("int"),
    }
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def run_props(p: Column, prefix: str = "") -> Column:
    """Run properties as a struct of 7 columns; the Latin font falls back from ascii to hAnsi."""
    get = lambda k: _get(p, prefix + k)
    fields = {"latin": F.coalesce(get("rFonts@ascii"), get("rFonts@hAnsi")), "east_asia": get("rFonts@eastAsia"), "complex_script": get("rFonts@cs"), "size_pt": U.half_pt_to_pt(get("sz@val")), "bold": _toggle(p, f"{prefix}b"), "italic": _toggle(p, f"{prefix}i"), "color": get("color@val")}
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def tables(elements: DataFrame) -> dict[str, DataFrame]:
    """The tables of a corpus: parts, blocks, runs (with text offsets), styles, defaults, sections, refs, fields, bookmarks, rels, tables, table_rows, table_cells, num, num_levels, marginal_paras, marginal_runs, marginal_elements, settings, errors."""
    of, p = lambda kind: elements.where(F.col("kind") == kind), F.col("props")
    flag = lambda k: _get(p, f"#{k}") == "true"
    drawings = F.transform(F.filter(F.split(F.coalesce(_get(p, "#drawings"), F.lit("")), ","), lambda x: x != ""), U.emu_to_in)
    blocks = of("block").select("doc_id", "idx", _get(p, "pStyle@val").alias("style_id"), "text", para_props(p).alias("para"), flag("in_table").alias("in_table"), flag("in_text_box").alias("in_text_box"), flag("section_break").alias("section_break"), *[_get(p, f"#{k}").cast("int").alias(v) for k, v in (("table", "table_idx"), ("row", "row_idx"), ("cell", "cell_idx"), ("top_table", "top_table_idx"))], drawings.alias("drawing_widths"))
    blocks = blocks.withColumns({"has_drawing": F.size("drawing_widths") > 0, "keep_next": F.col("para.keep_next")})
    before = W.partitionBy("doc_id", "idx").orderBy("run_ord").rowsBetween(W.unboundedPreceding, -1)
    runs = of("run").select("doc_id", "idx", F.col("ord").alias("run_ord"), "text", run_props(p).alias("run")).withColumn("offset", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))
    styles = of("style").select("doc_id", F.col("text").alias("style_id"), _get(p, "#name").alias("style_name"), _get(p, "#type").alias("type"), _get(p, "#basedOn").alias("based_on"), _get(p, "#next").alias("next"), para_props(p).alias("para"), run_props(p, "r/").alias("run"))
    sides = ("top", "right", "bottom", "left", "header", "footer", "gutter")
    sections = of("section").select(
        "doc_id", F.col("ord").alias("section_idx"), F.coalesce(_get(p, "type@val"), F.lit("nextPage")).alias("type"), U.twips_to_in(_get(p, "pgSz@w")).alias("width_in"), U.twips_to_in(_get(p, "pgSz@h")).alias("height_in"), _get(p, "pgSz@orient").alias("orientation"),
        *[U.twips_to_in(_get(p, f"pgMar@{s}")).alias(f"{s}_in") for s in sides], _get(p, "pgNumType@fmt").alias("num_fmt"), _get(p, "pgNumType@start").try_cast("int").alias("num_start"), F.coalesce(_toggle(p, "titlePg"), F.lit(False)).alias("different_first_page"),
    )
    return {
        "parts": of("part").select("doc_id", F.col("text").alias("part_name"), "ord", _get(p, "size").cast("long").alias("size")),
        "blocks": blocks,
        "runs": runs,
        "styles": styles,
        "sections": sections,
        "fields": of("field").select("doc_id", "ord", "idx", F.col("text").alias("instruction")),
        "bookmarks": of("bookmark").select("doc_id", "idx", F.col("text").alias("name")),
        "rels": of("rel").select("doc_id", F.col("text").alias("rel_id"), _get(p, "type").alias("rel_type"), resolve_target(_get(p, "target")).alias("target")),
        "defaults": of("default").select("doc_id", para_props(p).alias("para"), run_props(p, "r/").alias("run")),
        "refs": of("ref").select("doc_id", F.col("ord").alias("section_idx"), _get(p, "kind").alias("kind"), _get(p, "type").alias("ref_type"), F.col("text").alias("rel_id")),
        "tables": of("table").select("doc_id", F.col("ord").alias("table_idx"), *[_get(p, f"#{k}").cast("int").alias(v) for k, v in (("parent", "parent_idx"), ("parent_row", "parent_row"), ("parent_cell", "parent_cell"))], flag("in_text_box").alias("in_text_box"),
            _get(p, "jc@val").alias("alignment"), F.when(_get(p, "tblW@type") == "dxa", U.twips_to_in(_get(p, "tblW@w"))).alias("pref_in"), F.transform(F.filter(F.split("text", ","), lambda x: x != ""), U.twips_to_in).alias("grid_in")),
        "table_rows": of("row").select("doc_id", F.col("ord").alias("table_idx"), F.col("idx").alias("row_idx"), F.coalesce(_toggle(p, "tblHeader"), F.lit(False)).alias("is_header"), F.coalesce(_toggle(p, "cantSplit"), F.lit(False)).alias("cant_split"), U.twips_to_in(_get(p, "trHeight@val")).alias("min_height_in")),
        "table_cells": of("cell").select("doc_id", F.col("ord").alias("table_idx"), F.col("idx").alias("row_idx"), F.col("text").cast("int").alias("cell_idx"), F.when(_get(p, "tcW@type") == "dxa", U.twips_to_in(_get(p, "tcW@w"))).alias("width_in"), F.coalesce(_get(p, "gridSpan@val").try_cast("int"), F.lit(1)).alias("grid_span"),
            F.when(F.map_contains_key(p, F.lit("vMerge")), F.coalesce(_get(p, "vMerge@val"), F.lit("continue"))).alias("v_merge"), *[F.when(~_get(p, f"edge/{e}@val").isin("nil", "none"), _get(p, f"edge/{e}@sz").try_cast("int")).alias(f"{e}_sz") for e in ("top", "bottom", "left", "right")]),
        "num": of("num").select("doc_id", F.col("ord").alias("num_id"), F.col("text").try_cast("int").alias("abstract_id")),
        "num_levels": of("level").select("doc_id", F.col("ord").alias("abstract_id"), F.col("idx").alias("ilvl"), _get(p, "lvlText@val").alias("pattern"), _get(p, "numFmt@val").alias("format"), _get(p, "start@val").try_cast("int").alias("start"), _get(p, "pStyle@val").alias("p_style"), _get(p, "suff@val").alias("suffix")),
        "marginal_paras": of("mpara").select("doc_id", F.col("text").alias("part_name"), F.col("ord").alias("para_idx"), para_props(p).alias("para"), *[_get(p, f"edge/bottom@{k}").alias(f"border_{n}") for k, n in (("val", "style"), ("sz", "size"), ("space", "space"), ("color", "color"))]),
        "marginal_runs": of("mrun").select("doc_id", F.col("text").alias("part_name"), F.col("ord").alias("para_idx"), F.col("idx").alias("run_ord"), _get(p, "#marker").alias("marker"), _get(p, "#instr").alias("instruction"), _get(p, "#text").alias("text")),
        "marginal_elements": of("melement").select("doc_id", F.col("text").alias("part_name"), _get(p, "#tag").alias("element")),
        "settings": of("setting").select("doc_id", F.coalesce(_toggle(p, "evenAndOddHeaders"), F.lit(False)).alias("even_and_odd"), F.coalesce(_toggle(p, "updateFields"), F.lit(False)).alias("update_fields")),
        "errors": of("error").select("doc_id", F.col("text").alias("problem")),
    }
