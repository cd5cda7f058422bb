"""Readers and writers of document measures, toggles, page boxes and formats (P-1 to P-3, P-8 to P-14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(c: Column) -> Column:
    """A number, or null for what isn't one."""
    return c.try_cast("double")


def twips_to_in(c: Column) -> Column:
    return F.round(num(c) / 1440, 4)


def half_pt_to_pt(c: Column) -> Column:
    return num(c) / 2


def emu_to_in(c: Column) -> Column:
    return F.round(num(c) / 914400, 4)


def line_spacing(line: Column, rule: Column) -> Column:
    """Multiples of a line unless the rule is exact or atLeast; those are twentieths of a point elsewhere."""
    return F.when(~F.coalesce(rule.isin("exact", "atLeast"), F.lit(False)), num(line) / 240)


def line_exact_pt(line: Column, rule: Column) -> Column:
    return F.when(rule.isin("exact", "atLeast"), num(line) / 20)


def in_to_twips(c: Column) -> Column:
    """Inches to twips; a negative measure is an error."""
    return F.when(c < 0, F.raise_error(F.lit("measure must not be negative"))).otherwise(F.bround(c * 1440).cast("long"))


def pt_to_twips(c: Column) -> Column:
    return F.when(c < 0, F.raise_error(F.lit("measure must not be negative"))).otherwise(F.bround(c * 20).cast("long"))


def pt_to_half_pt(c: Column) -> Column:
    return F.when(c <= 0, F.raise_error(F.lit("size must be positive"))).otherwise(F.bround(c * 2).cast("long"))


def cm_to_in(c: Column) -> Column:
    return F.round(c / 2.54, 4)


def mm_to_in(c: Column) -> Column:
    return F.round(c / 25.4, 4)


def toggle(present: Column, value: Column) -> Column:
    """Absent is null, bare is true, 0/false/off is false."""
    return F.when(present, ~F.lower(F.coalesce(value, F.lit("1"))).isin("0", "false", "off"))


def measure_width(kind: Column, raw: Column, container: Column) -> Column:
    """Preferred width in inches: pct as fiftieths of a percent or ``n%`` of the container, dxa as twips."""
    percent = F.when(raw.endswith("%"), num(F.regexp_replace(raw, "%$", "")) / 100).otherwise(num(raw) / 5000)
    return F.when(kind == "pct", container * percent).when(kind == "dxa", num(raw) / 1440)


def content_box(width: Column, height: Column, left: Column, right: Column, top: Column, bottom: Column) -> tuple[Column, Column]:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return width - zero(left) - zero(right), height - zero(top) - zero(bottom)


# Named page sizes in inches.
PAGE_SIZES = {"a3": (11.693, 16.535), "a4": (8.268, 11.693), "a5": (5.827, 8.268), "letter": (8.5, 11.0), "legal": (8.5, 14.0), "tabloid": (11.0, 17.0)}
# Page-number formats of profiles and documents.
NUMBER_FORMATS = {"decimal": "decimal", "lower-roman": "lowerRoman", "upper-roman": "upperRoman", "lower-alpha": "lowerLetter", "upper-alpha": "upperLetter"}


def lookup(c: Column, values: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)


def expected_page_size(size: Column, orientation: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Explicit width or height wins; else the named size, turned for landscape; unknown names give null."""
    named = lambda i: lookup(F.lower(size), {k: v[i] for k, v in PAGE_SIZES.items()})
    wide = orientation.eqNullSafe("landscape")
    explicit = width.isNotNull() | height.isNotNull()
    return F.when(explicit, width).when(wide, named(1)).otherwise(named(0)), F.when(explicit, height).when(wide, named(0)).otherwise(named(1))


def approx(a: Column, b: Column, tolerance: float) -> Column:
    """Equal within a tolerance; null equals only null."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= tolerance)


def first_line_in(inches: Column, chars: Column, size_pt: Column) -> Column:
    return F.coalesce(inches, F.when(size_pt != 0, F.round(chars * size_pt * 20 / 1440, 4)))


# Field kinds that a rule may insert.
FIELD_KINDS = ("TOC", "PAGE", "NUMPAGES", "SECTIONPAGES", "SEQ", "REF", "PAGEREF", "STYLEREF", "CITATION", "BIBLIOGRAPHY", "NOTEREF", "HYPERLINK")


def field_kind(instruction: Column) -> Column:
    """Leading letters in upper case; null if there are none."""
    return F.nullif(F.upper(F.regexp_extract(instruction, r"^\s*([A-Za-z]+)", 1)), F.lit(""))
