"""The corpus scan on small packages that the test writes."""

import zipfile

from quire.operators import job, packages, structure
from quire.sources import docx

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:wps="http://schemas.microsoft.com/office/word/2010/wordprocessingShape" xmlns:new="urn:new"'
DOCUMENT = f"""<w:document {W}><w:body>
<w:p><w:pPr><w:pStyle w:val="Heading1"/><w:keepNext/><w:spacing w:line="360" w:before="120"/><w:ind w:firstLine="480"/></w:pPr><w:r><w:rPr><w:rFonts w:hAnsi="Arial" w:eastAsia="黑体"/><w:sz w:val="32"/><w:b w:val="0"/></w:rPr><w:t>1 绪</w:t></w:r><w:r><w:t>论</w:t></w:r><w:bookmarkStart w:id="0" w:name="here"/></w:p>
<w:p><w:r><mc:AlternateContent><mc:Choice Requires="new"><w:t>no</w:t></mc:Choice><mc:Choice Requires="wps"><w:txbxContent><w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbxContent></mc:Choice><mc:Fallback><w:t>no</w:t></mc:Fallback></mc:AlternateContent></w:r></w:p>
<w:p><w:pPr><w:sectPr><w:pgSz w:w="11906" w:h="16838"/><w:pgNumType w:fmt="upperRoman" w:start="1"/></w:sectPr></w:pPr><w:r><w:instrText> PAGE  x</w:instrText></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
<w:sectPr><w:pgSz w:w="16838" w:h="11906" w:orient="landscape"/><w:pgMar w:left="1440"/><w:titlePg/></w:sectPr></w:body></w:document>"""
STYLES = f'<w:styles {W}><w:style w:type="paragraph" w:styleId="Heading1"><w:name w:val="heading 1"/><w:basedOn w:val="Normal"/><w:pPr><w:outlineLvl w:val="0"/></w:pPr><w:rPr><w:b/></w:rPr></w:style></w:styles>'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="t" Target="media/../header1.xml"/></Relationships>'


def corpus(spark, folder):
    with zipfile.ZipFile(folder / "a.docx", "w") as z:
        for name, text in (("[Content_Types].xml", "<x/>"), ("_rels/.rels", "<x/>"), ("word/document.xml", DOCUMENT), ("word/styles.xml", STYLES), ("word/_rels/document.xml.rels", RELS)):
            z.writestr(name, text)
    (folder / "b.docx").write_bytes(b"not a package")
    with zipfile.ZipFile(folder / "c.docx", "w") as z:
        z.writestr("word/document.xml", "<broken")
    return docx.tables(docx.scan_corpus(spark, f"{folder}/*.docx"))


def test_scan(spark, tmp_path):
    t = corpus(spark, tmp_path)
    blocks = t["blocks"].orderBy("idx").collect()
    assert [(b.idx, b.text, b.in_table, b.in_text_box, b.section_break) for b in blocks] == [(0, "1 绪论", False, False, False), (1, "", False, False, False), (2, "box", False, True, False), (3, "", False, False, True), (4, "cell", True, False, False)]
    p = blocks[0].para
    assert (blocks[0].style_id, p.line_spacing, p.space_before_pt, p.first_line_in, p.keep_next, p.keep_lines) == ("Heading1", 1.5, 6.0, 0.3333, True, None)
    first = t["runs"].where("idx = 0").orderBy("run_ord").collect()
    assert [(r.text, r.offset) for r in first] == [("1 绪", 0), ("论", 3)]
    r = first[0].run
    assert (r.latin, r.east_asia, r.size_pt, r.bold, r.italic) == ("Arial", "黑体", 16.0, False, None)
    s = t["sections"].orderBy("section_idx").collect()
    assert [(x.width_in, x.orientation, x.num_fmt, x.num_start, x.left_in, x.different_first_page) for x in s] == [(8.2681, None, "upperRoman", 1, None, False), (11.6931, "landscape", None, None, 1.0, True)]
    style = t["styles"].first()
    assert (style.style_id, style.style_name, style.based_on, style.para.outline_level, style.run.bold) == ("Heading1", "heading 1", "Normal", 0, True)
    assert [x.instruction for x in t["fields"].collect()] == ["PAGE x"] and [x.name for x in t["bookmarks"].collect()] == ["here"]
    assert t["rels"].first().target == "word/header1.xml"
    assert t["errors"].count() == 2
    missing = packages.check_packages(t["parts"].select("doc_id").distinct(), t["parts"])
    assert missing.count() == 2  # the third package has its document only
    kinds = structure.classify(structure.enrich(t["blocks"], t["styles"].selectExpr("doc_id", "style_id", "style_name", "para.outline_level", "para.keep_next")))
    assert [r.kind for r in kinds.orderBy("idx").collect()] == ["chapter", "empty", "body", "empty", "table_cell"]


def test_runs_are_written_once_unless_forced(spark, tmp_path):
    import pytest

    rows = {"x": spark.range(3)}
    job.write_run(rows, str(tmp_path / "run"))
    with pytest.raises(Exception, match="EXIST"):
        job.write_run(rows, str(tmp_path / "run"))
    job.write_run(rows, str(tmp_path / "run"), force=True)
    assert spark.read.parquet(str(tmp_path / "run")).count() == 3


def test_specs_are_read_whole(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>纸型 A4</p><script>x</script>1 &lt; 2")
    assert job.read_specs(spark, str(tmp_path / "*.html"), html=True).first().text.split() == ["纸型", "A4", "1", "<", "2"]
