import io
import json
import zipfile

import pytest

from veilspark.operators.policy import policy
from veilspark.operators.verify import MaskingError
from veilspark.sources.files import file_units
from veilspark.sources.office import Leaf, Package, office_rewritten, office_units, put_marks, repointed
from veilspark.sources.publish import mask_files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:w14="urn:w14" xmlns:mc="urn:mc" mc:Ignorable="w14"'
X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
CORE = '<cp:coreProperties xmlns:cp="urn:cp" xmlns:dc="urn:dc"><dc:creator>ab.c@example.net</dc:creator><cp:revision>3</cp:revision></cp:coreProperties>'


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(body, **more):
    return packed({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "docProps/core.xml": CORE, **more})


def rels(*items):
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{REL}/{kind}" Target="{target}"/>' for i, kind, target in items) + "</Relationships>"


def xlsx():
    sheet = f"""<worksheet {X}><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>fee</t></is></c></row>
<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>1234.5</v></c><c r="C2" t="str"><f>IF(A2="ab.c@example.net","dup","")</f><v>ab.c@example.net</v></c></row>
<row r="3"><c r="A3" t="s"><v>2</v></c><c r="C3"><f>'call 202-555-0147'!B2+B2</f><v>2</v></c></row></sheetData>
<hyperlinks><hyperlink ref="A2" r:id="h1" display="write"/></hyperlinks>
<headerFooter><oddHeader>&amp;L&amp;"Arial,Bold"&amp;12to ab.c@example.net&amp;RPage &amp;P</oddHeader></headerFooter></worksheet>"""
    return packed({
        "xl/workbook.xml": f'<workbook {X}><sheets><sheet name="call 202-555-0147" sheetId="1" r:id="r1"/></sheets><definedNames><definedName name="n">\'call 202-555-0147\'!$A$1</definedName></definedNames></workbook>',
        "xl/_rels/workbook.xml.rels": rels(("r1", "worksheet", "worksheets/sheet1.xml"), ("r2", "sharedStrings", "sharedStrings.xml")),
        "xl/sharedStrings.xml": f"<sst {X}><si><t>customer id</t></si><si><r><t>CUS-4827</t></r><r><t>-9136</t></r></si><si><t>plain</t></si></sst>",
        "xl/worksheets/sheet1.xml": sheet,
        "xl/worksheets/_rels/sheet1.xml.rels": rels(("h1", "hyperlink", "mailto:ab.c@example.net"), ("c1", "comments", "../comments1.xml")),
        "xl/comments1.xml": f'<comments {X}><commentList><comment ref="A2"><text><r><t>see CUS-77</t></r><r><t>12</t></r></text></comment></commentList></comments>',
        "docProps/core.xml": CORE,
    })


def test_tags_go_where_values_start():
    def run(parts, marks):
        out = [t for t, _ in parts]
        leaves = [Leaf(t, (lambda new, k=k: out.__setitem__(k, new)) if editable else None) for k, (t, editable) in enumerate(parts)]
        put_marks(leaves, marks)
        return out

    assert run([("to ", True), ("Mi", True), ("ra Cal", True), ("der", True), (" now", True)], [(3, 14, "<N>")]) == ["to ", "<N>", "", "", " now"]
    assert run([("a", True), ("\t", False), ("bc", True)], [(1, 3, "<N>")]) == ["a", "\t", "<N>c"]
    assert run([("a", True), ("\t", False)], [(1, 2, "<N>")]) == ["a<N>", "\t"]
    assert run([("abcd", True)], [(0, 1, "<A>"), (2, 3, "<B>")]) == ["<A>b<B>d"]
    assert run([], [(0, 1, "<A>")]) == []


def test_word_paragraphs_and_properties():
    body = '<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p><w:tbl><w:p><w:r><w:t>in</w:t></w:r></w:p></w:tbl>'
    content = docx(body, **{"word/footnotes.xml": f"<w:footnotes {W}><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnotes>"})
    assert [(u[1], u[5]) for u in office_units(".docx", "x", content)] == [("word/document.xml", "a\tb\nclink"), ("word/document.xml", "in"), ("word/footnotes.xml", "note"), ("property", "ab.c@example.net")]
    out = office_rewritten(".docx", content, {0: [(0, 1, " <N>")]})
    part = zipfile.ZipFile(io.BytesIO(out)).read("word/document.xml").decode()
    assert '<w:t xml:space="preserve"> &lt;N&gt;</w:t>' in part and 'xmlns:w14="urn:w14"' in part and "mc:Ignorable" in part
    assert zipfile.ZipFile(io.BytesIO(out)).read("word/footnotes.xml") == zipfile.ZipFile(io.BytesIO(content)).read("word/footnotes.xml")
    assert office_rewritten(".docx", content, {}) == content


def test_excel_places():
    got = {(u[1].split(":")[-1], u[2], u[3], u[4], u[5]) for u in office_units(".xlsx", "x", xlsx())}
    assert ("cell", 1, 0, "customer id", "CUS-4827-9136") in got and ("cell", 0, 0, "", "customer id") in got
    assert ("formula", 1, 2, "", "ab.c@example.net") in got and ("comment", 1, 0, "customer id", "see CUS-7712") in got
    assert ("link", 1, 0, "customer id", "mailto:ab.c@example.net") in got and ("link", 1, 0, "customer id", "write") in got
    assert ("print", 0, 1, "", "to ab.c@example.net") in got and ("print", 0, 2, "", "Page ") in got and ("title", 0, 0, "", "call 202-555-0147") in got
    assert not any("1234.5" in x[4] for x in got)


def test_references_follow_titles():
    assert repointed("'a b'!A1+ab!A1&\"ab!\"", {"a b": "<N#0>", "ab": "x"}) == "'<N#0>'!A1+'x'!A1&\"ab!\""


def test_masked_files(spark, tmp_path):
    for name in ("in", "docx"):
        (tmp_path / name).mkdir()
    (tmp_path / "in" / "plan.xlsx").write_bytes(xlsx())
    reports = mask_files(spark, str(tmp_path / "in"), ".xlsx", str(tmp_path / "out"))
    out = (tmp_path / "out" / "plan.xlsx").read_bytes()
    everything = "".join(zipfile.ZipFile(io.BytesIO(out)).read(n).decode() for n in Package(out).names)
    assert not any(v in everything for v in ("ab.c@example.net", "CUS-4827", "202-555-0147", "CUS-77")) and "plain" in everything and "1234.5" in everything
    assert "'call &lt;PHONE#0&gt;'!B2+B2" in everything and "'call &lt;PHONE#0&gt;'!$A$1" in everything and "mailto:&lt;EMAIL#0&gt;" in everything
    data = json.loads(reports.first()["report"])
    assert data["verified"] and data["leaked_count"] == 0 and data["source"] == "<input>.xlsx" and {f["value"] for f in data["findings"]} == {""}

    (tmp_path / "docx" / "to_202-555-0147x.docx").write_bytes(docx("<w:p><w:r><w:t>mail ab.c@exa</w:t></w:r><w:r><w:t>mple.net now</w:t></w:r></w:p>"))
    with pytest.raises(MaskingError):
        mask_files(spark, str(tmp_path / "docx"), ".docx", str(tmp_path / "none"), policy(entities=("PERSON",)))
    assert not (tmp_path / "none").exists()
    mask_files(spark, str(tmp_path / "docx"), ".docx", str(tmp_path / "out"))
    back = file_units(spark, str(tmp_path / "out" / "to_202-555-0147x.docx"), ".docx")
    assert [r["text"] for r in back.orderBy("place").collect()] == ["mail <EMAIL#0> now", "<EMAIL#0>"]


def test_masked_csv_and_names(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "CALDER, MIRA.csv").write_text('customer id,note\nCUS-4827-9136,"a, ab.c@example.net"\n')
    mask_files(spark, str(tmp_path / "in"), ".csv", str(tmp_path / "out"))
    assert [(p.name, p.read_bytes()) for p in (tmp_path / "out").iterdir()] == [("<NAME#0>,_<NAME#1>.csv", b'customer id,note\r\n<ID#0>,"a, <EMAIL#0>"\r\n')]
