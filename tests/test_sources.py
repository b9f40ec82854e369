"""Files, grade files and report sinks."""

import json
import zipfile

from docloom.operators import scoring
from docloom.sources import grades, reports, word_files

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _p(text, style=None):
    return f"<w:p>{f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"


def _cell(text, props=""):
    return f"<w:tc><w:tcPr>{props}</w:tcPr>{_p(text)}</w:tc>"


def _docx(path, body):
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("B", "List Bullet"), ("N", "List Number"), ("D", "Daftar Poin")))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {_NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {_NS}>{styles}</w:styles>")


def test_files(spark, tmp_path):
    table = f"<w:tbl><w:tr>{_cell('a')}{_cell('')}{_cell('b')}</w:tr><w:tr>{_cell('')}</w:tr><w:tr>{_cell('wide', '<w:gridSpan w:val="2"/>')}</w:tr></w:tbl>"
    tall = f"<w:tbl><w:tr>{_cell('x', '<w:vMerge w:val="restart"/>')}{_cell('y')}</w:tr><w:tr>{_cell('', '<w:vMerge/>')}{_cell('z')}</w:tr></w:tbl>"
    _docx(tmp_path / "a.DOCX", _p("Skills") + _p("  ") + _p("one", "B") + _p("two", "N") + _p("tiga", "D") + table + tall)
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "c.pdf").write_bytes(b"pdf text")
    (tmp_path / "d.rtf").write_bytes(b"x")
    (tmp_path / "e.pdf").write_bytes(b"")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in word_files.read_files(spark, str(tmp_path), pdf_text=lambda b: b.decode()).collect()}
    assert rows["a.DOCX"]["text"].split("\n") == ["Skills", "• one", "two", "• tiga", "a | b", "wide | wide", "x | y", "x | z"]
    assert rows["bad.docx"]["text"] is None and "BadZipFile" in rows["bad.docx"]["error"]
    assert rows["c.pdf"]["text"] == "pdf text" and "e.pdf" not in rows  # no bytes, no row
    assert "unsupported" in rows["d.rtf"]["error"]
    plain = word_files.read_files(spark, str(tmp_path)).filter("suffix = '.pdf'").collect()
    assert all("no decoder" in r["error"] for r in plain)


def test_grades(spark, tmp_path):
    body = {"a": {"human_overall": 8, "human_sections": {"Skills": 7, "Contact": 9.5}, "human_role": "data"}, "b.pdf": {"human_overall": 3.5, "notes": "n"}, "gone": {"human_overall": 1}, "_comment": "text", "list": [1]}
    (tmp_path / "grades.json").write_text(json.dumps(body, indent=1))
    read = grades.read_grades(spark, str(tmp_path / "grades.json"))
    assert {r["filename"] for r in read.collect()} == {"a", "b.pdf", "gone"}
    files = spark.createDataFrame([("a.docx",), ("a.txt",), ("b.pdf",), ("b.pdf",)], "file string")
    got = {r["filename"]: r for r in grades.resolve(read, files).collect()}
    assert {k: r["file"] for k, r in got.items()} == {"a": "a.docx", "b.pdf": "b.pdf"}
    assert got["b.pdf"]["human_role"] == "general" and got["b.pdf"]["notes"] == "n" and got["a"]["human_overall"] == 8.0
    auto = spark.createDataFrame([("a.docx", "Skills", 6.0), ("a.docx", "Summary", 1.0), ("b.pdf", "Skills", 2.0)], "file string, section string, auto double")
    assert [tuple(r) for r in grades.beside(grades.resolve(read, files), auto).collect()] == [("a.docx", "Skills", 7.0, 6.0)]
    assert grades.resolve(read, files.limit(0)).count() == 0


def test_deltas(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"section":"Skills","human_score":7,"auto_score":3}\n{"human":4,"auto":6}\ngarbage\n\n[1]\n{"section":"Skills"\n')
    assert sorted(map(tuple, grades.read_deltas(spark, str(tmp_path / "log.jsonl")).collect())) == [("Skills", 4.0), ("Unknown", -2.0)]


def test_reports(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Ann\na@x.com\nSkills\nPython, Go\n"), (2, None), (3, "")], "doc_id long, text string")
    scored = scoring.score_documents(docs).selectExpr("*", "array('email') as evidence_contact", "if(doc_id = 1, 'Add a phone.', null) as feedback_contact")
    reports.write(scored, str(tmp_path / "out"))
    found = {r["file"]: r for r in (json.loads(x["value"]) for x in spark.read.text(str(tmp_path / "out")).collect())}
    assert set(found) == {"1", "2", "3"}
    contact = found["1"]["sections"]["Contact"]
    assert contact["score"] == 3.0 and contact["evidence"] == ["email"] and contact["issues"] == [] and contact["feedback"] == "Add a phone."
    assert found["2"]["sections"]["Contact"]["feedback"] == "" and set(found["1"]["sections"]) == {"Contact", "Summary", "Experience", "Skills", "Education", "Projects", "Length_Formatting"}
