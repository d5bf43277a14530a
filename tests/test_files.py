"""Readers of files, on files made here."""

import io
import zipfile

from ledgerloom.sources import files as S

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(*paragraphs: str, part: str = "word/document.xml") -> bytes:
    body = "".join(f"<w:p>{''.join(f'<w:r><w:t>{t}</w:t></w:r>' for t in p.split('|'))}</w:p>" for p in paragraphs)
    with zipfile.ZipFile(out := io.BytesIO(), "w") as z:
        z.writestr(part, f"<w:document {NS}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


MHTML = b"""Subject: A page
Date: Tue, 02 Jan 2024 10:00:00 +0000
Content-Location: https://www.example.org/a
Content-Type: multipart/related; boundary="x"

--x
Content-Type: text/html

<p>one</p><script>no</script><p>two &amp; three</p>
--x
Content-Type: image/png
Content-Transfer-Encoding: base64
Content-Location: https://www.example.org/a.png

AAEC
--x--
"""


def test_parse_by_kind(spark):
    rows = [
        ("a.DOCX", docx("Hello |world", " ", "next")),
        ("bad.docx", docx("x", part="word/other.xml")),
        ("broken.docx", b"no archive"),
        ("b.mht", MHTML),
        ("plain.mhtml", b"<p>bare</p>"),
        ("c.htm", b"<div>x</div>y"),
        ("empty.html", b""),
        ("d.xyz", b"?"),
        ("none", b"?"),
        ("null.html", None),
    ]
    df = spark.createDataFrame([(n, c, 1) for n, c in rows], "filename string, content binary, text int")
    got = {r["filename"]: r for r in S.parse(df).collect()}
    assert {n: got[n]["text"] for n, _ in rows} == {
        "a.DOCX": "Hello world\nnext", "bad.docx": None, "broken.docx": None, "b.mht": "one\ntwo & three", "plain.mhtml": "bare",
        "c.htm": "x\ny", "empty.html": "", "d.xyz": None, "none": None, "null.html": None,
    }
    assert got["bad.docx"]["error"] == "ValueError: Invalid DOCX: no word/document.xml found"
    assert got["broken.docx"]["error"].startswith("BadZipFile")
    assert got["d.xyz"]["error"] == got["none"]["error"] == "Unsupported file type"
    assert got["null.html"]["error"] == "No content"
    page = got["b.mht"]
    assert page["meta"] == {"title": "A page", "source": "https://www.example.org/a", "saved": "2024-01-02", "site_name": "example.org"}
    assert [tuple(x) for x in page["images"]] == [(0, "https://www.example.org/a.png", "image/png", bytearray(b"\0\1\2"))]
    assert S.parse(df.limit(0)).count() == 0


def test_unparsable_date_stays(spark):
    assert S.archive(b"Date: soon\n\n<p>x</p>")[1] == {"saved": "soon"}


def test_read_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.DocX").write_bytes(docx("deep"))
    (tmp_path / "y.html").write_text("<p>flat</p>")
    files = S.read_files(spark, str(tmp_path))
    assert {(r["filename"], r["ext"]) for r in files.select("filename", "ext").collect()} == {("x.DocX", "docx"), ("y.html", "html")}
    assert {r["text"] for r in S.parse(files).collect()} == {"deep", "flat"}
