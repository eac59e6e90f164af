"""Packages: parsing, writing back, checking."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lakesieve.sources import docx

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
BODY = f"""<?xml version="1.0" encoding="UTF-8"?><w:document {W}><w:body>
<w:p><w:r><w:t>E-mail: priya.</w:t></w:r><w:r><w:t>sharma@orchid.example.org now</w:t></w:r></w:p>
<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>Name</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>DIN</w:t></w:r></w:p></w:tc></w:tr>
<w:tr><w:tc><w:p><w:r><w:t>Asha Rao</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>01234567</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
</w:body></w:document>"""


def package(body=BODY):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"/>')
        z.writestr("word/document.xml", body)
    return out.getvalue()


def test_paragraphs_cells_and_breaks():
    p = docx.Package(package())
    rows = list(p.paragraphs())
    assert [x.text for _, x in rows] == ["E-mail: priya.sharma@orchid.example.org now", "a\tb", "Name", "DIN", "Asha Rao", "01234567"]
    assert rows[5][1].cell == (0, 1, 1)
    assert rows[5][1].headers == ["Name", "DIN"]


def test_replacement_goes_over_runs_and_marks():
    p = docx.Package(package())
    p.replace({"word/document.xml:p000000": [(8, 39, "x@example.com")]})
    p.mark()
    again = docx.Package(p.content())
    assert next(x.text for _, x in again.paragraphs()) == "E-mail: x@example.com now"
    assert again.done
    assert not docx.Package(package()).done


def test_breaks_are_not_written_over():
    with pytest.raises(ValueError, match="crosses"):
        docx.Package(package()).replace({"word/document.xml:p000001": [(0, 3, "x")]})


def test_checks():
    assert docx.check("a.docx", package()) is None
    assert docx.check("a.txt", package()) == "extension"
    assert docx.check("a.docx", b"") == "empty"
    assert docx.check("a.docx", b"no zip") == "not_a_package"


def test_source_and_sink(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(package())
    (tmp_path / "b.docx").write_bytes(b"broken")
    files = docx.packages(spark, str(tmp_path))
    assert {r.path[-6:]: r.error for r in files.collect()} == {"a.docx": None, "b.docx": "not_a_package"}
    records = docx.records(files)
    assert records.count() == 6
    assert records.where("column_header = 'DIN'").count() == 2
    assert docx.cells(files).count() == 4
    found = records.where("ord = 0").select("doc_id", "record_id", F.lit(8).alias("start"), F.lit(39).alias("end"), F.lit("x@example.com").alias("replacement"))
    new = docx.rewrite(files.where("error IS NULL"), found).first()
    assert docx.Package(bytes(new.content)).done
