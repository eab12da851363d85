import base64
import hashlib
import io
import zipfile

from brindle.llm import warc


def test_zip_round_trip():
    out = io.BytesIO()
    writer = warc.ZipWriter(out)
    for name, data in (("a/b", b"x" * 1000), ("c", b"")):
        writer.begin(name)
        writer.write(data)
        writer.end()
    writer.close()
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:
        assert z.testzip() is None
        assert z.read("a/b") == b"x" * 1000
    assert warc.ZipReader(io.BytesIO(out.getvalue())).read("a/b") == b"x" * 1000


def test_reads_foreign_zip():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK a comment"
        with z.open("big", "w", force_zip64=True) as m:
            m.write(b"hello")
        z.writestr("small", b"you")
    reader = warc.ZipReader(io.BytesIO(out.getvalue()))
    assert (reader.read("big"), reader.read("small")) == (b"hello", b"you")


def test_odd_rows(spark, tmp_path):
    html = "<p>é</p>\r\n\r\n" * 2000
    data = [(3, "u", html, 0), (1, "u\r\nX: y", html, 0), (1, None, html, 0), (None, "u", html, 0), (5, "u", None, 0), (6, "u", "", 0), (7, "u", "solo", 0)]
    df = spark.createDataFrame(data, "page_id long, url string, html string, digest int")
    found = warc.read(warc.write(warc.with_revisits(df, f"file://{tmp_path}/r"), f"file://{tmp_path}/p")).collect()
    digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in found), key=str) == sorted([(3, "revisit", 1), (1, "response", None), (1, "response", None), (None, "revisit", 1), (5, "response", None), (6, "revisit", 5), (7, "response", None)], key=str)
    assert {r.payload_digest for r in found if r.payload_bytes > 9} == {digest}
    assert {r.payload for r in found if r.page_id == 1} == {html}
    empty = df.limit(0)
    assert warc.read(warc.write(warc.with_revisits(empty, f"file://{tmp_path}/s"), f"file://{tmp_path}/q")).count() == 0
