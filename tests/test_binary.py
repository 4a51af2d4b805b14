"""Archives, images, PDF: bytes made by hand, and what is wrong with them."""

import gzip
import io
import struct
import tarfile
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.functions import images, pdf
from weftline.sources import archive as a

NAMES = st.lists(st.text("abc/.é", min_size=1, max_size=8), min_size=1, max_size=5, unique=True)


@settings(max_examples=60, deadline=None)
@given(NAMES, st.data(), st.sampled_from(["zip", "tar", "tar.gz"]))
def test_round_trips(names, data, kind):
    entries = [a.Entry(n, data.draw(st.binary(max_size=600)), 1_500_000_000_000 + 2000 * i) for i, n in enumerate(names)]
    raw = a.create(kind, entries)
    assert raw == a.create(kind, entries)
    assert a.extract(kind, raw) == (entries, [])


def test_other_libraries_read_them():
    entries = [a.Entry("x.txt", b"hello", 1_500_000_000_000)]
    assert zipfile.ZipFile(io.BytesIO(a.zip_create(entries))).read("x.txt") == b"hello"
    t = tarfile.open(fileobj=io.BytesIO(a.tar_create(entries)))
    assert t.extractfile("x.txt").read() == b"hello" and t.getmember("x.txt").mtime == 1_500_000_000
    assert gzip.decompress(a.gzip_create(b"hello", 5000, "n")) == b"hello"
    e = a.gzip_extract(a.gzip_create(b"hello", 5000, "n"))
    assert (e.name, e.data, e.mtime) == ("n", b"hello", 5000) and a.gzip_extract(gzip.compress(b"q", mtime=0)).mtime is None


@pytest.mark.parametrize("fmt", [tarfile.GNU_FORMAT, tarfile.PAX_FORMAT, tarfile.USTAR_FORMAT])
def test_tar_dialects(fmt):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=fmt) as t:
        for name in ("short", "d/" * 30 + "long-" + "n" * 80):
            info = tarfile.TarInfo(name)
            info.size, info.mtime = 3, 1_400_000_000
            t.addfile(info, io.BytesIO(b"abc"))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "short"
        t.addfile(link)
    entries, skipped = a.tar_extract(out.getvalue())
    assert [(e.name, e.data, e.mtime) for e in entries] == [("short", b"abc", 1_400_000_000_000), ("d/" * 30 + "long-" + "n" * 80, b"abc", 1_400_000_000_000)]
    assert skipped == [("link", "2")]


def test_tar_numbers():
    assert [a.tar_number(x) for x in (b"0000644\0", b"\x80" + b"\0" * 10 + b"\x05", b"\xff" * 12, b" 17 \0", b"\0")] == [0o644, 5, -1, 15, 0]


def test_limits_and_damage(monkeypatch):
    monkeypatch.setattr(a, "MAX_BYTES", 1000)
    bomb = zipfile.ZipFile(raw := io.BytesIO(), "w", zipfile.ZIP_DEFLATED)
    bomb.writestr("x", b"0" * 5000)
    bomb.close()
    many = a.tar_create([a.Entry(f"{i}", b"") for i in range(5)])
    monkeypatch.setattr(a, "MAX_ENTRIES", 4)
    good = a.tar_create([a.Entry("x", b"abc")])
    for kind, data in (("zip", raw.getvalue()), ("gzip", gzip.compress(b"0" * 5000)), ("tar", many), ("zip", b"PK"), ("gzip", a.gzip_create(b"abc")[:-9]), ("tar", b"y" + good[1:]), ("tar", good[:513]), ("rar", b"")):
        with pytest.raises(a.ArchiveError):
            a.extract(kind, data)
    for entries in ([], [a.Entry("", b"")], [a.Entry("x", b""), a.Entry("x", b"")], [a.Entry("__proto__", b"")], [a.Entry("x", b"0" * 1001)]):
        with pytest.raises(a.ArchiveError):
            a.zip_create(entries)
    for bad in (lambda: a.tar_create([a.Entry("n" * 101, b"")]), lambda: a.tar_create([a.Entry("n", b"", -1)]), lambda: a.gzip_create(b"", -1), lambda: a.zip_create([a.Entry("x", b"", 0)]), lambda: a.create("gzip", [a.Entry("x", b"")] * 2)):
        with pytest.raises(a.ArchiveError):
            bad()


def test_paths():
    assert a.safe_path("/r", "a/./b") == "/r/a/b"
    for bad in ("", "/a", "../a", "a/../../b", "C:\\x", "..\\x", "\\a"):
        with pytest.raises(a.ArchiveError):
            a.safe_path("/r", bad)


def test_entry_text():
    assert a.Entry("x", b"a\tb").text == ("a\tb", False) and a.Entry("x", b"\xff").text == (None, False) and a.Entry("x", b"\x07").text == (None, False)
    assert a.Entry("x", b"a" * (a.MAX_TEXT + 1)).text[1]


def test_bad_archives_are_rows(spark):
    rows = spark.createDataFrame([(1, bytearray(b"no zip"))], "k int, archive binary")
    r = a.unpack(rows, "zip", keep=("k",)).first()
    assert r.k == 1 and r.error and r.name is None


# ---------- images ----------


def exif(orientation, order="<"):
    return struct.pack(order + "2sHIHHHIHHI", b"II" if order == "<" else b"MM", 42, 8, 1, 0x112, 3, 1, orientation, 0, 0)


def segment(marker, payload):
    return b"\xff" + bytes([marker]) + struct.pack(">H", len(payload) + 2) + payload


def png(*extra):
    return images.PNG + images.png_chunk(b"IHDR", b"\0" * 13) + b"".join(images.png_chunk(k, d) for k, d in extra) + images.png_chunk(b"IDAT", b"x") + images.png_chunk(b"IEND", b"")


def test_png():
    assert images.strip_png(png((b"tEXt", b"a\0b"), (b"tIME", b"1234567"), (b"gAMA", b"1234")) + b"trailing") == png((b"gAMA", b"1234"))
    assert images.strip_png(png((b"eXIf", exif(6, ">")))) == png((b"eXIf", images.tiff_with(6)))
    assert images.strip_png(png((b"eXIf", exif(1)))) == png()
    for bad in (b"x" * 20, png()[:-5], png()[:-12]):
        with pytest.raises(ValueError):
            images.strip_png(bad)


def test_jpeg():
    scan = segment(0xDA, b"\1\1\0\0\x3f\0") + b"data\xff\x00more\xff\xd0x"
    head, end = b"\xff\xd8" + segment(0xE0, b"JFIF\0"), b"\xff\xd9"
    icc = lambda i, n: segment(0xE2, images.ICC + bytes([i, n]) + b"p")
    strip = images.strip_jpeg
    assert strip(head + segment(0xE1, b"Exif\0\0" + exif(1)) + segment(0xFE, b"note") + segment(0xED, b"x") + scan + end) == head + scan + end
    assert strip(head + segment(0xE1, b"Exif\0\0" + exif(6)) + scan + end) == head + segment(0xE1, b"Exif\0\0" + images.tiff_with(6)) + scan + end
    assert strip(head + icc(1, 2) + icc(2, 2) + scan + end) == head + icc(1, 2) + icc(2, 2) + scan + end
    assert strip(head + icc(1, 3) + icc(2, 3) + scan + end) == head + scan + end and strip(head + icc(9, 9) + scan + end) == head + icc(9, 9) + scan + end
    assert strip(head + scan + segment(0xFE, b"late") + scan + end + b"rest") == head + scan + scan + end
    for bad in (b"\xff\xd8\xff\xe1\xff\xff", head, head[:-1], b"GIF"):
        with pytest.raises(ValueError):
            strip(bad)
    with pytest.raises(ValueError):
        images.sanitize(b"GIF89a")


def test_kinds(spark):
    rows = spark.createDataFrame([(bytearray(b"\xff\xd8\xff\xe0"),), (bytearray(png()),), (bytearray(b"x"),)], "c binary")
    out = rows.select(images.kind_column(rows.c).alias("k"), images.scrubbed(rows.c).alias("s")).collect()
    assert [r.k for r in out] == ["jpeg", "png", None] and out[2].s.error and out[1].s.stripped_bytes == 0


# ---------- PDF ----------


def simple(pages=2, extra=b""):
    kids = b" ".join(b"%d 0 R" % (10 + i) for i in range(pages))
    body = b"".join(b"%d 0 obj\n<</Type/Page/Parent 2 0 R>>\nendobj\n" % (10 + i) for i in range(pages))
    return b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R/Metadata 5 0 R>>endobj\n2 0 obj\n<</Type/Pages/Kids[" + kids + b"]/Count 1>>\nendobj\n5 0 obj<</Length 4>>stream\nxmp!\nendstream endobj\n6 0 obj<</Author(Me \\) (x))>>endobj\n" + body + extra + b"trailer<</Root 1 0 R/Info 6 0 R>>\n%%EOF"


def test_pdf():
    data = simple(3)
    assert pdf.page_count(data) == 3
    out, _ = pdf.shrink(data)
    assert b"xmp!" not in out and b"Author" not in out and pdf.page_count(out) == 3 and pdf.page_count(pdf.shrink(out)[0]) == 3
    assert b"Author" not in zlib.decompress(out[out.index(b"stream\n") + 7 :].split(b"\nendstream")[0])
    big = simple(1, b"9 0 obj<</Length 8 0 R>>stream\n" + b"q" * 5000 + b"\nendstream endobj\n8 0 obj 5000 endobj\n").replace(b"/Parent 2 0 R", b"/Parent 2 0 R/Contents 9 0 R")
    small, saved = pdf.shrink(big)
    assert saved > 50 and pdf.page_count(small) == 1
    loop = data.replace(b"/Kids[10 0 R", b"/Kids[2 0 R 10 0 R")
    assert pdf.page_count(loop) == 3


def test_pdf_errors(monkeypatch):
    for bad in (b"", b"hello", b"%PDF-1.4\n", simple().replace(b"/Info 6 0 R", b"/Encrypt 6 0 R")):
        with pytest.raises(ValueError):
            pdf.page_count(bad)
    monkeypatch.setattr(pdf, "MAX_OBJECTS", 4)
    with pytest.raises(ValueError):
        pdf.page_count(simple(9))
