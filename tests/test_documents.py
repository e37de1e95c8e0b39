"""Readers of office formats on files made here, whole and damaged."""

import io
import random
import struct
import zipfile
import zlib

import pytest

from docketry.sources import documents as D
from docketry.sources import pdf, word97

TEXT = "Рішення суду №1/23\n\n  два  blanks\tand a tab & <marks> ü\n\U0001f600 end"


def test_docx_parts():
    text = TEXT + "\x0b\x01 _x0041_ literal"
    assert "\n".join(D.docx_paragraphs(D.docx_bytes(text))) == text
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'
    body = (
        '<w:p><w:pPr><w:tabs><w:tab w:val="left"/></w:tabs></w:pPr><w:r><w:t>one</w:t><w:br/><w:t>two</w:t></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p>'
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:instrText>PAGE</w:instrText></w:r></w:p>"
        "<w:p><w:r><mc:AlternateContent><mc:Choice><w:t>new</w:t></mc:Choice><mc:Fallback><w:t>old</w:t></mc:Fallback></mc:AlternateContent></w:r></w:p>"
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    assert list(D.docx_paragraphs(out.getvalue())) == ["one\ntwo", "cell", "", "new"]


def squeezed(text):
    return "\n".join(line for line in text.split("\n") if line)


def test_pdf_round_trip_and_damaged_table():
    text = "\n".join(f"line {i} {TEXT}" for i in range(60))
    content = pdf.pdf_bytes(text)
    assert "\n".join(pdf.pages(content)) == squeezed(text) and len(list(pdf.pages(content))) > 4
    broken = content.replace(b"startxref\n", b"startxref\n9")
    assert list(pdf.pages(broken)) == list(pdf.pages(content))


def packed(head, data):
    data = zlib.compress(data)
    return b"<<%s/Filter/FlateDecode/Length %d>>stream\n" % (head, len(data)) + data + b"\nendstream"


def test_pdf_reference_streams_and_fonts():
    """Objects in a stream, a reference stream with a PNG filter, simple fonts, moves, forms, arrays with gaps, inherited resources."""
    content = rb"BT /A 12 Tf 10 700 Td [(Hel) 20 (lo) -300 (W\157rld\051)] TJ 0 -14 Td (caf\351 \(x\)) Tj T* /B 12 Tf <0102> Tj ET /X Do BI /W 1 ID \001\002 EI BT /A 9 Tf 1 0 0 1 50 600 Tm (last) ' ET"
    inner = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1/Resources 4 0 R>>", b"<</Type/Page/Parent 2 0 R/Contents[7 0 R]>>", b"<</Font<</A<</Subtype/Type1/Encoding/WinAnsiEncoding>>/B 5 0 R>>/XObject<</X 8 0 R>>>>", b"<</Subtype/Type1/Encoding<</Differences[1/uni0416/comma]>>>>"]
    heads, body = b"", b""
    for i, x in enumerate(inner):
        heads += b"%d %d " % (i + 1, len(body))
        body += x + b" "
    objects = {6: packed(b"/Type/ObjStm/N 5/First %d" % len(heads), heads + body), 7: packed(b"", content), 8: packed(b"/Type/XObject/Subtype/Form", b"BT /A 9 Tf 10 650 Td (form) Tj ET")}
    out, places = bytearray(b"%PDF-1.5\n%\xe2\xe3\n"), {}
    for n, x in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n" % n + x + b"\nendobj\n"
    rows = [struct.pack(">BHB", 0, 0, 255)] + [struct.pack(">BHB", 2, 6, i) for i in range(5)] + [struct.pack(">BHB", 1, places[n], 0) for n in (6, 7, 8)] + [struct.pack(">BHB", 1, len(out), 0)]
    filtered, before = b"", bytes(4)
    for row in rows:
        filtered += b"\x02" + bytes((a - b) & 255 for a, b in zip(row, before))
        before = row
    start = len(out)
    out += b"9 0 obj\n" + packed(b"/Type/XRef/Size 10/W[1 2 1]/Root 1 0 R/DecodeParms<</Predictor 12/Columns 4>>", filtered) + b"\nendobj\nstartxref\n%d\n%%%%EOF" % start
    wanted = ["Hello World)\ncafé (x)\nЖ,\nform\nlast"]
    assert list(pdf.pages(bytes(out))) == wanted
    assert list(pdf.pages(bytes(out).replace(b"startxref", b"startxxxx"))) == wanted
    with pytest.raises(ValueError, match="encrypted"):
        list(pdf.pages(pdf.pdf_bytes("a").replace(b"trailer<<", b"trailer<</Encrypt 9 0 R")))


def word_file(pieces, size=512):
    """A compound file whose main stream has the pieces (text, one byte a sign) apart from each other and out of order."""
    main, places = bytearray(2048), []
    for text, short in reversed(pieces):
        main += b"\0" * (len(main) % 2)
        places.insert(0, len(main))
        main += text.encode("cp1252" if short else "utf-16-le")
    main += b"\0" * max(0, 4096 - len(main))
    lengths = [len(t) if s else len(t.encode("utf-16-le")) // 2 for t, s in pieces]
    ends = [sum(lengths[:i]) for i in range(len(pieces) + 1)]
    pcds = b"".join(struct.pack("<HIH", 0, at * 2 | 0x40000000 if short else at, 0) for at, (_, short) in zip(places, pieces))
    plc = struct.pack(f"<{len(ends)}I", *ends) + pcds
    table = b"\x01\x02\x00zz" + b"\x02" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<H", main, 0, 0xA5EC)
    struct.pack_into("<H", main, 10, 0x200)
    struct.pack_into("<I", main, 76, ends[-1])
    struct.pack_into("<II", main, 418, 0, len(table))
    sector = lambda b: b + b"\0" * (-len(b) % size)
    main_, mini = sector(bytes(main)), sector(table + b"\0" * (-len(table) % 64))
    n_main, n_mini, minis = len(main_) // size, len(mini) // size, -(-len(table) // 64)
    chain = lambda first, n: [first + i + 1 for i in range(n - 1)] + [0xFFFFFFFE]
    fat = [0xFFFFFFFD, 0xFFFFFFFE, 0xFFFFFFFE] + chain(3, n_main) + chain(3 + n_main, n_mini)
    mini_fat = chain(0, minis)
    entry = lambda name, kind, at, n: name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HB", 2 * len(name) + 2, kind) + bytes(49) + struct.pack("<IQ", at, n)
    directory = entry("Root Entry", 5, 3 + n_main, len(mini)) + entry("WordDocument", 2, 3, len(main)) + entry("1Table", 2, 0, len(table)) + bytes(128)
    head = bytearray(512)
    head[:8] = bytes.fromhex("D0CF11E0A1B11AE1")
    struct.pack_into("<HH", head, 30, 9, 6)
    struct.pack_into("<IIIIIIII", head, 44, 1, 1, 0, 4096, 2, 1, 0xFFFFFFFE, 0)
    struct.pack_into("<109I", head, 76, 0, *[0xFFFFFFFF] * 108)
    filled = lambda x: struct.pack(f"<{size // 4}I", *(x + [0xFFFFFFFF] * (size // 4 - len(x))))
    return bytes(head) + filled(fat) + sector(directory) + filled(mini_fat) + main_ + mini


def test_word97():
    content = word_file([("One café\r", True), ("Рішення \x13 PAGE \x14сім\x15 кінець\rcell\x07", False), ("x\x0by\r", True)])
    assert list(word97.paragraphs(content)) == ["One café", "Рішення сім кінець", "cell", "x\ny"]
    with pytest.raises(ValueError):
        list(word97.paragraphs(content[:700]))


def test_files_with_errors(spark, tmp_path):
    """Whole, cut, empty and foreign files of a folder: each has rows, and a damaged one says so."""
    r = random.Random(2)
    long = "\n".join("".join(r.choices("abc дé", k=40)) for _ in range(3000))
    files = {
        "a.docx": D.docx_bytes(TEXT), "b.pdf": pdf.pdf_bytes(TEXT), "c.doc": word_file([("Word\r", True)]), "d.rtf": rb"{\rtf1{\fonttbl{\f0 Arial;}}A \b b\b0\par \u1057?{\*\x y}\'e9}", "e.html": b"<html><style>p{}</style><p>One</p> two</html>",
        "f.txt": "Привіт".encode("cp1251"), "g.docx": D.docx_bytes(long)[:3000], "h.pdf": b"%PDF-1.4 nothing", "i.doc": bytes.fromhex("D0CF11E0A1B11AE1") + bytes(600), "j.docx": D.docx_bytes(long), "l.docx": D.docx_bytes(""),
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {row.path.rsplit("/", 1)[1]: row for row in D.texts(D.read(spark, str(tmp_path))).collect()}
    assert set(got) == set(files)
    wanted = {"a.docx": TEXT.replace("\n", "\n\n"), "b.pdf": squeezed(TEXT), "c.doc": "Word", "d.rtf": "A b\n Сй", "e.html": "One two", "f.txt": "Привіт", "j.docx": long.replace("\n", "\n\n"), "l.docx": ""}
    assert {k: got[k].text for k in wanted} == wanted and all(got[k].error is None for k in wanted)
    assert all(got[k].error for k in ("g.docx", "h.pdf", "i.doc"))
    parts = D.parts(D.read(spark, str(tmp_path), "j.docx")).orderBy("part").collect()
    assert [p.part for p in parts] == list(range(1, 3001)) and "\n".join(p.text for p in parts) == long


def test_files_are_made_in_small_batches(spark):
    """Files are made one at a time and handed on every few MB, not as a whole batch of texts; null texts and large ones among them."""
    from pyspark.sql import functions as F

    from docketry.sources import documents

    noise = random.Random(3).randbytes(3_000_000).hex()  # its files hardly shrink, so several batches are handed on
    rows = [(1, "a\nb"), (2, None), (3, noise), (4, noise), (5, noise + "\nend"), (6, "last")]
    files = documents.as_files(spark.createDataFrame(rows, "k int, t string").coalesce(1), "k", "t", F.when(F.col("k") == 4, "pdf").otherwise("docx"))
    assert "ArrowEvalPython" not in files._jdf.queryExecution().executedPlan().toString()
    got = {r.path: r for r in documents.texts(files).collect()}
    assert {p: r.text for p, r in got.items() if p != "4.pdf"} == {f"{k}.docx": (t or "").replace("\n", "\n\n") for k, t in rows if k != 4}
    assert got["4.pdf"].error is None and got["4.pdf"].text.replace("\n", "") == noise


def test_a_map_is_read_once_for_all_files(monkeypatch):
    """Files with the same map of codes share it; strings of digits are read as before."""
    list(pdf.pages(pdf.pdf_bytes("first")))
    calls, real = [], pdf.parse
    monkeypatch.setattr(pdf, "parse", lambda *a, **k: calls.append(1) or real(*a, **k))
    assert list(pdf.pages(pdf.pdf_bytes("second\tУкраїна \U0001F600\nline"))) == ["second\tУкраїна \U0001F600\nline"]
    assert len(calls) < 200
    assert [real(x, 0)[0] for x in (b"<0041>", b"<00 4 1>", b"<414>", b"<41zz 42>", b"<>")] == [b"\x00A", b"\x00A", b"A@", b"AB", b""]
