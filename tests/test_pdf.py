"""PDF files made by hand: text with styles, annotations, passwords, notes, merging, texts beside them."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from inkwell.operators import exports, styles
from inkwell.sources import pdf, pdf_file, texts
from inkwell.sources.pdf_file import Name, Ref, Stream

RICH = '<?xml version="1.0"?><body><p style="font-size:10pt">plain <span style="font-weight:bold">bold</span> end</p><p><b>two</b></p></body>'


def made(content, annots=(), extra=None):
    objects = {
        1: {"Type": Name("Catalog"), "Pages": Ref(2)},
        2: {"Type": Name("Pages"), "Kids": [Ref(3)], "Count": 1, "MediaBox": [0, 0, 200, 100]},
        3: {"Type": Name("Page"), "Parent": Ref(2), "Contents": Ref(4), "Resources": {"Font": {"F1": Ref(5), "F2": Ref(6)}}, "Annots": list(annots)},
        4: Stream({"Filter": Name("FlateDecode")}, zlib.compress(content)),
        5: {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("ABCDEF+Main"), "FirstChar": 97, "Widths": [500, 600]},
        6: {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("Kana"), "DescendantFonts": [{"DW": 1000, "W": [1, [900]]}], "ToUnicode": Ref(7)},
        7: Stream({}, b"1 beginbfchar <0001> <6F22> endbfchar 1 beginbfrange <0002> <0003> <304B> endbfrange"),
        **(extra or {}),
    }
    return pdf_file.file_of(objects, 1)


CONTENT = b"BT /F1 10 Tf 20 80 Td (a\\(b) Tj /F2 12 Tf 0 -20 Td [<0001> -500 <0002>] TJ /F2 5 Tf <0003> Tj ET"
NOTES = ({"Type": Name("Annot"), "Subtype": Name("Text"), "T": "ann", "Subj": "F1 12", "Contents": "plain bold end\rtwo", "RC": RICH}, {"Subtype": Name("Link"), "Contents": "no"}, {"Subtype": Name("Highlight"), "Contents": b"caf\xe9"})


@pytest.fixture
def folder(tmp_path):
    for name, content in (("p10.pdf", b"BT /F1 9 Tf 10 10 Td (ten) Tj ET"), ("p2.pdf", CONTENT), ("x.txt", b"no")):
        (tmp_path / name).write_bytes(made(content, NOTES if name == "p2.pdf" else ()) if name.endswith("pdf") else content)
    return str(tmp_path)


def test_glyphs(spark, folder):
    rows = pdf.glyphs(pdf.scan(spark, f"{folder}/p2.pdf")).orderBy("ord").collect()
    assert [(r["text"], r["font"], r["size"]) for r in rows] == [("a", "Main", 10.0), ("(", "Main", 10.0), ("b", "Main", 10.0), ("漢", "Kana", 12.0), ("か", "Kana", 12.0), ("が", "Kana", 5.0)]
    assert (rows[0]["x0"], rows[0]["top"], rows[0]["x1"], rows[0]["bottom"]) == (20.0, 10.0, 25.0, 20.0)
    assert rows[4]["x0"] == pytest.approx(20 + 0.9 * 12 + 0.5 * 12)
    kept = styles.keep_styles(pdf.glyphs(pdf.scan(spark, folder)), min_size=8.0)
    assert sorted(r["text"] for r in styles.plain_text(kept).collect()) == ["a(b漢か", "ten"]


def test_annotations(spark, folder):
    notes = pdf.annotations(pdf.scan(spark, folder))
    rows = notes.orderBy("idx").collect()
    assert [(r["author"], r["subject"], r["contents"]) for r in rows] == [("ann", "F1 12", "plain bold end\ntwo"), (None, None, "café")]
    out = exports.with_output_name(exports.export_bold(notes))
    assert out.first()["text"] == "plain 【bold】 end\n【two】\ncafé"
    assert [r["out"].endswith("/p2.txt") for r in out.collect()] == [True]
    texts.write_texts(out, folder)
    with open(f"{folder}/p2.txt", encoding="utf-8") as file:
        assert file.read() == out.first()["text"]


def test_notes_and_merge(spark, folder):
    files = pdf.scan(spark, folder)
    labels = styles.style_labels(pdf.glyphs(files)).select("path", "page", "x", "y", F.lit("inkwell").alias("author"), F.lit("style").alias("subject"), "label")
    noted = pdf.annotate(files, labels)
    assert {r["contents"] for r in pdf.annotations(noted).where("author = 'inkwell'").collect()} == {"Main 10.0", "Kana 12.0", "Kana 5.0", "Main 9.0"}
    merged = pdf.merge(noted).collect()
    assert len(merged) == 1 and merged[0]["by"].endswith(folder)
    one = pdf_file.Pdf(bytes(merged[0]["content"]))
    assert ["".join(g[0] for g in pdf_file.page_glyphs(one, p)) for _, p in one.pages()] == ["a(b漢かが", "ten"]
    assert len(pdf_file.page_annotations(one, one.pages()[0][1])) == 5


def test_object_streams():
    inner = {10: {"Type": Name("Catalog"), "Pages": Ref(11)}, 11: {"Type": Name("Pages"), "Kids": [Ref(12)], "Count": 1}, 12: {"Type": Name("Page"), "Contents": Ref(4), "Resources": {"Font": {"F1": {"BaseFont": Name("M")}}}}}
    parts = [pdf_file.written(v) for v in inner.values()]
    head = b" ".join(b"%d %d" % (n, sum(len(p) + 1 for p in parts[:k])) for k, n in enumerate(inner)) + b" "
    stream = Stream({"Type": Name("ObjStm"), "N": 3, "First": len(head), "Filter": Name("FlateDecode")}, zlib.compress(head + b" ".join(parts)))
    body = pdf_file.written(stream)
    data = b"%PDF-1.5\n1 0 obj\n" + body + b"\nendobj\n4 0 obj\n<</Length 5 0 R>>\nstream\nBT /F1 7 Tf (hey) Tj ET\nendstream\nendobj\n5 0 obj\n24\nendobj\n"
    own = pdf_file.Pdf(data)
    assert [g[0] for g in pdf_file.page_glyphs(own, own.pages()[0][1])] == list("hey")


def locked(password, owner="owner"):
    """A file encrypted by the standard handler, revision 3."""
    ident, size, rights = b"0123456789abcdef", 16, -4
    key = hashlib.md5((owner.encode() + pdf_file.PADDING)[:32]).digest()
    for _ in range(50):
        key = hashlib.md5(key).digest()
    o = (password.encode() + pdf_file.PADDING)[:32]
    for k in range(20):
        o = pdf_file.rc4(bytes(b ^ k for b in key), o)
    own = hashlib.md5((password.encode() + pdf_file.PADDING)[:32] + o + (rights & 0xFFFFFFFF).to_bytes(4, "little") + ident).digest()
    for _ in range(50):
        own = hashlib.md5(own).digest()
    u = hashlib.md5(pdf_file.PADDING + ident).digest()
    for k in range(20):
        u = pdf_file.rc4(bytes(b ^ k for b in own), u)
    content = pdf_file.rc4(hashlib.md5(own + (4).to_bytes(3, "little") + b"\0\0").digest()[:16], b"BT /F1 8 Tf (key) Tj ET")
    objects = {
        1: {"Type": Name("Catalog"), "Pages": Ref(2)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3)], "Count": 1}, 3: {"Type": Name("Page"), "Contents": Ref(4), "Resources": {"Font": {"F1": {}}}}, 4: Stream({}, content),
        9: {"Filter": Name("Standard"), "V": 2, "R": 3, "Length": 8 * size, "P": rights, "O": o, "U": u + bytes(16)},
    }
    return pdf_file.file_of(objects, 1).replace(b"trailer\n<<", b"trailer\n<</Encrypt 9 0 R /ID [<%s>]" % ident.hex().encode())


@pytest.mark.parametrize("given", ["open", "owner"])
def test_passwords(given):
    own = pdf_file.Pdf(locked("open"), given)
    assert [g[0] for g in pdf_file.page_glyphs(own, own.pages()[0][1])] == list("key")
    with pytest.raises(pdf_file.PdfError, match="wrong password"):
        pdf_file.Pdf(locked("open"), "else")


def test_files_that_are_none(spark, folder):
    bad = spark.createDataFrame([("a", bytearray(b"none")), ("b", None)], "path string, content binary")
    assert pdf.glyphs(bad, errors="skip").count() == 0
    with pytest.raises(Exception, match="no PDF header"):
        pdf.glyphs(bad).count()


def test_scan_reads_no_content_for_names(spark, folder):
    plan = pdf.scan(spark, folder).where("length > 10").select("path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1] and "GreaterThan(length,10)" in plan


def strong(password, owner, revision):
    """A file encrypted with AES of 256 bits."""
    key, objects = bytes(range(32)), {
        1: {"Type": Name("Catalog"), "Pages": Ref(2)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3)], "Count": 1},
        3: {"Type": Name("Page"), "Contents": Ref(4), "Resources": {"Font": {"F1": {}}}, "Annots": [{"Subtype": Name("Text"), "Contents": sealed(b"a note", bytes(range(32)))}]}, 4: Stream({}, sealed(b"BT /F1 8 Tf (key) Tj ET", bytes(range(32)))),
    }
    hashed = lambda p, salt, more=b"": pdf_file.strong_hash(p.encode(), salt, more, revision)
    u = hashed(password, b"validate") + b"validate" + b"key salt"
    o = hashed(owner, b"VALIDATE", u) + b"VALIDATE" + b"KEY SALT"
    ue, oe = (pdf_file.aes.encrypt(h, bytes(16), key) for h in (hashed(password, b"key salt"), hashed(owner, b"KEY SALT", u)))
    objects[9] = {"Filter": Name("Standard"), "V": 5, "R": revision, "Length": 256, "P": -4, "O": o, "U": u, "OE": oe, "UE": ue, "CF": {"StdCF": {"CFM": Name("AESV3")}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
    return pdf_file.file_of(objects, 1, {"Encrypt": Ref(9)})


def sealed(data, key):
    return bytes(16) + pdf_file.aes.encrypt(key, bytes(16), pdf_file.aes.padded(data))


@pytest.mark.parametrize("revision", [5, 6])
@pytest.mark.parametrize("given", ["öpen", "owner"])
def test_strong_passwords(revision, given):
    own = pdf_file.Pdf(strong("öpen", "owner", revision), given)
    page = own.pages()[0][1]
    assert [g[0] for g in pdf_file.page_glyphs(own, page)] == list("key") and pdf_file.page_annotations(own, page)[0][2] == "a note"
    with pytest.raises(pdf_file.PdfError, match="wrong password"):
        pdf_file.Pdf(strong("öpen", "owner", revision), "else")


def test_written_passwords():
    objects = pdf_file.text_file([[("漢字 😀", "Main", 12.0), ("b", "Kana", 5.0)]], [[("me", "of it", "said 😀\nmore")]])
    data = pdf_file.encrypted(objects, 1, "user", "owner", b"salt")
    assert b"\x6f\x22" not in data
    for given in ("user", "owner"):
        own = pdf_file.Pdf(data, given)
        page = own.pages()[0][1]
        assert [g[:3] for g in pdf_file.page_glyphs(own, page)] == [*((c, "Main", 12.0) for c in "漢字 😀"), ("b", "Kana", 5.0)]
        assert pdf_file.page_annotations(own, page) == [("me", "of it", "said 😀\nmore", [("said 😀\nmore", False)])]
    with pytest.raises(pdf_file.PdfError, match="wrong password"):
        pdf_file.Pdf(data, "")


def test_aes_vectors():
    """The published examples of the standard, for keys of 16 and 32 bytes."""
    text = bytes.fromhex("00112233445566778899aabbccddeeff")
    for n, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        assert pdf_file.aes.encrypt(bytes(range(n)), bytes(16), text).hex() == want
        assert pdf_file.aes.decrypt(bytes(range(n)), text, pdf_file.aes.encrypt(bytes(range(n)), text, text * 9)) == text * 9


def packed_codes(data, early):
    """LZW as files have it."""
    table, out, width, last = {bytes([b]): b for b in range(256)}, [(256, 9)], 9, b""
    for b in data:
        if last + bytes([b]) in table:
            last += bytes([b])
            continue
        out.append((table[last], width))
        table[last + bytes([b])] = len(table) + 2
        width = max(9, min(12, (len(table) + 1 + early).bit_length()))
        if len(table) > 3900:
            out.append((256, width))
            table, width = {bytes([b]): b for b in range(256)}, 9
        last = bytes([b])
    out.append((table[last], width))
    width = max(9, min(12, (len(table) + 2 + early).bit_length()))
    bits = "".join(f"{c:0{w}b}" for c, w in [*out, (257, width)])
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def test_filters():
    import random

    rng = random.Random(2)
    assert pdf_file.unpacked_codes(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), 1) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    data = bytes(rng.choice(b"abcd") for _ in range(30_000)) + rng.randbytes(9000)
    for early in (0, 1):
        assert pdf_file.unpacked_codes(packed_codes(data, early), early) == data
    assert pdf_file.unpacked_runs(b"\x02abc\xfex\x00y\x80zz") == b"abcxxxy"
    own = pdf_file.Pdf(made(b"").replace(b"/FlateDecode", b"/RunLengthDecode"))
    assert own.decoded(Stream({"Filter": [Name("AHx"), Name("RL")]}, b"0261626380>")) == b"abc"


def test_named_encodings_and_unknown_codes():
    for name, raw, want in (("90ms-RKSJ-H", "あａ1ｱ漢".encode("cp932"), "あａ1ｱ漢"), ("UniJIS-UTF16-V", "漢😀".encode("utf-16-be"), "漢😀"), ("EUC-H", "漢字".encode("euc_jp"), "漢字"), ("GBK-EUC-H", "汉a".encode("gbk"), "汉a"), ("Identity-H", b"\0\1\0\2", "\ufffd\ufffd")):
        font = pdf_file.font_of(pdf_file.Pdf(made(b"")), {"Subtype": Name("Type0"), "Encoding": Name(name), "DescendantFonts": [{}]})
        assert "".join(font.text(c) for c in font.codes(raw)) == want
