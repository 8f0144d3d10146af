import io
import json
import zipfile
import zlib

from lexforge.operators import adapt, chunking, occurrences
from lexforge.plans import source_queries
from lexforge.sources import formats, ingest, parsers
from pyspark.sql import functions as F


def heads(result):
    return [(s["level"], s["heading"], s["body"]) for s in result[1]]


def test_text_and_markdown():
    assert heads(parsers.parse_txt(b"Intro\n\nINDICATIONS AND USAGE\nFor pain.\n4.2 Posology\nTake it.")) == [(1, "General Content", "Intro"), (1, "INDICATIONS AND USAGE", "For pain."), (1, "4.2 Posology", "Take it.")]
    title, found = parsers.parse_md("# Läbel\n\n## 4.2 Dose\nx\n### Sub\ny".encode())
    assert title == "Läbel" and [(s["level"], s["number"], s["heading"]) for s in found] == [(1, None, "Läbel"), (2, "4.2", "Dose"), (3, None, "Sub")]
    assert heads(parsers.parse_txt(b"")) == [] and parsers.decode(b"\xe9") == "é"


def test_json_forms():
    assert heads(parsers.parse_json(json.dumps([{"section": "A", "content": "x"}, {"k": 1}, "z"]).encode())) == [(1, "A", "x"), (1, "Section 2", "k: 1"), (1, "Item 3", "z")]
    assert heads(parsers.parse_json(json.dumps({"results": [{"id": "1", "boxed_warning": ["a", "b"], "nested": {"k": 1}}]}).encode())) == [(1, "Boxed Warning", "a\nb"), (1, "Nested", "[JSON Path: $.nested]\nk: 1")]
    assert heads(parsers.parse_json(b"{}")) == [(1, "General Content", "{}")]


def test_xml_and_html():
    xml = b"""<document xmlns="urn:hl7-org:v3"><title>Label</title><component><section><code code="34067-9" displayName="INDICATIONS"/><text><paragraph>For pain.</paragraph><list><item>one</item></list>
      <table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table></text><component><section><title>Sub</title><text>inner</text></section></component></section></component></document>"""
    title, found = parsers.parse_xml(xml)
    assert title == "Label" and [(s["level"], s["heading"], s["loinc"]) for s in found] == [(1, "INDICATIONS", "34067-9"), (2, "Sub", None)]
    assert "| 1 | 2 |" in found[0]["body"] and "* one" in found[0]["body"] and found[1]["body"] == "inner"
    title, found = parsers.parse_html(b"<html><head><meta charset=utf-8><title>T</title><script>x<1</script></head><body><nav>no</nav><h1>Dose</h1><p>Take <b>one</b><br>now</p><ul><li>a</li></ul><table><tr><th>h</th></tr><tr><td>v</td></tr></table></body></html>")
    assert title == "T" and found == [{"level": 1, "number": None, "heading": "Dose", "loinc": None, "body": "Take one now\n\n* a\n\n| h |\n| --- |\n| v |"}]


def docx(paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    return out.getvalue()


def pdf(pages, fonts=b"", extra=()):
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(len(pages))) + b"] >>"]
    for i, p in enumerate(pages):
        data = zlib.compress(p)
        objects.append(b"<< /Type /Page /Parent 2 0 R /Resources << /Font << " + fonts + b" >> >> /Contents %d 0 R >>" % (4 + 2 * i))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(data) + data + b"\nendstream")
    objects += extra
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects)) + b"%%EOF"


def test_pdf():
    first = rb"BT /F1 12 Tf 72 700 Td (OVERDOSAGE) Tj 0 -14 Td (Call \(24 h\) caf\351.) Tj T* [(Sp) -300 (lit)] TJ ET"
    second = b"BT 1 0 0 1 72 700 Tm (Second) Tj 1 0 0 1 120 700 Tm (page) Tj ET"
    _, found = parsers.parse_pdf(pdf([first, second]))
    assert [(s["heading"], s["body"]) for s in found] == [("General Content", "[Page 1]"), ("OVERDOSAGE", "Call (24 h) café.\nSp lit\n[Page 2]\nSecond page")]
    assert parsers.parse_pdf(pdf([b""]))[1][0]["body"].startswith("No digital text layer")
    cmap = b"<< /Length 1 >>\nstream\n1 beginbfrange <0001> <0003> <0041> endbfrange 1 beginbfchar <0009> <00E9> endbfchar\nendstream"
    font = pdf([b"BT /F1 9 Tf <000100020009> Tj ET"], b"/F1 5 0 R", [b"<< /Type /Font /ToUnicode 6 0 R >>", cmap])
    assert parsers.parse_pdf(font)[1][0]["body"] == "[Page 1]\nABé"
    try:
        parsers.parse_pdf(pdf([first]) + b"trailer << /Encrypt 9 0 R >>")
    except ValueError:
        return
    raise AssertionError("an encrypted file was read")


def test_files_of_all_kinds(spark):
    files = [("a.docx", docx([("Title", "T"), ("Heading1", "Dose"), ("ListBullet", "x")])), ("b.json", b"{broken"), ("c.doc", b"\xd0\xcf\x11\xe0"), (None, b"# Hi\ntext"), ("e.txt", None), ("f", b"<?xml version='1.0'?><d><t>x</t></d>")]
    df = spark.createDataFrame([(str(i), p, c) for i, (p, c) in enumerate(files)], "id string, path string, content binary")
    rows = ingest.parse_files(df, "id").collect()
    by = {r["document_id"]: r for r in rows}
    assert by["0"]["heading"] == "Dose" and "* x" in by["0"]["body"] and "| c |" in by["0"]["body"] and by["0"]["title"] == "T"
    assert by["1"]["error"].startswith("JSONDecodeError") and "no parser for doc" in by["2"]["error"] and by["3"]["format"] == "md" and "4" not in by and by["5"]["format"] == "xml"
    items = ingest.sections_to_items(ingest.parse_files(df, "id")).collect()
    assert {i["section"] for i in items} == {"Dose", "Hi", "T"} and ingest.parse_files(df.limit(0), "id").count() == 0


def test_binary_files(spark, tmp_path):
    (tmp_path / "x.html").write_text("<h2>Use</h2><p>Daily.</p>")
    (tmp_path / "y.txt").write_text("OVERDOSAGE\nCall.")
    rows = ingest.parse_files(ingest.read_files(spark, str(tmp_path))).collect()
    assert sorted((r["format"], r["heading"], r["body"]) for r in rows) == [("html", "Use", "Daily."), ("txt", "OVERDOSAGE", "Call.")]


def test_format_order(spark):
    df = spark.createDataFrame([("a.htm", b"{}", "text/plain", "pdf"), ("a.htm", b"{}", "text/plain", None), ("a", b"{}", "text/xml; charset=x", None), ("a", b"PK\x03\x04", None, None), (None, None, None, None)], "p string, c binary, m string, s string")
    assert [r[0] for r in df.select(formats.resolve(*[F.col(c) for c in "pcms"])).collect()] == ["pdf", "html", "xml", "docx", "txt"]


def test_label_payloads(spark):
    payload = {"results": [{"id": "1", "version": "2", "openfda": {"brand_name": ["B"], "generic_name": ["G"]}, "warnings": ["w", "x"], "description": [" "]}, {"id": "2", "overdosage": ["o" * 5000]}]}
    df = spark.createDataFrame([(json.dumps(payload),), ("{}",), ("broken",), (None,)], "j string")
    assert sorted((r["document_id"], r["drug"], r["section"], len(r["text"])) for r in ingest.label_items(df, "j").collect()) == [("1", "G", "Warnings", 3), ("2", None, "Overdosage", 4000)]


DOC = """Preface of the document, long enough to be kept.

2 DOSAGE
| Group | Dose |
|---|---|
| Adults | 5 mg |
| Children |  |

Take one of these options daily:
- first option
- second option

NDC: see the carton

A plain paragraph that is long enough to stay in.
2.1 Renal
Short."""


def test_chunks(spark):
    df = spark.createDataFrame([(1, DOC, "Doc", "x"), (2, None, "Doc", "x"), (3, "", None, None)], "id long, text string, name string, content string")
    rows = [r for r in chunking.chunk_documents(df, "id", "text", "name").collect()]
    assert [(r["chunk_type"], r["exact_location"], r["content"]) for r in rows] == [
        ("paragraph", "Paragraph 1", "Preface of the document, long enough to be kept."), ("table_row", "Table, Row 1", "Group: Adults | Dose: 5 mg"), ("table_row", "Table, Row 2", "Group: Children | Dose"),
        ("paragraph", "Paragraph (Stem)", "Take one of these options daily:"), ("bullet", "List Item -", "first option"), ("bullet", "List Item -", "second option"),
        ("structured_field", "Field (NDC)", "NDC: see the carton"), ("paragraph", "Paragraph 2", "A plain paragraph that is long enough to stay in."),
    ]
    assert rows[4]["parent_chunk_id"] == rows[3]["chunk_id"] and rows[0]["structure_path"] == "Doc > General Content > Paragraph 1" and all(len(r["chunk_id"]) == 16 for r in rows)
    again = {r["chunk_id"] for r in chunking.chunk_documents(df, "id", "text", "name").collect()}
    assert again == {r["chunk_id"] for r in rows}
    sections = chunking.sections(df, "id", "text").orderBy("order_index").collect()
    assert [(s["section_number"], s["level"]) for s in sections] == [(None, 1), ("2", 1), ("2.1", 2)] and sections[2]["parent_section_id"] == sections[1]["section_id"]
    assert {(r["header"], r["value"]) for r in chunking.table_rows(df, "id", "text").collect()} == {("Group", "Adults"), ("Dose", "5 mg"), ("Group", "Children"), ("Dose", "")}


def test_long_paragraphs_are_packed():
    text = " ".join(f"Sentence number {i} is here." for i in range(60))
    parts = chunking.pack(text, 300, 1)
    assert all(len(p) <= 300 and p.endswith(".") for p in parts) and len(parts) > 4
    assert all(b.startswith(a[a.rindex("Sentence") :]) for a, b in zip(parts, parts[1:]))
    assert chunking.pack("x" * 5000, 300, 1) == ["x" * 5000]


def test_adapters(spark):
    schema = "chunk_id string, document_id string, document_fingerprint string, document_name string, source string, source_identifier string, version string, section_title string, section_number string, page int, exact_location string, loinc_code string, chunk_type string, active_ingredient string, content string, parent_chunk_id string, section_id string, structure_path string, order_index int, jurisdiction string, document_type string, normalized_section string"
    base = ["c", "d", None, None, "S", None, None, "Sec", "1", None, "Table 2, Row 3", None, "table_row", None, "Dose: 5 mg daily", None, None, "a > b", 1, None, None, None]
    rows = [base, [*base[:9], None, "p. 7", *base[11:12], None, *base[13:]], [None] * 22]
    out = adapt.chunks_to_items(spark.createDataFrame(rows, schema)).collect()
    assert out[0]["metadata"]["table_title"] == "Table 2" and out[0]["metadata"]["row_index"] == "3" and out[0]["dose"] == "5 mg" and out[0]["page"] is None
    assert out[1]["page"] == 7 and "table_title" not in out[1]["metadata"] and out[2]["text"] is None


def test_occurrences(spark):
    rows = spark.createDataFrame([("1", "A", "We take Losartan 50 mg now and then"), ("2", "A", "• TAKE  losartan 50 mg!"), ("3", "B", "Losartan at 50 mg, other words"), ("4", "B", "take metformin 50 mg"), ("5", None, "no"), ("6", "C", None), ("7", "C", "completely different subject"), ("8", "C", "take Losartan")], "id string, section string, text string")
    p = spark.createDataFrame([(1, "take Losartan 50 mg"), (2, "ab"), (3, None)], "p long, s string")
    got = {r["row_id"]: (r["layer"], r["relevance"]) for r in occurrences.find_occurrences(rows, "id", "section", "text", p, "p", "s").collect()}
    assert got == {"1": ("exact_match", "DIRECT"), "2": ("normalized_match", "DIRECT"), "3": ("structured_match", "INDIRECT"), "8": ("semantic_match", "INDIRECT")}
    assert occurrences.find_occurrences(rows, "id", "section", "text", p.limit(0), "p", "s").count() == 0


def test_occurrences_count_once_within_one_document_only(spark):
    same = "Take losartan 50 mg once daily with water or food, as the doctor says"
    rows = spark.createDataFrame([("s1", 1, 0, "Dose", same + ", one."), ("s0", 1, 1, "Dose", same + ", two."), ("s2", 2, 0, "Dose", same + ", three."), ("s3", 2, 1, "Other", same)], "id string, doc long, o int, section string, text string")
    p = spark.createDataFrame([(1, "Take losartan 50 mg")], "p long, s string")
    got = occurrences.find_occurrences(rows, "id", "section", "text", p, "p", "s", document="doc", order="o")
    assert {r["row_id"] for r in got.collect()} == {"s1", "s2", "s3"}
    assert occurrences.find_occurrences(rows, "id", "section", "text", p, "p", "s").count() == 4


def test_occurrence_query_reads_sections(spark, tmp_path):
    text = "1 DOSAGE\nFirst words stand here, and these go on for well over sixty characters. {}\n2 WARNINGS\nTake losartan 50 mg. {}"
    spark.createDataFrame([(i, "Label", text.format(i, i)) for i in (1, 2)], "doc_id long, document_name string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100, "Take losartan 50 mg. More.")], "item_id long, target_text string").write.parquet(str(tmp_path / "eval_cases.parquet"))
    got = source_queries.phrase_occurrences(spark, str(tmp_path)).collect()
    assert sorted((r["row_id"], r["section"], r["layer"]) for r in got) == [("sec_1_1_2", "2 WARNINGS", "exact_match"), ("sec_2_1_2", "2 WARNINGS", "exact_match")]


def test_html_and_tsv_tables(spark):
    html = "<table><caption>Doses</caption>\n\t<tr>\t<th>Group</th><th>Dose</th></tr>\n\t<tr>\t<td>Adults</td><td>5 mg</td><td>daily</td></tr></table>"
    text = f"1 DOSAGE\n| A | B |\n|---|---|\n| x | y |\n{html}\nAge\tDose\n\n6\t1 mg\n7\t2 mg\nend\none\ttab"
    df = spark.createDataFrame([(1, text, "Doc"), (2, "<table><tr><td>only</td></tr></table>", "Doc")], "id long, text string, name string")
    got = {(r["document_id"], r["table_no"], r["row_no"], r["header"], r["value"]) for r in chunking.table_rows(df, "id", "text").collect()}
    assert got == {
        ("1", 0, 0, "A", "x"), ("1", 0, 0, "B", "y"), ("1", 1, 0, "Group", "Adults"), ("1", 1, 0, "Dose", "5 mg"), ("1", 1, 0, "Column 3", "daily"),
        ("1", 2, 0, "Age", "6"), ("1", 2, 0, "Dose", "1 mg"), ("1", 2, 1, "Age", "7"), ("1", 2, 1, "Dose", "2 mg"), ("2", 0, 0, "Column 1", "only"),
    }
    rows = [r for r in chunking.chunk_documents(df, "id", "text", "name").collect() if r["chunk_type"] == "table_row"]
    assert ("Doses, Row 1", "Group: Adults | Dose: 5 mg | Column 3: daily") in [(r["exact_location"], r["content"]) for r in rows]


def test_whole_texts(spark):
    payload = spark.createDataFrame([(json.dumps({"results": [{"id": "2", "overdosage": ["o" * 5000]}]}),)], "j string")
    docs = spark.createDataFrame([(1, "OVERDOSAGE\n" + "x" * 6000)], "id long, text string")
    assert [len(r["text"]) for r in ingest.label_items(payload, "j", chars=None).collect()] == [5000]
    assert [len(r["text"]) for r in ingest.standard_segments(docs, "id", "text", chars=None).collect()] == [6000]


def test_label_sections_take_their_code_names(spark):
    xml = b'<document><title>T</title><component><section><code code="34067-9" displayName="INDICATIONS SECTION"/><title>1 Indications</title><text><paragraph>For pain in adults only.</paragraph></text></section><section><title>No code</title><text><paragraph>Some text of its own.</paragraph></text></section></component></document>'
    df = spark.createDataFrame([("a", bytearray(xml)), ("b", bytearray(b"<document")), ("c", None)], "path string, content binary")
    assert sorted(r["section"] for r in ingest.spl_items(df).collect()) == ["INDICATIONS SECTION", "No code"]
    assert [s["heading"] for s in parsers.parse_xml(xml)[1]] == ["1 Indications", "No code"]


def compound(streams):
    """A compound file of 512-byte sectors; every stream is padded beyond the size of small ones."""
    import struct

    body, fat, entries = b"", [], []

    def add(data):
        nonlocal body
        data += b"\0" * (-len(data) % 512)
        start, n = len(fat), len(data) // 512
        fat.extend([*range(start + 1, start + n), 0xFFFFFFFE])
        body += data
        return start

    def entry(name, kind, start, size):
        raw = (name + "\0").encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + struct.pack("<III", *[0xFFFFFFFF] * 3) + b"\0" * 36 + struct.pack("<IQ", start, size)

    for name, data in streams.items():
        data = data.ljust(4096, b"\0")
        entries.append(entry(name, 2, add(data), len(data)))
    directory = add(b"".join([entry("Root Entry", 5, 0xFFFFFFFE, 0), *entries]).ljust(512 * 2, b"\0"))
    at = len(fat)
    fat.append(0xFFFFFFFD)
    table = struct.pack("<128I", *(fat + [0xFFFFFFFF] * (128 - len(fat))))
    head = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIIII", 0, 1, directory, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, at)
    return head.ljust(512, b"\xff") + body + table


def word_file(encrypted=False):
    """Two pieces, one of single bytes and one of UTF-16, with a field and a table cell."""
    import struct

    first, second = "1 DOSAGE\rTake it \x13 HYPERLINK \x14daily\x15.\r".encode("cp1252"), "Größe\x07中\x07\r".encode("utf-16-le")
    text = bytearray(2048)
    text[512 : 512 + len(first)], text[1024 : 1024 + len(second)] = first, second
    struct.pack_into("<H", text, 0, 0xA5EC)
    struct.pack_into("<H", text, 0x0A, 0x0200 | (0x0100 if encrypted else 0))
    n = len(first) + len(second) // 2
    struct.pack_into("<I", text, 0x4C, n)
    pieces = struct.pack("<III", 0, len(first), n) + struct.pack("<HIH", 0, 512 * 2 | 0x40000000, 0) + struct.pack("<HIH", 0, 1024, 0)
    clx = b"\x01" + struct.pack("<H", 3) + b"abc" + b"\x02" + struct.pack("<I", len(pieces)) + pieces
    struct.pack_into("<II", text, 0x1A2, 8, len(clx))
    return compound({"WordDocument": bytes(text), "1Table": b"\0" * 8 + clx})


def test_legacy_word_files(spark):
    title, found = parsers.parse_doc(word_file())
    assert [(s["heading"], s["body"]) for s in found] == [("1 DOSAGE", "Take it daily.\nGröße\t中")]
    files = [("a.doc", word_file()), ("b.doc", word_file(encrypted=True)), ("c.doc", b"D0CF"), ("d.doc", compound({"Other": b"x"})), (None, word_file())]
    got = ingest.parse_files(spark.createDataFrame([(i, p, bytearray(b)) for i, (p, b) in enumerate(files)], "id int, path string, content binary"), "id").collect()
    assert sorted((r["document_id"], r["error"] is None, r["format"]) for r in got) == [("0", True, "doc"), ("1", False, "doc"), ("2", False, "doc"), ("3", False, "doc"), ("4", True, "doc")]


def test_numbered_lists_and_plain_archives(spark):
    import io
    import zipfile

    html = b"<body><ol><li>one<li>two</li><ul><li>dot</li></ul><li>three</li></ol><ul><li>x</li></ul></body>"
    assert parsers.parse_html(html)[1][0]["body"].split("\n\n")[-3:] == ["* dot", "3. three", "* x"]
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda n, t: f'<w:p><w:pPr><w:numPr><w:numId w:val="{n}"/></w:numPr></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p(1, 'dot')}{p(2, 'count')}{p(9, 'none')}</w:body></w:document>")
        kinds = "".join(f'<w:abstractNum w:abstractNumId="{a}"><w:lvl w:ilvl="0"><w:numFmt w:val="{f}"/></w:lvl></w:abstractNum>' for a, f in ((5, "bullet"), (6, "decimal")))
        z.writestr("word/numbering.xml", f'<w:numbering {w}>{kinds}<w:num w:numId="1"><w:abstractNumId w:val="5"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="6"/></w:num></w:numbering>')
    assert parsers.parse_docx(box.getvalue())[1][0]["body"] == "* dot\n\n1. count\n\nnone"
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("a.txt", "x")
    df = spark.createDataFrame([(1, bytearray(box.getvalue())), (2, bytearray(plain.getvalue()))], "id int, content binary")
    assert {r[0]: r[1] for r in df.select("id", formats.resolve(F.lit(None).cast("string"), F.col("content"))).collect()} == {1: "docx", 2: "txt"}


def test_occurrences_are_scored_by_dimension(spark):
    rows = spark.createDataFrame([("1", "Dosage", "Take losartan 50 mg once daily."), ("2", "Dosage", "take  losartan 50 mg, but not with food"), ("3", "Storage", "Keep dry.")], "id string, section string, text string")
    p = spark.createDataFrame([(1, "Take losartan 50 mg")], "p long, s string")
    got = {r["row_id"]: r for r in occurrences.find_occurrences(rows, "id", "section", "text", p, "p", "s", scores=True).collect()}
    assert set(got) == {"1", "2"} and set(got["1"]["scores"]) == {"meaning", "template", "context", "structure", "format", "key_information"}
    assert got["1"]["statuses"]["context"] == "MATCH" and got["1"]["scores"]["context"] == 0.9 and got["1"]["false_match"] is False
    assert occurrences.find_occurrences(rows, "id", "section", "text", p.limit(0), "p", "s", scores=True).count() == 0
