"""The retrieval pipeline, blocked comparison, adapters, ingestion and stores on small fixtures."""

from lexforge.operators import adapt, pipeline, search, store
from lexforge.sources import ingest
from pyspark.sql import functions as F

ITEM = "content_id string, source string, document_id string, document_name string, document_fingerprint string, source_identifier string, source_url string, section string, subsection string, exact_location string, page int, version string, publication_date string, loinc_code string, drug string, product string, indication string, text string"
TARGET = "target_id long, text string, section string, document_id string, fingerprint string, content_id string"


def item(content_id, source, document_id, text, drug=None, section=None, fingerprint=None):
    return (content_id, source, document_id, None, fingerprint, None, None, section, None, None, None, None, None, None, drug, None, None, text)


ITEMS = [
    item("own", "S", "d0", "Take losartan 50 mg once daily.", "Losartan", "Dosage"),
    item("same", "A", "d1", "Take losartan 50 mg once daily.", "Losartan", "Dosage"),
    item("then", "B", "d2", "- take  losartan 50 mg once daily", "losartan potassium", "Dosage"),
    item("dose", "A", "d3", "Take losartan 100 mg once daily.", "Losartan", "Dosage"),
    item("print", "A", "d4", "Take losartan 50 mg once daily with water.", "Losartan", "Dosage", "fp"),
    item("far", "C", "d5", "Losartan tablets are stored below thirty degrees.", "Losartan", "Storage"),
    item("other", "C", "d6", "Aspirin for headaches.", "Aspirin", "Use"),
    item("null", "C", "d7", None, "Losartan"),
    item("same", "A", "d1", "Take losartan 50 mg once daily.", "Losartan", "Dosage"),
]


def frames(spark, targets):
    docs = spark.createDataFrame([("d0", "Section 2"), ("d5", "Losartan"), ("d5", None)], "document_id string, drug string")
    return spark.createDataFrame(targets, TARGET), spark.createDataFrame(ITEMS, ITEM), docs


def test_candidates_are_searched_merged_and_ranked(spark):
    targets, items, docs = frames(spark, [(1, "Take losartan 50 mg once daily.", "Dosage", "d0", "fp", None), (2, "zzz qqq", None, "d5", None, "far"), (3, None, None, None, None, None)])
    rows = pipeline.retrieve(targets, items, docs).orderBy("target_id", "rank").collect()
    first = [(r["content_id"], r["similarity"], r["cross_sources"], r["duplicate_ids"]) for r in rows if r["target_id"] == 1]
    # its own document and fingerprint are out, copies are one candidate, the other dose is another
    assert first[0] == ("same", 1.0, "A|B", "then") and [x[0] for x in first[:2]] == ["same", "dose"] and {x[0] for x in first} <= {"same", "dose", "far"}
    # the document's drug is searched; nothing is near, so the first one stands
    second = [(r["content_id"], r["similarity"], r["rank"]) for r in rows if r["target_id"] == 2]
    assert len(second) == 1 and second[0][1:] == (search.FALLBACK_SCORE, 1) and second[0][0] not in ("far", "other")
    assert {r["target_id"] for r in rows} == {1, 2}
    only = pipeline.retrieve(targets, items, docs, sources=(" b ",)).where("target_id = 1").collect()
    assert [r["content_id"] for r in only] == ["then"]
    assert pipeline.retrieve(targets.limit(0), items, docs).count() == 0 and pipeline.retrieve(targets, items.limit(0), docs).count() == 0


def test_drugs_are_verified(spark):
    targets, items, docs = frames(spark, [(1, "Take losartan 50 mg.", None, None, None, None), (2, "x", None, "d0", None, None), (3, "x", None, "d5", None, None), (4, "x", None, "zz", None, None)])
    assert {r[0]: r[1] for r in pipeline.verified_drug(targets, docs, items).collect()} == {1: "Losartan", 2: "Losartan", 3: "Losartan", 4: None}


def test_compared_candidates_without_warning_come_first(spark):
    targets, items, docs = frames(spark, [(1, "Take losartan 50 mg once daily.", "Dosage", None, None, "own")])
    rows = pipeline.compare_ranked(targets, pipeline.retrieve(targets, items, docs)).orderBy("place").collect()
    flags = [r["warning"] is not None for r in rows]
    assert flags == sorted(flags) and rows[0]["similarity"] == 1.0 and "dose" in rows[0]["matched_aspects"]
    assert all(r["warning"] is not None for r in rows if r["content_id"] == "dose")


def test_section_filter_works_both_ways(spark):
    rows = spark.createDataFrame([(1, "a b", "Dosage and Administration"), (2, "a b", "dosage"), (3, "a b", "Warnings"), (4, "a b", None), (5, "a b", "")], "id long, t string, s string")
    q = spark.createDataFrame([(1, "a b", "Dosage"), (2, "a b", None)], "q long, t string, s string")
    assert {tuple(r)[:2] for r in search.cosine_top_k(rows, "id", "t", q, "q", "t", within=("s", "s")).collect()} == {(1, 1), (1, 2)}


def test_items_of_documents_take_the_first_branch(spark):
    docs = spark.createDataFrame([(i, f"D {i}", "S", None, None, t) for i, t in (("a", "x"), ("b", "x"), ("c", " text "), ("c", " text "), ("d", " "), (None, "x"))], "document_id string, document_name string, source string, source_identifier string, drug string, text string")
    blank = "chunk_id string, document_id string, section_id string, parent_chunk_id string, chunk_type string, order_index int, structure_path string, content string, document_fingerprint string, document_name string, document_type string, jurisdiction string, active_ingredient string, section_title string, section_number string, normalized_section string, source string, source_identifier string, version string, exact_location string, loinc_code string, page int"
    names = [c.split()[0] for c in blank.split(", ")]
    chunk = lambda **k: tuple(k.get(n) for n in names)
    chunks = spark.createDataFrame([chunk(chunk_id="k1", document_id="a", content="one"), chunk(chunk_id="k2", document_id="zz", content="two")], blank)
    sections = spark.createDataFrame([("a", "s0", None, "H", "body"), ("b", "s1", "2", "Dose", "body"), ("b", "s2", None, "Empty", None)], "document_id string, section_id string, section_number string, heading string, body string")
    got = {(r["content_id"], r["branch"], r["text"], r["exact_location"]) for r in adapt.documents_to_items(docs, chunks, sections).collect()}
    assert got == {("k1", "chunks", "one", None), ("s1", "sections", "body", "Section 2"), ("s2", "sections", "Empty", "Empty"), ("rc_c", "text", "text", None)}
    back = adapt.items_to_chunks(adapt.chunks_to_items(chunks, with_facts=False)).collect()
    assert {(r["chunk_id"], r["document_id"], r["content"]) for r in back} == {("k1", "a", "one"), ("k2", "zz", "two")}
    assert adapt.as_items(chunks).columns[0] == "content_id" and adapt.as_items(docs).columns == docs.columns


def test_files_become_documents(spark):
    files = [("/in/my_first label.MD", b"# Real Title\n\ntext"), ("c:\\x\\plain_notes.txt", b"Some  words"), ("two.txt", "Some words".encode()), ("empty.txt", b""), ("none.txt", None), ("bad.docx", b"PK no zip")]
    docs, sections = ingest.ingest(spark.createDataFrame([(p, bytearray(b) if b is not None else None) for p, b in files], "path string, content binary"))
    by = {r["source_url"]: r for r in docs.collect()}
    assert len(by) == 5 and by["file://my_first label.MD"]["document_name"] == "Real Title" and by["file://plain_notes.txt"]["document_name"] == "Plain Notes"
    assert by["file://plain_notes.txt"]["fingerprint"] == by["file://two.txt"]["fingerprint"] != by["file://empty.txt"]["fingerprint"]
    assert by["file://bad.docx"]["error"] and by["file://bad.docx"]["fingerprint"] != by["file://empty.txt"]["fingerprint"] and by["file://empty.txt"]["n_sections"] == 0
    assert len({r["document_id"] for r in by.values()}) == 5


def test_stores(spark, tmp_path):
    table = str(tmp_path / "bytes")
    rows = lambda *x: spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in x], "document_id string, content binary")
    assert store.retain(rows(("a", b"1"), ("b", b"22"), ("b", b"22"), (None, b"3"), ("c", None)), table).count() == 2
    assert [(r["document_id"], r["n_bytes"]) for r in store.retain(rows(("a", b"changed"), ("d", b"")), table).collect()] == [("d", 0)]
    assert {r["document_id"]: bytes(r["content"]) for r in spark.read.parquet(table).collect()} == {"a": b"1", "b": b"22", "d": b""}
    for _ in range(2):
        store.create_table(spark, "kept_events", "change_id STRING, pos INT, kind STRING", str(tmp_path / "t"), ("kind",))
    spark.createDataFrame([("c", 1, "k"), ("c", 2, "k"), ("d", 3, "k")], "change_id string, pos int, kind string").write.insertInto("kept_events")
    assert [r["pos"] for r in store.events_of(spark.table("kept_events"), "change_id", "c", "pos").collect()] == [1, 2]
    assert [r["pos"] for r in store.events_of(spark.table("kept_events"), "change_id", "c", "pos", 1).collect()] == [2]
    spark.sql("drop table kept_events")
    store.write_json(spark.createDataFrame([("a", None)], "k string, v string"), str(tmp_path / "j"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"k":"a","v":null}']
