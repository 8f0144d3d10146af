from lexforge.operators import compare, search, store
from lexforge.sources import ingest
from pyspark.sql import functions as F

ROWS = [("a", "f1", 1, "old"), ("a", "f2", 2, "new"), ("b", "f2", 3, "copy"), ("c", None, 1, "x"), ("d", None, 1, None), (None, "f9", 9, "y"), ("e", "f5", None, "z")]


def table(spark):
    return spark.createDataFrame(ROWS, "id string, fp string, at int, note string")


def test_register(spark):
    kept = {(r["id"], r["fp"], r["note"]) for r in store.register(table(spark), "id", "fp", "at").collect()}
    assert kept == {("b", "f2", "copy"), ("c", None, "x"), ("d", None, None), ("e", "f5", "z")}
    assert store.register(table(spark).limit(0), "id", "fp", "at").count() == 0


def test_upsert_remove_latest(spark):
    rows = {r["id"]: (r["at"], r["fp"], r["note"]) for r in store.upsert(table(spark), "id", "at", ("note",)).collect()}
    assert rows["a"] == (2, "f2", "old") and set(rows) == {"a", "b", "c", "d", "e"}
    gone = spark.createDataFrame([("a",), ("zz",), (None,)], "id string")
    assert {r["id"] for r in store.remove(table(spark), "id", gone).collect()} == {"b", "c", "d", "e", None}
    assert [r["at"] for r in store.latest(table(spark), "at", 2, "id is not null").collect()] == [3, 2]


def test_derived_queries(spark):
    df = spark.createDataFrame([("D", "I", "S", "t"), (" ", None, "S", "t"), (None, None, None, "the quick brown42 foxes jumped over"), (None, None, None, "a b"), (None, None, None, None)], "d string, i string, s string, t string")
    assert [r[0] for r in df.select(search.derived_query(*[F.col(c) for c in "dist"])).collect()] == ["D", "S", "quick foxes jumped", "a b", None]
    assert [r[0] for r in spark.createDataFrame([("Dosage",), ("2. Use",), ("Losartan",), (None,)], "n string").select(search.is_section_heading(F.col("n"))).collect()] == [True, True, False, False]


def test_adapted_texts(spark):
    df = spark.createDataFrame([("Take 10 mg of Losartan. LOSARTAN works.", "10 mg", "20 mg", "losartan", "Co$t\\x"), ("Take 5 mg", "5 mg", None, None, "x"), ("same 5 MG", "5 mg", "5 MG", "d", "d"), (None, "a", "b", "c", "d")], "t string, a string, b string, c string, d string")
    got = [r[0] for r in df.select(compare.adapted(*[F.col(c) for c in "tabcd"])).collect()]
    assert got == ["Take 20 mg of Co$t\\x. Co$t\\x works.", "Take 5 mg", "same 5 MG", None]


def test_segments_and_spl(spark):
    text = "Preface\n1 INDICATIONS AND USAGE:\nFor pain.\n\nOverdosage\n  \nCONTRAINDICATIONS\n" + "x" * 6000
    df = spark.createDataFrame([(1, text), (2, "plain"), (3, " "), (4, None)], "id int, t string")
    got = [(r["document_id"], r["segment_no"], r["section"], len(r["text"])) for r in ingest.standard_segments(df, "id", "t").orderBy("document_id", "segment_no").collect()]
    assert got == [(1, 0, "Indications And Usage", 9), (1, 2, "Contraindications", 5000), (2, 0, "General Content", 5)]
    xml = b"<document><section><title>A</title><text><paragraph>long enough to be kept</paragraph></text></section><section><title>B</title><text>short</text></section></document>"
    files = spark.createDataFrame([("p", xml), ("q", b"<broken")], "path string, content binary")
    assert [(r["section"], r["text"]) for r in ingest.spl_items(files).collect()] == [("A", "long enough to be kept")]


def test_jaccard(spark):
    rows = spark.createDataFrame([(1, "alpha beta gamma the"), (2, "alpha"), (3, None), (4, "")], "id long, t string")
    q = spark.createDataFrame([(7, "alpha beta with"), (8, None), (9, "the and")], "q long, s string")
    assert [tuple(r) for r in search.jaccard_top_k(rows, "id", "t", q, "q", "s").orderBy("rank").collect()] == [(7, 1, 0.6667, 1), (7, 2, 0.5, 2)]
