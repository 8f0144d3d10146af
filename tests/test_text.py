import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from lexforge.functions import outline
from lexforge.functions import text as X
from pyspark.sql import functions as F

LINES = [
    "## 4.2 Posology", "# Title", "4.2 Posology and method", "Section 2. Dosage", "1. Name", "INDICATIONS AND USAGE", "Therapeutic indications:", "ORAL", "WARNINGS", "A B C D E F G H I J K", "Not a heading.", "", "   ", "x" * 250,
    "- bullet", "• point", "(a) lettered", "iv) roman", "12. number", "1.5 mg daily", "B. item", "#no space", "ÜBERSICHT DER DATEN", "1 x", "– dash item", "overdose", "4.2.1- deep title",
]


def test_headings_and_items_agree_with_python(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)] + [(99, None)], "i int, line string")
    for r in df.select("i", "line", X.heading(F.col("line")).alias("h"), X.list_item(F.col("line")).alias("item")).collect():
        if r["line"] is None:
            assert r["h"] is None and r["item"] is None
            continue
        h, item = outline.heading(r["line"]), outline.list_item(r["line"])
        assert (h is None) == (r["h"] is None), r["line"]
        if h:
            assert (h.number, h.title, h.level, h.concept) == (r["h"]["section_number"], r["h"]["title"], r["h"]["level"], r["h"]["concept"]), r["line"]
        assert (tuple(r["item"]) if r["item"] else None) == item, r["line"]


def test_fingerprints(spark):
    texts = ["A  b\r\nc", "A b c", "“q” – x", '"q" - x', "--- [Page 3] ---\nA b c", "", None, "No digital text layer detected. Image-only PDF", "x" * 300_000]
    out = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(X.fingerprint(F.col("t"))).collect()]
    empty = "fp_" + hashlib.sha256(b"").hexdigest()[:16]
    assert out[0] == out[1] == out[4] == "fp_" + hashlib.sha256(b"A b c").hexdigest()[:16]
    assert out[2] == out[3] and out[5] == out[6] == out[7] == empty


def test_normal_forms_and_tokens(spark):
    df = spark.createDataFrame([("  • Take  “10 mg” DAILY.", "Losartan Potassium tablets"), ("", None), (None, "")], "t string, d string")
    rows = df.select(X.conservative(F.col("t")), X.numeric_tokens(F.col("t")), X.drug_token(F.col("d")), X.content_words(F.col("t")), X.blank_words(F.col("t"))).collect()
    assert tuple(rows[0])[:3] == ('take "10 mg" daily', ["10mg"], "losartan") and rows[0][3] == ["take", "daily"] and len(rows[0][4]) == 5
    assert rows[1][0] == "" and rows[1][2] == "" and rows[1][4] == []
    assert rows[2][0] is None and rows[2][1] is None


def test_embedding_bits(spark):
    words = ["dose", "Größe", "10", "été", "x" * 1000]
    for w, d, s in spark.createDataFrame([(w,) for w in words], "w string").select("w", X.embedding_dim(F.col("w")), X.embedding_sign(F.col("w"))).collect():
        h = int(hashlib.md5(w.encode()).hexdigest(), 16)
        assert d == h % 256 and s == (1 if (h >> 8) % 2 == 0 else -1)


def test_sentences():
    text = "Give 2.5 mg. daily of Drug A. See e.g. Sec. 4 for more! Is it safe? Yes (it is).\n1. first item.\nDr. No said so."
    assert [s for _, _, s in outline.sentences(text)] == ["Give 2.5 mg. daily of Drug A.", "See e.g. Sec. 4 for more!", "Is it safe?", "Yes (it is).", "1. first item.", "Dr. No said so."]


@given(st.text(alphabet="ab.?! \n1AZ)\"", max_size=80))
@settings(max_examples=200, deadline=None)
def test_sentences_keep_everything(text):
    spans = outline.sentences(text)
    assert re.sub(r"\s", "", "".join(s for _, _, s in spans)) == re.sub(r"\s", "", text)
    assert all(text[a:b] == s for a, b, s in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
