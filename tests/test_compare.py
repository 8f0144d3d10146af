from lexforge.functions import extract as K
from lexforge.operators import compare as C
from pyspark.sql import functions as F


def facts(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(*K.key_information(F.col("t"))).first().asDict()


def test_key_information(spark):
    f = facts(spark, "Adults: take 250 to 500 mg of amoxicillin orally every 6 to 8 hours for 10 days, indicated for otitis media, acute.")
    assert (f["dose"], f["dose_unit"], f["frequency"], f["route"], f["population"], f["drug"]) == ("250 to 500 mg", "mg", "every 6 to 8 hours", "Oral", "Adults", "Amoxicillin")
    assert (f["duration"], f["indication"], f["purpose"]) == ("10 days", "otitis media", "Therapeutic Indication")
    assert facts(spark, "Give 5 mg of co-drug9 daily")["drug"] == "Co-Drug9"
    assert facts(spark, "Zyxolol 10 mg is given with Drug B")["drug"] == "Zyxolol" and facts(spark, "Drug B now")["product"] == "Drug B"
    assert facts(spark, "losartan and aspirin")["drug"] == "Aspirin"
    assert set(facts(spark, "").values()) == {None} and set(facts(spark, None).values()) == {None}


PAIRS = [
    ("same", "Take 20 mg of losartan orally once daily.", "Take 20 mg of losartan by mouth q.d.", ("MATCH", "MATCH", "MATCH"), False),
    ("unit", "Take 50 mg of losartan daily.", "Take 50 mcg of losartan daily.", ("MISMATCH", "MATCH", "MISMATCH"), True),
    ("drug", "Take aspirin daily.", "Take ibuprofen daily.", ("MISMATCH", "MATCH", "MISMATCH"), True),
    ("contra", "Indicated for pain.", "Contraindicated in asthma.", ("MISMATCH", "MISMATCH", "MATCH"), True),
    ("food", "Take with food.", "Take on an empty stomach.", ("MISMATCH", "MATCH", "MATCH"), False),
    ("group", "In pregnancy avoid use.", "In cirrhosis avoid use.", ("MISMATCH", "MISMATCH", "MATCH"), True),
    ("mode", "Tablets must be stored dry.", "Tablets may be stored dry.", ("PARTIAL", "MATCH", "MATCH"), False),
]


def test_dimensions(spark):
    df = spark.createDataFrame([p[:3] for p in PAIRS] + [("null", None, "x"), ("blank", "", "")], "id string, target_text string, candidate_text string").withColumn("a_note", F.lit(1))
    rows = {r["id"]: r for r in C.compare(df).collect()}
    for name, _, _, expected, false_match in PAIRS:
        r = rows[name]
        assert (r["meaning_status"], r["context_status"], r["key_information_status"]) == expected, name
        assert r["false_match"] is false_match and bool(r["false_match_reasons"]) is false_match, name
    assert rows["null"]["meaning_status"] is None and rows["null"]["differences"] is None
    assert rows["blank"]["structure_status"] == "MATCH"
    assert {(d["attribute"], d["current_value"], d["candidate_value"]) for d in rows["unit"]["differences"]} == {("dose_unit", "mg", "mcg")}
    assert C.compare(df.limit(0)).count() == 0


def test_structure_and_format(spark):
    df = spark.createDataFrame([("t", "a | b", "plain text"), ("b", "- item", "plain text"), ("q", "Give 5 mg", "Give some"), ("r", "Give 5 to 10 mg", "Give 5 mg")], "id string, target_text string, candidate_text string")
    rows = {r["id"]: (r["structure_status"], r["structure_score"], r["format_status"], r["format_score"]) for r in C.compare(df).collect()}
    assert rows["t"][:2] == ("MISMATCH", 0.40) and rows["b"][:2] == ("PARTIAL", 0.75) and rows["q"][2:] == ("PARTIAL", 0.60) and rows["r"][2:] == ("PARTIAL", 0.75)


def test_sections_decide_context(spark):
    df = spark.createDataFrame([("a", "x", "x", "Dosage", "Adverse reactions"), ("b", "x", "x", "Warnings", "Overdosage"), ("c", "x", "x", "Posology", "Administration")], "id string, target_text string, candidate_text string, s1 string, s2 string")
    rows = {r["id"]: r["context_score"] for r in C.compare(df, target_section="s1", candidate_section="s2").collect()}
    assert rows == {"a": 0.35, "b": 0.65, "c": 0.90}


def test_word_changes(spark):
    df = spark.createDataFrame([("p", "take one small tablet daily", "take three enormous capsules daily"), ("n", None, "x"), ("e", "same", "same")], "k string, target_text string, candidate_text string")
    assert [tuple(r) for r in C.word_changes(df, "k").collect()] == [("p", 0, "replace", "one small tablet", "three enormous capsules")]


def test_coarse_differences_and_aspects(spark):
    rows = [("n", "Wait 2 hours before use.", "Wait 3 hours before use."), ("l", "Keep dry.", "Keep dry, and keep it out of the light."), ("s", "Keep dry.", "Keep dry."), ("d", "Take 5 mg daily.", "Take 7 mg daily."), ("z", None, "x")]
    x = C.compare(spark.createDataFrame(rows, "id string, target_text string, candidate_text string"))
    x = x.select("id", C.coarse_differences(F.col("differences"), F.col("target_text"), F.col("candidate_text")).alias("d"), C.matched_aspects(F.col("target_text"), F.col("candidate_text")).alias("m"))
    got = {r["id"]: r for r in x.collect()}
    assert [(d["attribute"], d["current_value"], d["candidate_value"]) for d in got["n"]["d"]] == [("key_information", "2 hours", "3 hours")]
    assert [(d["attribute"], d["current_value"], d["candidate_value"]) for d in got["l"]["d"]] == [("structure", "9 characters", "39 characters")]
    assert got["s"]["d"] == [] and got["d"]["d"] == [] and not got["z"]["d"] and got["d"]["m"] == ["frequency"] and got["s"]["m"] == []


def test_overall_all_differences_and_evidence(spark):
    rows = [
        (1, "Take losartan 50 mg once daily.", "Take losartan 50 mg once daily."), (2, "Take losartan 50 mg once daily.", "Take metformin 50 mg once daily."),
        (3, "Take losartan 50 mg once daily.", "Take losartan 100 mg once daily after a very light breakfast meal."), (4, None, "x"), (5, "", ""),
    ]
    x = C.compare(spark.createDataFrame(rows, "id long, target_text string, candidate_text string"))
    said = {r[0]: r[1] for r in x.select("id", C.overall(C.warning(F.col("false_match_reasons")))).collect()}
    assert said[1] == C.STRONG and said[2].startswith(C.ALERT + "FALSE MATCH WARNING") and said[4] is None and said[5] is not None
    every = [tuple(r) for r in C.all_differences(x, "id").orderBy("id", "pos").collect()]
    assert not [d for d in every if d[0] in (1, 4)]
    third = [d[2] for d in every if d[0] == 3]
    assert "dose" in third and third[-1] in ("content", "format") and len(every) == len({d[:1] + d[2:5] for d in every})
    assert {r[0]: r[1] for r in C.all_differences(x, "id", most=1).groupBy("id").count().collect()} == {2: 1, 3: 1, 5: 1}
    e = x.where("id = 3").select(C.evidence(F.col("target_text"), F.col("candidate_text"), {"source": F.lit("S")}).alias("e")).select("e.observed.*", F.col("e.target.extracted_dose").alias("t")).first()
    assert (e["source"], e["extracted_dose"], e["t"], e["exact_quote"]) == ("S", "100 mg", "50 mg", rows[2][2])
