import os
import random

import pytest
from lexforge.llm import language as G
from pyspark.sql import functions as F

# invented sentences of the six languages, from parts
PARTS = {
    "en": ("The patient|The nurse|A doctor|The old sister", "should carefully follow|must never forget|often reads", "the printed advice|the morning treatment|these simple rules", "before the next visit|with a glass of water|during the whole week"),
    "de": ("Der Patient|Die Schwester|Ein Arzt|Die alte Frau", "sollte sorgfältig befolgen|darf niemals vergessen|liest häufig", "den gedruckten Hinweis|die morgendliche Behandlung|diese einfachen Regeln", "vor dem nächsten Besuch|mit einem Glas Wasser|während der ganzen Woche"),
    "fr": ("Le patient|La sœur|Un médecin|La vieille dame", "devrait suivre avec soin|ne doit jamais oublier|lit souvent", "le conseil imprimé|le traitement du matin|ces règles simples", "avant la prochaine visite|avec un verre d'eau|pendant toute la semaine"),
    "es": ("El paciente|La enfermera|Un médico|La señora mayor", "debería seguir con cuidado|nunca debe olvidar|lee a menudo", "el consejo impreso|el tratamiento de la mañana|estas reglas sencillas", "antes de la próxima visita|con un vaso de agua|durante toda la semana"),
    "pt": ("O paciente|A enfermeira|Um médico|A senhora idosa", "deveria seguir com cuidado|nunca deve esquecer|lê muitas vezes", "o conselho impresso|o tratamento da manhã|estas regras simples", "antes da próxima visita|com um copo de água|durante toda a semana"),
    "it": ("Il paziente|L'infermiera|Un medico|La signora anziana", "dovrebbe seguire con cura|non deve mai dimenticare|legge spesso", "il consiglio stampato|il trattamento del mattino|queste regole semplici", "prima della prossima visita|con un bicchiere d'acqua|durante tutta la settimana"),
}


def sentence(r, lang):
    return " ".join(r.choice(p.split("|")) for p in PARTS[lang]) + "."


def text(r, lang, n):
    return " ".join(sentence(r, lang) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(1)
    rows = []
    for i in range(360):
        lang = list(PARTS)[i % 6]
        label = r.choice(list(PARTS)) if r.random() < 0.15 else r.choice([lang, lang.upper(), G.NAMES[lang][1].title(), f"{lang}-XX"])
        rows.append((i, text(r, lang, 5), label, "clash"))
    df = spark.createDataFrame(rows, "id long, body string, label string, lang string")
    return G.train(df, "id", "body", "label", sample_docs=40)


def test_held_out_accuracy(model):
    r = random.Random(2)
    models = G.compressors(model)
    assert set(models) == set(PARTS)
    cases = [(lang, sentence(r, lang)) for lang in PARTS for _ in range(60)]
    found = G.classify([s for _, s in cases], models)
    assert sum(lang == f for (lang, _), (f, _) in zip(cases, found)) / len(cases) > 0.98


def test_documents(spark, model):
    r = random.Random(3)
    t = lambda lang, n: text(r, lang, n)
    rows = [
        (1, t("en", 4), "en_GB"), (2, t("en", 4), "de"), (3, t("fr", 3), None), (4, t("es", 3), "xx"), (5, t("de", 3) + " " + t("pt", 2), "German"), (6, t("it", 4) + " " + t("en", 1), "ita"),
        (7, "", "en"), (8, None, "en"), (9, "HEADING\n\n1. Title", "en"), (10, t("en", 1), None), (None, t("en", 3), "fr"), (11, t("pt", 4000), "por"), (12, t("fr", 2) + "\n\n" + t("fr", 2).upper(), "en"), (2, t("en", 4), "de"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = G.identify(df, "doc_id", "text", model, ("lang",))
    found = {tuple(x) for x in G.mislabelled(out, "doc_id", "lang").collect()}
    assert found == {(2, "en"), (3, "fr"), (4, "es"), (5, "de"), (5, "pt"), (12, "fr")}
    by = {x["doc_id"]: x for x in out.collect()}
    assert set(by) == {1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12} and by[7]["language"] is None and by[9]["segments"] == [] and by[11]["language"] == "pt"
    five = by[5]["segments"]
    assert [(s["seg_lang"], s["sentences"]) for s in five] == [("de", 3), ("pt", 2)] and five[0]["end_char"] <= five[1]["start_char"] and 0 < by[5]["confidence"] <= 1
    assert G.identify(df.limit(0), "doc_id", "text", model).count() == 0
    assert G.identify(df, "doc_id", "text", {}).where("language is not null").count() == 0


def test_labels(spark):
    labels = ["en", "EN-us", "eng", "English ", "de_DE", "ger", "xx", "und", "", None, "Portuguese", "nl"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, l string")
    assert [r[0] for r in df.orderBy("i").select(G.label_language(F.col("l"))).collect()] == ["en", "en", "en", "en", "de", "de", None, None, None, None, "pt", None]


def test_train_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", None)], "id long, body string, label string")
    assert G.train(df, "id", "body", "label") == {} and os.path.exists(G.__file__)


def test_short_sentences_are_joined_with_their_neighbours(spark, model):
    short = {"en": "The nurse reads.", "de": "Ein Arzt liest.", "fr": "Un médecin lit.", "it": "Un medico legge."}
    rows = [(lang, " ".join([s] * 50)) for lang, s in short.items()]
    rows += [("list", "- the old sister\n- before the next visit\n- these simple rules\n- morning treatment"), ("digits", "1. 2. 3. " * 30), ("lone", "Zq xw."), ("heading", "Overdosage"), ("none", " \n\n ")]
    df = spark.createDataFrame(rows, "id string, body string")
    by = {x["id"]: x for x in G.identify(df, "id", "body", model).collect()}
    for lang in short:
        assert by[lang]["language"] == lang, lang
        assert sum(s["end_char"] - s["start_char"] for s in by[lang]["segments"]) > 600
    assert by["list"]["language"] == "en"
    assert by["digits"]["segments"] == by["heading"]["segments"] == by["none"]["segments"] == []
    # too short to be judged: rejected, not lost
    assert by["lone"]["language"] is None and [(s["seg_lang"], s["start_char"], s["end_char"]) for s in by["lone"]["segments"]] == [(None, 0, 6)]
    assert G.mislabelled(G.identify(df, "id", "body", model).withColumn("l", F.lit(None).cast("string")), "id", "l").where("seg_lang is null").count() == 0


def test_batches_of_sentences_agree_with_single_ones(model):
    r = random.Random(9)
    models = G.compressors(model)
    pieces = [sentence(r, r.choice(list(PARTS))) for _ in range(200)]
    sizes = [[len(m.compress(p.lower().encode())) for m in models.values()] for p in pieces]
    best, gaps = G.judge(pieces, models)
    assert [s.index(min(s)) for s in sizes] == best.tolist()
    assert all(abs(g - (sorted(s)[1] - min(s)) / sorted(s)[1]) < 1e-12 for g, s in zip(gaps, sizes))
