import json

import numpy as np
import pytest
from lexforge.operators import dedup, ledger, metrics, search
from pyspark.sql import functions as F


def test_lexical_search(spark):
    items = spark.createDataFrame(
        [("a", "Losartan", None, None, "Dosage", None, "take losartan daily"), ("b", None, None, None, None, None, "nothing here"), ("c", None, None, None, None, None, None), ("d", None, "losartan plus", None, "Warnings", None, "other words")],
        "content_id string, drug string, product string, indication string, section string, subsection string, text string",
    )
    q = spark.createDataFrame([(1, "Losartan", "dosage", None), (2, None, None, None), (3, "  ", "", "other words")], "query_id long, query string, section string, target_text string")
    out = {(r["query_id"], r["content_id"]): r["score"] for r in search.lexical_search(items, q).collect()}
    # an empty section of an item is contained in every section
    assert out[1, "a"] == 4 + 5 + 1.5 + 2.5 and out[1, "d"] == 3 and out[1, "b"] == 2.5 and (1, "c") not in out
    assert out[2, "a"] == out[2, "b"] == out[2, "d"] == 1 and out[3, "d"] == 3 and (3, "a") not in out
    assert search.lexical_search(items, q.limit(0)).count() == 0 and search.lexical_search(items.limit(0), q).count() == 0
    with pytest.raises(ValueError):
        search.lexical_search(items, q, max_queries=2)


def test_cosine_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (60, 8)).astype(float)
    v /= np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))
    rows = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)] + [(99, None, 0)], "vec_id long, e array<double>, label int").repartition(5)
    q = rows.where("vec_id < 4").select(F.col("vec_id").alias("q"), "e", "label")
    for match in (None, ("label", "label")):
        got = {(r["q"], r["rank"]): (r["vec_id"], r["similarity"]) for r in search.cosine_top_k(rows, "vec_id", "e", q, "q", "e", k=6, threshold=0.0, match=match).collect()}
        for i in range(4):
            sims = sorted(((-round(float(max(0, min(1, v[i] @ v[j]))), 4), j) for j in range(60) if not match or j % 3 == i % 3))[:6]
            assert [got[i, r + 1] for r in range(6)] == [(j, -s) for s, j in sims]
    assert search.cosine_top_k(rows.limit(0), "vec_id", "e", q, "q", "e").count() == 0
    assert search.cosine_top_k(rows, "vec_id", "e", q.limit(0), "q", "e").count() == 0


def test_phrases_and_exclusion(spark):
    rows = spark.createDataFrame([(1, "Take  TWO\ntablets daily"), (2, None), (3, ""), (4, "z" * 300_000 + " take two")], "id long, t string")
    phrases = spark.createDataFrame([(7, "take two"), (8, "TABLETS"), (9, " "), (10, None)], "p long, s string")
    assert {tuple(r) for r in search.phrase_matches(rows, "id", "t", phrases, "p", "s").collect()} == {(7, 1), (8, 1), (7, 4)}
    df = spark.createDataFrame([("d", None, "c1", "d", "f", "c2"), ("d", "f", "c1", "e", "f", "c2"), (None, None, "c", None, None, "c"), (None, None, "a", None, None, "b")], "a string, b string, c string, d string, e string, f string")
    assert [r[0] for r in df.select(search.excluded(*[F.col(c) for c in "abcdef"])).collect()] == [True, True, True, False]


ITEM = "content_id string, source string, document_id string, source_identifier string, section string, drug string, page int, text string"


def merged(spark, rows):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], f"g int, pos int, {ITEM}")
    return [(r["content_id"], r["cross_sources"], r["duplicate_ids"]) for r in dedup.merge_greedily(df, "g", "pos").orderBy("pos").collect()]


def test_greedy_merge(spark):
    words = "one two three four five six seven eight nine ten eleven twelve"
    assert merged(spark, [("a", "S1", "d1", None, None, "Losartan", None, "Take 10 mg."), ("b", "S2", "d2", None, None, "losartan potassium", 4, "- take  10 mg")]) == [("b", "S1|S2", "a")]
    assert len(merged(spark, [("a", "S", "d", None, None, "X", None, "Take 10 mg"), ("b", "S", "d", None, None, "X", None, "Take 20 mg")])) == 2
    assert len(merged(spark, [("a", "S", "d", None, None, "Sertraline", None, "same text"), ("b", "S", "d", None, None, "Losartan", None, "same text")])) == 2
    assert len(merged(spark, [("a", "S", "d", None, "Indications", None, None, "same text"), ("b", "S", "d", None, "Warnings", None, None, "same text")])) == 2
    assert len(merged(spark, [("a", "S", "d", None, None, None, None, words), ("b", "S", "e", None, None, None, None, words + " also")])) == 1
    assert len(merged(spark, [("a", "S", "d", None, None, None, None, None), ("b", "S", "e", None, None, None, None, "")])) == 2
    three = merged(spark, [("a", "A", "d", None, None, "X", None, "Same text"), ("b", "B", "e", None, None, "X", None, "same text."), ("c", "InternalDraft", "f", None, None, "X", 4, "same  text")])
    assert three == [("c", "A|B|InternalDraft", "a|b")]


def test_pair_rule_agrees_with_merge(spark):
    rows = [("a", "S", "d", "i", "Sec", "X y", None, "one two three four five"), ("b", "S", "d", "i", "Sec", "X", None, "one two three four six"), ("c", "S", "e", "j", "Dosage", "X", None, "one two three four five"), ("d", "S", "e", "j", "Contraindications", "X", None, "one two three four five")]
    df = dedup.prepared(spark.createDataFrame(rows, ITEM))
    p = df.select(F.struct("*").alias("a")).crossJoin(df.select(F.struct("*").alias("b"))).where("a.content_id < b.content_id")
    got = {(r[0], r[1]): r[2] for r in p.select("a.content_id", "b.content_id", dedup.are_duplicates("a", "b")).collect()}
    assert got == {("a", "b"): False, ("a", "c"): True, ("a", "d"): True, ("b", "c"): False, ("b", "d"): False, ("c", "d"): False}


def chain(spark, n=5):
    rows = [(f"c{i % 2}", None, {"k": 'a"b\\\té'} if i % 3 else None, f"e{i:02d}", "T", None, None, "2024-01-01", None, None, None, "ré", i) for i in range(n)]
    schema = ", ".join(f"{f} {'map<string,string>' if f == 'details' else 'string'}" for f in ledger.FIELDS) + ", pos int"
    return spark.createDataFrame(rows, schema)


def test_ledger(spark):
    built = ledger.build_chain(chain(spark, 9), "change_id", "pos")
    assert {(r["valid"], r["n_events"]) for r in ledger.verify(built, "change_id").collect()} == {(True, 5), (True, 4)}
    one = built.where("change_id = 'c0' and seq = 1").first()
    payload = {f: one[f] for f in ledger.FIELDS} | {"details": dict(one["details"] or {}), "previous_event_hash": ""}
    import hashlib

    assert one["event_hash"] == hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest() and one["previous_event_hash"] is None
    bad = {
        "wrong hash": built.withColumn("event_type", F.when(F.col("event_id") == "e04", "X").otherwise(F.col("event_type"))),
        "broken link": built.withColumn("previous_event_hash", F.when(F.col("event_id") == "e04", "0").otherwise(F.col("previous_event_hash"))),
        "genesis has a link": built.withColumn("previous_event_hash", F.when(F.col("event_id") == "e00", "0").otherwise(F.col("previous_event_hash"))),
    }
    for reason, df in bad.items():
        r = ledger.verify(df, "change_id").where("not valid").first()
        assert r["reason"] == reason and r["first_bad_id"] == ("e00" if "genesis" in reason else "e04")
    assert ledger.build_chain(chain(spark, 3).limit(0), "change_id", "pos").count() == 0


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False)], "q int, rank int, is_relevant boolean")
    sizes = spark.createDataFrame([(1, 4), (2, 1), (3, 0)], "q int, n_relevant int")
    rows = {r["q"]: tuple(r)[1:] for r in metrics.retrieval_metrics(ranked, sizes, "q", 3).collect()}
    assert rows == {1: (0.5, 0.6667, 1.0, 0.5), 2: (0.0, 0.0, 0.0, 0.0), 3: (1.0, 0.0, 0.0, 0.0)}
    df = spark.createDataFrame([("a  B", "x A b y"), (None, "x"), ("", "x"), ("q" * 60, "q" * 50)], "q string, s string")
    assert [r[0] for r in df.select(metrics.grounded(F.col("q"), F.col("s"))).collect()] == [True, False, False, True]


def test_pairs_of_whole_tables_equal_brute_force(spark):
    import random

    r = random.Random(2)
    vocabulary = [f"w{c}{d}" for c in "abcdefgh" for d in "xyz"]
    rows = []
    for i in range(120):
        if rows and r.random() < 0.7:
            words = r.choice(rows)[-1].split()
            for _ in range(r.randint(0, 2)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
        else:
            words = r.choices(vocabulary, k=r.choice([4, 12, 20]))
        rows.append((f"c{i % 110}", "S", "d", r.choice(["i", "j", None]), r.choice(["Dosage", "Warnings", None]), r.choice(["X", "Y", None]), None, " ".join(words)))
    df = dedup.prepared(spark.createDataFrame(rows, ITEM)).withColumn("g", F.lit(1)).withColumn("n", F.xxhash64("content_id", "text", "drug", "section", "source_identifier"))
    df = df.dropDuplicates(["n"])
    both = df.select(F.struct("*").alias("a")).crossJoin(df.select(F.struct("*").alias("b"))).where("a.n < b.n")
    want = {(x[0], x[1]) for x in both.where(dedup.are_duplicates("a", "b")).select("a.n", "b.n").collect()}
    got = [(x[1], x[2]) for x in dedup.duplicate_pairs(df, "g", "n").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30
    assert dedup.near_classes(spark.createDataFrame(rows, ITEM)).where("n_links > 0").count() > 10


def test_merging_takes_what_the_leader_lacks(spark):
    rows = [(1, 1, "a", "S", "d1", None, None, "X", None, "same text"), (1, 2, "b", "T", "d2", "i", "Sec", "X", 7, "same text"), (1, 3, "c", "S", "d3", None, None, "X", 9, "Same text."), (1, 4, "e", "S", "d4", None, None, "X", 1, "another"), (2, 1, "a", "S", "d1", None, None, "X", None, "same text")]
    got = {(r["g"], r["content_id"]): (r["section"], r["page"], r["cross_sources"], r["duplicate_ids"]) for r in dedup.merge_greedily(spark.createDataFrame(rows, f"g int, pos int, {ITEM}"), "g", "pos").collect()}
    assert got == {(1, "b"): ("Sec", 7, "S|T", "a|c"), (1, "e"): (None, 1, "S", ""), (2, "a"): (None, None, "S", "")}
    assert dedup.merge_greedily(spark.createDataFrame([], f"g int, pos int, {ITEM}"), "g", "pos").count() == 0


def test_query_blocks_change_nothing(spark):
    r = [(i, f"alpha{i % 7} beta{i % 5} gamma delta{i % 3}") for i in range(60)]
    rows, queries = spark.createDataFrame(r + r[:9], "id long, t string"), spark.createDataFrame([(i, t) for i, t in r[:20]], "q long, s string")
    for search_by in (lambda b: search.jaccard_top_k(rows, "id", "t", queries, "q", "s", block=b), lambda b: search.cosine_top_k(rows, "id", "t", queries, "q", "s", block=b), lambda b: search.phrase_matches(rows, "id", "t", queries, "q", "s", block=b)):
        whole, parts = ({tuple(x) for x in search_by(b).collect()} for b in (1000, 6))
        assert whole == parts and whole
    top = search.jaccard_top_k(rows, "id", "t", queries, "q", "s", k=3).groupBy("q").count().collect()
    assert {x[1] for x in top} == {3} and len(top) == 20


def test_impact_follows_the_review(spark, tmp_path):
    """Occurrences count once confirmed; before any review all count; excluded ones never do."""
    from lexforge.plans import retrieval_queries

    occ = lambda section, status=None, doc=None: {"section": section, "status": status, "document_name": doc}
    data = [
        ("open", {"section": "Dose", "document_name": "D", "related_occurrences": [occ("A"), occ("B", "PENDING", "E")]}),
        ("begun", {"section": "Dose", "related_occurrences": [occ("A", "CONFIRMED", "E"), occ("B", "PENDING", "F"), occ("C", "EXCLUDED")]}),
        ("out", {"section": "Dose", "related_occurrences": [occ("A", "EXCLUDED")]}),
        ("none", {"section": "Dose", "related_occurrences": []}),
    ]
    spark.createDataFrame([(k, json.dumps(v)) for k, v in data], "change_id string, data string").write.parquet(str(tmp_path / "proposals.parquet"))
    got = {r["record_id"]: (r["reviewed"], r["sections"], r["documents"], r["n_contents"], r["n_pending"]) for r in retrieval_queries.change_impact(spark, str(tmp_path)).collect()}
    assert got == {"open": (False, "A|B|Dose", "D|E", 3, 0), "begun": (True, "A|Dose", "E", 2, 1), "out": (True, "Dose", "", 1, 0), "none": (False, "Dose", "", 1, 0)}
