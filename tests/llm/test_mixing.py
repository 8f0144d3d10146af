import base64
import functools
import os

import pytest
from lexforge.llm import mixing as M
from pyspark.sql import functions as F

pytestmark = pytest.mark.skipif(not os.path.exists(M.VOCABULARY), reason="no vocabulary")


@functools.cache
def encoding():
    import tiktoken

    with open(M.VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=M.PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokens(text):
    return len(encoding().encode_ordinary(text))


def docs(spark):
    rows = [(i, f"document {i} " + "word " * (i % 17), "Big" if i % 3 else (" small " if i % 2 else "SMALL"), None) for i in range(400)]
    rows += [(1000, None, "big", None), (None, "text", "big", None), (1001, "", "big", None), (1002, "x", None, None), (1003, "x", "unknown", None), (5, "document 5 " + "word " * 5, "Big", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, uses int"), rows


@pytest.mark.parametrize(("budget", "range_rows"), [(None, 50_000), (None, 13), (900, 7), (0, 10)])
def test_equals_plain_prefix_sums(spark, budget, range_rows):
    df, rows = docs(spark)
    targets = spark.createDataFrame([("big", 0.4, 1), ("Small", 0.5, 4), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    uses, shares = M.mix(df, "doc_id", "text", "source", targets, budget=budget, range_rows=range_rows)
    keys = {r[0]: r[1] for r in df.where("doc_id is not null").select("doc_id", F.xxhash64(F.lit(0), "doc_id")).collect()}
    by = {"big": {}, "small": {}}
    for i, t, s, _ in rows:
        if i is not None and t and s and s.strip().lower() in by:
            by[s.strip().lower()][i] = tokens(t)
    plan = {"big": (0.4, 1), "small": (0.5, 4)}
    total = min(sum(by[s].values()) * m / w for s, (w, m) in plan.items())
    total = total if budget is None else min(budget, total)
    expected = {}
    for s, (w, m) in plan.items():
        epochs, rest = divmod(min(int(w * total), m * sum(by[s].values())), sum(by[s].values()))
        run = 0
        for i in sorted(by[s], key=lambda x: (keys[x], x)):
            run += by[s][i]
            if epochs + (run <= rest):
                expected[i] = epochs + (run <= rest)
    assert {r["doc_id"]: r["uses"] for r in uses.collect()} == expected
    report = {r["source"]: r for r in shares.collect()}
    assert set(report) == {"big", "Small", "absent"} and report["absent"]["n_tokens"] == 0
    assert all(report[s]["most_uses"] <= m for s, m in (("big", 1), ("Small", 4)))
    if budget is None:
        assert abs(report["Small"]["actual_share"] - 5 / 9) < 0.05 and abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9


def test_empty(spark):
    df, _ = docs(spark)
    targets = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    uses, shares = M.mix(df.limit(0), "doc_id", "text", "source", targets)
    assert uses.count() == 0 and shares.first()["actual_share"] == 0.0
    assert M.mix(df, "doc_id", "text", "source", targets.limit(0))[0].count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello <|endoftext|> wörld"), (2, None), (3, "")], "id int, text string")
    assert {r["id"]: r["n_tokens"] for r in M.count_tokens(df, "text").collect()} == {1: tokens("Hello <|endoftext|> wörld"), 2: None, 3: 0}
