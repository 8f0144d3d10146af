import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexforge.llm import splitting
from pyspark.sql import functions as F


def check(text, limit, overlap):
    pieces = splitting.cuts(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    overlap = max(0, min(overlap, (max(1, limit) - 1) // 2))
    for a, b in pieces:
        assert b - a <= max(1, limit) or len(pieces) == 1 == (len(text) <= limit)
    for (_, b), (a2, b2) in zip(pieces, pieces[1:]):
        assert a2 == max(0, b - overlap) and b2 > b
    return pieces


@given(st.text(alphabet="ab .\n!é漢。́", max_size=600), st.integers(1, 120), st.integers(0, 60))
@settings(max_examples=300, deadline=None)
def test_pieces_cover_the_text(text, limit, overlap):
    check(text, limit, overlap)


def sentences(n, salt=""):
    return " ".join(f"Sentence {salt}{i * 7919 % 1000} of the long text says {i * 31 % 97} things about {chr(97 + i % 26) * 5}." for i in range(n))


def test_natural_boundaries():
    text = sentences(200)
    pieces = check(text, 600, 60)
    assert len(pieces) > 15 and all(text[:b].rstrip().endswith(".") for _, b in pieces)


def test_text_without_boundaries():
    pieces = check("x" * 10_000, 500, 50)
    assert len(pieces) >= 20
    check("á" * 5000, 500, 50)
    assert not any(("á" * 5000)[b : b + 1] == "́" for _, b in splitting.cuts("á" * 5000, 500, 50)[:-1])


def test_edits_stay_local():
    text = sentences(400)
    changed = text[:9000] + " An inserted remark." + text[9000:]
    before, after = ({t[a:b] for a, b in splitting.cuts(t, 800, 80)} for t in (text, changed))
    assert len(before - after) <= 4


def test_table(spark):
    limits = spark.createDataFrame([("paragraph", 50, 5), ("paragraph", 40, 4), ("heading", 10, 0), ("none", None, 0)], "record_kind string, max_chars int, overlap_chars int")
    rows = [("a", "p. " * 20, None, 1), ("b", "h " * 20, "Heading", 1), ("c", "", "paragraph", 1), ("d", None, "paragraph", 1), (None, "x" * 99, None, 1), ("e", "y" * 999, "other", 1), ("f", "z" * 200_000, " ", None), ("a", "p. " * 20, None, 1)]
    df = spark.createDataFrame(rows, "id string, text string, kind string, max_chars int")
    out = splitting.split_oversized(df, "id", "text", limits, "kind").collect()
    n = {i: sum(1 for r in out if r["record_id"] == i) for i in "abcdef"}
    assert n["c"] == 1 and n["d"] == 0 and n["e"] == 1 and n["b"] > 3 and n["f"] > 5000 and n["a"] % 2 == 0
    assert all(len(r["piece"]) <= 40 and r["piece"] == (r["piece"] or "") for r in out if r["record_id"] in "af")
    joined = "".join(r["piece"][0 if r["piece_no"] == 0 else 4 :] for r in sorted((r for r in out if r["record_id"] == "f"), key=lambda r: r["piece_no"]))
    assert joined == "z" * 200_000
    only = splitting.split_oversized(df, "id", "text", limits, "kind", keep_whole=False)
    assert {r[0] for r in only.select("record_id").distinct().collect()} == {"a", "b", "f"}
    assert splitting.split_oversized(df.limit(0), "id", "text", limits, F.lit("paragraph")).count() == 0


def test_impossible_overlaps_are_refused(spark):
    df = spark.createDataFrame([("a", "x " * 99)], "id string, text string")
    limits = lambda overlap: spark.createDataFrame([("paragraph", 40, overlap)], "record_kind string, max_chars int, overlap_chars int")
    assert splitting.split_oversized(df, "id", "text", limits(19), F.lit("paragraph")).count() > 5
    with pytest.raises(ValueError):
        splitting.split_oversized(df, "id", "text", limits(20), F.lit("paragraph"))


def test_edits_stay_local_in_many_texts():
    r = random.Random(4)
    worst = total = 0
    for n in range(40):
        text = "".join(f"{''.join(r.choices('abcdefgh ', k=r.randint(20, 120)))}{r.choice(['. ', '.\n', ';', '. '])}" for _ in range(150))
        at = r.randrange(len(text))
        changed = text[:at] + " An inserted remark. " + text[at:]
        before, after = ({t[a:b] for a, b in splitting.cuts(t, 400, 40)} for t in (text, changed))
        worst, total = max(worst, len(before - after)), total + len(before - after)
    assert worst <= 8 and total / 40 < 3
