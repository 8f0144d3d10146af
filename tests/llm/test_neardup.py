import itertools
import os
import random

import numpy as np
import pytest
from lexforge.llm import neardup as N

DATA = os.environ.get("NEARDUP_DATA", "/root/testdata/sf0.001")


def rows(seed, n=260):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of", "and", "in"] * 4
    out = []
    for i in range(n):
        drug = r.choice(["Alpha", "alpha tablets", "ALPHA sodium", "Beta", None, " "])
        if out and r.random() < 0.7:
            _, text, other = r.choice(out)
            drug = other if r.random() < 0.7 else drug
            words = text.split()
            for _ in range(r.randint(0, max(1, len(words) // 8))):
                k = r.randrange(len(words) + 1)
                words = words[:k] + r.choice([[], [r.choice(vocabulary)], [r.choice(vocabulary)]]) + words[k + r.randint(0, 1) :]
            r.shuffle(words) if r.random() < 0.3 else None
        else:
            words = r.choices(vocabulary, k=r.choice([3, 10, 20, 33, 34, 60, 120]))
        if r.random() < 0.05:
            words = [*words, str(r.choice([5, 10]))]
        text = " ".join(words)
        out.append((f"id{i:03d}", text.upper() if r.random() < 0.2 else text + r.choice(["", ".", " ", " "]), drug))
    return out


def brute(data, max_chars=2000):
    known = {N.drug_key(d) for _, _, d in data} - {None}
    items = []
    for i, t, d in data:
        if i is None or t is None or len(t) > max_chars:
            continue
        key = N.drug_key(d)
        if key is None:
            key = next((k for k in map(N.drug_key, t.lower().split()) if k in known), None)
        words = frozenset(w for w in map(N.bare, t.lower().split()) if w)
        if key and words:
            items.append((i, key, N.number_key(t), words))
    return {
        (min(a[0], b[0]), max(a[0], b[0]))
        for a, b in itertools.combinations(items, 2)
        if a[0] != b[0] and a[1:3] == b[1:3] and 5 * len(a[3] & b[3]) >= 4 * len(a[3] | b[3])
    }


@pytest.mark.parametrize(("seed", "small", "full", "balls"), [(1, 64, 1000, 2), (2, 1, 1000, 2), (3, 1, 3, 2), (4, 1, 2, 0), (5, 1, 2, 50)])
def test_equals_brute_force(spark, seed, small, full, balls):
    data = rows(seed)
    data += [data[0], data[1], ("id000", data[5][1], data[5][2]), ("nul", None, "Alpha"), (None, data[0][1], "Alpha"), ("empty", "", "Alpha"), ("dots", "... ,", "Alpha"), ("long", "x " * 1500, "Alpha"), ("named", "take beta w1 w2", None)]
    df = spark.createDataFrame(data, "id string, t string, d string").withColumn("words", N.F.lit(1))
    members, links = N.link_classes(N.fingerprints(df, "id", "t", "d"), small, full, balls)
    got = [tuple(r) for r in N.linked_pairs(members, links).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data) and len(got) > 40


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, t string, d string")
    assert N.linked_pairs(*N.link_classes(N.fingerprints(df, "id", "t", "d"))).count() == 0


def test_levels_leave_enough_segments():
    for n in range(1, 3000, 7):
        level = int(N.level_of(np.array([n]))[0])
        assert n <= 17 * 2**level - 1 and (level == 0 or n >= 17 * 2 ** (level - 1))
        for balls in (0, 2, 100):
            ones, zeros = N.segments_of(level, balls)
            assert zeros >= 0 and 2 * ones + zeros >= 2 * n // 9 + 3


def test_keys():
    assert N.drug_key("Lumtatriptol  Hydrochloride oral solution") == N.drug_key(" LUMTA-triptol ") == "lumtatriptol"
    assert N.drug_key("Sodium chloride") == "sodiumchloride" and N.drug_key(" ") is None
    assert N.number_key("1,000 mg, 2,50 or 2.5 and 07") == "1000 2.5 7"
    assert N.bare("(night-shift)…") == "night-shift" and N.bare("...") == ""


def pairs(spark, data, small=64, full=1000, balls=2, block=2000):
    df = spark.createDataFrame(data, "id string, t string, d string")
    got = [tuple(r) for r in N.linked_pairs(*N.link_classes(N.fingerprints(df, "id", "t", "d"), small, full, balls), block=block).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_drugs_of_several_words(spark):
    text = "Give {} to adults with care and watch the heart rate every morning and evening"
    names = [("acetyl salicylic acid", "acetyl salicylic acid"), ("Acetylsalicylic Acid tablets", "ACETYLSALICYLIC acid"), ("sodium chloride", "Sodium Chloride"), ("alpha beta gamma delta", "alpha sodium beta gamma-delta")]
    data = []
    for i, (name, mention) in enumerate(names):
        data += [(f"named{i}", text.format(mention), name), (f"open{i}", text.format(mention), None if i % 2 else " ")]
    data += [("short", text.format("alpha"), "alpha")]
    found = pairs(spark, data)
    assert {(f"named{i}", f"open{i}") for i in range(4)} <= found
    # the longest name at the first place: alpha is not what is meant
    assert ("open3", "short") not in found


@pytest.mark.parametrize(("full", "block"), [(2, 2), (5, 3), (1000, 2)])
def test_crowded_entries_lose_nothing(spark, full, block):
    """One block of boilerplate that differs in a few words: every table entry, and every pair of them, is full."""
    r = random.Random(full)
    letters = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    base = ["word" + letters(i) for i in range(40)]
    data = []
    for i in range(90):
        words = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 6])):
            words[r.randrange(40)] = "other" + letters(r.randrange(25))
        data.append((f"i{i:02d}", " ".join(words), "Alpha"))
    data += [(f"c{i:02d}", " ".join(base), "alpha") for i in range(7)]
    want = brute(data)
    assert pairs(spark, data, small=1, full=full, balls=2, block=block) == want and len(want) > 500


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_whole_table_equals_brute_force(spark):
    """All pairs of the whole table by comparing every two texts of equal drug and numbers (NEARDUP_DATA: another scale)."""
    rows = [tuple(x) for x in spark.read.parquet(f"{DATA}/content_items.parquet").select("content_id", "text", "drug").distinct().collect()]
    known = {N.drug_key(d) for *_, d in rows} - {None}
    blocks: dict[tuple, dict] = {}
    for i, t, d in rows:
        if i is None or t is None or len(t) > 2000:
            continue
        key = N.drug_key(d) or next((k for k in map(N.drug_key, t.lower().split()) if k in known), None)
        words = frozenset(w for w in map(N.bare, t.lower().split()) if w)
        if key and words:
            blocks.setdefault((key, N.number_key(t)), {}).setdefault(words, set()).add(i)
    want = set()
    for texts in blocks.values():
        for (a, ids_a), (b, ids_b) in itertools.combinations_with_replacement(texts.items(), 2):
            if 5 * len(a & b) >= 4 * len(a | b):
                want |= {(min(x, y), max(x, y)) for x in ids_a for y in ids_b if x != y}
    assert pairs(spark, rows) == want and len(want) > 100
