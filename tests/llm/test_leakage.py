import random

import numpy as np
import pytest
from lexforge.llm import leakage as L


def brute(docs, items):
    """Every alignment of every item and document, at several penalties."""
    out = set()
    for d, t in docs:
        if d is None or t is None:
            continue
        for i, *texts in items:
            for x in texts:
                words = L.words_of(x or "")
                place = {w: k + 1 for k, w in enumerate(dict.fromkeys(words))}
                a, b = np.array([place[w] for w in words]), np.array([place.get(w, 0) for w in L.words_of(t)])
                if len(a) and len(b) and any(L.covers(L.align(a, b, p), len(a), 0.5, 8) for p in (3, 5)):
                    out.add((d, i))
    return out


def edit(r, words, vocabulary, n):
    for _ in range(n):
        k = r.randrange(len(words))
        words = words[:k] + r.choice([[], [r.choice(vocabulary)], [words[k], r.choice(vocabulary)]]) + words[k + 1 :]
    return words


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(150)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([6, 14, 24, 40]))), None if i % 3 else " ".join(r.choices(vocabulary, k=20))) for i in range(25)]
    docs = []
    for d in range(120):
        words = r.choices(vocabulary, k=r.randint(0, 60))
        if d % 2:
            source = r.choice([x for x in r.choice(items)[1:] if x]).split()
            size = r.randint(len(source) // 3, len(source))
            start = r.randint(0, len(source) - size)
            k = r.randint(0, len(words))
            words = words[:k] + edit(r, source[start : start + size], vocabulary, r.randint(0, max(1, size // 6))) + words[k:]
        text = r.choice([" ", "\n", " - "]).join(w.upper() if r.random() < 0.1 else w for w in words)
        docs.append((d, text.replace("word1", "wo­rd1")))
    docs += [(900, None), (None, docs[1][1]), (901, ""), (902, "?!"), docs[1], (903, "filler " * 40_000 + items[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", L.F.lit("clash"))
    it = spark.createDataFrame(items + [(None, "word1 word2 word3", None), (50, None, "")], "item_id long, a string, b string")
    got = [tuple(x) for x in L.find_leaks(df, "doc_id", "text", it, "item_id", ["a", "b"]).collect()]
    expected = brute([x for x in docs if x[0] != 903], items) | {(903, 3)}
    assert len(got) == len(set(got)) and {x for x in got if x[0] != 903} | {(903, 3)} == expected and (903, 3) in got and len(expected) > 30


def test_empty_sides(spark):
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    it = spark.createDataFrame([(1, "a b c d e f")], "item_id long, a string")
    assert L.find_leaks(df.limit(0), "doc_id", "text", it, "item_id", ["a"]).count() == 0
    assert L.find_leaks(df, "doc_id", "text", it.limit(0), "item_id", ["a"]).count() == 0
    with pytest.raises(ValueError):
        L.find_leaks(df, "doc_id", "text", it, "item_id", ["a"], max_items=0)


def test_seeds_suffice():
    assert L.seed_length(40, 0.5, 8) == 6 and L.seed_length(1, 0.5, 8) == 1 and L.seed_length(0, 0.5, 8) == 0
    for n in (8, 20, 36):
        k = L.seed_length(n, 0.5, 8)
        everything = list(range(n - k + 1))
        assert L.certain(everything, k, n, 0.5, 8)
        r = random.Random(n)
        frequency = [r.choice([0, 5, 1000]) for _ in everything]
        chosen = L.choose_seeds(frequency, k, n, 0.5, 8)
        assert L.certain(chosen, k, n, 0.5, 8)


def test_words():
    assert L.words_of("Night-shift, ﬁne HYPO­kal​emia_x 2.5") == ["night", "shift", "fine", "hypokalemia", "x", "2", "5"]


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_verification_equals_edit_distance():
    item = np.arange(1, 17)
    doc = np.array([0, 0, 1, 0, 3, 4, 5, 6, 7, 8, 0, 0])
    assert L.leaks(item, doc, [(2, 4)], 0.5, 8, by_edits=True)
    rng = random.Random(5)
    seen = set()
    for _ in range(60):
        a = rng.randrange(0, 9)
        passage = list(range(a + 1, a + rng.randrange(7, 10)))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(passage))
            passage[at : at + 1] = rng.choice([[], [0], [passage[at], 0]])
        doc = [0] * rng.randrange(3) + passage + [0] * rng.randrange(3)
        want = any(_edits(range(i + 1, j + 1), doc[x:y]) * 8 <= j - i for i in range(16) for j in range(i + 8, 17) for x in range(len(doc)) for y in range(x + 1, len(doc) + 1) if abs((y - x) - (j - i)) <= 2)
        hits = [(w - 1, q) for q, w in enumerate(doc) if 0 < w <= 16]
        assert L.leaks(item, np.array(doc), hits, 0.5, 8, by_edits=True) == want, doc
        seen.add(want)
    assert seen == {True, False}


def exact(item, doc, share=0.5, one_in=8):
    """Whether some stretch of item stands in doc with few enough edits, by plain edit distances."""
    least = -int(-len(item) * share // 1)
    for a in range(len(item) - least + 1):
        row = [0] * (len(doc) + 1)
        for i, x in enumerate(item[a:], 1):
            last, row = row, [i]
            for j, y in enumerate(doc, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            if i >= least and min(row) * one_in <= i:
                return True
    return False


@pytest.mark.parametrize("size", [15, 60, 1000])
def test_borderline_passages_are_complete(spark, size):
    """Passages of just enough words with just as many edits as allowed, or one more, also in the last words."""
    r = random.Random(size)
    vocabulary = [f"v{i}" for i in range(size)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(8, 30)))) for i in range(60)]
    docs, source = [], {}
    for d in range(400):
        i, t = r.choice(items)
        words = t.split()
        least = -(-len(words) // 2)
        span = min(len(words), least + r.choice([0, 0, 0, 1, 4]))
        start = r.randint(0, len(words) - span)
        passage = words[start : start + span]
        for _ in range(span // 8 + r.choice([-1, 0, 0, 0, 1])):
            at = r.choice([r.randrange(len(passage)), max(0, len(passage) - r.randint(1, 4)), r.randrange(min(4, len(passage)))])
            passage[at : at + 1] = r.choice([[], ["x"], [r.choice(vocabulary)], [passage[at], "y"]])
        docs.append((d, " ".join([*r.choices(vocabulary, k=r.randint(0, 6)), *passage, *r.choices(vocabulary, k=r.randint(0, 6))])))
        source[d] = i
    by_id = dict(items)
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, a string")
    planted = {(d, i) for d, i in source.items() if exact(by_id[i].split(), docs[d][1].split())}
    for blocks in ({}, {"max_items": 25, "max_chars": 1000}):
        found = {tuple(x) for x in L.find_leaks(df, "doc_id", "text", it, "item_id", ["a"], by_edits=True, **blocks).collect()}
        assert planted <= found and len(planted) > 100 and len(planted) < 400
        assert all(exact(by_id[i].split(), docs[d][1].split()) for d, i in found)


def test_seed_choice_equals_the_definition():
    def spoilt(positions, length, low, high):
        count, last = 0, -1
        for p in positions:
            if p >= low and p + length <= high and p > last:
                count, last = count + 1, p + length - 1
        return count

    r = random.Random(3)
    for _ in range(200):
        n = r.randint(1, 40)
        k = L.seed_length(n, 0.5, 8)
        positions = sorted(r.sample(range(n - k + 1), r.randint(0, n - k + 1)))
        least = -(-n // 2)
        want = all(spoilt(positions, k, a, a + span) > span // 8 for span in range(least, n + 1) for a in range(n - span + 1))
        assert L.certain(positions, k, n, 0.5, 8) == want


def test_long_items_choose_quickly():
    n = 10_000
    k = L.seed_length(n, 0.5, 8)
    r = random.Random(1)
    chosen = L.choose_seeds([r.randrange(50) for _ in range(n - k + 1)], k, n, 0.5, 8)
    assert L.certain(chosen, k, n, 0.5, 8)
