"""Evaluation texts leaking into training text (problem 6).

Rare n-gram seeds join documents to test items; a word-level Smith-Waterman alignment then scores the
passage. A passage leaks an item if it covers at least ``share`` of the words of one of the item's texts,
in order, with at most one difference (another, missing or extra word) in ``one_in`` words.

Seeds: every n-gram of the items, n being the longest run that such a passage must contain unchanged.
Their document frequencies are counted over the whole corpus and an item keeps its rarest ones, as many
as it takes for every leaking passage to contain one of them, however the differences are placed.

Defined results: null ids or texts have no leaks; words are letter and digit runs without case and
invisible characters, so empty and punctuation-only texts have no words and leak nothing; items too short
to hold a seed of one word are ignored; repeated rows give one result.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿]")


def words_of(text: str) -> list[str]:
    """Words without case, punctuation, line breaks and invisible characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    return _WORD.findall(text.lower())


def _least(n: int, share: float) -> int:
    return max(1, -int(-n * share // 1))


def seed_length(n: int, share: float, one_in: int) -> int:
    """The longest run that any leaking passage of a text of n words contains unchanged."""
    runs = [-(-(span - span // one_in) // (span // one_in + 1)) for span in range(_least(n, share), n + 1)]
    return min(runs, default=0) if n else 0


def certain(positions: list[int], length: int, n: int, share: float, one_in: int) -> bool:
    """Whether every leaking passage keeps one of the seeds at these (sorted) positions.

    It does if no stretch of the text can have all its seeds spoilt by the changes that it may hold. Fewest
    changes that spoil a stretch's seeds: one at the end of the first seed, one at that of the next seed
    behind it, and so on; followed for all starts of stretches at once, in n / one_in steps.
    """
    least = _least(n, share)
    start = np.arange(n - least + 1)
    following = np.full(n + 1, 2 * n + length)
    for p in positions:
        following[p] = p
    following = np.minimum.accumulate(following[::-1])[::-1]
    end = start
    for changes in range(n // one_in + 1):
        # the shortest stretch that may hold so many changes must hold one seed more
        span = max(least, changes * one_in)
        end = following[np.minimum(end, n)] + length
        if (end[: n - span + 1] > start[: n - span + 1] + span).any():
            return False
    return True


def choose_seeds(frequency: list[int], length: int, n: int, share: float, one_in: int) -> list[int]:
    """Positions of the rarest n-grams that suffice; the n-grams stand at 0, 1, ... in the text."""
    order = sorted(range(len(frequency)), key=lambda p: (frequency[p], p))
    low, high = 1, len(order)
    while low < high:
        middle = (low + high) // 2
        if certain(sorted(order[:middle]), length, n, share, one_in):
            high = middle
        else:
            low = middle + 1
    return sorted(order[:low])


def align(item: np.ndarray, passage: np.ndarray, penalty: int = 3) -> list[tuple[int, int]]:
    """Smith-Waterman over words: match +1, any difference -penalty. Columns (item words, differs) of the best alignment."""
    n, m = len(item), len(passage)
    score = np.zeros((n + 1, m + 1), np.int32)
    slope = np.arange(m + 1, dtype=np.int32) * penalty
    for i in range(1, n + 1):
        step = score[i - 1, :-1] + np.where(passage == item[i - 1], 1, -penalty)
        row = np.maximum(0, np.maximum(step, score[i - 1, 1:] - penalty))
        row = np.concatenate(([0], row))
        # extra words of the passage: a running maximum of score + penalty * position
        score[i] = np.maximum.accumulate(row + slope) - slope
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    out = []
    while score[i, j] > 0:
        here = score[i, j]
        same = i > 0 and j > 0 and item[i - 1] == passage[j - 1]
        if i > 0 and j > 0 and here == score[i - 1, j - 1] + (1 if same else -penalty):
            out.append((1, 0 if same else 1))
            i, j = i - 1, j - 1
        elif i > 0 and here == score[i - 1, j] - penalty:
            out.append((1, 1))
            i -= 1
        else:
            out.append((0, 1))
            j -= 1
    return out[::-1]


def covers(columns: list[tuple[int, int]], n: int, share: float, one_in: int) -> bool:
    """Whether some stretch of an alignment has enough words of the item and few enough differences."""
    least = _least(n, share)
    span, off = sum(c[0] for c in columns), sum(c[1] for c in columns)
    if span < least:
        return False
    if off * one_in <= span:
        return True
    for a in range(len(columns)):
        s = o = 0
        for words, differs in columns[a:]:
            s, o = s + words, o + differs
            if s >= least and o * one_in <= s:
                return True
    return False


def qualifies(item: np.ndarray, window: np.ndarray, share: float, one_in: int) -> bool:
    """Whether some stretch of the item stands somewhere in window with few enough edits.

    Edit distances of all stretches from all starts to their nearest passage; starts beyond any allowance go.
    """
    n = len(item)
    least = _least(n, share)
    starts, place = np.arange(n - least + 1), np.arange(len(window) + 1, dtype=np.int32)
    d = np.zeros((len(starts), len(place)), np.int32)
    for i in range(1, n + 1):
        left = starts + i <= n
        starts, d = starts[left], d[left]
        if not len(starts):
            return False
        step = np.minimum(d[:, :-1] + (item[starts + i - 1][:, None] != window), d[:, 1:] + 1)
        d = np.concatenate([np.full((len(starts), 1), i, np.int32), step], axis=1)
        d = np.minimum.accumulate(d - place, axis=1) + place
        best = d.min(axis=1)
        if i >= least and (best * one_in <= i).any():
            return True
        starts, d = starts[best <= n // one_in], d[best <= n // one_in]
    return False


#: Words of the runs that are counted before anything is aligned.
RUN = 3


def runs(words: np.ndarray) -> np.ndarray:
    """A number for each run of RUN words; word numbers stay below 2^21."""
    w = words.astype(np.int64)
    return (w[:-2] << 42) | (w[1:-1] << 21) | w[2:] if len(w) >= RUN else np.zeros(0, np.int64)


def fewest_runs(n: int, share: float, one_in: int) -> int:
    """Runs of the text that any leaking passage keeps: each change spoils RUN of them at most."""
    return min((span - RUN + 1 - RUN * (span // one_in) for span in range(_least(n, share), n + 1)), default=0)


def leaks(item: np.ndarray, doc: np.ndarray, hits: list[tuple[int, int]], share: float, one_in: int, by_edits: bool = False, doc_runs: np.ndarray | None = None) -> bool:
    """Whether doc has a leaking passage at one of the seed hits (item position, document position).

    doc_runs: ``runs(doc)``, where it is at hand.
    """
    n = len(item)
    least = _least(n, share)
    slack = n // one_in + 1
    ends = -n - slack
    needed = fewest_runs(n, share, one_in)
    if needed > 0:
        mine, doc_runs = runs(item), runs(doc) if doc_runs is None else doc_runs
    for p, q in sorted(hits, key=lambda h: h[1] - h[0]):
        if q - p <= ends:
            continue
        # all hits whose diagonals lie within reach are covered by one window
        ends = q - p + slack
        low, high = max(0, q - p - slack), min(len(doc), q - p + n + 2 * slack)
        window = doc[low:high]
        if needed > 0:
            if np.isin(mine, doc_runs[low : max(low, high - RUN + 1)]).sum() < needed:
                continue
        elif np.isin(item, window).sum() < least - least // one_in:
            continue
        at = q - p - low
        if 0 <= at and at + n <= len(window):
            same = window[at : at + n] == item
            run = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
            if len(run) and (run[1::2] - run[::2]).max() >= least:
                return True
        # the best alignment decides most cases at once, but may trim or outscore a stretch that qualifies
        if covers(align(item, window), n, share, one_in) or by_edits and qualifies(item, window, share, one_in):
            return True
    return False


def grams(w: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words."""
    h = np.full(max(0, len(w) - k + 1), k, np.uint64)
    for i in range(k):
        h = (h ^ w[i : len(w) - k + 1 + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def known_grams(words: np.ndarray, offsets: np.ndarray, known: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(document, gram), each pair once, of all known grams in documents whose words stand one after another.

    A run with a word that no item has (number 0), or from two documents, is none.
    """
    document = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    stops = np.concatenate(([0], np.cumsum(words == 0)))
    found = []
    for k, mine in known.items():
        if len(words) < k:
            continue
        at = np.flatnonzero((stops[k:] == stops[:-k]) & (document[: len(document) - k + 1] == document[k - 1 :]))
        g = np.full(len(at), k, np.uint64)
        for i in range(k):
            g = (g ^ words[at + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            g ^= g >> np.uint64(29)
        met = mine[np.minimum(np.searchsorted(mine, g), len(mine) - 1)] == g
        found.append((document[at[met]], g[met]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    d, g = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((g, d))
    d, g = d[order], g[order]
    first = np.r_[True, (d[1:] != d[:-1]) | (g[1:] != g[:-1])] if len(d) else np.zeros(0, bool)
    return d[first], g[first]


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_texts: list[str], share: float = 0.5, one_in: int = 8, max_items: int = 100_000, by_edits: bool = False, max_chars: int = 1 << 24) -> DataFrame:
    """(doc_id, item_id) of every document that leaks an item.

    items is the held-out set. It is taken in blocks of about max_items rows and max_chars characters, each
    block against all documents, so what the driver holds and broadcasts is bounded whatever the set's
    size: one block's texts, and one count for each of its n-grams. by_edits also finds passages that
    qualify by edit distance but not on the best local alignment.
    """
    if max_items < 1 or max_chars < 1:
        raise ValueError("a block holds at least one item")
    held = items.select(F.col(item_id).alias("id"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(item_texts)]).where("id is not null").distinct()
    n, chars = held.agg(F.count("*"), F.sum(sum((F.coalesce(F.char_length(c), F.lit(0)) for c in held.columns[1:]), F.lit(0)))).first()
    blocks = max(1, -(-n // max_items), -(-(chars or 0) // max_chars))
    out = None
    for block in range(blocks):
        mine = held if blocks == 1 else held.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        pairs = _leaks_of(docs, doc_id, text, mine.collect(), share, one_in, by_edits)
        if pairs is not None:
            pairs = pairs if blocks == 1 else stage(pairs, "leaks")
            out = pairs if out is None else out.unionByName(pairs)
    kinds = docs.schema[doc_id].dataType, items.schema[item_id].dataType
    if out is None:
        return docs.select(F.col(doc_id), F.lit(None).cast(kinds[1]).alias(item_id)).limit(0)
    return out.select(F.col("doc").cast(kinds[0]).alias(doc_id), F.col("item").cast(kinds[1]).alias(item_id)).distinct()


def _leaks_of(docs: DataFrame, doc_id: str, text: str, held: list, share: float, one_in: int, by_edits: bool) -> DataFrame | None:
    """(doc, item), both as strings, for the items of one block."""
    vocabulary: dict[str, int] = {}
    texts: list[tuple[str, np.ndarray, int]] = []  # (item, word numbers, seed length)
    for row in held:
        for t in dict.fromkeys(x for x in row[1:] if x):
            w = words_of(t)
            if k := seed_length(len(w), share, one_in):
                texts.append((str(row[0]), np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for x in w], np.int64), k))
    if not texts:
        return None
    if len(vocabulary) >= 1 << 21:
        raise ValueError("too many different words in one block of items: lower max_chars")
    known = {k: np.unique(np.concatenate([grams(w, k) for _, w, j in texts if j == k])) for k in sorted({k for *_, k in texts})}
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, known))
    schema = pa.schema([("doc", pa.string()), ("words", pa.list_(pa.int32())), ("hits", pa.list_(pa.int64()))])

    def seek(batches):
        vocabulary, known = shared.value
        number = vocabulary.get
        for b in batches:
            ids, numbers, size = [], [], 0
            for i, (d, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                ids.append(d)
                numbers.append(np.array([number(x, 0) for x in words_of(t)], np.int32))
                size += len(numbers[-1])
                if size < 500_000 and i + 1 < b.num_rows:
                    continue
                # enough words for one pass over arrays
                at, hits = known_grams(np.concatenate(numbers), np.cumsum([0, *map(len, numbers)]), known)
                met, starts = np.unique(at, return_index=True)
                if len(met):
                    kept = [numbers[j] for j in met]
                    words = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, kept)]), pa.int32()), pa.array(np.concatenate(kept)))
                    lists = pa.ListArray.from_arrays(pa.array([*starts, len(hits)], pa.int32()), pa.array(hits.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array([ids[j] for j in met], pa.string()), words, lists], schema=schema)
                ids, numbers, size = [], [], 0

    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("string"), F.col(text))
    met = stage(rows.mapInArrow(seek, "doc string, words array<int>, hits array<long>"), "seeds")
    counted = met.select(F.explode("hits").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect()
    frequency = {r[0] & (2**64 - 1): r[1] for r in counted}
    seeds: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for index, (_, w, k) in enumerate(texts):
        g = grams(w, k).tolist()
        for p in choose_seeds([frequency.get(x, 0) for x in g], k, len(w), share, one_in):
            seeds.setdefault(k, {}).setdefault(g[p], []).append((index, p))
    # sorted, to be sought in arrays
    tables = {k: (np.array(sorted(mine), np.uint64), [mine[g] for g in sorted(mine)]) for k, mine in seeds.items()}
    plan = spark.sparkContext.broadcast((texts, tables))
    found = pa.schema([("doc", pa.string()), ("item", pa.string())])

    def verify(batches):
        texts, tables = plan.value
        for b in batches:
            out = ([], [])
            for d, w in zip(b.column(0).to_pylist(), b.column(1)):
                w = w.values.to_numpy()
                hits: dict[int, list[tuple[int, int]]] = {}
                for k, (mine, entries) in tables.items():
                    g = grams(w, k)
                    if not len(g):
                        continue
                    at = np.minimum(np.searchsorted(mine, g), len(mine) - 1)
                    places = np.flatnonzero(mine[at] == g)
                    for q, e in zip(places.tolist(), at[places].tolist()):
                        for index, p in entries[e]:
                            hits.setdefault(index, []).append((p, q))
                done = set()
                doc_runs = runs(w) if hits else None
                for index, at in hits.items():
                    item, words, _ = texts[index]
                    if item not in done and leaks(words, w, at, share, one_in, by_edits, doc_runs):
                        done.add(item)
                        out[0].append(d)
                        out[1].append(item)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], schema=found)

    return met.select("doc", "words").mapInArrow(verify, "doc string, item string")
