"""Near-duplicate statements about the same drug (problem 4), by multi-index hashing.

Two texts are linked if they have the same drug, the same set of numbers, and at least four fifths of all
their distinct words in common. Then the symmetric difference of their word sets has at most
(|A| + |B|) / 9 words. A text's fingerprint is its set of word hashes, dealt out to segments by hash.
Within each segment a small Hamming ball is enumerated (radius 1 by leaving out each word in turn, or
radius 0), and texts that meet in a table entry are candidates. The radii of a size level are chosen so
that any two texts within the greatest distance meet in at least two segments: with radii t_j,
sum(t_j + 1) exceeds the distance by 3. So the search loses no link, and a table entry that is too full
may be dropped for its pairs with other full entries of the same text without losing one either. A pair of
entries that is still too full is split once more, by the rarest words that any partner must share, and
what is too full even then is compared block against block, so that no task holds a whole entry.
Complete distances are verified twice: on 64-bit parity fingerprints, where the tables meet, then on the
word sets.

Texts with equal drug, numbers and words form one class; classes, not texts, are compared, so a hot group
of copies costs one entry. Small blocks of equal drug and numbers need no segments: their one entry is
the block.

Defined results: null ids, null or wordless texts and texts longer than ``max_chars`` have no links; where
the drug is null or blank it is the known drug named first in the text (the longest where several begin),
in as many words as it takes, else the text has none and no links; a text delivered twice counts once.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import broadcast_if_small, stage

# Salt and form words that do not make another drug.
SALTS_AND_FORMS = frozenset(
    """hydrochloride hcl hydrobromide sodium potassium calcium magnesium maleate tartrate bitartrate succinate mesylate besylate
    tosylate sulfate sulphate phosphate acetate citrate fumarate bromide chloride nitrate lactate gluconate hydrate monohydrate dihydrate
    tablet tablets capsule capsules injection injections infusion oral solution suspension syrup drops powder cream ointment gel
    patch spray inhaler film coated extended release""".split()
)
#: Blocks of at most so many classes need no segments.
SMALL_BLOCK = 64
#: A table entry with more classes is dropped for its pairs with other such entries.
FULL_ENTRY = 1000
#: Segments of each level that have radius 1 (and twice the words); the others have radius 0.
BALLS = 2

_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")


def drug_key(name: str | None) -> str | None:
    """A drug's name without case, blanks, punctuation, salt and form words."""
    words = re.findall(r"\w+", unicodedata.normalize("NFKC", name or "").lower())
    return "".join([w for w in words if w not in SALTS_AND_FORMS] or words) or None


def bare(word: str) -> str:
    """A word without outer punctuation."""
    a, b = 0, len(word)
    while a < b and unicodedata.category(word[a])[0] == "P":
        a += 1
    while b > a and unicodedata.category(word[b - 1])[0] == "P":
        b -= 1
    return word[a:b]


def number_key(text: str) -> str:
    """The set of numbers in a text; 1,000 is 1000 and 2,50 is 2.5."""
    found = set()
    for x in _NUMBER.findall(text):
        x = x.replace(",", "") if re.fullmatch(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?", x) else x.replace(",", ".")
        if x.count(".") == 1:
            x = x.rstrip("0").rstrip(".")
        found.add(x.lstrip("0") or "0")
    return " ".join(sorted(found))


class _Hashes(dict):
    """Word hashes by raw word, kept while the worker lives."""

    def __missing__(self, word: str):
        if len(self) > 400_000:
            self.clear()
        w = bare(word)
        h = self[word] = xxhash.xxh64_intdigest(w) >> 32 if w else None
        return h


def fingerprints(df: DataFrame, record_id: str, text: str, drug: str, max_chars: int = 2000) -> DataFrame:
    """(id, drug, numbers, words, mentions): hashes of each text's numbers and distinct words.

    mentions, only where the drug is not given, holds the keys of the text's words in order.
    """
    schema = pa.schema([("id", pa.string()), ("drug", pa.string()), ("numbers", pa.int64()), ("words", pa.list_(pa.int32())), ("mentions", pa.list_(pa.string()))])

    def run(batches):
        hashes, drugs = _Hashes(), {}
        for batch in batches:
            ids, keys, numbers, sets, mentions = [], [], [], [], []
            for i, t, d in zip(*(batch.column(k).to_pylist() for k in range(3))):
                raw = t.lower().split()
                words = set(map(hashes.__getitem__, raw))
                words.discard(None)
                if not words:
                    continue
                if d not in drugs:
                    if len(drugs) > 100_000:
                        drugs.clear()
                    drugs[d] = drug_key(d)
                key = drugs[d]
                named = None
                if key is None:
                    named = [drug_key(w) for w in raw]
                ids.append(i)
                keys.append(key)
                numbers.append(xxhash.xxh64_intdigest(number_key(t)) - (1 << 63))
                sets.append(np.sort(np.fromiter(words, np.uint32, len(words))).view(np.int32))
                mentions.append(named)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, keys, numbers, sets, mentions), schema)], schema=schema)

    rows = df.where(F.col(record_id).isNotNull() & F.col(text).isNotNull() & (F.char_length(text) <= max_chars))
    return rows.select(F.col(record_id).cast("string"), F.col(text), F.col(drug)).mapInArrow(run, "id string, drug string, numbers long, words array<int>, mentions array<string>")


def phrases(keys: list[str | None], longest: int) -> list[tuple[int, str]]:
    """(position, key) of all phrases of consecutive words that may be a drug's name of at most so many letters.

    Blanks do not count, so any number of words may make it up; salt and form words may stand between.
    """
    out = []
    at = [i for i, k in enumerate(keys) if k]
    for places in (at, [i for i in at if keys[i] not in SALTS_AND_FORMS]):
        for n, start in enumerate(places):
            name = ""
            for i in places[n:]:
                name += keys[i]
                if len(name) > longest:
                    break
                out.append((start, name))
    return list(dict.fromkeys(out))


def _with_drug(prints: DataFrame) -> DataFrame:
    """Give texts without a drug the known drug that they name first."""
    # staged, so that its size is known: where it is small, mentions are sifted before anything moves
    known = stage(prints.where("drug is not null").select("drug").distinct(), "drugs")
    longest = known.agg(F.max(F.char_length("drug"))).first()[0] or 0
    schema = pa.schema([("id", pa.string()), ("numbers", pa.int64()), ("w", pa.int64()), ("pos", pa.int32()), ("drug", pa.string())])

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for i, n, w, keys in zip(*(b.column(k).to_pylist() for k in range(4))):
                rows += [(i, n, w, pos, name) for pos, name in phrases(keys, longest)]
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    open_rows = prints.where("drug is null")
    at = open_rows.select("id", "numbers", F.xxhash64("words").alias("w"), "mentions").mapInArrow(run, "id string, numbers long, w long, pos int, drug string")
    first = F.min_by("drug", F.struct("pos", (-F.char_length("drug")).alias("letters"), "drug"))
    named = at.join(broadcast_if_small(known), "drug").groupBy("id", "numbers", "w").agg(first.alias("drug"))
    found = open_rows.drop("drug", "mentions").withColumn("w", F.xxhash64("words")).join(named, ["id", "numbers", "w"])
    columns = ["id", "drug", "numbers", "words"]
    # staged, as several readers follow
    return prints.where("drug is not null").select(columns).unionByName(stage(found.select(columns), "named"))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def level_of(n: np.ndarray) -> np.ndarray:
    """Size level of a text: 0 up to 16 words, then one for each doubling from 17."""
    return np.maximum(0, np.floor(np.log2(np.maximum(n, 1) / 17.0)).astype(np.int64) + 1)


def segments_of(level: int, balls: int) -> tuple[int, int]:
    """Numbers of segments with radius 1 and 0 of a level: each two texts of it meet in two of them."""
    greatest = (2 * (17 * 2**level - 1)) // 9
    ones = min(balls, (greatest + 3) // 2)
    return ones, greatest + 3 - 2 * ones


def table_entries(blocks: np.ndarray, sizes: np.ndarray, words: np.ndarray, offsets: np.ndarray, small: int, balls: int):
    """(text index, level, key) of all table entries of a batch of word sets.

    A pair of texts belongs to the level of the larger one; so a text has entries in its own level and in
    the next if a partner four fifths smaller or larger may be there. words: all sets, one after another.
    """
    n = np.diff(offsets)
    out = []
    own = level_of(n)
    whole = sizes <= small
    at = np.flatnonzero(whole)
    out.append((at, own[at], _mix(blocks[at])))
    out.append((at[(up := level_of(n[at] * 5 // 4) > own[at])], own[at][up] + 1, _mix(blocks[at][up])))
    rest = ~whole
    text_of = np.repeat(np.arange(len(n)), n)
    for step in (0, 1):
        for level in np.unique(own[rest]):
            level = int(level)
            chosen = rest & (own == level) if step == 0 else rest & (own == level) & (level_of(n * 5 // 4) > own)
            if not chosen.any():
                continue
            level += step
            ones, zeros = segments_of(level, balls)
            m = ones + zeros
            mine = chosen[text_of]
            texts, w = text_of[mine], words[mine]
            h = _mix(w + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64))
            share = (h >> np.uint64(32)) % np.uint64(2 * ones + zeros)
            segment = np.where(share < 2 * ones, share // np.uint64(2), share - np.uint64(ones)).astype(np.int64)
            place = np.searchsorted(np.flatnonzero(chosen), texts)
            sums = np.zeros(int(chosen.sum()) * m, np.uint64)
            value = _mix(h + np.uint64(1))
            np.add.at(sums, place * m + segment, value)
            ids = np.flatnonzero(chosen)
            salt = _mix(np.arange(m, dtype=np.uint64) + np.uint64(1000 * (level + 1)))
            out.append((np.repeat(ids, m), np.full(len(ids) * m, level), _mix(_mix(sums + np.tile(salt, len(ids))) ^ np.repeat(blocks[ids], m))))
            ball = segment < ones
            less = sums[(place * m + segment)[ball]] - value[ball]
            out.append((texts[ball], np.full(int(ball.sum()), level), _mix(_mix(less + salt[segment[ball]]) ^ blocks[texts[ball]])))
    return tuple(np.concatenate(x) for x in zip(*out))


def _entries(reps: DataFrame, small: int, balls: int) -> DataFrame:
    """(key, level, class_id, n, parity): the tables' entries of all classes. Keys of different levels differ."""
    schema = pa.schema([("key", pa.int64()), ("level", pa.int16()), ("class_id", pa.int64()), ("n", pa.int32()), ("parity", pa.int64())])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            words = lists.values.to_numpy().view(np.uint32).astype(np.uint64)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            classes, blocks, sizes = (batch.column(i).to_numpy() for i in range(3))
            n = np.diff(offsets)
            bits = np.uint64(1) << (_mix(words) & np.uint64(63))
            parity = np.bitwise_xor.reduceat(bits, offsets[:-1])
            at, level, key = table_entries(blocks.view(np.uint64), sizes, words, offsets, small, balls)
            key = _mix(key + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            columns = (key.view(np.int64), level.astype(np.int16), classes[at], n[at].astype(np.int32), parity.view(np.int64)[at])
            table = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            for i in range(0, table.num_rows, 100_000):
                yield table.slice(i, 100_000)

    return reps.select("class_id", "block", "block_size", "words").mapInArrow(run, "key long, level smallint, class_id long, n int, parity long")


#: Bytes of an entry in a shuffle, about, and entries that one task should read.
ENTRY_BYTES, TASK_BYTES = 26, 4 << 20


def _parts(entries: int) -> int:
    """Partitions for so many entries, whatever the session's setting: tasks stay small as tables grow."""
    return max(1, -(-entries * ENTRY_BYTES // TASK_BYTES))


def _meet(entries: DataFrame, *more: str, parts: int | None = None) -> DataFrame:
    """Pairs of classes that share an entry and whose parity fingerprints are near enough.

    more: columns of the entry's blocks. parts: partitions of the entries, which meet themselves there.
    """
    if parts:
        entries = entries.repartition(parts, "key")
    on = ["key", *more[:2]]
    a = entries.select(*on, *[F.col(c).alias(f"{c}_a") for c in ("class_id", "n", "parity", *more[2:])])
    b = entries.select(*on, *[F.col(c).alias(f"{c}_b") for c in ("class_id", "n", "parity", *more[2:])])
    both = a.join(b, on).where("class_id_a < class_id_b")
    if more:
        both = both.where("low = high or part_a != part_b")
    return both.where("9 * bit_count(parity_a ^ parity_b) <= n_a + n_b and 5 * n_a >= 4 * n_b and 5 * n_b >= 4 * n_a").select("class_id_a", "class_id_b")


def _crowded(entries: DataFrame, full: int, name: str) -> DataFrame:
    """(key, entry_size) of the entries with more than full classes."""
    counted = entries.groupBy("key").agg(F.count("*").alias("entry_size"))
    return stage(counted.where(F.col("entry_size") > full), name)


def _split(entries: DataFrame, crowded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries outside the crowded ones, and those inside with their entry_size."""
    hint = broadcast_if_small(crowded)
    return entries.join(hint, "key", "left_anti"), entries.join(hint, "key")


def _meet_crowded(double: DataFrame, reps: DataFrame, full: int) -> DataFrame:
    """``_meet`` for entries of any size: crowded ones are split by rare words, then into blocks.

    Two linked sets share four fifths of the larger one's words, so they share one of the first
    n - 4n/5 + 1 words of both in any common order; rare words first keeps those entries small.
    """
    double = stage(double, "double")
    crowded = _crowded(double, full, "full-2")
    if crowded.isEmpty():
        return _meet(double)
    light, heavy = _split(double, crowded)
    words = heavy.select("key", "class_id", "n", "parity").join(reps.select("class_id", "words"), "class_id").select("key", "class_id", "n", "parity", F.explode("words").alias("word"))
    words = stage(words, "words")
    common = words.groupBy("key", "word").agg(F.count("*").alias("df"))
    order = Window.partitionBy("key", "class_id").orderBy("df", "word")
    ranked = words.join(common, ["key", "word"]).withColumn("r", F.row_number().over(order))
    kept = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1)
    rare = stage(kept.select(F.xxhash64("key", "word").alias("key"), "class_id", "n", "parity"), "rare")
    still = _crowded(rare, full, "full-3")
    pairs = _meet(light)
    if still.isEmpty():
        return pairs.unionByName(_meet(rare))
    light, heavy = _split(rare, still)
    # blocks of an entry meet in cells (low, high); a pair of one block only in its own cell
    parts = heavy.withColumn("parts", F.ceil(F.col("entry_size") / F.lit(full)).cast("int")).withColumn("part", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int"))
    cells = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
    return pairs.unionByName(_meet(light)).unionByName(_meet(cells, "low", "high", "part"))


def link_classes(prints: DataFrame, small: int = SMALL_BLOCK, full: int = FULL_ENTRY, balls: int = BALLS) -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, class_id) of every text, and each pair of linked classes once."""
    prints = stage(prints, "prints")
    named = _with_drug(prints).withColumn("block", F.xxhash64("drug", "numbers"))
    named = named.select("id", "block", "words", F.xxhash64("block", "words").alias("class_id"))
    members = stage(named.select("id", "class_id").distinct(), "members")
    classes = named.groupBy("class_id").agg(F.first("block").alias("block"), F.first("words").alias("words"))
    sizes = named.select("block", "class_id").distinct().groupBy("block").agg(F.count("*").alias("block_size"))
    # only blocks beyond the small ones are joined; where they are few, that is a broadcast
    large = stage(sizes.where(F.col("block_size") > small), "blocks")
    reps = classes.join(broadcast_if_small(large), "block", "left").withColumn("block_size", F.coalesce("block_size", F.lit(1)))
    reps = stage(reps.select("class_id", "block", "block_size", "words"), "classes")
    entries = _entries(reps, small, balls)
    # of each class, by its size: about as many entries as its level has segments and balls words
    parts = _parts(reps.count() * 17)
    # an entry is never fuller than its block, so those of other blocks need not be counted
    crowded = _crowded(_entries(reps.where(F.col("block_size") > full), small, balls), full, "full")
    if crowded.isEmpty():
        pairs = _meet(entries, parts=parts)
    else:
        light, heavy = _split(entries, crowded)
        # a text's full entries, a bounded number, in pairs: two near texts share at least two entries
        of_text = heavy.groupBy("class_id", "level").agg(F.first("n").alias("n"), F.first("parity").alias("parity"), F.array_sort(F.collect_set("key")).alias("keys"))
        pairs_of = F.flatten(F.transform("keys", lambda x, i: F.transform(F.slice("keys", i + 2, F.size("keys")), lambda y: F.xxhash64(x, y))))
        double = of_text.select(F.explode(pairs_of).alias("key"), "class_id", "n", "parity")
        pairs = _meet(light, parts=parts).unionByName(_meet_crowded(double, reps, full))
    pairs = stage(pairs.distinct(), "pairs")
    ids = stage(pairs.select(F.explode(F.array("class_id_a", "class_id_b")).alias("class_id")).distinct(), "paired")
    sets = reps.join(broadcast_if_small(ids), "class_id", "left_semi").select("class_id", "words")
    a, b = (sets.select(F.col("class_id").alias(f"class_id_{s}"), F.col("words").alias(f"words_{s}")) for s in "ab")
    shared = F.size(F.array_intersect("words_a", "words_b"))
    links = pairs.join(a, "class_id_a").join(b, "class_id_b").where(9 * shared >= 4 * (F.size("words_a") + F.size("words_b")))
    return members, links.select("class_id_a", "class_id_b")


#: Members of a class that one task expands at a time.
MEMBERS = 2000


def linked_pairs(members: DataFrame, links: DataFrame, block: int = MEMBERS) -> DataFrame:
    """(content_id_a, content_id_b), the smaller id first, of all linked texts, also those of one class.

    Classes are expanded in blocks of about ``block`` members, so no task expands a hot class alone.
    """
    sizes = stage(members.groupBy("class_id").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    parts = sizes.select("class_id", F.ceil(F.col("size") / F.lit(block)).cast("int").alias("parts"), "size")
    placed = members.join(broadcast_if_small(parts), "class_id", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    a = placed.select(F.col("id").alias("id_a"), F.col("class_id").alias("class_id_a"), F.col("part").alias("part_a"))
    b = placed.select(F.col("id").alias("id_b"), F.col("class_id").alias("class_id_b"), F.col("part").alias("part_b"))
    # every link, or class with itself, once for each pair of blocks of its sides
    of = parts.where("parts > 1").select("class_id", "parts")
    for side in "ab":
        links = links.join(broadcast_if_small(of.select(F.col("class_id").alias(f"class_id_{side}"), F.col("parts").alias(f"n_{side}"))), f"class_id_{side}", "left")
        links = links.withColumn(f"part_{side}", F.explode(F.sequence(F.lit(0), F.coalesce(f"n_{side}", F.lit(1)) - 1))).drop(f"n_{side}")
    across = links.join(a, ["class_id_a", "part_a"]).join(b, ["class_id_b", "part_b"]).select("id_a", "id_b").where("id_a != id_b")
    # a member meets all blocks of its class; only classes of several members take part
    several = placed.where("size > 1").select("id", "class_id", "parts", "part")
    meets = several.select(F.col("id").alias("id_a"), F.col("class_id").alias("class_id_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part_b"))
    inside = several.select(F.col("id").alias("id_b"), F.col("class_id").alias("class_id_b"), F.col("part").alias("part_b"))
    within = meets.join(inside, ["class_id_b", "part_b"]).where("id_a < id_b").select("id_a", "id_b")
    return across.unionByName(within).select(F.least("id_a", "id_b").alias("content_id_a"), F.greatest("id_a", "id_b").alias("content_id_b")).distinct()
