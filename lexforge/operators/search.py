"""Retrieval: lexical scores, hash-embedding and dense cosine top-k for a set of queries against all rows.

Queries are a stated set: they travel to the rows in blocks of bounded size, and each task keeps its own
best k before the best of all are taken, so of the scored pairs only these are shuffled. Word overlap goes
through an inverted index of the queries: a row meets the queries that share a word with it.

Defined results: null texts score nothing; ties are ordered by the row's id; an empty query set gives no
rows; a blank query, section or target leaves its terms out, and with none of them every row scores 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

THRESHOLD = 0.35
TOP_K = 5
DIMENSIONS = 256
FALLBACK_SCORE = 0.30


#: Queries that meet the rows at a time.
BLOCK = 10_000


def collect_queries(queries: DataFrame, max_queries: int | None = None) -> list:
    """The query set; more than max_queries rows, if that is given, are refused."""
    if max_queries is None:
        return queries.collect()
    rows = queries.limit(max_queries + 1).collect()
    if len(rows) > max_queries:
        raise ValueError(f"more than {max_queries} queries")
    return rows


def in_blocks(queries: DataFrame, query_id: str, search: Callable[[DataFrame], DataFrame], size: int = BLOCK) -> DataFrame:
    """search(queries), block by block where there are more than size: what the driver holds stays bounded."""
    blocks = max(1, -(-queries.count() // size))
    if blocks == 1:
        return search(queries)
    parts = [search(queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == i)) for i in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def top_k(scored: DataFrame, query: str, score: Column, tie: str, k: int) -> DataFrame:
    """The best k rows of each query with their rank; limited within each task first.

    Repeated (score, tie) count once: they share a rank, so nothing has to be deduplicated before.
    """
    order = Window.partitionBy(query).orderBy(score.desc(), F.col(tie))
    return scored.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).distinct()


def excluded(query_document: Column, query_fingerprint: Column, query_content: Column, document: Column, fingerprint: Column, content: Column) -> Column:
    """True where a row is the query itself: same document, fingerprint or content id; never by name."""
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    return same(query_document, document) | same(query_fingerprint, fingerprint) | same(query_content, content)


def lexical_search(items: DataFrame, queries: DataFrame, item_id: str = "content_id", k: int = 10, max_queries: int | None = None, exclude: bool = False) -> DataFrame:
    """(query_id, item_id, score, rank) of the k best items for each query.

    queries has query_id, query, section and target_text. The score adds 4 for the query in the text, 5, 3
    and 3 in drug, product and indication, 1.5 for each shared word, 3 times the overlap with the target,
    and 2.5 for an aligned section. exclude: queries also have document_id, fingerprint and content_id, and a
    row (document_id, document_fingerprint, content_id) that is the query itself is none of its results.
    """
    if max_queries is None:
        # these queries become part of the plan, so blocks are small
        return in_blocks(queries, "query_id", lambda q: lexical_search(items, q, item_id, k, BLOCK, exclude), 500)
    own = ["document_id", "fingerprint", "content_id"] if exclude else []
    rows = collect_queries(queries.select("query_id", "query", "section", "target_text", *own), max_queries)
    same = [F.col(c).alias(f"own_{n}") for n, c in zip(own, ("document_id", "document_fingerprint", "content_id"))]
    texts = items.where(F.col("text").isNotNull()).select(F.col(item_id).alias("item_id"), "drug", "product", "indication", "section", "subsection", F.lower("text").alias("low"), *same)
    pairs = texts.withColumn("words", X.words3(F.col("low"))).withColumn("q", F.explode(_literal_block(rows)))
    q = lambda n: F.col(f"q.{n}")
    if exclude:
        pairs = pairs.where(~excluded(*[q(f"own_{n}") for n in own], *[F.col(f"own_{n}") for n in own]))
    asked, aimed, placed = q("query") != "", q("target") != "", q("section") != ""
    inside = lambda c: F.coalesce(F.contains(F.lower(F.col(c)), q("query")), F.lit(False))
    points = lambda when, n: F.when(when, n).otherwise(0.0)
    sec, sub = F.lower(F.coalesce("section", F.lit(""))), F.lower(F.coalesce("subsection", F.lit("")))
    shared = F.size(F.array_intersect(q("t_words"), "words"))
    union = F.size("words") + F.size(q("t_words")) - shared
    score = (
        points(asked & F.contains("low", q("query")), 4.0) + points(asked & inside("drug"), 5.0) + points(asked & inside("product"), 3.0) + points(asked & inside("indication"), 3.0)
        + F.size(F.array_intersect(q("q_words"), "words")) * 1.5
        + points((F.size(q("t_words")) > 0) & (union > 0), shared / union * 3.0)
        + points(placed & (F.contains(sec, q("section")) | F.contains(q("section"), sec) | F.contains(sub, q("section"))), 2.5)
        + points(~asked & ~aimed & ~placed, 1.0)
    )
    scored = pairs.select(q("query_id").alias("query_id"), "item_id", score.alias("score")).where("score > 0")
    return top_k(scored, "query_id", F.col("score"), "item_id", k).select("query_id", F.col("item_id").alias(item_id), "score", "rank")


def jaccard_top_k(rows: DataFrame, row_id: str, text: str, queries: DataFrame, query_id: str, query_text: str, k: int = TOP_K, block: int = BLOCK) -> DataFrame:
    """(query, row, score, rank) by overlap of content words, rounded to 4 digits; pairs without overlap are left out.

    The queries' inverted index travels to the rows; a row looks its words up, counts those it shares with
    each query, and only each task's best rows move.
    """
    return in_blocks(queries, query_id, lambda q: _jaccard_block(rows, row_id, text, q, query_id, query_text, k), block)


def _jaccard_block(rows: DataFrame, row_id: str, text: str, queries: DataFrame, query_id: str, query_text: str, k: int) -> DataFrame:
    held = collect_queries(queries.select(query_id, query_text).where(F.col(query_id).isNotNull() & F.col(query_text).isNotNull()).distinct())
    kinds = dict(queries.dtypes)[query_id], dict(rows.dtypes)[row_id]
    stop = set(X.STOP_WORDS)
    sizes: list[int] = []
    index: dict[str, list[int]] = {}
    for i, r in enumerate(held):
        words = [w for w in _words(r[1].lower()) if w not in stop]
        sizes.append(len(words))
        for w in words:
            index.setdefault(w, []).append(i)
    shared = rows.sparkSession.sparkContext.broadcast((index, np.array(sizes, np.int64), [str(r[0]) for r in held]))
    schema = pa.schema([("query", pa.string()), ("row", pa.string()), ("score", pa.float64())])

    def run(batches):
        index, sizes, ids = shared.value
        for b in batches:
            out: list[tuple] = []
            for row, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                places = [i for w in words for i in index.get(w, ())]
                if places:
                    met, n = np.unique(places, return_counts=True)
                    out += [(ids[i], row, s) for i, s in zip(met.tolist(), (n / (sizes[met] + len(words) - n)).tolist())]
                if len(out) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    given = rows.where(F.col(row_id).isNotNull() & F.col(text).isNotNull()).select(F.col(row_id).cast("string"), X.content_words(F.col(text)))
    scored = given.mapInArrow(run, "query string, row string, score double").select(F.col("query").cast(kinds[0]).alias(query_id), F.col("row").cast(kinds[1]).alias(row_id), F.bround("score", 4).alias("score"))
    return top_k(scored.where("score > 0"), query_id, F.col("score"), row_id, k).select(query_id, row_id, "score", "rank")


# Fixed value: what a section heading, as opposed to a drug's name, begins with.
HEADING_START = r"(?i)^(section\s*\d+|part\s*\d+|chapter\s*\d+|[0-9]+[.:\s]+|indications?(\s+and\s+usage)?|dosage(\s+and\s+administration)?|contraindications?|warnings?(\s+and\s+precautions)?|precautions?|adverse\s*reactions?|drug\s*interactions?|clinical\s*pharmacology|storage|how\s*supplied|description|overdosage|patient\s*counseling)"


def is_section_heading(name: Column) -> Column:
    return F.coalesce(F.rlike(F.trim(name), F.lit(HEADING_START)), F.lit(False))


def derived_query(drug: Column, indication: Column, section: Column, text: Column) -> Column:
    """What to search for: drug, indication, section, the first three long words, else the text's beginning."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    words = F.filter(X.blank_words(text), lambda w: (F.char_length(w) > 3) & F.rlike(w, F.lit(r"^\p{L}+$")))
    return F.coalesce(blank(drug), blank(indication), blank(section), blank(F.array_join(F.slice(words, 1, 3), " ")), blank(F.left(text, F.lit(40))))


def _words(text: str) -> list[str]:
    import re

    return list(dict.fromkeys(re.findall(r"\b[a-zA-Z0-9]{3,}\b", text)))


def _literal_block(rows: list) -> Column:
    """The queries as an array literal of structs, to be exploded beside each row."""
    low = lambda s: (s or "").strip().lower()
    words = lambda s: F.array(*[F.lit(w) for w in _words(s)]).cast("array<string>")
    structs = [
        F.struct(F.lit(r[0]).alias("query_id"), F.lit(low(r[1])).alias("query"), F.lit(low(r[2])).alias("section"), F.lit(low(r[3])).alias("target"), words(low(r[1])).alias("q_words"), words(low(r[3])).alias("t_words"), *[F.lit(x).cast("string").alias(f"own_{n}") for n, x in zip(("document_id", "fingerprint", "content_id"), r[4:])])
        for r in rows
    ]
    return F.array(*structs) if structs else F.array().cast("array<struct<query_id:bigint,query:string,section:string,target:string,q_words:array<string>,t_words:array<string>,own_document_id:string,own_fingerprint:string,own_content_id:string>>")


def embed(texts: list[str | None], places: dict[str, tuple[int, float]]) -> np.ndarray:
    """Unit vectors of the texts' words, each hashed to one signed dimension; places caches the words."""
    out = np.zeros((len(texts), DIMENSIONS))
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            at = places.get(w)
            if at is None:
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[-2:], "big")
                if len(places) > 500_000:
                    places.clear()
                at = places[w] = (h & 255, 1.0 - 2.0 * (h >> 8 & 1))
            out[i, at[0]] += at[1]
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 1e-9)


def cosine_top_k(rows: DataFrame, row_id: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, k: int = TOP_K, threshold: float = THRESHOLD, match: tuple[str, str] | None = None, block: int = BLOCK, within: tuple[str, str] | None = None) -> DataFrame:
    """(query, row, similarity, rank): the k nearest rows of each query by cosine, rounded to 4 digits.

    vector columns hold text (hash embeddings) or arrays of numbers; match names a column of rows and one
    of queries that must be equal without case; within names two of which one must contain the other. Rows meet the query matrix batch by batch.
    """
    near = in_blocks(queries, query_id, lambda q: _near(rows, row_id, vector, q, query_id, query_vector, threshold, match, k, within), block)
    return top_k(near, "query", F.col("similarity"), "row", k).select(F.col("query").alias(query_id), F.col("row").alias(row_id), "similarity", "rank")


def cosine_near(rows: DataFrame, row_id: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, threshold: float, match: tuple[str, str] | None = None) -> DataFrame:
    """(query, row, similarity) of all rows within the threshold of a query: no ranking, nothing is held or shuffled."""
    near = in_blocks(queries, query_id, lambda q: _near(rows, row_id, vector, q, query_id, query_vector, threshold, match, None))
    return near.select(F.col("query").alias(query_id), F.col("row").alias(row_id), "similarity")


def _near(rows: DataFrame, row_id: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, threshold: float, match: tuple[str, str] | None, k: int | None, within: tuple[str, str] | None = None) -> DataFrame:
    """(query, row, similarity) from the threshold on; with k, each task keeps its best k rows of each query."""
    plain = lambda pair, i, name: (F.lower(F.trim(F.col(pair[i]).cast("string"))) if pair else F.lit("")).alias(name)
    held = collect_queries(queries.select(F.col(query_id).alias("id"), F.col(query_vector).alias("v"), (F.lower(F.col(match[1]).cast("string")) if match else F.lit("")).alias("m"), plain(within, 1, "s")))
    textual = dict(rows.dtypes)[vector] == "string"
    matrix = (embed([r[1] for r in held], {}) if textual else np.array([r[1] for r in held], float)) if held else np.zeros((0, DIMENSIONS))
    keys = np.array([r[2] or "" for r in held], object)
    ids = np.array([r[0] for r in held], np.int64)
    sections = [r[3] or "" for r in held]
    shared = rows.sparkSession.sparkContext.broadcast((matrix, keys, ids))
    schema = pa.schema([("query", pa.int64()), ("row", pa.int64()), ("similarity", pa.float64())])

    def table(columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches):
        matrix, keys, ids = shared.value
        places: dict = {}
        best: list = []
        if not len(ids):
            return
        for b in batches:
            if not b.num_rows:
                continue
            at = b.column(0).to_numpy()
            if textual:
                v = embed(b.column(1).to_pylist(), places)
            else:
                v = np.array([x if x is not None else np.zeros(matrix.shape[1]) for x in b.column(1).to_numpy(zero_copy_only=False)], float)
            labels = np.array([x or "" for x in b.column(2).to_pylist()], object)[:, None] if match else None
            if within:
                # (row, query): whether one section contains the other, worked out once for each section
                named = b.column(3).to_pylist()
                placed = {x: np.array([bool(x) and bool(s) and (x in s or s in x) for s in sections]) for x in set(named)}
                fits = np.array([placed[x] for x in named])
            # some queries at a time, so that a batch's similarities stay small
            for low in range(0, len(ids), 1000):
                sim = np.round(np.clip(v @ matrix[low : low + 1000].T, 0.0, 1.0), 12)
                if match:
                    sim = np.where(labels == keys[None, low : low + 1000], sim, -1.0)
                if within:
                    sim = np.where(fits[:, low : low + 1000], sim, -1.0)
                r, q = np.nonzero(sim >= threshold)
                if k is None:
                    if len(r):
                        yield table((ids[low + q], at[r], sim[r, q]))
                    continue
                best.append((ids[low + q], at[r], sim[r, q]))
                if sum(len(x[0]) for x in best) > 200_000:
                    best = [_keep(best, k)]
        if best:
            yield table(_keep(best, k))

    given = rows.where(F.col(row_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(row_id).cast("long"), F.col(vector), (F.lower(F.col(match[0]).cast("string")) if match else F.lit("")).alias("m"), plain(within, 0, "s"))
    return given.mapInArrow(run, "query long, row long, similarity double").withColumn("similarity", F.bround("similarity", 4))


def _keep(parts: list, k: int) -> tuple[np.ndarray, ...]:
    """The best k rows of each query by (rounded similarity, row id), of columns (query, row, similarity)."""
    q, r, s = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((r, -np.round(s, 4), q))
    q, r, s = q[order], r[order], s[order]
    # a repeated row counts once
    first = np.r_[True, (q[1:] != q[:-1]) | (r[1:] != r[:-1]) | (np.round(s[1:], 4) != np.round(s[:-1], 4))] if len(q) else np.zeros(0, bool)
    q, r, s = q[first], r[first], s[first]
    start = np.r_[0, np.flatnonzero(np.diff(q)) + 1] if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return q[rank < k], r[rank < k], s[rank < k]


def with_fallback(hits: DataFrame, queries: DataFrame, query_id: str, row_id: str, first_row: int | None) -> DataFrame:
    """hits, and for each query without one the first row with a low fixed score."""
    none = queries.select(query_id).distinct().join(hits.select(query_id).distinct(), query_id, "left_anti")
    return hits.unionByName(none.select(query_id, F.lit(first_row).cast("long").alias(row_id), F.lit(FALLBACK_SCORE).alias("similarity"), F.lit(1).alias("rank")))


def phrase_matches(rows: DataFrame, row_id: str, text: str, phrases: DataFrame, phrase_id: str, phrase: str, block: int = 100_000) -> DataFrame:
    """(phrase_id, row_id) of every text that contains a phrase, without case and runs of white space.

    A block of phrases is sought at once with an Aho-Corasick automaton.
    """
    return in_blocks(phrases, phrase_id, lambda p: _phrase_block(rows, row_id, text, p, phrase_id, phrase), block)


def _phrase_block(rows: DataFrame, row_id: str, text: str, phrases: DataFrame, phrase_id: str, phrase: str) -> DataFrame:
    held = collect_queries(phrases.select(phrase_id, phrase).where(F.col(phrase).isNotNull() & (F.trim(phrase) != "")))
    flat = lambda t: " ".join(t.lower().split())
    by_text: dict[str, list] = {}
    for r in held:
        by_text.setdefault(flat(r[1]), []).append(str(r[0]))
    shared = rows.sparkSession.sparkContext.broadcast(by_text)
    schema = pa.schema([("phrase", pa.string()), ("row", pa.string())])

    def run(batches):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for t, ids in shared.value.items():
            machine.add_word(t, ids)
        machine.make_automaton()
        for b in batches:
            out = ([], [])
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for p in {p for _, ids in machine.iter(flat(t)) for p in ids}:
                    out[0].append(p)
                    out[1].append(i)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], schema=schema)

    kinds = dict(phrases.dtypes)[phrase_id], dict(rows.dtypes)[row_id]
    given = rows.where(F.col(row_id).isNotNull() & F.col(text).isNotNull()).select(F.col(row_id).cast("string"), F.col(text))
    if not by_text:
        return given.select(F.lit(None).cast(kinds[0]).alias(phrase_id), F.col(row_id).cast(kinds[1]).alias(row_id)).limit(0)
    return given.mapInArrow(run, "phrase string, row string").select(F.col("phrase").cast(kinds[0]).alias(phrase_id), F.col("row").cast(kinds[1]).alias(row_id)).distinct()
