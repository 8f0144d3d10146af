"""Splitting oversized texts at natural boundaries (problem 3).

Content-defined chunking: a rolling hash over the characters marks landmarks; each cut is the natural
boundary nearest to the first landmark between the least and the greatest size, so an edit changes only
the pieces around it. Pieces after the first begin ``overlap`` characters before the previous cut.

Defined results: null texts or ids give no row; empty texts and texts within their limit are one piece; a
kind that is null or blank means ``default_kind``, a kind without a limit is never split; where there is
no natural boundary the landmark, else the limit, is the cut, never before a combining mark. Limits whose
overlap is half of them or more cannot be kept by pieces that only overlap their neighbours: they are
refused (``cuts`` alone takes just under half). Sizes are Unicode code points. Repeated rows give
repeated pieces.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small

#: Characters that a landmark depends on.
WINDOW = 16
BASE = 0x100000001B3
#: Ends of paragraphs, sentences and lines: natural boundaries. Then ends of words, where there are none.
_NATURAL = re.compile(r"\n\s*\n\s*|\r?\n|[.!?…][\"'”’»)\]]*\s+|[。！？｡؟।॥]+[”’」』】)]*\s*|;\s+")
_WORD_END = re.compile(r"\s+|(?<=[,:、，；：])")

PIECES = "record_kind string, record_id string, piece_no int, start_char int, end_char int, piece string"


def _landmarks(text: str, spacing: int) -> np.ndarray:
    """Positions behind which the rolling hash of the last WINDOW characters says so, about every ``spacing``."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    mixed = (codes + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    # h[i] = sum over the window of mixed[i - k] * BASE^k
    h = mixed.copy()
    for k in range(1, WINDOW):
        h[k:] += mixed[:-k] * np.uint64(pow(BASE, k, 1 << 64))
    h ^= h >> np.uint64(31)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    at = np.flatnonzero(h % np.uint64(max(1, spacing)) == 0) + 1
    return at[at >= WINDOW]


def _within(positions: np.ndarray, low: int, high: int) -> np.ndarray:
    return positions[np.searchsorted(positions, low) : np.searchsorted(positions, high, side="right")]


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of every piece of a text; each is at most ``limit`` long."""
    n, limit = len(text), max(1, limit)
    if n <= limit:
        return [(0, n)]
    overlap = max(0, min(overlap, (limit - 1) // 2))
    most = limit - overlap
    least = max(most // 3, min(overlap + 1, most), 1)
    marks = _landmarks(text, max(1, (most - least) // 3))
    natural = np.array([m.end() for m in _NATURAL.finditer(text)], dtype=np.int64)
    words = np.array([m.end() for m in _WORD_END.finditer(text)], dtype=np.int64)
    out, at = [], 0
    while n - at > most:
        low, high = at + least, at + most
        mark = _within(marks, low, high)
        target = int(mark[0]) if len(mark) else high
        for ends in (natural, words):
            near = _within(ends, low, high)
            if len(near):
                cut = int(near[np.argmin(np.abs(near - target))])
                break
        else:
            cut = target
            while cut > low and (unicodedata.combining(text[cut]) or text[cut] in "‍︎️" or text[cut - 1] == "‍"):
                cut -= 1
        out.append((max(0, at - overlap), cut))
        at = cut
    out.append((max(0, at - overlap), n))
    return out


def split_oversized(df: DataFrame, record_id: str, text: str, limits: DataFrame, kind, default_kind: str = "paragraph", keep_whole: bool = True) -> DataFrame:
    """Ordered pieces (columns of PIECES) of every row's text.

    kind: a column or expression that names the row's kind; limits (record_kind, max_chars,
    overlap_chars) is a reference table, of which the least limit counts where a kind stands twice. Texts
    within their limit never leave the JVM; with keep_whole=False they are left out.
    """
    kind = F.lower(F.trim(kind if not isinstance(kind, str) else F.col(kind)))
    named = F.when(F.coalesce(kind, F.lit("")) == "", F.lit(default_kind)).otherwise(kind)
    # tied to the row, so that a constant kind stays an equi-join
    named = F.when(F.col(record_id).isNotNull(), named)
    rows = df.select(named.alias("record_kind"), F.col(record_id).cast("string").alias("record_id"), F.col(text).alias("text")).where("record_id is not null and text is not null")
    bounds = limits.where("max_chars is not null").groupBy(F.lower(F.trim("record_kind")).alias("record_kind")).agg(F.min(F.struct("max_chars", "overlap_chars")).alias("b"))
    if (wide := bounds.where("b.max_chars > 0 and 2 * b.overlap_chars >= b.max_chars").first()) is not None:
        raise ValueError(f"an overlap of half the limit or more: {wide[0]}")
    rows = rows.join(broadcast_if_small(bounds), "record_kind", "left").withColumn("n", F.char_length("text"))
    over = rows.where("n > b.max_chars").select("record_kind", "record_id", "text", "b.max_chars", F.coalesce("b.overlap_chars", F.lit(0)).alias("overlap_chars"))
    schema = pa.schema([("record_kind", pa.string()), ("record_id", pa.string()), ("piece_no", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("piece", pa.string())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for k, rid, t, limit, overlap in zip(*(b.column(i).to_pylist() for i in range(5))):
                rows += [(k, rid, i, a, e, t[a:e]) for i, (a, e) in enumerate(cuts(t, limit, overlap))]
                if len(rows) > 5_000:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)

    pieces = over.mapInArrow(run, PIECES)
    if not keep_whole:
        return pieces
    whole = rows.where("b.max_chars is null or n <= b.max_chars").select("record_kind", "record_id", F.lit(0).alias("piece_no"), F.lit(0).alias("start_char"), F.col("n").alias("end_char"), F.col("text").alias("piece"))
    return whole.unionByName(pieces)
