"""Missing or wrong language labels (problem 8), by compression.

Each language has a dictionary of raw sentences; a sentence belongs to the language whose dictionary makes
it smallest under zstandard, and to none where the margin to the next is narrow. Sentences and lines too
short to be judged alone are joined with their short neighbours. Runs of sentences of one language are
segments, rejected ones are segments without a language; a document's language is that of most of its
characters.

The dictionaries are the model. They come from ``sample_docs`` labelled documents a language (lowest
hashes of their ids) and ``dictionary_bytes`` of text; as labels can be wrong and texts mixed, the
sentences are classified and those that disagree with their label are thrown out, ``rounds`` times. Only
this bounded sample reaches the driver.

Defined results: null ids or texts give no row; texts without a sentence (empty, only a heading) have no
language and no segments; pieces without a letter are no text; what cannot be judged even when joined is
rejected if it has a sentence, and ignored if it is a heading or fragment; a full sentence ends with a
full stop, question or exclamation mark and has at least ``least_words`` words; a language without
labelled sample is never assigned; repeated rows repeat.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LANGUAGES = ("en", "de", "fr", "es", "pt", "it")
# Three-letter codes and English names of the languages.
NAMES = {
    "en": ("eng", "english"),
    "de": ("deu", "ger", "german"),
    "fr": ("fra", "fre", "french"),
    "es": ("spa", "spanish"),
    "pt": ("por", "portuguese"),
    "it": ("ita", "italian"),
}
#: A language is assigned if its size is at least this share below the next one's.
MARGIN = 0.08
#: Characters from which a piece is judged alone, and a piece that ends like a sentence.
ALONE, ALONE_SENTENCE = 40, 20
#: Sentences that are compressed at a time.
BLOCK = 4096

_SENTENCE = re.compile(r"[^\n]+?(?:[.!?]+[\"'”’»)\]]*(?=\s|$)|(?=\n)|$)")
_LEAD = re.compile(r"^[\s#>*•\-–—|]*(?:\(?[0-9ivxIVX]{1,4}[.)]\s+|\(?[a-zA-Z][.)]\s+)?")
_FULL = re.compile(r"[.!?][\"'”’»)\]]*$")

FOUND = "language string, confidence double, segments array<struct<seg_lang:string,confidence:double,start_char:int,end_char:int,sentences:int>>"


def label_language(label: Column) -> Column:
    """The two-letter code that a label names, whatever its case, region or spelling; null if none."""
    primary = F.split(F.regexp_replace(F.lower(F.trim(label)), "_", "-"), "-")[0]
    known = F.create_map(*[F.lit(x) for code, names in NAMES.items() for name in (code, *names) for x in (name, code)])
    return known[primary]


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, text without markers) of each sentence or line."""
    out = []
    for m in _SENTENCE.finditer(text):
        s = m[0]
        start = m.start() + _LEAD.match(s).end()
        s = text[start : m.end()].rstrip()
        if s:
            out.append((start, start + len(s), " ".join(s.replace("\xad", "").split())))
    return out


def compressors(dictionaries: dict[str, bytes], level: int = 1) -> dict[str, zstandard.ZstdCompressor]:
    out = {}
    for lang, data in dictionaries.items():
        raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=level)
        out[lang] = zstandard.ZstdCompressor(level=level, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)
    return out


def judge(pieces: list[str], models: dict[str, zstandard.ZstdCompressor]) -> tuple[np.ndarray, np.ndarray]:
    """The number of the language with the smallest compressed size of each piece, and its margin to the next."""
    data = [p.lower().encode() for p in pieces]
    sizes = np.empty((len(models), len(data)), np.int64)
    for k, m in enumerate(models.values()):
        for i in range(0, len(data), BLOCK):
            out = m.multi_compress_to_buffer(data[i : i + BLOCK])
            sizes[k, i : i + BLOCK] = [len(out[j]) for j in range(len(out))]
    best = sizes.argmin(axis=0)
    if len(models) < 2:
        return best, np.zeros(len(data))
    least, rest = np.partition(sizes, 1, axis=0)[:2]
    return best, (rest - least) / rest


def classify(pieces: list[str], models: dict[str, zstandard.ZstdCompressor]) -> list[tuple[str, float]]:
    """The language with the smallest compressed size of each piece, and its margin to the next."""
    if not models or not pieces:
        return [("", 0.0)] * len(pieces)
    langs = list(models)
    return [(langs[k], g) for k, g in zip(*(x.tolist() for x in judge(pieces, models)))]


def units(text: str, least_words: int) -> list[tuple]:
    """(start, end, text or None, full sentences, characters) of what is judged as one.

    A piece that is long enough, or a run of short neighbours. text is None for sentences that stay too short.
    """
    out, run = [], []

    def close() -> None:
        joined = " ".join(p[2] for p in run)
        sentence = any(p[3] for p in run)
        if run and (len(joined) >= ALONE or sentence):
            enough = len(joined) >= (ALONE_SENTENCE if sentence else ALONE)
            out.append((run[0][0], run[-1][1], joined if enough else None, sum(p[4] for p in run), sum(p[1] - p[0] for p in run)))
        run.clear()

    size = 0
    for start, end, s in sentences(text):
        stop = bool(_FULL.search(s))
        words = s.count(" ") + 1
        full = int(stop and words >= least_words)
        if len(s) >= ALONE or (stop and len(s) >= ALONE_SENTENCE):
            close()
            size = 0
            out.append((start, end, s, full, end - start))
        elif any(c.isalpha() for c in s):
            run.append((start, end, s, stop and words > 1, full))
            size += len(s) + 1
            if size > ALONE:
                close()
                size = 0
    close()
    return out


def train(df: DataFrame, doc_id: str, text: str, label: str, languages: tuple[str, ...] = LANGUAGES, sample_docs: int = 250, dictionary_bytes: int = 1 << 16, rounds: int = 3, max_chars: int = 20_000) -> dict[str, bytes]:
    """The dictionaries, from at most sample_docs documents of at most max_chars for each language."""
    docs = df.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), label_language(F.col(label)).alias("named"), F.col(text).alias("t"))
    fit = docs.where(F.col("named").isin(*languages) & F.char_length("t").between(100, max_chars)).select("id", "named").distinct()
    order = Window.partitionBy("named").orderBy(F.xxhash64("id"), "id")
    ids = fit.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample_docs).select("id").distinct()
    # bounded by languages x sample_docs rows, also where an id is repeated
    texts = docs.join(F.broadcast(ids), "id", "left_semi").where(F.char_length("t") <= max_chars)
    picked = texts.groupBy("id").agg(F.min(F.struct("named", "t")).alias("x")).where("x.named is not null").select("x.named", F.xxhash64("id"), "x.t").collect()
    # two folds by text: a sentence is judged only with dictionaries of the other fold
    pool: list[dict[str, list[str]]] = [{}, {}]
    for i, (lang, t) in enumerate(dict.fromkeys((lang, t) for lang, _, t in sorted(picked))):
        pool[i % 2].setdefault(lang, []).extend(s.lower() for _, _, s in sentences(t) if len(s) >= 30)
    pool = [{lang: list(dict.fromkeys(p)) for lang, p in fold.items()} for fold in pool]
    kept = pool
    for _ in range(rounds):
        models = [compressors({lang: _dictionary(p, dictionary_bytes) for lang, p in fold.items() if p}) for fold in kept]
        kept = [{lang: [s for s, (found, gap) in zip(p, classify(p, models[1 - i])) if found == lang and gap >= MARGIN] for lang, p in fold.items()} for i, fold in enumerate(pool)]
    both = {lang: kept[0].get(lang, []) + kept[1].get(lang, []) for lang in sorted({*kept[0], *kept[1]})}
    return {lang: _dictionary(p, dictionary_bytes) for lang, p in both.items() if p}


def _dictionary(pieces: list[str], limit: int) -> bytes:
    out, n = [], 0
    for s in pieces:
        b = s.encode() + b"\n"
        if n + len(b) > limit:
            break
        out.append(b)
        n += len(b)
    return b"".join(out)


def identify(df: DataFrame, doc_id: str, text: str, dictionaries: dict[str, bytes], carry: tuple[str, ...] = (), margin: float = MARGIN, least_words: int = 5) -> DataFrame:
    """Each document's language with confidence, and its segments; carry: further columns to keep."""
    shared = df.sparkSession.sparkContext.broadcast(dictionaries)
    kept = df.select(doc_id, *carry).schema
    segment = pa.struct([("seg_lang", pa.string()), ("confidence", pa.float64()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("sentences", pa.int32())])

    def describe(found: list[tuple], best: list[int], gaps: list[float], langs: list[str]) -> tuple:
        """(language, confidence, segments) of one document."""
        segments: list[list] = []
        weight: dict[str, list[float]] = {}
        for (start, end, _, full, n), k, gap in zip(found, best, gaps):
            lang = langs[k] if gap >= margin else None
            if segments and segments[-1][0] == lang:
                x = segments[-1]
                x[1], x[3], x[4], x[5] = x[1] + gap * n, end, x[4] + full, x[5] + n
            else:
                segments.append([lang, gap * n, start, end, full, n])
            if lang:
                w = weight.setdefault(lang, [0, 0.0])
                w[0], w[1] = w[0] + n, w[1] + gap * n
        most = max(weight, key=lambda k: (weight[k][0], k)) if weight else None
        shown = [{"seg_lang": x[0], "confidence": x[1] / x[5], "start_char": x[2], "end_char": x[3], "sentences": x[4]} for x in segments]
        return most, weight[most][1] / weight[most][0] if most else None, shown

    def run(batches):
        models = compressors(shared.value)
        langs = list(models)
        for b in batches:
            texts = b.column(0).to_pylist()
            at, i = 0, 0
            while i < len(texts):
                # documents with enough sentences for one pass of compression
                lists, size = [], 0
                while i < len(texts) and size < BLOCK:
                    lists.append(units(texts[i], least_words) if models else [])
                    size += len(lists[-1])
                    i += 1
                asked = [u[2] for found in lists for u in found if u[2] is not None]
                best, gaps = (x.tolist() for x in judge(asked, models)) if asked else ([], [])
                places, out = iter(zip(best, gaps)), []
                for found in lists:
                    mine = [next(places) if u[2] is not None else (0, 0.0) for u in found]
                    out.append(describe(found, [m[0] for m in mine], [m[1] for m in mine], langs))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.float64(), pa.list_(segment)))]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, i - at) for c in b.columns[1:]), *columns], names=[*kept.names, "language", "confidence", "segments"])
                at = i

    rows = df.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("_text"), doc_id, *carry)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{fields}, {FOUND}")


def mislabelled(identified: DataFrame, doc_id: str, label: str, least_sentences: int = 2) -> DataFrame:
    """(doc_id, seg_lang) for each language with enough full sentences, of documents whose label is missing or wrong or that hold several such languages."""
    counts = F.aggregate(
        F.filter("segments", lambda x: x["seg_lang"].isNotNull()),
        F.create_map().cast("map<string,int>"),
        lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, _: k != x["seg_lang"]), F.create_map(x["seg_lang"], F.coalesce(F.try_element_at(acc, x["seg_lang"]), F.lit(0)) + x["sentences"])),
    )
    langs = F.map_keys(F.map_filter(counts, lambda _, v: v >= least_sentences))
    rows = identified.select(doc_id, label_language(F.col(label)).alias("named"), "language", langs.alias("langs"))
    wrong = F.col("named").isNull() | (F.col("named") != F.col("language"))
    return rows.where((F.size("langs") > 1) | wrong).select(doc_id, F.explode("langs").alias("seg_lang")).distinct()
