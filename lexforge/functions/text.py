"""Text normalisation, tokens, hashes and heading rules as column expressions.

All stay on the JVM. Null in, null out, unless a function says otherwise; word and space classes are
Unicode-aware, so they agree with Python's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation that is made plain before texts are compared.
SMART = "\u201c\u201d\u2018\u2019\u2013\u2014\u00a0"
PLAIN = "\"\"''-- "
# Words that carry no content in token overlap.
STOP_WORDS = ("the", "and", "for", "with", "this", "that", "from", "are", "was", "were", "has", "have", "had", "not", "but", "can", "should", "will")
# Salt and form words dropped from drug names.
DRUG_NOISE = ("tablets?", "capsules?", "solution", "injection", "oral", "calcium", "sodium", "hydrochloride", "potassium", "maleate", "succinate", "tartrate", "fumarate")
# Units that belong to a number in numeric tokens.
NUMBER_UNITS = ("mg", "mcg", "g", "kg", "ml", "l", "%", "hours?", "hrs?", "days?", "weeks?", "months?", "years?", "tablet", "capsule", "tablets", "capsules")
# Texts that a scanned page leaves behind.
SCANNED_MARKERS = ("[scanned image-only pdf", "no digital text layer detected. image-only pdf")

# Section concepts, the first that matches a heading.
CONCEPTS = {
    "INDICATIONS": r"indications?\s+and\s+usage|therapeutic\s+indications?|indications?",
    "POSOLOGY_DOSAGE": r"posology\s+and\s+method\s+of\s+administration|dosage\s+and\s+administration|posology|dosage|method\s+of\s+administration|dosing",
    "DOSAGE_FORMS": r"dosage\s+forms\s+and\s+strengths|pharmaceutical\s+form|qualitative\s+and\s+quantitative\s+composition",
    "CONTRAINDICATIONS": r"contraindications?|contra-indications?",
    "WARNINGS": r"special\s+warnings\s+and\s+precautions\s+for\s+use|warnings\s+and\s+precautions|boxed\s+warning|black\s+box\s+warning|warnings?",
    "ADVERSE_REACTIONS": r"undesirable\s+effects?|adverse\s+reactions?|side\s+effects?|adverse\s+events?",
    "DRUG_INTERACTIONS": r"interaction\s+with\s+other\s+medicinal\s+products|drug\s+interactions?|interactions?",
    "POPULATIONS": r"fertility[,\s]+pregnancy\s+and\s+lactation|use\s+in\s+specific\s+populations|pediatric\s+use|geriatric\s+use|pregnancy|lactation|special\s+populations",
    "OVERDOSAGE": r"overdosage|overdose|toxicity",
    "CLINICAL_PHARM": r"pharmacological\s+properties|clinical\s+pharmacology|pharmacodynamics?|pharmacokinetics?|nonclinical\s+toxicology|clinical\s+particulars",
    "STORAGE_HANDLING": r"how\s+supplied[\s/]+storage\s+and\s+handling|pharmaceutical\s+particulars|special\s+precautions\s+for\s+storage|shelf\s+life|storage\s+and\s+handling|how\s+supplied",
}
# Headings that stand without a number.
STANDARD_HEADINGS = [
    "indications and usage", "dosage and administration", "dosage forms and strengths", "contraindications", "warnings and precautions", "adverse reactions",
    "drug interactions", "use in specific populations", "overdosage", "description", "clinical pharmacology", "nonclinical toxicology", "clinical studies",
    "how supplied/storage and handling", "patient counseling information", "boxed warning", "highlights of prescribing information",
    "name of the medicinal product", "qualitative and quantitative composition", "pharmaceutical form", "clinical particulars", "therapeutic indications",
    "posology and method of administration", "special warnings and precautions for use", "interaction with other medicinal products and other forms of interaction",
    "fertility, pregnancy and lactation", "effects on ability to drive and use machines", "undesirable effects", "overdose", "pharmacological properties",
    "pharmacodynamic properties", "pharmacokinetic properties", "preclinical safety data", "pharmaceutical particulars", "list of excipients", "incompatibilities",
    "shelf life", "special precautions for storage", "nature and contents of container", "special precautions for disposal",
    "summary", "introduction", "physical, chemical, and pharmaceutical properties and formulation", "nonclinical studies", "nonclinical pharmacology",
    "pharmacokinetics and product metabolism in animals", "toxicology", "effects in humans", "pharmacokinetics and product metabolism in humans",
    "safety and efficacy", "marketing experience", "summary of data and guidance for the investigator",
]

NUMBERED = r"^\s*(?:[Ss][Ee][Cc][Tt][Ii][Oo][Nn]\s+)?(\d+(?:\.\d+)*)[:.\-]?\s+(.+)$"
MARKDOWN = r"^\s*(#{1,6})\s+(.+)$"
BULLET = r"^\s*([*\-•–—])\s+(.+)$"
NUMBERED_ITEM = r"^\s*(?:\(([0-9]+|[a-zA-Z]|[ivxcdmIVXCDM]+)\)|([0-9]+|[a-zA-Z]|[ivxcdmIVXCDM]+)[.)])\s+(.+)$"


def plain(text: Column) -> Column:
    """Smart quotes, dashes and hard blanks made plain."""
    return F.translate(text, SMART, PLAIN)


def collapse(text: Column) -> Column:
    """One blank for each run of white space, none outside."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def fingerprint(text: Column, raw: Column | None = None) -> Column:
    """``fp_`` and 16 hex digits of the text's hash, blind to page marks, line ends and white space.

    Scanned or empty texts take the hash of their raw bytes, or of nothing.
    """
    clean = collapse(F.regexp_replace(F.regexp_replace(F.translate(plain(text), "\ufeff", ""), r"---\s*\[Page\s+\d+\]\s*---", ""), r"\[Page\s+\d+\]", ""))
    nothing = clean.isNull() | (clean == "")
    for marker in SCANNED_MARKERS:
        nothing = nothing | F.contains(F.lower(clean), F.lit(marker))
    body = F.when(nothing, F.coalesce(raw, F.lit(b"")) if raw is not None else F.lit(b"")).otherwise(F.encode(clean, "UTF-8"))
    return F.concat(F.lit("fp_"), F.left(F.sha2(body, 256), F.lit(16)))


def conservative(text: Column) -> Column:
    """Lower case, plain punctuation, one leading list mark and outer punctuation removed."""
    marked = F.regexp_replace(F.lower(plain(text)), r"^\s*[-*•\d.)(]+\s+", "")
    return F.btrim(collapse(marked), F.lit(" .,;:!?-"))


def aggressive(text: Column) -> Column:
    """Only lower-case words, single blanks between them."""
    return collapse(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " "))


def numeric_tokens(text: Column) -> Column:
    """Sorted distinct numbers with the unit behind them, without blanks."""
    units = "|".join(NUMBER_UNITS)
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"\b\d+(?:\.\d+)?(?:\s*(?:{units}))?\b"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\s+", ""))))


def drug_token(name: Column) -> Column:
    """A drug's name without salt and form words; empty for null."""
    clean = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-zA-Z0-9\s]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(clean, rf"\b({'|'.join(DRUG_NOISE)})\b", ""), r"\s+", " "))


def words3(text: Column) -> Column:
    """Distinct lower-case ASCII words of three characters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[a-zA-Z0-9]{3,}\b"), F.lit(0)))


def content_words(text: Column) -> Column:
    """words3 without stop words."""
    return F.array_except(words3(text), F.array(*[F.lit(w) for w in STOP_WORDS]))


def all_words(text: Column) -> Column:
    """Distinct lower-case words of any script."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w+\b"), F.lit(0)))


def blank_words(text: Column) -> Column:
    """Words between white space, repeated ones kept."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def chunk_id(document_id: Column, section_id: Column, kind: Column, order: Column, content: Column) -> Column:
    key = F.concat_ws(":", document_id, section_id, kind, order.cast("string"), F.left(content, F.lit(64)))
    return F.concat(F.lit("chk_"), F.left(F.sha2(key, 256), F.lit(12)))


def concept(heading: Column) -> Column:
    """The first section concept that a heading names, else null."""
    out = None
    for name, pattern in CONCEPTS.items():
        hit = F.rlike(heading, F.lit(rf"(?i)\b({pattern})\b"))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def heading(line: Column) -> Column:
    """STRUCT<kind, section_number, title, level, concept> of a heading line, null for other lines."""
    clean = F.trim(F.regexp_replace(line, r"(?U)^\s+|\s+$", ""))
    bare = F.rtrim(F.regexp_replace(clean, ":+$", ""))
    mark, title = F.regexp_extract(clean, MARKDOWN, 1), F.regexp_extract(clean, MARKDOWN, 2)
    inner, inner_title = F.regexp_extract(title, NUMBERED, 1), F.regexp_extract(title, NUMBERED, 2)
    number, text = F.regexp_extract(clean, NUMBERED, 1), F.regexp_extract(clean, NUMBERED, 2)
    n_words = F.size(blank_words(bare))

    def row(kind, number, title, level):
        t = F.trim(title)
        return F.struct(F.lit(kind).alias("kind"), number.alias("section_number"), t.alias("title"), level.cast("int").alias("level"), concept(t).alias("concept"))

    null = F.lit(None).cast("string")
    upper = (F.upper(bare) == bare) & (F.lower(bare) != bare) & n_words.between(1, 10) & (F.char_length(bare) <= 80)
    return (
        F.when((clean == "") | (F.char_length(clean) > 200), F.lit(None))
        .when(mark != "", row("markdown", F.nullif(inner, F.lit("")), F.when(inner != "", inner_title).otherwise(title), F.char_length(mark)))
        .when(number != "", row("numbered", number, text, F.size(F.split(number, r"\."))))
        .when(F.lower(bare).isin(*STANDARD_HEADINGS), row("standard", null, bare, F.lit(1)))
        .when(upper & (concept(bare).isNotNull() | (n_words >= 2)), row("uppercase", null, bare, F.lit(1)))
    )


def list_item(line: Column) -> Column:
    """STRUCT<item_type, marker, content> of a bullet, numbered, roman or lettered line, null for others."""
    clean = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    bullet = F.regexp_extract(clean, BULLET, 1)
    inner, outer = F.regexp_extract(clean, NUMBERED_ITEM, 1), F.regexp_extract(clean, NUMBERED_ITEM, 2)
    mark = F.when(inner != "", inner).otherwise(outer)
    kind = F.when(F.rlike(mark, F.lit("^[0-9]+$")), "numbered_item").when(F.rlike(mark, F.lit("^[ivxcdmIVXCDM]+$")), "roman_item").otherwise("lettered_item")

    def row(kind, marker, content):
        return F.struct(kind.alias("item_type"), marker.alias("marker"), F.trim(content).alias("content"))

    return F.when(bullet != "", row(F.lit("bullet"), bullet, F.regexp_extract(clean, BULLET, 2))).when(
        mark != "", row(kind, F.when(inner != "", F.concat(F.lit("("), inner, F.lit(")"))).otherwise(F.concat(outer, F.lit("."))), F.regexp_extract(clean, NUMBERED_ITEM, 3))
    )


def embedding_dim(word: Column) -> Column:
    """Dimension (0 to 255) of a word: the last byte of its MD5."""
    return F.conv(F.right(F.md5(word), F.lit(2)), 16, 10).cast("int")


def embedding_sign(word: Column) -> Column:
    """+1 or -1 by bit 8 of a word's MD5."""
    return F.lit(1) - F.lit(2) * (F.conv(F.substring(F.md5(word), 30, 1), 16, 10).cast("int") % 2)
