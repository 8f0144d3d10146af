"""Key facts and content types of regulatory texts: ordered rules, first hit wins.

The rules are fixed values; ``cascade`` turns a list of them into one CASE expression. Null text gives
nulls; blank text gives nulls and no purpose.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns are matched without case; the first that matches gives the label.
DOSE = r"\b(\d+(?:\.\d+)?(?:\s*(?:to|-)\s*\d+(?:\.\d+)?)?)\s*(mg|g|mcg|ml|tablets?|capsules?|drops?|puffs?|units?|mEq)\b"
EVERY_HOURS = r"\bevery\s+(\d+(?:\s*(?:to|-)\s*\d+)?)\s*hours?\b"
FREQUENCIES = [
    (r"\bonce\s+(?:each\s+day|daily|a\s+day)\b|\bdaily\b|\bq\s*d\b|\bq\.d\.\b", "once daily"),
    (r"\btwice\s+(?:daily|a\s+day|per\s+day)\b|\bb\s*i\s*d\b|\bb\.i\.d\.\b|\bbid\b", "twice daily"),
    (r"\bthree\s+times\s+(?:a|per)\s+day\b|\bt\s*i\s*d\b|\bt\.i\.d\.\b|\btid\b", "three times daily"),
    (r"\bfour\s+times\s+(?:a|per)\s+day\b|\bq\s*i\s*d\b|\bq\.i\.d\.\b|\bqid\b", "four times daily"),
    (EVERY_HOURS, None),
    (r"\bevery\s+morning\b", "every morning"),
    (r"\bat\s+bedtime\b", "at bedtime"),
    (r"\bas\s+needed\b|\bprn\b|\bp\.r\.n\.\b", "as needed"),
    (r"\bq\s*4\s*h\b", "every 4 hours"),
    (r"\bq\s*6\s*h\b", "every 6 hours"),
    (r"\bq\s*8\s*h\b", "every 8 hours"),
    (r"\bq\s*12\s*h\b", "every 12 hours"),
]
ROUTES = [
    (r"\borally\b|\bby\s+mouth\b|\boral\b|\bpo\b|\bp\.o\.\b", "Oral"),
    (r"\bintravenous(?:ly)?\b|\bIV\b|\bi\.v\.\b", "Intravenous"),
    (r"\bsubcutaneous(?:ly)?\b|\bSC\b|\bSubQ\b|\bs\.c\.\b", "Subcutaneous"),
    (r"\bintramuscular(?:ly)?\b|\bIM\b|\bi\.m\.\b", "Intramuscular"),
    (r"\btopical(?:ly)?\b", "Topical"),
    (r"\binhalation\b|\binhaled\b", "Inhalation"),
    (r"\bophthalmic\b", "Ophthalmic"),
    (r"\botic\b", "Otical"),
]
POPULATIONS = [
    (r"\bpediatric\s+(?:patients?|population)\b|\bchildren\b|\bchild\b|\bpediatrics?\b|\b2\s+to\s+12\s+years\b|\bunder\s+18\s+years\b", "Pediatric patients"),
    (r"\badults?(?:\s+and\s+children\s+12\s+years\s+and\s+over)?\b|\badult\s+(?:patients?|population)\b|\bin\s+adults\b|\b18\s+years\s+(?:of\s+age\s+)?and\s+older\b", "Adults"),
    (r"\bgeriatric\s+(?:patients?|population)\b|\belderly\b|\b65\s+years\s+(?:of\s+age\s+)?and\s+older\b", "Geriatric patients"),
    (r"\bneonates?\b|\bnewborns?\b", "Neonates"),
    (r"\binfants?\b", "Infants"),
]
AGES = [
    r"\b18\s+years\s+(?:of\s+age\s+)?and\s+older\b",
    r"\b12\s+years\s+(?:of\s+age\s+)?and\s+older\b",
    r"\bunder\s+12\s+years\b",
    r"\bunder\s+18\s+years\b",
    r"\b60\s+years\s+and\s+over\b",
    r"\b65\s+years\s+and\s+over\b",
    r"\b2\s+to\s+11\s+years\b",
    r"\b2\s+to\s+12\s+years\b",
]
STEM = r"\b([A-Za-z]+(?:olol|artan|statin|pril|dipine|prazole|mab|nib|xaban|cillin|mycin|floxacin|zole|triptan|tide|lukast|semide|vir|gliptin|glitazone|afil|dopa|asone|tidine|sone|pam|lam))\b"
AMOUNT_OF = r"\b\d+(?:\.\d+)?\s*(?:mg|g|mcg|ml)?\s+of\s+([A-Za-z0-9\-]+)\b"
NOT_AFTER_OF = ["water", "food", "liquid", "solution", "each", "this", "the"]
BEFORE_AMOUNT = r"\b([A-Za-z0-9\-]{4,25})\s+\d+(?:\.\d+)?\s*(?:mg|g|mcg|ml)\b"
NOT_BEFORE = ["take", "administer", "receive", "dose", "give", "adults", "initial", "maximum"]
DESIGNATION = r"\b(Drug\s+[A-Z0-9]+|Product\s+[A-Z0-9]+)\b"
DURATION = r"\b(?:for|up to|during)\s+(\d+(?:\s*(?:to|-)\s*\d+)?\s+(?:days?|weeks?|months?|hours?))\b|\b(\d+(?:\s*(?:to|-)\s*\d+)?\s+(?:days?|weeks?|months?))\s+(?:of\s+treatment|course|therapy|duration)\b"
INDICATION = r"\b(?:indicated for|treatment of|relief of|to relieve|for the management of|management of)\s+([^.,;\n]+)"
CONDITION = r"\bfor\s+(hypertension|chronic\s+pain(?: management)?|uncomplicated\s+migraine(?: attacks)?|type\s+2\s+diabetes|major\s+depression|asthma)\b"
SAFETY = r"\b(?:contraindicated\s+in|contraindicated|warning[:\s]|do\s+not\s+use\s+if|caution[:\s]|adverse\s+reactions?[:\s]|boxed\s+warning[:\s])\s*([^.,;\n]+)"
STUDY = r"\b(clinical\s+trials?|patients\s+received|in\s+study\s+\d+|experienced\s+nausea|adverse\s+events?\s+were|placebo)\b"
CONTRA = r"\b(contraindicated|contraindication|do\s+not\s+use|hypersensitivity)\b"
INDICATED = r"\b(indicated\s+for|treatment\s+of|management\s+of|relief\s+of)\b"
# Known drug names, in order of precedence.
KNOWN_DRUGS = (
    "aspirin", "acetylsalicylic acid", "ibuprofen", "acetaminophen", "paracetamol", "naproxen", "amoxicillin", "atorvastatin", "metformin", "lisinopril", "amlodipine", "omeprazole", "losartan",
    "gabapentin", "hydrochlorothiazide", "sertraline", "simvastatin", "pantoprazole", "furosemide", "prednisone", "metoprolol", "albuterol", "levothyroxine", "citalopram", "escitalopram",
    "fluoxetine", "venlafaxine", "duloxetine", "rosuvastatin", "pravastatin", "valsartan", "candesartan", "irbesartan", "olmesartan", "ramipril", "enalapril", "carvedilol", "atenolol", "propranolol",
    "bisoprolol", "diltiazem", "verapamil", "nifedipine", "spironolactone", "clopidogrel", "warfarin", "apixaban", "rivaroxaban", "dabigatran", "heparin", "montelukast", "fluticasone", "budesonide",
    "cetirizine", "loratadine", "esomeprazole", "famotidine", "ranitidine", "ondansetron", "sumatriptan", "zolmitriptan", "semaglutide", "liraglutide", "dulaglutide", "empagliflozin", "dapagliflozin",
    "sitagliptin", "linagliptin", "tramadol", "codeine", "morphine", "oxycodone", "fentanyl", "methadone", "buprenorphine", "ciprofloxacin", "levofloxacin", "azithromycin", "doxycycline",
    "cephalexin", "sulfamethoxazole", "trimethoprim", "metronidazole", "fluconazole", "acyclovir", "adalimumab", "infliximab", "rituximab", "pembrolizumab", "trastuzumab",
)
# Canonical spellings.
CANONICAL_ROUTES = [("oral|po|by mouth|orally", "Oral"), ("intravenous|iv|intravenously", "Intravenous"), ("subcutaneous|sc|subq|subcutaneously", "Subcutaneous"), ("intramuscular|im|intramuscularly", "Intramuscular"), ("topical|topically", "Topical"), ("inhalation|inhaled", "Inhalation")]
CANONICAL_FREQUENCIES = [
    ("once daily|daily|qd|once a day|once each day|every day", "once daily"),
    ("twice daily|bid|twice a day|per day twice", "twice daily"),
    ("three times daily|tid|three times a day", "three times daily"),
    ("four times daily|qid|four times a day", "four times daily"),
]
CANONICAL_UNITS = [("mg|milligram|milligrams", "mg"), ("mcg|ug|microgram|micrograms", "mcg"), ("g|gram|grams", "g"), ("ml|milliliter|milliliters", "ml"), ("tablet|tablets|tab|tabs", "tablet"), ("capsule|capsules|cap|caps", "capsule")]
# Content types by section, then by text.
TYPE_BY_SECTION = [("dosage|administration", "dosage_statement"), ("indication|usage", "indication_statement"), ("contraindication|warning|adverse", "safety_statement"), ("clinical|study|pharmacology", "clinical_statement")]
TYPE_BY_TEXT = [
    (r"\b(contraindicated|warning|caution|boxed warning|do not use|adverse reaction|black box)\b", "safety_statement"),
    (r"\b(dose|dosage|administer|take\s+\d+|daily|every\s+\d+\s+hours?|mg|tablets?|capsules?)\b", "dosage_statement"),
    (r"\b(indicated for|treatment of|relief of|to treat|management of|indicated as)\b", "indication_statement"),
    (r"\b(pediatric|children|neonates|infants|geriatric|elderly|adults\s+only|age\s+group)\b", "population_statement"),
    (r"\b(in\s+clinical\s+trials?|randomized|placebo|study\s+\d+|efficacy|pharmacokinetics)\b", "clinical_statement"),
    (r"\b(prescribing information|fda approved|spl|package insert|how supplied|storage)\b", "regulatory_statement"),
]
FIELD_LINE = r"^[A-Z0-9_\-\s]{2,20}\s*:\s*[^\n]+$"


def has(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(f"(?i){pattern}"))


def get(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none."""
    return F.nullif(F.regexp_extract(text, f"(?i){pattern}", group), F.lit(""))


def cascade(text: Column, rules: list[tuple[str, object]], otherwise=None) -> Column:
    """The value of the first pattern that matches."""
    out = None
    for pattern, value in rules:
        out = F.when(has(text, pattern), value) if out is None else out.when(has(text, pattern), value)
    return out if otherwise is None else out.otherwise(otherwise)


def title_case(text: Column) -> Column:
    """Each run of letters with a capital first."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0)), lambda x: F.initcap(x)), "")


def known_drug(text: Column) -> Column:
    """The known drug in the text that stands first in the list."""
    names = F.array(*[F.lit(d) for d in KNOWN_DRUGS])
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"\b({'|'.join(KNOWN_DRUGS)})\b"), F.lit(1))
    return F.initcap(F.try_element_at(names, F.array_min(F.transform(found, lambda x: F.array_position(names, x).cast("int")))))


def key_information(text: Column) -> list[Column]:
    """dose, dose_unit, frequency, route, population, age_group, drug, product, duration, indication, safety_information and purpose."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    low = F.lower(t)
    dose = F.concat(get(t, DOSE, 1), F.lit(" "), get(t, DOSE, 2))
    frequency = cascade(low, [(p, v if v else F.concat(F.lit("every "), get(low, p, 1), F.lit(" hours"))) for p, v in FREQUENCIES])
    after, before = get(t, AMOUNT_OF), get(t, BEFORE_AMOUNT)
    designation = title_case(get(t, DESIGNATION))
    drug = F.coalesce(known_drug(t), F.when(~F.lower(after).isin(NOT_AFTER_OF), title_case(after)), F.when(~F.lower(before).isin(NOT_BEFORE), title_case(before)), title_case(get(t, STEM)), designation)
    indication = F.coalesce(F.trim(get(t, INDICATION)), F.trim(get(t, CONDITION)))
    purpose = (
        F.when(t == "", F.lit(None))
        .when(has(low, STUDY), "Clinical Study Observation")
        .when(has(low, CONTRA), "Safety / Contraindication")
        .when(has(low, INDICATED), "Therapeutic Indication")
        .when(dose.isNotNull() | frequency.isNotNull() | low.contains("take") | low.contains("administer"), "Dosing Specification")
        .when(t.isNotNull(), "General Prescribing Directive")
    )
    return [
        dose.alias("dose"),
        F.lower(get(t, DOSE, 2)).alias("dose_unit"),
        frequency.alias("frequency"),
        cascade(t, ROUTES).alias("route"),
        cascade(t, POPULATIONS).alias("population"),
        F.coalesce(*[get(t, p, 0) for p in AGES]).alias("age_group"),
        drug.alias("drug"),
        designation.alias("product"),
        F.trim(F.coalesce(get(t, DURATION, 1), get(t, DURATION, 2))).alias("duration"),
        indication.alias("indication"),
        F.trim(get(t, SAFETY)).alias("safety_information"),
        purpose.alias("purpose"),
    ]


def _canonical(value: Column, rules: list[tuple[str, str]], otherwise: Column) -> Column:
    return cascade(value, [(f"^(?:{names})$", label) for names, label in rules], otherwise)


def canonical_route(route: Column) -> Column:
    r = F.nullif(F.trim(route), F.lit(""))
    return F.when(r.isNotNull(), _canonical(F.regexp_replace(F.lower(r), r"\.", ""), CANONICAL_ROUTES, title_case(r)))


def canonical_frequency(frequency: Column) -> Column:
    f = F.nullif(F.lower(F.trim(frequency)), F.lit(""))
    return F.when(f.isNotNull(), _canonical(F.regexp_replace(f, r"\.", ""), CANONICAL_FREQUENCIES, f))


def canonical_unit(unit: Column) -> Column:
    u = F.nullif(F.lower(F.trim(unit)), F.lit(""))
    return F.when(u.isNotNull(), _canonical(u, CANONICAL_UNITS, u))


def content_type(text: Column, section: Column) -> Column:
    """The content type by field form, table marks, section, then text."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    hint = F.coalesce(F.lower(section), F.lit(""))
    out = F.when(text.isNull(), F.lit(None)).when(F.rlike(t, F.lit(FIELD_LINE)), "structured_field").when(text.contains("|") | text.contains("\t"), "table_content")
    for pattern, label in TYPE_BY_SECTION:
        out = out.when(F.rlike(hint, F.lit(pattern)), label)
    for pattern, label in TYPE_BY_TEXT:
        out = out.when(has(F.lower(t), pattern), label)
    return out.otherwise("general_regulatory_content")
