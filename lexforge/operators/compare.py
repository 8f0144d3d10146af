"""Pairwise comparison of passages across six dimensions, set at a time.

``compare`` adds to a table of pairs (target_text, candidate_text, and optionally their sections and the
candidate's content type) a status and a score for each dimension, the false-match reasons, and the list
of differences. The work is staged in a few projections: facts of either side, flags, dimensions.

Defined results: a pair with a null text on either side has null statuses and no differences; blank texts
compare as narrative paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import extract as K
from ..functions import text as X

DIMENSIONS = ("meaning", "template", "context", "structure", "format", "key_information")
FACTS = ("dose", "dose_unit", "frequency", "route", "population", "age_group", "drug", "product", "duration", "indication", "safety_information")

# The wording of context reasons and of the warning; pairs stand before and between two values.
GROUP_REASON = ("Specialized population context disparity: current applies to ", ", whereas candidate applies to ")
SECTION_REASON = ("Regulatory section context disparity: target content is from '", "', whereas candidate originates from '")
STUDY_REASON = "Context mismatch: one statement describes clinical study observations, whereas the other provides prescribing recommendations."
SAFETY_REASON = "Context mismatch: therapeutic indication context compared against contraindication safety context."
WARNING = "FALSE MATCH WARNING: High semantic similarity masks critical regulatory discrepancy ("
# Patterns on lower-case text that raise a flag.
FLAGS = {
    "contra": r"\b(contraindicated|contraindication|do not use|hypersensitiv)\b",
    "ind": r"\b(indicated|treatment of|management of|relief of)\b",
    "food": r"\b(with\s+(?:food|meals?)|take\s+with\s+(?:food|meals?)|co-administered\s+with\s+food)\b",
    "fast": r"\b(without\s+food|on\s+an\s+empty\s+stomach|fasting|1\s+hour\s+before\s+meals?)\b",
    "whole": r"\b(do\s+not\s+(?:crush|chew|divide)|must\s+not\s+be\s+crushed|swallow\s+whole)\b",
    "crush": r"\b(may\s+be\s+(?:crushed|chewed)|can\s+be\s+crushed|chewable)\b",
    "study": r"\b(clinical\s+trial|patients\s+received|study\s+\d+|in\s+trials?|experienced\s+nausea|adverse\s+events?|were\s+monitored)\b",
    "contra_use": r"\b(contraindicated|contraindication|do\s+not\s+use)\b",
    "ind_use": r"\b(indicated|treatment\s+of|management\s+of)\b",
}
# Words that bind and words that advise.
MANDATORY = ["must", "shall", "required", "contraindicated", "do not"]
ADVISORY = ["may", "should", "consider", "recommended", "optional"]
# Patient groups by pattern, the first that matches.
SUBGROUPS = [
    (r"\b(renal\s+impairment|kidney\s+disease|crcl\b|creatinine\s+clearance|dialysis|esrd|gfr\b|<\s*30\s*ml/min)\b", "renal impairment"),
    (r"\b(hepatic\s+impairment|liver\s+disease|cirrhosis|child-pugh)\b", "hepatic impairment"),
    (r"\b(pregnancy|pregnant\s+women|teratogen|fetal\s+harm|first\s+trimester)\b", "pregnancy"),
    (r"\b(lactation|nursing\s+mothers|breast\s*feeding|human\s+milk)\b", "lactation"),
    (r"\b(pediatric|children|child\b|infants?|neonates?|2\s+to\s+12\s+years|under\s+18\s+years)\b", "pediatric"),
    (r"\b(geriatric|elderly|65\s+years\s+(?:of\s+age\s+)?and\s+older)\b", "geriatric"),
    (r"\b(adults?|adult\s+patients?)\b", "general adult"),
]
# Label sections by pattern, the first that matches.
SECTIONS = [
    (r"\bcontraindications?\b", "Contraindications"),
    (r"\b(?:overdose|overdosage)\b", "Overdosage"),
    (r"\b(?:adverse\s+reactions?|undesirable\s+effects?|side\s+effects?)\b", "Adverse Reactions"),
    (r"\b(?:warnings?|precautions?)\b", "Warnings and Precautions"),
    (r"\b(?:dosage|posology|administration|how\s+to\s+take)\b", "Dosage and Administration"),
    (r"\b(?:indications?|therapeutic\s+indications?|usage)\b", "Indications and Usage"),
    (r"\b(?:clinical\s+pharmacology|pharmacodynamics?|pharmacokinetics?)\b", "Clinical Pharmacology"),
    (r"\b(?:specific\s+populations?|special\s+populations?)\b", "Use in Specific Populations"),
]
# Sections whose contents do not stand for each other.
INCOMPATIBLE = [
    ("Dosage and Administration", "Adverse Reactions"),
    ("Dosage and Administration", "Overdosage"),
    ("Dosage and Administration", "Indications and Usage"),
    ("Indications and Usage", "Adverse Reactions"),
    ("Indications and Usage", "Contraindications"),
    ("Contraindications", "Dosage and Administration"),
    ("Warnings and Precautions", "Dosage and Administration"),
]
FAMILIES = [
    (r"\b(contraindicated|contraindication|do\s+not\s+use\s+in|do\s+not\s+use\s+if)\b", "CONTRAINDICATION"),
    (r"\b(indicated\s+for|treatment\s+of|for\s+the\s+management\s+of|as\s+monotherapy)\b", "INDICATION"),
]
DOSING_WORDS = r"\b(dose|dosage|administer|take\s+\d+|starting\s+dose|titrat)\b"
# Slots of each family: name, facts of which one suffices, pattern.
SLOTS = {
    "POSOLOGY": [
        ("Target Population", ["population"], r"\b(adults?|pediatric|children|elderly|geriatric|patients?)\b"),
        ("Initial/Starting Dose", [], r"\b(starting\s+dose|initial\s+dose|starting\s+dosage|initial\s+dosage|recommended\s+(?:starting\s+)?dose)\b"),
        ("Frequency", ["frequency"], r"\b(once\s+daily|twice\s+daily|every\s+\d+\s+hours?|daily|bid|tid|qd|as\s+needed)\b"),
        ("Titration/Interval", [], r"\b(titrat|increase\s+by|every\s+\d+\s+(?:days|weeks)|adjust(?:ed)?)\b"),
        ("Maximum Dose", [], r"\b(maximum|not\s+to\s+exceed|max(?:\.|\s+dose))\b"),
        ("Administration Route", ["route"], r"\b(oral|orally|by\s+mouth|intravenous|iv|subcutaneous|sc|im)\b"),
    ],
    "INDICATION": [
        ("Drug/Product", ["drug", "product"], None),
        ("Indication/Condition", ["indication"], r"\b(indicated\s+for|treatment\s+of|relief\s+of|management\s+of)\b"),
        ("Patient Population", ["population"], r"\b(in\s+adults?|in\s+pediatric|in\s+children|in\s+patients)\b"),
        ("Monotherapy/Adjunct context", [], r"\b(as\s+monotherapy|in\s+combination\s+with|as\s+adjunct(?:ive)?|adjunct\s+to|concomitantly)\b"),
    ],
    "CONTRAINDICATION": [
        ("Drug/Product", ["drug", "product"], None),
        ("Contraindicated Condition/Population", ["safety_information"], r"\b(contraindicated\s+in|contraindication|do\s+not\s+use\s+if|hypersensitivity\s+to)\b"),
    ],
}
STEP_LINE = r"(?im)^(?:step\s+\d+|[0-9]+\.\s+|initial:|maintenance:|titration:)"
FIELD = r"^[A-Z][a-zA-Z\s]{2,25}:\s+[^\n]+$"
QUANTITY = r"\b\d+(?:\.\d+)?(?:\s*(?:to|-)\s*\d+(?:\.\d+)?)?\s*(?:mg|g|mcg|ml|tablets?|capsules?|drops?|units?|mEq|%)\b"
RANGE = r"\b\d+(?:\.\d+)?\s*(?:to|-)\s*\d+(?:\.\d+)?\s*(?:mg|g|mcg|ml|tablets?|capsules?)\b"
SHORTHAND = r"\b\d+\s*(?:mg|g|mcg|ml)\s+(?:PO|IV|SC|IM)\s+(?:QD|BID|TID|QID|PRN|q\s*\d+\s*h)\b"

DIFFERENCE = "array<struct<attribute:string,current_value:string,candidate_value:string,source_dimension:string>>"


def _terms(low: Column, terms: list[str]) -> Column:
    return F.filter(F.array(*[F.when(F.rlike(low, F.lit(rf"\b{t}\b")), t) for t in terms]), lambda x: x.isNotNull())


def _side(text: str, section: str | None, kind: str | None) -> Column:
    """All facts and flags of one side as a struct."""
    t = F.col(text)
    low = F.lower(t)
    clean = F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    flags = [F.rlike(low, F.lit(p)).alias(n) for n, p in FLAGS.items()]
    item = F.col(kind) if kind else F.lit(None).cast("string")
    structure = (
        F.when(clean.contains("|") | clean.contains("\t") | item.eqNullSafe("table_row"), "table_row")
        .when(F.rlike(clean, F.lit(STEP_LINE)) | item.eqNullSafe("numbered_item"), "numbered_step")
        .when(F.rlike(clean, F.lit(r"^[-•*]")) | t.contains("\n-") | item.eqNullSafe("bullet"), "bullet_item")
        .when(item.eqNullSafe("structured_field") | F.rlike(clean, F.lit(FIELD)), "structured_field")
        .when(clean.startswith("#") | item.eqNullSafe("heading"), "heading")
        .otherwise("paragraph")
    )
    section = F.nullif(F.col(section), F.lit("")) if section else F.lit(None).cast("string")
    return F.struct(
        *K.key_information(t)[:-1],
        *flags,
        _terms(low, MANDATORY).alias("mandatory"),
        _terms(low, ADVISORY).alias("advisory"),
        K.cascade(low, SUBGROUPS).alias("subgroup"),
        section.alias("section"),
        F.when(section.isNotNull(), K.cascade(F.lower(F.trim(section)), SECTIONS, section)).alias("concept"),
        structure.alias("structure"),
        *[K.has(t, p).alias(n) for n, p in (("quantity", QUANTITY), ("range", RANGE), ("shorthand", SHORTHAND))],
        F.rlike(low, F.lit(r"take|administer")).alias("dosing_verb"),
        *[F.contains(low, F.lit(w)).alias(n) for n, w in (("prior_to", "prior to"), ("following", "following"), ("bolus", "rapid bolus"), ("over", "over"))],
        X.all_words(t).alias("words"),
        low.alias("low"),
    )


def _derived(side: str) -> list[Column]:
    """Template family, slots and dosing flag of one side."""
    c = lambda name: F.col(f"{side}.{name}")
    low = c("low")
    dosed = c("dose").isNotNull() | c("frequency").isNotNull()
    family = K.cascade(low, FAMILIES, F.when(dosed | F.rlike(low, F.lit(DOSING_WORDS)), "POSOLOGY").otherwise("NARRATIVE"))
    out = [(dosed | c("dosing_verb")).alias(f"{side}_dosed"), family.alias(f"{side}_family")]
    for name, slots in SLOTS.items():
        marks = []
        for slot, facts, pattern in slots:
            hit = F.rlike(low, F.lit(pattern)) if pattern else F.lit(False)
            for fact in facts:
                hit = hit | c(fact).isNotNull()
            if slot == "Initial/Starting Dose":
                hit = hit | (c("dose").isNotNull() & ~F.rlike(low, F.lit(r"\bmaximum\b")))
            marks.append(F.when(hit, slot))
        out.append(F.filter(F.array(*marks), lambda x: x.isNotNull()).alias(f"{side}_{name.lower()}"))
    return out


def _differ(a: Column, b: Column) -> Column:
    """Both known and different without case and outer blanks."""
    return F.coalesce(F.lower(F.trim(a)) != F.lower(F.trim(b)), F.lit(False))


def _diff(when: Column, attribute: str, current: Column, candidate: Column, dimension: str) -> Column:
    return F.when(when, F.struct(F.lit(attribute).alias("attribute"), current.alias("current_value"), candidate.alias("candidate_value"), F.lit(dimension).alias("source_dimension")))


def _pick(*cases: tuple[Column, str, object]) -> tuple[Column, Column]:
    """(status, score) of the first case that holds."""
    status = score = None
    for when, s, x in cases:
        x = F.lit(x).cast("double") if not isinstance(x, Column) else x
        status = F.when(when, s) if status is None else status.when(when, s)
        score = F.when(when, x) if score is None else score.when(when, x)
    return status, score


def compare(pairs: DataFrame, target: str = "target_text", candidate: str = "candidate_text", target_section: str | None = None, candidate_section: str | None = None, candidate_type: str | None = None) -> DataFrame:
    """pairs with <dimension>_status, <dimension>_score, false_match, false_match_reasons and differences."""
    keep = pairs.columns
    known = F.col(target).isNotNull() & F.col(candidate).isNotNull()
    # AQE cannot merge projections across this boundary: facts are computed once
    sides = pairs.withColumn("a", F.when(known, _side(target, target_section, None))).withColumn("b", F.when(known, _side(candidate, candidate_section, candidate_type)))
    x = sides.select("*", *_derived("a"), *_derived("b"))
    a, b = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    both = known
    true = F.lit(True)
    # key information
    canon = {"dose_unit": K.canonical_unit, "frequency": K.canonical_frequency, "route": K.canonical_route}
    off = {n: F.coalesce(canon[n](a(n)) != canon[n](b(n)), F.lit(False)) if n in canon else _differ(a(n), b(n)) for n in FACTS}
    off["dose"] = off["dose"] & ~off["dose_unit"]
    one_drug = a("drug").isNull() != b("drug").isNull()
    said = lambda label, n, verb: F.concat(F.lit(f"{label} mismatch: target {verb} '"), a(n), F.lit(f"' but candidate {verb} '"), b(n), F.lit("'"))
    key_reasons = [F.when(off[n], said(label, n, verb)) for n, label, verb in (("drug", "Drug", "specifies"), ("product", "Product", "specifies"), ("population", "Population", "applies to"), ("dose_unit", "Dose unit", "specifies"))]
    key_diffs = [F.when(off["drug"], F.struct(F.lit("drug").alias("attribute"), a("drug").alias("current_value"), b("drug").alias("candidate_value"), F.lit("key_information").alias("source_dimension")))]
    key_diffs.append(_diff(one_drug, "drug", F.coalesce(a("drug"), F.lit("Unspecified")), F.coalesce(b("drug"), F.lit("Unspecified")), "key_information"))
    key_diffs += [_diff(off[n], n, a(n), b(n), "key_information") for n in ("product", "population", "dose_unit", "dose", "frequency", "route", "duration", "indication", "age_group")]
    # context
    group_off = F.coalesce(a("subgroup") != b("subgroup"), F.lit(False))
    section_off = F.coalesce(a("concept") != b("concept"), F.lit(False))
    pair = F.concat_ws("|", a("concept"), b("concept"))
    clash = pair.isin([f"{m}|{n}" for m, n in INCOMPATIBLE] + [f"{n}|{m}" for m, n in INCOMPATIBLE])
    study_off = a("study") != b("study")
    opposed = lambda ind, contra: (a(ind) & ~a(contra) & b(contra)) | (a(contra) & b(ind) & ~b(contra))
    context_cases = [(group_off, "MISMATCH", 0.35), (section_off & clash, "MISMATCH", 0.35), (section_off, "PARTIAL", 0.65), (study_off, "MISMATCH", 0.35), (opposed("ind_use", "contra_use"), "MISMATCH", 0.25), (true, "MATCH", 0.90)]
    context_status, context_score = _pick(*context_cases)
    context_reason = (
        F.when(group_off, F.concat(F.lit(GROUP_REASON[0]), a("subgroup"), F.lit(GROUP_REASON[1]), b("subgroup"), F.lit(".")))
        .when(section_off & clash, F.concat(F.lit(SECTION_REASON[0]), a("section"), F.lit(SECTION_REASON[1]), b("section"), F.lit("'.")))
        .when(section_off, F.lit(None))
        .when(study_off, F.lit(STUDY_REASON))
        .when(opposed("ind_use", "contra_use"), F.lit(SAFETY_REASON))
    )
    purpose = lambda c: F.when(c("study"), "Clinical study observation").otherwise("Prescribing directive")
    context_diffs = [
        _diff(group_off, "context", a("subgroup"), b("subgroup"), "context"),
        _diff(~group_off & section_off, "context", a("section"), b("section"), "context"),
        _diff(~group_off & ~section_off & study_off, "context", purpose(a), purpose(b), "context"),
    ]
    # false matches
    shared = F.size(F.array_intersect(a("words"), b("words"))) / F.greatest(F.size(F.array_union(a("words"), b("words"))), F.lit(1))
    alike = shared >= 0.4
    raw_dose_off = F.coalesce(F.lower(a("dose")) != F.lower(b("dose")), F.lit(False))
    reasons = F.filter(
        F.array(*key_reasons, F.when(context_status == "MISMATCH", context_reason), F.when(alike & raw_dose_off, said("Dose", "dose", "specifies")), F.when(alike & off["route"], said("Route", "route", "specifies"))),
        lambda r: r.isNotNull(),
    )
    key_off = off["drug"] | off["product"] | off["population"] | off["dose_unit"]
    any_key_diff = one_drug
    for n in ("dose", "frequency", "route", "duration", "indication", "age_group"):
        any_key_diff = any_key_diff | off[n]
    false_match = key_off | (context_status == "MISMATCH") | (alike & (raw_dose_off | off["route"]))
    # meaning
    food = (a("food") & b("fast")) | (a("fast") & b("food"))
    crush = (a("whole") & b("crush")) | (a("crush") & b("whole"))
    has = lambda c, n: F.size(c(n)) > 0
    binding = lambda c: has(c, "mandatory") & ~has(c, "advisory")
    advice = lambda c: has(c, "advisory") & ~has(c, "mandatory")
    shift = (binding(a) & advice(b)) | (binding(b) & advice(a))
    directive = opposed("ind", "contra")
    dosed = F.col("a_dosed") & F.col("b_dosed")
    timing = (a("prior_to") & b("following")) | (a("following") & b("prior_to")) | (b("bolus") & a("over")) | (a("bolus") & b("over"))
    meaning = _pick(
        (directive, "MISMATCH", 0.1), (food, "MISMATCH", 0.25), (crush, "MISMATCH", 0.25), (false_match, "MISMATCH", 0.3),
        (shift, "PARTIAL", 0.60), (dosed & (timing | raw_dose_off), "PARTIAL", 0.70), (dosed, "MATCH", 0.95), (shared > 0.4, "MATCH", 0.85), (true, "PARTIAL", 0.60),
    )
    tone = lambda c: F.when(has(c, "mandatory"), F.concat(F.lit("Mandatory ("), F.array_join(c("mandatory"), ", "), F.lit(")"))).otherwise(F.concat(F.lit("Advisory ("), F.array_join(c("advisory"), ", "), F.lit(")")))
    either = lambda when, yes, no: F.when(when, yes).otherwise(no)
    meaning_diffs = [
        _diff(directive, "directive_type", either(a("ind") & ~a("contra"), "Indication", "Contraindication"), either(b("contra"), "Contraindication", "Indication"), "meaning"),
        _diff(~directive & food, "administration_condition", *[either(c("food"), "With food/meals", "Without food/empty stomach") for c in (a, b)], "meaning"),
        _diff(~directive & ~food & crush, "administration_condition", *[either(c("whole"), "Swallow whole / Do not crush", "May be crushed/chewed") for c in (a, b)], "meaning"),
        _diff(~directive & ~food & ~crush & shift, "modality", tone(a), tone(b), "meaning"),
    ]
    # template
    fa, fb = F.col("a_family"), F.col("b_family")
    slots = {n: (F.col(f"a_{n.lower()}"), F.col(f"b_{n.lower()}")) for n in SLOTS}
    matched = {n: F.size(F.array_intersect(*s)) for n, s in slots.items()}
    full = {n: (matched[n] >= 2) & (F.size(F.array_except(*s)) == 0) for n, s in slots.items()}
    same = {n: (fa == n) & (fb == n) for n in SLOTS}
    template = _pick(
        (same["POSOLOGY"] & full["POSOLOGY"], "MATCH", 0.95),
        (same["POSOLOGY"] & (matched["POSOLOGY"] > 0), "PARTIAL", F.bround(0.55 + 0.35 * (matched["POSOLOGY"] / F.greatest(F.size(slots["POSOLOGY"][0]), F.lit(1))), 2)),
        (same["POSOLOGY"], "PARTIAL", 0.50),
        (same["INDICATION"] & full["INDICATION"], "MATCH", 0.95), (same["INDICATION"], "PARTIAL", 0.65),
        (same["CONTRAINDICATION"] & (matched["CONTRAINDICATION"] > 0), "MATCH", 0.95), (same["CONTRAINDICATION"], "PARTIAL", 0.65),
        ((fa != fb) & (fa != "NARRATIVE") & (fb != "NARRATIVE"), "MISMATCH", 0.30), (true, "MATCH", 0.80),
    )
    template_diffs = [_diff((fa != fb) & (fa != "NARRATIVE") & (fb != "NARRATIVE"), "template", fa, fb, "template")]
    # structure and format
    sa, sb = a("structure"), b("structure")
    one = lambda kind: (sa == kind) | (sb == kind)
    structure = _pick((sa == sb, "MATCH", 0.95), (one("table_row"), "MISMATCH", 0.40), (one("numbered_step"), "PARTIAL", 0.70), (one("bullet_item"), "PARTIAL", 0.75), (true, "PARTIAL", 0.80))
    spaced = lambda s: F.replace(s, F.lit("_"), F.lit(" "))
    q_off, r_off, s_off = a("quantity") != b("quantity"), a("quantity") & b("quantity") & (a("range") != b("range")), a("shorthand") != b("shorthand")
    form = _pick((q_off, "PARTIAL", 0.60), (r_off, "PARTIAL", 0.75), (s_off, "PARTIAL", 0.80), (a("quantity") & b("quantity"), "MATCH", 0.95), (true, "MATCH", 0.85))
    layout_diffs = [
        _diff(sa != sb, "structure", spaced(sa), spaced(sb), "structure"),
        _diff(q_off, "format", *[either(c("quantity"), "Quantitative specification", "Qualitative guidance") for c in (a, b)], "format"),
        _diff(~q_off & r_off, "format", *[either(c("range"), "Dose range (titration)", "Fixed dose") for c in (a, b)], "format"),
        _diff(~q_off & ~r_off & s_off, "format", *[either(c("shorthand"), "Abbreviated clinical shorthand", "Narrative regulatory prose") for c in (a, b)], "format"),
    ]
    key = _pick((key_off, "MISMATCH", 0.2), (any_key_diff, "PARTIAL", 0.65), (true, "MATCH", 1.0))
    results = {"meaning": meaning, "template": template, "context": (context_status, context_score), "structure": structure, "format": form, "key_information": key}
    all_diffs = F.filter(F.array(*key_diffs, *meaning_diffs, *context_diffs, *template_diffs, *layout_diffs), lambda d: d.isNotNull())
    # the first of equal (attribute, values), in order
    first = F.filter(all_diffs, lambda d, i: (i == 0) | ~F.exists(F.slice(all_diffs, 1, F.greatest(i, F.lit(1))), lambda e: (e["attribute"] == d["attribute"]) & e["current_value"].eqNullSafe(d["current_value"]) & e["candidate_value"].eqNullSafe(d["candidate_value"])))
    columns = [c for n in DIMENSIONS for c in (F.when(both, results[n][0]).alias(f"{n}_status"), F.when(both, results[n][1]).alias(f"{n}_score"))]
    return x.select(*keep, *columns, F.when(both, false_match).alias("false_match"), F.when(both, reasons).alias("false_match_reasons"), F.when(both, first).alias("differences"))


_QUANTITY = r"(?iU)\b\d+(?:\.\d+)?\s*(?:mg|g|mcg|ml|kg|%|tablets?|capsules?|hours?|days?)\b"
ASPECTS = ("dose", "frequency", "route", "population", "drug")


def coarse_differences(differences: Column, target: Column, candidate: Column) -> Column:
    """Differences that the dimensions leave out: other quantities where no dose or unit differs, and a length over twice or under half."""
    a, b = (F.regexp_extract_all(t, F.lit(_QUANTITY), F.lit(0)) for t in (target, candidate))
    dosed = F.coalesce(F.exists(differences, lambda d: d["attribute"].isin("dose", "dose_unit")), F.lit(False))
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("None detected")
    other = (F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0)
    ratio = F.length(candidate) / F.greatest(F.length(target), F.lit(1))
    characters = lambda t: F.concat(F.length(t).cast("string"), F.lit(" characters"))
    found = F.array(
        _diff(~dosed & other, "key_information", listed(a), listed(b), "key_information"),
        _diff((ratio > 2) | (ratio < 0.5), "structure", characters(target), characters(candidate), "structure"),
    )
    return F.filter(found, lambda d: d.isNotNull())


def matched_aspects(target: Column, candidate: Column) -> Column:
    """The aspects that both texts state alike."""
    a, b = (F.struct(*K.key_information(t)) for t in (target, candidate))
    return F.filter(F.array(*[F.when((a[n] != "") & (a[n] == b[n]), F.lit(n)) for n in ASPECTS]), lambda n: n.isNotNull())


def warning(reasons: Column) -> Column:
    """The warning that false-match reasons add up to; null if there are none."""
    return F.when(F.size(reasons) > 0, F.concat(F.lit(WARNING), F.array_join(reasons, "; "), F.lit(").")))


def summary(prefix: str = "") -> Column:
    """How many dimensions match, are partial, or do not match."""
    n = lambda status: sum((F.when(F.col(f"{prefix}{d}_status") == status, 1).otherwise(0) for d in DIMENSIONS), F.lit(0))
    return F.concat_ws("/", n("MATCH"), n("PARTIAL"), n("MISMATCH"))


# What the statuses of a pair add up to.
ALERT = "FALSE MATCH ALERT: "
CONTEXT_OFF = "Context Discrepancy: "
STRONG = "Strong Multi-Dimensional Alignment across meaning, template, and key parameters."
MODERATE = "Moderate Multi-Dimensional Alignment: shared regulatory template with specific attribute variations."
LOW = "Low Alignment: significant divergence in key parameters or regulatory context."


def overall(warned: Column) -> Column:
    """One sentence for a compared pair: the warning first, then context, then meaning and key information."""
    status = lambda d: F.col(f"{d}_status")
    return (
        F.when(status("meaning").isNull(), F.lit(None))
        .when(warned.isNotNull(), F.concat(F.lit(ALERT), warned))
        .when(status("context") == "MISMATCH", F.concat(F.lit(CONTEXT_OFF), status("context")))
        .when((status("key_information") == "MATCH") & (status("meaning") == "MATCH"), STRONG)
        .when((status("key_information") == "PARTIAL") | (status("meaning") == "PARTIAL"), MODERATE)
        .otherwise(LOW)
    )


def evidence(target: Column, candidate: Column, observed: dict[str, Column]) -> Column:
    """What was observed in the candidate's source beside the facts of either text; nothing is interpreted.

    observed: provenance columns of the candidate by name.
    """
    names = ("drug", "dose", "population", "indication")
    facts = lambda t: F.struct(*[c for c in K.key_information(t)])
    a, b = facts(target), facts(candidate)
    said = [candidate.alias("exact_quote"), *[c.alias(n) for n, c in observed.items()], *[b[n].alias(f"extracted_{n}") for n in names]]
    return F.struct(F.struct(*said).alias("observed"), F.struct(*[a[n].alias(f"extracted_{n}") for n in names]).alias("target"))


def all_differences(compared: DataFrame, key: str, target: str = "target_text", candidate: str = "candidate_text", most: int | None = None) -> DataFrame:
    """(key, pos, attribute, current_value, candidate_value, source_dimension): differences of the dimensions, then coarse ones, then changed wording.

    Equal ones count once. most caps them a pair, as for display; None keeps all.
    """
    listed = F.concat("differences", coarse_differences(F.col("differences"), F.col(target), F.col(candidate)))
    first = compared.select(F.col(key).cast("string").alias("key"), F.posexplode(listed).alias("place", "d")).select("key", F.lit(0).alias("part"), "place", "d.*")
    changed = word_changes(compared, key, target, candidate)
    wording = changed.select("key", F.lit(1).alias("part"), F.col("change_no").alias("place"), F.when(F.col("kind") == "replace", "format").otherwise("content").alias("attribute"), F.col("current_text").alias("current_value"), F.col("candidate_text").alias("candidate_value"), F.lit("wording").alias("source_dimension"))
    once = first.unionByName(wording).groupBy("key", "attribute", "current_value", "candidate_value").agg(F.min(F.struct("part", "place", "source_dimension")).alias("x"))
    # a pair's differences are as many as its texts have words, at most
    ranked = once.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("x.part", "x.place", "attribute")) - 1)
    kept = ranked if most is None else ranked.where(F.col("pos") < most)
    return kept.select(F.col("key").cast(dict(compared.dtypes)[key]).alias(key), "pos", "attribute", "current_value", "candidate_value", "x.source_dimension")


def adapted(candidate: Column, candidate_dose: Column, target_dose: Column, candidate_drug: Column, target_drug: Column) -> Column:
    """The candidate's text with its dose, then its drug, put as in the target, where both are known and differ."""

    def swap(text: Column, old: Column, new: Column) -> Column:
        pattern = F.concat(F.lit(r"(?i)\b\Q"), old, F.lit(r"\E\b"))
        differ = F.coalesce(F.lower(old) != F.lower(new), F.lit(False))
        return F.when(differ, F.regexp_replace(text, pattern, F.regexp_replace(new, r"([\\$])", r"\\$1"))).otherwise(text)

    return F.trim(swap(swap(candidate, candidate_dose, target_dose), candidate_drug, target_drug))


def word_changes(pairs: DataFrame, key: str, target: str = "target_text", candidate: str = "candidate_text", least: int = 10, most: int | None = 150) -> DataFrame:
    """(key, change_no, kind, current_text, candidate_text): word runs replaced, deleted or inserted.

    Runs of at most ``least`` characters are left out; texts are cut at ``most``. Python's difflib has no
    counterpart in Spark, so pairs go through Arrow batches.
    """
    import difflib

    import pyarrow as pa

    schema = pa.schema([("key", pa.string()), ("change_no", pa.int32()), ("kind", pa.string()), ("current_text", pa.string()), ("candidate_text", pa.string())])

    def run(batches):
        for batch in batches:
            out = []
            for k, t, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                a, b = t.split(), c.split()
                n = 0
                for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b).get_opcodes():
                    old, new = " ".join(a[i1:i2]), " ".join(b[j1:j2])
                    if tag != "equal" and max(len(old), len(new)) > least:
                        out.append((k, n, tag, old[:most] or None, new[:most] or None))
                        n += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    rows = pairs.where(F.col(key).isNotNull() & F.col(target).isNotNull() & F.col(candidate).isNotNull())
    return rows.select(F.col(key).cast("string"), target, candidate).mapInArrow(run, "key string, change_no int, kind string, current_text string, candidate_text string")
