"""Queries on key facts, content types and pair comparison, with SQL made of the same fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as K
from ..operators import compare as C
from ..session import read, read_spread


def key_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key facts of every item's text."""
    return read_spread(spark, sf_dir, "content_items", "content_id", "text").select("content_id", *K.key_information(F.col("text"))).distinct()


def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "content_items").select("content_id", K.content_type(F.col("text"), F.col("section")).alias("derived_type")).distinct()


def canonical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical routes, frequencies and units, with the rows of each."""
    info = "key_information"
    rows = read(spark, sf_dir, "content_items").select(
        K.canonical_route(F.col("route")).alias("route"), K.canonical_frequency(F.col(f"{info}.frequency")).alias("frequency"), K.canonical_unit(F.col(f"{info}.dose_unit")).alias("unit")
    )
    return rows.groupBy("route", "frequency", "unit").agg(F.count("*").alias("n"))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.compare(read(spark, sf_dir, "eval_cases"))


def compare_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and score of each dimension of every evaluation pair."""
    return _compared(spark, sf_dir).select("item_id", *[f"{d}_{x}" for d in C.DIMENSIONS for x in ("status", "score")], "false_match")


def compare_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All differences of all evaluation pairs, in order."""
    return _compared(spark, sf_dir).select("item_id", F.posexplode("differences").alias("pos", "d")).select("item_id", "pos", "d.*")


def compare_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that look alike but differ in what matters."""
    rows = _compared(spark, sf_dir).select("item_id", C.warning(F.col("false_match_reasons")).alias("warning"), C.summary().alias("summary"))
    return rows.where("warning is not null")


def compare_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the comparison of every evaluation pair adds up to."""
    return _compared(spark, sf_dir).select("item_id", C.overall(C.warning(F.col("false_match_reasons"))).alias("overall"))


def compare_all_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of dimensions, quantities, lengths and wording of every evaluation pair, each once."""
    return C.all_differences(C.compare(read(spark, sf_dir, "eval_cases")), "item_id")


def compare_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed quotes and facts of either side of every evaluation pair."""
    e = C.evidence(F.col("target_text"), F.col("candidate_text"), {"case_id": F.col("case_id"), "section": F.lit(None).cast("string")})
    rows = read(spark, sf_dir, "eval_cases").select("item_id", e.alias("e"))
    return rows.select("item_id", F.md5("e.observed.exact_quote").alias("quote_md5"), *[F.col(f"e.observed.extracted_{n}").alias(n) for n in ("drug", "dose", "population", "indication")], *[F.col(f"e.target.extracted_{n}").alias(f"target_{n}") for n in ("drug", "dose", "population", "indication")])


def compare_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of pairs with the expected status, by dimension; for meaning MATCH and PARTIAL count as equal."""
    # one row a dimension: each status is computed once, however often it is read below
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"{d}_status").alias("status")) for d in C.DIMENSIONS])).alias("x")
    found = _compared(spark, sf_dir).select("expected_dimension", "expected_status", each).where("x.dimension = expected_dimension")
    near = (F.col("expected_dimension") == "meaning") & F.col("expected_status").isin("MATCH", "PARTIAL") & F.col("x.status").isin("MATCH", "PARTIAL")
    rows = found.withColumn("hit", ((F.col("x.status") == F.col("expected_status")) | near).cast("int")).where("hit is not null")
    return rows.groupBy("expected_dimension").agg(F.count("*").alias("n"), F.sum("hit").alias("n_hit"))


def compare_coarse_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities and lengths that differ between the texts of every evaluation pair."""
    found = C.coarse_differences(F.col("differences"), F.col("target_text"), F.col("candidate_text"))
    return _compared(spark, sf_dir).select("item_id", F.posexplode(found).alias("pos", "d")).select("item_id", "pos", "d.*")


def compare_matched_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aspects that both texts of an evaluation pair state alike."""
    return read(spark, sf_dir, "eval_cases").select("item_id", F.posexplode(C.matched_aspects(F.col("target_text"), F.col("candidate_text"))).alias("pos", "aspect"))


def compare_word_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word runs that differ between the texts of every evaluation pair."""
    return C.word_changes(read(spark, sf_dir, "eval_cases"), "case_id")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q('(?i)' + pattern)})"


def sql_get(column: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({column}, {q('(?i)' + pattern)}, {group}), '')"


def sql_cascade(column: str, rules: list[tuple[str, str | None]], otherwise: str = "null") -> str:
    """rules: pattern and the SQL of its value."""
    return "case " + " ".join(f"when {sql_has(column, p)} then {v}" for p, v in rules) + f" else {otherwise} end"


def sql_title(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), lambda s: upper(s[1]) || lower(s[2:])), '')"


def sql_key_information(t: str, prefix: str = "") -> str:
    """The columns of key_information over the stripped text column t."""
    low = f"lower({t})"
    dose = f"({sql_get(t, K.DOSE, 1)} || ' ' || {sql_get(t, K.DOSE, 2)})"
    frequency = sql_cascade(low, [(p, q(v) if v else f"'every ' || {sql_get(low, p, 1)} || ' hours'") for p, v in K.FREQUENCIES])
    names = "[" + ", ".join(q(d) for d in K.KNOWN_DRUGS) + "]"
    known = f"{names}[list_min(list_transform(regexp_extract_all({low}, {q(chr(92) + 'b(' + '|'.join(K.KNOWN_DRUGS) + ')' + chr(92) + 'b')}, 1), lambda x: list_position({names}, x)))]"
    after, before, designation = sql_get(t, K.AMOUNT_OF), sql_get(t, K.BEFORE_AMOUNT), sql_title(sql_get(t, K.DESIGNATION))
    bad = lambda words: "(" + ", ".join(q(w) for w in words) + ")"
    drug = f"coalesce({sql_title(known)}, case when lower({after}) not in {bad(K.NOT_AFTER_OF)} then {sql_title(after)} end, case when lower({before}) not in {bad(K.NOT_BEFORE)} then {sql_title(before)} end, {sql_title(sql_get(t, K.STEM))}, {designation})"
    columns = {
        "dose": dose,
        "dose_unit": f"lower({sql_get(t, K.DOSE, 2)})",
        "frequency": frequency,
        "route": sql_cascade(t, [(p, q(v)) for p, v in K.ROUTES]),
        "population": sql_cascade(t, [(p, q(v)) for p, v in K.POPULATIONS]),
        "age_group": "coalesce(" + ", ".join(sql_get(t, p, 0) for p in K.AGES) + ")",
        "drug": drug,
        "product": designation,
        "duration": f"trim(coalesce({sql_get(t, K.DURATION, 1)}, {sql_get(t, K.DURATION, 2)}))",
        "indication": f"coalesce(trim({sql_get(t, K.INDICATION)}), trim({sql_get(t, K.CONDITION)}))",
        "safety_information": f"trim({sql_get(t, K.SAFETY)})",
        "purpose": f"case when {sql_has(low, K.STUDY)} then 'Clinical Study Observation' when {sql_has(low, K.CONTRA)} then 'Safety / Contraindication' when {sql_has(low, K.INDICATED)} then 'Therapeutic Indication' "
        f"when {dose} is not null or ({frequency}) is not null or contains({low}, 'take') or contains({low}, 'administer') then 'Dosing Specification' else 'General Prescribing Directive' end",
    }
    return ", ".join(f"{v} as {prefix}{k}" for k, v in columns.items())


SQL_STRIP = r"regexp_replace(regexp_replace({0}, '^[\s\x{{A0}}]+', ''), '[\s\x{{A0}}]+$', '')"


def _sql_type(t: str, section: str) -> str:
    hint = f"coalesce(lower({section}), '')"
    rules = [f"when regexp_matches({t}, {q(K.FIELD_LINE)}) then 'structured_field'", f"when contains({t}, '|') or contains({t}, chr(9)) then 'table_content'"]
    rules += [f"when regexp_matches({hint}, {q(p)}) then {q(v)}" for p, v in K.TYPE_BY_SECTION]
    rules += [f"when {sql_has(f'lower({t})', p)} then {q(v)}" for p, v in K.TYPE_BY_TEXT]
    return "case " + " ".join(rules) + " else 'general_regulatory_content' end"


def _sql_canonical(value: str, rules: list[tuple[str, str]], otherwise: str) -> str:
    return sql_cascade(value, [(f"^(?:{n})$", q(v)) for n, v in rules], otherwise)


def _sql_terms(low: str, terms: list[str]) -> str:
    return "list_filter([" + ", ".join(f"case when regexp_matches({low}, {q(chr(92) + 'b' + t + chr(92) + 'b')}) then {q(t)} end" for t in terms) + "], lambda x: x is not null)"


def _sql_side(side: str, text: str) -> str:
    low, clean = f"lower({text})", SQL_STRIP.format(text)
    flags = ", ".join(f"regexp_matches({low}, {q(p)}) as {side}_{n}" for n, p in C.FLAGS.items())
    marks = ", ".join(f"{sql_has(text, p)} as {side}_{n}" for n, p in (("quantity", C.QUANTITY), ("range", C.RANGE), ("shorthand", C.SHORTHAND)))
    structure = f"case when contains({clean}, '|') or contains({clean}, chr(9)) then 'table_row' when regexp_matches({clean}, {q(C.STEP_LINE)}) then 'numbered_step' when regexp_matches({clean}, '^[-•*]') or contains({text}, chr(10) || '-') then 'bullet_item' when regexp_matches({clean}, {q(C.FIELD)}) then 'structured_field' when starts_with({clean}, '#') then 'heading' else 'paragraph' end"
    words = f"list_distinct(list_filter(regexp_split_to_array({low}, '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda x: x <> ''))"
    return f"{sql_key_information(clean, side + '_')}, {flags}, {marks}, {_sql_terms(low, C.MANDATORY)} as {side}_mand, {_sql_terms(low, C.ADVISORY)} as {side}_adv, {sql_cascade(low, [(p, q(v)) for p, v in C.SUBGROUPS])} as {side}_subgroup, {structure} as {side}_structure, {words} as {side}_words, {low} as {side}_low"


def _sql_slots(side: str) -> str:
    low, out = f"{side}_low", []
    for name, slots in C.SLOTS.items():
        marks = []
        for slot, facts, pattern in slots:
            tests = [f"regexp_matches({low}, {q(pattern)})"] if pattern else []
            tests += [f"{side}_{f} is not null" for f in facts]
            if slot == "Initial/Starting Dose":
                tests.append(f"({side}_dose is not null and not regexp_matches({low}, '\\bmaximum\\b'))")
            marks.append(f"case when {' or '.join(tests)} then {q(slot)} end")
        out.append(f"list_filter([{', '.join(marks)}], lambda x: x is not null) as {side}_{name.lower()}_slots")
    dosed = f"({side}_dose is not null or {side}_frequency is not null)"
    family = sql_cascade(low, [(p, q(v)) for p, v in C.FAMILIES], f"case when {dosed} or regexp_matches({low}, {q(C.DOSING_WORDS)}) then 'POSOLOGY' else 'NARRATIVE' end")
    return ", ".join([*out, f"{family} as {side}_family", f"({dosed} or regexp_matches({low}, 'take|administer')) as {side}_dosed"])


def _sql_compare(final: str = "select item_id, {columns}, context_status, context_score, false_match from flagged") -> str:
    """The comparison in SQL; final reads the facts, flags and dimensions of flagged."""
    canon = {"dose_unit": lambda x: _sql_canonical(x, K.CANONICAL_UNITS, x), "frequency": lambda x: _sql_canonical(f"replace({x}, '.', '')", K.CANONICAL_FREQUENCIES, x), "route": lambda x: _sql_canonical(f"replace(lower({x}), '.', '')", K.CANONICAL_ROUTES, sql_title(x))}
    off = [f"coalesce({canon[n]('a_' + n)} <> {canon[n]('b_' + n)}, false) as off_{n}" if n in canon else f"coalesce(lower(trim(a_{n})) <> lower(trim(b_{n})), false) as off_{n}" for n in C.FACTS]
    opposed = lambda i, c: f"((a_{i} and not a_{c} and b_{c}) or (a_{c} and b_{i} and not b_{c}))"
    same = lambda n: f"(a_family = '{n}' and b_family = '{n}')"
    m = lambda n: f"len(list_intersect(a_{n}_slots, b_{n}_slots))"
    full = lambda n: f"({m(n)} >= 2 and len(list_filter(a_{n}_slots, lambda x: not list_contains(b_{n}_slots, x))) = 0)"
    dims = {
        "meaning": [(opposed("ind", "contra"), "MISMATCH", 0.1), ("(a_food and b_fast) or (a_fast and b_food)", "MISMATCH", 0.25), ("(a_whole and b_crush) or (a_crush and b_whole)", "MISMATCH", 0.25), ("false_match", "MISMATCH", 0.3), ("shift", "PARTIAL", 0.6),
                    ("a_dosed and b_dosed and (timing or raw_dose)", "PARTIAL", 0.7), ("a_dosed and b_dosed", "MATCH", 0.95), ("shared > 0.4", "MATCH", 0.85), ("true", "PARTIAL", 0.6)],
        "template": [(f"{same('POSOLOGY')} and {full('posology')}", "MATCH", 0.95), (f"{same('POSOLOGY')} and {m('posology')} > 0", "PARTIAL", f"round_even(0.55::double + 0.35::double * ({m('posology')} / greatest(len(a_posology_slots), 1)), 2)"), (same("POSOLOGY"), "PARTIAL", 0.5),
                     (f"{same('INDICATION')} and {full('indication')}", "MATCH", 0.95), (same("INDICATION"), "PARTIAL", 0.65), (f"{same('CONTRAINDICATION')} and {m('contraindication')} > 0", "MATCH", 0.95), (same("CONTRAINDICATION"), "PARTIAL", 0.65),
                     ("a_family <> b_family and a_family <> 'NARRATIVE' and b_family <> 'NARRATIVE'", "MISMATCH", 0.3), ("true", "MATCH", 0.8)],
        "structure": [("a_structure = b_structure", "MATCH", 0.95), ("'table_row' in (a_structure, b_structure)", "MISMATCH", 0.4), ("'numbered_step' in (a_structure, b_structure)", "PARTIAL", 0.7), ("'bullet_item' in (a_structure, b_structure)", "PARTIAL", 0.75), ("true", "PARTIAL", 0.8)],
        "format": [("a_quantity <> b_quantity", "PARTIAL", 0.6), ("a_quantity and b_quantity and a_range <> b_range", "PARTIAL", 0.75), ("a_shorthand <> b_shorthand", "PARTIAL", 0.8), ("a_quantity and b_quantity", "MATCH", 0.95), ("true", "MATCH", 0.85)],
        "key_information": [("key_off", "MISMATCH", 0.2), ("(a_drug is null) <> (b_drug is null) or (off_dose and not off_dose_unit) or off_frequency or off_route or off_duration or off_indication or off_age_group", "PARTIAL", 0.65), ("true", "MATCH", 1.0)],
    }
    context = [("coalesce(a_subgroup <> b_subgroup, false)", "MISMATCH", 0.35), ("a_study <> b_study", "MISMATCH", 0.35), (opposed("ind_use", "contra_use"), "MISMATCH", 0.25), ("true", "MATCH", 0.9)]
    pick = lambda cases, i: "case " + " ".join(f"when {c[0]} then {q(c[1]) if i == 1 else f'({c[2]})::double'}" for c in cases) + " end"
    columns = ", ".join(f"{pick(cases, 1)} as {d}_status, {pick(cases, 2)} as {d}_score" for d, cases in dims.items())
    return f"""
    with facts as (select item_id, {_sql_side('a', 'target_text')}, {_sql_side('b', 'candidate_text')} from eval_cases),
    slots as (select *, {_sql_slots('a')}, {_sql_slots('b')}, {', '.join(off)}, {pick(context, 1)} as context_status, {pick(context, 2)} as context_score,
        len(list_intersect(a_words, b_words)) / greatest(len(list_distinct(a_words || b_words)), 1) as shared, coalesce(lower(a_dose) <> lower(b_dose), false) as raw_dose,
        (len(a_mand) > 0 and len(a_adv) = 0 and len(b_adv) > 0 and len(b_mand) = 0) or (len(b_mand) > 0 and len(b_adv) = 0 and len(a_adv) > 0 and len(a_mand) = 0) as shift,
        (contains(a_low, 'prior to') and contains(b_low, 'following')) or (contains(a_low, 'following') and contains(b_low, 'prior to')) or (contains(b_low, 'rapid bolus') and contains(a_low, 'over')) or (contains(a_low, 'rapid bolus') and contains(b_low, 'over')) as timing from facts),
    keyed as (select *, off_drug or off_product or off_population or off_dose_unit as key_off from slots),
    flagged as (select *, key_off or context_status = 'MISMATCH' or (shared >= 0.4 and (raw_dose or off_route)) as false_match from keyed)
    {final.replace("{columns}", columns)}"""


def _sql_differences() -> str:
    d = lambda when, attribute, a, b, dimension: f"case when {when} then {{'attribute': '{attribute}', 'current_value': {a}, 'candidate_value': {b}, 'source_dimension': '{dimension}'}} end"
    if_else = lambda when, yes, no: f"case when {when} then '{yes}' else '{no}' end"
    directive = "((a_ind and not a_contra and b_contra) or (a_contra and b_ind and not b_contra))"
    food, crush = "((a_food and b_fast) or (a_fast and b_food))", "((a_whole and b_crush) or (a_crush and b_whole))"
    tone = lambda c: f"case when len({c}_mand) > 0 then 'Mandatory (' || array_to_string({c}_mand, ', ') || ')' else 'Advisory (' || array_to_string({c}_adv, ', ') || ')' end"
    key = [d("off_drug", "drug", "a_drug", "b_drug", "key_information"), d("(a_drug is null) <> (b_drug is null)", "drug", "coalesce(a_drug, 'Unspecified')", "coalesce(b_drug, 'Unspecified')", "key_information")]
    key += [d("off_dose and not off_dose_unit" if n == "dose" else f"off_{n}", n, f"a_{n}", f"b_{n}", "key_information") for n in ("product", "population", "dose_unit", "dose", "frequency", "route", "duration", "indication", "age_group")]
    meaning = [
        d(directive, "directive_type", if_else("a_ind and not a_contra", "Indication", "Contraindication"), if_else("b_contra", "Contraindication", "Indication"), "meaning"),
        d(f"not {directive} and {food}", "administration_condition", *[if_else(f"{c}_food", "With food/meals", "Without food/empty stomach") for c in "ab"], "meaning"),
        d(f"not {directive} and not {food} and {crush}", "administration_condition", *[if_else(f"{c}_whole", "Swallow whole / Do not crush", "May be crushed/chewed") for c in "ab"], "meaning"),
        d(f"not {directive} and not {food} and not {crush} and shift", "modality", tone("a"), tone("b"), "meaning"),
    ]
    group = "coalesce(a_subgroup <> b_subgroup, false)"
    context = [d(group, "context", "a_subgroup", "b_subgroup", "context"), d(f"not {group} and a_study <> b_study", "context", *[if_else(f"{c}_study", "Clinical study observation", "Prescribing directive") for c in "ab"], "context")]
    families = "a_family <> b_family and a_family <> 'NARRATIVE' and b_family <> 'NARRATIVE'"
    q_off, r_off, s_off = "a_quantity <> b_quantity", "(a_quantity and b_quantity and a_range <> b_range)", "a_shorthand <> b_shorthand"
    layout = [
        d(families, "template", "a_family", "b_family", "template"), d("a_structure <> b_structure", "structure", *[f"replace({c}_structure, '_', ' ')" for c in "ab"], "structure"),
        d(q_off, "format", *[if_else(f"{c}_quantity", "Quantitative specification", "Qualitative guidance") for c in "ab"], "format"),
        d(f"not ({q_off}) and {r_off}", "format", *[if_else(f"{c}_range", "Dose range (titration)", "Fixed dose") for c in "ab"], "format"),
        d(f"not ({q_off}) and not {r_off} and {s_off}", "format", *[if_else(f"{c}_shorthand", "Abbreviated clinical shorthand", "Narrative regulatory prose") for c in "ab"], "format"),
    ]
    every = ", ".join([*key, *meaning, *context, *layout])
    listed = f"select item_id, list_filter([{every}], lambda x: x is not null) as l from flagged"
    one_by_one = f"select item_id, generate_subscripts(l, 1) as place, unnest(l) as x from ({listed})"
    first = f"select * from ({one_by_one}) qualify row_number() over (partition by item_id, x.attribute, x.current_value, x.candidate_value order by place) = 1"
    return _sql_compare(f"select item_id, (row_number() over (partition by item_id order by place) - 1)::int as pos, x.attribute as attribute, x.current_value as current_value, x.candidate_value as candidate_value, x.source_dimension as source_dimension from ({first})")


def _sql_warnings() -> str:
    mark = "chr(39)"
    said = lambda label, n, verb, when: f"case when {when} then '{label} mismatch: target {verb} ' || {mark} || a_{n} || {mark} || ' but candidate {verb} ' || {mark} || b_{n} || {mark} end"
    reasons = [said(label, n, verb, f"off_{n}") for n, label, verb in (("drug", "Drug", "specifies"), ("product", "Product", "specifies"), ("population", "Population", "applies to"), ("dose_unit", "Dose unit", "specifies"))]
    reasons.append(
        "case when context_status = 'MISMATCH' then case when a_subgroup <> b_subgroup then 'Specialized population context disparity: current applies to ' || a_subgroup || ', whereas candidate applies to ' || b_subgroup || '.' "
        "when a_study <> b_study then 'Context mismatch: one statement describes clinical study observations, whereas the other provides prescribing recommendations.' "
        "else 'Context mismatch: therapeutic indication context compared against contraindication safety context.' end end"
    )
    reasons += [said("Dose", "dose", "specifies", "shared >= 0.4 and raw_dose"), said("Route", "route", "specifies", "shared >= 0.4 and off_route")]
    count = lambda status: " + ".join(f"({n}_status = '{status}')::int" for n in C.DIMENSIONS)
    found = _sql_compare(f"select item_id, list_filter([{', '.join(reasons)}], lambda x: x is not null) as r from flagged")
    return f"""with c as ({_sql_compare()}), w as ({found})
        select item_id, 'FALSE MATCH WARNING: High semantic similarity masks critical regulatory discrepancy (' || array_to_string(r, '; ') || ').' as warning,
            ({count('MATCH')}) || '/' || ({count('PARTIAL')}) || '/' || ({count('MISMATCH')}) as summary from c join w using (item_id) where len(r) > 0"""


def _sql_overall() -> str:
    return f"""select c.item_id, case when w.warning is not null then {q(C.ALERT)} || w.warning when c.context_status = 'MISMATCH' then {q(C.CONTEXT_OFF)} || c.context_status
        when c.key_information_status = 'MATCH' and c.meaning_status = 'MATCH' then {q(C.STRONG)} when c.key_information_status = 'PARTIAL' or c.meaning_status = 'PARTIAL' then {q(C.MODERATE)} else {q(C.LOW)} end as overall
        from ({_sql_compare()}) c left join ({_sql_warnings()}) w using (item_id)"""


QUERIES = {"compare_overall": compare_overall, "compare_all_differences": compare_all_differences, "compare_evidence": compare_evidence, "key_information": key_information, "content_types": content_types, "canonical_values": canonical_values, "compare_dimensions": compare_dimensions, "compare_differences": compare_differences, "compare_warnings": compare_warnings, "compare_accuracy": compare_accuracy, "compare_word_changes": compare_word_changes, "compare_coarse_differences": compare_coarse_differences, "compare_matched_aspects": compare_matched_aspects}
ORACLES = {
    "key_information": f"select distinct content_id, {sql_key_information('t')} from (select content_id, {SQL_STRIP.format('text')} as t from content_items)",
    "content_types": f"select distinct content_id, {_sql_type('t', 'section')} as derived_type from (select content_id, section, {SQL_STRIP.format('text')} as t from content_items)",
    "canonical_values": f"""select route, frequency, unit, count(*) as n from (select
        case when r is not null then {_sql_canonical("replace(lower(r), '.', '')", K.CANONICAL_ROUTES, sql_title('r'))} end as route,
        case when f is not null then {_sql_canonical("replace(f, '.', '')", K.CANONICAL_FREQUENCIES, 'f')} end as frequency,
        case when u is not null then {_sql_canonical('u', K.CANONICAL_UNITS, 'u')} end as unit
        from (select nullif(trim(route), '') as r, nullif(lower(trim(key_information.frequency)), '') as f, nullif(lower(trim(key_information.dose_unit)), '') as u from content_items)) group by all""",
    "compare_dimensions": _sql_compare(),
    "compare_overall": _sql_overall(),
    "compare_evidence": f"""with k as (select item_id, candidate_text, {sql_key_information(SQL_STRIP.format('target_text'), 'a_')}, {sql_key_information(SQL_STRIP.format('candidate_text'), 'b_')} from eval_cases)
        select item_id, md5(candidate_text) as quote_md5, {', '.join(f'b_{n} as {n}, a_{n} as target_{n}' for n in ('drug', 'dose', 'population', 'indication'))} from k""",
    "compare_differences": _sql_differences(),
    "compare_warnings": _sql_warnings(),
    "compare_accuracy": f"""select expected_dimension, count(*) as n, sum(hit)::bigint as n_hit from (select expected_dimension, (s = expected_status or (expected_dimension = 'meaning' and s in ('MATCH', 'PARTIAL') and expected_status in ('MATCH', 'PARTIAL')))::int as hit from (
        select e.expected_dimension, e.expected_status, case e.expected_dimension {" ".join(f"when '{d}' then c.{d}_status" for d in C.DIMENSIONS)} end as s from eval_cases e join ({_sql_compare()}) c using (item_id))) where hit is not null group by 1""",
    "metrics_confusion": f"""select outcome, count(*) as n from (select case when e and f then 'TP' when not e and not f then 'TN' when f then 'FP' else 'FN' end as outcome from (
        select x.expected_status = 'MISMATCH' as e, c.false_match as f from eval_cases x join ({_sql_compare()}) c using (item_id))) group by 1""",
    "compare_adapted": f"""with k as (select item_id, candidate_text as t, {sql_key_information(SQL_STRIP.format('target_text'), 'a_')}, {sql_key_information(SQL_STRIP.format('candidate_text'), 'b_')} from eval_cases),
        d as (select *, case when lower(b_dose) <> lower(a_dose) then regexp_replace(t, '(?i)\\b' || regexp_escape(b_dose) || '\\b', a_dose, 'g') else t end as t1 from k)
        select item_id, md5(trim(case when lower(b_drug) <> lower(a_drug) then regexp_replace(t1, '(?i)\\b' || regexp_escape(b_drug) || '\\b', a_drug, 'g') else t1 end)) as text_md5 from d""",
}
