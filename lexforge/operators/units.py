"""Quantities written in different units to common base units (problem 2).

A dose is stated up to three times: in its own text, in a unit column, and in running text. The identity
that ties the statements is that they are the same amount. Every unit of the table of standards is a
hypothesis; its cost is the weighted sum of the log residuals |ln(number x factor) - ln(stated amount)|
against all statements, and the cheapest combination of units is taken (``resolve``). Units that some
statement gives the number outrank those that only fit an amount in the text ("0.5" beside "500 mg" is
implied to be grams). The weights are such that a statement outweighs all that come after it.

``tied``: another combination of the same rank has the same cost. ``is_unique``: not tied, and no other
unit fits the amounts in the text better. Tied and contradicted results are flagged, not dropped.

Defined results: null, blank and non-amounts (also amounts per weight or surface, concentrations, and
numbers for which no statement has an amount) give no row; a range in reverse order is put in order; a
residual is null where the text states no amount of that kind. Frequencies that are null, on demand, a
range, or not an interval give 0 minutes.
"""

from __future__ import annotations

import math
import re
import unicodedata
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Spellings of the units, by their symbol in the table of standards.
SPELLINGS = {
    "ng": "ng nanogram nanograms nanogramme nanogrammes",
    "mcg": "mcg mcgs ug ugs μg microgram micrograms microgramme microgrammes",
    "mg": "mg mgs milligram milligrams milligramme milligrammes",
    "g": "g gm gms gram grams gramme grammes",
    "uL": "ul μl microlitre microlitres microliter microliters",
    "mL": "ml mls cc ccs millilitre millilitres milliliter milliliters",
    "L": "l litre litres liter liters",
    "tsp": "tsp tsps teaspoon teaspoons teaspoonful teaspoonfuls teaspoonsful",
    "tbsp": "tbsp tbsps tablespoon tablespoons tablespoonful tablespoonfuls tablespoonsful",
    "IU": "iu ius i.u u unit units internationalunit internationalunits",
    "mEq": "meq meqs milliequivalent milliequivalents",
    "form": "tablet tablets tab tabs capsule capsules cap caps puff puffs drop drops",
}
# Numbers as words, and scale words.
NUMBERS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12}
SCALES = {"thousand": 10**3, "million": 10**6, "billion": 10**9}
FRACTIONS = {"¼": Fraction(1, 4), "½": Fraction(1, 2), "¾": Fraction(3, 4), "⅓": Fraction(1, 3), "⅔": Fraction(2, 3)}

_DIGITS = r"(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:[.,]\d+)?|\.\d+)"
_WORDS = "|".join(NUMBERS)
_NUMBER = rf"(?:{_DIGITS}\s*[¼½¾⅓⅔]|[¼½¾⅓⅔]|\d+/\d+|{_DIGITS}|(?:{_WORDS})\s+and\s+(?:a\s+|one\s*-?\s*)half|(?:one\s*-?\s*|a\s+)?half(?:\s+an?\b)?|\b(?:{_WORDS})\b)"
_UNIT = r"(?:international\s*units?|i\.\s?u\.?|[a-zμ]+)"
_SCALE = r"(?:\s*(?P<{0}>thousand|million|billion))?"
_QUANTITY = re.compile(
    rf"(?P<n1>{_NUMBER}){_SCALE.format('s1')}\s*(?P<u1>(?!to\b|and\b|or\b|x\b){_UNIT})?\.?\s*"
    rf"(?:(?:-|–|—|\bto\b|\band\b|\bor\b)\s*(?P<n2>{_NUMBER}){_SCALE.format('s2')}\s*(?P<u2>{_UNIT})?)?"
)
_LEADING = re.compile(rf"(?P<u>{_UNIT})\.?\s*$")
_REMARK = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
_PER = re.compile(r"\s*(?:/|\bper\b)\s*(?!day\b|d\b|dose\b|24\b)")


def _symbols() -> dict[str, str]:
    return {alias: symbol for symbol, names in SPELLINGS.items() for alias in names.split()}


def _plain(text: str | None) -> str:
    """Without remarks, case, micro-sign variants and repeated blanks."""
    text = (text or "").replace("µ", "μ")
    while (cut := _REMARK.sub(" ", text)) != text:
        text = cut
    return " ".join(text.lower().split())


def number(text: str) -> Fraction | None:
    """A number in digits, fractions or words; a comma before exactly three digits separates thousands."""
    text = text.strip()
    if text[-1:] in FRACTIONS:
        head = number(text[:-1]) if text[:-1].strip() else Fraction(0)
        return None if head is None else head + FRACTIONS[text[-1]]
    if m := re.fullmatch(r"(\d+)/(\d+)", text):
        return Fraction(int(m[1]), int(m[2])) if int(m[2]) else None
    if text[:1].isdigit() or text[:1] == ".":
        text = text.replace(",", "") if re.fullmatch(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?", text) else text.replace(",", ".")
        return Fraction("0" + text if text[0] == "." else text)
    if "half" in text:
        head = re.match(rf"({_WORDS})\s+and\b", text)
        return Fraction(NUMBERS[head[1]] if head else 0) + Fraction(1, 2)
    return Fraction(NUMBERS[text]) if text in NUMBERS else None


def _unit(text: str | None, symbols: dict[str, str]) -> str | None:
    return symbols.get("".join((text or "").lower().replace("µ", "μ").split()).strip("."))


def quantities(text: str, symbols: dict[str, str]) -> list[tuple[Fraction, Fraction, str]]:
    """Every (low, high, unit symbol) that is written in a text, units behind their numbers."""
    out = []
    for m in _QUANTITY.finditer(text):
        unit = _unit(m["u2"] or m["u1"], symbols) if m["n2"] else _unit(m["u1"], symbols)
        low, high = number(m["n1"]), number(m["n2"]) if m["n2"] else None
        if unit and low is not None:
            high = low if high is None else high
            scale1, scale2 = SCALES.get(m["s1"] or m["s2"], 1) if m["n2"] else SCALES.get(m["s1"], 1), SCALES.get(m["s2"] or m["s1"], 1)
            out.append((low * scale1, high * scale2, unit))
    return out


#: What a statement weighs: more than twice all that come after it, so that earlier ones decide.
WEIGHTS = {"dose": 6.0, "unit column": 2.0, "text": 0.5}
#: The log residual of amounts of different kinds, beyond any between amounts of one kind.
OTHER_KIND = 100.0
#: Log residual below which amounts are equal; units that stand nowhere must make them so.
AGREES = 1e-9
#: Where a unit stands, the most trusted place first; implied: in no place, but it makes the amounts agree.
PLACES = ("dose", "unit column", "text", "implied")
# Words behind a number that are no units.
NO_UNITS = ("daily", "once", "twice", "every", "each", "at", "for", "in", "of", "taken", "or")


def _statements(dose: str | None, unit: str | None, symbols: dict[str, str]):
    """(low, high, units in the dose, unit of the column) as written, or None where it is no absolute amount."""
    plain = _plain(dose)
    m = _QUANTITY.search(plain)
    if not m or _PER.match(plain, m.end()) or (m["u1"] and not m["n2"] and _PER.match(plain, m.end("u1"))):
        return None
    low, high = number(m["n1"]), number(m["n2"]) if m["n2"] else None
    if low is None or (m["n2"] and high is None):
        return None
    s1 = SCALES.get(m["s1"] or (m["s2"] if m["n2"] else None), 1)
    s2 = SCALES.get(m["s2"] or m["s1"], 1) if m["n2"] else s1
    first, second = _unit(m["u1"], symbols), _unit(m["u2"], symbols)
    written = m["u2"] or m["u1"]
    if written and not (first or second) and written not in NO_UNITS:
        return None  # a unit that is no amount in the table of standards
    if not (first or second) and (lead := _LEADING.search(plain[: m.start()])):
        first = _unit(lead["u"], symbols)
    column = None
    if not (first or second):
        beside = _plain(unit)
        words = beside.split()
        if words and words[0] in SCALES:
            s1, s2, beside = s1 * SCALES[words[0]], s2 * SCALES[words[0]], " ".join(words[1:])
        column = _unit(beside, symbols)
        if _PER.search(beside) or (beside and not column):
            return None
    else:
        words = _plain(unit).split()
        column = _unit(" ".join(words[1:] if words and words[0] in SCALES else words), symbols)
    in_dose = (first or second, second or first) if first or second else None
    return low * s1, (low if high is None else high) * s2, in_dose, column


def resolve(dose: str | None, unit: str | None, text: str | None, factors: dict[str, tuple[str, int]], symbols: dict[str, str]):
    """(kind, low, high, log residual, is unique, place of the unit, tied) of a stated dose, or None."""
    said = _statements(dose, unit, symbols)
    if said is None:
        return None
    low, high, in_dose, column = said
    if any(u not in factors for u in (in_dose or ((column,) if column else ()))):
        return None
    stated = [(a, b, u) for a, b, u in quantities(_plain(text), symbols) if u in factors] if text else []
    amounts = [(factors[u][0], math.log(a * factors[u][1]), math.log(b * factors[u][1])) for a, b, u in stated if a > 0 and b > 0]
    log_low, log_high = (math.log(low), math.log(high)) if low > 0 and high > 0 else (None, None)

    def apart(one: tuple[str, str], other: tuple[str, str]) -> float:
        """Log residual of the same numbers in two combinations of units."""
        return sum(abs(math.log(factors[a][1] / factors[b][1])) if factors[a][0] == factors[b][0] else OTHER_KIND for a, b in zip(one, other))

    def against_text(pair: tuple[str, str]) -> float | None:
        if log_low is None:
            return None
        (kind, f1), (_, f2) = factors[pair[0]], factors[pair[1]]
        x, y = log_low + math.log(f1), log_high + math.log(f2)
        return min((abs(x - a) + abs(y - b) for k, a, b in amounts if k == kind), default=None)

    places: dict[tuple[str, str], str] = {}
    if in_dose:
        mixed = factors[in_dose[0]][0] != factors[in_dose[1]][0]
        places[(in_dose[1], in_dose[1]) if mixed else in_dose] = "dose"
    if column in factors:
        places.setdefault((column, column), "unit column")
    for a, b, u in stated:
        if a in (low, high) or b in (low, high):
            places.setdefault((u, u), "text")
    kinds = {k for k, *_ in amounts} | {factors[u][0] for pair in places for u in pair}
    for u, (kind, _) in factors.items():
        if kind in kinds:
            places.setdefault((u, u), "implied")
    ranked, fits = [], {}
    for pair, place in places.items():
        fits[pair] = against_text(pair)
        if place == "implied" and not (fits[pair] is not None and fits[pair] < AGREES):
            continue
        cost = WEIGHTS["text"] * (fits[pair] or 0.0)
        if in_dose:
            cost += WEIGHTS["dose"] * apart(pair, in_dose)
        if column in factors:
            cost += WEIGHTS["unit column"] * apart(pair, (column, column))
        ranked.append((place == "implied", round(cost, 9), PLACES.index(place), pair))
    if not ranked:
        return None
    # the first of equals is the one named first
    best = min(ranked, key=lambda r: r[:3])
    pair = best[3]
    amount = lambda p: (factors[p[0]][0], *sorted((round(low * factors[p[0]][1]), round(high * factors[p[1]][1]))))
    found, residual = amount(pair), fits[pair]
    if found[2] >= 2**63:
        return None
    tied = any(r[:3] == best[:3] and amount(r[3]) != found for r in ranked)
    better = residual is not None and any(f is not None and f < residual - AGREES for f in fits.values())
    return *found, residual, not tied and not better, PLACES[best[2]], tied


def read_dose(dose: str | None, unit: str | None, text: str | None, factors: dict[str, tuple[str, int]], symbols: dict[str, str]):
    """The first six values of ``resolve``, of units that stand somewhere."""
    found = resolve(dose, unit, text, factors, symbols)
    return found[:6] if found else None


_COUNT = {"once": 1, "twice": 2, "thrice": 3} | NUMBERS
_PERIOD = {"minute": 1, "min": 1, "m": 1, "hour": 60, "hr": 60, "h": 60, "day": 1440, "d": 1440, "week": 10080, "wk": 10080, "w": 10080}
_ORDINAL = {"other": 2, "second": 2, "alternate": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7}
_N = r"(\d+|" + "|".join(_COUNT) + ")"
_P = r"(minutes?|mins?|hours?|hrs?|hr?|days?|weeks?|wks?)"


def _count(x: str) -> int:
    return int(x) if x.isdigit() else _COUNT[x]


def _period(x: str) -> int:
    return _PERIOD[x.rstrip("s")]


def interval_minutes(frequency: str | None) -> int:
    """Minutes between two administrations; 0 if there is no fixed interval."""
    t = " ".join(unicodedata.normalize("NFKC", frequency or "").lower().split())
    abbr = t.replace(".", "").replace(" ", "")
    if re.search(r"\bp\.?r\.?n\b|as needed|as required|if needed|as directed|on demand", t):
        return 0
    if abbr in (fixed := {"qd": 1, "od": 1, "qam": 1, "qpm": 1, "qhs": 1, "hs": 1, "bid": 2, "bd": 2, "tid": 3, "tds": 3, "qid": 4, "qds": 4}):
        return 1440 // fixed[abbr]
    if abbr == "qod":
        return 2880
    if m := re.fullmatch(r"q(\d+)(h|hrs?|hours?|d|days?|w|wks?|weeks?|min)", abbr):
        return int(m[1]) * _period(m[2])
    if m := re.fullmatch(rf"(?:once\s+)?every\s+{_N}\s*{_P}", t):
        return _count(m[1]) * _period(m[2])
    if m := re.fullmatch(rf"(?:once\s+)?(?:every|each)\s+(?:(other|second|third|fourth|fifth|sixth|seventh)\s+)?{_P}", t):
        return _ORDINAL.get(m[1], 1) * _period(m[2])
    if m := re.fullmatch(r"(?:on|every)?\s*(?:alternate|alternating)\s+(days|weeks)", t):
        return 2 * _period(m[1])
    if m := re.fullmatch(rf"{_N}\s*(?:x|times?)?\s*(?:/|a|per|each|every)?\s*(hour|day|week|hourly|daily|weekly)", t):
        n, period = _count(m[1]), {"hour": 60, "hourly": 60, "day": 1440, "daily": 1440, "week": 10080, "weekly": 10080}[m[2]]
        return period // n if n else 0
    if re.fullmatch(r"(?:once\s+)?(?:daily|nightly|(?:(?:every|each|in the|at)\s+)?(?:morning|evening|night|bedtime|noon|day))", t):
        return 1440
    return {"hourly": 60, "weekly": 10080, "once weekly": 10080, "fortnightly": 20160, "biweekly": 0}.get(t, 0)


AMOUNTS = "kind string, amount_low long, amount_high long, log_residual double, is_unique boolean, unit_source string, tied boolean, interval_min long"


def normalise_doses(df: DataFrame, key: str, standards: DataFrame, dose: str = "dose", unit: str = "dose_unit", frequency: str = "frequency", text: str = "text", verify: bool = True, max_standards: int = 10_000) -> DataFrame:
    """One row for each row of df that states an absolute amount: key and the columns of AMOUNTS.

    verify: the text takes part in every decision; else it is only read where neither other column has a
    unit. standards (unit_symbol, kind, factor) is a reference table of at most max_standards rows: it
    names physical units, and more are refused.
    """
    rows = standards.select("unit_symbol", "kind", "factor").distinct().limit(max_standards + 1).collect()
    if len(rows) > max_standards:
        raise ValueError(f"more than {max_standards} units")
    factors = {r[0]: (r[1], int(r[2])) for r in rows if None not in r}
    symbols = _symbols() | {s.lower(): s for s in factors if s.lower() not in _symbols()}
    schema = pa.schema([(key, pa.string()), ("kind", pa.string()), ("amount_low", pa.int64()), ("amount_high", pa.int64()), ("log_residual", pa.float64()), ("is_unique", pa.bool_()), ("unit_source", pa.string()), ("tied", pa.bool_()), ("interval_min", pa.int64())])

    def run(batches):
        intervals: dict[str | None, int] = {}
        for b in batches:
            out = []
            for k, d, u, f, t in zip(*(b.column(i).to_pylist() for i in range(5))):
                if found := resolve(d, u, t, factors, symbols):
                    if f not in intervals:
                        if len(intervals) > 50_000:
                            intervals.clear()
                        intervals[f] = interval_minutes(f)
                    out.append((k, *found, intervals[f]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    given = df.where(F.col(dose).isNotNull() & F.col(key).isNotNull())
    shown = F.col(text) if verify else F.when(F.coalesce(F.trim(F.col(unit)), F.lit("")) == "", F.col(text))
    return given.select(F.col(key).cast("string"), F.col(dose), F.col(unit), F.col(frequency), shown).mapInArrow(run, f"{key} string, {AMOUNTS}")
