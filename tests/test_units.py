from fractions import Fraction

import pytest
from lexforge.operators import units

STANDARDS = [("ng", "mass", 1), ("mcg", "mass", 1000), ("mg", "mass", 10**6), ("g", "mass", 10**9), ("uL", "volume", 1), ("mL", "volume", 1000), ("L", "volume", 10**6), ("tsp", "volume", 5000), ("tbsp", "volume", 15000), ("IU", "activity", 1), ("mEq", "charge", 1000), ("form", "count", 1000)]
FACTORS = {s: (k, f) for s, k, f in STANDARDS}


def read(dose, unit=None, text=None):
    return units.read_dose(dose, unit, text, FACTORS, units._symbols())


@pytest.mark.parametrize(
    ("dose", "unit", "expected"),
    [
        ("10 mg", None, ("mass", 10**7, 10**7)),
        ("2,5 mg", None, ("mass", 2_500_000, 2_500_000)),
        ("1,000 U", None, ("activity", 1000, 1000)),
        ("I.U. 1,000", None, ("activity", 1000, 1000)),
        ("Mg 40", None, ("mass", 4 * 10**7, 4 * 10**7)),
        ("between 250 and 500 mg.", "mg.", ("mass", 25 * 10**7, 5 * 10**8)),
        ("10-20 milligrams", None, ("mass", 10**7, 2 * 10**7)),
        ("500 to 250 mg", None, ("mass", 25 * 10**7, 5 * 10**8)),
        ("500 mg - 1 g", None, ("mass", 5 * 10**8, 10**9)),
        ("0.1 G (2 x 0.05 g)", "g", ("mass", 10**8, 10**8)),
        ("one and a half tablets", "tabs", ("count", 1500, 1500)),
        ("one-half gram", None, ("mass", 5 * 10**8, 5 * 10**8)),
        ("1½ tablets", None, ("count", 1500, 1500)),
        ("½ tablet", None, ("count", 500, 500)),
        ("1/2 g", None, ("mass", 5 * 10**8, 5 * 10**8)),
        (".08 grams", None, ("mass", 8 * 10**7, 8 * 10**7)),
        ("1.2 million IU", "million units", ("activity", 1_200_000, 1_200_000)),
        ("2.4", "million units", ("activity", 2_400_000, 2_400_000)),
        ("approx. 88 µg", None, ("mass", 88_000, 88_000)),
        ("up to 88  μg ", None, ("mass", 88_000, 88_000)),
        ("two teaspoonfuls", None, ("volume", 10_000, 10_000)),
        ("7.5 cc", "cc", ("volume", 7500, 7500)),
        ("20 mEq", None, ("charge", 20_000, 20_000)),
    ],
)
def test_doses(dose, unit, expected):
    assert read(dose, unit)[:3] == expected


@pytest.mark.parametrize("dose", ["10 mg/kg", "75 mg/m2", "0.5 mL/kg", "weight-based", "N/A", "?", "-", "as directed", "", None, "5 mg per kg", "20", "5 sachets"])
def test_no_amounts(dose):
    assert read(dose) is None


def test_unit_from_text():
    assert read("180", None, "Take 180 mg. Swallow with 150 mL of water.")[:3] == ("mass", 180 * 10**6, 180 * 10**6)
    kind, low, high, residual, unique, place = read("25–50", None, "Give 25 to 50 mcg daily.")
    assert (kind, low, high, unique, place) == ("mass", 25_000, 50_000, True, "text") and residual < 1e-9
    assert read("5", None, "Take 5 mg with 5 mL of water.")[4] is False
    assert read("5 mg", None, "Take 10 mg.")[3] == pytest.approx(0.693147 * 2, abs=1e-4)
    assert read("10", "mg/kg", "10 mg") is None


def test_resolution_is_one_minimisation():
    resolve = lambda *x: units.resolve(*x, FACTORS, units._symbols())
    # implied: no unit stands behind this number, but grams make the amounts agree
    assert resolve("0.5", "", "Dose: 500 mg") == ("mass", 5 * 10**8, 5 * 10**8, 0.0, True, "implied", False)
    assert resolve("20", None, "Take 3 mL.") is None
    # earlier statements decide, contradictions are flagged
    assert resolve("5 mg", "g", "Take 5 g.")[:3] == ("mass", 5 * 10**6, 5 * 10**6) and resolve("5 mg", "g", "Take 5 g.")[4:] == (False, "dose", False)
    assert resolve("5 mg", None, "Take 5 g.")[4:] == (False, "dose", False)
    assert resolve("2 tablets", "mg", "2 mg")[0] == "count"
    assert resolve("5 mg", None, "At most 40 mg; 10 mg at first.")[4:] == (True, "dose", False)
    assert resolve("5", "mg", "Take 5 mg with 5 mL of water.")[4:] == (True, "unit column", False)
    # ties of one rank are returned and flagged; a unit behind the number outranks an implied one
    assert resolve("5", None, "Take 5 mg with 5 mL of water.")[4:] == (False, "text", True)
    assert resolve("5", None, "Take 5 mg, at most 5000 mg.")[:3] == ("mass", 5 * 10**6, 5 * 10**6)
    assert resolve("5", None, "Take 5 mg, at most 5000 mg.")[5:] == ("text", False)


def test_numbers():
    assert units.number("1,234,567.5") == Fraction("1234567.5")
    assert units.number("12,34") == Fraction("12.34")


@pytest.mark.parametrize(
    ("frequency", "minutes"),
    [("BID", 720), ("q.i.d.", 360), ("q 12 h", 720), ("q4w", 40320), ("every other week", 20160), ("on alternate days", 2880), ("every third day", 4320), ("1x/week", 10080), ("six times daily", 240), ("hourly", 60),
     ("every 60 minutes", 60), ("at bedtime", 1440), ("fortnightly", 20160), ("PRN", 0), ("every 6 hours as needed", 0), ("as directed", 0), (None, 0), ("", 0), ("every 4 to 6 hours", 0), ("EVERY FOUR HOURS", 240), ("3 times a week", 3360)],
)
def test_intervals(frequency, minutes):
    assert units.interval_minutes(frequency) == minutes


def test_table(spark):
    standards = spark.createDataFrame(STANDARDS, "unit_symbol string, kind string, factor long")
    rows = [("a", "10 mg", None, "BID", None, "x"), ("a", "10 mg", None, "BID", None, "x"), ("b", None, "mg", None, "5 mg", "y"), (None, "5 mg", None, None, None, None), ("c", "5", None, None, "z" * 200_000 + " 5 g", None)]
    df = spark.createDataFrame(rows, "id string, dose string, dose_unit string, frequency string, text string, kind string")
    for verify in (True, False):
        out = {tuple(r)[:4] + (r["interval_min"],) for r in units.normalise_doses(df, "id", standards, verify=verify).collect()}
        assert out == {("a", "mass", 10**7, 10**7, 720), ("c", "mass", 5 * 10**9, 5 * 10**9, 0)}
    assert units.normalise_doses(df.limit(0), "id", standards).count() == 0
