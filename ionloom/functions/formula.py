"""Molecular formulas as column expressions: counts, text, masses, structure, classes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.session import cut_lineage

# Monoisotopic masses and the electron mass (Da).
MASS = {
    "C": 12.0,
    "H": 1.0078250319,
    "N": 14.0030740052,
    "O": 15.9949146221,
    "S": 31.97207069,
    "P": 30.97376163,
    "Si": 27.9769265350,
    "F": 18.9984031627,
    "Cl": 34.96885268,
    "Br": 78.9183371,
    "I": 126.9044719,
    "^N": 15.0001088984,
}
ELECTRON = 0.0005485799

# Field names of the count struct; '^N' (labelled nitrogen) becomes N15.
FIELDS = {"C": "C", "H": "H", "N": "N", "^N": "N15", "O": "O", "S": "S", "P": "P",
          "Si": "Si", "F": "F", "Cl": "Cl", "Br": "Br", "I": "I"}

# What each ion form adds to the neutral, and its charge sign.
ADDUCTS: dict[str, tuple[dict[str, int], int]] = {
    "[M-H]-": ({"H": -1}, -1),
    "[M+Br]-": ({"Br": 1}, -1),
    "[M+Cl]-": ({"Cl": 1}, -1),
    "[M+I]-": ({"I": 1}, -1),
    "[M+I2]-": ({"I": 2}, -1),
    "[M+I3]-": ({"I": 3}, -1),
    "[M-H+I2]-": ({"I": 2, "H": -1}, -1),
    "[M+NO3]-": ({"N": 1, "O": 3}, -1),
    "[M+^NO3]-": ({"^N": 1, "O": 3}, -1),
    "[M+HSO4]-": ({"H": 1, "S": 1, "O": 4}, -1),
    "[M+CHO2]-": ({"C": 1, "H": 1, "O": 2}, -1),
    "[M+C2H3O2]-": ({"C": 2, "H": 3, "O": 2}, -1),
    "[M+CO3]-": ({"C": 1, "O": 3}, -1),
    "[M+O2]-": ({"O": 2}, -1),
    "[M]-.": ({}, -1),
    "[M+HBr+CO3]-": ({"H": 1, "Br": 1, "C": 1, "O": 3}, -1),
    "[M+Br2]-": ({"Br": 2}, -1),
    "[M+HBr+Br]-": ({"H": 1, "Br": 2}, -1),
    "[M+Br3]-": ({"Br": 3}, -1),
    "[M+HBr+Br2]-": ({"H": 1, "Br": 3}, -1),
    "[M+H]+": ({"H": 1}, 1),
    "[M+NH4]+": ({"N": 1, "H": 4}, 1),
    "[M+(CH4N2O)H]+": ({"C": 1, "H": 5, "N": 2, "O": 1}, 1),
}
# Metal ion forms, as plain mass shifts.
METAL_SHIFTS = {"[M+Na]+": 22.9897692820 - ELECTRON, "[M+K]+": 38.9637064864 - ELECTRON}

# Homologous repeat units.
REPEAT_UNITS: dict[str, dict[str, int]] = {
    "CH2": {"C": 1, "H": 2},
    "H2O": {"H": 2, "O": 1},
    "O": {"O": 1},
    "CO": {"C": 1, "O": 1},
    "CO2": {"C": 1, "O": 2},
    "C2H2O": {"C": 2, "H": 2, "O": 1},
    "CF2": {"C": 1, "F": 2},
    "C2H6OSi": {"C": 2, "H": 6, "O": 1, "Si": 1},
    "HBr": {"H": 1, "Br": 1},
    "HCl": {"H": 1, "Cl": 1},
    "HI": {"H": 1, "I": 1},
    "C2H4O2": {"C": 2, "H": 4, "O": 2},
    "C2F4": {"C": 2, "F": 4},
    "C2H4O": {"C": 2, "H": 4, "O": 1},
    "C3H6O": {"C": 3, "H": 6, "O": 1},
    "CH2O": {"C": 1, "H": 2, "O": 1},
    "SO3": {"S": 1, "O": 3},
}
ORGANIC_UNITS = ("CH2", "H2O", "O", "CO", "CO2", "C2H2O")

# Heteroatom weights of the complexity penalty.
COMPLEXITY = {"N": 3, "S": 8, "P": 25, "Cl": 50, "Br": 50, "Si": 80, "I": 80, "F": 30}


def adduct_shift(adduct: str) -> float:
    if adduct in METAL_SHIFTS:
        return METAL_SHIFTS[adduct]
    delta, charge = ADDUCTS[adduct]
    return plain_mass(delta) - charge * ELECTRON


def plain_mass(counts: Mapping[str, int]) -> float:
    return sum(MASS[el] * n for el, n in counts.items())


def unit_mass(unit: str) -> float:
    return plain_mass(REPEAT_UNITS[unit])


def count_of(formula: Column, element: str) -> Column:
    """Atoms of one element; repeated tokens add up, a bare symbol counts once."""
    symbol = r"\^N" if element == "^N" else rf"(?<!\^){element}(?![a-z])"
    numbers = F.regexp_extract_all(formula, F.lit(symbol + r"(\d*)"), 1)
    total = F.aggregate(
        F.transform(numbers, lambda x: F.when(x == "", 1).otherwise(x.try_cast("int"))),
        F.lit(0),
        lambda a, b: a + b,
    )
    # Most elements are absent from most formulas, and a plain search tells so at little cost.
    return F.when(~F.contains(formula, F.lit(element)), 0).otherwise(total)


def counts(formula: Column) -> Column:
    """Struct of element counts of a formula text (zeros for a null text)."""
    text = F.coalesce(formula, F.lit(""))
    return F.struct(*[count_of(text, el).alias(field) for el, field in FIELDS.items()])


def parsed(formulas: DataFrame, formula: str, out: str = "el") -> DataFrame:
    """The distinct formulas and their count structs, as a table.

    Without it later filters and projections would move below the distinct and parse the formula of every row, once per use.
    """
    return cut_lineage(formulas.select(formula).distinct().withColumn(out, counts(F.col(formula))))


def with_counts(df: DataFrame, formula: str, out: str = "el") -> DataFrame:
    """``df`` plus the count struct of ``formula``; each distinct formula is parsed once."""
    key = parsed(df.select(F.col(formula).alias("_formula")), "_formula", out)
    return df.join(key, F.col(formula).eqNullSafe(F.col("_formula"))).drop("_formula")


def n(el: Column, *elements: str) -> Column:
    """Sum of element counts out of a count struct."""
    total = el[FIELDS[elements[0]]]
    for e in elements[1:]:
        total = total + el[FIELDS[e]]
    return total


def mass(el: Column) -> Column:
    total = F.lit(0.0)
    for element, field in FIELDS.items():
        total = total + el[field] * F.lit(MASS[element])
    return total


def shifted(el: Column, delta: Mapping[str, int], times: Column | int = 1) -> Column:
    """Count struct plus ``times`` units, or null when a count would turn negative."""
    k = times if isinstance(times, Column) else F.lit(times)
    moved = {e: el[f] + k * delta.get(e, 0) for e, f in FIELDS.items()}
    ok = F.lit(True)
    for e in delta:
        ok = ok & (moved[e] >= 0)
    return F.when(ok, F.struct(*[moved[e].alias(f) for e, f in FIELDS.items()]))


def counts_literal(counts: Mapping[str, int], times: int = 1) -> str:
    """SQL text of a count struct; a table of them in one text is built in one call, not one per number."""
    return "named_struct(" + ", ".join(f"'{f}', {counts.get(e, 0) * times}" for e, f in FIELDS.items()) + ")"


def adduct_delta(adduct: Column) -> Column:
    """Struct of the atoms an ion form adds; null for an unknown form."""
    table = F.expr("map(" + ", ".join(f"'{a}', {counts_literal(delta)}" for a, (delta, _) in ADDUCTS.items()) + ")")
    return F.try_element_at(table, adduct)


def folded(el: Column) -> Column:
    """Labelled nitrogen counted as nitrogen."""
    return F.struct(
        *[
            (el["N"] + el["N15"] if f == "N" else F.lit(0) if f == "N15" else el[f]).alias(f)
            for f in FIELDS.values()
        ]
    )


def text(el: Column) -> Column:
    """Hill-order text: C, H, then the other symbols in alphabetical order."""
    order = ["C", "H", "Br", "Cl", "F", "I", "N", "^N", "O", "P", "S", "Si"]
    parts = []
    for e in order:
        c = el[FIELDS[e]]
        parts.append(
            F.when(c == 1, F.lit(e)).when(c > 1, F.concat(F.lit(e), c.cast("string"))).otherwise("")
        )
    return F.concat(*parts)


def dbe(el: Column) -> Column:
    """Double bond equivalents of the neutral."""
    return (
        F.lit(1.0) + n(el, "C", "Si") + n(el, "N", "P", "^N") / 2.0 - n(el, "H", "F", "Cl", "Br", "I") / 2.0
    )


def senior_cap(el: Column) -> Column:
    return n(el, "C", "Si") + n(el, "N", "^N") / 2.0 + 1.0


def oxygen_cap(el: Column) -> Column:
    return n(el, "C", "N", "^N", "S", "P") * 2 + 4


def structure_ok(el: Column) -> Column:
    """Non-negative whole DBE within the valence cap."""
    d = dbe(el)
    return (d >= 0) & (d == F.floor(d)) & (d <= senior_cap(el))


def complexity_penalty(el: Column, scale: float = 0.01, cap: float = 0.20) -> Column:
    raw = F.lit(0)
    for e, w in COMPLEXITY.items():
        raw = raw + el[e] * w
    return F.least(raw * F.lit(scale), F.lit(cap))


def backbone(el: Column) -> Column:
    return F.when(el["S"] > 0, "CHOS").when(el["N"] > 0, "CHON").otherwise("CHO")


def full_class(el: Column) -> Column:
    return (
        F.when(el["Si"] > 0, "siloxane")
        .when(el["F"] > 0, "F-containing")
        .when(n(el, "Cl", "Br") > 0, "halogenated")
        .otherwise(backbone(el))
    )


def panel_class(formula: Column, el: Column) -> Column:
    """Class of a report panel; unlike ``backbone`` it separates CHONS and inorganics."""
    return (
        F.when(F.coalesce(formula, F.lit("")).rlike(r"^(\?|$)"), "unassigned")
        .when(el["C"] == 0, "inorganic")
        .when(el["Si"] > 0, "Si / siloxane")
        .when(el["F"] > 0, "F-containing")
        .when(n(el, "Cl", "Br", "I") > 0, "halogenated")
        .when((el["N"] > 0) & (el["S"] > 0), "CHONS")
        .when(el["S"] > 0, "CHOS")
        .when(el["N"] > 0, "CHON")
        .otherwise("CHO")
    )


def minus_nh3(el: Column) -> Column:
    """The partner one ammonia lighter, or null without one to remove."""
    return shifted(el, {"N": -1, "H": -3})


def mass_defect(mz: Column) -> Column:
    return mz - F.rint(mz)


def kendrick_mass(mz: Column, unit: str, x: int) -> Column:
    return mz * x / F.lit(unit_mass(unit))


def kendrick_defect(mz: Column, unit: str, x: int) -> Column:
    k = kendrick_mass(mz, unit, x)
    return k - F.rint(k)
