"""Re-readings: the same ion read as another neutral under another ion form.

A rule is data: what the neutral gains or loses per ion form, the form it is then read as, which
neutrals it applies to and whose testimony it asks for. One engine applies rules in order. Only
the rows a rule can apply to meet the testimony, so a step shuffles a few rows of the ledger
whatever its size; every step that moves rows writes an audit of before and after.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.functions import formula as fx
from ionloom.operators.claims import MINOR_CHANNELS, Z_ACCEPT, with_calibration, z_score
from ionloom.session import cut_lineage

PEAK = ["sample_item_id", "peak_id"]
HETERO = ("N", "^N", "O", "S", "P", "F", "Cl", "Br", "I", "Si")
# Ion forms that need a functional group, and forms by attachment of an electron.
GROUP_CHANNELS = ("[M-H]-", "[M+Br]-", "[M+Cl]-")
ELECTRON_CHANNELS = ("[M]-.", "[M]-", "[M+O2]-")
#: Columns that the engine adds to a ledger without them.
DEFAULTS = {"ion_formula": "string", "tier": "string", "confidence": "string", "below_assignability": "boolean", "locked": "boolean"}
AUDIT = [*PEAK, "rule", "before_formula", "before_adduct", "before_tier", "after_formula", "after_adduct", "after_tier", "corroborated"]


def bare(el: Column) -> Column:
    """Carbon and hydrogen only: nothing that could hold a charge or a cluster."""
    return (el["C"] >= 1) & (fx.n(el, *HETERO) == 0)


def nitrate_ester(el: Column) -> Column:
    return (el["C"] >= 1) & (el["N"] >= 1) & (el["O"] >= 3) & (el["N15"] == 0)


@dataclass(frozen=True)
class Rule:
    """``forms``: ion form -> (atoms the neutral gains, ion form it is read as).

    ``witness`` are the ion forms under which an owner or child of the same sample testifies to
    the new neutral (to the old one with ``of_old``). ``needs`` says what a move takes: True a
    testimony, False its absence, None nothing. ``demote`` takes the Assigned tier; ``below``
    flags the row as beyond assignability (``"unless"``: not if corroborated).
    """

    name: str
    forms: Mapping[str, tuple[Mapping[str, int], str]]
    applies: Callable[[Column], Column]
    witness: tuple[str, ...] = ()
    of_old: bool = False
    needs: bool | None = None
    demote: bool = False
    below: bool | str = False
    confidence: tuple[str | None, str | None] = (None, None)


# Atoms of the clusters, and of what a protonated reading leaves of them.
RADICAL_ANION = Rule(
    "radical anion",
    {
        "[M+CO3]-": ({"C": 1, "O": 3}, "[M]-."),
        "[M+NO3]-": ({"N": 1, "O": 3}, "[M]-."),
        "[M+^NO3]-": ({"N": 1, "O": 3}, "[M]-."),
    },
    bare, GROUP_CHANNELS, demote=True, below="unless",
    confidence=("Low (radical anion)", "Good (radical anion, corroborated)"),
)
REAGENT_NITROGEN = Rule(
    "reagent nitrogen",
    {
        "[M+NH4]+": ({"N": 1, "H": 3}, "[M+H]+"),
        "[M+(CH4N2O)H]+": ({"C": 1, "H": 4, "N": 2, "O": 1}, "[M+H]+"),
    },
    bare, ("[M+H]+",), of_old=True, needs=False, demote=True, below=True,
    confidence=("Low (reagent-N re-read)", None),
)
NITRATE_CLUSTER = Rule(
    "nitrate cluster",
    {"[M-H]-": ({"H": -1, "N": -1, "O": -3}, "[M+NO3]-")},
    nitrate_ester, ("[M-H]-", "[M+^NO3]-"), needs=True,
    confidence=(None, "Good (14NO3 cluster re-read)"),
)


def reagent_halogen(element: str) -> Rule:
    """A reagent halogen in the neutral read as part of the ion form, where such a form is modelled."""
    gone, hx = {"H": -1, element: -1}, f"H{element}"
    forms = {"[M-H]-": (gone, f"[M+{element}]-")}
    for form in fx.ADDUCTS:
        wider = f"[M+{hx}+{form[3:-2]}]-"
        if wider in fx.ADDUCTS and form.endswith("]-") and hx not in form:
            forms[form] = (gone, wider)
    return Rule("reagent halogen", forms, lambda el: el["C"] >= 1)


def rules_of(reagent: str | None = None, labelled: bool = False) -> list[Rule]:
    """Rules of a run in their order: by the reagent's element, and whether its nitrogen is labelled."""
    first = [reagent_halogen(reagent)] if reagent in ("Br", "Cl", "I") else []
    return [*first, RADICAL_ANION, REAGENT_NITROGEN, *([NITRATE_CLUSTER] if labelled else [])]


def _by_form(rule: Rule, value: Callable[[Mapping[str, int], str], Column]) -> Column:
    branches = [(F.col("adduct") == form, value(*move)) for form, move in rule.forms.items()]
    return reduce(lambda w, b: w.when(*b), branches[1:], F.when(*branches[0]))


def _charge(form: Column) -> Column:
    return F.when(form.endswith("+"), "+").otherwise("-")


def prepared(ledger: DataFrame) -> DataFrame:
    """``ledger`` with the columns that re-readings write; those it lacks are null, flags false."""
    for name, kind in DEFAULTS.items():
        if name not in ledger.columns:
            ledger = ledger.withColumn(name, F.lit(None).cast(kind))
    return ledger.withColumns({f: F.coalesce(f, F.lit(False)) for f, kind in DEFAULTS.items() if kind == "boolean"})


def _readings(rows: DataFrame, rule: Rule) -> DataFrame:
    """What each distinct (neutral, form) of ``rows`` is read as: ``_formula, _form, _ion, _dbe``, and the
    neutral ``_asked`` about, null where the rule does not apply or leaves no valid neutral.

    Counts are materialised before they are used, so that each formula is parsed once.
    """

    def counted(array: str) -> Column:
        return F.struct(*[F.col(array)[i].alias(f) for i, f in enumerate(fx.FIELDS.values())])

    gain = _by_form(rule, lambda atoms, _: F.array(*[F.lit(atoms.get(e, 0)) for e in fx.FIELDS]))
    extra = _by_form(rule, lambda _, to: F.array(*[F.lit(fx.ADDUCTS[to][0].get(e, 0)) for e in fx.FIELDS]))
    old = F.array(*[fx.count_of(F.col("neutral_formula"), e) for e in fx.FIELDS])
    pairs = rows.select("neutral_formula", "adduct").distinct()
    numbers = cut_lineage(pairs.select("neutral_formula", "adduct", old.alias("_old"), gain.alias("_gain"), extra.alias("_extra")))
    moved = numbers.withColumn("_new", F.zip_with("_old", "_gain", lambda a, b: a + b))
    moved = cut_lineage(moved.withColumn("_both", F.zip_with("_new", "_extra", lambda a, b: a + b)))
    el, new = counted("_old"), counted("_new")
    fits = rule.applies(el) & F.forall("_new", lambda k: k >= 0) & fx.structure_ok(new) & (new["O"] <= fx.oxygen_cap(new))
    form = _by_form(rule, lambda _, to: F.lit(to))
    return moved.select(
        "neutral_formula", "adduct", fx.text(new).alias("_formula"), form.alias("_form"), fx.dbe(new).alias("_dbe"),
        F.concat(fx.text(counted("_both")), _charge(form)).alias("_ion"),
        F.when(F.coalesce(fits, F.lit(False)), fx.text(el if rule.of_old else new)).alias("_asked"),
    )


def apply_rule(ledger: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """The ledger after one rule, and the audit rows of what moved.

    A row moves if it owns its peak, is of one of the rule's forms and classes, has every atom
    that goes, leaves a valid closed-shell neutral, and has the testimony that the rule asks for.
    All rows of a step see the ledger as it was before the step. Locked rows move too: mass and
    ion stay as they are. Rows without formula or form never move; repeated rows move alike.
    """
    can = F.coalesce((F.col("role") == "M0") & F.col("adduct").isin(*rule.forms) & F.col("neutral_formula").isNotNull(), F.lit(False))
    rows = ledger.where(can).join(_readings(ledger.where(can), rule), ["neutral_formula", "adduct"])
    stay = rows.where("_asked IS NULL").withColumn("_told", F.lit(False)).withColumn("_moves", F.lit(False))
    fits = rows.where("_asked IS NOT NULL")
    if rule.witness:
        told = ledger.where(F.col("adduct").isin(*rule.witness)).select("sample_item_id", "neutral_formula").distinct()
        told = fx.with_counts(told, "neutral_formula", "_w").where(F.col("_w.C") >= 1)
        told = told.select("sample_item_id", fx.text(F.col("_w")).alias("_asked")).distinct().withColumn("_told", F.lit(True))
        fits = fits.join(told, ["sample_item_id", "_asked"], "left").withColumn("_told", F.coalesce("_told", F.lit(False)))
    else:
        fits = fits.withColumn("_told", F.lit(False))
    fits = fits.withColumn("_moves", F.lit(True) if rule.needs is None else F.col("_told") == F.lit(rule.needs))
    both = cut_lineage(stay.unionByName(fits))

    moves, told = F.col("_moves"), F.col("_told")
    plain, backed = (F.lit(c).cast("string") for c in rule.confidence)
    tier = F.when(F.lit(rule.demote) & (F.col("tier") == "Assigned"), "Candidate").otherwise(F.col("tier"))
    below = ~told if rule.below == "unless" else F.lit(True) if rule.below else F.col("below_assignability")
    written = {
        "neutral_formula": F.col("_formula"), "adduct": F.col("_form"), "ion_formula": F.col("_ion"), "tier": tier,
        "confidence": F.coalesce(F.when(told, backed).otherwise(plain), "confidence"), "below_assignability": below,
    }
    if "dbe" in ledger.columns:
        written["dbe"] = F.col("_dbe").cast(ledger.schema["dbe"].dataType)
    after = both.select(
        *[F.when(moves, written[c]).otherwise(F.col(c)).alias(c) if c in written else F.col(f"`{c}`") for c in ledger.columns]
    )
    audit = both.where(moves).select(
        *PEAK, F.lit(rule.name).alias("rule"), F.col("neutral_formula").alias("before_formula"), F.col("adduct").alias("before_adduct"),
        F.col("tier").alias("before_tier"), F.col("_formula").alias("after_formula"), F.col("_form").alias("after_adduct"),
        tier.alias("after_tier"), told.alias("corroborated"),
    )
    return ledger.where(~can).unionByName(after), audit


def reread(ledger: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Ledger after all rules in order, and one audit row per move with its ``step`` (from 1).

    A row may move in several steps. The rows that a step looks at are checkpointed, so later
    steps do not repeat it; the rest of the ledger is only filtered, never shuffled.
    An empty ledger, or no rule, gives the ledger and an empty audit.
    """
    ledger = prepared(ledger)
    audit = None
    for step, rule in enumerate(rules, 1):
        ledger, moved = apply_rule(ledger, rule)
        moved = moved.select(F.lit(step).alias("step"), *AUDIT)
        audit = moved if audit is None else audit.unionByName(moved)
    if audit is None:
        texts = [F.lit(None).cast("string").alias(c) for c in AUDIT if c not in (*PEAK, "corroborated")]
        audit = ledger.limit(0).select(F.lit(0).alias("step"), *PEAK, *texts, F.lit(False).alias("corroborated")).select("step", *AUDIT)
    return ledger, audit


# Ions of bromine reagents: ion, neutral, ion form, what it is, whether the reagent itself.
HALOCARBONS = (
    ("CHBr2", "CH2Br2", "[M-H]-", "dibromomethane", True),
    ("CBr3", "CHBr3", "[M-H]-", "bromoform", True),
    ("C2HBr2O2", "C2H2Br2O2", "[M-H]-", "dibromoacetic acid", False),
)


def _atoms(formula: str) -> dict[str, int]:
    return {e: int(k or 1) for e, k in re.findall(r"([A-Z][a-z]?)(\d*)", formula)}


def halocarbons(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unlocked rows whose ion is a known bromine background, named by the ion whatever was read.

    Precursors of the reagent leave the owners (role ``reagent``), the others keep their role and
    get the neutral and form of the table. Returns the ledger and ``(peak, label, role)`` of the
    rows that changed. A few literal branches on the ion's composition: no join.
    """
    ledger = prepared(ledger)
    elements = ("C", "H", "Br", "O")
    found = F.concat_ws(",", *[fx.count_of(F.col("ion_formula"), e).cast("string") for e in elements])
    plausible = F.col("ion_formula").rlike(r"^((C|H|Br|O)[0-9]*)+[+.-]*$") & F.contains("ion_formula", F.lit("Br")) & ~F.col("locked")
    marked = ledger.withColumn("_ion", F.when(plausible, found))

    def pick(value: Callable[[tuple], Column]) -> Column:
        branches = [(F.col("_ion") == ",".join(str(_atoms(t[0]).get(e, 0)) for e in elements), value(t)) for t in HALOCARBONS]
        return reduce(lambda w, b: w.when(*b), branches[1:], F.when(*branches[0]))

    marked = marked.withColumn("_label", pick(lambda t: F.lit(t[3])))
    written = {
        "role": pick(lambda t: F.lit("reagent") if t[4] else F.col("role")),
        "neutral_formula": pick(lambda t: F.col("neutral_formula") if t[4] else F.lit(t[1])),
        "adduct": pick(lambda t: F.col("adduct") if t[4] else F.lit(t[2])),
    }
    known = F.col("_label").isNotNull()
    after = marked.select(
        *[F.when(known, written[c]).otherwise(F.col(c)).alias(c) if c in written else F.col(f"`{c}`") for c in ledger.columns], "_label"
    )
    return after.drop("_label"), after.where(known).select(*PEAK, F.col("_label").alias("label"), "role")


def demotions(ledger: DataFrame, cal: DataFrame, z_accept: float = Z_ACCEPT) -> DataFrame:
    """Owners that cannot ionise as read, and residual fits that are Assigned on weak evidence.

    One row per owner: ``(peak, before_tier, after_tier, reason)``; all are beyond assignability.
    The isotope lines of an owner are ``n_iso`` if the ledger has it, else its children. Owners
    of samples without calibration are never off calibration.
    """
    owners = ledger.where("role = 'M0'")
    if "n_iso" not in ledger.columns:
        kids = ledger.where("role = 'iso_child'").groupBy("sample_item_id", F.col("parent_peak_id").alias("peak_id")).agg(
            F.count(F.lit(1)).alias("n_iso")
        )
        owners = owners.join(kids, PEAK, "left")
    for name in ("method", "tier", "commentary"):
        if name not in owners.columns:
            owners = owners.withColumn(name, F.lit(None).cast("string"))
    major = owners.where(~F.coalesce(F.col("adduct").isin(*MINOR_CHANNELS), F.lit(False)))
    major = major.select("sample_item_id", "neutral_formula").where("neutral_formula IS NOT NULL").distinct().withColumn("_major", F.lit(True))
    lone = F.coalesce(F.col("adduct").isin(*MINOR_CHANNELS), F.lit(False)) & F.col("neutral_formula").isNotNull()
    rows = owners.where(lone).join(major, ["sample_item_id", "neutral_formula"], "left").select(*owners.columns, "_major").unionByName(
        owners.where(~lone).withColumn("_major", F.lit(True))
    )
    rows = fx.with_counts(with_calibration(rows, cal), "neutral_formula", "_el")
    el, z, single = F.col("_el"), z_score(F.col("ppm_error"), F.col("cal_mu"), F.col("cal_sigma")), F.coalesce("n_iso", F.lit(0)) == 0
    residual = (F.col("tier") == "Assigned") & F.coalesce("method", F.lit("")).startswith("residual")
    reason = (
        F.when(bare(el) & F.col("adduct").endswith("-") & ~F.col("adduct").isin(*ELECTRON_CHANNELS), "cannot ionise")
        .when(residual & (z > z_accept), "off calibration")
        .when(residual & single & (el["N"] >= 3), "nitrogens without isotopes")
        .when(residual & F.contains(F.coalesce("commentary", F.lit("")), F.lit("0 supporting anchors")), "no anchors")
        .when(residual & single & F.col("_major").isNull(), "minor channel alone")
    )
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select(
        *PEAK, F.col("tier").alias("before_tier"), F.when(F.col("tier") == "Assigned", "Candidate").otherwise(F.col("tier")).alias("after_tier"), "reason"
    )


def apply_demotions(ledger: DataFrame, audit: DataFrame) -> DataFrame:
    """Tiers after an audit of ``demotions``, its rows flagged as beyond assignability."""
    hit = audit.groupBy(*PEAK).agg(F.min("after_tier").alias("_tier"), F.lit(True).alias("_hit"))
    owner = (F.col("role") == "M0") & F.col("_hit").isNotNull()
    return prepared(ledger).join(hit, PEAK, "left").withColumns(
        {
            "tier": F.when(owner, F.col("_tier")).otherwise(F.col("tier")),
            "below_assignability": owner | F.col("below_assignability"),
        }
    ).drop("_tier", "_hit")
