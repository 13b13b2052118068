"""Tagging of records: nested boolean patterns and hierarchical codes, compiled to column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import any_of

#: A pattern, or (operator, parts...) with operator ``or``, ``and`` or ``not``.
Pattern = str | tuple


def matches(col: str | Column, pattern: Pattern) -> Column:
    """Whether a text fits a nested pattern, case aside; null never does."""
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(pattern, str):
        return F.coalesce(c.rlike(f"(?i){pattern}"), F.lit(False))
    op, *parts = pattern
    got = [matches(c, p) for p in parts]
    if op == "not":
        return ~got[0] & c.isNotNull()
    out = got[0]
    for g in got[1:]:
        out = out & g if op == "and" else out | g
    return out


def matches_any(cols: Sequence[str], pattern: Pattern) -> Column:
    return any_of([matches(c, pattern) for c in cols])


def has_code(cols: Sequence[str], codes: str | Sequence[str]) -> Column:
    """Whether one of the columns holds one of the codes or a finer one under it."""
    codes = [codes] if isinstance(codes, str) else codes
    return any_of([F.startswith(F.col(c), F.lit(k)) for c in cols for k in codes])


def valid_code(col: str, pattern: str) -> Column:
    """The code if it fits the pattern whole, else null."""
    return F.when(F.col(col).rlike(f"^(?:{pattern})$"), F.col(col))


# Dutch clinical patterns, matched case aside, and what may not stand before or behind them.
NO_DENIAL = r"(?<!\bgeen )(?<!\bniet )(?<!\bzonder )"
NO_DOUBT = r"(?<!\bmogelijk )(?<!\bverdenking )(?<!\bcave )(?<!\bdd )(?<!\bd\.d\. )"
NO_FEAR = r"(?<!\bangst voor )(?<!\bschrik voor )"
NO_QUESTION = r"(?! *\?)"
DYSPNEA_TERMS = [r"\bd[iy]spn", r"\bbenauw(d|ig|end)", r"\bbeklem(d|mend)", r"\bdrukkend", r"\bkortademig", r"\bkort +v(\.|an)? +adem", r"\badem *te *kort"]
EDEMA_TERM = r"\benkeloede[em]"
SWELLING_TERMS = [r"\bvocht(ophoping|\b)", r"\b(op)?gezwollen", r"\boede[em]", r"\bdikke"]
LEG_TERMS = [r"\bbenen\b", r"\benkels\b"]
HEART_FAILURE_TERMS = [r"hart *falen", r"cardio *m[yi]opath?ie", r"dec(\.?|omp\w*\.?) *cordis"]
AF_TERMS = [r"atrium\s*f", r"fibr(?!o)", r"\bboez", r"\b[ab]fib\b", r"\bp?[ab]f\b"]
VHD_TERMS = [r"\b[am]?klep", r"\bvalv", r"\bmitr", r"\baorta\s*k.*", r"\binsuf.*", r"steno.*"]
# End of the fixed values.


def affirmed(terms: Sequence[str]) -> Pattern:
    """One of the terms, not denied."""
    return ("or", *(NO_DENIAL + x for x in terms))


def diagnosed(terms: Sequence[str]) -> Pattern:
    """One of the terms, not denied, doubted, feared or asked for."""
    return ("or", *(NO_DENIAL + NO_DOUBT + NO_FEAR + x + NO_QUESTION for x in terms))


DYSPNEA = affirmed(DYSPNEA_TERMS)
EDEMA: Pattern = ("or", NO_DENIAL + EDEMA_TERM, ("and", affirmed(SWELLING_TERMS), ("or", *LEG_TERMS)))
HEART_FAILURE = diagnosed(HEART_FAILURE_TERMS)
AF = diagnosed(AF_TERMS)
VHD = diagnosed(VHD_TERMS)

# Symptoms, outcomes and risk factors by ICPC code (a code stands for all finer ones under it).
SYMPTOMS = {"dyspnea": ["K02", "R02"], "edema": ["K07"]}
OUTCOMES = {"HF": ["K77", "K84.03"], "AF": ["K78"], "VHD": ["K83"]}
RISK_FACTORS = {
    "cvd_in_family": ["A29.01"],
    "coronary_artery_disease": ["K74", "K75", "K76"],
    "atrial_fibrillation": ["K78", "K04", "K05", "K79", "K79.01", "K80", "K80.01"],
    "heart_murmur": ["K81"],
    "valvular_heart_disease": ["K83", "K83.01", "K83.02"],
    "hypertension": ["K86", "K87"],
    "stroke": ["K90"],
    "copd": ["R91", "R95"],
    "diabetes_mellitus": ["T90"],
    "chronic_kidney_disease": ["U99.01"],
    "alcohol_abuse": ["P15", "P16"],
    "tobacco_use": ["P17"],
    "obesity": ["T82", "T83"],
    "material_deprivation": ["Z01"],
}
#: The earlier, longer list.
RISK_FACTORS_LEGACY = {
    "coronary_artery_disease": ["K74", "K75", "K76"],
    "myocardial_infarction": ["K75", "K76.02"],
    "hypertension": ["K86", "K87"],
    "diabetes_mellitus": ["T90"],
    "atrial_fibrillation": ["K78"],
    "valvular_heart_disease": ["K83"],
    "aortic_stenosis": ["K83.01"],
    "mitralis_insufficiency": ["K83.02"],
    "heart_murmur": ["K81"],
    "chronic_kidney_disease": ["U99.01"],
    "aortic_aneurysm": ["K99.01"],
    "copd": ["R91", "R95"],
    "thyroid_dysfunction": ["T85", "T86"],
    "malignancy": ["A79", "B73", "B74", "D74", "D75", "D76", "D77", "N74", "R84", "R85", "S77.03", "U75", "U76", "U77", "Y77", "X75", "X76", "X77", "Y78"],
    "chronic_alcohol_abuse": ["P15"],
    "alcoholism": ["P15.01"],
    "delirium_tremens": ["P15.02"],
    "wernicke_korsakoff": ["P15.03"],
    "problematic_alcohol_use": ["P15.05"],
    "binge_drinking": ["P15.06"],
    "acute_alcohol_abuse": ["P16"],
    "substance_abuse": ["P19"],
    "tobacco_use": ["P17"],
    "anemia": ["B80", "B81", "B82", "B78"],
    "thalassemia": ["B78.01"],
    "sickle_cell_disease": ["B78.02"],
    "obesity": ["T82", "T83"],
    "depressive_disorder": ["P76", "P77"],
    "anxiety_disorder": ["P74"],
    "psychiatric_disorder": ["P71", "P72", "P73", "P79", "P80", "P98", "P99"],
    "dementia": ["P70"],
    "mental_retardation": ["P85"],
    "nutritional_deficiency": ["T91"],
    "inflammatory_bowel_disease": ["D94"],
    "rheumatic_arthritis": ["L88"],
    "cvd_in_family": ["A29.01"],
}
#: Coefficients of the risk score.
RISK_COEFFICIENTS = {
    "decades_age": 1.96,
    "male": 1.28,
    "alcohol_abuse": 1.55,
    "obesity": 1.10,
    "material_deprivation": 0.75,
    "hypertension": 1.09,
    "diabetes_mellitus": 1.44,
    "coronary_artery_disease": 1.52,
    "atrial_fibrillation": 2.10,
    "heart_murmur": 1.42,
    "valvular_heart_disease": 1.75,
    "stroke": 1.14,
    "copd": 1.47,
    "chronic_kidney_disease": 1.21,
    "cvd_in_family": 1.00,
    "tobacco_use": 1.00,
}
# End of the fixed values.


def risk_flags(codes: DataFrame, on: str, code: str, library: Mapping[str, Sequence[str]] = RISK_FACTORS) -> DataFrame:
    """One row for each ``on``: whether it has a code of each entry of the library; one aggregation, no pivot job."""
    return codes.groupBy(on).agg(*(F.max(has_code([code], k)).alias(name) for name, k in library.items()))
