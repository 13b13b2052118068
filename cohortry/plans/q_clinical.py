"""Registered queries over the clinical vocabulary: tags of Dutch notes, risk factors by code, risk scores.

The notes are made of a beginning, a term and an ending by doc_id; their SQL says for each
term when it counts, so it shares no pattern with the operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import features as X
from ..operators import tagging as G
from .registry import Tables, query
from .standins import PAT, patients

BEFORE = ["", "geen ", "niet ", "zonder ", "mogelijk ", "verdenking ", "cave ", "dd ", "d.d. ", "angst voor ", "schrik voor ", "wel ", "geen koorts, wel "]
#: When a term counts: always; not when denied; nor when doubted or feared; nor when asked for.
ALWAYS, DENIED, GUARDED, ASKED = 0, 1, 2, 3
TERMS = [
    ("hartfalen", "hf", ASKED), ("Cardiomyopathie", "hf", ASKED), ("decompensatio cordis", "hf", ASKED), ("hart falen", "hf", ASKED),
    ("atriumfibrilleren", "af", ALWAYS), ("boezemflutter", "af", GUARDED), ("afib", "af", ASKED), ("PAF", "af", ASKED),
    ("klepinsufficientie", "vhd", GUARDED), ("aortaklep", "vhd", GUARDED), ("mitralisstenose", "vhd", ALWAYS), ("stenose", "vhd", GUARDED),
    ("kortademig", "dyspnea", DENIED), ("benauwd", "dyspnea", DENIED), ("Dyspnoe", "dyspnea", DENIED), ("enkeloedeem", "edema", DENIED),
    ("dikke benen", "edema", DENIED), ("vocht in de enkels", "edema", DENIED), ("fibroom", None, ALWAYS), ("dikke buik", None, ALWAYS),
]
AFTER = ["", "?", " ?", " sinds gisteren", "."]
TAGS = ("hf", "af", "vhd", "dyspnea", "edema")
PATTERNS = dict(zip(TAGS, (G.HEART_FAILURE, G.AF, G.VHD, G.DYSPNEA, G.EDEMA), strict=True))


def notes(t: Tables):
    """(doc_id, note) for every document."""
    i = F.col("doc_id")
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    term = F.floor(i / len(BEFORE))
    return t.documents.select("doc_id", F.concat(pick(BEFORE, i), pick([x for x, _, _ in TERMS], term), pick(AFTER, F.floor(term / len(TERMS)))).alias("note"))


def _tags_sql() -> str:
    terms = ", ".join(f"({k}, {repr(tag) if tag else 'null'}, {when})" for k, (_, tag, when) in enumerate(TERMS))
    said = "case when b in (1, 2, 3) then t.rule = 0 when b between 4 and 10 then t.rule <= 1 when a in (1, 2) then t.rule <= 2 else true end"
    flags = ", ".join(f"coalesce(tag = '{x}' and {said}, false) as {x}" for x in TAGS)
    return f"""with t(k, tag, rule) as (values {terms}), n as (select doc_id, doc_id % {len(BEFORE)} as b, doc_id // {len(BEFORE)} % {len(TERMS)} as k,
 doc_id // {len(BEFORE) * len(TERMS)} % {len(AFTER)} as a from documents) select doc_id, {flags} from n join t using (k)"""


@query("pip_01_clinical_tags", _tags_sql())
def _(t):
    """Tags of heart failure, atrial fibrillation, valve disease, dyspnea and edema on notes with denial, doubt, fear and questions."""
    return notes(t).select("doc_id", *(G.matches("note", p).alias(x) for x, p in PATTERNS.items()))


#: ICPC codes that orders are given: those of the library, finer ones, and some that stand for nothing.
CODES = ["A29.01", "A29", "K74", "K75.01", "K76.02", "K78", "K04", "K80.01", "K81", "K83.02", "K86", "K87.01", "K90", "K89", "R91", "R95", "T90.02", "U99.01", "U99", "P15.03", "P16", "P17", "T82", "T83", "Z01", "K77", "K84.03", "K84", "K02", "K07", "D01"]
_CODED = f"{PAT}, coded as (select person_id, pid, age_days, sex, [{', '.join(map(repr, CODES))}][o_orderkey % {len(CODES)} + 1] as code from orders join pat on o_custkey = person_id)"


def coded(t: Tables):
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("o_orderkey") % len(CODES) + 1).cast("int"))
    return t.orders.select(F.col("o_custkey").alias("person_id"), code.alias("code")).join(patients(t), "person_id")


def _flags_sql(library) -> str:
    return ", ".join(f"bool_or({' or '.join(f'''starts_with(code, '{c}')''' for c in codes)}) as {name}" for name, codes in library.items())


_LIBRARY = {**G.RISK_FACTORS, **{f"outcome_{k}": v for k, v in G.OUTCOMES.items()}, **G.SYMPTOMS}


@query("fil_15_risk_factors", f"with {_CODED} select pid, {_flags_sql(_LIBRARY)} from coded group by 1")
def _(t):
    """The 14 risk factors, three outcomes and two symptoms of each patient by ICPC code."""
    return G.risk_flags(coded(t), "pid", "code", _LIBRARY)


_MORE = G.RISK_FACTORS_LEGACY


@query("fil_15_legacy_factors", f"with {_CODED} select pid, {_flags_sql(_MORE)} from coded group by 1")
def _(t):
    return G.risk_flags(coded(t), "pid", "code", _MORE)


_TERMS = {"decades_age": "decades_age", "male": "male::int", **{k: f"{k}::int" for k in G.RISK_FACTORS}}


@query(
    "ml_13_target_risk",
    f"""with {_CODED}, f as (select pid, max(age_days) / 3652.5::double as decades_age, max(sex) = 'M' as male, {_flags_sql(G.RISK_FACTORS)} from coded group by 1),
 m as (select {', '.join(f'avg({x}) as m_{k}' for k, x in _TERMS.items())} from f)
 select pid, round(ln_risk, 6) as ln_risk, round(exp(ln_risk), 4) as risk from (select pid, {' + '.join(f'{c}::double * ({_TERMS[k]} - m_{k})' for k, c in G.RISK_COEFFICIENTS.items())} as ln_risk from f, m)""",
)
def _(t):
    """The risk score with its 16 fixed coefficients: partial hazard against the mean of the cohort."""
    c = coded(t)
    base = c.groupBy("pid").agg((F.max("age_days") / F.lit(3652.5)).alias("decades_age"), (F.max("sex") == "M").alias("male"), *(F.max(G.has_code(["code"], v)).alias(k) for k, v in G.RISK_FACTORS.items()))
    rows = base.select("pid", *(F.col(k).cast("double").alias(k) for k in G.RISK_COEFFICIENTS))
    means = rows.agg(*(F.avg(k).alias(k) for k in G.RISK_COEFFICIENTS)).first().asDict()
    risk = X.risk_score(G.RISK_COEFFICIENTS, means)
    return rows.select("pid", S.r6(F.log(risk)).alias("ln_risk"), F.round(risk, 4).alias("risk"))
