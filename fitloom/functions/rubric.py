"""The published rubric: its values, and the column functions that apply them.

All arithmetic is on integers, HALF_UP: weights and credits in hundredths, their products in ten-thousandths, coverage in
10^-10, scores in tenths, applied weights in ten-thousandths. Only the coverage quotient needs more than a long.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category, name shown, weight in hundredths.
CATEGORIES = [
    ("CORE_TECHNICAL_STACK", "Core Technical Stack", 25),
    ("ROLE_AND_RESPONSIBILITY_ALIGNMENT", "Role & Responsibility Alignment", 20),
    ("EXPERIENCE_EVIDENCE", "Experience Evidence", 15),
    ("SENIORITY_AND_OWNERSHIP", "Seniority & Ownership", 15),
    ("REQUIRED_QUALIFICATION_COVERAGE", "Required Qualification Coverage", 15),
    ("DOMAIN_AND_OPERATING_ENVIRONMENT", "Domain & Operating Environment", 10),
]
REQUIRED = "REQUIRED_QUALIFICATION_COVERAGE"
COVERAGE_CATEGORIES = ["CORE_TECHNICAL_STACK", "ROLE_AND_RESPONSIBILITY_ALIGNMENT", "DOMAIN_AND_OPERATING_ENVIRONMENT"]
# Category, subfactor, weight in hundredths.
SUBFACTORS = [
    ("EXPERIENCE_EVIDENCE", "specificity", 25), ("EXPERIENCE_EVIDENCE", "outcomes", 20), ("EXPERIENCE_EVIDENCE", "depth", 25),
    ("EXPERIENCE_EVIDENCE", "recency", 15), ("EXPERIENCE_EVIDENCE", "consistency", 15),
    ("SENIORITY_AND_OWNERSHIP", "yearsAlignment", 20), ("SENIORITY_AND_OWNERSHIP", "systemComplexity", 20),
    ("SENIORITY_AND_OWNERSHIP", "endToEndDelivery", 20), ("SENIORITY_AND_OWNERSHIP", "ownershipScope", 20),
    ("SENIORITY_AND_OWNERSHIP", "measurableOutcomes", 10), ("SENIORITY_AND_OWNERSHIP", "leadership", 10),
]
# Coverage in hundredths, score in tenths.
ANCHORS = [(0, 0), (20, 10), (40, 20), (60, 30), (80, 40), (95, 47), (100, 50)]
# Lower bound in tenths, label, meaning.
BANDS = [
    (45, "Excellent Match", "Strong direct experience supports nearly all core requirements; this is a highly competitive documented fit."),
    (40, "Strong Match", "The candidate aligns well overall, with only limited or realistically addressable gaps."),
    (35, "Good Match", "Worth applying, but there are meaningful weaknesses to prepare for or explain."),
    (30, "Moderate Match", "A reach based on transferable experience; tailored positioning is important."),
    (20, "Weak Match", "Several core gaps materially limit competitiveness."),
    (0, "Poor Match", "The role direction is substantially different or critical minimum requirements are not met."),
]
# Ceilings in tenths.
NOT_ELIGIBLE_CEILING, ONE_GAP, TWO_GAPS, MORE_GAPS = 15, 34, 24, 19
MINIMUM_ITEMS = 2
UNIT = 10**10


def weight(importance: Column, criticality: Column) -> Column:
    return F.when(importance == "REQUIRED", 100).otherwise(35) * F.when(criticality == "CORE", 150).otherwise(100)


def credit(status: Column, relation: Column, strength: Column) -> Column:
    """Null for an unknown; a strength of NONE doesn't lower it."""
    base = F.when(status == "STRONG_MATCH", 100).when(status == "PARTIAL_MATCH", F.when(relation == "TRANSFERABLE", 45).otherwise(55)).when(status == "GAP", 0)
    return base * F.when(strength == "MODERATE", 90).when(strength == "WEAK", 75).otherwise(100)


def ratio(num: Column, den: Column) -> Column:
    """num / den in 10^-10, HALF_UP."""
    wide = "decimal(38,0)"
    twice = (den.cast(wide) * 2).cast(wide)
    return F.call_function("div", (num.cast("decimal(20,0)") * F.lit(2 * UNIT).cast("decimal(12,0)") + den.cast(wide)).cast(wide), twice).cast("long")


def score_of(coverage: Column) -> Column:
    """Tenths, on the line between the two anchors around the coverage; 0 where there is none."""
    c = F.least(F.greatest(coverage, F.lit(0)), F.lit(UNIT))
    found = F.when(c.isNull(), 0)
    for (lo, below), (hi, above) in zip(ANCHORS, ANCHORS[1:]):
        low, width = lo * UNIT // 100, (hi - lo) * UNIT // 100
        point = F.call_function("div", 2 * ((c - low) * (above - below) + below * width) + width, F.lit(2 * width))
        found = found.when(c <= low + width, point)
    return found.cast("int")


def _band(tenths: Column, what: int) -> Column:
    found = F.when(tenths >= BANDS[0][0], BANDS[0][what])
    for band in BANDS[1:-1]:
        found = found.when(tenths >= band[0], band[what])
    return found.otherwise(BANDS[-1][what])


def label_of(tenths: Column) -> Column:
    return _band(tenths, 1)


def meaning_of(tenths: Column) -> Column:
    return _band(tenths, 2)


def tier(core_gaps: Column, required_coverage: Column, seniority: Column) -> Column:
    covered = F.coalesce(required_coverage, F.lit(0))
    return (
        F.when(core_gaps > 0, "REACH")
        .when((covered >= 90 * UNIT // 100) & (seniority >= 45), "SAFETY")
        .when(covered >= 75 * UNIT // 100, "TARGET")
        .otherwise("REACH")
    )


def confidence(high: Column, chars: Column, unknown: Column, n: Column, dropped: Column, quotes: Column) -> Column:
    """high: whether a resume warning is HIGH. unknown of n requirements; dropped of all quotes."""
    low = high | (chars < 1500) | (n == 0) | (100 * unknown > 35 * n) | (100 * dropped > 10 * quotes)
    sure = (chars >= 2500) & (100 * unknown <= 15 * n) & (dropped == 0) & (n >= 5)
    return F.when(low, "LOW").when(sure, "HIGH").otherwise("MEDIUM")


def recommendation(total: Column, core_gaps: Column, eligibility: Column, sure: Column) -> Column:
    return (
        F.when((eligibility == "NOT_ELIGIBLE") | (total < 25), "LOW_PRIORITY")
        .when((core_gaps > 0) | (sure == "LOW") | (total < 35), "CONDITIONAL")
        .when(total >= 42, "STRONG_APPLY")
        .otherwise("APPLY")
    )
