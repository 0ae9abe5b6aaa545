"""Risk of a list of findings and the verdict, folded inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis.config import Thresholds
from tamis.patterns import DEFAULT_WEIGHT, SEVERITY_WEIGHTS, THREAT_WEIGHTS


def _weight(key: Column, weights: dict[str, float]) -> Column:
    case = F
    for name, w in weights.items():
        case = case.when(key == name, w)
    return case.otherwise(DEFAULT_WEIGHT)


def probability(threat: Column, severity: Column, confidence: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _weight(threat, THREAT_WEIGHTS) * _weight(severity, SEVERITY_WEIGHTS) * F.coalesce(confidence, F.lit(1.0))))


def risk(findings: Column) -> Column:
    """1 - product of (1 - p); 0 for null and empty lists; null elements count nothing."""
    kept = F.filter(findings, lambda f: f.isNotNull())
    rest = F.aggregate(kept, F.lit(1.0), lambda s, f: s * (1 - probability(f["threat_id"], f["severity"], f["confidence"])))
    return F.coalesce(1 - rest, F.lit(0.0))


def verdict(score: Column, t: Thresholds = Thresholds()) -> Column:
    return F.when(score > t.block, "BLOCK").when(score >= t.flag, "FLAG").otherwise("ALLOW")
