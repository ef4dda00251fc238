"""Scalar scores as Columns: freshness, authority, quality, status bands and calculators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Authority of a class of sources, 0 to 100.
CLASS_AUTHORITY = {"government": 100, "international_organization": 96, "standard_body": 95, "registry": 94, "research": 90, "industry": 80, "customer": 70, "news": 60, "other": 45}
#: Verification score of a document's status.
STATUS_SCORE = {"verified": 1.0, "published": 0.9, "pending_review": 0.45, "processing": 0.25, "failed": 0.0}
#: Weight of an evidence stream.
STREAM_WEIGHT = {"DOCUMENT": 1.0, "GRAPH": 0.98, "ONTOLOGY": 0.95, "INFERENCE": 0.9}


def steps(value: Column, bands: list[tuple[float, float]], rest: float) -> Column:
    """The score of the first band (upper bound, score) that value fits in."""
    (top, score), *more = bands
    found = F.when(value <= top, F.lit(score))
    for top, score in more:
        found = found.when(value <= top, F.lit(score))
    return found.otherwise(F.lit(rest))


def looked_up(key: Column, values: dict[str, float], rest: float) -> Column:
    found = reduce(lambda c, kv: c.when(key == kv[0], F.lit(float(kv[1]))), list(values.items())[1:], F.when(key == next(iter(values)), F.lit(float(next(iter(values.values()))))))
    return found.otherwise(F.lit(rest))


def rank_freshness(date: Column, as_of: str) -> Column:
    """Freshness for ranking, by age in days; a missing date counts 0.4."""
    age = F.datediff(F.lit(as_of).cast("date"), date)
    return F.when(date.isNull(), F.lit(0.4)).otherwise(steps(age, [(365, 1.0), (730, 0.9), (1095, 0.8), (1825, 0.65), (3650, 0.5)], 0.35))


def source_freshness(date: Column, as_of: str) -> Column:
    """Freshness for source quality, by years of 365.25 days; a missing date counts 0."""
    years = F.greatest(F.datediff(F.lit(as_of).cast("date"), date), F.lit(0)) / 365.25
    return F.when(date.isNull(), F.lit(0.0)).otherwise(steps(years, [(1, 1.0), (2, 0.9), (3, 0.8), (5, 0.65), (8, 0.45)], 0.25))


def authority(source_class: Column) -> Column:
    return looked_up(source_class, CLASS_AUTHORITY, 45.0)


def verification(status: Column) -> Column:
    return looked_up(status, STATUS_SCORE, 0.35)


def filled_share(*fields: Column) -> Column:
    return sum((F.when(F.coalesce(F.trim(f.cast("string")), F.lit("")) != "", 1).otherwise(0) for f in fields), F.lit(0)) / float(len(fields))


def content_quality(text: Column) -> Column:
    """Length, sentence marks and absence of one repeated character."""
    n, one = F.length(text), lambda c, v: F.when(c, v).otherwise(0.0)
    return F.when(n == 0, 0.0).otherwise(one(n >= 200, 0.25) + one(n >= 500, 0.2) + one(n <= 5000, 0.15) + one(text.rlike("[.!?]"), 0.15) + one(~text.rlike(r"(.)\1{15,}"), 0.1))


def evidence_score(similarity: Column, quality: Column, status: Column, fresh: Column, metadata: Column, content: Column) -> Column:
    return 0.38 * similarity + 0.30 * quality + 0.12 * status + 0.10 * fresh + 0.05 * metadata + 0.05 * content


def truth_status(confidence: Column, n_evidence: Column, n_conflicts: Column) -> Column:
    return (
        F.when(n_evidence == 0, "INSUFFICIENT_EVIDENCE").when(n_conflicts > 0, "CONFLICTING")
        .when(confidence >= 0.75, "SUPPORTED").when(confidence >= 0.45, "PARTIALLY_SUPPORTED").otherwise("INSUFFICIENT_EVIDENCE")
    )


def rounded(value: Column, digits: int) -> Column:
    """Half up."""
    return F.floor(value * 10**digits + 0.5) / 10**digits


def solar_credits(mwh: Column, factor: Column) -> Column:
    return mwh * factor


def methane_credits(tonnes: Column, efficiency: float = 0.9, warming: float = 28.0) -> Column:
    return tonnes * efficiency * warming


def biochar_credits(tonnes: Column, carbon: float = 0.7, permanence: float = 0.8) -> Column:
    return tonnes * carbon * 44.0 / 12.0 * permanence


def traceability(document: Column, chunk: Column, place: Column, url: Column, page: Column, section: Column) -> Column:
    """How far evidence can be traced, from whether each of its references is known."""
    weights = [(document, 0.25), (chunk, 0.25), (place, 0.15), (url, 0.15), (page, 0.1), (section, 0.1)]
    return reduce(lambda a, b: a + b, [F.when(known, w).otherwise(0.0) for known, w in weights])


def source_quality(authority_share: Column, verified: Column, fresh: Column, metadata: Column, traced: Column) -> Column:
    return 0.3 * authority_share + 0.25 * verified + 0.15 * fresh + 0.15 * metadata + 0.15 * traced


def stars(quality: Column) -> Column:
    """Five bands of source quality."""
    return F.when(quality >= 0.9, 5).when(quality >= 0.78, 4).when(quality >= 0.62, 3).when(quality >= 0.45, 2).otherwise(1)
