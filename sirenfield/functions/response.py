"""Response-time scoring expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dimensions import DISPATCH_SHARE, RESPONSE_CV, THRESHOLD_SECONDS


def erf(x: Column) -> Column:
    """Error function, Abramowitz and Stegun 7.1.26 (absolute error below 1.5e-7)."""
    a = F.abs(x)
    t = 1 / (1 + 0.3275911 * a)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    y = 1 - poly * F.exp(-(a * a))
    return F.when(x < 0, -y).otherwise(y)


def share_within(mean_seconds: Column, threshold: float = THRESHOLD_SECONDS, cv: float = RESPONSE_CV) -> Column:
    """Expected share of calls under ``threshold`` when response times are
    lognormal with the given mean and coefficient of variation."""
    sigma = math.sqrt(math.log(1 + cv * cv))
    mu = F.ln(mean_seconds) - sigma * sigma / 2
    z = (math.log(threshold) - mu) / sigma
    return F.when(mean_seconds <= 0, 1.0).otherwise(0.5 * (1 + erf(z / math.sqrt(2))))


def within_threshold(seconds: Column) -> Column:
    return (seconds <= THRESHOLD_SECONDS).cast("int")


def service_tier(seconds: Column) -> Column:
    return F.when(seconds <= 480, "good").when(seconds <= 600, "fair").otherwise("poor")


def svi_band(svi: Column) -> Column:
    """Fixed right-closed bands."""
    return F.when(svi <= 0.25, "Q1").when(svi <= 0.50, "Q2").when(svi <= 0.75, "Q3").otherwise("Q4")


def vulnerability_label(svi: Column) -> Column:
    """Left-closed display label."""
    return (
        F.when(svi >= 0.75, "Very High").when(svi >= 0.5, "High").when(svi >= 0.25, "Moderate").otherwise("Low")
    )


def dispatch_default(response: Column) -> Column:
    """Dispatch part of a zone's default response time, rounded half to even."""
    return F.bround(response * DISPATCH_SHARE).cast("int")


def dispatch_pct(dispatch: Column, total: Column) -> Column:
    return F.when(total > 0, dispatch / total * 100).otherwise(50.0)


def observed_or(seconds: Column, alternative: Column) -> Column:
    """Observed time truncated to whole seconds if it lies in 1..7200, else the alternative."""
    return F.when(seconds.between(1, 7200), seconds.cast("int")).otherwise(alternative)


def repeat_weight(demand: Column) -> Column:
    """How often a zone counts in a demand-weighted median or histogram."""
    return F.greatest(F.lit(1), F.bround(demand).cast("int"))
