"""Predicates that turn measured statistics into decisions stated beforehand; columns in, booleans out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, equal to those of the definitions.
LEAST_COVERAGE = 0.40
CLOSED_FORM_GAP = 1e-9
NULL_FACTOR = 1.25
MOVE_FACTOR = 2.0
TOP_OVER_MEDIAN = 1.5
LARGEST_P = 1e-3
LEAST_GAIN = 0.01
LEAST_POWER = 0.8
LARGEST_PLANTED_RMS = 0.29
UNIFORMITY_P = 0.01
LARGEST_R_HAT = 1.05
MOST_BENCHES = 4
MOST_SIZES = 4


def covered(coverage: Column) -> Column:
    """Lineage is known for enough models."""
    return coverage >= LEAST_COVERAGE


def closed_form_holds(naive: Column, forced: Column) -> Column:
    """The excess over independence is what the margins force."""
    return F.abs(naive - forced) < CLOSED_FORM_GAP


def differs(a: Column, b: Column) -> Column:
    """Two nulls are apart by the factor, in either direction."""
    return F.greatest(a / b, b / a) >= NULL_FACTOR


def duplication_driven(move_factor: Column) -> Column:
    return move_factor > MOVE_FACTOR


def redundancy_rises(spearman: Column, top: Column, median: Column) -> Column:
    """Accurate entities are the more redundant ones."""
    return (spearman > 0) & (top > median)


def survives_dedup(top_over_median: Column) -> Column:
    return F.coalesce(top_over_median >= TOP_OVER_MEDIAN, F.lit(False))


def adds_information(p: float, gain: float) -> bool:
    return bool(p < LARGEST_P and gain >= LEAST_GAIN)


def interval_positive(low: Column) -> Column:
    return low > 0


def interval_has_zero(low: Column, high: Column) -> Column:
    """A slope whose interval includes 0 is no trend."""
    return (low <= 0) & (high >= 0)


def usable(power: Column, planted_rms: Column) -> Column:
    """Enough power at a planted structure of realistic size."""
    return (power >= LEAST_POWER) & (planted_rms <= LARGEST_PLANTED_RMS)


def uniform(p: Column) -> Column:
    """Uniformity of the sampler is not rejected."""
    return p >= UNIFORMITY_P


def mixed(r_hat: Column) -> Column:
    return r_hat <= LARGEST_R_HAT


def fires_below(passed: Column, least: int = MOST_BENCHES) -> Column:
    """A claim is dropped if fewer than `least` of its parts pass.  passed: boolean, over the rows of a group."""
    return F.count_if(passed) < least


def fires_by_majority(passed: Column) -> Column:
    """A claim is dropped unless more than half of its parts pass."""
    return F.count_if(passed) <= F.floor(F.count(F.lit(1)) / 2)
