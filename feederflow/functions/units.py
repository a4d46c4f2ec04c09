"""Constants and conversions between physical and per-unit quantities."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: bases and weights of the envelope objective
BASE_VA = 1e6
INTERVAL_H = 5 / 60
WIDTH_WEIGHT, VIOLATION_WEIGHT = 0.001, 1000.0
LINE_RATING_A, TRANSFORMER_RATING_W = 100_000.0, 1e9
ENVELOPE_CAP_KW = 50.0


def pu_of_kw(kw: Column) -> Column:
    return kw * 1e3 / BASE_VA


def pu_of_w(w: Column) -> Column:
    return w / BASE_VA


def w_of_pu(pu: Column, digits: int = 6) -> Column:
    return F.round(pu * BASE_VA, digits)


def amps(l_pu: Column, i_base: Column, digits: int = 6) -> Column:
    """Current from its per-unit square."""
    return F.round(F.sqrt(F.abs(l_pu)) * i_base, digits)


def volts_pu(v2: Column, digits: int = 6) -> Column:
    return F.round(F.sqrt(F.abs(v2)), digits)
