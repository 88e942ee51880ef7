"""Check digits of trade-item codes, location codes and tax ids, as pure column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed: weights and prefix range of the published check-digit rules.
MOD10_WEIGHTS = (1, 3) * 6
INN10_WEIGHTS = (2, 4, 10, 3, 5, 9, 4, 6, 8)
EAEU_PREFIXES = (460, 469)


def _weighted_sum(code: Column, weights: Sequence[int]) -> Column:
    total = F.lit(0)
    for position, weight in enumerate(weights, start=1):
        total = total + F.substring(code, position, 1).cast("int") * weight
    return total


def _digits(code: Column, length: int) -> Column:
    return F.coalesce(code.rlike(rf"^[0-9]{{{length}}}\z"), F.lit(False))


def _mod10_ok(code: Column) -> Column:
    check = (10 - _weighted_sum(code, MOD10_WEIGHTS) % 10) % 10
    return F.when(_digits(code, 13), check == F.substring(code, 13, 1).cast("int")).otherwise(False)


def valid_gtin13(code: Column) -> Column:
    """13 digits with a correct last digit."""
    return _mod10_ok(code)


def eaeu_prefix(code: Column) -> Column:
    return F.coalesce(F.substring(code, 1, 3).try_cast("int").between(*EAEU_PREFIXES), F.lit(False))


def valid_gln13(code: Column) -> Column:
    """Location code: the trade-item rule without a prefix rule."""
    return _mod10_ok(code)


def valid_inn10(code: Column) -> Column:
    """10-digit tax id: weighted sum, modulo 11, modulo 10."""
    check = _weighted_sum(code, INN10_WEIGHTS) % 11 % 10
    return F.when(_digits(code, 10), check == F.substring(code, 10, 1).cast("int")).otherwise(False)
