"""Numeric expressions: exact differences, percentages, tolerances, size estimates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom import scope

EXACT = "decimal(30,8)"


def runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of rows whose sizes add up to ``limit`` at most; a larger row is a run of its own."""
    total = np.append(0, np.cumsum(sizes, dtype=np.int64))
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        yield at, end
        at = end


def exact_delta(later: Column, earlier: Column) -> Column:
    """Difference of two decimal quantities, free of binary-float residue."""
    return (later.cast(EXACT) - earlier.cast(EXACT)).cast("double")


def rounded(value: Column, decimals: int) -> Column:
    """Rounded as SQL engines round doubles: the scaled double, halves away from zero."""
    scale = F.lit(float(10**decimals))
    return F.round(value * scale) / scale


def percent_change(later: Column, earlier: Column) -> Column:
    """Change in percent of |earlier|, two decimals; NULL when earlier is zero."""
    delta = exact_delta(later, earlier)
    share = F.try_divide(delta, F.abs(earlier)) * F.lit(100.0)
    return F.round(share, scope.PERCENT_DECIMALS)


def within(got: Column, want: Column, relative: Column | float, absolute: Column | float = 0.0) -> Column:
    relative = relative if isinstance(relative, Column) else F.lit(float(relative))
    absolute = absolute if isinstance(absolute, Column) else F.lit(float(absolute))
    allowed = F.greatest(relative * F.greatest(F.abs(want), F.lit(1.0)), absolute)
    return F.abs(got - want) <= allowed


def estimated_tokens(n_chars: Column) -> Column:
    return F.floor(n_chars / F.lit(scope.CHARS_PER_TOKEN)).cast("int")


def annual_band(period_start: Column, period_end: Column) -> Column:
    """Instants always pass; durations must span about one year."""
    days = F.datediff(period_end, period_start)
    return period_start.isNull() | days.between(scope.ANNUAL_MIN_DAYS, scope.ANNUAL_MAX_DAYS)
