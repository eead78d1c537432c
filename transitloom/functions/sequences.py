"""Array expressions on stop sequences and route paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays (one table row per element of ``a``)."""

    def next_row(row: Column, item: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            best = F.when(F.get(b, j - 1) == item, F.get(row, j - 1) + 1).otherwise(
                F.greatest(F.get(row, j), F.get(done, j - 1))
            )
            return F.concat(done, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(F.lit(0)), cell)

    start = F.array_repeat(F.lit(0), F.size(b) + 1)
    filled = F.element_at(F.aggregate(a, start, next_row), -1)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).otherwise(filled)


def overlap_ratio(a: Column, b: Column) -> Column:
    shorter = F.least(F.size(a), F.size(b))
    return F.when(shorter == 0, F.lit(0.0)).otherwise(lcs_length(a, b) / shorter)


def collapse_runs(items: Column) -> Column:
    """Drops an element that equals the one before it."""
    return F.filter(items, lambda x, i: (i == 0) | (x != F.get(items, i - 1)))


def revisits(items: Column) -> Column:
    """True when a value comes back after a different one."""
    runs = collapse_runs(items)
    return F.size(runs) != F.size(F.array_distinct(runs))
