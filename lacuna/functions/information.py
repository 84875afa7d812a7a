"""Entropies and the uncertainty coefficient of two concepts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plogp(part: Column, total: Column) -> Column:
    """-p ln p for p = part/total; 0 unless p is positive (an impossible cell adds nothing)."""
    p = part / total
    return F.when(part > 0, -p * F.ln(p)).otherwise(F.lit(0.0))


def entropy(o: Column, total: Column) -> Column:
    return plogp(o, total) + plogp(total - o, total)


def joint_entropy(o_i: Column, o_j: Column, n_ij: Column, total: Column) -> Column:
    """Four cells; the last one is total - o_i - o_j, as the method is defined."""
    return plogp(n_ij, total) + plogp(o_j - n_ij, total) + plogp(o_i - n_ij, total) + plogp(total - o_j - o_i, total)


def uncertainty(o_i: Column, o_j: Column, n_ij: Column, total: Column) -> Column:
    """(H(i) + H(j) - H(i, j)) over the mean of H(i) and H(j); 0 if both are 0."""
    both = entropy(o_i, total) + entropy(o_j, total)
    return F.when(both != 0, (both - joint_entropy(o_i, o_j, n_ij, total)) / (0.5 * both)).otherwise(F.lit(0.0))
