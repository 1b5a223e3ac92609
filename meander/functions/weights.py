"""Weights of second-order steps as integers and as the acceptance ratios of rejection sampling.

prev is t, cur is v, a candidate is x; a weight depends on whether x is t, is a neighbour of t too, or neither.
"""

from __future__ import annotations

from fractions import Fraction
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 1 << 20


class Classes(NamedTuple):
    """Integer weights of the return vertex, of one common neighbour and of one other neighbour."""

    back: Column
    common: Column
    other: Column


def node2vec(p: Fraction | float, q: Fraction | float) -> Classes:
    """1/p, 1, 1/q times the least integer that makes them whole."""
    p, q = Fraction(p).limit_denominator(10_000), Fraction(q).limit_denominator(10_000)
    a, b, c, d = p.numerator, p.denominator, q.numerator, q.denominator
    return Classes(*(F.lit(w).cast("bigint") for w in (b * c, a * c, d * a)))


def autoregressive(alpha: Fraction | float, deg_prev: Column, deg_cur: Column) -> Classes:
    """(1-alpha)/deg(v), and alpha/deg(t) more for a common neighbour."""
    x = Fraction(alpha).limit_denominator(10_000)
    base = (x.denominator - x.numerator) * deg_prev
    return Classes(base, base + x.numerator * deg_cur, base)


def similarity(common: Column, deg_prev: Column, deg_next: Column) -> Column:
    """c / (2 + deg(t) + deg(x) - c) in units of 1/SCALE; c: vertices that t and x both have as neighbours."""
    return F.floor((common * F.lit(SCALE)).cast("bigint") / (2 + deg_prev + deg_next - common)).cast("bigint")


def node2vec_acceptance(p: float, q: float, back: Column, common: Column) -> Column:
    """Weight times min(1, p, q)."""
    return F.when(back, 1 / p).when(common, 1.0).otherwise(1 / q) * min(1.0, p, q)


def autoregressive_acceptance(alpha: float, deg_prev: Column, deg_cur: Column, common: Column) -> Column:
    """Weight over its largest value."""
    weight = (1 - alpha) / deg_cur + F.when(common, alpha / deg_prev).otherwise(0.0)
    return weight / ((1 - alpha) / deg_cur + alpha / deg_prev)
