"""Closed-form test statistics as Column expressions.

Spark SQL has no ``erf``; the standard-normal upper tail is half the
complementary error function of z / sqrt(2), by Cody's rational approximations
on three ranges, whose *relative* error stays small far out in the tail.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of W. J. Cody's approximations (Math. Comp. 23, 1969).
_SMALL_P = (3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3, 1.85777706184603153e-1)
_SMALL_Q = (2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
_MID_P = (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2,
          1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3, 2.15311535474403846e-8)
_MID_Q = (1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3,
          4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3)
_FAR_P = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
_FAR_Q = (2.56852019228982242e0, 1.87295284992346047e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def _ratio(x: Column, p: tuple[float, ...], q: tuple[float, ...]) -> Column:
    """Cody's order: the last p leads the numerator, the denominator is monic."""
    above, below = F.lit(p[-1]) * x, x
    for a, b in zip(p[:-2], q[:-1], strict=True):
        above, below = (above + F.lit(a)) * x, (below + F.lit(b)) * x
    return (above + F.lit(p[-2])) / (below + F.lit(q[-1]))


def erfc(y: Column) -> Column:
    """1 - erf(y) for y >= 0."""
    square = y * y
    small = F.lit(1.0) - y * _ratio(square, _SMALL_P, _SMALL_Q)
    mid = F.exp(-square) * _ratio(y, _MID_P, _MID_Q)
    inverse = F.lit(1.0) / F.greatest(square, F.lit(1e-300))
    far = F.exp(-square) * (F.lit(1.0 / math.sqrt(math.pi)) - inverse * _ratio(inverse, _FAR_P, _FAR_Q)) / F.greatest(y, F.lit(1e-150))
    return F.when(y <= 0.46875, small).when(y <= 4.0, mid).otherwise(far)


def normal_upper_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0 (use |z| for a two-sided test)."""
    return F.lit(0.5) * erfc(z / F.lit(math.sqrt(2.0)))


def normal_two_sided_p(z: Column) -> Column:
    """min(1, 2 * P(Z > |z|))."""
    return F.least(F.lit(1.0), F.lit(2.0) * normal_upper_tail(F.abs(z)))


def significant(x: Column, digits: int = 10) -> Column:
    """x to so many significant digits, also when it is tiny."""
    return F.format_string(f"%.{digits - 1}e", x).cast("double")


#: The exact distribution of U is taken as the common libraries do: without ties,
#: if the smaller group has at most so many values; and while n1 n2 is at most
#: so much, from where on the normal approximation is as good.
EXACT_GROUP, EXACT_PAIRS = 8, 20_000


def exact_u_tail(u: Column, n1: Column, n2: Column) -> Column:
    """P(U >= u) of two groups without ties. Ways to draw the smaller group from
    all ranks, counted by their U: taking rank r as the j-th smallest drawn adds
    r - j, so ways[j] gains ways[j - 1] moved by r - j for each rank."""
    small, large = F.least(n1, n2).cast("int"), F.greatest(n1, n2).cast("int")
    size = small * large + 1
    zero, one = F.lit(0.0), F.array(F.lit(1.0))
    none = F.array_repeat(zero, size)
    start = F.transform(F.sequence(F.lit(0), small), lambda j: F.when(j == 0, F.slice(F.concat(one, none), F.lit(1), size)).otherwise(none))

    def take(ways: Column, rank: Column) -> Column:
        def gain(j: Column) -> Column:
            moved = F.slice(F.concat(F.array_repeat(zero, rank - j), F.get(ways, j - 1)), F.lit(1), size)
            return F.when((j == 0) | (rank < j) | (rank - j > large), F.get(ways, j)).otherwise(F.zip_with(F.get(ways, j), moved, lambda a, b: a + b))

        return F.transform(F.sequence(F.lit(0), small), gain)

    ways = F.get(F.aggregate(F.sequence(F.lit(1), small + large), start, take), small)
    add = lambda a, b: a + b
    at_least = F.slice(ways, F.ceil(u).cast("int") + 1, size)
    return F.aggregate(at_least, zero, add) / F.aggregate(ways, zero, add)
