"""The normal distribution's tail as a column expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# W. J. Cody's rational Chebyshev approximations of erf and erfc (Math. Comp. 23, 1969), numerators and denominators from the highest power.
ERF = ([1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3],
       [1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3])
MIDDLE = ([2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3],
          [1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3])
FAR = ([1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4],
       [1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3])


def _ratio(x: Column, pair: tuple[list[float], list[float]]) -> Column:
    def horner(values: list[float]) -> Column:
        out = F.lit(values[0])
        for v in values[1:]:
            out = out * x + F.lit(v)
        return out

    return horner(pair[0]) / horner(pair[1])


def erfc(x: Column) -> Column:
    """1 - erf(x) to about 1e-15 of its value, without rounding to 0 before the smallest double."""
    y = F.abs(x)
    square = F.lit(1.0) / (y * y)
    near = F.lit(1.0) - x * _ratio(y * y, ERF)
    middle = F.exp(-y * y) * _ratio(y, MIDDLE)
    far = F.exp(-y * y) / y * (F.lit(1 / math.sqrt(math.pi)) - square * _ratio(square, FAR))
    tail = F.when(y <= 4, middle).when(y < 27.5, far).otherwise(F.lit(0.0))
    return F.when(y <= 0.46875, near).when(x > 0, tail).otherwise(F.lit(2.0) - tail)


def upper_tail(z: Column) -> Column:
    """1 - Phi(z) of the standard normal distribution."""
    return F.lit(0.5) * erfc(z / F.lit(math.sqrt(2)))


def upper_tail_sql(z: str) -> str:
    """The same in SQL, from the same values."""

    def ratio(x: str, pair: tuple[list[float], list[float]]) -> str:
        def horner(values: list[float]) -> str:
            out = f"{values[0]!r}::DOUBLE"
            for v in values[1:]:
                out = f"({out} * {x} + {v!r}::DOUBLE)"
            return out

        return f"({horner(pair[0])} / {horner(pair[1])})"

    x, y = f"({z} / {math.sqrt(2)!r}::DOUBLE)", f"(abs({z}) / {math.sqrt(2)!r}::DOUBLE)"
    square, power = f"(1::DOUBLE / ({y} * {y}))", f"exp(-{y} * {y})"
    far = f"{power} / {y} * ({1 / math.sqrt(math.pi)!r}::DOUBLE - {square} * {ratio(square, FAR)})"
    tail = f"CASE WHEN {y} <= 4 THEN {power} * {ratio(y, MIDDLE)} WHEN {y} < 27.5 THEN {far} ELSE 0::DOUBLE END"
    near = f"1 - {x} * {ratio(f'({y} * {y})', ERF)}"
    return f"(0.5::DOUBLE * CASE WHEN {y} <= 0.46875 THEN {near} WHEN {x} > 0 THEN {tail} ELSE 2 - {tail} END)"
