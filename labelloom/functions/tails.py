"""Two-sided tail chances of the normal and of Student's distribution, as expressions.

With s = sin(a) ** 2, the chance that |T| exceeds t at df degrees of freedom is the mean of (1 + t * t / (df * s)) **
(-df / 2) over angles a from 0 to a right angle, and exp(-z * z / (2 * s)) gives the normal one. The integrand is
smooth once angles are spaced by a cosine, so the midpoint rule over POINTS of them gives some nine digits, deep in the
tail too, and five where t or z is below a hundredth and the chance about 1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom.functions.text import col

POINTS = 128


def _points() -> list[tuple[float, float]]:
    """(weight, sine squared) of each angle."""
    out = []
    for k in range(POINTS):
        u = (k + 0.5) / POINTS * math.pi / 2
        out.append((math.sin(u) * math.pi / 2 / POINTS, math.sin(math.pi / 2 * (1 - math.cos(u))) ** 2))
    return out


def _mean(f) -> Column:
    points = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(s).alias("s")) for w, s in _points()))
    return F.least(F.lit(1.0), F.aggregate(points, F.lit(0.0), lambda sum_, x: sum_ + x["w"] * f(x["s"])))


def normal_tail(z: str | Column) -> Column:
    """The chance that a normal deviate is at least as far from 0 as z; null and NaN stay."""
    z = col(z).cast("double")
    return F.when(F.isnan(z), z).when(z.isNotNull(), _mean(lambda s: F.exp(-z * z / (s * 2))))


def student_tail(t: str | Column, df: str | Column) -> Column:
    """The chance that |T| is at least |t| at df degrees of freedom; null without both, or at df of 0 and below."""
    t, df = col(t).cast("double"), col(df).cast("double")
    return F.when(F.isnan(t), t).when(t.isNotNull() & (df > 0), _mean(lambda s: F.exp(F.log1p(t * t / (df * s)) * (-df / 2))))


#: The same for a SQL oracle: a list of points and the sums over it.
POINTS_SQL = f"list_transform(range({POINTS}), lambda k: {{'w': sin((k + 0.5) / {POINTS} * pi() / 2) * pi() / 2 / {POINTS}, 's': power(sin(pi() / 2 * (1 - cos((k + 0.5) / {POINTS} * pi() / 2))), 2)}})"


def normal_tail_sql(z: str) -> str:
    return f"least(1.0, list_sum(list_transform({POINTS_SQL}, lambda x: x.w * exp(-power({z}, 2) / (2 * x.s)))))"


def student_tail_sql(t: str, df: str) -> str:
    return f"least(1.0, list_sum(list_transform({POINTS_SQL}, lambda x: x.w * exp(ln(1 + power({t}, 2) / ({df} * x.s)) * (-({df}) / 2)))))"
