"""Distribution tail probabilities as column expressions (F9, E15 p-values).

Spark SQL has no ``erf``; these are closed-form approximations built from
``exp`` / ``sqrt`` so that they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chebyshev fit of erfc (Numerical Recipes ``erfcc``), fractional error < 1.2e-7.
ERFC_COEFS = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
              0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def erfc(x: Column) -> Column:
    z = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * z)
    poly = F.lit(ERFC_COEFS[-1])
    for c in reversed(ERFC_COEFS[:-1]):
        poly = F.lit(c) + t * poly
    ans = t * F.exp(-z * z + poly)
    return F.when(x >= 0, ans).otherwise(F.lit(2.0) - ans)


def normal_two_sided_p(z: Column) -> Column:
    """2 * P(Z > |z|) for a standard normal Z."""
    return erfc(F.abs(z) / F.lit(2.0 ** 0.5))


def kolmogorov_p(d: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic two-sample KS p-value: Q_KS(lambda), lambda = (sqrt(ne) + 0.12 +
    0.11 / sqrt(ne)) * D, ne = n1 n2 / (n1 + n2); Q clipped to [0, 1]."""
    # An empty sample makes ne null, and with it the p-value.
    en = F.sqrt(F.nullif(F.try_divide(n1 * n2, n1 + n2), F.lit(0.0)))
    lam = (en + F.lit(0.12) + F.lit(0.11) / en) * d
    ks = F.sequence(F.lit(1), F.lit(terms))
    series = F.aggregate(
        ks, F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        * F.exp(F.lit(-2.0) * k * k * lam * lam))
    q = F.lit(2.0) * series
    return F.when(lam.isNull(), F.lit(None).cast("double")).when(lam < 1e-3, F.lit(1.0)).otherwise(F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0)))
