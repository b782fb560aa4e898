"""The normal distribution in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published rational approximations. Lists begin with the constant term.
#: Wichura's AS 241 (PPND16): numerator and denominator near the middle, in the shoulders, and in the tails.
MIDDLE = ([3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
          [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3])
SHOULDER = ([1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
            [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9])
TAIL = ([6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
        [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15])
#: The complementary error function by a Chebyshev fit, relative error under 1.2e-7.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def _polynomial(x: Column, terms: list[float]) -> Column:
    out = F.lit(terms[-1])
    for t in reversed(terms[:-1]):
        out = out * x + F.lit(t)
    return out


def _ratio(x: Column, terms: tuple[list[float], list[float]]) -> Column:
    return _polynomial(x, terms[0]) / _polynomial(x, terms[1])


def quantile(p: Column) -> Column:
    """The standard normal quantile; infinite at 0 and 1, null beyond."""
    p = p.cast("double")
    q = p - 0.5
    far = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.when(far <= 5, _ratio(far - 1.6, SHOULDER)).otherwise(_ratio(far - 5, TAIL))
    inner = q * _ratio(F.lit(0.180625) - q * q, MIDDLE)
    found = F.when(F.abs(q) <= 0.425, inner).otherwise(F.signum(q) * tail)
    return F.when((p > 0) & (p < 1), found).when(p == 0, F.lit(float("-inf"))).when(p == 1, F.lit(float("inf")))


def distribution(x: Column) -> Column:
    """The standard normal distribution function."""
    z = F.abs(x.cast("double")) / (2**0.5)
    t = 1 / (1 + 0.5 * z)
    half = 0.5 * t * F.exp(-z * z + _polynomial(t, ERFC))
    return F.when(x >= 0, 1 - half).otherwise(half)
