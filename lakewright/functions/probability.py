"""Tail probabilities as column expressions: t, chi-square and F, from the incomplete gamma and beta functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The nine coefficients of Lanczos' approximation of the gamma function for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
HALF_LOG_2PI = 0.9189385332046727
_TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0, to about 15 digits."""
    # From 1 on, so that the series has no pole near.
    series = reduce(lambda a, b: a + b, [F.lit(LANCZOS[0]), *[F.lit(c) / (x + k) for k, c in enumerate(LANCZOS[1:], 1)]])
    t = x + 7.5
    return F.lit(HALF_LOG_2PI) + (x + 0.5) * F.log(t) - t + F.log(series) - F.log(x)


def _guarded(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, F.lit(_TINY)).otherwise(x)


def _fraction(steps: Column, start: Column, term) -> Column:
    """Value of a continued fraction by steps of the modified Lentz method; ``term`` gives (numerator, denominator) of a step."""
    first = _guarded(start)
    state = F.struct(first.alias("c"), F.lit(0.0).alias("d"), first.alias("h"))

    def step(s: Column, k: Column) -> Column:
        a, b = term(k.cast("double"))
        d = 1.0 / _guarded(b + a * s["d"])
        c = _guarded(b + a / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    return F.aggregate(F.sequence(F.lit(1), steps), state, step, lambda s: s["h"])


def _steps(size: Column) -> Column:
    """Terms until the series and fractions below have settled: some hundreds, and a few times the root of the parameters."""
    return (F.lit(300) + 8 * F.sqrt(F.abs(size))).cast("int")


def beta_share(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b) for 0 <= x <= 1 and a, b > 0; null for other arguments."""
    x, a, b = x.cast("double"), a.cast("double"), b.cast("double")
    turned = x > (a + 1) / (a + b + 2)
    # On the side where the fraction converges fast.
    p, q, y = F.when(turned, b).otherwise(a), F.when(turned, a).otherwise(b), F.when(turned, 1 - x).otherwise(x)

    def term(k: Column) -> tuple[Column, Column]:
        # Partial numerators: 1 first, then one for m = 0, and two for each m from 1 on.
        m = F.floor((k - 1) / 2)
        on = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        m = F.floor((k - 2) / 2)
        between = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        return F.when(k == 1, F.lit(1.0)).when(k % 2 == 1, on).otherwise(between), F.lit(1.0)

    front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(y) + q * F.log1p(-y)) / p
    inside = front * _fraction(_steps(a + b), F.lit(0.0), term)
    value = F.when(turned, 1 - inside).otherwise(inside)
    good = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    return F.when(good & (x == 0), F.lit(0.0)).when(good & (x == 1), F.lit(1.0)).when(good, value)


def gamma_rest(a: Column, x: Column) -> Column:
    """The regularised upper incomplete gamma function Q(a, x) for a > 0 and x >= 0; null for other arguments."""
    a, x = a.cast("double"), x.cast("double")
    front = F.exp(a * F.log(x) - x - log_gamma(a))
    terms = F.sequence(F.lit(1), _steps(a + x))
    grown = F.aggregate(terms, F.struct((1 / a).alias("term"), (1 / a).alias("sum")), lambda s, k: F.struct(
        (s["term"] * x / (a + k)).alias("term"), (s["sum"] + s["term"] * x / (a + k)).alias("sum")), lambda s: s["sum"])

    def term(k: Column) -> tuple[Column, Column]:
        return F.when(k == 1, F.lit(1.0)).otherwise(-(k - 1) * (k - 1 - a)), x + 2 * k - 1 - a

    value = F.when(x < a + 1, 1 - front * grown).otherwise(front * _fraction(_steps(a + x), F.lit(0.0), term))
    good = (a > 0) & (x >= 0)
    return F.when(good & (x == 0), F.lit(1.0)).when(good, value)


def t_two_sided(t: Column, df: Column) -> Column:
    """Probability of a t statistic at least as far from 0."""
    return beta_share(df / (df + t * t), df / 2, F.lit(0.5))


def chi_square_upper(x: Column, df: Column) -> Column:
    """Probability of a chi-square statistic at least as large."""
    return gamma_rest(df / 2, x / 2)


def f_upper(f: Column, df_between: Column, df_within: Column) -> Column:
    """Probability of an F statistic at least as large."""
    return beta_share(df_within / (df_within + df_between * f), df_within / 2, df_between / 2)
