"""Row-level column helpers with missing-value rules made explicit.

Null is the only missing value inside the engine: NaN and infinities are
turned into null once (``finite``) and division by zero yields null (``div``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a: Column | str, b: Column | str) -> Column:
    """a / b as double, null where b is 0 (ANSI mode would raise)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clip(x: Column | str, lo: float | None, hi: float | None) -> Column:
    """Clamp that keeps null (``least``/``greatest`` alone would turn it into a bound)."""
    x = col(x)
    y = x if lo is None else F.greatest(x, F.lit(lo))
    y = y if hi is None else F.least(y, F.lit(hi))
    return F.when(x.isNotNull(), y)


def finite(x: Column | str) -> Column:
    """NaN and infinities to null."""
    x = col(x)
    inf = float("inf")
    return F.when(~F.isnan(x) & (x != inf) & (x != -inf), x)


def zero_to_null(x: Column | str) -> Column:
    return F.nullif(col(x).cast("double"), F.lit(0.0))


def flag(cond: Column) -> Column:
    """Predicate to 0/1 where an unknown comparison counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def is_true(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def symmetric_growth(now: Column, before: Column, eps: float = 1e-6) -> Column:
    """Change relative to the mean magnitude of both ends (finite for sign changes)."""
    return div(now - before, F.lit(0.5) * (F.abs(now) + F.abs(before)) + F.lit(eps))


def prefix_key(code: Column | str, n: int = 4) -> Column:
    return F.substring(col(code), 1, n)


def sanitize(df: DataFrame, names: list[str], dtype: str = "float") -> DataFrame:
    """One projection: non-finite to null and narrow type for the named columns."""
    return df.withColumns({c: finite(c).cast(dtype) for c in names})


def ordered_columns(names: list[str]) -> list[str]:
    """Drop repeated names, keep first positions."""
    return list(dict.fromkeys(names))


def snap(x: Column | str, digits: int = 6) -> Column:
    """Nearest multiple of 10^-digits, with the cut slightly off the half.

    Values that sit exactly on a half (prices with few decimals do) would
    otherwise fall either way depending on summation order.
    """
    scale = float(10 ** digits)
    return F.floor(col(x).cast("double") * F.lit(scale) + F.lit(0.4971)).cast("double") / F.lit(scale)


def rounded(df: DataFrame, digits: dict[str, int] | int = 6) -> DataFrame:
    """Snap double/float columns (reports and comparisons)."""
    out = {}
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            d = digits if isinstance(digits, int) else digits.get(f.name, 6)
            out[f.name] = snap(f.name, d)
    return df.withColumns(out) if out else df


# Coefficients of the inverse normal distribution, Wichura (1988),
# Algorithm AS 241 (PPND16).
PPND_A = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
          1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
          3.3430575583588128105e4, 2.5090809287301226727e3)
PPND_B = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
          2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
          5.2264952788528545610e3)
PPND_C = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
          3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
          2.27238449892691845833e-2, 7.74545014278341407640e-4)
PPND_D = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
          1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
          1.05075007164441684324e-9)
PPND_E = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
          2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
          2.71155556874348757815e-5, 2.01033439929228813265e-7)
PPND_F = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
          7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
          2.04426310338993978564e-15)


def _horner(coeffs: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), reversed(coeffs[:-1]), F.lit(coeffs[-1]))


def probit(p: Column | str) -> Column:
    """Inverse standard normal distribution function for 0 < p < 1, about 1e-16 accurate.

    ``p`` is referenced many times: pass a materialised column, not a large expression.
    """
    p = col(p)
    q = p - F.lit(0.5)
    central = F.lit(0.180625) - q * q
    r = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    near, far = r - F.lit(1.6), r - F.lit(5.0)
    tail = F.when(r <= 5.0, _horner(PPND_C, near) / _horner(PPND_D, near)).otherwise(
        _horner(PPND_E, far) / _horner(PPND_F, far))
    value = F.when(F.abs(q) <= 0.425, q * _horner(PPND_A, central) / _horner(PPND_B, central)).otherwise(
        F.signum(q) * tail)
    return F.when(p.isNotNull() & (p > 0.0) & (p < 1.0), value)


def erfinv(x: Column | str) -> Column:
    """Inverse error function: probit((x+1)/2) / sqrt(2)."""
    return probit((col(x) + F.lit(1.0)) / F.lit(2.0)) / F.lit(2.0 ** 0.5)
