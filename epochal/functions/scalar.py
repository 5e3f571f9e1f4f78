"""Functions of one row, as Columns of built-in functions alone.

Comparisons allow EPS2, membership EPS1. Values outside a function's domain give null.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerances: the square root of the machine epsilon, and a thousand of them.
EPS1, EPS2 = 2.0**-26, 1000 * 2.0**-52


def _c(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).when(~c, 0.0)


# arithmetic


def divide(a, b) -> Column:
    """a / b, where 0 / b is 0 for every b; null for other divisions by 0."""
    a, b = _c(a), _c(b)
    return F.when(a == 0, 0.0).when(b != 0, a / b)


def power(a, b) -> Column:
    """a ^ b: 0 for a = 0 (also 0 ^ 0); a negative base takes the floor of b."""
    a, b = _c(a), _c(b)
    return F.when(F.abs(a) <= EPS2, 0.0).when(a < 0, F.pow(a, F.floor(b).cast("double"))).otherwise(F.pow(a, b))


def remainder(a, b) -> Column:
    """a % b of whole numbers with the sign of a; null otherwise."""
    a, b = _c(a), _c(b)
    whole = (a == F.floor(a)) & (b == F.floor(b)) & (b != 0)
    return F.when(whole, F.try_mod(a, b))


def log(x) -> Column:
    x = _c(x)
    return F.when(x > 0, F.log(x))


def rounded(x) -> Column:
    """To a whole number, halves away from zero."""
    x = _c(x)
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(-F.floor(-x + 0.5)).cast("double")


def truncated(x, low, high) -> Column:
    """x held in [low, high]; null if low > high."""
    x, low, high = _c(x), _c(low), _c(high)
    return F.when(low <= high, F.least(F.greatest(x, low), high))


def logistic(x) -> Column:
    x = _c(x)
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


# logic and comparison; results are 1 and 0


def not_(x) -> Column:
    return _flag(F.abs(_c(x)) <= EPS2)


def and_(a, b) -> Column:
    return _flag((F.abs(_c(a)) > EPS2) & (F.abs(_c(b)) > EPS2))


def or_(a, b) -> Column:
    return _flag((F.abs(_c(a)) > EPS2) | (F.abs(_c(b)) > EPS2))


def eq(a, b) -> Column:
    return _flag(F.abs(_c(a) - _c(b)) <= EPS2)


def ne(a, b) -> Column:
    return _flag(F.abs(_c(a) - _c(b)) > EPS2)


def lt(a, b) -> Column:
    return _flag(_c(a) + EPS2 < _c(b))


def le(a, b) -> Column:
    return _flag(_c(a) <= _c(b) + EPS2)


def gt(a, b) -> Column:
    return _flag(_c(a) > _c(b) + EPS2)


def ge(a, b) -> Column:
    return _flag(_c(a) + EPS2 >= _c(b))


def choose(condition, then, otherwise) -> Column:
    """then where condition isn't 0."""
    return F.when(F.abs(_c(condition)) > EPS2, _c(then)).otherwise(_c(otherwise))


def dummy(x, values: Sequence[float] = (), ranges: Sequence[tuple[float | None, float | None]] = ()) -> Column:
    """1 if x is one of values or in one of the closed ranges (None: open), else 0."""
    x, hit = _c(x), F.lit(False)
    for v in values:
        hit = hit | (F.abs(x - float(v)) <= EPS1)
    for low, high in ranges:
        hit = hit | ((F.lit(True) if low is None else x >= low - EPS1) & (F.lit(True) if high is None else x <= high + EPS1))
    return _flag(hit)


def recoded(x, mapping: dict[float, float], default: Column | float | None = None) -> Column:
    """x through mapping; default (else x itself) where it has none."""
    x = _c(x)
    out = x if default is None else _c(default)
    for old, new in reversed(list(mapping.items())):
        out = F.when(F.abs(x - float(old)) <= EPS1, float(new)).otherwise(out)
    return out


# special functions that built-in ones can express

#: Lanczos' coefficients for g = 7; fixed values.
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_gamma(x) -> Column:
    """ln of the gamma function of x > 0."""
    x = _c(x)

    def direct(x: Column) -> Column:
        z = x - 1
        series = F.lit(_LANCZOS[0])
        for k, c in enumerate(_LANCZOS[1:], 1):
            series = series + c / (z + k)
        t = z + 7.5
        return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(series)

    return F.when(x >= 0.5, direct(x)).when(x > 0, direct(x + 1) - F.log(x))


def digamma(x) -> Column:
    """The derivative of ln gamma at x > 0: shifted upwards, then by its asymptotic series."""
    x = _c(x)
    shift = sum((1 / (x + k) for k in range(1, 8)), 1 / x)
    y = 1 / (x + 8)
    y2 = y * y
    return F.when(x > 0, F.log(x + 8) - y / 2 - y2 * (1 / 12 - y2 * (1 / 120 - y2 * (1 / 252 - y2 / 240))) - shift)


def trigamma(x) -> Column:
    x = _c(x)
    shift = sum((1 / ((x + k) * (x + k)) for k in range(1, 8)), 1 / (x * x))
    y = 1 / (x + 8)
    y2 = y * y
    return F.when(x > 0, y + y2 / 2 + y * y2 * (1 / 6 - y2 * (1 / 30 - y2 * (1 / 42 - y2 / 30))) + shift)


def binomial(n, k) -> Column:
    """n over k, a product for whole k from 0."""
    n, k = _c(n), _c(k)
    product = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1.0)).cast("int")), F.lit(1.0), lambda s, i: s * (n - k + i) / i)
    return F.when((k < 0) | (k > n), 0.0).when(k < 1, 1.0).otherwise(F.round(product))


def log_poisson(rate, k) -> Column:
    rate, k = _c(rate), _c(k)
    return F.when((rate > 0) & (k >= 0), k * F.log(rate) - rate - log_gamma(k + 1))


def log_negative_binomial(mean, shape, k) -> Column:
    """ln of the density of counts with that mean and variance mean + mean^2 / shape."""
    m, s, k = _c(mean), _c(shape), _c(k)
    return F.when((m > 0) & (s > 0) & (k >= 0), log_gamma(k + s) - log_gamma(s) - log_gamma(k + 1) + s * F.log(s / (s + m)) + k * F.log(m / (s + m)))


def normal_density(x) -> Column:
    x = _c(x)
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def great_circle(lon1, lat1, lon2, lat2) -> Column:
    """Degrees of arc between two places given in degrees."""
    a, b, c, d = (F.radians(_c(v)) for v in (lon1, lat1, lon2, lat2))
    h = F.pow(F.sin((d - b) / 2), F.lit(2.0)) + F.cos(b) * F.cos(d) * F.pow(F.sin((c - a) / 2), F.lit(2.0))
    return F.degrees(2 * F.asin(F.sqrt(F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0)))))


# dates: Julian day numbers

_EPOCH = 2440588  # of 1970-01-01


def julian(year, month, day) -> Column:
    """Null where there is no such day."""
    date = F.try_to_date(F.format_string("%04d-%02d-%02d", *[_c(v).cast("int") for v in (year, month, day)]), "yyyy-MM-dd")
    return julian_of(date)


def julian_of(date) -> Column:
    return F.datediff(_c(date), F.lit("1970-01-01").cast("date")) + _EPOCH


def date_of(day) -> Column:
    return F.date_from_unix_date((_c(day) - _EPOCH).cast("int"))


def julian_year(day) -> Column:
    return F.year(date_of(day))


def julian_month(day) -> Column:
    return F.month(date_of(day))


def julian_day(day) -> Column:
    return F.day(date_of(day))


# strings


def slice_value(text, first: int, last: int, missing: float = -1.0) -> Column:
    """The number in characters first to last; missing where there is none."""
    return F.coalesce(F.trim(F.substring(_c(text), first, last - first + 1)).try_cast("double"), F.lit(missing))


def string_value(text) -> Column:
    return F.trim(_c(text)).try_cast("double")


# arrays of states: negative ones are missing


def span(states) -> Column:
    """Number of places from the first to the last state that isn't missing; 0 without any."""
    a = _c(states)
    ok = F.transform(a, lambda x: F.coalesce(x >= 0, F.lit(False)))
    first, back = F.array_position(ok, True), F.array_position(F.reverse(ok), True)
    return F.when(first > 0, F.size(a) - first - back + 2).otherwise(0).cast("long")


def gaps(states) -> Column:
    """How many states between the first and the last one are missing."""
    a = _c(states)
    return (span(a) - F.size(F.filter(a, lambda x: x >= 0))).cast("long")


def filled(states, most: int) -> Column:
    """Runs of up to most missing states between two equal ones take their value."""
    a = _c(states)
    n = F.size(a)

    def near(i: Column, back: bool) -> Column:
        """Place of the nearest state that isn't missing before (or from) i, -1 if there is none within reach."""
        steps = F.sequence(F.lit(1), F.lit(most))
        place = lambda k: i - k if back else i + k
        hits = F.filter(steps, lambda k: F.coalesce(F.get(a, place(k)) >= 0, F.lit(False)))
        return F.when(F.size(hits) > 0, place(F.array_min(hits))).otherwise(-1)

    def one(x: Column, i: Column) -> Column:
        left, right = near(i, True), near(i, False)
        ok = (F.coalesce(x, F.lit(-1)) < 0) & (left >= 0) & (right >= 0) & (right < n) & (right - left - 1 <= most) & (F.get(a, left) == F.get(a, right))
        return F.when(ok, F.get(a, left)).otherwise(x)

    return F.transform(a, one)
