"""Column expressions shared by the operators; all stay inside generated code."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoweave.functions import dims


def lookup(column: Column, values: Mapping[int, int], other: object = None) -> Column:
    """A constant dictionary as CASE; ``other`` for keys that it lacks."""
    out = None
    for result in sorted(set(values.values()), key=str):
        keys = [k for k, v in values.items() if v == result]
        out = (F.when if out is None else out.when)(column.isin(keys), F.lit(result))
    return out.otherwise(F.lit(other))


def at_code(values: Mapping[int, int], code: Column) -> Column:
    """A dictionary of small non-negative codes as a constant array; 0 for codes that it lacks and for null."""
    return F.coalesce(F.get(F.array(*(F.lit(values.get(c, 0)) for c in range(max(values) + 1))), code), F.lit(0))


def to_l1(unified: Column) -> Column:
    return lookup(unified, dims.UNIFIED_TO_L1, 0)


def zone_of(unified: Column) -> Column:
    return lookup(unified, {c: z for z, classes in dims.ZONES.items() for c in classes}, 0)


def first_equal(values: Sequence[Column], target: Column, results: Sequence[object]) -> Column:
    """The result of the first value equal to ``target``."""
    out = None
    for value, result in zip(values, results):
        out = (F.when if out is None else out.when)(value == target, F.lit(result))
    return out


def direction_gradient(source: Column, target: Column) -> Column:
    """Recovery, degradation or agricultural, by the rank of the classes."""
    a, b = lookup(source, dims.RANK), lookup(target, dims.RANK)
    return F.when(b < a, "recovery").when(b > a, "degradation").otherwise("agricultural")


def direction_strict(source: Column, target: Column) -> Column:
    """As the gradient, but moves that end in (recovery) or stay among arid classes are a reshuffle."""
    a, b = lookup(source, dims.RANK), lookup(target, dims.RANK)
    steppe, arid = target.isin(*dims.STEPPE), source.isin(*dims.ARID) & target.isin(*dims.ARID)
    return F.when(b < a, F.when(steppe, "recovery").otherwise("arid reshuffle")).when(b > a, F.when(arid, "arid reshuffle").otherwise("degradation")).otherwise("agricultural")


def clamp(value: Column, low: float, high: float) -> Column:
    """The value if it is plausible, else null; NaN is null."""
    return F.when(~F.isnan(value.cast("double")) & value.between(low, high), value)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation of the rows where both are given; null below 3 rows or for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.count(a) >= 3) & (F.stddev_pop(a) >= 1e-12) & (F.stddev_pop(b) >= 1e-12), F.try_divide(F.covar_pop(a, b), spread))


def aspect_sin(degrees: Column) -> Column:
    return F.sin(F.radians(degrees))


def aspect_cos(degrees: Column) -> Column:
    return F.cos(F.radians(degrees))


class Albers:
    """Equal-area conic with two standard parallels on an ellipsoid (Snyder 1987, eq. 14-1 to 14-20, 3-12 to 3-16)."""

    def __init__(self, lat1: float = 25.0, lat2: float = 47.0, lat0: float = 0.0, lon0: float = 105.0, a: float = 6378137.0, f: float = 1 / 298.257223563):
        self.a, self.e2, self.lon0 = a, f * (2 - f), lon0
        self.e = math.sqrt(self.e2)
        p1, p2, p0 = map(math.radians, (lat1, lat2, lat0))
        m = lambda p: math.cos(p) / math.sqrt(1 - self.e2 * math.sin(p) ** 2)
        q1, q2, q0 = map(self.q, (p1, p2, p0))
        self.n = (m(p1) ** 2 - m(p2) ** 2) / (q2 - q1)
        self.c = m(p1) ** 2 + self.n * q1
        self.rho0 = a * math.sqrt(self.c - self.n * q0) / self.n
        # Coefficients of the series from authalic to geodetic latitude.
        e2 = self.e2
        self.qp = self.q(math.pi / 2)
        self.series = (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360)

    def q(self, latitude: float) -> float:
        s = math.sin(latitude)
        return (1 - self.e2) * (s / (1 - self.e2 * s * s) - math.log((1 - self.e * s) / (1 + self.e * s)) / (2 * self.e))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """(x, y) in metres from degrees."""
        s = F.sin(F.radians(lat))
        q = (s / (F.lit(1) - s * s * self.e2) - F.ln((F.lit(1) - s * self.e) / (F.lit(1) + s * self.e)) / (2 * self.e)) * (1 - self.e2)
        rho = F.sqrt(F.lit(self.c) - q * self.n) * (self.a / self.n)
        theta = F.radians(lon - self.lon0) * self.n
        return rho * F.sin(theta), F.lit(self.rho0) - rho * F.cos(theta)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(lon, lat) in degrees from metres; the latitude by the series, exact to far below a metre."""
        dy = F.lit(self.rho0) - y
        rho2 = x * x + dy * dy
        q = (F.lit(self.c) - rho2 * (self.n**2 / self.a**2)) / self.n
        beta = F.asin(q / self.qp)
        p2, p4, p6 = self.series
        lat = beta + F.sin(beta * 2) * p2 + F.sin(beta * 4) * p4 + F.sin(beta * 6) * p6
        return F.degrees(F.atan2(x, dy) / self.n) + self.lon0, F.degrees(lat)


def truncated_percent(p: Column) -> Column:
    """100 p cut to an integer 0 to 100; noise below 1e-6 doesn't move it across an integer."""
    return F.floor(F.round(F.least(F.greatest(p * 100, F.lit(0.0)), F.lit(100.0)), 6)).cast("int")


def any_prefix(column: Column, prefixes: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | column.startswith(p)
    return out


# How a feature's name tells its group, tried in this order: (kind of match, text, group).
GROUP_RULES = (
    ("prefix", "ndvi", "Vegetation productivity"),
    ("prefix", "phen", "Phenology"),
    ("prefix", "spei", "Drought (SPEI)"),
    ("prefix", "clim", "Climate extremes"),
    ("prefix", "graz", "Livestock/grazing"),
    ("within", "glw", "Livestock/grazing"),
    ("within", "livestock", "Livestock/grazing"),
    ("within", "pop", "Population"),
    ("whole", "elevation", "Terrain"),
    ("whole", "slope", "Terrain"),
    ("whole", "aspect", "Terrain"),
    ("within", "terrain", "Terrain"),
    ("within", "road", "Infrastructure"),
    ("prefix", "from_", "Prior class (autocorr.)"),
    ("prefix", "nbr", "Neighbour class (autocorr.)"),
)
_MATCH = {"prefix": Column.startswith, "within": Column.contains, "whole": Column.__eq__}


def feature_group(name: Column, rules: Sequence[tuple[str, str, str]] = GROUP_RULES, other: str = "Other") -> Column:
    """Group of a feature column: that of the first rule that its name satisfies."""
    low = F.lower(name)
    return F.coalesce(*(F.when(_MATCH[kind](low, text), group) for kind, text, group in rules), F.lit(other))


def feature_label(name: Column) -> Column:
    """A feature's name for readers: underscores as spaces, ``5y`` and ``10y`` as years."""
    return F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), r"\b(slope)(5|10)y\b", "$1 over $2 years")


def is_autocorrelated(name: Column) -> Column:
    return any_prefix(F.lower(name), ("from_", "nbr"))


#: Lanczos' approximation of the gamma function, g = 7 (fixed values).
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of numbers from 0.5 on."""
    z = x - 1
    series = sum((F.lit(c) / (z + i) for i, c in enumerate(_LANCZOS) if i), F.lit(_LANCZOS[0]))
    base = z + 7.5
    return F.lit(0.9189385332046727) + (z + 0.5) * F.log(base) - base + F.log(series)


def _beta_fraction(a: Column, b: Column, x: Column, terms: int = 200) -> Column:
    """Continued fraction of the incomplete beta function, forwards with both parts kept from zero."""
    kept = lambda v: let(v, lambda w: F.when(F.abs(w) > 1e-300, w).otherwise(F.lit(1e-300)))

    def half(s: Column, top: Column) -> Column:
        parts = F.struct((1 / kept(1 + top * s["d"])).alias("d"), kept(1 + top / s["c"]).alias("c"))
        return let(parts, lambda p: F.struct(p["c"].alias("c"), p["d"].alias("d"), (s["h"] * p["c"] * p["d"]).alias("h")))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return let(half(s, even), lambda t: half(t, odd))

    first = let(1 / kept(1 - (a + b) * x / (a + 1)), lambda d: F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h")))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda m: m.cast("double")), first, step, lambda s: s["h"])


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    """P(F > f) with d1 and d2 degrees of freedom; 1 for an f that isn't positive."""
    f, d1, d2 = (c.cast("double") for c in (f, d1, d2))

    def tail(v: Column) -> Column:
        a, b, x = v["a"], v["b"], v["x"]
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(v["rest"]))
        return let(front, lambda w: F.when(x < (a + 1) / (a + b + 2), w * _beta_fraction(a, b, x) / a).otherwise(1 - w * _beta_fraction(b, a, v["rest"]) / b))

    held = F.struct((d2 / 2).alias("a"), (d1 / 2).alias("b"), (d2 / (d2 + d1 * f)).alias("x"), (d1 * f / (d2 + d1 * f)).alias("rest"))
    return F.when(f > 0, let(held, tail)).when(f.isNotNull(), F.lit(1.0))


def centred_moments(rows: Column, width: Column | int) -> Column:
    """Matrix (array of arrays) of sums of products of centred columns; ``rows`` is an array of equally long arrays of doubles."""
    columns = F.sequence(F.lit(0), (F.lit(width) if isinstance(width, int) else width) - 1)

    def centred(r: Column) -> Column:
        means = F.transform(columns, lambda i: F.aggregate(r, F.lit(0.0), lambda s, v: s + F.get(v, i)) / F.size(r))
        return let(means, lambda m: F.transform(r, lambda v: F.zip_with(v, m, lambda x, y: x - y)))

    products = lambda c: F.transform(columns, lambda i: F.transform(columns, lambda j: F.aggregate(c, F.lit(0.0), lambda s, v: s + F.get(v, i) * F.get(v, j))))
    return let(let(rows, centred), products)


def swept(matrix: Column, at: Column) -> Column:
    """A symmetric matrix swept at one column: what is left of the others after a regression on it, its own place minus the inverse.

    A column that the ones before explain wholly has no variance left and gives nulls."""
    over = lambda v, pivot: F.when(pivot > 1e-12, v / pivot)

    def cell(v: Column, i: Column, j: Column, row: Column, pivots: Column) -> Column:
        pivot = F.get(pivots, at)
        return (
            F.when((i == at) & (j == at), -over(F.lit(1.0), pivot))
            .when((i == at) | (j == at), over(v, pivot))
            .otherwise(v - F.get(row, at) * over(F.get(pivots, j), pivot))
        )

    return let(F.get(matrix, at), lambda pivots: F.transform(matrix, lambda row, i: F.transform(row, lambda v, j: cell(v, i, j, row, pivots))))
