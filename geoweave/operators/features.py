"""Feature columns: nearest years, trends, anomalies, yearly statistics and the feature table."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The columns of the feature table by group, and the prefixes of the groups with many.
FEATURE_GROUPS = {
    "geometry": ("row", "col", "x", "y", "lon", "lat", "year"),
    "target": ("lulc_class", "conf_joint", "conf_l1", "conf_l2", "agreement_count"),
    "population": ("popdens",),
    "livestock": ("glw_density",),
    "terrain": ("elevation", "slope", "aspect_sin", "aspect_cos"),
    "roads": ("road_distance_km",),
}
FEATURE_PREFIXES = {"climate": "clim_", "spei": "spei", "ndvi": "ndvi_", "phenology": "phen_", "grazing": "graz_", "cropping": "cropping_", "spatial_ctx": "nbr3_"}


def nearest_year(targets: DataFrame, available: DataFrame, *keys: str) -> DataFrame:
    """(keys, target, source_year): the available year nearest to each target, ties to the earlier.

    Years are a small dimension: both sides are distinct years before they meet, and one
    minimum by (distance, year) decides; no ordering of the data itself."""
    years = available.select(*keys, F.col("year").alias("source_year")).distinct()
    wanted = targets.select(*keys, F.col("year").alias("target")).distinct()
    both = wanted.join(years, list(keys)) if keys else wanted.crossJoin(F.broadcast(years))
    return both.groupBy(*keys, "target").agg(F.min_by("source_year", F.struct(F.abs(F.col("source_year") - F.col("target")), F.col("source_year"))).alias("source_year"))


def trailing_slope(df: DataFrame, entity: str, year: str, value: str, years: int, least: int = 3, least_listed: int = 0, name: str = "slope") -> DataFrame:
    """Adds the least-squares slope over ``[year - years + 1, year]`` by entity; null below ``least`` given values,
    below ``least_listed`` rows in the window, or for a single year."""
    frame = Window.partitionBy(entity).orderBy(year).rangeBetween(-(years - 1), 0)
    slope = F.regr_slope(F.col(value), F.col(year).cast("double")).over(frame)
    enough = (F.count(value).over(frame) >= least) & (F.count("*").over(frame) >= least_listed)
    return df.withColumn(name, F.when(enough, slope))


def anomaly(df: DataFrame, entity: str, year: str, value: str, first: int, last: int, least: int = 10, name: str = "anomaly") -> DataFrame:
    """Adds value less the entity's mean over the baseline years; null below ``least`` baseline values."""
    inside = F.when(F.col(year).between(first, last), F.col(value))
    over = Window.partitionBy(entity)
    return df.withColumn(name, F.when(F.count(inside).over(over) >= least, F.col(value) - F.avg(inside).over(over)))


def yearly_statistics(monthly: DataFrame, keys: Sequence[str], value: str = "z", month: str = "month") -> DataFrame:
    """Seven statistics of monthly values by ``keys``: one aggregation with map-side partials.

    The growing season is April to September; without a value in it its mean is the annual one."""
    v = F.col(value)
    season = F.avg(F.when(F.col(month).between(4, 9), v))
    return monthly.groupBy(*keys).agg(
        F.avg(v).alias("annual_mean"), F.coalesce(season, F.avg(v)).alias("gs_mean"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.count_if(v < -1.5).alias("n_severe_drought"), F.count_if((v >= -1.5) & (v < -1.0)).alias("n_moderate_drought"), F.count_if(v > 1.5).alias("n_wet"),
    )


def clamp_table(long: DataFrame, ranges: Mapping[str, tuple[float, float]], variable: str = "variable", value: str = "value") -> DataFrame:
    """Implausible values become null, by the variable's range; variables without one are untouched."""
    v = F.col(value)
    rule = None
    for name, (low, high) in ranges.items():
        kept = F.when(~F.isnan(v.cast("double")) & v.between(low, high), v)
        rule = F.when(F.col(variable) == name, kept) if rule is None else rule.when(F.col(variable) == name, kept)
    return long.withColumn(value, v if rule is None else rule.otherwise(v))


def scale_fixed_point(value: Column, factor: float = 0.0001, nodata: int | None = None) -> Column:
    return (value if nodata is None else F.nullif(value, F.lit(nodata))) * factor


def no_data(value: Column, *codes: float, greatest: float = 3.0e38) -> Column:
    """The value, or null for the given codes, NaN, infinities and the sentinels of floats from ``greatest`` on."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < greatest) & ~v.isin(*[float(c) for c in codes] or [math.nan]), v)


def long_features(long: DataFrame, anchors: Sequence[int], *, slopes: Sequence[tuple[int, int]] = (), baseline: tuple[int, int, int] | None = None, at_state: bool = False, key: str = "pix") -> DataFrame:
    """(key, year, variable, state, slope<n>y.., anomaly): yearly layers (key, variable, year, value) at the anchor years.

    The state is the value of the layer nearest to the anchor (ties to the earlier). A slope (years,
    least listed) covers the years up to the anchor, or up to the state's year with ``at_state``; it
    needs 3 values, and that many layers of the variable in the window. The anomaly is the state less
    the mean over the ``baseline`` (first, last, least years with a value).

    One aggregation by key and variable holds all anchors, so the rows of a layer are not multiplied. Which layers exist is a
    table of variables x years, the only thing that is collected; it comes back as one row a variable."""
    listed: dict[str, list[int]] = {}
    for r in long.select("variable", "year").distinct().collect():
        listed.setdefault(r.variable, []).append(r.year)
    variables = sorted(listed)
    if not variables:
        return long.sparkSession.createDataFrame([], ", ".join([f"{key} {dict(long.dtypes)[key]}", "year int", "variable string", "state double", *(f"slope{n}y double" for n, _ in slopes), *(["anomaly double"] if baseline else [])]))
    value, year = F.col("value").cast("double"), F.col("year").cast("double")
    parts, rows, dimension = [], [], []
    for v in variables:
        nearest = {a: min(listed[v], key=lambda y: (abs(y - a), y)) for a in anchors}
        ends = {a: nearest[a] if at_state else a for a in anchors}
        dimension.append((v, *(nearest[a] for a in anchors), *(sum(ends[a] - n < y <= ends[a] for y in set(listed[v])) >= least for a in anchors for n, least in slopes)))
    names = [*(f"_source{a} int" for a in anchors), *(f"_enough{n}_{a} boolean" for a in anchors for n, _ in slopes)]
    sources = long.sparkSession.createDataFrame(dimension, ", ".join(["variable string", *names]))
    for a in anchors:
        source = F.col(f"_source{a}")
        parts.append(F.max(F.when(F.col("year") == source, value)).alias(f"_state{a}"))
        fields = [F.lit(a).alias("year"), F.col(f"_state{a}").alias("state")]
        for n, _ in slopes:
            last = source if at_state else F.lit(a)
            inside = F.when(F.col("year").between(last - n + 1, last), value)
            parts.append(F.when((F.count(inside) >= 3) & F.first(f"_enough{n}_{a}"), F.regr_slope(inside, year)).alias(f"_slope{n}_{a}"))
            fields.append(F.col(f"_slope{n}_{a}").alias(f"slope{n}y"))
        if baseline:
            fields.append(F.when(F.col("_n") >= baseline[2], F.col(f"_state{a}") - F.col("_mean")).alias("anomaly"))
        rows.append(F.struct(*fields))
    if baseline:
        inside = F.when(F.col("year").between(*baseline[:2]), value)
        parts += [F.avg(inside).alias("_mean"), F.count(inside).alias("_n")]
    made = long.join(F.broadcast(sources), "variable").groupBy(key, "variable").agg(*parts).select(key, "variable", F.inline(F.array(*rows)))
    return made.select(key, "year", "variable", *made.columns[3:])


def wide(long: DataFrame, names: Mapping[str, str], statistics: Mapping[str, str], keys: Sequence[str] = ("pix", "year")) -> DataFrame:
    """(keys, columns): one column for each variable and statistic, ``{statistic column: suffix}``; one aggregation."""
    return wide_groups(long, [(names, statistics)], keys)


def wide_groups(long: DataFrame, groups: Sequence[tuple[Mapping[str, str], Mapping[str, str]]], keys: Sequence[str] = ("pix", "year")) -> DataFrame:
    """The columns of several groups, each with its variables and statistics, by one aggregation."""
    columns = [F.max(F.when(F.col("variable") == v, F.col(c))).alias(name + suffix) for names, statistics in groups for v, name in names.items() for c, suffix in statistics.items()]
    return long.groupBy(*keys).agg(*columns)


def previous_target(map_: DataFrame, step: int = 5) -> DataFrame:
    """(pix, year, lulc_class_prev, lulc_change_flag): the class of the anchor before, and whether it changed (null where either is 0)."""
    before = map_.select("pix", (F.col("year") + step).alias("year"), F.col("class").alias("lulc_class_prev"))
    joined = map_.select("pix", "year", "class").join(before, ["pix", "year"])
    flag = F.when((F.col("class") > 0) & (F.col("lulc_class_prev") > 0), (F.col("class") != F.col("lulc_class_prev")).cast("int"))
    return joined.select("pix", "year", "lulc_class_prev", flag.alias("lulc_change_flag"))


def neighbour_columns(fractions: DataFrame, classes: Sequence[int], cells: int = 9, keys: Sequence[str] = ("r", "c")) -> DataFrame:
    """(keys, nbr3_class<k>_frac..) from the counts of :func:`grid.class_fractions`; 0 for classes that aren't there."""
    share = lambda k: F.coalesce(F.max(F.when(F.col("class") == k, F.col("n"))), F.lit(0)) / F.lit(float(cells))
    return fractions.groupBy(*keys).agg(*(share(k).alias(f"nbr3_class{k}_frac") for k in classes))


def assembled(cells: DataFrame, groups: Sequence[DataFrame], keys: Sequence[str] = ("pix", "year")) -> DataFrame:
    """Cells with the columns of every group, as :func:`feature_table` gives them, by one shuffle instead of a join for each group.

    Every row of a group becomes a short row (keys, group, its values as one struct), a group without the year one for each year of the
    cells' (few) years. One aggregation brings the rows of a cell together. Groups have at most one row for a key; rows of no cell go."""
    first, later = keys[0], keys[1:]
    years = cells.select(*later).distinct()
    columns = [[c for c in d.columns if c not in keys] for d in (cells, *groups)]
    long = None
    for i, d in enumerate((cells, *groups)):
        missing = [k for k in later if k not in d.columns]
        held = d.join(F.broadcast(years.select(*missing).distinct()), how="cross") if missing else d  # years are a small dimension
        parts = [F.struct(*(F.col(f"`{c}`") for c in columns[j])) if j == i else F.lit(None) for j in range(len(columns))]
        one = held.select(*keys, *(p.alias(f"_{j}") for j, p in enumerate(parts) if j == i))
        long = one if long is None else long.unionByName(one, allowMissingColumns=True)
    by = long.groupBy(*keys).agg(*(F.first(f"_{j}", ignorenulls=True).alias(f"_{j}") for j in range(len(columns))))
    return by.where("_0 IS NOT NULL").select(*keys, *(F.col(f"_{j}.`{c}`").alias(c) for j, names in enumerate(columns) for c in names))


def feature_table(cells: DataFrame, groups: Sequence[DataFrame], keys: Sequence[str] = ("pix", "year")) -> DataFrame:
    """Cells with the columns of every group that has rows for them; a missing group's columns are null."""
    out = cells
    for g in groups:
        out = out.join(g, [k for k in keys if k in g.columns], "left")
    return out


def given(df: DataFrame) -> DataFrame:
    """(column, n_given): how many rows have a value, for every column; one aggregation."""
    counts = df.agg(*(F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(df.columns)))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("n_given")) for i, c in enumerate(df.columns)))))


def feature_metadata(df: DataFrame, counted: bool = False) -> DataFrame:
    """(column, type, group) of a feature table, from its schema; with ``counted`` also how many rows have a value (n_given)."""
    rows = []
    for name, kind in df.dtypes:
        group = next((g for g, names in FEATURE_GROUPS.items() if name in names), None)
        if group is None and ("lulc_" in name and "prev" in name or name == "lulc_change_flag"):
            group = "prev_target"
        rows.append((name, kind, group or next((g for g, p in FEATURE_PREFIXES.items() if name.startswith(p)), "other")))
    named = df.sparkSession.createDataFrame(rows, "column string, type string, group string")
    return named.join(given(df), "column") if counted else named


def split_features(df: DataFrame, target: str, drop: Sequence[str] = (), prefixes: Sequence[str] = ()) -> tuple[list[str], str]:
    """(names of the feature columns, the target): all columns but the target, those named, and those of a prefix."""
    return [c for c in df.columns if c != target and c not in drop and not any(c.startswith(p) for p in prefixes)], target


def union_years(parts: Sequence[DataFrame]) -> DataFrame:
    """Tables of several years under each other; columns that a year lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def standardise(df: DataFrame, value: str, *keys: str, epsilon: float = 1e-9, name: str = "z") -> DataFrame:
    """Adds the value's z-score (population deviation) within ``keys``."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    joined = df.join(stats, list(keys)) if keys else df.crossJoin(F.broadcast(stats))
    return joined.withColumn(name, (F.col(value) - F.col("_m")) / (F.col("_s") + epsilon)).drop("_m", "_s")


def fill_series(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Missing values become the entity's mean, then 0."""
    return df.withColumn(value, F.coalesce(value, F.avg(value).over(Window.partitionBy(entity)), F.lit(0.0)))
