"""Alignment of driver variables with the target grid: one job for all variables of a group."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.functions import dims
from geoweave.operators import features, grid


def continuous(source: DataFrame, target: DataFrame, ranges: Mapping[str, tuple[float, float]], keys: Sequence[str] = ("variable", "year"), step_r: float = 1.0, step_c: float = 1.0) -> DataFrame:
    """(keys, r, c, value): bilinear resampling of every variable and year, then its plausible range.

    ``source`` has (keys, r, c, value). Missing rasters give no rows and never zeros."""
    y, x = (F.col("r") + 0.5) * step_r - 0.5, (F.col("c") + 0.5) * step_c - 0.5
    fy, fx = y - F.floor(y), x - F.floor(x)
    corners = [F.struct((F.floor(y) + i).cast("int").alias("_r"), (F.floor(x) + j).cast("int").alias("_c"), ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("w")) for i in (0, 1) for j in (0, 1)]
    sent = target.select("r", "c", F.inline(F.array(*corners))).where("w > 0")
    src = source.where(F.col("value").isNotNull() & ~F.isnan("value")).select(*keys, F.col("r").alias("_r"), F.col("c").alias("_c"), "value")
    mixed = src.join(sent, ["_r", "_c"]).groupBy(*keys, "r", "c").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))
    return features.clamp_table(mixed, ranges)


def categorical(source: DataFrame, target: DataFrame, keys: Sequence[str] = ("variable", "year"), step_r: float = 1.0, step_c: float = 1.0, nodata: int | None = None) -> DataFrame:
    """(keys, r, c, value): the class of the source cell under each target centre; ``nodata`` is null."""
    at = target.select("r", "c", F.floor((F.col("r") + 0.5) * step_r).cast("int").alias("_r"), F.floor((F.col("c") + 0.5) * step_c).cast("int").alias("_c"))
    value = F.col("value") if nodata is None else F.nullif("value", F.lit(nodata))
    return source.select(*keys, F.col("r").alias("_r"), F.col("c").alias("_c"), value.alias("value")).join(at, ["_r", "_c"]).select(*keys, "r", "c", "value")


def climate(source: DataFrame, target: DataFrame, **steps: float) -> DataFrame:
    return continuous(source, target, dims.PLAUSIBLE, **steps)


def phenology(source: DataFrame, target: DataFrame, **steps: float) -> DataFrame:
    """Day-of-year variables, 1 to 366."""
    out = continuous(source, target, {}, **steps)
    low, high = dims.PLAUSIBLE["phenology"]
    return out.withColumn("value", F.when(F.col("value").between(low, high), F.col("value")))


def population(source: DataFrame, target: DataFrame, **steps: float) -> DataFrame:
    """Densities; the code for no data and the sentinels of floats are missing."""
    return continuous(source.withColumn("value", features.no_data(F.col("value"), -99999)), target, {}, **steps)


def cropping(source: DataFrame, target: DataFrame, **steps: float) -> DataFrame:
    """Classes of cropping intensity, by the nearest cell; 255 is outside."""
    return categorical(source, target, nodata=255, **steps)


def plain(source: DataFrame, target: DataFrame, **steps: float) -> DataFrame:
    """Variables without a range: grazing and livestock."""
    return continuous(source, target, {}, **steps)


def vegetation(bands: DataFrame, target: DataFrame, names: Sequence[str] = ("annual_mean", "gs_mean", "gs_max"), **steps: float) -> DataFrame:
    """Three-band fixed-point images (year, r, c, band1..) as long variables, scaled and clamped."""
    pairs = ", ".join(f"'ndvi_{n}', band{i + 1}" for i, n in enumerate(names))
    long = bands.select("year", "r", "c", F.expr(f"stack({len(names)}, {pairs}) AS (variable, value)"))
    long = long.withColumn("value", features.scale_fixed_point(F.col("value")))
    out = continuous(long, target, {}, **steps)
    low, high = dims.PLAUSIBLE["ndvi"]
    return out.withColumn("value", F.when(F.col("value").between(low, high), F.col("value")))


def terrain(source: DataFrame, target: DataFrame, **steps: float) -> DataFrame:
    """Elevation and slope bilinear, aspect nearest (it is an angle); all clamped."""
    smooth = continuous(source.where("variable <> 'aspect'"), target, dims.PLAUSIBLE, keys=("variable",), **steps)
    angle = features.clamp_table(categorical(source.where("variable = 'aspect'"), target, keys=("variable",), **steps), dims.PLAUSIBLE)
    return smooth.unionByName(angle)


def drought(monthly: DataFrame, target: DataFrame, **steps: float) -> DataFrame:
    """Monthly index (scale, year, month, r, c, z) to yearly statistics on the target grid, as long variables."""
    stats = features.yearly_statistics(monthly, ("scale", "year", "r", "c"))
    names = [c for c in stats.columns if c not in ("scale", "year", "r", "c")]
    pairs = ", ".join(f"'{n}', CAST({n} AS DOUBLE)" for n in names)
    long = stats.select("scale", "year", "r", "c", F.expr(f"stack({len(names)}, {pairs}) AS (stat, value)"))
    long = long.select(F.concat_ws("_", "scale", "stat").alias("variable"), "year", "r", "c", "value")
    return continuous(long, target, {}, **steps)


def desertification(cells: DataFrame, edges: DataFrame, codes: DataFrame) -> DataFrame:
    """(r, c, code): polygons burnt into the grid, later ones over earlier. ``codes`` has (poly, code, seq)."""
    burnt = grid.burn_polygons(cells, edges).join(codes, "poly")
    return burnt.groupBy("r", "c").agg(F.max_by("code", "seq").alias("code"))


def sandstorms(cells: DataFrame, touched: DataFrame) -> DataFrame:
    """(year, r, c, n): event days of every cell and year; ``touched`` has (year, day, r, c)."""
    return grid.event_days(cells, touched, "year")


def roads(cells: DataFrame, road_cells: DataFrame, height: int, width: int) -> DataFrame:
    """(r, c, road_distance_km): distance to the nearest road at one kilometre a cell."""
    d = grid.distance_squared(cells, road_cells, height, width)
    return d.select("r", "c", F.sqrt("d2").alias("road_distance_km"))


def roads_from_lines(cells: DataFrame, lines: DataFrame, left: float, top: float, res: float, height: int, width: int) -> DataFrame:
    """(r, c, road_distance_km) from road segments (id, x1, y1, x2, y2, in the grid's projection): every cell that a segment passes is a road
    cell. ``left`` and ``top`` are the grid's corner and ``res`` the size of a cell."""
    x, y = (lambda c: (F.col(c) - left) / res), (lambda c: (top - F.col(c)) / res)
    in_cells = lines.select("id", x("x1").alias("x1"), y("y1").alias("y1"), x("x2").alias("x2"), y("y2").alias("y2"))
    crossed = grid.cells_crossed(in_cells, grid.extent_of(cells), "id").select("r", "c").distinct()
    return roads(cells, crossed, height, width)


def storms(cells: DataFrame, edges: DataFrame, days: DataFrame) -> DataFrame:
    """(year, r, c, n): days on which a storm's polygon touched each cell. ``days`` has (poly, year, day)."""
    return sandstorms(cells, grid.burn_touched(cells, edges).join(days, "poly"))


def aligned(wanted: Sequence[str], sources: Mapping[str, DataFrame], target: DataFrame, years: Sequence[int] = (), **steps: float) -> DataFrame:
    """(group, variable, year, r, c, value) of the raster groups asked for, those years only (all, if none are named).

    A group without a source gives no rows; an unknown name raises ValueError."""
    unknown = [g for g in wanted if g not in GROUPS]
    if unknown:
        raise ValueError(f"no such group: {unknown}; there are {sorted(GROUPS)}")
    out = target.sparkSession.createDataFrame([], "group string, variable string, year int, r int, c int, value double")
    for g in wanted:
        if g in sources:
            held = sources[g].where(F.col("year").isin(*years)) if years else sources[g]
            out = out.unionByName(GROUPS[g](held, target, **steps).select(F.lit(g).alias("group"), "variable", F.col("year").cast("int").alias("year"), "r", "c", F.col("value").cast("double").alias("value")))
    return out


#: Groups by name, as the command line of a batch run would pick them.
GROUPS: dict[str, Callable[..., DataFrame]] = {
    "climate": climate, "grazing": plain, "phenology": phenology, "population": population, "cropping": cropping,
    "desertification": desertification, "sandstorm": sandstorms, "roads": roads, "livestock": plain,
    "vegetation": vegetation, "terrain": terrain, "drought": drought,
}
