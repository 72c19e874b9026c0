"""Grids as rows (r, c): stencils, blocks, resampling, burning and distances.

Stencils are separable: each pass sends a cell to its neighbours along one axis and
aggregates, so a 7 x 7 window costs 7 + 7 copies of a cell and not 49, and all joins are
equi-joins on integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def target_grid(spark, x0: float, y1: float, width: int, height: int, res: float) -> DataFrame:
    """(r, c, x, y) of every cell, with the coordinates of its centre."""
    cells = spark.range(width * height).select((F.col("id") / width).cast("int").alias("r"), (F.col("id") % width).cast("int").alias("c"))
    return cells.withColumns({"x": F.lit(x0) + (F.col("c") + 0.5) * res, "y": F.lit(y1) - (F.col("r") + 0.5) * res})


def covering(spark, source: DataFrame, step_r: float, step_c: float) -> DataFrame:
    """(r, c) of the target cells, each of ``step_r`` by ``step_c`` source cells, that cover the source from its corner on."""
    h, w = source.agg(F.ceil((F.max("r") + 1) / step_r).cast("long"), F.ceil((F.max("c") + 1) / step_c).cast("long")).first()
    return target_grid(spark, 0.0, 0.0, w or 0, h or 0, 1.0).select("r", "c")


def overlaps(x0: Column, y0: Column, x1: Column, y1: Column, extent: tuple[float, float, float, float]) -> Column:
    """Whether a rectangle and an extent (x0, y0, x1, y1) share an area."""
    return ~((x1 <= extent[0]) | (x0 >= extent[2]) | (y1 <= extent[1]) | (y0 >= extent[3]))


def snapped_extent(x0: float, y0: float, x1: float, y1: float, res: float) -> tuple[float, float, int, int]:
    """(x0, y1, width, height) of the least grid of whole multiples of ``res`` that holds a rectangle."""
    left, low, right, high = (f(v / res) * res for f, v in ((math.floor, x0), (math.floor, y0), (math.ceil, x1), (math.ceil, y1)))
    return left, high, round((right - left) / res), round((high - low) / res)


def north_up(points: DataFrame) -> DataFrame:
    """(row, col, left, top, value): a grid of longitudes and latitudes of centres, in whatever order, from the north-west corner on.

    ``left`` and ``top`` are the cell's edges, half a cell from its centre. Rows and columns come from
    the distinct coordinates, which are few against the cells."""

    def axis(name: str, index: str, sign: int) -> DataFrame:
        order = Window.orderBy(F.col(name) * sign)
        values = points.select(name).distinct()
        step = (F.max(name).over(Window.partitionBy()) - F.min(name).over(Window.partitionBy())) / F.greatest(F.count("*").over(Window.partitionBy()) - 1, F.lit(1))
        return values.select(name, (F.row_number().over(order) - 1).alias(index), (F.col(name) - sign * step / 2).alias("left" if sign > 0 else "top"))

    return points.join(axis("lat", "row", -1), "lat").join(axis("lon", "col", 1), "lon").select("row", "col", "left", "top", "value")


def segments_within(segments: DataFrame, extent: tuple[float, float, float, float], transform=None) -> DataFrame:
    """Line segments (x1, y1, x2, y2) whose box meets an extent; then ``transform`` maps (x, y) columns to other coordinates."""
    x0, x1 = F.least("x1", "x2"), F.greatest("x1", "x2")
    y0, y1 = F.least("y1", "y2"), F.greatest("y1", "y2")
    kept = segments.where((x1 >= extent[0]) & (x0 <= extent[2]) & (y1 >= extent[1]) & (y0 <= extent[3]))
    if transform is None:
        return kept
    (a, b), (c, d) = transform(F.col("x1"), F.col("y1")), transform(F.col("x2"), F.col("y2"))
    return kept.withColumns({"x1": a, "y1": b, "x2": c, "y2": d})


def within(df: DataFrame, area: DataFrame, *keys: str) -> DataFrame:
    """Rows of cells inside an area: absence is outside."""
    return df.join(area.select(*keys), list(keys), "left_semi")


def _reflected(index: Column, size: int) -> Column:
    """The index mirrored at the edges, the edge cell itself repeated."""
    return F.when(index < 0, -index - 1).when(index >= size, 2 * size - 1 - index).otherwise(index)


def class_fractions(cells: DataFrame, height: int, width: int, classes: Sequence[int], radius: int = 1, label: str = "class", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, r, c, class, n): how many of the (2 radius + 1)^2 cells around a cell are of each class that occurs there.

    The centre counts, edges are mirrored, cells without a class are of none. Mirroring is
    done by the sender: near an edge a cell stands for its image as well."""
    one = cells.where(F.col(label).isin(*classes)).select(*keys, "r", "c", F.col(label).alias("class"), F.lit(1).cast("long").alias("n"))
    return _spread(_spread(one, "r", height, radius), "c", width, radius).select(*keys, "r", "c", "class", "n")


def _received(df: DataFrame, axis: str, size: int, radius: int) -> DataFrame:
    """Every row once for each receiver along an axis, whose index takes the place of its own."""
    at, span = F.col(axis), range(-radius, radius + 1)
    # A receiver t sees this cell at offset d where mirror(t + d) is the cell's index: t = index - d, or its image's.
    targets = [F.struct((at - d).alias("t"), (at - d).between(0, size - 1).alias("ok")) for d in span]
    targets += [F.struct((-at - 1 - d).alias("t"), ((-at - 1 - d).between(0, size - 1)).alias("ok")) for d in span]
    targets += [F.struct((2 * size - 1 - at - d).alias("t"), ((2 * size - 1 - at - d).between(0, size - 1)).alias("ok")) for d in span]
    return df.select("*", F.explode(F.filter(F.array(*targets), lambda s: s["ok"])).alias("_to")).withColumn(axis, F.col("_to.t")).drop("_to")


def _spread(df: DataFrame, axis: str, size: int, radius: int) -> DataFrame:
    """Sums of ``n`` by all other columns over the receivers along an axis."""
    return _received(df, axis, size, radius).groupBy(*(c for c in df.columns if c != "n")).agg(F.sum("n").alias("n"))


def class_shares(cells: DataFrame, height: int, width: int, classes: int, label: str = "class", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, r, c, nbr3_class<k>_frac..): shares of the classes 1 to ``classes`` (14 at most) in the 3 x 3 cells around a cell that holds or sees any.

    As :func:`class_fractions`, but all classes' counts travel as one number with four bits for each, and rows of cells meet in one shuffle."""
    if classes > 14:
        raise ValueError("at most 14 classes")
    one = cells.where(F.col(label).between(1, classes)).select(*keys, "r", "c", F.expr(f"shiftleft(1L, CAST(4 * ({label} - 1) AS INT))").alias("n"))
    rows = _received(one, "r", height, 1).repartition(*keys, "r").groupBy(*keys, "r", "c").agg(F.sum("n").alias("n"))
    held = _spread(rows, "c", width, 1)
    return held.select(*keys, "r", "c", *((F.shiftright("n", 4 * (k - 1)).bitwiseAND(15) / 9.0).alias(f"nbr3_class{k}_frac") for k in range(1, classes + 1)))


def _box(cells: DataFrame, value: str, radius: int) -> DataFrame:
    """(r, c, s, n): sum and number of given values in the square around every cell that any of them reaches."""
    span = F.array(*(F.lit(d) for d in range(-radius, radius + 1)))
    rows = cells.where(F.col(value).isNotNull()).select("c", F.explode(F.transform(span, lambda d: F.col("r") + d)).alias("r"), F.col(value).cast("double").alias("s"))
    rows = rows.groupBy("r", "c").agg(F.sum("s").alias("s"), F.count("*").alias("n"))
    both = rows.select("r", F.explode(F.transform(span, lambda d: F.col("c") + d)).alias("c"), "s", "n")
    return both.groupBy("r", "c").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def gap_fill(cells: DataFrame, value: str = "value", radius: int = 3, least: int = 5) -> DataFrame:
    """Missing values become the mean of the given ones around them, where there are ``least`` or more."""
    joined = cells.join(_box(cells, value, radius), ["r", "c"], "left")
    return joined.withColumn(value, F.coalesce(F.col(value), F.when(F.col("n") >= least, F.col("s") / F.col("n")))).drop("s", "n")


def median_filter(cells: DataFrame, value: str = "value", radius: int = 1) -> DataFrame:
    """The median of the square around each given cell, where missing cells and those outside count as 0; missing cells stay missing."""
    width = 2 * radius + 1
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)))
    sent = cells.where(F.col(value).isNotNull()).select("r", "c", F.col(value).cast("double").alias("_v"), F.explode(offsets).alias("o"))
    got = sent.groupBy((F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c")).agg(F.collect_list("_v").alias("_vs"))  # at most width^2 values
    full = F.array_sort(F.concat("_vs", F.array_repeat(F.lit(0.0), F.lit(width * width) - F.size("_vs"))))
    return cells.where(F.col(value).isNotNull()).join(got, ["r", "c"]).withColumn(value, F.element_at(full, width * width // 2 + 1)).drop("_vs")


def coarsen_mean(cells: DataFrame, factor: int, height: int, width: int, value: str = "value") -> DataFrame:
    """(br, bc, value, n): mean of the given values of whole blocks; blocks cut by the edge go."""
    whole = cells.where((F.col("r") < height // factor * factor) & (F.col("c") < width // factor * factor))
    return whole.groupBy(F.floor(F.col("r") / factor).cast("int").alias("br"), F.floor(F.col("c") / factor).cast("int").alias("bc")).agg(F.avg(value).alias("value"), F.count(value).alias("n"))


def coarsen_mode(cells: DataFrame, factor: int, height: int, width: int, label: str = "class") -> DataFrame:
    """(br, bc, class): the most frequent positive class of whole blocks, ties to the least, 0 if there is none."""
    whole = cells.where((F.col("r") < height // factor * factor) & (F.col("c") < width // factor * factor))
    by = whole.groupBy(F.floor(F.col("r") / factor).cast("int").alias("br"), F.floor(F.col("c") / factor).cast("int").alias("bc"), F.when(F.col(label) > 0, F.col(label)).alias("class")).agg(F.count("*").alias("n"))
    best = F.max_by("class", F.when(F.col("class").isNotNull(), F.struct(F.col("n"), -F.col("class"))))
    return by.groupBy("br", "bc").agg(F.coalesce(best, F.lit(0)).alias("class"))


def node_mask(cells: DataFrame, factor: int, height: int, width: int, inside: str, value: str, least_inside: float = 0.5, least_valid: float = 0.9) -> DataFrame:
    """(br, bc): blocks of which enough lies inside and, of all cells, enough has a value."""
    whole = cells.where((F.col("r") < height // factor * factor) & (F.col("c") < width // factor * factor))
    area = float(factor * factor)
    by = whole.groupBy(F.floor(F.col("r") / factor).cast("int").alias("br"), F.floor(F.col("c") / factor).cast("int").alias("bc")).agg(F.count_if(inside).alias("i"), F.count(value).alias("v"))
    return by.where((F.col("i") / area >= least_inside) & (F.col("v") / area >= least_valid)).select("br", "bc")


def resample_nearest(source: DataFrame, target: DataFrame, step_r: float, step_c: float, value: str = "code") -> DataFrame:
    """(r, c, value): the source cell in which each target centre lies; ``step`` is the target's cell in source cells. Outside is null."""
    at = target.select("r", "c", F.floor((F.col("r") + 0.5) * step_r).cast("int").alias("_r"), F.floor((F.col("c") + 0.5) * step_c).cast("int").alias("_c"))
    src = source.select(F.col("r").alias("_r"), F.col("c").alias("_c"), F.col(value))
    return at.join(src, ["_r", "_c"], "left").select("r", "c", value)


def resample_bilinear(source: DataFrame, target: DataFrame, step_r: float, step_c: float, value: str = "value") -> DataFrame:
    """(r, c, value): the weighted mean of the given ones of the four source cells around each target centre; null if there are none."""
    y, x = (F.col("r") + 0.5) * step_r - 0.5, (F.col("c") + 0.5) * step_c - 0.5
    fy, fx = y - F.floor(y), x - F.floor(x)
    corners = [F.struct((F.floor(y) + i).cast("int").alias("_r"), (F.floor(x) + j).cast("int").alias("_c"), ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("w")) for i in (0, 1) for j in (0, 1)]
    sent = target.select("r", "c", F.inline(F.array(*corners))).where("w > 0")
    src = source.select(F.col("r").alias("_r"), F.col("c").alias("_c"), F.col(value).alias("_v"))
    joined = sent.join(src, ["_r", "_c"], "left")
    given = F.when(F.col("_v").isNotNull(), F.col("w"))
    return joined.groupBy("r", "c").agg(F.try_divide(F.sum(F.col("w") * F.col("_v")), F.sum(given)).alias(value))


def burn_rectangles(cells: DataFrame, rects: DataFrame) -> DataFrame:
    """(r, c, code): the code of the last rectangle (r0 <= r < r1, c0 <= c < c1; by seq) that holds each cell's centre.

    Rectangles are spread over the rows that they touch, so the join is on the row."""
    by_row = rects.where("r1 > r0").select(F.explode(F.sequence("r0", F.col("r1") - 1)).alias("r"), "c0", "c1", "code", "seq")
    hit = cells.select("r", "c").join(by_row, "r").where((F.col("c") >= F.col("c0")) & (F.col("c") < F.col("c1")))
    return hit.groupBy("r", "c").agg(F.max_by("code", F.col("seq")).alias("code"))


def scanline_spans(edges: DataFrame, bounds: DataFrame) -> DataFrame:
    """(poly, r, c0, c1): runs of cells, first and last, whose centres lie in a polygon, cut at ``bounds`` (one row: r0, r1, c0, c1).

    Edges (poly, x1, y1, x2, y2, in cells) are spread over the rows whose centre line they cross. Along a row, a polygon's crossings
    are sorted, and every other gap between them is inside. Holes and further parts are edges like any."""
    e = edges.withColumns({"lo": F.least("y1", "y2"), "hi": F.greatest("y1", "y2")}).where("hi > lo").join(F.broadcast(bounds), how="cross")
    first, last = F.greatest(F.ceil(F.col("lo") - 0.5).cast("int"), "r0"), F.least((F.ceil(F.col("hi") - 0.5) - 1).cast("int"), "r1")
    spread = e.where(last >= first).select("poly", "x1", "y1", "x2", "y2", "c0", "c1", F.explode(F.sequence(first, last)).alias("r"))
    cross = spread.select("poly", "r", "c0", "c1", (F.col("x1") + (F.col("r") + 0.5 - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))).alias("x"))
    order = Window.partitionBy("poly", "r").orderBy("x")
    gaps = cross.withColumns({"end": F.lead("x").over(order), "k": F.row_number().over(order)}).where("k % 2 = 1 AND end IS NOT NULL")
    span = gaps.select("poly", "r", F.greatest(F.ceil(F.col("x") - 0.5).cast("int"), "c0").alias("c0"), F.least((F.ceil(F.col("end") - 0.5) - 1).cast("int"), "c1").alias("c1"))
    return span.where("c1 >= c0")


def extent_of(cells: DataFrame) -> DataFrame:
    """One row (r0, r1, c0, c1): the first and last row and column."""
    return cells.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))


def burn_polygons(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """(poly, r, c): cells whose centre lies in a polygon: the cells of its runs, by an equi-join on row and column."""
    inside = scanline_spans(edges, extent_of(cells)).select("poly", "r", F.explode(F.sequence("c0", "c1")).alias("c"))
    return inside.join(cells.select("r", "c"), ["r", "c"]).select("poly", "r", "c")


def cells_crossed(edges: DataFrame, bounds: DataFrame, key: str = "poly") -> DataFrame:
    """(key, r, c), distinct: every cell that a line segment (key, x1, y1, x2, y2, in cells) passes, within ``bounds`` (one row: r0, r1, c0, c1).

    A segment is cut at the borders of the rows that it crosses; each part passes the columns between its ends."""
    x1, y1, x2, y2 = (F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))
    first, last = F.greatest(F.floor(F.least(y1, y2)).cast("int"), "r0"), F.least(F.floor(F.greatest(y1, y2)).cast("int"), "r1")
    near = edges.select(key, x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")).join(F.broadcast(bounds), how="cross")
    spread = near.where(last >= first).select("*", F.explode(F.sequence(first, last)).alias("r"))
    x1, y1, x2, y2, r = (F.col(c) for c in ("x1", "y1", "x2", "y2", "r"))
    at = lambda y: F.when(y1 == y2, x1).otherwise(x1 + (F.greatest(F.least(y1, y2), F.least(F.greatest(y1, y2), y)) - y1) / F.nullif(y2 - y1, F.lit(0.0)) * (x2 - x1))
    a, b = at(r.cast("double")), F.when(y1 == y2, x2).otherwise(at(r + F.lit(1.0)))
    lo, hi = F.greatest(F.floor(F.least(a, b)).cast("int"), "c0"), F.least(F.floor(F.greatest(a, b)).cast("int"), "c1")
    parts = spread.select(key, "r", lo.alias("lo"), hi.alias("hi")).where("hi >= lo")
    return parts.select(key, "r", F.explode(F.sequence("lo", "hi")).alias("c")).distinct()


def burn_touched(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """(poly, r, c): cells that a polygon's area or outline touches: those with their centre inside, and those that an edge crosses."""
    touched = cells_crossed(edges, extent_of(cells)).join(cells.select("r", "c"), ["r", "c"]).select("poly", "r", "c")
    return touched.union(burn_polygons(cells, edges)).distinct()


def event_days(cells: DataFrame, touched: DataFrame, *keys: str) -> DataFrame:
    """(r, c, keys, n): on how many days an event touched each cell."""
    return cells.select("r", "c").join(touched, ["r", "c"]).groupBy("r", "c", *keys).agg(F.countDistinct("day").alias("n"))


def distance_squared(cells: DataFrame, roads: DataFrame, height: int, width: int) -> DataFrame:
    """(r, c, d2): squared distance in cells to the nearest road cell; null if there are no roads.

    Exact and separable. Along each column the nearest road above and below gives the
    vertical distance, in windows that only grow (linear in its length). Then every row takes the lower envelope of the parabolas
    (horizontal distance)^2 + (vertical distance)^2 of its columns, in time linear in its
    length."""
    marked = cells.select("r", "c", F.lit(None).cast("int").alias("road")).unionAll(roads.select("r", "c", F.col("r").alias("road")))
    marked = marked.groupBy("r", "c").agg(F.max("road").alias("road"))
    up = Window.partitionBy("c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("c").orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, 0)  # a frame up to the end would begin anew at every row
    vertical = marked.select("r", "c", F.least(F.col("r") - F.last("road", True).over(up), F.last("road", True).over(down) - F.col("r")).alias("v"))

    # A row of the grid is one array of columns and one of distances; its work is linear in its length.
    rows = vertical.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("line"))  # at most the grid's width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(1).offsets.to_numpy()
            c, v = (batch.column(1).values.field(i) for i in (0, 1))
            c, known, v = c.to_numpy(), v.is_valid().to_numpy(zero_copy_only=False), v.fill_null(0).to_numpy().astype(np.int64)
            found = np.full(len(c), -1, np.int64)
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                near = known[a:b]
                if near.any():
                    found[a:b] = lower_envelope(c[a:b][near].astype(np.int64), v[a:b][near] ** 2, c[a:b].astype(np.int64))
            r = np.repeat(batch.column(0).to_numpy(), np.diff(ends))
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(c[ends[0] : ends[-1]], pa.int32()), pa.array(found[ends[0] : ends[-1]], pa.int64(), mask=found[ends[0] : ends[-1]] < 0)], names=["r", "c", "d2"])

    best = rows.select("r", "line").mapInArrow(run, "r int, c int, d2 long")
    return cells.select("r", "c").join(best, ["r", "c"], "left")


def lower_envelope(centres: np.ndarray, heights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Least of (x - centre)^2 + height over the parabolas, for every x of ``at``; centres ascend."""
    kept: list[int] = []
    begins: list[float] = []
    for i, (c, h) in enumerate(zip(centres.tolist(), heights.tolist())):
        begin = -np.inf
        while kept:
            j = kept[-1]
            begin = (h + c * c - int(heights[j]) - int(centres[j]) ** 2) / (2 * (c - int(centres[j])))
            if begin > begins[-1]:
                break
            kept.pop()
            begins.pop()
            begin = -np.inf
        kept.append(i)
        begins.append(begin)
    k = np.searchsorted(begins, at, "right") - 1
    found = np.full(len(at), np.iinfo(np.int64).max)
    for step in (-1, 0, 1):  # rounding of a border may name the parabola beside
        i = np.array(kept)[np.clip(k + step, 0, len(kept) - 1)]
        found = np.minimum(found, (at - centres[i]) ** 2 + heights[i])
    return found


def zone_means(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Means of the given values by zone (and more keys); NaN counts as missing."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    return df.groupBy(*keys).agg(F.avg(v).alias("value"), F.count(v).alias("n"))


def zone_summary(df: DataFrame, zone: str, drivers: Sequence[str], dominant: str) -> DataFrame:
    """Pixels of each zone, its mean of every driver, and the share in per cent of pixels that each driver dominates."""
    n = F.greatest(F.count("*"), F.lit(1))
    return df.groupBy(zone).agg(F.count("*").alias("n_pixels"), *(F.round(F.avg(d), 6).alias(f"mean_{d}") for d in drivers), *(F.round(F.lit(100.0) * F.count_if(F.col(dominant) == i + 1) / n, 2).alias(f"share_{d}") for i, d in enumerate(drivers)))


def dominant(df: DataFrame, drivers: Sequence[str], least: float | None = None, name: str = "dominant") -> DataFrame:
    """Adds the number (from 1) of the driver of the greatest value, ties to the first; 0 if none is given or above ``least``."""
    top = F.greatest(*(F.col(d) for d in drivers))
    out = F.when(F.lit(False), F.lit(0))
    for i, d in enumerate(drivers):
        out = out.when(F.col(d) == top, F.lit(i + 1))
    found = out.otherwise(0)
    return df.withColumn(name, found if least is None else F.when(top > least, found).otherwise(0))
