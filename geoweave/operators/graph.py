"""Contiguity graphs: edges, normalised adjacency, convolution, neighbour features, forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoweave.operators.quantiles import exact_quantiles

_FORWARD = ((0, 1), (1, -1), (1, 0), (1, 1))


def queen_edges(nodes: DataFrame, node: str = "node", row: str = "br", column: str = "bc") -> DataFrame:
    """(src, dst): undirected edges between the eight neighbours, each once with src first in row-major order.

    Every node asks for its four forward neighbours: an equi-join, no range join."""
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _FORWARD))
    asks = nodes.select(F.col(node).alias("src"), row, column, F.explode(offsets).alias("o")).select("src", (F.col(row) + F.col("o.i")).alias(row), (F.col(column) + F.col("o.j")).alias(column))
    return asks.join(nodes.select(F.col(node).alias("dst"), row, column), [row, column]).select("src", "dst")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def normalised_adjacency(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """(src, dst, w): D^-1/2 (A + I) D^-1/2, both directions and self loops."""
    full = both_ways(edges).unionAll(nodes.select(F.col(node).alias("src"), F.col(node).alias("dst")))
    degree = full.groupBy("src").agg(F.count("*").alias("d"))
    rows = full.join(degree.withColumnRenamed("d", "ds"), "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst")
    return rows.select("src", "dst", (F.lit(1.0) / F.sqrt(F.col("ds") * F.col("dd"))).alias("w"))


def propagate(adjacency: DataFrame, values: DataFrame, features: Sequence[str], node: str = "node") -> DataFrame:
    """(node, features): each node's weighted sum of its neighbours' features."""
    joined = adjacency.join(values.select(F.col(node).alias("dst"), *features), "dst")
    return joined.groupBy(F.col("src").alias(node)).agg(*(F.sum(F.col("w") * F.col(f)).alias(f) for f in features))


def convolve(adjacency: DataFrame, values: DataFrame, features: Sequence[str], weights: Sequence[Sequence[float]], bias: Sequence[float], node: str = "node") -> DataFrame:
    """(node, h0..): A X W + b, the weights as column arithmetic."""
    summed = propagate(adjacency, values, features, node)
    return summed.select(node, *((sum(F.col(f) * float(weights[i][k]) for i, f in enumerate(features)) + float(bias[k])).alias(f"h{k}") for k in range(len(bias))))


def neighbour_mean(nodes: DataFrame, edges: DataFrame, features: Sequence[str], node: str = "node") -> DataFrame:
    """Nodes with nbr_<feature>: the mean over neighbours, 0 for a node without any."""
    sums = both_ways(edges).join(nodes.select(F.col(node).alias("dst"), *features), "dst").groupBy(F.col("src").alias(node)).agg(*(F.avg(f).alias(f"nbr_{f}") for f in features))
    return nodes.join(sums, node, "left").na.fill(0.0, [f"nbr_{f}" for f in features])


def persistence(df: DataFrame, node: str, time: str, value: str) -> DataFrame:
    """Adds the value before (the persistence forecast) and the change from it."""
    order = Window.partitionBy(node).orderBy(time)
    return df.withColumn("persisted", F.lag(value).over(order)).withColumn("change", F.col(value) - F.col("persisted"))


def forecast_scores(df: DataFrame, value: str, predicted: str, baseline: str = "persisted", *by: str) -> DataFrame:
    """(by.., n, rmse, r2, persistence_r2, skill): skill is one less the ratio of squared errors to the baseline's."""
    rows = df.where(f"{value} IS NOT NULL AND {predicted} IS NOT NULL AND {baseline} IS NOT NULL")
    v, e, b = F.col(value), F.col(value) - F.col(predicted), F.col(value) - F.col(baseline)
    total = F.var_pop(v) * F.count("*")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), total)).alias("r2"),
        (1 - F.try_divide(F.sum(b * b), total)).alias("persistence_r2"), (1 - F.try_divide(F.sum(e * e), F.sum(b * b))).alias("skill"),
    )


def influence(adjacency: DataFrame, nodes: DataFrame, values: DataFrame, features: Sequence[str], weights: Sequence[Sequence[float]], bias: Sequence[float], node: str = "node") -> DataFrame:
    """(node, influence): how far the model's output moves when neighbours are shut out (identity instead of the adjacency)."""
    loops = nodes.select(F.col(node).alias("src"), F.col(node).alias("dst"), F.lit(1.0).alias("w"))
    a, b = convolve(adjacency, values, features, weights, bias, node), convolve(loops, values, features, weights, bias, node)
    b = b.select(node, *(F.col(f"h{k}").alias(f"own{k}") for k in range(len(bias))))
    return a.join(b, node).select(node, sum(F.abs(F.col(f"h{k}") - F.col(f"own{k}")) for k in range(len(bias))).alias("influence"))


def roll_out(state: DataFrame, adjacency: DataFrame, own: float, neighbours: float, bias: float, steps: int = 3, node: str = "node", value: str = "value") -> DataFrame:
    """(node, step, value): an autoregressive forecast, each step from the one before; the steps are unrolled in the plan."""
    out, current = None, state.select(node, value)
    for k in range(1, steps + 1):
        mean = propagate(adjacency, current, [value], node).withColumnRenamed(value, "_m")
        current = current.join(mean, node).select(node, (F.col(value) * own + F.col("_m") * neighbours + bias).alias(value))
        part = current.select(node, F.lit(k).alias("step"), value)
        out = part if out is None else out.unionAll(part)
    return out


def risk_index(df: DataFrame, before: str, after: str, percentile: float = 0.95, name: str = "risk") -> DataFrame:
    """Adds the decline (0 if it grows) over the 95th percentile of declines, at most 1; 0 if nothing declines."""
    decline = F.greatest(F.col(before) - F.col(after), F.lit(0.0))
    limit = exact_quantiles(df.select(decline.alias("_d")).where("_d > 0"), "_d", [percentile]).select(F.col("q0").alias("_p"))
    return df.join(F.broadcast(limit), how="left").withColumn(name, F.coalesce(F.least(F.try_divide(decline, F.col("_p")), F.lit(1.0)), F.lit(0.0))).drop("_p")


def to_raster(cells: DataFrame, nodes: DataFrame, value: str, row: str = "br", column: str = "bc") -> DataFrame:
    """Every coarse cell with its node's value, null where it has no node."""
    return cells.select(row, column).distinct().join(nodes.select(row, column, value), [row, column], "left")
