"""Small networks for node series: dense, recurrent and attentive; fitted on all windows, where they lie.

Graph convolution is linear, so the neighbours' part of a window is propagated by the graph
operators (a distributed join) before it gets here, and the network's input weights are the
convolution's. A round of a fit is one pass: tasks add up the gradients of their windows, Spark adds
those, and the driver takes a step from one number for each parameter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoweave.operators import features, graph
from geoweave.operators.models import Adam, RecurrentNode
from geoweave.sources import catalog


class DenseNode(RecurrentNode):
    """One hidden layer over a whole window."""

    def __init__(self, inputs: int, hidden: int = 8, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {"h": rng.normal(0, 0.3, (inputs + 1, hidden)), "o": rng.normal(0, 0.3, (hidden + 1, 1))}

    def _run(self, x: np.ndarray):
        one = np.ones((len(x), 1))
        u = np.concatenate([x.reshape(len(x), -1), one], axis=1)
        c = np.tanh(u @ self.p["h"])
        top = np.concatenate([c, one], axis=1)
        return (top @ self.p["o"])[:, 0], (u, c), top

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._run(x)[0]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        out, (u, c), top = self._run(x)
        error = ((out - y) / len(y))[:, None]
        dc = (error @ self.p["o"][:-1].T) * (1 - c * c)
        return float(((out - y) ** 2).mean() / 2), {"h": u.T @ dc, "o": top.T @ error}


class AttentiveNode(RecurrentNode):
    """A recurrent unit whose head sees all steps, each by its attention."""

    def __init__(self, inputs: int, hidden: int = 8, seed: int = 0):
        super().__init__(inputs, hidden, seed)
        self.p["a"] = np.random.default_rng(seed + 1).normal(0, 0.3, (hidden, 1))

    def _weighed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """(states (step, hidden, row), their weights (step, row), what the head sees, what each step saw)."""
        states, saved = self._unrolled(x)
        score = self.p["a"][:, 0] @ states
        weights = np.exp(score - score.max(axis=0))
        weights /= weights.sum(axis=0)
        return states, weights, (weights[:, None] * states).sum(axis=0), saved

    def attention(self, x: np.ndarray) -> np.ndarray:
        """(row, step): what each step weighs."""
        return self._weighed(x)[1].T

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.p["o"][:-1, 0] @ self._weighed(x)[2] + self.p["o"][-1, 0]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        states, weights, seen, saved = self._weighed(x)
        out = self.p["o"][:-1, 0] @ seen + self.p["o"][-1, 0]
        error = (out - y) / len(y)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["o"] = np.append(seen @ error, error.sum())[:, None]
        dseen = self.p["o"][:-1] * error
        dweight = (states * dseen).sum(axis=1)
        dscore = weights * (dweight - (weights * dweight).sum(axis=0))
        g["a"] = sum(h @ d for h, d in zip(states, dscore))[:, None]
        self._backwards(saved, weights[:, None] * dseen + dscore[:, None] * self.p["a"], g)
        return float(((out - y) ** 2).mean() / 2), g


def windows(df: DataFrame, node: str, time: str, columns: Sequence[str], label: str, length: int = 3) -> DataFrame:
    """(node, time, label, <column>_<k>..): standardised columns of the ``length`` steps before each one; rows without all of them go.

    Missing values are filled by the node's mean before they are standardised over all nodes and times."""
    held = df
    for c in columns:
        held = features.standardise(features.fill_series(held, node, c), c, name=f"_z_{c}")
    order = Window.partitionBy(node).orderBy(time)
    lagged = {f"{c}_{k}": F.lag(f"_z_{c}", k).over(order) for c in columns for k in range(length, 0, -1)}
    out = held.select(node, time, F.col(label), *(v.alias(n) for n, v in lagged.items()))
    return out.where(" AND ".join(f"{c}_{length} IS NOT NULL" for c in columns) + f" AND {label} IS NOT NULL")


def with_propagated(adjacency: DataFrame, panel: DataFrame, columns: Sequence[str], node: str = "node", time: str = "t") -> DataFrame:
    """The panel with nbr_<column>: each column weighed over a node and its neighbours at the same time."""
    moved = adjacency.join(panel.select(F.col(node).alias("dst"), time, *columns), "dst").groupBy(F.col("src").alias(node), time).agg(*(F.sum(F.col("w") * F.col(c)).alias(f"nbr_{c}") for c in columns))
    return panel.join(moved, [node, time], "left").na.fill(0.0, [f"nbr_{c}" for c in columns])


#: Windows in a lot: the arrays of a step then take about 32 KB each.
LOT = 512
KINDS = {"dense": DenseNode, "recurrent": RecurrentNode, "attentive": AttentiveNode}


def _names(columns: Sequence[str], length: int) -> list[str]:
    return [f"{c}_{k}" for k in range(length, 0, -1) for c in columns]


def packed(inputs: DataFrame, used: Sequence[str], lot: int = LOT) -> DataFrame:
    """(judged, data): the windows as tables of doubles (the ``used`` columns and ``_y``), at most ``lot`` rows each, so that a round turns
    no columns into arrays and a network's steps stay in the processor's cache."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = {False: np.empty((0, len(used) + 1)), True: np.empty((0, len(used) + 1))}

        def out(away: bool, tables: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([away] * len(tables)), pa.array([np.ascontiguousarray(t).tobytes() for t in tables], pa.binary())], names=["judged", "data"])

        for batch in batches:
            held = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(used) + 1)], axis=1)
            judged = batch.column(len(used) + 1).to_numpy(zero_copy_only=False).astype(bool)
            for away in rest:
                new = np.concatenate([rest[away], held[judged == away]])
                full = len(new) // lot * lot
                rest[away] = new[full:]
                if full:
                    yield out(away, np.split(new[:full], full // lot))
        for away, left in rest.items():
            if len(left):
                yield out(away, [left])

    return inputs.select(*used, "_y", "_judged").mapInArrow(run, "judged boolean, data binary")


def fitted(rows: DataFrame, specs: dict[str, tuple[str, Sequence[str]]], label: str, length: int, *, judged: str | None = None, hidden: int = 8, rounds: int = 200, rate: float = 0.02, clip: float = 2.0, patience: int = 40, seed: int = 0) -> tuple[dict, list[dict[str, float]]]:
    """(fitted networks by name, losses of each round). ``specs`` names networks: a kind of ``KINDS`` and the columns it sees.

    All networks are fitted side by side: a round is one pass over all windows, in which every task adds up the gradients of
    its rows, and Spark adds those of the tasks. The driver gets one number for each parameter. ``rows`` is read once and stored as lots of
    numbers (:func:`packed`), which the rounds read. A network without gain for long takes no further part. Rows where the column ``judged`` holds don't take part in the gradients; their loss (else that of
    the others) tells when a network has ``patience`` rounds without gain and which state is kept."""
    columns = {n: _names(c, length) for n, (_, c) in specs.items()}
    models = {n: KINDS[kind](length * len(c) if kind == "dense" else len(c), hidden, seed) for n, (kind, c) in specs.items()}
    order = {n: sorted(m.p) for n, m in models.items()}
    steps = {n: Adam(m.p, rate, clip) for n, m in models.items()}
    used = list(dict.fromkeys(x for names in columns.values() for x in names))
    inputs = rows.select(*used, F.col(label).cast("double").alias("_y"), (F.coalesce(F.col(judged), F.lit(False)) if judged else F.lit(False)).alias("_judged"))
    lots = catalog.stored(packed(inputs, used), "lots")
    at = {n: [used.index(c) for c in names] for n, names in columns.items()}
    best, held, waited, history = dict.fromkeys(models, np.inf), {}, dict.fromkeys(models, 0), []

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {n: np.zeros(4 + sum(v.size for v in m.p.values())) for n, m in models.items() if waited[n] < patience}
        for away, data in (x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            table = np.frombuffer(data).reshape(-1, len(used) + 1)
            k, y = len(table), table[:, -1]
            for n in sums:
                m, x = models[n], table[:, at[n]].reshape(k, length, -1)
                if away:
                    sums[n][2:4] += k, ((m.predict(x) - y) ** 2).sum() / 2
                else:
                    loss, g = m.gradients(x, y)
                    sums[n][:2] += k, k * loss
                    sums[n][4:] += k * np.concatenate([g[i].ravel() for i in order[n]])
        for n, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), list(models).index(n), np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["network", "at", "v"])

    for _ in range(rounds):
        found = lots.mapInArrow(totals, "network int, at int, v double").groupBy("network", "at").agg(F.sum("v").alias("v")).toPandas()
        losses = {}
        for i, (n, m) in enumerate(models.items()):
            v = np.zeros(4 + sum(x.size for x in m.p.values()))
            one = found[found["network"] == i]
            v[one["at"].to_numpy()] = one["v"].to_numpy()
            if not v[0]:
                continue
            losses[n] = float(v[3] / v[2] if v[2] else v[1] / v[0])
            if waited[n] >= patience:
                continue
            if losses[n] < best[n] - 1e-9:
                best[n], waited[n], held[n] = losses[n], 0, {k: x.copy() for k, x in m.p.items()}
            else:
                waited[n] += 1
            ends = np.cumsum([m.p[k].size for k in order[n]])
            parts = np.split(v[4:] / v[0], ends[:-1])
            steps[n].step({k: part.reshape(m.p[k].shape) for k, part in zip(order[n], parts)})
        history.append(losses)
        if not losses or all(w >= patience for w in waited.values()):
            break
    catalog.discard(lots)
    for n, p in held.items():
        models[n].p = p
    return models, history


def predicted(rows: DataFrame, models: dict, specs: dict[str, tuple[str, Sequence[str]]], length: int) -> DataFrame:
    """``rows`` under each other for each network, with its name as ``model`` and its ``predicted``, in Arrow batches."""
    columns = {n: _names(c, length) for n, (_, c) in specs.items()}
    names = rows.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", model string, predicted double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, m in models.items():
                x = batch[columns[n]].to_numpy(float).reshape(len(batch), length, -1)
                yield batch[names].assign(model=n, predicted=m.predict(x) if len(batch) else np.empty(0))

    return rows.mapInPandas(run, schema)


def _prepared(panel: DataFrame, neighbours: DataFrame, columns: Sequence[str], label: str, length: int, first_test: int, change: bool) -> DataFrame:
    """Stored windows with the target, the value before, and whether the row judges the fit (the last step before the test)."""
    both = panel.join(neighbours, ["node", "t"], "left").na.fill(0.0, [f"nbr_{c}" for c in columns])
    rows = windows(both, "node", "t", [*columns, *(f"nbr_{c}" for c in columns)], label, length)
    persisted = graph.persistence(panel, "node", "t", label).select("node", "t", "persisted")
    target = F.col(label) - F.col("persisted") if change else F.col(label)
    return catalog.stored(rows.join(persisted, ["node", "t"]).withColumn("_target", target).withColumn("_judged", F.col("t") == first_test - 1).where("_target IS NOT NULL"), "windows")


def compared(panel: DataFrame, adjacency: DataFrame, columns: Sequence[str], label: str, first_test: int, kinds: Sequence[str] = ("dense", "recurrent", "attentive"), length: int = 3, rounds: int = 150, threshold: float = 0.03) -> DataFrame:
    """(model, r2, rmse, skill, gap, spillover): each kind without and with the neighbours' columns, on the times from ``first_test`` on.

    ``gap`` is what neighbours add to the explained share; above ``threshold`` it counts as spillover."""
    near = with_propagated(adjacency, panel, columns).select("node", "t", *(f"nbr_{c}" for c in columns))
    rows = _prepared(panel, near, columns, label, length, first_test, False)
    seen = {"own": list(columns), "neighbours": [*columns, *(f"nbr_{c}" for c in columns)]}
    specs = {f"{kind}, {name}": (kind, used) for kind in kinds for name, used in seen.items()}
    models, _ = fitted(rows.where(F.col("t") < first_test), specs, "_target", length, judged="_judged", rounds=rounds)
    scores = graph.forecast_scores(predicted(rows.where(F.col("t") >= first_test), models, specs, length), "_target", "predicted", "persisted", "model")
    kind = F.split("model", ", ")[0]
    both = Window.partitionBy(kind)
    of = lambda name: F.max(F.when(F.col("model").endswith(f", {name}"), F.col("r2"))).over(both)
    out = scores.withColumn("gap", of("neighbours") - of("own"))
    return out.select("model", "r2", "rmse", "skill", "gap", (F.col("gap") > threshold).alias("spillover"))


def neighbour_means(panel: DataFrame, edges: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(node, t, nbr_<column>..): the mean over a node's neighbours at the same time."""
    return graph.both_ways(edges).join(panel.select(F.col("node").alias("dst"), "t", *columns), "dst").groupBy(F.col("src").alias("node"), "t").agg(*(F.avg(c).alias(f"nbr_{c}") for c in columns))


def spillover_test(panel: DataFrame, edges: DataFrame, columns: Sequence[str], label: str, first_test: int, *, length: int = 3, hidden: int = 8, rounds: int = 150, threshold: float = 0.01) -> DataFrame:
    """(model, n, r2, skill, gap, spillover) of one recurrent network that sees own values, and of the same network that sees the
    neighbours' means, too. The target is the change from the step before, so persistence explains none of it; ``r2`` is the share of
    the change explained on the times from ``first_test`` on, and ``skill`` the share of persistence's squared error taken away.

    Only the inputs differ, so the gap is what neighbours tell; up to ``threshold`` it is no spillover."""
    rows = _prepared(panel, neighbour_means(panel, edges, columns), columns, label, length, first_test, True)
    specs = {"own": ("recurrent", list(columns)), "own and neighbours": ("recurrent", [*columns, *(f"nbr_{c}" for c in columns)])}
    models, _ = fitted(rows.where(F.col("t") < first_test), specs, "_target", length, judged="_judged", hidden=hidden, rounds=rounds)
    tested = predicted(rows.where(F.col("t") >= first_test), models, specs, length).withColumn("_none", F.lit(0.0))
    scores = graph.forecast_scores(tested, "_target", "predicted", "_none", "model")
    of = lambda name: F.max(F.when(F.col("model") == name, F.col("r2"))).over(Window.partitionBy(F.lit(0)))
    out = scores.withColumn("gap", of("own and neighbours") - of("own"))
    return out.select("model", "n", "r2", "skill", "gap", (F.col("gap") > threshold).alias("spillover"))
