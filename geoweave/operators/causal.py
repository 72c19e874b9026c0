"""Causality screens: delay embedding, convergent cross mapping, Granger tests, false discovery control.

Cross mapping of a series is an equi-join of the series with itself on its key: a series is
short (years or months), so its pairs are bounded by its length, whatever the number of
series. Random variants draw by integer hashes or by seeded generators inside grouped
pandas functions, one series at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweave.functions.expressions import centred_moments, f_tail as f_tail_of, let, safe_corr, swept
from geoweave.operators.quantiles import log_range


def embed(df: DataFrame, value: str, time: str, keys: Sequence[str], dims: int = 3, tau: int = 1) -> DataFrame:
    """Adds x0..x<dims-1>, the value ``j tau`` rows before; rows without all of them go."""
    order = Window.partitionBy(*keys).orderBy(time)
    out = df.withColumns({f"x{j}": F.lag(value, j * tau).over(order) if j else F.col(value) for j in range(dims)})
    return out.where(" AND ".join(f"x{j} IS NOT NULL" for j in range(dims)))


def simplex(library: DataFrame, predicted: DataFrame, keys: Sequence[str], dims: int = 3, time: str = "t", target: str = "target") -> DataFrame:
    """(keys, time, observed, estimate): cross-map estimates of the target.

    Each point takes its ``dims + 1`` nearest library points of other times (ties to the
    earlier), weighted by exp(-d / d1) with d1 the least distance, at least 1e-12."""
    lib = library.select(*keys, F.col(time).alias("_t"), F.col(target).alias("_y"), *(F.col(f"x{j}").alias(f"_x{j}") for j in range(dims)))
    both = predicted.join(lib, list(keys)).where(F.col(time) != F.col("_t"))
    d = F.sqrt(sum((F.col(f"x{j}") - F.col(f"_x{j}")) * (F.col(f"x{j}") - F.col(f"_x{j}")) for j in range(dims)))
    near = Window.partitionBy(*keys, time).orderBy("_d", "_t")
    ranked = both.withColumn("_d", d).withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= dims + 1)
    first = F.greatest(F.min("_d").over(Window.partitionBy(*keys, time)), F.lit(1e-12))
    weighed = ranked.withColumn("_w", F.exp(-F.col("_d") / first))
    out = weighed.groupBy(*keys, time).agg(F.first(target).alias("observed"), (F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("estimate"), F.count("*").alias("_k"))
    return out.where(F.col("_k") == dims + 1).drop("_k")


def skill(estimates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, rho, n) of observed against estimated."""
    return estimates.groupBy(*keys).agg(safe_corr(F.col("observed"), F.col("estimate")).alias("rho"), F.count("*").alias("n"))


def ccm_full(df: DataFrame, cause: str, effect: str, keys: Sequence[str], time: str = "t", dims: int = 3, tau: int = 1) -> DataFrame:
    """(keys, rho, n): how well the effect's manifold recovers the cause, with the whole series as library."""
    manifold = embed(df, effect, time, keys, dims, tau).withColumn("target", F.col(cause))
    return skill(simplex(manifold, manifold, keys, dims, time), keys)


def ccm_lagged(df: DataFrame, cause: str, effect: str, keys: Sequence[str], lags: Sequence[int], time: str = "t", dims: int = 3, tau: int = 1) -> DataFrame:
    """(keys, lag, rho, n): the estimate of the cause at ``t`` against its value at ``t + lag``. Only observations move."""
    manifold = embed(df, effect, time, keys, dims, tau).withColumn("target", F.col(cause))
    estimates = simplex(manifold, manifold, keys, dims, time)
    moved = estimates.select(*keys, "estimate", F.explode(F.array(*(F.struct(F.lit(l).alias("lag"), (F.col(time) + l).alias("_t")) for l in lags))).alias("_s")).select(*keys, "estimate", "_s.lag", F.col("_s._t").alias(time))
    seen = df.select(*keys, time, F.col(cause).alias("observed"))
    return skill(moved.join(seen, [*keys, time]), [*keys, "lag"])


def best_lag(lagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The lag of the greatest rho, ties to the least lag."""
    return lagged.groupBy(*keys).agg(F.max_by("lag", F.struct(F.col("rho"), -F.col("lag"))).alias("best_lag"), F.max("rho").alias("best_lag_rho"))


def ccm_bootstrap(df: DataFrame, cause: str, effect: str, keys: Sequence[str], sizes: Sequence[int], boots: int, seed: int = 42, time: str = "t", dims: int = 3, tau: int = 1) -> DataFrame:
    """(keys, size, rho, n_boot): mean skill over libraries of each size, drawn by an integer hash of (seed, size, boot, time)."""
    manifold = embed(df, effect, time, keys, dims, tau).withColumn("target", F.col(cause))
    draws = F.explode(F.array(*(F.struct(F.lit(s).alias("size"), F.lit(b).alias("boot")) for s in sizes for b in range(boots))))
    pool = manifold.withColumn("_draw", draws).select("*", "_draw.size", "_draw.boot").drop("_draw")
    order = Window.partitionBy(*keys, "size", "boot").orderBy(F.xxhash64(F.lit(seed), "size", "boot", time), time)
    library = pool.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.col("size")).drop("_n")
    rho = skill(simplex(library, pool, [*keys, "size", "boot"], dims, time), [*keys, "size", "boot"])
    return rho.groupBy(*keys, "size").agg(F.avg("rho").alias("rho"), F.count("rho").alias("n_boot"))


def library_draw(time: Column, size: Column, boot: Column) -> Column:
    """Integer by whose order a library of a size draws its points: another order for each size and draw."""
    return F.pmod((time + 1).cast("long") * (7919 + 2 * (size * 1000 + boot).cast("long")), F.lit(1_000_003))


def ccm_libraries(df: DataFrame, cause: str, effect: str, keys: Sequence[str], boots: int = 30, time: str = "t", dims: int = 3, tau: int = 1) -> DataFrame:
    """(keys, size, rho, n_boot): mean skill over ``boots`` libraries of each of the sizes dims + 2, a quarter, a half, three quarters and all of a
    series' points. Draws go by :func:`library_draw`; the whole series is one library.

    Distances are taken and sorted once for each point. A library is a filter over its neighbours in that order, so
    all sizes and draws share one pass, and no pair of points is joined again."""
    points = embed(df, effect, time, keys, dims, tau).where(F.col(cause).isNotNull()).withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(time)) - 1)
    names = [f"x{j}" for j in range(dims)]
    other = points.select(*keys, F.col(time).alias("_t"), F.col("_i").alias("_j"), F.col(cause).cast("double").alias("_y"), *(F.col(x).alias(f"_{x}") for x in names))
    distance = F.sqrt(sum((F.col(x) - F.col(f"_{x}")) * (F.col(x) - F.col(f"_{x}")) for x in names))
    both = points.join(other, list(keys)).where(F.col(time) != F.col("_t"))
    near = both.groupBy(*keys, time).agg(F.first(cause).cast("double").alias("observed"), F.array_sort(F.collect_list(F.struct(distance.alias("d"), F.col("_t").alias("t"), F.col("_j").alias("i"), F.col("_y").alias("y")))).alias("near"))
    few = dims + 2
    n = F.size("_points")
    quarters = [F.greatest(F.lit(few), F.floor(n * q / 4).cast("int")) for q in (1, 2, 3)]
    sizes = F.array_sort(F.array_distinct(F.transform(F.array(F.lit(few), *quarters, n), lambda s: F.least(s, n))))

    def drawn(size: Column, boot: Column) -> Column:
        order = F.array_sort(F.transform("_points", lambda t, i: F.struct(library_draw(t, size, boot).alias("h"), t.alias("t"), i.alias("i"))))
        chosen = lambda first: F.transform("_points", lambda t, i: F.array_contains(first, i))
        return F.struct(size.alias("size"), boot.alias("boot"), let(F.transform(F.slice(order, 1, size), lambda o: o["i"]), chosen).alias("in"))

    libraries = F.flatten(F.transform(sizes, lambda s: F.transform(F.sequence(F.lit(1), F.when(s == n, F.lit(1)).otherwise(F.lit(boots))), lambda b: drawn(s, b))))
    drawn_of = points.groupBy(*keys).agg(F.array_sort(F.collect_list(time)).alias("_points")).select(*keys, libraries.alias("_libraries"))

    def estimate(k: Column) -> Column:
        weight = lambda x: F.exp(-x["d"] / F.greatest(F.get(k, 0)["d"], F.lit(1e-12)))
        total = lambda term: F.aggregate(k, F.lit(0.0), lambda s, x: s + term(x))
        return F.when(F.size(k) == dims + 1, total(lambda x: weight(x) * x["y"]) / total(weight))

    found = F.transform("_libraries", lambda l: F.struct(l["size"].alias("size"), l["boot"].alias("boot"), let(F.slice(F.filter("near", lambda x: F.get(l["in"], x["i"])), 1, dims + 1), estimate).alias("estimate")))
    rows = near.join(drawn_of, list(keys)).select(*keys, time, "observed", F.inline(found)).where("estimate IS NOT NULL")
    rho = skill(rows, [*keys, "size", "boot"])
    return rho.groupBy(*keys, "size").agg(F.avg("rho").alias("rho"), F.count("rho").alias("n_boot"))


def regional_links(df: DataFrame, effect: str, causes: Sequence[str], keys: Sequence[str], time: str = "t", *, boots: int = 30, surrogates: int = 200, alpha: float = 0.05, rho: float = 0.3, least_convergence: float = 0.05) -> DataFrame:
    """(keys, driver, n, best_lag, p_value, q_value, rho, convergence, surrogate_p, surrogate_q, link): the whole regional run. Every
    series is tested by Granger's test and by cross mapping with growing libraries and surrogates, both families of p-values are
    controlled for false discoveries, and a link is what both methods find (uncorrected Granger p, skill and convergence)."""
    by = [*keys, "driver"]
    tests = benjamini_hochberg(granger_full(df, effect, causes, keys, time), "p_value")
    long = _long(df, effect, causes, keys, time)
    mapped = convergence(ccm_libraries(long, "x", "y", by, boots, time), by).select(*by, F.col("rho_max_lib").alias("rho"), "convergence")
    chance = surrogate_p(df, effect, causes, keys, surrogates, time=time).select(*by, F.col("p_value").alias("surrogate_p"))
    chance = benjamini_hochberg(chance, "surrogate_p", name="surrogate_q")
    out = tests.join(mapped, by, "left").join(chance, by, "left")
    link = (F.col("p_value") < alpha) & (F.col("rho") > rho) & (F.col("convergence") > least_convergence)
    return out.select(*by, "n", "best_lag", "p_value", "q_value", "rho", "convergence", "surrogate_p", "surrogate_q", F.coalesce(link, F.lit(False)).alias("link"))


def convergence(by_size: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Skill at the largest less that at the smallest library."""
    return by_size.groupBy(*keys).agg((F.max_by("rho", "size") - F.min_by("rho", "size")).alias("convergence"), F.max_by("rho", "size").alias("rho_max_lib"), F.min_by("rho", "size").alias("rho_min_lib"))


def aligned(df: DataFrame, keys: Sequence[str], columns: Sequence[str], least: int = 12) -> DataFrame:
    """Rows where all columns are given, of series with ``least`` such rows or more."""
    whole = df.dropna(subset=list(columns))
    return whole.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("_n") >= least).drop("_n")


def granger_lag1(df: DataFrame, effect: str, cause: str, keys: Sequence[str], time: str = "t") -> DataFrame:
    """(keys, n, f_stat): F of adding the cause's last value to a regression of the effect on its own last value.

    In closed form from the partial correlation r: F = r^2 (n - 3) / (1 - r^2)."""
    order = Window.partitionBy(*keys).orderBy(time)
    rows = df.select(*keys, F.col(effect).alias("y"), F.lag(effect).over(order).alias("a"), F.lag(cause).over(order).alias("b")).where("y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL")
    ya, yb, ab = safe_corr(F.col("y"), F.col("a")), safe_corr(F.col("y"), F.col("b")), safe_corr(F.col("a"), F.col("b"))
    by = rows.groupBy(*keys).agg(ya.alias("ya"), yb.alias("yb"), ab.alias("ab"), F.count("*").alias("n"))
    square = F.try_divide((F.col("yb") - F.col("ya") * F.col("ab")) * (F.col("yb") - F.col("ya") * F.col("ab")), (F.lit(1.0) - F.col("ya") * F.col("ya")) * (F.lit(1.0) - F.col("ab") * F.col("ab")))
    return by.withColumn("_r2", square).select(*keys, "n", F.try_divide(F.col("_r2") * (F.col("n") - 3), F.lit(1.0) - F.col("_r2")).alias("f_stat"))


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


def f_tail(f: float, d1: int, d2: int) -> float:
    """P(F > f)."""
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def _ssr(x: np.ndarray, y: np.ndarray) -> float:
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    r = y - x @ beta
    return float(r @ r)


def adf_statistic(x: np.ndarray, lags: int | None = None) -> float:
    """t of the level in the augmented Dickey-Fuller regression with a constant; lags up to ``lags`` by AIC."""
    dx = np.diff(x)
    most = min(lags if lags is not None else int(12 * (len(x) / 100) ** 0.25), max(0, len(dx) // 2 - 2))
    best = None
    for k in range(most + 1):
        y = dx[most:]
        cols = [np.ones_like(y), x[most:-1], *(dx[most - j : len(dx) - j] for j in range(1, k + 1))]
        z = np.stack(cols, axis=1)
        if len(y) <= z.shape[1]:
            break
        ssr = max(_ssr(z, y), 1e-300)
        aic = len(y) * math.log(ssr / len(y)) + 2 * z.shape[1]
        if best is None or aic < best[0]:
            beta = np.linalg.lstsq(z, y, rcond=None)[0]
            cov = np.linalg.pinv(z.T @ z) * ssr / (len(y) - z.shape[1])
            best = (aic, beta[1] / math.sqrt(max(cov[1, 1], 1e-300)))
    return best[1] if best else math.nan


#: 5 per cent critical value of the test with a constant: MacKinnon (2010), coefficients of 1, 1/n, 1/n^2, 1/n^3.
ADF_5 = (-2.86154, -2.8903, -4.234, -40.040)


def is_stationary(x: np.ndarray) -> bool:
    if len(x) < 8 or np.std(x) < 1e-12:
        return True
    n = len(x)
    return adf_statistic(x) < sum(c / n**i for i, c in enumerate(ADF_5))


def granger(y: np.ndarray, x: np.ndarray, most: int = 3) -> dict:
    """The lag of least p of F tests that x helps to predict y; both are differenced once if either isn't stationary."""
    differenced = not (is_stationary(y) and is_stationary(x))
    if differenced:
        y, x = np.diff(y), np.diff(x)
    best = {"f_stat": None, "p_value": None, "best_lag": None, "differenced": differenced, "n": len(y)}
    for k in range(1, min(most, (len(y) - 1) // 3) + 1):
        target = y[k:]
        own = [np.ones(len(target)), *(y[k - j : len(y) - j] for j in range(1, k + 1))]
        other = [x[k - j : len(x) - j] for j in range(1, k + 1)]
        free = len(target) - 1 - 2 * k
        if free <= 0:
            break
        small, large = _ssr(np.stack(own, axis=1), target), _ssr(np.stack(own + other, axis=1), target)
        if large <= 1e-300:
            continue
        f = max(0.0, (small - large) / k / (large / free))
        p = f_tail(f, k, free)
        if best["p_value"] is None or p < best["p_value"]:
            best |= {"f_stat": f, "p_value": p, "best_lag": k}
    return best


def _long(df: DataFrame, effect: str, causes: Sequence[str], keys: Sequence[str], time: str) -> DataFrame:
    """(keys, driver, time, y, x) of rows where both are given."""
    pairs = F.inline(F.array(*(F.struct(F.lit(c).alias("driver"), F.col(c).cast("double").alias("x")) for c in causes)))
    return df.select(*keys, time, F.col(effect).cast("double").alias("y"), pairs).where("y IS NOT NULL AND x IS NOT NULL AND NOT isnan(y) AND NOT isnan(x)")


def adf_of(series: Column) -> Column:
    """(n, stat): the statistic of :func:`adf_statistic` of an array of values, as an expression.

    The moments of the level and all its lagged changes are taken once; sweeping them in one lag after the other gives
    every model's squared error, level coefficient and its variance, among which the information criterion chooses."""

    def of(x: Column) -> Column:
        n = F.size(x)
        most = F.greatest(F.lit(0), F.least(F.floor(12 * F.pow(n / 100.0, 0.25)).cast("int"), F.floor((n - 1) / 2).cast("int") - 2))
        change = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.get(x, i) - F.get(x, i - 1))
        return let(F.struct(x.alias("x"), n.alias("n"), most.alias("most"), change.alias("change")), chosen)

    def chosen(v: Column) -> Column:
        most, n = v["most"], v["n"]
        # One row for each change that has all lags: the level, the lagged changes, and the change itself.
        row = lambda t: F.concat(F.array(F.get(v["x"], t)), F.reverse(F.slice(v["change"], t - most + 1, most)), F.array(F.get(v["change"], t)))
        rows = F.transform(F.sequence(most, n - 2), row)
        count, last = (n - 1 - most).cast("double"), most + 1
        start = F.struct(centred_moments(rows, most + 2).alias("m"), F.lit(float("inf")).alias("aic"), F.lit(None).cast("double").alias("t"))

        def judged(s: Column, k: Column, m: Column) -> Column:
            error, level = F.greatest(F.get(F.get(m, last), last), F.lit(1e-300)), F.get(m, 0)
            free = count - k - 2
            aic = count * F.log(error / count) + 2 * (k + 2)
            t = F.get(level, last) / F.sqrt(F.greatest(-F.get(level, 0) * error / free, F.lit(1e-300)))
            return let(F.struct(aic.alias("aic"), t.alias("t")), lambda w: let((free > 0) & (w["aic"] < s["aic"]) & w["t"].isNotNull(), lambda better: F.struct(m.alias("m"), F.when(better, w["aic"]).otherwise(s["aic"]).alias("aic"), F.when(better, w["t"]).otherwise(s["t"]).alias("t"))))

        return F.aggregate(F.sequence(F.lit(0), most), start, lambda s, k: let(swept(s["m"], k), lambda m: judged(s, k, m)), lambda s: s["t"])

    return F.struct(F.size(series).alias("n"), let(series, of).alias("stat"))


def stationary_of(series: Column) -> Column:
    """Whether the test with a constant rejects a unit root at 5 per cent; short and constant series count as stationary."""

    def of(x: Column) -> Column:
        n = F.size(x)
        mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
        squares = let(mean, lambda m: F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)))
        limit = sum((F.lit(c) / F.pow(n.cast("double"), i) for i, c in enumerate(ADF_5) if i), F.lit(ADF_5[0]))
        return F.when((n < 8) | (F.sqrt(squares / n) < 1e-12), F.lit(True)).otherwise(F.coalesce(adf_of(x)["stat"] < limit, F.lit(False)))

    return let(series, of)


def _errors(matrix: Column, k: int) -> Column:
    """Squared errors of the last column after the first ``k`` and after twice as many are swept in."""
    error = lambda m: F.get(F.get(m, 2 * k), 2 * k)
    by = lambda m, lo, hi: F.aggregate(F.sequence(F.lit(lo), F.lit(hi - 1)), m, swept)
    return let(by(matrix, 0, k), lambda own: F.struct(error(own).alias("own"), error(by(own, k, 2 * k)).alias("both")))


def granger_lags(long: DataFrame, keys: Sequence[str], time: str = "t", lags: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """(keys, lag, n, f_stat, p_value): F tests that ``lag`` values of x before help to predict y beyond as many of its own.

    One aggregation takes the moments of y and its and x's lagged values, for every lag over the rows that have it;
    sweeping y's own lags and then x's gives both squared errors. A lag is tested where more rows than parameters are left;
    where the lagged values determine each other there is no result."""
    order, deepest = Window.partitionBy(*keys).orderBy(time), max(lags)
    rows = long.withColumns({f"{v}{k}": F.lag(v, k).over(order) for v in "yx" for k in range(1, deepest + 1)})
    sums, tests = [F.count("*").alias("_rows")], []
    for k in lags:
        names = [*(f"y{j}" for j in range(1, k + 1)), *(f"x{j}" for j in range(1, k + 1)), "y"]
        there, n = F.col(f"y{k}").isNotNull(), f"_n{k}"
        sums.append(F.count(F.when(there, 1)).alias(n))
        sums += [F.covar_pop(F.when(there, F.col(a)), F.col(b)).alias(f"_{k}{a}{b}") for i, a in enumerate(names) for b in names[i:]]
        at = {(a, b): f"_{k}{a}{b}" for i, a in enumerate(names) for b in names[i:]}
        matrix = F.array(*(F.array(*(F.col(at.get((a, b)) or at[b, a]) * F.col(n) for b in names)) for a in names))
        tests.append(F.struct(F.lit(k).alias("lag"), F.col(n).alias("n"), _errors(matrix, k).alias("e")))
    out = rows.groupBy(*keys).agg(*sums).select(*keys, "_rows", F.explode(F.array(*tests)).alias("t")).select(*keys, "_rows", "t.lag", "t.n", "t.e.own", "t.e.both")
    free = F.col("n") - 1 - 2 * F.col("lag")
    f = F.greatest(F.lit(0.0), (F.col("own") - F.col("both")) / F.col("lag") / (F.col("both") / free))
    kept = out.where((free > 0) & (F.col("lag") <= F.floor((F.col("_rows") - 1) / 3))).withColumn("f_stat", F.when(F.col("both") > 1e-300, f))
    return kept.select(*keys, "lag", "n", "f_stat", f_tail_of(F.col("f_stat"), F.col("lag"), free).alias("p_value"))


def granger_full(df: DataFrame, effect: str, causes: Sequence[str], keys: Sequence[str], time: str = "t", most: int = 3, least: int = 12) -> DataFrame:
    """(keys, driver, n, best_lag, f_stat, p_value, differenced) of series with ``least`` rows or more: the lag of least p (ties to the
    fewest lags). Both series are differenced once if either isn't stationary. Expressions only; a series (years or
    months of one key) is gathered by one aggregation for the stationarity test."""
    long, by = _long(df, effect, causes, keys, time), [*keys, "driver"]
    series = long.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(time, "y", "x"))).alias("s"))
    flags = series.where(F.size("s") >= least).select(*by, (~(stationary_of(F.col("s.y")) & stationary_of(F.col("s.x")))).alias("differenced"))
    order = Window.partitionBy(*by).orderBy(time)
    change = {v: F.when(F.col("differenced"), F.col(v) - F.lag(v).over(order)).otherwise(F.col(v)) for v in "yx"}
    used = long.join(flags, by).withColumns(change).where("y IS NOT NULL AND x IS NOT NULL")
    tests = granger_lags(used, by, time, range(1, most + 1))
    best = tests.where("p_value IS NOT NULL").groupBy(*by).agg(F.min(F.struct("p_value", "lag", "f_stat")).alias("b"))
    sizes = used.groupBy(*by).agg(F.count("*").alias("n"), F.first("differenced").alias("differenced"))
    return sizes.join(best, by, "left").select(*by, "n", F.col("b.lag").alias("best_lag"), "b.f_stat", "b.p_value", "differenced")


def surrogates(x: np.ndarray, count: int, rng: np.random.Generator) -> np.ndarray:
    """(count, len(x)): series with the spectrum of ``x``, each of whose waves is turned by a random angle.

    The mean, and of even lengths the wave of highest frequency, have no angle and stay."""
    spectrum = np.fft.rfft(x)
    waves = slice(1, (len(x) + 1) // 2)
    many = np.repeat(spectrum[None], count, axis=0)
    many[:, waves] *= np.exp(2j * np.pi * rng.random((count, waves.stop - waves.start)))
    return np.fft.irfft(many, n=len(x), axis=1)


def cross_maps(effect: np.ndarray, causes: np.ndarray, dims: int = 3, tau: int = 1) -> np.ndarray:
    """Skill for each row of ``causes`` with the whole series as library: the NumPy form of ``ccm_full``.

    Neighbours and weights come from the effect alone, so they serve all causes; NaN where there is no skill."""
    first = (dims - 1) * tau
    m = np.stack([effect[first - j * tau : len(effect) - j * tau] for j in range(dims)], axis=1)
    y = causes[:, first:]
    if m.shape[0] < dims + 2:
        return np.full(len(causes), np.nan)
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, : dims + 1]
    dist = np.take_along_axis(d, near, axis=1)
    w = np.exp(-dist / np.maximum(dist[:, :1], 1e-12))
    estimate = (w * y[:, near]).sum(axis=2) / w.sum(axis=1)
    a, b = y - y.mean(axis=1, keepdims=True), estimate - estimate.mean(axis=1, keepdims=True)
    spread = np.sqrt((a * a).mean(axis=1)), np.sqrt((b * b).mean(axis=1))
    good = (spread[0] >= 1e-12) & (spread[1] >= 1e-12)
    return np.where(good, (a * b).mean(axis=1) / np.where(good, spread[0] * spread[1], 1), np.nan)


def cross_map(effect: np.ndarray, cause: np.ndarray, dims: int = 3, tau: int = 1) -> float:
    return float(cross_maps(effect, cause[None], dims, tau)[0])


def surrogate_p(df: DataFrame, effect: str, causes: Sequence[str], keys: Sequence[str], count: int = 200, seed: int = 42, time: str = "t", dims: int = 3) -> DataFrame:
    """(keys, driver, rho, p_value): share of ``count`` surrogates of the cause that do as well, (hits + 1) / (count + 1)."""
    long = df.select(*keys, time, F.col(effect).alias("y"), F.explode(F.array(*(F.struct(F.lit(c).alias("driver"), F.col(c).cast("double").alias("x")) for c in causes))).alias("_d")).select(*keys, time, "y", "_d.driver", "_d.x")

    def test(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        import zlib

        rows = rows.dropna(subset=["y", "x"]).sort_values(time)
        y, x = rows["y"].to_numpy(float), rows["x"].to_numpy(float)
        if len(y) < 12:
            return pd.DataFrame()
        rng = np.random.default_rng([seed, zlib.crc32(repr(key).encode())])
        rho = cross_map(y, x, dims)
        hits = int((cross_maps(y, surrogates(x, count, rng), dims) >= rho).sum())
        return pd.DataFrame([dict(zip([*keys, "driver"], key)) | {"rho": rho, "p_value": (hits + 1) / (count + 1)}])

    kinds = dict(df.dtypes)
    return long.groupBy(*keys, "driver").applyInPandas(test, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", driver string, rho double, p_value double")


def per_pixel_ccm(df: DataFrame, pixel: str, effect: str, cause: str, time: str = "year", dims: int = 2) -> DataFrame:
    """(pixel, rho): full-library skill of every pixel's short series, many pixels at a time.

    Rows of a pixel must have all values; constant series give null. Series are gathered by
    one aggregation and mapped in Arrow batches, so no pair of rows is ever shuffled."""
    series = df.groupBy(pixel).agg(F.array_sort(F.collect_list(F.struct(time, effect, cause))).alias("s"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for s in batch["s"]:
                e, c = np.array([r[effect] for r in s], float), np.array([r[cause] for r in s], float)
                good = len(e) > dims + 2 and np.isfinite(e).all() and np.isfinite(c).all() and min(e.std(), c.std()) >= 1e-6
                rho = cross_map(e, c, dims) if good else math.nan
                out.append(None if math.isnan(rho) else rho)
            yield pd.DataFrame({pixel: batch[pixel], "rho": pd.Series(out, dtype=float)})

    return series.mapInPandas(run, f"{pixel} {dict(df.dtypes)[pixel]}, rho double").withColumn("rho", F.nanvl("rho", F.lit(None)))


def running_counts(counts: DataFrame, value: str, number: str, keys: Sequence[str], name: str = "_upto") -> DataFrame:
    """Adds how many rows have at most this value, from one row for each distinct one.

    Values are dealt into ranges of their logarithm, 1,024 to an octave (so values that pile up near
    zero are told apart, too). Sums are made within a range and completed from one row for each
    range: no task sees all values of a family."""
    ranges = counts.withColumn("_b", log_range(F.col(value).cast("double")))
    family = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    totals = ranges.groupBy(*keys, "_b").agg(F.sum(number).alias("_c"))
    totals = totals.withColumns({"_before": F.sum("_c").over(family.orderBy("_b")) - F.col("_c"), "_all": F.sum("_c").over(family)}).drop("_c")
    inside = F.sum(number).over(Window.partitionBy(*keys, "_b").orderBy(value))
    return ranges.withColumn("_in", inside).join(totals, [*keys, "_b"]).withColumn(name, F.col("_in") + F.col("_before")).drop("_in", "_before")


def benjamini_hochberg(df: DataFrame, p: str = "p_value", *, keys: Sequence[str] = (), name: str = "q_value") -> DataFrame:
    """Adds the false-discovery rate of each p-value; rows without one keep none and don't count.

    Equal p-values have equal rates, so the work is done on one row for each distinct p-value (however
    many rows share it) in ranges; the running minimum from the largest on is completed as the ranks are."""
    counts = df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("_c"))
    ranked = running_counts(counts, p, "_c", keys).withColumn("_q", F.col(p) * F.col("_all") / F.col("_upto"))
    family = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    later = ranked.groupBy(*keys, "_b").agg(F.min("_q").alias("_least"))
    later = later.select(*keys, "_b", F.min("_least").over(family.orderBy("_b").rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    least = F.min("_q").over(Window.partitionBy(*keys, "_b").orderBy(p).rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rates = ranked.withColumn("_least", least).join(later, [*keys, "_b"]).select(*keys, p, F.least("_least", "_later", F.lit(1.0)).alias(name))
    return df.where(F.col(p).isNotNull()).join(rates, [*keys, p]).select(*df.columns, name).unionByName(df.where(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double")))


def consensus(granger_rows: DataFrame, ccm_rows: DataFrame, keys: Sequence[str], alpha: float = 0.05, rho: float = 0.3, least_convergence: float = 0.05) -> DataFrame:
    """Links that both methods find: p below ``alpha``, and skill and convergence above their limits."""
    return granger_rows.where(F.col("p_value") < alpha).join(ccm_rows.where((F.col("rho") > rho) & (F.col("convergence") > least_convergence)), list(keys))


def link_table(zones: DataFrame, drivers: DataFrame, granger_rows: DataFrame, links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every zone with every driver: the strength -log10 p (at most 6) where tested, and whether it is a consensus link.

    The grid of few zones and drivers is the result itself."""
    every = zones.crossJoin(F.broadcast(drivers))
    out = every.join(granger_rows.select(*keys, "p_value"), list(keys), "left").join(links.select(*keys).withColumn("link", F.lit(True)), list(keys), "left")
    return out.select(*keys, (-F.log10(F.greatest("p_value", F.lit(1e-6)))).alias("strength"), F.coalesce("link", F.lit(False)).alias("link"))


def coupled_logistic(n: int = 1200, rx: float = 3.7, ry: float = 3.7, bxy: float = 0.0, byx: float = 0.32, x: float = 0.4, y: float = 0.2, skip: int = 100) -> list[tuple[int, float, float]]:
    """(t, x, y) of two logistic maps of which x drives y."""
    out = []
    for t in range(n):
        if t >= skip:
            out.append((t - skip, x, y))
        x, y = x * (rx - rx * x - bxy * y), y * (ry - ry * y - byx * x)
        x, y = min(1.0, max(0.0, x)), min(1.0, max(0.0, y))
    return out


#: Fixed values of the regional screen: least pixels of a zone, least years of either test, and the years from which three dimensions are used.
LEAST_PIXELS, LEAST_GRANGER, LEAST_CCM, LEAST_3D = 100, 12, 15, 18


def causal_flag(rho: Column, converged: Column) -> Column:
    return (rho > 0.3) & (converged > 0.05)


def regional_screen(series: DataFrame, pixels: DataFrame, effect: str, causes: Sequence[str], zone: str = "zone", time: str = "t", least_pixels: int = LEAST_PIXELS) -> DataFrame:
    """(zone, driver, n_years, dims, rho, causal..) of every zone with enough pixels and every driver with enough years.

    ``pixels`` has (zone, n). Whole-library skill in two or three dimensions by the number of years, skill
    with a library of dims + 2 points (those of the least hash), and their difference as convergence."""
    big = pixels.where(F.col("n") >= least_pixels).select(zone)
    long = series.join(big, zone, "left_semi").select(zone, time, F.col(effect).alias("y"), F.explode(F.array(*(F.struct(F.lit(c).alias("driver"), F.col(c).cast("double").alias("x")) for c in causes))).alias("_d")).select(zone, time, "y", "_d.driver", "_d.x")
    keys = [zone, "driver"]
    held = aligned(long, keys, ["y", "x"], LEAST_CCM).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    out = None
    for dims, some in ((2, held.where(F.col("_n") < LEAST_3D)), (3, held.where(F.col("_n") >= LEAST_3D))):
        manifold = embed(some, "y", time, keys, dims).withColumn("target", F.col("x"))
        order = Window.partitionBy(*keys).orderBy(F.pmod(F.col(time) * 7919 + 104729, F.lit(1_000_003)), time)
        few = manifold.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= dims + 2).drop("_k")
        whole = skill(simplex(manifold, manifold, keys, dims, time), keys).select(*keys, F.col("rho").alias("rho_max_lib"))
        least = skill(simplex(few, manifold, keys, dims, time), keys).select(*keys, F.col("rho").alias("rho_min_lib"))
        years = some.groupBy(*keys).agg(F.count("*").alias("n_years"), F.lit(dims).alias("dims"))
        part = years.join(whole, keys, "left").join(least, keys, "left")
        out = part if out is None else out.unionAll(part)
    out = out.withColumn("convergence", F.col("rho_max_lib") - F.col("rho_min_lib"))
    return out.withColumn("causal", F.coalesce(causal_flag(F.col("rho_max_lib"), F.col("convergence")), F.lit(False)))
