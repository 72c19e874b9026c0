"""Accuracy, baselines, folds and samples."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reference_points(points: DataFrame, column: str = "reference") -> DataFrame:
    """Interpreted points with a usable class: blank, non-numeric and non-positive ones go."""
    value = F.expr(f"try_cast(trim(cast({column} AS string)) AS double)").cast("int")
    return points.withColumn(column, value).where(F.col(column) > 0)


def confusion(points: DataFrame, mapped: str = "mapped", reference: str = "reference") -> DataFrame:
    return points.groupBy(F.col(mapped).alias("mapped"), F.col(reference).alias("reference")).agg(F.count("*").alias("n"))


def overall_accuracy(matrix: DataFrame, group: Sequence[int] | None = None) -> DataFrame:
    """(n, n_correct, accuracy); with ``group`` over points that are of it on either side."""
    if group is not None:
        matrix = matrix.where(F.col("mapped").isin(*group) | F.col("reference").isin(*group))
    hit = F.coalesce(F.sum(F.when(F.col("mapped") == F.col("reference"), F.col("n"))), F.lit(0))
    n = F.coalesce(F.sum("n"), F.lit(0))
    return matrix.agg(n.alias("n"), hit.alias("n_correct"), F.round(F.try_divide(hit.cast("double"), n), 6).alias("accuracy"))


def accuracy_by_class(matrix: DataFrame) -> DataFrame:
    """(class, user_accuracy, producer_accuracy): right over mapped, and over reference; null where there are none."""
    cells = matrix.select(F.col("mapped").alias("class"), F.col("n").alias("m"), F.lit(0).cast("long").alias("r"), F.when(F.col("mapped") == F.col("reference"), F.col("n")).otherwise(0).alias("hit"))
    cells = cells.unionAll(matrix.select("reference", F.lit(0).cast("long"), "n", F.lit(0).cast("long")))
    by = cells.groupBy("class").agg(F.sum("m").alias("m"), F.sum("r").alias("r"), F.sum("hit").alias("hit"))
    return by.select("class", F.round(F.try_divide(F.col("hit").cast("double"), F.col("m")), 6).alias("user_accuracy"), F.round(F.try_divide(F.col("hit").cast("double"), F.col("r")), 6).alias("producer_accuracy"))


def label_counts(df: DataFrame, label: str, predicted: str, *keys: str, weight: str | None = None) -> DataFrame:
    """(keys, y, p, n): rows of each pair of classes, or the sum of their ``weight``."""
    return df.groupBy(*keys, F.col(label).alias("y"), F.col(predicted).alias("p")).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))


def f1_by_class(df: DataFrame, label: str, predicted: str, *keys: str, weight: str | None = None) -> DataFrame:
    """(keys, class, support, f1) for every class seen on either side; 0 where undefined."""
    return _f1(label_counts(df, label, predicted, *keys, weight=weight), keys)


def _f1(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    sides = F.array(F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"), hit.alias("hit")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"), F.lit(0).cast("long").alias("hit")))
    by = cells.select(*keys, F.inline(sides)).groupBy(*keys, "class").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit"))
    return by.withColumn("f1", F.coalesce(F.try_divide(F.lit(2.0) * F.col("hit"), F.col("support") + F.col("called")), F.lit(0.0)))


def classification_scores(df: DataFrame, label: str, predicted: str, labels: int, *keys: str, weight: str | None = None) -> DataFrame:
    """(keys, accuracy, macro_f1, weighted_f1). The macro mean is over ``labels`` classes, those absent counting 0.

    All scores come from the counts of pairs of classes: the rows are read once."""
    f1 = _f1(label_counts(df, label, predicted, *keys, weight=weight), keys)
    return f1.groupBy(*keys).agg(
        F.round(F.sum("hit") / F.sum("support"), 6).alias("accuracy"), F.round(F.sum("f1") / labels, 6).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 6).alias("weighted_f1")
    )


def block_id(x: Column, y: Column, size: float = 100_000.0, truncate: bool = False) -> Column:
    """Square block of a coordinate; ``truncate`` rounds towards zero, which doubles the blocks at the axes."""
    cell = (lambda v: F.floor(v / size)) if not truncate else (lambda v: F.when(v < 0, F.ceil(v / size)).otherwise(F.floor(v / size)))
    return cell(x).cast("long") * 100_000 + cell(y).cast("long")


def spatial_folds(df: DataFrame, folds: int = 5, truncate: bool = False, x: str = "x", y: str = "y") -> DataFrame:
    """Adds block and fold: blocks are shuffled by an integer hash and dealt in turn, so folds have equal numbers of blocks.

    Only the distinct blocks are ranked; they are few against the rows and joined back."""
    df = df.withColumn("block", block_id(F.col(x), F.col(y), truncate=truncate))
    blocks = df.select("block").distinct()
    order = Window.orderBy(F.pmod(F.col("block") * 7919 + 104729, F.lit(1_000_003)), "block")
    return df.join(blocks.withColumn("fold", ((F.row_number().over(order) - 1) % folds).cast("int")), "block")


def persistence_baseline(pairs: DataFrame, labels: int) -> DataFrame:
    """(fold, accuracy, macro_f1, weighted_f1) of predicting the source class."""
    return classification_scores(pairs, "to_class", "from_class", labels, "fold")


def markov_baseline(pairs: DataFrame, labels: int, folds: int = 5) -> DataFrame:
    """(fold, ...) of predicting the most frequent destination of the source class in the other folds.

    Ties go to the least class, sources that the other folds lack to themselves. Predictions and
    scores come from the counts by fold and pair of classes, so the pairs are read once."""
    counts = pairs.groupBy("fold", "from_class", "to_class").agg(F.count("*").alias("n"))
    total = counts.groupBy("from_class", "to_class").agg(F.sum("n").alias("total"))
    every = total.crossJoin(F.broadcast(pairs.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold"))))
    cells = every.join(counts, ["fold", "from_class", "to_class"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rest = F.col("total") - F.col("n")
    best = F.max_by(F.when(rest > 0, F.col("to_class")), F.when(rest > 0, F.struct(rest, -F.col("to_class")))).over(Window.partitionBy("fold", "from_class"))
    scored = cells.withColumn("predicted", F.coalesce(best, F.col("from_class"))).where("n > 0")
    return classification_scores(scored, "to_class", "predicted", labels, "fold", weight="n")


def mean_of_folds(scores: DataFrame) -> DataFrame:
    return scores.agg(*(F.round(F.avg(c), 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")))


def draw(*columns: str, seed: int = 42, modulus: int = 1_000_003) -> Column:
    """A repeatable integer rank from key columns, by arithmetic alone."""
    mixed = F.lit(seed).cast("long")
    for c in columns:
        mixed = F.pmod(mixed * 31 + F.col(c).cast("long") * 7919 + 12345, F.lit(modulus))
    return F.pmod(mixed * 48271, F.lit(modulus))


def stratified_sample(df: DataFrame, stratum: str, key: str, per_class: int) -> DataFrame:
    """``per_class`` rows of each stratum by the draw of their key."""
    order = Window.partitionBy(stratum).orderBy(draw(key), key)
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_class).drop("_n")


def log_quotas(df: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """(keys, n, quota): shares of ``size`` in proportion to log(1 + n), halves to even, at most n."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum(F.log1p("n")).alias("total"))
    quota = F.least(F.col("n"), F.bround(F.round(F.log1p("n") / F.col("total") * size, 9)).cast("long"))
    return counts.crossJoin(F.broadcast(total)).select(*keys, "n", quota.alias("quota"))


def quota_sample(df: DataFrame, quotas: DataFrame, keys: Sequence[str], key: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(draw(key), key)
    ranked = df.withColumn("_n", F.row_number().over(order)).join(quotas.select(*keys, "quota"), list(keys))
    return ranked.where(F.col("_n") <= F.col("quota")).drop("_n", "quota")


def held_out(df: DataFrame, key: str, share: float = 0.1, least: int = 5000) -> DataFrame:
    """Adds ``held``: a repeatable random part, ``share`` of the rows or about ``least``, whichever is more; all if there are fewer."""
    n = df.agg(F.greatest(F.lit(share), F.least(F.lit(1.0), F.try_divide(F.lit(float(least)), F.count("*")))).alias("_share"))
    return df.crossJoin(F.broadcast(n)).withColumn("held", draw(key) < F.col("_share") * 1_000_003).drop("_share")


def random_folds(df: DataFrame, key: str, folds: int = 5) -> DataFrame:
    """Adds fold by the draw of a key, for rows without coordinates."""
    return df.withColumn("fold", F.pmod(draw(key), F.lit(folds)).cast("int"))


def stride_sample(cells: DataFrame, stride: int, order: Sequence[str] = ("r", "c")) -> DataFrame:
    """Every ``stride``-th cell in row-major order. Ranks within rows are added to the cells before each row, so no task sees all cells."""
    row = order[0]
    starts = cells.groupBy(row).agg(F.count("*").alias("_n"))
    starts = starts.select(row, (F.sum("_n").over(Window.orderBy(row)) - F.col("_n")).alias("_before"))
    ranked = cells.withColumn("_rank", F.row_number().over(Window.partitionBy(row).orderBy(*order[1:])) - 1)
    return ranked.join(starts, row).where((F.col("_rank") + F.col("_before")) % stride == 0).drop("_rank", "_before")


def area_weighted_accuracy(matrix: DataFrame, areas: DataFrame) -> DataFrame:
    """(class, area, area_se, user, user_se, producer, producer_se) of a stratified sample whose strata are the mapped classes.

    ``matrix`` has (mapped, reference, n), ``areas`` (class, area) of the map. A point of a stratum stands for its share of the map, so
    areas and producers' accuracies are estimated with those shares, with the standard errors of stratified sampling. A stratum with one
    point has no error of its own and counts as certain; classes without points in the map's stratum have no user's accuracy."""
    total = areas.agg(F.sum("area").alias("_total"))
    strata = matrix.groupBy("mapped").agg(F.sum("n").alias("_m")).join(areas.select(F.col("class").alias("mapped"), "area"), "mapped").join(F.broadcast(total), how="cross")
    cells = matrix.join(strata.select("mapped", "_m", (F.col("area") / F.col("_total")).alias("w"), "_total"), "mapped").withColumn("p", F.col("n") / F.col("_m"))
    spread = F.coalesce(F.try_divide(F.col("p") * (1 - F.col("p")), F.col("_m") - 1), F.lit(0.0))
    cells = cells.withColumns({"share": F.col("w") * F.col("p"), "part": F.col("w") * F.col("w") * spread, "own": F.col("mapped") == F.col("reference"), "spread": spread})
    only = lambda c: F.sum(F.when(F.col("own"), F.col(c)))
    reference = cells.groupBy(F.col("reference").alias("class")).agg(
        F.sum("share").alias("share"), F.sum("part").alias("variance"), only("share").alias("hit"), only("w").alias("w"), only("spread").alias("spread"),
        F.sum(F.when(~F.col("own"), F.col("part"))).alias("others"), F.first("_total").alias("_total"),
    )
    user = cells.groupBy(F.col("mapped").alias("class")).agg(F.coalesce(only("p"), F.lit(0.0)).alias("user"), F.sqrt(F.coalesce(only("spread"), F.lit(0.0))).alias("user_se"))
    hit = F.coalesce("hit", F.lit(0.0))
    producer = F.try_divide(hit, F.col("share"))
    w, s, others = (F.coalesce(c, F.lit(0.0)) for c in ("w", "spread", "others"))
    variance = F.try_divide(w * w * (1 - producer) * (1 - producer) * s + producer * producer * others, F.col("share") * F.col("share"))
    by = reference.select("class", (F.col("share") * F.col("_total")).alias("area"), (F.sqrt("variance") * F.col("_total")).alias("area_se"), producer.alias("producer"), F.sqrt(variance).alias("producer_se"))
    return by.join(user, "class", "full").select("class", "area", "area_se", "user", "user_se", "producer", "producer_se")


def area_weighted_overall(matrix: DataFrame, areas: DataFrame, z: float = 1.96) -> DataFrame:
    """(accuracy, se, low, high): the share of the mapped area that is right, and its interval of ``z`` standard errors."""
    strata = matrix.groupBy(F.col("mapped").alias("class")).agg(F.sum("n").alias("m"), F.sum(F.when(F.col("mapped") == F.col("reference"), F.col("n")).otherwise(0)).alias("hit")).join(areas, "class")
    total = strata.crossJoin(F.broadcast(areas.agg(F.sum("area").alias("_total"))))
    w, u = F.col("area") / F.col("_total"), F.col("hit") / F.col("m")
    one = total.agg(F.sum(w * u).alias("accuracy"), F.sqrt(F.sum(w * w * F.coalesce(F.try_divide(u * (1 - u), F.col("m") - 1), F.lit(0.0)))).alias("se"))
    return one.select("accuracy", "se", (F.col("accuracy") - z * F.col("se")).alias("low"), (F.col("accuracy") + z * F.col("se")).alias("high"))


#: Most rows, about, that change places with each other in a permutation.
LOT = 200_000


def permuted(df: DataFrame, key: str, columns: Sequence[str], *carried: str) -> DataFrame:
    """(key, permuted, columns.., carried..): every row once for each column with another row's value in that column, and once as it is (``permuted`` null).

    Rows are dealt to lots by a hash of ``key``, which tells them apart, and ordered by it there; column i takes the values i + 1 places on in
    that random order, around the lot's end. So one shuffle of the rows as they are moves the values of all columns, and the variants are made behind it."""
    others = [c for c in dict.fromkeys(carried) if c != key and c not in columns]
    rows = df.select(F.xxhash64(key, F.lit(42)).alias("_h"), key, *(F.col(c).cast("double").alias(c) for c in columns), *others)
    types = dict(rows.dtypes)
    names = [key, "permuted", *columns, *others]
    schema = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        lot = pa.Table.from_batches(held).sort_by([("_h", "ascending"), (key, "ascending")]).combine_chunks()
        n = lot.num_rows
        for i, c in [(None, None), *enumerate(columns)]:
            out = {x: lot[x] for x in names if x != "permuted"} | {"permuted": pa.array([c] * n, pa.string())}
            if c is not None:
                out[c] = lot[c].take(pa.array((np.arange(n) + 1 + i % max(n - 1, 1)) % n))
            yield from pa.table({x: out[x] for x in names}).to_batches(max_chunksize=1 << 16)

    return rows.repartition(df.count() // LOT + 1, "_h").mapInArrow(run, schema)


def permutation_importance(df: DataFrame, key: str, columns: Sequence[str], label: str, predicted, *carried: str) -> DataFrame:
    """(feature, accuracy, importance): what accuracy a model loses when a column is permuted. ``predicted`` takes a table with the columns, ``label``
    and ``carried`` and adds ``predicted``; it is called once, for all variants together, and its rows are made once."""
    by = predicted(permuted(df, key, columns, label, *carried)).groupBy("permuted").agg(F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("accuracy"))
    base = F.max(F.when(F.col("permuted").isNull(), F.col("accuracy"))).over(Window.partitionBy(F.lit(0)))  # a row for each column
    return by.withColumn("_all", base).where("permuted IS NOT NULL").select(F.col("permuted").alias("feature"), "accuracy", (F.col("_all") - F.col("accuracy")).alias("importance"))
