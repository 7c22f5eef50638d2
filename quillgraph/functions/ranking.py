"""Ranks, folds and running shapes over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rank_max(by: Column, keys: list) -> Column:
    """Ascending ranks in which equal values all have their last place."""
    w = Window.partitionBy(*keys).orderBy(by)
    return F.count("*").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))


def rank_average(by: Column, keys: list) -> Column:
    """Ascending ranks in which equal values share the mean of their places."""
    w = Window.partitionBy(*keys).orderBy(by)
    same = F.count("*").over(Window.partitionBy(*keys, by))
    return F.rank().over(w) + (same - 1) / 2.0


def tie_ranks(df: DataFrame, value: str, keys: list[str], rank: str, kind: str = "average", bins: int = 256) -> DataFrame:
    """``df`` with ascending ranks of ``value`` within ``keys`` in which equal values share the mean of their places, or all have the last.

    What rank_average() and rank_max() give, however large a group or a tie is: equal values are counted first, the distinct
    ones dealt into bins of about equal number, and only counts are summed over the bins.
    """
    own = [f"__k{i}" for i in range(len(keys))]
    n = df.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    cuts = n.groupBy(*own).agg(F.percentile_approx("__v", [k / bins for k in range(1, bins)], 4 * bins).alias("__cuts"))
    same = lambda a, b: [a[o].eqNullSafe(b[f"{o}_"]) for o in own] or [F.lit(True)]
    cuts = cuts.select(*[F.col(o).alias(f"{o}_") for o in own], "__cuts")
    binned = n.join(cuts if own else F.broadcast(cuts), same(n, cuts), "left").drop(*[f"{o}_" for o in own])
    binned = binned.withColumn("__bin", F.size(F.filter("__cuts", lambda c: c < F.col("__v")))).drop("__cuts")
    sums = binned.groupBy(*own, "__bin").agg(F.sum("__n").alias("__s"))
    before = F.sum("__s").over(Window.partitionBy(*own).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))  # ``bins`` rows for each group
    sums = sums.select(*[F.col(o).alias(f"{o}_") for o in own], F.col("__bin").alias("__bin_"), F.coalesce(before, F.lit(0)).alias("__before"))
    placed = binned.join(sums, [*same(binned, sums), binned["__bin"] == sums["__bin_"]]).drop(*[f"{o}_" for o in own], "__bin_")
    upto = F.sum("__n").over(Window.partitionBy(*own, "__bin").orderBy("__v")) + F.col("__before")
    at = upto - (F.col("__n") - 1) / 2.0 if kind == "average" else upto
    placed = placed.select(*own, "__v", at.alias(rank))
    got = df.join(placed, [*[F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)], F.col(value).eqNullSafe(F.col("__v"))], "left")
    return got.drop(*own, "__v")


def folds(df: DataFrame, k: int, key: list[str], seed: int = 0, column: str = "fold") -> DataFrame:
    """Rows dealt into k folds by the MD5 of seed and key as text: the same at every run and in any engine, without a global order."""
    named = F.concat_ws("\x01", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
    return df.withColumn(column, (F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long") % k).cast("int"))


def even_folds(df: DataFrame, k: int, key: list[str], group: list[str], seed: int = 0, column: str = "fold") -> DataFrame:
    """As folds(), but of equal size within each group: dealt in turn after a shuffle."""
    w = Window.partitionBy(*group).orderBy(F.xxhash64(F.lit(seed), *key), *key)
    return df.withColumn(column, ((F.row_number().over(w) - 1) % k).cast("int"))


def running_max(value: Column, i: Column, keys: list, step: float = 1e-6) -> Column:
    """Values made to rise by ``step`` at least along ``i``."""
    w = Window.partitionBy(*keys).orderBy(i).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.max(value - i * step).over(w) + i * step


def smooth(value: Column, i: Column, keys: list, width: int) -> Column:
    """The mean over the rows from i - width / 2 to i + width - 1."""
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(i).rowsBetween(-(width // 2), width - 1))


def share(value: Column, keys: list) -> Column:
    """Each value as a part of its group's sum."""
    return value / F.sum(value).over(Window.partitionBy(*keys))


def position(scores: DataFrame, ids: DataFrame, key: str, id_col: str) -> DataFrame:
    """(key, id, rank, score) of the asked (key, id); null for those that aren't in the list."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), id_col)
    ranked = scores.select(key, id_col, "score", F.row_number().over(w).alias("rank"))
    return ids.select(key, id_col).join(ranked, [key, id_col], "left")


def robust_mean(values: Column) -> Column:
    """The mean of an array's values, weighted by a normal density of their places around the middle one: extreme values count little."""
    n = F.size(values)
    mid, width = F.floor(n / 2), F.greatest(F.lit(3), F.floor(n / 4))
    weight = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.exp(-(i - mid) * (i - mid) / (2.0 * width * width)))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    return F.when(n > 0, total(F.zip_with(F.array_sort(values), weight, lambda x, w: x * w)) / total(weight))


def smooth_robust(df: DataFrame, x: str, y: str, keys: list[str], width: int, points: int) -> DataFrame:
    """(keys, x, y): curves of about ``points`` points: every n / (points + 1)-th x with the robust mean of the y around it.

    The window goes from width / 2 before a row to width - 1 after it, as far as there are rows; points of one x share their mean.
    """
    w = Window.partitionBy(*keys).orderBy(x, y)
    around = F.collect_list(F.col(y).cast("double")).over(w.rowsBetween(-(width // 2), width - 1))
    n = F.count("*").over(Window.partitionBy(*keys))
    r = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", n).withColumn("__y", around)
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / (points + 1)))
    i = F.col("__i") - width // 2
    at = r.where((i >= 0) & (F.col("__i") < F.col("__n") - width // 2) & (i % step == 0))
    return at.select(*keys, F.col(x).cast("double").alias(x), robust_mean(F.col("__y")).alias(y)).groupBy(*keys, x).agg(F.avg(y).alias(y))


def normalised(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Summed values (keys.., id, value) as shares of their group's sum."""
    return values.withColumn(value, share(F.col(value), keys))


def largest(values: DataFrame, keys: list[str], ident: str, value: str = "value") -> DataFrame:
    """(keys, ident, value): the id of the largest value of each group, the smaller id in ties."""
    b = F.min(F.struct((-F.col(value)).alias("v"), F.col(ident).alias("i"))).alias("b")
    return values.groupBy(*keys).agg(b).select(*keys, F.col("b.i").alias(ident), (-F.col("b.v")).alias(value))


def divided(values: DataFrame, by: DataFrame, keys: list[str], value: str = "value", weight: str = "weight") -> DataFrame:
    """Each value by its key's weight; keys without one stay."""
    return values.join(by.select(*keys, weight), keys, "left").withColumn(value, F.col(value) / F.coalesce(F.col(weight), F.lit(1.0))).drop(weight)
